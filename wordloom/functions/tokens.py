"""The tokenizer, n-grams and small text functions, on built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.functions.characters import ENDING, NUMBER, OTHER, RUN, SPACE, SUBSCRIPT, WORD_CHAR, expanding_characters, lower_case_pairs
from wordloom.functions.urls import without_urls

#: Matches one after the other, each with the spaces or the ending sign, marks and spaces after it, the word in the group: a
#: number before a plain space; a run with a word of two characters at least, or of one that is the whole run; an ending sign;
#: any other run; spaces. Together they leave no character over. Loops are possessive, and the plain word comes before rarer ones, so that a character is looked at about once.
LETTER = f"[{WORD_CHAR}]"
AFTER = rf"(?:[{SPACE}]++|{ENDING}[\p{{P}}{SPACE}]*+)?+"
WORDS = (rf"[{NUMBER}]++(?= )[{SPACE}]*+"
         rf"|(?:(?={LETTER}{LETTER})|{OTHER}*+(?={LETTER}{RUN}*?{LETTER})|(?={LETTER}(?!{RUN})))({LETTER}++(?:{OTHER}++{LETTER}++)*+){OTHER}*+{AFTER}"
         rf"|{ENDING}[\p{{P}}{SPACE}]*+"
         rf"|{RUN}++|[{SPACE}]++")
#: Before them, a plain word with the plain sign and space after it; most words are such, and need no look ahead.
PLAIN = rf"([A-Z][A-Z]+)(?:\.?+[ \n]|,[\p{{P}}{SPACE}]*+)"


def upper_but(text: Column, kept: str = "") -> Column:
    """Upper case character by character: no character becomes several, Ё becomes Е, and those in `kept` stay."""
    plain, shield = expanding_characters()
    plain, shield = plain + kept, shield + "\ue0ff"[:len(kept)]
    careful = F.translate(F.upper(F.translate(text, plain, shield)), shield + "Ё", plain + "Е")
    short = F.char_length(F.upper(text)) == F.char_length(text)  # what becomes several characters makes a text longer
    for c in kept:
        short = short & ~F.contains(text, F.lit(c))
    return (F.when(F.octet_length(text) == F.char_length(text), F.upper(text))
            .when(short, F.replace(F.upper(text), F.lit("Ё"), F.lit("Е"))).otherwise(careful))


def upper_invariant(text: Column) -> Column:
    """Upper case character by character: no character becomes several, and Ё becomes Е."""
    return upper_but(text)


def lower_invariant(text: Column) -> Column:
    """Lower case character by character: no character becomes several, whatever stands next to it."""
    upper, lower = lower_case_pairs()
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def joined_words(text: Column, drop_urls: bool = True) -> Column:
    """The words of a text in order with plain spaces between them, one or more, also at the ends. A null text has none; what follows a NUL is not read.

    A word runs to white space or an ending sign and is cut to its first and last letter or digit. A word of
    one character is kept only if nothing was cut off. Runs of digits and number signs before a plain space are dropped.
    The whole text is put in upper case and read once, by one expression, without a lambda. No word holds a space.
    """
    if drop_urls:
        text = without_urls(text)
    text = F.coalesce(F.substring_index(text, "\x00", 1), F.lit(""))
    # The subscript is no letter, but its upper case is: it gets it when words are cut.
    found = F.regexp_replace(upper_but(text, SUBSCRIPT), F.lit(f"{PLAIN}|{WORDS}"), F.lit("$1$2 "))
    return F.replace(found, F.lit(SUBSCRIPT), F.lit("Ι"))


def words_in(joined: Column) -> Column:
    """The words that joined_words has left, as an array."""
    return F.array_remove(F.split(joined, " "), "")


def tokenize(text: Column, drop_urls: bool = True) -> Column:
    """Words of a text in order, by the rules of joined_words."""
    return words_in(joined_words(text, drop_urls))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by spaces; none if there are fewer words."""
    if n == 1:
        return words
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def preview(text: Column, length: int = 150) -> Column:
    """The beginning of a text on one line: line ends and tabs become spaces, then each pair of spaces one."""
    short = F.when(F.char_length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)
    return F.replace(F.translate(short, "\r\n\t", "   "), F.lit("  "), F.lit(" "))


def limit_text(text: Column, characters: int = 10_000) -> Column:
    return F.substring(text, 1, characters)


def percent_text(percent: Column) -> Column:
    """Two decimals, halves away from zero."""
    return F.format_number(F.round(percent, 2), 2)


def class_label(class_id: Column, names: dict[int, str]) -> Column:
    """The class's name, or its number in brackets if it has none."""
    unknown = F.concat(F.lit("[class-index: "), class_id.cast("string"), F.lit("]"))
    if not names:
        return unknown
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, class_id), unknown)
