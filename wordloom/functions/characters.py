"""Character classes of the tokenizer and the URL detector, as contents of Java regex classes."""

from __future__ import annotations

from functools import cache

#: White space: separators, tab to carriage return, next line.
SPACE = r"\p{Z}\t-\r\u0085"
#: Punctuation that does not end a word, and other signs that do.
KEPT_MARKS = "&'-._­՚՛՝‒–—―‘’‛"
ENDING_SIGNS = "¥©¤¦§®¶€™<>"
#: Characters besides digits and the plain space that a skipped number is made of.
NUMBER_MARKS = ";,:./\\-–〃´°"
KEPT = r"&'\-._­՚՛՝‒-―‘’‛"
#: What ends a word for good; all punctuation and space after it goes too.
ENDING = rf"[[\p{{P}}{ENDING_SIGNS}]&&[^{KEPT}]]"
#: Of the number signs, those that a run may hold; the others end it.
NUMBER = r"\p{Nd}.\-–´°"
WORD_CHAR = r"\p{L}\p{Nd}"
#: What a run of characters between ends and spaces is made of, and what of it is no letter or digit.
RUN = rf"[[^\p{{P}}{ENDING_SIGNS}{SPACE}]{KEPT}]"
OTHER = rf"[[^\p{{P}}{ENDING_SIGNS}{SPACE}{WORD_CHAR}]{KEPT}]"
#: A combining mark whose upper case is a letter.
SUBSCRIPT = "ͅ"


@cache
def expanding_characters() -> tuple[str, str]:
    """Characters whose upper case is longer, and private-use stand-ins for them; the categoriser leaves them as they are."""
    found = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and len(chr(c).upper()) > 1]
    return "".join(found), "".join(chr(0xE100 + i) for i in range(len(found)))


@cache
def lower_case_pairs() -> tuple[str, str]:
    """Characters whose lower case is one other character, and that character."""
    found = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and len(c.lower()) == 1 and c.lower() != c]
    return "".join(found), "".join(c.lower() for c in found)
