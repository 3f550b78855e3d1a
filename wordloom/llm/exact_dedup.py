"""Exact deduplication by 128-bit content hash, with a comparison of bytes inside each hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import cut, rows_that_stay

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII texts take the quick built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                 digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Rows are grouped by `digest`; the bytes of
    the texts are compared inside each group, and a group that holds different texts is split by them.
    The row with the smallest (or largest) id stays.

    A null text counts as empty, so null and empty texts form one group. A null id stays only in a group
    without other ids. Rows that repeat an id with an equal text count in group_size and share the
    verdict. A very long text is compared whole. An empty table gives an empty result. Columns other than
    the two named are not read. A text that a large share of rows has is folded before each exchange of
    texts; in the last join, of ids and hashes only, its rows are one key, which adaptive execution splits.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    pick = F.min if keep == "smallest" else F.max
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"))
    hashed = texts.select("_id", "_norm", digest(F.col("_norm")).alias("_h"))
    # Equal bytes are grouped first (one exchange of texts, with map-side combining), hashes after that.
    by_bytes = hashed.groupBy("_h", "_norm").agg(F.count(F.lit(1)).alias("_n"), pick("_id").alias("_keep"))
    by_hash = cut(by_bytes.groupBy("_h").agg(
        F.count(F.lit(1)).alias("_texts"), F.sum("_n").alias("_n"), pick("_keep").alias("_keep")))

    def result(joined: DataFrame) -> DataFrame:
        return joined.select(
            F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
            F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_sha").alias("text_sha256"))

    narrow = hashed.select("_id", "_h", F.sha2("_norm", 256).alias("_sha"))
    out = result(narrow.join(by_hash.where("_texts = 1").select("_h", "_n", "_keep"), "_h"))
    collided = by_hash.where("_texts > 1").select("_h")
    if collided.isEmpty():
        return out
    wide = hashed.join(collided, "_h", "left_semi")
    exact = wide.groupBy("_h", "_norm").agg(F.count(F.lit(1)).alias("_n"), pick("_id").alias("_keep"))
    return out.unionByName(result(wide.withColumn("_sha", F.sha2("_norm", 256)).join(exact, ["_h", "_norm"])))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, one of each text, with all their columns.

    Texts are equal as in exact_groups; the row with the smallest (or largest) id stays, and one without an id only where no equal
    text has one. Of rows that repeat that id the least by its columns stays. A null text counts as empty; a very long one is compared whole.
    Columns of any name are kept. An empty table gives an empty result.
    """
    groups = exact_groups(docs, id_col, text_col, keep)
    stay = groups.where("kept").groupBy(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    return rows_that_stay(docs, stay, id_col, F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))), 256))
