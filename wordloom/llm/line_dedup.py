"""Line deduplication: repeated windows of consecutive lines keep their first occurrence only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """Starts of windows of `window` lines that occurred before: (_id, _text, starts), _text a hash of the whole text.

    Occurrences are ordered by id (null first), then by the hash of the text, then by line. The 128-bit
    hash of the lines stands for the window.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), lines.alias("_lines"))
    hashes = F.expr(
        f"CASE WHEN size(_lines) >= {window} THEN transform(sequence(0, size(_lines) - {window}), "
        f"i -> unhex(md5(array_join(slice(_lines, i + 1, {window}), '\\n')))) ELSE array() END")
    windows = base.select("_id", "_text", F.posexplode(hashes).alias("_pos", "_h"))
    at = F.struct("_id", "_text", "_pos")
    first = (windows.groupBy("_h").agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
             .where("not (_first <=> _last)").select("_h", "_first"))
    later = windows.join(first, "_h").where(~at.eqNullSafe(F.col("_first")))
    # Rows repeating id and text yield each start several times; a set keeps one of them.
    return later.groupBy("_id", "_text").agg(F.collect_set("_pos").alias("starts"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """One row per input row: id, n_lines, n_removed, text (the lines that stay, joined again by line feeds).

    Lines end at line feeds. A line goes when a window that covers it occurred before, in this document
    or one with a smaller id; overlapping windows are merged. Texts of fewer lines than a window stay
    whole. A null text counts as empty: one empty line. A null id comes before all others. Rows that
    repeat id and text are one document and get the same result. A very long text is read whole; columns other
    than the two named are not read. An empty table gives an empty result.
    """
    found = repeated_windows(docs, id_col, text_col, window)
    own = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), F.coalesce(F.col(text_col), F.lit("")).alias("_all"))
    same = (F.col("d._id").eqNullSafe(F.col("f._id"))) & (F.col("d._text") == F.col("f._text"))
    joined = own.alias("d").join(found.alias("f"), same, "left").select("d._id", "d._all", "f.starts")
    covered = f"flatten(transform(starts, s -> sequence(s, s + {window - 1})))"
    return (joined.withColumn("_lines", F.split("_all", "\n", -1))
            .withColumn("_stay", F.when(F.col("starts").isNotNull(), F.expr(f"array_except(sequence(0, size(_lines) - 1), {covered})")))
            .select(F.col("_id").alias(id_col), F.size("_lines").cast("long").alias("n_lines"),
                    F.when(F.col("starts").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size("_stay")).cast("long").alias("n_removed"),
                    F.when(F.col("starts").isNull(), F.col("_all"))
                    .otherwise(F.expr("array_join(transform(_stay, i -> _lines[i]), '\\n')")).alias("text")))
