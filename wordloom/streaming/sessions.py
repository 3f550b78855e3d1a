"""Sessions of requests, and requests with the answers that follow them, of tables and of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window


def sessions(requests: DataFrame, key: str, at: str, gap: int, late: str | None = None) -> DataFrame:
    """(key, begin, end, requests): runs of a key's requests, each within `gap` seconds of the one before; end is the last request's time and the gap.

    Of a stream, `late` ("10 minutes") is how long requests may come after later ones. A session is output once, when the watermark, the
    latest time less `late`, has passed its end. A request that would make a session of its own which has ended by the watermark is
    dropped, and `dropped` counts it; any other one joins what is still open. Of a table, all sessions are output and nothing is late. Requests without a key or time are left out.

    A table's requests are counted by key and bins of the gap's width before they are exchanged, as all of one bin are in one session: of
    a hot key, one row for each bin in use is looked at, whatever the number of its requests.
    """
    asked = requests.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, F.col(at).cast("timestamp").alias("_at"))
    if requests.isStreaming:
        of = asked.withWatermark("_at", late or "0 seconds").groupBy(key, F.session_window("_at", f"{gap} seconds").alias("_s"))
        return of.agg(F.count(F.lit(1)).alias("requests")).select(key, F.col("_s.start").alias("begin"), F.col("_s.end").alias("end"), "requests")
    us, width = F.unix_micros("_at"), gap * 1_000_000
    bins = (asked.select(key, us.alias("_us")).groupBy(key, F.floor(F.col("_us") / width).alias("_bin"))
            .agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.count(F.lit(1)).alias("_n")))
    order = Window.partitionBy(key).orderBy("_bin")
    opens = F.coalesce(F.col("_first") - F.lag("_last").over(order) > width, F.lit(True))
    numbered = bins.withColumn("_opens", opens.cast("long")).withColumn("_session", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_session").agg(
        F.timestamp_micros(F.min("_first")).alias("begin"), F.timestamp_micros(F.max("_last") + width).alias("end"), F.sum("_n").alias("requests")).drop("_session")


def answered(requests: DataFrame, answers: DataFrame, keys: tuple[str, str], ids: tuple[str, str], at: tuple[str, str], within: int, late: str | None = None) -> DataFrame:
    """(key, request, at, answer, answered): each request with every answer of its key from its own time to `within` seconds later; nulls where there is none.

    `keys`, `ids` and `at` name the columns of requests and of answers. Both meet by key and a bin of time: a request lies in its own
    bin, an answer in its own and the one before, so that each pair meets once and no other times of a key are tried. Two streams
    both have the watermark `late`: a request without an answer is output once the watermark has passed its last moment, and rows of
    either stream that come after the watermark are dropped, which `dropped` counts. Answers without a request are not
    output. A request without a key or time has no answer; of a stream, one without a time is left out.
    """
    width = within * 1_000_000

    def side(rows: DataFrame, key: str, id: str, when: str, names: tuple[str, str, str]) -> DataFrame:
        out = rows.select(F.col(key).alias(names[0]), F.col(id).alias(names[1]), F.col(when).cast("timestamp").alias(names[2]))
        if not rows.isStreaming:
            return out
        return out.where(F.col(names[2]).isNotNull()).withWatermark(names[2], late or "0 seconds")

    asked = side(requests, keys[0], ids[0], at[0], ("key", "request", "at"))
    given = side(answers, keys[1], ids[1], at[1], ("_key", "answer", "answered"))
    own = F.floor(F.unix_micros("answered") / width)
    left, right = asked.withColumn("_bin", F.floor(F.unix_micros("at") / width)), given.withColumn("_of", F.explode(F.array(own, own - 1)))
    meets = (F.col("key") == F.col("_key")) & (F.col("_bin") == F.col("_of")) & (F.col("answered") >= F.col("at")) & (F.col("answered") <= F.col("at") + F.expr(f"interval {within} seconds"))
    return left.join(right, meets, "left").select("key", "request", "at", "answer", "answered")


def dropped(query: StreamingQuery) -> int:
    """How many rows came too late, in all micro-batches that a query still remembers."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
