"""Scoring of a stream of texts: each micro-batch runs the batch plan against a stored model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from wordloom.plans.training import Settings, classify


def classify_stream(texts: DataFrame, model: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, doc: str = "doc_id",
                    key: str = "class_id", text: str = "text", settings: Settings = Settings(), names: dict | None = None) -> StreamingQuery:
    """Starts a query that hands the report of each micro-batch to `sink(report, batch)`; a batch that is repeated has the same number."""
    def run(batch: DataFrame, number: int) -> None:
        sink(classify(batch, model, doc, key, text, settings, names), number)

    return texts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
