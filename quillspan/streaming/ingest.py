"""Continuous ingestion: each micro-batch goes through the batch pipeline into the store."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from ..engine import Engine


def ingest_stream(engine: Engine, documents: DataFrame, checkpoint: str, **trigger: Any):
    """Start a query that adds the documents of a stream (doc_id, payloads, metadata, source).

    A micro-batch that runs again after a failure appends the same documents once more
    under a higher version, which replaces the first: the result is the same.
    """

    def add(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.add_documents(batch)

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
