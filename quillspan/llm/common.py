"""What several of these operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.partition import spread  # noqa: F401


def current_documents(store_docs: DataFrame) -> DataFrame:
    """One row for each doc_key: the payloads and metadata of its highest seq.

    Rows without a key are no document.  Partial aggregation before the shuffle
    leaves one row a key and map task, so a key with many versions can't swell a task.
    """
    latest = F.max_by(F.struct("payloads", "metadata", "profile"), F.coalesce("seq", F.lit(-1).cast("long")))
    return store_docs.where(F.col("doc_key").isNotNull()).groupBy("doc_key").agg(latest.alias("d")).select("doc_key", "d.payloads", "d.metadata", "d.profile")


def text_payloads(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_key, *keep, payload_no, data) of the text payloads, payload_no counted over all payloads from 0."""
    rows = docs.select("doc_key", *keep, F.posexplode("payloads").alias("payload_no", "p"))
    return rows.where(F.col("p.modality") == "text").select("doc_key", *keep, "payload_no", F.col("p.data").alias("data"))
