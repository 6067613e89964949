"""Retrieval quality over ranked results (query_id, id, rank) and gold pairs (query_id, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_query(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, hit_rate, recall_at_k, reciprocal_rank); queries without results score 0."""
    want = gold.select("query_id", "id").distinct()
    got = ranked.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    both = want.join(got, ["query_id", "id"], "left")
    hit = F.col("rank").isNotNull().cast("double")
    return both.groupBy("query_id").agg(
        F.avg(hit).alias("hit_rate"),
        F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias("recall_at_k"),
        F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def summary(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    return per_query(ranked, gold, k).agg(F.avg("hit_rate").alias("hit_rate"), F.avg("recall_at_k").alias("recall_at_k"), F.avg("reciprocal_rank").alias("mrr"))


def condition_precision(results: DataFrame, condition: Column, by: str = "query_id") -> DataFrame:
    """Share of each query's results that meet a condition."""
    return results.groupBy(by).agg(F.avg(F.coalesce(condition, F.lit(False)).cast("double")).alias("precision"))


def dedup_by_text(corpus: DataFrame, text: str = "text", digits: int = 10) -> DataFrame:
    """One row for each text, named by its hash."""
    return corpus.withColumn("doc_hash", F.substring(F.md5(F.col(text)), 1, digits)).dropDuplicates(["doc_hash"])


def distractors(corpus: DataFrame, gold: DataFrame, n: int, seed: int = 7, ident: str = "id") -> DataFrame:
    """n seeded rows that are no gold row (a sampling operator)."""
    return corpus.join(gold.select(ident).distinct(), ident, "left_anti").orderBy(F.xxhash64(F.lit(seed), F.col(ident)), ident).limit(n)
