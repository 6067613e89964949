"""How rows are dealt out."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Enough partitions for heavy work a row: a table of fewer splits than cores is dealt out once.

    Tables of usual size have more splits than that and pass through unshuffled.
    Filters and column pruning still reach the scan below.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
