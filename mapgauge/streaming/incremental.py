"""Incremental evaluation: pooled statistics that new results are added to as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapgauge.functions.lineage import cut


def pool_stream(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """key, n, mean, std (population) of a folder or file of Parquet, as a stream that stops when all there is has been read.

    State is three sums a key. A file path is read through its folder, so the same query picks up files that come later.
    """
    batch = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(batch.schema).option("pathGlobFilter", name).parquet(folder)
    v = F.col(value)
    sums = source.groupBy(key).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    kept: list[DataFrame] = []

    def take(df: DataFrame, _: int) -> None:
        kept[:] = [cut(df)]

    cut(spark.range(0))  # the shared folder is known from here on
    at = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    run = sums.writeStream.outputMode("complete").option("checkpointLocation", at).foreachBatch(take).trigger(availableNow=True).start()
    run.awaitTermination()
    out = kept[0] if kept else batch.groupBy(key).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    mean = F.col("s") / F.col("n")
    return out.select(key, "n", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))), 5).alias("std"))
