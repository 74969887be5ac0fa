"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode, where that is unset, a folder of our own."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if not at:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}")
        at = sc.getCheckpointDir()
    return at


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder: later reads neither recompute them nor depend on an executor."""
    spark = df.sparkSession
    shared_dir(spark)
    done = df.checkpoint(eager=True)
    # A checkpointed plan keeps the estimates of the plan before; a join multiplies sizes, so in iterative jobs they grow to
    # numbers of millions of digits. The same rows without estimates; adaptive execution measures what it needs.
    session = spark._jsparkSession
    return DataFrame(session.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)
