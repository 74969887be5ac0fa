"""Matching of modalities by hierarchy and file id, and operators on hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapgauge.functions.lineage import cut

KEY = ["hierarchy", "file_id"]


def match_frames(modalities: dict[str, DataFrame], value: str = "value") -> DataFrame:
    """Inner equi-join of all modalities on (hierarchy, file_id): one row a sample, a column a modality."""
    out = None
    for name, df in modalities.items():
        one = df.select(*KEY, F.col(value).alias(name))
        out = one if out is None else out.join(one, KEY)
    return out


def require_matches(frames: DataFrame) -> DataFrame:
    if frames.isEmpty():
        raise ValueError("no sample is there in all modalities")
    return frames


def unmatched(left: DataFrame, right: DataFrame) -> DataFrame:
    """Frames of left that right lacks."""
    return left.join(right, KEY, "left_anti").select(*KEY)


def with_index(frames: DataFrame) -> DataFrame:
    """frames with sample_idx in the order of hierarchy and file id, from 0 in each leading hierarchy level.

    Frames are range-partitioned in that order and numbered within each partition; what lies before a partition is known
    from a count a partition and level. So no task holds more than a partition, however large a level is.
    """
    level = F.coalesce(F.get("hierarchy", 0), F.lit(""))
    ranged = cut(frames.withColumn("_level", level).repartitionByRange("_level", "hierarchy", "file_id").withColumn("_pid", F.spark_partition_id()))
    # a row a partition and level
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_level").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = ranged.groupBy("_level", "_pid").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", before).drop("_n")
    within = F.row_number().over(Window.partitionBy("_level", "_pid").orderBy("hierarchy", "file_id")) - 1
    return ranged.withColumn("_at", within).join(counts, ["_level", "_pid"]).withColumn("sample_idx", (F.col("_before") + F.col("_at")).cast("int")).drop("_level", "_pid", "_at", "_before")


def attach_ancestor(frames: DataFrame, coarse: DataFrame, columns: list[str]) -> DataFrame:
    """Left join of a modality that lies at an ancestor level: the deepest entry wins, then the smallest file id.

    Every frame is given its ancestors as keys, so this is an equi-join and not a nested loop over prefixes.
    """
    depth = F.explode(F.sequence(F.lit(0), F.size("hierarchy")))
    keys = frames.select(*KEY).withColumn("d", depth).withColumn("prefix", F.slice("hierarchy", 1, F.col("d")))
    entry = F.struct(F.size("hierarchy").alias("d"), *[F.col(c) for c in columns])
    best = coarse.groupBy(F.col("hierarchy").alias("prefix")).agg(F.min_by(entry, "file_id").alias("entry"))
    found = keys.join(best, "prefix").groupBy(*KEY).agg(F.max_by("entry", "d").alias("entry"))
    return frames.join(found, KEY, "left").select(*frames.columns, *[F.col(f"entry.{c}").alias(c) for c in columns])


def split_full_id(full_id: str = "full_id", fallback: str = "id"):
    """hierarchy and file_id of a path such as /Scene01/clone/00042; without one, no levels and the fallback."""
    parts = F.filter(F.split(F.col(full_id), "/"), lambda x: x != "")
    has = F.col(full_id).isNotNull() & (F.size(parts) > 0)
    hierarchy = F.when(has, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return hierarchy.alias("hierarchy"), F.when(has, F.element_at(parts, -1)).otherwise(F.col(fallback)).alias("file_id")


def subtree(frames: DataFrame, prefix: list[str]) -> DataFrame:
    """All entries under a hierarchy prefix."""
    return frames.where(F.slice("hierarchy", 1, len(prefix)) == F.array(*map(F.lit, prefix)).cast("array<string>"))


def retrieve(frames: DataFrame, hierarchy: list[str], file_id: str) -> DataFrame:
    return frames.where((F.col("hierarchy") == F.array(*map(F.lit, hierarchy)).cast("array<string>")) & (F.col("file_id") == file_id))


def upsert(frames: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """frames with changes written over them by (hierarchy, file_id); the last by `order` wins, new keys are added."""
    rest = [c for c in frames.columns if c not in KEY]
    old = frames.withColumn("_turn", F.lit(0)).withColumn("_at", F.lit(None).cast(changes.schema[order].dataType))
    new = changes.select(*frames.columns, F.lit(1).alias("_turn"), F.col(order).alias("_at"))
    last = old.unionByName(new).groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("_turn", "_at")).alias("r"))
    return last.select(*KEY, *[F.col(f"r.{c}").alias(c) for c in rest])
