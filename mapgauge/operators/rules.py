"""Sanity rules over per-image results, and their report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A warning of this type where column (times `against`, another column) is beyond the limit."""

    modality: str
    metric: str
    kind: str
    column: str
    op: str
    limit: float
    against: str = ""


RULES = (
    Rule("depth", "depth_input", "max_exceeded", "depth_max", ">", 100.0),
    Rule("depth", "depth_input", "min_below_expected", "depth_min", "<", 0.0),
    Rule("depth", "depth_input", "no_valid_pixels", "n", "<", 1.0),
    Rule("depth", "psnr", "max_val_too_high", "max_val", ">", 100.0),
    Rule("depth", "psnr", "max_val_too_low", "max_val", "<", 0.1),
    Rule("depth", "ssim", "depth_range_too_small", "depth_range", "<", 0.1),
    Rule("depth", "absrel", "median_too_high", "absrel_median", ">", 1.0),
    Rule("depth", "absrel", "p90_too_high", "absrel_p90", ">", 2.0),
    Rule("depth", "rmse", "rmse_too_high", "rmse", ">", 0.5, "depth_range"),
    Rule("depth", "silog", "silog_too_high", "silog", ">", 0.5),
    Rule("depth", "normal_consistency", "mean_angle_too_high", "mean_angle", ">", 45.0),
    Rule("depth", "normal_consistency", "insufficient_valid_pixels", "angle_pixels", "<", 100.0),
    Rule("depth", "depth_edge_f1", "gt_edges_too_sparse", "gt_edge_ratio", "<", 0.001),
    Rule("depth", "depth_edge_f1", "gt_edges_too_dense", "gt_edge_ratio", ">", 0.5),
    Rule("rgb", "rgb_input", "values_exceed_range", "rgb_max", ">", 1.01),
    Rule("rgb", "rgb_input", "values_below_range", "rgb_min", "<", -0.01),
    Rule("rgb", "psnr", "psnr_too_low", "psnr", "<", 10.0),
    Rule("rgb", "psnr", "psnr_unusually_high", "psnr", ">", 60.0),
    Rule("rgb", "ssim", "ssim_too_low", "ssim", "<", 0.3),
    Rule("rgb", "lpips", "lpips_too_high", "lpips", ">", 0.7),
    Rule("rgb", "tail_errors", "p99_too_high", "p99", ">", 0.5),
    Rule("rgb", "high_freq_energy", "excessive_smoothing", "relative_diff", "<", -0.5),
    Rule("rgb", "depth_binned", "near_bin_empty", "near_count", "<", 1.0),
    Rule("rgb", "depth_binned", "mid_bin_empty", "mid_count", "<", 1.0),
    Rule("rgb", "depth_binned", "far_bin_empty", "far_count", "<", 1.0),
    Rule("rays", "rays_input", "gt_not_unit_vectors", "gt_norm_deviation", ">", 0.1),
    Rule("rays", "rays_input", "pred_not_unit_vectors", "pred_norm_deviation", ">", 0.1),
    Rule("rays", "rays_input", "no_valid_pixels", "n", "<", 1.0),
    Rule("rays", "rho_a", "rho_a_too_low", "rho_a", "<", 0.3),
    Rule("rays", "rho_a", "mean_angle_too_high", "mean_angle", ">", 30.0),
)


#: Columns that an evaluation may lack because it was given no depth map or no network.
OPTIONAL = frozenset({"lpips", "near_count", "mid_count", "far_count"})


def configured(limits: dict[str, float], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Rules with other limits, by 'metric:type'."""
    return tuple(Rule(r.modality, r.metric, r.kind, r.column, r.op, limits.get(f"{r.metric}:{r.kind}", r.limit), r.against) for r in rules)


def warnings(per_image: DataFrame, modality: str, file_id: str = "img", rules: tuple[Rule, ...] = RULES, complete: bool = False) -> DataFrame:
    """file_id, metric, type, message, observed, expected: one pass, all rules of the modality whose columns are there; if
    complete, a rule without its columns raises, unless they are OPTIONAL. Null and NaN never warn."""
    found = []
    for r in rules:
        lacks = {r.column, r.against or r.column} - set(per_image.columns)
        if r.modality != modality or lacks and (lacks <= OPTIONAL or not complete):
            continue
        if lacks:
            raise ValueError(f"rule {r.metric}:{r.kind} needs {', '.join(sorted(lacks))}")
        limit = F.lit(r.limit) * F.col(r.against) if r.against else F.lit(r.limit)
        v = F.col(r.column).cast("double")
        hit = ~F.isnan(v) & ((v > limit) if r.op == ">" else (v < limit))
        message = F.format_string(f"{r.metric} {r.column} %.6g is {'above' if r.op == '>' else 'below'} %.6g", v, limit.cast("double"))
        found.append(F.when(hit, F.struct(F.lit(r.metric).alias("metric"), F.lit(r.kind).alias("type"), message.alias("message"), v.alias("observed"), limit.cast("double").alias("expected"))))
    if not found:
        return per_image.select(F.col(file_id).cast("string").alias("file_id")).limit(0).selectExpr("file_id", "'' metric", "'' type", "'' message", "0D observed", "0D expected")
    return per_image.select(F.col(file_id).alias("file_id"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("w")).select("file_id", "w.*")


#: Parts that a group's files are dealt into, to find which of them may be among the first.
PARTS = 16


def report(found: DataFrame, samples: int = 5) -> DataFrame:
    """metric, type, count, first message, up to `samples` observed values in file order (equal files by value).

    found is read twice and not sorted: a group's rows are dealt into PARTS parts by hash, and of the parts' least rows the
    `samples`-th bounds the first `samples` of all, so that only the few rows up to it are ranked. Without a bound are groups
    whose rows fill fewer parts, and more samples than parts: there all rows are ranked.
    """
    from pyspark.sql import Window

    at = F.struct("file_id", "observed")
    part = F.pmod(F.xxhash64("file_id", "observed"), F.lit(PARTS))
    least = [F.min(F.when(part == k, at)) for k in range(PARTS)]
    # a set among them keeps the groups in a hash table; structs and strings alone would be aggregated by sorting all rows
    groups = found.groupBy("metric", "type").agg(F.count(F.lit(1)).alias("count"), F.min_by("message", at).alias("message"), F.array(*least).alias("least"), F.collect_set(part).alias("parts"))
    bound = F.when(F.size("parts") >= samples, F.get(F.array_sort(F.array_compact("least")), samples - 1))
    groups = F.broadcast(groups.select("metric", "type", "count", "message", bound.alias("bound")))
    first = Window.partitionBy("metric", "type").orderBy("file_id", "observed")
    top = found.select("metric", "type", "file_id", "observed").join(groups, ["metric", "type"]).where(F.col("bound").isNull() | (at <= F.col("bound")))
    top = top.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= samples)
    values = F.transform(F.array_sort(F.collect_list(F.struct("rn", "observed"))), lambda x: x["observed"])
    return top.groupBy("metric", "type").agg(F.first("count").alias("count"), F.first("message").alias("message"), values.alias("samples"))
