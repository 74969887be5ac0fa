"""The three evaluations end to end: image pairs to a long table of metrics, per-image results and sanity report.

Inputs are tables with a row an image pair (maps as row-major arrays), however they came about: decoded from manifests
(mapgauge.sources) or read from Parquet. Pixels are exploded in place; per image and per pool everything is one aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapgauge.functions import masks
from mapgauge.functions.lineage import cut
from mapgauge.operators import align, distribution, images, rays, reduce, rules
from mapgauge.sources.fixtures import pixels

LONG = ["modality", "space", "category", "reduction", "bin", "metric", "value"]


@dataclass
class Result:
    metrics: DataFrame  # LONG
    per_image: DataFrame
    report: DataFrame
    info: dict = field(default_factory=dict)


def long_table(wide: DataFrame, modality: str, space: str, category: str, names: dict[str, str], reduction: str = "", bin_: str = "") -> DataFrame:
    """A wide row (or a row a reduction or bin, where those are columns) as rows of the long table; nulls are left out."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for c, m in names.items()])).alias("x")
    get = lambda n, d: F.col(n) if n in wide.columns else F.lit(d)
    rows = wide.select(F.lit(modality).alias("modality"), F.lit(space).alias("space"), F.lit(category).alias("category"), get("reduction", reduction).alias("reduction"), get("bin", bin_).alias("bin"), cells)
    return rows.select(*LONG[:5], "x.metric", "x.value").where(masks.finite("value"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _quantiles(rows: DataFrame, values: dict, shares: dict[str, float]) -> DataFrame:
    """Exact pooled quantiles of several values as one wide row: <value>.<share's name>."""
    found = reduce.pooled_quantiles(rows, values, list(shares.values()))
    at = lambda v, q: (F.col("name") == v) & (F.col("share") == q)
    return found.agg(*[F.max(F.when(at(v, q), F.col("value"))).alias(f"{v}.{n}") for v in values for n, q in shares.items()])


def _normals(angles: DataFrame, space: str, bin_: str = "") -> list[DataFrame]:
    """Pooled normal metrics; consistency is the mean dot product."""
    middle = reduce.exact_quantiles(angles, "angle", [0.5]).select(F.col("value").alias("median_angle"))
    means = angles.agg(F.avg("angle").alias("mean_angle"), F.avg(F.cos(F.radians("angle"))).alias("consistency"))
    shares = reduce.below_shares(angles, "angle", [11.25, 22.5, 30])
    return [long_table(d, "depth", space, "geometric_metrics", {c: f"normal_consistency.{c}" for c in d.columns}, bin_=bin_) for d in (middle, means, shares)]


def _means(per_image: DataFrame, columns: list[str]) -> DataFrame:
    return per_image.agg(*[F.avg(masks.only_finite(c)).alias(c) for c in columns])


def _depth_space(pairs: DataFrame, space: str, sky: bool, benchmark: tuple[float, float] | None, ssim_sky: bool) -> tuple[list[DataFrame], DataFrame]:
    keep = ("sky",) if sky else ()
    px = pixels(pairs, "gt", "pred", *keep)
    ok = masks.valid(sky="sky" if sky else None)
    stats = cut(reduce.pixel_stats(px, ["img"], ok))
    ten = {m: m for m in reduce.STANDARD}
    many = stats.count() > reduce.MANY
    parts = [long_table(reduce.standard_reducers(stats, many), "depth", space, "standard", ten)]
    errors = reduce.depth_errors(px, ok)
    values = {"absrel": F.col("absrel"), "rmse": F.col("err"), "silog": F.col("logerr")}
    q = _quantiles(errors, values, {"median": 0.5, "p90": 0.9})
    parts.append(long_table(q.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in q.columns]), "depth", space, "depth_metrics", {c.replace(".", "_"): c for c in q.columns}))
    # masked pixels are holes to the image metrics
    hole = pairs.withColumn("gt", F.zip_with("gt", "sky", lambda g, s: F.when(s, F.lit(0.0)).otherwise(g))) if sky else pairs
    per = stats.select("img", "n", *[c.alias(m) for m, c in reduce.standard_columns().items()])
    e2 = F.avg(F.when(F.col("ok"), F.pow(F.col("pred") - F.col("gt"), 2)))
    extra = px.withColumn("ok", ok).groupBy("img").agg(e2.alias("mse"), F.max(F.when(F.col("ok"), F.col("gt"))).alias("max_val"), F.min(F.when(F.col("ok"), F.col("gt"))).alias("depth_min"))
    extra = extra.withColumns({"psnr": F.when(F.col("mse").isNull(), 0.0).when(F.col("mse") < 1e-10, float("inf")).otherwise(10 * F.log10(F.col("max_val") ** 2 / F.col("mse"))), "depth_max": F.col("max_val"), "depth_range": F.col("max_val") - F.col("depth_min")})
    edges = images.depth_edge_f1(hole)
    absrel = F.zip_with("gt", "pred", lambda g, p: F.when((g > 0) & (p > 0), F.abs(p - g) / g))
    size = hole.select("img", (F.col("height") * F.col("width")).alias("pixels"), reduce.array_quantile(absrel, 0.5).alias("absrel_median"), reduce.array_quantile(absrel, 0.9).alias("absrel_p90"))
    angles = cut(images.normal_angles(hole))
    angle = angles.groupBy("img").agg(F.avg("angle").alias("mean_angle"), F.count(F.lit(1)).alias("angle_pixels"))
    per = per.join(extra.drop("mse"), "img").join(images.depth_ssim(hole if ssim_sky else pairs), "img").join(edges, "img").join(angle, "img", "left").join(size, "img")
    per = cut(per.withColumn("gt_edge_ratio", F.col("gt_edges") / F.col("pixels")).drop("pixels"))
    parts.append(long_table(_means(per, ["psnr", "ssim"]), "depth", space, "image_quality", {"psnr": "psnr", "ssim": "ssim"}))
    parts.append(long_table(_means(per, ["silog"]), "depth", space, "depth_metrics", {"silog": "silog.mean"}))
    some = per.where("gt_edges > 0 OR pred_edges > 0")
    parts.append(long_table(_means(some, ["precision", "recall", "f1"]), "depth", space, "geometric_metrics", {c: f"depth_edge_f1.{c}" for c in ("precision", "recall", "f1")}))
    parts += _normals(angles, space)
    if benchmark:
        inside = px.where(ok & masks.finite("pred"))
        b = cut(reduce.binned_stats(inside, masks.benchmark_bin("gt", *benchmark), ["img"]))
        for name in ("all", "near", "mid", "far"):
            rows = reduce.standard_reducers(b.where(F.col("bin") == name), many).withColumn("bin", F.lit(name))
            parts.append(long_table(rows, "depth", space, "standard", ten))
        by_bin = cut(images.normal_angles(hole, benchmark))
        for name in ("all", "near", "mid", "far"):
            parts += _normals(by_bin.where(F.col("bin") == name), space, name)
    return parts, per.withColumn("space", F.lit(space))


def evaluate_depth(pairs: DataFrame, mode: str = "auto_affine", intrinsics: tuple | None = None, radial: bool = True, benchmark: tuple[float, float] | None = None, trim: float = 0.95, ssim_sky: bool = False, features: DataFrame | None = None) -> Result:
    """pairs: img, height, width, gt, pred and optionally sky. Planar maps are made radial with intrinsics (fx, fy, cx, cy:
    numbers, or columns of pairs) unless radial; predictions in [-1, 1] (seen in the first sample) or mode 'affine' are fitted to the ground truth."""
    if pairs.isEmpty():
        raise ValueError("there are no image pairs")
    sky = "sky" in pairs.columns
    normalised = align.is_normalised(pairs)
    emitted = align.spaces(mode, normalised)
    native = pairs
    if intrinsics and not radial:
        ray = lambda m: F.transform(m, lambda d, p: align.radial(d, p % F.col("width"), F.floor(p / F.col("width")), *intrinsics))
        native = pairs.withColumns({"gt": ray("gt"), "pred": ray("pred")})
    metric = native
    if "native" in emitted and "metric" in emitted:
        # a normalised prediction is fitted as it came, without the radial factor
        base = native.drop("pred").join(pairs.select("img", "pred"), "img") if normalised else native
        fit_px = pixels(align.with_trim(base, trim), "gt", "pred", "sky", keep=("trim",)) if sky else pixels(base, "gt", "pred")
        mask = align.trimmed() if sky else masks.fit_mask()
        fit = align.affine_fit(fit_px, mask).select("img", "s", "t")
        metric = base.join(fit, "img").withColumn("pred", F.transform("pred", lambda p: (F.col("s") * p + F.col("t")).cast("float").cast("double"))).drop("s", "t")
    parts, per = [], []
    for space in emitted:
        p, r = _depth_space(native if space == "native" else metric, space, sky, benchmark, ssim_sky)
        parts += p
        per.append(r)
    if features is not None:
        parts.append(long_table(distribution.fid(features), "depth", emitted[-1], "image_quality", {"fid": "fid"}))
        parts.append(long_table(distribution.kid_subsets(features), "depth", emitted[-1], "image_quality", {"kid_mean": "kid_mean", "kid_std": "kid_std"}))
    per_image = _union(per)
    report = rules.report(rules.warnings(per_image.where(F.col("space") == emitted[-1]), "depth", complete=True))
    return Result(_union(parts), per_image, report, {"spaces": emitted, "normalised": normalised})


def benchmark_rgb(px: DataFrame, benchmark: tuple[float, float], sky: str | None = None) -> DataFrame:
    """bin, mae, mse: means over images of the errors (ae, se) in each bin of the benchmark range and in all of it, without
    sky. A bin that is empty in an image counts there as 0."""
    bin_ = masks.benchmark_bin("depth", *benchmark)
    rows = px.withColumn("bin", F.when(~F.coalesce(F.col(sky), F.lit(False)), bin_) if sky else bin_)
    names = ("all", "near", "mid", "far")
    inside = lambda b: F.col("bin").isNotNull() if b == "all" else F.col("bin") == b
    per = rows.groupBy("img").agg(*[F.coalesce(F.avg(F.when(inside(b), F.col(c))), F.lit(0.0)).alias(f"{m}_{b}") for b in names for m, c in (("mae", "ae"), ("mse", "se"))])
    one = per.agg(*[F.avg(c).alias(c) for c in per.columns if c != "img"])
    return one.select(F.explode(F.array(*[F.struct(F.lit(b).alias("bin"), F.col(f"mae_{b}").alias("mae"), F.col(f"mse_{b}").alias("mse")) for b in names])).alias("r")).select("r.*")


def evaluate_rgb(pairs: DataFrame, sky: bool = False, depth: bool = False, benchmark: tuple[float, float] | None = None, features: DataFrame | None = None) -> Result:
    """pairs: img, height, width, gr, gg, gb, pr, pg, pb and optionally sky and depth. Sky pixels are set to 0 in both."""
    if pairs.isEmpty():
        raise ValueError("there are no image pairs")
    if sky:
        pairs = pairs.withColumns({c: F.zip_with(c, "sky", lambda v, s: F.when(s, F.lit(0.0)).otherwise(v)) for c in images.RGB})
    error = lambda z: (F.abs(z["pr"] - z["gr"]) + F.abs(z["pg"] - z["gg"]) + F.abs(z["pb"] - z["gb"])) / 3
    tails = pairs.withColumn("ae", F.transform(F.arrays_zip(*images.RGB), error)).select("img", reduce.array_quantile(F.col("ae"), 0.95).alias("p95"), reduce.array_quantile(F.col("ae"), 0.99).alias("p99"))
    px = pixels(pairs, *images.RGB, *(("depth",) if depth else ()), *(("sky",) if sky else ()))
    channel = lambda f: (f("r") + f("g") + f("b")) / 3
    px = px.withColumns({"ae": channel(lambda c: F.abs(F.col(f"p{c}") - F.col(f"g{c}"))), "se": channel(lambda c: F.pow(F.col(f"p{c}") - F.col(f"g{c}"), 2))})
    by_img = [F.avg("se").alias("mse"), F.max(F.greatest(*images.RGB)).alias("rgb_max"), F.min(F.least(*images.RGB)).alias("rgb_min")]
    bins: dict[str, str] = {}
    if depth:
        px = px.withColumn("bin", masks.fixed_bin("depth"))
        for m, c in (("mae", "ae"), ("mse", "se")):
            for b in ("near", "mid", "far", "all"):
                inside = F.col("bin").isNotNull() if b == "all" else F.col("bin") == b
                by_img.append(F.coalesce(F.avg(F.when(inside, F.col(c))), F.lit(0.0)).alias(f"bin_{m}_{b}"))
                bins[f"bin_{m}_{b}"] = f"{m}.{b}"
        by_img += [F.count(F.when(F.col("bin") == b, 1)).alias(f"{b}_count") for b in ("near", "mid", "far")]
    per = px.groupBy("img").agg(*by_img).withColumn("psnr", F.when(F.col("mse") < 1e-10, float("inf")).otherwise(10 * F.log10(1 / F.col("mse")))).drop("mse")
    per = per.join(tails, "img").join(images.rgb_ssim(pairs), "img").join(images.rgb_edge_f1(pairs), "img").join(images.chroma_error(pairs), "img").join(images.hf_energy(pairs), "img")
    per = cut(per)
    parts = [
        long_table(_means(per, ["psnr", "ssim", "sce"]), "rgb", "", "image_quality", {c: c for c in ("psnr", "ssim", "sce")}),
        long_table(_means(per.where("gt_edges > 0 OR pred_edges > 0"), ["precision", "recall", "f1"]), "rgb", "", "edge_f1", {c: c for c in ("precision", "recall", "f1")}),
        long_table(_means(per, ["gt_hf_ratio", "pred_hf_ratio", "relative_diff"]), "rgb", "", "high_frequency", {c: c for c in ("gt_hf_ratio", "pred_hf_ratio", "relative_diff")}),
        long_table(per.agg(F.stddev_pop(masks.only_finite("relative_diff")).alias("std")), "rgb", "", "high_frequency", {"std": "relative_diff_std"}),
        long_table(reduce.exact_quantiles(px, "ae", [0.95, 0.99]).groupBy().pivot("share", [0.95, 0.99]).agg(F.max("value")).toDF("p95", "p99"), "rgb", "", "tail_errors", {"p95": "p95", "p99": "p99"}),
    ]
    if bins:
        parts.append(long_table(_means(per, list(bins)), "rgb", "", "depth_binned_photometric", bins))
    if depth and benchmark:
        parts.append(long_table(benchmark_rgb(px, benchmark, "sky" if sky else None), "rgb", "", "benchmark", {"mae": "mae", "mse": "mse"}))
    if features is not None:
        parts.append(long_table(distribution.fid(features), "rgb", "", "image_quality", {"fid": "fid"}))
    return Result(_union(parts), per, rules.report(rules.warnings(per, "rgb", complete=True)))


def evaluate_rays(px: DataFrame, domain: str = "lfov", sky: str | None = None) -> Result:
    """px: img, gx, gy, gz, px, py, pz, a row a ray."""
    if px.isEmpty():
        raise ValueError("there are no rays")
    errors = cut(rays.angular_errors(px, sky))
    norm = lambda s: F.sqrt(sum((F.col(s + c) ** 2 for c in "yz"), F.col(s + "x") ** 2))
    unit = px.where(masks.ray_valid("gx", "gy", "gz", "px", "py", "pz")).groupBy("img").agg(F.abs(F.avg(norm("g")) - 1).alias("gt_norm_deviation"), F.abs(F.avg(norm("p")) - 1).alias("pred_norm_deviation"), F.count(F.lit(1)).alias("n"))
    per = cut(rays.per_image(errors, rays.domain_threshold(domain)).join(unit, "img"))
    middle = reduce.medians(per, ["rho_a"], per.count() > reduce.MANY).withColumnRenamed("rho_a", "median")
    r = per.agg(F.avg("rho_a").alias("mean"), F.stddev_pop("rho_a").alias("std"))
    shares = rays.angular_summary(errors)
    parts = [long_table(r, "rays", "", "rho_a", {c: c for c in r.columns}), long_table(middle, "rays", "", "rho_a", {"median": "median"}), long_table(shares, "rays", "", "angular_error", {c: c for c in shares.columns}), long_table(reduce.histogram_median(errors, "angle"), "rays", "", "angular_error", {"median_angle": "median_angle"})]
    return Result(_union(parts), per, rules.report(rules.warnings(per, "rays", complete=True)), {"domain": domain})
