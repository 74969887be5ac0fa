"""Alignment of a prediction and its ground truth: spatial, planar to radial, and affine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapgauge.functions.masks import fit_mask
from mapgauge.operators.reduce import array_quantile

MODES = ("none", "auto_affine", "affine")


def spatial_kind(gh="gt_height", gw="gt_width", ph="pred_height", pw="pred_width") -> Column:
    """none, vae_crop (prediction in multiples of 8, less than 8 smaller on both sides) or resize."""
    gh, gw, ph, pw = map(F.col, (gh, gw, ph, pw))
    crop = (ph % 8 == 0) & (pw % 8 == 0) & (gh - ph).between(0, 7) & (gw - pw).between(0, 7)
    return F.when((gh == ph) & (gw == pw), "none").when(crop, "vae_crop").otherwise("resize")


def crop(px: DataFrame, height: int, width: int) -> DataFrame:
    """The top left height x width pixels."""
    return px.where((F.col("i") < height) & (F.col("j") < width))


def resize_nearest(px: DataFrame, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Target pixel (i, j) takes source pixel (floor(i h / H), floor(j w / W)); an equi-join with the index table of the
    target, whose size is that of one image."""
    (h, w), (th, tw) = size, to
    target = px.sparkSession.range(th * tw).select((F.col("id") / tw).cast("int").alias("ti"), (F.col("id") % tw).cast("int").alias("tj"))
    target = target.withColumns({"i": F.floor(F.col("ti") * h / th).cast("int"), "j": F.floor(F.col("tj") * w / tw).cast("int")})
    rest = [c for c in px.columns if c not in ("i", "j")]
    return px.join(F.broadcast(target), ["i", "j"]).select(*rest, F.col("ti").alias("i"), F.col("tj").alias("j"))


def area_cells(n: int, m: int) -> list[tuple[int, int, float]]:
    """(target, source, length) of the overlaps of m equal cells with n unit cells."""
    out = []
    for t in range(m):
        lo, hi = t * n / m, (t + 1) * n / m
        out += [(t, s, float(min(hi, s + 1) - max(lo, s))) for s in range(int(lo), min(n, int(hi) + 1)) if min(hi, s + 1) > max(lo, s)]
    return out


def resize_area(px: DataFrame, size: tuple[int, int], to: tuple[int, int], value: str) -> DataFrame:
    """Down-scaling by area: each target pixel is the overlap-weighted mean of the source pixels under it."""
    spark = px.sparkSession
    rows = F.broadcast(spark.createDataFrame(area_cells(size[0], to[0]), "ti int, i int, wi double"))
    cols = F.broadcast(spark.createDataFrame(area_cells(size[1], to[1]), "tj int, j int, wj double"))
    w = F.col("wi") * F.col("wj")
    out = px.join(rows, "i").join(cols, "j").groupBy("img", "ti", "tj").agg((F.sum(F.col(value) * w) / F.sum(w)).alias(value))
    return out.select("img", F.col("ti").alias("i"), F.col("tj").alias("j"), value)


def linear_cells(n: int, m: int) -> list[tuple[int, int, float]]:
    out = []
    for t in range(m):
        at = min(max((t + 0.5) * n / m - 0.5, 0.0), n - 1.0)
        s = min(int(at), n - 1)
        out += [(t, s, 1.0 - (at - s))] + ([(t, s + 1, at - s)] if at > s else [])
    return out


def resize_linear(px: DataFrame, size: tuple[int, int], to: tuple[int, int], value: str) -> DataFrame:
    """Up-scaling with half-pixel centres and clamped borders, four neighbours."""
    spark = px.sparkSession
    rows = F.broadcast(spark.createDataFrame(linear_cells(size[0], to[0]), "ti int, i int, wi double"))
    cols = F.broadcast(spark.createDataFrame(linear_cells(size[1], to[1]), "tj int, j int, wj double"))
    out = px.join(rows, "i").join(cols, "j").groupBy("img", "ti", "tj").agg(F.sum(F.col(value) * F.col("wi") * F.col("wj")).alias(value))
    return out.select("img", F.col("ti").alias("i"), F.col("tj").alias("j"), value)


def radial(depth: Column, u: Column, v: Column, fx, fy, cx, cy) -> Column:
    """Distance along the ray of pixel (u, v) for a depth along the optical axis."""
    x, y = (u - cx) / fx, (v - cy) / fy
    return depth * F.sqrt(x * x + y * y + 1.0)


def is_normalised(pairs: DataFrame, order: str = "img", pred: str = "pred") -> bool:
    """Whether the first sample's finite predictions lie in [-1, 1] up to 1e-3: one small job, its answer shapes the plan."""
    row = pairs.orderBy(order).select(F.filter(pred, lambda x: ~F.isnan(x)).alias("p")).limit(1)
    got = row.select(F.array_max("p").alias("hi"), F.array_min("p").alias("lo")).first()
    return bool(got and got["hi"] is not None and got["hi"] <= 1 + 1e-3 and got["lo"] >= -1 - 1e-3)


def with_trim(pairs: DataFrame, share: float = 0.95, sky: str | None = "sky") -> DataFrame:
    """pairs with trim: the ground truth's quantile over the pixels that a fit may use, above which it takes none, or
    infinity if fewer than two would be left. Found in each image's row, without a shuffle of its pixels."""
    if not 0 < share <= 1:
        raise ValueError("the quantile must be in (0, 1]")
    usable = F.transform(F.arrays_zip("gt", "pred", *([sky] if sky else [])), lambda z: F.when(fit_mask(z["gt"], z["pred"], z[sky] if sky else None), z["gt"]))
    top = pairs.withColumn("_usable", usable).withColumn("_top", array_quantile(F.col("_usable"), share))
    left = F.size(F.filter("_usable", lambda v: v <= F.col("_top")))
    return top.withColumn("trim", F.when(left >= 2, F.col("_top")).otherwise(float("inf"))).drop("_usable", "_top")


def trimmed(sky: str | None = "sky") -> Column:
    """Pixels for a fit after the far tail is cut (with_trim)."""
    return fit_mask(sky=sky) & (F.col("gt") <= F.col("trim"))


def affine_fit(px: DataFrame, mask: Column, source: str = "pred") -> DataFrame:
    """img, n, s, t, fitted: least squares s * source + t = gt over the mask. A constant source takes the least-norm
    solution; fewer than two pixels give s = 1, t = 0."""
    rows = px.withColumn("use", mask)
    g, p = F.when(F.col("use"), F.col("gt")), F.when(F.col("use"), F.col(source))
    fit = rows.groupBy("img").agg(F.count(p).alias("n"), F.regr_slope(g, p).alias("a"), F.regr_intercept(g, p).alias("b"), F.avg(g).alias("mg"), F.avg(p).alias("mp"), F.max(p).alias("hi"), F.min(p).alias("lo"))
    flat = F.col("hi") == F.col("lo")
    least = F.col("mg") / (F.col("mp") * F.col("mp") + 1)
    return fit.select(
        "img", "n",
        F.when(F.col("n") < 2, 1.0).when(flat, F.col("mp") * least).otherwise(F.col("a")).alias("s"),
        F.when(F.col("n") < 2, 0.0).when(flat, least).otherwise(F.col("b")).alias("t"), (F.col("n") >= 2).alias("fitted"),
    )


def apply_affine(px: DataFrame, fit: DataFrame, source: str = "pred") -> DataFrame:
    """px with pred replaced by s * source + t, as float32 values."""
    return px.join(fit.select("img", "s", "t"), "img").withColumn("pred", (F.col("s") * F.col(source) + F.col("t")).cast("float").cast("double")).drop("s", "t")


def spaces(mode: str, normalised: bool) -> list[str]:
    """Which spaces are reported: native, metric or both."""
    if mode not in MODES:
        raise ValueError(f"alignment mode must be one of {MODES}")
    applied = mode == "affine" or (mode == "auto_affine" and normalised)
    return ["native"] * (applied or normalised) + ["metric"] * (applied or not normalised)


def normalise(px: DataFrame, value: str, ok: Column) -> DataFrame:
    """value scaled to [0, 1] over an image's valid pixels; a range below 1e-8 gives 0."""
    img = Window.partitionBy("img")
    lo, hi = F.min(F.when(ok, F.col(value))).over(img), F.max(F.when(ok, F.col(value))).over(img)
    scaled = F.when(hi - lo < 1e-8, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - lo) / (hi - lo))))
    return px.withColumn(value, scaled)
