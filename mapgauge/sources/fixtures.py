"""Image-shaped tables derived from the driver's tables: a row an image pair, maps as row-major arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs(spark, sf_dir, keep=None) -> DataFrame:
    """Even vectors with the following odd one: img, e, n (arrays of double)."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    even = v.where("vec_id % 2 = 0").select(F.expr("vec_id div 2").alias("img"), "e")
    odd = v.where("vec_id % 2 = 1").select(F.expr("vec_id div 2").alias("img"), F.col("e").alias("n"))
    return even.join(odd, "img")


def _maps(df: DataFrame, gt: str, pred: str, *more: str) -> DataFrame:
    cols = [f"zip_with(e, n, (e, n) -> {x}) AS {name}" for name, x in (("gt", gt), ("pred", pred), *(m.split(":", 1) for m in more))]
    return df.selectExpr("img", f"{SIDE} AS height", f"{SIDE} AS width", *cols)


def depth_pairs(spark, sf_dir) -> DataFrame:
    """img, height, width, gt, pred in metres; holes are 0."""
    return _maps(_pairs(spark, sf_dir), "IF(e < -0.3D, 0D, 10D + 4D * e)", "1.05D * (10D + 4D * e) + 0.8D * n - 0.3D")


def normalised_pairs(spark, sf_dir) -> DataFrame:
    """As depth_pairs with predictions in about [-1, 1], and a sky row on top at 1000 m."""
    out = _maps(_pairs(spark, sf_dir), "IF(e < -0.3D, 0D, 10D + 4D * e)", "1.2D * e + 0.05D * n")
    sky = F.transform("gt", lambda x, p: p < SIDE)
    return out.withColumns({"sky": sky, "gt": F.transform("gt", lambda x, p: F.when(p < SIDE, F.lit(1000.0)).otherwise(x))})


def rgb_pairs(spark, sf_dir) -> DataFrame:
    """img, height, width, gr, gg, gb, pr, pg, pb in [0, 1], depth; three vectors make an image."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    v = v.withColumns({"img": F.expr("vec_id div 3"), "k": F.expr("vec_id % 3")})
    gt = F.expr("transform(e, x -> least(greatest(0.5D + x, 0D), 1D))")
    pred = F.expr(f"transform(e, (x, p) -> least(greatest(0.9D * least(greatest(0.5D + x, 0D), 1D) + 0.05D + 0.1D * element_at(e, {SIDE * SIDE} - p), 0D), 1D))")
    one = v.select("img", "k", gt.alias("g"), pred.alias("p"), F.expr("transform(e, x -> 3D + 8D * x)").alias("d"))
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    out = one.groupBy("img").agg(F.count(F.lit(1)).alias("n"), *[pick(c, k).alias(c + "rgb"[k]) for c in "gp" for k in range(3)], pick("d", 0).alias("depth"))
    return out.where("n = 3").select("img", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), "gr", "gg", "gb", "pr", "pg", "pb", "depth")


def ray_pixels(spark, sf_dir) -> DataFrame:
    """img, p, gx, gy, gz, px, py, pz: 21 direction pairs an image."""
    df = _pairs(spark, sf_dir).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(20))))
    at = lambda a, k: F.element_at(a, F.col("p") * 3 + 1 + k)
    gt = [at("e", 0), at("e", 1), at("e", 2) + 1.0]
    pred = [g + 1.2 * at("n", k) for k, g in enumerate(gt)]
    return df.select("img", "p", *[g.alias(c) for g, c in zip(gt, ("gx", "gy", "gz"), strict=True)], *[p.alias(c) for p, c in zip(pred, ("px", "py", "pz"), strict=True)])


def features(spark, sf_dir) -> DataFrame:
    """set, id, x: embeddings as image features, even vectors are the ground truth."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.when(F.col("vec_id") % 2 == 0, "gt").otherwise("pred").alias("set"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


def price_pixels(spark, sf_dir) -> DataFrame:
    """img, gt, pred from lineitem: the largest pool of pixels that the driver's tables give."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("img"), F.col("l_extendedprice").alias("gt"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("pred"))


def frame_table(spark, sf_dir, modality: str) -> DataFrame:
    """hierarchy, file_id, modality: orders as frames under region / nation / customer. Predictions exist for open orders
    only, calibration once a nation."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    if modality == "calibration":
        return nation.select(F.array("r_name", "n_name").alias("hierarchy"), F.lit("intrinsics").alias("file_id"), F.lit(modality).alias("modality"), (F.lit(500.0) + F.col("n_nationkey")).alias("fx"))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    o = o.where("o_orderstatus = 'O'") if modality == "pred" else o
    return o.select(F.array("r_name", "n_name", "c_name").alias("hierarchy"), F.col("o_orderkey").cast("string").alias("file_id"), F.lit(modality).alias("modality"), F.col("o_totalprice").alias("value"))


def pixels(pairs: DataFrame, *maps: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """img, i, j and the named maps as columns, a row a pixel: exploded in place, without a shuffle."""
    z = F.posexplode(F.arrays_zip(*maps)).alias("pos", "z")
    rows = pairs.select("img", "width", *keep, z)
    return rows.select("img", *keep, F.expr("pos div width").cast("int").alias("i"), F.expr("pos % width").cast("int").alias("j"), *[F.col(f"z.{m}").alias(m) for m in maps])
