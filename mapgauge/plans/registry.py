"""The registered queries and their SQL twins in DuckDB's dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapgauge.functions import masks
from mapgauge.operators import align, distribution, images, match, rays, reduce, rules
from mapgauge.sources import fixtures as fx

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function by its name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, NaN as null, no negative zero: sums differ by engine in their last digits."""
    return df.select(*[(F.when(~F.isnan(c), F.round(c, 6)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- SQL of the derived tables -----------------------------------------------------------------------------------------

E_ = "a.embedding[k + 1]::DOUBLE"
N_ = "b.embedding[k + 1]::DOUBLE"
PX_DEPTH = f"""px AS (SELECT a.vec_id // 2 AS img, CAST(k // 8 AS INTEGER) AS i, CAST(k % 8 AS INTEGER) AS j,
    CASE WHEN {E_} < -0.3::DOUBLE THEN 0::DOUBLE ELSE 10 + 4 * {E_} END AS gt, 1.05::DOUBLE * (10 + 4 * {E_}) + 0.8::DOUBLE * {N_} - 0.3::DOUBLE AS pred
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, range(64) t(k) WHERE a.vec_id % 2 = 0)"""
PX_NORM = f"""px AS (SELECT a.vec_id // 2 AS img, CAST(k // 8 AS INTEGER) AS i, CAST(k % 8 AS INTEGER) AS j, k < 8 AS sky,
    CASE WHEN k < 8 THEN 1000::DOUBLE WHEN {E_} < -0.3::DOUBLE THEN 0::DOUBLE ELSE 10 + 4 * {E_} END AS gt, 1.2::DOUBLE * {E_} + 0.05::DOUBLE * {N_} AS pred
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, range(64) t(k) WHERE a.vec_id % 2 = 0)"""
_CH = lambda n: f"least(greatest(0.5::DOUBLE + {n}.embedding[k + 1]::DOUBLE, 0), 1)"
_PR = lambda n: f"least(greatest(0.9::DOUBLE * {_CH(n)} + 0.05::DOUBLE + 0.1::DOUBLE * {n}.embedding[64 - k]::DOUBLE, 0), 1)"
PX_RGB = f"""px AS (SELECT a.vec_id // 3 AS img, CAST(k // 8 AS INTEGER) AS i, CAST(k % 8 AS INTEGER) AS j, {_CH("a")} AS gr, {_CH("b")} AS gg, {_CH("c")} AS gb,
    {_PR("a")} AS pr, {_PR("b")} AS pg, {_PR("c")} AS pb, 3 + 8 * {E_} AS depth
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2, range(64) t(k) WHERE a.vec_id % 3 = 0)"""
_G = [f"a.embedding[3 * p + {k + 1}]::DOUBLE" + (" + 1" if k == 2 else "") for k in range(3)]
PX_RAYS = f"""px AS (SELECT a.vec_id // 2 AS img, p, {_G[0]} AS gx, {_G[1]} AS gy, {_G[2]} AS gz, {", ".join(f"{_G[k]} + 1.2::DOUBLE * b.embedding[3 * p + {k + 1}]::DOUBLE AS p{'xyz'[k]}" for k in range(3))}
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, range(21) t(p) WHERE a.vec_id % 2 = 0),
    er AS (SELECT img, degrees(acos(greatest(-1, least(1, (gx*px + gy*py + gz*pz) / (sqrt(gx*gx + gy*gy + gz*gz) * sqrt(px*px + py*py + pz*pz)))))) AS angle FROM px
      WHERE sqrt(gx*gx + gy*gy + gz*gz) > 1e-8 AND sqrt(px*px + py*py + pz*pz) > 1e-8)"""
PX_PRICE = "px AS (SELECT l_suppkey AS img, l_extendedprice AS gt, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS pred FROM lineitem)"
OK = "gt > 0 AND pred > 0"
_SUMS = f"""count(*) FILTER ({OK}) AS n, sum(abs(pred-gt)/gt) FILTER ({OK}) AS s1, sum((pred-gt)*(pred-gt)/gt) FILTER ({OK}) AS s2, sum(abs(pred-gt)) FILTER ({OK}) AS s3,
    sum((pred-gt)*(pred-gt)) FILTER ({OK}) AS s4, sum(CASE WHEN {OK} THEN (ln(pred)-ln(gt))*(ln(pred)-ln(gt)) END) AS s5, sum(CASE WHEN {OK} THEN abs(log10(pred)-log10(gt)) END) AS s6,
    sum(CASE WHEN {OK} THEN ln(pred)-ln(gt) END) AS s7, {", ".join(f"count(*) FILTER ({OK} AND greatest(pred/gt, gt/pred) < {1.25**k!r}::DOUBLE) AS c{k}" for k in (1, 2, 3))}"""
_TEN = "s1/nullif(n,0) AS absrel, s2/nullif(n,0) AS sqrel, s3/nullif(n,0) AS mae, sqrt(s4/nullif(n,0)) AS rmse, sqrt(s5/nullif(n,0)) AS rmse_log, s6/nullif(n,0) AS log10, CASE WHEN n > 0 THEN sqrt(greatest(s5/nullif(n,0) - (s7/nullif(n,0))*(s7/nullif(n,0)), 0)) END AS silog, c1/nullif(n,0) AS delta1, c2/nullif(n,0) AS delta2, c3/nullif(n,0) AS delta3"
_M = reduce.STANDARD
_R = lambda names: ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in names)


def _standard(px: str) -> str:
    return f"""WITH {px}, st AS (SELECT img, {_SUMS} FROM px GROUP BY img), im AS (SELECT {_TEN} FROM st), po AS (SELECT {_TEN} FROM (SELECT {", ".join(f"sum({c}) AS {c}" for c in "n s1 s2 s3 s4 s5 s6 s7 c1 c2 c3".split())} FROM st)),
    al AS (SELECT 'image_mean' AS reduction, {", ".join(f"avg({m}) AS {m}" for m in _M)} FROM im UNION ALL SELECT 'image_median', {", ".join(f"quantile_cont({m}, 0.5)" for m in _M)} FROM im UNION ALL SELECT 'pixel_pool', {", ".join(_M)} FROM po)
    SELECT reduction, {_R(_M)} FROM al"""


def _depth(spark, d) -> DataFrame:
    return fx.pixels(fx.depth_pairs(spark, d), "gt", "pred")


# --- depth, element-wise -----------------------------------------------------------------------------------------------


@query(_standard(PX_DEPTH))
def standard_reducers(spark, d):
    return rounded(reduce.standard_reducers(reduce.pixel_stats(_depth(spark, d), ["img"])))


@query(_standard(PX_PRICE))
def standard_reducers_large(spark, d):
    return rounded(reduce.standard_reducers(reduce.pixel_stats(fx.price_pixels(spark, d), ["img"])))


@query(f"WITH {PX_DEPTH}, st AS (SELECT img, {_SUMS} FROM px GROUP BY img), m AS (SELECT img, n, {_TEN} FROM st) SELECT img, n, {_R(_M)} FROM m")
def standard_per_image(spark, d):
    stats = reduce.pixel_stats(_depth(spark, d), ["img"])
    return rounded(stats.select("img", "n", *[c.alias(m) for m, c in reduce.standard_columns().items()]))


def _quantile_sql(px: str) -> str:
    q = lambda x: f"SELECT unnest([0.5, 0.9])::DOUBLE AS share, unnest(quantile_cont({x}, [0.5, 0.9])) AS value FROM px WHERE {OK}"
    parts = [f"SELECT '{n}' AS metric, share, round(value, 6) AS value FROM ({q(x)})" for n, x in (("absrel", "abs(pred-gt)/gt"), ("err", "abs(pred-gt)"), ("logerr", "abs(ln(pred)-ln(gt))"))]
    return f"WITH {px} " + " UNION ALL ".join(parts)


def _quantiles(px) -> DataFrame:
    names = ("absrel", "err", "logerr")
    return rounded(reduce.pooled_quantiles(reduce.depth_errors(px), {m: F.col(m) for m in names}, [0.5, 0.9]).withColumnRenamed("name", "metric"))


@query(_quantile_sql(PX_DEPTH))
def pooled_quantiles(spark, d):
    return _quantiles(_depth(spark, d))


@query(_quantile_sql(PX_PRICE))
def pooled_quantiles_large(spark, d):
    return _quantiles(fx.price_pixels(spark, d))


@query(f"WITH {PX_DEPTH}, s AS (SELECT img, avg((pred-gt)*(pred-gt)) FILTER ({OK}) AS mse, max(gt) FILTER ({OK}) AS top, count(*) FILTER ({OK}) AS n FROM px GROUP BY img) SELECT img, round(top, 6) AS max_val, round(CASE WHEN n = 0 THEN 0 WHEN mse < 1e-10 THEN 'inf'::DOUBLE ELSE 10 * log10(top * top / mse) END, 6) AS psnr FROM s")
def depth_psnr(spark, d):
    """0 without valid pixels, infinite below an error of 1e-10 (and then left out of means)."""
    e = F.col("pred") - F.col("gt")
    s = _depth(spark, d).withColumn("ok", masks.valid()).groupBy("img").agg(F.avg(F.when(F.col("ok"), e * e)).alias("mse"), F.max(F.when(F.col("ok"), F.col("gt"))).alias("max_val"))
    psnr = F.when(F.col("mse").isNull(), 0.0).when(F.col("mse") < 1e-10, float("inf")).otherwise(10 * F.log10(F.col("max_val") * F.col("max_val") / F.col("mse")))
    return rounded(s.select("img", "max_val", psnr.alias("psnr")))


@query(f"WITH {PX_DEPTH}, s AS (SELECT img, avg((ln(pred)-ln(gt))*(ln(pred)-ln(gt))) - avg(ln(pred)-ln(gt)) * avg(ln(pred)-ln(gt)) AS v FROM px WHERE {OK} GROUP BY img) SELECT img, round(CASE WHEN v >= 0 THEN sqrt(v) END, 6) AS silog FROM s")
def silog_unclamped(spark, d):
    """Null, not 0, for a negative variance."""
    x = F.ln("pred") - F.ln("gt")
    s = _depth(spark, d).where(masks.valid()).groupBy("img").agg((F.avg(x * x) - F.avg(x) * F.avg(x)).alias("v"))
    return rounded(s.select("img", F.when(F.col("v") >= 0, F.sqrt("v")).alias("silog")))


def _bins_sql(px: str, bin_: str, where: str = "TRUE") -> str:
    return f"""WITH {px}, bp AS (SELECT *, {bin_} AS b FROM px WHERE {where}), al AS (SELECT * FROM bp WHERE b IS NOT NULL UNION ALL SELECT * REPLACE ('all' AS b) FROM bp WHERE b IS NOT NULL),
    st AS (SELECT b, {_SUMS} FROM al GROUP BY b), m AS (SELECT b, n, {_TEN} FROM st) SELECT b AS bin, n, {_R(_M)} FROM m"""


def _bins(px, bin_) -> DataFrame:
    stats = reduce.binned_stats(px, bin_, [])
    return rounded(stats.select("bin", F.col("n").cast("long").alias("n"), *[c.alias(m) for m, c in reduce.standard_columns().items()]))


_A, _B = masks.benchmark_edges(8, 12)


@query(_bins_sql(PX_DEPTH, f"CASE WHEN gt BETWEEN 8 AND 12 THEN CASE WHEN gt < {_A!r}::DOUBLE THEN 'near' WHEN gt < {_B!r}::DOUBLE THEN 'mid' ELSE 'far' END END", "pred > 0"))
def benchmark_bins(spark, d):
    return _bins(_depth(spark, d).where((F.col("pred") > 0) & masks.finite("pred")), masks.benchmark_bin("gt", 8, 12))


@query(_bins_sql(PX_PRICE, "CASE WHEN gt > 0 THEN CASE WHEN gt <= 20000 THEN 'near' WHEN gt <= 50000 THEN 'mid' ELSE 'far' END END"))
def fixed_bins_large(spark, d):
    return _bins(fx.price_pixels(spark, d), masks.fixed_bin("gt", 20_000, 50_000))


# --- alignment -------------------------------------------------------------------------------------------------------

_FIT = """ft AS (SELECT img, count(*) AS n, CASE WHEN count(*) < 2 THEN 1 WHEN max(pred) = min(pred) THEN avg(pred)*avg(gt)/(avg(pred)*avg(pred)+1) ELSE regr_slope(gt, pred) END AS s,
    CASE WHEN count(*) < 2 THEN 0 WHEN max(pred) = min(pred) THEN avg(gt)/(avg(pred)*avg(pred)+1) ELSE regr_intercept(gt, pred) END AS t FROM {0} WHERE {1} GROUP BY img)"""


def _norm(spark, d) -> DataFrame:
    return fx.pixels(fx.normalised_pairs(spark, d), "gt", "pred", "sky")


@query(f"WITH {PX_NORM}, {_FIT.format('px', 'gt > 0 AND NOT sky')} SELECT img, n, round(s, 6) AS s, round(t, 6) + 0.0 AS t, n >= 2 AS fitted FROM ft")
def affine_fit(spark, d):
    return rounded(align.affine_fit(_norm(spark, d), masks.fit_mask(sky="sky")))


_TRIM = "tp AS (SELECT img, quantile_cont(gt, 0.95) AS top FROM px WHERE gt > 0 AND NOT sky GROUP BY img), tr AS (SELECT px.* FROM px JOIN tp USING (img) WHERE gt <= top)"


@query(f"WITH {PX_NORM}, {_TRIM}, {_FIT.format('tr', 'gt > 0 AND NOT sky')} SELECT img, n, round(s, 6) AS s, round(t, 6) + 0.0 AS t, n >= 2 AS fitted FROM ft")
def affine_fit_p95(spark, d):
    px = fx.pixels(align.with_trim(fx.normalised_pairs(spark, d)), "gt", "pred", "sky", keep=("trim",))
    return rounded(align.affine_fit(px, align.trimmed()))


@query(_standard(f"{PX_NORM.replace('px AS', 'p0 AS', 1)}, {_FIT.format('p0', 'gt > 0 AND NOT sky')}, px AS (SELECT img, gt, CASE WHEN sky THEN NULL ELSE CAST(CAST(s * pred + t AS FLOAT) AS DOUBLE) END AS pred FROM p0 JOIN ft USING (img))"))
def affine_aligned_metrics(spark, d):
    px = _norm(spark, d)
    fitted = align.apply_affine(px, align.affine_fit(px, masks.fit_mask(sky="sky")))
    return rounded(reduce.standard_reducers(reduce.pixel_stats(fitted, ["img"], masks.valid(sky="sky"))))


@query("SELECT m AS mode, unnest(CASE WHEN m = 'none' THEN ['native'] ELSE ['native', 'metric'] END) AS space FROM (VALUES ('none'), ('auto_affine'), ('affine')) t(m)")
def space_emission(spark, d):
    norm = align.is_normalised(fx.normalised_pairs(spark, d))
    return spark.createDataFrame([(m, s) for m in align.MODES for s in align.spaces(m, norm)], "mode string, space string")


@query(f"WITH {PX_DEPTH} SELECT img, i, j, round(gt * sqrt(((j-3.5)/525)*((j-3.5)/525) + ((i-3.5)/525)*((i-3.5)/525) + 1), 6) AS radial FROM px")
def planar_to_radial(spark, d):
    return rounded(_depth(spark, d).select("img", "i", "j", align.radial(F.col("gt"), F.col("j"), F.col("i"), 525.0, 525.0, 3.5, 3.5).alias("radial")))


@query("""SELECT p_partkey, CASE WHEN gh = ph AND gw = pw THEN 'none' WHEN ph % 8 = 0 AND pw % 8 = 0 AND gh - ph BETWEEN 0 AND 7 AND gw - pw BETWEEN 0 AND 7 THEN 'vae_crop' ELSE 'resize' END AS kind
    FROM (SELECT p_partkey, p_size + 370 AS gh, p_size + 1230 AS gw, CASE WHEN p_partkey % 3 = 0 THEN p_size + 370 ELSE (p_size + 370) // 8 * 8 END AS ph, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1230 ELSE (p_size + 1230) // 8 * 8 - CASE WHEN p_partkey % 3 = 1 THEN 8 ELSE 0 END END AS pw FROM part)""")
def spatial_classify(spark, d):
    x = F.expr("p_partkey % 3")
    rows = fx.table(spark, d, "part").select("p_partkey", (F.col("p_size") + 370).alias("gt_height"), (F.col("p_size") + 1230).alias("gt_width"))
    rows = rows.withColumns({"pred_height": F.when(x == 0, F.col("gt_height")).otherwise(F.expr("gt_height div 8 * 8")), "pred_width": F.when(x == 0, F.col("gt_width")).otherwise(F.expr("gt_width div 8 * 8") - F.when(x == 1, 8).otherwise(0))})
    return rows.select("p_partkey", align.spatial_kind().alias("kind"))


@query(f"WITH {PX_DEPTH} SELECT img, i, j, round(gt, 6) AS gt FROM px WHERE i < 6 AND j < 5")
def crop_align(spark, d):
    return rounded(align.crop(_depth(spark, d), 6, 5).select("img", "i", "j", "gt"))


@query(f"WITH {PX_DEPTH}, t AS (SELECT CAST(r AS INTEGER) AS ti, CAST(c AS INTEGER) AS tj FROM range(12) a(r), range(10) b(c)) SELECT img, ti AS i, tj AS j, round(gt, 6) AS gt FROM t JOIN px ON i = ti * 8 // 12 AND j = tj * 8 // 10")
def resize_nearest(spark, d):
    return rounded(align.resize_nearest(_depth(spark, d).select("img", "i", "j", "gt"), (8, 8), (12, 10)))


@query(f"""WITH {PX_DEPTH}, o AS (SELECT CAST(t AS INTEGER) AS t, CAST(s AS INTEGER) AS s, least((t+1)*8.0::DOUBLE/3, s+1) - greatest(t*8.0::DOUBLE/3, s) AS w FROM range(3) a(t), range(8) b(s) WHERE least((t+1)*8.0::DOUBLE/3, s+1) > greatest(t*8.0::DOUBLE/3, s))
    SELECT img, a.t AS i, b.t AS j, round(sum(gt*a.w*b.w)/sum(a.w*b.w), 6) AS gt FROM px JOIN o a ON a.s = i JOIN o b ON b.s = j GROUP BY ALL""")
def resize_area(spark, d):
    return rounded(align.resize_area(_depth(spark, d), (8, 8), (3, 3), "gt"))


# --- matching and hierarchies ----------------------------------------------------------------------------------------

_FR = "fr AS (SELECT [r_name, n_name, c_name] AS hierarchy, CAST(o_orderkey AS VARCHAR) AS file_id, o_totalprice AS value, o_orderstatus, n_nationkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {_FR} SELECT g.hierarchy, g.file_id, g.value AS gt, p.value AS pred FROM fr g JOIN fr p ON g.hierarchy = p.hierarchy AND g.file_id = p.file_id WHERE p.o_orderstatus = 'O'")
def multimodal_match(spark, d):
    return match.match_frames({m: fx.frame_table(spark, d, m) for m in ("gt", "pred")})


@query(f"WITH {_FR} SELECT hierarchy, file_id FROM fr WHERE o_orderstatus <> 'O'")
def unmatched_frames(spark, d):
    return match.unmatched(fx.frame_table(spark, d, "gt"), fx.frame_table(spark, d, "pred"))


@query(f"WITH {_FR} SELECT hierarchy, file_id, value, 500.0::DOUBLE + n_nationkey AS fx FROM fr")
def prefix_join_calibration(spark, d):
    gt = fx.frame_table(spark, d, "gt").drop("modality")
    return match.attach_ancestor(gt, fx.frame_table(spark, d, "calibration"), ["fx"])


@query(f"WITH {_FR} SELECT hierarchy, file_id, value FROM fr WHERE hierarchy[1] = (SELECT min(r_name) FROM region)")
def subtree_retrieve(spark, d):
    first = fx.table(spark, d, "region").agg(F.min("r_name")).first()[0]
    return match.subtree(fx.frame_table(spark, d, "gt"), [first]).select("hierarchy", "file_id", "value")


@query(f"WITH {_FR} SELECT hierarchy, file_id, CASE WHEN o_orderstatus = 'O' THEN value * 2 ELSE value END AS value FROM fr")
def upsert_last_wins(spark, d):
    p = fx.frame_table(spark, d, "pred").select("hierarchy", "file_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("turn"), "value").withColumn("value", F.col("value") * F.col("turn"))
    return match.upsert(fx.frame_table(spark, d, "gt").select("hierarchy", "file_id", "value"), p, "turn")


@query(f"WITH {_FR} SELECT hierarchy, file_id, CAST(row_number() OVER (PARTITION BY hierarchy[1] ORDER BY hierarchy, file_id) - 1 AS INTEGER) AS sample_idx FROM fr")
def sample_index(spark, d):
    return match.with_index(fx.frame_table(spark, d, "gt")).select("hierarchy", "file_id", "sample_idx")


# --- rgb -------------------------------------------------------------------------------------------------------------


def _rgb(spark, d) -> DataFrame:
    return fx.pixels(fx.rgb_pairs(spark, d), *images.RGB, "depth")


_ABS = "(abs(pr-gr)+abs(pg-gg)+abs(pb-gb))/3"
_SQ = "((pr-gr)*(pr-gr)+(pg-gg)*(pg-gg)+(pb-gb)*(pb-gb))/3"
def _channels(f):
    """Mean over the colour channels of f(prediction, ground truth)."""
    return (f(F.col("pr"), F.col("gr")) + f(F.col("pg"), F.col("gg")) + f(F.col("pb"), F.col("gb"))) / 3


def _abs():
    return _channels(lambda p, g: F.abs(p - g))


def _error_arrays(spark, d) -> DataFrame:
    """img, height, width, e: each image's errors in its row."""
    error = lambda z: (F.abs(z["pr"] - z["gr"]) + F.abs(z["pg"] - z["gg"]) + F.abs(z["pb"] - z["gb"])) / 3
    return fx.rgb_pairs(spark, d).select("img", "height", "width", F.transform(F.arrays_zip(*images.RGB), error).alias("e"))


def _sq():
    return _channels(lambda p, g: F.pow(p - g, 2))


@query(f"WITH {PX_RGB}, s AS (SELECT img, avg({_SQ}) AS mse FROM px GROUP BY img) SELECT img, round(CASE WHEN mse < 1e-10 THEN 'inf'::DOUBLE ELSE 10*log10(1/mse) END, 6) AS psnr FROM s")
def rgb_psnr(spark, d):
    s = _rgb(spark, d).groupBy("img").agg(F.avg(_sq()).alias("mse"))
    return rounded(s.select("img", F.when(F.col("mse") < 1e-10, float("inf")).otherwise(10 * F.log10(1 / F.col("mse"))).alias("psnr")))


@query(f"WITH {PX_RGB}, s AS (SELECT img, avg({_SQ}) AS mse FROM px WHERE depth > 3 GROUP BY img) SELECT img, round(10*log10(1/mse), 6) AS psnr FROM s")
def rgb_psnr_masked(spark, d):
    s = _rgb(spark, d).where("depth > 3").groupBy("img").agg(F.avg(_sq()).alias("mse"))
    return rounded(s.select("img", (10 * F.log10(1 / F.col("mse"))).alias("psnr")))


@query(f"WITH {PX_RGB} SELECT img, {', '.join(f'round(quantile_cont({_ABS}, {q}), 6) AS {n}' for n, q in (('p95', 0.95), ('p99', 0.99)))}, round(max({_ABS}), 6) AS max FROM px GROUP BY img")
def tail_errors(spark, d):
    e = _error_arrays(spark, d)
    return rounded(e.select("img", reduce.array_quantile(F.col("e"), 0.95).alias("p95"), reduce.array_quantile(F.col("e"), 0.99).alias("p99"), F.array_max("e").alias("max")))


@query(f"WITH {PX_RGB}, e AS (SELECT {_ABS} AS e FROM px) SELECT unnest([0.95, 0.99])::DOUBLE AS share, round(unnest(quantile_cont(e, [0.95, 0.99])), 6) AS value FROM e")
def tail_errors_pooled(spark, d):
    return rounded(reduce.exact_quantiles(_rgb(spark, d).select(_abs().alias("e")), "e", [0.95, 0.99]))


@query(f"WITH {PX_RGB} SELECT img, " + ", ".join(f"round(quantile_cont(abs(p{c}-g{c}), {q}), 6) AS {c}_{n}" for c in "rgb" for n, q in (("p95", 0.95), ("p99", 0.99))) + " FROM px GROUP BY img")
def tail_errors_per_channel(spark, d):
    error = lambda c: F.zip_with(f"p{c}", f"g{c}", lambda p, g: F.abs(p - g))
    return rounded(fx.rgb_pairs(spark, d).select("img", *[reduce.array_quantile(error(c), q).alias(f"{c}_{n}") for c in "rgb" for n, q in (("p95", 0.95), ("p99", 0.99))]))


@query(f"WITH {PX_RGB}, e AS (SELECT img, i, j, {_ABS} AS e FROM px), q AS (SELECT img, quantile_cont(e, 0.95) AS q FROM e GROUP BY img) SELECT img, i, j, round(e, 6) AS e FROM e JOIN q USING (img) WHERE e >= q")
def tail_mask(spark, d):
    e = _error_arrays(spark, d).withColumn("q", reduce.array_quantile(F.col("e"), 0.95))
    return rounded(fx.pixels(e, "e", keep=("q",)).where("e >= q").drop("q"))


@query(f"""WITH {PX_RGB}, e AS (SELECT img, {_ABS} AS a, {_SQ} AS s, CASE WHEN depth > 0 THEN CASE WHEN depth <= 1 THEN 'near' WHEN depth <= 5 THEN 'mid' ELSE 'far' END END AS b FROM px)
    SELECT img, {", ".join(f"round(coalesce(avg({v}) FILTER (b = '{n}'), 0), 6) AS {m}_{n}, count(*) FILTER (b = '{n}') AS {m}_{n}_count" for m, v in (("mae", "a"), ("mse", "s")) for n in ("near", "mid", "far"))}, round(coalesce(avg(a) FILTER (b IS NOT NULL), 0), 6) AS mae_all, round(coalesce(avg(s) FILTER (b IS NOT NULL), 0), 6) AS mse_all FROM e GROUP BY img""")
def fixed_bins_mae_mse(spark, d):
    """An empty bin scores 0; its count tells."""
    e = _rgb(spark, d).select("img", _abs().alias("mae"), _sq().alias("mse"), masks.fixed_bin("depth").alias("bin"))
    per = [f for m in ("mae", "mse") for b in ("near", "mid", "far") for f in (F.coalesce(F.avg(F.when(F.col("bin") == b, F.col(m))), F.lit(0.0)).alias(f"{m}_{b}"), F.count(F.when(F.col("bin") == b, 1)).alias(f"{m}_{b}_count"))]
    every = [F.coalesce(F.avg(F.when(F.col("bin").isNotNull(), F.col(m))), F.lit(0.0)).alias(f"{m}_all") for m in ("mae", "mse")]
    return rounded(e.groupBy("img").agg(*per, *every))


# --- stencils: the twins work on windows and neighbour joins ----------------------------------------------------------

_NB = "lag({0}) OVER (PARTITION BY img, {1} ORDER BY {2})"
_EDGE = lambda z: f"greatest(abs(coalesce(lead({z}) OVER r, 0) - coalesce(lag({z}) OVER r, 0)), abs(coalesce(lead({z}) OVER c, 0) - coalesce(lag({z}) OVER c, 0))) > 0.1::DOUBLE * {z} AND {OK}"
_EDGES = f"ed AS (SELECT img, i, j, {_EDGE('gt')} AS g, {_EDGE('pred')} AS p FROM px WINDOW r AS (PARTITION BY img, i ORDER BY j), c AS (PARTITION BY img, j ORDER BY i))"
_SCORE = """di AS (SELECT a.img, a.i, a.j, any_value(a.g) AS g, any_value(a.p) AS p, bool_or(b.g) AS dg, bool_or(b.p) AS dp FROM ed a JOIN ed b ON a.img = b.img AND abs(a.i-b.i) <= 1 AND abs(a.j-b.j) <= 1 GROUP BY ALL),
    sc AS (SELECT img, count(*) FILTER (g) AS gt_edges, count(*) FILTER (p) AS pred_edges, coalesce(count(*) FILTER (p AND dg) / nullif(count(*) FILTER (p), 0), 0) AS precision, coalesce(count(*) FILTER (g AND dp) / nullif(count(*) FILTER (g), 0), 0) AS recall FROM di GROUP BY img)
    SELECT img, gt_edges, pred_edges, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2*precision*recall/nullif(precision+recall, 0), 0), 6) AS f1 FROM sc"""


@query(f"WITH {PX_DEPTH}, {_EDGES}, {_SCORE}")
def depth_edge_f1(spark, d):
    return rounded(images.depth_edge_f1(fx.depth_pairs(spark, d)))


@query(f"WITH {PX_DEPTH}, {_EDGES}, m AS ({_SCORE.replace('di AS', 'WITH di AS', 1)}) SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, count(*) AS images FROM m WHERE gt_edges > 0 OR pred_edges > 0")
def depth_edge_f1_macro(spark, d):
    """Mean over images with any edge."""
    e = images.depth_edge_f1(fx.depth_pairs(spark, d)).where("gt_edges > 0 OR pred_edges > 0")
    return rounded(e.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.count(F.lit(1)).alias("images")))


_N9 = "sb AS (SELECT a.img, a.i, a.j, {0} FROM px a JOIN px b ON a.img = b.img AND abs(a.i-b.i) <= 1 AND abs(a.j-b.j) <= 1 GROUP BY ALL)"
_SX = lambda z, ok: f"sum(CASE WHEN {ok} THEN {z} ELSE 0 END * (b.j-a.j) * (2 - abs(b.i-a.i)))/8"
_SY = lambda z, ok: f"sum(CASE WHEN {ok} THEN {z} ELSE 0 END * (b.i-a.i) * (2 - abs(b.j-a.j)))/8"
_BOK = "b.gt > 0 AND b.pred > 0"
_NORMALS = f"""WITH {PX_DEPTH}, {_N9.format(f"count(*) FILTER ({_BOK}) AS n, {_SX('b.gt', _BOK)} AS gx, {_SY('b.gt', _BOK)} AS gy, {_SX('b.pred', _BOK)} AS px_, {_SY('b.pred', _BOK)} AS py_")},
    an AS (SELECT img, degrees(acos(greatest(-1, least(1, (gx*px_ + gy*py_ + 1)/(sqrt(gx*gx+gy*gy+1)*sqrt(px_*px_+py_*py_+1)))))) AS angle FROM sb WHERE n = 9)"""


@query(f"{_NORMALS} SELECT img, count(*) AS n, round(avg(angle), 5) AS mean_angle, round(quantile_cont(angle, 0.5), 5) AS median_angle FROM an GROUP BY img")
def normal_consistency(spark, d):
    a = images.normal_angles(fx.depth_pairs(spark, d)).groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.avg("angle").alias("m"), F.percentile("angle", 0.5).alias("q"))
    return a.select("img", "n", F.round("m", 5).alias("mean_angle"), F.round("q", 5).alias("median_angle"))


@query(f"{_NORMALS} SELECT round(avg(CASE WHEN angle < 11.25 THEN 1.0::DOUBLE ELSE 0 END)*100, 6) AS percent_below_11_25, round(avg(CASE WHEN angle < 22.5 THEN 1.0::DOUBLE ELSE 0 END)*100, 6) AS percent_below_22_5, round(avg(CASE WHEN angle < 30 THEN 1.0::DOUBLE ELSE 0 END)*100, 6) AS percent_below_30 FROM an")
def normal_shares(spark, d):
    return rounded(reduce.below_shares(images.normal_angles(fx.depth_pairs(spark, d)), "angle", [11.25, 22.5, 30]))


_LUMA = lambda s: f"(0.299::DOUBLE*{s}r + 0.587::DOUBLE*{s}g + 0.114::DOUBLE*{s}b)"
#: Neighbours with the border row or column repeated.
_REFL = "nb AS (SELECT img, i, j, di, dj, least(greatest(i+di, 0), 7) AS ni, least(greatest(j+dj, 0), 7) AS nj FROM px, (SELECT unnest([-1,0,1]) AS di), (SELECT unnest([-1,0,1]) AS dj))"
_GRAD = lambda z, k: f"sqrt(pow(sum({z}*dj*(CASE WHEN di = 0 THEN {k[1]} ELSE {k[0]} END)), 2) + pow(sum({z}*di*(CASE WHEN dj = 0 THEN {k[1]} ELSE {k[0]} END)), 2))"


@query(f"""WITH {PX_RGB}, {_REFL}, lu AS (SELECT img, i, j, {_LUMA('g')} AS lg, {_LUMA('p')} AS lp FROM px),
    ed AS (SELECT nb.img, nb.i, nb.j, {_GRAD('lg', (1, 2))} > 0.1 AS g, {_GRAD('lp', (1, 2))} > 0.1 AS p FROM nb JOIN lu ON lu.img = nb.img AND lu.i = ni AND lu.j = nj GROUP BY ALL), {_SCORE}""")
def rgb_edge_f1(spark, d):
    return rounded(images.rgb_edge_f1(fx.rgb_pairs(spark, d)))


@query(f"""WITH {PX_RGB}, {_REFL}, lu AS (SELECT img, i, j, {_LUMA('g')} AS lg, {_LUMA('p')} AS lp FROM px),
    gr AS (SELECT nb.img, nb.i, nb.j, ({_GRAD('lg', (3, 10))}/16 + {_GRAD('lp', (3, 10))}/16)/2 AS w FROM nb JOIN lu ON lu.img = nb.img AND lu.i = ni AND lu.j = nj GROUP BY ALL),
    ce AS (SELECT img, i, j, ({" + ".join(f"abs(g{c}/(gr+gg+gb+1e-6) - p{c}/(pr+pg+pb+1e-6))" for c in "rgb")})/3 AS e FROM px)
    SELECT img, round(CASE WHEN avg(w) < 1e-6 THEN 0 ELSE avg(w*e)/(avg(w)+1e-6) END, 6) AS sce FROM gr JOIN ce USING (img, i, j) GROUP BY img""")
def chroma_error(spark, d):
    return rounded(images.chroma_error(fx.rgb_pairs(spark, d)))


def _gauss(cols: str, table: str, sums: list[tuple[str, str]]) -> str:
    """Separable Gaussian of expressions over a table (img, i, j) with repeated borders, as CTEs ending in gs."""
    idx = "CASE WHEN {0} < 0 THEN -1-({0}) WHEN {0} > 7 THEN 15-({0}) ELSE {0} END"
    return f"""kn AS (SELECT d, exp(-0.5::DOUBLE*d*d/((11.0::DOUBLE/6)*(11.0::DOUBLE/6))) / sum(exp(-0.5::DOUBLE*d*d/((11.0::DOUBLE/6)*(11.0::DOUBLE/6)))) OVER () AS w FROM (SELECT unnest(range(-5, 6)) AS d)),
    ix AS (SELECT CAST(t AS INTEGER) AS t, CAST({idx.format('(t+d)')} AS INTEGER) AS s, sum(w) AS w FROM range(8) r(t), kn GROUP BY ALL),
    g1 AS (SELECT img, t AS i, j, {", ".join(f"sum(w*({x})) AS {n}" for n, x in sums)} FROM {table} JOIN ix ON s = i GROUP BY ALL),
    gs AS (SELECT img, i, t AS j, {", ".join(f"sum(w*{n}) AS {n}" for n, _ in sums)} FROM g1 JOIN ix ON s = j GROUP BY ALL)"""


_SSIM = "(2*mx*my+0.0001::DOUBLE)*(2*(xy-mx*my)+0.0009::DOUBLE)/((mx*mx+my*my+0.0001::DOUBLE)*(xx-mx*mx+yy-my*my+0.0009::DOUBLE))"
_FIVE = lambda x, y: [("mx", x), ("my", y), ("xx", f"{x}*{x}"), ("yy", f"{y}*{y}"), ("xy", f"{x}*{y}")]


@query(f"""WITH {PX_DEPTH}, lim AS (SELECT img, min(least(gt, pred)) AS lo, max(greatest(gt, pred)) AS hi FROM px WHERE {OK} GROUP BY img),
    no AS (SELECT img, i, j, CASE WHEN {OK} THEN (pred-lo)/(hi-lo) ELSE 0 END AS x, CASE WHEN {OK} THEN (gt-lo)/(hi-lo) ELSE 0 END AS y, CASE WHEN {OK} THEN 1.0::DOUBLE ELSE 0 END AS v FROM px JOIN lim USING (img)),
    {_gauss("", "no", _FIVE("x", "y") + [("v", "v")])} SELECT img, round(avg({_SSIM}), 6) AS ssim FROM gs WHERE v > 0.5 GROUP BY img""")
def depth_ssim(spark, d):
    return rounded(images.depth_ssim(fx.depth_pairs(spark, d)))


@query(f"""WITH {PX_RGB}, ch AS ({" UNION ALL ".join(f"SELECT img * 3 + {k} AS img, i, j, p{c} AS x, g{c} AS y FROM px" for k, c in enumerate("rgb"))}),
    {_gauss("", "ch", _FIVE("x", "y"))} SELECT img // 3 AS img, round(avg({_SSIM}), 6) AS ssim FROM gs GROUP BY img // 3""")
def rgb_ssim(spark, d):
    return rounded(images.rgb_ssim(fx.rgb_pairs(spark, d)))


# --- spectra ---------------------------------------------------------------------------------------------------------

_DFT = f"""lu AS (SELECT img, i, j, {_LUMA('g')} AS lg, {_LUMA('p')} AS lp FROM px),
    f1 AS (SELECT img, CAST(u AS INTEGER) AS u, j, sum(lg*cos(2*pi()*u*i/8)) AS gc, sum(lg*sin(2*pi()*u*i/8)) AS gs, sum(lp*cos(2*pi()*u*i/8)) AS pc, sum(lp*sin(2*pi()*u*i/8)) AS ps FROM lu, range(8) r(u) GROUP BY ALL),
    f2 AS (SELECT img, u, CAST(v AS INTEGER) AS v, {", ".join(f"pow(sum({s}c*cos(2*pi()*v*j/8) - {s}s*sin(2*pi()*v*j/8)), 2) + pow(sum({s}c*sin(2*pi()*v*j/8) + {s}s*cos(2*pi()*v*j/8)), 2) AS {s}e" for s in "gp")} FROM f1, range(8) r(v) GROUP BY ALL),
    po AS (SELECT img, ge, pe, sqrt(pow((u+4)%8-4, 2) + pow((v+4)%8-4, 2))/sqrt(32.0::DOUBLE) AS r FROM f2)"""


@query(f"""WITH {PX_RGB}, {_DFT}, hr AS (SELECT img, sum(ge) FILTER (r > 0.75)/sum(ge) AS g, sum(pe) FILTER (r > 0.75)/sum(pe) AS p FROM po GROUP BY img)
    SELECT img, round(g, 6) AS gt_hf_ratio, round(p, 6) AS pred_hf_ratio, round((p-g)/g, 6) + 0.0::DOUBLE AS relative_diff, round(least(p/g, 1), 6) AS preservation FROM hr""")
def hf_energy(spark, d):
    return rounded(images.hf_energy(fx.rgb_pairs(spark, d)))


@query(f"""WITH {PX_RGB}, {_DFT}, ba AS (SELECT img, CAST(floor(r*4) AS INTEGER) AS band, sum(pe)/sum(ge) AS q FROM po WHERE r < 1 GROUP BY ALL)
    SELECT img, band, round(1 - least(abs(q-1), 1), 6) AS similarity FROM ba""")
def band_similarity(spark, d):
    b = images.band_similarity(fx.rgb_pairs(spark, d)).select("img", F.posexplode("bands").alias("band", "similarity"))
    return rounded(b)


# --- rays ------------------------------------------------------------------------------------------------------------


def _errors(spark, d) -> DataFrame:
    return rays.angular_errors(fx.ray_pixels(spark, d))


@query(f"WITH {PX_RAYS} SELECT round(avg(angle), 6) AS mean_angle, {', '.join(f'round(avg(CASE WHEN angle < {x} THEN 1.0::DOUBLE ELSE 0 END)*100, 6) AS percent_below_{x}' for x in (5, 10, 15, 20, 30))} FROM er")
def angular_error(spark, d):
    return rounded(rays.angular_summary(_errors(spark, d)))


@query(f"""WITH {PX_RAYS}, cu AS (SELECT img, t, avg(CASE WHEN angle <= t*0.2::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS y FROM er, range(101) g(t) GROUP BY ALL),
    ra AS (SELECT img, sum(CASE WHEN t IN (0, 100) THEN y/2 ELSE y END)/100 AS rho_a FROM cu GROUP BY img),
    st AS (SELECT img, avg(angle) AS mean_angle, quantile_cont(angle, 0.5) AS median_angle FROM er GROUP BY img)
    SELECT img, round(mean_angle, 6) AS mean_angle, round(median_angle, 6) AS median_angle, round(rho_a, 6) AS rho_a FROM st JOIN ra USING (img)""")
def rho_a(spark, d):
    return rounded(rays.per_image(_errors(spark, d), rays.domain_threshold("lfov")))


@query(f"WITH {PX_RAYS}, h AS (SELECT least(17999, floor(angle/180*18000)) AS b, count(*) AS n FROM er GROUP BY ALL), c AS (SELECT b, sum(n) OVER (ORDER BY b) AS cum, sum(n) OVER () AS total FROM h) SELECT round((min(b)+0.5)*180/18000, 6) AS median_angle FROM c WHERE cum >= total/2")
def histogram_median(spark, d):
    return rounded(reduce.histogram_median(_errors(spark, d), "angle"))


@query("""SELECT p_partkey, CASE WHEN fov <= 90 THEN 'sfov' WHEN fov >= 160 THEN 'pano' ELSE 'lfov' END AS domain FROM (SELECT p_partkey, degrees(2*atan(sqrt(pow(640/(2.0::DOUBLE*f), 2) + pow(480/(2.0::DOUBLE*f), 2)))) AS fov FROM (SELECT p_partkey, 20.0::DOUBLE + 13*p_size AS f FROM part))""")
def fov_domain(spark, d):
    f = F.lit(20.0) + 13 * F.col("p_size")
    return fx.table(spark, d, "part").select("p_partkey", rays.fov_domain(F.lit(480), F.lit(640), f, f).alias("domain"))


# --- distributions ---------------------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'gt' ELSE 'pred' END AS set, embedding FROM embeddings), p AS (SELECT set, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, embedding[a+1]::DOUBLE AS x, embedding[b+1]::DOUBLE AS y FROM v, range(64) q(a), range(64) r(b) WHERE a <= b)
    SELECT set, a, b, round(avg(x), 6) + 0.0::DOUBLE AS mean_a, round(avg(y), 6) + 0.0::DOUBLE AS mean_b, round(covar_samp(x, y), 6) + 0.0::DOUBLE AS cov FROM p GROUP BY ALL""")
def fid_moments(spark, d):
    return rounded(distribution.covariance(fx.features(spark, d)))


@query()
def fid(spark, d):
    return rounded(distribution.fid(fx.features(spark, d)))


@query("""WITH v AS (SELECT vec_id AS id, vec_id % 2 AS s, embedding::DOUBLE[64] AS x FROM embeddings), k AS (SELECT a.s AS s, b.s AS t, pow(array_inner_product(a.x, b.x)/64 + 1, 3) AS k FROM v a JOIN v b ON a.id <> b.id)
    SELECT round(avg(k) FILTER (s = 0 AND t = 0) + avg(k) FILTER (s = 1 AND t = 1) - 2*avg(k) FILTER (s = 0 AND t = 1), 6) + 0.0::DOUBLE AS kid_mean FROM k""")
def kid_full_set(spark, d):
    return rounded(distribution.kid_full(fx.features(spark, d)))


@query(ORACLES["kid_full_set"].replace("AS kid_mean FROM k", "AS kid_mean, 0.0::DOUBLE AS kid_std FROM k"))
def kid_subsets(spark, d):
    """A hundred subsets of up to a thousand; sets of no more are taken whole, in which case the twin has the same."""
    return rounded(distribution.kid_subsets(fx.features(spark, d)))


# --- aggregates and variants -------------------------------------------------------------------------------------------


@query(_standard(PX_DEPTH).replace(OK, "gt > 8 AND pred > 8"))
def standard_min_depth(spark, d):
    """The standard metrics over pixels beyond a least depth."""
    return rounded(reduce.standard_reducers(reduce.pixel_stats(_depth(spark, d), ["img"], masks.valid(least=8.0))))


@query(f"WITH {PX_DEPTH}, st AS (SELECT img, {_SUMS} FROM px GROUP BY img), m AS (SELECT img, {_TEN} FROM st) SELECT " + ", ".join(f"round({f}, 6) AS {c}_{n}" for c in ("absrel", "rmse") for n, f in (("mean", f"avg({c})"), ("median", f"quantile_cont({c}, 0.5)"), ("std", f"stddev_pop({c})"))) + " FROM m")
def image_reducers(spark, d):
    """Mean, median and population deviation over images."""
    stats = reduce.pixel_stats(_depth(spark, d), ["img"])
    return rounded(reduce.image_reduce(stats.select("img", *[c.alias(m) for m, c in reduce.standard_columns().items()]), ["absrel", "rmse"]))


@query(f"WITH {PX_RGB}, s AS (SELECT img, avg(CASE WHEN img % 3 = 0 THEN 0 ELSE {_SQ} END) AS mse FROM px GROUP BY img) SELECT round(avg(10*log10(1/mse)) FILTER (mse >= 1e-10), 6) AS psnr, count(*) AS images FROM s")
def finite_mean(spark, d):
    """Every third image is perfect: its infinite PSNR doesn't count."""
    s = _rgb(spark, d).groupBy("img").agg(F.avg(F.when(F.col("img") % 3 == 0, 0.0).otherwise(_sq())).alias("mse"))
    s = s.withColumn("psnr", F.when(F.col("mse") < 1e-10, float("inf")).otherwise(10 * F.log10(1 / F.col("mse"))))
    return rounded(s.agg(F.avg(masks.only_finite("psnr")).alias("psnr"), F.count(F.lit(1)).alias("images")))


@query(f"{_NORMALS} SELECT count(*) AS n, round(avg(angle), 5) AS mean_angle, round(quantile_cont(angle, 0.5), 5) AS median_angle, round(avg(cos(radians(angle))), 6) AS consistency FROM an")
def normal_pool(spark, d):
    """Normals over all pixels of all images."""
    a = images.normal_angles(fx.depth_pairs(spark, d))
    one = a.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("angle"), 5).alias("mean_angle"), F.round(F.avg(F.cos(F.radians("angle"))), 6).alias("consistency"))
    return one.crossJoin(reduce.exact_quantiles(a, "angle", [0.5]).select(F.round("value", 5).alias("median_angle")))


_IN_BIN = f"gt BETWEEN 8 AND 12 AND pred > 0 AND (bin = 'all' OR bin = CASE WHEN gt < {_A!r}::DOUBLE THEN 'near' WHEN gt < {_B!r}::DOUBLE THEN 'mid' ELSE 'far' END)"


@query(f"""WITH {PX_DEPTH}, pb AS (SELECT px.*, bin FROM px, (VALUES ('all'), ('near'), ('mid'), ('far')) b(bin) WHERE {_IN_BIN}),
    sb AS (SELECT a.img, a.bin, a.i, a.j, count(*) AS n, {_SX('b.gt', 'TRUE')} AS gx, {_SY('b.gt', 'TRUE')} AS gy, {_SX('b.pred', 'TRUE')} AS px_, {_SY('b.pred', 'TRUE')} AS py_ FROM pb a JOIN pb b ON a.img = b.img AND a.bin = b.bin AND abs(a.i-b.i) <= 1 AND abs(a.j-b.j) <= 1 GROUP BY ALL),
    an AS (SELECT bin, degrees(acos(greatest(-1, least(1, (gx*px_ + gy*py_ + 1)/(sqrt(gx*gx+gy*gy+1)*sqrt(px_*px_+py_*py_+1)))))) AS angle FROM sb WHERE n = 9)
    SELECT bin, count(*) AS n, round(avg(angle), 5) AS mean_angle FROM an GROUP BY bin""")
def normal_bins(spark, d):
    """Normals in each benchmark bin, whose mask is eroded by itself."""
    a = images.normal_angles(fx.depth_pairs(spark, d), (8, 12))
    return a.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("angle"), 5).alias("mean_angle"))


@query(f"""WITH {PX_RGB}, e AS (SELECT img, {_ABS} AS a, {_SQ} AS s, CASE WHEN i > 0 AND depth BETWEEN 1 AND 9 THEN CASE WHEN depth < 25.0::DOUBLE/9 THEN 'near' WHEN depth < 49.0::DOUBLE/9 THEN 'mid' ELSE 'far' END END AS b FROM px),
    m AS (SELECT img, bin, coalesce(avg(a) FILTER (b IS NOT NULL AND (bin = 'all' OR b = bin)), 0) AS mae, coalesce(avg(s) FILTER (b IS NOT NULL AND (bin = 'all' OR b = bin)), 0) AS mse FROM e, (VALUES ('all'), ('near'), ('mid'), ('far')) t(bin) GROUP BY ALL)
    SELECT bin, round(avg(mae), 6) AS mae, round(avg(mse), 6) AS mse FROM m GROUP BY bin""")
def benchmark_rgb_bins(spark, d):
    """Means over images without the sky, here their top row; an empty bin counts as 0."""
    from mapgauge.plans.evaluate import benchmark_rgb

    px = _rgb(spark, d).withColumns({"ae": _abs(), "se": _sq(), "sky": F.col("i") == 0})
    return rounded(benchmark_rgb(px, (1, 9), "sky"))


@query(f"""WITH {PX_RGB}, {_DFT}, hr AS (SELECT img, sum(ge) FILTER (r > 0.75)/sum(ge) AS g, sum(pe) FILTER (r > 0.75)/sum(pe) AS p FROM po GROUP BY img)
    SELECT round(avg(g), 6) AS gt_hf_ratio, round(avg(p), 6) AS pred_hf_ratio, round(avg((p-g)/g), 6) + 0.0::DOUBLE AS relative_diff, round(stddev_pop((p-g)/g), 6) AS relative_diff_std FROM hr""")
def hf_aggregate(spark, d):
    per = images.hf_energy(fx.rgb_pairs(spark, d))
    return rounded(per.agg(*[F.avg(masks.only_finite(c)).alias(c) for c in ("gt_hf_ratio", "pred_hf_ratio", "relative_diff")], F.stddev_pop(masks.only_finite("relative_diff")).alias("relative_diff_std")))


@query(f"WITH {PX_DEPTH}, {_EDGES.replace('0.1::DOUBLE * gt', '1.5::DOUBLE').replace('0.1::DOUBLE * pred', '1.5::DOUBLE')}, {_SCORE}")
def depth_edge_f1_absolute(spark, d):
    return rounded(images.depth_edge_f1(fx.depth_pairs(spark, d), 1.5, "absolute"))


@query(f"""WITH {PX_DEPTH}, {_REFL}, ed AS (SELECT nb.img, nb.i, nb.j, {_GRAD('z.gt', (1, 2))} > 8 AND any_value(c.gt) > 0 AND any_value(c.pred) > 0 AS g, {_GRAD('z.pred', (1, 2))} > 8 AND any_value(c.gt) > 0 AND any_value(c.pred) > 0 AS p
    FROM nb JOIN px z ON z.img = nb.img AND z.i = ni AND z.j = nj JOIN px c ON c.img = nb.img AND c.i = nb.i AND c.j = nb.j GROUP BY ALL), {_SCORE}""")
def depth_edge_f1_sobel(spark, d):
    return rounded(images.depth_edge_f1(fx.depth_pairs(spark, d), 8.0, "sobel"))


@query(f"""WITH {PX_RGB}, pos AS (SELECT CAST(t AS INTEGER) AS t, least(greatest((t + 0.5::DOUBLE) * 8 / 12 - 0.5::DOUBLE, 0), 7) AS x FROM range(12) r(t)), w AS (SELECT t, CAST(s AS INTEGER) AS s, greatest(1 - abs(x - s), 0) AS w FROM pos, range(8) q(s) WHERE abs(x - s) < 1)
    SELECT img, a.t AS i, b.t AS j, round(sum(gr*a.w*b.w), 6) AS gr FROM px JOIN w a ON a.s = i JOIN w b ON b.s = j GROUP BY ALL""")
def resize_linear(spark, d):
    return rounded(align.resize_linear(_rgb(spark, d).select("img", "i", "j", "gr"), (8, 8), (12, 12), "gr"))


@query(f"WITH {PX_DEPTH}, r AS (SELECT img, min(gt) FILTER ({OK}) AS lo, max(gt) FILTER ({OK}) AS hi FROM px GROUP BY img) SELECT img, i, j, round(CASE WHEN hi - lo < 1e-8 THEN 0 ELSE greatest(0, least(1, (gt - lo)/(hi - lo))) END, 6) + 0.0::DOUBLE AS gt FROM px JOIN r USING (img)")
def normalised_display(spark, d):
    return rounded(align.normalise(_depth(spark, d), "gt", masks.valid()).select("img", "i", "j", "gt"))


@query(f"""WITH {_FR}, k AS (SELECT [r_name] AS h, 'b' AS f, 1.0::DOUBLE AS fx FROM region UNION ALL SELECT [r_name], 'a', 2.0 FROM region UNION ALL SELECT [r_name, n_name], 'z', 3.0::DOUBLE + n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0)
    SELECT hierarchy, file_id, coalesce((SELECT min(fx) FROM k WHERE h = hierarchy[1:2]), (SELECT arg_min(fx, f) FROM k WHERE h = hierarchy[1:1])) AS fx FROM fr""")
def deepest_entry_wins(spark, d):
    """Calibration a region, twice, and for every other nation: the deepest wins, of one level the smallest file id."""
    n = fx.table(spark, d, "nation").join(fx.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    deep = n.where("n_nationkey % 2 = 0").select(F.array("r_name", "n_name").alias("hierarchy"), F.lit("z").alias("file_id"), (F.lit(3.0) + F.col("n_nationkey")).alias("fx"))
    flat = fx.table(spark, d, "region").select(F.array("r_name").alias("hierarchy"), F.explode(F.array(*[F.struct(F.lit(f).alias("file_id"), F.lit(v).alias("fx")) for f, v in (("b", 1.0), ("a", 2.0))])).alias("e")).select("hierarchy", "e.*")
    return match.attach_ancestor(fx.frame_table(spark, d, "gt").select("hierarchy", "file_id"), flat.unionByName(deep), ["fx"])


@query(f"WITH {_FR} SELECT hierarchy, file_id, value FROM fr WHERE o_orderstatus = 'F'")
def split_selection(spark, d):
    from mapgauge.sources.manifests import split_of

    status = fx.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("file_id"), F.col("o_orderstatus").alias("split"))
    return split_of(fx.frame_table(spark, d, "gt").join(status, "file_id"), "F").select("hierarchy", "file_id", "value")


@query(f"WITH {_FR} SELECT hierarchy, file_id, value FROM fr WHERE file_id = (SELECT CAST(min(o_orderkey) AS VARCHAR) FROM orders)")
def retrieve_one(spark, d):
    frames = fx.frame_table(spark, d, "gt")
    key = str(fx.table(spark, d, "orders").agg(F.min("o_orderkey")).first()[0])
    found = frames.where(F.col("file_id") == key).select("hierarchy").first()
    return match.retrieve(frames, list(found[0]), key).select("hierarchy", "file_id", "value")


# --- rules and publication -------------------------------------------------------------------------------------------


def _facts(spark, d) -> DataFrame:
    px = reduce.depth_errors(_depth(spark, d))
    return px.groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.max("gt").alias("depth_max"), F.min("gt").alias("depth_min"), (F.max("gt") - F.min("gt")).alias("depth_range"), F.percentile("absrel", 0.5).alias("absrel_median"), F.percentile("absrel", 0.9).alias("absrel_p90"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"))


def _rule_table(modality: str) -> tuple[dict[str, str], str]:
    """A column for each that the modality's rules look at, made from the part table so that some rows break each rule, and
    the rules as SQL."""
    own = [r for r in rules.RULES if r.modality == modality]
    columns: dict[str, str] = {}
    for r in own:
        for c in filter(None, (r.column, r.against)):
            spread = f"CAST(p_partkey * {7 + 2 * len(columns)} % 101 AS DOUBLE) / CAST(101 AS DOUBLE)"
            low = f" - CAST({abs(r.limit) * 2!r} AS DOUBLE)" if r.limit <= 0 else ""
            columns.setdefault(c, f"{spread} * CAST({abs(r.limit) * 2 + 0.05!r} AS DOUBLE){low}")
    cell = lambda r: f"SELECT '{r.metric}' AS metric, '{r.kind}' AS type, img, {r.column} AS o FROM f WHERE {r.column} {r.op} {r.limit!r}::DOUBLE" + (f" * {r.against}" if r.against else "")
    made = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    sql = f"""WITH f AS (SELECT p_partkey AS img, {made} FROM part), w AS ({" UNION ALL ".join(cell(r) for r in own)})
    SELECT metric, type, count(*) AS count, list_transform(list(o ORDER BY img)[1:5], lambda x: round(x, 6)) AS samples FROM w GROUP BY ALL"""
    return columns, sql


def _rule_report(spark, d, modality: str) -> DataFrame:
    facts = fx.table(spark, d, "part").selectExpr("p_partkey AS img", *[f"{e} AS {c}" for c, e in _rule_table(modality)[0].items()])
    r = rules.report(rules.warnings(facts, modality))
    return r.select("metric", "type", "count", F.transform("samples", lambda x: F.round(x, 6)).alias("samples"))


@query(_rule_table("depth")[1])
def rules_depth(spark, d):
    return _rule_report(spark, d, "depth")


@query(_rule_table("rgb")[1])
def rules_rgb(spark, d):
    return _rule_report(spark, d, "rgb")


@query(_rule_table("rays")[1])
def rules_rays(spark, d):
    return _rule_report(spark, d, "rays")


#: Limits at which the derived images do warn.
STRICT = {"depth_input:max_exceeded": 11.5, "absrel:median_too_high": 0.02, "rmse:rmse_too_high": 0.08, "ssim:depth_range_too_small": 1.8}


@query(f"""WITH {PX_DEPTH}, f AS (SELECT img, count(*) AS n, max(gt) AS mx, max(gt)-min(gt) AS rg, quantile_cont(abs(pred-gt)/gt, 0.5) AS am, sqrt(avg((pred-gt)*(pred-gt))) AS rm FROM px WHERE {OK} GROUP BY img),
    w AS (SELECT 'depth_input' AS metric, 'max_exceeded' AS type, img, mx AS o FROM f WHERE mx > 11.5 UNION ALL SELECT 'absrel', 'median_too_high', img, am FROM f WHERE am > 0.02 UNION ALL SELECT 'rmse', 'rmse_too_high', img, rm FROM f WHERE rm > 0.08::DOUBLE*rg UNION ALL SELECT 'ssim', 'depth_range_too_small', img, rg FROM f WHERE rg < 1.8)
    SELECT metric, type, count(*) AS count, list_transform(list(o ORDER BY img)[1:5], lambda x: round(x, 6)) AS samples FROM w GROUP BY ALL""")
def sanity_report(spark, d):
    r = rules.report(rules.warnings(_facts(spark, d), "depth", rules=rules.configured(STRICT)))
    return r.select("metric", "type", "count", F.transform("samples", lambda x: F.round(x, 6)).alias("samples"))


@query(f"""SELECT 'depth' AS modality, 'metric' AS space, 'standard' AS category, reduction, 'all' AS bin, metric, value FROM (UNPIVOT ({_standard(PX_DEPTH)}) ON {", ".join(_M)} INTO NAME metric VALUE value)""")
def metric_long_table(spark, d):
    r = standard_reducers(spark, d)
    long = r.unpivot(["reduction"], list(_M), "metric", "value")
    return long.select(F.lit("depth").alias("modality"), F.lit("metric").alias("space"), F.lit("standard").alias("category"), "reduction", F.lit("all").alias("bin"), "metric", "value")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(sqrt(greatest(avg(value*value) - avg(value)*avg(value), 0)), 5) AS std FROM events GROUP BY event_type")
def incremental_pool(spark, d):
    """The streaming evaluator over the events table, run to its end."""
    from mapgauge.streaming.incremental import pool_stream

    return pool_stream(spark, f"{d}/events.parquet", "event_type", "value")
