"""Depth metrics from sufficient statistics, and the reducers over images and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapgauge.functions.masks import only_finite, valid

STANDARD = ("absrel", "sqrel", "mae", "rmse", "rmse_log", "log10", "silog", "delta1", "delta2", "delta3")
_STATS = ("n", "s_absrel", "s_sqrel", "s_abs", "s_sq", "s_dd", "s_log10", "s_d", "c1", "c2", "c3")


def pixel_stats(px: DataFrame, keys: list[str], mask: Column | None = None) -> DataFrame:
    """One row a key with the sums that all standard metrics need; map-side partial sums, so a row a key is shuffled."""
    g, p = F.col("gt"), F.col("pred")
    ok = valid() if mask is None else mask
    rows = px.withColumn("ok", ok).withColumn("d", F.when(F.col("ok"), F.ln(p) - F.ln(g)))
    if_ok = lambda e: F.sum(F.when(F.col("ok"), e))
    ratio = F.greatest(p / g, g / p)
    return rows.groupBy(*keys).agg(
        F.count(F.when(F.col("ok"), 1)).alias("n"),
        if_ok(F.abs(p - g) / g).alias("s_absrel"), if_ok((p - g) * (p - g) / g).alias("s_sqrel"), if_ok(F.abs(p - g)).alias("s_abs"), if_ok((p - g) * (p - g)).alias("s_sq"),
        F.sum(F.col("d") * F.col("d")).alias("s_dd"), if_ok(F.abs(F.log10(p) - F.log10(g))).alias("s_log10"), F.sum("d").alias("s_d"),
        *[F.count(F.when(F.col("ok"), F.when(ratio < 1.25**k, 1))).alias(f"c{k}") for k in (1, 2, 3)],
    )


def standard_columns() -> dict[str, Column]:
    """The ten standard metrics from pixel_stats; null where no pixel is valid."""
    n = F.when(F.col("n") > 0, F.col("n").cast("double"))
    mean = lambda c: F.col(c) / n
    return {
        "absrel": mean("s_absrel"), "sqrel": mean("s_sqrel"), "mae": mean("s_abs"), "rmse": F.sqrt(mean("s_sq")), "rmse_log": F.sqrt(mean("s_dd")), "log10": mean("s_log10"),
        "silog": F.when(F.col("n") > 0, F.sqrt(F.greatest(mean("s_dd") - mean("s_d") * mean("s_d"), F.lit(0.0)))), "delta1": mean("c1"), "delta2": mean("c2"), "delta3": mean("c3"),
    }


#: Images whose values one task may sort for a median.
MANY = 1_000_000


def medians(per: DataFrame, columns: list[str], many: bool = False) -> DataFrame:
    """One row with the median of each column's finite values; with many rows they are counted in bins and not gathered."""
    if not many:
        return per.agg(*[F.percentile(only_finite(c), 0.5).alias(c) for c in columns])
    found = pooled_quantiles(per, {c: F.col(c) for c in columns}, [0.5])
    return found.agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in columns])


def standard_reducers(stats: DataFrame, many: bool = False) -> DataFrame:
    """reduction (image_mean, image_median, pixel_pool) and the ten metrics, from a row an image: images without valid pixels
    and non-finite values don't count, the pool is made of the summed statistics. One pass, unless there are many images."""
    per = stats.withColumns({m: only_finite(c) for m, c in standard_columns().items()})
    mean = F.struct(F.lit("image_mean").alias("reduction"), *[F.avg(m).alias(m) for m in STANDARD])
    median = F.struct(F.lit("image_median").alias("reduction"), *[F.percentile(m, 0.5).alias(m) for m in STANDARD])
    one = per.agg(mean.alias("mean"), *([] if many else [median.alias("median")]), *[F.sum(c).alias(c) for c in _STATS])
    pool = F.struct(F.lit("pixel_pool").alias("reduction"), *[c.alias(m) for m, c in standard_columns().items()])
    out = one.select(F.explode(F.array("mean", *([] if many else ["median"]), pool)).alias("r")).select("r.*")
    if many:
        out = out.unionByName(medians(per, list(STANDARD), True).withColumn("reduction", F.lit("image_median")))
    return out


def depth_errors(px: DataFrame, mask: Column | None = None) -> DataFrame:
    """absrel, err (absolute) and logerr of each valid pixel."""
    g, p = F.col("gt"), F.col("pred")
    rows = px.where(valid() if mask is None else mask)
    return rows.withColumns({"absrel": F.abs(p - g) / g, "err": F.abs(p - g), "logerr": F.abs(F.ln(p) - F.ln(g))})


#: Bins that a range of values is cut into, and values that one sorted window may hold.
BINS, FEW = 4096, 100_000


def pooled_quantiles(rows: DataFrame, values: dict[str, Column], shares: list[float]) -> DataFrame:
    """name, share, value: exact quantiles with linear interpolation of several values over one pool of any size.

    All values are counted together, in BINS equal bins of their range; a bin that holds a wanted rank is cut again, from
    its least to its largest value, until it holds one value only, however often, or FEW rows, which are sorted. So the pool
    is read a few times and never moved: map-side sums leave BINS rows a task and value. Nulls and non-finite values don't
    count; an empty pool gives null values.
    """
    spark = rows.sparkSession
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), only_finite(c).cast("double").alias("v")) for n, c in values.items()]))
    pool = rows.select(cells.alias("c")).select("c.*").where("v IS NOT NULL")
    total = {r["name"]: r for r in pool.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    # an open range: name, number, lo, hi, rows before it, rows, the ranks (from 0) wanted in it
    todo, known = [], {}
    for k, (name, r) in enumerate(sorted(total.items())):
        ranks = {x for q in shares for at in [q * (r["n"] - 1)] for x in ([int(at)] if at == int(at) else [int(at), int(at) + 1])}
        todo.append((name, k, r["lo"], r["hi"], 0, r["n"], ranks))
    while todo:
        for name, _, lo, hi, _, _, ranks in todo:
            if lo == hi:
                known.update({(name, x): lo for x in ranks})
        todo = [t for t in todo if t[2] < t[3]]
        if not todo:
            break
        ranges = F.broadcast(spark.createDataFrame([t[:4] for t in todo], "name string, range long, lo double, hi double"))
        inside = pool.join(ranges, "name").where("v BETWEEN lo AND hi")
        if all(t[5] <= FEW for t in todo):
            wanted = F.broadcast(spark.createDataFrame([(t[1], x, x - t[4] + 1) for t in todo for x in sorted(t[6])], "range long, rank long, rn int"))
            order = inside.withColumn("rn", F.row_number().over(Window.partitionBy("range").orderBy("v")))
            known.update({(r["name"], r["rank"]): r["v"] for r in order.join(wanted, ["range", "rn"]).select("name", "rank", "v").collect()})
            break
        # halves first: the difference of two finite doubles may not be finite
        at = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS), F.lit(BINS - 1))
        found = inside.groupBy("name", "range", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        nxt = []
        for name, k, _, _, before, _, ranks in todo:
            for r in sorted((r for r in found if r["range"] == k), key=lambda r: r["bin"]):
                here = {x for x in ranks if before <= x < before + r["n"]}
                if here:
                    nxt.append((name, len(nxt), r["lo"], r["hi"], before, r["n"], here))
                before += r["n"]
        todo = nxt
    out = []
    for name in values:
        for q in shares:
            value = None
            if name in total:
                at = q * (total[name]["n"] - 1)
                value = known[name, int(at)] + ((at - int(at)) * (known[name, int(at) + 1] - known[name, int(at)]) if at > int(at) else 0.0)
            out.append((name, float(q), value))
    return spark.createDataFrame(out, "name string, share double, value double")


def exact_quantiles(rows: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """share, value: exact pooled quantiles of one column."""
    return pooled_quantiles(rows, {column: F.col(column)}, shares).drop("name")


def array_quantile(values: Column, share: float) -> Column:
    """The quantile of an array's finite elements with linear interpolation, in place: no shuffle of an image's pixels."""
    ordered = F.array_sort(F.filter(values, lambda v: only_finite(v).isNotNull()))
    # bound once: sorted again for each use otherwise
    at = lambda a: F.lit(share) * (F.size(a) - 1)
    low = lambda a: F.get(a, F.floor(at(a)).cast("int"))
    pick = lambda a: low(a) + (at(a) - F.floor(at(a))) * (F.get(a, F.ceil(at(a)).cast("int")) - low(a))
    return F.get(F.transform(F.array(ordered), lambda a: F.when(F.size(a) > 0, pick(a))), 0)


def below_shares(rows: DataFrame, column: str, limits: list[float]) -> DataFrame:
    """percent_below_<limit> for each limit, strictly below."""
    name = lambda x: f"percent_below_{x:g}".replace(".", "_")
    return rows.agg(*[(F.avg(F.when(F.col(column) < x, 1.0).otherwise(0.0)) * 100).alias(name(x)) for x in limits])


def histogram_median(rows: DataFrame, column: str, bins: int = 18_000, high: float = 180.0) -> DataFrame:
    """median_angle: centre of the first of `bins` equal bins at which half of the values are reached. The histogram has a
    bounded number of rows, whatever the pool."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(column) / high * bins))).cast("int")
    hist = rows.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    run = hist.withColumns({"cum": F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(Window.partitionBy())})
    return run.where(F.col("cum") >= F.col("total") / 2).agg(((F.min("bin") + 0.5) * high / bins).alias("median_angle"))


def image_reduce(per_image: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, median and population standard deviation of the finite values of each column."""
    return per_image.agg(*[f(only_finite(c)).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("median", lambda x: F.percentile(x, 0.5)), ("std", F.stddev_pop))])


def binned_stats(px: DataFrame, bin_: Column, keys: list[str]) -> DataFrame:
    """pixel_stats for each bin and for all binned pixels together ('all'): a roll-up, the pixels are read once."""
    rows = px.withColumn("bin", bin_).where("bin IS NOT NULL")
    per = pixel_stats(rows, [*keys, "bin"])
    every = per.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _STATS]).withColumn("bin", F.lit("all"))
    return per.unionByName(every)
