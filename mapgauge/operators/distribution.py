"""Distances between feature distributions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(features: DataFrame) -> DataFrame:
    """set, a, n, sums, products: for each feature column a its sums of products with all columns, and all columns' sums.
    Gram matrices of Arrow batches are added up in each task, so a task leaves d rows of d numbers, whatever the number of
    vectors."""

    def grams(batches):
        import pyarrow as pa

        total = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for s in set(names.tolist()):
                part = batch.column(1).filter(pa.array(names == s))
                x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1).astype(float)
                n, t, g = total.get(s, (0, 0.0, 0.0))
                total[s] = n + len(x), t + x.sum(axis=0), g + x.T @ x
        for s, (n, t, g) in total.items():
            d = len(t)
            yield pa.RecordBatch.from_arrays([pa.array([s] * d), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([t] * d, pa.list_(pa.float64())), pa.array(list(g), pa.list_(pa.float64()))], names=["set", "a", "n", "sums", "products"])

    def added(pdf):
        import pandas as pd

        return pd.DataFrame({"set": [pdf["set"].iloc[0]], "a": [pdf["a"].iloc[0]], "n": [pdf["n"].sum()], "sums": [np.sum(np.stack(pdf["sums"].to_list()), axis=0)], "products": [np.sum(np.stack(pdf["products"].to_list()), axis=0)]})

    schema = "set string, a int, n long, sums array<double>, products array<double>"
    return features.select("set", F.col("x").cast("array<double>").alias("x")).mapInArrow(grams, schema).groupBy("set", "a").applyInPandas(added, schema)


def covariance(features: DataFrame) -> DataFrame:
    """set, a, b, mean_a, mean_b, cov (sample), for a <= b."""
    n = F.col("n").cast("double")
    m = moments(features).select("set", "a", "n", F.get("sums", F.col("a")).alias("sum_a"), F.posexplode(F.arrays_zip("sums", "products")).alias("b", "z")).where("a <= b")
    return m.select("set", "a", "b", (F.col("sum_a") / n).alias("mean_a"), (F.col("z.sums") / n).alias("mean_b"), F.when(n > 1, (F.col("z.products") - F.col("sum_a") * F.col("z.sums") / n) / (n - 1)).alias("cov"))


def frechet(m1: np.ndarray, s1: np.ndarray, m2: np.ndarray, s2: np.ndarray) -> float:
    """|m1 - m2|^2 + tr(s1 + s2 - 2 (s1 s2)^1/2) for covariance matrices."""

    def root(s):
        w, v = np.linalg.eigh((s + s.T) / 2)
        return v * np.sqrt(np.clip(w, 0, None)) @ v.T

    r = root(s1)
    cross = np.sqrt(np.clip(np.linalg.eigvalsh(r @ s2 @ r), 0, None)).sum()
    return float(((m1 - m2) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * cross)


def fid(features: DataFrame) -> DataFrame:
    """fid between the sets gt and pred. Only the d x d moments come to the driver."""
    rows: dict[str, list] = {}
    for r in moments(features).collect():
        rows.setdefault(r["set"], []).append(r)
    got: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for name, found in rows.items():
        found.sort(key=lambda r: r["a"])
        n, total = found[0]["n"], np.array(found[0]["sums"])
        products = np.array([r["products"] for r in found])
        got[name] = total / n, (products - np.outer(total, total) / n) / (n - 1) if n > 1 else np.full(products.shape, np.nan)
    value = frechet(*got["gt"], *got["pred"]) if {"gt", "pred"} <= got.keys() and all(np.isfinite(c).all() for _, c in got.values()) else None
    return features.sparkSession.createDataFrame([(value,)], "fid double")


#: Vectors of so many dimensions or fewer meet through their third moments, longer ones block by block.
MOMENT_DIMS = 128


def _by_moments(features: DataFrame) -> DataFrame:
    """xx, yy, xy: sums of the kernel over all pairs of rows within and between the sets, in parts. With z = (x / sqrt(d), 1)
    the kernel is (z.w)^3, so its sums are products of the sets' third moments: one pass, (d + 1)^3 / 6 numbers a task."""

    def sums(batches):
        import pyarrow as pa

        total = {}
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float)
            names = np.array(batch.column(0).to_pylist(), object)
            for s in ("gt", "pred"):
                rows = x[names == s]
                if not len(rows):
                    continue
                z = np.hstack([rows / np.sqrt(rows.shape[1]), np.ones((len(rows), 1))])
                for a in range(z.shape[1]):
                    part = (z[:, a:] * z[:, a : a + 1]).T @ z[:, a:]
                    part = part[np.triu_indices(len(part))]
                    total[s, a] = total[s, a] + part if (s, a) in total else part
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.list_(pa.float64()))], names=["set", "a", "m"])

    def meet(pdf):
        import pandas as pd

        x, y = (sum(pdf[pdf["set"] == s]["m"].to_list()) for s in ("gt", "pred"))
        n = len(pdf["m"].iloc[0])
        width = int(((8 * n + 1) ** 0.5 - 1) / 2 + 0.5)
        i, j = np.triu_indices(width)
        # how many orders of (a, b, c) an ordered triple stands for
        times = np.where((i == 0) & (j == 0), 1, np.where((i == 0) | (i == j), 3, 6))
        return pd.DataFrame({"xx": [float((times * x * x).sum())], "yy": [float((times * y * y).sum())], "xy": [float((times * x * y).sum())]})

    return features.select("set", "x").mapInArrow(sums, "set string, a int, m array<double>").groupBy("a").applyInPandas(meet, "xx double, yy double, xy double")


def _by_blocks(features: DataFrame, n: int, block: int) -> DataFrame:
    """The same sums from products of blocks of about `block` rows: a task for each pair of blocks."""
    blocks = max(1, -(-n // block))
    own = features.withColumn("own", F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    own = own.select("set", "x", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def meet(pdf):
        import pandas as pd

        at = lambda s, b: pdf[(pdf["set"] == s) & (pdf["own"] == b)]["x"].to_list()

        def k(x, y):
            return float(((np.stack(x) @ np.stack(y).T / len(x[0]) + 1) ** 3).sum()) if x and y else 0.0

        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        x, y, u, v = at("gt", lo), at("pred", lo), at("gt", hi), at("pred", hi)
        row = (k(x, x), k(y, y), k(x, y)) if lo == hi else (2 * k(x, u), 2 * k(y, v), k(x, v) + k(u, y))
        return pd.DataFrame([row], columns=["xx", "yy", "xy"])

    return own.groupBy("lo", "hi").applyInPandas(meet, "xx double, yy double, xy double")


def kid_full(features: DataFrame, moment_dims: int = MOMENT_DIMS, block: int = 1000) -> DataFrame:
    """kid_mean: the unbiased polynomial MMD^2 of the whole sets, with (x.y / d + 1)^3, at any number of rows. Null if a set
    has fewer than two."""
    features = features.where("set IN ('gt', 'pred')")
    own = F.pow(F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v) / F.size("x") + 1, 3)
    facts = {r["set"]: r for r in features.groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"), F.sum(own).alias("own")).collect()}
    value = None
    if {"gt", "pred"} <= facts.keys() and min(r["n"] for r in facts.values()) > 1:
        (n, kx), (m, ky) = ((facts[s]["n"], facts[s]["own"]) for s in ("gt", "pred"))
        parts = _by_moments(features) if facts["gt"]["d"] <= moment_dims else _by_blocks(features, n + m, block)
        t = parts.agg(F.sum("xx").alias("xx"), F.sum("yy").alias("yy"), F.sum("xy").alias("xy")).first()
        value = (t["xx"] - kx) / (n * (n - 1)) + (t["yy"] - ky) / (m * (m - 1)) - 2 * t["xy"] / (n * m)
    return features.sparkSession.createDataFrame([(value,)], "kid_mean double")


def kid_subsets(features: DataFrame, subsets: int = 100, size: int = 1000, seed: int = 0) -> DataFrame:
    """kid_mean, kid_std over seeded random subsets without replacement; a subset is one task of at most 2 * size rows."""
    n = {r["set"]: r["n"] for r in features.groupBy("set").agg(F.count(F.lit(1)).alias("n")).collect()}
    m = min(size, *n.values())
    spread = features.withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(subsets - 1))))
    draw = F.xxhash64(F.lit(seed), "subset", "set", "id")
    # a hash threshold keeps a few more than m rows a subset; the task takes the m with the smallest hashes
    share = F.lit(1.0)
    for k, v in n.items():
        share = F.when(F.col("set") == k, min(1.0, (m + 6 * m**0.5 + 20) / v)).otherwise(share)
    spread = spread.withColumn("draw", draw).where(F.pmod("draw", F.lit(1_000_000)) / 1e6 < share)

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["draw", "id"])
        x, y = (np.stack(pdf[pdf["set"] == s]["x"].head(m).to_list()) for s in ("gt", "pred"))
        k = lambda a, b: (a @ b.T / a.shape[1] + 1) ** 3
        same = lambda a: (k(a, a).sum() - np.trace(k(a, a))) / (len(a) * (len(a) - 1))
        return pd.DataFrame({"kid": [same(x) + same(y) - 2 * k(x, y).mean()]})

    each = spread.groupBy("subset").applyInPandas(one, "kid double")
    return each.agg(F.avg("kid").alias("kid_mean"), F.stddev_pop("kid").alias("kid_std"))


class LearnedMetric:
    """Interface of metrics that need a pretrained network; give it a callable on stacks of images."""

    def __init__(self, model=None):
        self.model = model

    def __call__(self, pairs: DataFrame, maps: list[str], name: str) -> DataFrame:
        if self.model is None:
            raise NotImplementedError(f"{name} needs a pretrained network, which isn't part of this package: pass model=")
        from mapgauge.operators.images import per_image

        model = self.model
        return per_image(pairs, maps, f"{name} double", lambda *m: {name: model(*m)})
