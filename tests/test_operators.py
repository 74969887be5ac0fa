import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapgauge.functions import kernels as K
from mapgauge.functions import masks
from mapgauge.operators import align, distribution, match, rays, reduce, rules
from mapgauge.sources import manifests, sinks


def px(spark, rows):
    return spark.createDataFrame([(i, k // 2, k % 2, float(g), float(p)) for i, img in enumerate(rows) for k, (g, p) in enumerate(img)], "img long, i int, j int, gt double, pred double")


def test_standard_metrics_and_reducers(spark):
    d = px(spark, [[(1, 1), (1, 2)], [(2, 1), (4, 2), (8, 4)]])
    got = {r["reduction"]: r.asDict() for r in reduce.standard_reducers(reduce.pixel_stats(d, ["img"])).collect()}
    assert got["image_mean"]["absrel"] == pytest.approx((0.5 + 0.5) / 2)
    assert got["pixel_pool"]["mae"] == pytest.approx((0 + 1 + 1 + 2 + 4) / 5)
    assert got["pixel_pool"]["rmse"] == pytest.approx(math.sqrt((0 + 1 + 1 + 4 + 16) / 5))
    assert got["pixel_pool"]["delta1"] == pytest.approx(1 / 5)


def test_medians_of_many_images(spark):
    rng = np.random.default_rng(2)
    d = px(spark, [[(g, p) for g, p in rng.uniform(1, 5, (4, 2))] for _ in range(41)] + [[(0, 1)]])
    stats = reduce.pixel_stats(d, ["img"])
    few, many = ({r["reduction"]: r.asDict() for r in reduce.standard_reducers(stats, m).collect()} for m in (False, True))
    assert few.keys() == many.keys() and all(many[k][m] == pytest.approx(few[k][m]) for k in few for m in reduce.STANDARD)


def test_empty_masks_give_null(spark):
    d = px(spark, [[(0, 1), (float("nan"), 2)]])
    r = reduce.pixel_stats(d, ["img"]).select(*[c.alias(m) for m, c in reduce.standard_columns().items()]).first()
    assert all(v is None for v in r)


def test_exact_quantiles(spark):
    v = np.random.default_rng(1).standard_normal(1001)
    d = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    got = {r["share"]: r["value"] for r in reduce.exact_quantiles(d, "v", [0.0, 0.5, 0.9, 0.99, 1.0]).collect()}
    for q, x in got.items():
        assert x == pytest.approx(np.percentile(v, q * 100))
    assert reduce.exact_quantiles(d.limit(0), "v", [0.5]).first()["value"] is None


def test_affine_cases(spark):
    fit = lambda rows: align.affine_fit(px(spark, [rows]), masks.fit_mask()).first()
    exact = fit([(10, 0.1), (20, 0.3), (30, 0.5), (40, 0.7)])
    assert (exact["s"], exact["t"]) == (pytest.approx(50), pytest.approx(5))
    flat = fit([(10, 2), (20, 2)])
    assert (flat["s"], flat["t"]) == (pytest.approx(2 * 15 / 5), pytest.approx(15 / 5))
    few = fit([(10, 2), (0, 3)])
    assert (few["s"], few["t"], few["fitted"]) == (1.0, 0.0, False)


def test_modes_and_bins():
    assert align.spaces("none", False) == ["metric"] and align.spaces("none", True) == ["native"]
    assert align.spaces("auto_affine", False) == ["metric"] and align.spaces("affine", False) == ["native", "metric"]
    with pytest.raises(ValueError):
        align.spaces("other", True)
    a, b = masks.benchmark_edges(0.1, 80)
    assert b == pytest.approx(36.82, abs=0.01) and a < b
    for bad in ((-1, 2), (3, 3)):
        with pytest.raises(ValueError):
            masks.benchmark_edges(*bad)
    assert masks.benchmark_key(0.5, 100) == "benchmark_0_5m_100m"


def test_resize_linear_constant(spark):
    d = px(spark, [[(3, 0), (3, 0), (3, 0), (3, 0)]])
    out = align.resize_linear(d, (2, 2), (5, 3), "gt").collect()
    assert len(out) == 15 and all(r["gt"] == pytest.approx(3) for r in out)


def test_rho_a_on_grid_points(spark):
    a = [0.0, 0.2, 0.4, 19.8, 20.0, 25.0]
    d = spark.createDataFrame([(0, x) for x in a], "img long, angle double")
    t = np.arange(101) * (20 / 100)
    y = [(np.array(a) <= x).mean() for x in t]
    want = (sum(y) - (y[0] + y[-1]) / 2) / 100
    assert rays.rho_a(d, 20.0).first()["rho_a"] == pytest.approx(want)
    with pytest.raises(ValueError):
        rays.domain_threshold("wide")


def test_kernels_against_loops():
    rng = np.random.default_rng(2)
    a = rng.random((2, 6, 7))
    p = np.pad(a, ((0, 0), (1, 1), (1, 1)), mode="symmetric")
    across, down = K.gradients(a)
    for i in range(6):
        for j in range(7):
            w = p[0, i : i + 3, j : j + 3]
            assert across[0, i, j] == pytest.approx((w * np.outer([1, 2, 1], [-1, 0, 1])).sum())
            assert down[0, i, j] == pytest.approx((w * np.outer([-1, 0, 1], [1, 2, 1])).sum())
    e = a > 0.8
    d = K.dilate(e)
    assert all(d[0, i, j] == e[0, max(0, i - 1) : i + 2, max(0, j - 1) : j + 2].any() for i in range(6) for j in range(7))
    ok = np.ones(a.shape, bool)
    assert K.depth_ssim(a, a, ok) == pytest.approx([1, 1])
    assert list(K.depth_ssim(a, a, ~ok)) == [0, 0] and list(K.depth_ssim(np.ones_like(a), np.ones_like(a), ok)) == [1, 1]
    assert K.band_similarity(a, a) == pytest.approx(np.ones((2, 4)))
    thin, wide = K.rgb_edges(a, method="canny_approx"), K.rgb_edges(a)
    assert (thin <= wide).all() and not thin[:, 0].any()


def test_frechet_of_equal_sets_is_zero():
    x = np.random.default_rng(3).standard_normal((50, 4))
    m, s = x.mean(0), np.cov(x.T)
    assert distribution.frechet(m, s, m, s) == pytest.approx(0, abs=1e-9)
    assert distribution.frechet(m, s, m + 1, s) == pytest.approx(4)
    with pytest.raises(NotImplementedError):
        distribution.LearnedMetric()(None, [], "lpips")


def test_matching(spark):
    f = spark.createDataFrame([(["a", "b"], "1", 1.0), (["a", "b"], "2", 2.0), (["c"], "1", 3.0), ([], "9", 4.0)], "hierarchy array<string>, file_id string, value double")
    k = spark.createDataFrame([(["a"], "k", 7.0), (["a"], "j", 6.0), (["a", "b"], "k", 8.0), ([], "k", 5.0)], "hierarchy array<string>, file_id string, fx double")
    got = {(tuple(r["hierarchy"]), r["file_id"]): r["fx"] for r in match.attach_ancestor(f, k, ["fx"]).collect()}
    assert got == {(("a", "b"), "1"): 8.0, (("a", "b"), "2"): 8.0, (("c",), "1"): 5.0, ((), "9"): 5.0}
    assert match.subtree(f, ["a"]).count() == 2 and match.retrieve(f, ["c"], "1").first()["value"] == 3.0
    ids = spark.createDataFrame([("/S/c/0", "x"), (None, "y")], "full_id string, id string").select(*match.split_full_id()).collect()
    assert [tuple(r) for r in ids] == [(["S", "c"], "0"), ([], "y")]
    with pytest.raises(ValueError):
        match.require_matches(f.limit(0))


def test_rules(spark):
    d = spark.createDataFrame([(i, 0.6 if i < 7 else float("nan")) for i in range(9)], "img long, silog double")
    r = rules.report(rules.warnings(d, "depth")).collect()
    assert len(r) == 1 and r[0]["count"] == 7 and len(r[0]["samples"]) == 5 and r[0]["type"] == "silog_too_high"


def test_rule_report_ranks_few_rows_and_sorts_no_others(spark):
    rows = [(f"{i * 7919 % 1000:03d}", 0.6 + i / 1000) for i in range(1000)] + [("000", 0.55), ("000", 0.55)]
    r = rules.report(rules.warnings(spark.createDataFrame(rows, "img string, silog double"), "depth"))
    assert "SortAggregate" not in r._jdf.queryExecution().executedPlan().toString()
    got = r.collect()
    assert len(got) == 1 and got[0]["count"] == 1002 and got[0]["samples"] == [v for _, v in sorted((i, v) for i, v in rows)[:5]]
    few = rules.report(rules.warnings(spark.createDataFrame([("b", 0.7), ("a", 0.6), ("a", 0.6)], "img string, silog double"), "depth")).collect()
    assert few[0]["samples"] == [0.6, 0.6, 0.7] and few[0]["message"].startswith("silog silog 0.600000 is ")


def test_sinks(tmp_path):
    assert sinks.clean({"a": float("nan"), "b": {"c": None}, "d": [{"e": None}], "f": 1}) == {"d": [{}], "f": 1}
    tree = sinks.set_value({}, ["s", "t"], "1", {"m": 1})
    sinks.set_value(tree, ["s", "t"], "1", {"m": 2})
    assert tree["children"]["s"]["children"]["t"]["files"] == [{"id": "1", "metrics": {"m": 2}}]
    archive = tmp_path / "x.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("keep.txt", "k")
    for v in (1, 2):
        sinks.save_json({"v": v}, archive / "eval.json")
    with zipfile.ZipFile(archive) as z:
        assert sorted(z.namelist()) == ["eval.json", "keep.txt"] and '"v": 2' in z.read("eval.json").decode()
    assert sinks.save_json({"v": 1}, tmp_path / "d" / "e.json").read_text().startswith("{")


def test_manifests(spark, tmp_path):
    (tmp_path / "output.json").write_text('{"name": "n", "meta": {"radial_depth": false, "scale_to_meters": 0.01}, "dataset": {"children": {"S": {"children": {"c": {"files": [{"id": "1", "path": "a.npy"}]}}, "files": [{"id": "k", "path": "k.npy"}]}}}}')
    f = manifests.read_manifest(spark, str(tmp_path / "output.json"), "depth")
    assert sorted((tuple(r["hierarchy"]), r["file_id"]) for r in f.collect()) == [(("S",), "k"), (("S", "c"), "1")]
    assert manifests.metadata(f, "depth") == {"radial_depth": False, "scale_to_meters": 1.0}
    np.save(tmp_path / "a.npy", np.arange(8.0).reshape(1, 2, 4))
    r = manifests.decode_maps(spark, str(tmp_path), glob="*.npy").first()
    assert (r["height"], r["width"], list(r["values"])) == (2, 4, [0, 1, 2, 3, 4, 5, 6, 7])
    with pytest.raises(ValueError):
        manifests.loader("exr")
    with pytest.raises(ValueError):
        manifests.channels_last(np.zeros((3, 4, 3)))


def test_normalise(spark):
    d = align.normalise(px(spark, [[(1, 0), (3, 0), (2, 0), (5, 0)]]), "gt", F.col("gt") < 4)
    assert [r["gt"] for r in d.orderBy("i", "j").collect()] == [0, 1, 0.5, 1]


def test_kid_of_whole_sets_has_no_cap(spark):
    rng = np.random.default_rng(3)
    sets = {"gt": rng.normal(size=(1500, 5)), "pred": rng.normal(0.3, 1, size=(1100, 5))}
    rows = [(s, i, [float(v) for v in r]) for s, x in sets.items() for i, r in enumerate(x)]
    d = spark.createDataFrame(rows, "set string, id long, x array<double>").repartition(3)
    k = lambda a, b: (a @ b.T / 5 + 1) ** 3
    same = lambda a: (k(a, a).sum() - np.trace(k(a, a))) / (len(a) * (len(a) - 1))
    want = same(sets["gt"]) + same(sets["pred"]) - 2 * k(sets["gt"], sets["pred"]).mean()
    assert distribution.kid_full(d).first()["kid_mean"] == pytest.approx(want, abs=1e-9)
    assert distribution.kid_full(d, moment_dims=0, block=700).first()["kid_mean"] == pytest.approx(want, abs=1e-9)
    assert distribution.kid_full(d.where("set = 'gt'")).first()["kid_mean"] is None


def test_fid_and_kid_against_numpy(spark):
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(90, 7)), rng.normal(0.3, 1.4, size=(70, 7))
    rows = [("gt", k, v.tolist()) for k, v in enumerate(x)] + [("pred", 1000 + k, v.tolist()) for k, v in enumerate(y)]
    f = spark.createDataFrame(rows, "set string, id long, x array<double>").repartition(5)
    s, t = np.cov(x.T), np.cov(y.T)
    want = ((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(s) + np.trace(t) - 2 * np.sqrt(np.linalg.eigvals(s @ t).real).sum()
    assert distribution.fid(f).first()[0] == pytest.approx(want)
    k = lambda a, b: (a @ b.T / 7 + 1) ** 3
    off = lambda a: (k(a, a).sum() - np.trace(k(a, a))) / (len(a) * (len(a) - 1))
    whole = off(x) + off(y) - 2 * k(x, y).mean()
    assert distribution.kid_full(f).first()[0] == pytest.approx(whole)
    # subsets of 70: all of pred and 70 of gt each time
    got = distribution.kid_subsets(f, subsets=40, size=1000).first()
    draws = [off(z) + off(y) - 2 * k(z, y).mean() for z in (x[rng.permutation(90)[:70]] for _ in range(400))]
    assert abs(got["kid_mean"] - np.mean(draws)) < 6 * np.std(draws) / 40**0.5 and 0.5 < got["kid_std"] / np.std(draws) < 2
    assert distribution.kid_subsets(f, subsets=3, size=20).first()["kid_std"] > 0
    assert distribution.fid(f.where("id = 0")).first()[0] is None


def test_quantiles_of_ties_and_wide_ranges(spark):
    rng = np.random.default_rng(12)
    pools = {"ties": [0.0] * 5000, "two": [1.0] * 3000 + [2.0] * 3001, "wide": [*(10.0 ** rng.uniform(-300, 300, 2000)).tolist(), -1e308, 1e308], "odd": [float("nan"), float("inf"), None, 3.0], "none": [None]}
    for few in (10, 100_000):
        reduce.FEW, kept = few, reduce.FEW
        try:
            for name, pool in pools.items():
                d = spark.createDataFrame([(v,) for v in pool], "v double").repartition(3)
                ok = np.array([v for v in pool if v is not None and np.isfinite(v)])
                got = {r["share"]: r["value"] for r in reduce.exact_quantiles(d, "v", [0.0, 0.3, 0.5, 0.95, 1.0]).collect()}
                for q, v in got.items():
                    assert v == (pytest.approx(np.quantile(ok, q)) if len(ok) else None), (name, q)
        finally:
            reduce.FEW = kept


def test_with_index_of_one_large_level(spark):
    rows = [(["s", f"{k % 7}"], f"{k:05}") for k in range(3000)] + [([], "x"), (["t"], "y")]
    got = match.with_index(spark.createDataFrame(rows, "hierarchy array<string>, file_id string").repartition(6)).collect()
    for level in ("s", "t", None):
        own = sorted((r["hierarchy"], r["file_id"], r["sample_idx"]) for r in got if (r["hierarchy"] or [None])[0] == level)
        assert [x[2] for x in own] == list(range(len(own))) and own


def test_a_rule_without_its_column_raises(spark):
    with pytest.raises(ValueError):
        rules.warnings(spark.createDataFrame([(1, 2.0)], "img long, psnr double"), "rgb", complete=True)
