import math

import numpy as np
import pytest

import numpy_loop
from mapgauge.operators.reduce import STANDARD
from mapgauge.plans import registry

SF = "/root/testdata/sf0.001"


def test_loops_give_what_the_queries_give(spark):
    rows = registry.QUERIES["standard_per_image"](spark, SF).collect()
    want = numpy_loop.standard_per_image(SF)
    assert sorted(want) == sorted(r["img"] for r in rows)
    for r in rows:
        for m, x in zip(STANDARD, want[r["img"]], strict=True):
            assert (r[m] is None and math.isnan(x)) or r[m] == pytest.approx(x, abs=1e-5)
    for name, column in (("depth_ssim", "ssim"), ("rgb_psnr", "psnr"), ("rgb_ssim", "ssim"), ("chroma_error", "sce"), ("depth_edge_f1", "f1")):
        got, loop = {r["img"]: r[column] for r in registry.QUERIES[name](spark, SF).collect()}, numpy_loop.LOOPS[name](SF)
        assert got.keys() == loop.keys() and all(got[k] == pytest.approx(loop[k], abs=1e-5) for k in got)
    got = {(r["metric"], r["share"]): r["value"] for r in registry.QUERIES["pooled_quantiles_large"](spark, SF).collect()}
    for name, (median, p90) in numpy_loop.pooled_quantiles_large(SF).items():
        assert got[name, 0.5] == pytest.approx(median, abs=1e-5) and got[name, 0.9] == pytest.approx(p90, abs=1e-5)
    assert registry.QUERIES["kid_full_set"](spark, SF).first()[0] == pytest.approx(numpy_loop.kid_full_set(SF), abs=1e-5)
    assert np.isfinite(list(numpy_loop.times(SF).values())).all()
