import json

import pytest

from mapgauge.plans import config, evaluate
from mapgauge.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def by_key(result):
    return {(r["space"], r["category"], r["reduction"], r["bin"], r["metric"]): r["value"] for r in result.metrics.collect()}


def test_depth(spark):
    r = evaluate.evaluate_depth(fx.normalised_pairs(spark, SF), benchmark=(8, 12))
    got = by_key(r)
    assert r.info == {"spaces": ["native", "metric"], "normalised": True}
    assert got["metric", "standard", "pixel_pool", "", "absrel"] < 0.1 < got["native", "standard", "pixel_pool", "", "absrel"]
    assert 0 < got["metric", "image_quality", "", "", "ssim"] <= 1 and ("metric", "standard", "image_mean", "near", "rmse") in got
    assert got["metric", "geometric_metrics", "", "", "normal_consistency.percent_below_30"] > 0


def test_perfect_depth(spark):
    p = fx.depth_pairs(spark, SF)
    got = by_key(evaluate.evaluate_depth(p.withColumn("pred", p["gt"]), mode="none"))
    assert got["metric", "standard", "pixel_pool", "", "mae"] == 0 and got["metric", "image_quality", "", "", "ssim"] == pytest.approx(1)
    assert ("metric", "image_quality", "", "", "psnr") not in got  # infinite everywhere, so nothing to average
    assert got["metric", "geometric_metrics", "", "", "depth_edge_f1.f1"] == 1


def test_rgb_and_rays(spark):
    got = by_key(evaluate.evaluate_rgb(fx.rgb_pairs(spark, SF), depth=True, benchmark=(1, 9)))
    assert 0 < got["", "tail_errors", "", "", "p95"] < got["", "tail_errors", "", "", "p99"] and ("", "benchmark", "", "all", "mae") in got
    r = by_key(evaluate.evaluate_rays(fx.ray_pixels(spark, SF)))
    assert 0 < r["", "rho_a", "", "", "mean"] < 1 and r["", "angular_error", "", "", "median_angle"] > 0


def test_config_and_command_line(spark, tmp_path):
    data = tmp_path / "depth.parquet"
    fx.depth_pairs(spark, SF).limit(20).write.parquet(str(data))
    good = {"gt": {"depth": str(data)}, "datasets": [{"name": "d", "depth": str(data), "output_file": str(tmp_path / "out.json")}]}
    bad = [{}, {"gt": {"depth": str(data)}}, good | {"datasets": []}, good | {"gt": {"depth": "/nowhere"}}, good | {"datasets": [{"depth": "x"}]}, good | {"datasets": [{"name": "d"}]}, good | {"datasets": [{"name": "d", "rgb": "x"}]}]
    for n, c in enumerate(bad):
        f = tmp_path / f"{n}.json"
        f.write_text(json.dumps(c))
        with pytest.raises(config.ConfigError):
            config.load_config(str(f))
        assert config.main([str(f)]) == 1
    f = tmp_path / "good.json"
    f.write_text(json.dumps(good))
    assert config.main([str(f), "--alignment", "none", "--report", str(tmp_path / "report.json")]) == 0
    tree = json.loads((tmp_path / "out.depth.json").read_text())
    assert tree["depth"]["eval"]["metric"]["standard"]["pixel_pool"]["absrel"] > 0 and tree["dataset_info"]["name"] == "d"
    files = tree["files"]["files"]
    assert len(files) == 20 and files[0]["metrics"]["depth"]["eval"]["metric"]["absrel"] > 0
    assert "depth" in json.loads((tmp_path / "report.json").read_text())["d"]


def test_string_keys_and_a_perfect_pool(spark):
    p = fx.depth_pairs(spark, SF).limit(6)
    p = p.withColumn("img", p["img"].cast("string")).withColumn("pred", p["gt"])
    got = by_key(evaluate.evaluate_depth(p, mode="none"))
    assert got["metric", "depth_metrics", "", "", "absrel.median"] == 0
    assert got["metric", "geometric_metrics", "", "", "normal_consistency.consistency"] == pytest.approx(1)


def test_benchmark_rgb_bins_leave_out_sky_and_count_empty_bins(spark):
    rows = [("a", 0.1, 1.0, 2.0, False), ("a", 0.3, 0.5, 9.0, False), ("a", 9.0, 9.0, 5.0, True), ("b", 0.5, 0.2, 2.0, False)]
    px = spark.createDataFrame(rows, "img string, ae double, se double, depth double, sky boolean")
    got = {r["bin"]: (r["mae"], r["mse"]) for r in evaluate.benchmark_rgb(px, (1, 10), "sky").collect()}
    assert got["all"] == pytest.approx(((0.2 + 0.5) / 2, (0.75 + 0.2) / 2))
    assert got["near"] == pytest.approx((0.3, 0.6)) and got["mid"] == (0, 0) and got["far"] == pytest.approx((0.15, 0.25))


def test_datasets_end_to_end(spark, tmp_path):
    import io
    import zipfile

    import numpy as np

    from mapgauge.sources import datasets

    rng = np.random.default_rng(3)
    ids = [f"s{k % 2}/v/{k:03}" for k in range(6)]

    def npy(a):
        b = io.BytesIO()
        np.save(b, a)
        return b.getvalue()

    truth = {i: rng.uniform(2, 9, (19, 26)) for i in ids}
    gt, pred = tmp_path / "gt", tmp_path / "pred.zip"
    for i, a in truth.items():
        (gt / i).parent.mkdir(parents=True, exist_ok=True)
        (gt / f"{i}.npy").write_bytes(npy(a))
    (gt / "output.json").write_text(datasets.manifest_text({i: f"{i}.npy" for i in ids}))
    with zipfile.ZipFile(pred, "w") as z:
        for i in ids[:5]:
            z.writestr(f"{i}.npy", npy(truth[i][:16, :24][None] * 1.1))
        z.writestr("output.json", datasets.manifest_text({i: f"{i}.npy" for i in ids[:5]}))
    k, sky = tmp_path / "k", tmp_path / "sky"
    k.mkdir()
    sky.mkdir()
    (k / "m.npy").write_bytes(npy(np.array([[500.0, 0, 12], [0, 510.0, 8], [0, 0, 1]])))
    (k / "output.json").write_text(datasets.manifest_text({"s0/m": "m.npy", "s1/m": "m.npy"}))
    mask = np.zeros((19, 26))
    mask[:3] = 1
    (sky / "m.npy").write_bytes(npy(mask))
    (sky / "output.json").write_text(datasets.manifest_text({i: "m.npy" for i in ids}))
    pairs = datasets.build_pairs(spark, {"path": str(gt)}, {"path": str(pred)}, "depth", {"path": str(k)}, {"path": str(sky)})
    rows = {r["img"]: r for r in pairs.collect()}
    assert sorted(rows) == sorted(ids[:5])
    for i, r in rows.items():
        assert (r["height"], r["width"], r["spatial"], r["aspect"], r["fx"], r["cy"]) == (16, 24, "vae_crop", False, 500.0, 8.0)
        assert np.allclose(np.array(r["gt"]).reshape(16, 24), truth[i][:16, :24]) and sum(r["sky"]) == 3 * 24
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"gt": {"depth": str(gt), "calibration": str(k), "segmentation": str(sky)}, "datasets": [{"name": "z", "depth": str(pred), "output_file": str(tmp_path / "o.json")}]}))
    logged = []
    tree = next(t for *_, t, _ in config.evaluate(spark, config.load_config(str(f)), "none", log=lambda *x: logged.append(x)))
    assert tree["depth"]["eval"]["metric"]["standard"]["pixel_pool"]["absrel"] == pytest.approx(0.1)
    assert tree["files"]["children"]["s0"]["children"]["v"]["files"][0]["metrics"]["depth"]["eval"]["metric"]["absrel"] == pytest.approx(0.1)
    assert tree["dataset_info"]["spatial"] == {"vae_crop": 5} and logged[0][2]["depth.metric.standard.pixel_pool.absrel"] == pytest.approx(0.1)
    with pytest.raises(ValueError):
        datasets.build_pairs(spark, {"path": str(gt)}, {"path": str(k)}, "depth")


def test_to_size():
    import numpy as np

    from mapgauge.sources.datasets import kind_of, to_size

    a = np.arange(48.0).reshape(6, 8)
    assert to_size(a, 6, 8) is a and kind_of(375, 1242, 368, 1240) == "vae_crop" and kind_of(376, 1242, 368, 1240) == "resize"
    assert np.allclose(to_size(a, 3, 4), a.reshape(3, 2, 4, 2).mean(axis=(1, 3)))
    assert np.array_equal(to_size(a, 12, 16), a.repeat(2, axis=0).repeat(2, axis=1))
    up = to_size(np.stack([a] * 3, axis=2), 12, 16)
    assert up.shape == (12, 16, 3) and up[0, 0, 0] == a[0, 0] and up[0, 1, 0] == pytest.approx(0.25) and up[-1, -1, 2] == a[-1, -1]
    assert set(np.unique(to_size(a > 20, 4, 5, mask=True))) <= {False, True}


def test_png():
    import struct
    import zlib

    import numpy as np

    from mapgauge.sources import png

    rng = np.random.default_rng(5)

    def paeth(a, b, c):
        p = a + b - c
        return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]

    def encode(a, colour):
        h, w = a.shape[:2]
        raw = (a.astype(">u2") if a.dtype == np.uint16 else a).tobytes()
        stride, step = len(raw) // h, len(raw) // (h * w)
        rows = [raw[i * stride : (i + 1) * stride] for i in range(h)]
        out = b""
        for i, row in enumerate(rows):
            up = rows[i - 1] if i else bytes(stride)
            left = lambda r, x: r[x - step] if x >= step else 0
            guess = [lambda x: 0, lambda x: left(row, x), lambda x: up[x], lambda x: (left(row, x) + up[x]) // 2, lambda x: paeth(left(row, x), up[x], left(up, x))][i % 5]
            out += bytes([i % 5]) + bytes((row[x] - guess(x)) & 255 for x in range(stride))
        part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        return png.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 16 if a.dtype == np.uint16 else 8, colour, 0, 0, 0)) + part(b"IDAT", zlib.compress(out)) + part(b"IEND", b"")

    for shape, colour, kind in (((11, 7), 0, np.uint8), ((9, 8), 0, np.uint16), ((10, 6, 3), 2, np.uint8), ((7, 5, 4), 6, np.uint8)):
        a = rng.integers(0, np.iinfo(kind).max, shape, dtype=kind)
        assert np.array_equal(png.decode(encode(a, colour)), a[:, :, :3] if colour == 6 else a)
    with pytest.raises(ValueError):
        png.decode(encode(a, 6)[:-20])


def test_image_features(spark, tmp_path):
    import numpy as np

    from mapgauge.operators import distribution
    from mapgauge.sources import datasets

    rng = np.random.default_rng(4)
    for k in range(5):
        np.save(tmp_path / f"{k}.npy", rng.uniform(-0.2, 1.2, (6, 5, 3)))
    (tmp_path / "note.txt").write_text("no image")
    got = {r["id"]: r["x"] for r in datasets.image_features(spark, str(tmp_path), lambda a: a.mean(axis=(0, 1)), "gt").collect()}
    want = np.rint(np.clip(np.load(tmp_path / "3.npy"), 0, 1) * 255).mean(axis=(0, 1)) / 255
    assert sorted(got) == [f"{k}.npy" for k in range(5)] and np.allclose(got["3.npy"], want)
    both = [datasets.image_features(spark, str(tmp_path), lambda a: a.mean(axis=(0, 1)), n) for n in ("gt", "pred")]
    assert distribution.fid(both[0].unionByName(both[1])).first()[0] == pytest.approx(0, abs=1e-9)
    z = datasets.as_image(np.array([[0.0, 2.0], [4.0, np.inf]]), depth=True)
    assert z.shape == (2, 2, 3) and z[0, 1, 0] == 0 and z[1, 0, 2] == 1


def test_rays_and_images_from_files(spark, tmp_path):
    import numpy as np

    from mapgauge.sources import datasets

    rng = np.random.default_rng(9)
    maps = {}
    for name in ("gt", "pred"):
        (tmp_path / name).mkdir()
        for k in range(2):
            maps[name, k] = rng.normal(size=(4, 5, 3)) + [0, 0, 5]
            np.save(tmp_path / name / f"{k}.npy", maps[name, k])
        (tmp_path / name / "output.json").write_text(datasets.manifest_text({f"s/{k}": f"{k}.npy" for k in range(2)}, {"rgb_range": [0, 10]}))
    gt, pred = ({"path": str(tmp_path / n)} for n in ("gt", "pred"))
    px = datasets.build_pairs(spark, gt, pred, "rays")
    first = sorted((r["gx"], r["gy"], r["gz"], r["px"], r["py"], r["pz"]) for r in px.where("img = 's/0'").collect())
    assert np.allclose(first, sorted(map(tuple, np.concatenate([maps["gt", 0], maps["pred", 0]], axis=2).reshape(-1, 6).tolist())))
    got = by_key(evaluate.evaluate_rays(px))
    cos = [(g * p).sum(-1) / np.linalg.norm(g, axis=-1) / np.linalg.norm(p, axis=-1) for g, p in ((maps["gt", k], maps["pred", k]) for k in range(2))]
    assert got["", "angular_error", "", "", "mean_angle"] == pytest.approx(np.degrees(np.arccos(np.concatenate(cos))).mean())
    rgb = {r["img"]: r for r in datasets.build_pairs(spark, gt, pred, "rgb").collect()}
    assert np.allclose(rgb["s/1"]["pg"], maps["pred", 1][:, :, 1].ravel() / 10)
