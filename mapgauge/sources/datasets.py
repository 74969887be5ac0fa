"""Datasets end to end: manifests of two or more modalities to matched, decoded and spatially aligned image pairs.

Frames (a row a file, without its contents) are matched first; contents are decoded in tasks and only those of matched frames
are moved. Calibration and segmentation may lie at ancestor levels. A pair's key, img, is its hierarchy and file id joined by
slashes.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapgauge.functions import masks
from mapgauge.operators import match
from mapgauge.operators.align import area_cells, linear_cells
from mapgauge.sources import manifests as M

MANIFEST = "output.json"
#: Frames that may be broadcast: some 200 bytes each.
FEW_FRAMES = 50_000
#: Sides whose ratios differ by more than this are reported.
ASPECT = 0.05


def _qualified(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def contents(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), content: the files of a folder, or the entries of a zip archive (of 2 GB at most, opened in a task)."""
    if root.endswith(".zip"):

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for body in batch.column(0):
                    with zipfile.ZipFile(io.BytesIO(body.as_py())) as z:
                        for i in z.infolist():
                            if not i.is_dir():
                                yield pa.RecordBatch.from_arrays([pa.array([i.filename]), pa.array([z.read(i)], pa.binary())], names=["path", "content"])

        return spark.read.format("binaryFile").load(root).select("content").mapInArrow(entries, "path string, content binary")
    base = _qualified(spark, root).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.expr(f"substring(path, {len(base) + 1})").alias("path"), "content")


def frames(spark: SparkSession, root: str, modality: str, split: str = "", manifest: str = MANIFEST) -> DataFrame:
    """The frames that the manifest at the root of a folder or archive lists."""
    if not root.endswith(".zip"):
        return M.read_manifest(spark, f"{root.rstrip('/')}/{manifest}", modality, split)
    return M.parse_manifests(contents(spark, root).where(F.col("path") == manifest).select(F.col("content").cast("string")), modality, split)


def decoded(spark: SparkSession, root: str, wanted: DataFrame, loader: str) -> DataFrame:
    """hierarchy, file_id, height, width, channels, values of the wanted frames (hierarchy, file_id, path)."""
    read = M.loader(loader)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a = M.as_map(read(batch.column(2)[k].as_py()))
                sides = [a.shape[0], a.shape[1], a.shape[2] if a.ndim == 3 else 1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), *(pa.array([x], pa.int32()) for x in sides), pa.array([a.ravel()], pa.list_(pa.float64()))], names=["hierarchy", "file_id", "height", "width", "channels", "values"])

    keys = wanted.select("hierarchy", "file_id", "path")
    keys = F.broadcast(keys) if keys.limit(FEW_FRAMES + 1).count() <= FEW_FRAMES else keys
    found = contents(spark, root).join(keys, "path").select("hierarchy", "file_id", "content")
    return found.mapInArrow(run, "hierarchy array<string>, file_id string, height int, width int, channels int, values array<double>")


def resized(a: np.ndarray, height: int, width: int, kind: str) -> np.ndarray:
    """One map (h, w) at another size: area, nearest or linear."""
    h, w = a.shape
    if kind == "nearest":
        return a[np.arange(height) * h // height][:, np.arange(width) * w // width]
    cells = area_cells if kind == "area" else linear_cells

    def weights(n: int, m: int) -> np.ndarray:
        out = np.zeros((m, n))
        for t, s, x in cells(n, m):
            out[t, s] += x
        return out / out.sum(axis=1, keepdims=True)

    return weights(h, height) @ a @ weights(w, width).T


def to_size(a: np.ndarray, height: int, width: int, mask: bool = False) -> np.ndarray:
    """A ground truth (h, w) or (h, w, 3) at the size of its prediction: as it is, its top left part where the prediction
    looks like a crop to multiples of 8, or resized: masks by nearest pixels, down by area, up by nearest for maps and
    linearly for images."""
    h, w = a.shape[:2]
    if (h, w) == (height, width):
        return a
    if height % 8 == 0 and width % 8 == 0 and 0 <= h - height < 8 and 0 <= w - width < 8:
        return a[:height, :width]
    down = height * width < h * w
    kind = "nearest" if mask else "area" if down else "nearest" if a.ndim == 2 else "linear"
    if a.ndim == 3:
        return np.stack([resized(a[:, :, c], height, width, kind) for c in range(a.shape[2])], axis=2)
    return resized(a, height, width, kind)


def kind_of(h: int, w: int, height: int, width: int) -> str:
    if (h, w) == (height, width):
        return "none"
    return "vae_crop" if height % 8 == 0 and width % 8 == 0 and 0 <= h - height < 8 and 0 <= w - width < 8 else "resize"


def aligned(pairs: DataFrame, maps: dict[str, str], channels: int = 1) -> DataFrame:
    """pairs: img, height, width (of the prediction), and for each map name -> kind (values or mask) the columns name,
    name_height and name_width. All maps at the prediction's size (of three-channel ones name_r, name_g, name_b), spatial (how the first map was aligned) and
    aspect (whether its sides' ratio is off by more than ASPECT). In tasks, a row at a time; nothing is shuffled."""
    names = list(maps)
    others = [c for c in pairs.columns if c not in ("img", "height", "width") and not any(c in (n, f"{n}_height", f"{n}_width") for n in names)]
    kept = pairs.select(*others, "img", "height", "width", *[c for n in names for c in (n, f"{n}_height", f"{n}_width")])
    k0 = len(others)
    out_names = [o for n in names for o in ([n] if maps[n] == "mask" or channels == 1 else [f"{n}_{c}" for c in "rgb"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                height, width = batch.column(k0 + 1)[k].as_py(), batch.column(k0 + 2)[k].as_py()
                cols, how, off = [], "", False
                for m, n in enumerate(names):
                    at = k0 + 3 + 3 * m
                    v, h, w = batch.column(at)[k], batch.column(at + 1)[k].as_py(), batch.column(at + 2)[k].as_py()
                    mask = maps[n] == "mask"
                    if not v.is_valid:
                        cols += [pa.nulls(1, pa.list_(pa.float64()))]
                        continue
                    a = v.values.to_numpy(zero_copy_only=False)
                    a = a.reshape(h, w) if mask or channels == 1 else a.reshape(h, w, channels)
                    if m == 0:
                        how, off = kind_of(h, w, height, width), abs(w / h - width / height) / max(w / h, width / height) > ASPECT
                    a = to_size(a, height, width, mask)
                    cols += [pa.array([x.ravel()], pa.list_(pa.float64())) for x in ([a] if a.ndim == 2 else [a[:, :, c] for c in range(3)])]
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns[: k0 + 3]), *cols, pa.array([how]), pa.array([off and how == "resize"])], names=[*others, "img", "height", "width", *out_names, "spatial", "aspect"])

    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in [*others, "img", "height", "width"]), *(f"{c} array<double>" for c in out_names), "spatial string", "aspect boolean"])
    return kept.mapInArrow(run, schema)


def _unit(values: str, low: float, high: float) -> Column:
    return F.transform(values, lambda v: (v - low) / (high - low))


def build_pairs(spark: SparkSession, gt: dict, pred: dict, kind: str, calibration: dict | None = None, segmentation: dict | None = None) -> DataFrame:
    """Image pairs of a ground truth and a prediction as mapgauge.plans.evaluate takes them.

    Each dataset is {path, loader, split, manifest}; path is a folder or zip archive with a manifest at its root. kind is
    depth (gt, pred), rgb (gr ... pb in [0, 1]) or rays (directions; a row a ray: gx ... pz). calibration adds the nearest matrix at an ancestor level as fx, fy, cx,
    cy; segmentation adds sky (class 1 or true). No sample in all modalities raises.
    """
    found = {}
    for name, d in (("gt", gt), ("pred", pred)):
        found[name] = frames(spark, d["path"], name, d.get("split") or "", d.get("manifest", MANIFEST))
    both = match.require_matches(match.match_frames(found, "path"))
    maps = {}
    for name, d in (("gt", gt), ("pred", pred)):
        a = decoded(spark, d["path"], both.select("hierarchy", "file_id", F.col(name).alias("path")), d.get("loader", "npy"))
        if kind == "rgb":
            a = a.withColumn("values", _unit("values", *M.metadata(found[name], "rgb")["rgb_range"]))
        maps[name] = a.select("hierarchy", "file_id", F.col("values").alias(name), F.col("height").alias(f"{name}_height"), F.col("width").alias(f"{name}_width"))
    pairs = maps["gt"].join(maps["pred"], match.KEY).withColumns({"height": F.col("pred_height"), "width": F.col("pred_width")})
    masked = {}
    if segmentation:
        of = frames(spark, segmentation["path"], "segmentation", segmentation.get("split") or "", segmentation.get("manifest", MANIFEST))
        sky = decoded(spark, segmentation["path"], of, segmentation.get("loader", "npy")).select("hierarchy", "file_id", F.col("values").alias("sky"), F.col("height").alias("sky_height"), F.col("width").alias("sky_width"))
        pairs, masked = pairs.join(sky, match.KEY, "left"), {"sky": "mask"}
    if calibration:
        of = frames(spark, calibration["path"], "calibration", calibration.get("split") or "", calibration.get("manifest", MANIFEST))
        k = decoded(spark, calibration["path"], of, calibration.get("loader", "npy"))
        at = lambda i: F.get("values", i)
        k = k.select("hierarchy", "file_id", at(0).alias("fx"), at(4).alias("fy"), at(2).alias("cx"), at(5).alias("cy"))
        pairs = match.attach_ancestor(pairs, k, ["fx", "fy", "cx", "cy"])
    pairs = pairs.withColumn("img", F.array_join(F.concat("hierarchy", F.array("file_id")), "/")).drop(*match.KEY)
    out = aligned(pairs, {"gt": "values", "pred": "values", **masked}, 1 if kind == "depth" else 3)
    if kind == "rays":
        axes = [f"{n}_{c}" for n in ("gt", "pred") for c in "rgb"]
        z = F.explode(F.arrays_zip(*axes, *masked)).alias("z")
        named = [F.col(f"z.{a}").alias(a[0] + "xyz"["rgb".index(a[-1])]) for a in axes]
        return out.select("img", z).select("img", *named, *[(F.coalesce(F.col(f"z.{m}"), F.lit(0.0)) > 0).alias(m) for m in masked])
    if kind == "rgb":
        out = out.withColumnsRenamed({f"{n}_{c}": n[0] + c for n in ("gt", "pred") for c in "rgb"})
    if masked:
        out = out.withColumn("sky", F.transform(F.coalesce("sky", F.array_repeat(F.lit(0.0), (F.col("height") * F.col("width")).cast("int"))), lambda v: v > 0))
    return out


def three_channels(values: str = "values"):
    """A map's finite positive depths scaled to [0, 1] and repeated in three channels, for metrics that take images: an
    array of structs r, g, b."""
    ok = F.filter(values, lambda v: masks.finite(v) & (v > 0))
    lo, hi = F.array_min(ok), F.array_max(ok)
    unit = lambda v: F.when(F.coalesce(hi - lo < 1e-8, F.lit(True)), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo))))
    return F.transform(values, lambda v: F.struct(unit(v).alias("r"), unit(v).alias("g"), unit(v).alias("b")))


def as_image(a: np.ndarray, depth: bool = False) -> np.ndarray:
    """(h, w, 3) in [0, 1] of an image (samples of 8 or 16 bits or floats), in steps of 1 / 255 as a file of 8 bits would
    hold it; or of a depth map, scaled over its finite positive depths, in three channels."""
    if depth:
        z = M.squeeze_map(np.asarray(a, np.float64))
        ok = (z > 0) & np.isfinite(z)
        low, high = (z[ok].min(), z[ok].max()) if ok.any() else (0.0, 0.0)
        unit = np.clip((z - low) / (high - low), 0, 1) if high - low > 1e-8 else np.zeros(z.shape)
        return np.repeat(np.nan_to_num(unit)[:, :, None], 3, axis=2)
    top = np.iinfo(a.dtype).max if a.dtype.kind == "u" else 1.0
    image = np.repeat(a[:, :, None], 3, axis=2) if a.ndim == 2 else M.channels_last(a)
    return np.rint(np.clip(image / top, 0, 1) * 255) / 255


def image_features(spark: SparkSession, root: str, model: Callable[[np.ndarray], np.ndarray], name: str, depth: bool = False) -> DataFrame:
    """set (name), id (path), x: what the model makes of each image file (.npy or .png) of a folder or archive, for FID and
    KID. The model is a callable from an image (h, w, 3) to a vector; it is sent to the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                read = M.loader(path.rsplit(".", 1)[-1].lower())
                rows.append((path, np.asarray(model(as_image(read(body.as_py()), depth)), float).ravel().tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["set", "id", "x"])

    files = contents(spark, root).where(F.lower("path").rlike(r"\.(npy|png)$"))
    return files.mapInArrow(run, "set string, id string, x array<double>")


def manifest_text(files: dict[str, str], meta: dict | None = None) -> str:
    """A manifest of file ids with their levels (a/b/id) -> path."""
    root: dict = {}
    for full, path in files.items():
        node = root
        *levels, name = full.split("/")
        for level in levels:
            node = node.setdefault("children", {}).setdefault(level, {})
        node.setdefault("files", []).append({"id": name, "path": path})
    return json.dumps({"meta": meta or {}, "dataset": root})
