"""Metrics that need an image as a whole: Arrow batches of image rows, no shuffle; images of equal size share a numpy stack."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mapgauge.functions import kernels as K
from mapgauge.functions.masks import benchmark_edges

#: Pixels that one stack may have.
STACK = 1 << 22


def stacks(batch: pa.RecordBatch, n: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Row numbers and the n maps from column 3 on, as stacks (rows, height, width) of equal size."""
    size = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1)
    for h, w in np.unique(size, axis=0) if len(size) else []:
        rows = np.flatnonzero((size == (h, w)).all(axis=1))
        step = max(1, STACK // int(h * w))
        for s in range(0, len(rows), step):
            take = pa.array(rows[s : s + step])
            yield rows[s : s + step], [batch.column(3 + m).take(take).flatten().to_numpy(zero_copy_only=False).reshape(-1, h, w) for m in range(n)]


def per_image(pairs: DataFrame, maps: list[str], schema: str, fn: Callable[..., dict[str, np.ndarray]], key: str = "img") -> DataFrame:
    """Applies fn to stacks (n, height, width) of the named row-major arrays; it returns the columns of schema, one value
    an image. Null elements are NaN."""
    names = [c.split()[0] for c in schema.split(", ")]
    kept = pairs.select(key, "height", "width", *maps)
    key_type = kept.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, maps_ in stacks(batch, len(maps)):
                out = fn(*maps_)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(pa.array(np.asarray(out[c]).tolist() if np.asarray(out[c]).ndim > 1 else out[c]) for c in names)], names=[key, *names])

    return kept.mapInArrow(run, f"{key} {key_type}, {schema}")


def _f(a: np.ndarray) -> np.ndarray:
    return a.astype(np.float64)


def depth_ssim(pairs: DataFrame) -> DataFrame:
    return per_image(pairs, ["gt", "pred"], "ssim double", lambda g, p: {"ssim": K.depth_ssim(g, p, K.valid_pair(g, p))})


def depth_edge_f1(pairs: DataFrame, threshold: float = 0.1, method: str = "relative", tolerance: int = 1) -> DataFrame:
    def fn(g, p):
        ok = K.valid_pair(g, p)
        return {k: _f(v) if k in ("precision", "recall", "f1") else v for k, v in K.edge_scores(K.depth_edges(g, ok, threshold, method), K.depth_edges(p, ok, threshold, method), tolerance).items()}

    return per_image(pairs, ["gt", "pred"], "gt_edges long, pred_edges long, precision double, recall double, f1 double", fn)


RGB = ["gr", "gg", "gb", "pr", "pg", "pb"]


def rgb_ssim(pairs: DataFrame) -> DataFrame:
    mean = lambda a: a.reshape(len(a), -1).mean(axis=1)
    return per_image(pairs, RGB, "ssim double", lambda *m: {"ssim": sum(mean(K.ssim_map(m[3 + k], m[k])) for k in range(3)) / 3})


def rgb_edge_f1(pairs: DataFrame, threshold: float = 0.1, method: str = "sobel", tolerance: int = 1) -> DataFrame:
    fn = lambda *m: K.edge_scores(K.rgb_edges(K.luma(*m[:3]), threshold, method), K.rgb_edges(K.luma(*m[3:]), threshold, method), tolerance)
    return per_image(pairs, RGB, "gt_edges long, pred_edges long, precision double, recall double, f1 double", fn)


def chroma_error(pairs: DataFrame, kernel: str = "scharr") -> DataFrame:
    return per_image(pairs, RGB, "sce double", lambda *m: {"sce": K.chroma_error(list(m[:3]), list(m[3:]), kernel)})


def hf_energy(pairs: DataFrame, cut: float = 0.75) -> DataFrame:
    """gt_hf_ratio, pred_hf_ratio, relative_diff and preservation."""

    def fn(*m):
        g, p = K.high_frequency_share(K.luma(*m[:3]), cut), K.high_frequency_share(K.luma(*m[3:]), cut)
        none = g <= 1e-10
        safe = np.where(none, 1, g)
        diff = np.where(none, np.where(p <= 1e-10, 0.0, np.inf), (p - g) / safe)
        return {"gt_hf_ratio": g, "pred_hf_ratio": p, "relative_diff": diff, "preservation": np.where(none, 1.0, np.minimum(p / safe, 1.0))}

    return per_image(pairs, RGB, "gt_hf_ratio double, pred_hf_ratio double, relative_diff double, preservation double", fn)


def band_similarity(pairs: DataFrame, bands: int = 4) -> DataFrame:
    return per_image(pairs, RGB, "bands array<double>", lambda *m: {"bands": K.band_similarity(K.luma(*m[:3]), K.luma(*m[3:]), bands)})


def normal_angles(pairs: DataFrame, bins: tuple[float, float] | None = None, key: str = "img") -> DataFrame:
    """key, angle: the angle between normals at each pixel that counts.

    With bins = (low, high) also bin: all, and near, mid and far of the benchmark range. Each bin is masked before its
    normals are taken and eroded by itself, so a bin's pixels beside another bin's don't count.
    """
    kept = pairs.select(key, "height", "width", "gt", "pred")
    key_type = kept.schema[key].dataType.simpleString()
    first, second = benchmark_edges(*bins) if bins else (0.0, 0.0)

    def parts(g: np.ndarray) -> dict[str, np.ndarray]:
        if not bins:
            return {"": np.ones(g.shape, bool)}
        inside = (g >= bins[0]) & (g <= bins[1])
        return {"all": inside, "near": inside & (g < first), "mid": inside & (g >= first) & (g < second), "far": inside & (g >= second)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, (g, p) in stacks(batch, 2):
                ok = K.valid_pair(g, p)
                for name, inside in parts(g).items():
                    angle, at = K.normal_angles(g, p, ok & inside)
                    owner = np.repeat(rows, at.reshape(len(rows), -1).sum(axis=1))
                    columns = [batch.column(0).take(pa.array(owner)), pa.array(angle[at])]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([name] * len(owner), pa.string())][: 3 if bins else 2], names=[key, "angle", "bin"][: 3 if bins else 2])

    return kept.mapInArrow(run, f"{key} {key_type}, angle double" + (", bin string" if bins else ""))
