"""Dataset manifests: nested JSON of levels and files, flattened to frames; and decoding of the files."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapgauge.sources import png

SCHEMA = "modality string, split string, hierarchy array<string>, file_id string, path string, meta map<string,string>"
DEFAULTS = {"depth": {"radial_depth": True, "scale_to_meters": 1.0}, "rgb": {"rgb_range": [0, 1]}, "rays": {"fov_domain": None}}

#: Loader name -> decoder of a file's bytes to an array.
LOADERS: dict[str, Callable[[bytes], np.ndarray]] = {"npy": lambda b: np.load(io.BytesIO(b), allow_pickle=False), "png": png.decode}


def register_loader(name: str, decode: Callable[[bytes], np.ndarray]) -> None:
    LOADERS[name] = decode


def loader(name: str | None) -> Callable[[bytes], np.ndarray]:
    if not name:
        raise ValueError("the manifest declares no loader")
    if name not in LOADERS:
        raise ValueError(f"no loader {name!r} is registered")
    return LOADERS[name]


def walk(node: dict, above: tuple[str, ...] = ()) -> Iterator[tuple[list[str], str, str]]:
    """(hierarchy, file id, path) of all files of a manifest node."""
    for f in node.get("files", []):
        yield list(above), f["id"], f["path"]
    for name, child in node.get("children", {}).items():
        yield from walk(child, (*above, name))


def parse_manifests(texts: DataFrame, modality: str, split: str = "") -> DataFrame:
    """frames of manifests given as texts, parsed in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                m = json.loads(body.as_py())
                meta = [(str(k), json.dumps(v)) for k, v in (m.get("meta") or {}).items()]
                rows = list(walk(m.get("dataset", {})))
                yield pa.RecordBatch.from_pydict(
                    {"modality": [modality] * len(rows), "split": [split] * len(rows), "hierarchy": [r[0] for r in rows], "file_id": [r[1] for r in rows], "path": [r[2] for r in rows], "meta": [meta] * len(rows)},
                    schema=pa.schema([("modality", pa.string()), ("split", pa.string()), ("hierarchy", pa.list_(pa.string())), ("file_id", pa.string()), ("path", pa.string()), ("meta", pa.map_(pa.string(), pa.string()))]),
                )

    return texts.mapInArrow(run, SCHEMA)


def read_manifest(spark: SparkSession, path: str, modality: str, split: str = "") -> DataFrame:
    """frames of one manifest or, where the path is a pattern, of many, a task each."""
    return parse_manifests(spark.read.text(path, wholetext=True), modality, split)


def metadata(frames: DataFrame, kind: str) -> dict:
    """The manifest's meta with defaults; a stated scale is read as 1, as values are metres already."""
    row = frames.select("meta").limit(1).first()
    got = {k: json.loads(v) for k, v in (row["meta"] or {}).items()} if row else {}
    out = {k: got.get(k, d) for k, d in DEFAULTS[kind].items()}
    return out | {"scale_to_meters": 1.0} if kind == "depth" else out


def decode_maps(spark: SparkSession, folder: str, name: str = "npy", glob: str = "*") -> DataFrame:
    """path, height, width, channels, values: files decoded in tasks."""
    read = loader(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, body in zip(batch.column(0), batch.column(1), strict=True):
                a = as_map(read(body.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), *(pa.array([int(x)], pa.int32()) for x in (a.shape[0], a.shape[1], a.shape[2] if a.ndim == 3 else 1)), pa.array([a.ravel()], pa.list_(pa.float64()))], names=["path", "height", "width", "channels", "values"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")
    return files.mapInArrow(run, "path string, height int, width int, channels int, values array<double>")


def as_map(a: np.ndarray) -> np.ndarray:
    """(h, w), or (h, w, 3) of an image; anything but an image is squeezed to a single map."""
    a = np.asarray(a, np.float64)
    return squeeze_map(a) if a.ndim != 3 or a.shape[-1] != 3 else a


def squeeze_map(a: np.ndarray) -> np.ndarray:
    """(h, w) of a map given as (1, h, w), (h, w, 1), (1, 1, h, w) or (1, h, w, 1)."""
    out = np.squeeze(a)
    if out.ndim != 2:
        raise ValueError(f"not a single map: {a.shape}")
    return out


def channels_last(a: np.ndarray, tensor: bool = False) -> np.ndarray:
    """(h, w, 3) of an image; channels may lead in tensors. Arrays that could be either raise."""
    a = a[0] if a.ndim == 4 and a.shape[0] == 1 else a
    if a.ndim == 3 and a.shape[0] == 3 and a.shape[-1] == 3 and not tensor:
        raise ValueError("channels first or last? both sides are 3")
    if a.ndim == 3 and a.shape[0] == 3 and (tensor or a.shape[-1] != 3):
        return np.moveaxis(a, 0, -1)
    if a.ndim != 3 or a.shape[-1] != 3:
        raise ValueError(f"not an image: {a.shape}")
    return a


def split_of(frames: DataFrame, split: str | None) -> DataFrame:
    return frames.where(F.col("split") == split) if split else frames
