"""Run configuration and the command line."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from mapgauge.sources.sinks import file_tree, output_path, save_json, show, to_tree

MODALITIES = ("depth", "rgb", "rays")


class ConfigError(ValueError):
    pass


def _path(entry) -> str | None:
    return entry.get("path") if isinstance(entry, dict) else entry


def load_config(path: str) -> dict:
    """Reads and checks a configuration: gt with at least one existing modality, and named datasets with one each."""
    try:
        config = json.loads(Path(path).read_text())
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path}: {e}") from None
    if not isinstance(config, dict) or not isinstance(config.get("gt"), dict):
        raise ConfigError("gt is missing")
    if not isinstance(config.get("datasets"), list) or not config["datasets"]:
        raise ConfigError("datasets must be a list that isn't empty")
    gt = config["gt"]
    if not any(_path(gt.get(m)) for m in MODALITIES):
        raise ConfigError(f"gt needs one of {', '.join(MODALITIES)}")
    for name, entry in gt.items():
        if _path(entry) and not Path(_path(entry)).exists():
            raise ConfigError(f"gt.{name}: {_path(entry)} doesn't exist")
    for n, d in enumerate(config["datasets"]):
        if not isinstance(d, dict) or not d.get("name"):
            raise ConfigError(f"datasets[{n}] has no name")
        if not any(_path(d.get(m)) for m in MODALITIES):
            raise ConfigError(f"datasets[{n}] needs one of {', '.join(MODALITIES)}")
        for m in MODALITIES:
            if _path(d.get(m)) and not _path(gt.get(m)):
                raise ConfigError(f"datasets[{n}] has {m}, gt has not")
    return config


def pairs_of(spark, gt: dict | str, pred: dict | str, modality: str, calibration=None, segmentation=None):
    """Image pairs of one modality: the prediction's table, where its path is a Parquet table of pairs, or the files that the
    manifests of ground truth and prediction list."""
    if str(_path(pred)).rstrip("/").endswith(".parquet"):
        return spark.read.parquet(_path(pred))
    as_dict = lambda x: x if isinstance(x, dict) or x is None else {"path": x}
    from mapgauge.sources.datasets import build_pairs

    return build_pairs(spark, as_dict(gt), as_dict(pred), modality, as_dict(calibration), as_dict(segmentation))


def evaluate(spark, config: dict, alignment: str = "auto_affine", benchmark: tuple[float, float] | None = None, domain: str = "lfov", skip: tuple[str, ...] = (), log=None):
    """Yields (dataset, modality, result tree, output path) for each modality of each dataset; the trees are saved.

    log, if given, is called with (dataset, modality, metrics) for each, where metrics are dotted names and values: a hook for
    experiment loggers. The tree holds the whole's metrics, those of each file, and the sanity warnings.
    """
    from mapgauge.plans import evaluate as E

    gt = config["gt"]
    for d in config["datasets"]:
        for m in MODALITIES:
            if not _path(d.get(m)) or m in skip:
                continue
            table = pairs_of(spark, gt[m], d[m], m, gt.get("calibration"), gt.get("segmentation"))
            info = {"name": d["name"], "modality": m}
            if "aspect" in table.columns:
                spatial = {r["spatial"]: r["n"] for r in table.groupBy("spatial").agg(F.count(F.lit(1)).alias("n")).collect()}
                info |= {"spatial": spatial, "aspect_warnings": table.where("aspect").count()}
            if m == "depth":
                intrinsics = tuple(F.col(c) for c in ("fx", "fy", "cx", "cy")) if "fx" in table.columns else None
                r = E.evaluate_depth(table, alignment, intrinsics, gt[m].get("radial", True) if isinstance(gt[m], dict) else True, benchmark=benchmark)
            elif m == "rgb":
                r = E.evaluate_rgb(table, "sky" in table.columns, "depth" in table.columns, benchmark)
            else:
                r = E.evaluate_rays(table, domain, "sky" if "sky" in table.columns else None)
            metrics = r.metrics.collect()
            tree = to_tree(metrics) | {"dataset_info": info, "meta": r.info, "warnings": [w.asDict() for w in r.report.collect()], "files": file_tree(r.per_image.toLocalIterator(), m)}
            if log is not None:
                log(d["name"], m, {".".join(x for x in (w["modality"], w["space"], w["category"], w["reduction"], w["bin"], w["metric"]) if x): w["value"] for w in metrics})
            yield d["name"], m, tree, save_json(tree, output_path(d, m))


def main(argv: list[str] | None = None) -> int:
    """Evaluates datasets: each modality's path is a folder or zip archive with a manifest, or a Parquet table of pairs."""
    ap = argparse.ArgumentParser(prog="mapgauge", description=main.__doc__)
    ap.add_argument("config")
    ap.add_argument("--alignment", default="auto_affine", choices=["none", "auto_affine", "affine"])
    ap.add_argument("--benchmark", nargs=2, type=float, metavar=("MIN", "MAX"))
    ap.add_argument("--domain", default="lfov")
    ap.add_argument("--report", default="sanity_check_report.json", help="where the warnings of the whole run go")
    for m in MODALITIES:
        ap.add_argument(f"--skip-{m}", action="store_true")
    args = ap.parse_args(argv)
    try:
        config = load_config(args.config)
    except ConfigError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    warned: dict = {}
    skip = tuple(m for m in MODALITIES if getattr(args, f"skip_{m}"))
    for name, m, tree, at in evaluate(spark, config, args.alignment, tuple(args.benchmark) if args.benchmark else None, args.domain, skip):
        print(show({k: tree[k] for k in tree if k != "files"}, f"{name}: {m}"))
        print(at)
        warned.setdefault(name, {})[m] = tree["warnings"]
    print(save_json(warned, args.report))
    return 0


if __name__ == "__main__":
    sys.exit(main())
