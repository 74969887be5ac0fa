"""Result publication: long table to tree, JSON to a folder or into a zip archive."""

from __future__ import annotations

import json
import math
import os
import zipfile
from pathlib import Path
from typing import Any


def clean(node: Any) -> Any:
    """The tree without None, non-finite numbers and empty dicts; lists keep their length, dicts in them are cleaned."""
    if isinstance(node, dict):
        kept = {k: clean(v) for k, v in node.items()}
        return {k: v for k, v in kept.items() if v is not None and v != {} and not (isinstance(v, float) and not math.isfinite(v))}
    if isinstance(node, (list, tuple)):
        return [clean(v) if isinstance(v, dict) else v for v in node]
    return node


def set_value(tree: dict, hierarchy: list[str], file_id: str, value: Any) -> dict:
    """Writes value for a file id below a hierarchy, creating levels; a second write replaces the first."""
    node = tree
    for level in hierarchy:
        node = node.setdefault("children", {}).setdefault(level, {})
    files = node.setdefault("files", [])
    for f in files:
        if f["id"] == file_id:
            f["metrics"] = value
            return tree
    files.append({"id": file_id, "metrics": value})
    return tree


#: Per-image columns that aren't results.
KEYS = ("img", "space")


def file_tree(rows, modality: str) -> dict:
    """Per-image results (rows with img, a path of levels and file id, and perhaps space) as a tree of levels and files, each
    file's metrics under the names that the whole's have: <modality>.eval.<space>. rows may be an iterator; the tree itself
    is one JSON document, so it holds a few numbers a file."""
    out: dict = {}
    seen: dict = {}
    for r in rows:
        r = r.asDict() if hasattr(r, "asDict") else dict(r)
        *levels, name = [x for x in str(r["img"]).split("/") if x] or [""]
        metrics = seen.get((*levels, name))
        if metrics is None:
            metrics = seen[(*levels, name)] = {modality: {"eval": {}}}
            set_value(out, levels, name, metrics)
        node = metrics[modality]["eval"]
        if r.get("space"):
            node = node.setdefault(r["space"], {})
        node.update({k: v for k, v in r.items() if k not in KEYS})
    return out


def show(tree: dict, title: str) -> str:
    """The tree as indented text, floats with six decimals."""
    lines = ["=" * 60, title, "=" * 60]

    def down(node: dict, depth: int) -> None:
        for k, v in node.items():
            if isinstance(v, dict):
                lines.append(f"{'  ' * depth}{k}:")
                down(v, depth + 1)
            else:
                lines.append(f"{'  ' * depth}{k}: " + (f"{v:.6f}" if isinstance(v, float) else str(v)))

    down(tree, 0)
    return "\n".join(lines)


def to_tree(rows: list) -> dict:
    """modality, space, category, reduction, bin, metric, value rows as <modality>.eval.<space>.<category>..., empty
    dimensions left out."""
    out: dict = {}
    for r in rows:
        node = out.setdefault(r["modality"], {}).setdefault("eval", {})
        for part in (r["space"], r["category"], r["reduction"], r["bin"]):
            if part:
                node = node.setdefault(part, {})
        *path, last = r["metric"].split(".")
        for part in path:
            node = node.setdefault(part, {})
        node[last] = r["value"]
    return clean(out)


def zip_ancestor(path: str | os.PathLike) -> Path | None:
    """The zip archive on the way to path, if there is one."""
    p = Path(path)
    return next((x for x in (p, *p.parents) if x.suffix == ".zip"), None)


def save_json(tree: dict, path: str | os.PathLike) -> Path:
    """Writes JSON to a file, or as an entry of the archive that the path leads into; an entry of that name is replaced."""
    text = json.dumps(clean(tree), indent=2)
    archive = zip_ancestor(path)
    if archive is None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text)
        return Path(path)
    entry = str(Path(path).relative_to(archive)) if Path(path) != archive else "eval.json"
    old: list[tuple[zipfile.ZipInfo, bytes]] = []
    if archive.exists():
        with zipfile.ZipFile(archive) as z:
            if entry not in z.namelist():
                z.close()
                with zipfile.ZipFile(archive, "a") as a:
                    a.writestr(entry, text)
                return archive
            old = [(i, z.read(i)) for i in z.infolist() if i.filename != entry]
    part = archive.with_suffix(".zip.part")
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
        for info, body in old:
            z.writestr(info, body)
        z.writestr(entry, text)
    part.replace(archive)
    return archive


def output_path(config: dict, modality: str) -> Path:
    """output_file with the modality in its name, else eval.json beside the modality's data, else the first modality's."""
    if config.get("output_file"):
        p = Path(config["output_file"])
        return p.with_name(f"{p.stem}.{modality}{p.suffix or '.json'}")
    for m in (modality, "depth", "rgb", "rays"):
        if config.get(m):
            return Path(config[m].get("path", config[m]) if isinstance(config[m], dict) else config[m]) / "eval.json"
    return Path("eval.json")
