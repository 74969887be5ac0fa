"""Quality classifier: naive Bayes support vectors over byte n-grams.

Indicators of a text's byte 2- and 3-grams (hashed to DIMS) are scaled by the log-count ratio of the classes, and a linear
hinge-loss model is fitted to them by dual coordinate descent. Ratios come from every labelled training row; the fit takes a
seeded sample of at most about FIT_ROWS of them, a documented bound, on the driver. Scores are calibrated on a part of the
sample that the fit doesn't see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapgauge.llm.bytekit import flat, slices
from mapgauge.llm.common import fresh, stored, table, text_of

DIMS = 1 << 16
FIT_ROWS = 5_000
#: Labels that may be broadcast: 16 bytes each.
FEW_LABELS = 1_000_000
EPOCHS = 12
COST = 0.1
SMOOTH = 1.0
FOLDS, HELD_OUT = 3, 1


def indicators(data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's distinct features, in order. Works on slices of bounded size."""
    for i, j in slices(off):
        yield from _indicators(data[off[i] : off[j]], off[i : j + 1] - off[i])


def _indicators(data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    seen = np.zeros(DIMS, bool)
    d = data.astype(np.uint32)
    two = (d[:-1] | d[1:] << np.uint32(8)) * np.uint32(0x9E3779B1) >> np.uint32(16)
    three = (d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)) * np.uint32(0x85EBCA77) >> np.uint32(16)
    for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        seen[two[i : j - 1] if j > i else two[:0]] = True
        seen[three[i : j - 2] if j > i + 1 else three[:0]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learned from: crc32 of the identifier as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


@dataclass
class Model:
    weights: np.ndarray  # float32, by feature; ratios included
    bias: float
    slope: float
    shift: float

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        margin = np.array([self.weights[f].sum(dtype=np.float64) for f in indicators(data, off)]) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, epochs: int = EPOCHS, cost: float = COST, seed: int = 5) -> tuple[np.ndarray, float]:
    """Minimises |w|^2 / 2 + sum of cost_i * hinge over rows scaled by ratio, with a bias feature of 1; classes weigh the same."""
    w, b, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    most = cost * len(y) / (2 * np.where(y > 0, max((y > 0).sum(), 1), max((y < 0).sum(), 1)))
    norm = np.array([float((ratio[r] ** 2).sum()) + 1 for r in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x = ratio[r]
            g = y[i] * (w[r] @ x + b) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), most[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[r] += step * x
                b += step
                moved = max(moved, abs(step) * norm[i] ** 0.5)
        if moved < 1e-3:
            break
    return w, b


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic of the margin, by a few damped Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * (a - 1), (p - t).sum()])
        v = p * (1 - p)
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum()]]) + np.eye(2) * 1e-6
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2 / max(abs(step).max(), 1e-12))
        a, c = a - step[0], c - step[1]
        if abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), c


def _counts(texts: DataFrame) -> DataFrame:
    """texts: text, label. feature, pos, neg: the rows of each class that have the feature; feature -1 is the rows themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros((2, DIMS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False).astype(int)
            for found, y in zip(indicators(*flat(batch.column(0))), labels, strict=True):
                seen[y][found] += 1
            total += np.bincount(labels, minlength=2)[:2]
        any_ = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(any_, -1).astype(np.int32)), pa.array(np.append(seen[1][any_], total[1])), pa.array(np.append(seen[0][any_], total[0]))], names=["feature", "pos", "neg"])

    return texts.select("text", "label").mapInArrow(run, "feature int, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", fit_rows: int = FIT_ROWS) -> Model:
    """Learns from rows of docs that have a label and aren't held out. Identifiers with several labels take their mean,
    rounded; null labels are ignored. Without labels of both classes the model is a constant: the smoothed share of 1."""
    known = labels.select(F.col(f"`{id_col}`").alias("l_id"), F.col(f"`{label_col}`").cast("double").alias("v")).where("v IS NOT NULL AND l_id IS NOT NULL")
    known = known.where(~held_out(F.col("l_id"))).groupBy("l_id").agg(F.when(F.avg("v") >= 0.5, 1).otherwise(0).alias("label"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")).where(~held_out(F.col("id")))
    # labels that meet a document, found by identifiers alone; texts are moved only to more of them than may be broadcast
    known = stored(known.join(texts.select(F.col("id").alias("l_id")), "l_id", "left_semi"))
    known = F.broadcast(known) if known.count() <= FEW_LABELS else known
    counted = {r["feature"]: (r["pos"], r["neg"]) for r in _counts(texts.join(known, F.col("id") == F.col("l_id"))).collect()}
    pos, neg = counted.pop(-1, (0, 0))
    if not pos or not neg:
        share = (pos + 1) / (pos + neg + 2)
        return Model(np.zeros(DIMS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    p, q = np.full(DIMS, SMOOTH), np.full(DIMS, SMOOTH)
    at = np.fromiter(counted, np.int64, len(counted))
    both = np.array(list(counted.values())).reshape(-1, 2)
    p[at] += both[:, 0]
    q[at] += both[:, 1]
    ratio = np.log((p / (pos + 2 * SMOOTH)) / (q / (neg + 2 * SMOOTH)))
    ratio[np.setdiff1d(np.arange(DIMS), at)] = 0
    # a seeded sample of each class, of equal expected size where there are enough rows
    shares = [min(1.0, fit_rows / 2 / n) for n in (neg, pos)]
    draw = F.pmod(F.xxhash64(F.lit(11), "l_id"), F.lit(1_000_000)) / 1e6
    few = known.where(draw < F.when(F.col("label") == 1, shares[1]).otherwise(shares[0]))
    # a table broken up by repeated identifiers could give more rows than labels: the sample has the first of each
    # the sample is bounded by fit_rows, whatever the table's size
    sample = texts.join(F.broadcast(few), F.col("id") == F.col("l_id")).groupBy("l_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [f.astype(np.uint16).tobytes() for f in indicators(*flat(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["l_id", "label", "found"])

    rows = sample.mapInArrow(featured, f"l_id {known.schema['l_id'].dataType.simpleString()}, label int, found binary").orderBy("l_id").collect()
    x = [np.frombuffer(r["found"], np.uint16).astype(np.int64) for r in rows]
    y = np.array([1 if r["label"] else -1 for r in rows])
    last = np.arange(len(rows)) % 5 == 4
    if len(set(y[~last])) < 2 or len(set(y[last])) < 2:
        last[:] = False
    w, b = dual_descent([r for r, z in zip(x, last, strict=True) if not z], y[~last], ratio)
    scaled = w * ratio
    check = last if last.any() else ~last
    slope, shift = calibrate(np.array([scaled[r].sum() + b for r, z in zip(x, check, strict=True) if z]), y[check])
    return Model(scaled.astype(np.float32), float(b), float(slope), float(shift))


def score(docs: DataFrame, model: Model, text_col="text", into: str = "score") -> DataFrame:
    """docs with the model's score of each whole text (null: empty) as a column more."""
    keep = list(docs.columns)
    at = keep.index(text_col)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields) + f"`{into}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(*flat(batch.column(at))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*keep, into])

    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality") -> DataFrame:
    """A row a document: id, held_out, score, predicted. Empty texts are scored by the bias alone; empty tables give no
    rows; labels, language, source and identifier are no inputs of a score."""
    model = train(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")).withColumn("held_out", F.coalesce(held_out(F.col("id")), F.lit(False)))
    out = score(rows, model)
    return out.select(F.col("id").alias(id_col), "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality") -> DataFrame:
    """The rows of docs that the classifier accepts, columns as they are."""
    model = train(docs, labels, id_col, text_col, label_col)
    (name,) = fresh(docs, "score")
    return score(docs, model, text_col, name).where(F.col(name) >= 0.5).drop(name)


def op3_quality(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
