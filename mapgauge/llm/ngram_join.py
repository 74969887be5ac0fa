"""Jaccard self-join over word shingles by universe partitioning and the pigeonhole principle, verified exactly.

Two sets of sizes a <= b with Jaccard similarity of PERCENT / 100 or more differ in at most (a + b) / 9 elements (for 80).
Sizes are banded by powers of two. In the band of the larger set the universe of shingles is hashed into m segments. With
H differences at most, of any H + 1 non-empty segments of a set one at least is equal in its partner: each segment's content
is a signature. A set of the band below takes part in the next band's scheme if a partner can lie there.

Allocation by cost: a large set uses segments of few elements, one signature each, and of these only as many as its own
bound needs (with a margin, HEADROOM). A small set uses few segments, and for each the content and all contents with one
element deleted: such a segment finds one difference more, so half as many are needed. Empty segments say nothing and are
never indexed; what they take from the guarantee is counted for each set, and sets for which it fails also index the prefix
of their elements in hash order, which every linked pair of such sets shares. Signatures of a single set are dropped at
once, and of the others each set drops its most frequent ones, as many as its margin allows (components.link_buckets). Sets
that meet in a signature are compared there by narrow parity sketches, which bound their differences from below; the pairs
left by wider sketches, and then by their elements.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapgauge.llm.bytekit import distinct, flat, mix, shingles, slices, word_hashes
from mapgauge.llm.common import LOWER, UPPER, WORD, discard, fresh, quoted, stored, table, text_of
from mapgauge.llm.components import link_buckets

WORDS = 5
PERCENT = 80
HEADROOM = 1.3
#: Steps of size in a band; sets of one step use the same segments.
STEPS = 8
#: Longs of the sketch that is compared inside a key.
WIDE = 8
#: So many pairs may be broadcast: 48 bytes each.
FEW_PAIRS = 100_000
#: Bands below this use one-deletion neighbourhoods.
SMALL = 32


def bound(a: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Most differences between a set of size a and a partner of size up to most."""
    b = np.minimum(100 * a // PERCENT, most)
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def step_of(a: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Which of the STEPS equal ratios of the band [base, 2 base) the size a lies in; sizes below the band have negative ones."""
    return np.floor(STEPS * np.log2(a / base) + 1e-9).astype(np.int64)


def step_sizes(step: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest size that may lie in a step, with one to spare."""
    low = np.floor(base * 2.0 ** (step / STEPS)).astype(np.int64)
    return np.maximum(low, 1), np.minimum(np.ceil(base * 2.0 ** ((step + 1) / STEPS)).astype(np.int64), 2 * base - 1)


def scheme(step: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sets in a step of the band [base, 2 base): segments m, and how many of them each of these sets uses."""
    low, high = step_sizes(step, base)
    top = bound(2 * base - 1, 2 * base - 1)
    m = np.where(base < SMALL, top // 2 + 1, np.ceil(top * 1.4).astype(np.int64) + 1)
    filled = 1 - np.exp(-low / m)
    use = np.ceil(HEADROOM * (bound(high, 2 * base - 1) + 1) / filled).astype(np.int64) + 1
    return m, np.where(base < SMALL, m, np.minimum(m, use))


def _sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, owner = shingles(*word_hashes(data, off), WORDS)
    return distinct(values, owner, len(off) - 1)


def class_ids(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; equal sets have equal ones."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(v ^ np.uint64(0x51ED270B9F3C6A11)))])
    return mix((sums[at[1:]] - sums[at[:-1]]) ^ (np.diff(at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


def signatures(v: np.ndarray, at: np.ndarray, only_counts: bool = False):
    """Signature keys of sets and their owners; and for each set and role (own band, next band) the segments used, those
    that aren't empty, the bound and the slack: how many keys may be passed over (-1: the guarantee fails, -2: no role)."""
    size = np.diff(at).astype(np.int64)
    n = len(size)
    facts = np.zeros((2, 4, n), np.int64)
    facts[:, 3] = -2
    keys, owners = [], []
    weak_any = np.zeros(n, bool)
    band = 1 << np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
    spread = mix(v.copy())
    for role in (0, 1):
        base = band << role
        takes = (size >= 4) if role == 0 else (size >= 4) & (100 * size // PERCENT >= base)
        who = np.flatnonzero(takes)
        if not len(who):
            continue
        own, base_of = step_of(size[who], base[who]), base[who]
        m, use = scheme(own, base_of)
        h = bound(size[who], 2 * base_of - 1)
        place = np.full(n, -1, np.int64)
        first = np.concatenate([[0], np.cumsum(use)])
        place[who] = np.arange(len(who))
        owner = np.repeat(np.arange(n), size)
        k = place[owner]
        in_role = np.flatnonzero(k >= 0)
        k = k[in_role]
        seg = ((spread[in_role] >> np.uint64(32)) * m[k].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        used = seg < use[k]
        k, seg, element = k[used], seg[used], spread[in_role[used]]
        cell = first[k] + seg
        content = np.zeros(first[-1], np.uint64)
        element = mix(element ^ np.uint64(0x2545F4914F6CDD1D))
        np.add.at(content, cell, element)
        count = np.bincount(cell, minlength=first[-1])
        set_of = np.repeat(np.arange(len(who)), use)
        tag = mix((base[who][set_of].astype(np.uint64) << np.uint64(32)) + (np.arange(first[-1]) - first[set_of]).astype(np.uint64))
        small = base[who] < SMALL
        filled = np.bincount(set_of[count > 0], minlength=len(who))
        weight = np.where(small, np.bincount(set_of, np.minimum(count, 2), len(who)).astype(np.int64), filled)
        # a partner may use fewer segments: of those that both use, the worst case over the steps it can lie in
        upto = np.concatenate([[0], np.cumsum(count > 0)])
        left = weight - h - 1
        for away in range(-STEPS // 2, STEPS // 2 + 1):
            low, high = step_sizes(own + away, base_of)
            largest = np.minimum(high, 100 * size[who] // PERCENT)
            can = ~small & (100 * largest >= PERCENT * size[who]) & (low <= largest) & (100 * high >= PERCENT * base_of)
            common = np.minimum(use, scheme(own + away, base_of)[1])
            found = upto[first[:-1] + common] - upto[first[:-1]] - (size[who] + largest) * (100 - PERCENT) // (100 + PERCENT) - 1
            left = np.where(can, np.minimum(left, found), left)
        slack = np.where(left < 0, -1, np.where(small, left // 2, left))
        facts[role][:, who] = use, filled, h, slack
        weak_any[who] |= left < 0
        if only_counts:
            continue
        has = count > 0
        keys.append(mix(content[has] + count[has].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + tag[has]))
        owners.append(who[set_of[has]])
        drop = np.flatnonzero(small[k] & (count[cell] > 1))
        if len(drop):
            c = cell[drop]
            keys.append(mix(content[c] - element[drop] + (count[c] - 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + tag[c]))
            owners.append(who[k[drop]])
    if only_counts:
        return facts
    for i in np.flatnonzero(weak_any):
        most = size[i] - (PERCENT * size[i] + 99) // 100 + 1
        keys.append(mix(v[at[i] : at[i] + most] ^ np.uint64(0xA24BAED4963EE407)))
        owners.append(np.full(most, i))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def narrow(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The parity of each set's elements in 64 * WIDE buckets, as WIDE longs a set."""
    n, wide = len(at) - 1, 64 * WIDE
    out = np.zeros((n, WIDE), np.int64)
    bucket = (mix(v ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.int64) % wide
    for i in range(0, n, 4096):
        j = min(n, i + 4096)
        owner = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
        odd = np.bincount(owner * wide + bucket[at[i] : at[j]], minlength=(j - i) * wide) & 1
        out[i:j] = np.packbits(odd.astype(np.uint8).reshape(j - i, wide), axis=1, bitorder="little").view(np.int64)
    return out


def may_link(a: str, b: str) -> Column:
    """Whether sizes and narrow sketches allow a link: each bucket whose parities differ holds a difference at least."""
    odd = sum((F.bit_count(F.col(f"{a}p{i}").bitwiseXOR(F.col(f"{b}p{i}"))) for i in range(1, WIDE)), F.bit_count(F.col(f"{a}p0").bitwiseXOR(F.col(f"{b}p0"))))
    x, y = F.col(f"{a}n"), F.col(f"{b}n")
    return (100 * F.least(x, y) >= PERCENT * F.greatest(x, y)) & (odd * (100 + PERCENT) <= (x + y) * (100 - PERCENT))


def _light(rows: DataFrame) -> DataFrame:
    """rows: id, th, text. id, th, n (set size), node (class), the facts of both roles, and the narrow sketch."""
    names = [f"{f}{r}" for r in (0, 1) for f in ("use", "filled", "bound", "slack")]
    sketch = [f"p{i}" for i in range(WIDE)]
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column(2))
            for i, j in slices(off):
                v, at = _sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                facts = signatures(v, at, only_counts=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(at), pa.int64()), pa.array(class_ids(v, at)), *(pa.array(facts[r][f], pa.int32()) for r in (0, 1) for f in range(4)), *(pa.array(np.ascontiguousarray(c)) for c in narrow(v, at).T)], names=["id", "th", "n", "node", *names, *sketch])

    return rows.mapInArrow(run, f"id {id_type}, th long, n long, node long, " + ", ".join([*(f"{x} int" for x in names), *(f"{x} long" for x in sketch)]))


def _signature_rows(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column(0))
            for i, j in slices(off):
                v, at = _sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                keys, owner = signatures(v, at)
                node = class_ids(v, at)[owner]
                for s in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[s : s + 100_000].view(np.int64)), pa.array(node[s : s + 100_000])], names=["key", "node"])

    return rows.select("text").mapInArrow(run, "key long, node long")


def parity(v: np.ndarray) -> bytes:
    """One bit for each of M buckets, a power of two of at least four a element: whether its elements are odd in number."""
    m = max(64, 1 << int(4 * len(v) - 1).bit_length())
    return np.packbits(np.bincount((mix(v ^ np.uint64(0x8EBC6AF09C88C6E3)) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1, bitorder="little").tobytes()


def differences(x: bytes, y: bytes) -> int:
    """A lower bound on the differences of two sets from their parities: each bucket whose parities differ holds one at
    least. The larger sketch is folded to the buckets of the smaller."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def _set_rows(rows: DataFrame) -> DataFrame:
    """rows: text, node. The shingle set of each text that has this class, as sorted 64-bit hashes, and its parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column(0))
            want = batch.column(1).to_numpy()
            for i, j in slices(off):
                v, at = _sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                ok = np.flatnonzero(class_ids(v, at) == want[i:j])
                yield pa.RecordBatch.from_arrays([pa.array(want[i:j][ok]), pa.array([v[at[k] : at[k + 1]].tobytes() for k in ok], pa.binary()), pa.array([parity(v[at[k] : at[k + 1]]) for k in ok], pa.binary())], names=["node", "elements", "sketch"])

    return rows.mapInArrow(run, "node long, elements binary, sketch binary")


def _meet(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """a, b, most, x, y: what both sets of each pair have in this column. They meet in one shuffle; few pairs (counted
    here) are sent to the sets and not the sets to them."""
    ends = pairs.select("a", "b", "most", F.explode(F.array("a", "b")).alias("node"))
    ends = F.broadcast(ends) if pairs.count() <= FEW_PAIRS else ends
    both = sets.select("node", column).join(ends, "node")
    return both.groupBy("a", "b", "most").agg(F.min(column).alias("x"), F.max(column).alias("y")).select("a", "b", "x", "y", "most")


def _not_far(joined: DataFrame) -> DataFrame:
    """joined: a, b, x, y (the sketches), most. The pairs that don't surely differ in more than `most` elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([differences(x.as_py(), y.as_py()) <= most.as_py() for x, y, most in zip(batch.column(2), batch.column(3), batch.column(4), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in (0, 1, 4)], names=["a", "b", "most"])

    return joined.mapInArrow(run, "a long, b long, most long")


def _overlaps(joined: DataFrame) -> DataFrame:
    """joined: a, b, x, y (the elements). The pairs whose similarity suffices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                p, q = (p, q) if len(p) < len(q) else (q, p)
                at = np.minimum(np.searchsorted(q, p), max(len(q) - 1, 0))
                both = int((q[at] == p).sum()) if len(q) else 0
                ok[i] = both > 0 and 100 * both >= PERCENT * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """A row a document: id, n_shingles, component_id, and th (a hash of its text, to tell repeated identifiers apart).

    Words are lower-cased in A-Z; a set is the distinct 5-word shingles, of a shorter text the whole sequence; texts without
    words and null texts have the empty set and are linked with nothing. Sets are compared by 64-bit shingle hashes. Equal
    sets are one class throughout, so copies never make pairs. component_id is the smallest identifier reachable. An empty
    table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    light = stored(_light(rows.withColumn("th", F.xxhash64("text")).select("id", "th", "text")))
    facts = [c for c in light.columns if c not in ("id", "th", "n", "node")]
    sketch = [c for c in facts if c.startswith("p")]
    classes = light.where("n > 0").groupBy("node").agg(F.min("id").alias("first"), F.min("n").alias("n"), *[F.min(c).alias(c) for c in facts])
    classes = stored(classes)
    shared = Window.partitionBy("key")
    found = _signature_rows(rows).withColumns({"lo": F.min("node").over(shared), "hi": F.max("node").over(shared)})
    members = stored(found.where("lo <> hi").select("key", "node").distinct())
    # a linked pair shares more signatures than either set may miss: sets that share fewer with all others together are out
    slack = classes.select("node", F.least(F.when(F.col("slack0") > -2, F.col("slack0")), F.when(F.col("slack1") > -2, F.col("slack1"))).alias("slack"))
    enough = members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(slack, "node").where("n > slack").select("node")
    all_members, members = members, stored(members.join(enough, "node"))
    discard(all_members)
    # the elements of all sets that share a signature with another
    wanted = members.select("node").distinct().join(classes, "node").select("first", "node")
    elements = stored(_set_rows(rows.join(wanted, F.col("id").eqNullSafe(F.col("first"))).select("text", "node")))
    known = classes.drop("first", *sketch)

    def verify(pairs: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(known.select(*[F.col(c).alias(end if c == "node" else f"{end}_{c}") for c in known.columns]), end)
        larger, smaller = F.greatest("a_n", "b_n"), F.least("a_n", "b_n")
        # of the segments that the set with fewer uses, so many must agree; bands with deletions aside
        base = F.pow(F.lit(2.0), F.floor(F.log2(larger.cast("double"))))
        for end in ("a", "b"):
            own = F.col(f"{end}_n") >= base
            for f in ("use", "filled", "slack"):
                pairs = pairs.withColumn(f"{end}_{f}", F.when(own, F.col(f"{end}_{f}0")).otherwise(F.col(f"{end}_{f}1")))
        differ = F.floor((larger + smaller) * (100 - PERCENT) / (100 + PERCENT))
        must = F.when(F.col("a_use") <= F.col("b_use"), F.col("a_filled")).otherwise(F.col("b_filled")) - differ
        # by each set's own bound, in all bands: one key more than may be dropped
        must = F.greatest(F.when(base >= SMALL, must), F.greatest("a_slack", "b_slack") + 1)
        enough = F.coalesce(F.col("shared") >= must, F.lit(True))
        pairs = stored(pairs.where((100 * smaller >= PERCENT * larger) & enough).select("a", "b", differ.cast("long").alias("most")))
        # sketches of half a byte an element leave few pairs beside the true ones
        pairs = stored(_not_far(_meet(pairs, elements, "sketch")))
        return _overlaps(_meet(pairs, elements, "elements"))

    _, labels = link_buckets(members, verify, classes.select("node", "n", *sketch), may_link, slack)
    discard(members, elements)
    if labels is None:
        ends = classes.select(F.col("node").alias("c_node"), F.col("first").alias("component"))
    else:
        ends = classes.select("node", "first").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = ends.groupBy("comp").agg(F.min("first").alias("component"))
        ends = ends.join(least, "comp").select(F.col("node").alias("c_node"), "component")
    out = light.join(ends, (F.col("node") == F.col("c_node")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"), "th")


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of docs that stay, all columns: of each component the document with the smallest identifier; of rows with
    that identifier and the same text one. Documents without words all stay."""
    found = stored(jaccard_components(docs, id_col, text_col))
    d_id, d_th, th = fresh(docs, "d_id", "d_th", "text_hash")
    gone = found.where(~F.col(f"`{id_col}`").eqNullSafe(F.col("component_id"))).select(F.col(f"`{id_col}`").alias(d_id), F.col("th").alias(d_th)).distinct()
    marked = docs.withColumn(th, F.xxhash64(text_of(text_col)))
    stay = marked.join(gone, marked[f"`{id_col}`"].eqNullSafe(F.col(d_id)) & (F.col(th) == F.col(d_th)), "left_anti")
    twice = found.where("n_shingles > 0").groupBy(F.col(f"`{id_col}`").alias(d_id), F.col("th").alias(d_th)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if twice.isEmpty():
        return stay.drop(th)
    same = stay[f"`{id_col}`"].eqNullSafe(F.col(d_id)) & (F.col(th) == F.col(d_th))
    once = stay.join(twice, same, "left_semi").dropDuplicates([id_col, th])
    return stay.join(twice, same, "left_anti").unionByName(once).select(*quoted(docs.columns))


def op9_ngram_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents")).drop("th")


#: The same by a plain join of all shingles, and components by walking along links.
ORACLE = f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
    i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WORDS - 2}, 2))) AS k FROM w WHERE len(ws) > 0),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + {WORDS - 1}], ' ') AS shingle FROM i),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * both_ >= {PERCENT} * (x.n + y.n - both_)),
    r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
    SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""
