"""Packing of tokenised documents in the order of a space-filling curve.

A document's words are hashed to a vector of WIDTH log counts; its unit vector is projected to DIMS fixed directions and
quantised, and the cell's index along the Hilbert curve is its key. Documents are range-partitioned and sorted by that key,
so neighbours along the curve share sequences, and the stream of their tokens is cut every `length` ids: all sequences are
full but the last. Copies share a key; a hash of the row spreads them over partitions.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from mapgauge.llm.bytekit import SPACE, flat, slices, word_hashes
from mapgauge.llm.common import cut, table, text_of

LENGTH = 1024
WIDTH, DIMS, BITS = 256, 3, 16
END = 0
BLOCK = 500
BEYOND = re.compile("[^\x00-\u024f]")
#: Bytes of white space below U+0250, by any definition.
MAYBE_SPACE = SPACE.copy()
MAYBE_SPACE[[0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0xC2]] = True


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of each row of cells (n, dims), integers below 2**bits: the transpose form is reached
    by undoing rotations from the highest bit down, then by Gray decoding, and interleaved."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def _directions() -> np.ndarray:
    d = np.random.default_rng(23).standard_normal((WIDTH, DIMS))
    return d / np.linalg.norm(d, axis=0)


def curve_keys(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The Hilbert key of each text; texts without words lie at the centre."""
    h, at = word_hashes(data, off)
    n = len(off) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    counts = np.bincount(owner * WIDTH + (h >> np.uint64(56)).astype(np.int64), minlength=n * WIDTH).reshape(n, WIDTH)
    v = np.log1p(counts)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    z = v @ _directions() * np.sqrt(WIDTH) / 2
    cells = (2**BITS / (1 + np.exp(-1.7 * z))).astype(np.int64)
    return hilbert(np.clip(cells, 0, 2**BITS - 1))


def long_runs(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether a text may have a run of 2 * BLOCK bytes without ASCII white space, or of what may be white space below
    U+0250: such a run fills one of the blocks of BLOCK bytes. Runs may reach over texts, which marks some more."""
    out = np.zeros(len(off) - 1, bool)
    for i, j in slices(off):
        part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
        part = part[: len(part) // BLOCK * BLOCK].reshape(-1, BLOCK)
        spaces, maybe = (kind.view(np.uint8)[part].sum(axis=1, dtype=np.uint16) for kind in (SPACE, MAYBE_SPACE))
        for k in np.flatnonzero((spaces == 0) | (maybe == BLOCK)).tolist():
            first, last = np.searchsorted(at, [k * BLOCK, (k + 1) * BLOCK - 1], "right") - 1
            out[i + first : i + last + 1] = True
    return out


class Encoder:
    """Token ids of a text, as the `tokenizers` file gives them.

    A text of characters below U+0250 goes through the same vocabulary's rank file where there is one, which gives the same
    ids (held by a test) in a third of the time; any other text goes through `tokenizers` itself, and so does one with a
    special token's string, and one of long_runs, which the rank file's encoder takes quadratic time or unbounded stack for.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks and pattern:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})

    def __call__(self, text: str, long_run: bool) -> list[int]:
        if self.fast is not None and not long_run and (text.isascii() or not BEYOND.search(text)) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


_encoders: dict[tuple, Encoder] = {}


def _encoder(*args) -> Encoder:
    if args not in _encoders:
        _encoders[args] = Encoder(*args)
    return _encoders[args]


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, id_col="doc_id", text_col="text", length: int = LENGTH) -> DataFrame:
    """Pieces of sequences: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and curve_key.

    A document is its token ids and id 0; null text is empty, so its only id is 0. Each id lies in one piece. A repeated row
    is packed as often as it occurs. An empty table gives no rows; other columns are ignored. tokenizer is the path of a
    `tokenizers` file on every executor.
    """
    kept = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    kept = kept.withColumn("tie", F.xxhash64("id", "text"))
    id_type = kept.schema["id"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column(1))
            keys = [curve_keys(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in slices(off)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]), pa.int64())], names=["id", "text", "tie", "curve"])

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pid, start = _encoder(tokenizer, ranks, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, sizes = [], []
            for text, long_run in zip(batch.column(1), long_runs(*flat(batch.column(1))).tolist(), strict=True):
                a = np.array([*encode(text.as_py(), long_run), END], np.uint32)
                sizes.append(len(a))
                ids.append((a.astype(np.uint16) if a.max() < 65536 else a).tobytes())
            begin = start + np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            start = int(begin[-1])
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(np.full(n, pid), pa.int32()), pa.array(begin[:n], pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names=["id", "curve", "pid", "begin", "n", "ids"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, sizes = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            rows: list[tuple] = []
            which: list[int] = []
            for i, (b, n, raw) in enumerate(zip(begins.tolist(), sizes.tolist(), batch.column(4), strict=True)):
                raw = raw.as_py()
                a = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype("<u4")
                s = 0
                while s < n:
                    k = min(n - s, length - (b + s) % length)
                    rows.append((s, k, zlib.crc32(a[s : s + k].tobytes()), n, (b + s) // length, (b + s) % length))
                    which.append(i)
                    s += k
            cols = list(zip(*rows, strict=True)) or [()] * 6
            take = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), *(pa.array(c, pa.int64()) for c in cols), batch.column(1).take(take)], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key"])

    ordered = kept.mapInArrow(keyed, f"id {id_type}, text string, tie long, curve long").repartitionByRange("curve", "tie").sortWithinPartitions("curve", "tie", "id")
    rows = cut(ordered.mapInArrow(tokenised, f"id {id_type}, curve long, pid int, begin long, n long, ids binary"))
    totals = rows.groupBy("pid").agg(F.sum("n").alias("total"))
    # one row a partition of the sort
    before = F.coalesce(F.sum("total").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(F.broadcast(totals.select("pid", before.alias("before"))), "pid").select("id", "curve", (F.col("begin") + F.col("before")).alias("begin"), "n", "ids")
    out = placed.mapInArrow(pieces, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long")
    return out.withColumnRenamed("id", id_col)


def public_files() -> dict:
    """The public byte-level vocabulary of the box, for the registered query."""
    import public_tokenizers as P

    return {"tokenizer": P.path("byte_bpe_50k.json"), "ranks": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


def op5_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), **public_files())
