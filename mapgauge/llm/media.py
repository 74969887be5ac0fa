"""Baseline JPEG columns: a lossless store for payload bytes, and thumbnails decoded from the stored bytes.

Reading follows the format: markers are parsed, each scan is Huffman-decoded with the tables that the file defines, and the
luminance DC coefficients, dequantised, make a thumbnail of one pixel a block. Scans are decoded in lockstep: all restart
intervals of all images of a batch advance by one symbol at a time, each a lane of numpy arrays.

Writing stores a payload in the quantised coefficients of a grey image, 64 bytes a block in zigzag order: byte b is the
coefficient of magnitude category 8 whose extra bits are b, so every coefficient is one Huffman code of length one and
eight bits, and every block is a restart interval of its own. A comment segment holds the payload's length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mapgauge.llm.bytekit import flat, slices

BLOCK = 64
BATCH_BYTES = 1 << 20
#: Side of the thumbnail that is hashed.
THUMB = 8
LENGTH_TAG = b"payload-bytes:"


@dataclass
class Image:
    """What a file's markers say. error is set if it isn't a baseline JPEG that this decoder reads."""

    width: int = 0
    height: int = 0
    components: list = field(default_factory=list)  # id, horizontal, vertical sampling, quantisation table
    quant: dict = field(default_factory=dict)
    dc: dict = field(default_factory=dict)
    ac: dict = field(default_factory=dict)
    restart: int = 0
    scan: list = field(default_factory=list)  # component index, dc table, ac table
    intervals: np.ndarray | None = None  # byte ranges of the entropy-coded data, (n, 2)
    comments: list = field(default_factory=list)
    error: str = ""


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits that may follow: code length << 8 | symbol; 0 where no code fits."""
    out, code, k = np.zeros(65536, np.int64), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            lo = code << (16 - length)
            out[lo : lo + (1 << (16 - length))] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


_tables: dict[bytes, np.ndarray] = {}


def parse(body: bytes) -> Image:
    """Markers of a baseline JPEG up to the end of its first scan. Bad input gives an Image with an error."""
    im = Image()
    if body[:2] != b"\xff\xd8":
        im.error = "no start of image"
        return im
    p = 2
    try:
        while True:
            while body[p] == 0xFF and body[p + 1] == 0xFF:
                p += 1
            if body[p] != 0xFF:
                raise ValueError("marker expected")
            kind = body[p + 1]
            if kind == 0xD9:
                raise ValueError("no scan")
            size = int.from_bytes(body[p + 2 : p + 4], "big")
            seg, p = body[p + 4 : p + 2 + size], p + 2 + size
            if len(seg) != size - 2:
                raise ValueError("cut off")
            if kind == 0xDB:
                while seg:
                    wide = seg[0] >> 4
                    n = 128 if wide else 64
                    im.quant[seg[0] & 15] = np.frombuffer(seg[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                    seg = seg[1 + n :]
            elif kind == 0xC4:
                while seg:
                    n = sum(seg[1:17])
                    key = seg[1 : 17 + n]
                    if key not in _tables:
                        if len(_tables) > 256:
                            _tables.clear()
                        _tables[key] = _lookup(seg[1:17], seg[17 : 17 + n])
                    (im.ac if seg[0] >> 4 else im.dc)[seg[0] & 15] = _tables[key]
                    seg = seg[17 + n :]
            elif kind in (0xC0, 0xC1):
                if seg[0] != 8:
                    raise ValueError("not 8 bits a sample")
                im.height, im.width = int.from_bytes(seg[1:3], "big"), int.from_bytes(seg[3:5], "big")
                im.components = [(seg[6 + 3 * i], seg[7 + 3 * i] >> 4, seg[7 + 3 * i] & 15, seg[8 + 3 * i]) for i in range(seg[5])]
            elif 0xC2 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
                raise ValueError("not baseline")
            elif kind == 0xDD:
                im.restart = int.from_bytes(seg[:2], "big")
            elif kind == 0xFE:
                im.comments.append(bytes(seg))
            elif kind == 0xDA:
                ids = [c[0] for c in im.components]
                im.scan = [(ids.index(seg[1 + 2 * i]), seg[2 + 2 * i] >> 4, seg[2 + 2 * i] & 15) for i in range(seg[0])]
                break
        if not im.width or not im.height or not im.scan or im.scan[0][0] != 0 or len(im.scan) != len(im.components):
            raise ValueError("no frame, or a scan of some components only")
        if any(im.components[c][3] not in im.quant or d not in im.dc or a not in im.ac for c, d, a in im.scan):
            raise ValueError("a table is missing")
    except (ValueError, IndexError) as e:
        im.error = str(e) or "cut off"
        return im
    a = np.frombuffer(body, np.uint8)
    ff = np.flatnonzero(a[p:-1] == 0xFF) + p
    after = a[ff + 1]
    marks = ff[(after != 0) & (after != 0xFF)]
    stop = marks[(a[marks + 1] & 0xF8) != 0xD0]
    end = int(stop[0]) if len(stop) else len(body)
    marks = marks[marks < end]
    im.intervals = np.stack([np.append(p, marks + 2), np.append(marks, end)], axis=1)
    return im


def _units(im: Image) -> tuple[np.ndarray, int, int]:
    """The blocks of an MCU as rows (component, dc table, ac table), and the MCUs across and down."""
    if len(im.scan) == 1:
        return np.array([im.scan[0]]), -(-im.width // 8), -(-im.height // 8)
    h, v = max(c[1] for c in im.components), max(c[2] for c in im.components)
    return np.array([s for s in im.scan for _ in range(im.components[s[0]][1] * im.components[s[0]][2])]), -(-im.width // (8 * h)), -(-im.height // (8 * v))


def _windows(data: np.ndarray) -> np.ndarray:
    """The 64 bits that start at each byte; beyond the end come ones."""
    d = np.concatenate([data, np.full(16, 0xFF, np.uint8)])
    out = np.zeros(len(data) + 8, np.uint64)
    for i in range(8):
        out |= d[i : i + len(out)].astype(np.uint64) << np.uint64(56 - 8 * i)
    return out


#: By magnitude category: values below half of the range are negative, and how far.
_HALF = np.array([0, *(1 << (s - 1) for s in range(1, 16))])
_FULL = np.array([0, *((1 << s) - 1 for s in range(1, 16))])


def decode(bodies: list[bytes], images: list[Image], keep: bool = True) -> list[np.ndarray | None]:
    """Quantised coefficients of each image's scan: int16 (blocks in scan order, 64 in zigzag order); None where it has an
    error or its data break off. With keep False only the DC coefficients are kept: (blocks, 1)."""
    tables: list[np.ndarray] = []
    at: dict[int, int] = {}

    def number(t: np.ndarray) -> int:
        if id(t) not in at:
            at[id(t)] = len(tables)
            tables.append(t)
        return at[id(t)]

    parts, base, total = [], 0, 0
    lane_bit, lane_end, lane_out, lane_blocks, lane_im, lane_kinds = [], [], [], [], [], []
    plans: list[np.ndarray] = []
    firsts: list[int | None] = []
    seen_plans: dict[tuple, int] = {}
    for n, (body, im) in enumerate(zip(bodies, images, strict=True)):
        if im.error:
            firsts.append(None)
            continue
        units, across, down = _units(im)
        mcus = across * down
        each = im.restart or mcus
        if len(im.intervals) < -(-mcus // each):
            im.error = "scan data break off"
            firsts.append(None)
            continue
        plan = tuple((int(c), number(im.dc[int(d)]), number(im.ac[int(a)])) for c, d, a in units)
        if plan not in seen_plans:
            seen_plans[plan] = len(plans)
            plans.append(np.array(plan))
        lo = im.intervals[0][0]
        a = np.frombuffer(body, np.uint8)[lo : im.intervals[-1][1]]
        stuffed = np.zeros(len(a), bool)
        stuffed[1:] = (a[1:] == 0) & (a[:-1] == 0xFF)
        gone = np.concatenate([[0], np.cumsum(stuffed)])
        k = im.intervals[: -(-mcus // each)] - lo
        k = k - gone[k] + base
        parts.append(a[~stuffed])
        base += len(parts[-1])
        m = len(k)
        blocks = np.full(m, each * len(units))
        blocks[-1] = (mcus - each * (m - 1)) * len(units)
        lane_bit.append(k[:, 0] * 8)
        lane_end.append(k[:, 1] * 8)
        lane_out.append(total + np.concatenate([[0], np.cumsum(blocks)[:-1]]))
        lane_blocks.append(blocks)
        lane_im.append(np.full(m, n))
        lane_kinds.append(np.full(m, seen_plans[plan]))
        firsts.append(total)
        total += int(blocks.sum())
    if not parts:
        return [None] * len(bodies)
    windows = _windows(np.concatenate(parts))
    bit, end, out, left, owner, kind = (np.concatenate(x).astype(np.int64) for x in (lane_bit, lane_end, lane_out, lane_blocks, lane_im, lane_kinds))
    longest = max(len(p) for p in plans)
    unit_of = np.zeros((len(plans), longest, 3), np.int64)
    period = np.array([len(p) for p in plans])
    for i, p in enumerate(plans):
        unit_of[i, : len(p)] = p
    lut = np.concatenate(tables)
    coef = np.zeros(total * (64 if keep else 1), np.int16)
    bad = np.zeros(len(bodies), bool)
    pred = np.zeros((len(bit), 4), np.int64)
    unit, k = np.zeros(len(bit), np.int64), np.zeros(len(bit), np.int64)
    plain = longest == 1 and len(plans) == 1  # one component and one set of tables: the common case needs fewer look-ups
    while len(bit):
        first = k == 0
        any_first = bool(first.any())
        if plain:
            dc_at, ac_at, comp = unit_of[0, 0, 1], unit_of[0, 0, 2], 0
        else:
            u = unit_of[kind, unit]
            comp, dc_at, ac_at = u[:, 0], u[:, 1], u[:, 2]
        table = np.where(first, dc_at, ac_at) if any_first else ac_at
        top = windows[bit >> 3] << (bit & 7).astype(np.uint64)
        found = lut[(table << 16) + (top >> np.uint64(48)).astype(np.int64)]
        length, size, run = found >> 8, found & 15, (found >> 4) & 15
        if any_first:
            run = np.where(first, 0, run)
        wide = size.astype(np.uint64)
        value = (((top << length.astype(np.uint64)) >> np.uint64(1)) >> (np.uint64(63) - wide)).astype(np.int64)
        value -= np.where(value < _HALF[size], _FULL[size], 0)
        bit = bit + (length + size)
        k = k + run
        wrong = (length == 0) | (bit > end) | (size > 11) | (k > 63)
        if any_first:
            at_first = np.flatnonzero(first)
            c = comp if plain else comp[at_first]
            pred[at_first, c] += value[at_first]
            value[at_first] = pred[at_first, c]
        eob = (found & 255) == 0
        if any_first:
            eob &= ~first
        if keep:
            put = np.flatnonzero(~(eob | wrong)) if eob.any() or wrong.any() else slice(None)
            coef[out[put] * 64 + k[put]] = value[put]
        elif any_first:
            put = np.flatnonzero(first & ~wrong)
            coef[out[put]] = value[put]
        k += 1
        over = (k > 63) | eob | wrong
        if over.any():
            k[over] = 0
            out[over] += 1
            left[over] -= 1
            unit[over] += 1
            if not plain:
                unit %= period[kind]
            else:
                unit[:] = 0
            if wrong.any():
                bad[owner[wrong]] = True
                left[wrong] = 0
            if (left <= 0).any():
                stay = np.flatnonzero(left > 0)
                bit, end, out, left, owner, kind, unit, k, pred = (x[stay] for x in (bit, end, out, left, owner, kind, unit, k, pred))
    result: list[np.ndarray | None] = []
    for n, first in enumerate(firsts):
        if first is None or bad[n]:
            images[n].error = images[n].error or "scan data break off"
            result.append(None)
            continue
        units, across, down = _units(images[n])
        count = across * down * len(units)
        result.append(coef[first * (64 if keep else 1) : (first + count) * (64 if keep else 1)].reshape(count, -1))
    return result


def thumbnail(im: Image, coef: np.ndarray) -> np.ndarray:
    """Luminance, one uint8 pixel a block: the dequantised DC over 8, level-shifted."""
    units, across, down = _units(im)
    _, h, v, q = im.components[0]
    if len(im.scan) == 1:
        h = v = 1
    dc = coef[:, 0].reshape(down * across, len(units))[:, : h * v].astype(np.int32) * int(im.quant[q][0])
    grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    grid = grid[: -(-im.height // 8), : -(-im.width // 8)]
    return np.clip(np.floor(grid / 8 + 128.5), 0, 255).astype(np.uint8)


def _shrink(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 source row of each of THUMB rows (rows repeat where there are fewer)."""
    lo = np.arange(THUMB) * n // THUMB
    return lo, np.maximum((np.arange(1, THUMB + 1) * n) // THUMB, lo + 1)


def thumb_hash(thumb: np.ndarray) -> str:
    """64 bits in hex: which cells of the thumbnail, averaged to 8 x 8, are brighter than their mean."""
    s = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    s[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    (t, b), (l, r) = _shrink(thumb.shape[0]), _shrink(thumb.shape[1])
    total = s[np.ix_(b, r)] - s[np.ix_(t, r)] - s[np.ix_(b, l)] + s[np.ix_(t, l)]
    cell = total / ((b - t)[:, None] * (r - l)[None, :])
    return np.packbits((cell > cell.mean()).ravel()).tobytes().hex()


_HEAD = (
    b"\xff\xd8\xff\xdb\x00\x43\x00" + b"\x01" * 64
    + b"\xff\xc4\x00\x14\x00\x01" + bytes(15) + b"\x08"
    + b"\xff\xc4\x00\x14\x10\x01" + bytes(15) + b"\x08"
    + b"\xff\xdd\x00\x04\x00\x01"
)
_SOS = b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"


#: Blocks whose bits are spread to bytes at once.
BLOCKS_AT_ONCE = 1 << 15


def encode(payload: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """JPEG files that hold the payloads (each a positive multiple of 64 bytes) in their coefficients."""
    count = np.diff(offsets) // BLOCK
    across = np.ceil(np.sqrt(count)).astype(np.int64)
    down = -(-count // across)
    cells = across * down  # the last row is filled up with zero bytes
    at = np.concatenate([[0], np.cumsum(cells)])
    grid = np.zeros((at[-1], BLOCK), np.uint8)
    source = np.repeat(at[:-1] - offsets[:-1] // BLOCK, count) + np.arange(offsets[-1] // BLOCK)
    grid[source] = payload.reshape(-1, BLOCK)
    coded = np.empty((at[-1], BLOCK * 9 // 8), np.uint8)
    for i in range(0, at[-1], BLOCKS_AT_ONCE):
        part = grid[i : i + BLOCKS_AT_ONCE]
        bits = np.zeros((len(part), BLOCK, 9), np.uint8)
        bits[:, :, 1:] = np.unpackbits(part, axis=1).reshape(-1, BLOCK, 8)
        coded[i : i + len(part)] = np.packbits(bits.reshape(len(part), -1), axis=1)
    number = np.arange(at[-1]) - np.repeat(at[:-1], cells)
    # each block's code bytes, then its restart marker; 0xFF among code bytes is followed by 0
    rows = np.empty((at[-1], coded.shape[1] + 2), np.uint8)
    rows[:, :-2], rows[:, -2], rows[:, -1] = coded, 0xFF, 0xD0 + number % 8
    stuff = rows[:, :-2] == 0xFF
    padded = np.zeros(rows.shape, bool)
    padded[:, :-2] = stuff
    stuffed = np.flatnonzero(padded)
    del stuff, padded, coded, grid
    body = np.insert(rows.ravel(), stuffed + 1, np.uint8(0))
    ends = at[1:] * rows.shape[1] + np.searchsorted(stuffed, at[1:] * rows.shape[1])
    starts = np.concatenate([[0], ends[:-1]])
    out = []
    for n in range(len(count)):
        note = LENGTH_TAG + str(int(count[n]) * BLOCK).encode()
        sof = b"\xff\xc0\x00\x0b\x08" + int(down[n] * 8).to_bytes(2, "big") + int(across[n] * 8).to_bytes(2, "big") + b"\x01\x01\x11\x00"
        com = b"\xff\xfe" + (len(note) + 2).to_bytes(2, "big") + note
        out.append(_HEAD + com + sof + _SOS + body[starts[n] : ends[n] - 2].tobytes() + b"\xff\xd9")
    return out


def read_payload(im: Image, coef: np.ndarray) -> bytes:
    """The bytes that encode() has stored."""
    size = next((int(c[len(LENGTH_TAG) :]) for c in im.comments if c.startswith(LENGTH_TAG)), len(coef) * BLOCK)
    value = np.where(coef < 0, coef + 255, coef)
    return value.astype(np.uint8).tobytes()[:size]


def pad(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts filled up with zero bytes to positive multiples of 64."""
    size = np.diff(off)
    padded = np.maximum(-(-size // BLOCK), 1) * BLOCK
    at = np.concatenate([[0], np.cumsum(padded)])
    out = np.zeros(at[-1], np.uint8)
    out[np.repeat(at[:-1] - off[:-1], size) + np.arange(off[-1])] = data[: off[-1]]
    return out, at


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Stores each text as a baseline JPEG, reads the stored bytes back and describes them: a row a document.

    Null text is empty; an empty text is one block of zero bytes. feature is width x height : thumbnail hash, so equal texts
    have equal rows. With with_media the stored file is a column too. Other columns are ignored.
    """
    kept = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    id_type = kept.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column(1))
            for i, j in slices(off, BATCH_BYTES):
                size = np.diff(off[i : j + 1])
                files = encode(*pad(data[off[i] : off[j]], off[i : j + 1] - off[i]))
                images = [parse(f) for f in files]
                rows = []
                for n, (f, im, c) in enumerate(zip(files, images, decode(files, images), strict=True)):
                    if c is None:
                        raise ValueError(f"a stored file can't be read back: {im.error}")
                    p = read_payload(im, c)
                    feature = f"{im.width}x{im.height}:{thumb_hash(thumbnail(im, c))}"
                    rows.append((int(size[n]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(f), hashlib.sha256(f).hexdigest(), feature, f))
                cols = list(zip(*rows, strict=True))[: 7 + with_media]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names=[x.split(" ")[0] for x in schema.split(", ")])

    return kept.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)


def media_features(rows: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Dimensions, thumbnail (one byte a block) and thumbnail hash of a column of JPEG files. Null, damaged and
    non-baseline files give a row with nulls and the reason in error."""
    kept = rows.select(rows[f"`{id_col}`"].alias("id"), rows[f"`{media_col}`"].cast("binary").alias("media"))
    schema = f"id {kept.schema['id'].dataType.simpleString()}, width int, height int, thumb_width int, thumb_height int, thumb binary, thumb_hash string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [x or b"" for x in batch.column(1).to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(x) for x in bodies])]).astype(np.int64)
            for i, j in slices(off, BATCH_BYTES):
                part = bodies[i:j]
                images = [parse(f) for f in part]
                out = []
                for im, c in zip(images, decode(part, images, keep=False), strict=True):
                    if c is None:
                        out.append((None, None, None, None, None, None, im.error))
                        continue
                    t = thumbnail(im, c)
                    out.append((im.width, im.height, t.shape[1], t.shape[0], t.tobytes(), thumb_hash(t), None))
                kinds = [pa.int32()] * 4 + [pa.binary(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["id", "width", "height", "thumb_width", "thumb_height", "thumb", "thumb_hash", "error"])

    return kept.mapInArrow(run, schema).withColumnRenamed("id", id_col)
