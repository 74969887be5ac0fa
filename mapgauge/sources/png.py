"""PNG files to arrays: the format's chunks, inflate and the five row filters, in numpy. No interlacing, no palettes below 8 bits."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Colour type -> samples a pixel.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks(body: bytes):
    """(type, data) of each chunk; a wrong checksum raises."""
    if not body.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    at = len(SIGNATURE)
    while at + 12 <= len(body):
        (n,) = struct.unpack_from(">I", body, at)
        kind, data = body[at + 4 : at + 8], body[at + 8 : at + 8 + n]
        if len(data) != n or zlib.crc32(kind + data) != struct.unpack_from(">I", body, at + 8 + n)[0]:
            raise ValueError("a PNG chunk is damaged")
        yield kind, data
        at += 12 + n


def _unfilter(raw: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    """Rows without their filters. Sub and Up are running sums; Average and Paeth depend on the pixel before."""
    rows = raw.reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)
    for i in range(height):
        kind, line, above = rows[i, 0], rows[i, 1:], out[i]
        if kind == 0:
            out[i + 1] = line
        elif kind == 1:
            out[i + 1] = np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[i + 1] = line + above
        elif kind in (3, 4):
            done = [0] * step + [0] * stride
            up = [0] * step + above.tolist()
            for k, x in enumerate(line.tolist(), step):
                a, b, c = done[k - step], up[k], up[k - step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    near = (abs(p - a), abs(p - b), abs(p - c))
                    guess = a if near[0] <= near[1] and near[0] <= near[2] else b if near[1] <= near[2] else c
                done[k] = (x + guess) & 0xFF
            out[i + 1] = done[step:]
        else:
            raise ValueError(f"no PNG filter {kind}")
    return out[1:]


def decode(body: bytes) -> np.ndarray:
    """(h, w) or (h, w, channels) samples of 8 or 16 bits; palettes are looked up, alpha is dropped."""
    head, data, palette = None, [], None
    for kind, part in chunks(body):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(part)
    if head is None or not data:
        raise ValueError("a PNG file without header or data")
    width, height, depth, colour, _, _, interlaced = head
    if depth not in (8, 16) or colour not in CHANNELS or interlaced:
        raise ValueError(f"PNG of {depth} bits, colour type {colour}, interlace {interlaced} isn't read")
    n = CHANNELS[colour]
    step = n * depth // 8
    flat = _unfilter(np.frombuffer(zlib.decompress(b"".join(data)), np.uint8), height, width * step, step)
    a = flat.view(">u2").astype(np.uint16) if depth == 16 else flat
    a = a.reshape(height, width, n)
    if colour == 3:
        a = palette[a[:, :, 0]]
    a = a[:, :, : {4: 1, 6: 3}.get(colour, a.shape[2])]
    return a[:, :, 0] if a.shape[2] == 1 else a
