"""PNG encoder and decoder for 8-bit images, on zlib and numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by PNG colour type (grey, RGB, grey + alpha, RGBA).
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(image: np.ndarray, level: int = 3) -> bytes:
    """(H, W, 3) or (H, W) uint8 as PNG; rows are stored unfiltered."""
    h, w = image.shape[:2]
    grey = image.ndim == 2
    rows = np.ascontiguousarray(image, np.uint8).reshape(h, -1)
    data = np.concatenate([np.zeros((h, 1), np.uint8), rows], 1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if grey else 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(data, level)) + _chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """(H, W, 3) uint8 of a non-interlaced 8-bit PNG; alpha is dropped, grey is spread."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("unsupported PNG")
    w, h, n = head[0], head[1], CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    plain = not raw[:, 0].any()
    out = raw[:, 1:] if plain else np.zeros((h, w * n), np.uint8)
    for y in range(0 if plain else h):
        line, up = raw[y, 1:].astype(np.int32), out[y - 1].astype(np.int32) if y else np.zeros(w * n, np.int32)
        kind = raw[y, 0]
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        elif kind == 1:
            out[y] = (np.cumsum(line.reshape(w, n), 0) & 255).ravel()
        else:  # mean and Paeth depend on the pixel to the left, one after the other
            cur = np.zeros(w * n, np.int32)
            for x in range(w * n):
                a = cur[x - n] if x >= n else 0
                if kind == 3:
                    guess = (a + up[x]) >> 1
                else:
                    c = up[x - n] if x >= n else 0
                    p = a + up[x] - c
                    guess = min((abs(p - a), 0, a), (abs(p - up[x]), 1, up[x]), (abs(p - c), 2, c))[2]
                cur[x] = (line[x] + guess) & 255
            out[y] = cur
    out = out.reshape(h, w, n)
    return np.repeat(out[..., :1], 3, 2) if n < 3 else out[..., :3]
