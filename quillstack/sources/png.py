"""PNG files as pixel tables, decoded by zlib and NumPy: 8 bits a channel, grey, RGB, palette, with or without alpha."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode(data: bytes) -> np.ndarray | None:
    """height x width x 4, or None for files of another form."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, parts, palette, clear = 8, [], None, b""
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlace or colour not in _CHANNELS:
                return None
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    n = _CHANNELS[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width, n), np.int32)
    above = np.zeros((width, n), np.int32)
    for y in range(height):
        raw, how = rows[y, 1:].astype(np.int32).reshape(width, n), rows[y, 0]
        if how == 0:
            line = raw
        elif how == 1:
            line = np.cumsum(raw, axis=0) & 255
        elif how == 2:
            line = (raw + above) & 255
        else:
            line = np.zeros_like(raw)
            left = corner = np.zeros(n, np.int32)
            for x in range(width):
                if how == 3:
                    guess = (left + above[x]) >> 1
                else:
                    p = left + above[x] - corner
                    a, b, c = np.abs(p - left), np.abs(p - above[x]), np.abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above[x], corner))
                line[x] = (raw[x] + guess) & 255
                left, corner = line[x], above[x]
        out[y] = above = line
    rgba = np.full((height, width, 4), 255, np.int32)
    if colour == 3:
        rgba[..., :3] = palette[out[..., 0]]
        alpha = np.full(256, 255)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        rgba[..., 3] = alpha[out[..., 0]]
    else:
        rgba[..., :3] = out[..., :3] if n >= 3 else out[..., :1]
        if n in (2, 4):
            rgba[..., 3] = out[..., -1]
    return rgba


def encode(g: np.ndarray) -> bytes:
    """An RGBA file of a height x width x 4 array."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = np.concatenate((np.zeros((g.shape[0], 1), np.uint8), g.astype(np.uint8).reshape(g.shape[0], -1)), axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", g.shape[1], g.shape[0], 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def pixels(files: DataFrame) -> DataFrame:
    """Pixel rows of files (path, content); files that can't be decoded give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                g = decode(bytes(content))
                if g is not None:
                    y, x = np.indices(g.shape[:2]).reshape(2, -1)
                    yield pd.DataFrame({"img_id": path, "x": x, "y": y, **{c: g[..., i].ravel() for i, c in enumerate("rgba")}})

    return files.select("path", "content").mapInPandas(run, "img_id string, x int, y int, r int, g int, b int, a int")
