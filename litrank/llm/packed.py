"""Arrays of unsigned integers in one compressed binary value."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(*arrays) -> bytes:
    """Arrays of unsigned integers, byte planes apart, compressed."""
    out = zstandard.ZstdCompressor(level=9)
    planes = []
    for a in arrays:
        a = np.ascontiguousarray(a, "<u8")
        top = int(a.max()) if len(a) else 0
        width = max(1, (top.bit_length() + 7) // 8)
        planes += [np.array([len(a), width], "<u8").tobytes(),
                   a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return out.compress(b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    while at < len(raw):
        n, width = (int(v) for v in np.frombuffer(raw, "<u8", 2, at))
        at += 16
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        out.append(a.view("<u8").reshape(-1).astype(np.int64))
        at += n * width
    return out
