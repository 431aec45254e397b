"""What JPEG coding does to pixels, without the entropy coder, which loses nothing; and the tables a file carries."""

from __future__ import annotations

import numpy as np

from .pixels import dct_matrix, tiles

# Quantisation tables of the JPEG standard (annex K) in row order, for quality 50.
LUMINANCE_TABLE = """
16 11 10 16 24 40 51 61
12 12 14 19 26 58 60 55
14 13 16 24 40 57 69 56
14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77
24 35 55 64 81 104 113 92
49 64 78 87 103 121 120 101
72 92 95 98 112 100 103 99
"""
CHROMINANCE_TABLE = """
17 18 24 47 99 99 99 99
18 21 26 66 99 99 99 99
24 26 56 99 99 99 99 99
47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
"""
# Red, green, blue to luminance and the two colour differences.
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
OFFSET = np.array([0.0, 128.0, 128.0])
SWEEP = range(55, 101, 5)


def scaled_table(text: str, quality: int) -> np.ndarray:
    base = np.array(text.split(), float).reshape(8, 8)
    percent = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((base * percent + 50) // 100, 1, 255)


def code_plane(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A plane after quantisation of its 8 x 8 blocks; edges are repeated to whole blocks."""
    h, w = plane.shape
    padded = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    basis = dct_matrix(8)
    blocks = np.rint(basis @ tiles(padded, 8) @ basis.T / table) * table
    back = (basis.T @ blocks @ basis).swapaxes(1, 2).reshape(padded.shape) + 128
    return np.clip(np.rint(back[:h, :w]), 0, 255)


def recompress(rgb: np.ndarray, quality: int) -> np.ndarray:
    """The image after JPEG coding at a quality, colour at half resolution."""
    ycc = rgb.astype(np.float64) @ TO_YCC.T + OFFSET
    h, w = ycc.shape[:2]
    luma, chroma = scaled_table(LUMINANCE_TABLE, quality), scaled_table(CHROMINANCE_TABLE, quality)
    out = np.empty_like(ycc)
    out[:, :, 0] = code_plane(np.rint(ycc[:, :, 0]), luma)
    for c in (1, 2):
        even = np.pad(ycc[:, :, c], ((0, h % 2), (0, w % 2)), mode="edge")
        small = np.rint(even.reshape(even.shape[0] // 2, 2, even.shape[1] // 2, 2).mean(axis=(1, 3)))
        out[:, :, c] = code_plane(small, chroma).repeat(2, axis=0).repeat(2, axis=1)[:h, :w]
    return np.clip(np.rint((out - OFFSET) @ np.linalg.inv(TO_YCC).T), 0, 255).astype(np.uint8)


def error_level(rgb: np.ndarray, quality: int = 90) -> dict:
    """Mean and largest change when coded once more."""
    diff = np.abs(rgb.astype(np.int16) - recompress(rgb, quality))
    return {"ela_mean": float(diff.mean()), "ela_max": float(diff.max())}


def ghost_sweep(rgb: np.ndarray) -> list[dict]:
    """Mean change and its spread over 32 x 32 tiles for each quality of the sweep; the first least change marks the earlier quality."""
    rows = []
    for quality in SWEEP:
        diff = np.abs(rgb.astype(np.float64) - recompress(rgb, quality)).mean(axis=2)
        parts = tiles(diff, 32).mean(axis=(2, 3))
        rows.append({"quality": quality, "error": float(diff.mean()), "block_cv": float(parts.std() / (parts.mean() + 1e-12)) if parts.size else 0.0})
    return rows


def quantisation_tables(content: bytes) -> list[dict] | None:
    """Tables of a JPEG file in their coded order, by walking its segments; None where the bytes are no JPEG."""
    if content is None or content[:2] != b"\xff\xd8":
        return None
    found, at = [], 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        marker = content[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xDA:
            break
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        if marker == 0xDB:
            body = content[at + 4 : at + 2 + size]
            while body:
                wide = body[0] >> 4
                raw = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else "u1")
                if raw.size < 64:
                    break
                found.append({"table_id": body[0] & 15, "values": [int(v) for v in raw]})
                body = body[1 + 64 * (1 + wide) :]
        at += 2 + max(size, 2)
    return found
