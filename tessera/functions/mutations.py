"""Synthetic changes of RGB arrays for test catalogues, and a PNG encoder."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from tessera.functions.images import resize


def crop(rgb: np.ndarray, share: float) -> np.ndarray:
    """Without this share of each side; images that would be ten pixels or less stay whole."""
    h, w = rgb.shape[:2]
    y0, x0, y1, x1 = int(h * share), int(w * share), int(h * (1 - share)), int(w * (1 - share))
    return rgb[y0:y1, x0:x1].copy() if y1 > y0 + 10 and x1 > x0 + 10 else rgb.copy()


def scale(rgb: np.ndarray, factor: float, least: int = 32) -> np.ndarray:
    h, w = rgb.shape[:2]
    return _bytes(resize(rgb, max(least, int(w * factor)), max(least, int(h * factor))))


def brightness(rgb: np.ndarray, factor: float) -> np.ndarray:
    return _bytes(rgb.astype(float) * factor)


def contrast(rgb: np.ndarray, factor: float) -> np.ndarray:
    """Distances from the mean luminance, scaled."""
    mean = float(np.rint((rgb.astype(float) @ np.array([0.299, 0.587, 0.114])).mean()))
    return _bytes(mean + (rgb.astype(float) - mean) * factor)


def shift_channels(rgb: np.ndarray, gains: tuple[float, float, float], offsets: tuple[float, float, float] = (0, 0, 0)) -> np.ndarray:
    """Another colour of the same shape: each channel times its gain plus its offset."""
    return _bytes(rgb.astype(float) * np.array(gains) + np.array(offsets))


def watermark(rgb: np.ndarray, opacity: float = 0.35, every: int = 16) -> np.ndarray:
    """White diagonal stripes, blended over the lower right quarter."""
    out = rgb.astype(float)
    y, x = np.indices(rgb.shape[:2])
    on = ((x + y) % every < max(1, every // 4)) & (y >= rgb.shape[0] // 2) & (x >= rgb.shape[1] // 2)
    out[on] = out[on] * (1 - opacity) + 255 * opacity
    return _bytes(out)


#: The quantisation tables of Annex K of the JPEG standard, for quality 50.
LUMINANCE = (
    (16, 11, 10, 16, 24, 40, 51, 61), (12, 12, 14, 19, 26, 58, 60, 55), (14, 13, 16, 24, 40, 57, 69, 56), (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77), (24, 35, 55, 64, 81, 104, 113, 92), (49, 64, 78, 87, 103, 121, 120, 101), (72, 92, 95, 98, 112, 100, 103, 99),
)
CHROMINANCE = ((17, 18, 24, 47), (18, 21, 26, 66), (24, 26, 56, 99), (47, 66, 99, 99))


def recompress(rgb: np.ndarray, quality: int) -> np.ndarray:
    """The pixels after a JPEG round trip at a quality of 1 to 100: rounding of the 8 x 8 cosine coefficients in YCbCr, without chroma subsampling."""
    scale_ = 5000 / quality if quality < 50 else 200 - 2 * quality
    chroma = np.full((8, 8), 99)
    chroma[:4, :4] = CHROMINANCE
    steps = [np.clip((np.array(t) * scale_ + 50) // 100, 1, 255) for t in (LUMINANCE, chroma, chroma)]
    forward = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
    h, w = rgb.shape[:2]
    padded = np.pad(rgb, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype(float) @ forward.T
    padded[..., 0] -= 128
    k = np.arange(8)
    basis = np.cos(np.pi * k[:, None] * (2 * k[None, :] + 1) / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    blocks = padded.reshape(padded.shape[0] // 8, 8, padded.shape[1] // 8, 8, 3).transpose(4, 0, 2, 1, 3)
    for c, step in enumerate(steps):
        blocks[c] = basis.T @ (np.rint(basis @ blocks[c] @ basis.T / step) * step) @ basis
    out = blocks.transpose(1, 3, 2, 4, 0).reshape(padded.shape)
    out[..., 0] += 128
    return _bytes(out @ np.linalg.inv(forward).T)[:h, :w]


def encode_png(rgb: np.ndarray) -> bytes:
    h, w = rgb.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + np.ascontiguousarray(rgb[i], np.uint8).tobytes() for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)
