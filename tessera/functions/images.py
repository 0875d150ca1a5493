"""Image mathematics in numpy: headers, hashes, border trim, palettes, palette distance and the recolour score.

Pixels are uint8 arrays (height, width, 3) in RGB; an alpha plane comes apart.
"""

from __future__ import annotations

import itertools
import struct

import numpy as np

#: The share of a side that crops and margins take.
INSET = 0.04
#: Fixed values of the border trim: spread of an even border, difference of the foreground, least pixels, least side of the content, least margin.
TRIM = {"even": 18, "front": 30, "pixels": 50, "content": 16, "pad": 2}
#: Fixed values of the recolour score: cells on a side, difference of like cells, their least share, difference of recoloured cells, their least share, percentile.
RECOLOUR = {"cells": 16, "like": 6, "aligned": 0.5, "far": 15, "region": 0.12, "percentile": 85}


def header_size(content: bytes) -> tuple[int, int] | None:
    """(width, height) from the first bytes of PNG, GIF, BMP, JPEG, WebP or TIFF; None if it is none of them."""
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", content[16:24])
        if content[:4] == b"GIF8":
            return struct.unpack("<HH", content[6:10])
        if content[:2] == b"BM":
            w, h = struct.unpack("<ii", content[18:26])
            return w, abs(h)
        if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
            if content[12:16] == b"VP8X":
                return 1 + int.from_bytes(content[24:27], "little"), 1 + int.from_bytes(content[27:30], "little")
            if content[12:16] == b"VP8L":
                bits = int.from_bytes(content[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            return struct.unpack("<H", content[26:28])[0] & 0x3FFF, struct.unpack("<H", content[28:30])[0] & 0x3FFF
        if content[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(content):
                if content[at] != 0xFF:
                    at += 1
                    continue
                mark = content[at + 1]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                    return w, h
                at += 2 + (0 if mark in (0x01, *range(0xD0, 0xD9), 0xFF) else struct.unpack(">H", content[at + 2 : at + 4])[0])
        if content[:4] in (b"II*\0", b"MM\0*"):
            end = "<" if content[:2] == b"II" else ">"
            at = struct.unpack(end + "I", content[4:8])[0]
            size = {}
            for i in range(struct.unpack(end + "H", content[at : at + 2])[0]):
                entry = content[at + 2 + 12 * i : at + 14 + 12 * i]
                tag, kind = struct.unpack(end + "HH", entry[:4])
                if tag in (256, 257):
                    size[tag] = struct.unpack(end + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
            return (size[256], size[257]) if len(size) == 2 else None
    except (struct.error, IndexError):
        pass
    return None


def spark_pixels(height: int, width: int, channels: int, data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """(RGB, alpha or None) from Spark's image rows, which interleave BGR or BGRA."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(x, 3, axis=2), None
    return np.ascontiguousarray(x[:, :, 2::-1]), (x[:, :, 3] if channels == 4 else None)


def gray(rgb: np.ndarray) -> np.ndarray:
    return ((rgb.astype(np.int64) * [19595, 38470, 7471]).sum(axis=2) + 0x8000 >> 16).astype(np.uint8)


def _kernel(n: int, m: int, support: float, weigh) -> np.ndarray:
    """m x n resampling weights with the kernel widened when it shrinks."""
    scale = n / m
    wide = max(1.0, scale)
    centre = (np.arange(m) + 0.5) * scale
    x = (np.arange(n)[None, :] + 0.5 - centre[:, None]) / wide
    w = np.where(np.abs(x) < support, weigh(x), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(x: np.ndarray, width: int, height: int, method: str = "lanczos") -> np.ndarray:
    kind = (3.0, lambda t: np.sinc(t) * np.sinc(t / 3)) if method == "lanczos" else (0.5 + 1e-9, np.ones_like)
    rows, cols = _kernel(x.shape[0], height, *kind), _kernel(x.shape[1], width, *kind)
    y = np.tensordot(rows, np.tensordot(x.astype(float), cols, axes=(1, 1)) if x.ndim == 2 else np.einsum("hwc,mw->hmc", x.astype(float), cols), axes=(1, 0))
    return np.clip(np.floor(y + 0.5), 0, 255).astype(np.uint8)


def _to_long(bits: np.ndarray) -> int:
    return int(np.packbits(bits.ravel()).view(">i8")[0])


def phash(rgb: np.ndarray) -> int:
    """64 bits: the low 8 x 8 block of the cosine transform of a 32 x 32 gray image against its median."""
    x = resize(gray(rgb), 32, 32).astype(float)
    k = np.arange(32)
    basis = 2 * np.cos(np.pi * k[:, None] * (2 * k[None, :] + 1) / 64)
    low = (basis @ x @ basis.T)[:8, :8]
    return _to_long(low > np.median(low))


def dhash(rgb: np.ndarray) -> int:
    """64 bits: whether each pixel of a 9 x 8 gray image is under its right neighbour."""
    x = resize(gray(rgb), 9, 8).astype(int)
    return _to_long(x[:, 1:] > x[:, :-1])


def four_hashes(rgb: np.ndarray) -> tuple[int, int, int | None, int | None]:
    """phash, dhash, and both of the image without 4 % on each side (None under 25 pixels)."""
    h, w = rgb.shape[:2]
    p, d = phash(rgb), dhash(rgb)
    if min(h, w) < 25:
        return p, d, None, None
    y, x = int(h * INSET), int(w * INSET)
    inner = rgb[y : h - y, x : w - x]
    return p, d, phash(inner), dhash(inner)


def trim_border(rgb: np.ndarray) -> tuple[int, int, int, int]:
    """(x0, y0, x1, y1) of the content on a uniform border; the whole image where there is none."""
    h, w = rgb.shape[:2]
    whole = (0, 0, w, h)
    if min(h, w) < 32:
        return whole
    edge = np.concatenate([rgb[0], rgb[-1], rgb[:, 0], rgb[:, -1]]).astype(int)
    middle = np.median(edge, axis=0)
    if np.percentile(np.abs(edge - middle).max(axis=1), 80) > TRIM["even"]:
        return whole
    front = np.abs(rgb.astype(int) - middle).max(axis=2) > TRIM["front"]
    if front.sum() < TRIM["pixels"]:
        return whole
    ys, xs = np.flatnonzero(front.any(axis=1)), np.flatnonzero(front.any(axis=0))
    x0, x1, y0, y1 = xs[0], xs[-1] + 1, ys[0], ys[-1] + 1
    if x1 - x0 < TRIM["content"] or y1 - y0 < TRIM["content"]:
        return whole
    pad_x, pad_y = max(TRIM["pad"], int(w * INSET)), max(TRIM["pad"], int(h * INSET))
    return max(0, int(x0) - pad_x), max(0, int(y0) - pad_y), min(w, int(x1) + pad_x), min(h, int(y1) + pad_y)


def lab(rgb: np.ndarray) -> np.ndarray:
    """CIE Lab (D65) of 8-bit sRGB. The sRGB transfer curve, its matrix and the D65 white."""
    c = rgb.astype(float) / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    xyz = c @ np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]]).T / [0.95047, 1.0, 1.08883]
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def hsv(rgb: np.ndarray) -> np.ndarray:
    c = rgb.astype(float) / 255
    high, low = c.max(axis=-1), c.min(axis=-1)
    span = high - low
    safe = np.where(span > 0, span, 1)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    turn = np.where(b == high, (r - g) / safe + 4, np.where(g == high, (b - r) / safe + 2, (g - b) / safe))
    return np.stack([np.where(span > 0, 60 * turn % 360, 0), np.where(high > 0, span / np.where(high > 0, high, 1), 0), high], axis=-1)


def palette(rgb: np.ndarray, alpha: np.ndarray | None = None, n: int = 5, seed: int = 42, space: str = "lab", min_pixels: int = 100, starts: int = 10) -> list[tuple[float, float, float, float]] | None:
    """Dominant colours with their shares, largest first: k-means over distinct colours weighed by their pixels; None with too few opaque pixels."""
    pixels = rgb[alpha > 128] if alpha is not None else rgb.reshape(-1, 3)
    if len(pixels) < min_pixels:
        return None
    colours, counts = np.unique(pixels, axis=0, return_counts=True)
    x = lab(colours) if space == "lab" else hsv(colours)
    w = counts / counts.sum()
    k = min(n, len(x))
    rng = np.random.default_rng(seed)
    best, kept = np.inf, None
    for _ in range(starts):
        centres = x[[rng.choice(len(x), p=w)]]
        while len(centres) < k:
            gap = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1) * w
            centres = np.vstack([centres, x[rng.choice(len(x), p=gap / gap.sum()) if gap.sum() > 0 else rng.integers(len(x))]])
        for _ in range(50):
            label = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            moved = np.array([np.average(x[label == c], axis=0, weights=w[label == c]) if (label == c).any() else centres[c] for c in range(k)])
            if np.allclose(moved, centres):
                break
            centres = moved
        cost = (w * ((x - centres[label]) ** 2).sum(axis=1)).sum()
        if cost < best - 1e-12:
            best, kept = cost, (centres, label)
    centres, label = kept
    found = [(*map(float, centres[c]), float(w[label == c].sum())) for c in range(k) if (label == c).any()]
    return sorted(found, key=lambda p: (-p[3], p[:3]))


def _transport(cost: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> float:
    """Least cost of moving supply to demand: successive cheapest paths in the residual graph."""
    n, m = cost.shape
    flow = np.zeros((n, m))
    supply, demand = supply.astype(float).copy(), demand.astype(float).copy()
    for _ in range(20 * (n + m)):
        if supply.max() < 1e-12 or demand.max() < 1e-12:
            break
        dist = np.concatenate([np.where(supply > 1e-12, 0.0, np.inf), np.full(m, np.inf)])
        back = np.full(n + m, -1)
        for _ in range(n + m):
            changed = False
            for i, j in itertools.product(range(n), range(m)):
                if dist[i] + cost[i, j] < dist[n + j] - 1e-12:
                    dist[n + j], back[n + j], changed = dist[i] + cost[i, j], i, True
                if flow[i, j] > 1e-12 and dist[n + j] - cost[i, j] < dist[i] - 1e-12:
                    dist[i], back[i], changed = dist[n + j] - cost[i, j], n + j, True
            if not changed:
                break
        end = n + int(np.argmin(np.where(demand > 1e-12, dist[n:], np.inf)))
        path, at = [end], end
        while back[at] >= 0:
            at = int(back[at])
            path.append(at)
        path.reverse()
        amount = min(supply[path[0]], demand[end - n])
        for a, b in itertools.pairwise(path):
            if a >= n:
                amount = min(amount, flow[b, a - n])
        for a, b in itertools.pairwise(path):
            if a < n:
                flow[a, b - n] += amount
            else:
                flow[b, a - n] -= amount
        supply[path[0]] -= amount
        demand[end - n] -= amount
    return float((flow * cost).sum())


def assignment(cost: np.ndarray) -> list[int]:
    """The column of each row in the cheapest one-to-one matching of a square cost matrix: one shortest augmenting path for each row, with potentials."""
    n = len(cost)
    row_of = np.full(n + 1, -1)  # the last column is where a path begins
    u, v = np.zeros(n), np.zeros(n + 1)
    for i in range(n):
        row_of[n], at = i, n
        least, back, seen = np.full(n, np.inf), np.full(n, -1), np.zeros(n + 1, bool)
        while row_of[at] >= 0:
            seen[at] = True
            r = row_of[at]
            slack = cost[r] - u[r] - v[:n]
            better = ~seen[:n] & (slack < least)
            least[better], back[better] = slack[better], at
            step = int(np.argmin(np.where(seen[:n], np.inf, least)))
            gap = least[step]
            for j in np.flatnonzero(seen):
                u[row_of[j]] += gap
                v[j] -= gap
            least[~seen[:n]] -= gap
            at = step
        while at != n:
            row_of[at] = row_of[back[at]]
            at = int(back[at])
    out = [0] * n
    for j in range(n):
        out[row_of[j]] = j
    return out


def palette_distance(a: list, b: list, dummy: float = 200.0) -> float:
    """The larger of two distances between palettes (L, a, b, share): the best one-to-one matching, weighed by mean shares, and the earth mover's distance."""
    x, y = np.array(a, dtype=float), np.array(b, dtype=float)
    cost = np.sqrt(((x[:, None, :3] - y[None, :, :3]) ** 2).sum(axis=2))
    n = max(len(x), len(y))
    square, wx, wy = np.full((n, n), dummy), np.zeros(n), np.zeros(n)
    square[: len(x), : len(y)] = cost
    wx[: len(x)], wy[: len(y)] = x[:, 3], y[:, 3]
    best = assignment(square)
    weights = [(wx[i] + wy[j]) / 2 for i, j in enumerate(best)]
    matched = sum(w * square[i, j] for w, (i, j) in zip(weights, enumerate(best), strict=True)) / max(1e-12, sum(weights))
    moved = _transport(cost, x[:, 3] / x[:, 3].sum(), y[:, 3] / y[:, 3].sum())
    return float(max(matched, moved))


def cell_grids(rgb: np.ndarray) -> bytes | None:
    """Two grids of mean colours as bytes, of the whole image and of it without INSET on each side; None under 32 pixels."""
    h, w = rgb.shape[:2]
    if min(h, w) < 32:
        return None
    inner = rgb[int(h * INSET) : int(h * (1 - INSET)), int(w * INSET) : int(w * (1 - INSET))]
    return b"".join(resize(x, RECOLOUR["cells"], RECOLOUR["cells"], "box").tobytes() for x in (rgb, inner))


def recolour_score(a: bytes | None, b: bytes | None) -> float:
    """How far the recoloured cells of two pictures (their cell_grids) of one scene are apart; 0 if they don't line up or don't differ. The least over plain, a cropped, b cropped.

    Pictures line up if enough cells are alike as they are; the shift that light
    alone makes is the median difference, a vector, and what is left counts.
    """
    if a is None or b is None:
        return 0.0
    shape = (2, RECOLOUR["cells"] ** 2, 3)
    x, y = (lab(np.frombuffer(g, np.uint8).reshape(shape)) for g in (a, b))
    scores = []
    for p, q in ((0, 0), (1, 0), (0, 1)):
        gap = x[p] - y[q]
        if (np.linalg.norm(gap, axis=1) < RECOLOUR["like"]).mean() < RECOLOUR["aligned"]:
            continue
        rest = np.linalg.norm(gap - np.median(gap, axis=0), axis=1)
        scores.append(float(np.percentile(rest, RECOLOUR["percentile"])) if (rest > RECOLOUR["far"]).mean() >= RECOLOUR["region"] else 0.0)
    return min(scores, default=0.0)


def verify_colour(palette_a, palette_b, spatial: float, threshold: float, space: str = "lab") -> tuple[bool, float, str]:
    """(passed, distance, reason): a missing palette rejects; in Lab the recolour score counts as well."""
    if not palette_a or not palette_b:
        return False, float("inf"), "palette missing"
    distance = palette_distance(palette_a, palette_b)
    if space == "lab":
        distance = max(distance, spatial)
    return distance <= threshold, distance, f"distance {distance:.2f} against {threshold:.2f}"
