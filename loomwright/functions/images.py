"""Pixel operations on (height, width, 3) arrays of bytes: bicubic resizing by weight tables, tone curves, affine sampling, and an
augmentation policy whose choices are hashes of a key."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights are whole multiples of 2 ** -22.
_BITS = 22


# --- resizing ---------------------------------------------------------------------------------------------------------


def taps(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, weights) of the samples that each of ``size`` new ones is made of: the cubic kernel (a = -0.5), as wide as
    a new sample where the image shrinks, cut at the edges, with weights that sum to one before they are rounded."""
    scale = n / size
    wide = max(scale, 1.0)
    centre = (np.arange(size) + 0.5) * scale
    lo = np.maximum((centre - 2 * wide + 0.5).astype(np.int64), 0)
    hi = np.minimum((centre + 2 * wide + 0.5).astype(np.int64), n)
    k = np.arange(int((hi - lo).max()))
    x = np.abs((k[None, :] + lo[:, None] - centre[:, None] + 0.5) / wide)
    w = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))
    w = np.where(k[None, :] < (hi - lo)[:, None], w, 0.0)
    w = w / w.sum(axis=1, keepdims=True)
    return lo, np.floor(w * (1 << _BITS) + 0.5).astype(np.int64)


def _resample(pixels: np.ndarray, size: int) -> np.ndarray:
    """Along the first axis."""
    lo, w = taps(len(pixels), size)
    at = np.minimum(lo[:, None] + np.arange(w.shape[1])[None, :], len(pixels) - 1)
    out = np.full((size, *pixels.shape[1:]), 1 << (_BITS - 1), np.int64)
    for k in range(w.shape[1]):
        out += pixels[at[:, k]].astype(np.int64) * w[:, k].reshape(-1, *[1] * (pixels.ndim - 1))
    return np.clip(out >> _BITS, 0, 255).astype(np.uint8)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Columns first, then rows, rounded to bytes between."""
    return _resample(_resample(pixels.transpose(1, 0, 2), width).transpose(1, 0, 2), height)


# --- tones ------------------------------------------------------------------------------------------------------------


def _by_channel(pixels: np.ndarray, table: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    return np.stack([table(c)[c] for c in np.moveaxis(pixels, 2, 0)], axis=2)


def equalize(pixels: np.ndarray) -> np.ndarray:
    """Each channel's values by how many pixels are below them, in steps of a 255th of all but the highest value's."""

    def table(c: np.ndarray) -> np.ndarray:
        many = np.bincount(c.ravel(), minlength=256)
        step = (many.sum() - many[np.flatnonzero(many)[-1]]) // 255
        if not step:
            return np.arange(256, dtype=np.uint8)
        return np.minimum((step // 2 + np.append(0, np.cumsum(many)[:-1])) // step, 255).astype(np.uint8)

    return _by_channel(pixels, table)


def autocontrast(pixels: np.ndarray) -> np.ndarray:
    """Each channel stretched from its least and greatest value to 0 and 255."""

    def table(c: np.ndarray) -> np.ndarray:
        lo, hi, v = int(c.min()), int(c.max()), np.arange(256)
        return v.astype(np.uint8) if hi <= lo else np.clip(((v - lo) * 255) // (hi - lo), 0, 255).astype(np.uint8)

    return _by_channel(pixels, table)


def solarize(pixels: np.ndarray, threshold: int) -> np.ndarray:
    return np.where(pixels < threshold, pixels, 255 - pixels)


def posterize(pixels: np.ndarray, bits: int) -> np.ndarray:
    return pixels & np.uint8(255 << (8 - bits) & 255)


def _blend(pixels: np.ndarray, base: np.ndarray, factor: float) -> np.ndarray:
    """base + factor * (pixels - base), cut to whole bytes."""
    return np.clip(base + factor * (pixels.astype(np.float64) - base), 0, 255).astype(np.uint8)


def _grey(pixels: np.ndarray) -> np.ndarray:
    return pixels @ np.array([0.299, 0.587, 0.114])


def brightness(pixels: np.ndarray, factor: float) -> np.ndarray:
    return _blend(pixels, np.zeros(1), factor)


def contrast(pixels: np.ndarray, factor: float) -> np.ndarray:
    return _blend(pixels, np.full(1, np.floor(_grey(pixels).mean() + 0.5)), factor)


def color(pixels: np.ndarray, factor: float) -> np.ndarray:
    return _blend(pixels, _grey(pixels)[..., None], factor)


def sharpness(pixels: np.ndarray, factor: float) -> np.ndarray:
    """Against a smoothed copy (the middle of nine weighs 5 of 13); the edge stays."""
    soft = pixels.astype(np.float64)
    if min(pixels.shape[:2]) > 2:
        around = sum(soft[i : len(soft) - 2 + i, j : soft.shape[1] - 2 + j] for i in range(3) for j in range(3))
        soft[1:-1, 1:-1] = (around + 4 * pixels[1:-1, 1:-1]) / 13
    return _blend(pixels, soft, factor)


# --- places -----------------------------------------------------------------------------------------------------------


def affine(pixels: np.ndarray, matrix: tuple[float, ...], fill: int = 128) -> np.ndarray:
    """The pixel at floor(a x + b y + c), floor(d x + e y + f) for each (x, y), ``fill`` outside the image."""
    h, w = pixels.shape[:2]
    y, x = np.mgrid[:h, :w]
    a, b, c, d, e, f = matrix
    sx, sy = np.floor(a * x + b * y + c).astype(np.int64), np.floor(d * x + e * y + f).astype(np.int64)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    return np.where(inside[..., None], pixels[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], np.uint8(fill))


def rotate(pixels: np.ndarray, degrees: float, fill: int = 128) -> np.ndarray:
    h, w = pixels.shape[:2]
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    mx, my = (w - 1) / 2, (h - 1) / 2
    return affine(pixels, (c, -s, mx - c * mx + s * my + 0.5, s, c, my - s * mx - c * my + 0.5), fill)


# --- policy -----------------------------------------------------------------------------------------------------------

#: Operations that a policy chooses from, with what a level from 0 to 1 (and a sign) makes of them (fixed values).
OPERATIONS: dict[str, Callable[[np.ndarray, float, int], np.ndarray]] = {
    "identity": lambda p, level, sign: p,
    "autocontrast": lambda p, level, sign: autocontrast(p),
    "equalize": lambda p, level, sign: equalize(p),
    "rotate": lambda p, level, sign: rotate(p, sign * level * 30),
    "solarize": lambda p, level, sign: solarize(p, int(level * 256)),
    "color": lambda p, level, sign: color(p, level * 1.8 + 0.1),
    "contrast": lambda p, level, sign: contrast(p, level * 1.8 + 0.1),
    "brightness": lambda p, level, sign: brightness(p, level * 1.8 + 0.1),
    "sharpness": lambda p, level, sign: sharpness(p, level * 1.8 + 0.1),
    "shear_x": lambda p, level, sign: affine(p, (1, sign * level * 0.3, 0, 0, 1, 0)),
    "translate_x": lambda p, level, sign: affine(p, (1, 0, sign * level * 10, 0, 1, 0)),
    "translate_y": lambda p, level, sign: affine(p, (1, 0, 0, 0, 1, sign * level * 10)),
    "posterize": lambda p, level, sign: posterize(p, int(level * 4)),
    "shear_y": lambda p, level, sign: affine(p, (1, 0, 0, sign * level * 0.3, 1, 0)),
}


def _u01(key: str, salt: str) -> float:
    return int(hashlib.md5(f"{key}:{salt}".encode()).hexdigest()[:8], 16) / float(1 << 32)


def choices(key: str, n: int = 2, chance: float = 0.5) -> list[tuple[str, int]]:
    """(operation, sign) of ``n`` draws for a key, each left out but for a chance."""
    names, out = list(OPERATIONS), []
    for i in range(n):
        if _u01(key, f"apply{i}") <= chance:
            out.append((names[int(_u01(key, f"op{i}") * len(names))], -1 if _u01(key, f"sign{i}") > 0.5 else 1))
    return out


def augment(pixels: np.ndarray, key: str, n: int = 2, level: float = 0.5, chance: float = 0.5) -> np.ndarray:
    for name, sign in choices(key, n, chance):
        pixels = OPERATIONS[name](pixels, level, sign)
    return pixels


def transformed(pixels: Column, width: Column, work: Callable[[np.ndarray, str], np.ndarray], key: Column | None = None) -> Column:
    """Bytes of rows of RGB behind ``work(array, key)``; null and empty images stay as they are."""

    @F.arrow_udf("binary")
    def run(data: pa.Array, w: pa.Array, k: pa.Array) -> pa.Array:
        out = []
        for x, n, own in zip(data.to_pylist(), w.to_pylist(), k.to_pylist()):
            out.append(x if not x else np.ascontiguousarray(work(np.frombuffer(x, np.uint8).reshape(-1, n, 3), own)).tobytes())
        return pa.array(out, pa.binary())

    return run(pixels, width, (key if key is not None else F.lit("")).cast("string"))
