"""Pixel transforms on raw RGB images: arrays of height * width * 3 numbers, row by row. Decoding needs an image library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _picked(pixels: Column, width: Column | int, h: int, w: int, y: Callable[[Column], Column], x: Callable[[Column], Column]) -> Column:
    """The image of h x w pixels whose pixel (i, j) is the one at (y(i), x(j))."""
    row, place = w * 3, lambda i, k: F.floor(i / k).cast("int")

    def at(i):
        return pixels[((y(place(i, row)) * width + x(place(i % row, 3))) * 3 + i % 3).cast("int")]

    return F.transform(F.sequence(F.lit(0), F.lit(h * row - 1)), at)


def crop(pixels: Column, width: Column | int, left: Column | int, top: Column | int, w: int, h: int) -> Column:
    return _picked(pixels, width, h, w, lambda i: i + top, lambda j: j + left)


def resize_nearest(pixels: Column, width: Column | int, height: Column | int, w: int, h: int) -> Column:
    """Each new pixel is the old one under its centre."""
    return _picked(pixels, width, h, w, lambda i: F.floor((i + 0.5) * height / h), lambda j: F.floor((j + 0.5) * width / w))


def flip(pixels: Column, width: int, height: int) -> Column:
    return _picked(pixels, width, height, width, lambda i: i, lambda j: width - 1 - j)


def normalise(pixels: Column, mean: tuple[float, float, float], std: tuple[float, float, float]) -> Column:
    """Numbers of 0 to 255 as (x / 255 - mean) / std of their channel."""
    m, s = (F.array(*[F.lit(v) for v in of]) for of in (mean, std))
    return F.transform(pixels, lambda x, i: (x / F.lit(255.0) - m[i % 3]) / s[i % 3])
