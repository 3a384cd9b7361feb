"""Learning-rate schedules in closed form over a step or epoch column; image geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_with_warmup(step: Column, warmup: int, steps: int, cycles: float = 0.5, floor: float = 0.0) -> Column:
    progress = (step - warmup) / F.lit(float(max(1, steps - warmup)))
    wave = 0.5 * ((1 + floor) + (1 - floor) * F.cos(F.lit(math.pi * cycles * 2) * progress))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(F.greatest(F.lit(0.0), wave))


def cosine_epochs(epoch: Column, epochs: int, first: float, last: float) -> Column:
    return (first - last) * 0.5 * (1 + F.cos(F.lit(math.pi) * epoch / epochs)) + last


def linear_warmup(step: Column, steps: int, first: float, top: float) -> Column:
    return F.least(F.lit(top), F.lit(first) + F.lit(top - first) * step / max(steps, 1))


def step_decay(epoch: Column, first: float, last: float, decay: float) -> Column:
    return F.greatest(F.lit(last), F.lit(first) * F.pow(F.lit(decay), epoch))


def centre_crop(w: Column, h: Column) -> tuple[Column, Column, Column]:
    """(left, top, side) of the largest centred square."""
    side = F.least(w, h)
    return F.floor((w - side) / 2), F.floor((h - side) / 2), side


def resize_short_side(w: Column, h: Column, size: int) -> tuple[Column, Column]:
    """(width, height) with the shorter side at ``size``, the other cut to a whole number."""
    return F.when(w <= h, F.lit(size)).otherwise(F.floor(size * w / h)), F.when(w <= h, F.floor(size * h / w)).otherwise(F.lit(size))
