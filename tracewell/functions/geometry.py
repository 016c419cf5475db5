"""Boxes as structs x0, y0, x1, y1 of doubles; a null box has no place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box; null if any side is null, not finite, or out of order."""
    sides = [c.cast("double") for c in (x0, y0, x1, y1)]
    sound = F.lit(True)
    for side in sides:
        sound = sound & ~F.isnan(side) & (F.abs(side) < float("inf"))
    made = F.struct(*[s.alias(n) for s, n in zip(sides, ("x0", "y0", "x1", "y1"))])
    return F.when(sound & (sides[2] >= sides[0]) & (sides[3] >= sides[1]), made)


def area(one: Column) -> Column:
    """Width times height; a null box is larger than all."""
    return F.coalesce((one["x1"] - one["x0"]) * (one["y1"] - one["y0"]), F.lit(float("inf")))


def overlap(one: Column, two: Column, axis: str) -> Column:
    """Length of the common part on an axis; negative if apart."""
    return F.least(one[f"{axis}1"], two[f"{axis}1"]) - F.greatest(one[f"{axis}0"], two[f"{axis}0"])


def overlaps(one: Column, two: Column, least: float = 0.0) -> Column:
    """Whether the boxes share more than ``least`` on both axes."""
    return (overlap(one, two, "x") > least) & (overlap(one, two, "y") > least)


def iou(one: Column, two: Column) -> Column:
    """Intersection over union; 0 where the union has no area."""
    shared = F.greatest(overlap(one, two, "x"), F.lit(0.0)) * F.greatest(overlap(one, two, "y"), F.lit(0.0))
    union = area(one) + area(two) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def near(one: Column, two: Column) -> Column:
    """Equal up to a relative difference of 1e-9."""
    return F.abs(one - two) <= F.lit(1e-9) * F.greatest(F.abs(one), F.abs(two))
