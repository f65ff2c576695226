"""Distances, boxes and their overlaps as column expressions; a box is a pair of corners (low, high)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, mul

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dominance import all_of

Point = Sequence[Column]
Box = tuple[Sequence[Column], Sequence[Column]]
#: Margin by which a box is widened beyond its points.
MARGIN = 1e-5
LARGEST = 1.7976931348623157e308


def _sum(terms: Sequence[Column]) -> Column:
    return reduce(add, terms)


def sides(box: Box) -> list[Column]:
    return [F.abs(high - low) for low, high in zip(*box, strict=True)]


def l1(p: Point) -> Column:
    return _sum([F.abs(x) for x in p])


def l2(p: Point, q: Point) -> Column:
    return F.sqrt(_sum([(x - y) * (x - y) for x, y in zip(p, q, strict=True)]))


def l2_to_box(p: Point, box: Box) -> Column:
    """0 inside the box."""
    gaps = [F.greatest(low - x, x - high, F.lit(0.0)) for x, low, high in zip(p, *box, strict=True)]
    return F.sqrt(_sum([g * g for g in gaps]))


def area(box: Box) -> Column:
    return reduce(mul, sides(box))


def perimeter(box: Box) -> Column:
    """Total length of all edges: each side occurs 2^(n-1) times."""
    return _sum(sides(box)) * float(2 ** (len(box[0]) - 1))


def centre(box: Box) -> list[Column]:
    return [(low + high) / 2 for low, high in zip(*box, strict=True)]


def distance_from_centre(p: Point, box: Box) -> Column:
    return l2(p, centre(box))


def contains_point(box: Box, p: Point) -> Column:
    """Strictly inside."""
    return all_of([(low < x) & (x < high) for x, low, high in zip(p, *box, strict=True)])


def contains_box(outer: Box, inner: Box) -> Column:
    return contains_point(outer, inner[0]) & contains_point(outer, inner[1])


def overlaps(a: Box, b: Box) -> Column:
    """Touching boxes overlap."""
    return all_of([(al <= bh) & (ah >= bl) for al, ah, bl, bh in zip(*a, *b, strict=True)])


def overlap(a: Box, b: Box) -> Box:
    """The common box; meaningless where the boxes don't overlap."""
    low = [F.greatest(x, y) for x, y in zip(a[0], b[0], strict=True)]
    return low, [F.least(x, y) for x, y in zip(a[1], b[1], strict=True)]


def overlap_box(a: Box, b: Box) -> Column:
    """The common box as struct(low array, high array), null if there is none."""
    low, high = overlap(a, b)
    return F.when(overlaps(a, b), F.struct(F.array(*low).alias("low"), F.array(*high).alias("high")))


def overlap_area(a: Box, b: Box) -> Column:
    return F.when(overlaps(a, b), area(overlap(a, b))).otherwise(0.0)


def expand(box: Box, by: Box | Point, margin: float = MARGIN) -> Box:
    """The least box around a box and a point or another box, widened by the margin."""
    low, high = by if isinstance(by, tuple) else (by, by)
    return (
        [F.least(x, y) - margin for x, y in zip(box[0], low, strict=True)],
        [F.greatest(x, y) + margin for x, y in zip(box[1], high, strict=True)],
    )


def dominance_area(p: Point) -> Box:
    """The box of everything that p may dominate."""
    return list(p), [F.lit(LARGEST) for _ in p]
