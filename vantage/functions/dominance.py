"""Dominance as a column predicate: all dimensions at least as good, one of them better.

Smaller is better; dimensions to be maximised are negated beforehand (see `oriented`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(and_, conditions)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions)


def dominates(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """a dominates b, dimension by dimension."""
    return all_of([x <= y for x, y in zip(a, b, strict=True)]) & any_of([x < y for x, y in zip(a, b, strict=True)])


def dominates_array(a: Column, b: Column) -> Column:
    """a dominates b, both arrays of doubles of one length."""
    return F.forall(F.zip_with(a, b, lambda x, y: x <= y), lambda t: t) & F.exists(F.zip_with(a, b, lambda x, y: x < y), lambda t: t)


def partly_dominates(p: Sequence[Column], low: Sequence[Column], high: Sequence[Column]) -> Column:
    """p dominates the upper corner of a box but not its lower corner: only some of its points may be dominated."""
    return ~dominates(p, low) & dominates(p, high)


def box_dominates_point(low: Sequence[Column], p: Sequence[Column]) -> Column:
    """Some point of a box may dominate p: its lower corner would."""
    return dominates(low, p)


def box_dominates_box(low: Sequence[Column], other_low: Sequence[Column]) -> Column:
    """Some point of a box may dominate all of another: its lower corner would dominate the other's."""
    return dominates(low, other_low)


def dimension_columns(df: DataFrame, dims: Sequence[str] | None = None, prefix: str = "Dim_") -> list[str]:
    """dims, checked, or else the columns with the prefix in the order of their numbers."""
    found = list(dims) if dims else sorted((c for c in df.columns if c.startswith(prefix)), key=lambda c: (len(c), c))
    if not found:
        raise ValueError(f"no dimensions given and no column starts with {prefix}")
    missing = [c for c in found if c not in df.columns]
    if missing:
        raise ValueError(f"unknown dimensions {missing}; there are {df.columns}")
    return found


def oriented(df: DataFrame, dims: Sequence[str], direction: Mapping[str, str] | None = None, strict: bool = False) -> list[Column]:
    """The dimensions as doubles, those with direction "max" negated; -0.0 counts as 0.0."""
    direction = direction or {}
    wrong = {k: v for k, v in direction.items() if k not in dims or v not in ("min", "max")}
    if wrong:
        raise ValueError(f"directions are min or max of a dimension, not {wrong}")
    out = []
    for d in dims:
        kind = dict(df.dtypes)[d]
        value = F.unix_micros(F.col(d)) / 1e6 if kind == "timestamp" else F.col(d).cast("double")
        out.append((-value if direction.get(d) == "max" else value) + F.lit(0.0))
    return out


def usable(values: Sequence[Column]) -> Column:
    """No null and no NaN among the values."""
    return all_of([v.isNotNull() & ~F.isnan(v) for v in values])
