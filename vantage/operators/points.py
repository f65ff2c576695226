"""Points as the operators see them: (id, x0, x1, ...) of doubles without nulls or NaN, smaller is better."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dominance import dimension_columns, oriented, usable


def as_points(df: DataFrame, dims: Sequence[str] | None, direction: Mapping[str, str] | None = None, strict: bool = False, **keep: str) -> tuple[DataFrame, list[str]]:
    """(points, their coordinate columns x0, x1, ...). keep: columns to carry, by new name.

    Rows with a null or NaN in a dimension are dropped, or with strict raise an error when they are read."""
    names = dimension_columns(df, dims)
    values = oriented(df, names, direction)
    xs = [f"x{i}" for i in range(len(names))]
    rows = df.select(*(F.col(c).alias(new) for new, c in keep.items()), *(v.alias(x) for v, x in zip(values, xs, strict=True)))
    fine = usable([F.col(x) for x in xs])
    if strict:
        message = F.lit("a dimension is null or NaN")
        return rows.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(message).isNull())), xs
    return rows.where(fine), xs
