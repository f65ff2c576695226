"""The k points that dominate the most others, of all points or of the skyline. Ties go to the smaller id."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cells import Grid, build_grid, histogram
from .points import as_points
from .score import BLOCK, SMALL, _schema, blocks, exact_scores
from .skyline import skyline


def kth_largest_bound(counts: np.ndarray, bound: np.ndarray, k: int) -> int:
    """The k-th largest of `bound`, each value taken as often as counts says; 0 if there are fewer."""
    held = counts.ravel() > 0
    values, times = bound.ravel()[held], counts.ravel()[held]
    order = np.argsort(-values, kind="stable")
    at = int(np.searchsorted(np.cumsum(times[order]), k))
    return int(values[order][at]) if at < len(order) else 0


def _best(candidates: DataFrame, points: DataFrame, xs: list[str], k: int, grid: Grid, own: np.ndarray) -> list[tuple]:
    """The k best (id, score) of the candidates. own: how many candidates each cell of the grid has."""
    floor = kth_largest_bound(own, grid.lower, k)
    reach = grid.upper.ravel()
    kinds = T.StructType([candidates.schema["id"], *(candidates.schema[x] for x in xs), T.StructField("reach", T.LongType())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = reach[grid.cells(np.column_stack([batch.column(x).to_numpy(zero_copy_only=False) for x in xs]))]
            yield batch.append_column("reach", pa.array(bound)).filter(pa.array(bound >= floor))

    left = candidates.select("id", *xs).mapInArrow(keep, kinds).persist()
    best: list[tuple] = []
    try:
        few = left.count() <= BLOCK
        # the most promising first: once a block's bounds are below the k-th score, no other can matter
        for rows in [left.collect()] if few else blocks(left.orderBy(F.desc("reach")), BLOCK):
            if not rows or len(best) == k and max(r["reach"] for r in rows) < best[-1][1]:
                break
            best = _ranked(best + _scored(rows, points, xs, grid))[:k]
    finally:
        left.unpersist()
    return best


def _scored(rows: list, points: DataFrame, xs: list[str], grid: Grid | None) -> list[tuple]:
    scores = exact_scores(np.array([[r[x] for x in xs] for r in rows], float), points, xs, grid)
    return [(r["id"], int(s)) for r, s in zip(rows, scores, strict=True)]


def _ranked(scored: list[tuple]) -> list[tuple]:
    return sorted(scored, key=lambda b: (-b[1], b[0] is not None, b[0] if b[0] is not None else 0))


def topk_dominating(df: DataFrame, k: int, dims: Sequence[str] | None = None, id_col: str = "id", direction: Mapping[str, str] | None = None) -> DataFrame:
    """(id, score) of the k rows with the highest dominance scores, fewer if df has fewer.

    Bounds from the cell summary leave few candidates; only those are scored exactly. The result doesn't
    depend on how the rows are partitioned. k of 0 or less gives an empty result.
    """
    points, xs = as_points(df, dims, direction, id=id_col)
    grid = build_grid(points, xs)
    best = _best(points, points, xs, k, grid, grid.counts) if k > 0 else []
    return df.sparkSession.createDataFrame(best, _schema(points.schema["id"], id_col))


def topk_skyline(df: DataFrame, k: int, dims: Sequence[str] | None = None, id_col: str = "id", direction: Mapping[str, str] | None = None) -> DataFrame:
    """(id, score) of the k skyline rows with the highest dominance scores over all of df."""
    points, xs = as_points(df, dims, direction, id=id_col)
    sky = skyline(points, xs).persist()
    try:
        if k <= 0:
            best = []
        elif sky.count() < SMALL:
            rows = sky.collect()
            best = _ranked(_scored(rows, points, xs, None))[:k] if rows else []
        else:
            grid = build_grid(points, xs)
            over = xs[: grid.counts.ndim]
            best = _best(sky, points, xs, k, grid, histogram(sky, over, grid.edges))
    finally:
        sky.unpersist()
    return df.sparkSession.createDataFrame(best, _schema(points.schema["id"], id_col))


def topk_by_score(scores: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """The k rows with the highest score; ties by id."""
    return scores.orderBy(F.desc("score"), id_col).limit(max(0, k))
