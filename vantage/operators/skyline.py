"""Skylines: the points that no other point dominates."""

from __future__ import annotations

import weakref
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce as reduce_
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dominance import dimension_columns, dominates, oriented, usable
from ..storage import Table
from . import kernels

STRATEGIES = ("auto", "anti", "two_phase", "window2d")
#: Strong points that every task filters with, and most rows of one side that are broadcast at a time.
PIVOTS, BROADCAST_ROWS = 512, 200_000
#: Survivors per task of the first phase that make another local round worthwhile.
MERGE_ROWS = 50_000
#: Estimated bytes of the input beyond which pivots pay: among many tasks, some have no strong points of their own.
PIVOT_BYTES = 1 << 30
#: Survivors of one group that a task compares another group's rows with, when groups are joined.
GROUP_ROWS = 20_000
_X = "__x{}".format


def _prepared(df: DataFrame, dims: Sequence[str] | None, direction: Mapping[str, str] | None) -> tuple[DataFrame, list[str]]:
    names = dimension_columns(df, dims)
    xs = [_X(i) for i in range(len(names))]
    rows = df.select("*", *(v.alias(x) for v, x in zip(oriented(df, names, direction), xs, strict=True)))
    return rows.where(usable([F.col(x) for x in xs])), xs


def _local(rows: DataFrame, xs: list[str], pivots: np.ndarray | None) -> DataFrame:
    """rows less those dominated by a pivot or by another row of their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        waiting: list[pa.RecordBatch] = []

        def reduce() -> pa.Table | None:
            if not waiting:
                return held
            table = pa.Table.from_batches(waiting)
            x = np.column_stack([table[c].to_numpy() for c in xs])
            mine = kernels.local_skyline(x, pivots)
            table, x = table.take(mine), x[mine]
            if held is None:
                return table
            both = pa.concat_tables([held, table])
            return both.take(kernels.local_skyline(np.column_stack([both[c].to_numpy() for c in xs])))

        size = 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.num_rows
            if size >= 100_000:
                held, waiting, size = reduce(), [], 0
        held = reduce()
        if held is not None:
            yield from held.to_batches()

    return rows.mapInArrow(run, rows.schema)


def _pivots(rows: DataFrame, xs: list[str]) -> np.ndarray:
    """The skyline of the PIVOTS points with the least sum of ranges-scaled coordinates: at most PIVOTS rows."""
    ends = rows.agg(*(f(x) for x in xs for f in (F.min, F.max))).first()
    scaled = F.lit(0.0)
    for i, x in enumerate(xs):
        low, high = ends[2 * i], ends[2 * i + 1]
        if low is None:
            return np.empty((0, len(xs)))
        if np.isfinite(high - low) and high > low:
            scaled = scaled + (F.col(x) - F.lit(low)) / F.lit(high - low)
    top = rows.select(*xs, scaled.alias("__s")).orderBy("__s").limit(PIVOTS).drop("__s").collect()
    found = np.array([tuple(r) for r in top], float).reshape(-1, len(xs))
    found = found[kernels.local_skyline(found)]
    return found[kernels.order(found)]


def _against(rows: DataFrame, others: DataFrame, xs: list[str]) -> DataFrame:
    """rows that no row of others, a checked number of rows, dominates, by an anti join."""
    o = others.select(*(F.col(x).alias(f"__o{x}") for x in xs))
    return rows.join(F.broadcast(o), dominates([F.col(f"__o{x}") for x in xs], [F.col(x) for x in xs]), "left_anti")


def _undominated(rows: DataFrame, xs: list[str], strong: np.ndarray) -> DataFrame:
    """rows that none of the points, a counted number of them in order, dominates. Most rows meet one that does early."""
    held = rows.sparkSession.sparkContext.broadcast(strong)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in xs])
            yield batch.filter(pa.array(~kernels.dominated_by(x, held.value)))

    return rows.mapInArrow(run, rows.schema)


def _holding(out: DataFrame, *kept: DataFrame) -> DataFrame:
    """out, whose persisted inputs are dropped when the caller drops it."""
    for df in kept:
        weakref.finalize(out, df.unpersist).atexit = False
    return out


def _two_phase(rows: DataFrame, xs: list[str]) -> DataFrame:
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    pivots = _pivots(rows, xs) if size > PIVOT_BYTES else None
    local = _local(rows, xs, pivots).persist()  # the survivors only
    try:
        n, parts = local.count(), max(1, local.rdd.getNumPartitions())
        while parts > 1 and n > MERGE_ROWS and n / parts < MERGE_ROWS:  # merge some tasks as long as that leaves fewer
            fewer = max(1, min(parts // 8, int(n / MERGE_ROWS) + 1))
            merged = _local(local.coalesce(fewer), xs, None).persist()
            m = merged.count()
            local.unpersist()
            local, parts, shrunk, n = merged, fewer, m < 0.8 * n, m
            if not shrunk:
                break
        if n <= MERGE_ROWS:
            return _holding(_local(local.coalesce(1), xs, None) if parts > 1 else local.select("*"), local)
        distinct = Table(local.select(*xs).distinct(), "skyline-survivors").df  # equal points once
        n = distinct.count()
        out, blocks = local, -(-n // BROADCAST_ROWS)
        number = F.pmod(F.xxhash64(*xs), F.lit(blocks))
        for b in range(blocks):  # a counted number of points at a time, the strongest first
            rows_ = (distinct.where(number == b) if blocks > 1 else distinct).collect()
            found = np.array([tuple(r) for r in rows_], float).reshape(-1, len(xs))
            out = _undominated(out, xs, found[kernels.order(found)])
        return _holding(out, local)
    except Exception:
        local.unpersist()
        raise


def _window2d(rows: DataFrame, xs: list[str], parts: int = 256) -> DataFrame:
    """Two dimensions without any join of points: along the first, a point stays if its second value is below
    all before it. The first dimension is cut into ranges, so the windows run in as many tasks."""
    a, b = xs
    edges = sorted(set(rows.approxQuantile(a, [i / parts for i in range(1, parts)], 0.002)))
    part: Column = F.lit(0)
    if edges:
        part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(a)))
    least = rows.groupBy(a).agg(F.min(b).alias("__b")).withColumn("__part", part)
    before = F.min("__b").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    heads = least.groupBy("__part").agg(F.min("__b").alias("__b")).select("__part", before.alias("__head"))  # a row a range
    inside = F.min("__b").over(W.partitionBy("__part").orderBy(a).rowsBetween(W.unboundedPreceding, -1))
    kept = least.withColumn("__inside", inside).join(F.broadcast(heads), "__part")
    floor = F.least("__inside", "__head")  # least() passes over nulls
    kept = kept.where(floor.isNull() | (F.col("__b") < floor)).select(F.col(a).alias("__ka"), F.col("__b").alias("__kb"))
    return rows.join(kept, (F.col(a) == F.col("__ka")) & (F.col(b) == F.col("__kb")), "left_semi")


def skyline(
    df: DataFrame,
    dims: Sequence[str] | None = None,
    direction: Mapping[str, str] | None = None,
    by: Sequence[str] = (),
    distinct: bool = False,
    strategy: str = "auto",
) -> DataFrame:
    """Rows of df that no row of df (of the same group, with `by`) dominates; all its columns.

    dims: the dimensions (default: columns Dim_0, Dim_1, ...), smaller is better unless direction says "max".
    Equal points don't dominate each other and all stay; distinct keeps one row of each. Rows with a null or
    NaN in a dimension are dropped. Empty in, empty out.

    strategy: "anti" is one anti join (of up to BROADCAST_ROWS rows; beyond, two_phase); "two_phase" reduces every task's rows to their own
    skyline first, then merges; "window2d" is for two dimensions; "auto" takes two_phase.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    names = dimension_columns(df, dims)
    rows, xs = _prepared(df, names, direction)
    if distinct:
        rows = rows.dropDuplicates([*names, *by])
    if strategy == "window2d" and (len(xs) != 2 or by):
        raise ValueError("window2d needs two dimensions and no groups")
    if by:
        found = _by_group(rows, xs, list(by))
    elif strategy == "anti" and rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = _against(rows, rows, xs)
    elif strategy == "window2d":
        found = _window2d(rows, xs)
    else:
        found = _two_phase(rows, xs)
    out = found.drop(*xs)
    return _holding(out, *([found] if strategy in ("auto", "two_phase") and not by else []))


def _grouped_local(rows: DataFrame, xs: list[str], by: list[str]) -> DataFrame:
    """rows less those dominated by another row of their group in their task. A task holds the survivors so far of its
    groups, and rows that wait to be compared with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        waiting: list[pa.RecordBatch] = []

        def reduce() -> pa.Table | None:
            if not waiting:
                return held
            table = pa.Table.from_batches(waiting)
            table = pa.concat_tables([held, table]) if held is not None else table
            codes = table.select(by).to_pandas().groupby(by, dropna=False, sort=False).ngroup().to_numpy()
            x = np.column_stack([table[c].to_numpy() for c in xs])
            at = np.argsort(codes, kind="stable")
            groups = np.split(at, np.flatnonzero(np.diff(codes[at])) + 1)
            return table.take(pa.array(np.sort(np.concatenate([g[kernels.local_skyline(x[g])] for g in groups]))))

        size = 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.num_rows
            if size >= max(100_000, held.num_rows if held is not None else 0):
                held, waiting, size = reduce(), [], 0
        held = reduce()
        if held is not None:
            yield from held.to_batches()

    return rows.mapInArrow(run, rows.schema)


def _by_group(rows: DataFrame, xs: list[str], by: list[str]) -> DataFrame:
    """A local skyline per group in every task, before any shuffle and again after groups have been dealt out in parts;
    what is left meets the distinct survivors of its group in an anti join. Both are split for groups with many
    survivors, so that one group keeps many tasks busy."""
    local = Table(_grouped_local(rows, xs, by), "group-survivors")
    n, before = local.df.count(), None
    while before is None or n < 0.8 * before:  # another deal, in parts of a few times what a task compares at once
        salts = max(1, -(-n // (4 * GROUP_ROWS)))
        salt = F.pmod(F.xxhash64(*xs), F.lit(salts))
        dealt = local.df.withColumn("__salt", salt).repartition(*by, "__salt").drop("__salt")
        after = Table(_grouped_local(dealt, xs, by), "group-survivors")
        local.drop()
        local, before, n = after, n, after.df.count()
        if salts == 1:
            return local.df
    survivors = Table(local.df.select(*by, *xs).distinct(), "group-distinct")
    sizes = survivors.df.groupBy(*by).agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("__parts"))
    mine = [F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]
    parts = Table(sizes.select(*mine, "__parts"), "group-parts").df
    same = reduce_(and_, [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)])
    keys = [f"__g{i}" for i in range(len(by))]
    left = local.df.join(parts, same).withColumn("__part", F.pmod(F.xxhash64(*xs, F.monotonically_increasing_id()), F.col("__parts")).cast("int"))
    right = survivors.df.join(parts, same).withColumn("__opart", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    o = right.select(*(F.col(k).alias(f"__o{k}") for k in keys), *(F.col(x).alias(f"__o{x}") for x in xs), "__opart")
    condition = dominates([F.col(f"__o{x}") for x in xs], [F.col(x) for x in xs]) & (F.col("__part") == F.col("__opart"))
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__o{k}"))
    return left.join(o, condition, "left_anti").drop(*keys, "__parts", "__part")
