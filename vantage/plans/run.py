"""A whole run over a point file: skyline, top-k dominating, top-k of the skyline, and a record of it."""

from __future__ import annotations

import argparse
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..functions.dominance import dimension_columns
from ..operators.cells import cell_summary, grid_dimensions, quantile_edges
from ..operators.points import as_points
from ..operators.score import dominance_score
from ..operators.skyline import skyline
from ..operators.topk import topk_by_score, topk_dominating, topk_skyline
from ..sources.points import format_result, read_points_csv, write_run_record


@dataclass
class Measured:
    """What Spark's own counters say of the stages of a query."""

    seconds: float  #: from the first task's start to the last task's end
    merge_seconds: float  #: from the end of the first stage that reads the points to the end
    reads: int  #: rows read from inputs, caches and shuffles
    overflows: int  #: bytes that didn't fit into memory
    stages: int
    tasks: int


def _stage(store, number: int):
    """Spark's record of a stage; None if it keeps none (skipped, or one of more than spark.ui.retainedStages)."""
    try:
        return store.lastStageAttempt(number)
    except Py4JJavaError as e:
        if "NoSuchElementException" in str(e.java_exception):
            return None
        raise


def measured(spark: SparkSession, query: Callable[[], DataFrame]) -> tuple[DataFrame, Measured]:
    """The persisted result of a query, and the counters of all stages that its jobs ran."""
    context, group = spark.sparkContext, f"vantage-{uuid.uuid4().hex}"
    context.setJobGroup(group, "a measured query")
    try:
        result = query().persist()
        result.count()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
    scala = context._jsc.sc()
    scala.listenerBus().waitUntilEmpty()
    tracker, store = context.statusTracker(), scala.statusStore()
    infos = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    known = (_stage(store, i) for i in sorted({i for info in infos if info for i in info.stageIds}))
    ran = [d for d in known if d is not None and d.firstTaskLaunchedTime().isDefined()]
    starts = [d.firstTaskLaunchedTime().get().getTime() for d in ran]
    ends = [d.completionTime().get().getTime() if d.completionTime().isDefined() else t for d, t in zip(ran, starts, strict=True)]
    end = max(ends, default=0)
    return result, Measured(
        (end - min(starts, default=0)) / 1000,
        (end - min(ends, default=0)) / 1000,
        sum(d.inputRecords() + d.shuffleReadRecords() for d in ran),
        sum(d.diskBytesSpilled() for d in ran),
        len(ran),
        sum(d.numTasks() for d in ran),
    )


@dataclass
class Run:
    skyline: DataFrame
    topk: DataFrame
    topk_skyline: DataFrame
    record: dict = field(default_factory=dict)
    counters: dict[str, Measured] = field(default_factory=dict)


def run(points: DataFrame, k: int = 10, k_skyline: int = 10, dims: Sequence[str] | None = None, id_col: str = "id", distribution: str = "", partitions: int | None = None) -> Run:
    """All three queries over points, with the seconds of each; the points are kept in memory meanwhile.

    partitions deals the points anew at random; the results don't depend on it. The record has the sixteen fields of
    the published result files. What they call the tree is the cell summary here: its time, the rows read and the bytes
    spilled on the way to it. Sol1 finds the skyline and its best points at once; Sol2 scores all of a skyline that is
    there already, and, as published, the time of that one isn't in it."""
    names = dimension_columns(points, dims)
    spark = points.sparkSession
    rows = (points.repartition(partitions) if partitions else points).persist()
    n = rows.count()
    as_doubles, xs = as_points(rows, names)
    work = {
        "tree": lambda: cell_summary(as_doubles, xs[: grid_dimensions(len(xs))], quantile_edges(as_doubles, xs[: grid_dimensions(len(xs))])),
        "skyline": lambda: skyline(rows, names),
        "topk": lambda: topk_dominating(rows, k, names, id_col),
        "sol1": lambda: topk_skyline(rows, k_skyline, names, id_col),
    }
    found, counters = {}, {}
    for name, query in work.items():
        found[name], counters[name] = measured(spark, query)
    found["sol2"], counters["sol2"] = measured(spark, lambda: topk_by_score(dominance_score(rows, names, id_col, candidates=found["skyline"]), k_skyline, id_col))
    for name in ("tree", "sol2"):
        found[name].unpersist()
    parts = rows.rdd.getNumPartitions()
    rows.unpersist()
    record = {
        "distribution": distribution,
        "dataSize": n,
        "nDims": len(names),
        "nPartitions": parts,
        "totalTreeCreationTime": counters["tree"].seconds,
        "totalTreeCreationIOs": counters["tree"].reads,
        "totalNOverflow": counters["tree"].overflows,
        "totalSkylineTime": counters["skyline"].seconds,
        "aggrSkylineTime": counters["skyline"].merge_seconds,
        "kForDataset": k,
        "totalTopKTime": counters["topk"].seconds,
        "aggrTopKTime": counters["topk"].merge_seconds,
        "kForSkyline": k_skyline,
        "totalSkyTopKTime_Sol1": counters["sol1"].seconds,
        "aggrSkyTopKTime": counters["sol1"].merge_seconds,
        "totalSkyTopKTime_Sol2": counters["sol2"].seconds,
    }
    return Run(found["skyline"], found["topk"], found["sol1"], record, counters)


def topk_skyline_by_scores(points: DataFrame, k: int, dims: Sequence[str] | None = None, id_col: str = "id") -> DataFrame:
    """The other way to the same result: score the whole skyline, then take the best."""
    names = dimension_columns(points, dims)
    return topk_by_score(dominance_score(points, names, id_col, candidates=skyline(points, names)), k, id_col)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> str:
    from ..session import local_session

    p = argparse.ArgumentParser(description="Skyline and top-k dominating points of a CSV file.")
    p.add_argument("data")
    p.add_argument("k", type=int, nargs="?", default=10)
    p.add_argument("k_skyline", type=int, nargs="?", default=10)
    p.add_argument("--partitions", type=int)
    p.add_argument("--distribution", default="")
    p.add_argument("--record", help="folder for the run's record as JSON")
    a = p.parse_args(argv)
    spark = spark or local_session()
    done = run(read_points_csv(spark, a.data), a.k, a.k_skyline, distribution=a.distribution, partitions=a.partitions)
    if a.record:
        write_run_record(spark, done.record, a.record)
    return "\n\n".join(format_result(rows, title) for title, rows in (("Skyline", done.skyline), ("Top-k dominating", done.topk), ("Top-k of the skyline", done.topk_skyline)))


if __name__ == "__main__":
    print(main())
