"""The folder that all executors share, and tables written to it on the way to a result."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local master gets a temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="vantage-"))
    return f"{base.rstrip('/')}/vantage-{app}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def purge(spark: SparkSession) -> None:
    """Delete every intermediate table of this application."""
    drop_path(spark, shared_dir(spark))


_cleaned: set[str] = set()


def _purge_at_exit(spark: SparkSession) -> None:
    try:
        purge(spark)
    except Exception:  # the JVM has gone already; nothing more can be done at exit
        pass
    for base in _own.values():  # folders made here, for local masters only
        shutil.rmtree(base.removeprefix("file://"), ignore_errors=True)


#: Settings while a table is written: its shuffle files go as soon as it is there.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Table:
    """A DataFrame written once to the shared folder, so that a lost executor costs no recomputation."""

    def __init__(self, df: DataFrame, label: str, conf: dict[str, str] | None = None):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, label)
        app = self.spark.sparkContext.applicationId
        if app not in _cleaned:
            _cleaned.add(app)
            atexit.register(_purge_at_exit, self.spark)
        with settings(self.spark, _WRITING | (conf or {})):
            df.write.parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    return Table(df, label).df
