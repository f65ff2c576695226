"""A corpus pipeline: quality, near-duplicates, decontamination, mixing, shards.

Each stage gets (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as Parquet
to the shared folder and reads it back as the next stage's docs. All but the last return the columns of docs.
Decisions are made for an id: rows that repeat one stay or go together, and so do rows without one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm import contamination, mixing, near_copies, quality, sharding
from vantage.llm.common import materialise, read
from vantage.llm.queries import MIX_WEIGHTS

ID = "doc_id"


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows whose id is in gone (id); only the ids, written down before, are joined."""
    ids = materialise(gone.select(F.col("id").alias("__gone")).distinct(), "pipeline-ids")
    return docs.join(ids.hint("merge"), docs[ID].eqNullSafe(ids["__gone"]), "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking rejects go."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return docs.where(quality.score_column(model, "text") >= quality.CUT)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, at a similarity of 0.8 of five-word shingles, the document with the smallest id
    stays."""
    found = near_copies.near_copies(docs)
    return _without(docs, found.where("NOT id <=> component_id"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    found = contamination.contamination(docs, read(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their rate says: some not at all, a few twice. The quality stage has taken
    most of the domain low, which gets its share as far as there is some left; the others aren't scaled down. Domains
    without labelled rows have no target, and without any labelled row all documents stay."""
    labelled = mixing.label_domains(read(spark, sf_dir, "labels"))
    known = {r["domain"] for r in labelled.select("domain").distinct().collect()}  # three at most
    weights = {d: w for d, w in MIX_WEIGHTS.items() if d in known}
    if not weights:
        return docs
    rated, _ = mixing.mix(docs, labelled, weights, whole=read(spark, sf_dir, "documents"), filtered=("low",))
    times = rated.groupBy("id").agg(F.max(mixing.copies(F.col("rate"), F.col("id"))).alias("__times"))
    other = materialise(times.where("__times <> 1"), "pipeline-times")  # most are taken once
    joined = docs.join(other.hint("merge"), docs[ID].eqNullSafe(other["id"]), "left").drop(other["id"])
    taken = joined.withColumn("__n", F.explode(F.sequence(F.lit(0), F.coalesce("__times", F.lit(1)))))
    return taken.where("__n > 0").drop("__times", "__n")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' shards and slots."""
    return sharding.shard(docs).withColumnRenamed("id", ID)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]
#: Classifiers and the solver can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
