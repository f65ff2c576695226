"""Input checks and texts of the training-data operators; their intermediate tables are those of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Table, drop_path, materialise, new_path, purge, settings, shared_dir

__all__ = ["SPACES", "SPACE_CLASS", "Table", "drop_path", "let", "materialise", "new_path", "purge", "read", "require", "settings", "shared_dir", "words_sql"]

#: [\x20\x09-\x0D] as a character class body for Java regular expressions, and as a plain string.
SPACE_CLASS = "\\x20\\x09-\\x0D"
SPACES = " \t\n\x0b\x0c\r"


def words_sql(text: Column) -> Column:
    """Native words [^\\x20\\x09-\\x0D]+ of a text; an empty array for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE_CLASS}]+"))


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row, even where body uses it inside a lambda function."""
    return F.element_at(F.transform(F.array(value), body), 1)


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
