"""A skyline kept up to date under a stream of points."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.skyline import skyline


def maintain_skyline(
    points: DataFrame, path: str, checkpoint: str, dims: Sequence[str] | None = None, direction: Mapping[str, str] | None = None, **trigger
) -> StreamingQuery:
    """Folds each micro-batch of a streaming DataFrame into the skyline in folder path/v<batch>.

    The skyline of all points so far is that of the last skyline and the new points. A batch that is run
    again writes the same folder again, from the same predecessor."""

    def fold(batch: DataFrame, number: int) -> None:
        rows = batch
        if number:
            rows = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/v{number - 1}"))
        skyline(rows, dims, direction).write.mode("overwrite").parquet(f"{path}/v{number}")

    return points.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
