"""A stream of corrected bars merged into a repository table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.repository import Repository


def latest(batch: DataFrame, order: str) -> DataFrame:
    """The last row of each (symbol, date) by ``order``."""
    fields = [c for c in batch.columns if c not in ("symbol", "date")]
    return batch.groupBy("symbol", "date").agg(F.max_by(F.struct(*fields), order).alias("r")).select("symbol", "date", *(F.col(f"r.{c}").alias(c) for c in fields if c != order))


def stream_into(stream: DataFrame, repository: Repository, kind: str, checkpoint: str, order: str = "arrived") -> StreamingQuery:
    """Upsert each micro-batch: new rows replace old ones, so late and repeated rows need no state."""

    def write(batch: DataFrame, _: int) -> None:
        rows = latest(batch, order)
        if not rows.isEmpty():
            repository.update(kind, rows)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
