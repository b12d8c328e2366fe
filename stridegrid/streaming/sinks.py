"""Sinks of streams: written results, snapshots by epoch, progress rows, and rows that close a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def with_close(stream: DataFrame, path: str) -> DataFrame:
    """``stream`` and the rows that ``write_close`` left in ``path``."""
    return stream.unionByName(stream.sparkSession.readStream.schema(stream.schema).parquet(path))


def write_close(rows: DataFrame, path: str, time: str, after: str) -> None:
    """One row, null but for a time ``after`` the last one of ``rows``: its watermark closes all windows of a stream that ends."""
    last = rows.agg((F.max(time) + F.expr(f"INTERVAL {after}")).alias(time)).where(F.col(time).isNotNull())
    kinds = {f.name: f.dataType for f in rows.schema}
    last.select(*[(F.col(time) if c == time else F.lit(None)).cast(kinds[c]).alias(c) for c in rows.columns]).write.parquet(path)


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All rows that an append stream gives for what its sources hold now, as a table."""
    writing = stream.writeStream.format("parquet").outputMode("append")
    writing = writing.option("path", path).option("checkpointLocation", checkpoint)
    writing.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def write_snapshots(stream: DataFrame, keys: list[str], at: str, path: str, checkpoint: str):
    """Keep what each micro-batch says of every key; returns the running query.

    A micro-batch gives one row per key: rows, first and last ``at`` and the row
    of the last. It stands in a folder of its epoch that a replay overwrites, so
    nothing counts twice. ``snapshot`` reads them.
    """
    rest = [c for c in stream.columns if c not in (*keys, at)]

    def save(batch: DataFrame, epoch: int) -> None:
        last = F.max(F.struct(at, *rest)).alias("newest")
        told = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min(at).alias(f"first_{at}"), last)
        told.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writing = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writing.trigger(availableNow=True).start()


def snapshot(saved: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The newest row of every key over all epochs, with its rows and the first and last ``at``."""
    told = saved.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.min(f"first_{at}").alias(f"first_{at}"), F.max("newest").alias("newest")
    )
    rest = [f.name for f in saved.schema["newest"].dataType if f.name != at]
    newest = [F.col("newest")[c].alias(c) for c in rest]
    return told.select(*keys, "rows", f"first_{at}", F.col("newest")[at].alias(f"last_{at}"), *newest)


class ProgressRows(StreamingQueryListener):
    """Progress of the streams of a session, one row per micro-batch; ``spark.streams.addListener`` starts it."""

    schema = "name string, batch bigint, input_rows bigint, rows_per_second double, watermark string, late_rows bigint"

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self.rows.append((p.name, p.batchId, p.numInputRows, p.processedRowsPerSecond, p.eventTime.get("watermark"), late))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
