"""Results that arrive in batches, merged by key into a table; and windows over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylark.operators import merge


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in a batch."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert_into(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: each batch gives a new version of the table, ``path``/v=N, made of the one before and the batch.

    A batch that comes again, after a failure, writes the same version again, so its
    rows count once.
    """

    def run(batch: DataFrame, n: int) -> None:
        new = latest(batch, key, order)
        if n > 0:
            new = merge.upsert(batch.sparkSession.read.parquet(f"{path}/v={n - 1}"), new, key)
        new.write.mode("overwrite").parquet(f"{path}/v={n}")

    return run


def tumbling_counts(events: DataFrame, ts: str, keys: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by window and keys; on a stream, windows close when the watermark passes. A timestamp without zone is taken as UTC."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_ts", late)
    counted = timed.groupBy(F.window("_ts", width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *keys, "n")


def recovered(runs: DataFrame, status: str = "status") -> DataFrame:
    """After a restart: what was running is an error."""
    return runs.withColumn(status, F.when(F.col(status) == "RUNNING", "ERROR").otherwise(F.col(status)))
