"""Event streams: windows with watermarks, deduplication, validation, and changes applied to a table.

The transformations take any DataFrame, streaming or not, so that a batch run over the same files gives the same rows. Sinks run under a checkpoint, and each batch may be repeated without harm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import last_per_key
from ..sources.tables import shared_dir, upserted


def read_files(spark: SparkSession, path: str, schema: str, most_files: int = 64) -> DataFrame:
    """New Parquet files below path as a stream, a bounded number a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def tumbling(events: DataFrame, at: str, width: str, by: Sequence[str], late: str = "10 minutes") -> DataFrame:
    w = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return w.groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("begin"), *by, "n", "total")


def sliding(events: DataFrame, at: str, width: str, step: str, by: Sequence[str], late: str = "10 minutes") -> DataFrame:
    w = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return w.groupBy(F.window(at, width, step).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), *by, "n")


def sessions(events: DataFrame, at: str, gap: str, by: Sequence[str], late: str = "10 minutes") -> DataFrame:
    w = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return w.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, at: str, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """One row of each key; a stream forgets keys after the watermark."""
    e = events.withColumn(at, F.col(at).cast("timestamp"))
    return e.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys)) if e.isStreaming else e.dropDuplicates(list(keys))


def expectations(events: DataFrame, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """Each rule with what to do where it doesn't hold (null counts as failing): "warn" lists its name in failed, "drop" leaves the row out, "fail" raises."""
    bad = {n: ~F.coalesce(c, F.lit(False)) for n, (c, _) in rules.items()}
    out = events
    for n, (_, what) in rules.items():
        if what == "drop":
            out = out.where(~bad[n])
        elif what == "fail":
            out = out.where(F.when(bad[n], F.raise_error(F.lit(f"expectation {n} failed")).cast("boolean")).otherwise(True))
    warn = [F.when(bad[n], F.lit(n)) for n, (_, what) in rules.items() if what == "warn"]
    return out.withColumn("failed", F.array_compact(F.array(*warn)) if warn else F.array().cast("array<string>"))


def apply_changes(state: DataFrame, changes: DataFrame, keys: Sequence[str], sequence: str, deleted: Column) -> DataFrame:
    """state with the last change of each key; one of a smaller sequence than the row has is left out, so late and repeated changes do no harm. Rows that are deleted stay as tombstones (is_deleted), without which a late change could bring them back."""
    new = last_per_key(changes.withColumn("is_deleted", F.coalesce(deleted, F.lit(False))), keys, [sequence, "is_deleted"])
    return upserted(state, new.select(*state.columns), list(keys), sequence)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, to Parquet, then the end. The sink's log and the checkpoint make a repeated batch harmless."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def collect_available(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Everything that is there now as a table in the shared folder: each batch replaces its own part of it, so the last complete batch is the result."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/{name}"

    def sink(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={0 if mode == 'complete' else k}")

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    if mode == "update":
        # the batch of each row tells which update is the last
        return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch int").parquet(f"{at}/rows")
    return spark.read.schema(stream.schema).parquet(f"{at}/rows/batch=*")


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) of a stream, a state of two numbers for each key that batches carry on; each batch tells the keys that it has touched."""
    kind = events.schema[key].dataType.simpleString()

    def step(k, frames, state):
        import pandas as pd

        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["v"].sum())
        state.update((n, total))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "total": [total]})

    slim = events.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v"))
    return slim.groupBy("key").applyInPandasWithState(step, f"key {kind}, n long, total double", "n long, total double", "update", "NoTimeout")


def lookback_start(now: Column, delay_days: int, lifecycle_days: int, window_days: int) -> Column:
    """The first day that has to be computed again: what can still change, and the window that reads it."""
    return F.date_sub(now, delay_days + lifecycle_days + window_days)
