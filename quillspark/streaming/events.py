"""Structured Streaming forms of the incremental operators, and windows over event time.

Tumbling, sliding and session windows are extensions; appending without repeats,
attempts, rolling gates and late verdicts follow the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, keys: list[str], size: str, slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """``start, keys, n, total`` of tumbling windows, or sliding ones with ``slide``."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withWatermark("ts", lateness).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, keys: list[str], gap: str, lateness: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), *keys, "n", "total")


def without_repeats(events: DataFrame, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark: what a restart sends again is dropped."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def count_attempts(failures: DataFrame, key: str, most: int) -> DataFrame:
    """``key, attempts, exhausted`` after every batch of failures, in update mode."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        n += sum(len(b) for b in batches)
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "attempts": [n], "exhausted": [n >= most]})

    kind = dict(failures.dtypes)[key]
    return failures.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, attempts bigint, exhausted boolean", "n bigint", "update", GroupStateTimeout.NoTimeout)


def with_late_verdicts(statements: DataFrame, verdicts: DataFrame, keys: list[str], lateness: str = "1 hour", wait: str = "2 hours") -> DataFrame:
    """Statements (``ts``) with the verdicts (``verdict_ts``) that arrive within ``wait``, else NULL."""
    s = statements.withWatermark("ts", lateness)
    v = verdicts.withWatermark("verdict_ts", lateness).select(*(F.col(k).alias(f"__{k}") for k in keys), "verdict", "verdict_ts")
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    near = F.expr(f"verdict_ts >= ts AND verdict_ts <= ts + INTERVAL {wait}")
    on = near
    for c in same:
        on = on & c
    return s.join(v, on, "leftOuter").drop(*(f"__{k}" for k in keys))


def append(stream: DataFrame, path: str, checkpoint: str, configuration: str = "") -> None:
    """Write all that is there and stop; run again to go on.

    The configuration is stored beside the checkpoint on the first run, and a run with
    another one is refused.
    """
    spark = stream.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}-configuration")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(where):
        stored = "\n".join(r["value"] for r in spark.read.text(where.toString()).collect())
        if stored != configuration:
            raise ValueError("the output was begun with another configuration")
    else:
        spark.createDataFrame([(configuration,)], "value string").coalesce(1).write.text(where.toString())
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
