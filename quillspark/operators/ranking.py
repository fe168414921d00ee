"""Ranks, percentiles, samples and picks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share: the session's checkpoint folder; a local session without one gets its own."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "quillspark-scratch"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder that the session names (its own where none is named)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def global_row_number(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number all rows from 1 in a total order without gathering them in one task.

    Rows are range-partitioned and sorted; each partition counts its own, and only the
    partitions' counts go to the driver.  ``order`` must end with a unique key.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    fixed = checkpointed(sorted_.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["p"], r["n"]) for r in fixed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    bases, total = [], 0
    for p, n in sizes:
        bases.append((p, total))
        total += n
    base = F.broadcast(df.sparkSession.createDataFrame(bases, "__p bigint, __base bigint"))
    return fixed.withColumn("__p", part).join(base, "__p").withColumn(name, F.col("__base") + place + 1).drop("__p", "__base", "__at")


def percentile_rank(value: Column, cohort: list[str]) -> Column:
    """Place of a value in its cohort from 0 to 1, ties averaged; 0.5 in a cohort of one; NULL stays."""
    over = Window.partitionBy(*cohort)
    below = F.rank().over(over.orderBy(value.asc_nulls_last())) - 1
    ties = F.count(value).over(over.orderBy(value.asc_nulls_last()).rangeBetween(0, 0)) - 1
    n = F.count(value).over(over)
    return F.when(value.isNull(), None).when(n == 1, F.lit(0.5)).otherwise((below + ties / 2) / (n - 1))


def blend(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that aren't NULL, with their weights scaled up to 1."""
    total = sum((F.when(c.isNotNull(), c * w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.try_divide(total, F.nullif(weight, F.lit(0.0)))


def first_rows(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group in the given order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= k).drop("__rn")


def _at(order: WindowSpec, keys: list[str]) -> tuple[Column, Column]:
    return F.row_number().over(order) - 1, F.count("*").over(Window.partitionBy(*keys))


def stride_sample(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Up to ``k`` rows of each group, at the places floor(i * n / k)."""
    at, n = _at(Window.partitionBy(*keys).orderBy(*order), keys)
    rows = df.withColumns({"__at": at, "__n": n})
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * F.col("__n") / k).cast("int"))
    return rows.where((F.col("__n") <= k) | F.array_contains(places, F.col("__at"))).drop("__at", "__n")


def spread_pick(df: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """Up to ``cap`` rows of each group, evenly spaced from its first to its last."""
    at, n = _at(Window.partitionBy(*keys).orderBy(*order), keys)
    rows = df.withColumns({"__at": at, "__n": n})
    places = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / (cap - 1)).cast("int"))
    return rows.where((F.col("__n") <= cap) | F.array_contains(places, F.col("__at"))).drop("__at", "__n")


def round_robin(df: DataFrame, strata: list[str], key: str, seed: str, limit: int) -> DataFrame:
    """``limit`` rows in turns over the strata, each in an order seeded by hash."""
    draw = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(draw, key))
    return df.withColumn("turn", turn).orderBy("turn", *strata).limit(limit)
