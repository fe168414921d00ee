"""Order within groups: carried context, islands, question-answer pairs, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def carry_forward(value: Column, keys: list[str], order: list[Column]) -> Column:
    """The last value that isn't NULL so far in the group."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def sequence_id(prefix: Column, keys: list[str], order: list[Column], width: int = 3) -> Column:
    """``prefix-001`` by place in the group."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("string")
    return F.concat(prefix, F.lit("-"), F.lpad(n, width, "0"))


def speaker_blocks(df: DataFrame, keys: list[str], order: list[Column], speaker: Column, reset: Column) -> DataFrame:
    """Runs of rows of one speaker.

    A row without a speaker belongs to the last one named, unless a row that resets stands
    between; rows that reset, and rows of no speaker, are dropped after they have cut a run.
    ``keys, block, speaker, n, first_at, last_at`` (places in the group, from 1).
    """
    ordered = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumns({"__at": F.row_number().over(ordered), "__reset": reset, "__named": F.when(reset, F.lit("\0")).otherwise(speaker)})
    rows = rows.withColumn("speaker", F.nullif(F.last("__named", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0)), F.lit("\0")))
    rows = rows.withColumn("speaker", F.when(F.col("__reset"), None).otherwise(F.col("speaker")))
    changed = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(ordered)) | F.col("__reset")
    rows = rows.withColumn("__run", F.sum(changed.cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))).where("speaker is not null")
    runs = rows.groupBy(*keys, "__run", "speaker").agg(F.count("*").alias("n"), F.min("__at").alias("first_at"), F.max("__at").alias("last_at"))
    return runs.withColumn("block", F.row_number().over(Window.partitionBy(*keys).orderBy("__run"))).select(*keys, "block", "speaker", "n", "first_at", "last_at")


def pair_answers(df: DataFrame, keys: list[str], order: str, asks: Column, answers: Column) -> DataFrame:
    """``keys, question, answer, supplementary``: each answer with the latest question that
    has no answer yet, as places in the order; a question's number among the questions, from 0."""
    ordered = Window.partitionBy(*keys).orderBy(order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.where(asks | answers).withColumns({"__q": F.last(F.when(asks, F.col(order)), ignorenulls=True).over(so_far), "__i": F.sum(asks.cast("int")).over(so_far) - 1, "__answers": answers})
    rows = rows.where("__answers and __q is not null")
    first = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, "__q").orderBy(order))).where("__rn = 1")
    return first.select(*keys, F.col("__q").alias("question"), F.col(order).alias("answer"), F.col("__i").cast("int").alias("supplementary"))


def changed_lines(lines: Column) -> Column:
    """An array without the entries that equal the one before."""
    return F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1)))
