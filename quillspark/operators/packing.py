"""Greedy packing of ordered items into windows and batches.

Packing is sequential within a group, so only (order, size) pairs of a group are gathered;
texts stay where they are and are joined by number afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_estimate(chars: Column) -> Column:
    """Tokens of a text by its characters."""
    return F.floor(chars / 4).cast("int")


def pack_sizes(sizes: Column, limit: int, most: int | None = None) -> Column:
    """Window number (from 0) of each size in an array.

    A window is closed when it isn't empty and the next item would pass ``limit`` in sum or
    ``most`` in number; an item larger than the limit has a window of its own.
    """
    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("window"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, size: Column) -> Column:
        full = (state["sum"] + size > limit) if most is None else ((state["sum"] + size > limit) | (state["n"] >= most))
        new = (state["n"] > 0) & full
        window = state["window"] + new.cast("int")
        return F.struct(F.when(new, size.cast("bigint")).otherwise(state["sum"] + size).alias("sum"), F.when(new, F.lit(1)).otherwise(state["n"] + 1).alias("n"), window.alias("window"), F.concat(state["out"], F.array(window)).alias("out"))

    return F.aggregate(sizes, zero, step, lambda s: s["out"])


def pack(df: DataFrame, keys: list[str], order: str, size: Column, limit: int, most: int | None = None) -> DataFrame:
    """``keys, order, window`` of every row; ``order`` is unique in a group."""
    items = df.select(*keys, F.col(order), size.cast("int").alias("__size"))
    listed = items.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "__size"))).alias("__items"))
    numbered = listed.withColumn("__windows", pack_sizes(F.transform("__items", lambda i: i["__size"]), limit, most))
    return numbered.select(*keys, F.explode(F.arrays_zip("__items", "__windows")).alias("i")).select(*keys, F.col(f"i.__items.{order}").alias(order), F.col("i.__windows").alias("window"))


def passages(sentences: Column, least: int = 120, most: int = 600) -> Column:
    """Array of struct<last, text>: passages of consecutive sentences and the number of the last one.

    Each is closed at ``least`` characters, and dropped where it is then longer than
    ``most``; what remains open at the end is lost.
    """
    zero = F.struct(F.lit("").alias("open"), F.lit(0).alias("i"), F.array().cast("array<struct<last:int,text:string>>").alias("out"))

    def step(state: Column, sentence: Column) -> Column:
        joined = F.when(state["open"] == "", sentence).otherwise(F.concat(state["open"], F.lit(" "), sentence))
        closed, i = F.length(joined) >= least, state["i"] + 1
        kept = closed & (F.length(joined) <= most)
        return F.struct(F.when(closed, F.lit("")).otherwise(joined).alias("open"), i.alias("i"), F.when(kept, F.concat(state["out"], F.array(F.struct(i.alias("last"), joined.alias("text"))))).otherwise(state["out"]).alias("out"))

    return F.aggregate(sentences, zero, step, lambda s: s["out"])
