"""Values carried along an order, and joins on the nearest row in time.

Rows are range-partitioned by (keys, order), so a key of any share is dealt over many tasks.
Within a partition a window carries the last value; what crosses a partition's edge is one
row for each (partition, key), and those rows are carried over the partitions by a window of
their own.  No join compares ranges, and nothing goes to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.ranking import checkpointed


def _both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def carried(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], strict: bool = False, backwards: bool = False) -> DataFrame:
    """``df`` with the columns ``values``: of each, the last that isn't NULL among the rows of the
    same keys up to the row itself in ``order`` (ascending, NULL first).

    ``strict`` leaves the row itself out; ``backwards`` goes through the order from its end.
    NULL keys are a key.  The order must be total for a defined result.  Columns of ``df`` may
    have any names but those of ``values``.
    """
    v, k, o = ([f"{x}{i}" for i in range(n)] for x, n in (("v", len(values)), ("k", len(keys)), ("o", len(order))))
    inner = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(F.col(f"`{c}`").alias(a) for c, a in zip(keys, k)), *(F.col(f"`{c}`").alias(a) for c, a in zip(order, o)), *(c.alias(a) for c, a in zip(values.values(), v)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(inner.repartitionByRange(parts, *k, *o).withColumn("part", F.spark_partition_id()))
    way = (lambda c: F.col(c).desc_nulls_last()) if backwards else (lambda c: F.col(c).asc_nulls_first())
    until = Window.unboundedPreceding, -1 if strict else 0
    here = Window.partitionBy(*k, "part").orderBy(*map(way, o)).rowsBetween(*until)
    place = F.struct(*o)
    edge = (F.min_by if backwards else F.max_by)
    edges = ranged.groupBy(*k, "part").agg(*(edge(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in v))
    beyond = Window.partitionBy(*k).orderBy(way("part")).rowsBetween(Window.unboundedPreceding, -1)
    over = edges.select(*(F.col(c).alias(f"e_{c}") for c in [*k, "part"]), *(F.last(c, ignorenulls=True).over(beyond).alias(f"b_{c}") for c in v))
    known = ranged.select("row", *k, "part", *(F.last(c, ignorenulls=True).over(here).alias(f"h_{c}") for c in v))
    met = known.join(over, _both([F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in k] + [F.col("part") == F.col("e_part")]))
    return met.select("row.*", *(F.coalesce(f"h_{c}", f"b_{c}").alias(name) for c, name in zip(v, values)))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, keep: list[str], direction: str = "backward", within: Column | None = None) -> DataFrame:
    """Every row of ``left`` with ``keep`` (and ``right_at``) of the right row that is nearest in time.

    ``backward`` takes the last row at or before ``left_at``, ``forward`` the first at or
    after it, ``nearest`` the nearer of both and the earlier where they are as near.  Of right rows
    with the same keys and time the one with the greatest ``keep`` counts.  Where none is
    found, or a key or a time is NULL, the added columns are NULL.  ``within`` is a condition
    on the joined columns beyond which a match counts as none.  Both sides are united and
    carried in one order; a time may be of any type that is ordered and, for ``nearest``, can be subtracted,
    the same on both sides.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {direction}")
    k = [f"k{i}" for i in range(len(keys))]
    usable = [F.col(c).isNotNull() for c in [*k, "at"]]
    payload = F.struct(*(F.col(f"`{c}`") for c in keep))
    own = left.select(F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("row"), *(F.col(f"`{c}`").alias(a) for c, a in zip(keys, k)), F.col(f"`{left_at}`").alias("at"), F.monotonically_increasing_id().alias("id"))
    theirs = right.select(*(F.col(f"`{c}`").alias(a) for c, a in zip(keys, k)), F.col(f"`{right_at}`").alias("at"), payload.alias("found")).where(_both(usable)).groupBy(*k, "at").agg(F.max("found").alias("found"))
    # at one time, rows of the right come first in the order that is gone through
    both = own.withColumn("kind", F.lit(0 if direction == "forward" else 1)).unionByName(theirs.withColumn("kind", F.lit(1 if direction == "forward" else 0)), allowMissingColumns=True)
    value = F.when(F.col("row").isNull(), F.struct("at", "found"))
    order = ["at", "kind", "id"]
    if direction == "nearest":
        both = carried(both, k, order, {"before": value})
        both = carried(both, k, order, {"after": value}, backwards=True)
        gap = lambda a, b: F.col(a) - F.col(b)  # noqa: E731  an interval of times, days of dates, a number of numbers
        earlier = F.col("before").isNotNull() & (F.col("after").isNull() | (gap("at", "before.at") <= gap("after.at", "at")))
        both = both.withColumn("match", F.when(earlier, F.col("before")).otherwise(F.col("after")))
    else:
        both = carried(both, k, order, {"match": value}, backwards=direction == "forward")
    match = F.when(_both(usable), F.col("match"))
    mine = both.where(F.col("row").isNotNull()).select("row", match.alias("match"))
    joined = mine.select("row.*", F.col("match.at").alias(right_at), *(F.col(f"match.found.`{c}`").alias(c) for c in keep))
    if within is None:
        return joined
    return joined.withColumns({c: F.when(within, F.col(f"`{c}`")) for c in [right_at, *keep]})


def numbered_at(rows: DataFrame, at: str, starts: DataFrame, start: str, number: str) -> DataFrame:
    """``rows`` with the number of the term that runs at a date: the last one that began by then; NULL before the first."""
    return asof_join(rows, starts, [], at, start, [number]).drop(start)
