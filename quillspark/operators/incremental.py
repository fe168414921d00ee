"""Incremental runs: what is left to do, attempts, verdicts that arrive later, rolling budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def todo(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the plan whose key isn't saved yet."""
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``new``, and those of ``old`` of other keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def attempts(failures: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``keys, attempts, exhausted``."""
    return failures.groupBy(*keys).agg(F.count("*").alias("attempts")).withColumn("exhausted", F.col("attempts") >= most)


def rolling_sums(df: DataFrame, keys: list[str], ts: str, value: str, hours: dict[str, int]) -> DataFrame:
    """Sums of ``value`` over trailing hours, both ends included, one column for each window.

    The range is over whole microseconds, so ties on time share one sum.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumn("__us", micros)
    for name, h in hours.items():
        over = Window.partitionBy(*keys).orderBy("__us").rangeBetween(-h * 3_600_000_000, 0)
        rows = rows.withColumn(name, F.sum(value).over(over))
    return rows.drop("__us")


def join_verdicts(statements: DataFrame, verdicts: DataFrame, keys: list[str], values: dict[str, float]) -> DataFrame:
    """``keys, state, score, prior_score`` of statements (``statement, score, prior``) and
    verdicts (``statement, verdict``).

    A verdict counts only where key and statement agree; one of another statement makes the
    row stale.  Verdicts outside ``values`` leave it pending: no score.  A prior is kept beside, never in, the score.
    """
    v = verdicts.select(*keys, F.col("statement").alias("__vs"), "verdict")
    j = statements.join(v, keys, "left")
    agrees = F.trim("__vs") == F.trim("statement")
    worth = F.lit(None).cast("double")
    for name, value in values.items():
        worth = F.when(F.col("verdict") == name, F.lit(value)).otherwise(worth)
    state = F.when(F.col("__vs").isNotNull() & ~agrees, "stale").when(F.col("score").isNotNull(), "scored").when(F.col("verdict").isin(*values), "resolved").when(F.col("verdict").isNotNull(), "pending").otherwise("prior")
    return j.select(*keys, state.alias("state"), F.coalesce("score", F.when(agrees, worth)).alias("score"), F.when(F.col("score").isNull(), F.col("prior")).alias("prior_score"))
