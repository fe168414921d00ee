"""Statistics: shrinkage, agreement, error metrics, histograms and densities.

NULL scores are missing evidence: they are never counted and never become zero.  Every
rate stands beside the number that it was made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Variance floor, and weight of the pooled variance in observations.
VARIANCE_FLOOR, POOL_WEIGHT = 1e-6, 4


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL where the whole is 0."""
    return F.try_divide(part.cast("double"), whole)


def geometric_mean(value: Column) -> Column:
    """Aggregate: geometric mean of values clamped to 1 at least."""
    return F.exp(F.avg(F.ln(F.greatest(value, F.lit(1.0)))))


def pearson(x: Column, y: Column, min_n: int = 3) -> Column:
    """Aggregate: correlation of the pairs without NULL; NULL below ``min_n`` pairs or where
    either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.var_pop(a) * F.var_pop(b)
    return F.when((F.count(a) >= min_n) & (F.var_pop(a) > 0) & (F.var_pop(b) > 0), F.covar_pop(a, b) / F.sqrt(spread))


def error_metrics(gold: Column, pred: Column, threshold: float = 0.5) -> list[Column]:
    """Aggregates: n, mae, rmse, binary_accuracy and r of the pairs without NULL."""
    both = gold.isNotNull() & pred.isNotNull()
    gap = F.when(both, pred - gold)
    same = F.when(both, ((pred >= threshold) == (gold >= threshold)).cast("double"))
    return [F.count(gap).alias("n"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(same).alias("binary_accuracy"), pearson(gold, pred, 2).alias("r")]


def histogram_bin(value: Column, bins: int) -> Column:
    """Bin of a value in 0 to 1; the last bin is closed, values outside go to the ends."""
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(value * bins).cast("int")))


def density(df: DataFrame, group: str, value: str, points: int = 81, low: float = 0.0, high: float = 100.0, bandwidth: float = 6.0) -> DataFrame:
    """``group, point, x, n, density``: Gaussian kernel density on an even grid.

    Each row is spread over the grid where it is read and summed there, so that only
    ``points`` sums for each group and task are shuffled.
    """
    step = (high - low) / (points - 1)
    spread = df.where(F.col(value).isNotNull()).select(group, value, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    x = F.lit(low) + F.col("point") * step
    z = (x - F.col(value)) / bandwidth
    return spread.withColumns({"x": x, "k": F.exp(-0.5 * z * z)}).groupBy(group, "point", "x").agg(F.count("*").alias("n"), (F.sum("k") / (F.count("*") * bandwidth * (2 * 3.141592653589793) ** 0.5)).alias("density"))


def shrink(df: DataFrame, entity: str, attribute: str, score: str) -> DataFrame:
    """Empirical-Bayes shrinkage of each entity's mean to the attribute's.

    ``entity, attribute, n, raw, adjusted, shrink, ci95, confidence, display``.  The prior mean weighs
    statements alike; the within-variance pools entities with two scores or more, and falls
    back to the variance of all scores where it is 0; the between-variance is what the entities' means
    vary beyond sampling.  An entity's own variance counts with weight (n - 1) / (n + 3).
    """
    scored = df.where(F.col(score).isNotNull()).select(F.col(entity).alias("entity"), F.col(attribute).alias("attribute"), F.col(score).cast("double").alias("score"))
    groups = scored.groupBy("attribute", "entity").agg(F.count("*").alias("n"), F.avg("score").alias("raw"), F.coalesce(F.var_samp("score"), F.lit(0.0)).alias("own"))
    everything = scored.groupBy("attribute").agg(F.avg("score").alias("prior_mean"), F.coalesce(F.var_samp("score"), F.lit(0.0)).alias("total_var"))
    spread = groups.groupBy("attribute").agg(F.avg(F.when(F.col("n") >= 2, F.col("own"))).alias("pooled"), F.coalesce(F.var_samp("raw"), F.lit(0.0)).alias("observed"), F.avg(1 / F.col("n")).alias("inverse"))
    prior = spread.join(everything, "attribute").select("attribute", "prior_mean", "observed", "inverse", F.coalesce(F.nullif(F.col("pooled"), F.lit(0.0)), F.col("total_var")).alias("w"))
    prior = prior.select("attribute", "prior_mean", F.greatest(F.lit(VARIANCE_FLOOR), F.col("observed") - F.col("w") * F.col("inverse")).alias("between"), F.greatest(F.lit(VARIANCE_FLOOR), F.col("w")).alias("within"))
    own_weight = (F.col("n") - 1) / (F.col("n") - 1 + POOL_WEIGHT)
    var = F.when(F.col("n") < 2, F.col("within")).otherwise(F.greatest(F.lit(VARIANCE_FLOOR), own_weight * F.col("own") + (1 - own_weight) * F.col("within")))
    rows = groups.join(prior, "attribute").withColumn("se2", var / F.col("n"))
    rows = rows.withColumn("shrink", F.col("between") / (F.col("between") + F.col("se2")))
    rows = rows.withColumns({"adjusted": F.col("shrink") * F.col("raw") + (1 - F.col("shrink")) * F.col("prior_mean"), "ci95": 1.96 * F.sqrt(1 / (1 / F.col("between") + 1 / F.col("se2")))})
    return rows.select("entity", "attribute", "n", "raw", "adjusted", "shrink", "ci95", confidence(F.col("shrink"), F.col("ci95"), F.col("n")).alias("confidence"), F.bround(100 * F.col("adjusted")).cast("int").alias("display"))


def confidence(shrink_: Column, ci95: Column, n: Column) -> Column:
    """Tier of an adjusted score."""
    return F.when(shrink_ < 0.25, "low").when((ci95 <= 0.05) & (n >= 8) & (shrink_ >= 0.5), "high").when((ci95 <= 0.12) & (n >= 3), "medium").otherwise("low")
