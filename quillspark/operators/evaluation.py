"""Evaluation of scorers against labelled statements: what to run, what failed, and how models compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.stats import error_metrics


def gold_score(record: Column) -> Column:
    """First number among a map's values whose key ends in ``_score``, by key; NULL if there is none."""
    named = F.array_sort(F.map_entries(F.map_filter(record, lambda k, v: k.endswith("_score") & v.try_cast("double").isNotNull())))
    return F.get(named, F.lit(0))["value"].try_cast("double")


def plan(windows: DataFrame, id_: str, models: list[str], repeats: int, done: DataFrame | None = None) -> DataFrame:
    """``id_, model, repeat``: every window by every model as often as asked, without what is done.

    Models and repeats are short lists, unfolded beside each window.
    """
    runs = windows.select(id_).distinct().select(id_, F.explode(F.array(*map(F.lit, models))).alias("model")).select(id_, "model", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    return runs if done is None else runs.join(done.select(id_, "model", "repeat").distinct(), [id_, "model", "repeat"], "left_anti")


def details(rows: DataFrame) -> DataFrame:
    """``rows`` (``statement, gold, pred``) that can be judged, with ``error``: those without a
    statement, a gold score or an answer (a failed row) are skipped."""
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return rows.where(known("gold") & known("pred") & (F.coalesce("statement", F.lit("")) != "")).withColumn("error", F.abs(F.col("pred") - F.col("gold")))


def compare(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, skipped`` and the errors and correlation of each model, the best correlated first
    (``place`` from 1); those without a correlation come last.  A model all of whose rows failed stays, with n = 0."""
    from pyspark.sql.window import Window

    judged = details(rows)
    scores = judged.groupBy(*keys).agg(*error_metrics(F.col("gold"), F.col("pred")))
    total = rows.groupBy(*keys).agg(F.count("*").alias("asked"))
    joined = total.join(scores, keys, "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("skipped", F.col("asked") - F.col("n")).drop("asked")
    return joined.withColumn("place", F.row_number().over(Window.orderBy(F.coalesce("r", F.lit(-1.0)).desc(), *keys)))  # a row a model


def merge_scores(rows: DataFrame, keys: list[str], attribute: str, score: str) -> DataFrame:
    """``keys, scores``: one row for each statement of a speaker, its scores as a map by attribute.

    Of several scores of one attribute the greatest counts; NULL scores are left out, and a statement
    that has none has an empty map.
    """
    best = rows.groupBy(*keys, attribute).agg(F.max(score).alias("s"))
    entries = F.collect_list(F.when(F.col("s").isNotNull() & F.col(attribute).isNotNull(), F.struct(attribute, "s")))
    return best.groupBy(*keys).agg(F.map_from_entries(F.array_sort(entries)).alias("scores"))


def preferred(windows: DataFrame, speakers: str, text: str, order: str, k: int) -> DataFrame:
    """The ``k`` windows to look at first: those of several speakers, then the longest, then by ``order``."""
    return windows.orderBy(F.when(F.size(speakers) > 1, 0).otherwise(1), F.length(text).desc(), order).limit(k)


def rendered(rows: DataFrame, keys: list[str], order: str, parts: list[tuple[str, str]]) -> DataFrame:
    """``keys, n, prompt``: a batch's rows as text, numbered in order, a line for each part that is there."""
    lines = F.concat_ws("\n", *(F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))) for label, c in parts))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), lines.alias("t")))).alias("l"))
    numbered = F.transform("l", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]\n"), x["t"]))
    return listed.select(*keys, F.size("l").alias("n"), F.array_join(numbered, "\n\n").alias("prompt"))
