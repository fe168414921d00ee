"""Evidence: the quality gate and the published tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def starts_sentence(text: Column) -> Column:
    return F.substring(text, 1, 1).rlike("[\\p{Lu}\"'“‘(]")


def ends_sentence(text: Column) -> Column:
    return text.rlike("[.!?\"'”’)]$")


def reject_reason(verbatim: Column, text: Column, score: Column) -> Column:
    """Why a statement is refused, the first reason that holds; NULL where it is accepted."""
    return F.when(~verbatim, "not_verbatim").when(~starts_sentence(text), "cut_start").when(~ends_sentence(text), "cut_end").when(score.isNull(), "no_score")


def explode_examples(windows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows ``keys, attribute, idx, example.*`` of a map of attribute to examples."""
    by_attribute = windows.select(*keys, F.explode(column).alias("attribute", "__examples"))
    return by_attribute.select(*keys, "attribute", F.posexplode("__examples").alias("idx", "__e")).select(*keys, "attribute", "idx", "__e.*")


def wide_scores(long: DataFrame, attributes: list[str], id_: str = "id") -> DataFrame:
    """``id, attr, attr_n`` for every attribute, from rows ``id, attr, score, n``."""
    out = []
    for a in attributes:
        here = F.col("attr") == a
        out += [F.max(F.when(here, F.col("score"))).alias(a), F.max(F.when(here, F.col("n"))).alias(f"{a}_n")]
    return long.where(F.col("attr").isin(attributes)).groupBy(id_).agg(*out)


#: Tiers of attributes: scored where they are extracted, decided by a record, or by a search later.
TEXT, RECORD, SEARCH = "text", "record", "search"


def _lookup(registry: dict[str, tuple[str, tuple[str, ...]]], attribute: Column) -> tuple[Column, Column]:
    """(tier, required fields) of an attribute; ``unknown`` and none for one that isn't registered."""
    tiers = F.create_map(*(F.lit(x) for name, (tier, _) in registry.items() for x in (name, tier)))
    fields = F.create_map(*(x for name, (_, needed) in registry.items() for x in (F.lit(name), F.array(*map(F.lit, needed)).cast("array<string>"))))
    return F.coalesce(F.try_element_at(tiers, attribute), F.lit("unknown")), F.coalesce(F.try_element_at(fields, attribute), F.array().cast("array<string>"))


def gated(examples: DataFrame, registry: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """``examples`` with ``tier, reason, remark, gated_score, gated_prior``.

    ``examples`` has attribute, statement, quote_class (``verbatim`` or another), fields (a map of
    the example's other fields as text), score and prior_score (as text or numbers);
    ``registry`` gives each attribute's tier and the fields that it requires.  ``reason`` is
    the first of: ``empty``, ``quote:<class>``, ``quote:mid_sentence``,
    ``<attribute>:missing_<field>`` (absent, NULL or empty) and, in the text tier,
    ``<attribute>:no_score``; NULL where the example is accepted.  Scores are clamped to 0 to 1 and
    kept in the text tier only; in the search tier a guess (``prior_score``, else ``score``) is
    kept apart as the prior, and ``remark`` tells of a missing one.
    """
    tier, needed = _lookup(registry, F.col("attribute"))
    statement = F.coalesce("statement", F.lit(""))
    missing = F.get(F.filter(needed, lambda f: F.coalesce(F.try_element_at(F.col("fields"), f), F.lit("")) == ""), F.lit(0))
    number = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.trim(F.col(c).cast("string")).try_cast("double"), F.lit(None).cast("double"))))
    score, prior = F.when(tier == TEXT, number("score")), F.when(tier == SEARCH, F.when(F.col("prior_score").isNotNull(), number("prior_score")).otherwise(number("score")))
    # greatest() skips NULL, so a missing number must stay missing
    known = lambda c: F.nanvl(F.trim(F.col(c).cast("string")).try_cast("double"), F.lit(None).cast("double")).isNotNull()
    score = F.when(known("score"), score)
    prior = F.when(F.when(F.col("prior_score").isNotNull(), known("prior_score")).otherwise(known("score")), prior)
    reason = (
        F.when(statement == "", "empty").when(F.coalesce(F.col("quote_class") != "verbatim", F.lit(True)), F.concat(F.lit("quote:"), F.coalesce("quote_class", F.lit("unknown"))))
        .when(~(starts_sentence(statement) & ends_sentence(statement)), "quote:mid_sentence").when(missing.isNotNull(), F.concat("attribute", F.lit(":missing_"), missing))
        .when((tier == TEXT) & score.isNull(), F.concat("attribute", F.lit(":no_score")))
    )
    accepted = reason.isNull()
    return examples.withColumns({"tier": tier, "reason": reason, "remark": F.when(accepted & (tier == SEARCH) & prior.isNull(), F.concat("attribute", F.lit(":no_prior"))), "gated_score": F.when(accepted, score), "gated_prior": F.when(accepted, prior)})
