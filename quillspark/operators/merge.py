"""Three-way merge of tables: a base, ours, and theirs that were both made from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources import bundles

#: Rows of all sides that one task merges, about.
TASK_ROWS = 200_000


def merge3(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], may_add: bool = False) -> tuple[DataFrame, DataFrame]:
    """(merged rows, conflicts ``keys, kind, column, base, ours, theirs`` with values as text).

    Keys identify rows on each side; the other columns of ``base`` are merged one by one: a side
    that left a value as it was gives way to the other, and two equal changes are one.  Kinds of
    conflict: ``both_changed`` (one row a column), ``deleted_and_changed`` (of rows that one side
    dropped and the other changed), ``unknown`` (rows of ours or theirs that the base lacks,
    unless ``may_add``), ``added_differently``, and ``repeated`` or ``null_key`` (keys that aren't
    unique or have a NULL on some side, which aren't merged at all).  NULL is a value.
    Merged rows of a key in conflict hold the base's row, or are left out if there is none.
    """
    columns = [c for c in base.columns if c not in keys]
    k = [f"k{i}" for i in range(len(keys))]

    def side(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(*(F.col(f"`{c}`") for c in columns))
        return df.select(*(F.col(f"`{c}`").alias(a) for c, a in zip(keys, k)), row.alias("row"), F.lit(name).alias("side"))

    every = reduce(DataFrame.unionByName, (side(df, n) for n, df in (("base", base), ("ours", ours), ("theirs", theirs))))
    of = lambda n: F.max(F.when(F.col("side") == n, F.struct("row")))
    count = lambda n: F.count_if(F.col("side") == n)
    most = F.greatest(count("base"), count("ours"), count("theirs"))
    # dealt by key first, into tasks of so many rows: a key has a row a side, so that combining where the rows are read would only sort whole inputs
    parts = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-every.count() // TASK_ROWS))
    met = every.repartition(parts, *k).groupBy(*k).agg(of("base").alias("b"), of("ours").alias("o"), of("theirs").alias("t"), most.alias("n"))
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    same = lambda x, y: x.eqNullSafe(y)
    null_key = reduce(lambda x, y: x | y, (F.col(c).isNull() for c in k))
    whole = (
        F.when(null_key, "null_key").when(F.col("n") > 1, "repeated")
        .when(b.isNull() & ~F.lit(may_add), "unknown").when(b.isNull() & o.isNotNull() & t.isNotNull() & ~same(o, t), "added_differently")
        .when(b.isNotNull() & (o.isNull() & t.isNotNull() & ~same(t, b) | t.isNull() & o.isNotNull() & ~same(o, b)), "deleted_and_changed")
    )
    value = lambda s, c: F.col(f"{s}.row.`{c}`")
    all_there = b.isNotNull() & o.isNotNull() & t.isNotNull()
    clash = lambda c: all_there & ~same(value("o", c), value("b", c)) & ~same(value("t", c), value("b", c)) & ~same(value("o", c), value("t", c))
    text = lambda x: x.cast("string")
    both = F.filter(F.array(*(F.when(clash(c), F.struct(F.lit(c).alias("column"), text(value("b", c)).alias("base"), text(value("o", c)).alias("ours"), text(value("t", c)).alias("theirs"))) for c in columns)), lambda x: x.isNotNull()) if columns else F.array().cast("array<struct<column:string,base:string,ours:string,theirs:string>>")
    judged = met.withColumns({"whole": whole, "both": F.when(whole.isNull(), both)})
    named = [F.col(a).alias(c) for a, c in zip(k, keys)]
    as_row = lambda s: F.when(F.col(s).isNotNull(), F.to_json(F.col(f"{s}.row")))
    rows = judged.where("whole IS NOT NULL").select(*named, F.col("whole").alias("kind"), F.lit(None).cast("string").alias("column"), as_row("b").alias("base"), as_row("o").alias("ours"), as_row("t").alias("theirs"))
    cells = judged.where("size(both) > 0").select(*named, F.lit("both_changed").alias("kind"), F.explode("both").alias("c")).select(*keys, "kind", "c.*")
    bad = F.col("whole").isNotNull() | (F.size("both") > 0)

    def merged(c: str) -> Column:
        return F.when(bad, value("b", c)).when(all_there & same(value("o", c), value("b", c)), value("t", c)).when(all_there, value("o", c)).otherwise(F.coalesce(F.col("o"), F.col("t"))["row"][c])

    kept = F.when(bad, b.isNotNull() & ~F.coalesce(F.col("whole").isin("null_key", "repeated"), F.lit(False))).when(b.isNotNull(), o.isNotNull() & t.isNotNull()).otherwise(True)
    return judged.where(kept).select(*named, *(merged(c).alias(c) for c in columns)), rows.unionByName(cells)


def merge_bundle(path: str, table: str, base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], may_add: bool = False) -> DataFrame:
    """Merge and make the result the bundle's new version, if nothing is in conflict; the conflicts.

    With any conflict nothing is written and the old version stays.
    """
    merged, conflicts = merge3(base, ours, theirs, keys, may_add)
    if conflicts.limit(1).count() == 0:
        bundles.write_bundle({table: merged}, path)
    return conflicts
