import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import ordered

T0 = dt.datetime(2024, 1, 1)


def at(m):
    return None if m is None else T0 + dt.timedelta(minutes=m)


def plain_asof(left, right, direction):
    out = []
    for i, key, t in left:
        found = [(u, v) for k, u, v in right if key is not None and k == key and t is not None and u is not None]
        before, after = [x for x in found if x[0] <= t] if t is not None else [], [x for x in found if x[0] >= t] if t is not None else []
        b = max(before, default=None)
        a = min(after, key=lambda x: (x[0], -x[1]), default=None)
        if direction == "nearest":
            match = a if b is None else b if a is None or t - b[0] <= a[0] - t else a
        else:
            match = b if direction == "backward" else a
        out.append((i, match))
    return sorted(out)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("parts", ["1", "5", "16"])
def test_asof_against_brute_force(spark, direction, parts):
    rng = random.Random(len(direction))
    key = lambda: rng.choice(["hot"] * 6 + ["b", "c", "", None])
    left = [(i, key(), at(rng.choice([None, *range(60)]))) for i in range(150)]
    right = [(key(), at(rng.choice([None, *range(0, 60, 3)])), rng.randint(0, 4)) for _ in range(60)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = ordered.asof_join(spark.createDataFrame(left, "id int, k string, t timestamp"), spark.createDataFrame(right, "k string, u timestamp, v int"), ["k"], "t", "u", ["v"], direction)
        got = sorted((r["id"], None if r["u"] is None else (r["u"], r["v"])) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain_asof(left, right, direction)


def test_asof_columns_limits_and_plan(spark):
    left = spark.createDataFrame([(1, "a", at(10)), (2, "a", at(30))], "row int, k0 string, at timestamp").selectExpr("*", "row AS id", "k0 AS kind", "k0 AS `odd.name`")
    right = spark.createDataFrame([("a", at(1), "x", 1.5)], "k0 string, u timestamp, match string, found double")
    found = ordered.asof_join(left, right, ["k0"], "at", "u", ["match", "found"], within=F.col("at") - F.col("u") < F.expr("INTERVAL 15 MINUTES"))
    assert found.columns == [*left.columns, "u", "match", "found"]
    assert [(r["row"], r["match"], r["found"]) for r in found.orderBy("row").collect()] == [(1, "x", 1.5), (2, None, None)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert ordered.asof_join(left.limit(0), right, ["k0"], "at", "u", ["match"]).count() == 0
    assert [r["u"] for r in ordered.asof_join(left, right.limit(0), ["k0"], "at", "u", ["match"]).collect()] == [None, None]
    with pytest.raises(ValueError):
        ordered.asof_join(left, right, ["k0"], "at", "u", ["match"], "sideways")


def test_values_cross_many_partitions_of_one_key(spark):
    rows = [("hot", i, i if i in (3, 700) else None) for i in range(1000)] + [(None, 0, 7), (None, 1, None), ("cold", 0, None)]
    df = spark.createDataFrame(rows, "key string, n int, v int").repartition(9)
    up = {(r["key"], r["n"]): (r["got"], r["other"]) for r in ordered.carried(df, ["key"], ["n"], {"got": F.col("v"), "other": F.lit(None).cast("string")}).collect()}
    down = {(r["key"], r["n"]): r["got"] for r in ordered.carried(df, ["key"], ["n"], {"got": F.col("v")}, strict=True, backwards=True).collect()}
    for i in range(1000):
        assert up["hot", i] == (None if i < 3 else 3 if i < 700 else 700, None)
        assert down["hot", i] == (3 if i < 3 else 700 if i < 700 else None)
    assert (up[None, 0], up[None, 1], up["cold", 0]) == ((7, None), (7, None), (None, None))
    assert (down[None, 0], down[None, 1]) == (None, None)


def test_number_of_the_term(spark):
    terms = spark.createDataFrame([("2020-11-25", 53), ("2023-10-06", 54)], "begins string, number int").selectExpr("date(begins) AS begins", "number")
    days = spark.createDataFrame([("2019-01-01",), ("2023-10-05",), ("2023-10-06",), ("2026-05-27",), (None,)], "day string").selectExpr("date(day) AS day")
    got = {str(r["day"]): r["number"] for r in ordered.numbered_at(days, "day", terms, "begins", "number").collect()}
    assert got == {"2019-01-01": None, "2023-10-05": 53, "2023-10-06": 54, "2026-05-27": 54, "None": None}


def test_nearest_of_dates_and_numbers(spark):
    left, right = spark.createDataFrame([(1, 10), (2, 14), (3, 15)], "id int, n int"), spark.createDataFrame([(9, "a"), (20, "b")], "m int, v string")
    assert {r["id"]: r["v"] for r in ordered.asof_join(left, right, [], "n", "m", ["v"], "nearest").collect()} == {1: "a", 2: "a", 3: "b"}
    days = lambda df, c: df.withColumn(c, F.date_add(F.lit("2024-03-01").cast("date"), F.col(c)))
    found = ordered.asof_join(days(left, "n"), days(right, "m"), [], "n", "m", ["v"], "nearest")
    assert {r["id"]: r["v"] for r in found.collect()} == {1: "a", 2: "a", 3: "b"}
