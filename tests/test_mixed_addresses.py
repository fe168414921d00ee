import os

from pyspark.sql import functions as F

from quillspark.functions import mixed
from quillspark.operators import addresses


def test_two_shapes_absent_paths_and_wrong_types(spark, tmp_path):
    path = tmp_path / "docs.txt"
    path.write_text("\n".join(['{"results": [{"id": 1, "a": {"b": [5, 6]}}, {"id": "2"}]}', '{"id": 3, "a": null}', "[]", "[4, {}]", "not json", '{"results": {"id": 9}}', "null"]))
    rows = spark.read.text(str(path)).select("value", F.posexplode_outer(mixed.items_of(F.col("value"))).alias("i", "v"))
    v = F.col("v")
    got = rows.select("value", "i", mixed.value_at(v, "$.id", "int", -1).alias("id"), mixed.value_at(v, "$.a.b[1]", "bigint").alias("b"), mixed.kind_at(v, "$.a").alias("a")).collect()
    assert sorted(((r["value"][:12], r["i"], r["id"], r["b"], r["a"]) for r in got), key=str) == sorted(
        [('{"results": ', 0, 1, 6, "OBJECT"), ('{"results": ', 1, 2, None, None), ('{"id": 3, "a', 0, 3, None, "VOID"), ("[]", None, -1, None, None), ("[4, {}]", 0, -1, None, None), ("[4, {}]", 1, -1, None, None), ("not json", None, -1, None, None), ('{"results": ', 0, -1, None, None), ("null", 0, -1, None, None)], key=str)
    report = mixed.shapes(rows.where("v IS NOT NULL").select(F.lit(1).alias("k"), F.when(mixed.kind_at(v) == "OBJECT", v).alias("v")).where("v IS NOT NULL"), ["k"], F.col("v")).first()
    assert report["n"] == 5 and report["shape"].startswith("OBJECT<a: OBJECT<b: ARRAY<BIGINT>>")
    assert spark.range(1).select(mixed.dumped(F.struct(F.lit(None).cast("int").alias("x"), F.array(F.lit(1)).alias("y")))).first()[0] == '{"x":null,"y":[1]}'


def test_one_address_opens_one_day(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = [(f"2024-01-{d:02d}", i, f"day {d} line {i}" if i % 4 else None, 4) for d in range(1, 9) for i in range(10)] + [(None, 0, "no day", 4)]
    addresses.write_addressed(spark.createDataFrame(rows, "day string, n bigint, line string, size int"), path, "day", "n", "line", F.col("size"), 12)
    want = "\n".join(f"day 3 line {i}" if i % 4 else "" for i in (3, 4, 5))
    assert addresses.window_text(spark, path, "2024-01-03#1") == want
    assert [addresses.window_text(spark, path, a) for a in ("2024-01-03#9", "2024-02-01#0", "2024-01-03", "#1", "2024-01-03#x")] == [None] * 5
    for d in range(1, 9):  # the other days' files aren't there any more, and nobody misses them
        if d != 3:
            for part in ("lines", "index"):
                os.rename(f"{path}/{part}/day=2024-01-{d:02d}", f"{path}/{part}/_gone-{d}")
    assert addresses.window_text(spark, path, "2024-01-03#1") == want
    asked = spark.createDataFrame([("2024-01-03#1",), ("2024-01-03#1",), ("2024-01-03#0",), ("2024-01-01#0",), ("bad",), (None,)], "text string")
    got = {r["address"]: r["text"] for r in addresses.window_texts(spark, path, asked, "text").collect()}
    assert got == {"2024-01-03#1": want, "2024-01-03#0": "\nday 3 line 1\nday 3 line 2", "2024-01-01#0": None, "bad": None, None: None}
    plan = addresses.window_texts(spark, path, asked, "text")._jdf.queryExecution().executedPlan().toString()
    assert " IN (" in plan  # the days' folders, by name


def test_many_days_share_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(addresses, "FEW_DAYS", 20)
    monkeypatch.setattr(addresses, "FOLDERS", 7, raising=False)
    path = str(tmp_path / "many")
    rows = [(f"d/{d:03d}", n, f"line {d} {n}") for d in range(60) for n in range(5)]
    addresses.write_addressed(spark.createDataFrame(rows, "day string, n bigint, line string"), path, "day", "n", "line", F.lit(5), 10)
    want = {f"d/{d:03d}#{w}": "\n".join(f"line {d} {n}" for n in range(2 * w, min(5, 2 * w + 2))) for d in range(60) for w in range(3)} | {"d/001#3": None, "none#0": None, "x": None}
    assert all(len([x for x in os.listdir(f"{path}/{part}") if "=" in x]) <= 7 for part in ("lines", "index"))
    for asked in (want, dict(list(want.items())[:12])):  # of many days, and of few
        got = addresses.window_texts(spark, path, spark.createDataFrame([(a,) for a in asked], "a string"), "a").collect()
        assert {r["address"]: r["text"] for r in got} == asked
    assert all(addresses.window_text(spark, path, a) == want[a] for a in ("d/000#0", "d/059#2", "d/001#3", "none#0"))
