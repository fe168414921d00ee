from pyspark.sql import functions as F

from quillspark.operators import evaluation, roster


def test_ids_are_kept_and_views(spark):
    existing = spark.createDataFrame([("old-id", ["ann lee", "lee", "annie"]), ("b2", ["bo park"]), ("b1", ["bo park", "bp"])], "id string, aliases array<string>")
    members = spark.createDataFrame([("Ánn Lee", "N"), ("ANN LEE", "S"), ("Bo Park", "S"), ("Cy O'Dell-Hill", "N"), ("", "N"), (None, "N")], "name string, party string")
    built = roster.rebuild(members, existing)
    got = {r["id"]: (r["name"], r["party"], r["aliases"]) for r in built.collect()}
    assert got == {"old-id": ("ANN LEE", "S", ["ann lee", "annie", "lee"]), "b2": ("Bo Park", "S", ["bo park", "park"]), "cy-o-dell-hill": ("Cy O'Dell-Hill", "N", ["cy o'dell-hill", "o'dell-hill"])}
    assert {r["id"]: (r["full_names"], r["surnames"]) for r in roster.views(built).collect()}["old-id"] == (["ann lee"], ["annie", "lee"])


def test_forms_loose_keys_and_titles(spark):
    people = spark.createDataFrame([("a", ["ann lee", "lee"]), ("b", ["bo park", "park"]), ("c", ["cy park"])], "id string, aliases array<string>")
    rows = spark.createDataFrame([(1, "Hon ANN LEE (North)", None), (2, "Nobody", "Lee, Rt Hon Ann"), (3, "Dr Park", "x"), (4, None, None), (5, "Cy Park", "Ann Lee")], "id int, k_f0_0 string, row string")
    assert {r["id"]: r["who"] for r in roster.resolve_forms(rows, ["k_f0_0", "row"], people, "who").collect()} == {1: "a", 2: "a", 3: "b", 4: None, 5: "c"}
    icons = spark.createDataFrame([("precision", "Being Precise", "Precision", "P"), ("wit", "Wit", "", "W"), ("Wit", "Other", None, "X")], "cid string, name string, site string, symbol string")
    named = spark.createDataFrame([("PRECISION", "n"), ("q", "being precise"), ("none", None), ("wit", "precision")], "e string, best string")
    assert [(r["e"], r["symbol"]) for r in roster.loose_join(named, ["e", "best"], icons, ["cid", "name", "site"], ["symbol"]).orderBy("e").collect()] == [("PRECISION", "P"), ("none", None), ("q", "P"), ("wit", "W")]
    bills = spark.createDataFrame([("Arms (No 2) Bill", 1, "old"), ("ARMS NO. 2 BILL", 2, "new"), ("", 3, "none")], "t string, o int, k string")
    asked = spark.createDataFrame([("Arms, No 2 Bill",), ("Other Bill",), ("",), (None,)], "e string")
    assert sorted((str(r["e"]), r["k"]) for r in roster.join_titles(asked, "e", bills, "t", "o", ["k"]).collect()) == [("", None), ("Arms, No 2 Bill", "new"), ("None", None), ("Other Bill", None)]


def test_evaluation(spark):
    record = spark.createDataFrame([(1, {"b_score": "0.5", "a_score": "x", "c_score": "1"}), (2, {"score": "1"}), (3, {}), (4, None)], "k int, r map<string,string>")
    assert {r["k"]: r["g"] for r in record.select("k", evaluation.gold_score(F.col("r")).alias("g")).collect()} == {1: 0.5, 2: None, 3: None, 4: None}
    windows = spark.createDataFrame([("w1",), ("w2",), ("w2",)], "id string")
    done = spark.createDataFrame([("w1", "m", 0), ("w1", "m", 0), ("w9", "m", 1)], "id string, model string, repeat int")
    assert evaluation.plan(windows, "id", ["m", "n"], 3).count() == 12
    left = evaluation.plan(windows, "id", ["m", "n"], 2, done)
    assert left.count() == 7 and left.where("id = 'w1' AND model = 'm'").collect()[0]["repeat"] == 1
    rows = [("good", f"s{i}", i / 4, i / 4 + 0.1) for i in range(4)] + [("flat", f"s{i}", i / 4, 0.5) for i in range(4)] + [("bad", f"s{i}", i / 4, 1 - i / 4) for i in range(4)] + [("good", "", 0.1, 0.1), ("good", "s", None, 0.1), ("good", "s", 0.1, None), ("good", "s", 0.1, float("nan")), ("failed", "s", 0.1, None)]
    table = spark.createDataFrame(rows, "model string, statement string, gold double, pred double")
    got = {r["model"]: r for r in evaluation.compare(table, ["model"]).collect()}
    assert [m for m in sorted(got, key=lambda m: got[m]["place"])] == ["good", "bad", "failed", "flat"]  # no correlation counts as -1
    assert (got["good"]["n"], got["good"]["skipped"], round(got["good"]["mae"], 9)) == (4, 4, 0.1) and got["flat"]["r"] is None and got["failed"]["n"] == 0
    merged = evaluation.merge_scores(spark.createDataFrame([("s", "t", "wit", 0.2), ("s", "t", "wit", 0.4), ("s", "t", "grit", None), ("s", "u", "grit", None)], "who string, what string, a string, v double"), ["who", "what"], "a", "v")
    assert {r["what"]: r["scores"] for r in merged.collect()} == {"t": {"wit": 0.4}, "u": {}}
    picks = spark.createDataFrame([(1, ["a"], "long long"), (2, ["a", "b"], "x"), (3, ["a", "b"], "xx"), (4, ["a", "b"], "yy")], "k int, s array<string>, t string")
    assert [r["k"] for r in evaluation.preferred(picks, "s", "t", "k", 3).collect()] == [3, 4, 2]
    batch = spark.createDataFrame([("b", 2, "q2", None), ("b", 1, "q1", "a1"), ("c", 1, " ", "x")], "b string, o int, q string, a string")
    assert {r["b"]: (r["n"], r["prompt"]) for r in evaluation.rendered(batch, ["b"], "o", [("Question", "q"), ("Answer", "a")]).collect()} == {"b": (2, "[1]\nQuestion: q1\nAnswer: a1\n\n[2]\nQuestion: q2"), "c": (1, "[1]\nAnswer: x")}
