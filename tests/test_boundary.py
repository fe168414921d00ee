import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions.json_rescue import rescue, rescued
from quillspark.operators import echoed
from quillspark.streaming import strikes

# arrays in prose


@pytest.mark.parametrize(
    "text, want, state",
    [
        ('[{"a": 1}]', [{"a": 1}], "whole"),
        ("[]", [], "whole"),
        ('Here it is:\n```json\n[{"a": [1, [2]]}, {"b": "]"}]\n```\nDone [1].', [{"a": [1, [2]]}, {"b": "]"}], "whole"),
        ('See [1] and [2]: [{"q": "say \\"[\\" and \\\\"}] as said', [{"q": 'say "[" and \\'}], "whole"),
        ("As [noted], the values are [1, 2, 3].", [1, 2, 3], "whole"),
        ("[note: the array is [1, 2]]", [1, 2], "whole"),
        ('He said "yes [sic" and then [{"k": 5}]', [{"k": 5}], "whole"),
        ('[{"a": 1}, {"b": [2, 3]}, {"c": "cut of', [{"a": 1}, {"b": [2, 3]}], "cut"),
        ('Sure: [{"a": 1},', [{"a": 1}], "cut"),
        ("[1, 2, 3", [1, 2], "cut"),
        ('[{"a": 1', None, None),
        ("no array", None, None),
        ("[broken, json]", None, None),
        ('{"a": [1]} tail', [1], "whole"),
        (") ] } [", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_rescue(text, want, state):
    found, how = rescue(text)
    assert (None if found is None else json.loads(found), how) == (want, state)


def test_rescue_is_linear_and_a_column(spark):
    assert rescue("[" * 200_000) == (None, None) and rescue("[1] " * 50_000)[0] == "[1]" and rescue("[" * 50_000 + "]" * 50_000)[1] in ("whole", None)
    rows = spark.createDataFrame([(1, "x [1] y"), (2, None), (3, "none")], "id int, t string").select("id", rescued(F.col("t")).alias("r")).collect()
    assert {r["id"]: tuple(r["r"]) for r in rows} == {1: ("[1]", "whole"), 2: (None, None), 3: (None, None)}


# answers that echo ids


class Odd:
    """Misbehaves in every way that is told apart, by the question's text."""

    def __call__(self, questions, again):
        if any(t == "down" for _, t in questions):
            raise OSError("out of reach")
        if any(t == "garbled" for _, t in questions) and again == 0:
            return "I can't [do that"
        out = []
        for i, t in reversed(questions):
            if t == "late" and again == 0 or t == "never":
                continue
            verdict = {"wild": "perhaps" if again == 0 else "TRUE ", "silly": "42", "blank": None}.get(t, "false")
            out += [{"id": i, "verdict": verdict, "reason": f"{t} {again}"}] * (2 if t == "twice" else 1)
        return "Here:\n```json\n" + json.dumps([*out, {"id": "nobody", "verdict": "true"}, "junk"]) + "\n```"


def test_answers_are_matched_by_id(spark):
    texts = ["plain", "late", "never", "wild", "silly", "blank", "twice", None]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "plain")], "verdict int, t string").withColumnRenamed("verdict", "q").coalesce(1)
    rows = echoed.ask(items, "q", "t", Odd(), ["True", "False"], attempts=3).collect()
    got = {r["q"]: (r["verdict"], r["asks"], r["refused"], r["doubled"], r["state"]) for r in rows if r["state"] != "unmatched" and r["q"] is not None}
    assert got == {
        0: ("false", 1, 0, 0, "answered"), 1: ("false", 2, 0, 0, "answered"), 2: (None, 3, 0, 0, "unanswered"), 3: ("true", 2, 1, 0, "answered"), 4: (None, 3, 3, 0, "unanswered"),
        5: (None, 3, 3, 0, "unanswered"), 6: ("false", 1, 0, 1, "answered"), 7: ("false", 1, 0, 0, "answered"),
    }
    assert [r["state"] for r in rows if r["q"] is None and r["state"] != "unmatched"] == ["unanswered"]
    assert sorted(r["reason"] for r in rows if r["state"] == "unmatched") == ["None"] * 3 + ["nobody"] * 3


def test_a_failing_batch_loses_nothing_of_others(spark):
    items = spark.createDataFrame([(f"{i}", "down" if i == 5 else "garbled" if i == 9 else "plain") for i in range(12)], "q string, t string").coalesce(1)
    rows = {r["q"]: r for r in echoed.ask(items, "q", "t", Odd(), None, attempts=2, most=4).collect() if r["state"] != "unmatched"}
    assert {q for q, r in rows.items() if r["state"] == "unanswered"} == {"4", "5", "6", "7"}
    assert {rows[q]["asks"] for q in ("8", "9", "10", "11")} == {2} and {rows[q]["asks"] for q in "0123"} == {1}
    assert [len(b) for b in echoed.batches_of([("a", "x" * 5), ("b", "x" * 9), ("c", "x"), ("d", "x"), ("e", "x")], 3, 10)] == [1, 2, 2]
    assert echoed.ask(items.limit(0), "q", "t", Odd()).count() == 0


# strikes

T0 = dt.datetime(2024, 1, 1)


def at(m):
    return T0 + dt.timedelta(minutes=m)


def plain_stop(passes, silence, end, quota=3, idle=4):
    q = i = 0
    last = None
    for t, written, blocked in passes:
        if last is not None and t > last + silence:
            return last + silence, "silence"
        last = t
        if written:
            q = i = 0
        else:
            q, i = q + blocked, i + (not blocked)
            if q >= quota or i >= idle:
                return t, "quota" if q >= quota else "idle"
    return (last + silence, "silence") if end >= last + silence else None


def test_stops_of_a_finished_log(spark):
    import random

    rng = random.Random(12)
    log = {s: [(at(m), rng.choice([0, 0, 0, 5]), rng.random() < 0.5) for m in sorted(rng.sample(range(0, 400, 4), rng.randint(1, 25)))] for s in range(60)}
    rows = [(s, t, w or None, b or None, k) for s, passes in log.items() for k, (t, w, b) in enumerate(passes)] + [(999, None, 0, True, 0)]
    got = strikes.stops(spark.createDataFrame(rows, "stage int, at timestamp, written int, blocked boolean, k int"), "stage", "at", "written", "blocked", "k", F.expr("INTERVAL 60 MINUTES"), 3, 4).collect()
    end = max(t for passes in log.values() for t, _, _ in passes)
    want = {s: plain_stop(p, dt.timedelta(minutes=60), end) for s, p in log.items()}
    assert {r["stage"]: (r["at"], r["reason"]) for r in got} == {s: x for s, x in want.items() if x}
    assert {r["reason"] for r in got} == {"quota", "idle", "silence"}


def test_silence_alone_stops_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema, source = "stage string, at timestamp, written int, blocked boolean", str(tmp_path / "in")
    steps = [
        [("quiet", at(0), 5, False), ("idle", at(0), 0, False), ("quota", at(0), 0, True), ("well", at(0), 1, False)],
        [("idle", at(10), 0, False), ("quota", at(10), 0, True), ("well", at(20), 0, False)],
        [("idle", at(20), 0, False), ("quota", at(15), 0, True), ("well", at(40), 3, False)],
        [("well", at(70), 3, False), ("quota", at(71), 0, True)],
        [("well", at(100), 3, False)],
        [("well", at(150), 3, False)],
    ]
    try:
        for rows in steps:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            stream = strikes.watch(spark.readStream.schema(schema).parquet(source), "stage", 60 * 60_000, "30 minutes", quota=3, idle=3)
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r["stage"]: (r["at"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"quiet": (at(60), "silence"), "idle": (at(20), "idle"), "quota": (at(15), "quota")}
