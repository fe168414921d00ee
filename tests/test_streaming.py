import pytest
from pyspark.sql import functions as F

from quillspark.streaming import events as se

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def source(spark, tmp_path, rows, name="in"):
    spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(f"file://{tmp_path}/{name}")
    return f"file://{tmp_path}/{name}"


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


ROWS = [(1, "2024-01-01 10:10:00", 1, "a", 1.0), (2, "2024-01-01 10:50:00", 1, "a", 2.0), (3, "2024-01-01 11:10:00", 2, "error", 4.0), (2, "2024-01-01 10:50:00", 1, "a", 2.0), (9, "2024-01-02 10:00:00", 3, "a", 0.0)]


def test_windows_match_batch(spark, tmp_path):
    path = source(spark, tmp_path, ROWS)
    for name, args in (("tumbling", ("1 hour",)), ("sliding", ("2 hours", "1 hour"))):
        drain(se.windowed(se.read_stream(spark, path, SCHEMA), ["event_type"], *args), f"w_{name}", "complete")
        batch = spark.read.parquet(path).groupBy(F.window("ts", *args).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")
        assert sorted(map(tuple, spark.table(f"w_{name}").collect())) == sorted(map(tuple, batch.collect()))
    drain(se.sessions(se.read_stream(spark, path, SCHEMA), ["user_id"], "1 hour"), "w_session", "complete")
    assert sorted((r["user_id"], r["n"]) for r in spark.table("w_session").collect()) == [(1, 3), (2, 1), (3, 1)]


def test_repeats_and_attempts(spark, tmp_path):
    path = source(spark, tmp_path, ROWS)
    drain(se.without_repeats(se.read_stream(spark, path, SCHEMA), ["event_id"]), "unique_events")
    assert sorted(r["event_id"] for r in spark.table("unique_events").collect()) == [1, 2, 3, 9]
    for _ in range(2):
        source(spark, tmp_path, [(5, "2024-01-03 00:00:00", 7, "error", 0.0), (6, "2024-01-03 00:00:00", 7, "error", 0.0)], "fails")
    drain(se.count_attempts(se.read_stream(spark, f"file://{tmp_path}/fails", SCHEMA, 1), "user_id", 3), "attempts", "update")
    assert max((r["attempts"], r["exhausted"]) for r in spark.table("attempts").collect()) == (4, True)


def test_append_resumes_and_guards_its_configuration(spark, tmp_path):
    path = source(spark, tmp_path, ROWS[:2])
    out, check = f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    se.append(se.read_stream(spark, path, SCHEMA), out, check, "v1")
    assert spark.read.parquet(out).count() == 2
    source(spark, tmp_path, ROWS[2:3])
    se.append(se.read_stream(spark, path, SCHEMA), out, check, "v1")
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        se.append(se.read_stream(spark, path, SCHEMA), out, check, "v2")


def test_late_verdicts(spark, tmp_path):
    s = source(spark, tmp_path, ROWS[:3] + ROWS[4:] + [(10, "2024-01-05 00:00:00", 1, "a", 0.0)], "s")
    v = source(spark, tmp_path, [(1, "2024-01-01 11:00:00", 1, "true", 0.0), (3, "2024-01-01 20:00:00", 1, "true", 0.0), (99, "2024-01-05 00:00:00", 1, "x", 0.0)], "v")
    verdicts = se.read_stream(spark, v, SCHEMA).select("event_id", F.col("event_type").alias("verdict"), F.col("ts").alias("verdict_ts"))
    drain(se.with_late_verdicts(se.read_stream(spark, s, SCHEMA), verdicts, ["event_id"]), "late")
    got = {r["event_id"]: r["verdict"] for r in spark.table("late").collect()}
    assert got[1] == "true" and got[2] is None and got[3] is None
