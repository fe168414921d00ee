import json
import os

import pytest
from pyspark.sql import functions as F

from quillspark.sources import listings


@pytest.fixture
def folder(tmp_path):
    for month, page, n in (("2024-01", 0, 3), ("2024-01", 1, 2), ("2024-02", 0, 4), ("2024-10", 0, 1)):
        where = tmp_path / f"month={month}" / f"page={page}"
        where.mkdir(parents=True)
        (where / "part-0.json").write_text("\n".join(json.dumps({"id": f"{month}/{page}/{i}", "t": "é "}, ensure_ascii=False) for i in range(n)) + "\n\n")
        (where / "_SUCCESS").write_text("x")
        (where / ".part-0.json.crc").write_text("x")
    (tmp_path / "notes.txt").write_text("no page")
    return str(tmp_path)


def ids(df):
    return sorted(r["id"] for r in df.select(F.get_json_object("record", "$.id").alias("id")).collect())


def test_pages_and_pushed_conditions(spark, folder):
    rows = listings.read_listing(spark, folder)
    assert rows.rdd.getNumPartitions() == 4 and len(ids(rows)) == 10
    january = rows.where("month = '2024-01'")
    assert january.rdd.getNumPartitions() == 2 and ids(january) == [f"2024-01/{p}" for p in ("0/0", "0/1", "0/2", "1/0", "1/1")]
    os.rename(f"{folder}/month=2024-02/page=0/part-0.json", f"{folder}/month=2024-02/page=0/_gone")  # what isn't asked for isn't opened
    assert ids(rows.where("month >= '2024-02' AND page < 1")) == ["2024-10/0/0"]
    assert rows.where("month IN ('2024-01', '2024-10') AND page = 0").rdd.getNumPartitions() == 2
    assert rows.where("month > '2024-01' AND record LIKE '%2024-10%'").count() == 1
    assert rows.where("month = '1999-01'").count() == 0 and listings.read_listing(spark, folder + "/none").count() == 0


def test_stream_goes_on_at_its_offset(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("listing"))

    def run():
        listings.stream_listing(spark, folder).writeStream.format("json").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/cp").trigger(once=True).start().awaitTermination()
        return ids(spark.read.schema("month string, page int, record string").json(f"{out}/rows"))

    first = run()
    assert len(first) == 10 and run() == first
    os.makedirs(f"{folder}/month=2024-10/page=1")
    with open(f"{folder}/month=2024-10/page=1/a.json", "w") as f:
        f.write('{"id": "new"}')
    os.rename(f"{folder}/month=2024-01/page=0/part-0.json", f"{folder}/month=2024-01/page=0/_gone")  # old pages aren't read again
    assert run() == sorted([*first, "new"])


def test_written_listing_comes_back(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i == 7 else f"2024-0{i % 3 + 1}", None if i % 2 else "x\ny") for i in range(20)], "id int, m string, t string")
    listings.write_listing(rows, str(tmp_path / "l"), F.col("m"), [F.col("id")], 3)
    back = listings.read_listing(spark, str(tmp_path / "l")).select("month", "page", F.from_json("record", "id int, m string, t string").alias("r")).select("month", "page", "r.*").collect()
    assert sorted((r["id"], r["m"], r["t"]) for r in back) == sorted(tuple(r) for r in rows.where("m IS NOT NULL").collect())
    assert all(r["month"] == r["m"] for r in back) and {(r["month"], r["page"]) for r in back} == {("2024-01", 0), ("2024-01", 1), ("2024-01", 2), ("2024-02", 0), ("2024-02", 1), ("2024-03", 0), ("2024-03", 1)}


def test_many_pages_are_dealt_out_as_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listings, "MOST_PARTITIONS", 6, raising=False)
    path = str(tmp_path / "l")
    listings.write_listing(spark.range(200).selectExpr("id", "concat('2024-0', id % 4 + 1) AS m"), path, F.col("m"), [F.col("id")], 5)
    rows = listings.read_listing(spark, path)
    assert rows.rdd.getNumPartitions() == 6 and len(set(ids(rows))) == 200
    assert rows.where("month = '2024-03'").rdd.getNumPartitions() == 5 and rows.where("month = '2024-03'").count() == 50
    listings.stream_listing(spark, path).writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/cp").trigger(once=True).start().awaitTermination()
    assert ids(spark.read.parquet(f"{tmp_path}/rows")) == sorted(map(str, range(200))) and len([n for n in os.listdir(f"{tmp_path}/rows") if n.endswith(".parquet")]) <= 6
