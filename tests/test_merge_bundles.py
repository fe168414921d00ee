import glob
import os
import random

import pytest

from quillspark.operators import merge
from quillspark.sources import bundles


def plain_merge(base, ours, theirs, may_add):
    rows, conflicts = [], set()
    for key in sorted({*base, *ours, *theirs}):
        b, o, t = base.get(key), ours.get(key), theirs.get(key)
        if b is None:
            if not may_add:
                conflicts.add((key, "unknown", None))
            elif o is not None and t is not None and o != t:
                conflicts.add((key, "added_differently", None))
            else:
                rows.append((key, *(o or t)))
        elif o is None or t is None:
            other = t if o is None else o
            if other is not None and other != b:
                conflicts.add((key, "deleted_and_changed", None))
                rows.append((key, *b))
        else:
            out = []
            for name, x, y, z in zip("xy", b, o, t):
                if y != x and z != x and y != z:
                    conflicts.add((key, "both_changed", name))
                out.append(z if y == x else y)
            rows.append((key, *(b if any(c[0] == key for c in conflicts) else out)))
    return sorted(rows, key=str), conflicts


@pytest.mark.parametrize("may_add", [False, True])
def test_merge_against_brute_force(spark, may_add):
    rng = random.Random(21)
    base = {k: (rng.choice([None, 1, 2]), rng.choice("ab")) for k in range(120)}

    def edited():
        out = {k: (rng.choice([None, 1, 2]) if rng.random() < 0.3 else x, rng.choice("abc") if rng.random() < 0.3 else y) for k, (x, y) in base.items() if rng.random() > 0.1}
        return out | {k: (rng.choice([None, 1]), "n") for k in rng.sample(range(120, 150), 10)}

    ours, theirs = edited(), edited()
    frames = [spark.createDataFrame([(k, *v) for k, v in d.items()], "k int, x int, y string") for d in (base, ours, theirs)]
    merged, conflicts = merge.merge3(*frames, ["k"], may_add)
    rows, want = plain_merge(base, ours, theirs, may_add)
    assert merged.columns == ["k", "x", "y"] and sorted((tuple(r) for r in merged.collect()), key=str) == rows
    assert {(r["k"], r["kind"], r["column"]) for r in conflicts.collect()} == want and len(want) > 10


def test_repeated_and_null_keys(spark):
    schema = "k string, b int"
    base, ours, theirs = (spark.createDataFrame(r, schema) for r in ([("a", 1), (None, 2), ("c", 3)], [("a", 1), ("a", 1), (None, 2), ("c", 4)], [("a", 1), ("c", 3)]))
    merged, conflicts = merge.merge3(base, ours, theirs, ["k"])
    assert [tuple(r) for r in merged.collect()] == [("c", 4)]
    assert {(r["k"], r["kind"]) for r in conflicts.collect()} == {("a", "repeated"), (None, "null_key")}
    assert conflicts.columns == ["k", "kind", "column", "base", "ours", "theirs"]


def test_merged_bundle_is_swapped_or_left(spark, tmp_path):
    path, schema = str(tmp_path / "b"), "k int, v string"
    base = spark.createDataFrame([(1, "a"), (2, "b")], schema)
    first = bundles.write_bundle({"labels": base}, path)
    ours, theirs = spark.createDataFrame([(1, "x"), (2, "b")], schema), spark.createDataFrame([(1, "a"), (2, "y")], schema)
    unknown = spark.createDataFrame([(1, "a"), (2, "b"), (9, "z")], schema)
    assert [(r["k"], r["kind"]) for r in merge.merge_bundle(path, "labels", base, ours, unknown, ["k"]).collect()] == [(9, "unknown")]
    assert bundles.read_manifest(spark, path) == first and bundles.read_bundle(spark, path, "labels").count() == 2
    assert merge.merge_bundle(path, "labels", base, ours, theirs, ["k"]).count() == 0
    assert sorted(tuple(r) for r in bundles.read_bundle(spark, path, "labels").collect()) == [(1, "x"), (2, "y")]
    assert not os.path.exists(f"{path}/{first['version']}")


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_bundle_names_what_changed(spark, tmp_path, form):
    path = str(tmp_path / "b")
    people = spark.createDataFrame([(i, f"n{i}") for i in range(50)], "id int, name string").repartition(3)
    manifest = bundles.write_bundle({"people": people, "none": people.where("false")}, path, form)
    assert {n: t["rows"] for n, t in manifest["tables"].items()} == {"people": 50, "none": 0} and bundles.verify_bundle(spark, path).count() == 0
    assert bundles.read_bundle(spark, path, "people").count() == 50 and bundles.read_bundle(spark, path, "none").columns == ["id", "name"]
    one, two, *_ = sorted(glob.glob(f"{path}/{manifest['version']}/people/part-*"))
    data = bytearray(open(one, "rb").read())
    data[len(data) // 2] ^= 1
    open(one, "wb").write(data)
    os.remove(two)
    open(f"{path}/{manifest['version']}/people/part-extra", "w").write("x")
    for crc in glob.glob(f"{path}/{manifest['version']}/people/.*.crc"):
        os.remove(crc)
    problems = {r["part"].split("/")[1]: r["problem"] for r in bundles.verify_bundle(spark, path).collect()}
    assert problems == {os.path.basename(one): "changed", os.path.basename(two): "missing", "part-extra": "unexpected"}


def test_a_run_that_dies_leaves_the_old_bundle(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "b")
    with pytest.raises(FileNotFoundError):
        bundles.read_bundle(spark, path, "t")
    old = bundles.write_bundle({"t": spark.range(5)}, path)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(bundles, "commit", dies)
        with pytest.raises(RuntimeError):
            bundles.write_bundle({"t": spark.range(7)}, path)
    assert bundles.read_bundle(spark, path, "t").count() == 5 and bundles.verify_bundle(spark, path).count() == 0
    new = bundles.write_bundle({"t": spark.range(7)}, path)
    assert bundles.read_bundle(spark, path, "t").count() == 7 and new["root"] != old["root"]
    broken = new | {"root": "0" * 64}
    bundles.commit(spark, path, broken)
    assert [(r["part"], r["problem"]) for r in bundles.verify_bundle(spark, path).collect()] == [(bundles.MANIFEST, "root")]


def test_merge_deals_rows_to_tasks_of_bounded_size(spark, monkeypatch):
    from quillspark.operators import merge

    monkeypatch.setattr(merge, "TASK_ROWS", 10, raising=False)
    side = spark.range(100).selectExpr("id AS k", "'v' AS v")
    merged = merge.merge3(side, side, side.where("k <> 5"), ["k"])[0]
    assert merged.rdd.getNumPartitions() == 30 and sorted(r["k"] for r in merged.collect()) == [k for k in range(100) if k != 5]
