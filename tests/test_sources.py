import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from quillspark.sources import files, html, sinks

ROWS = [{"headline": "One", "date": "2024-01-02", "content": "a", "url": "u1"}, {"headline": "Two", "date": "2024-03-05", "content": "", "url": "u2", "extra": 1}]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "lines.jsonl").write_text("\n".join(map(json.dumps, ROWS)) + "\n")
    (tmp_path / "torn.jsonl").write_text("\n".join(map(json.dumps, ROWS)) + '\n{"headline": "Thr')
    (tmp_path / "array.json").write_text("  \n" + json.dumps(ROWS, indent=1))
    return tmp_path


def test_json_forms(spark, folder):
    path = lambda n: f"file://{folder}/{n}"
    assert files.read_jsonl(spark, path("lines.jsonl"), "article").count() == 2
    assert files.read_jsonl(spark, path("torn.jsonl"), "article", strict=False).where("url is not null").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, path("torn.jsonl"), "article").collect()
    assert files.read_json_array(spark, path("array.json"), "article").count() == 2
    rows = files.read_either(spark, [path("array.json"), path("lines.jsonl"), path("torn.jsonl")], "article").orderBy("file", "ord").collect()
    assert [(r["ord"], r["url"]) for r in rows] == [(0, "u1"), (1, "u2")] * 3
    assert sorted({r["n"] for r in files.read_texts(spark, path("*")).select(files.source_name(F.col("file")).alias("n")).collect()}) == ["array", "lines", "torn"]


def test_manifest(spark, folder):
    got = {r["file"]: r for r in files.manifest(spark, f"file://{folder}").collect()}
    for name, r in got.items():
        data = (folder / name).read_bytes()
        assert (r["bytes"], r["lines"], r["sha256"]) == (len(data), len(data.splitlines()), hashlib.sha256(data).hexdigest())
    before = spark.createDataFrame([(r["file"], r["sha256"]) for r in got.values()], "file string, sha256 string")
    (folder / "lines.jsonl").write_text("other")
    (folder / "array.json").unlink()
    (folder / "new.json").write_text("[]")
    assert {(r["file"], r["problem"]) for r in files.verify(before, files.manifest(spark, f"file://{folder}")).collect()} == {("lines.jsonl", "changed"), ("array.json", "missing"), ("new.json", "unexpected")}


def test_ranges_and_fallback(spark):
    df = spark.createDataFrame([("2024-01-31", 1), ("2024-02-01", 2), ("2024-02-29", 3), ("2024-03-01", 4)], "date string, v int")
    assert [r["v"] for r in files.date_range(df, "date", "2024-02-01", "2024-02").orderBy("v").collect()] == [2, 3]
    assert files.date_range(df, "date", "2024-02-01").count() == 3
    other = spark.createDataFrame([("2024-02-01", 9), ("2024-05-01", 10)], "date string, v int")
    assert sorted(r["v"] for r in files.with_fallback(df, other, "date").collect()) == [1, 2, 3, 4, 10]


def test_captions_and_archive(spark):
    lines = ["WEBVTT", "Kind: captions", "", "1", "00:00 --> 00:02", "so <c>we</c> begin", "00:02 --> 00:03", "so we begin", "here"]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(lines)], "f string, i int, line string")
    assert files.captions(df, ["f"], "i", "line").first()["text"] == "so we begin here"
    index = spark.createDataFrame([("http://www.x.org/a/?q=1", "20240103000000"), ("https://x.org/a", "20240102000000"), ("https://x.org/a", "20230102000000")], "url string, ts string")
    assert [(r["url"], r["ts"]) for r in files.archive_candidates(index, "2024").collect()] == [("https://x.org/a", "20240102000000")]


def test_html_references_without_a_semicolon_stay(spark):
    page = "<h1>a &amp;&amp;&amp</h1><p>&lt;b&gt; &#65;&#x42; &am &copy &copyx; R&D & &</p><a href='/x?a=1&amp;b=2&copy=3'>l</a>"
    pages = spark.createDataFrame([(1, "https://x.org/", page)], "page_id int, url string, html string")
    got = html.articles(pages).first()
    assert (got["headline"], got["content"]) == ("a &&&amp", "a &&&amp\n<b> AB &am &copy &copyx; R&D & &\nl")
    assert html.links(pages).first()["link"] == "https://x.org/x?a=1&b=2&copy=3"


def test_html(spark):
    page = """<html><head><title>Site | Story</title><meta property="og:title" content="Story &amp; more"><meta name="author" content="A. Writer">
    <script>var x = "<p>no</p>"</script></head><body><nav><a href="/home">Home</a></nav><time datetime="2024-02-03T10:00"></time><h1>Story</h1><p>First  para.<p>Second<br>line <a href="b.html#part">b</a> <a href="mailto:x@y">m</a><a href="/home">again</a></body>"""
    got = html.articles(spark.createDataFrame([(1, "https://x.org/dir/a.html", page), (2, None, None), (3, "u", "<p <<>> broken")], "page_id int, url string, html string")).orderBy("page_id").collect()
    assert (got[0]["headline"], got[0]["author"], got[0]["date"], got[0]["content"]) == ("Story & more", "A. Writer", "2024-02-03", "Story\nFirst para.\nSecond\nline b magain")
    assert got[1]["headline"] is None and len(got) == 3
    links = html.links(spark.createDataFrame([(1, "https://x.org/dir/a.html", page)], "page_id int, url string, html string")).collect()
    assert [(r["position"], r["link"]) for r in links] == [(0, "https://x.org/home"), (1, "https://x.org/dir/b.html")]


def test_sinks(spark, tmp_path):
    base = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, "a,\"b\""), (2, None)], "id int, t string")
    sinks.write_csv(df, f"{base}/csv")
    assert {tuple(r) for r in files.read_csv(spark, f"{base}/csv", "id int, t string").collect()} == {tuple(r) for r in df.collect()}
    counts = {r["table"]: r["rows"] for r in sinks.write_bundle({"one": df, "two": df.limit(0)}, f"{base}/bundle").collect()}
    assert counts == {"one": 2, "two": 0}
    sinks.write_merged(df, spark.createDataFrame([(2, "new")], "id int, t string"), ["id"], f"{base}/merged")
    assert sorted((r["id"], r["t"]) for r in spark.read.json(f"{base}/merged").collect()) == [(1, "a,\"b\""), (2, "new")]
    urls = spark.sql("select '/a' as path, date'2024-02-03' as changed union all select '/b', null")
    assert sorted(r["entry"] for r in sinks.sitemap(urls, "https://x.org/").collect()) == ["<url><loc>https://x.org/a</loc><lastmod>2024-02-03</lastmod></url>", "<url><loc>https://x.org/b</loc></url>"]
    assert sinks.markdown(df.orderBy("id")).splitlines()[2:] == ['| 1 | a,"b" |', "| 2 |  |"]
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(5), most=4)


def test_texts_are_written_to_one_folder(spark, tmp_path):
    texts = ["a\nb", "a\nb", "", "é\n", "x" * 70_000] * 20
    path = str(tmp_path / "texts")
    sinks.write_texts(spark.createDataFrame([(t,) for t in texts], "value string").repartition(3), path)
    names = [n for n in os.listdir(path) if n.endswith(".txt")]
    assert len(names) == len(texts) and not [n for n in os.listdir(path) if os.path.isdir(f"{path}/{n}")]
    found = files.manifest(spark, path).join(files.read_texts(spark, path).select(F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), "value"), "file").collect()
    assert sorted((r["bytes"], r["lines"], r["value"]) for r in found) == sorted((len(t.encode()) + 1, t.count("\n") + 1, t + "\n") for t in texts)
