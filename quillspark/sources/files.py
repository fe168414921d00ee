"""Readers of JSON, CSV, text and binary files.

Files have no order in Spark: readers that need one give every row the file it came from
and its place there, and "first" and "last" are decided by those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from quillspark.schemas import SCHEMAS

Paths = str | Sequence[str]


def _schema(name: str) -> StructType:
    return _parse_datatype_string(SCHEMAS.get(name, name))


def read_jsonl(spark: SparkSession, paths: Paths, schema: str, strict: bool = True) -> DataFrame:
    """One record a line.  Strict reading fails at a bad line; otherwise bad lines, such as a
    torn last one, are left out."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(_schema(schema)).option("mode", mode).json(list(paths) if not isinstance(paths, str) else paths)


def read_json_array(spark: SparkSession, paths: Paths, schema: str) -> DataFrame:
    """One array of records a file."""
    return spark.read.schema(_schema(schema)).option("multiLine", True).option("mode", "FAILFAST").json(list(paths) if not isinstance(paths, str) else paths)


def read_either(spark: SparkSession, paths: Paths, schema: str) -> DataFrame:
    """Files of either form, told apart by their first sign that isn't white space, with
    ``file`` and ``ord`` (place in the file, from 0).  Bad lines are left out."""
    kind = _schema(schema)
    whole = spark.read.text(list(paths) if not isinstance(paths, str) else paths, wholetext=True).select(F.input_file_name().alias("file"), "value")
    is_array = F.col("value").rlike(r"^\s*\[")
    array = F.from_json("value", f"array<{kind.simpleString()}>")
    checked = f"struct<{kind.simpleString()[7:-1]},_corrupt_record:string>"
    lines = F.filter(F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, checked, {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})), lambda r: r["_corrupt_record"].isNull())
    plain = F.transform(lines, lambda r: F.struct(*(r[n].alias(n) for n in kind.names)))
    return whole.select("file", F.posexplode(F.when(is_array, array).otherwise(plain)).alias("ord", "r")).select("file", "ord", "r.*")


def read_csv(spark: SparkSession, paths: Paths, schema: str) -> DataFrame:
    return spark.read.schema(_schema(schema)).option("header", True).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').csv(list(paths) if not isinstance(paths, str) else paths)


def read_texts(spark: SparkSession, paths: Paths) -> DataFrame:
    """``file, value``: whole text files."""
    return spark.read.text(list(paths) if not isinstance(paths, str) else paths, wholetext=True).select(F.input_file_name().alias("file"), "value")


def source_name(path: Column) -> Column:
    """Name of a file without folder and ending."""
    return F.regexp_extract(path, r"([^/]+?)(\.[A-Za-z0-9]+)?$", 1)


def manifest(spark: SparkSession, paths: Paths) -> DataFrame:
    """``file, bytes, lines, sha256`` of files; an unterminated last line counts."""
    files = spark.read.format("binaryFile").load(list(paths) if not isinstance(paths, str) else paths)
    signs = F.decode("content", "ISO-8859-1")  # a sign a byte
    newline = F.length(signs) - F.length(F.replace(signs, F.lit("\n"), F.lit("")))
    open_end = (F.length(signs) > 0) & ~F.endswith(signs, F.lit("\n"))
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), (newline + open_end.cast("int")).cast("bigint").alias("lines"), F.sha2("content", 256).alias("sha256"))


def verify(expected: DataFrame, found: DataFrame) -> DataFrame:
    """``file, problem`` (missing, unexpected or changed) where two manifests differ."""
    e = expected.select("file", F.col("sha256").alias("__e"))
    f = found.select("file", F.col("sha256").alias("__f"))
    problem = F.when(F.col("__f").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(F.col("__e") != F.col("__f"), "changed")
    return e.join(f, "file", "full").select("file", problem.alias("problem")).where("problem is not null")


def date_range(df: DataFrame, date: str, since: str, until: str = "") -> DataFrame:
    """Rows from ``since`` to ``until``, both included; ``until`` may be a month or a year."""
    rows = df.where(F.col(date) >= since)
    return rows.where(F.substring(F.col(date), 1, len(until)) <= until) if until else rows


def with_fallback(primary: DataFrame, fallback: DataFrame, day: str) -> DataFrame:
    """All of the primary source, and the fallback's rows of days that the primary lacks."""
    return primary.unionByName(fallback.join(primary.select(day).distinct(), day, "left_anti"), allowMissingColumns=True)


def reference_rows(comparison: DataFrame, model: str) -> DataFrame:
    """Rows of a model comparison (``results`` of struct<model, repeat, rows>) by the reference model, first repeat."""
    return comparison.select(F.explode("results").alias("r")).where((F.col("r.model") == model) & (F.col("r.repeat") == 0)).select(F.explode("r.rows").alias("row")).select("row.*")


def captions(lines: DataFrame, keys: list[str], order: str, line: str) -> DataFrame:
    """``keys, text`` of caption files: timing lines, marks and lines that repeat the one before go."""
    bare = F.trim(F.regexp_replace(F.col(line), "<[^>]*>", ""))
    kept = lines.where(~F.col(line).rlike(r"-->|^WEBVTT|^(Kind|Language):|^\d+$")).select(*keys, order, bare.alias("__t")).where("__t <> ''")
    listed = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "__t"))).alias("__l")).select(*keys, F.transform("__l", lambda x: x["__t"]).alias("__l"))
    return listed.select(*keys, F.array_join(F.filter("__l", lambda x, i: (i == 0) | (x != F.get("__l", i - 1))), " ").alias("text"))


def archive_candidates(index: DataFrame, since: str) -> DataFrame:
    """``url, ts``: the earliest capture of each canonical URL from ``since`` on (``url, ts`` as yyyyMMddHHmmss)."""
    canonical = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("url"), r"^http:", "https:"), r"://www\.", "://"), r"(:80)?/*([?#].*)?$", "")
    return index.where(F.col("ts") >= since).groupBy(canonical.alias("url")).agg(F.min("ts").alias("ts"))
