"""Bundles of tables with a manifest that is written last.

A bundle's parts stand in a folder of their own for each version.  Their digests are computed
by the tasks that read them back, the manifest names every part, its bytes, rows and digest and a
root over all of them, and one rename of the manifest makes the version the bundle.  A run that dies
before that leaves the old version whole; readers only ever see parts that a manifest names.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "MANIFEST.json"
#: Rows of a part at most, so that a part can be read back as one value.
PART_ROWS = 1_000_000
_READ = {"parquet": lambda reader, files: reader.parquet(*files), "json": lambda reader, files: reader.json(files)}


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """``part, bytes, sha256`` of the files of a folder; ``part`` is the path below it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder)
    # below the version's folder: table/part-…
    part = F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2))
    return found.select(part.alias("part"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def root_of(parts: list[dict]) -> str:
    """Digest over the parts' names and digests in the order of their names."""
    return hashlib.sha256("".join(f"{p['part']}:{p['sha256']}\n" for p in sorted(parts, key=lambda p: p["part"])).encode()).hexdigest()


def write_bundle(tables: dict[str, DataFrame], path: str, form: str = "parquet", note: str = "", keep_old: bool = False) -> dict:
    """Write the tables as the new version of the bundle at ``path`` and return its manifest.

    On the driver are the manifest's lines alone, one a part.  Unless ``keep_old``, the parts of
    the version before are deleted once the new one is in place.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    folder = f"{path}/{version}"
    for name, df in tables.items():
        df.write.option("maxRecordsPerFile", PART_ROWS).format(form).save(f"{folder}/{name}")
    parts = [r.asDict() for r in digests(spark, folder).orderBy("part").collect()]
    rows = {name: _load(spark, folder, name, df.schema, form, parts).count() for name, df in tables.items()}
    manifest = {"version": version, "form": form, "note": note, "tables": {n: {"schema": df.schema.jsonValue(), "rows": rows[n]} for n, df in tables.items()}, "parts": parts, "root": root_of(parts)}
    old = read_manifest(spark, path)
    commit(spark, path, manifest)
    if old and not keep_old:
        fs, where = _files(spark, f"{path}/{old['version']}")
        fs.delete(where, True)
    return manifest


def commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """Put a manifest in the place of the one that is there, by a rename that replaces it."""
    draft = f"{path}/{MANIFEST}.{manifest['version']}"
    fs, where = _files(spark, draft)
    out = fs.create(where, True)
    out.write(bytearray(json.dumps(manifest, indent=1, sort_keys=True).encode()))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(context.Options.Rename, 1)
    options[0] = context.Options.Rename.OVERWRITE
    target = context.Path(f"{path}/{MANIFEST}")
    files = context.FileContext.getFileContext(fs.makeQualified(where).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(where), fs.makeQualified(target), options)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    fs, where = _files(spark, f"{path}/{MANIFEST}")
    if not fs.exists(where):
        return None
    return json.loads("\n".join(r["value"] for r in spark.read.text(where.toString()).collect()))


def _load(spark: SparkSession, folder: str, table: str, schema, form: str, parts: list[dict]) -> DataFrame:
    own = [f"{folder}/{p['part']}" for p in parts if p["part"].split("/")[0] == table]
    return _READ[form](spark.read.schema(schema), own) if own else spark.createDataFrame([], schema)


def read_bundle(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the bundle's present version: the parts that its manifest names."""
    from pyspark.sql.types import StructType

    manifest = read_manifest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"no bundle at {path}")
    return _load(spark, f"{path}/{manifest['version']}", table, StructType.fromJson(manifest["tables"][table]["schema"]), manifest["form"], manifest["parts"])


def verify_bundle(spark: SparkSession, path: str) -> DataFrame:
    """``part, problem`` where parts differ from the manifest: missing, unexpected, changed, or the
    manifest's own ``root``; no rows if all is right."""
    manifest = read_manifest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"no bundle at {path}")
    expected = spark.createDataFrame([(p["part"], p["bytes"], p["sha256"]) for p in manifest["parts"]], "part string, e_bytes bigint, e_sha256 string")
    both = expected.join(digests(spark, f"{path}/{manifest['version']}"), "part", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("e_sha256").isNull(), "unexpected").when((F.col("bytes") != F.col("e_bytes")) | (F.col("sha256") != F.col("e_sha256")), "changed")
    wrong_root = [(MANIFEST, "root")] * (root_of(manifest["parts"]) != manifest["root"])
    return both.select("part", problem.alias("problem")).where("problem IS NOT NULL").unionByName(spark.createDataFrame(wrong_root, "part string, problem string"))
