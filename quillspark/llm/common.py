"""Plumbing that the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound of the text bytes of one Arrow batch that is built or held at once.
BATCH_BYTES = 8 << 20


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir`` or by ``setCheckpointDir``.  Only a local
    session where both are unset (as in tests) uses a folder under the machine's temporary
    folder, and sets it as the checkpoint folder; elsewhere that is an error, since executors
    would write where nobody else reads.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        named = sc._jsc.sc().getCheckpointDir()
        if named.isDefined():
            return f"{named.get().rstrip('/')}/quillspark"
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "quillspark-scratch")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quillspark"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost
    executor loses nothing."""
    path = scratch_path(df.sparkSession, label)
    schema, spark = df.schema, df.sparkSession
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote, once nothing needs them."""
    spark = df.sparkSession
    roots = {f.rpartition("/")[0] for f in df.inputFiles()}
    jvm = spark.sparkContext._jvm
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def limit_batches(spark: SparkSession) -> None:
    """Keep Arrow batches for Python to ``BATCH_BYTES``, so that long texts don't gather in one."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if size > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def bounded(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slice batches so that each holds at most ``most`` bytes of ``column``, or one row."""
    for batch in batches:
        if batch.nbytes <= most:
            yield batch
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            size = size or 0
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; NULL ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
