"""Windows of a day's lines by their address ``day#number``, without storing any window's text.

Lines are stored once, a folder a day; beside them stands the address index: for each window
the numbers of its first and last line.  An address is resolved to a day and a range of lines, so
one address opens one day's folder of each.  More than ``FEW_DAYS`` days share ``FOLDERS`` folders, each in
the order of its days, since writing and listing a folder for each would take longer than the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.packing import pack

#: Days up to which a read names the folders that it opens.
FEW_DAYS = 1000
#: Folders of more days than that.
FOLDERS = 256


def parse(address: Column) -> tuple[Column, Column]:
    """(day, number) of an address; NULLs if it isn't one."""
    number = F.nullif(F.regexp_extract(address, r"^.+#(\d{1,9})$", 1), F.lit("")).try_cast("int")
    return F.when(number.isNotNull(), F.regexp_extract(address, r"^(.+)#\d+$", 1)), number


def _folder(day: Column) -> Column:
    return F.pmod(F.hash(day), F.lit(FOLDERS))


def write_addressed(lines: DataFrame, path: str, day: str, order: str, line: str, size: Column, limit: int) -> None:
    """Store ``lines`` (``order`` is unique in a day) by day, and the index of their greedy windows of
    ``limit`` in ``size``.  NULL lines are empty; rows without a day are left out."""
    rows = lines.where(F.col(day).isNotNull()).select(F.col(day).cast("string").alias("day"), F.col(order).alias("ord"), F.coalesce(F.col(line), F.lit("")).alias("line"), size.alias("size"))
    few = rows.select("day").distinct().limit(FEW_DAYS + 1).count() <= FEW_DAYS

    def write(df: DataFrame, order: str, part: str) -> None:
        folder = "day" if few else "folder"
        df = df if few else df.withColumn("folder", _folder(F.col("day")))
        df.repartition(folder).sortWithinPartitions(*dict.fromkeys([folder, "day", order])).write.partitionBy(folder).parquet(f"{path}/{part}")

    write(rows.select("day", "ord", "line"), "ord", "lines")
    windows = pack(rows, ["day"], "ord", F.col("size"), limit)
    index = windows.groupBy("day", "window").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    write(index, "window", "index")


def _stored(spark: SparkSession, path: str, part: str) -> DataFrame:
    schema = {"lines": "ord bigint, line string, day string, folder int", "index": "window int, first bigint, last bigint, day string, folder int"}[part]
    return spark.read.schema(schema).parquet(f"{path}/{part}")


def _of(days: list[str], folders: list[int]) -> Column:
    """Rows of these days; where a day has its own folder, ``folder`` is NULL."""
    return F.col("day").isin(days) & (F.col("folder").isNull() | F.col("folder").isin(folders))


def window_text(spark: SparkSession, path: str, address: str) -> str | None:
    """Text of one window; None if there is none of that address.  Opens that day's folders only."""
    day, _, number = address.rpartition("#")
    if not day or not number.isascii() or not number.isdigit():
        return None
    own = _of([day], [spark.range(1).select(_folder(F.lit(day))).first()[0]])
    found = _stored(spark, path, "index").where(own & (F.col("window") == int(number))).first()
    if found is None:
        return None
    lines = _stored(spark, path, "lines").where(own & F.col("ord").between(found["first"], found["last"])).orderBy("ord")
    return "\n".join(r["line"] for r in lines.collect())  # one window, whose size is bounded


def window_texts(spark: SparkSession, path: str, addresses: DataFrame, address: str) -> DataFrame:
    """``address, text`` of every distinct address; NULL text where there is none.

    Addresses are joined with the index and their windows with the lines by day; a line belongs to
    one window, so nothing is multiplied.  Where the addresses are of no more than ``FEW_DAYS`` days,
    only those days' folders are opened.
    """
    day, number = parse(F.col("address"))
    asked = addresses.select(F.col(f"`{address}`").alias("address")).distinct().select("address", day.alias("day"), number.alias("window"))
    days = asked.where("day IS NOT NULL").select("day", _folder(F.col("day")).alias("folder")).distinct().limit(FEW_DAYS + 1).collect()
    wanted = _of([r["day"] for r in days], sorted({r["folder"] for r in days})) if len(days) <= FEW_DAYS else F.lit(True)
    index, lines = (_stored(spark, path, part).where(wanted).drop("folder") for part in ("index", "lines"))
    found = asked.join(index, ["day", "window"])
    inside = found.join(lines, (found["day"] == lines["day"]) & lines["ord"].between(found["first"], found["last"])).select("address", "ord", "line")
    texts = inside.groupBy("address").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return asked.select("address").join(texts, "address", "left")
