"""Writers: JSON lines, CSV, bundles with a manifest, sitemaps and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.incremental import upsert


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_texts(df: DataFrame, path: str) -> None:
    """A text file for each row of ``value``, all in the new folder ``path``, with names that don't repeat.

    One folder is listed at once, where a folder a file takes a call each; the tasks put their files
    in place themselves, so ``path`` holds a whole result only once this returns.
    """
    df.select("value").write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def write_merged(old: DataFrame, new: DataFrame, keys: list[str], path: str) -> None:
    """New rows replace the old ones of their key wholesale; ``path`` must not be what ``old`` is read from."""
    write_jsonl(upsert(old, new, keys), path)


def write_bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write each table as JSON lines under ``path``; ``table, rows`` of what was written."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        write_jsonl(df, f"{path}/{name}")
        counts.append((name, spark.read.text(f"{path}/{name}").count()))
    return spark.createDataFrame(counts, "table string, rows bigint")


def sitemap(urls: DataFrame, base: str) -> DataFrame:
    """``entry``: a sitemap line for each path of ``urls`` (``path, changed``)."""
    loc = F.concat(F.lit(f"<url><loc>{base.rstrip('/')}"), F.col("path"), F.lit("</loc>"))
    changed = F.coalesce(F.concat(F.lit("<lastmod>"), F.date_format("changed", "yyyy-MM-dd"), F.lit("</lastmod>")), F.lit(""))
    return urls.select(F.concat(loc, changed, F.lit("</url>")).alias("entry"))


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; more than ``most`` rows are refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of over {most} rows")
    show = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *([show(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
