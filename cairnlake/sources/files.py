"""Scan of files by Spark's own reader: one row for each file below a root, with or without its content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.schema import FILE


def split_sources(text: str) -> list[str]:
    """Comma list without blanks around or empty parts."""
    return [x for x in (p.strip(" \t") for p in text.split(",")) if x]


def scan(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(source, path, type, size, mtime_ns[, content]); paths begin with the root's last segment. Content is read only if
    asked for."""
    base = root.rstrip("/").rsplit("/", 1)[-1]
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    tail = F.regexp_extract("path", rf"^.*?{root.rstrip('/').replace('file://', '')}/(.*)$", 1)
    out = rows.select(F.lit(root).alias("source"), F.concat(F.lit(base + "/"), tail).alias("path"), F.lit(FILE).alias("type"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), *["content"] * content)
    return out
