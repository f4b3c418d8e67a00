"""Listing and searching paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.match import search_matches, under
from cairnlake.schema import DIRECTORY


def children(entries: DataFrame, prefix: str = "") -> DataFrame:
    """(name, is_dir) directly below a directory, each once; a directory without a row of its own is implied by what it holds."""
    p = prefix.strip("/")
    rest = F.substring("path", len(p) + 2 if p else 1, 1 << 30)
    first = F.substring_index(rest, "/", 1)
    is_dir = F.contains(rest, F.lit("/")) | (F.col("type") == DIRECTORY)
    rows = entries.where(under(F.col("path"), p)).select(first.alias("name"), is_dir.alias("is_dir")).where("name <> ''")
    return rows.groupBy("name").agg(F.bool_or("is_dir").alias("is_dir"))


def panel(entries: DataFrame, prefix: str = "", hidden: bool = False) -> DataFrame:
    """Children in the order of a panel: directories first, then by name."""
    rows = children(entries, prefix)
    return (rows if hidden else rows.where("name not like '.%'")).orderBy(F.desc("is_dir"), "name")


def listing(entries: DataFrame, prefix: str = "") -> DataFrame:
    return entries.where(under(F.col("path"), prefix)).orderBy("path")


def search(entries: DataFrame, pattern: str, glob: bool | None = None, snapshot: str | None = None) -> DataFrame:
    """Entries whose path matches; a snapshot name prunes partitions where entries are partitioned by it."""
    rows = entries if snapshot is None else entries.where(F.col("snapshot") == snapshot)
    return rows.where(search_matches(F.col("path"), pattern, glob))


def tree_sizes(entries: DataFrame, prefix: str = "") -> DataFrame:
    """(name, bytes, files) of the children of a directory."""
    p = prefix.strip("/")
    rest = F.substring("path", len(p) + 2 if p else 1, 1 << 30)
    return entries.where(under(F.col("path"), p)).groupBy(F.substring_index(rest, "/", 1).alias("name")).agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))
