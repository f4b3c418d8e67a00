"""Differences of two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.schema import FILE, SYMLINK

_FIELDS = ("type", "mode", "uid", "gid", "size", "mtime_ns", "symlink_target", "hardlink_to", "chunks")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): D only in old, A only in new, T another type, M content, C metadata, = none of these. One full
    outer join on the path. Files differ by size or ordered chunks, or by target if either is a hard link."""
    # A null list of chunks is an empty one.
    fields = [F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks") if c == "chunks" else F.col(c) for c in _FIELDS]
    side = lambda df, x: df.select("path", F.struct(*fields).alias(x))
    both = side(old, "a").join(side(new, "b"), "path", "full_outer")
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    linked = F.col("a.hardlink_to").isNotNull() | F.col("b.hardlink_to").isNotNull()
    content = F.when(F.col("a.type") == FILE, F.when(linked, ~same("hardlink_to")).otherwise(~same("size") | ~same("chunks"))).when(F.col("a.type") == SYMLINK, ~same("symlink_target")).otherwise(False)
    metadata = ~(same("mode") & same("uid") & same("gid") & same("mtime_ns"))
    status = F.when(F.col("a").isNull(), "A").when(F.col("b").isNull(), "D").when(~same("type"), "T").when(content, "M").when(metadata, "C").otherwise("=")
    return both.select("path", status.alias("status"))


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("n"))
