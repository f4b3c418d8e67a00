"""Counts, sums and ratios over a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.schema import COMPRESSED_FLAG, DELTA_FLAG, DIRECTORY, FILE, HARDLINK_FLAG, SYMLINK


def manifest_counters(entries: DataFrame, by: str = "snapshot") -> DataFrame:
    """Entries, kinds, bytes (hard links included) and chunk references of each snapshot."""
    kind = lambda k: F.count_if(F.col("type") == k)
    return entries.groupBy(by).agg(
        F.count("*").alias("entry_count"), kind(FILE).alias("file_count"), kind(DIRECTORY).alias("dir_count"), kind(SYMLINK).alias("symlink_count"),
        F.sum("size").alias("logical_bytes"), F.sum(F.coalesce(F.size("chunks"), F.lit(0))).cast("long").alias("chunk_refs"),
    )


def delta_totals(entries: DataFrame) -> DataFrame:
    delta = entries.where(F.col("flags").bitwiseAND(DELTA_FLAG) != 0)
    return delta.agg(F.count("*").alias("delta_entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("delta_bytes"), F.coalesce(F.sum(F.size("delta_source_chunks")), F.lit(0)).alias("delta_refs"))


def pack_stats(packs: DataFrame) -> DataFrame:
    """Number, bytes and whole average of the packs."""
    n, total = F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))
    return packs.agg(n.alias("packs"), total.alias("pack_bytes"), F.when(n > 0, F.floor(total / n)).otherwise(0).cast("long").alias("average_bytes"))


def ratio(a, b):
    """a / b to four places, or 0 where b is 0."""
    return F.when(b > 0, F.round(a.cast("double") / b, 4)).otherwise(0.0)


def chunk_stats(index: DataFrame, refs: int | None = None) -> DataFrame:
    compressed = F.col("flags").bitwiseAND(COMPRESSED_FLAG) != 0
    got = index.agg(F.count("*").alias("unique_chunks"), F.sum("uncomp_size").alias("uncomp_bytes"), F.sum("comp_size").alias("comp_bytes"), F.count_if(compressed).alias("compressed"), F.count_if(~compressed).alias("uncompressed"))
    got = got.withColumn("compression_ratio", ratio(F.col("uncomp_bytes"), F.col("comp_bytes")))
    return got if refs is None else got.withColumn("dedup_ratio", ratio(F.lit(refs), F.col("unique_chunks")))


def repo_info(counters: DataFrame, index: DataFrame, packs: DataFrame) -> DataFrame:
    """One row of totals and the three ratios."""
    totals = counters.agg(F.count("*").alias("snapshots"), F.sum("entry_count").alias("entries"), F.sum("logical_bytes").alias("logical_bytes"), F.sum("chunk_refs").alias("chunk_refs"))
    out = totals.crossJoin(chunk_stats(index)).crossJoin(pack_stats(packs))  # one row each
    return out.withColumn("dedup_ratio", ratio(F.col("chunk_refs"), F.col("unique_chunks"))).withColumn("overall_ratio", ratio(F.col("logical_bytes"), F.col("pack_bytes")))


def create_stats(entries: DataFrame, index: DataFrame) -> DataFrame:
    """Input without hard links, output of the distinct chunks, and the share saved in percent."""
    own = entries.where((F.col("type") == FILE) & (F.col("flags").bitwiseAND(HARDLINK_FLAG) == 0))
    used = own.select(F.explode("chunks").alias("chunk_id")).distinct().join(index, "chunk_id").agg(F.coalesce(F.sum("comp_size"), F.lit(0)).alias("output_bytes"))
    out = own.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("input_bytes")).crossJoin(used)
    return out.withColumn("saved", F.greatest(F.lit(0.0), 100 - 100 * ratio(F.col("output_bytes"), F.col("input_bytes"))))
