"""Referential integrity: snapshots, index, packs and filters against each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_refs(refs: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """References (each counted) whose key the other table lacks."""
    return refs.join(index.select(key), key, "left_anti")


def refs_to_missing_packs(refs: DataFrame, index: DataFrame, packs: DataFrame) -> DataFrame:
    """References found in the index whose pack does not exist. Lost index rows are few, so they are found first."""
    lost = index.join(packs.select("pack_id"), "pack_id", "left_anti")
    return refs.join(lost, "chunk_id")


def orphan_segments(index: DataFrame, packs: DataFrame) -> DataFrame:
    """Segments with no pack of their name, none of whose entries is in an existing pack."""
    ids = packs.select("pack_id")
    segments = index.select("segment_id").distinct().join(ids.withColumnRenamed("pack_id", "segment_id"), "segment_id", "left_anti")
    return segments.join(index.join(ids, "pack_id", "left_semi").select("segment_id").distinct(), "segment_id", "left_anti")


def indexless_packs(pack_entries: DataFrame, packs: DataFrame, index: DataFrame) -> DataFrame:
    """Packs that the index does not name and none of whose chunks it knows."""
    idle = packs.select("pack_id").join(index.select("pack_id"), "pack_id", "left_anti")
    known = pack_entries.join(index.select("chunk_id"), "chunk_id", "left_semi").select("pack_id").distinct()
    return idle.join(known, "pack_id", "left_anti")


def orphan_filters(filters: DataFrame, index: DataFrame) -> DataFrame:
    return filters.join(index.select("segment_id").distinct(), "segment_id", "left_anti")


def rebuilt_index(pack_entries: DataFrame, index: DataFrame, segment_id: int) -> DataFrame:
    """Rows of a new segment: what packs hold and the index lacks."""
    return pack_entries.join(index.select("chunk_id"), "chunk_id", "left_anti").dropDuplicates(["chunk_id"]).withColumn("segment_id", F.lit(segment_id).cast("long"))


def latest(index: DataFrame, order: str = "segment_id") -> DataFrame:
    """One row for each chunk: that of the last segment."""
    cols = [c for c in index.columns if c != "chunk_id"]
    return index.groupBy("chunk_id").agg(F.max_by(F.struct(*cols), order).alias("v")).select("chunk_id", "v.*")


def health(checks: dict[str, DataFrame]) -> DataFrame:
    """(category, n) of named anomaly tables, and their total."""
    rows = reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(k).alias("category"), "n") for k, df in checks.items()))
    return rows.unionByName(rows.agg(F.lit("total").alias("category"), F.sum("n").alias("n")))


def damaged_packs(packs: DataFrame) -> DataFrame:
    """Packs whose payload does not have the stored CRC-32C."""
    from cairnlake.functions.hashing import crc32c

    return packs.where(F.col("payload").isNull() | (crc32c("payload") != F.col("stored_crc"))).select("pack_id")


def damaged_chunks(payloads: DataFrame, algo: str = "sha256") -> DataFrame:
    """Chunks whose payload is missing, or differs from their id or (where it is given) their size."""
    from cairnlake.functions.hashing import blake2b_128, fnv1a_128_lowprime

    made = {"sha256": lambda: F.substring(F.sha2("payload", 256), 1, 32), "blake2b_128": lambda: F.lower(F.hex(blake2b_128("payload"))), "fnv1a_128_lowprime": lambda: F.lower(F.hex(fnv1a_128_lowprime("payload")))}[algo]()
    size = F.octet_length("payload") != F.col("uncomp_size") if "uncomp_size" in payloads.columns else F.lit(False)
    return payloads.where(F.col("payload").isNull() | size | (made != F.col("chunk_id"))).select("chunk_id")
