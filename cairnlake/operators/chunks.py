"""Chunk references, deduplication, reconstruction, hard links and the file cache."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.chunking import ChunkSizes, cut_points
from cairnlake.functions.hashing import digest
from cairnlake.schema import FILE, HARDLINK_FLAG


def chunk_refs(entries: DataFrame) -> DataFrame:
    """(snapshot, path, role, ord, chunk_id) of data and delta-source chunks."""
    one = lambda c, role: entries.select("snapshot", "path", F.lit(role).alias("role"), F.posexplode(c).alias("ord", "chunk_id"))
    return one("chunks", "data").unionByName(one("delta_source_chunks", "delta_source"))


def new_chunks(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """One row for each chunk id that the index does not hold yet."""
    return chunks.dropDuplicates(["chunk_id"]).join(existing.select("chunk_id"), "chunk_id", "left_anti")


def content_chunks(files: DataFrame, key: str, data: str, sizes: ChunkSizes = ChunkSizes(), algo: str = "sha256") -> DataFrame:
    """(key, ord, chunk_id, payload) of content-defined chunks, cut and named in one pass over each file; a null file has none."""
    rows = files.select(F.col(key).alias("key"), F.col(data).cast("binary").alias("raw")).where("raw is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw in enumerate(batch.column(1)):
                whole = raw.as_py()
                ends = cut_points(whole, sizes)
                parts = [whole[a:b] for a, b in zip([0, *ends], ends)]
                ids = [digest(algo, x).hex() for x in parts]
                keys = batch.column(0).take(pa.array([at] * len(parts), pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(range(len(parts)), pa.int32()), pa.array(ids, pa.string()), pa.array(parts, pa.binary())], names=["key", "ord", "chunk_id", "payload"])

    kind = files.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ord int, chunk_id string, payload binary").withColumnRenamed("key", key)


def fixed_chunks(files: DataFrame, key: str, data: str, width: int) -> DataFrame:
    """(key, ord, piece): pieces of `width` characters."""
    n = F.ceil(F.length(data) / width).cast("int")
    rows = files.select(key, data, F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).alias("ord"))
    return rows.select(key, "ord", F.substring(data, F.col("ord") * width + 1, F.lit(width)).alias("piece"))


def reconstruct(refs: DataFrame, payloads: DataFrame, key: str) -> DataFrame:
    """(key, data, missing): chunks joined by id and put together in order; missing counts references without a payload.
    The parts are joined as text at once, so that a file of many chunks is not copied for each of them."""
    rows = refs.join(payloads.select("chunk_id", "payload"), "chunk_id", "left")
    parts = F.array_sort(F.collect_list(F.struct("ord", F.hex("payload").alias("payload"))))
    out = rows.groupBy(key).agg(parts.alias("parts"), F.count_if(F.col("payload").isNull()).alias("missing"))
    data = F.unhex(F.array_join(F.transform("parts", lambda x: F.coalesce(x["payload"], F.lit(""))), ""))
    return out.select(key, data.alias("data"), "missing")


def group_hardlinks(entries: DataFrame, by: tuple = ("dev", "ino")) -> DataFrame:
    """Entries with canonical (smallest path of the group) and is_link. Only files with an inode number are linked: other
    entries take no part in the groups or in the join."""
    able = (F.col("type") == FILE) & F.col("ino").isNotNull() & (F.col("ino").cast("string") != "0")
    least = entries.where(able).groupBy(*by).agg(F.min("path").alias("canonical"), F.count("*").alias("links")).where("links > 1").drop("links")
    linked = entries.where(able).join(least, list(by), "left").select(*entries.columns, "canonical")
    out = linked.unionByName(entries.where(~F.coalesce(able, F.lit(False))).withColumn("canonical", F.lit(None).cast("string")))
    return out.withColumn("is_link", F.col("canonical").isNotNull() & (F.col("path") != F.col("canonical")))


def as_links(grouped: DataFrame) -> DataFrame:
    """Linked entries point to the canonical one and hold no chunks."""
    link = F.col("is_link")
    return grouped.withColumn("flags", F.when(link, F.col("flags").bitwiseOR(HARDLINK_FLAG)).otherwise(F.col("flags"))).withColumn("hardlink_to", F.when(link, F.col("canonical"))).withColumn("chunks", F.when(~link, F.col("chunks")))


_IDENTITY = ("dev", "ino", "size", "mtime_ns", "ctime_ns", "mode")


def cache_hits(entries: DataFrame, cache: DataFrame, index: DataFrame) -> DataFrame:
    """Paths whose cached identity is equal in every field and whose chunks are all in the index."""
    same = entries.select("path", *_IDENTITY).join(cache.select("path", *_IDENTITY, "chunks"), ["path", *_IDENTITY])
    return same.select("path").join(stale_cache(cache, index), "path", "left_anti")


def stale_cache(cache: DataFrame, index: DataFrame) -> DataFrame:
    """Cache paths with a chunk that the index lacks."""
    return cache.select("path", F.explode("chunks").alias("chunk_id")).join(index.select("chunk_id"), "chunk_id", "left_anti").select("path").distinct()


def delta_candidates(entries: DataFrame, cache: DataFrame, index: DataFrame, limit: int = 256 << 10) -> DataFrame:
    """Changed files up to `limit` bytes whose previous version is whole in the index: what a delta may be tried for."""
    previous = cache.join(stale_cache(cache, index), "path", "left_anti").select("path", F.col("chunks").alias("previous_chunks"))
    return entries.where(F.col("size") <= limit).join(previous, "path").join(cache_hits(entries, cache, index), "path", "left_anti")


def delta_pays(size, delta_size):
    return delta_size * 2 < size
