"""Packs: chunks encoded, put behind each other up to a limit, read back and rewritten."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.chunking import incompressible
from cairnlake.functions.hashing import crc32c_of
from cairnlake.schema import COMPRESSED_FLAG, ENCRYPTED_FLAG, ZSTD_FLAG

ENTRY = "struct<chunk_id:string,offset:bigint,comp_size:bigint,uncomp_size:bigint,flags:int>"
PACK = f"pack_id long, bytes long, stored_crc long, payload binary, entries array<{ENTRY}>"
#: Fixed value: bytes from which on a pack is closed.
ROTATE_BYTES = 64 << 20


@cache
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


def encode(payload: bytes, level: int) -> tuple[bytes, int]:
    """What is stored of a chunk and its flags: it is compressed unless it looks random or does not get smaller."""
    if level and not incompressible(payload):
        small = _compressor(level).compress(payload)
        if len(small) < len(payload):
            return small, COMPRESSED_FLAG | ZSTD_FLAG
    return payload, 0


def decode(stored: bytes, flags: int, size: int) -> bytes | None:
    """The chunk, or None where the stored bytes cannot be it."""
    try:
        return zstandard.ZstdDecompressor().decompress(stored, max_output_size=max(1, size)) if flags & COMPRESSED_FLAG else stored
    except zstandard.ZstdError:
        return None


def encoded(chunks: DataFrame, level: int = 3) -> DataFrame:
    """(chunk_id, payload) -> (chunk_id, stored, uncomp_size, flags)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [bytes(x or b"") for x in batch.column(1).to_pylist()]
            got = [encode(x, level) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.binary()), pa.array(list(map(len, raw)), pa.int64()), pa.array([f for _, f in got], pa.int32())], names=["chunk_id", "stored", "uncomp_size", "flags"])

    return chunks.select("chunk_id", "payload").mapInArrow(run, "chunk_id string, stored binary, uncomp_size long, flags int")


def sealed(rows: DataFrame, key: bytes) -> DataFrame:
    """Stored bytes under AES-GCM: nonce, ciphertext and tag; the size of the chunk stays."""
    return rows.withColumn("stored", F.aes_encrypt("stored", F.lit(key), F.lit("GCM"))).withColumn("flags", F.col("flags").bitwiseOR(ENCRYPTED_FLAG))


class Rotation:
    """Numbers packs as they are filled: one is closed before a chunk that does not fit in it, if it holds any."""

    def __init__(self, limit: int, header: int = 0):
        self.limit, self.header = limit, header
        self.pack, self.fill, self.held = 0, header, 0

    def add(self, size: int) -> int:
        if self.held and (self.fill >= self.limit or self.fill + size > self.limit):
            self.pack, self.fill, self.held = self.pack + 1, self.header, 0
        self.fill, self.held = self.fill + size, self.held + 1
        return self.pack


def rotation(chunks: DataFrame, order: str, size: str, by: str, limit: int, header: int = 36) -> DataFrame:
    """chunks with the number of the pack that each comes to within its writer. A writer is one sequence; its rows stream
    through a task in their order, so a large load is dealt to many writers."""
    schema = f"{chunks.drop('pack')._jdf.schema().toDDL()}, pack BIGINT"
    rows = chunks.drop("pack").repartition(F.col(by)).sortWithinPartitions(by, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packs = (), Rotation(limit, header)
        for batch in batches:
            out = []
            for writer, n in zip(batch.column(by).to_pylist(), batch.column(size).to_pylist()):
                if (writer,) != now:
                    now, packs = (writer,), Rotation(limit, header)
                out.append(packs.add(int(n or 0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "pack"])

    return rows.mapInArrow(run, schema)


def packed(rows: DataFrame, first: int, writers: int = 8, limit: int = ROTATE_BYTES) -> DataFrame:
    """Encoded chunks -> packs with their entries; pack ids begin at `first`. Each writer holds one pack at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, packs = None, [], Rotation(limit)

        def pack(writer: int, number: int) -> pa.RecordBatch:
            payload, offset, entries = b"".join(x[1] for x in held), 0, []
            for chunk_id, stored, size, flags in held:
                entries.append({"chunk_id": chunk_id, "offset": offset, "comp_size": len(stored), "uncomp_size": size, "flags": flags})
                offset += len(stored)
            kind = pa.list_(pa.struct([("chunk_id", pa.string()), ("offset", pa.int64()), ("comp_size", pa.int64()), ("uncomp_size", pa.int64()), ("flags", pa.int32())]))
            values = [pa.array([first + number * writers + writer], pa.int64()), pa.array([len(payload)], pa.int64()), pa.array([int(crc32c_of([payload])[0])], pa.int64()), pa.array([payload], pa.binary()), pa.array([entries], kind)]
            return pa.RecordBatch.from_arrays(values, names=["pack_id", "bytes", "stored_crc", "payload", "entries"])

        at = 0
        for batch in batches:
            for writer, *row in zip(*(batch.column(c).to_pylist() for c in ("writer", "chunk_id", "stored", "uncomp_size", "flags"))):
                if writer != now:
                    if held:
                        yield pack(now, at)
                    now, held, packs, at = writer, [], Rotation(limit), 0
                number = packs.add(len(row[1]))
                if number != at:
                    yield pack(now, at)
                    held, at = [], number
                held.append(row)
        if held:
            yield pack(now, at)

    dealt = rows.withColumn("writer", F.pmod(F.xxhash64("chunk_id"), F.lit(writers)).cast("long"))
    return dealt.select("writer", "chunk_id", "stored", "uncomp_size", "flags").repartition("writer").sortWithinPartitions("writer", "chunk_id").mapInArrow(run, PACK)


def _placed(packs: DataFrame, index: DataFrame | None) -> DataFrame:
    """(pack_id, payload, entries) by the index, or without one by the entries that the packs carry, which needs no join."""
    if index is None:
        return packs.select("pack_id", "payload", "entries")
    fields = ("chunk_id", "offset", "comp_size", "uncomp_size", "flags")
    return packs.select("pack_id", "payload").join(index.groupBy("pack_id").agg(F.collect_list(F.struct(*fields)).alias("entries")), "pack_id")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack_id, payload, entries in zip(*(batch.column(c).to_pylist() for c in ("pack_id", "payload", "entries"))):
            raw = payload or b""
            stored = [raw[e["offset"] : e["offset"] + e["comp_size"]] if 0 <= e["offset"] <= len(raw) - e["comp_size"] else None for e in entries]
            columns = [pa.array([e["chunk_id"] for e in entries], pa.string()), pa.array([pack_id] * len(entries), pa.int64()), pa.array([e["uncomp_size"] for e in entries], pa.int64()), pa.array([e["flags"] for e in entries], pa.int32()), pa.array(stored, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk_id", "pack_id", "uncomp_size", "flags", "stored"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [None if x is None else decode(x, f, n) for x, f, n in zip(*(batch.column(c).to_pylist() for c in ("stored", "flags", "uncomp_size")))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(got, pa.binary())], names=["chunk_id", "pack_id", "uncomp_size", "payload"])


def _opened_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices opened at once, without a key: what is encrypted stays shut."""
    for batch in _slices(batches):
        stored = [None if f & ENCRYPTED_FLAG else x for x, f in zip(batch.column("stored").to_pylist(), batch.column("flags").to_pylist())]
        yield from _opened([batch.set_column(4, "stored", pa.array(stored, pa.binary()))])


def sliced(packs: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(chunk_id, pack_id, uncomp_size, flags, stored): the stored bytes of the chunks that the index, or else the packs' own
    entries, place in these packs, null where the place is out of bounds. A pack is sliced as a whole, not once for each chunk."""
    return _placed(packs, index).mapInArrow(_slices, "chunk_id string, pack_id long, uncomp_size long, flags int, stored binary")


def unpacked(packs: DataFrame, index: DataFrame | None = None, key: bytes | None = None) -> DataFrame:
    """(chunk_id, pack_id, uncomp_size, payload) of the chunks that the index, or else the packs' own entries, place in these
    packs; payload is null where the place is out of bounds or the bytes cannot be decoded."""
    schema = "chunk_id string, pack_id long, uncomp_size long, payload binary"
    if not key:
        return _placed(packs, index).mapInArrow(_opened_slices, schema)
    secret = F.col("flags").bitwiseAND(ENCRYPTED_FLAG) != 0
    clear = F.when(secret, F.try_aes_decrypt("stored", F.lit(key), F.lit("GCM"))).otherwise(F.col("stored"))
    return sliced(packs, index).withColumn("stored", clear).mapInArrow(_opened, schema)


def bloom(ids: DataFrame, by: str = "segment_id", bits: int = 1 << 24, hashes: int = 5) -> DataFrame:
    """(segment_id, size_bits, num_hashes, bits): a filter for the chunk ids of each segment. Tasks fill filters of their own,
    which are then put together."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            segment, places = np.asarray(batch.column(0)), bloom_places(batch.column(1).to_pylist(), bits, hashes)
            for s in np.unique(segment):
                made.setdefault(int(s), np.zeros(bits, bool))[places[segment == s].ravel()] = True
        for s, held in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], names=["segment_id", "bits"])

    def join(rows: pa.Table) -> pa.Table:
        whole = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows["bits"].to_pylist()])
        return pa.table({"segment_id": rows["segment_id"][:1], "bits": pa.array([whole.tobytes()], pa.binary())})

    parts = ids.select(F.col(by).cast("long").alias("segment_id"), "chunk_id").mapInArrow(fill, "segment_id long, bits binary")
    whole = parts.groupBy("segment_id").applyInArrow(join, "segment_id long, bits binary")
    return whole.select("segment_id", F.lit(bits).cast("long").alias("size_bits"), F.lit(hashes).alias("num_hashes"), "bits")


def bloom_places(ids: list[str], bits: int, hashes: int) -> np.ndarray:
    """(ids, hashes) places of hexadecimal ids of 16 bytes, by double hashing of their halves."""
    raw = np.frombuffer(b"".join(bytes.fromhex(x) for x in ids), "<u8").reshape(-1, 2)
    a, b = raw[:, :1], raw[:, 1:] | np.uint64(1)
    return ((a + np.arange(hashes, dtype=np.uint64) * b) % np.uint64(bits)).astype(np.int64)


def may_hold(filters: DataFrame, ids: DataFrame) -> DataFrame:
    """(chunk_id, segment_id) of the segments whose filter lets the id through. The ids are few and asked of all filters."""
    asked = ids.select(F.collect_set("chunk_id").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, bits, hashes, raw, wanted in zip(*(batch.column(c).to_pylist() for c in ("segment_id", "size_bits", "num_hashes", "bits", "ids"))):
                held = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
                found = [x for x, ok in zip(wanted, held[bloom_places(wanted, bits, hashes)].all(axis=1) if wanted else []) if ok]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([segment] * len(found), pa.int64())], names=["chunk_id", "segment_id"])

    return filters.crossJoin(F.broadcast(asked)).mapInArrow(run, "chunk_id string, segment_id long")
