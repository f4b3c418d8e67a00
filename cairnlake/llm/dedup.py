"""Exact deduplication through a log-structured merge index.

Each task fills a memtable (digest -> bytes of the first row, smallest row, count). A full memtable is flushed as a
run sorted by digest; equal digests within it have already been compared byte by byte. A run holds one row per distinct
text, so that a text making up a third of the corpus sends one row per run to its shard of the index. Each shard merges
its runs: keys that the other run's filter excludes pass through, the others are matched by binary search, and the
smallest id stays. A text that hit in more than one run is then compared byte by byte with the text that stays; texts
whose digests collide without being equal are regrouped by their bytes.

Defined cases: a null text is an empty one. Texts that differ only in the length or kind of white-space runs are equal.
Of rows with the same id and text, one is kept. A null id sorts after all others. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.shared import SPACE, bound_batches, cut, small, tidy

NO_ID = np.iinfo(np.int64).max
ENTRIES = "doc_id long, entry long, rep_entry long, rep_id long, run_count long, run long, key binary, sha binary"


def normalise(raw: bytes | None) -> bytes:
    """Each run of the bytes 0x20 and 0x09-0x0D becomes one space."""
    if not raw:
        return b""
    words = raw.split()
    if not words:
        return b" "
    white = b" \t\n\r\x0b\x0c"
    return b" " * (raw[0] in white) + b" ".join(words) + b" " * (raw[-1] in white)


class Filter:
    """Bloom filter over digests, with `per_key` bits a key; the digests are already random."""

    def __init__(self, keys: np.ndarray, per_key: int = 10, hashes: int = 5):
        self.hashes = hashes
        self.bits = np.zeros(max(64, len(keys) * per_key), dtype=bool)
        for at in self._places(keys):
            self.bits[at] = True

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        raw = np.zeros((len(keys), 16), dtype=np.uint8)
        flat = np.frombuffer(keys.tobytes(), dtype=np.uint8).reshape(len(keys), -1)[:, :16] if len(keys) else raw
        raw[:, : flat.shape[1]] = flat
        a, b = raw.view("<u8").T
        for i in range(self.hashes):
            yield ((a + np.uint64(i) * (b | np.uint64(1))) % np.uint64(len(self.bits))).astype(np.int64)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        held = np.ones(len(keys), dtype=bool)
        for at in self._places(keys):
            held &= self.bits[at]
        return held


class Run:
    """Distinct sorted keys with the (id, entry) that stays, the number of rows and of flushed rows behind each."""

    def __init__(self, keys, ids, entries, counts, parts):
        self.keys, self.ids, self.entries, self.counts, self.parts = keys, ids, entries, counts, parts
        self.filter = Filter(keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1; only what the filter lets through is searched."""
        out = np.full(len(keys), -1, dtype=np.int64)
        ask = np.flatnonzero(self.filter.may_hold(keys))
        if len(ask) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys[ask]), len(self.keys) - 1)
            hit = self.keys[at] == keys[ask]
            out[ask[hit]] = at[hit]
        return out


def merge(a: Run, b: Run) -> Run:
    """One run from two; of equal keys the smaller (id, entry) stays."""
    if len(a.keys) < len(b.keys):
        a, b = b, a
    at = a.find(b.keys)
    old, new = at[at >= 0], np.flatnonzero(at >= 0)
    ids, entries, counts, parts = (x.copy() for x in (a.ids, a.entries, a.counts, a.parts))
    less = (b.ids[new] < ids[old]) | ((b.ids[new] == ids[old]) & (b.entries[new] < entries[old]))
    ids[old[less]], entries[old[less]] = b.ids[new[less]], b.entries[new[less]]
    counts[old] += b.counts[new]
    parts[old] += b.parts[new]
    only = at < 0
    keys = np.concatenate([a.keys, b.keys[only]])
    order = np.argsort(keys, kind="stable")
    whole = (np.concatenate([x, y[only]])[order] for x, y in ((ids, b.ids), (entries, b.entries), (counts, b.counts), (parts, b.parts)))
    return Run(keys[order], *whole)


def tiered(runs: list[Run]) -> Run:
    """One run from many short ones, by one sort; of equal keys the smallest (id, entry) stays."""
    keys, ids, entries, counts, parts = (np.concatenate(x) for x in zip(*((r.keys, r.ids, r.entries, r.counts, r.parts) for r in runs)))
    order = np.lexsort((entries, ids, keys))
    first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    top = order[first]
    return Run(keys[top], ids[top], entries[top], np.add.reduceat(counts[order], first), np.add.reduceat(parts[order], first))


def compact(runs: list[Run], short: int = 1024) -> Run:
    """Runs of fewer than `short` keys, which a shard of a large table gets in great number, are merged at once; then runs
    of similar size first, so that each key is rewritten about log2(runs) times."""
    few = [r for r in runs if len(r.keys) < short]
    runs = [r for r in runs if len(r.keys) >= short] + [tiered(few[i : i + 256]) for i in range(0, len(few), 256)]
    runs = sorted(runs, key=lambda r: len(r.keys))
    while len(runs) > 1:
        runs = [merge(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


class Memtable:
    """Rows of one run before its flush. Texts are held, so that equal digests are compared by bytes at once."""

    def __init__(self, rows: int, size: int, key_bytes: int):
        self.rows, self.size, self.key_bytes = rows, size, key_bytes
        self.reset()

    def reset(self) -> None:
        self.held, self.reps, self.entries, self.used = {}, [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        sha = hashlib.sha256(text).digest()
        variants = self.held.setdefault(sha[: self.key_bytes], [])
        here = len(self.entries)
        for rep in variants:
            if self.reps[rep][0] == text:
                break
        else:
            rep = len(self.reps)
            variants.append(rep)
            self.reps.append([text, sha, NO_ID, here, 0])
            self.used += len(text)
        known = self.reps[rep]
        if doc_id is not None and doc_id < known[2]:
            known[2], known[3] = doc_id, here
        known[4] += 1
        self.entries.append((doc_id, rep))

    def full(self) -> bool:
        return len(self.entries) >= self.rows or self.used >= self.size

    def flush(self, first: int, run: int) -> pa.RecordBatch:
        """All rows sorted by digest; a row whose entry equals rep_entry stands for its text in the index."""
        order = sorted(range(len(self.entries)), key=lambda i: self.reps[self.entries[i][1]][1])
        reps = [self.reps[self.entries[i][1]] for i in order]
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([self.entries[i][0] for i in order], pa.int64()),
                pa.array([first + i for i in order], pa.int64()),
                pa.array([first + r[3] for r in reps], pa.int64()),
                pa.array([r[2] for r in reps], pa.int64()),
                pa.array([r[4] for r in reps], pa.int64()),
                pa.array([run] * len(order), pa.int64()),
                pa.array([r[1][: self.key_bytes] for r in reps], pa.binary()),
                pa.array([r[1] for r in reps], pa.binary()),
            ],
            names=[x.split()[0] for x in ENTRIES.split(", ")],
        )
        self.reset()
        return out


def _flusher(rows: int, size: int, key_bytes: int):
    @tidy
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = Memtable(rows, size, key_bytes), TaskContext.get().partitionId()
        first, run = part << 36, part << 24
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                table.add(doc_id, normalise(raw.as_py()))
                if table.full():
                    n = len(table.entries)
                    yield table.flush(first, run)
                    first, run = first + n, run + 1
        if table.entries:
            yield table.flush(first, run)

    return runs


def _shard(width: int):
    def merged(rows: pa.Table) -> pa.Table:
        """One shard of the index: its flushed runs are compacted, then every flushed row looks up what stays."""
        keys = np.frombuffer(b"".join(rows["key"].to_pylist()), dtype=f"S{width}") if width else np.zeros(rows.num_rows, "S1")
        keys = np.array(keys)
        run, ids, entry, count = (np.asarray(rows[c]) for c in ("run", "rep_id", "entry", "run_count"))
        made = []
        order = np.lexsort((entry, ids, keys, run))
        for own in np.split(order, np.flatnonzero(np.diff(run[order])) + 1):
            k, start = np.unique(keys[own], return_index=True)
            totals = np.add.reduceat(count[own], start)
            sizes = np.diff(np.append(start, len(own)))
            made.append(Run(k, ids[own][start], entry[own][start], totals, sizes))
        whole = compact(made)
        at = whole.find(keys)
        return pa.table({"entry": entry, "rep_id": ids, "sha": rows["sha"], "run_count": count, "keep_entry": whole.entries[at], "keep_id": whole.ids[at], "group_size": whole.counts[at], "parts": whole.parts[at]})

    return merged


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, memtable_rows: int = 50_000, memtable_bytes: int = 48 << 20, key_bytes: int = 32, shard_rows: int = 200_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. key_bytes shortens the index's digests
    (collisions are then settled by the bytes)."""
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    entries = cut(base.select("doc_id", F.col("text").cast("binary")).mapInArrow(_flusher(memtable_rows, memtable_bytes, key_bytes), ENTRIES), "runs")
    reps = entries.where("entry = rep_entry")
    shards = max(1, reps.count() // shard_rows + 1)
    rows = reps.select("entry", "rep_id", "run_count", "run", "key", "sha", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    schema = "entry long, rep_id long, sha binary, run_count long, keep_entry long, keep_id long, group_size long, parts long"
    hits = cut(rows.groupBy("shard").applyInArrow(_shard(key_bytes), schema).where("parts > 1"), "hits")
    verified = _verified(base, hits, broadcast_rows)
    found = small(verified.select(F.col("entry").alias("rep_entry"), "keep_entry", "keep_id", "group_size"), broadcast_rows)
    out = entries.select("doc_id", "entry", "rep_entry", "rep_id", "run_count", "sha").join(found, "rep_entry", "left")
    keep = F.coalesce("keep_id", "rep_id")
    return out.select(
        "doc_id",
        F.when(keep != NO_ID, keep).alias("keep_id"),
        F.coalesce("group_size", "run_count").alias("group_size"),
        (F.col("entry") == F.coalesce("keep_entry", "rep_entry")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _verified(base: DataFrame, hits: DataFrame, broadcast_rows: int) -> DataFrame:
    """hits whose bytes equal those of the row that stays, and the others regrouped by their bytes."""
    ids = small(hits.select("entry", "rep_id", "sha"), broadcast_rows)
    text = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ")
    texts = base.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("rep_id"), "text").join(ids, "rep_id").withColumn("text", text)
    texts = texts.where(F.unhex(F.sha2(F.col("text").cast("binary"), 256)) == F.col("sha")).groupBy("entry").agg(F.first("text").alias("text"))
    rows = hits.join(texts, "entry")
    # The text that stays goes to as many places as it has rows to meet, at most 64 in each.
    places = (F.col("parts") / 64).cast("long")
    keeper = rows.where("entry = keep_entry").select("keep_entry", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0).cast("long"), places)).alias("place"))
    compared = rows.withColumn("place", F.pmod(F.xxhash64("entry"), places + 1)).join(keeper, ["keep_entry", "place"])
    compared = cut(compared.select("entry", "rep_id", "sha", "run_count", "keep_entry", "keep_id", "group_size", (F.col("text") == F.col("kept_text")).alias("same")), "compared")
    if compared.where("not same").isEmpty():
        return compared
    # Digests that collide: rows that differ from the one that stays are grouped by their whole texts.
    apart = compared.where("not same").select("entry", "rep_id", "run_count").join(texts, "entry")
    first = apart.groupBy("text").agg(F.min(F.struct("rep_id", "entry")).alias("top"), F.sum("run_count").alias("group_size"))
    split = apart.join(first, "text").select("entry", F.col("top.entry").alias("keep_entry"), F.col("top.rep_id").alias("keep_id"), "group_size")
    together = compared.where("same")
    sizes = together.groupBy("keep_entry").agg(F.sum("run_count").alias("group_size"))
    return together.drop("group_size").join(sizes, "keep_entry").select("entry", "keep_entry", "keep_id", "group_size").unionByName(split)
