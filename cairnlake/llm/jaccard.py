"""Self-join of documents by the Jaccard similarity of their word shingles, through parity sketches.

Every shingle flips one bit of a sketch, so that the Hamming distance of two sketches is at most the size of the symmetric
difference of the sets. Sets of a and b shingles with similarity s >= t differ in at most (a+b)(1-t)/(1+t) shingles. In
a band of sizes that bound is a number d; shingles dealt into d+1 blocks then agree with those of every partner in at
least one whole block, and so does the XOR of their hashes, which is the block's key. Documents near the edge of a band also have a sketch for pairs across the edge. Documents meet on
equal blocks, and pairs are verified on the whole sets.

Groups are not expanded into pairs. Equal sets are one class from the start. On each block the class with the smallest
id is verified against the others; only on blocks that still hold several components after that are the sketches of the
rest compared, in square tiles of bounded size, and what is within the Hamming bound is verified. Together that tests every linked
pair that is not already connected, so the components are exact (sets are compared by 64-bit shingle hashes, equal sets
by 128 bits).

Defined cases: a null, empty or white-space text has no shingles, links with nothing and is its own component. With
fewer words than the width, the whole sequence is one shingle. Rows that repeat an id are rows of the result each.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.components import components
from cairnlake.llm.shared import WordHashes, bound_batches, cut, forget, mix, small, tidy

ROWS = "doc_id long, n_shingles long, hi long, lo long, inner_tag int, inner array<long>, inner_bits array<long>, edge_tag int, edge array<long>, edge_bits array<long>"
TILE = ("block", "tag", "left", "right")
_U = np.uint64


class Bands:
    """Size bands and the number of blocks that each needs at `percent` similarity."""

    def __init__(self, percent: int):
        self.percent = percent
        self.ratio = max(1.5, 110 / percent)  # at least the largest ratio of linked sizes: links stay in a band or cross one edge

    def top(self, band: int) -> int:
        return math.floor(self.ratio**band)

    def band(self, n: int) -> int:
        """The band that holds sizes over top(band - 1), up to top(band)."""
        k = max(0, math.ceil(math.log(n, self.ratio)) - 2)
        while self.top(k) < n:
            k += 1
        return k

    def differ(self, total: int) -> int:
        """The most shingles by which two linked sets of `total` shingles together can differ."""
        return total * (100 - self.percent) // (100 + self.percent)

    def slack(self, d: int) -> int:
        """How many empty blocks a sketch may leave out: about as many as it is likely to have."""
        filled = (100 + self.percent) / (2 * (100 - self.percent)) / self.ratio
        return 0 if d < 3 else 1 + int(1.6 * math.exp(-filled) * d)

    def tags(self, n: int) -> list[tuple[int, int]]:
        """(tag, d) for the band of n, then for the edge that it is near to; even tags are bands, odd ones edges."""
        k, p = self.band(n), self.percent
        out = [(2 * k, self.differ(2 * self.top(k)))]
        for edge in (k - 1, k):
            low = self.top(edge)
            high = low * 100 // p  # the largest partner of a set of that size
            if high > low and (n <= high if edge < k else 100 * n >= p * (low + 1)):
                out.append((2 * edge + 1, self.differ(low + high)))
        return out


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a sequence of word hashes."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(n, width)
    got = np.zeros(n - size + 1, dtype=_U)
    for i in range(size):
        got = (got ^ hashes[i : n - size + 1 + i]) * _U(0x9E3779B97F4A7C15)
        got ^= got >> _U(29)
    return np.unique(mix(got + _U(size)))


def sketch(found: np.ndarray, tag: int, d: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, bits) of sorted shingle hashes: for each of d + 1 + slack blocks a key from the XOR of its shingles' hashes,
    and the parities of the shingles on its 16 bits, four blocks to a word. Empty blocks have no key if there are at most
    `slack`: of two linked sets, at least slack + 1 blocks agree, so that one with a key does."""
    blocks = d + 1 + slack
    at = ((found >> _U(32)) * _U(blocks) >> _U(32)).astype(np.int64)
    words = np.bincount(at * 16 + (found & _U(15)).astype(np.int64), minlength=64 * -(-blocks // 4)).astype(np.uint8)
    starts = np.append(0, np.flatnonzero(np.diff(at)) + 1)
    keys, places = np.bitwise_xor.reduceat(mix(found), starts), at[starts]
    if blocks - len(starts) > slack:
        empty = np.setdiff1d(np.arange(blocks), places)
        keys, places = np.append(keys, np.zeros(len(empty), _U)), np.append(places, empty)
    keys = mix(keys ^ mix((places + 1).astype(_U) + _U(tag << 40)))
    return keys.view("<i8"), np.packbits(words & 1, bitorder="little").view("<i8")


def _sketcher(width: int, percent: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bands = WordHashes(), Bands(percent)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch, rows = whole.slice(at, 1000), []
                for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                    found = shingles(words.of((raw.as_py() or b"").lower().split()), width)
                    if not len(found):
                        rows.append((doc_id, 0, 0, 0, [(None, None, None)] * 2))
                        continue
                    own = [(tag, *sketch(found, tag, d, bands.slack(d))) for tag, d in bands.tags(len(found))]
                    hi, lo = (int(np.bitwise_xor.reduce(mix(found * _U(k))).view(np.int64)) for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
                    # A set near both edges of a narrow band has both edge sketches in one row of tags.
                    rows += [(doc_id, len(found), hi, lo, [own[0] if i == 0 else (None, None, None), edge]) for i, edge in enumerate(own[1:] or [(None, None, None)])]
                columns = list(zip(*rows)) if rows else [[]] * 5
                both = list(zip(*columns[4])) if rows else [[], []]
                arrays = [pa.array(columns[i], pa.int64()) for i in range(4)]
                for own in both:
                    arrays += [pa.array([x[0] for x in own], pa.int32()), *(pa.array([x[i] for x in own], pa.list_(pa.int64())) for i in (1, 2))]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in ROWS.split(", ")])

    return run


def _sets(width: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [shingles(words.of((raw.as_py() or b"").lower().split()), width).view(np.int64) for raw in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "found"])

    return run


def _meet(rows: pa.Table, percent: int, words: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of rows that follow each other in one tile, are of different components and within the Hamming bound.

    Rows are compared at a distance of 1, of 2 and so on, all tiles with sketches of one width at once, and at most
    `words` words of sketches together."""
    own = rows["own"].combine_chunks()
    widths = own.value_lengths().to_numpy()
    starts, flat = own.offsets.to_numpy()[:-1], own.values.to_numpy().view(_U)
    key = np.stack([rows[c].to_numpy() for c in TILE], axis=1)
    tile = np.append(0, np.cumsum((key[1:] != key[:-1]).any(axis=1)))
    out = [np.empty((2, 0), np.int64)]
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)  # tiles have one tag, and so one width
        of, from_ = tile[at], starts[at]
        ids, n, comp, chunk = (rows[c].to_numpy()[at] for c in ("doc_id", "n_shingles", "component", "chunk"))
        square = (rows["left"].to_numpy() == rows["right"].to_numpy())[at]
        step, left = 0, np.arange(len(at))
        while True:
            step += 1
            left = left[left + step < len(at)]
            left = left[of[left] == of[left + step]]
            if not len(left):
                break
            right = left + step
            low, high = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
            ask = (comp[left] != comp[right]) & (square[left] | (chunk[left] != chunk[right])) & (100 * low >= percent * high)
            asked = left[ask]
            for k in range(0, len(asked), max(1, words // max(1, int(width)))):
                i = asked[k : k + max(1, words // max(1, int(width)))]
                j, places = i + step, np.arange(width)
                apart = np.bitwise_count(flat[from_[i][:, None] + places] ^ flat[from_[j][:, None] + places]).sum(axis=1, dtype=np.int64)
                close = apart <= (n[i] + n[j]) * (100 - percent) // (100 + percent)
                out.append(np.sort(np.stack([ids[i[close]], ids[j[close]]]), axis=0))
    both = np.unique(np.concatenate(out, axis=1), axis=1)
    return both[0], both[1]


def _tiles(percent: int):
    """The pairs of _meet for rows sorted by tile; a tile may go over several batches and is at most two chunks long."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                whole, kept = kept, None
            else:
                rows = pa.Table.from_batches([batch])
                rows = rows if kept is None else pa.concat_tables([kept, rows])
                if not rows.num_rows:
                    continue
                key = np.stack([rows[c].to_numpy() for c in TILE], axis=1)
                last = int(np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1)[-1])  # where the last tile starts
                whole, kept = rows.slice(0, last), rows.slice(last)
            if whole is not None and whole.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _meet(whole, percent)], names=["a", "b"])

    return run


def _with_keeper(pairs: DataFrame, of_a: DataFrame, on: list[str], broadcast_rows: int, rows: int = 4096) -> DataFrame:
    """pairs joined with what is known of a (and the columns `on`). The smallest member of a large group is the a of very
    many pairs: it is repeated once for each `rows` of them, so that no task gets them all."""
    hot = pairs.groupBy("a").agg((F.count("*") / rows).cast("int").alias("more")).where("more > 0")
    hot = small(cut(hot, "hot"), broadcast_rows)
    more = F.coalesce("more", F.lit(0))
    left = pairs.join(hot, "a", "left").withColumn("place", F.pmod(F.xxhash64("b"), more + 1).cast("int")).drop("more")
    right = of_a.join(hot, "a", "left").withColumn("place", F.explode(F.sequence(F.lit(0), more))).drop("more")
    return left.join(right, ["a", "place", *on])


def _near(pairs: DataFrame, sketched: DataFrame, percent: int, broadcast_rows: int) -> DataFrame:
    """The pairs whose sketches of the same tag are within the Hamming bound, as those of every linked pair are."""
    asked = small(cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "asked"), broadcast_rows)
    own = cut(sketched.drop("keys").join(asked, "doc_id", "left_semi"), "asked-sketches")
    of = lambda x: own.select(F.col("doc_id").alias(x), "tag", F.col("own").alias(f"own_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    joined = _with_keeper(pairs.join(of("b"), "b"), of("a"), ["tag"], broadcast_rows)
    apart = F.aggregate(F.zip_with("own_a", "own_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    low, high, both = F.least("n_a", "n_b"), F.greatest("n_a", "n_b"), F.col("n_a") + F.col("n_b")
    joined = joined.where(100 * low >= percent * high)
    return joined.where(apart * (100 + percent) <= both * (100 - percent)).select("a", "b").distinct()


def _linked(base: DataFrame, pairs: DataFrame, width: int, percent: int, broadcast_rows: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity; only texts of documents in a pair are read and moved."""
    asked = small(cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "asked"), broadcast_rows)
    texts = base.join(asked, "doc_id", "left_semi")
    sets = cut(texts.select("doc_id", F.col("text").cast("binary")).mapInArrow(_sets(width), "doc_id long, found array<long>"), "sets")
    left = sets.select(F.col("doc_id").alias("b"), F.col("found").alias("of_b"))
    right = sets.select(F.col("doc_id").alias("a"), F.col("found").alias("of_a"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    joined = _with_keeper(pairs.join(left, "b"), right, [], broadcast_rows)
    return joined.where(100 * both >= percent * (F.size("of_a") + F.size("of_b") - both)).select("a", "b").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80, tile: int = 2048, broadcast_rows: int = 2_000_000, block_rows: int = 1_000_000) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id (smallest id with an equal set), component_id."""
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(base.select("doc_id", F.col("text").cast("binary")).mapInArrow(_sketcher(width, percent), ROWS), "sketches")
    first = rows.where("inner_tag is not null or n_shingles = 0")
    classes = rows.where("n_shingles > 0 and inner_tag is not null").groupBy("n_shingles", "hi", "lo").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    classes = cut(classes, "classes")
    doubles = classes.where("copies > 1").drop("copies")
    member = first.select("doc_id", "n_shingles", "hi", "lo").join(small(doubles, broadcast_rows), ["n_shingles", "hi", "lo"], "left")
    member = cut(member.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id")), "member")

    # Blocks of one document for each class.
    alone = rows.where("n_shingles > 0").join(small(doubles, broadcast_rows), ["n_shingles", "hi", "lo"], "left").where("class_id is null or class_id = doc_id")
    tagged = [alone.where(f"{c}_tag is not null").select("doc_id", "n_shingles", F.col(f"{c}_tag").alias("tag"), F.col(c).alias("keys"), F.col(f"{c}_bits").alias("own")) for c in ("inner", "edge")]
    sketched = tagged[0].unionByName(tagged[1])
    blocks = sketched.select("doc_id", "tag", F.explode("keys").alias("block"))
    met = blocks.groupBy("block").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("rows"))
    met = cut(met.where("low <> high"), "met")

    # Two members are a pair as they are; more are read again, and meet the smallest.
    pairs = met.where("rows = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).distinct()
    many = cut(blocks.join(small(met.where("rows > 2").select("block", "low"), block_rows), "block"), "members")
    pairs = pairs.unionByName(many.where("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()).distinct()
    pairs = cut(pairs, "pairs")
    near = cut(_near(pairs, sketched, percent, broadcast_rows), "near")
    links = cut(_linked(base, near, width, percent, broadcast_rows), "linked")
    found = components(links)

    # Blocks that still hold several components.
    known = many.join(found, F.col("doc_id") == F.col("node"), "left").select("block", "tag", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    members = [F.bit_xor(F.xxhash64("doc_id", F.lit(k))).alias(f"m{k}") for k in (1, 2)]
    open_ = known.groupBy("block").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"), *members).where("x <> y")
    open_ = open_.groupBy("size", "m1", "m2").agg(F.min("block").alias("block")).select("block", "size")  # one of the blocks with the same members
    rest = cut(known.join(open_, "block"), "open")
    if not rest.isEmpty():
        own = sketched.drop("keys").join(small(cut(rest.select("doc_id").distinct(), "open-ids"), broadcast_rows), "doc_id", "left_semi")
        chunks = F.ceil(F.col("size") / tile).cast("int")
        rest = rest.join(own, ["doc_id", "tag"]).withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
        rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        rest = rest.withColumn("left", F.least("chunk", "other")).withColumn("right", F.greatest("chunk", "other"))
        tiles = rest.select(*TILE, "chunk", "doc_id", "n_shingles", "component", "own").repartition(*TILE).sortWithinPartitions(*TILE)
        more = tiles.mapInArrow(_tiles(percent), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti")
        more = cut(more, "more-pairs")
        if not more.isEmpty():
            found = components(links.unionByName(_linked(base, more, width, percent, broadcast_rows)))
    found = small(found.where("node <> component"), broadcast_rows)
    forget(rows, classes, met, many, pairs, near)  # the result depends on member and found alone
    out = member.join(found, member["class_id"] == found["node"], "left")
    return out.select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
