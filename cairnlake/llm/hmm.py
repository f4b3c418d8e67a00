"""Hidden Markov language model over words.

Corpus counts of all training words are added up on the cluster. An emission is P(symbol | state) * P(word | symbol):
the most frequent words are symbols of their own, all others share a bounded number of symbols by their last bytes, and
within a symbol words have their share of the corpus counts. Every word never met in training counts as one symbol, whose probability in any
state is that of a word met once (Good-Turing). So the model is a proper distribution over the training words and that
symbol, as the base is. Latent states start from the corpus counts, tilted by fixed random factors. Each Baum-Welch round
runs over the segments of all training texts, whatever their length and number; the expected counts of all tasks are
added up by (state, symbol), until a round gains less than `settled` in natural log-likelihood a token. The words with
symbols of their own grow as the square root of the number of distinct words, from `own_symbols` on. Scores come from
the scaled forward recursion over each whole text, in double precision.

If the distinct training words are more than `broadcast_words`, their counts are joined to blocks of documents instead.

Defined cases: a null text is an empty one, and its only token is the end. Without training rows the score is the base.
Rows that repeat are scored (and counted) each.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.shared import Numbered, WordHashes, bound_batches, cut, fold, tidy

END = xxhash.xxh3_64_intdigest(b"\n")  # no word holds white space
CLASSES = 512
ENCODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, word_score double, symbols binary"


def word_class(words: list[bytes]) -> np.ndarray:
    """Symbol class of each word: its last two bytes and whether it is long."""
    return np.fromiter(((w[-1] * 31 + (w[-2] if len(w) > 1 else 0) * 7 + (len(w) > 6) * 257) % CLASSES for w in words), np.int32, len(words))


def width(symbols: int) -> type:
    """The type in which sequences of that many symbols are written."""
    return np.uint16 if symbols <= 1 << 16 else np.uint32


#: Most distinct words that a task counts before it writes their counts.
COUNTED = 500_000


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    texts = 0

    def written() -> pa.RecordBatch:
        hashes = [xxhash.xxh3_64_intdigest(w) for w in seen] + [END]
        arrays = np.array(hashes, np.uint64).view(np.int64), np.append(word_class(list(seen)), CLASSES), np.array([*seen.values(), texts])
        return pa.RecordBatch.from_arrays([pa.array(arrays[0], pa.int64()), pa.array(arrays[1], pa.int32()), pa.array(arrays[2], pa.int64())], names=["hash", "class", "n"])

    for whole in batches:
        for raw in whole.column(0):
            seen.update((raw.as_py() or b"").lower().split())
            texts += 1
            if len(seen) >= COUNTED:
                yield written()
                seen.clear()
                texts = 0
    if texts:
        yield written()


class Vocabulary:
    """Counts and classes of words by sorted hash, and their symbols. top: hashes that are symbols of their own."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, classes: np.ndarray, top: np.ndarray, class_totals: np.ndarray, tokens: int, distinct: int):
        self.hashes, self.counts, self.classes, self.class_totals, self.tokens, self.distinct = hashes, counts, classes, class_totals, tokens, distinct
        self.order = np.argsort(top)
        self.top = top[self.order]
        self.unknown = len(top) + CLASSES + 1
        self.symbols = self.unknown + 1

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, symbol and log10 P(word | symbol)."""
        c, symbol, share = np.zeros(len(hashes), np.int64), np.full(len(hashes), self.unknown), np.zeros(len(hashes))
        if len(self.hashes):
            order = np.argsort(hashes)  # neighbours are then looked up near each other
            at = np.minimum(np.searchsorted(self.hashes, hashes[order]), len(self.hashes) - 1)
            met = (self.hashes[at] == hashes[order]) & (self.counts[at] > 0)
            at, to = at[met], order[met]
            c[to], classes = self.counts[at], self.classes[at]
            t = np.minimum(np.searchsorted(self.top, self.hashes[at]), max(0, len(self.top) - 1))
            own = self.top[t] == self.hashes[at] if len(self.top) else np.zeros(len(at), bool)
            symbol[to] = np.where(own, self.order[t] if len(self.top) else 0, len(self.top) + classes)
            share[to] = np.where(own, 0.0, np.log10(c[to] / np.maximum(self.class_totals[classes], 1)))
        return c, symbol, share


class Encoder:
    """Encodes texts by a vocabulary; what it says of the words met so far, up to about `limit`, is kept by their number.
    The end is number 0."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 500_000):
        self.vocabulary, self.limit = vocabulary, limit
        self.norm = math.log10(vocabulary.tokens + vocabulary.distinct + 1)
        self.reset()

    def reset(self) -> None:
        self.words = Numbered()
        self.words[None] = 0
        self.known, self.gain, self.symbol, self.share = (np.zeros(0, t) for t in (bool, float, width(self.vocabulary.symbols), float))
        self._add(np.array([END], np.uint64))

    def _add(self, hashes: np.ndarray) -> None:
        c, symbol, share = self.vocabulary.look(hashes)
        new = (c > 0, np.log10(c + 1.0), symbol.astype(self.symbol.dtype), share)
        self.known, self.gain, self.symbol, self.share = (np.concatenate(x) for x in zip((self.known, self.gain, self.symbol, self.share), new))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Tokens, known tokens, base score and word score of each text, and its symbols."""
        if len(self.words) > self.limit:
            self.reset()
        split = [[*t.lower().split(), None] for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        if not len(n):
            return n, n, np.zeros(0), np.zeros(0), []
        at = self.words.of(chain.from_iterable(split), int(n.sum()))
        new = self.words.taken()
        if new:
            self._add(np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new)))
        first = np.cumsum(n) - n
        total = lambda x: np.add.reduceat(x[at], first)
        symbols = [x.tobytes() for x in np.split(self.symbol[at], first[1:])]
        return n, np.add.reduceat(self.known[at], first, dtype=np.int64), total(self.gain) - n * self.norm, total(self.share), symbols


class Model:
    """start (K), move (K, K), emit (symbols, K): probabilities, each row or column of them adding up to 1."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, states: int, frequency: np.ndarray, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        emit = frequency[:, None] * rng.gamma(1.0, 1.0, (len(frequency), states)) + 1e-12
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    def expect(self, texts: list[np.ndarray], length: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions over the texts, cut into segments of `length`."""
        return self.expect_and_likelihood(texts, length)[:3]

    def expect_and_likelihood(self, texts: list[np.ndarray], length: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """expect(), and the natural log-likelihood of the segments."""
        k = len(self.start)
        starts, moves, emits, likelihood = np.zeros(k), np.zeros((k, k)), np.zeros_like(self.emit), 0.0
        if not texts:
            return starts, moves, emits, likelihood
        flat = np.concatenate(texts)
        whole = np.fromiter(map(len, texts), np.int64, len(texts))
        n = -(-whole // length)
        text = np.repeat(np.arange(len(texts)), n)
        past = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * length
        first, size = (np.cumsum(whole) - whole)[text] + past, np.minimum(length, whole[text] - past)
        order = np.argsort(-size, kind="stable")
        move, table = self.move.astype(np.float32), np.ascontiguousarray(self.emit.T, np.float32)
        # States come first in every array, so that each step works on whole rows of segments.
        for block in range(0, len(order), 2048):
            own = order[block : block + 2048]
            head, t = past[own] == 0, int(size[own[0]])
            grid = flat[np.minimum(first[own] + np.arange(t)[:, None], len(flat) - 1)]
            live = np.searchsorted(-size[own], -np.arange(t), side="left")
            e, alpha, gamma = table[:, grid], np.empty((t, k, len(own)), np.float32), np.zeros((k, t, len(own)), np.float32)
            a = np.where(head, self.start[:, None], 1 / k).astype(np.float32)
            for i, m in enumerate(live):
                a = (a if i == 0 else move.T @ a[:, :m]) * e[:, i, :m]
                total = np.maximum(a.sum(axis=0), 1e-37)
                likelihood += float(np.log(total).sum(dtype=np.float64))
                a /= total
                alpha[i, :, :m] = a
            beta = np.ones((k, live[-1]), np.float32)
            for i in range(t - 1, -1, -1):
                m = live[i]
                if i + 1 < t:
                    q = live[i + 1]
                    after = e[:, i + 1, :q] * beta
                    back = move @ after
                    scale = np.maximum((alpha[i, :, :q] * back).sum(axis=0), 1e-37)
                    moves += (alpha[i, :, :q] / scale) @ after.T
                    beta = np.ones((k, m), np.float32)
                    np.divide(back, scale, out=beta[:, :q])
                g = alpha[i, :, :m] * beta
                np.divide(g, np.maximum(g.sum(axis=0), 1e-37), out=gamma[:, i, :m])
            starts += gamma[:, 0, head].sum(axis=1)
            at = grid.ravel()
            for s in range(k):
                emits[:, s] += np.bincount(at, weights=gamma[s].ravel(), minlength=len(self.emit))
        return starts, moves * self.move, emits, likelihood

    def renewed(self, starts, moves, emits, unknown: float, prior: np.ndarray) -> Model:
        """Model from expected counts; the last symbol, for unknown words, has a fixed share in every state."""
        emit = emits[:-1] + prior[:-1, None] * 2.0
        emit = np.vstack([emit / emit.sum(axis=0) * (1 - unknown), np.full((1, emit.shape[1]), unknown)])
        move = moves + 1.0
        return Model((starts + 1) / (starts + 1).sum(), move / move.sum(axis=1, keepdims=True), emit)

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """Exact log10 likelihood of each whole sequence by the scaled forward recursion."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-sizes, kind="stable")
        flat, first = np.concatenate(texts), np.cumsum(sizes) - sizes
        first, left, total = first[order], sizes[order], np.zeros(len(texts))
        move, emit = np.ascontiguousarray(self.move.T), np.ascontiguousarray(self.emit.T)
        a, live = np.repeat(self.start[:, None], len(texts), axis=1), np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")
        for i, n in enumerate(live):
            a = (a if i == 0 else move @ a[:, :n]) * emit[:, flat[first[:n] + i]]
            s = a.sum(axis=0)
            a /= s
            total[:n] += np.log(s)
        out = np.empty(len(texts))
        out[order] = total / math.log(10)
        return out


def _encoded(base: DataFrame, counts: DataFrame, top, totals, tokens: int, distinct: int, broadcast_words: int, block_rows: int) -> DataFrame:
    names = [x.split()[0] for x in ENCODED.split(", ")]

    def rows(encoder: Encoder, batch) -> pa.RecordBatch:
        got = encoder.encode([raw.as_py() or b"" for raw in batch.column(2)])
        columns = [pa.array(c, t) for c, t in zip(got, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    if distinct <= broadcast_words:
        held = counts.select("hash", "n", "class").toArrow()  # at most broadcast_words rows of 20 bytes
        hashes = held["hash"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        sent = base.sparkSession.sparkContext.broadcast((hashes[order], held["n"].to_numpy()[order].astype(np.uint32 if tokens < 1 << 32 else np.int64), held["class"].to_numpy()[order].astype(np.int16)))

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = Encoder(Vocabulary(*sent.value, top, totals, tokens, distinct))
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    yield rows(encoder, whole.slice(at, 500))

        return base.mapInArrow(run, ENCODED)

    # Blocks of documents meet the counts of the words that they hold.
    blocks = base.count() // block_rows + 1
    dealt = base.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))

    @tidy
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            at, own = [], []
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = np.unique(hashes.of((raw.as_py() or b"").lower().split()))
                at.append(np.full(len(h), block))
                own.append(h)
            pair = np.unique(np.stack([np.concatenate(at), np.concatenate(own).view(np.int64)]), axis=1) if at else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0], pa.int64()), pa.array(pair[1], pa.int64())], names=["block", "hash"])

    pairs = dealt.select("block", "text").mapInArrow(asked, "block long, hash long").distinct().join(counts.select("hash", "n", "class"), "hash")
    end = np.array([END], np.uint64)

    def blockwise(words: pa.Table, docs: pa.Table) -> pa.Table:
        hashes, n, classes = words["hash"].to_numpy().view(np.uint64), words["n"].to_numpy(), words["class"].to_numpy()
        hashes, n, classes = np.append(hashes, end), np.append(n, end_count), np.append(classes, CLASSES)
        order = np.argsort(hashes)
        encoder = Encoder(Vocabulary(hashes[order], n[order], classes[order], top, totals, tokens, distinct))
        return pa.Table.from_batches([rows(encoder, b) for b in docs.select(["doc_id", "held_out", "text"]).to_batches()], schema=empty)

    found = counts.where(F.col("hash") == int(end.view(np.int64)[0])).select("n").collect()
    end_count = found[0]["n"] if found else 0
    empty = pa.schema([pa.field("doc_id", pa.int64()), pa.field("held_out", pa.bool_()), pa.field("n_tokens", pa.int64()), pa.field("n_known", pa.int64()), pa.field("base_score", pa.float64()), pa.field("word_score", pa.float64()), pa.field("symbols", pa.binary())])
    return pairs.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(blockwise, ENCODED)


def score_hmm(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 7, held_fold: int = 2, states: int = 8, own_symbols: int = 4096, rounds: int | None = None, settled: float = 1e-3, sample_rows: int = 0, sample_rounds: int = 0, broadcast_words: int = 8_000_000, block_rows: int = 2000, seed: int = 1) -> DataFrame:
    """One row for each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Every round counts
    all training texts; without a number of rounds they go on until they settle. A start from sample_rows training texts
    (chosen by a hash of their ids, sample_rounds rounds) has to be asked for."""
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold(id_col, folds, held_fold).alias("held_out"), F.col(text_col).cast("string").cast("binary").alias("text"))
    counts = base.where("not held_out").select("text").mapInArrow(_count, "hash long, class int, n long").groupBy("hash", "class").agg(F.sum("n").alias("n"))
    counts = cut(counts, "words")
    sums = counts.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1)).first()
    tokens, distinct, once = sums[0] or 0, sums[1], sums[2]
    own = max(own_symbols, 8 * math.isqrt(distinct))
    first = counts.orderBy(F.desc("n"), "hash").limit(own).collect()  # as many rows as symbols
    first = [r for r in first if r["class"] != CLASSES]
    top = np.array([r["hash"] for r in first], np.int64).view(np.uint64)
    totals = np.zeros(CLASSES + 1)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():  # a row for each class
        totals[r["class"]] = r["n"]
    for r in first:
        totals[r["class"]] -= r["n"]
    encoded = cut(_encoded(base, counts, top, totals, tokens, distinct, broadcast_words, block_rows), "encoded")
    out = ("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score")
    if not tokens:
        return encoded.select(*out, F.col("base_score").alias("score"))
    frequency = np.append(np.concatenate([[r["n"] for r in first], totals]).astype(float), 0.0)
    frequency /= frequency.sum()
    unknown = (once + 1) / (tokens + 2)
    learn = encoded.where("not held_out").select("doc_id", "symbols")
    kind = width(len(top) + CLASSES + 2)
    model = Model.first(states, frequency, seed)
    if sample_rows and sample_rounds:
        sample = learn.select("symbols", F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(sample_rows).collect()
        texts = [np.frombuffer(r["symbols"], kind) for r in sample]
        for _ in range(sample_rounds if texts else 0):
            model = model.renewed(*model.expect(texts), unknown, frequency * 200)

    def gather(model: Model):
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            starts, moves, emits, likelihood = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit), 0.0
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    got = model.expect_and_likelihood([np.frombuffer(raw.as_py(), kind) for raw in whole.slice(at, 1000).column(0)])
                    starts, moves, emits, likelihood = starts + got[0], moves + got[1], emits + got[2], likelihood + got[3]
            flat = np.concatenate([starts, moves.ravel(), emits.ravel(), [likelihood]])
            at = np.flatnonzero(np.abs(flat) > 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at], pa.float64())], names=["at", "v"])

        return run

    before = -math.inf
    for at in itertools.count():
        if at == rounds:
            break
        got = learn.select("symbols").mapInArrow(gather(model), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # at most a value for each parameter
        flat = np.zeros(states + states**2 + model.emit.size + 1)
        flat[got["at"].to_numpy()] = got["v"].to_numpy()
        model = model.renewed(flat[:states], flat[states : states + states**2].reshape(states, states), flat[states + states**2 : -1].reshape(model.emit.shape), unknown, frequency)
        if rounds is None and flat[-1] - before < settled * tokens:
            break
        before = flat[-1]

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.log10([np.frombuffer(raw.as_py(), kind) for raw in batch.column(7)]) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(np.asarray(got) + np.asarray(batch.column(6)), pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return encoded.select(*out, "word_score", "symbols").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
