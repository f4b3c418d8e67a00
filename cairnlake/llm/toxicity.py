"""Toxicity by a bidirectional gated recurrent network with attention, written and trained in numpy.

A word enters as its own embedding (if frequent in the sample) beside the sum of the embeddings of its character
n-grams, so that unseen forms of a stem are read too. The first channel of both starts from the log odds of a word or
n-gram in the labelled sample; beside them stands the largest of the word's n-grams, as it is. A window's states of both directions are pooled by attention into one logit. All
overlapping windows of a whole text are scored, and the largest logit is the text's, in training as well: the gradient
goes through that window of each text.

The labelled sample is bounded: at most `sample_rows` rows of each class, in the order of a hash of their ids among the
training folds, and no more of them than the whole texts of which have `sample_bytes` together. A fifth of it is left out
of training: the network that does best on it is kept, and its scores are calibrated on it. Nothing else is bounded.

Defined cases: null and empty texts are one window of padding. Without both classes every score is 0. Rows that repeat
are scored each; of several labels of a document the largest counts.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.quality import logistic, training_labels
from cairnlake.llm.shared import Numbered, bound_batches, cut, fold, tidy

_F = np.float32
_SIZES = (3, 4, 5, 6)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def ngrams(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of the words, with ^ and $ around each, and where each word's begin."""
    flat = np.frombuffer(b"^" + b"$^".join(words) + b"$", np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat)) - first[owner]
    many = [np.maximum(sizes - n + 1, 0) for n in _SIZES]
    total = sum(many)
    starts = np.cumsum(total) - total
    out, base = np.empty(int(total.sum()), np.int64), starts.copy()
    h, done = np.zeros(len(flat), np.uint64), 0
    for k, n in enumerate(_SIZES):
        while done < n:
            m = max(0, len(flat) - done)
            h[:m] = h[:m] * np.uint64(1000003) + flat[done:] + np.uint64(1)
            done += 1
        ok = np.flatnonzero(place + n <= sizes[owner])
        x = (h[ok] ^ (h[ok] >> np.uint64(17))) * np.uint64(0x9E3779B97F4A7C15)
        out[base[owner[ok]] + place[ok]] = (x >> np.uint64(40)).astype(np.int64) % buckets + k * buckets
        base += many[k]
    return out, starts


def _sum_by(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values that have the same index."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(at):
        order = np.argsort(at, kind="stable")
        cuts = np.append(0, np.flatnonzero(np.diff(at[order])) + 1)
        out[at[order[cuts]]] = np.add.reduceat(values[order], cuts, axis=0)
    return out


class BiGru:
    """Parameters and passes of the network. Inputs of a window are rows of word tables; row 0 is padding."""

    def __init__(self, vocabulary: list[bytes], buckets: int = 1 << 15, width: int = 8, hidden: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = lambda *s, by: (rng.standard_normal(s) * by).astype(_F)
        self.index, self.buckets, self.width, self.hidden = {w: i + 1 for i, w in enumerate(vocabulary)}, buckets, width, hidden
        self.words, self.grams = n(len(vocabulary) + 1, width, by=0.1), n(len(_SIZES) * buckets, width, by=0.05)
        self.words[0] = 0
        self.odds = np.zeros(len(_SIZES) * buckets, _F)
        d = 2 * width + 1
        self.p = {"w": n(2, d, 3 * hidden, by=0.3), "b": np.zeros((2, 1, 3 * hidden), _F), "u": n(2, hidden, 3 * hidden, by=0.3), "v": n(2 * hidden, by=0.3), "o": n(2 * hidden, by=0.5), "c": np.zeros(1, _F)}

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """One row for each word, and what the gradient needs."""
        if not len(words):
            none = np.zeros(0, np.int64)
            return np.zeros((0, 2 * self.width + 1), _F), (none, none, none, np.zeros((0, 1), _F))
        own = np.fromiter(map(self.index.get, words, repeat(0)), np.int64, len(words))
        at, starts = ngrams(words, self.buckets)
        n = np.diff(np.append(starts, len(at)))
        by = (1 / np.sqrt(np.maximum(n, 1)))[:, None].astype(_F)
        chars = np.add.reduceat(self.grams[at], starts, axis=0) * by
        return np.concatenate([self.words[own], chars, np.maximum.reduceat(self.odds[at], starts)[:, None]], axis=1), (own, at, n, by)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Input parts of the gates of both directions, (2, rows, 3 * hidden)."""
        return (x @ self.p["w"] + self.p["b"]).astype(_F)

    def forward(self, gates: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows; at: (windows, time) rows of gates, 0 for padding."""
        h_, (b, t), turned = self.hidden, at.shape, np.ascontiguousarray(at.T)
        states, kept = np.empty((t, b, 2 * h_), _F), [[], []]
        for way in (0, 1):
            u, h, g = self.p["u"][way], np.zeros((b, h_), _F), gates[way]
            for i in range(t) if way == 0 else range(t - 1, -1, -1):
                x, hu = g.take(turned[i], axis=0), h @ u
                rz = _sigmoid(x[:, : 2 * h_] + hu[:, : 2 * h_])
                r, z, hn = rz[:, :h_], rz[:, h_:], hu[:, 2 * h_ :]
                n = np.tanh(x[:, 2 * h_ :] + r * hn)
                if keep:
                    kept[way].append((i, h, r, z, n, hn))
                h = n + z * (h - n)
                states[i, :, way * h_ : (way + 1) * h_] = h
        e = states @ self.p["v"]
        e[turned == 0] = -1e4
        e -= e.max(axis=0)
        a = np.exp(e)
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * states).sum(axis=0)
        logit = pooled @ self.p["o"] + self.p["c"]
        return (logit, (states, kept, a, pooled)) if keep else logit

    def backward(self, dlogit: np.ndarray, gates: np.ndarray, at: np.ndarray, saved) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters (but for w and b) and of the gates."""
        states, kept, a, pooled = saved
        h_, grad = self.hidden, {"o": pooled.T @ dlogit, "c": dlogit.sum(keepdims=True)}
        dp = dlogit[:, None] * self.p["o"]
        da = (states * dp).sum(axis=2)
        de = a * (da - (a * da).sum(axis=0))
        grad["v"] = (de[:, :, None] * states).sum(axis=(0, 1))
        ds = a[:, :, None] * dp + de[:, :, None] * self.p["v"]
        dgates, du = np.zeros_like(gates), np.zeros_like(self.p["u"])
        for way in (0, 1):
            u, dh, dx = self.p["u"][way], np.zeros((len(at), h_), _F), np.zeros((at.shape[1], len(at), 3 * h_), _F)
            for i, h, r, z, n, hn in reversed(kept[way]):
                dh = dh + ds[i, :, way * h_ : (way + 1) * h_]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                dhu = np.concatenate([dr, dz, dn * r], axis=1)
                dx[i] = np.concatenate([dr, dz, dn], axis=1)
                du[way] += h.T @ dhu
                dh = dh * z + dhu @ u.T
            dgates[way] = _sum_by(at.T.ravel(), dx.reshape(-1, 3 * h_), gates.shape[1])
        grad["u"] = du
        return grad, dgates


def windows(lengths: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of all windows: every `stride` words, and one that ends with the text; short texts have one."""
    n = np.maximum(1, -(-(lengths - size) // stride) + 1)
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, np.maximum(np.minimum(k * stride, lengths[text] - size), 0)


def _grid(flat: np.ndarray, first: np.ndarray, lengths: np.ndarray, text: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    at = start[:, None] + np.arange(size)
    return np.where(at < lengths[text, None], flat[np.minimum(first[text, None] + at, len(flat) - 1)], 0)


def log_loss(logit: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y == 1, -logit, logit)).mean())


def train(texts: list[bytes], y: np.ndarray, size: int, stride: int, epochs: int, patience: int = 2, seed: int = 3) -> tuple[BiGru, np.ndarray]:
    """The network, and the logits that the last fifth of the texts (left out of training) have by it, else nan.

    All windows of all texts are gone through anew in the first two epochs and in every third one; between these a text
    is trained by the window found last. After each such epoch the texts left out are scored: the best network so far is
    kept, and training ends when `patience` more of them have not improved on it, or after `epochs`."""
    rng = np.random.default_rng(seed)
    fit = np.arange(len(texts)) < max(2, len(texts) * 4 // 5)
    n1, n0 = max(1, int((y[fit] == 1).sum())), max(1, int((y[fit] == 0).sum()))
    # Words are numbered from 1, and only their numbers are kept; counts: texts of each class that a word or n-gram is in.
    table, parts, counts = Numbered(), [], np.zeros((2, 0))
    table[b""] = 0
    buckets = BiGru([]).buckets
    df = np.zeros((2, len(_SIZES) * buckets))
    for t, label, ok in zip(texts, y, fit):
        words = t.lower().split()
        own = table.of(words, len(words)).astype(np.int32)
        parts.append(own)
        if len(table) > counts.shape[1]:
            counts = np.concatenate([counts, np.zeros((2, len(table)))], axis=1)
        if ok and words:
            counts[label, np.unique(own)] += 1
            df[label, np.unique(ngrams(list(set(words)), buckets)[0])] += 1
    every = list(table)
    log_odds = lambda c: np.log((c[1] + 0.5) / (n1 + 1)) - np.log((c[0] + 0.5) / (n0 + 1))
    seen_in, odds = counts.sum(axis=0)[: len(every)], log_odds(counts)
    vocabulary = np.flatnonzero(seen_in >= 5)
    net = BiGru([every[i] for i in vocabulary])
    net.words[1:, 0] = odds[vocabulary] / 2
    gram = np.where(df.sum(axis=0) < 5, 0, log_odds(df) / 2)
    net.grams[:, 0] = net.odds[:] = gram
    net.p["w"][:, [0, net.width, 2 * net.width]] += 0.3
    lengths = np.array(list(map(len, parts)))
    flat = np.concatenate([*parts, np.zeros(1, np.int32)])
    first = np.cumsum(lengths) - lengths
    del table, parts, df, counts, odds, gram
    m, v = ({k: np.zeros_like(q) for k, q in net.p.items()} for _ in range(2))
    sq = {"words": np.zeros((len(net.words), 1), _F), "grams": np.zeros((len(net.grams), 1), _F)}
    step, held, out = 0, np.flatnonzero(~fit), np.full(len(texts), np.nan)
    chosen = np.zeros(len(texts), np.int64)  # where the window of each text starts
    best, waited = (np.inf, net), 0
    for epoch in range(epochs):
        anew = epoch < 2 or epoch % 3 == 0
        for own in np.array_split(rng.permutation(np.flatnonzero(fit)), max(1, fit.sum() // 32)):
            text, start = windows(lengths[own], size, stride) if anew else (np.arange(len(own)), chosen[own])
            grid = _grid(flat, first[own], lengths[own], text, start, size)
            used, local = np.unique(np.append(grid, 0), return_inverse=True)
            grid = local[:-1].reshape(grid.shape)
            x, back = net.inputs([every[i] for i in used])
            x[0] = 0
            gates = net.gates(x)
            if anew:
                logit = net.forward(gates, grid)
                order = np.lexsort((logit, text))
                top = order[np.append(np.flatnonzero(np.diff(text[order])), len(order) - 1)]  # each text's largest
                grid, chosen[own] = grid[top], start[top]
            logit, saved = net.forward(gates, grid, keep=True)
            d = ((_sigmoid(logit) - y[own]) / len(own)).astype(_F)
            grad, dg = net.backward(d, gates, grid, saved)
            grad["w"], grad["b"] = x.T @ dg, dg.sum(axis=1, keepdims=True)
            dx = (dg @ net.p["w"].transpose(0, 2, 1)).sum(axis=0)
            dx[0] = 0
            step += 1
            for k, g in grad.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                net.p[k] -= (0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(_F)
            ids, at, n, by = back
            for name, rows, g in (("words", ids, dx[:, : net.width]), ("grams", at, np.repeat(dx[:, net.width : 2 * net.width] * by, n, axis=0))):
                touched, where = np.unique(rows, return_inverse=True)
                total = _sum_by(where, g, len(touched))
                sq[name][touched] += (total * total).mean(axis=1, keepdims=True)
                getattr(net, name)[touched] -= 0.03 * total / (np.sqrt(sq[name][touched]) + 1e-6)
            net.words[0] = 0
        if anew and len(held):
            logit = Scorer(net, size, stride).logits([texts[i] for i in held])
            loss = log_loss(logit, y[held])
            if loss < best[0]:
                best, out[held], waited = (loss, copy.deepcopy(net)), logit, 0
            else:
                waited += 1
                if waited > patience:
                    break
    return best[1], out


class _Rows(dict):
    """Row of each word; new words are numbered as they come."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = n = len(self) + 1
        return n


class Scorer:
    """Scores texts; the gate inputs of up to `limit` distinct words are kept."""

    def __init__(self, net: BiGru, size: int, stride: int, limit: int = 350_000, block: int = 4096):
        self.net, self.size, self.stride, self.limit, self.block = net, size, stride, limit, block
        self.reset()

    def reset(self) -> None:
        self.rows = _Rows()
        self.room = np.zeros((2, 1, 3 * self.net.hidden), _F) + self.net.p["b"]
        self.done = 1

    def _learn(self) -> None:
        new, n = self.rows.new, self.done
        if n + len(new) > self.room.shape[1]:
            self.room = np.concatenate([self.room[:, :n], np.empty((2, len(new) + n // 2, self.room.shape[2]), _F)], axis=1)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.room[:, n : n + len(part)] = self.net.gates(self.net.inputs(part)[0])
            n += len(part)
        self.rows.new, self.done = [], n

    def logits(self, texts: list[bytes]) -> np.ndarray:
        split = [t.lower().split() for t in texts]
        if len(self.rows) > self.limit:
            self.reset()
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(split)), np.int32, int(lengths.sum()))
        self._learn()
        flat = flat if len(flat) else np.zeros(1, np.int32)
        first = np.cumsum(lengths) - lengths
        text, start = windows(lengths, self.size, self.stride)
        out = np.full(len(texts), -np.inf)
        for at in range(0, len(text), self.block):
            own = slice(at, at + self.block)
            grid = _grid(flat, first, lengths, text[own], start[own], self.size)
            np.maximum.at(out, text[own], self.net.forward(self.room, grid))
        return out


_SCORERS: dict[str, Scorer] = {}


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, folds: int = 3, held_fold: int = 1, cut_off: float = 0.7, size: int = 32, stride: int = 16, epochs: int = 24, sample_rows: int = 4000, sample_bytes: int = 8 << 20) -> DataFrame:
    """One row for each row: doc_id, held_out, score, predicted."""
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    known = training_labels(labels, label_col).where(~fold("doc_id", folds, held_fold))
    # Of rows that share an id, the largest text stands for it.
    sizes = base.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("bytes"))
    sized = sizes.join(known, "doc_id").groupBy("doc_id", "label").agg(F.max("bytes").alias("bytes"))
    sized = cut(sized.withColumn("h", F.xxhash64("doc_id")), "labels")
    counts = {r["label"]: r["count"] for r in sized.groupBy("label").count().collect()}  # two rows
    held = fold("doc_id", folds, held_fold).alias("held_out")
    if len(counts) < 2:
        return base.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    got = [sized.where(F.col("label") == c).orderBy("h", "doc_id").limit(sample_rows).collect() for c in (0, 1)]  # at most sample_rows rows without texts
    picked = [r for part in got for r, total in zip(part, np.cumsum([r["bytes"] for r in part])) if total <= sample_bytes or r is part[0]]
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["label"], r["h"]) for r in picked], "doc_id long, label int, h long")
    sample = base.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "h").agg(F.max_by("text", F.length("text")).alias("text"))
    got = sorted(sample.collect(), key=lambda r: (r["h"], r["doc_id"]))  # at most sample_rows texts of sample_bytes for each class
    # Both classes are dealt evenly, whatever part of its rows each has in the sample.
    order = sorted((((k + 0.5) / len(part), c, r) for c in (0, 1) for part in [[r for r in got if r["label"] == c]] for k, r in enumerate(part)), key=lambda x: x[:2])
    order = [r for _, _, r in order]
    y = np.array([r["label"] for r in order])
    net, logit = train([bytes(r["text"] or b"") for r in order], y, size, stride, epochs)
    left = ~np.isnan(logit)
    slope, shift = 1.0, 0.0
    if left.any() and len(set(y[left])) == 2:
        weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())[left] * len(y) / sum(counts.values())
        slope, shift = logistic(logit[left], weight * (y[left] == 1), weight * (y[left] == 0))
    key = uuid.uuid4().hex

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(net, size, stride)
        for whole in batches:
            for at in range(0, whole.num_rows, 400):
                batch = whole.slice(at, 400)
                got = _SCORERS[key].logits([raw.as_py() or b"" for raw in batch.column(1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(np.clip(slope * got + shift, -30, 30)), pa.float64())], names=["doc_id", "score"])

    out = base.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held, "score", (F.col("score") >= cut_off).cast("int").alias("predicted"))
