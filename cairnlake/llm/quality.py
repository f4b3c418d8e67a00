"""Quality by a regularised quadratic discriminant over document statistics.

Every whole text becomes a row of transformed statistics (logarithms of lengths and ratios, square roots of shares). The
labelled rows of the training folds give counts, sums and second moments of each class, added up on the cluster; class
covariances are shrunk towards the pooled one and its diagonal. The score compares the classes' log densities, whose
Mahalanobis terms come from Cholesky factors made once, and is calibrated by a logistic curve over a histogram of the
training differences.

Defined cases: a null text is an empty one and is scored like any other. Labels other than 0 and 1, and of unknown
documents, are left out; of several labels of a document the largest counts. Without both classes all scores are the
share of label 1, or 0.5 without labels. Rows that repeat are scored each.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.shared import bound_batches, cut, fold, small, tidy

_SETS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "bang": b"!?", "bar": b"|<>{}[]\\/=_~", "mark": b"#$%&*@^+", "stop": b".,;:", "line": b"\n"}
_MASKS = np.zeros((len(_SETS) + 1, 256))
for _i, _s in enumerate(_SETS.values()):
    _MASKS[_i, list(_s)] = 1
_MASKS[-1, 128:] = 1
STATISTICS = ["words", "word_bytes", "upper", "digit", "bang", "bar", "mark", "stop", "lines", "other", "distinct", "top_word", "short", "longest", "entropy", "packed", "same_lines", "no_letter"]


def statistics(raw: bytes | None) -> list[float]:
    """Transformed statistics of one text, in the order of STATISTICS."""
    raw = raw or b""
    n, words = len(raw) + 1.0, raw.split()
    k = len(words) + 1.0
    seen = Counter(words)
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    upper, lower, digit, bang, bar, mark, stop, line, other = _MASKS @ bytes_
    p = bytes_[bytes_ > 0] / max(1, len(raw))
    rows = raw.split(b"\n")
    letters = upper + lower + other + 1.0
    return [
        math.log(k),
        math.log(n / k),
        math.sqrt(upper / letters),
        math.sqrt(digit / n),
        math.sqrt(bang / n),
        math.sqrt(bar / n),
        math.sqrt(mark / n),
        math.sqrt(stop / n),
        math.log((line + 1) / k),
        math.sqrt(other / n),
        math.log((len(seen) + 1) / k),
        math.sqrt(max(seen.values(), default=0) / k),
        math.sqrt(sum(c for w, c in seen.items() if len(w) <= 2) / k),
        math.log(1 + max(map(len, seen), default=0)),
        float(-(p * np.log(p)).sum()),
        math.log(len(zlib.compress(raw, 1)) / (n + 8)),
        math.sqrt(1 - len(set(rows)) / len(rows)),
        math.sqrt(max(0.0, 1 - letters / n)),
    ]


@tidy
def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            rows = [statistics(raw.as_py()) for raw in batch.column(1)]
            keys = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), pa.array(rows, pa.list_(pa.float64()))], names=[*keys, "x"])


@dataclass
class Discriminant:
    """Class means and Cholesky factors; `slope` and `shift` calibrate the log-density difference."""

    means: np.ndarray
    factors: list[np.ndarray]
    log_dets: list[float]
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, counts, sums, seconds, shrink: float = 0.1, ridge: float = 0.02) -> Discriminant:
        means = sums / counts[:, None]
        covs = [s / n - np.outer(m, m) for s, n, m in zip(seconds, counts, means)]
        pooled = sum(n * c for n, c in zip(counts, covs)) / counts.sum()
        out = []
        for c in covs:
            mixed = (1 - shrink) * c + shrink * pooled
            out.append(mixed + ridge * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(c)))
        factors = [np.linalg.cholesky(c) for c in out]
        return cls(means, factors, [2 * float(np.log(np.diag(f)).sum()) for f in factors])

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        dens = []
        for m, f, d in zip(self.means, self.factors, self.log_dets):
            z = np.linalg.solve(f, (x - m).T)
            dens.append(-0.5 * ((z * z).sum(axis=0) + d))
        return np.clip(dens[1] - dens[0], -200, 200)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -30, 30)))


def logistic(x: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through counted values, by Newton steps that are halved until they gain. Each
    class aims a little short of certainty, so that the curve is finite where the classes are apart."""
    n = ones + zeros
    up = ones * (ones.sum() + 1) / (ones.sum() + 2) + zeros / (zeros.sum() + 2)
    scale = max(1.0, float(np.abs(x).max()))
    u, at = x / scale, np.zeros(2)

    def loss(at: np.ndarray) -> float:
        z = at[0] * u + at[1]
        return float((n * np.logaddexp(0, z) - up * z).sum()) + 0.005 * at[0] ** 2

    now = loss(at)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(at[0] * u + at[1], -500, 500)))
        g = np.array([((up - n * p) * u).sum() - 0.01 * at[0], (up - n * p).sum()])
        w = n * p * (1 - p)
        h = np.array([[(w * u * u).sum() + 0.01, (w * u).sum()], [(w * u).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        while (then := loss(at + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if now - then < 1e-9:
            break
        at, now = at + step, then
    return at[0] / scale, at[1]


def training_labels(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    good = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    return good.groupBy("doc_id").agg(F.max("label").alias("label"))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, folds: int = 5, held_fold: int = 0, cut_off: float = 0.3, broadcast_rows: int = 2_000_000, row_col: str | None = None) -> DataFrame:
    """One row for each row: doc_id, held_out, score, predicted, and row_col (a number of the row) where it is named."""
    own = [row_col] if row_col else []
    kept = "".join(f", `{c}` long" for c in own)
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), *own)
    rows = cut(base.mapInArrow(_statistics, f"doc_id long{kept}, x array<double>"), "statistics").withColumn("held_out", fold("doc_id", folds, held_fold))
    known = small(cut(training_labels(labels, label_col), "labels"), broadcast_rows)
    train = rows.where("not held_out").join(known, "doc_id")
    d = len(STATISTICS)

    @tidy
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = np.asarray(batch.column(1))
            x = np.array(batch.column(0).flatten()).reshape(-1, d)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["label", "sums"])

    parts = train.select("x", "label").mapInArrow(moments, "label int, sums array<double>")
    got = parts.select("label", F.posexplode("sums").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v")).collect()  # 2 * (1 + d + d * d) rows
    total = np.zeros((2, 1 + d + d * d))
    for r in got:
        total[r["label"], r["at"]] = r["v"]
    counts = total[:, 0]
    if not counts.all():
        rate = float(counts[1] / counts.sum()) if counts.sum() else 0.5
        return rows.select("doc_id", "held_out", F.lit(rate).alias("score"), F.lit(int(rate >= cut_off)).alias("predicted"), *own)
    model = Discriminant.fit(counts, total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d))

    def scorer(how: str):
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.array(batch.column(1).flatten()).reshape(-1, d)
                rest = batch.schema.names[2:]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(getattr(model, how)(x), pa.float64()), *map(batch.column, rest)], names=["a", "score", *rest])

        return run

    bins = train.select("label", "x").mapInArrow(scorer("difference"), "a int, score double")
    bins = bins.groupBy(F.col("a").alias("label"), F.round(F.col("score") * 2).cast("int").alias("bin")).count().collect()  # at most 2 * 801 rows
    at = sorted({r["bin"] for r in bins})
    held = {(r["label"], r["bin"]): r["count"] for r in bins}
    per = [np.array([float(held.get((c, b), 0)) for b in at]) for c in (1, 0)]
    model.slope, model.shift = logistic(np.array(at) / 2.0, *per)
    out = rows.select("doc_id", "x", *own).mapInArrow(scorer("score"), f"a long, score double{kept}").withColumnRenamed("a", "doc_id")
    return out.select("doc_id", fold("doc_id", folds, held_fold).alias("held_out"), "score", (F.col("score") >= cut_off).cast("int").alias("predicted"), *own)
