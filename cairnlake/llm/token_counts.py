"""Token counts by the best unigram segmentation, computed once for each shared prefix of the distinct pre-tokens.

A pre-token is a word with the word mark in front. A piece scores the logarithm of its probability: the vocabulary file
has its pieces in the order in which they were found, and by Zipf's law the probability of the piece of rank r is
in proportion to 1 / (r + 2.7). Nothing is trained. A character that no piece covers counts as its UTF-8 bytes. The new distinct pre-tokens of a batch are inserted in a trie by sorting: going
through them in order is a walk of the trie, and the stack of forward scores (best score and its number of pieces up to
each character) is popped back to the prefix shared with the previous word. Of equal scores the segmentation with fewer
pieces is taken. Terminal counts are stored with the words, and a document's count is the sum over its words.

Defined cases: null, empty and white-space texts have no tokens. Rows that repeat are counted each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.shared import bound_batches, tidy

MARK = "▁"
#: Fixed value: the usual offset of ranks in Zipf's law.
OFFSET = 2.7
ROWS = "doc_id long, n_words long, n_tokens long"


class Unigram:
    """Vocabulary of pieces with scores, and the counts of the words met so far (at most about `limit`)."""

    def __init__(self, scores: dict[str, float], limit: int = 400_000):
        self.scores, self.limit = scores, limit
        self.longest = max(map(len, scores), default=1)
        self.by_end: dict[str, set[int]] = {}
        for piece in scores:
            self.by_end.setdefault(piece[-2:], set()).add(len(piece))
        self.lengths = {k: sorted(v) for k, v in self.by_end.items()}
        self.byte_score = min(scores.values(), default=0.0) - 10.0
        self.counts: dict[str, int] = {}

    @classmethod
    def load(cls, path: str, limit: int = 400_000) -> Unigram:
        """Pieces of a sentencepiece file; control and byte pieces are not matched in text."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        ids.sort(key=lambda i: (-model.get_score(i), i))
        total = math.log(sum(1 / (r + OFFSET) for r in range(1, len(ids) + 1)))
        return cls({model.id_to_piece(i): -math.log(r + OFFSET) - total for r, i in enumerate(ids, 1)}, limit)

    def learn(self, words: list[str]) -> None:
        """Walks the trie of the words and stores a count for each."""
        scores, lengths, byte_score, none = self.scores, self.lengths, self.byte_score, []
        best, many, before = [0.0], [0], MARK[:0]
        for word in sorted(words):
            text = MARK + word
            shared, most = 0, min(len(text), len(before))
            while shared < most and text[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], many[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                size = len(text[end - 1].encode("utf-8", "surrogatepass"))
                top, n = best[end - 1] + size * byte_score, many[end - 1] + size
                last = text[max(0, end - 2) : end]
                for length in lengths.get(last, none) if end > 1 else none:
                    if length > end:
                        break
                    s = scores.get(text[end - length : end])
                    if s is not None and ((s := s + best[end - length]) > top or s == top and many[end - length] + 1 < n):
                        top, n = s, many[end - length] + 1
                s = scores.get(text[end - 1])
                if s is not None and ((s := s + best[end - 1]) > top or s == top and many[end - 1] + 1 < n):
                    top, n = s, many[end - 1] + 1
                best.append(top)
                many.append(n)
            self.counts[word] = many[-1]
            before = text

    def count(self, texts: list[list[str]]) -> list[int]:
        if len(self.counts) > self.limit:
            self.counts = {}
        new = {w for words in texts for w in words if w not in self.counts}
        self.learn(list(new))
        get = self.counts.__getitem__
        return [sum(map(get, words)) for words in texts]


_MODELS: dict[str, Unigram] = {}


def _counter(path: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _MODELS:
            _MODELS[path] = Unigram.load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                texts = [[w.decode("utf-8", "replace") for w in (raw.as_py() or b"").split()] for raw in batch.column(1)]
                counts = [pa.array(x, pa.int64()) for x in (list(map(len, texts)), _MODELS[path].count(texts))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *counts], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_words, n_tokens."""
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return base.mapInArrow(_counter(vocabulary_path), ROWS)
