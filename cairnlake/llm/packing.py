"""Packing of token sequences by minimum bin slack.

Documents are tokenised and longer ones are cut at the capacity. What remains are lengths; a window starts with the
longest and is filled from a bitset of reachable sums: one shift and one disjunction for each power of two of copies of a
length, stopping when the capacity itself is reached. The bitsets are walked back into counts of each length. The pool
of open pieces of a task is bounded, windows leave it as soon as it is full, and the tasks share nothing, so nothing is
shuffled and a lost task is run again alone. Where the least slack is still above a thousandth of a window, the longest
piece that stays open is cut to fill it. What no longer fills a window at the end of a task is cut into windows whose
lengths are powers of two, which need no padding.

Defined cases: a null text is an empty one, whose only token is the end. Every row is packed, also one that repeats another.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.shared import Numbered, bound_batches, release, tidy

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: The combining marks U+0300 to U+036F in UTF-8, the only ones that join with A-Z.
_MARKS = re.compile(rb"\xcc[\x80-\xbf]|\xcd[\x80-\xaf]")
_LETTERS = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: Words whose parts are told apart here: visible ASCII without capitals, and Latin letters that normalisation leaves alone.
_PLAIN = re.compile(f"[!-@\\[-~{_LETTERS}]+")
#: Fixed value: the tokenizer's own rule for parts of a word, over those characters.
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9\n]+|\n")


class Runs:
    """Runs of ids by number, one behind the other."""

    def __init__(self):
        self.flat, self.sizes, self.starts = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n = self.used = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(sizes) > len(self.sizes):
            self.sizes, self.starts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.starts))
        self.flat[self.used : self.used + len(ids)] = ids
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.starts[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = self.n + len(sizes), self.used + len(ids)

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs `at`, joined, and where each of them ends."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        index = np.repeat((self.starts[at] - ends + sizes).astype(np.int32), sizes)
        index += np.arange(len(index), dtype=np.int32)
        return self.flat[index], ends


class WordTokens:
    """Ids of UTF-8 texts by a lower-casing BPE tokenizer with word ends whose normaliser and pre-tokeniser never look
    across white space. Distinct words are encoded once and kept, up to `limit` of them, and so are the distinct parts
    of plain words; other words go through the whole tokenizer."""

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for token, i in vocabulary.items() if token.endswith(self.tokenizer.model.end_of_word_suffix)]] = True
        self.reset()

    def reset(self) -> None:
        self.words, self.parts, self.word_runs, self.part_runs = Numbered(), Numbered(), Runs(), Runs()
        self.words[None] = 0  # the end of a text, whose only id is set at each call
        self.word_runs.add(np.zeros(1, np.uint32), np.ones(1, np.int64))

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = np.fromiter((_PLAIN.fullmatch(x) is not None and "<|" not in x for x in texts), bool, len(texts))
        parts = _PARTS.findall("\n".join(x for x, ok in zip(texts, plain) if ok).lower())
        at = self.parts.of(parts, len(parts))
        new = self.parts.taken()
        for k in range(0, len(new), 5000):
            some = new[k : k + 5000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            sizes = np.diff(np.flatnonzero(self.final[ids]), prepend=-1)
            if "\n" in some:
                sizes = np.insert(sizes, some.index("\n"), 0)
            if len(sizes) != len(some):
                raise ValueError("the vocabulary lacks word ends")
            self.part_runs.add(ids, sizes)
        ids, ends = self.part_runs.of(at)
        last = ends[np.append(at[1:] == self.parts.get("\n"), True)] if len(parts) else ends  # of the last part of each word
        sizes = np.zeros(len(words), np.int64)
        sizes[plain] = np.diff(last, prepend=0)
        rest = [x.ids for x in self.tokenizer.encode_batch_fast([x for x, ok in zip(texts, plain) if not ok], add_special_tokens=False)]
        sizes[~plain] = list(map(len, rest))
        both = np.empty(int(sizes.sum()), np.uint32)
        own = np.repeat(plain, sizes)
        both[own], both[~own] = ids, [i for x in rest for i in x]
        self.word_runs.add(both, sizes)

    def _words(self, raw: bytes) -> list[bytes | None]:
        """Words between ASCII white space, then None; other white space stays within them, for the tokenizer to treat.
        A-Z become a-z where that changes no id: marks after a capital can make another letter than after a small one."""
        low = raw.lower()
        odd = low != raw and (not raw.isascii() and _MARKS.search(raw) or any(x in low for x in self.special))
        words: list[bytes | None] = (raw if odd else low).split()
        words.append(None)
        return words

    def encode(self, raws: list[bytes], end: int) -> list[np.ndarray]:
        """Ids of each text, then the end."""
        if len(self.words) > self.limit:
            self.reset()
        split = list(map(self._words, raws))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = self.words.of(chain.from_iterable(split), int(counts.sum()))
        self._learn(self.words.taken())
        self.word_runs.flat[0] = end
        ids, ends = self.word_runs.of(at)
        return np.split(ids, ends[np.cumsum(counts)[:-1] - 1]) if len(split) else []


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of each length, at most those given, whose total is the largest that is possible up to `capacity`."""
    reach, seen, full = 1, [], 1 << capacity
    keep = (full << 1) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= capacity), reverse=True):
        left, many = min(counts[length], capacity // length), 1
        while left:
            many = min(many, left)
            seen.append((length, many, reach))
            reach |= (reach << (length * many)) & keep
            left, many = left - many, many * 2
            if reach & full:
                break
        if reach & full:
            break
    at, used = reach.bit_length() - 1, defaultdict(int)
    for length, many, before in reversed(seen):
        if not before >> at & 1:
            used[length] += many
            at -= length * many
    return dict(used)


class Packer:
    """Turns pieces into sequences; holds at most `pool` open pieces, or more while they do not make up one window."""

    def __init__(self, capacity: int, pool: int, first_sequence: int):
        self.capacity, self.pool, self.sequence = capacity, pool, first_sequence
        self.open: dict[int, list] = defaultdict(list)
        self.held = self.tokens = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        for start in range(0, len(ids), self.capacity):
            part = ids[start : start + self.capacity]
            if len(part) == self.capacity:
                self._close([(doc_id, start, part, len(ids))])
            else:
                self._open(doc_id, start, part.copy(), len(ids))
        while self.held > self.pool and self.tokens >= self.capacity:
            self._close(self._window())

    def _open(self, doc_id, start: int, part: np.ndarray, total: int) -> None:
        self.open[len(part)].append((doc_id, start, part, total))
        self.held, self.tokens = self.held + 1, self.tokens + len(part)

    def _take(self, length: int):
        piece = self.open[length].pop()
        self.held, self.tokens = self.held - 1, self.tokens - length
        if not self.open[length]:
            del self.open[length]
        return piece

    def _window(self) -> list:
        longest = max(self.open)
        pieces = [self._take(longest)]
        for length, n in fill({k: len(v) for k, v in self.open.items()}, self.capacity - longest).items():
            pieces += [self._take(length) for _ in range(n)]
        slack = self.capacity - sum(len(x[2]) for x in pieces)
        if slack > self.capacity // 1024 and self.open:
            # Every open piece is longer than the slack, or it would be in the window.
            doc_id, start, part, total = self._take(max(self.open))
            pieces.append((doc_id, start, part[:slack], total))
            self._open(doc_id, start + slack, part[slack:], total)
        return pieces

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, part, total in pieces:
            self.out.append((doc_id, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), total, self.sequence, offset))
            offset += len(part)
        self.sequence += 1

    def finish(self) -> None:
        while self.held:
            pieces = self._window()
            left = sum(len(x[2]) for x in pieces)
            if self.capacity - left <= self.capacity // 1024 or left & (left - 1) == 0:
                self._close(pieces)
                continue
            size = 1 << (left.bit_length() - 1)
            now, room = [], size
            for doc_id, start, part, total in pieces:
                while len(part):
                    now.append((doc_id, start, part[:room], total))
                    start, room, part = start + len(now[-1][2]), room - len(now[-1][2]), part[room:]
                    if not room:
                        self._close(now)
                        left -= size
                        now, room = [], 1 << (left.bit_length() - 1) if left else 0
                        size = room

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) or [[]] * 7
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")])


_TOKENS: dict[tuple[str, int], WordTokens] = {}


def _packer(path: str, end: int, capacity: int, pool: int, words: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, words)
        if key not in _TOKENS:
            _TOKENS.clear()
            _TOKENS[key] = WordTokens(path, words)
        tokens = _TOKENS[key]
        packer = Packer(capacity, pool, TaskContext.get().partitionId() << 32)
        for whole in batches:
            for at in range(0, whole.num_rows, 300):
                batch = whole.slice(at, 300)
                for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.encode([x or b"" for x in batch.column(1).to_pylist()], end)):
                    packer.add(doc_id, ids)
                yield packer.drain()
            release(collect=False)
        packer.finish()
        yield packer.drain()

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, end: int = 2, capacity: int = 4096, pool: int = 1500, words: int = 600_000) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A worker keeps the ids of
    about `words` distinct words."""
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return base.mapInArrow(_packer(tokenizer_path, end, capacity, pool, words), PIECES)
