"""Best-fit packing of tokenised documents into sequences by exact-complement hashing.

Tokens are counted where the texts lie; what is planned is only how many pieces there are of each length,
a table of at most ``capacity`` numbers whatever the corpus. The plan takes the longest pieces first and
looks up single lengths, pair sums and triple sums that fill the gap exactly, consuming a combination as
often as its availability allows; what has no exact complement is packed by best fit. A run of equal sequences is one
entry of the plan, so the plan is bounded by ``capacity`` as well. Pieces are numbered within their length by task and place, without
gathering a length's pieces anywhere, and find their sequence by binary search in the plan.

Defined results: a null text counts as empty and yields the end token alone; null identifiers and repeated
rows are packed like any other; a text over the capacity is cut into pieces, its ids held whole by its task alone; an
empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import settle, small_batches, trim

CAPACITY = 4096
END = 1
#: Distinct words whose ids a worker keeps: two generations, so that words in use outlive the rare ones.
CACHE_WORDS = 300_000
#: Characters of the texts whose words a worker holds at once; a longer text is held alone.
HELD = 800_000

_LETTER = "a-zªµºß-öø-ſ"
_NUMBER = "0-9²³¹¼½¾"
#: Texts of other characters, or with what may be a special token, go through the tokenizer whole.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ſ‐-‧€]|<\\|")
_WORDS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")


class _Generations(dict):
    """Words of this generation; those of the last one move here when they are used."""

    def __init__(self):
        super().__init__()
        self.last: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        self[word] = code = self.last[word]
        return code

    def turn(self) -> None:
        self.last = dict(self)
        self.clear()


class WordTokens:
    """Token ids of whole texts as little-endian 32-bit bytes; words are encoded once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.words = _Generations()

    def _learn(self, words: set[str]) -> None:
        if len(self.words) > CACHE_WORDS // 2:
            self.words.turn()
        now, last = self.words, self.words.last
        new = [word for word in words if word not in now and word not in last]  # a set less a dictionary's keys would go through the dictionary
        if not new:
            return
        # A word's last token alone ends a word, so all new ones are encoded in one text and cut apart again.
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(new):
            raise ValueError(f"{len(new)} words gave {len(ends)} codes")
        data, cuts = ids.tobytes(), (4 * ends).tolist()
        self.words.update(zip(new, map(data.__getitem__, map(slice, [0, *cuts[:-1]], cuts))))

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out, start, held = [], 0, 0
        for end, text in enumerate(texts, 1):
            held += len(text)
            if held >= HELD or end == len(texts):
                out += self._some(texts[start:end])
                start, held = end, 0
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        """What is new in any of the texts is learnt at once."""
        cut = [None if _UNUSUAL.search(t) else _WORDS.findall(t.lower()) for t in texts]
        self._learn(set().union(*filter(None, cut)))
        code = self.words.__getitem__
        return [b"".join(map(code, words)) if words is not None else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, words in zip(texts, cut)]

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


_loaded: dict[str, WordTokens] = {}


def _tokens(path: str) -> WordTokens:
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
        trim()
    return _loaded[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, end = TaskContext.get().partitionId(), _tokens(path), np.array([END], "<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for key, ids in zip(batch.column("doc_id").to_pylist(), encode.many([x or "" for x in batch.column("text").to_pylist()])):
                ids = memoryview(ids + end)
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + capacity)]
                    n = len(own) // 4
                    rows.append((key, piece, start, n, zlib.crc32(own), part, int(seen[n])))
                    seen[n] += 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)
        trim()  # the worker waits for other tasks

    return run


class _Sums:
    """Which lengths are left, and which sums two or three of them have (brought up to date lazily: lengths only vanish)."""

    def __init__(self, left: np.ndarray):
        self.left, self.stale = left, 99
        self.pairs = self.triples = np.zeros(0, bool)

    def _refresh(self) -> None:
        have = (self.left > 0).astype(float)
        n = 4 * len(have)
        spectrum = np.fft.rfft(have, n)
        self.pairs, self.triples = (np.fft.irfft(spectrum**k, n) > 0.5 for k in (2, 3))
        self.stale = 0

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often a combination can be taken."""
        return int(min(self.left[x] // lengths.count(x) for x in lengths))

    def pair(self, gap: int, others: tuple[int, ...]) -> tuple[int, ...] | None:
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        for x in a[(self.left[a] > 0) & (self.left[gap - a] > 0)]:
            if self.times(found := (*others, int(x), gap - int(x))):
                return found
        return None

    def triple(self, gap: int, length: int) -> tuple[int, ...] | None:
        """``length`` and three more that fill the gap. A sum that has vanished since the last look brings the index up to date."""
        top = gap - 2
        while self.triples[gap]:
            c = np.arange(top, 0, -1)
            for x in c[(self.left[c] > 0) & self.pairs[gap - c]]:
                if found := self.pair(gap - int(x), (length, int(x))):
                    return found
                if self.stale:
                    top = int(x) - 1
                    break
            else:
                return None
            self._refresh()
        return None

    def exact(self, length: int, capacity: int) -> tuple[int, ...] | None:
        gap = capacity - length
        if gap == 0:
            return (length,)
        if self.left[gap] and self.times((length, gap)):
            return length, gap
        if self.stale >= 16:
            self._refresh()
        if gap >= 2 and self.pairs[gap] and (found := self.pair(gap, (length,))):
            return found
        return self.triple(gap, length) if gap >= 3 else None

    def take(self, need: dict[int, int]) -> int:
        times = int(min(self.left[x] // k for x, k in need.items()))
        for x, k in need.items():
            self.left[x] -= times * k
            self.stale += self.left[x] == 0
        return times


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, of each sequence so many, first sequence, offset) sorted by length and rank.

    ``counts[n]`` pieces have length n. A row holds for ranks from its first to the next row's first.
    """
    sums = _Sums(counts.astype(np.int64).copy())
    used, rows, sequences = np.zeros(capacity + 1, np.int64), [], 0

    def put(need: dict[int, int]) -> None:
        nonlocal sequences
        times, offset = sums.take(need), 0
        for length in sorted(need, reverse=True):
            rows.append((length, int(used[length]), need[length], sequences, offset))
            used[length] += times * need[length]
            offset += need[length] * length
        sequences += times

    for length in range(capacity, 0, -1):
        while sums.left[length] and (found := sums.exact(length, capacity)):
            put({x: found.count(x) for x in found})
    for length in range(capacity, 0, -1):
        while sums.left[length]:
            need, gap = {length: 1}, capacity - length
            fits = min(gap, length)
            while gap and fits:
                fits = min(fits, gap)
                some = np.flatnonzero(sums.left[1 : fits + 1])
                if not len(some):
                    break
                fits = int(some[-1]) + 1
                k = int(min(gap // fits, sums.left[fits] - need.get(fits, 0)))
                if k:
                    need[fits] = need.get(fits, 0) + k
                    gap -= k * fits
                fits -= 1
            put(need)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(slots: np.ndarray):
    keys = slots[:, 0] * 2**44 + slots[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            at = slots[np.searchsorted(keys, length * 2**44 + rank, side="right") - 1]
            i = rank - at[:, 1]
            columns = [batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at[:, 3] + i // at[:, 2]), pa.array(at[:, 4] + i % at[:, 2] * length)], names=names)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of a document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession, 500):
        pieces = settle(rows.mapInArrow(_cut(tokenizer or default_tokenizer(), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"))
    by_task = settle(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).toLocalIterator():  # at most ``capacity`` rows
        counts[length] = n
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = pieces.join(first, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("first"))
    return numbered.mapInArrow(_place(plan(counts, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
