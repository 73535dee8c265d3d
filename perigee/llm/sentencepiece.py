"""SentencePiece (byte-pair model) encoding and decoding by suffix-array matching.

A batch's new units (a run of meta spaces with the word behind it; no piece reaches over such a border) are
concatenated and indexed by a suffix array as deep as the longest piece. Every piece of the model is
searched in it, all pieces at once, one character at a time; its range of suffixes gives its occurrences. These
edges form a table of the best score from each position and length, over which the units
are relaxed: the two neighbours whose edge has the best score are merged, leftmost first, until none is left. That
is what the model's own encoder does, so identifiers equal its identifiers. What no piece covers
becomes byte pieces. Units are remembered; a text is cut into units and looked up.

A long unit, as texts without spaces have, is cut again between neighbours that stand side by side in no piece: every
merge makes a piece, so none reaches over such a border, and its parts are encoded as units of their own.

Defined results: a null or empty text has no pieces; a meta space (U+2581) in a text is read as a space, as the
model does, so it doesn't come back on decoding; null identifiers and repeated rows are kept; very long texts are taken
whole, and of them one part without a border at a time is in memory (some 500 bytes a character: only a run of characters that
pieces join everywhere, such as one letter repeated, makes a large part); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import settle, small_batches

META = "▁"
#: Units that a worker remembers, and characters of new units that are indexed at once.
CACHE_UNITS, BLOCK_CHARS = 600_000, 1 << 20
#: Longer units are relaxed one by one with a heap, as rounds over all units would wait for them.
LONG_UNIT = 48
#: Units beyond so many characters are cut at borders that no piece reaches over.
CUT_UNIT = 2048
_UNIT = re.compile(f"{META}*[^{META}]+|{META}+")


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their next ``depth`` characters, by prefix doubling; ties keep their order.

    The first sort takes as many characters at once as fit into a key.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    low = int(codes.min())
    present = np.zeros(int(codes.max()) - low + 1, bool)
    present[codes - low] = True
    char = np.cumsum(present)[codes - low]  # from 1, as nothing stands behind the end
    bits, width, key = int(char.max()).bit_length(), 1, char
    while width * 2 * bits <= 63 and width < depth:
        longer = key << (width * bits)
        longer[: max(n - width, 0)] |= key[width:]
        key, width = longer, width * 2
    order = np.argsort(key, kind="stable")
    while width < depth:
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
        key = rank * (n + 1)
        key[: max(n - width, 0)] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        width *= 2
    return order


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of = [b""] * n
        self.byte_id = [model.unk_id()] * 256
        pieces = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes_of[i] = piece.encode()
                pieces.append((piece, i, model.get_score(i)))
        if any(META in p.lstrip(META) for p, _, _ in pieces):
            raise ValueError("a piece reaches over a unit's border")
        self.depth = max(len(p) for p, _, _ in pieces)
        self.chars = np.zeros((len(pieces), self.depth), np.int64)
        for row, (piece, _, _) in enumerate(pieces):
            self.chars[row, : len(piece)] = [ord(c) for c in piece]
        self.lengths = np.array([len(p) for p, _, _ in pieces])
        self.ids = np.array([i for _, i, _ in pieces])
        # Ranks by score: the better one first; equal scores keep the order of identifiers.
        self.rank = np.empty(len(pieces), np.int64)
        self.rank[np.lexsort((self.ids, [-s for _, _, s in pieces]))] = np.arange(len(pieces))
        self.id_of_rank = np.empty(len(pieces), np.int64)
        self.id_of_rank[self.rank] = self.ids
        self.units: dict[str, bytes] = {}
        inner = self.chars[:, 1:] > 0
        self.joined = np.unique((self.chars[:, :-1] << 21 | self.chars[:, 1:])[inner])

    def parts(self, unit: str) -> Iterator[str]:
        """A unit cut between neighbours that stand side by side in no piece."""
        begin = 0
        for at in range(0, len(unit), BLOCK_CHARS):
            codes = np.frombuffer(unit[at : at + BLOCK_CHARS + 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            pair = codes[:-1] << 21 | codes[1:]
            found = self.joined[np.minimum(np.searchsorted(self.joined, pair), len(self.joined) - 1)] == pair
            for end in (np.flatnonzero(~found) + at + 1).tolist():
                yield unit[begin:end]
                begin = end
        yield unit[begin:]

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """best[position, length]: rank of the piece that matches there, or a large number."""
        order = suffix_array(codes, self.depth)
        n, none = len(codes), np.iinfo(np.int32).max
        padded = np.r_[codes, np.full(self.depth, -1)]
        low, high = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), n, np.int64)
        for d in range(self.depth):
            live = np.flatnonzero((self.lengths > d) & (low < high))
            want = self.chars[live, d]
            for side in (0, 1):  # the range whose character at this depth is the wanted one
                a, b = low[live].copy(), high[live].copy()
                while (open_ := a < b).any():
                    middle = (a + b) // 2
                    seen = padded[order[np.minimum(middle, n - 1)] + d]
                    up = open_ & ((seen < want) if side == 0 else (seen <= want))
                    a, b = np.where(up, middle + 1, a), np.where(open_ & ~up, middle, b)
                if side == 0:
                    first = a
                else:
                    low[live], high[live] = first, a
        count = high - low
        piece = np.repeat(np.arange(len(count)), count)
        at = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        # No two pieces match at one position with one length, so the order of the edges doesn't matter.
        best = np.full((n + 1, self.depth + 1), none, np.int32)
        best.ravel()[at * (self.depth + 1) + self.lengths[piece]] = self.rank[piece]
        return best

    def learn(self, units: Iterable[str]) -> None:
        block, size = [], 0
        for unit in units:
            block.append(unit)
            size += len(unit) + 1
            if size >= BLOCK_CHARS:
                self._learn(block)
                block, size = [], 0
        if block:
            self._learn(block)

    def _learn(self, units: list[str]) -> None:
        text = "\0".join(units)
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        lengths = np.array([len(u) for u in units])
        starts = np.cumsum(lengths + 1) - lengths - 1
        codes[starts[1:] - 1] = -2  # between units, below every character
        best = self.edges(codes)
        after = np.arange(1, len(codes) + 1)  # where the symbol that begins at a position ends
        alive = codes != -2  # positions where a symbol begins
        short = lengths <= LONG_UNIT
        self._relax(best, after, alive, starts[short], lengths[short])
        for s, n in zip(starts[~short].tolist(), lengths[~short].tolist()):
            self._relax_long(best, after, alive, s, s + n)
        at = np.flatnonzero(alive)
        size = after[at] - at
        rank = best[at, np.minimum(size, self.depth)]
        known = rank < len(self.id_of_rank)
        ids = self.id_of_rank[np.where(known, rank, 0)].astype("<u4")
        first = np.searchsorted(at, starts)
        bounds = np.r_[first, len(at)]
        odd = np.zeros(len(units), bool)
        odd[np.searchsorted(starts, at[~known], side="right") - 1] = True
        data, cuts = ids.tobytes(), (4 * bounds).tolist()
        for unit, a, b in zip(units, cuts, cuts[1:]):
            self.units[unit] = data[a:b]
        for u in np.flatnonzero(odd).tolist():  # with characters that no piece has
            out: list[int] = []
            for k in range(bounds[u], bounds[u + 1]):
                out += [int(ids[k])] if known[k] else [self.byte_id[x] for x in text[at[k] : after[at[k]]].encode("utf-8", "surrogatepass")]
            self.units[units[u]] = np.array(out, "<u4").tobytes()

    def _merge_ranks(self, best: np.ndarray, after: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Rank of merging the symbol at a position with the next one of its unit."""
        none = np.iinfo(np.int32).max
        middle = after[at]
        ok = middle < stop
        end = np.where(ok, after[np.minimum(middle, len(after) - 1)], at)
        size = end - at
        ok &= size <= self.depth
        return np.where(ok, best[at, np.where(ok, size, 0)], none)

    def _relax(self, best: np.ndarray, after: np.ndarray, alive: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """All units at once; in each round every unit makes its best merge, the leftmost among equals."""
        none = np.iinfo(np.int32).max
        at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        unit = np.repeat(np.arange(len(starts)), lengths)
        stop = (starts + lengths)[unit]
        while len(at):
            rank = self._merge_ranks(best, after, at, stop)
            heads = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            least = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.r_[heads, len(at)])
            hit = (rank == np.repeat(least, sizes)) & (rank < none)
            index = np.flatnonzero(hit)
            first = index[np.r_[True, unit[index][1:] != unit[index][:-1]]] if len(index) else index
            gone = np.zeros(len(at), bool)
            after_next = after[after[at[first]]]
            gone[first + 1] = True
            alive[at[first + 1]] = False
            after[at[first]] = after_next
            stay = ~gone & np.repeat(least < none, sizes)
            at, unit, stop = at[stay], unit[stay], stop[stay]

    def _relax_long(self, best: np.ndarray, after: np.ndarray, alive: np.ndarray, start: int, stop: int) -> None:
        import heapq

        before = {i: i - 1 for i in range(start, stop)}
        ends = {i: i + 1 for i in range(start, stop)}
        heap: list[tuple[int, int, int]] = []

        def propose(i: int) -> None:
            if i < start or ends[i] >= stop:
                return
            end = ends[ends[i]]
            if end - i <= self.depth and best[i, end - i] < np.iinfo(np.int32).max:
                heapq.heappush(heap, (int(best[i, end - i]), i, end))

        for i in range(start, stop):
            propose(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            if i not in ends or ends[i] >= stop or ends[i] == end or ends.get(ends[i]) != end:
                continue
            del ends[ends[i]]
            ends[i] = end
            if end < stop:
                before[end] = i
            propose(i)
            if before[i] >= start:
                propose(before[i])
        alive[start:stop] = False
        for i, end in ends.items():
            after[i], alive[i] = end, True

    def _units(self, text: str) -> Iterator[str]:
        for m in _UNIT.finditer((META + text).replace(" ", META)) if text else ():
            if m.end() - m.start() > CUT_UNIT:
                yield from self.parts(m.group())
            else:
                yield m.group()

    def _encode(self, cut: list[list[str]]) -> list[bytes]:
        new = {u for units in cut for u in set(units) if u not in self.units}
        if len(self.units) + len(new) > CACHE_UNITS:
            self.units, new = {}, {u for units in cut for u in units}
        self.learn(new)
        return [b"".join(map(self.units.__getitem__, units)) for units in cut]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Identifiers of each text as little-endian 32-bit bytes; a very long text goes in blocks of units."""
        cut = [_UNIT.findall((META + t).replace(" ", META)) if t else [] for t in texts if len(t) <= BLOCK_CHARS]
        cut = [[x for u in units for x in (self.parts(u) if len(u) > CUT_UNIT else (u,))] if max(map(len, units), default=0) > CUT_UNIT else units for units in cut]
        short = iter(self._encode(cut))
        return [next(short) if len(t) <= BLOCK_CHARS else b"".join(self._encode([block])[0] for block in self._blocks(t)) for t in texts]

    def _blocks(self, text: str) -> Iterator[list[str]]:
        block, size = [], 0
        for unit in self._units(text):
            block.append(unit)
            size += len(unit)
            if size >= BLOCK_CHARS:
                yield block
                block, size = [], 0
        yield block

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data.decode("utf-8", "replace").replace(META, " ")[1:]


_loaded: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian 32-bit), n_ids: one row per document."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(path)
        for batch in batches:
            ids = pieces.encode_batch([x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["doc_id", "ids", "n_ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, n_ids long")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows made by :func:`encode`."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(path)
        for batch in batches:
            texts = [pieces.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_and_check(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_sha256, n_chars, round_trip: encoded, decoded again and compared, without shipping the ids."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(path)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids = pieces.encode_batch(texts)
            columns = [
                batch.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([pieces.decode(x) == t.replace(META, " ") for x, t in zip(ids, texts)]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_ids", "ids_sha256", "n_chars", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession, 2000):
        return settle(rows.mapInArrow(run, "doc_id long, n_ids long, ids_sha256 string, n_chars long, round_trip boolean"))
