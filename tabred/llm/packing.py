"""Sequences of token ids packed by linear grouping, few-size configurations and best fit."""
from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabred.llm.tables import giving_back, numbered, saved
from tabred.llm.words import equal_spans, slices, span_codes, span_hashes

CAPACITY = 1024
END_ID = 2
#: Pieces above this share of a sequence are grouped; shorter ones are fitted in afterwards.
SMALL_SHARE = 0.45
#: Groups of equal cardinality, so many sizes at most in a configuration.
GROUPS = 64
#: Different text chunks whose ids a task keeps, about 60 bytes each.
KEPT_CHUNKS = 400_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
#: White space outside ASCII, in UTF-8.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def safe_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of chunks that the split pattern of byte-level BPE never joins.

    No match goes on from a letter (ASCII, or of the Latin-1 block) to an ASCII character that is none, or from
    anything to white space; a line end alone between two other characters is a match of its own.
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        before, here = data[:-1], data[1:]
        letter = _LETTER[data]
        letter[1:] |= (before == 0xC3) & (here >= 0x80) & (here != 0x97) & (here != 0xB7)
        space = _SPACE[data]
        cut[1:-1] = (space[1:] & ~space[:-1]) | (letter[:-1] & (here < 0x80) & ~_LETTER[here])
        cut[2:-1] |= (data[1:-1] == 0x0A) & ~space[:-2] & ~space[2:]
    for wide in _WIDE_SPACE.finditer(data.tobytes()):
        cut[max(wide.start() - 1, 0):wide.end() + 2] = False
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


class ChunkTokenizer:
    """Ids of texts by the tokenizers library, each different chunk of text encoded once and put together."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.forget()

    def forget(self) -> None:
        """Keep no chunks."""
        self.known, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.bytes, self.held = np.zeros(1 << 16, np.uint8), 0
        self.byte_at, self.byte_size = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _ids(self, chunks: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in chunks], add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        made = self._ids(chunks)
        size = np.fromiter(map(len, made), np.int32, len(made))
        whole, long = np.frombuffer(b"".join(chunks), np.uint8), np.fromiter(map(len, chunks), np.int32, len(chunks))
        if self.held + len(whole) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros(len(self.bytes) + len(whole), np.uint8)])
        self.bytes[self.held:self.held + len(whole)] = whole
        byte_at = self.held + np.cumsum(long, dtype=np.int64) - long
        self.held += len(whole)
        total = int(size.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + total, np.uint32)])
        self.ids[self.used:self.used + total] = np.fromiter(chain.from_iterable(made), np.uint32, total)
        at = self.used + np.cumsum(size, dtype=np.int64) - size
        self.used += total
        place = np.searchsorted(self.known, hashes)
        self.known, self.at, self.size, self.byte_at, self.byte_size = (np.insert(a, place, b) for a, b in (
            (self.known, hashes), (self.at, at), (self.size, size), (self.byte_at, byte_at), (self.byte_size, long)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds per text) of a run of texts."""
        starts = safe_cuts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        hashes, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > KEPT_CHUNKS:
            self.forget()
        place = np.searchsorted(self.known, hashes)
        new = np.flatnonzero(place == len(self.known)) if not len(self.known) else np.flatnonzero(
            self.known[np.minimum(place, len(self.known) - 1)] != hashes)
        if len(new):
            raw = data.tobytes()
            self._learn(hashes[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            place = np.searchsorted(self.known, hashes)
        kept = place[back]
        if not equal_spans(data, starts, ends, self.bytes, self.byte_at[kept], self.byte_at[kept] + self.byte_size[kept]).all():
            return self._encode_apart(data, offsets, starts, ends)
        at, sizes = self.at[place][back], self.size[place][back].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.ids[np.repeat(at - total[:-1], sizes) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]

    def _encode_apart(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same where different chunks share a hash: chunks are told apart by their bytes, and nothing is kept."""
        codes, chunks = span_codes(data, starts, ends)
        made = [np.array(i, np.uint32) for i in self._ids(chunks.to_pylist())]
        total = np.concatenate(([0], np.cumsum(np.array([len(m) for m in made], np.int64)[codes])))
        return np.concatenate([made[c] for c in codes.tolist()]), total[np.searchsorted(starts, offsets)]


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: its ids closed by the end id, cut only if longer than a sequence.

    The first piece of a long document takes the remainder, so all others are full. Null and empty texts are one
    piece of the end id alone. Repeated rows repeat; an empty table gives no rows.
    """
    def run(batches):
        encoder = _tokenizer(tokenizer)
        for batch in batches:
            keys, made = batch.column(0), []
            for first, _, data, offsets in slices(batch.column(1)):
                ids, bounds = encoder.encode(data, offsets)
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    own = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4")
                    start, length = 0, (len(own) - 1) % capacity + 1
                    piece = 0
                    while start < len(own):
                        made.append((first + i, piece, start, length, zlib.crc32(own[start:start + length].tobytes())))
                        start, length, piece = start + length, capacity, piece + 1
            columns = list(zip(*made)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()),
                 *[pa.array(c, pa.int64()) for c in columns[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder.forget()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(giving_back(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(pieces of each size, sequences) of whole sequences that a linear programme over few sizes fills.

    Columns are found as they are needed: the shadow prices of the sizes in the basis ask a knapsack for a better
    filling. Shares of a sequence are rounded down, what is left over is fitted afterwards.
    """
    n = len(sizes)
    if not n:
        return []
    basis = np.diag([float(capacity // s) for s in sizes])
    need, of = np.array(counts, float), np.array(sizes)
    for _ in range(40 * n):
        price = np.linalg.solve(basis.T, np.ones(n))
        value, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(1, capacity + 1):                     # best value of a filling of each room
            value[room] = value[room - 1]
            fit = np.searchsorted(-of, -room)                   # sizes from here on fit
            if fit < n:
                worth = value[room - of[fit:]] + price[fit:]
                best = int(np.argmax(worth))
                if worth[best] > value[room] + 1e-12:
                    value[room], taken[room] = worth[best], fit + best
        if value[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(n), capacity
        while room > 0:
            if taken[room] < 0:
                room -= 1
            else:
                column[taken[room]] += 1
                room -= sizes[taken[room]]
        level, change = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, level / np.where(change > 1e-9, change, 1), np.inf)
        if not np.isfinite(ratio).any():
            break
        basis[:, int(np.argmin(ratio))] = column
    level = np.floor(np.linalg.solve(basis, need) + 1e-9)
    out = []
    left = list(counts)
    for j in range(n):
        column = [int(round(c)) for c in basis[:, j]]
        times = min([int(max(level[j], 0)), *[left[i] // c for i, c in enumerate(column) if c]])
        if times > 0:
            left = [a - times * c for a, c in zip(left, column)]
            out.append((column, times))
    return out


class Plan:
    """Where the pieces of each length go. Its size depends on the capacity and the groups, never on the rows.

    A row (length, rank, count, sequence, offset) puts the ``count`` pieces of this length from number ``rank`` on
    into consecutive sequences from ``sequence`` on, each at ``offset``.
    """

    def __init__(self, lengths: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL_SHARE) -> None:
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self.next = defaultdict(int)
        self.rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
        full = lengths.get(capacity, 0)
        if full:
            self._put(capacity, full, self._open(full), 0)
        left = {n: c for n, c in lengths.items() if n < capacity and c > 0}
        large = [(n, left[n]) for n in sorted(left, reverse=True) if n > capacity * small]
        members = self._grouped(large, groups)
        sizes, counts = [m[0][0] for m in members], [sum(c for _, c in m) for m in members]
        for column, times in configurations(sizes, counts, capacity):
            self._substitute(members, column, times, left)
        for n in sorted(left, reverse=True):
            self._best_fit(n, left[n])

    @staticmethod
    def _grouped(large: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
        """Runs of (length, count), longest first, cut into groups of equal cardinality."""
        total = sum(c for _, c in large)
        size = -(-total // groups) if total else 1
        out, room = [], 0
        for n, c in large:
            while c:
                if room == 0:
                    out.append([])
                    room = size
                part = min(c, room)
                out[-1].append([n, part])
                c, room = c - part, room - part
        return out

    def _open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def _put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.rows.append((length, self.next[length], count, sequence, offset))
        self.next[length] += count

    def _substitute(self, members, column: list[int], times: int, left: dict[int, int]) -> None:
        """Fill ``times`` sequences of one configuration with pieces of the groups, longest first."""
        slots = []
        for group, copies in zip(members, column):
            for _ in range(copies):
                slot, need = [], times
                while need:
                    n, c = group[0]
                    part = min(c, need)
                    slot.append((n, part))
                    need -= part
                    left[n] -= part
                    if part == c:
                        group.pop(0)
                    else:
                        group[0][1] -= part
                slots.append(slot)
        first = self._open(times)
        marks = sorted({0, times, *[m for slot in slots for m in np.cumsum([c for _, c in slot]).tolist()]})
        for a, b in zip(marks[:-1], marks[1:]):
            used = 0
            for slot in slots:
                at = 0
                for n, c in slot:
                    if at <= a < at + c:
                        self._put(n, b - a, first + a, used)
                        used += n
                        break
                    at += c
            if used < self.capacity:
                self.rooms[self.capacity - used].append((first + a, b - a))

    def _best_fit(self, length: int, count: int) -> None:
        """Put pieces of one length into the tightest sequences with room, then into new ones."""
        while count:
            room = min((r for r, runs in self.rooms.items() if r >= length and runs), default=0)
            if room:
                first, there = self.rooms[room].pop()
            else:
                room = self.capacity
                there = -(-count // (room // length))
                first = self._open(there)
            copies = room // length
            whole = min(there, count // copies)
            for k in range(copies if whole else 0):
                self._put(length, whole, first, self.capacity - room + k * length)
            if whole and room - copies * length:
                self.rooms[room - copies * length].append((first, whole))
            count -= whole * copies
            rest = there - whole
            if rest and count:                                   # fewer than ``copies`` are left: one sequence takes them
                for k in range(count):
                    self._put(length, 1, first + whole, self.capacity - room + k * length)
                if room - count * length:
                    self.rooms[room - count * length].append((first + whole, 1))
                rest, count, whole = rest - 1, 0, whole + 1
            if rest:
                self.rooms[room].append((first + whole, rest))


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL_SHARE) -> DataFrame:
    """``pieces`` (a saved table with ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Only the number of pieces of each length goes to the driver, one row per length; the plan made from it is
    bounded by capacity and groups and is broadcast. Pieces of one length are numbered in bins, so a length that most
    pieces share is no hot group.
    """
    lengths = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    if lengths and (min(lengths) < 1 or max(lengths) > capacity):
        raise ValueError(f"lengths must be 1 to {capacity}")
    rows = Plan(lengths, capacity, groups, small).rows
    names = ["length", "from__", "count__", "sequence__", "offset"]
    columns = list(zip(*rows)) or [[]] * 5
    plan = pieces.sparkSession.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names=names))
    ranked = numbered(pieces, ["length"], "rank__").alias("p")
    here = (F.col("p.length") == F.col("q.length")) & (F.col("rank__") >= F.col("from__")) & (F.col("rank__") < F.col("from__") + F.col("count__"))
    return ranked.join(F.broadcast(plan.alias("q")), here).select(
        *[F.col(f"p.{c}") for c in pieces.columns], (F.col("sequence__") + F.col("rank__") - F.col("from__")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Cut all documents into pieces and pack them; see :func:`cut_pieces` and :func:`pack`."""
    return pack(saved(cut_pieces(docs, tokenizer, capacity)), capacity)
