"""Words, shingles and lines of many texts at once, over Arrow's own buffers."""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together; a longer single text is taken whole.
SLICE_BYTES = 750_000
U = np.uint64
_ROOT = 0x9E3779B97F4A7C15
_INVERSE = pow(_ROOT, -1, 2 ** 64)
_SPREAD = np.random.default_rng(20240711).integers(1, 2 ** 63, 16, dtype=np.uint64) * U(2) + U(1)

#: White space between words: the space and the five controls from tab to carriage return.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
_KEYED = blake2b(digest_size=8, key=b"words")
_powers = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for i, base in enumerate((_ROOT, _INVERSE)):
            factors = np.full(size, U(base & (2 ** 64 - 1)), U)
            factors[0] = 1
            _powers[i] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(places, kind)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, raw[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span: a filter only, since different spans can be made that share it."""
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U) * _SPREAD[0])


def equal_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each span of ``data`` has the bytes of its span of ``other``; some ten thousand spans at a time."""
    same = ends - starts == last - first
    for low in range(0, len(starts), 1 << 14):
        part = slice(low, low + (1 << 14))
        size = np.where(same[part], (ends - starts)[part], 0)
        edge = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(edge[-1]) - np.repeat(edge[:-1], size)
        wrong = np.concatenate(([0], np.cumsum(data[np.repeat(starts[part], size) + at] != other[np.repeat(first[part], size) + at])))
        same[part] &= wrong[edge[1:]] == wrong[edge[:-1]]
    return same


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of each span's bytes, the different byte strings by number) for spans in order that don't overlap."""
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    edge = np.empty(2 * len(starts) + 1, np.int64)
    edge[0:-1:2], edge[1::2], edge[-1] = starts, ends, ends[-1]
    every = pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(data))])
    own = every.take(pa.array(np.arange(0, len(edge) - 1, 2))).dictionary_encode()
    return own.indices.to_numpy().astype(np.int64), own.dictionary


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of a keyed blake2b digest of each span, alike on every machine; equal bytes are digested once."""
    codes, texts = span_codes(data, starts, ends)
    if not len(texts):
        return np.zeros(0, U)
    _, places, held = texts.buffers()
    raw = held.to_pybytes() if held is not None else b""
    edge = np.frombuffer(places, np.int64 if pa.types.is_large_binary(texts.type) else np.int32)[texts.offset:texts.offset + len(texts) + 1].tolist()
    made = []
    for first, last in zip(edge, edge[1:]):            # slices of one bytes object cost a fraction of Arrow's own values
        digest = _KEYED.copy()
        digest.update(raw[first:last])
        made.append(digest.digest())
    return np.frombuffer(b"".join(made), U)[codes]


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the end) of the words of a run of texts."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separator[data]
    starts, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    both = inside[cuts] & inside[cuts + 1]          # a text ends in a word and the next begins with one
    starts[cuts[both]] = ends[cuts[both]] = True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    return starts, ends, np.searchsorted(starts, offsets)


def windows(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k words from each word on, whether they all lie in its text)."""
    total = np.full(len(words), _SPREAD[0])
    for j in range(min(k, len(words))):
        total[:len(words) - j] = mix(total[:len(words) - j] ^ words[j:]) + _SPREAD[1]
    last = np.repeat(bounds[1:], np.diff(bounds)) - k
    return mix(total), np.arange(len(words)) <= last


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds per text) of all k-word shingles in order; a shorter text is one shingle as a whole."""
    lengths = np.diff(bounds)
    count = np.where(lengths >= k, lengths - k + 1, (lengths > 0).astype(lengths.dtype))
    total, keep = windows(words, bounds, k)
    for d in np.flatnonzero((lengths > 0) & (lengths < k)):
        own = words[bounds[d]:bounds[d + 1]]
        total[bounds[d]] = int.from_bytes(blake2b(own.tobytes(), digest_size=8, key=b"short").digest(), "little")
        keep[bounds[d]] = True
    return total[keep], np.concatenate(([0], np.cumsum(count)))


def distinct_sets(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct values per text."""
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def shingle_sets(texts: pa.Array, k: int, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of every text."""
    for first, _, data, offsets in slices(texts):
        data = LOWER[data] if lower else data
        starts, ends, bounds = word_spans(data, offsets)
        hashes, cuts = shingle_hashes(word_keys(data, starts, ends), bounds, k)
        for i, own in enumerate(distinct_sets(hashes, cuts)):
            yield first + i, own
