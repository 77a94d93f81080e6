"""Digests of words, read from one buffer."""
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from tabred.llm import words


class Buffers:
    """Byte strings that give their buffers only, not a Python value each through Arrow."""

    def __init__(self, texts: pa.Array) -> None:
        self.buffers, self.type, self.offset, self.size = texts.buffers, texts.type, texts.offset, len(texts)

    def __len__(self) -> int:
        return self.size


def test_words_are_digested_from_one_buffer(monkeypatch):
    told = [b"one", "zwölf".encode(), b"x" * 300, b"one", b"\xff\x00"]
    data = np.frombuffer(b" ".join(told), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in told]) - 1
    starts = ends - [len(w) for w in told]
    keep = words.span_codes
    monkeypatch.setattr(words, "span_codes", lambda *a: (lambda codes, texts: (codes, Buffers(texts)))(*keep(*a)))
    want = [int.from_bytes(blake2b(w, digest_size=8, key=b"words").digest(), "little") for w in told]
    assert words.word_keys(data, starts, ends).tolist() == want
    assert words.word_keys(data, starts[1:], ends[1:]).tolist() == want[1:]
    assert len(words.word_keys(data[:0], starts[:0], ends[:0])) == 0
    sliced = pa.array([b"no", b"one", b"two"], pa.large_binary()).slice(1)
    monkeypatch.setattr(words, "span_codes", lambda *a: (np.array([1, 0]), Buffers(sliced)))
    assert words.word_keys(data, starts[:2], ends[:2]).tolist() == [int.from_bytes(blake2b(w, digest_size=8, key=b"words").digest(), "little") for w in (b"two", b"one")]
