"""Byte-level BPE encoding and decoding with a local rank file."""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

#: Characters that a text is encoded in at once, about; longer texts are cut at safe boundaries.
PIECE_CHARS = 100_000
#: Between these two characters no match of the split pattern can reach: a space after and before something that is not space.
SAFE = regex.compile(r"(?<=\S)(?= \S)")

#: White space (Unicode) in a row from which a run is merged without the split pattern.
LONG_RUN = 10_000
_RUN = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


@lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (one base64 token and its rank per line)."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Consecutive parts of a text, cut only where the split pattern always ends a match.

    A match that begins at a space and goes on with something else never starts earlier, and nothing before a space
    runs over it; a text without such a place stays whole.
    """
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, enc: tiktoken.Encoding, size: int = PIECE_CHARS) -> np.ndarray:
    """Token ids of a text, as the library gives for the whole text.

    The split pattern takes a run of white space as one match, less its last character where something follows. The
    library's pattern engine runs out of stack on very long runs, so their bytes are merged as one piece instead.
    """
    if len(text) <= min(size, LONG_RUN):
        return np.array(enc.encode_ordinary(text), np.uint32)
    out, start = [np.zeros(0, np.uint32)], 0
    for run in _RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += [np.array(enc.encode_ordinary(p), np.uint32) for p in pieces(text[start:run.start()], size)]
        out.append(np.array(enc._encode_single_piece(text[run.start():end]), np.uint32))
        start = end
    out += [np.array(enc.encode_ordinary(p), np.uint32) for p in pieces(text[start:], size)]
    return np.concatenate(out)


def encode_texts(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) per row; null and empty texts give no ids, repeated rows repeat. Other columns are left out."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            ids = [encode(t or "", enc) for t in batch.column(1).to_pylist()]
            yield _batch(batch.column(0), {"ids": pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))})
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_ids(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes) per row of ids, byte for byte; the bytes need not be valid UTF-8. Null ids give no bytes."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            yield _batch(batch.column(0), {"bytes": pa.array([enc.decode_bytes(i or []) for i in batch.column(1).to_pylist()], pa.binary())})
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, bytes binary")


def round_trip(df: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Encode every document, decode its ids, and return counts and digests, without moving ids between tasks.

    Null and empty texts have no ids; texts of any length are encoded whole; repeated rows repeat, with the doc_id as it
    is (null too). Other columns are left out, whatever their names; an empty table gives no rows.
    """
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for part in batch.column(1):
                ids = encode(part.as_py() or "", enc)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(enc.decode_bytes(ids.tolist())).hexdigest())
            yield _batch(batch.column(0), {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()),
                                           "decoded_sha256": pa.array(of_bytes, pa.string())})
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _batch(key: pa.Array, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key, *columns.values()], names=["key", *columns])
