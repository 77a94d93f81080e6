"""Quality rules: base counts, and a linear-chain conditional random field over the lines of a text."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tabred.llm.tables import digits52, giving_back, small_batches
from tabred.llm.words import mix, slices, span_codes, windows, word_spans

WINDOW = 8
#: Labelled documents that the field is fitted on, and the longest text among them in bytes: what the driver holds.
TRAIN_DOCS, TRAIN_BYTES = 2000, 100_000
#: Share of a text's word characters on content lines from which it is kept.
CONTENT_SHARE = 0.5


def _class(chars: str | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars] if isinstance(chars, str) else list(chars)] = True
    return out


SYMBOL = _class("#*$%&|<>")
_UPPER, _LOWERCASE, _DIGIT, _BANG, _BAR, _STOP = (_class(c) for c in (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!", "|", ".!?"))
_CHARACTER = ~_class(range(0x80, 0xC0))                # first bytes of characters
FEATURES = ("bias", "length", "symbols", "capitals", "exclamations", "bars", "digits", "repeated line", "word after itself",
            "repeated words", "sentence end", "symbol at word end")
#: Where weights start and are drawn to while little is known: marks of boilerplate count against content.
PRIOR = np.array([2.0, 0.5, -8.0, -3.0, -8.0, -8.0, -1.0, -1.0, -4.0, -3.0, 0.5, -4.0])
PRIOR_STEPS = np.array([[0.5, 0.0], [0.0, 0.5]])


@dataclass
class Lines:
    """What a run of texts shows: counts per text, and features of the lines that hold a word."""
    counts: dict[str, np.ndarray]
    features: np.ndarray
    characters: np.ndarray
    bounds: np.ndarray


def look(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """Base counts per text, and one feature row per line with a word."""
    def running(marks: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(marks)))

    starts, ends, bounds = word_spans(data, offsets)
    words, _ = span_codes(data, starts, ends)
    texts = len(offsets) - 1
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    window, whole = windows(mix(words.astype(np.uint64)), bounds, WINDOW)
    at = np.flatnonzero(whole)
    keys = mix(window[at] + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first_of, back, times = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    like = at[first_of[back]]
    if (owner[at] != owner[like]).any() or any((words[at + j] != words[like + j]).any() for j in range(WINDOW)):
        whole_rows = np.stack([owner[at], *[words[at + j] for j in range(WINDOW)]], axis=1)
        _, back, times = np.unique(whole_rows, axis=0, return_inverse=True, return_counts=True)
        back = back.ravel()
    again = at[times[back] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)                # ends at the text's end at the latest
    repeated = running(np.cumsum(edge[:-1]) > 0)
    is_char = running(_CHARACTER[data])
    word_chars = running(is_char[ends] - is_char[starts])
    symbols = running(SYMBOL[data])

    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    closed = (line_ends > line_starts) & (data[line_ends - 1] == 0x0A) if len(line_ends) else np.zeros(0, bool)
    line_ends = line_ends - closed
    first, last = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    full = last > first
    line_starts, line_ends, first, last = line_starts[full], line_ends[full], first[full], last[full]
    line_owner = np.searchsorted(offsets, line_starts, "right") - 1
    line_codes, every_line = span_codes(data, line_starts, line_ends)
    line_keys = line_codes + line_owner * max(len(every_line), 1)
    _, once = np.unique(line_keys, return_index=True)
    copy = np.ones(len(line_keys), bool)
    copy[once] = False
    counts = {"n_words": np.diff(bounds), "word_chars": np.diff(word_chars[bounds]), "n_symbols": np.diff(symbols[offsets]),
              "n_dup_lines": np.bincount(line_owner[copy], minlength=texts), "n_repeat_words": np.diff(repeated[bounds])}

    def per(marks: np.ndarray, scale: np.ndarray) -> np.ndarray:
        total = running(marks)
        return (total[line_ends] - total[line_starts]) / np.maximum(scale, 1)

    n = (last - first).astype(float)
    letters = per(_UPPER[data] | _LOWERCASE[data], np.ones(len(n)))
    size = (line_ends - line_starts).astype(float)
    echo = np.zeros(len(words), bool)
    echo[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    echo, marked = running(echo), running(SYMBOL[data[ends - 1]] | _BANG[data[ends - 1]] if len(ends) else np.zeros(0, bool))
    features = np.stack([np.ones(len(n)), np.log1p(n) / 4, per(SYMBOL[data], size), per(_UPPER[data], letters), per(_BANG[data], size),
                         np.minimum(per(_BAR[data], n), 1), per(_DIGIT[data], size), copy.astype(float), (echo[last] - echo[first]) / np.maximum(n, 1),
                         (repeated[last] - repeated[first]) / np.maximum(n, 1), _STOP[data[ends[last - 1] - 1]].astype(float) if len(n) else np.zeros(0),
                         (marked[last] - marked[first]) / np.maximum(n, 1)], axis=1) if len(n) else np.zeros((0, len(FEATURES)))
    return Lines(counts, features, word_chars[last] - word_chars[first], np.searchsorted(line_owner, np.arange(texts + 1)))


@dataclass
class Field:
    """Linear-chain conditional random field with the states boilerplate (0) and content (1)."""
    weights: np.ndarray
    steps: np.ndarray

    def decode(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Most probable state of every line, sequence by sequence (Viterbi); boilerplate wins a tie."""
        score = features @ self.weights
        length = np.diff(bounds)
        order = np.argsort(-length, kind="stable")
        active = np.cumsum(np.bincount(length)[::-1])[::-1] if len(length) else np.zeros(1, int)   # texts with at least t lines
        out = np.zeros(len(score), np.int8)
        back = np.zeros((len(score), 2), np.int8)
        best = np.zeros((len(length), 2))
        for t in range(int(length.max(initial=0))):
            own = order[:active[t + 1]]
            line = bounds[own] + t
            if t:
                options = best[own][:, :, None] + self.steps[None]
                back[line] = options.argmax(axis=1)
                best[own] = options.max(axis=1)
            best[own, 1] += score[line]
        state = best.argmax(axis=1)
        for t in range(int(length.max(initial=0)) - 1, -1, -1):
            own = order[:active[t + 1]]
            line = bounds[own] + t
            out[line] = state[own]
            state[own] = back[line, state[own]]
        return out


def fit(features: np.ndarray, bounds: np.ndarray, content: np.ndarray, rounds: int = 150, hold: float = 2.0) -> Field:
    """Field of greatest posterior for sequences whose lines all have their text's label.

    Gradient ascent with forward and backward sums over all sequences at once; ``hold`` is the pull to the prior.
    Labels of whole texts say nothing of changes inside one, so the steps between states stay as they are given. No
    sequences at all, or one label only, leave the prior.
    """
    length = np.diff(bounds)
    content = content[length > 0]
    bounds = np.concatenate(([0], np.cumsum(length[length > 0])))
    length = length[length > 0]
    field = Field(PRIOR.copy(), PRIOR_STEPS.copy())
    if len(set(content.tolist())) < 2:
        return field
    order = np.argsort(-length, kind="stable")
    most = int(length.max())
    active = [int((length > t).sum()) for t in range(most)]
    lines = [bounds[order[:a]] + t for t, a in enumerate(active)]
    label = content[order]
    balance = np.where(label == 1, 0.5 / (label == 1).mean(), 0.5 / (label == 0).mean()) / np.sqrt(length[order])
    target = np.repeat(content, length).astype(float)
    share = np.zeros(len(target))
    for t, line in enumerate(lines):
        share[line] = balance[:active[t]]
    speed, moment, square = 0.1, None, None
    for k in range(1, rounds + 1):
        score = features @ field.weights
        forward = []
        for t, line in enumerate(lines):
            now = np.zeros((active[t], 2))
            if t:
                now += np.logaddexp.reduce(forward[-1][:active[t], :, None] + field.steps[None], axis=1)
            now[:, 1] += score[line]
            forward.append(now)
        total = np.zeros(len(label))
        for t in range(most):
            total[:active[t]] = np.logaddexp.reduce(forward[t], axis=1)
        after, chance = np.zeros((active[-1], 2)), np.zeros(len(target))
        for t in range(most - 1, -1, -1):
            if len(after) < active[t]:
                after = np.concatenate([after, np.zeros((active[t] - len(after), 2))])
            chance[lines[t]] = np.exp(forward[t][:, 1] + after[:, 1] - total[:active[t]])
            if t:
                emit = after.copy()
                emit[:, 1] += score[lines[t]]
                after = np.logaddexp.reduce(field.steps[None] + emit[:, None, :], axis=2)
        scale = 1.0 / len(label)
        slope = features.T @ ((target - chance) * share) * scale - hold * scale * (field.weights - PRIOR)
        moment = slope * 0.1 if moment is None else 0.9 * moment + 0.1 * slope
        square = slope ** 2 * 0.01 if square is None else 0.99 * square + 0.01 * slope ** 2
        step = speed * (moment / (1 - 0.9 ** k)) / (np.sqrt(square / (1 - 0.99 ** k)) + 1e-8)
        field = Field(field.weights + step, field.steps)
    return field


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Field:
    """Fit the field on at most ``train_docs`` labelled documents, the first in the order of a hash of doc_id.

    Texts longer than ``train_bytes`` are no examples. Null labels and labels without a document are left out; of
    several labels the highest counts.
    """
    chosen = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(digits52(F.col("doc_id").cast("string")), "doc_id").limit(train_docs))
    sample = docs.select("doc_id", "text").where(F.octet_length("text") <= train_bytes).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in batches:
            made, content = [], batch.column(1).to_pylist()
            for first, end, data, offsets in slices(batch.column(0)):
                seen = look(data, offsets)
                for i, (a, b) in enumerate(zip(seen.bounds[:-1], seen.bounds[1:])):
                    made.append((seen.features[a:b].astype("<f8").tobytes(), content[first + i]))
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.binary()), pa.array([int(m[1] > 0) for m in made], pa.int32())],
                                             names=["features", "content"])
    with small_batches(sample.sparkSession):
        made = sample.select("text", F.col("quality").cast("int")).mapInArrow(giving_back(run), "features binary, content int").collect()
    rows = sorted((bytes(r[0]), r[1]) for r in made)
    each = [np.frombuffer(r[0], "<f8").reshape(-1, len(FEATURES)) for r in rows]
    bounds = np.concatenate(([0], np.cumsum([len(e) for e in each]))).astype(int)
    return fit(np.concatenate(each) if each else np.zeros((0, len(FEATURES))), bounds, np.array([r[1] for r in rows], int))


def judge(docs: DataFrame, field: Field, name: str = "quality", share: float = CONTENT_SHARE) -> DataFrame:
    """``docs`` with a struct column of counts and verdict; every row and column stays.

    A text fails at once with fewer than 20 words or with over 30 % of its words in repeated windows; else it is
    kept if content lines hold ``share`` of its word characters. Null texts have no words. ``name`` must be new.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kind = T.StructType([*[T.StructField(c, T.LongType()) for c in counts], T.StructField("content_share", T.DoubleType()),
                         T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            parts: dict[str, list] = {c: [np.zeros(0)] for c in (*counts, "content_share", "base_failed", "kept")}
            for _, _, data, offsets in slices(batch.column(place)):
                seen = look(data, offsets)
                content = np.concatenate(([0], np.cumsum(field.decode(seen.features, seen.bounds) * seen.characters)))
                c = seen.counts
                part = np.diff(content[seen.bounds]) / np.maximum(c["word_chars"], 1)
                failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
                for key, value in {**c, "content_share": part, "base_failed": failed, "kept": ~failed & (part >= share)}.items():
                    parts[key].append(value)
            whole = {k: np.concatenate(v) for k, v in parts.items()}
            made = pa.StructArray.from_arrays([*[pa.array(whole[c].astype(np.int64)) for c in counts], pa.array(whole["content_share"]),
                                               *[pa.array(whole[c].astype(bool)) for c in ("base_failed", "kept")]], names=kind.names)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])
    return docs.mapInArrow(giving_back(run), T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts, base failure and verdict of every document."""
    out = judge(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", "quality.*")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    name = "quality__"
    while name in docs.columns:
        name += "_"
    return judge(docs, train(docs, labels), name).where(F.col(name)["kept"]).drop(name)
