"""Toxicity of documents by a linear-chain conditional random field over their words.

1. One pass over all labelled rows counts, per hashed form of a word (whole, beginnings, ends), toxic and clean documents.
   The counts give each form a log-odds value that is only as far from 0 as it is sure.
2. A bounded sample of labelled rows gives labelled words: those of toxic documents whose forms are surely toxic. The
   field is fitted to them; a logistic curve over what its marginals add up to is fitted to the documents' labels.
3. Forward and backward sums over every whole text give each word's marginal, hence score and offending offsets.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tabred.llm.tables import digits52, small_batches
from tabred.llm.words import LOWER, mix, slices, span_hashes, word_spans

#: Hashed forms: what is counted in Spark, and what every task is told (a number each).
BINS = 1 << 19
#: Bytes of the beginnings and ends of words that count as forms of their own.
STARTS, ENDS = (4, 6, 8), (4, 6)
#: Labelled documents that the field is fitted on, and the longest text among them in bytes: what the driver holds.
TRAIN_DOCS, TRAIN_BYTES = 1500, 6_000
#: Standard errors taken off a log-odds value, and the value from which a word of a toxic document is labelled toxic.
CAUTION, SURE = 2.0, 1.5
#: Words on either side that make up a word's surroundings.
AROUND = 5
FEATURES = ("bias", "word", "beginning", "end", "most", "least", "before", "after", "around", "length", "capitals", "digits")
#: Where weights start and are drawn to: words whose forms are surely toxic.
PRIOR = np.array([-4.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0])
#: Logarithms beyond which a word's weight counts as this, so that sums stay finite.
_FAR, _LEAST = 30.0, 1e-60
_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F, *range(0x80, 0x100)]] = False
_CAPITAL, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = _DIGIT[0x30:0x3A] = True
_SALTS = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % 2 ** 64) for i in range(1 + len(STARTS) + len(ENDS))]


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of Latin-1 in lower case; lengths stay."""
    out = LOWER[data]
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1
    up = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    out[up] += 0x20
    return out


@dataclass
class Words:
    """Words of a run of texts: byte spans, the first word of each text and the end, and hashed forms (-1: none)."""
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    forms: np.ndarray


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = lowered(data)
    starts, ends, bounds = word_spans(low, offsets, _NOT_WORD)
    length = ends - starts
    spans = [(starts, ends, length > 0)]
    spans += [(starts, np.minimum(starts + n, ends), length > n) for n in STARTS]
    spans += [(np.maximum(ends - n, starts), ends, length > n) for n in ENDS]
    forms = np.full((len(starts), len(spans)), -1, np.int64)
    for i, (a, b, there) in enumerate(spans):
        hashed = mix(span_hashes(low, a, b) ^ _SALTS[i]) % np.uint64(BINS)
        forms[:, i] = np.where(there, hashed.astype(np.int64), -1)
    return Words(starts, ends, bounds, forms)


def features(data: np.ndarray, words: Words, values: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per word; ``values`` has the log-odds value of every hashed form."""
    n = len(words.starts)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    own = np.where(words.forms >= 0, values[words.forms], 0.0)
    front, back = own[:, 1:1 + len(STARTS)], own[:, 1 + len(STARTS):]
    pick = lambda x: x[np.arange(n), np.abs(x).argmax(axis=1)]
    best = own.max(axis=1)
    owner = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    first, last = words.bounds[owner], words.bounds[owner + 1]
    at = np.arange(n)
    run = np.concatenate(([0.0], np.cumsum(np.maximum(best, 0.0))))
    low, high = np.maximum(at - AROUND, first), np.minimum(at + AROUND + 1, last)
    share = lambda marks: (c := np.concatenate(([0], np.cumsum(marks[data]))))[words.ends] - c[words.starts]
    size = words.ends - words.starts
    columns = (1.0, own[:, 0], pick(front), pick(back), best, own.min(axis=1),
               np.where(at > first, best[np.maximum(at - 1, 0)], 0.0), np.where(at + 1 < last, best[np.minimum(at + 1, n - 1)], 0.0),
               (run[high] - run[low] - np.maximum(best, 0.0)) / (2 * AROUND), np.log1p(size) / 3, share(_CAPITAL) / size, share(_DIGIT) / size)
    for i, column in enumerate(columns):
        out[:, i] = column
    return out


def marginals(scores: np.ndarray, steps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chance of state 1 per word, chance of each pair of states with the word before) by forward and backward sums.

    All texts are one sequence whose first words forget what stands before them. It is cut into about as many blocks as
    a block has words: products of steps within all blocks at once, then from block to block, then within all blocks
    again. What is carried is how many times state 1 outweighs state 0. Pairs of first words are 0.
    """
    n = len(scores)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    long = max(1, int(np.sqrt(n)))
    count = -(-n // long)

    def blocks(values: np.ndarray, rest: float) -> np.ndarray:
        out = np.full(count * long, rest)
        out[:n] = values
        return np.ascontiguousarray(out.reshape(count, long).T)

    begin = np.zeros(n, bool)
    begin[bounds[:-1][np.diff(bounds) > 0]] = True
    gain = np.exp(np.clip(scores, -_FAR, _FAR))
    moves = np.exp(np.clip(steps, -_FAR, _FAR))
    # Weight of state s before state t of this word is m[s][t], without what the word itself gives to state 1.
    m = [[np.where(begin, 1.0, moves[s, t]) for t in (0, 1)] for s in (0, 1)]
    g = blocks(gain, 1.0)
    (a, b), (c, d) = ([blocks(m[s][t], float(s == t)) for t in (0, 1)] for s in (0, 1))
    b, d = b * g, d * g
    whole = np.zeros((2, 2, count))
    whole[0, 0] = whole[1, 1] = 1.0
    for t in range(long):
        first, second = whole[:, 0], whole[:, 1]
        whole = np.stack([first * a[t] + second * c[t], first * b[t] + second * d[t]], axis=1)
        if t % 4 == 3:
            whole /= whole.max(axis=(0, 1))
    whole /= whole.max(axis=(0, 1))
    head, tail, now = np.empty(count), np.empty(count), 1.0
    for k, ((w, x), (y, z)) in enumerate(whole.transpose(2, 0, 1).tolist()):
        head[k] = now
        now = min(max((x + z * now) / (w + y * now), _LEAST), 1 / _LEAST)
    now = 1.0
    for k, ((w, x), (y, z)) in reversed(list(enumerate(whole.transpose(2, 0, 1).tolist()))):
        tail[k] = now
        now = min(max((y + z * now) / (w + x * now), _LEAST), 1 / _LEAST)
    ahead, behind = np.empty((long, count)), np.empty((long, count))
    now = head
    for t in range(long):
        ahead[t] = now = (b[t] + d[t] * now) / (a[t] + c[t] * now)
    now = tail
    for t in range(long - 1, -1, -1):
        behind[t] = now
        now = (c[t] + d[t] * now) / (a[t] + b[t] * now)
    ahead, behind = ahead.T.ravel()[:n], behind.T.ravel()[:n]
    both = ahead * behind
    pairs = np.zeros((n, 2, 2))
    pairs[1:, 0, 0], pairs[1:, 0, 1] = moves[0, 0], moves[0, 1] * (gain * behind)[1:]
    pairs[1:, 1, 0], pairs[1:, 1, 1] = moves[1, 0] * ahead[:-1], moves[1, 1] * ahead[:-1] * (gain * behind)[1:]
    pairs[begin] = 0.0
    total = pairs.sum(axis=(1, 2), keepdims=True)
    return both / (1 + both), pairs / np.where(total > 0, total, 1.0)


def fit_field(rows: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, rounds: int = 80, hold: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(weights, steps) of greatest posterior for labelled words, by gradient ascent; the prior where nothing is toxic."""
    weights, steps = PRIOR.copy(), np.zeros((2, 2))
    if not toxic.any():
        return weights, steps
    inner = np.ones(len(toxic), bool)
    inner[bounds[:-1][np.diff(bounds) > 0]] = False
    seen = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(seen, (toxic[at - 1].astype(int), toxic[at].astype(int)), 1.0)
    moment = square = np.zeros(len(weights) + 4)
    for k in range(1, rounds + 1):
        chance, pairs = marginals(rows @ weights, steps, bounds)
        slope = np.concatenate([rows.T @ (toxic - chance) - hold * (weights - PRIOR), (seen - pairs.sum(axis=0) - hold * steps).ravel()])
        moment, square = 0.9 * moment + 0.1 * slope, 0.99 * square + 0.01 * slope ** 2
        step = 0.1 * (moment / (1 - 0.9 ** k)) / (np.sqrt(square / (1 - 0.99 ** k)) + 1e-8)
        weights, steps = weights + step[:len(weights)], steps + step[len(weights):].reshape(2, 2)
    return weights, steps


def summary(chance: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text: 1, expected toxic words (its logarithm), chance of one at least, the same for two, share of words."""
    def total(x):
        return np.diff(np.concatenate(([0.0], np.cumsum(x)))[bounds])
    n = np.diff(bounds)
    chance = np.clip(chance, 0.0, 1 - 1e-9)
    sure, none = total(chance), np.exp(total(np.log1p(-chance)))
    one = none * total(chance / (1 - chance))
    return np.stack([np.ones(len(n)), np.log1p(sure), 1 - none, np.clip(1 - none - one, 0.0, 1.0), sure / np.maximum(n, 1)], axis=1)


def fit_curve(rows: np.ndarray, toxic: np.ndarray, hold: float = 0.1) -> np.ndarray:
    """Logistic weights over :func:`summary` by Newton's steps; the constant alone where one label is missing."""
    weights = np.zeros(5)
    if not len(toxic) or toxic.min() == toxic.max():
        weights[0] = np.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5)) if len(toxic) else -2.0
        return weights
    pull = np.array([0.0, hold, hold, hold, hold])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (toxic - p) - pull * weights
        bend = (rows * (p * (1 - p))[:, None]).T @ rows + np.diag(pull + 1e-6)
        step = np.linalg.solve(bend, slope)
        weights = weights + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
    return weights


@dataclass
class Model:
    """Log-odds value of every hashed form, weights and steps of the field, weights of the curve."""
    values: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    curve: np.ndarray

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
        """Words, their chances of being toxic, and the score of every text."""
        words = read_words(data, offsets)
        chance, _ = marginals(features(data, words, self.values) @ self.weights, self.steps, words.bounds)
        return words, chance, 1 / (1 + np.exp(-np.clip(summary(chance, words.bounds) @ self.curve, -30, 30)))


def word_lists(docs: DataFrame) -> DataFrame:
    """(doc_id, words) per document: its different words in lower case, compressed; what counting documents needs of a text."""
    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out = []
            for _, _, data, offsets in slices(batch.column(1)):
                low = lowered(data)
                starts, ends, bounds = word_spans(low, offsets, _NOT_WORD)
                raw, starts, ends = low.tobytes(), starts.tolist(), ends.tolist()
                out += [press.compress(b" ".join(dict.fromkeys(raw[i:j] for i, j in zip(starts[a:b], ends[a:b])))) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "words"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, words binary")


def form_values(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Cautious log-odds value of every hashed form, from the counts over all labelled documents.

    Word lists meet the labels in a shuffle, never texts. Counts are added up in a task, then in Spark, so at most
    ``BINS`` rows leave a task and reach the driver.
    """
    def count(batches):
        toxic, clean, docs_of = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64), [0, 0]
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            texts = pa.array([opened.decompress(w) for w in batch.column(0).to_pylist()], pa.binary()).cast(pa.string())
            for first, _, data, offsets in slices(texts):
                words = read_words(data, offsets)
                for i, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
                    forms = np.unique(words.forms[a:b])
                    (toxic if label[first + i] else clean)[forms[forms >= 0]] += 1
                    docs_of[int(label[first + i] > 0)] += 1
        full = np.flatnonzero(toxic + clean)
        yield pa.RecordBatch.from_pydict({"form": np.append(full, -1), "toxic": np.append(toxic[full], docs_of[1]), "clean": np.append(clean[full], docs_of[0])})
    marked = word_lists(docs).join(labels.hint("merge"), "doc_id").select("words", F.col("toxic").cast("int"))
    rows = marked.mapInArrow(count, "form long, toxic long, clean long").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    form, toxic, clean = (rows.column(c).to_numpy() for c in ("form", "toxic", "clean"))
    whole = form < 0
    every = max(int(toxic[whole].sum()), 1) / max(int(clean[whole].sum()), 1)
    odds = np.log((toxic + 0.5) / (clean + 0.5)) - np.log(every)
    doubt = CAUTION * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    values = np.zeros(BINS, np.float32)
    values[form[~whole]] = (np.sign(odds) * np.maximum(np.abs(odds) - doubt, 0.0))[~whole]
    return values


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model:
    """Learn from ``labels`` (doc_id, toxic): values from all of them, field and curve from ``train_docs`` of them.

    The sample is the first in the order of a hash of doc_id; texts longer than ``train_bytes`` are no examples. Null
    labels and labels without a document are left out; of several labels the highest counts.
    """
    spark = docs.sparkSession
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    with small_batches(spark):
        values = form_values(docs, labels)
    told = spark.sparkContext.broadcast(values)
    chosen = labels.orderBy(digits52(F.col("doc_id").cast("string")), "doc_id").limit(train_docs)
    sample = docs.select("doc_id", "text").where(F.octet_length("text") <= train_bytes).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in batches:
            label = batch.column(1).to_pylist()
            for first, _, data, offsets in slices(batch.column(0)):
                words = read_words(data, offsets)
                rows = features(data, words, told.value).astype("<f4")
                made = [(rows[a:b].tobytes(), int(label[first + i] > 0)) for i, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.int32())], names=["rows", "toxic"])
    rows = sorted((bytes(r[0]), r[1]) for r in sample.select("text", F.col("toxic").cast("int")).mapInArrow(run, "rows binary, toxic int").collect())
    each = [np.frombuffer(r[0], "<f4").reshape(-1, len(FEATURES)).astype(float) for r in rows]
    bounds = np.concatenate(([0], np.cumsum([len(e) for e in each]))).astype(int)
    flat = np.concatenate(each) if each else np.zeros((0, len(FEATURES)))
    label = np.array([r[1] for r in rows], float)
    toxic = (np.repeat(label, np.diff(bounds)) > 0) & (flat[:, FEATURES.index("most")] >= SURE)
    weights, steps = fit_field(flat, bounds, toxic)
    chance, _ = marginals(flat @ weights, steps, bounds)
    return Model(values, weights, steps, fit_curve(summary(chance, bounds), label))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, spans) of every row: ``spans`` lists start:end of toxic words in code points.

    Words next to each other make one span. Null texts count as empty; texts without words get the score of a text in
    which nothing is toxic. Texts are read whole, whatever their length; memory follows the longest text.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int, spans string"
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches):
        schema = pa.schema([("doc_id", id_type), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", pa.string())])
        for batch in batches:
            score, spans = [np.zeros(0)], []
            for _, _, data, offsets in slices(batch.column(1)):
                words, chance, own = told.value.read(data, offsets)
                score.append(own)
                hit = np.flatnonzero(chance >= 0.5)
                owner = np.searchsorted(words.bounds, hit, "right") - 1
                found: dict[int, list[list[int]]] = {}
                before = -2
                for w, d in zip(hit.tolist(), owner.tolist()):
                    if w == before + 1 and d in found:
                        found[d][-1][1] = int(words.ends[w])
                    else:
                        found.setdefault(d, []).append([int(words.starts[w]), int(words.ends[w])])
                    before = w
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80))) if found else None
                spans += [",".join(f"{chars[a] - chars[offsets[d]]}:{chars[b] - chars[offsets[d]]}" for a, b in found[d]) if d in found else "" for d in range(len(offsets) - 1)]
            whole = np.concatenate(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole), pa.array((whole >= 0.5).astype(np.int32)), pa.array(spans, pa.string())], schema=schema)
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """Every document's score from a model learned on the labelled rows outside the held-out fold.

    Held out are rows with crc32(doc_id as text) mod ``folds`` = 0; a null doc_id is neither held out nor learned from.
    Only texts and the labels of the other rows enter the model. Repeated rows all come back; an empty table gives an
    empty result; without labels every text gets the same score. Further columns of ``docs`` are ignored.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    model = train(docs, labels.where(~held))
    return judge(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "spans")
