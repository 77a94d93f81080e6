"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans. Four labelers (format, gazetteer, context, shape) vote on each; expectation-maximisation over the
counts of vote patterns estimates how far each labeler is right, and a logistic classifier fitted to the resulting
chances decides on the spans of the further kinds. Spans of the base kinds always stay.
"""
from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tabred.llm.tables import drop, saved

# Fixed patterns of the base kinds, written so that no start or repetition is tried twice.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Patterns of the further kinds; each is of bounded length.
HANDLE = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{2,64}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{2,24}){1,5}"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
LOCAL = r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])"
PERSON = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?(?![A-Za-z])"

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# Fixed lists: common endings of domains, countries of bank accounts, calling codes, given names.
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|io|co|ai|de|fr|es|it|nl|uk|us|eu|ch|at|be|pl|pt|se|no|dk|fi|ru|cn|jp|in|br|ca|au"
COUNTRIES = "AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK"
CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-9]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|85[0-9]|88[0-9]|96[0-9]|97[0-9]|99[0-9]"
GIVEN = ("James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|"
         "Jessica|Sarah|Karen|Anna|Maria|Peter|Paul|Hans|Klaus|Pierre|Jean|Marie|Carlos|Juan|Luis|Carmen|Ana|Laura|Julia|Emma|Sophie")
#: Words before or after a span that speak for a kind, and those that speak against any.
CONTEXT = {"email": "mail|contact|write", "ip": r"\bip\b|address|host|server|login", "card": "card|visa|credit|payment|carte|karte|tarjeta",
           "phone": "phone|tel|call|mobile|fax", "handle": "mail|contact|write", "national": "ssn|social|security|national|tax",
           "account": "iban|account|bank|konto|compte|cuenta", "local": "phone|tel|call|mobile|fax", "person": "name|dear|contact|sincerely|signed"}
AGAINST = "version|isbn|issn|order|invoice|serial|figure|table|page|chapter|example"
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(CONTEXT)
LABELERS = ("format", "gazetteer", "context", "shape")
#: Characters around a span that the context labeler reads.
BEFORE, AFTER = 40, 20
_BLOCK = 256


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (F.length(digits) - i) % 2 == 1
        return total + F.when(twice & (d > 4), d * 2 - 9).when(twice, d * 2).otherwise(d)
    n = F.length(digits)
    return F.when((n >= 12) & (n <= 19), F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0).otherwise(False)


def _bank_check(value: Column) -> Column:
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return out.otherwise(F.lit(-1)) if no is None else out.when(no, F.lit(-1)).otherwise(F.lit(0))


def _digit_count(low: int, high: int) -> Callable[[Column], Column]:
    return lambda v: F.length(_digits(v)).between(low, high)


@dataclass(frozen=True)
class Kind:
    pattern: str
    hint: str                                       # a text without this has no span of the kind
    holds: Callable[[Column], Column] | None        # further condition on a match; failing matches are dropped
    format: Callable[[Column], Column]
    gazetteer: Callable[[Column], Column]


_NONE = lambda v: F.lit(0)
PATTERNS = {
    "email": Kind(EMAIL, "@", None, lambda v: _vote(v.rlike(r"\.[A-Za-z]{2,24}$")), lambda v: _vote(v.rlike(rf"(?i)\.(?:{ENDINGS})$"), F.lit(False))),
    "ip": Kind(IP, r"[0-9]\.[0-9]", lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), lambda v: _vote(~v.rlike(r"^0+\.|^255\.|\.0+[0-9]")),
               lambda v: _vote(F.lit(False), v.rlike(r"^(?:0|127)\."))),
    "card": Kind(CARD, r"[0-9][\x20-]?[0-9]", _luhn, lambda v: _vote(_digit_count(13, 19)(v)),
                 lambda v: _vote(_digits(v).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"), _digits(v).rlike("^0"))),
    "phone": Kind(PHONE, r"\+[0-9]", _digit_count(9, 15), lambda v: _vote(~v.rlike(r"[.()-]{3}")), lambda v: _vote(_digits(v).rlike(f"^(?:{CALLING})"))),
    "handle": Kind(HANDLE, r"[\[(]at[\])]", None, lambda v: _vote(v.rlike(r"[A-Za-z]{2,24}$")), lambda v: _vote(v.rlike(rf"(?i)(?:{ENDINGS})$"), F.lit(False))),
    "national": Kind(NATIONAL, "[0-9]{3}-[0-9]{2}-", None, lambda v: _vote(~v.rlike("^(?:000|666|9)|-00-|-0000$")), _NONE),
    "account": Kind(ACCOUNT, "[A-Z]{2}[0-9]{2}", None, lambda v: _vote(_bank_check(v)), lambda v: _vote(v.rlike(f"^(?:{COUNTRIES})"))),
    "local": Kind(LOCAL, "[0-9]{3}[.-][0-9]{4}", None, lambda v: _vote(v.rlike(r"^\(?[2-9]")), _NONE),
    "person": Kind(PERSON, r"\b(?:Mr|Mrs|Ms|Dr|Prof)\b", None, _NONE, lambda v: _vote(v.rlike(rf"\b(?:{GIVEN})\b"), F.lit(False))),
}


def _totals(values: Column) -> Column:
    """Running totals of a short array of numbers."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"] + x).alias("out")), lambda a: a["out"])


def _fresh(columns: list[str], name: str) -> str:
    while name in columns:
        name += "_"
    return name


def _step(matches: Column, gaps: Column) -> Callable[[Column, Column], Column]:
    """From the start of one match to the start of the next: the match and the text behind it."""
    return lambda _, i: F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(matches, i - 1))).otherwise(0)


def _block(values: Column) -> Callable[[Column], Column]:
    return lambda b: _totals(F.slice(values, (b - 1) * _BLOCK + 1, F.lit(_BLOCK)))


def _shift(before: Column) -> Callable[[Column, Column], Column]:
    def block(values: Column, i: Column) -> Column:
        return F.transform(values, lambda x: x + F.get(before, i))
    return block


def _span(kind: str, gaps: Column, starts: Column) -> Callable[[Column, Column], Column]:
    """Function of (match, number) to the span with its votes."""
    p = PATTERNS[kind]

    def span(x: Column, i: Column) -> Column:
        start, before, after = F.get(starts, i), F.get(gaps, i), F.get(gaps, i + 1)
        near = F.concat(F.right(before, F.lit(BEFORE)), F.lit(" "), F.left(after, F.lit(AFTER)))
        glued = F.right(before, F.lit(1)).rlike("[A-Za-z0-9_]") | F.left(after, F.lit(1)).rlike("[A-Za-z0-9_]")
        votes = (p.format(x), p.gazetteer(x), _vote(near.rlike(f"(?i){CONTEXT[kind]}"), near.rlike(f"(?i){AGAINST}")), _vote(~glued))
        holds = F.lit(True) if p.holds is None else p.holds(x)
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(x)).alias("end"), holds.alias("holds"),
                        *[v.cast("int").alias(n) for n, v in zip(LABELERS, votes)])
    return span


def _of_kind(k: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == k


def candidates(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with an array column of all spans that patterns propose, and the column's name.

    A span has start and end in characters, kind, and the votes of the labelers. Null texts have none.
    """
    taken = list(docs.columns)
    out = docs
    columns = {}
    source = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    for kind, p in PATTERNS.items():
        m, g, s = (_fresh(taken, f"{x}_{kind}__") for x in ("m", "g", "s"))
        columns[kind] = (m, g, s)
        out = out.withColumn(m, F.when(source.rlike(p.hint), F.regexp_extract_all(source, F.lit(p.pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    out = out.withColumns({g: F.when(F.size(m) > 0, F.split(source, PATTERNS[k].pattern, -1)) for k, (m, g, _) in columns.items()})
    # Running totals in blocks, so that long arrays are not copied for each element. Each step is a column of its own,
    # used twice, so that none is worked out again inside a later one.
    every = columns.values()
    out = out.withColumns({s: F.when(F.size(m) > 0, F.transform(F.col(m), _step(F.col(m), F.col(g)))) for m, g, s in every})
    out = out.withColumns({s: F.when(F.size(s) > 0, F.transform(F.sequence(F.lit(1), F.ceil(F.size(s) / _BLOCK).cast("int")), _block(F.col(s)))) for *_, s in every})
    out = out.withColumns({f"{s}o": F.when(F.size(s) > 0, _totals(F.concat(F.array(F.lit(0)), F.transform(s, lambda b: F.element_at(b, -1))))) for *_, s in every})
    out = out.withColumns({s: F.when(F.size(f"{s}o") > 0, F.flatten(F.transform(F.col(s), _shift(F.col(f"{s}o"))))) for *_, s in every})
    arrays = []
    for kind, (m, g, s) in columns.items():
        spans = F.transform(F.col(m), _span(kind, F.col(g), F.col(s)))
        arrays.append(F.when(F.size(m) > 0, F.filter(spans, lambda c: c["holds"])))
    kept = F.array_compact(F.array(*arrays))
    name = _fresh(taken, "candidates__")
    return out.withColumn(name, F.array_sort(F.flatten(kept))).drop(*[c for m, g, s in every for c in (m, g, s, f"{s}o")]), name


@dataclass
class Classifier:
    """Weight of each kind and labeler; a span is personal data where their sum is positive."""
    kinds: list[float]
    labelers: list[float]
    reliability: list[float]

    def score(self, span: Column) -> Column:
        bias = F.get(F.array(*[F.lit(float(k)) for k in self.kinds]), span["kind"])
        return bias + sum((span[n] * F.lit(float(w)) for n, w in zip(LABELERS, self.labelers)), F.lit(0.0))


def fit(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50, steps: int = 400) -> Classifier:
    """Classifier from (kind, votes, count) of all candidates; without any, labelers count as right four times in five.

    Expectation: the chance that a candidate is personal data, from the kind's share and the labelers that do not
    abstain. Maximisation: shares and reliabilities, with ten imagined votes each. The logistic weights are then
    fitted to the chances by gradient steps, shrunk towards nought. Work depends on the vote patterns only.
    """
    sure = lambda p: min(max(p, 0.02), 0.98)
    share, right = [0.5] * len(KINDS), [0.8] * len(LABELERS)
    chance = {}
    for _ in range(rounds):
        for kind, votes, _ in patterns:
            odds = math.log(sure(share[kind]) / (1 - sure(share[kind]))) + sum(v * math.log(sure(r) / (1 - sure(r))) for v, r in zip(votes, right))
            chance[kind, votes] = 1 / (1 + math.exp(-odds))
        hit, cast, yes, seen = [8.0] * len(right), [10.0] * len(right), [5.0] * len(share), [10.0] * len(share)
        for kind, votes, count in patterns:
            c = chance[kind, votes]
            yes[kind] += c * count
            seen[kind] += count
            for j, v in enumerate(votes):
                if v:
                    cast[j] += count
                    hit[j] += count * (c if v > 0 else 1 - c)
        share, right = [y / s for y, s in zip(yes, seen)], [max(h / c, 0.5) for h, c in zip(hit, cast)]
    total = sum(n for *_, n in patterns) + 1.0
    kinds, weights = [0.0] * len(KINDS), [math.log(sure(r) / (1 - sure(r))) for r in right]
    for _ in range(steps if patterns else 0):
        slope_k, slope_w = [-0.01 * k for k in kinds], [-0.001 * w for w in weights]
        for kind, votes, count in patterns:
            p = 1 / (1 + math.exp(-kinds[kind] - sum(w * v for w, v in zip(weights, votes))))
            gap = (chance[kind, votes] - p) * count / total
            slope_k[kind] += gap
            for j, v in enumerate(votes):
                slope_w[j] += gap * v
        kinds = [k + s for k, s in zip(kinds, slope_k)]
        weights = [w + s for w, s in zip(weights, slope_w)]
    return Classifier(kinds, weights, right)


def train(found: DataFrame, name: str) -> Classifier:
    """Fit on the vote patterns of every candidate; one row per pattern reaches the driver, 729 at most."""
    each = found.where(F.size(name) > 0).select(F.explode(name).alias("c")).groupBy("c.kind", *[f"c.{n}" for n in LABELERS]).count()
    return fit(sorted((r[0], tuple(r[1:1 + len(LABELERS)]), r["count"]) for r in each.collect()))


def decided(spans: Column, classifier: Classifier) -> Column:
    """Base spans, and spans of further kinds that the classifier takes and that touch no base span, in order."""
    base = F.filter(spans, lambda s: s["kind"] < len(BASE))
    more = F.filter(spans, lambda s: (s["kind"] >= len(BASE)) & (classifier.score(s) > 0)
                    & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.array_sort(F.concat(base, more))


def find_private(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of base kinds, digest of base spans, and all spans of every document; repeated rows repeat.

    Candidates are found in one pass and kept without texts; the classifier fitted to all of them is then applied.
    """
    found, name = candidates(docs.select(key, text), text)
    found = saved(found.select(key, name))
    spans = decided(F.col(name), train(found, name))
    names = F.array(*map(F.lit, KINDS))
    told = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = found.select(key, spans.alias("s__"))
    base = F.filter("s__", lambda s: s["kind"] < len(BASE))
    return out.select(key, *[F.size(F.filter("s__", _of_kind(k))).cast("long").alias(f"n_{n}") for k, n in enumerate(BASE)],
                      F.sha2(told(base), 256).alias("base_sha256"), told(F.col("s__")).alias("spans"),
                      F.size(F.filter("s__", lambda s: s["kind"] >= len(BASE))).cast("long").alias("n_added"))


def mask_private(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, all columns kept.

    Overlapping spans become one, named after the first. A text without spans, and a null text, stay as they are; the
    length column ``n_chars``, where there is one, follows the text.
    """
    found, name = candidates(docs, text)
    counted = saved(found.select(name))                     # whole: a filter would be worked out inside every step above
    classifier = train(counted, name)
    drop(counted)

    def merge(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (s["start"] < last["end"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(
            F.array_append(done, F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    spans = _fresh(found.columns, "spans__")
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    body = F.col(f"`{text}`")
    out = found.withColumn(spans, F.when(F.size(name) > 0, F.aggregate(decided(F.col(name), classifier), empty, lambda d, s: F.when(
        F.size(d) == 0, F.array(F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))).otherwise(merge(d, s)))))
    at = F.col(spans)
    parts = F.transform(at, lambda s, i: F.concat(F.substring(body, F.when(i > 0, F.get(at, i - 1)["end"]).otherwise(0) + 1, s["start"] - F.when(
        i > 0, F.get(at, i - 1)["end"]).otherwise(0)), F.get(names, s["kind"])))
    rest = F.substring(body, F.element_at(at, -1)["end"] + 1, F.length(body))
    out = out.withColumn(text, F.when(F.size(at) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(body))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(at) > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])
