"""Secret scan with corpus-wide ownership frequency of every candidate value."""
from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabred.llm.tables import saved

# Fixed patterns of the base kinds and the least length of what counts in each.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "provider", "login", "random")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Fixed public formats: platform tokens, signed tokens, key blocks; and a password inside an address.
PROVIDER = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}"
                      r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")
LOGIN = re.compile(r"(?<=://)[A-Za-z0-9._-]{1,64}:[^\s:@/]{8,64}(?=@[A-Za-z0-9])")
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,200}(?![A-Za-z0-9+/_-])")
_PLACEHOLDER = re.compile(r"example|sample|changeme|your|dummy|placeholder|xxxx|1234567|(.)\1{5}", re.IGNORECASE)

#: A value seen at this many owners counts as a copied example.
COPIED_OWNERS = 5
#: Parts that the rows of one value are split into where frequencies are joined back.
SALTS = 8


def _live(value: str) -> bool:
    """Whether a value looks drawn at random rather than written by hand."""
    return len(set(value)) >= 7 and not _PLACEHOLDER.search(value)


def _random(value: str) -> bool:
    return (any(c.isdigit() for c in value) and any(c.isupper() for c in value) and any(c.islower() for c in value)
            and len(set(value)) >= 14)


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of all base spans and of the method's candidates outside them, in order."""
    spans = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        spans += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    more = [(m.start(), 3, m.end(), m[0]) for m in PROVIDER.finditer(text)]
    if "://" in text:
        more += [(m.start(), 4, m.end(), m[0]) for m in LOGIN.finditer(text)]
    more += [(m.start(), 5, m.end(), m[0]) for m in RANDOM.finditer(text) if _random(m[0])]
    if more:
        taken = sorted((s, e) for s, _, e, _ in spans)
        end = -1
        for s, kind, e, value in sorted(more):
            if s >= end and not any(a < e and s < b for a, b in taken):
                spans.append((s, kind, e, value))
                end = e
    return sorted(spans)


def scan(docs: DataFrame, owner: Column, repository: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its base counts and digest, and its candidates with a hash of each value.

    Null texts count as empty, null owners and repositories as ones named "". The values themselves stay in the task.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            counts, digests, found = ([], [], []), [], []
            for part in batch.column(3):
                spans = find(part.as_py() or "")
                base = [s for s in spans if s[1] < 3]
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base).encode()).hexdigest())
                found.append([{"start": s, "kind": k, "end": e, "live": _live(v), "value": hashlib.sha256(v.encode()).digest()[:16]}
                              for s, k, e, v in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()),
                 pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("live", pa.bool_()), ("value", pa.binary())])))],
                names=["key", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "found"])
    return docs.select(F.col(key), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
                       F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), F.col(text)).mapInArrow(
        run, f"`{key}` {kind}, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, "
             "found array<struct<start:int,kind:int,end:int,live:boolean,value:binary>>")


def ownership(values: DataFrame) -> DataFrame:
    """(value, n_owners, n_repositories) of rows (value, owner, repository), combined before each shuffle."""
    pairs = values.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("value", "owner").agg(F.count("one").alias("repositories"))
    return owners.groupBy("value").agg(F.count("owner").alias("n_owners"), F.sum("repositories").alias("n_repositories"))


def find_secrets(docs: DataFrame, owner: Column, repository: Column, key: str = "doc_id", text: str = "text",
                 copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Secrets of every document, base kinds and the method's own, with what the whole corpus says of their values.

    A value that ``copied_owners`` or more owners have is a copied example; one of fewer owners that looks random is
    live. Base spans stay whatever their frequency (``n_copied`` counts the copied ones); spans of the further kinds
    are added only where their value is live. Repeated rows give repeated rows, which do not change a frequency.
    """
    rows = saved(scan(docs, owner, repository, key, text).withColumn("row__", F.monotonically_increasing_id()))
    each = rows.where(F.size("found") > 0).select("row__", "owner", "repository", F.explode("found").alias("s")).select("row__", "owner", "repository", "s.*")
    salts = F.array(*[F.lit(i) for i in range(SALTS)])
    known = ownership(each.select("value", "owner", "repository")).withColumn("salt", F.explode(salts))
    judged = each.withColumn("salt", F.pmod(F.xxhash64("row__", "start"), F.lit(SALTS)).cast("int")).join(known, ["value", "salt"])
    own = (F.col("n_owners") < copied_owners) & F.col("live")
    span = F.struct("start", "kind", "end")
    of_row = judged.groupBy("row__").agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") < 3) | own, span))).alias("kept"),
        F.sum(F.when(F.col("n_owners") >= copied_owners, 1).otherwise(0)).alias("n_copied"),
        F.sum(F.when(own, 1).otherwise(0)).alias("n_live"), F.max("n_repositories").alias("most_repositories"))
    names = F.array(*map(F.lit, KINDS))
    told = F.array_join(F.transform("kept", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return (rows.select("row__", F.col(key), "n_assign", "n_access", "n_hex", "base_sha256").join(of_row, "row__", "left")
            .select(key, "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(told, F.lit("")).alias("spans"),
                    *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_copied", "n_live", "most_repositories")]))
