"""Tokens of property values, and hashed feature vectors."""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tabred.functions.vectors import let, unit

# Vector length, placeholder of a missing value, suffix of a corrected value.
DIMENSION = 128
MISSING = "<MISSING>"
CORRECTED = " [corrected]"


def correct(column: str, suffix: str = CORRECTED) -> Column:
    return F.concat(F.col(column).cast("string"), F.lit(suffix))


def canonical(column: str, missing: str | None = None) -> Column:
    """Trimmed lower-case text; null stays null unless ``missing`` gives a placeholder for null and empty."""
    text = F.lower(F.trim(F.col(column).cast("string")))
    return text if missing is None else F.coalesce(F.nullif(text, F.lit("")), F.lit(missing))


def tokens(namespace: str, column: str, name: str | None = None, missing: str | None = None) -> Column:
    """``ns.field=value`` and one ``ns.field:word=w`` per word; no tokens for a null value."""
    name = name or column
    text = canonical(column, missing)
    words = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), F.lit(1)),
                        lambda w: F.concat(F.lit(f"{namespace}.{name}:word="), w))
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(
        F.concat(F.array(F.concat(F.lit(f"{namespace}.{name}="), text)), words))


def all_tokens(parts: list[tuple[str, list[str]]], missing: str | None = None) -> Column:
    """Tokens of several (namespace, columns) parts in one array."""
    return F.concat(*[tokens(ns, c, missing=missing) for ns, cols in parts for c in sorted(cols)], F.array().cast("array<string>"))


def hashed_vector(token_array: Column, dimension: int = DIMENSION) -> Column:
    """Signed counts per hash slot, scaled to length 1; row-local, no shuffle.

    Slot and sign come from the md5 text of the token, which every engine computes alike.
    """
    slot = lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dimension).cast("int")
    sign = lambda t: F.when(F.substring(F.md5(t), 9, 1).isin("1", "3", "5", "7", "9", "b", "d", "f"), 1.0).otherwise(-1.0)
    hits = F.transform(token_array, lambda t: F.struct(slot(t).alias("i"), sign(t).alias("s")))
    counted = let(hits, lambda all_: F.transform(
        F.sequence(F.lit(0), F.lit(dimension - 1)),
        lambda i: F.aggregate(F.filter(all_, lambda h: h["i"] == i), F.lit(0.0), lambda a, h: a + h["s"])))
    return unit(counted)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def blake_vector(token_arrays: pd.Series) -> pd.Series:
    """The same with blake2b for slot and sign, where vectors must equal published ones number by number."""
    out = []
    for row in token_arrays:
        vector = np.zeros(DIMENSION)
        for token in row:
            digest = hashlib.blake2b(token.encode("utf-8"), digest_size=16).digest()
            vector[int.from_bytes(digest[:8], "big") % DIMENSION] += 1.0 if digest[8] % 2 else -1.0
        norm = np.sqrt((vector * vector).sum())
        out.append(vector / norm if norm else vector)
    return pd.Series(out)


def hash_features(df: DataFrame, id_: str, parts: list[tuple[str, list[str]]], dimension: int = DIMENSION,
                  missing: str | None = None, blake: bool = False) -> DataFrame:
    """[id, features] of the given (namespace, columns) parts."""
    bag = all_tokens(parts, missing)
    return df.select(F.col(id_).alias("id"), (blake_vector(bag) if blake else hashed_vector(bag, dimension)).alias("features"))


def property_bag(df: DataFrame, columns: list[str]) -> Column:
    """Map of the non-null columns of a row, as text."""
    entries = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("string") for c in columns]))
    return F.map_filter(entries, lambda k, v: v.isNotNull())
