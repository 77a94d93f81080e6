"""Typed conversion of text columns with rejection, and retry-safe loads."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def cast_text(column: str, kind: str) -> Column:
    """Text to a type; null where the text is no valid value. Kinds: int, float, date, boolean, datetime, text."""
    raw = F.col(column)
    if kind == "int":
        return F.when(raw.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(raw).try_cast("long"))
    if kind == "float":
        value = F.trim(raw).try_cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
    if kind == "date":
        return F.when(raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), raw.try_cast("date"))
    if kind == "boolean":
        low = F.lower(F.trim(raw))
        return F.when(low.isin("1", "true"), True).when(low.isin("0", "false"), False)
    if kind == "datetime":
        return F.when(raw.try_cast("timestamp").isNotNull(), raw)
    return raw


KIND_OF = {T.LongType(): "int", T.DoubleType(): "float", T.DateType(): "date", T.StringType(): "text"}


def cast_checked(df: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows where every filled text converts, and the others with a ``reason``."""
    failed = [F.when(F.col(c).isNotNull() & cast_text(c, k).isNull(), F.lit(f"{c} is no {k}")) for c, k in kinds.items() if k != "text"]
    reason = F.concat_ws("; ", *failed) if failed else F.lit("")
    marked = df.withColumn("reason", reason)
    good = marked.where(F.col("reason") == "").select(*[cast_text(c, kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])
    return good, marked.where(F.col("reason") != "")


def upsert_by_key(target: DataFrame, batch: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Merge by key: new rows come in, a filled new value replaces the old one. Repeating a batch changes nothing.

    Of several rows of a key in a batch, each column takes the last filled value by ``order``, or the greatest one
    where no order is given.
    """
    others = [c for c in batch.columns if c not in keys]
    last = [(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if order else F.max(c)).alias(f"_n_{c}") for c in others]
    new = batch.groupBy(*[F.col(k).alias(f"_n_{k}") for k in keys]).agg(*last) if others else batch.select(*[F.col(k).alias(f"_n_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_n_{k}") for k in keys])
    merged = [F.coalesce(f"_n_{c}", c).alias(c) if c in batch.columns else F.col(c) for c in target.columns]
    return target.join(new, same, "full").select(*merged)
