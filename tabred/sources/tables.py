"""Scan of the parquet tables, and the view that completes them to the TPC-H columns."""
from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabred.session import scan, stored

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed values of the TPC-H text columns that the driver tables lack.
SHIP_MODES = ("REG AIR", "AIR", "RAIL", "SHIP", "TRUCK", "MAIL", "FOB")
SHIP_INSTRUCTIONS = ("DELIVER IN PERSON", "COLLECT COD", "NONE", "TAKE BACK RETURN")
COMMENT_WORDS_1 = ("special", "pending", "unusual", "express")
COMMENT_WORDS_2 = ("packages", "requests", "accounts", "deposits")
CONTAINERS = ("SM CASE", "SM BOX", "SM PACK", "SM PKG", "MED BAG", "MED BOX", "MED PKG", "MED PACK",
              "LG CASE", "LG BOX", "LG PACK", "LG PKG")


def load_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """One lazily read DataFrame per parquet table."""
    return {n: scan(spark, f"{folder}/{n}.parquet") for n in names or DRIVER_TABLES}


def pick(values: tuple[str, ...], index: Column) -> Column:
    """Element ``index`` (from 0) of a fixed list."""
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def _text(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _partsupp(lineitem: DataFrame) -> DataFrame:
    key = F.col("ps_partkey") * 31 + F.col("ps_suppkey") * 17
    return (lineitem
            .groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey"))
            .agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
            .select("ps_partkey", "ps_suppkey",
                    (key % 40 + 1).cast("int").alias("ps_availqty"),
                    (F.floor(F.col("unit") * 100) / 100.0).alias("ps_supplycost"),
                    F.concat(F.lit("partsupp "), F.col("ps_partkey").cast("string"), F.lit(" "),
                             F.col("ps_suppkey").cast("string")).alias("ps_comment")))


class View(Mapping):
    """Tables by name, each made when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]) -> None:
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


_views: dict[tuple[str, str], View] = {}


def tpch_view(spark: SparkSession, folder: str) -> Mapping[str, DataFrame]:
    """The view of :func:`_tpch_view`, planned once per application and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _views:
        _views[key] = _tpch_view(spark, folder)
    return _views[key]


def _tpch_view(spark: SparkSession, folder: str) -> View:
    """The eight TPC-H tables over the driver's seven.

    Missing columns follow from keys by fixed row-local formulas, which Catalyst prunes when unused.
    ``partsupp`` is built from the part-supplier pairs of ``lineitem`` and written once per
    application, when a query first needs it. Dates stay as stored, so date filters still reach the parquet scan.
    """
    raw = View({n: lambda n=n: scan(spark, f"{folder}/{n}.parquet") for n in DRIVER_TABLES})
    ship = F.col("l_shipdate").cast("date")
    order, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    okey = F.col("o_orderkey")
    return View({
        "region": lambda: raw["region"].withColumn("r_comment", _text("region ", "r_regionkey")),
        "nation": lambda: raw["nation"].withColumn("n_comment", _text("nation ", "n_nationkey")),
        "supplier": lambda: raw["supplier"].withColumns({
            "s_address": _text("supplier street ", "s_suppkey"),
            "s_phone": F.concat((F.col("s_nationkey") + 10).cast("string"), F.lit("-"),
                                F.col("s_suppkey").cast("string")),
            "s_comment": F.when(F.col("s_suppkey") % 10 == 0, F.lit("Customer slow Complaints"))
                          .otherwise(_text("supplier ", "s_suppkey"))}),
        "customer": lambda: raw["customer"].withColumns({
            "c_address": _text("customer street ", "c_custkey"),
            "c_phone": F.concat((F.col("c_nationkey") + 10).cast("string"), F.lit("-"),
                                F.col("c_custkey").cast("string")),
            "c_comment": _text("customer ", "c_custkey")}),
        "part": lambda: raw["part"].withColumns({
            "p_mfgr": F.concat(F.lit("Manufacturer#"), (F.col("p_partkey") % 5 + 1).cast("string")),
            "p_container": pick(CONTAINERS, F.col("p_partkey") % 12),
            "p_comment": _text("part ", "p_partkey")}),
        "orders": lambda: raw["orders"].withColumns({
            "o_clerk": F.concat(F.lit("Clerk#"), (F.col("o_custkey") % 1000).cast("string")),
            "o_shippriority": F.lit(0),
            "o_comment": F.when(okey % 5 == 0, F.concat(
                pick(COMMENT_WORDS_1, okey % 4), F.lit(" filler "),
                pick(COMMENT_WORDS_2, F.floor(okey / 4) % 4))).otherwise(F.lit("plain text"))}),
        "lineitem": lambda: raw["lineitem"].withColumns({
            "l_commitdate": F.date_add(ship, ((part * 7 + supp * 3 + F.col("l_linenumber")) % 61 - 30).cast("int")),
            "l_receiptdate": F.date_add(ship, ((order + part) % 30 + 1).cast("int")),
            "l_shipmode": pick(SHIP_MODES, (order + part) % 7),
            "l_shipinstruct": pick(SHIP_INSTRUCTIONS, supp % 4),
            "l_comment": _text("line ", "l_orderkey")}),
        "partsupp": lambda: stored(spark, "partsupp", folder, lambda: _partsupp(raw["lineitem"])),
    })
