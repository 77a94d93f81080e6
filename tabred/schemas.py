"""Table structures, keys and references that the operators share."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_L, _I, _D, _S, _DT = (T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.DateType())


def _struct(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols])


# The eight TPC-H tables as dbgen writes them.
TBL_SCHEMAS: dict[str, T.StructType] = {
    "region": _struct(("r_regionkey", _L), ("r_name", _S), ("r_comment", _S)),
    "nation": _struct(("n_nationkey", _L), ("n_name", _S), ("n_regionkey", _L), ("n_comment", _S)),
    "supplier": _struct(("s_suppkey", _L), ("s_name", _S), ("s_address", _S), ("s_nationkey", _L),
                        ("s_phone", _S), ("s_acctbal", _D), ("s_comment", _S)),
    "customer": _struct(("c_custkey", _L), ("c_name", _S), ("c_address", _S), ("c_nationkey", _L),
                        ("c_phone", _S), ("c_acctbal", _D), ("c_mktsegment", _S), ("c_comment", _S)),
    "part": _struct(("p_partkey", _L), ("p_name", _S), ("p_mfgr", _S), ("p_brand", _S), ("p_type", _S),
                    ("p_size", _L), ("p_container", _S), ("p_retailprice", _D), ("p_comment", _S)),
    "partsupp": _struct(("ps_partkey", _L), ("ps_suppkey", _L), ("ps_availqty", _L),
                        ("ps_supplycost", _D), ("ps_comment", _S)),
    "orders": _struct(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S), ("o_totalprice", _D),
                      ("o_orderdate", _DT), ("o_orderpriority", _S), ("o_clerk", _S),
                      ("o_shippriority", _L), ("o_comment", _S)),
    "lineitem": _struct(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L), ("l_linenumber", _L),
                        ("l_quantity", _D), ("l_extendedprice", _D), ("l_discount", _D), ("l_tax", _D),
                        ("l_returnflag", _S), ("l_linestatus", _S), ("l_shipdate", _DT),
                        ("l_commitdate", _DT), ("l_receiptdate", _DT), ("l_shipinstruct", _S),
                        ("l_shipmode", _S), ("l_comment", _S)),
}


@dataclass(frozen=True)
class Reference:
    """A foreign key: ``source.fields`` names the key of ``target``."""
    code: str
    source: str
    target: str
    fields: tuple[str, ...]


# Table codes, and references in the order of the mask bits.
TABLE_OF = {"L": "lineitem", "PS": "partsupp", "P": "part", "O": "orders",
            "C": "customer", "S": "supplier", "N": "nation", "R": "region"}
REFERENCES = (
    Reference("L_PS", "L", "PS", ("l_partkey", "l_suppkey")),
    Reference("L_O", "L", "O", ("l_orderkey",)),
    Reference("PS_P", "PS", "P", ("ps_partkey",)),
    Reference("PS_S", "PS", "S", ("ps_suppkey",)),
    Reference("O_C", "O", "C", ("o_custkey",)),
    Reference("C_N", "C", "N", ("c_nationkey",)),
    Reference("S_N", "S", "N", ("s_nationkey",)),
    Reference("N_R", "N", "R", ("n_regionkey",)),
)
REFERENCE_BY_CODE = {r.code: r for r in REFERENCES}

# dbgen numbers the lines of an order. The driver's lineitem repeats line numbers, so there the part,
# the supplier and the quantity complete the key (see README).
TPCH_KEYS = {"L": ("l_orderkey", "l_linenumber"), "PS": ("ps_partkey", "ps_suppkey"),
             "P": ("p_partkey",), "O": ("o_orderkey",), "C": ("c_custkey",), "S": ("s_suppkey",),
             "N": ("n_nationkey",), "R": ("r_regionkey",)}
KEYS = {**TPCH_KEYS, "L": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")}

# Columns whose values the update experiments change.
UPDATE_COLUMN = {"PS": "ps_comment", "P": "p_comment", "O": "o_comment", "C": "c_comment",
                 "S": "s_comment", "N": "n_comment", "R": "r_comment"}


def mask_codes(mask: int) -> tuple[str, ...]:
    """Reference codes whose bit is set in ``mask`` (0-255)."""
    if not 0 <= mask < 1 << len(REFERENCES):
        raise ValueError(f"mask {mask} is outside 0-{(1 << len(REFERENCES)) - 1}")
    return tuple(r.code for i, r in enumerate(REFERENCES) if mask >> i & 1)


def mask_of(*codes: str) -> int:
    order = [r.code for r in REFERENCES]
    return sum(1 << order.index(c) for c in codes)
