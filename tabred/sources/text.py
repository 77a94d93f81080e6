"""Delimited text sources: dbgen tables, pipe files with header, wide record files, graph files."""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabred.schemas import TBL_SCHEMAS
from tabred.sources.typed import KIND_OF, cast_checked

BOM = "﻿"


def read_tbl(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of a ``|``-delimited file without header or quoting.

    A line has exactly the table's fields and one empty field after the last bar; spaces are data.
    """
    schema = TBL_SCHEMAS[table]
    width = len(schema.names)
    fields = F.split("value", r"\|", -1)
    lines = spark.read.text(path).withColumn("f", fields)
    fits = (F.size("f") == width + 1) & (F.get("f", F.lit(width)) == "")
    text = lines.where(fits).select("value", *[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(schema.names)])
    good, bad = cast_checked(text, {f.name: KIND_OF[f.dataType] for f in schema.fields})
    rejected = lines.where(~fits).select("value", F.lit("wrong number of fields").alias("reason")).unionByName(bad.select("value", "reason"))
    return good.select(*schema.names), rejected


def write_tbl(df: DataFrame, path: str) -> None:
    """The same format as a sink."""
    df.select(F.concat(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit("|"))).write.mode("overwrite").text(path)


def read_pipe_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All-text rows of a ``|`` file whose header must equal ``columns``; empty and NULL are null. A byte-order mark is allowed."""
    header = "|".join(columns)
    lines = spark.read.text(path)
    first = lines.head()
    if first is None or first["value"].removeprefix(BOM) != header:
        raise ValueError(f"header of {path} is not {header}")
    parts = lines.where(~F.col("value").isin(header, BOM + header)).withColumn("f", F.split("value", r"\|", -1))
    checked = parts.withColumn("f", F.when(F.size("f") == len(columns), F.col("f")).otherwise(
        F.raise_error(F.concat(F.lit("wrong number of fields: "), F.col("value"))).cast("array<string>")))
    return checked.select(*[F.when(~F.get("f", F.lit(i)).isin("", "NULL"), F.get("f", F.lit(i))).alias(c) for i, c in enumerate(columns)])


def header_name(name: str) -> str:
    """Lower case, with spaces and slashes as underscores."""
    return re.sub(r"[ /]", "_", name.strip().removeprefix(BOM).lower())


def read_record_csv(spark: SparkSession, path: str) -> DataFrame:
    """Wide comma file: all columns text, empty text kept, header names normalised."""
    df = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
          .option("emptyValue", "").option("nullValue", "\u0000").csv(path))
    return df.toDF(*map(header_name, df.columns)).fillna("")


def _graph_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def read_graph_csv(spark: SparkSession, node_files: list[tuple[str, str]], rel_file: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of node files per label, in order of precedence, and one relationship file.

    A node id in several files keeps the properties of the first file and all labels. Edges with an
    unknown end are dropped.
    """
    files = [_graph_csv(spark, path).withColumns({"label": F.lit(label), "_rank": F.lit(i)}) for i, (label, path) in enumerate(node_files)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), files)
    rest = [c for c in rows.columns if c not in ("node_id", "label", "_rank")]
    nodes = rows.groupBy("node_id").agg(F.array_sort(F.collect_set("label")).alias("labels"),
                                        F.min_by(F.struct(*rest), F.struct("_rank", F.xxhash64(*rest))).alias("p")).select("node_id", "labels", "p.*")
    edges = _graph_csv(spark, rel_file).select(F.col("node_id_start").alias("src"), F.col("node_id_end").alias("dst"), F.col("rel_type").alias("type"))
    known = nodes.select(F.col("node_id").alias("_n"))
    return nodes, (edges.join(known, F.col("src") == F.col("_n"), "left_semi").join(known, F.col("dst") == F.col("_n"), "left_semi"))
