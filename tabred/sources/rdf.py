"""RDF line files as triples, and entities assembled from them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values of the RDF vocabulary, and property names that carry no attribute.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
XSD_STRING = "http://www.w3.org/2001/XMLSchema#string"
RDF_LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
_LINE = r'^<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*$'


def _unescape(text: Column) -> Column:
    """The short escapes of a quoted literal; the backslash itself last."""
    mark = F.lit("\u0001")
    out = F.replace(text, F.lit("\\\\"), mark)
    for short, char in (("\\\"", '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r")):
        out = F.replace(out, F.lit(short), F.lit(char))
    return F.replace(out, mark, F.lit("\\"))


def read_triples(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(triples, rejected lines) of a file of one kind: types, labels, literals or objects.

    Triples: [subject, predicate, object, datatype, language]. Compressed files are split by Spark where
    the codec allows it. A line that is no statement of the kind is kept apart with its text.
    """
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    part = lambda i: F.regexp_extract("value", _LINE, i)
    parsed = lines.select("value", F.col("value").rlike(_LINE).alias("ok"), part(1).alias("subject"), part(2).alias("predicate"),
                          part(3).alias("iri"), part(4).alias("text"), part(5).alias("type"), part(6).alias("lang"))
    literal = F.col("iri") == ""
    role = {"types": ~literal & (F.col("predicate") == RDF_TYPE), "objects": ~literal & (F.col("predicate") != RDF_TYPE),
            "literals": literal, "labels": literal & (F.col("predicate") == RDFS_LABEL)}[kind]
    language = F.when(literal & (F.col("lang") != ""), F.col("lang"))
    datatype = F.when(literal, F.when(F.col("lang") != "", F.lit(RDF_LANG_STRING)).when(F.col("type") != "", F.col("type")).otherwise(F.lit(XSD_STRING)))
    good = parsed.where(F.col("ok") & role).select("subject", "predicate", F.when(literal, _unescape(F.col("text"))).otherwise(F.col("iri")).alias("object"),
                                                   datatype.alias("datatype"), language.alias("language"))
    return good, parsed.where(~(F.col("ok") & role)).select("value")


def assemble_entities(triples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(types, literals, edges), each without repeated statements.

    Literals keep their identity of value, datatype and language. They stay in long form, one row per
    term, so an entity or class with very many terms is never collected into one row.
    """
    distinct = triples.dropDuplicates(["subject", "predicate", "object", "datatype", "language"])
    types = distinct.where(F.col("predicate") == RDF_TYPE).select("subject", F.col("object").alias("class"))
    literals = distinct.where(F.col("datatype").isNotNull())
    edges = distinct.where(F.col("datatype").isNull() & (F.col("predicate") != RDF_TYPE)).select("subject", "predicate", "object")
    return types, literals, edges


def short_uri(column: str) -> Column:
    """Last part of a URI, percent-decoded."""
    return F.try_url_decode(F.replace(F.regexp_extract(column, r"([^/#]*)$", 1), F.lit("+"), F.lit("%2B")))


def literal_json(predicate: str, value: str, datatype: str, language: str) -> Column:
    """A term with its predicate as one JSON text."""
    return F.to_json(F.array(predicate, value, datatype, language))


def parse_literal(column: str) -> Column:
    """Struct [predicate, value, datatype, language] of that JSON text."""
    parts = F.from_json(column, "array<string>")
    return F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("predicate", "value", "datatype", "language"))])
