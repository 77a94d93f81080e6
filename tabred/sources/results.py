"""Result records in and out, and fingerprints of source files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed formats of the three kinds of result records.
SCHEMAS = {
    "query": "query_id long, template string, strategy string, mv_create_time_ms double, baseline struct<client_time_ms: double, server_time_ms: double>, "
             "template_result struct<status: string, client_time_ms: double, client_time_lower_bound_ms: double, server_time_ms: double>",
    "fold": "mask long, folded_edges array<string>, terminal_relations array<string>, structural_delta struct<delta_nodes: long, delta_relationships: long, delta_property_cells: long>, "
            "updates map<string, struct<min_ms: double, median_ms: double, max_ms: double, samples: array<struct<`group`: long, `key`: string, a0: string, a1: string, touched_nodes: long, elapsed_ms: double>>, "
            "normalized_update: struct<median_ms: double>, normalization_save: struct<median_ms: double>>>, normalization struct<elapsed_ms: double>",
    "fd_update": "fd string, valid_groups long, redundant_values long, normalization_seconds double, cases array<struct<`key`: string, copies: long, d_median_ms: double, n_median_ms: double>>",
}


def read_results(spark: SparkSession, path: str, kind: str, multi_line: bool = True) -> DataFrame:
    """Nested JSON result files as rows of a fixed schema."""
    return spark.read.schema(SCHEMAS[kind]).option("multiLine", multi_line).json(path)


def write_results(df: DataFrame, path: str, format_: str = "json") -> None:
    """Result records or report tables; the committer replaces the folder as a whole."""
    df.write.mode("overwrite").format(format_).save(path)


def source_manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """[path, length, sha256] per text file of any size.

    Every line is hashed on its own, the hashes are added, and the sums are hashed again, so no file has
    to fit into one row or one task.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.length("value").alias("n"),
                                          F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h"),
                                          F.conv(F.substring(F.sha2("value", 256), 16, 15), 16, 10).cast("decimal(38,0)").alias("h2"))
    return (lines.groupBy("path").agg(F.sum(F.col("n") + 1).alias("length"), F.sum("h").alias("h"), F.sum("h2").alias("h2"))
            .select("path", "length", F.sha2(F.concat_ws(":", F.col("h").cast("string"), F.col("h2").cast("string")), 256).alias("sha256")))


def check_release(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Files whose fingerprint differs from the recorded one, or that only one side has: empty for the same release."""
    old = recorded.select("path", F.col("sha256").alias("recorded"))
    return current.select("path", "sha256").join(old, "path", "full").where(~F.col("sha256").eqNullSafe(F.col("recorded")))
