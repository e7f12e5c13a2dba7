"""The canonical graph of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.clustering import given
from quillon.operators.graph import as_edges, auto_link
from quillon.session import Scratch

AS_OF = 1706659200
NEVER = 1704067200
LINK_AT = 0.3


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, content, embedding, significance, access_count, last_access_ts."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("short").alias("significance"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    a = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', max(ts))").alias("t"))
    rows = e.join(d, "id", "left").join(a, "id", "left")
    return rows.select("id", F.coalesce("text", F.concat(F.lit("Node "), F.col("id").cast("string"))).alias("content"), "embedding", "significance", F.coalesce("n", F.lit(0)).alias("access_count"), F.coalesce("t", F.lit(NEVER)).cast("long").alias("last_access_ts"))


def scored_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nodes without their contents, for what doesn't show them."""
    e = vectors(spark, sf_dir)
    a = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', max(ts))").alias("t"))
    return e.join(a, "id", "left").select("id", "embedding", "significance", F.coalesce("n", F.lit(0)).alias("access_count"), F.coalesce("t", F.lit(NEVER)).cast("long").alias("last_access_ts"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("short").alias("significance"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auto_link(vectors(spark, sf_dir), LINK_AT)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As written once, however often they are read."""
    return Scratch(spark).save(as_edges(links(spark, sf_dir)))


def clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ten roots by significance, each in five parts by id."""
    s = F.col("significance").cast("long")
    return given(vectors(spark, sf_dir), s, s * 5 + 10 + F.col("id") % 5)


def query_vector(spark: SparkSession, sf_dir: str, node: int) -> list[float]:
    row = vectors(spark, sf_dir).where(F.col("id") == node).select("embedding").first()
    return list(row["embedding"]) if row else []


def mean_vector(spark: SparkSession, sf_dir: str, significance: int) -> list[float]:
    each = vectors(spark, sf_dir).where(F.col("significance") == significance).select(F.posexplode("embedding").alias("i", "x"))
    return [r["x"] for r in each.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x")).orderBy("i").collect()]
