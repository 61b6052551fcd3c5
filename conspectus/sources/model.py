"""The concept-index tables, read from the star-schema and text tables.

videos from orders, concepts from part (a concept's root is the least id of its
name), occurrences from lineitem, transcripts from conversations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Occurrences at least this significant explain a concept; others mention it.
COMPREHENSIVE = 2.5
#: Occurrences at least this significant enter the search index.
INDEXED = 1.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("video_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("language"),
        ((F.col("o_orderkey") % 11) / 10.0).alias("ratio"), F.col("o_orderdate").alias("indexed_at"),
    )


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """concept_id, text, domain, root, canonical (null for roots). Names are few: their roots are found by a partial aggregate."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("text"), F.col("p_type").alias("domain"))
    roots = p.groupBy("text").agg(F.min("concept_id").alias("root"))
    return p.join(roots, "text").select("concept_id", "text", "domain", "root", F.when(F.col("concept_id") != F.col("root"), F.col("root")).alias("canonical"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    return item.select(
        F.col("l_partkey").alias("concept_id"), F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("segment_pos"),
        (F.col("l_quantity") / 10).alias("significance"), (F.col("l_linenumber") * 10.0).alias("start_time"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, pos, start, duration, text: one row per turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("pos"), (F.col("turn") * 10.0).alias("start"), F.lit(10.0).alias("duration"), "role", "text")


def prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src needs dst: every concept needs the one of half its id."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("long").alias("dst")).filter("dst >= 1")


#: The same tables as SQL, for the oracle side.
SQL = {
    "videos": "videos AS (SELECT o_orderkey AS video_id, o_orderpriority AS title, o_orderstatus AS language, (o_orderkey % 11) / 10.0 AS ratio, o_orderdate AS indexed_at FROM orders)",
    "concepts": "concepts AS (SELECT p_partkey AS concept_id, p_name AS text, p_type AS domain, root, CASE WHEN p_partkey <> root THEN root END AS canonical FROM part JOIN (SELECT p_name AS n, min(p_partkey) AS root FROM part GROUP BY p_name) ON n = p_name)",
    "occ": "occ AS (SELECT l_partkey AS concept_id, l_orderkey AS video_id, l_linenumber AS segment_pos, l_quantity / 10 AS significance, l_linenumber * 10.0 AS start_time FROM lineitem)",
    "transcripts": "transcripts AS (SELECT conv_id AS video_id, turn AS pos, turn * 10.0 AS start, 10.0 AS duration, role, text FROM conversations)",
}


def with_sql(names: str, query: str) -> str:
    """The query behind the named tables; a query that starts with a comma brings more of its own."""
    return f"WITH {', '.join(SQL[n] for n in names.split())}{query if query[0] == ',' else ' ' + query}"
