"""The supplied tables in the roles of the data model, as frames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators.temporal import supersede
from palimpsest.runtime import read_table


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as facts: one statement per customer and priority, each superseded by the next."""
    o = read_table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("user:"), F.col("o_custkey").cast("string")).alias("scope"), F.col("o_orderpriority").alias("statement_key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("valid_from"))
    return supersede(rows, ["scope", "statement_key"], ["valid_from", "id"])


FACTS = """facts AS (SELECT o_orderkey AS id, 'user:' || o_custkey AS scope, o_orderpriority AS statement_key, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS valid_from,
  lead(o_orderdate) OVER w AS valid_to, lead(o_orderkey) OVER w AS superseded_by FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey))"""


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as episodes: an hour apart in the order of their ids."""
    d = read_table(spark, sf_dir, "documents")
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("doc_id").cast("int"))
    return d.select(F.col("doc_id").alias("id"), F.concat(F.lit("user:"), "source").alias("scope"), F.col("text").alias("content"), F.concat("source", F.lit(":"), F.col("doc_id").cast("string")).alias("source_ref"), "lang", at.alias("created_at"))


EPISODES = """episodes AS (SELECT doc_id AS id, 'user:' || source AS scope, text AS content, source || ':' || doc_id AS source_ref, lang, TIMESTAMP '2024-01-01' + to_hours(doc_id::INT) AS created_at FROM documents)"""


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as edges from parts (even ids) to suppliers (odd ids)."""
    x = read_table(spark, sf_dir, "lineitem")
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("edge_id"), (F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"), F.col("l_returnflag").alias("rel_type"))


PART_EDGES = """edges AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst, l_returnflag AS rel_type FROM lineitem)"""


def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> order -> part -> supplier, by names."""
    o, x = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = (o.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")), x.select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst")), x.select(name("p", "l_partkey").alias("src"), name("s", "l_suppkey").alias("dst")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.withColumn("edge_id", F.concat_ws(">", "src", "dst"))


CHAIN_EDGES = """edges AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with the text of the turn before."""
    t = read_table(spark, sf_dir, "conversations")
    return t.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))


TURNS = """turns AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"""
