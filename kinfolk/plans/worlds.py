"""The tables that the registered queries see: records, scored pairs and vectors made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: every third one asks, the others are indexed; names are all words of the
    text, addresses its tokens with digits and the source."""
    low = F.lower("text")
    found = lambda p: F.regexp_extract_all(low, F.lit(p), F.lit(0))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("rec_id"), F.when(F.col("doc_id") % 3 == 0, "q").otherwise("i").alias("side"), (F.col("doc_id") % 3 + 1).alias("src"), F.col("lang").alias("ckey"), "source", "text",
        found("[a-z]+").alias("name"), F.concat(found("[a-z]*[0-9]+[a-z0-9]*"), F.array("source")).alias("address"), found("[0-9]+").alias("nums"), F.md5(F.col("text").cast("binary")).alias("whole"),
    )


DOCUMENTS = """d AS (SELECT doc_id AS rec_id, CASE WHEN doc_id % 3 = 0 THEN 'q' ELSE 'i' END AS side, doc_id % 3 + 1 AS src, lang AS ckey, source, text,
    regexp_extract_all(lower(text), '[a-z]+') AS name, list_append(regexp_extract_all(lower(text), '[a-z]*[0-9]+[a-z0-9]*'), source) AS address,
    regexp_extract_all(lower(text), '[0-9]+') AS nums, md5(text) AS whole FROM documents)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and parts as scored pairs; a returned line makes the pair a true one."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("q_id"), F.col("l_partkey").alias("i_id")).agg(
        F.round(F.max("l_discount") * 10, 6).alias("p"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"), F.max("l_quantity").alias("qty"), F.max(F.col("l_linenumber")).alias("line"))


PAIRS = """p AS (SELECT l_orderkey AS q_id, l_partkey AS i_id, round(max(l_discount) * 10, 6) AS p, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y,
    max(l_quantity) AS qty, max(l_linenumber) AS line FROM lineitem GROUP BY 1, 2)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q_id"), F.col("o_orderpriority").alias("country"))


ORDERS = "e AS (SELECT o_orderkey AS q_id, o_orderpriority AS country FROM orders)"


def true_pairs(scored: DataFrame) -> DataFrame:
    return scored.where("y = 1").select("q_id", "i_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec_id"), F.col("embedding").alias("vec"), F.col("label").alias("label"))


def vector_truth(rows: DataFrame) -> DataFrame:
    """Each query's next four vectors, where they have its label."""
    q = rows.where("rec_id % 5 = 0").select(F.col("rec_id").alias("q_id"), F.col("label").alias("ql"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("j"))
    return q.withColumn("i_id", F.col("q_id") + F.col("j")).join(rows.select(F.col("rec_id").alias("i_id"), "label"), "i_id").where("ql = label").select("q_id", "i_id")


VECTORS = """v AS (SELECT vec_id AS rec_id, embedding::DOUBLE[] AS vec, label FROM embeddings),
    e AS (SELECT rec_id AS q_id, cast(label AS VARCHAR) AS country FROM v WHERE rec_id % 5 = 0),
    t AS (SELECT q.rec_id AS q_id, i.rec_id AS i_id FROM v q JOIN v i ON i.rec_id > q.rec_id AND i.rec_id <= q.rec_id + 4 AND i.label = q.label WHERE q.rec_id % 5 = 0),
    n AS (SELECT q.rec_id AS q_id, i.rec_id AS i_id, round(list_dot_product(q.vec, i.vec), 5) AS cosine FROM v q, v i WHERE q.rec_id % 5 = 0 AND i.rec_id % 5 <> 0),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY cosine DESC, i_id) AS rank FROM n) WHERE rank <= 10)"""
