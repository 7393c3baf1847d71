"""The driver's queries for this folder: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfolk.llm.sharding import assign

    return assign(_table(spark, sf_dir, "documents"), shards=8)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfolk.llm.exact_dedup import decide

    return decide(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op10_exact_dedup": """
            WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, text_sha256
            FROM d WINDOW w AS (PARTITION BY text_sha256)
        """,
    }


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfolk.llm.chat import digest, render

    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return digest(render(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfolk.llm.warc import archive_round_trip

    return archive_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfolk.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op2_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfolk.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfolk.llm.langid import id_crc
    from kinfolk.llm.lm_scoring import score

    return score(_table(spark, sf_dir, "documents"), id_crc("doc_id") % 7 == 2)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfolk.llm.ngram_join import jaccard_links

    return jaccard_links(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfolk.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited crops of every 20th vector's picture, searched among the pictures of all vectors.

    ``link`` rows pair a query with a class of equal pictures; ``member`` rows give each picture's class.
    """
    from pyspark.sql import functions as F

    from kinfolk.llm.images import find_copies, pictures

    vectors = _table(spark, sf_dir, "embeddings")
    links, members = find_copies(pictures(vectors.where(F.col("vec_id") % 20 == 0), edit=True), pictures(vectors))
    found = ["n_matches", "shift_y", "shift_x", "scale", "turn"]
    kinds = dict(links.dtypes)
    rows = links.select(F.lit("link").alias("kind"), "query_id", "class_id", F.lit(None).cast("long").alias("image_id"), *found)
    member = members.select(F.lit("member").alias("kind"), F.lit(None).cast("long").alias("query_id"), "class_id", "image_id", *(F.lit(None).cast(kinds[c]).alias(c) for c in found))
    return rows.unionByName(member)
