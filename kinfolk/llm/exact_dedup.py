"""Exact de-duplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is first reduced to one row per digest
(partial aggregation runs before the shuffle, so a text that makes up a third of all rows costs one
row per task), then a sort-merge anti-join finds the digests the index lacks, and those are
appended. DataFrame and SQL functions only.

Defined results
---------------
* Null text counts as the empty text; the empty text is a text like any other.
* Of equal texts the row with the largest ``doc_id`` stays; a null id is smaller than every other.
  Rows that tie on the id as well are told apart by their position in the input: the first stays.
* A text that the index already holds keeps the row that brought it in; no row of the new batch stays.
* Empty input gives an empty result and leaves the index as it is. Extra columns are carried, whatever
  their names, by ``drop_duplicates``; ``decide`` returns its own columns only.
* Row positions come from ``monotonically_increasing_id`` over the input, so the input must be
  deterministic: a table scan, or a stored table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolk.llm.storage import fresh_path, stored

_ROW = "__xd_row"


class DigestIndex:
    """Table ``(digest string, keep_id long, batch string)``, bucketed and sorted by digest.

    The location outlives the session: opening the same location again declares the table anew over
    the files that are there.
    """

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.location = location or fresh_path(spark, "digest-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"kinfolk_digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest STRING, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append_new(self, groups: DataFrame, batch: str) -> None:
        """Sort-merge anti-join of the batch's digests with the index; what is left is appended."""
        new = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        new.select("digest", "keep_id", F.lit(batch).alias("batch")).write.insertInto(self.table)


def digest_of(text) -> F.Column:
    """SHA-256 of the text in UTF-8, lowercase hex; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        digest_of(F.col(text_col)).alias("digest"),
        F.monotonically_increasing_id().alias(_ROW),
    )


def _groups(rows: DataFrame) -> DataFrame:
    top = F.max(F.struct(F.col("doc_id"), (-F.col(_ROW)).alias("r")))
    return rows.groupBy("digest").agg(top.alias("top"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("top.doc_id").alias("keep_id"), (-F.col("top.r")).alias("keep_row"), "group_size"
    )


def ingest(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put a batch's digests into the index; return one row per digest of the batch.

    Columns: digest, keep_id, keep_row (position of the row that stays, null if the index held the
    text before), group_size.
    """
    batch = uuid.uuid4().hex
    groups = stored(_groups(_rows(docs, id_col, text_col)), "digest-groups")
    index.append_new(groups, batch)
    held = index.read().select("digest", F.col("keep_id").alias("__held_id"), "batch")
    return groups.join(held, "digest").select(
        "digest",
        F.col("__held_id").alias("keep_id"),
        F.when(F.col("batch") == batch, F.col("keep_row")).alias("keep_row"),
        "group_size",
    )


def decide(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    index = index or DigestIndex(docs.sparkSession)
    groups = stored(ingest(docs, index, id_col, text_col), "digest-decisions")
    # Both sides come from plain shuffles on the digest, so adaptive execution splits a hot digest.
    return _rows(docs, id_col, text_col).join(groups.hint("merge"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col(_ROW) == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    index = index or DigestIndex(docs.sparkSession)
    mark = "__xd"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    row, digest, stay_digest, stay_row = (f"{mark}_{x}" for x in ("row", "digest", "stay_digest", "stay_row"))
    stay = stored(
        ingest(docs, index, id_col, text_col).where(F.col("keep_row").isNotNull()).select(
            F.col("digest").alias(stay_digest), F.col("keep_row").alias(stay_row)
        ),
        "digest-stay",
    )
    rows = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(digest, digest_of(F.col(text_col)))
    # The digest is the join key and the position a filter on top of it: two keys would hash a hot
    # text's rows apart, yet this way the single staying row is found whatever its partition.
    kept = rows.join(stay.hint("merge"), (F.col(digest) == F.col(stay_digest)) & (F.col(row) == F.col(stay_row)), "left_semi")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
