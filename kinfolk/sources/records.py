"""Record tables, truth lists and id lists as tab-separated text: readers, writer and checks.

The format has no quoting, so lines are read as text: a quote is a character like any other, and extra tabs
belong to the address.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COLUMNS = ("entity_id", "business_name", "business_address", "country")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, at): lines without byte order mark, line ends and each file's first line, the header; ``at`` orders by file and place."""
    place = F.struct(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    raw = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff|\r$", "").alias("line"), place.alias("at"))
    # The first line of a file is the least place of the split that begins the file.
    heads = raw.where("at.block = 0").groupBy("at.file").agg(F.min("at.place").alias("head"))
    rows = raw.join(F.broadcast(heads.withColumnRenamed("file", "__file")), F.col("at.file") == F.col("__file"))
    return rows.where((F.col("line") != "") & (F.col("at.place") != F.col("head"))).select("line", "at")


def first_of_id(rows: DataFrame, key: str = "entity_id", at: str = "at") -> DataFrame:
    """The first row of each id; blank ids leave."""
    w = W.partitionBy(key).orderBy(at)
    return rows.where(F.coalesce(F.col(key), F.lit("")) != "").withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """Records with all four columns; columns are found by name, missing ones are empty, entity_id must be there."""
    header = [h.strip().lower() for h in spark.read.text(path).first()[0].lstrip("﻿").rstrip("\r").split("\t")]
    if "entity_id" not in header:
        raise ValueError("no column entity_id")
    cells = F.split("line", "\t", -1)
    if tuple(header) == COLUMNS:  # extra tabs are part of the address
        size = F.size("__c")
        address = F.when(size > 4, F.array_join(F.slice("__c", F.lit(3), size - 3), " ")).otherwise(F.get("__c", F.lit(2)))
        country = F.when(size > 4, F.get("__c", size - 1)).otherwise(F.get("__c", F.lit(3)))
        values = {"entity_id": F.get("__c", F.lit(0)), "business_name": F.get("__c", F.lit(1)), "business_address": address, "country": country}
    else:
        values = {c: F.get("__c", F.lit(header.index(c))) if c in header else F.lit("") for c in COLUMNS}
    rows = _lines(spark, path).withColumn("__c", cells)
    rows = rows.select("at", *(F.trim(F.coalesce(v, F.lit(""))).alias(c) for c, v in values.items()))
    return first_of_id(rows).drop("at")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(q_id, ids): the last line of a query counts; blanks between commas leave."""
    cells = F.split("line", "\t", -1)
    rows = _lines(spark, path).select("at", F.trim(F.get(cells, F.lit(0))).alias("q_id"), F.coalesce(F.get(cells, F.lit(1)), F.lit("")).alias("list"))
    last = W.partitionBy("q_id").orderBy(F.col("at").desc())
    rows = rows.withColumn("__n", F.row_number().over(last)).where(F.col("__n") == 1)
    return rows.select("q_id", F.filter(F.transform(F.split("list", ","), lambda x: F.trim(x)), lambda x: x != "").alias("ids"))


def truth_pairs(truth: DataFrame) -> DataFrame:
    return truth.select("q_id", F.explode("ids").alias("i_id"))


def combine_index(second: DataFrame, third: DataFrame, key: str = "entity_id") -> DataFrame:
    """Union of two sources with their number; ids of the third that the second has, too, leave."""
    return second.withColumn("src", F.lit(2)).unionByName(third.join(second.select(key), key, "left_anti").withColumn("src", F.lit(3)))


def id_lists(entities: DataFrame, pairs: DataFrame, prefixes: tuple[str, ...] = ("S2-", "S3-")) -> DataFrame:
    """(q_id, ids): one row per entity, empty where nothing is selected; ids by falling p, then id, without repeats."""
    wanted = F.lit(False)
    for p in prefixes:
        wanted = wanted | F.col("i_id").startswith(p)
    best = pairs.where(wanted).groupBy("q_id", "i_id").agg(F.max("p").alias("p"))
    lists = best.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("a"), "i_id"))).alias("l"))
    return entities.select("q_id").distinct().join(lists, "q_id", "left").select("q_id", F.coalesce(F.array_join(F.transform("l", lambda x: x["i_id"]), ","), F.lit("")).alias("ids"))


def write_id_lists(lists: DataFrame, path: str, header: tuple[str, str]) -> None:
    lists.select(F.col("q_id").alias(header[0]), F.col("ids").alias(header[1])).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def list_faults(lists: DataFrame, required: DataFrame, known: DataFrame | None = None, prefixes: tuple[str, ...] = ("S2-", "S3-")) -> DataFrame:
    """(fault, n) of id lists (q_id, ids): repeated_row, repeated_id, bad_prefix, missing_row, extra_row, unknown_id."""
    ids = lists.select("q_id", F.filter(F.split(F.coalesce("ids", F.lit("")), ","), lambda x: x != "").alias("l"))
    bad = lambda x: ~F.array_contains(F.array(*(F.lit(p) for p in prefixes)), F.substring(x, 1, len(prefixes[0])))
    parts = [
        ("repeated_row", lists.groupBy("q_id").count().where("count > 1")),
        ("repeated_id", ids.where(F.size("l") != F.size(F.array_distinct("l")))),
        ("bad_prefix", ids.where(F.exists("l", bad))),
        ("missing_row", required.select("q_id").distinct().join(lists, "q_id", "left_anti")),
        ("extra_row", lists.join(required, "q_id", "left_anti")),
    ]
    if known is not None:
        parts.append(("unknown_id", ids.select(F.explode("l").alias("i_id")).join(known.select("i_id"), "i_id", "left_anti")))
    out = None
    for name, rows in parts:
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fault"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows whose matches aren't all candidates: (q_id, n)."""
    split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    both = matches.select("q_id", split(F.col("ids")).alias("m")).join(candidates.select("q_id", split(F.col("ids")).alias("c")), "q_id", "left")
    return both.select("q_id", F.size(F.array_except("m", F.coalesce("c", F.array().cast("array<string>")))).alias("n")).where("n > 0")
