"""Decisions on scored pairs (q_id, i_id, p): one owner, expected-F selection, tuning, and the F0.5 metric."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolk.operators.windows import by

BETA2 = 0.25


def adjust_house_number(p: Column, q_num: Column, i_num: Column, boost: float = 0.05, penalty: float = 0.05) -> Column:
    """Equal house numbers add, unequal ones at most 5 apart subtract; -1 stands for none."""
    known = (q_num >= 0) & (i_num >= 0)
    apart = F.abs(q_num - i_num)
    moved = F.when(known & (apart == 0), p + boost).when(known & (apart <= 5), p - penalty)
    return F.when(moved.isNull(), p).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)))


def one_owner(pairs: DataFrame) -> DataFrame:
    """Of each indexed record's pairs, the one with the largest p; ties: the smallest query."""
    best = by("i_id", F.col("p").desc(), "q_id")
    return pairs.withColumn("__place", F.row_number().over(best)).where(F.col("__place") == 1).drop("__place")


def with_expected_f(pairs: DataFrame, tau=0.0, gamma=1.0, miss=0.0, group=("q_id",)) -> DataFrame:
    """Adds rank, ef (expected F0.5 of the prefix that ends here, -1 below tau), ef_empty and take.

    tau, gamma and miss are numbers or columns; with columns, ``group`` must tell the settings apart.
    """
    tau, gamma, miss = (x if isinstance(x, Column) else F.lit(float(x)) for x in (tau, gamma, miss))
    whole = W.partitionBy(*group)
    order = by(group, F.col("p").desc(), "i_id")
    df = pairs.select("*", F.row_number().over(order).alias("rank"), F.sum("p").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("__sum"), F.sum("p").over(whole).alias("__all"), F.sum(F.log1p(-F.least(F.col("p"), F.lit(1 - 1e-7)))).over(whole).alias("__none"))
    ef = (1 + BETA2) * F.col("__sum") / (BETA2 * (F.col("__all") + miss) + F.col("rank"))
    df = df.withColumn("ef", F.when(F.col("p") >= tau, ef).otherwise(F.lit(-1.0))).withColumn("ef_empty", gamma * F.exp("__none"))
    df = df.withColumn("__best", F.max("ef").over(whole))
    df = df.withColumn("__stop", F.min(F.when(F.col("ef") == F.col("__best"), F.col("rank"))).over(whole))
    take = (F.col("rank") <= F.col("__stop")) & (F.col("__best") > F.col("ef_empty")) & (F.col("__best") > 0)
    return df.withColumn("take", take).drop("__sum", "__all", "__none", "__best", "__stop")


def select_expected_f(pairs: DataFrame, tau: float = 0.0, gamma: float = 1.0, miss: float = 0.0) -> DataFrame:
    return with_expected_f(pairs, tau, gamma, miss).where("take").select(*pairs.columns)


def select_threshold(pairs: DataFrame, tau: float) -> DataFrame:
    return pairs.where(F.col("p") >= tau)


def decide(pairs: DataFrame, method: str = "expected_f", **setting) -> DataFrame:
    """One owner per indexed record, then the chosen selection."""
    owned = one_owner(pairs)
    return select_threshold(owned, setting["tau"]) if method == "threshold" else select_expected_f(owned, **setting)


def f05(g: Column, p: Column, tp: Column) -> Column:
    """F0.5 of one entity with g true, p predicted and tp correct matches."""
    return F.when(g == 0, (p == 0).cast("double")).when(p == 0, F.lit(0.0)).otherwise((1 + BETA2) * tp / (BETA2 * g + p))


def entity_counts(entities: DataFrame, truth: DataFrame, selected: DataFrame) -> DataFrame:
    """entities (q_id, ...), truth and selected (q_id, i_id) -> entities with g, p, tp and f05, zeros filled in."""
    hits = selected.select("q_id", "i_id").distinct().join(truth.select("q_id", "i_id").distinct().withColumn("__hit", F.lit(1)), ["q_id", "i_id"], "left")
    made = hits.groupBy("q_id").agg(F.count(F.lit(1)).alias("p"), F.count("__hit").alias("tp"))
    true = truth.select("q_id", "i_id").distinct().groupBy("q_id").agg(F.count(F.lit(1)).alias("g"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("g", "p", "tp")}
    out = entities.join(true, "q_id", "left").join(made, "q_id", "left").withColumns(zero)
    return out.withColumn("f05", f05(F.col("g"), F.col("p"), F.col("tp")))


def macro_f05(counts: DataFrame, *groups: str) -> DataFrame:
    """Mean of f05 over entities, per group and over all (null group)."""
    return counts.rollup(*groups).agg(F.avg("f05").alias("macro_f05"), F.count(F.lit(1)).alias("n_entities"))


def grid(spark, taus_threshold, taus, gammas, misses) -> DataFrame:
    """Settings to try, numbered; a table of the length of the product, whatever the data."""
    rows = [("threshold", float(t), 0.0, 0.0) for t in taus_threshold] + [("expected_f", float(t), float(g), float(m)) for t in taus for g in gammas for m in misses]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "setting int, method string, tau double, gamma double, miss double")


def tune(pairs: DataFrame, entities: DataFrame, truth: DataFrame, settings: DataFrame) -> DataFrame:
    """macro F0.5 of every setting, best first; ties: the earlier setting.

    Pairs meet the settings by explosion (the grid is small by construction); a group is one query
    under one setting, so partitions stay as small as a query's candidates.
    """
    n = entities.count()
    true = truth.select("q_id", "i_id").distinct()
    g = true.groupBy("q_id").agg(F.count(F.lit(1)).alias("g"))
    labelled = one_owner(pairs).join(true.withColumn("y", F.lit(1)), ["q_id", "i_id"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    tried = settings.collect()
    options = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in settings.columns)) for r in tried))
    tested = labelled.withColumn("s", F.explode(options)).select("*", "s.*").drop("s")
    tested = with_expected_f(tested, F.col("tau"), F.col("gamma"), F.col("miss"), ("setting", "q_id"))
    kept = tested.where(F.when(F.col("method") == "threshold", F.col("p") >= F.col("tau")).otherwise(F.col("take")))
    per_query = kept.groupBy("setting", "q_id").agg(F.count(F.lit(1)).alias("made"), F.sum("y").alias("tp")).join(g, "q_id", "left")
    scored = per_query.withColumn("f", F.when(F.col("g").isNull(), F.lit(0.0)).otherwise(f05(F.col("g"), F.col("made"), F.col("tp"))))
    # Entities without a prediction count 1 where nothing is true, else 0.
    singles = entities.join(g, "q_id", "left_anti").count()
    sums = scored.groupBy("setting").agg(F.sum("f").alias("f"), F.sum(F.col("g").isNull().cast("int")).alias("wrong"))
    total = F.coalesce(F.col("f"), F.lit(0.0)) + F.lit(singles) - F.coalesce(F.col("wrong"), F.lit(0))
    return settings.join(F.broadcast(sums), "setting", "left").select(*settings.columns, (total / n).alias("macro_f05")).orderBy(F.col("macro_f05").desc(), "setting")


def best_setting(tuned: DataFrame) -> dict:
    return tuned.first().asDict()


def union_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
