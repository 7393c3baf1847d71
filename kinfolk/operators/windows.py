"""Group ranks and group statistics as window columns. Missing values are nulls and come last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by(group, *order):
    """Window over ``group``; every order ends in unique keys, so ranks are the same on every run."""
    keys = [group] if isinstance(group, str) else list(group)
    return W.partitionBy(*keys).orderBy(*order)


def position(group, *order) -> Column:
    """0-based place of a row in its group."""
    return F.row_number().over(by(group, *order)) - 1


def starts_group(group: str, *order) -> Column:
    """Whether a row opens a new run when the table is ordered by group."""
    return F.lag(F.lit(1)).over(by(group, *order)).isNull()


def rank_desc(group, value: str, *ties) -> Column:
    """1-based place by falling value; nulls last; ties by the given keys."""
    return F.row_number().over(by(group, F.col(value).desc_nulls_last(), *ties))


def group_max(group, value: str) -> Column:
    keys = [group] if isinstance(group, str) else list(group)
    return F.max(value).over(W.partitionBy(*keys))


def with_top2(df: DataFrame, group: str, value: str, *ties: str) -> DataFrame:
    """Adds rank, top1, top2 (null in a group of one) and best_other: the best value among the group's other rows."""
    ranked = df.withColumn("rank", rank_desc(group, value, *ties))
    whole = W.partitionBy(group)
    ranked = ranked.withColumn("top1", F.max(F.when(F.col("rank") == 1, F.col(value))).over(whole)).withColumn("top2", F.max(F.when(F.col("rank") == 2, F.col(value))).over(whole))
    return ranked.withColumn("best_other", F.when(F.col("rank") == 1, F.col("top2")).otherwise(F.col("top1")))


def running_sum(value: str, group: str, *order) -> Column:
    return F.sum(value).over(by(group, *order).rowsBetween(W.unboundedPreceding, 0))


def top_k(df: DataFrame, group, k: int, *order, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their 1-based rank; the limit runs before the shuffle, too."""
    return df.withColumn(rank, F.row_number().over(by(group, *order))).where(F.col(rank) <= k)


def largest(df: DataFrame, value: str, most: int) -> DataFrame:
    """The rows of the largest positive values, at most so many: those above a bound that a count of the values by eighths of powers of two sets."""
    level = F.floor(F.log2(value) * 8)
    total, least = 0, None
    for at, n in sorted(df.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += n
        if total > most:
            break
        least = at
    return df.where(F.lit(False) if least is None else level >= least)
