"""Folds, boosted trees with out-of-fold scores, isotonic calibration, hard negatives, feature contract."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolk.functions.text import hash_sample, id_fold
from kinfolk.operators.decide import union_of

MISSING = -1.0


def with_fold(df: DataFrame, key: str, folds: int = 10) -> DataFrame:
    return df.withColumn("fold", id_fold(F.col(key), folds))


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """A vector column; nulls become MISSING beside an indicator, since trees here don't take them."""
    known = {f"{f}__there": F.col(f).isNotNull().cast("double") for f in features}
    filled = df.withColumns(known).withColumns({f"{f}__v": F.coalesce(F.col(f).cast("double"), F.lit(MISSING)) for f in features})
    out = VectorAssembler(inputCols=[f"{f}__v" for f in features] + list(known), outputCol="features").transform(filled)
    return out.drop(*known, *(f"{f}__v" for f in features))


def fit_trees(df: DataFrame, rounds: int = 20, depth: int = 4, rate: float = 0.2, seed: int = 42):
    return GBTClassifier(labelCol="y", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed).fit(df)


def out_of_fold(df: DataFrame, features: list[str], folds: list[int], **settings) -> DataFrame:
    """Scores p of every row: rows of a training fold by the model without it, all others by the models' mean."""
    rows = assembled(df, features)
    models = {f: fit_trees(rows.where(F.col("fold").isin(*[g for g in folds if g != f])), **settings) for f in folds}
    score = lambda m, part: m.transform(part).withColumn("p", vector_to_array("probability")[1]).select(*df.columns, "p")
    own = [score(m, rows.where(F.col("fold") == f)) for f, m in models.items()]
    rest = rows.where(~F.col("fold").isin(*folds))
    for k, m in enumerate(models.values()):
        rest = m.transform(rest).withColumn(f"__p{k}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
    rest = rest.withColumn("p", sum((F.col(f"__p{k}") for k in range(len(models))), F.lit(0.0)) / len(models)).select(*df.columns, "p")
    return union_of([*own, rest])


def calibrate(scored: DataFrame, fit_on) -> DataFrame:
    """Isotonic calibration fitted on the rows of the predicate, applied to all; p stays inside 0 and 1."""
    vectors = VectorAssembler(inputCols=["p"], outputCol="__v").transform(scored)
    model = IsotonicRegression(labelCol="y", featuresCol="__v").fit(vectors.where(fit_on).withColumn("y", F.col("y").cast("double")))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
    return model.transform(vectors).withColumn("p_calibrated", clipped).drop("__v", "prediction")


def _largest(rows: DataFrame, value: Column, n: int, *ties: Column, steps: int = 1000) -> DataFrame:
    """The ``n`` rows of the largest values. A histogram finds the bin that the cut falls into; only that bin is ordered."""
    binned = rows.withColumn("__v", value).withColumn("__bin", F.floor(F.col("__v") * steps))
    above, cut, rest = 0, None, 0
    for r in sorted(binned.groupBy("__bin").agg(F.count(F.lit(1)).alias("size")).collect(), key=lambda r: -r["__bin"]):  # a score's range times ``steps`` at most
        if above + r["size"] > n:
            cut, rest = r["__bin"], n - above
            break
        above += r["size"]
    if cut is None:
        return rows
    tied = binned.where(F.col("__bin") == cut).orderBy(F.col("__v").desc(), *ties).limit(rest)
    return binned.where(F.col("__bin") > cut).unionByName(tied).drop("__v", "__bin")


def hard_negatives(pairs: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows: the positives (a draw by hash where they alone are more) and the hardest negatives; hardness: bscore + dcos / 2 - brank / 100."""
    hard = F.coalesce("bscore", F.lit(0.0)) + 0.5 * F.coalesce("dcos", F.lit(0.0)) - 0.01 * F.col("brank")
    positives = pairs.where("y = 1")
    n = positives.count()
    if n >= most:
        lot = F.pmod(F.xxhash64("q_id", "i_id"), F.lit(1_000_003)) / 1_000_003
        return _largest(positives, lot, most, F.col("q_id"), F.col("i_id"), steps=100_000)
    return positives.unionByName(_largest(pairs.where("y = 0"), hard, most - n, F.col("q_id"), F.col("i_id")))


def uniform(*keys: str) -> Column:
    """A number above 0 and below 1 that the keys decide, from 32 bits of their MD5."""
    text = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32


def weighted_sample(rows: DataFrame, weight: str, n: int, *keys: str) -> DataFrame:
    """``n`` rows without replacement, drawn in proportion to weight: those of the least -ln(u) / weight. Rows without a positive weight stay out."""
    drawn = rows.where(F.col(weight) > 0)
    # The same order on a scale of a few dozen units, so that the histogram stays small whatever the weights.
    return _largest(drawn, F.log(weight) - F.log(-F.log(uniform(*keys))), n, *(F.col(k) for k in keys), steps=4000)


def truncated(pairs: DataFrame, n: int) -> DataFrame:
    """The n pairs of the largest p; ties by ids."""
    return _largest(pairs, F.col("p"), n, F.col("q_id"), F.col("i_id"))


def known_ids(ids: DataFrame, records: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Ids with their records' columns, and the number of ids that no record has: a table of one row (n_unknown)."""
    found = ids.join(records, key)
    return found, ids.join(records.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("n_unknown"))


def entity_subsample(queries: DataFrame, index: DataFrame, truth: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """Whole clusters: queries (q_id) by hash, the index rows (i_id) that truth (q_id, i_id) gives to them, and unowned rows at the same rate by another hash."""
    kept = queries.where(hash_sample(F.col("q_id"), share))
    owners = truth.groupBy("i_id").agg(F.max("q_id").alias("__owner"))
    owned = index.join(owners, "i_id", "left")
    held = kept.select(F.col("q_id").alias("__owner")).distinct()
    clusters = owned.join(held, "__owner", "left_semi")
    loose = owned.where(F.col("__owner").isNull() & hash_sample(F.col("i_id"), share, "devx"))
    return kept, clusters.unionByName(loose).drop("__owner")


def check_contract(trained: list[str], given: list[str]) -> None:
    """Features must be the same ones, in the same order, as in training."""
    if trained != given:
        raise ValueError(f"features differ from training: {sorted(set(trained) ^ set(given)) or 'their order'}")


def blend(pairs: DataFrame, reranked: DataFrame, weight: float) -> DataFrame:
    """(1 - weight) * p + weight * ce on the shortlist, p elsewhere."""
    return pairs.join(reranked.select("q_id", "i_id", "ce"), ["q_id", "i_id"], "left").withColumn("p", F.when(F.col("ce").isNull(), F.col("p")).otherwise((1 - weight) * F.col("p") + weight * F.col("ce"))).drop("ce")


def shortlist(pairs: DataFrame, least: float = 0.02) -> DataFrame:
    """Pairs whose record has no better owner and whose p is not negligible."""
    from kinfolk.operators.decide import one_owner

    return one_owner(pairs).where(F.col("p") >= least)
