"""Candidate generation: rare tokens, key families, capped key joins, and the union of retrievers.

Records are rows (rec_id, side, ckey, <family arrays>) with side 'q' or 'i'. Everything is one plan: token
frequencies, ranks and key frequencies are aggregations whose results join back on their keys, and the
caps remove keys before the join expands them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolk.operators.windows import largest, top_k


@dataclass(frozen=True)
class Caps:
    """A key joins if its index frequency is from 1 to ``max_df`` and its pairs are at most ``max_pairs``."""

    max_df: int = 500
    max_pairs: int = 50_000


#: Key families by bit: (name, caps).
FAMILIES = {0: ("NT", Caps()), 1: ("NS", Caps()), 2: ("AN", Caps()), 3: ("NH", Caps()), 4: ("NP", Caps(max_df=200)), 5: ("NC", Caps(max_df=200)), 6: ("PH", Caps())}
BM25_BIT, DENSE_BIT = 8, 7
#: The frequencies of so many frequent tokens are known inside tasks; a record's other tokens meet theirs in a join.
LOOKED_UP = 200_000


def share_blank_partitions(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Index rows with their partition; a blank one joins every partition that has queries.

    Expressed by exploding blank rows over the queries' distinct partitions, so that what follows stays
    an equi-join; partitions without queries vanish.
    """
    partitions = queries.select("ckey").distinct()
    named = index.join(partitions, "ckey", "left_semi")
    # One row that lists the partitions: countries, not records.
    every = partitions.where(F.col("ckey") != "").agg(F.collect_set("ckey").alias("__all")).withColumn("ckey", F.lit(""))
    spread = index.where(F.col("ckey") == "").join(F.broadcast(every), "ckey").withColumn("ckey", F.explode("__all")).drop("__all")
    return named.unionByName(spread)


def token_df(records: DataFrame, tokens: str) -> DataFrame:
    """(ckey, token, df): records of both sides that hold the token."""
    return records.select("ckey", F.explode(F.array_distinct(tokens)).alias("token")).groupBy("ckey", "token").agg(F.count(F.lit(1)).alias("df"))


def tokens_of(records: DataFrame, tokens: str) -> DataFrame:
    """(rec_id, side, ckey, token): each record's distinct tokens."""
    return records.select("rec_id", "side", "ckey", F.explode(F.array_distinct(tokens)).alias("token"))


def recoded(held: DataFrame, code: Callable[[Column], Column]) -> DataFrame:
    """Token rows under another spelling (skeletons, phonetic codes), which is made once a distinct token; empty ones leave."""
    return with_distinct(held, "token", "__code", code).where(F.col("__code") != "").select("rec_id", "side", "ckey", F.col("__code").alias("token")).distinct()


def with_distinct(df: DataFrame, column: str, name: str, make: Callable[[Column], Column]) -> DataFrame:
    """Adds ``name``, computed once for every distinct value of a column and joined back; a null value's is null."""
    known = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(name, make(F.col(column)))
    return df.join(known, column, "left")


def rarest(records: DataFrame, tokens: str, k: int, least_df: int = 2) -> DataFrame:
    """(rec_id, side, ckey, token): each record's k rarest tokens of df >= least_df; ties by token."""
    return ranked_tokens(records, tokens, k, least_df).drop("rank")


def ranked_tokens(records: DataFrame, tokens: str, k: int, least_df: int = 2) -> DataFrame:
    """(rec_id, side, ckey, token, rank): the same with ranks.

    Nearly all of a table's tokens are of a few frequent kinds. Of those a record keeps its k rarest before
    anything is shuffled; none of the others among them could be one of its k rarest.
    """
    frequent = token_df(records, tokens).where(F.col("df") >= least_df).persist()
    known: dict[object, list[tuple[int, str]]] = {}
    for ckey, token, df in largest(frequent, "df", LOOKED_UP).select("ckey", "token", "df").collect():
        known.setdefault(ckey, []).append((df, token))
    known = {ckey: tuple(zip(*sorted(own))) for ckey, own in known.items() if ckey is not None}
    types = {c: records.schema[c].dataType.simpleString() for c in ("rec_id", "side", "ckey")}

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each record's k rarest looked-up tokens with their frequency, and all its other tokens without."""
        order = {ckey: (np.array(df, np.int64), pa.array(token, pa.string())) for ckey, (df, token) in known.items()}
        for batch in batches:
            for ckey in pc.unique(batch.column(2)).to_pylist():
                if ckey is None:
                    continue
                own = batch.filter(pc.equal(batch.column(2), pa.scalar(ckey, batch.column(2).type)))
                token = own.column(3).flatten()
                row = np.repeat(np.arange(len(own)), pc.fill_null(pc.list_value_length(own.column(3)), 0).to_numpy())
                df, listed = order.get(ckey, (np.empty(0, np.int64), pa.array([], pa.string())))
                at = pc.fill_null(pc.index_in(token, value_set=listed), -1).to_numpy()
                usual = np.flatnonzero(at >= 0)
                usual = usual[np.lexsort((at[usual], row[usual]))]  # places are in order of frequency, then token
                first = np.flatnonzero(np.diff(row[usual], prepend=-1))
                usual = usual[np.arange(len(usual)) - np.repeat(first, np.diff(first, append=len(usual))) < k]
                others = np.flatnonzero(at < 0)
                kept = np.concatenate([usual, others])
                found = pa.concat_arrays([pa.array(df[at[usual]], pa.int64()), pa.nulls(len(others), pa.int64())])
                yield pa.RecordBatch.from_arrays([*(own.column(c).take(pa.array(row[kept])) for c in range(3)), token.take(pa.array(kept)), found], names=["rec_id", "side", "ckey", "token", "known"])

    rows = records.select("rec_id", "side", "ckey", F.array_distinct(tokens).alias("tokens"))
    rows = rows.mapInArrow(shortened, ", ".join(f"{c} {t}" for c, t in types.items()) + ", token string, known long")
    rows = rows.join(frequent, ["ckey", "token"], "left").withColumn("df", F.coalesce("known", "df")).where("df IS NOT NULL")
    return top_k(rows, ["rec_id", "side"], k, "df", "token").select("rec_id", "side", "ckey", "token", "rank")


def rarest_rows(held: DataFrame, k: int, least_df: int = 2) -> DataFrame:
    """The same for distinct token rows."""
    frequent = held.groupBy("ckey", "token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least_df)
    ranked = top_k(held.join(frequent, ["ckey", "token"]), ["rec_id", "side"], k, "df", "token")
    return ranked.select("rec_id", "side", "ckey", "token")


def as_arrays(tokens: DataFrame, name: str) -> DataFrame:
    return tokens.groupBy("rec_id", "side", "ckey").agg(F.array_sort(F.collect_set("token")).alias(name))


def cross_keys(a: DataFrame, b: DataFrame, bit: int) -> DataFrame:
    """Keys of token pairs of the same record, from two families of (rec_id, side, ckey, token)."""
    left = a.withColumnRenamed("token", "ka")
    right = b.select("rec_id", "side", F.col("token").alias("kb"))
    return left.join(right, ["rec_id", "side"]).select("rec_id", "side", "ckey", F.lit(bit).alias("bit"), "ka", "kb")


def pair_keys(a: DataFrame, bit: int) -> DataFrame:
    """Keys of unordered token pairs of the same record."""
    return cross_keys(a, a, bit).where(F.col("ka") < F.col("kb"))


def whole_keys(records: DataFrame, column: str, bit: int) -> DataFrame:
    """One key per record with a non-empty value."""
    return records.where(F.col(column) != "").select("rec_id", "side", "ckey", F.lit(bit).alias("bit"), F.col(column).alias("ka"), F.lit("").alias("kb"))


def first_tokens(records: DataFrame, tokens: str, k: int) -> DataFrame:
    return records.select("rec_id", "side", "ckey", F.explode(F.array_distinct(F.slice(tokens, 1, k))).alias("token"))


def key_join(keys: DataFrame, records: DataFrame, caps: dict[int, Caps] | None = None) -> DataFrame:
    """(q_id, i_id, ckey, bit, weight) for every admitted key that a query and an indexed record share.

    weight = ln(1 + N / df), N being the partition's indexed records.
    """
    on = ["ckey", "bit", "ka", "kb"]
    keys = keys.distinct().persist()  # read three times
    sizes = records.where(F.col("side") == "i").groupBy("ckey").agg(F.count(F.lit(1)).alias("n_index"))
    admitted = admitted_keys(keys, caps)
    admitted = admitted.join(sizes, "ckey").select(*on, F.log1p(F.col("n_index") / F.col("df")).alias("weight"))
    q = keys.where(F.col("side") == "q").select(*on, F.col("rec_id").alias("q_id"))
    i = keys.where(F.col("side") == "i").select(*on, F.col("rec_id").alias("i_id"))
    return q.join(admitted, on).join(i, on).select("q_id", "i_id", "ckey", "bit", "weight")


def admitted_keys(keys: DataFrame, caps: dict[int, Caps] | None = None) -> DataFrame:
    """(ckey, bit, ka, kb, df, qdf) of the keys that both sides have and the caps let through; keys are distinct rows."""
    caps = caps or {b: c for b, (_, c) in FAMILIES.items()}
    stats = keys.groupBy("ckey", "bit", "ka", "kb").agg(F.sum((F.col("side") == "i").cast("long")).alias("df"), F.sum((F.col("side") == "q").cast("long")).alias("qdf"))
    limit = F.coalesce(*(F.when(F.col("bit") == b, F.lit(c.max_df)) for b, c in caps.items()))
    pairs = F.coalesce(*(F.when(F.col("bit") == b, F.lit(c.max_pairs)) for b, c in caps.items()))
    return stats.where((F.col("df") > 0) & (F.col("qdf") > 0) & (F.col("df") <= limit) & (F.col("df") * F.col("qdf") <= pairs))


def join_budget(keys: DataFrame, caps: dict[int, Caps] | None = None) -> DataFrame:
    """(bit, n_keys, n_rows, largest): the rows that the key join will make per family, known before it runs."""
    rows = F.col("df") * F.col("qdf")
    return admitted_keys(keys.distinct(), caps).groupBy("bit").agg(F.count(F.lit(1)).alias("n_keys"), F.sum(rows).alias("n_rows"), F.max(rows).alias("largest"))


def score_pairs(joined: DataFrame, digits: int = 6) -> DataFrame:
    """(ckey, q_id, i_id, bscore, bits): summed weights and the families that found the pair."""
    return joined.groupBy("ckey", "q_id", "i_id").agg(F.round(F.sum("weight"), digits).alias("bscore"), F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("bit"))).cast("long").alias("bits"))


def best_candidates(scored: DataFrame, k: int = 40) -> DataFrame:
    """Each query's k best pairs with their 0-based brank: by score, families, then id."""
    out = top_k(scored, ["ckey", "q_id"], k, F.col("bscore").desc(), F.bit_count("bits").desc(), "i_id", rank="brank")
    return out.withColumn("brank", F.col("brank") - 1)


def merge_retrievers(keyed: DataFrame, others: list[tuple[DataFrame, int]], k_key: int = 40) -> DataFrame:
    """Union of the key candidates and other retrievers' pairs (ckey, q_id, i_id, dcos), provenance bits joined.

    Pairs that only the others found have bscore 0 and brank k_key + 50.
    """
    rows = keyed.select("ckey", "q_id", "i_id", "bscore", "bits", F.col("brank").cast("long").alias("brank"), F.lit(None).cast("double").alias("dcos"))
    for pairs, bit in others:
        dcos = F.col("dcos") if "dcos" in pairs.columns else F.lit(None)
        rows = rows.unionByName(pairs.select("ckey", "q_id", "i_id", F.lit(None).cast("double").alias("bscore"), F.lit(1 << bit).cast("long").alias("bits"), F.lit(None).cast("long").alias("brank"), dcos.cast("double").alias("dcos")))
    return rows.groupBy("ckey", "q_id", "i_id").agg(F.coalesce(F.max("bscore"), F.lit(0.0)).alias("bscore"), F.bit_or("bits").alias("bits"), F.coalesce(F.min("brank"), F.lit(k_key + 50)).alias("brank"), F.max("dcos").alias("dcos"))
