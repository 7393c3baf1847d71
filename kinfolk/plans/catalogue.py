"""Registered queries of the engine's operators, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolk.functions import phonetics, similarity, text
from kinfolk.operators import blocking, decide, diagnostics, features, model, retrieval, windows
from kinfolk.plans import worlds
from kinfolk.plans.worlds import DOCUMENTS, ORDERS, PAIRS, VECTORS
from kinfolk.sources import records

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# --- sources and set operations ------------------------------------------------------------------

@query("SELECT src, count(*) AS n, count(DISTINCT text) AS texts FROM (SELECT doc_id % 3 + 1 AS src, text FROM documents) GROUP BY 1")
def union_sources(spark, d):
    docs = worlds.documents(spark, d)
    parts = [docs.where(F.col("src") == s) for s in (1, 2, 3)]
    return decide.union_of(parts).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("texts"))


@query(f"WITH {DOCUMENTS} SELECT whole, min(rec_id) AS rec_id, arg_min(source, rec_id) AS source FROM d GROUP BY 1")
def scan_dedupe_first(spark, d):
    return records.first_of_id(worlds.documents(spark, d).select("whole", "rec_id", "source"), "whole", "rec_id")


@query(f"WITH {DOCUMENTS} SELECT rec_id, whole, 2 AS src FROM d WHERE src = 2 UNION ALL SELECT rec_id, whole, 3 FROM d WHERE src = 3 AND whole NOT IN (SELECT whole FROM d WHERE src = 2)")
def cross_source_antijoin(spark, d):
    docs = worlds.documents(spark, d).select("rec_id", "whole", F.col("src").alias("s"))
    part = lambda s: docs.where(F.col("s") == s).drop("s")
    return records.combine_index(part(2), part(3), "whole").select("rec_id", "whole", F.col("src").cast("int").alias("src"))


@query(f"WITH {DOCUMENTS}, b AS (SELECT rec_id, side, CASE WHEN ckey = 'es' THEN '' ELSE ckey END AS ckey FROM d), q AS (SELECT DISTINCT ckey FROM b WHERE side = 'q') "
       "SELECT ckey, count(*) AS n, sum(rec_id)::BIGINT AS ids FROM (SELECT b.rec_id, b.ckey FROM b JOIN q USING (ckey) WHERE side = 'i' UNION ALL SELECT b.rec_id, q.ckey FROM b, q WHERE side = 'i' AND b.ckey = '' AND q.ckey <> '') GROUP BY 1")
def partition_blank_country(spark, d):
    docs = worlds.documents(spark, d).select("rec_id", "side", F.when(F.col("ckey") == "es", "").otherwise(F.col("ckey")).alias("ckey"))
    spread = blocking.share_blank_partitions(docs.where("side = 'q'"), docs.where("side = 'i'"))
    return spread.groupBy("ckey").agg(F.count(F.lit(1)).alias("n"), F.sum("rec_id").alias("ids"))


@query()
def hash_fold_counts(spark, d):
    docs = worlds.documents(spark, d)
    return model.with_fold(docs, "rec_id").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("first"))


@query()
def dev_subsample(spark, d):
    """Whole clusters of equal texts: a text's first asked record owns the indexed ones."""
    docs = worlds.documents(spark, d).withColumn("h", F.hash("name", "address"))
    asks, index = docs.where("side = 'q'").withColumnRenamed("rec_id", "q_id"), docs.where("side = 'i'").withColumnRenamed("rec_id", "i_id")
    truth = index.join(asks.groupBy("h").agg(F.min("q_id").alias("q_id")), "h").select("q_id", "i_id")
    kept, own = model.entity_subsample(asks, index, truth, 0.3)
    both = kept.withColumnRenamed("q_id", "rec_id").unionByName(own.withColumnRenamed("i_id", "rec_id"))
    return both.groupBy("side", "ckey").agg(F.count(F.lit(1)).alias("n"), F.sum("rec_id").alias("ids"))


# --- text ----------------------------------------------------------------------------------------

def _skeleton_sql(token: str) -> str:
    from kinfolk.functions.vocabulary import SKELETON_FROM, SKELETON_PAIRS, SKELETON_TO

    t = token
    for a, b in SKELETON_PAIRS:
        t = f"replace({t}, '{a}', '{b}')"
    t = f"(SELECT left(x, 1) || replace(substr(x, 2), 'h', '') FROM (SELECT {t} AS x))"
    t = f"translate({t}, '{SKELETON_FROM}', '{SKELETON_TO}')"
    t = f"(SELECT left(x, 1) || regexp_replace(substr(x, 2), '[aeiou]', '', 'g') FROM (SELECT {t} AS x))"
    for c in "abcdefghijklmnopqrstuvwxyz0123456789_":
        t = f"regexp_replace({t}, '{c}+', '{c}', 'g')"
    return f"CASE WHEN regexp_full_match({token}, '[0-9]*') THEN {token} ELSE {t} END"


@query(f"SELECT token, n, {_skeleton_sql('token')} AS skeleton FROM (SELECT token, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS token FROM part) GROUP BY 1)")
def skeleton_tokens(spark, d):
    tokens = worlds.table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return tokens.withColumn("skeleton", text.skeleton(F.col("token")))


_PART_PAIRS = """n AS (SELECT lower(p_name) AS name, min(p_partkey) AS id, min(p_brand) AS brand FROM part GROUP BY 1), x AS (SELECT a.id AS a_id, b.id AS b_id, a.name AS a, b.name AS b FROM n a JOIN n b ON a.brand = b.brand AND a.name < b.name)"""


def _part_pairs(spark, d):
    """Pairs of distinct part names whose least brands are equal."""
    names = worlds.table(spark, d, "part").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("id"), F.min("p_brand").alias("brand"))
    a, b = (names.select(F.col("name").alias(s), F.col("id").alias(f"{s}_id"), "brand") for s in "ab")
    return a.join(b, "brand").where("a < b").select("a_id", "b_id", "a", "b")


@query(f"WITH {_PART_PAIRS} SELECT a_id, b_id, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS similarity FROM x")
def name_levenshtein(spark, d):
    return _part_pairs(spark, d).select("a_id", "b_id", F.round(similarity.levenshtein_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"WITH {_PART_PAIRS} SELECT a_id, b_id, round(jaro_winkler_similarity(a, b), 6) AS similarity FROM x")
def name_jaro_winkler(spark, d):
    return _part_pairs(spark, d).select("a_id", "b_id", F.round(similarity.jaro_winkler_udf("a", "b"), 6).alias("similarity"))


@query()
def name_sequence_ratios(spark, d):
    score = lambda f: F.round(f("a", "b"), 6)
    return _part_pairs(spark, d).select("a_id", "b_id", score(similarity.ratio_udf).alias("ratio"), score(similarity.partial_ratio_udf).alias("partial"), score(similarity.token_sort_udf).alias("sorted"), score(similarity.token_set_udf).alias("as_set"))


@query()
def normalised_records(spark, d):
    from kinfolk.functions.normalise import normalise

    parts = worlds.table(spark, d, "part")
    rows = parts.select(F.col("p_partkey").alias("entity_id"), F.concat("p_name", F.lit(" Industries Pvt. Ltd.")).alias("business_name"), F.concat(F.col("p_size").cast("string"), F.lit(" Maple St, New York, NY 10001")).alias("business_address"), F.when(F.col("p_size") % 2 == 0, "US").otherwise("India").alias("country"))
    return normalise(rows).drop("business_name", "business_address")


# --- tokens and blocking ---------------------------------------------------------------------------

_DF = "h AS (SELECT rec_id, side, ckey, unnest(list_distinct(name)) AS token FROM d), f AS (SELECT ckey, token, count(*) AS df FROM h GROUP BY 1, 2)"


@query(f"WITH {DOCUMENTS}, {_DF} SELECT * FROM f")
def token_df(spark, d):
    return blocking.token_df(worlds.documents(spark, d), "name")


def _rare_sql(name: str, column: str, k: int) -> str:
    return f"""{name} AS (SELECT rec_id, side, ckey, token FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY df, token) AS rn
        FROM (SELECT rec_id, side, ckey, unnest(list_distinct({column})) AS token FROM d) JOIN (SELECT ckey, token, count(*) AS df FROM (SELECT rec_id, ckey, unnest(list_distinct({column})) AS token FROM d) GROUP BY 1, 2 HAVING count(*) >= 2) USING (ckey, token)) WHERE rn <= {k})"""


@query(f"WITH {DOCUMENTS}, {_rare_sql('r', 'name', 3)} SELECT * FROM r")
def rare_topk_tokens(spark, d):
    return blocking.rarest(worlds.documents(spark, d), "name", 3)


def _rare_rows_sql(name: str, rows: str, k: int) -> str:
    return f"""{name} AS (SELECT rec_id, side, ckey, token FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY df, token) AS rn
        FROM {rows} JOIN (SELECT ckey, token, count(*) AS df FROM {rows} GROUP BY 1, 2 HAVING count(*) >= 2) USING (ckey, token)) WHERE rn <= {k})"""


def _skeleton_rows_sql(name: str, column: str) -> str:
    held = f"SELECT DISTINCT rec_id, side, ckey, token FROM (SELECT rec_id, side, ckey, unnest({column}) AS token FROM d)"
    return f"""{name}_held AS ({held}), {name}_code AS (SELECT token, {_skeleton_sql('token')} AS code FROM (SELECT DISTINCT token FROM {name}_held)),
        {name} AS (SELECT DISTINCT rec_id, side, ckey, code AS token FROM {name}_held JOIN {name}_code USING (token) WHERE code <> '')"""


def _crossed_sql(bit: int, a: str, b: str) -> str:
    return f"SELECT a.rec_id, a.side, a.ckey, {bit} AS bit, a.token AS ka, b.token AS kb FROM {a} a JOIN {b} b USING (rec_id)"


_FIRST_NUMS = "(SELECT DISTINCT rec_id, side, ckey, unnest(nums[1:2]) AS token FROM d)"
_KEYS = {
    "NP": (4, [_rare_sql("n3", "name", 3)], "SELECT a.rec_id, a.side, a.ckey, 4 AS bit, a.token AS ka, b.token AS kb FROM n3 a JOIN n3 b USING (rec_id) WHERE a.token < b.token"),
    "NT": (0, [_rare_sql("n2", "name", 2), _rare_sql("a4", "address", 4)], _crossed_sql(0, "n2", "a4")),
    "NH": (3, [_rare_sql("n2", "name", 2)], _crossed_sql(3, "n2", _FIRST_NUMS)),
    "NC": (5, [], "SELECT rec_id, side, ckey, 5 AS bit, whole AS ka, '' AS kb FROM d"),
}
#: The other families; phonetic codes have no SQL.
_MORE_KEYS = {
    "NS": (1, [_skeleton_rows_sql("ns", "name"), _rare_rows_sql("ns2", "ns", 2), _skeleton_rows_sql("hs", "address"), _rare_rows_sql("hs3", "hs", 3)], _crossed_sql(1, "ns2", "hs3")),
    "AN": (2, [_rare_sql("a3", "address", 3)], _crossed_sql(2, _FIRST_NUMS, "a3")),
}


def _block_sql(families: list[str], last: str) -> str:
    every = _KEYS | _MORE_KEYS
    tables = list(dict.fromkeys(t for f in families for t in every[f][1]))
    keys = " UNION ALL ".join(f"({every[f][2]})" for f in families)
    limit = "CASE bit " + " ".join(f"WHEN {b} THEN {blocking.FAMILIES[b][1].max_df}" for b, *_ in every.values()) + " END"
    return f"""WITH {", ".join([DOCUMENTS, *tables])}, keys AS (SELECT DISTINCT * FROM ({keys})), sizes AS (SELECT ckey, count(*) AS n FROM d WHERE side = 'i' GROUP BY 1),
        stats AS (SELECT ckey, bit, ka, kb, count(*) FILTER (WHERE side = 'i') AS df, count(*) FILTER (WHERE side = 'q') AS qdf FROM keys GROUP BY ALL),
        admitted AS (SELECT ckey, bit, ka, kb, ln(1 + n / df) AS weight FROM stats JOIN sizes USING (ckey) WHERE df > 0 AND qdf > 0 AND df <= {limit} AND df * qdf <= 50000),
        joined AS (SELECT q.rec_id AS q_id, i.rec_id AS i_id, ckey, bit, weight FROM admitted JOIN keys q USING (ckey, bit, ka, kb) JOIN keys i USING (ckey, bit, ka, kb) WHERE q.side = 'q' AND i.side = 'i'),
        scored AS (SELECT ckey, q_id, i_id, round(sum(weight), 6) AS bscore, bit_or(1 << bit)::BIGINT AS bits FROM joined GROUP BY 1, 2, 3),
        best AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY ckey, q_id ORDER BY bscore DESC, bit_count(bits) DESC, i_id) - 1)::INT AS brank FROM scored) WHERE brank < 40) {last}"""


#: Ranks of a column's rare tokens are made once, up to the most that a family takes.
_MOST = {"name": 3, "address": 4}


def _keys(docs: DataFrame, families: list[str]) -> DataFrame:
    short = docs.select("rec_id", "side", "ckey", "address", "nums", "whole").persist()  # texts and names are many times larger
    ranked = cache(lambda c: blocking.ranked_tokens(docs if c == "name" else short, c, _MOST[c]).persist())
    rare = lambda c, k: ranked(c).where(F.col("rank") <= k).drop("rank")
    coded = lambda c, k, code: blocking.rarest_rows(blocking.recoded(blocking.tokens_of(docs, c), code), k)
    make = {
        "NP": lambda: blocking.pair_keys(rare("name", 3), 4), "NT": lambda: blocking.cross_keys(rare("name", 2), rare("address", 4), 0),
        "NH": lambda: blocking.cross_keys(rare("name", 2), blocking.first_tokens(short, "nums", 2), 3), "NC": lambda: blocking.whole_keys(short, "whole", 5),
        "NS": lambda: blocking.cross_keys(coded("name", 2, text.skeleton), coded("address", 3, text.skeleton), 1),
        "AN": lambda: blocking.cross_keys(blocking.first_tokens(short, "nums", 2), rare("address", 3), 2),
        "PH": lambda: blocking.cross_keys(coded("name", 2, lambda t: F.get(phonetics.nysiis_all(F.array(t)), F.lit(0))), coded("address", 3, text.skeleton), 6),
    }
    return decide.union_of([make[f]() for f in families])


def _block(spark, d, families: list[str]) -> DataFrame:
    docs = worlds.documents(spark, d)
    return blocking.best_candidates(blocking.score_pairs(blocking.key_join(_keys(docs, families), docs)))


def _add_block(name: str, families: list[str]) -> None:
    def run(spark, d):
        return _block(spark, d, families)

    run.__name__ = name
    query(_block_sql(families, "SELECT * FROM best"))(run)


for _family in [*_KEYS, *_MORE_KEYS]:
    _add_block(f"block_{_family.lower()}", [_family])
_add_block("block_union_score_bits_topk", list(_KEYS))


@query()
def block_ph(spark, d):
    return _block(spark, d, ["PH"])


@query(_block_sql(["NP", "NC", "AN"], "SELECT bit, count(*) AS n_keys, sum(df * qdf)::BIGINT AS n_rows, max(df * qdf)::BIGINT AS largest FROM (SELECT bit, df, qdf FROM stats JOIN admitted USING (ckey, bit, ka, kb)) GROUP BY 1"))
def join_budget(spark, d):
    return blocking.join_budget(_keys(worlds.documents(spark, d), ["NP", "NC", "AN"]))


@query(f"WITH {DOCUMENTS} SELECT source, count(*) AS n, count(code) AS coded, count(DISTINCT code) AS codes FROM (SELECT source, sha256(lower(text)) AS code FROM d) GROUP BY 1")
def distinct_text_codes(spark, d):
    """A costly function of whole texts, computed once a distinct text."""
    coded = blocking.with_distinct(worlds.documents(spark, d).select("source", "text"), "text", "code", lambda t: F.sha2(F.lower(t).cast("binary"), 256))
    return coded.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("code").alias("coded"), F.count_distinct("code").alias("codes"))


# --- retrieval -----------------------------------------------------------------------------------

_BM25 = f"""WITH {DOCUMENTS}, tf AS (SELECT rec_id, ckey, term, count(*) AS tf FROM (SELECT rec_id, ckey, unnest(name) AS term FROM d WHERE side = 'i') GROUP BY 1, 2, 3),
    len AS (SELECT rec_id, ckey, len(name) AS length FROM d WHERE side = 'i'), size AS (SELECT ckey, count(*) AS n, avg(length) AS mean FROM len GROUP BY 1),
    idf AS (SELECT ckey, term, mean, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT ckey, term, count(*) AS df FROM tf GROUP BY 1, 2) JOIN size USING (ckey) WHERE df <= greatest(50, floor(n * 0.2))),
    w AS (SELECT tf.ckey, tf.term, tf.rec_id AS i_id, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS w FROM tf JOIN idf USING (ckey, term) JOIN len USING (rec_id, ckey)),
    s AS (SELECT ckey, q_id, i_id, round(sum(w), 6) AS score FROM (SELECT rec_id AS q_id, ckey, unnest(list_distinct(name)) AS term FROM d WHERE side = 'q') JOIN w USING (ckey, term) GROUP BY 1, 2, 3),
    top AS (SELECT ckey, q_id, i_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY ckey, q_id ORDER BY score DESC, i_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 40)"""


def _bm25(spark, d) -> DataFrame:
    docs = worlds.documents(spark, d)
    return retrieval.bm25(docs.where("side = 'q'"), docs.where("side = 'i'"), "name", 40)


@query(f"{_BM25} SELECT ckey, q_id, i_id, round(score, 2) AS score, rank FROM top WHERE rank <= 5")
def bm25_topk(spark, d):
    return _bm25(spark, d).where("rank <= 5").withColumn("score", F.round("score", 2))


@query(f"{_BM25} SELECT top.ckey, q_id, i_id, rank FROM top JOIN d ON d.rec_id = i_id WHERE rank <= 5 OR len(address) = 1")
def bm25_empty_keep(spark, d):
    bare = worlds.documents(spark, d).select(F.col("rec_id").alias("i_id"), (F.size("address") == 1).alias("bare"))
    return retrieval.keep_more_where(_bm25(spark, d).join(bare, "i_id"), 5, 40, F.col("bare")).select("ckey", "q_id", "i_id", "rank")


@query(_block_sql(list(_KEYS), ", " + _BM25.removeprefix(f"WITH {DOCUMENTS}, ") + """, u AS (SELECT ckey, q_id, i_id, bscore, bits, brank FROM best UNION ALL SELECT ckey, q_id, i_id, NULL, 256, NULL FROM top WHERE rank <= 5)
    SELECT ckey, q_id, i_id, coalesce(max(bscore), 0)::DOUBLE AS bscore, bit_or(bits)::BIGINT AS bits, coalesce(min(brank), 90)::BIGINT AS brank, NULL::DOUBLE AS dcos FROM u GROUP BY 1, 2, 3"""))
def retrievers_merged(spark, d):
    keyed = _block(spark, d, list(_KEYS))
    return blocking.merge_retrievers(keyed, [(_bm25(spark, d).where("rank <= 5"), blocking.BM25_BIT)])


@query(_block_sql(["NC", "NP"], """, tf AS (SELECT rec_id, ckey, term, count(*) AS tf FROM (SELECT rec_id, ckey, unnest(name) AS term FROM d) GROUP BY 1, 2, 3), size AS (SELECT ckey, count(*) AS n FROM d GROUP BY 1),
    idf AS (SELECT ckey, term, ln((n + 1) / (df + 1)) + 1 AS idf FROM (SELECT ckey, term, count(*) AS df FROM tf GROUP BY 1, 2) JOIN size USING (ckey)), raw AS (SELECT rec_id, term, (ln(tf) + 1) * idf AS raw FROM tf JOIN idf USING (ckey, term)),
    w AS (SELECT rec_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY rec_id)) AS w FROM raw), dots AS (SELECT q_id, i_id, sum(a.w * b.w) AS dot FROM best JOIN w a ON a.rec_id = q_id JOIN w b ON b.rec_id = i_id AND b.term = a.term GROUP BY 1, 2)
    SELECT q_id, i_id, round(coalesce(dot, 0), 5) AS cosine FROM best LEFT JOIN dots USING (q_id, i_id)"""))
def tfidf_cosine_pairs(spark, d):
    docs = worlds.documents(spark, d)
    pairs = _block(spark, d, ["NC", "NP"]).select("q_id", "i_id")
    return retrieval.pair_cosine(pairs, retrieval.tfidf(docs, "name"), 5)


@query(_block_sql(["NC", "NP"], "SELECT q_id, i_id, round(CASE WHEN u = 0 THEN 0 ELSE (len(list_distinct(a.name)) + len(list_distinct(b.name)) - u) / u END, 6) AS jaccard FROM (SELECT q_id, i_id, a, b, len(list_distinct(list_concat(a.name, b.name))) AS u FROM best JOIN d a ON a.rec_id = q_id JOIN d b ON b.rec_id = i_id)"))
def token_jaccard(spark, d):
    docs = worlds.documents(spark, d)
    side = lambda s: docs.select(F.col("rec_id").alias(f"{s}_id"), F.col("name").alias(f"{s}_name"))
    pairs = _block(spark, d, ["NC", "NP"]).select("q_id", "i_id").join(side("q"), "q_id").join(side("i"), "i_id")
    return pairs.select("q_id", "i_id", F.round(similarity.jaccard(F.col("q_name"), F.col("i_name")), 6).alias("jaccard"))


def _knn(spark, d) -> DataFrame:
    rows = worlds.vectors(spark, d)
    return retrieval.knn(rows.where("rec_id % 5 = 0"), rows.where("rec_id % 5 <> 0"), 10)


@query(f"WITH {VECTORS} SELECT q_id, i_id, cosine, rank::INT AS rank FROM k")
def knn_topk(spark, d):
    return _knn(spark, d)


@query(f"WITH {VECTORS} SELECT k.q_id, i_id, rank::INT AS rank FROM k JOIN v ON v.rec_id = k.q_id WHERE rank <= 3 OR label < 3")
def knn_adaptive_keep(spark, d):
    labels = worlds.vectors(spark, d).select(F.col("rec_id").alias("q_id"), "label")
    return retrieval.keep_more_where(_knn(spark, d).join(labels, "q_id"), 3, 10, F.col("label") < 3).select("q_id", "i_id", "rank")


# --- windows and decisions -------------------------------------------------------------------------

@query(f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY p DESC, i_id) AS rank FROM p) "
       "SELECT q_id, i_id, p, rank::INT AS rank, max(p) FILTER (WHERE rank = 1) OVER w AS top1, max(p) FILTER (WHERE rank = 2) OVER w AS top2, CASE WHEN rank = 1 THEN max(p) FILTER (WHERE rank = 2) OVER w ELSE max(p) FILTER (WHERE rank = 1) OVER w END AS best_other FROM r WINDOW w AS (PARTITION BY q_id)")
def group_rank_max_top2(spark, d):
    return windows.with_top2(worlds.pairs(spark, d).select("q_id", "i_id", "p"), "q_id", "p", "i_id")


@query(f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY i_id ORDER BY p DESC, q_id) AS rank FROM p) SELECT q_id, i_id, round(p - coalesce(CASE WHEN rank = 1 THEN max(p) FILTER (WHERE rank = 2) OVER w ELSE max(p) FILTER (WHERE rank = 1) OVER w END, 0), 6) AS lead FROM r WINDOW w AS (PARTITION BY i_id)")
def competition_other(spark, d):
    rows = windows.with_top2(worlds.pairs(spark, d).select("q_id", "i_id", "p"), "i_id", "p", "q_id")
    return rows.select("q_id", "i_id", F.round(F.col("p") - F.coalesce("best_other", F.lit(0.0)), 6).alias("lead"))


_OWNED = f"{PAIRS}, o AS (SELECT q_id, i_id, p, y FROM (SELECT *, row_number() OVER (PARTITION BY i_id ORDER BY p DESC, q_id) AS rn FROM p) WHERE rn = 1)"


@query(f"WITH {_OWNED} SELECT q_id, i_id, p FROM o")
def exclusive_owner(spark, d):
    return decide.one_owner(worlds.pairs(spark, d)).select("q_id", "i_id", "p")


@query(f"WITH {_OWNED} SELECT q_id, i_id, p FROM o WHERE p >= 0.5")
def threshold_select(spark, d):
    return decide.select_threshold(decide.one_owner(worlds.pairs(spark, d)), 0.5).select("q_id", "i_id", "p")


def _expected_sql(pairs: str, tau: str, gamma: str, miss: str, group: str) -> str:
    return f"""r AS (SELECT *, row_number() OVER w AS rank, sum(p) OVER (w ROWS UNBOUNDED PRECEDING) AS cum, sum(p) OVER g AS total, sum(ln(1 - least(p, 1 - 1e-7))) OVER g AS none FROM {pairs} WINDOW w AS (PARTITION BY {group} ORDER BY p DESC, i_id), g AS (PARTITION BY {group})),
        f AS (SELECT *, CASE WHEN p >= {tau} THEN 1.25 * cum / (0.25 * (total + {miss}) + rank) ELSE -1 END AS ef, {gamma} * exp(none) AS ef_empty FROM r),
        b AS (SELECT *, max(ef) OVER (PARTITION BY {group}) AS best FROM f), s AS (SELECT *, min(CASE WHEN ef = best THEN rank END) OVER (PARTITION BY {group}) AS stop FROM b),
        taken AS (SELECT * FROM s WHERE rank <= stop AND best > ef_empty AND best > 0)"""


@query(f"WITH {_OWNED}, {_expected_sql('o', '0.1', '0.85', '0.1', 'q_id')} SELECT q_id, i_id, p FROM taken")
def expected_f_select(spark, d):
    return decide.decide(worlds.pairs(spark, d).select("q_id", "i_id", "p"), tau=0.1, gamma=0.85, miss=0.1)


@query(f"WITH {PAIRS} SELECT q_id, i_id, round(CASE WHEN q_id % 40 = i_id % 40 THEN least(1, p + 0.05) WHEN abs(q_id % 40 - i_id % 40) <= 5 THEN greatest(0, p - 0.05) ELSE p END, 6) AS p FROM p")
def housenum_adjust(spark, d):
    moved = decide.adjust_house_number(F.col("p"), F.col("q_id") % 40, F.col("i_id") % 40)
    return worlds.pairs(spark, d).select("q_id", "i_id", F.round(moved, 6).alias("p"))


_GRID = ((0.2, 0.5, 0.8), (0.05, 0.4), (0.7, 1.2), (0.0, 0.3))
_GRID_SQL = " UNION ALL ".join(f"SELECT {i} AS setting, '{m}' AS method, {t}::DOUBLE AS tau, {g}::DOUBLE AS gamma, {x}::DOUBLE AS miss" for i, (m, t, g, x) in enumerate(
    [("threshold", t, 0.0, 0.0) for t in _GRID[0]] + [("expected_f", t, g, x) for t in _GRID[1] for g in _GRID[2] for x in _GRID[3]]))
_F = "CASE WHEN g = 0 THEN CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END WHEN n = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * g + n) END"


@query(f"""WITH {_OWNED}, {ORDERS}, settings AS ({_GRID_SQL}), x AS (SELECT * FROM o, settings), {_expected_sql('x', 'tau', 'gamma', 'miss', 'setting, q_id')},
    kept AS (SELECT setting, q_id, y FROM taken WHERE method = 'expected_f' UNION ALL SELECT setting, q_id, y FROM x WHERE method = 'threshold' AND p >= tau),
    per AS (SELECT setting, q_id, count(*) AS n, sum(y) AS tp FROM kept GROUP BY 1, 2), g AS (SELECT q_id, sum(y) AS g FROM p GROUP BY 1)
    SELECT setting, method, tau, gamma, miss, round(avg({_F}), 6) AS macro_f05 FROM (SELECT s.*, e.q_id, coalesce(g, 0) AS g, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp FROM settings s CROSS JOIN e LEFT JOIN per USING (setting, q_id) LEFT JOIN g USING (q_id)) GROUP BY ALL""")
def decision_grid_tune(spark, d):
    scored = worlds.pairs(spark, d)
    tuned = decide.tune(scored.select("q_id", "i_id", "p"), worlds.orders(spark, d), worlds.true_pairs(scored), decide.grid(spark, *_GRID))
    return tuned.withColumn("macro_f05", F.round("macro_f05", 6))


@query(f"WITH {PAIRS}, h AS (SELECT q_id, i_id, p, y, (p - 0.01 * line + qty / 100) AS h FROM p), c AS (SELECT count(*) AS n FROM p WHERE y = 1) SELECT q_id, i_id, y FROM h WHERE y = 1 UNION ALL (SELECT q_id, i_id, y FROM (SELECT *, row_number() OVER (ORDER BY round(h, 6) DESC, q_id, i_id) AS rn FROM h WHERE y = 0) WHERE rn <= greatest(0, (SELECT (n * 3) // 2 FROM c) - (SELECT n FROM c)))")
def hard_negative_cap(spark, d):
    scored = worlds.pairs(spark, d)
    rows = scored.select("q_id", "i_id", "y", F.round(F.col("p") - 0.01 * F.col("line") + F.col("qty") / 100, 6).alias("bscore"), F.lit(0.0).alias("dcos"), F.lit(0).alias("brank"))
    return model.hard_negatives(rows, scored.where("y = 1").count() * 3 // 2).select("q_id", "i_id", "y")


_UNIFORM = "((('0x' || substr(md5(q_id || '|' || i_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)"


@query(f"WITH {PAIRS}, n AS (SELECT q_id, i_id, ln(qty) - ln(-ln({_UNIFORM})) AS key FROM p WHERE y = 0 AND qty > 0) SELECT q_id, i_id FROM (SELECT *, row_number() OVER (ORDER BY key DESC, q_id, i_id) AS rn FROM n) WHERE rn <= (SELECT count(*) // 3 FROM n)")
def weighted_negatives(spark, d):
    negatives = worlds.pairs(spark, d).where("y = 0 and qty > 0").withColumn("qty", F.col("qty").cast("double"))
    return model.weighted_sample(negatives, "qty", negatives.count() // 3, "q_id", "i_id").select("q_id", "i_id")


@query(f"WITH {PAIRS} SELECT q_id, i_id, p FROM (SELECT *, row_number() OVER (ORDER BY p DESC, q_id, i_id) AS rn FROM p) WHERE rn <= (SELECT count(*) // 4 FROM p)")
def shortlist_truncation(spark, d):
    scored = worlds.pairs(spark, d).select("q_id", "i_id", "p")
    return model.truncated(scored, scored.count() // 4)


@query(f"WITH {PAIRS}, c AS (SELECT p_partkey AS i_id FROM part WHERE p_size > 10) SELECT 'known' AS part, count(*) AS n FROM p JOIN c USING (i_id) UNION ALL SELECT 'unknown', count(*) FROM p WHERE i_id NOT IN (SELECT i_id FROM c)")
def known_id_lookup(spark, d):
    parts = worlds.table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("i_id"))
    found, unknown = model.known_ids(worlds.pairs(spark, d).select("q_id", "i_id"), parts, "i_id")
    return found.agg(F.count(F.lit(1)).alias("n")).select(F.lit("known").alias("part"), "n").unionByName(unknown.select(F.lit("unknown").alias("part"), F.col("n_unknown").alias("n")))


# --- metrics and reports -----------------------------------------------------------------------------

def _vector_case(spark, d):
    rows = worlds.vectors(spark, d)
    entities = rows.where("rec_id % 5 = 0").select(F.col("rec_id").alias("q_id"), F.col("label").cast("string").alias("country"))
    candidates = _knn(spark, d)
    selected = candidates.where("rank <= 3").withColumn("p", F.col("cosine"))
    return entities, worlds.vector_truth(rows), candidates, selected


_COUNTS = """c AS (SELECT e.q_id, e.country, coalesce(g, 0) AS g, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp FROM e LEFT JOIN (SELECT q_id, count(*) AS g FROM t GROUP BY 1) USING (q_id)
    LEFT JOIN (SELECT q_id, count(*) AS n, count(t.i_id) AS tp FROM k LEFT JOIN t USING (q_id, i_id) WHERE rank <= 3 GROUP BY 1) USING (q_id))"""


@query(f"WITH {VECTORS}, {_COUNTS} SELECT country, round(avg({_F}), 6) AS macro_f05, count(*) AS n_entities FROM c GROUP BY ROLLUP (country)")
def macro_f05_rollup(spark, d):
    entities, truth, _, selected = _vector_case(spark, d)
    return decide.macro_f05(decide.entity_counts(entities, truth, selected), "country").withColumn("macro_f05", F.round("macro_f05", 6))


@query(f"""WITH {VECTORS}, {_COUNTS}, x AS (SELECT *, {_F} AS f, {_F.replace('n = 0', 'tp = 0').replace('+ n)', '+ tp)')} AS f1, CASE WHEN g = 0 THEN CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END ELSE 1.25 * g / (0.25 * g + n + g - tp) END AS f2 FROM c)
    SELECT country, count(*) AS n, round(avg(f), 6) AS f05, round(avg((f >= 1)::INT), 6) AS perfect, sum(tp)::BIGINT AS tp, sum(n - tp)::BIGINT AS fp, sum(g - tp)::BIGINT AS fn, round(avg(f1), 6) AS f05_without_fp, round(avg(f2), 6) AS f05_without_fn,
    count(*) FILTER (WHERE g = 0) AS singletons, count(*) FILTER (WHERE g = 0 AND x.n = 0) AS singletons_right, count(*) FILTER (WHERE g > 0 AND x.n = 0) AS empty_but_matched FROM x GROUP BY ROLLUP (country)""")
def score_report(spark, d):
    entities, truth, _, selected = _vector_case(spark, d)
    out = diagnostics.score_report(decide.entity_counts(entities, truth, selected), "country")
    return out.withColumns({c: F.round(c, 6) for c in ("f05", "perfect", "f05_without_fp", "f05_without_fn")})


@query(f"""WITH {VECTORS}, s AS (SELECT cast(label AS VARCHAR) AS country, count(*) AS n_index FROM v WHERE rec_id % 5 <> 0 GROUP BY 1),
    per AS (SELECT e.country, coalesce(g, 0) AS g, coalesce(c, 0) AS c, coalesce(h, 0) AS h FROM e LEFT JOIN (SELECT q_id, count(*) AS g FROM t GROUP BY 1) USING (q_id) LEFT JOIN (SELECT q_id, count(*) AS c FROM k GROUP BY 1) USING (q_id) LEFT JOIN (SELECT q_id, count(*) AS h FROM k JOIN t USING (q_id, i_id) GROUP BY 1) USING (q_id)),
    z AS (SELECT country, count(*) AS n, sum(c) AS pairs, sum(g) AS g, sum(h) AS h, sum(CASE WHEN g = 0 THEN (h = 0)::INT WHEN h = 0 THEN 0 ELSE 1.25 * h / (0.25 * g + h) END) AS best, count(*) FILTER (WHERE c = 0) AS without FROM per GROUP BY 1)
    SELECT country, sum(n)::BIGINT AS n, sum(pairs)::BIGINT AS pairs, round(sum(pairs) / sum(n), 6) AS pairs_per_query, round(1 - sum(pairs) / sum(n * n_index), 6) AS reduction, round(sum(h) / nullif(sum(g), 0), 6) AS recall, round(sum(best) / sum(n), 6) AS ceiling, sum(without)::BIGINT AS without FROM z LEFT JOIN s USING (country) GROUP BY ROLLUP (country)""")
def blocking_recall_report(spark, d):
    entities, truth, candidates, _ = _vector_case(spark, d)
    index = worlds.vectors(spark, d).where("rec_id % 5 <> 0").select(F.col("label").cast("string").alias("country"))
    out = diagnostics.blocking_report(entities, index, truth, candidates, "country")
    return out.withColumns({c: F.round(c, 6) for c in ("pairs_per_query", "reduction", "recall", "ceiling")})


@query(f"""WITH {VECTORS}, ks AS (SELECT unnest([1, 3, 5, 10]) AS k), g AS (SELECT q_id, count(*) AS g FROM t GROUP BY 1), per AS (SELECT ks.k, q_id, count(*) AS c, count(t.i_id) AS h FROM ks JOIN k ON rank <= ks.k LEFT JOIN t USING (q_id, i_id) GROUP BY 1, 2)
    SELECT k::INT AS k, sum(c)::BIGINT AS pairs, round(sum(c) / (SELECT count(*) FROM e), 6) AS pairs_per_query, round(sum(h) / (SELECT count(*) FROM t), 6) AS recall,
    round((sum(CASE WHEN g IS NULL OR h = 0 THEN 0 ELSE 1.25 * h / (0.25 * g + h) END) + (SELECT count(*) FROM e) - (SELECT count(*) FROM g)) / (SELECT count(*) FROM e), 6) AS ceiling FROM per LEFT JOIN g USING (q_id) GROUP BY 1""")
def recall_curve(spark, d):
    entities, truth, candidates, _ = _vector_case(spark, d)
    return diagnostics.recall_curve(entities, truth, candidates, (1, 3, 5, 10)).withColumns({c: F.round(c, 6) for c in ("pairs_per_query", "recall", "ceiling")})


@query(f"""WITH {VECTORS}, m AS (SELECT * FROM k WHERE rank <= 3), a AS (SELECT n, count(*) AS n_true FROM (SELECT e.q_id, count(t.i_id) AS n FROM e LEFT JOIN t USING (q_id) GROUP BY 1) GROUP BY 1), b AS (SELECT n, count(*) AS n_made FROM (SELECT e.q_id, count(m.i_id) AS n FROM e LEFT JOIN m USING (q_id) GROUP BY 1) GROUP BY 1)
    SELECT n, coalesce(n_true, 0) AS n_true, coalesce(n_made, 0) AS n_made FROM a FULL JOIN b USING (n)""")
def match_histogram(spark, d):
    entities, truth, _, selected = _vector_case(spark, d)
    return diagnostics.match_histogram(entities, truth, selected)


@query(f"""WITH {VECTORS}, m AS (SELECT q_id, i_id FROM k WHERE rank <= 3), x AS (SELECT CASE WHEN k.i_id IS NULL THEN 'blocking_miss' ELSE 'missed_in_candidates' END AS category FROM (SELECT * FROM t EXCEPT SELECT * FROM m) t LEFT JOIN k USING (q_id, i_id)
    UNION ALL SELECT CASE WHEN q_id NOT IN (SELECT q_id FROM t) THEN 'fp_on_singleton' WHEN i_id IN (SELECT i_id FROM t) THEN 'fp_stolen' ELSE 'fp_distractor' END FROM (SELECT * FROM m EXCEPT SELECT * FROM t)) SELECT category, count(*) AS n FROM x GROUP BY 1""")
def error_taxonomy(spark, d):
    _, truth, candidates, selected = _vector_case(spark, d)
    return diagnostics.error_taxonomy(truth, candidates, selected)


@query(f"""WITH {VECTORS}, m AS (SELECT q_id, i_id FROM k WHERE rank <= 3), x AS (SELECT q_id, CASE WHEN k.i_id IS NULL THEN 'blocking_miss' ELSE 'missed_in_candidates' END AS category FROM (SELECT * FROM t EXCEPT SELECT * FROM m) t LEFT JOIN k USING (q_id, i_id)
    UNION ALL SELECT q_id, CASE WHEN q_id NOT IN (SELECT q_id FROM t) THEN 'fp_on_singleton' WHEN i_id IN (SELECT i_id FROM t) THEN 'fp_stolen' ELSE 'fp_distractor' END FROM (SELECT * FROM m EXCEPT SELECT * FROM t))
    SELECT country, category, count(*) AS n FROM x JOIN e USING (q_id) GROUP BY GROUPING SETS ((country, category), (category))""")
def error_taxonomy_by_country(spark, d):
    entities, truth, candidates, selected = _vector_case(spark, d)
    return diagnostics.error_taxonomy(truth, candidates, selected, entities, "country")


@query(f"WITH {PAIRS} SELECT q_id, src, count(*) AS n FROM (SELECT q_id, (i_id % 2 + 2)::INT AS src FROM p) GROUP BY 1, 2 HAVING count(*) > CASE src WHEN 2 THEN 2 ELSE 3 END")
def caps_violations(spark, d):
    return diagnostics.cap_violations(worlds.pairs(spark, d).withColumn("src", (F.col("i_id") % 2 + 2).cast("int")), {2: 2, 3: 3})


@query(f"WITH {PAIRS} SELECT i_id, count(DISTINCT q_id) AS owners FROM p GROUP BY 1 HAVING count(DISTINCT q_id) > 1")
def shared_owners(spark, d):
    return diagnostics.shared_owners(worlds.pairs(spark, d))


@query(f"""WITH {PAIRS}, m AS (SELECT y = 1 AS found, p >= 0.5 AS high, qty > 25 AS large, line = 1 AS first_line FROM p), r AS (SELECT 'high' AS trait, avg(high::INT) FILTER (WHERE NOT found) AS missed, avg(high::INT) FILTER (WHERE found) AS found FROM m
    UNION ALL SELECT 'large', avg(large::INT) FILTER (WHERE NOT found), avg(large::INT) FILTER (WHERE found) FROM m UNION ALL SELECT 'first_line', avg(first_line::INT) FILTER (WHERE NOT found), avg(first_line::INT) FILTER (WHERE found) FROM m)
    SELECT trait, round(missed, 6) AS missed, round(found, 6) AS found, round(missed / found, 6) AS lift FROM r""")
def trait_lift(spark, d):
    marked = worlds.pairs(spark, d).select((F.col("y") == 1).alias("found"), (F.col("p") >= 0.5).alias("high"), (F.col("qty") > 25).alias("large"), (F.col("line") == 1).alias("first_line"))
    return diagnostics.trait_lift(marked, ["high", "large", "first_line"]).withColumns({c: F.round(c, 6) for c in ("missed", "found", "lift")})


@query(f"""WITH {PAIRS}, g AS (SELECT q_id, sum(y)::DOUBLE AS g FROM p GROUP BY 1), r AS (SELECT q_id, row_number() OVER w AS k, sum(y) OVER (w ROWS UNBOUNDED PRECEDING) AS tp FROM p WINDOW w AS (PARTITION BY q_id ORDER BY p DESC, i_id)),
    f AS (SELECT q_id, k, g, CASE WHEN g = 0 THEN 0 ELSE round(1.25 * tp / (0.25 * g + k), 9) END AS f FROM r JOIN g USING (q_id)), b AS (SELECT q_id, g, k, f, row_number() OVER (PARTITION BY q_id ORDER BY f DESC, k) AS rn FROM f)
    SELECT q_id, CASE WHEN (CASE WHEN g = 0 THEN 1 ELSE 0 END) >= f THEN 0 ELSE k END::INT AS best_k, round(greatest(CASE WHEN g = 0 THEN 1 ELSE 0 END, f), 6) AS best_f05 FROM b WHERE rn = 1""")
def oracle_topk_bound(spark, d):
    scored = worlds.pairs(spark, d)
    return diagnostics.oracle_prefix(scored.select("q_id", "i_id", "p"), worlds.true_pairs(scored)).withColumn("best_f05", F.round("best_f05", 6))


@query(f"""WITH {PAIRS}, {ORDERS}, taus AS (SELECT unnest([0.2, 0.5, 0.8])::DOUBLE AS tau), g AS (SELECT q_id, sum(y) AS g FROM p GROUP BY 1), m AS (SELECT q_id, tau, count(*) AS n, sum(y) AS tp FROM p JOIN taus ON p >= tau GROUP BY 1, 2),
    x AS (SELECT tau, country, coalesce(g, 0) AS g, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp FROM e CROSS JOIN taus LEFT JOIN g USING (q_id) LEFT JOIN m USING (q_id, tau)) SELECT tau, country, round(avg({_F}), 6) AS macro_f05 FROM x GROUP BY GROUPING SETS ((tau, country), (tau))""")
def threshold_sweep_by_country(spark, d):
    scored = worlds.pairs(spark, d)
    return diagnostics.threshold_sweep(scored, worlds.orders(spark, d), worlds.true_pairs(scored), [0.2, 0.5, 0.8], "country").withColumn("macro_f05", F.round("macro_f05", 6))


@query(f"WITH {PAIRS} SELECT line, count(*) AS n, round(avg(y), 6) AS positive_rate, round(avg(p), 6) AS mean_p, round(avg(p) FILTER (WHERE y = 1), 6) AS mean_p_true FROM p GROUP BY 1")
def segment_calibration(spark, d):
    return diagnostics.calibration(worlds.pairs(spark, d), "line").withColumns({c: F.round(c, 6) for c in ("positive_rate", "mean_p", "mean_p_true")})


@query("""WITH x AS (SELECT p_brand, p_partkey % 3 AS m FROM part WHERE split_part(lower(p_name), ' ', 1) <> split_part(lower(p_name), ' ', 2)), t AS (SELECT p_brand, unnest(CASE m WHEN 0 THEN ['legal_suffix_added', 'token_appended'] WHEN 1 THEN ['word_transposition'] ELSE ['name_truncated'] END) AS tag FROM x),
    n AS (SELECT coalesce(p_brand, 'ALL') AS source, count(*) AS n FROM x GROUP BY ROLLUP (p_brand)), c AS (SELECT coalesce(p_brand, 'ALL') AS source, tag, count(*) AS c FROM t GROUP BY GROUPING SETS ((p_brand, tag), (tag))) SELECT source, tag, round(c / n, 6) AS rate FROM c JOIN n USING (source)""")
def tag_rates(spark, d):
    first, second = (F.split_part(F.lower("p_name"), F.lit(" "), F.lit(i)) for i in (1, 2))
    made = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lower("p_name"), F.lit(" ltd"))).when(F.col("p_partkey") % 3 == 1, F.concat(second, F.lit(" "), first)).otherwise(first)
    rows = worlds.table(spark, d, "part").where(first != second).select("p_brand", F.lower("p_name").alias("a"), made.alias("b"))
    tagged = rows.select("p_brand", diagnostics.name_tags(F.col("a"), F.col("b"), F.col("a"), F.col("b")).alias("tags"))
    return diagnostics.tag_rates(tagged, "tags", "p_brand").withColumn("rate", F.round("rate", 6))


# --- lists -----------------------------------------------------------------------------------------

@query(f"WITH {_OWNED}, {ORDERS} SELECT e.q_id, coalesce(ids, '') AS ids FROM e LEFT JOIN (SELECT q_id, string_agg('S2-' || i_id, ',' ORDER BY p DESC, 'S2-' || i_id) AS ids FROM o WHERE p >= 0.5 GROUP BY 1) USING (q_id)")
def id_list_output(spark, d):
    selected = decide.select_threshold(decide.one_owner(worlds.pairs(spark, d)), 0.5).withColumn("i_id", F.concat(F.lit("S2-"), F.col("i_id").cast("string")))
    return records.id_lists(worlds.orders(spark, d), selected)


@query(f"""WITH {_OWNED}, {ORDERS}, l AS (SELECT q_id, array_agg(i_id) AS ids FROM o GROUP BY 1) SELECT 'repeated_row' AS fault, count(*) AS n FROM (SELECT q_id FROM l GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'repeated_id', count(*) FROM l WHERE len(ids) <> len(list_distinct(ids))
    UNION ALL SELECT 'bad_prefix', count(*) FROM l WHERE len(list_filter(ids, lambda x: x % 7 = 0)) > 0 UNION ALL SELECT 'missing_row', count(*) FROM e WHERE q_id NOT IN (SELECT q_id FROM l) UNION ALL SELECT 'extra_row', count(*) FROM l WHERE q_id NOT IN (SELECT q_id FROM e)""")
def validate_lists(spark, d):
    owned = decide.one_owner(worlds.pairs(spark, d)).withColumn("i_id", F.concat(F.when(F.col("i_id") % 7 == 0, "X9-").otherwise("S3-"), F.col("i_id").cast("string")))
    lists = owned.groupBy("q_id").agg(F.array_join(F.collect_list("i_id"), ",").alias("ids"))
    return records.list_faults(lists, worlds.orders(spark, d))


@query(f"WITH {VECTORS}, m AS (SELECT q_id, i_id FROM k WHERE rank <= 3) SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM t INTERSECT SELECT * FROM m) UNION ALL SELECT 'true_only', count(*) FROM (SELECT * FROM t EXCEPT SELECT * FROM m) UNION ALL SELECT 'made_only', count(*) FROM (SELECT * FROM m EXCEPT SELECT * FROM t) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM t UNION SELECT * FROM m)")
def set_ops_pairs(spark, d):
    _, truth, _, selected = _vector_case(spark, d)
    t, m = truth.select("q_id", "i_id"), selected.select("q_id", "i_id")
    parts = {"both": t.intersect(m), "true_only": t.exceptAll(m), "made_only": m.exceptAll(t), "either": t.union(m).distinct()}
    return decide.union_of([x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n") for k, x in parts.items()])


# --- features and models -----------------------------------------------------------------------------

def _feature_pairs(spark, d) -> DataFrame:
    """Normalised part records, asked by customers' favourite brand: pairs that share a type and a brand."""
    from kinfolk.functions.normalise import normalise

    parts = worlds.table(spark, d, "part")
    rows = parts.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("entity_id"), F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " Ltd").otherwise(" Limited & Sons")).alias("business_name"), F.concat(F.col("p_size").cast("string"), F.lit(" "), F.col("p_brand"), F.lit(" Rd, Springfield, "), F.when(F.col("p_size") % 3 == 0, "Texas").otherwise("TX")).alias("business_address"), F.lit("US").alias("country"), F.col("p_type"), F.col("p_brand"), F.col("p_size"), F.col("p_partkey"))
    forms = normalise(rows).withColumn("src", F.lit(2) + F.col("p_partkey") % 2)
    asks, index = forms.where("p_partkey % 5 = 0"), forms.where("p_partkey % 5 <> 0")
    key = ["p_type", "p_brand", "p_size"]
    pairs = asks.select(F.col("entity_id").alias("q_id"), "ckey", *key).join(index.select(F.col("entity_id").alias("i_id"), *key), key)
    pairs = pairs.withColumns({"bscore": F.col("p_size").cast("double"), "bits": F.lit(17), "brank": F.pmod(F.hash("q_id", "i_id"), F.lit(48))}).drop(*key)
    gathered = features.gather(pairs, asks, index)
    out = features.provenance_features(features.costly_features(features.address_features(features.name_features(gathered))))
    return features.context_features(features.frequency_features(out, asks, index))


@query()
def pair_features(spark, d):
    rows = _feature_pairs(spark, d)
    return rows.select("q_id", "i_id", *(c for c in rows.columns if c[:2] in ("n_", "a_", "g_", "b_") or c.startswith(("bit_", "i_rank", "i_diff", "q_name", "i_name_df"))))


@query(f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY p DESC, i_id) AS n FROM p) SELECT r.q_id, r.i_id, a.i_id AS ref1, b.i_id AS ref2 FROM r LEFT JOIN r a ON a.q_id = r.q_id AND a.n = CASE WHEN r.n = 1 THEN 2 ELSE 1 END LEFT JOIN r b ON b.q_id = r.q_id AND b.n = CASE WHEN r.n <= 2 THEN 3 ELSE 2 END")
def reference_candidates(spark, d):
    return features.reference_candidates(worlds.pairs(spark, d).withColumnRenamed("p", "p1")).select("q_id", "i_id", "ref1", "ref2")


@query(f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY p DESC, i_id) AS g, row_number() OVER (PARTITION BY i_id ORDER BY p DESC, q_id) AS i FROM p)
    SELECT q_id, i_id, round(ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))), 5) AS p1_logit, g::INT AS g_rank_p1, i::INT AS i_rank_p1, round(p - max(p) OVER (PARTITION BY q_id), 6) AS g_diff_p1, round(sum(p) OVER (PARTITION BY q_id), 6) AS g_sum_p1,
    sum((p > 0.5)::INT) OVER (PARTITION BY q_id)::BIGINT AS g_cnt50_p1, count(*) OVER (PARTITION BY q_id) AS q_ncand, count(*) OVER (PARTITION BY i_id) AS i_ncand_s1 FROM r""")
def second_stage_features(spark, d):
    out = features.second_stage_features(worlds.pairs(spark, d).select("q_id", "i_id", F.col("p").alias("p1")))
    return out.select("q_id", "i_id", F.round("p1_logit", 5).alias("p1_logit"), "g_rank_p1", "i_rank_p1", F.round("g_diff_p1", 6).alias("g_diff_p1"), F.round("g_sum_p1", 6).alias("g_sum_p1"), "g_cnt50_p1", "q_ncand", "i_ncand_s1")


def _labelled(spark, d) -> DataFrame:
    docs = worlds.documents(spark, d).select("rec_id", F.size("name").cast("double").alias("words"), F.size(F.array_distinct("name")).cast("double").alias("distinct"), F.size("nums").cast("double").alias("numbers"), F.length("text").cast("double").alias("chars"))
    labels = worlds.table(spark, d, "labels").select(F.col("doc_id").alias("rec_id"), F.col("quality").alias("y"))
    return model.with_fold(docs.join(labels, "rec_id"), "rec_id")


@query()
def gbt_oof_scores(spark, d):
    scored = model.out_of_fold(_labelled(spark, d), ["words", "distinct", "numbers", "chars"], [0, 1, 2], rounds=5, depth=3)
    return scored.select("rec_id", "fold", "y", F.round("p", 6).alias("p"))


@query()
def isotonic_calibration(spark, d):
    scored = _labelled(spark, d).select("rec_id", "fold", "y", (F.col("distinct") / F.greatest("words", F.lit(1.0))).alias("p"))
    return model.calibrate(scored, F.col("fold") < 8).select("rec_id", F.round("p_calibrated", 6).alias("p_calibrated"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
