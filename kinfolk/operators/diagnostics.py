"""Reports over truth, candidates and selections. Every report is one aggregation; the null group is all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolk.functions.similarity import capped_levenshtein, jaccard
from kinfolk.functions.vocabulary import TAG_LEGAL_WORDS
from kinfolk.operators.decide import BETA2, f05
from kinfolk.operators.windows import by, running_sum


def _f(g, p, tp) -> Column:
    return f05(g, p, tp)


def score_report(counts: DataFrame, group: str) -> DataFrame:
    """counts (g, p, tp, f05, group) -> quality per group and over all, with both headrooms and singletons."""
    g, p, tp = F.col("g"), F.col("p"), F.col("tp")
    return counts.rollup(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("f05").alias("f05"), F.avg((F.col("f05") >= 1).cast("double")).alias("perfect"),
        F.sum("tp").alias("tp"), F.sum(p - tp).alias("fp"), F.sum(g - tp).alias("fn"),
        F.avg(_f(g, tp, tp)).alias("f05_without_fp"), F.avg(_f(g, p + g - tp, g)).alias("f05_without_fn"),
        F.sum((g == 0).cast("long")).alias("singletons"), F.sum(((g == 0) & (p == 0)).cast("long")).alias("singletons_right"),
        F.sum(((g > 0) & (p == 0)).cast("long")).alias("empty_but_matched"),
    )


def blocking_report(entities: DataFrame, index: DataFrame, truth: DataFrame, candidates: DataFrame, group: str) -> DataFrame:
    """Per partition and over all: pairs, pairs per query, reduction ratio, recall, ceiling of F0.5, queries without any."""
    true = truth.select("q_id", "i_id").distinct()
    made = candidates.select("q_id", "i_id").distinct()
    hit = true.join(made, ["q_id", "i_id"], "left_semi").groupBy("q_id").agg(F.count(F.lit(1)).alias("hit"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    per = (
        entities.join(true.groupBy("q_id").agg(F.count(F.lit(1)).alias("g")), "q_id", "left").join(made.groupBy("q_id").agg(F.count(F.lit(1)).alias("c")), "q_id", "left").join(hit, "q_id", "left")
        .select(group, zero("g").alias("g"), zero("c").alias("c"), zero("hit").alias("hit"))
    )
    sizes = index.groupBy(group).agg(F.count(F.lit(1)).alias("n_index"))
    sums = per.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("pairs"), F.sum("g").alias("g"), F.sum("hit").alias("hit"), F.sum(f05(F.col("g"), F.col("hit"), F.col("hit"))).alias("best"), F.sum((F.col("c") == 0).cast("long")).alias("without"))
    sums = sums.join(sizes, group, "left").withColumn("possible", F.col("n") * F.coalesce("n_index", F.lit(0)))
    share = lambda a, b: F.when(b > 0, a / b)
    return sums.rollup(group).agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs"), F.sum("g").alias("g"), F.sum("hit").alias("hit"), F.sum("best").alias("best"), F.sum("without").alias("without"), F.sum("possible").alias("possible")).select(
        group, "n", "pairs", (F.col("pairs") / F.col("n")).alias("pairs_per_query"), (1 - share(F.col("pairs"), F.col("possible"))).alias("reduction"), share(F.col("hit"), F.col("g")).alias("recall"), (F.col("best") / F.col("n")).alias("ceiling"), "without"
    )


def recall_curve(entities: DataFrame, truth: DataFrame, ranked: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """k -> pairs, pairs per query, recall, F0.5 ceiling, of ranked candidates (q_id, i_id, rank)."""
    n, true = entities.count(), truth.select("q_id", "i_id").distinct()
    g = true.groupBy("q_id").agg(F.count(F.lit(1)).alias("g"))
    total, matched = true.count(), g.count()
    marked = ranked.join(true.withColumn("y", F.lit(1)), ["q_id", "i_id"], "left")
    at = marked.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") <= F.col("k"))
    per = at.groupBy("k", "q_id").agg(F.count(F.lit(1)).alias("c"), F.count("y").alias("hit")).join(g, "q_id", "left")
    best = F.when(F.col("g").isNull(), F.lit(0.0)).otherwise(f05(F.col("g"), F.col("hit"), F.col("hit")))
    return per.groupBy("k").agg(F.sum("c").alias("pairs"), (F.sum("c") / n).alias("pairs_per_query"), (F.sum("hit") / F.lit(max(1, total))).alias("recall"), ((F.sum(best) + F.lit(n - matched)) / n).alias("ceiling"))


def match_histogram(entities: DataFrame, truth: DataFrame, selected: DataFrame) -> DataFrame:
    """(n, n_true, n_made): entities with n true, and with n selected matches."""
    def sizes(pairs: DataFrame, name: str) -> DataFrame:
        per = entities.select("q_id").join(pairs.groupBy("q_id").agg(F.count(F.lit(1)).alias("n")), "q_id", "left")
        return per.groupBy(F.coalesce("n", F.lit(0)).alias("n")).agg(F.count(F.lit(1)).alias(name))

    both = sizes(truth, "n_true").join(sizes(selected, "n_made"), "n", "full")
    return both.select("n", F.coalesce("n_true", F.lit(0)).alias("n_true"), F.coalesce("n_made", F.lit(0)).alias("n_made"))


def cap_violations(pairs: DataFrame, caps: dict[int, int]) -> DataFrame:
    """Queries with more than a source's cap of pairs (q_id, i_id, src)."""
    limit = F.coalesce(*(F.when(F.col("src") == s, F.lit(c)) for s, c in caps.items()))
    return pairs.groupBy("q_id", "src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)


def shared_owners(pairs: DataFrame) -> DataFrame:
    """Indexed records with several owners."""
    return pairs.groupBy("i_id").agg(F.count_distinct("q_id").alias("owners")).where(F.col("owners") > 1)


def error_taxonomy(truth: DataFrame, candidates: DataFrame, selected: DataFrame, entities: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """(category, n): missed pairs by where they were lost, wrong pairs by whose record they took.

    With entities (q_id, group) the counts are per group and over all (null group); a query without a row there is
    counted over all only.
    """
    true, key = truth.select("q_id", "i_id").distinct(), ["q_id", "i_id"]
    made, possible = selected.select(*key).distinct(), candidates.select(*key).distinct()
    missed = true.join(made, key, "left_anti").join(possible.withColumn("c", F.lit(1)), key, "left")
    missed = missed.select("q_id", F.when(F.col("c").isNull(), "blocking_miss").otherwise("missed_in_candidates").alias("category"))
    owner = true.select("i_id").distinct().withColumn("owned", F.lit(1))
    matched = true.select("q_id").distinct().withColumn("matched", F.lit(1))
    wrong = made.join(true, key, "left_anti").join(matched, "q_id", "left").join(owner, "i_id", "left")
    wrong = wrong.select("q_id", F.when(F.col("matched").isNull(), "fp_on_singleton").when(F.col("owned").isNotNull(), "fp_stolen").otherwise("fp_distractor").alias("category"))
    counted = missed.unionByName(wrong).groupBy("q_id", "category").agg(F.count(F.lit(1)).alias("n"))
    over_all = counted.groupBy("category").agg(F.sum("n").alias("n"))
    if entities is None:
        return over_all
    own = counted.join(entities.select("q_id", group), "q_id").groupBy(group, "category").agg(F.sum("n").alias("n"))
    return own.unionByName(over_all.select(F.lit(None).cast(own.schema[group].dataType).alias(group), "category", "n"))


def trait_lift(marked: DataFrame, traits: list[str], found: str = "found") -> DataFrame:
    """(trait, missed, found, lift): how much more often a trait holds among missed pairs."""
    sums = marked.agg(*(F.avg(F.when(F.col(found) == f, F.col(t).cast("double"))).alias(f"{t}__{int(f)}") for t in traits for f in (True, False)))
    stacked = F.explode(F.array(*(F.struct(F.lit(t).alias("trait"), F.col(f"{t}__0").alias("missed"), F.col(f"{t}__1").alias("found")) for t in traits)))
    return sums.select(stacked.alias("r")).select("r.*").withColumn("lift", F.when(F.col("found") > 0, F.col("missed") / F.col("found")))


def oracle_prefix(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query, the prefix by falling p whose F0.5 is best for the known truth: (q_id, best_k, best_f05)."""
    true = truth.select("q_id", "i_id").distinct()
    g = true.groupBy("q_id").agg(F.count(F.lit(1)).alias("g"))
    order = (F.col("p").desc(), F.col("i_id"))
    y = pairs.join(true.withColumn("y", F.lit(1)), ["q_id", "i_id"], "left").withColumn("y", F.coalesce("y", F.lit(0))).join(g, "q_id", "left").withColumn("g", F.coalesce("g", F.lit(0)))
    y = y.withColumn("k", F.row_number().over(by("q_id", *order))).withColumn("tp", running_sum("y", "q_id", *order))
    f = F.when(F.col("g") == 0, F.lit(0.0)).otherwise((1 + BETA2) * F.col("tp") / (BETA2 * F.col("g") + F.col("k")))
    best = F.max(F.struct(F.round(f, 9).alias("f"), (-F.col("k")).alias("k"))).alias("b")
    none = F.when(F.col("g") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return y.groupBy("q_id", "g").agg(best).select("q_id", F.when(none >= F.col("b.f"), F.lit(0)).otherwise(-F.col("b.k")).cast("int").alias("best_k"), F.greatest(none, F.col("b.f")).alias("best_f05"))


def threshold_sweep(pairs: DataFrame, entities: DataFrame, truth: DataFrame, taus: list[float], group: str) -> DataFrame:
    """macro F0.5 of every threshold per group and over all: (tau, group, macro_f05)."""
    true = truth.select("q_id", "i_id").distinct()
    per_entity = entities.select("q_id", group).join(true.groupBy("q_id").agg(F.count(F.lit(1)).alias("g")), "q_id", "left").withColumn("g", F.coalesce("g", F.lit(0)))
    cells = per_entity.withColumn("tau", F.explode(F.array(*map(F.lit, taus))))
    hits = pairs.select("q_id", "i_id", "p").join(true.withColumn("y", F.lit(1)), ["q_id", "i_id"], "left").withColumn("tau", F.explode(F.array(*map(F.lit, taus)))).where(F.col("p") >= F.col("tau"))
    made = hits.groupBy("q_id", "tau").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("tp"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    scored = cells.join(made, ["q_id", "tau"], "left").withColumn("f", f05(F.col("g"), zero("n"), zero("tp")))
    return scored.groupBy("tau", group).agg(F.sum("f").alias("f"), F.count(F.lit(1)).alias("n")).rollup("tau", group).agg((F.sum("f") / F.sum("n")).alias("macro_f05")).where(F.col("tau").isNotNull())


def calibration(scored: DataFrame, segment: str) -> DataFrame:
    """Per segment: pairs, share of true ones, mean p, mean p of the true ones."""
    return scored.groupBy(segment).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("double")).alias("positive_rate"), F.avg("p").alias("mean_p"), F.avg(F.when(F.col("y") == 1, F.col("p"))).alias("mean_p_true"))


# --- transformation tags -----------------------------------------------------------------------

def _tags(cases: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in cases)))


def _minus(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def name_tags(raw1: Column, raw2: Column, plain1: Column, plain2: Column) -> Column:
    """What was done to a name. raw: as given; plain: without marks, lower case."""
    t1, t2 = ascii_tokens(plain1), ascii_tokens(plain2)
    s1, s2 = F.array_distinct(t1), F.array_distinct(t2)
    legal = F.array(*map(F.lit, TAG_LEGAL_WORDS))
    c1, c2 = _minus(s1, legal), _minus(s2, legal)
    l1, l2 = F.array_intersect(s1, legal), F.array_intersect(s2, legal)
    none = lambda a: F.size(a) == 0
    both = ~none(s1) & ~none(s2)
    accent = lambda raw, plain: F.lower(raw) != plain
    grams = lambda t: F.when(F.length(t) >= 3, F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))).otherwise(F.array(t))
    squashed = [F.regexp_replace(p, "[^a-z0-9]", "") for p in (plain1, plain2)]
    differ = F.filter(F.zip_with(F.array_sort(t1), F.array_sort(t2), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda d: d["x"] != d["y"])
    near = F.exists(differ, lambda d: capped_levenshtein(d["x"], d["y"]).between(1, 2))
    return _tags([
        (~plain2.rlike("[a-z]"), "non_latin_name"),
        (accent(raw2, plain2) & ~accent(raw1, plain1), "diacritic_injected"),
        (F.lower(F.trim(raw2)).rlike(r"\.(com|net|in|co\.in|fr)\b|^www|^#"), "domain_or_handle_name"),
        (raw2.rlike(r"[\[\]{}<>|]|^\s*(--|\.\.\.)"), "bracket_or_junk_noise"),
        (both & none(F.array_intersect(s1, s2)), "name_zero_token_overlap"),
        (both & none(F.array_intersect(s1, s2)) & (jaccard(grams(squashed[0]), grams(squashed[1])) < 0.2), "name_RANDOM_replacement"),
        (both & none(_minus(c1, c2)) & none(_minus(c2, c1)) & ~none(_minus(l1, l2)), "legal_suffix_dropped"),
        (both & none(_minus(c1, c2)) & none(_minus(c2, c1)) & ~none(_minus(l2, l1)), "legal_suffix_added"),
        (both & none(_minus(s1, s2)) & ~none(_minus(s2, s1)), "token_appended"),
        (both & (F.array_sort(t1) == F.array_sort(t2)) & (t1 != t2), "word_transposition"),
        (both & none(_minus(s2, s1)) & ~none(_minus(s1, s2)), "name_truncated"),
        (both & (F.size(t1) == F.size(t2)) & (F.size(differ) == 1) & near, "typo_in_name"),
    ])


def address_tags(raw1: Column, raw2: Column, plain1: Column, plain2: Column) -> Column:
    """What was done to an address."""
    t1, t2 = ascii_tokens(plain1), ascii_tokens(plain2)
    digit = lambda t: t.rlike("^[0-9]+$")
    n1, n2 = F.filter(t1, digit), F.filter(t2, digit)
    w1, w2 = F.filter(t1, lambda t: ~digit(t)), F.filter(t2, lambda t: ~digit(t))
    none = lambda a: F.size(a) == 0
    empty = F.trim(raw2) == ""
    shared1, shared2 = F.filter(w1, lambda t: F.array_contains(w2, t)), F.filter(w2, lambda t: F.array_contains(w1, t))
    same_words = F.array_sort(w1) == F.array_sort(w2)
    other_numbers = ~none(n1) & ~none(n2) & (~none(_minus(n1, n2)) | ~none(_minus(n2, n1)))
    tags = _tags([
        (raw2.contains("<NULL>"), "null_literal_token"),
        (raw2.rlike(r"\p{Lu}") & ~raw2.rlike(r"[\p{L}&&[^\p{Lu}]]"), "address_UPPERCASED"),
        ((F.lower(raw2) != plain2) & (F.lower(raw1) == plain1), "addr_diacritic_injected"),
        (raw2.rlike(r"(?i)(^|[,\s])#|\bPO BOX\b|\bP\.O\b"), "hash_or_pobox_prefix"),
        (same_words & (w1 != w2), "component_reordered"),
        (~(same_words & (w1 != w2)) & ~none(shared1) & (shared1 != shared2), "component_reordered_partial"),
        (other_numbers & ~none(F.array_intersect(n1, n2)), "number_perturbed"),
        (other_numbers & none(F.array_intersect(n1, n2)), "number_fully_changed"),
        (~none(n1) & none(n2), "number_dropped"),
        (none(_minus(w2, w1)) & ~none(_minus(w1, w2)), "address_component_dropped"),
    ])
    return F.when(empty, F.array(F.lit("address_EMPTY"))).otherwise(tags)


def tag_rates(tagged: DataFrame, tags: str, source: str) -> DataFrame:
    """(source, tag, rate) per source and over all."""
    sizes = tagged.rollup(source).agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.coalesce(F.col(source).cast("string"), F.lit("ALL")))
    counts = tagged.select(source, F.explode(tags).alias("tag")).cube(source, "tag").agg(F.count(F.lit(1)).alias("c")).where(F.col("tag").isNotNull()).withColumn("k", F.coalesce(F.col(source).cast("string"), F.lit("ALL")))
    return counts.join(F.broadcast(sizes.select("k", "n")), "k").select(F.col("k").alias("source"), "tag", (F.col("c") / F.col("n")).alias("rate"))
