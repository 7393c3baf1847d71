"""Mixing to target weights with soft membership. DataFrame and SQL functions only.

A naive-Bayes classifier over hashed words and a few shape features, learned from the label table,
gives each document a posterior over domains. Nonnegative rates then fit

    sum over documents of rate * tokens * posterior[k] = target[k] * total     for each domain k

by projected-gradient least squares with spectral steps. Documents of like posteriors share a rate: their posteriors
fall into one cell of a grid of ``GRID`` steps (at most ``GRID``^2 / 2 cells, whatever the corpus). One aggregation
sums all documents' expected tokens by cell, exactly; a step then subtracts posterior . y from every cell's rate and
clips at zero (and at ``most``), y being the scaled residual, and is one aggregation of that bounded table. The length of
a step follows from the curvature that the last one met (Barzilai and Borwein). Steps go on until every target is met within ``tolerance``, the objective stands still or ``iterations`` are done. The mixture's total is the largest of
a ladder at which every target is met. Nothing of a document's goes to the driver.

Bounds: ``train_rows`` labelled rows are used in expectation (of all languages and sources alike); the
word features are ``BUCKETS`` hash buckets. All documents' tokens enter the fit.

Defined results
---------------
* Null text has no tokens and the prior as its posterior. Labels with a null are ignored; without
  any label the posterior is uniform. Several labels of a document all count.
* No tokens at all: every rate is 1. A null doc_id draws the same lot for all such rows.
* A domain too short of tokens for its target gives what the others leave: it takes no part in the fit.
* Targets that no total of the ladder can meet (labels too few to tell the domains apart): the least squares
  at the full total with residuals weighed by the domains' own tokens, so that vague posteriors don't empty the mixture; ``miss`` tells by how much.
* Empty table: no rows. Extra columns are carried by ``thin`` whatever their names: own columns take names that are free.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolk.llm.storage import stored

BUCKETS = 8192
#: Steps of the grid of posteriors; a rate belongs to a cell.
GRID = 400
#: Shares of the full total that are tried in turn.
LADDER = (1.0, 0.92, 0.84, 0.75, 0.65)
#: A domain is short where its target needs more than this share of its tokens.
SUPPLY = 0.95
#: Documents of either quality, and toxic ones; the weights of tokens that the mixture aims at.
DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.96, "poor": 0.03, "toxic": 0.01}


# --- features ----------------------------------------------------------------------------------

def words_of(text: Column) -> Column:
    """Words between ASCII white space, as they stand."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), " "), "")


def _level(x: Column, name: str, levels: int) -> Column:
    return F.hash(F.lit(name), F.least(F.floor(x * levels), F.lit(levels - 1)))


def features_of(words: Column, distinct: Column) -> Column:
    """Distinct hash buckets of the words, of their last two characters, and of the text's shape; ``distinct`` holds the words once."""
    shape = [
        _level(F.size(distinct) / F.greatest(F.size(words), F.lit(1)), "distinct", 10),
        _level(F.log2(F.size(words) + F.lit(1)) / 20, "length", 20),
    ]
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS))
    return F.array_distinct(F.concat(F.transform(distinct, lambda w: bucket(F.hash(w))), F.transform(distinct, lambda w: bucket(F.hash(F.substring(w, -2, 2), F.lit(1)))), F.array(*map(bucket, shape))))


def _domain(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).select(
        F.col("doc_id").alias("__label_id"),
        F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1).alias("__domain"),
    )


# --- classifier --------------------------------------------------------------------------------

class DomainClassifier:
    """Naive Bayes over feature buckets; ``weights[k][b]`` is 0 where a bucket tells nothing certain."""

    def __init__(self, priors: list[float], weights: list[list[float]]):
        self.priors, self.weights = priors, weights

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, certain: float = 4.0) -> DomainClassifier:
        known = _domain(labels)
        total = known.count()
        n_domains = len(DOMAINS)
        if not total:
            return cls([1 / n_domains] * n_domains, [[0.0] * BUCKETS] * n_domains)
        share = math.ceil(min(1.0, train_rows / total) * 1_000_000)
        drawn = known.where(F.pmod(F.xxhash64("__label_id", F.monotonically_increasing_id()), F.lit(1_000_000)) < share)
        # The draw is bounded by train_rows, so it may be broadcast; texts stay where they are.
        rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("__label_id"))
        rows = rows.select("__domain", words_of(F.col("text")).alias("words")).withColumn("once", F.array_distinct("words")).select("__domain", features_of(F.col("words"), F.col("once")).alias("buckets"))
        # An extra bucket, -1, counts the documents.
        counts = rows.select("__domain", F.explode(F.concat("buckets", F.array(F.lit(-1)))).alias("bucket")).groupBy("__domain", "bucket").count().collect()
        seen = [[0] * (BUCKETS + 1) for _ in DOMAINS]
        for r in counts:
            seen[r["__domain"]][r["bucket"]] = r["count"]
        sizes = [s[-1] for s in seen]
        n = sum(sizes)
        if not n:
            return cls([1 / n_domains] * n_domains, [[0.0] * BUCKETS] * n_domains)
        weights = [[0.0] * BUCKETS for _ in DOMAINS]
        for b in range(BUCKETS):
            everywhere = sum(s[b] for s in seen)
            if not everywhere:
                continue
            p = (everywhere + 1) / (n + 2)
            for k in range(n_domains):
                expected = p * sizes[k]
                if abs(seen[k][b] - expected) > certain * math.sqrt(expected * (1 - p) + 1):
                    weights[k][b] = math.log((seen[k][b] + 1) / (sizes[k] + 2)) - math.log(p)
        return cls([(s + 1) / (n + n_domains) for s in sizes], weights)

    def scores(self, buckets: Column) -> Column:
        """Log odds of the second and third domain against the first, fixed-point sums packed in one long (32 bits each)."""
        first, *others = self.weights
        step = lambda w, b: round((w[b] - first[b]) * FIXED)
        table = F.split(F.lit(",".join(str((step(others[0], b) << 32) + step(others[1], b)) for b in range(BUCKETS))), ",").cast("array<bigint>")
        start = [round(math.log(p / self.priors[0]) * FIXED) for p in self.priors[1:]]
        return F.aggregate(buckets, F.lit((start[0] << 32) + start[1]).cast("bigint"), lambda s, b: s + F.get(table, b))


#: Steps of a log weight in fixed point: 2 * BUCKETS weights below 30 stay within 31 bits.
FIXED = 4096


def _free(columns: list[str]) -> Callable[[str], str]:
    """Names for own columns that clash with none of the table's."""
    mark = "__mix"
    while any(c.lower().startswith(mark) for c in columns):
        mark += "_"
    return lambda name: mark + name


def with_posteriors(docs: DataFrame, model: DomainClassifier, name: Callable[[str], str], text_col: str = "text") -> DataFrame:
    """docs with the number of tokens and one posterior per domain: a softmax of the scores; ``name`` gives the columns' names."""
    # One projection each, so that nothing costly is computed twice.
    words, once, odds = (F.col(name(c)) for c in ("words", "once", "odds"))
    out = docs.withColumn(name("words"), words_of(F.col(text_col).cast("string"))).withColumn(name("once"), F.array_distinct(words))
    out = out.withColumn(name("n"), F.size(words).cast("long")).withColumn(name("odds"), features_of(words, once)).drop(name("words"), name("once"))
    out = out.withColumn(name("odds"), model.scores(odds))
    second = F.shiftright(F.shiftleft(odds, 32), 32)
    first = F.shiftright(odds - second, 32)
    scores = [F.lit(0.0), first / F.lit(float(FIXED)), second / F.lit(float(FIXED))]
    others = [sum((F.exp(F.least(x - y, F.lit(700.0))) for x in scores), F.lit(0.0)) for y in scores]
    return out.withColumns({name(f"p_{d}"): F.lit(1.0) / z for d, z in zip(DOMAINS, others)}).drop(name("odds"))


# --- rates -------------------------------------------------------------------------------------

def cell_of(p_second: Column, p_third: Column) -> Column:
    """Number of a document's cell on the grid of posteriors."""
    return (F.rint(p_second * GRID) * (GRID + 1) + F.rint(p_third * GRID)).cast("int")


def cells_of(table: DataFrame, name: Callable[[str], str]) -> DataFrame:
    """cell, n (its tokens) and m0, m1, m2 (expected tokens of the domains), summed over all documents."""
    n = F.col(name("n")).cast("double")
    cell = cell_of(*(F.col(name(f"p_{d}")) for d in DOMAINS[1:]))
    return table.groupBy(cell.alias("cell")).agg(F.sum(n).alias("n"), *(F.sum(n * F.col(name(f"p_{d}"))).alias(f"m{k}") for k, d in enumerate(DOMAINS)))


class Rates:
    """The steps of a fit, a pull for each domain; ``now`` replays them for a cell."""

    def __init__(self, steps: list[list[float]], most: float, residual: list[float], goal: list[float | None]):
        self.steps, self.most, self.residual, self.goal = steps, most, residual, goal

    @property
    def miss(self) -> float:
        """Largest share of its target by which a domain that isn't short (goal None) misses it."""
        return max((abs(r) / g for r, g in zip(self.residual, self.goal) if g), default=0.0)

    def now(self) -> Column:
        """A struct: the rate, and the rate one step before."""
        start = F.lit(float(min(1.0, self.most)))
        state = F.struct(start.alias("rate"), start.alias("before"))
        if not self.steps:
            return state
        text = " ".join(",".join(map(repr, pull)) for pull in self.steps)
        steps = F.transform(F.split(F.lit(text), " "), lambda y: F.split(y, ",").cast("array<double>"))
        shares = [F.when(F.col("n") > 0, F.col(f"m{k}") / F.col("n")).otherwise(0.0) for k in range(len(DOMAINS))]

        def step(now: Column, y: Column) -> Column:
            pulled = now["rate"] - sum((p * F.get(y, F.lit(k)) for k, p in enumerate(shares)), F.lit(0.0))
            return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(float(self.most)), pulled)).alias("rate"), now["rate"].alias("before"))

        return F.aggregate(steps, state, step)


def fit_rates(cells: DataFrame, targets: dict[str, float] = TARGETS, most: float = 1.0, total_share: float | None = None, iterations: int = 60, tolerance: float = 2e-3) -> Rates:
    """Spectral projected gradient on sum over domains of residual^2 / target.

    cells: the stored table of ``cells_of``. total_share: the mixture's tokens as a share of all; by default the largest
    of the ladder at which every target is met, from what the first domain supplies when all of it is used.
    """
    k = range(len(DOMAINS))
    m = [F.col(f"m{i}") for i in k]
    sums = cells.agg(F.sum("n").alias("all"), *(F.sum(m[i]).alias(f"mass{i}") for i in k), *(F.sum(F.when(F.col("n") > 0, m[i] * m[i] / F.col("n"))).alias(f"g{i}") for i in k)).first()
    if not sums["all"]:
        return Rates([], most, [0.0] * len(DOMAINS), [0.0] * len(DOMAINS))
    mass = [sums[f"mass{i}"] / sums["all"] for i in k]
    weight = sum(targets.values())
    share = [max(targets[d] / weight, 1e-6) for d in DOMAINS]

    def fit(total: float, scale: list[float]) -> Rates:
        goal = [s * total if i == 0 or s * total <= SUPPLY * most * mass[i] else None for i, s in enumerate(share)]
        rates, best, still = Rates([], most, [], goal), Rates([], most, [math.inf], [1.0]), 0
        now = [x * min(1.0, most) for x in mass]
        # The first step is as long as the trace of the small matrix allows for sure.
        length = 1 / max(sum(sums[f"g{i}"] / sums["all"] / scale[i] for i in k if goal[i] is not None), 1e-12)
        while True:
            rates.residual = [0.0 if y is None else x - y for x, y in zip(now, goal)]
            still = 0 if rates.miss < 0.9 * best.miss else still + 1
            if rates.miss < best.miss:
                best = Rates(list(rates.steps), most, rates.residual, goal)
            if best.miss < tolerance or still > 6 or len(rates.steps) >= iterations:
                return best
            rates.steps.append([length * r / s for r, s in zip(rates.residual, scale)])
            moved = F.col("now.rate") - F.col("now.before")
            got = cells.withColumn("now", rates.now()).agg(*(F.sum(m[i] * F.col("now.rate")).alias(f"got{i}") for i in k), F.sum(F.col("n") * moved * moved).alias("moved")).first()
            after = [x / sums["all"] for x in got[:-1]]
            met = sum((x - y) ** 2 / s for x, y, s, g in zip(after, now, scale, goal) if g is not None)
            now = after
            if met > 0:
                length = got["moved"] / sums["all"] / met

    if total_share is not None:
        return fit(total_share, share)
    full = min(1.0, most * mass[0] / share[0])
    for part in LADDER:
        rates = fit(full * part, share)
        if rates.miss <= tolerance * 5:
            return rates
    return fit(full, [max(x, 1e-6) for x in mass])


def _fitted(scored: DataFrame, name: Callable[[str], str], targets: dict[str, float], most: float) -> tuple[DataFrame, Rates]:
    """The scored rows with the rate of their cell; at most GRID^2 / 2 cells are broadcast (1 MB)."""
    cells = stored(cells_of(scored, name).coalesce(1), "mixing-cells")
    rates = fit_rates(cells, targets, most)
    found = stored(cells.select(F.col("cell").alias(name("cell")), rates.now()["rate"].alias(name("rate"))), "mixing-rates")
    cell = cell_of(*(F.col(name(f"p_{d}")) for d in DOMAINS[1:]))
    return scored.join(F.broadcast(found), cell == F.col(name("cell"))), rates


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, most: float = 1.0) -> DataFrame:
    """One row per input row: doc_id, n_tokens, p_<domain>, rate, kept, miss (of the worst domain, a share of its target)."""
    model, name = DomainClassifier.fit(docs, labels), _free(["doc_id", "text"])
    scored = stored(with_posteriors(docs.select("doc_id", "text"), model, name).drop("text"), "mixing-posteriors")
    rated, rates = _fitted(scored, name, targets, most)
    return rated.select(
        "doc_id", F.col(name("n")).alias("n_tokens"), *(F.col(name(f"p_{d}")).alias(f"p_{d}") for d in DOMAINS),
        F.col(name("rate")).alias("rate"), (lot(F.col("doc_id")) < F.col(name("rate"))).alias("kept"), F.lit(float(rates.miss)).alias("miss"),
    )


def thin(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows that stay when each is kept with its rate, with all their columns and no shuffle of texts."""
    model, name = DomainClassifier.fit(docs, labels), _free(docs.columns)
    # Written with the texts: reading them again costs less than scoring them again.
    rated, _ = _fitted(stored(with_posteriors(docs, model, name), "mixing-posteriors"), name, targets, 1.0)
    return rated.where(lot(F.col("doc_id")) < F.col(name("rate"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def lot(key: Column) -> Column:
    """A uniform number in [0, 1) that the key decides."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit("mixing")), 11) / F.lit(float(2**53))
