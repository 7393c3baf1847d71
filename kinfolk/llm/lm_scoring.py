"""Language-model scoring: a log-bilinear model over word classes, with exact counts inside a class.

A text's tokens are its lower-cased words and one end. P(token | history) is the product of

* P(class | last three classes), from a log-bilinear network: the history's vectors, each scaled by
  its position's weights, add up to a prediction that is compared with every class vector. It is
  trained by noise-contrastive estimation and normalised by a softmax over all classes when scoring
  (blocks of histories, one matrix product each, a history's sum kept for its next token);
* P(word | class) = (c + 1) / (N_class + V_class + 1) from counts over all training tokens. The most
  frequent words are classes of their own; every other word, known or not, belongs to the class of its
  last two bytes, and each such class reserves one place for unknown words. Both factors are normalised.

Scale: counts and classes come from all training documents. Frequent words (a bounded dictionary,
found by a histogram of counts, not by a global sort) are scored where the text is; the rest of
the words meet their counts in a join, free of hot keys for that reason. Every training token is an
example, so what the network learns from grows with the corpus: a start fitted on a bounded draw
is refined by trainers on all examples, and their parameters are averaged.

Defined results
---------------
* Null or empty text: one token, the end. A null doc_id counts as the empty text for the hold-out.
* Repeated rows are scored, and counted, as often as they occur. No training rows: N and V are 0.
* Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolk.llm.storage import stored

END = b""
HISTORY, WIDTH, SINGLES, FORMS = 3, 24, 192, 64
#: Words whose counts every task holds; a bound on the dictionary, not on what is scored.
FREQUENT = 200_000
#: Examples per document of the start's draw; examples the start is fitted on; trainers at most; examples a trainer
#: holds at once.
POSITIONS, START_EXAMPLES, TRAINERS, BLOCK_EXAMPLES = 32, 60_000, 512, 320_000
FLUSH_WORDS = 300_000


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words are runs without ASCII white space; then the end."""
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


def form_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % FORMS


# --- the network -------------------------------------------------------------------------------

class LogBilinear:
    """Class vectors, history vectors, diagonal position weights and biases."""

    def __init__(self, frequencies: np.ndarray, seed: int = 5):
        rng, n = np.random.default_rng(seed), len(frequencies)
        self.noise = (frequencies + 1.0) / (frequencies + 1.0).sum()
        self.history = rng.normal(0, 0.3, (n + 1, WIDTH)).astype(np.float32)  # the last: before the text
        self.position = np.full((HISTORY, WIDTH), 1.0 / HISTORY, np.float32)
        self.target = rng.normal(0, 0.05, (n, WIDTH)).astype(np.float32)
        self.bias = np.log(self.noise).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.history, self.position, self.target, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def load(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for p in self.parameters():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def fit(self, examples: np.ndarray, epochs: int = 1, rate: float = 0.1, batch: int = 512, noise: int = 96, seed: int = 3) -> LogBilinear:
        """Noise-contrastive estimation, AdaGrad. examples: rows of HISTORY classes (nearest first) and the class."""
        rng, n = np.random.default_rng(seed), len(self.bias)
        sums = [np.full_like(p, 1e-3) for p in self.parameters()]
        log_noise = np.log(noise * self.noise).astype(np.float32)
        reach = np.cumsum(self.noise)
        reach /= reach[-1]
        cells = np.arange(n + 1)[:, None] * WIDTH + np.arange(WIDTH)

        def summed(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
            """Sums of the values' rows that share a class."""
            return np.bincount(cells[keys].ravel(), values, (n + 1) * WIDTH).reshape(n + 1, WIDTH).astype(np.float32)

        for _ in range(epochs):
            shuffled = np.ascontiguousarray(examples[rng.permutation(len(examples))].T)
            for at in range(0, shuffled.shape[1], batch):
                h, y = shuffled[:HISTORY, at : at + batch], shuffled[HISTORY, at : at + batch]
                times = np.bincount(reach.searchsorted(rng.random(noise), side="right"), minlength=n)
                drawn = np.flatnonzero(times)
                times = times[drawn]
                guess = _guesses(self.scaled(), h)
                wanted, against = self.target[y], self.target[drawn]
                true = (guess * wanted).sum(1) + (self.bias - log_noise)[y]
                false = guess @ against.T
                false += self.bias[drawn] - log_noise[drawn]
                up = 1 / (1 + np.exp(np.clip(true, -30, 30)))  # 1 - P(from the data)
                np.negative(false, out=false)
                with np.errstate(over="ignore"):
                    np.exp(false, out=false)
                false += 1
                down = np.divide(-times.astype(np.float32), false, out=false)
                d_guess = up[:, None] * wanted + down @ against
                d_target, d_bias = summed(y, (up[:, None] * guess).ravel())[:n], np.bincount(y, up, n).astype(np.float32)
                d_target[drawn] += down.T @ guess
                d_bias[drawn] += down.sum(0)
                # By place and class, from which both the history's and the position's gradients follow.
                wide = d_guess.ravel().astype(np.float64)
                by_place = np.stack([summed(k, wide) for k in h])
                grads = [(by_place * self.position[:, None]).sum(0), (by_place * self.history).sum(1), d_target, d_bias]
                for p, g, s in zip(self.parameters(), grads, sums):
                    g /= len(y)
                    s += g * g
                    p += rate * g / np.sqrt(s)
        return self

    def scaled(self) -> list[np.ndarray]:
        """The history's vectors under each position's weights."""
        return [self.history * self.position[i] for i in range(HISTORY)]

    def log_probabilities(self, history: np.ndarray, target: np.ndarray) -> np.ndarray:
        return Normalised(self).log_probabilities(history, target)


def _guesses(scaled: list[np.ndarray], h: np.ndarray) -> np.ndarray:
    """Predictions of histories, given as a row of classes for each place."""
    guess = scaled[0][h[0]]
    for i in range(1, HISTORY):
        guess += scaled[i][h[i]]
    return guess


class Normalised:
    """A trained network's softmax. Each history's normaliser is computed once, when a text first has it.

    There are at most (classes + 1) ** HISTORY histories, so the table is bounded (68 MB for 256 classes),
    and memory is taken only for the pages in use.
    """

    def __init__(self, model: LogBilinear):
        self.scaled, self.bias = model.scaled(), model.bias
        self.weights = np.ascontiguousarray(model.target.T)
        self.parts = [s @ self.weights for s in self.scaled]  # what a class at a place adds to every logit
        self.base = len(self.bias) + 1
        self.log_sum = np.zeros(self.base**HISTORY, np.float32)  # 0: not known yet
        # No logit exceeds this bound, so where it is far from float32's the maximum needn't be taken away.
        bound = sum(np.linalg.norm(s, axis=1).max() for s in self.scaled) * np.linalg.norm(self.weights, axis=0).max() + np.abs(self.bias).max()
        self.take_top = bound > 60

    def _learn(self, keys: np.ndarray, block: int = 1024) -> None:
        ones = np.ones(len(self.bias), np.float32)
        for at in range(0, len(keys), block):
            own = keys[at : at + block]
            logits = _guesses(self.scaled, np.stack([own // self.base ** (HISTORY - 1 - i) % self.base for i in range(HISTORY)])) @ self.weights
            logits += self.bias
            top = logits.max(1) if self.take_top else np.float32(0)
            if self.take_top:
                logits -= top[:, None]
            np.exp(logits, out=logits)
            self.log_sum[own] = np.log(logits @ ones) + top

    def log_probabilities(self, history: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithm of the softmax at each target."""
        key = history[:, 0].astype(np.int64)
        for i in range(1, HISTORY):
            key = key * self.base + history[:, i]
        self._learn(np.unique(key[self.log_sum[key] == 0]))
        chosen = self.bias[target].astype(np.float64)
        for i in range(HISTORY):
            chosen += self.parts[i][history[:, i], target]
        return chosen - self.log_sum[key]


# --- counts ------------------------------------------------------------------------------------

def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, n long) over all rows; the end is the empty word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def frame() -> pd.DataFrame:
            out = pd.DataFrame({"word": list(seen), "n": np.fromiter(seen.values(), np.int64, len(seen))})
            seen.clear()
            return out

        for pdf in batches:
            for text in pdf["text"]:
                seen.update(words_of(text))
                if len(seen) > FLUSH_WORDS:
                    yield frame()
        yield frame()

    return docs.select(F.col(text_col).alias("text")).mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_floor(counts: DataFrame, most: int) -> float:
    """The least log-count bucket from which at most ``most`` words follow."""
    bucket = F.floor(F.log2(F.col("n")) * 64)
    sizes = sorted(((int(r["b"]), int(r["size"])) for r in counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("size")).collect()), reverse=True)
    total, floor = 0, math.inf
    for b, size in sizes:
        total += size
        if total > most:
            break
        floor = b
    return floor


class Vocabulary:
    """Frequent words with their counts and classes; sums of the classes of all words."""

    def __init__(self, counts: DataFrame, frequent: int = FREQUENT):
        floor = frequent_floor(counts, frequent)
        self.is_frequent: Column = F.floor(F.log2(F.col("n")) * 64) >= (floor if floor < math.inf else 1 << 40)
        rows = sorted(((bytes(r["word"]), int(r["n"])) for r in counts.where(self.is_frequent).collect()), key=lambda r: (-r[1], r[0]))
        self.words = [w for w, _ in rows]
        self.n = np.array([n for _, n in rows], dtype=np.int64)
        self.singles = min(SINGLES, len(rows))
        self.classes = np.array([i if i < self.singles else self.singles + form_of(w) for i, w in enumerate(self.words)], dtype=np.int16)
        form = F.pmod(F.crc32(F.substring(F.col("word"), -2, 2)), F.lit(FORMS))
        tokens, types = np.zeros(FORMS, np.int64), np.zeros(FORMS, np.int64)
        for r in counts.groupBy(form.alias("form")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect():
            tokens[r["form"]], types[r["form"]] = r["n"], r["types"]
        self.total, self.types = int(tokens.sum()), int(types.sum())
        for w, n in rows[: self.singles]:
            tokens[form_of(w)] -= n
            types[form_of(w)] -= 1
        self.class_tokens = np.r_[self.n[: self.singles], tokens].astype(np.float64)
        self.log_size = np.r_[np.zeros(self.singles), np.log10(tokens + types + 1.0)]
        self.log_count = np.log10(self.n + 1.0)

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    def class_of(self, word: bytes, index: dict[bytes, int]) -> int:
        i = index.get(word)
        return self.singles + form_of(word) if i is None else int(self.classes[i])


# --- training ----------------------------------------------------------------------------------

def class_sequences(docs: DataFrame, shared, text_col: str = "text") -> DataFrame:
    """(classes binary): the int16 classes of all tokens of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary: Vocabulary = shared.value
        index = vocabulary.index()
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                words = words_of(text)
                at = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
                classes = vocabulary.classes[at] if len(vocabulary.classes) else np.zeros(len(at), np.int16)
                for i in np.flatnonzero(at < 0):
                    classes[i] = vocabulary.singles + form_of(words[i])
                out.append(classes.tobytes())
            yield pd.DataFrame({"classes": out})

    return docs.select(F.col(text_col).alias("text")).mapInPandas(run, "classes binary")


def examples_of(sequences: list[bytes], before: int) -> np.ndarray:
    """Every token as an example: HISTORY classes (nearest first; ``before`` where the text hasn't begun) and its own."""
    classes = np.frombuffer(b"".join(sequences), np.int16)
    sizes = np.array([len(s) // 2 for s in sequences])
    place = np.arange(len(classes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.full((len(classes), HISTORY + 1), before, np.int16)
    out[:, HISTORY] = classes
    for k in range(1, HISTORY + 1):
        inside = np.flatnonzero(place >= k)
        out[inside, k - 1] = classes[inside - k]
    return out


def blocks_of(sequences: Iterator[bytes], before: int, most: int = BLOCK_EXAMPLES) -> Iterator[np.ndarray]:
    """All examples of the sequences, in blocks of about ``most``."""
    held, size = [], 0
    for s in sequences:
        held.append(s)
        size += len(s) // 2
        if size >= most:
            yield examples_of(held, before)
            held, size = [], 0
    if held:
        yield examples_of(held, before)


def train(sequences: DataFrame, vocabulary: Vocabulary) -> LogBilinear:
    """A start from a bounded draw, refined on every token by trainers whose parameters are averaged."""
    model = LogBilinear(vocabulary.class_tokens)
    total, before = sequences.count(), len(vocabulary.class_tokens)
    if not total:
        return model
    share = min(1.0, START_EXAMPLES / (POSITIONS * total))
    start = []
    for r in sequences.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1_000_000)) < math.ceil(share * 1_000_000)).toLocalIterator():
        own = examples_of([bytes(r["classes"])], before)
        start.append(own[np.unique(((np.arange(POSITIONS) + 0.5) / POSITIONS * len(own)).astype(int))])
    if start:
        model.fit(np.concatenate(sorted(start, key=lambda x: x.tobytes())), epochs=3)
    frequencies, flat = vocabulary.class_tokens, model.flat()

    def refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, n = LogBilinear(frequencies).load(flat), 0
        for rows in blocks_of((s for pdf in batches for s in sorted(pdf["classes"])), before):
            own.fit(rows, rate=0.03)
            n += len(rows)
        if n:
            yield pd.DataFrame({"n": [n], "parameters": [own.flat().tobytes()]})

    trainers = min(TRAINERS, int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = sequences.repartition(trainers).mapInPandas(refine, "n long, parameters binary").collect()
    if found:
        weights = np.array([r["n"] for r in found], dtype=np.float64)
        model.load(np.average([np.frombuffer(r["parameters"], np.float32) for r in found], axis=0, weights=weights))
    return model


# --- scoring -----------------------------------------------------------------------------------

SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("rare", pa.list_(pa.binary()))])


def score_block(vocabulary: Vocabulary, index: dict[bytes, int], model: Normalised, texts: list[str | None]) -> tuple:
    """Sums of a block of texts without their infrequent words, and those words."""
    words: list[bytes] = []
    sizes = []
    for text in texts:
        own = words_of(text)
        sizes.append(len(own))
        words += own
    at = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
    rare = np.flatnonzero(at < 0)
    rare_words = [words[i] for i in rare]
    classes = np.empty(len(at), np.int64)
    frequent = at >= 0
    classes[frequent] = vocabulary.classes[at[frequent]]
    classes[rare] = [vocabulary.singles + form_of(w) for w in rare_words]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    place = np.arange(len(at)) - np.repeat(starts, sizes)
    history = np.full((len(at), HISTORY), len(vocabulary.class_tokens), np.int64)
    for k in range(1, HISTORY + 1):
        inside = np.flatnonzero(place >= k)
        history[inside, k - 1] = classes[inside - k]
    log_count = np.zeros(len(at))
    log_count[frequent] = vocabulary.log_count[at[frequent]]
    found = model.log_probabilities(history, classes) / math.log(10) - vocabulary.log_size[classes]
    found += np.where(classes >= vocabulary.singles, log_count, 0.0)
    total = lambda x: np.add.reduceat(x, starts)  # noqa: E731  each text has one token at least
    return np.array(sizes), total(frequent.astype(np.int64)), total(log_count), total(found), rare_words, np.searchsorted(rare, np.r_[starts, len(at)])


def score_frequent(docs: DataFrame, shared, block_chars: int = 1 << 20) -> DataFrame:
    """One row per input row, with its infrequent words still to be looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, trained = shared.value
        index, model = vocabulary.index(), Normalised(trained)
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 33
        for batch in batches:
            ids, held, texts = (batch.column(i) for i in range(3))
            at = 0
            while at < len(batch):
                part, chars = [], 0
                while at + len(part) < len(batch) and chars < block_chars:
                    part.append(texts[at + len(part)].as_py())
                    chars += len(part[-1] or "")
                sizes, known, base, found, rare, offsets = score_block(vocabulary, index, model, part)
                n = len(part)
                rare_lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rare, pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), ids.slice(at, n), held.slice(at, n), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(found, pa.float64()), rare_lists], schema=SCORED)
                row, at = row + n, at + n

    return docs.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, rare array<binary>")


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    training = rows.where(~F.col("held_out"))
    counts = stored(count_words(training), "lm-counts")
    vocabulary = Vocabulary(counts)
    shared = spark.sparkContext.broadcast(_portable(vocabulary))
    model = train(stored(class_sequences(training, shared), "lm-classes"), vocabulary)
    both = spark.sparkContext.broadcast((_portable(vocabulary), model))
    scored = stored(score_frequent(rows, both), "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("tf"))
    looked_up = (
        rare.join(counts.where(~vocabulary.is_frequent), "word")
        .groupBy("row")
        .agg(F.sum(F.col("tf") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("tf").alias("more_known"))
    )
    more, more_known = F.coalesce(F.col("more"), F.lit(0.0)), F.coalesce(F.col("more_known"), F.lit(0))
    return scored.drop("rare").join(looked_up, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more_known).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * math.log10(vocabulary.total + vocabulary.types + 1)).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )


def _portable(vocabulary: Vocabulary) -> Vocabulary:
    """Without the Spark expression, which tasks neither need nor can read."""
    out = object.__new__(Vocabulary)
    out.__dict__ = {k: v for k, v in vocabulary.__dict__.items() if k != "is_frequent"}
    return out
