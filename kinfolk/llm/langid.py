"""Language identification by a byte convolutional network, trained in numpy on labelled text.

A window of ``LENGTH`` bytes passes through byte embeddings, filters of several widths, a maximum
over positions and a softmax. A text is cut into consecutive windows that cover all its bytes; its
probabilities are the windows' means, weighted by their bytes.

For prediction the embeddings and filters collapse into tables over byte pairs, so a position costs
five look-ups; all windows of a block advance one byte at a time, in cache.

Training draws ``train_docs`` labelled rows in expectation (a documented bound; by a hash of id and position) and,
of all windows of their whole texts alike, ``train_windows`` in expectation. Prediction reads whole texts.

Defined results
---------------
* Null text, or a text without any letter: ``und`` with score 0. Rows with null lang aren't learned from.
* Without a single labelled row every text is ``und``. Equal probabilities: the first language by name.
* Extra columns are ignored by ``predict`` and carried by ``keep_identified``. Empty table: no rows.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTH, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
UNDETERMINED = "und"


def has_letter(text: str) -> bool:
    """Whether a character of one of Unicode's letter categories occurs: fractions, superscripts and numerals are none."""
    return any(c.isalpha() and unicodedata.category(c)[0] == "L" for c in text)


# --- the network -------------------------------------------------------------------------------

class ByteCNN:
    """Parameters, training and block-wise prediction."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = [rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def _parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.out_bias]

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = 400, batch: int = 96, rate: float = 0.01, seed: int = 11) -> ByteCNN:
        """Adam on cross-entropy; gradients pass the maximum to the winning position only."""
        rng, n = np.random.default_rng(seed), len(labels)
        first = [np.zeros_like(p) for p in self._parameters()]
        second = [np.zeros_like(p) for p in self._parameters()]
        for step in range(1, steps + 1):
            pick = rng.integers(0, n, min(batch, n))
            grads = self._gradients(windows[pick], labels[pick])
            speed = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for p, g, m, v in zip(self._parameters(), grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, pooled, winners = len(y), [], []
        for w, kernel in zip(WIDTHS, self.filters):
            taps = np.einsum("be,kef->kbf", self.embed, kernel)
            scores = sum(taps[k][x[:, k : x.shape[1] - w + 1 + k]] for k in range(w))
            best = scores.argmax(1)
            winners.append(best)
            pooled.append(np.take_along_axis(scores, best[:, None], 1)[:, 0])
        z = np.concatenate(pooled, 1) + self.bias
        hidden = np.maximum(z, 0)
        logits = hidden @ self.out + self.out_bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        d_hidden = (p @ self.out.T) * (z > 0)
        d_embed, d_filters = np.zeros_like(self.embed), []
        for i, (w, kernel) in enumerate(zip(WIDTHS, self.filters)):
            g, best = d_hidden[:, i * FILTERS : (i + 1) * FILTERS], winners[i]
            d_kernel = np.zeros_like(kernel)
            for k in range(w):
                table = np.zeros((256, FILTERS), np.float32)
                np.add.at(table, (x[np.arange(n)[:, None], best + k], np.arange(FILTERS)[None]), g)
                d_kernel[k] = self.embed.T @ table
                d_embed += table @ kernel[k].T
            d_filters.append(d_kernel)
        return [d_embed, *d_filters, d_hidden.sum(0), hidden.T @ p, p.sum(0)]

    def predictor(self, block: int = 512):
        """A function: windows (n, LENGTH) -> probabilities (n, languages)."""
        one = {(w, k): self.embed @ kernel[k] for w, kernel in zip(WIDTHS, self.filters) for k in range(w)}

        def pair(w: int, k: int) -> np.ndarray:
            return np.ascontiguousarray((one[w, k][:, None] + one[w, k + 1][None]).reshape(65536, FILTERS))

        # Width -> (table over byte pairs, offset) and then single bytes for what is left over.
        plan = [([(pair(w, k), k, True) for k in range(0, w - 1, 2)] + ([(one[w, w - 1], w - 1, False)] if w % 2 else []), w) for w in WIDTHS]

        def predict(windows: np.ndarray) -> np.ndarray:
            out = np.empty((len(windows), len(self.langs)), np.float32)
            for at in range(0, len(windows), block):
                x = np.ascontiguousarray(windows[at : at + block].T).astype(np.intp)
                pairs = x[:-1] * 256 + x[1:]
                n = x.shape[1]
                a, b = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.float32)
                pooled = []
                for tables, w in plan:
                    top = np.full((n, FILTERS), -np.inf, np.float32)
                    (t0, k0, p0), *more = tables
                    for i in range(LENGTH - w + 1):
                        np.take(t0, (pairs if p0 else x)[i + k0], axis=0, out=a, mode="clip")
                        for t, k, p in more:
                            np.take(t, (pairs if p else x)[i + k], axis=0, out=b, mode="clip")
                            np.add(a, b, out=a)
                        np.maximum(top, a, out=top)
                    pooled.append(top)
                logits = np.maximum(np.concatenate(pooled, 1) + self.bias, 0) @ self.out + self.out_bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                out[at : at + n] = p / p.sum(1, keepdims=True)
            return out

        return predict


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover the texts, the text of each, and its bytes; the last of a text is padded with 0."""
    counts = np.array([-(-len(t) // LENGTH) for t in texts], dtype=np.int64)
    data = b"".join(t + bytes(-len(t) % LENGTH) for t in texts)
    own = np.repeat(np.arange(len(texts)), counts)
    weights = np.full(len(own), LENGTH, np.float64)
    ends = np.cumsum(counts)[counts > 0] - 1
    weights[ends] = [len(t) - (c - 1) * LENGTH for t, c in zip(texts, counts) if c]
    return np.frombuffer(data, np.uint8).reshape(-1, LENGTH), own, weights


# --- Spark -------------------------------------------------------------------------------------

def id_crc(id_col: str) -> Column:
    """CRC-32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def train(labelled: DataFrame, train_docs: int = 3000, train_windows: int = 40_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteCNN | None:
    """Fit the network on a bounded sample of rows with non-null text and language."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    total = rows.count()
    if not total:
        return None
    share = min(1.0, train_docs / total)
    drawn = rows.where(F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(1_000_000)) < int(np.ceil(share * 1_000_000)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, lang in zip(pdf["text"], pdf["lang"]):
                data = text.encode()
                lots = np.random.default_rng(zlib.crc32(data)).random(-(-len(data) // LENGTH))
                for i in np.flatnonzero(lots < part).tolist():
                    out.append((data[i * LENGTH : (i + 1) * LENGTH].ljust(LENGTH, b"\0"), lang))
            yield pd.DataFrame(out, columns=["window", "lang"])

    windows = drawn.agg(F.sum(F.ceil(F.octet_length(F.col(text_col)) / LENGTH))).first()[0]
    part = train_windows / max(windows or 0, train_windows)
    got = drawn.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInPandas(cut, "window binary, lang string").toPandas()
    if got.empty:
        return None
    got = got.sort_values(["lang", "window"], kind="stable")  # the order of rows doesn't sway training
    langs = sorted(got["lang"].unique())
    windows = np.frombuffer(b"".join(got["window"]), np.uint8).reshape(-1, LENGTH)
    return ByteCNN(langs).fit(windows, np.searchsorted(langs, got["lang"]))


def score_texts(model: ByteCNN | None, predict, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if t and has_letter(t)] if model else []
    if known:
        windows, own, weights = windows_of([texts[i].encode() for i in known])
        p = predict(windows) * weights[:, None]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        p = np.add.reduceat(p, starts, axis=0) / np.add.reduceat(weights, starts)[:, None]
        for i, best, row in zip(known, p.argmax(1), p):
            langs[i], scores[i] = model.langs[best], min(1.0, float(row[best]))
    return langs, scores


def _predict_with(model: ByteCNN | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = model.predictor() if model else None
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                langs, scores = score_texts(model, predict, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: ByteCNN | None, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict_with(model), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """Train on the rows whose id's CRC leaves another remainder than 2 by 4, predict every row."""
    held_out = id_crc("doc_id") % 4 == 2
    return predict(docs, train(docs.where(~held_out), **bounds), held_out)


def keep_identified(docs: DataFrame, **bounds) -> DataFrame:
    """The rows whose text has a language, with all their columns."""
    model = train(docs.where(id_crc("doc_id") % 4 != 2), **bounds)

    @F.pandas_udf("string")
    def lang(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = model.predictor() if model else None
        for texts in batches:
            yield pd.Series([x for at in range(0, len(texts), 500) for x in score_texts(model, predict, list(texts.iloc[at : at + 500]))[0]], dtype=object)

    return docs.where(lang(F.col("text")) != UNDETERMINED)
