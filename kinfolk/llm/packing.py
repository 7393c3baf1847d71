"""Lexical retrieval packing: BM25 neighbours fill each seed's window.

Every task streams its documents through index shards of bounded size. A document is tokenised and
closed with the end id; windows that it fills alone are cut off, and what is left (under one window)
enters the shard. Over a full shard an inverted index of token ids with BM25 weights is built. A seed
opens a window; all its terms retrieve the unused neighbours, as many as the window takes, which fill it in
order of score. The neighbour that no longer fits is cut, and its rest is the next seed. Where nothing
related is unused, the next unused document in input order takes the place.

The tokens that remain when a shard ends are cut into sequences whose lengths are powers of two,
which need no padding: nothing is padded at all.

Shards never span tasks, so there is no shuffle, no key that could be hot, and a lost task repeats
with the same result.

Defined results
---------------
* Null text is empty: one piece that holds the end id. Repeated rows are packed as often as they occur.
* ``start`` counts ids of the row's own document. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, END = 2048, 1
#: Tokens after which a shard is indexed and packed; bounds a task's memory.
SHARD_TOKENS = 1 << 21
#: Neighbours that are ordered at first; more follow while the window has room. Terms of a larger share of the items
#: have rows of a matrix instead of lists.
NEIGHBOURS, DENSE_SHARE = 16, 1 / 8
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# --- tokens ------------------------------------------------------------------------------------

@lru_cache(maxsize=4)
def byte_bpe(vocab_json: str, ranks_file: str, pattern: str, cache_size: int = 400_000) -> Callable[[str], np.ndarray]:
    """A function text -> ids, equal to the tokenizers file's without special tokens added.

    A piece of byte-level BPE never extends over the boundary before a single space, unless white
    space stands on both of its sides. So texts are cut at spaces, and the ids of ' word' are kept;
    a text's words that aren't known yet go through in one call and are cut where a token begins with the space.
    Texts with runs of white space are tokenised whole, and those that contain a special token's
    string go to the tokenizers library itself. A worker keeps the function, and its words, from task to task.
    """
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(vocab_json)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    spaced = np.zeros(max(ranks.values()) + 1, bool)
    spaced[[i for token, i in ranks.items() if token[:1] == b" "]] = True
    kept: dict[str, bytes] = {}

    def packed(ids: list[int]) -> bytes:
        return np.array(ids, dtype=np.uint16).tobytes()

    def learned(words: list[str]) -> dict[str, bytes] | None:
        """Ids of words; None where one of them can't be tokenised by itself."""
        joined = " ".join(words)
        if any(not w or w != w.strip() for w in words) or any(s in joined for s in special):
            return None
        ids = np.array(fast.encode_ordinary(" " + joined), dtype=np.uint16)
        at = (2 * np.flatnonzero(spaced[ids])).tolist()
        data = ids.tobytes()
        found = dict(zip(words, (data[i:j] for i, j in zip(at, [*at[1:], len(data)]))))
        if len(kept) < cache_size:
            kept.update(found)
        return found

    def encode(text: str) -> np.ndarray:
        first, *words = text.split(" ")
        parts = list(map(kept.get, words))
        if None in parts and (new := learned(list(dict.fromkeys(w for w, p in zip(words, parts) if p is None)))):
            parts = [new[w] if p is None else p for w, p in zip(words, parts)]
        if None in parts or first[-1:].isspace() or any(s in first for s in special):
            whole = exact.encode(text, add_special_tokens=False).ids if any(s in text for s in special) else fast.encode_ordinary(text)
            return np.array(whole, dtype=np.uint16)
        return np.frombuffer(packed(fast.encode_ordinary(first)) + b"".join(parts), dtype=np.uint16)

    return encode


# --- retrieval ---------------------------------------------------------------------------------

class BM25Index:
    """Inverted lists of token ids over one shard's items."""

    def __init__(self, items: list[np.ndarray]):
        found = [np.unique(x, return_counts=True) for x in items]
        sizes = np.array([len(t) for t, _ in found])
        self.terms = np.concatenate([t for t, _ in found])
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.n = len(items)
        tf = np.concatenate([c for _, c in found]).astype(np.float32)
        lengths = np.array([len(x) for x in items], dtype=np.float32)
        norm = np.repeat(K1 * (1 - B + B * lengths / max(lengths.mean(), 1e-9)), sizes)
        self.df = np.bincount(self.terms, minlength=65536)
        self.idf = np.log1p((self.n - self.df + 0.5) / (self.df + 0.5)).astype(np.float32)
        order = np.argsort(self.terms, kind="stable")
        self.owner = np.repeat(np.arange(self.n), sizes)[order]
        self.weight = (self.idf[self.terms] * tf * (K1 + 1) / (tf + norm))[order]
        self.lists = np.r_[0, np.cumsum(self.df)]
        dense = np.flatnonzero(self.df > max(1, self.n * DENSE_SHARE))
        self.dense_row = np.full(65536, -1)
        self.dense_row[dense] = np.arange(len(dense))
        self.dense = np.zeros((len(dense), self.n), np.float32)
        for row, t in zip(self.dense, dense):
            row[self.owner[self.lists[t] : self.lists[t + 1]]] = self.weight[self.lists[t] : self.lists[t + 1]]

    def scores(self, item: int) -> np.ndarray:
        """BM25 of every item against all the item's terms."""
        terms = self.terms[self.starts[item] : self.starts[item + 1]]
        rows = self.dense_row[terms]
        out = self.dense[rows[rows >= 0]].sum(0).astype(np.float64)
        spans = [slice(self.lists[t], self.lists[t + 1]) for t in terms[(rows < 0) & (self.df[terms] > 1)].tolist()]
        if spans:
            out += np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        return out

    def neighbours(self, item: int, left: np.ndarray, space: int) -> np.ndarray:
        """Items with ids left by falling score, ties by number: all that share a term, or as many as hold ``space`` ids."""
        scores = self.scores(item)
        scores[left == 0] = 0
        found, most = int((scores > 0).sum()), NEIGHBOURS
        while True:
            least = np.partition(scores, self.n - most)[self.n - most] if most < found else 0
            top = np.flatnonzero((scores >= least) & (scores > 0))
            if most >= found or left[top].sum() >= space:
                return top[np.lexsort((top, -scores[top]))]
            most *= 4


def pack_shard(lengths: list[int], index: BM25Index | None, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (item, from, length). All but the last ones hold ``window`` ids; those, powers of two."""
    n, left = len(lengths), np.array(lengths, dtype=np.int64)
    used, taken, ahead, seed = left == 0, np.zeros(n, np.int64), 0, -1
    remaining = int(left.sum())

    def take(item: int, most: int) -> tuple[int, int, int]:
        nonlocal remaining
        size = int(min(left[item], most))
        piece = (item, int(taken[item]), size)
        taken[item] += size
        left[item] -= size
        used[item] = left[item] == 0
        remaining -= size
        return piece

    def unused() -> int:
        nonlocal ahead
        while used[ahead]:
            ahead += 1
        return ahead

    while remaining:
        space = window if remaining >= window else 1 << (remaining.bit_length() - 1)
        if seed < 0 or used[seed]:
            seed = unused()
        anchor, pieces, queue = seed, [], []
        pieces.append(take(anchor, space))
        space -= pieces[-1][2]
        if space and index is not None:
            queue = index.neighbours(anchor, left, space).tolist()[::-1]
        seed = anchor
        while space:
            item = queue.pop() if queue else unused()
            pieces.append(take(item, space))
            space -= pieces[-1][2]
            seed = item
        yield pieces


# --- Spark -------------------------------------------------------------------------------------

def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k", tokenizers_dir: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        where = (lambda name: f"{tokenizers_dir}/{name}") if tokenizers_dir else public_tokenizers.path
        encode = byte_bpe(where(f"{vocab}.json"), where(f"{vocab}.tiktoken"), public_tokenizers.PATTERN)
        names = [x.split()[0] for x in PIECES.split(", ")]
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 32
        rows: list[tuple] = []
        pool: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        held = 0

        def crc(ids: np.ndarray) -> int:
            return zlib.crc32(ids.astype("<u4").tobytes())

        def flush() -> None:
            nonlocal sequence, held
            if pool:
                index = BM25Index([ids for _, _, ids, _ in pool])
                for pieces in pack_shard([len(ids) for _, _, ids, _ in pool], index):
                    at = 0
                    for item, first, size in pieces:
                        doc_id, start, ids, total = pool[item]
                        rows.append((doc_id, start + first, size, crc(ids[first : first + size]), total, sequence, at))
                        at += size
                    sequence += 1
            pool.clear()
            held = 0

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")
            rows.clear()
            return out

        for pdf in batches:
            for doc_id, missing, text in zip(pdf["doc_id"], pdf["missing"], pdf["text"]):
                ids = np.append(encode(text), np.uint16(END))
                total, own = len(ids), None if missing else int(doc_id)
                whole = total - total % WINDOW
                for start in range(0, whole, WINDOW):
                    rows.append((own, start, WINDOW, crc(ids[start : start + WINDOW]), total, sequence, 0))
                    sequence += 1
                if whole < total:
                    pool.append((own, whole, ids[whole:].copy(), total))
                    held += total - whole
                if held >= SHARD_TOKENS:
                    flush()
                if len(rows) >= 50_000:
                    yield frame()
        flush()
        yield frame()

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"), F.col(id_col).isNull().alias("missing"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, PIECES)
