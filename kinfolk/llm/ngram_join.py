"""N-gram Jaccard self-join: documents whose shingle sets overlap enough, and their components.

Search inside a neighbourhood is T-occurrence search by DivideSkip: a set needs T shared shingles
with another; its L longest inverted lists are put aside, the short ones are merged with a heap, and
a document that occurs often enough in them is probed in the long lists by binary search until it
reaches T or can't any more. For components only, members that already share one are skipped on the lists;
for the number of links every linked pair is found, and counted where it is found: a unit of work returns a spanning
forest and each set's number of linked rows, so a group of many near copies gives rows in proportion to its members.

Neighbourhoods make that distributed without losing a link:

1. Hash space is cut into H + 1 + spare parts, H being the largest symmetric difference that linked sets of
   a size class can have. Linked sets then agree in spare + 1 parts at least. Keys are grouped by one shuffle
   and read as a sorted stream. Each set then leaves its most frequent keys, ``spare`` of them: parts that hold
   a common passage only. One order of keys holds for all sets (empty parts, then the largest groups), so two
   sets leave at most ``spare`` keys they share, and one is kept by both. A set with more than ``spare`` empty
   parts emits keys for these, too.
2. Sets that share a key are compared by parity bitmaps: the bits in which they differ are a lower bound of
   their symmetric difference. Only pairs that could be linked survive; each group yields a spanning forest
   of them, never its pairs. Identical groups are processed once.
3. The components of these edges are the neighbourhoods. A text travels to its neighbourhood once; a large
   neighbourhood is cut into blocks, every pair of blocks being a unit of work of bounded size.

Equal sets collapse to one node before step 3, so copies never meet each other.

Defined results
---------------
* Words are runs without ASCII white space, A-Z lower-cased. With fewer words than a shingle has, the whole
  sequence is the one shingle; without words (or null text) the set is empty and linked with nothing.
* A null doc_id links nothing; its component is null. Rows that share a doc_id are rows of their own.
* A row's links are the other rows with an id whose sets are linked with its own, equal sets included.
* Empty table: no rows. Extra columns are ignored by ``jaccard_components`` and ``jaccard_links`` and carried by ``keep_first``.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfolk.llm.components import connected_components
from kinfolk.llm.storage import stored

#: Parts beyond H + 1, at least; of a large H, one for every SPARE_SHARE.
SPARE, SPARE_SHARE = 2, 4
#: Weight of a key that is never left.
NEVER = 1 << 40
#: Size classes grow by this factor.
CLASS_GROWTH = 1.6
#: Bits of a parity bitmap for each element that may differ. A group's bitmaps are folded to its smallest, whose set
#: may have half the elements of the largest: with four bits or more left, unrelated sets differ in twice the bound.
BITS_APART = 8
#: A unit of work holds two blocks of at most so many shingles and documents.
BLOCK_SHINGLES, BLOCK_DOCS = 1_000_000, 256
#: Members of a key group that are compared by bitmaps; a larger group, and a piece of one, joins as a whole (more work, same links).
GROUP_MEMBERS = 100_000
#: Representatives' ids are broadcast up to this many rows, else joined by shuffling.
BROADCAST_ROWS = 500_000

_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


# --- sets --------------------------------------------------------------------------------------

def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Text -> sorted array of distinct 64-bit shingle hashes."""

    def __init__(self, words: int):
        self.words, self.hashes = words, _WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = mixed(out * _P1 + h[i : len(h) - n + 1 + i])
        return np.unique(out)


def node_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def short_id(node: bytes) -> int:
    """64 bits of a node, for grouping only: a clash makes a neighbourhood larger, nothing else."""
    return int.from_bytes(node[:8], "little", signed=True)


class Keys:
    """Part keys and parity bitmaps of sets, for a least similarity in percent."""

    def __init__(self, percent: int):
        if not 50 <= percent < 100:
            raise ValueError("percent must be from 50 to 99")
        self.percent = percent
        bounds = [-(-percent // (100 - percent))]  # smaller sets are linked with equal ones only
        while bounds[-1] < 1 << 40:
            bounds.append(max(int(bounds[-1] * CLASS_GROWTH), -(-bounds[-1] * 100 // percent) + 1))
        self.bounds = np.array(bounds)

    def most_apart(self, sizes):
        """Largest symmetric difference of linked sets with so many elements together."""
        return sizes * (100 - self.percent) // (100 + self.percent)

    def class_of(self, n: int) -> int:
        return int(np.searchsorted(self.bounds, n, side="right")) - 1

    def parts(self, s: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(size class, spare parts, starts, counts) for the set's class and, if it may have a partner there, the next."""
        n = len(s)
        if n < self.bounds[0]:
            return
        own = self.class_of(n)
        for k in (own, own + 1):
            if k > own and 100 * n < self.percent * self.bounds[k]:
                break
            most = int(self.most_apart(2 * (int(self.bounds[k + 1]) - 1)))
            spare = max(SPARE, most // SPARE_SHARE)
            parts = most + 1 + spare
            starts = np.searchsorted(s, (np.arange(parts) * (2.0**64 / parts)).astype(np.uint64))
            yield k, spare, starts, np.diff(np.r_[starts, n])

    def of(self, s: np.ndarray) -> np.ndarray:
        """Keys; the lowest bit tells the size class from the next."""
        out, scrambled = [np.empty(0, np.uint64)], mixed(s)
        for k, spare, starts, counts in self.parts(s):
            full, salt = np.flatnonzero(counts), np.array([k], np.uint64) * _P3
            found = [mixed(np.add.reduceat(scrambled, starts[full]) + mixed(full.astype(np.uint64) * _P2 + salt))]
            if len(counts) - len(full) > spare:
                found.append(mixed(mixed(np.flatnonzero(counts == 0).astype(np.uint64) * _P2 + salt) + _P1))
            out.append(np.concatenate(found) & ~np.uint64(1) | np.uint64(k & 1))
        return np.concatenate(out)

    def rooms(self, s: np.ndarray) -> list[int]:
        """Keys that the set may leave, for even and odd size classes: the spare parts that aren't empty."""
        out = [0, 0]
        for k, spare, _, counts in self.parts(s):
            out[k & 1] = max(0, spare - int((counts == 0).sum()))
        return out

    def bitmap(self, s: np.ndarray) -> bytes:
        """Parity of the elements on each of 2^j bits, ``BITS_APART`` or more for each element that may differ."""
        apart = int(self.most_apart(2 * len(s)))
        bits = 1 << max(6, (BITS_APART * apart - 1).bit_length())
        odd = np.bincount((mixed(s + _P2) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bitmap: bytes, size: int) -> np.ndarray:
    """A bitmap reduced to ``size`` bytes: that of the same set on fewer bits."""
    x = np.frombuffer(bitmap, np.uint8)
    return np.bitwise_xor.reduce(x.reshape(-1, size), 0)


# --- step 2: possible links inside a key group ---------------------------------------------------

def possible_forest(keys: Keys, sizes: np.ndarray, bitmaps: list[bytes]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that sizes and bitmaps don't rule out."""
    width = min(map(len, bitmaps))
    bits = np.stack([folded(b, width) for b in bitmaps]).view(np.uint64)

    def could(i: int, rest: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(bits[rest] ^ bits[i]).sum(1)
        small, large = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        return (apart <= keys.most_apart(small + large)) & (100 * small >= keys.percent * large)

    out, rest = [], np.arange(len(sizes))
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            if len(front) <= len(rest):
                i, front = int(front[0]), front[1:]
                hit = could(i, rest)
                out += [(i, int(j)) for j in rest[hit]]
            else:
                hit, linked = np.zeros(len(rest), bool), front
                for at, j in enumerate(rest):
                    if (near := could(int(j), linked)).any():
                        hit[at] = True
                        out.append((int(linked[near.argmax()]), int(j)))
                front = front[:0]
            front, rest = np.r_[front, rest[hit]], rest[~hit]
    return out


# --- step 3: T-occurrence search by DivideSkip ---------------------------------------------------

class InvertedLists:
    """Sorted lists of local document numbers by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        changed = np.r_[True, values[order][1:] != values[order][:-1]]
        self.owner = owner[order]
        self.ends = np.r_[np.flatnonzero(changed), len(order)]
        own = np.empty(len(order), np.int64)
        own[order] = np.cumsum(changed) - 1
        self.lists_of = np.split(own, np.cumsum(self.sizes)[:-1])
        self.length = np.diff(self.ends)

    def list(self, term: int) -> np.ndarray:
        return self.owner[self.ends[term] : self.ends[term + 1]]


def merged_counts(lists: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(document, lists that hold it) by merging sorted lists with a heap."""
    last, count = -1, 0
    for doc in heapq.merge(*(x.tolist() for x in lists)):
        if doc == last:
            count += 1
        else:
            if count:
                yield last, count
            last, count = doc, 1
    if count:
        yield last, count


def divide_skip(index: InvertedLists, query: int, percent: int, label: np.ndarray, allowed) -> Iterator[int]:
    """Documents linked with the query, of those that don't share its label yet."""
    n = int(index.sizes[query])
    least = -(-percent * n // 100)  # T: shared shingles that any partner must have
    terms = index.lists_of[query]
    terms = terms[index.length[terms] > 1]
    if len(terms) < least:
        return
    order = np.argsort(index.length[terms], kind="stable")
    terms = terms[order]
    longest = int(index.length[terms[-1]])
    # The published rule of thumb for L, but never so many that no short list need hold a partner.
    aside = max(0, min(least - 1, round(least / (0.01 * np.log2(longest + 1) + 1))))
    short, long = terms[: len(terms) - aside], terms[len(terms) - aside :]
    lists = [x for t in short if len(x := (y := index.list(t))[(label[y] != label[query]) & allowed(y)])]
    for doc, count in merged_counts(lists):
        m = int(index.sizes[doc])
        if 100 * min(n, m) < percent * max(n, m) or count < least - aside or label[doc] == label[query]:
            continue
        need = -(-percent * (n + m) // (100 + percent))  # overlap that the pair must reach
        for left, t in zip(range(len(long), 0, -1), long):
            if count + left < need:
                break
            held = index.list(t)
            at = held.searchsorted(doc)
            count += int(at < len(held) and held[at] == doc)
        if count >= need:
            yield doc


def linked_forest(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs; with ``side``, of pairs from different sides only."""
    if len(sets) < 2 or side is not None and (side == side[0]).all():
        return []
    index, label, out = InvertedLists(sets), np.arange(len(sets)), []
    for query in np.argsort(index.sizes, kind="stable"):
        allowed = (lambda docs, own=side[query]: side[docs] != own) if side is not None else (lambda docs: np.ones(len(docs), bool))
        for doc in list(divide_skip(index, int(query), percent, label, allowed)):
            if label[doc] != label[query]:
                label[label == label[doc]] = label[query]
                out.append((int(query), doc))
    return out


def linked_pairs(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Every linked pair once; with ``side``, of pairs from different sides only."""
    if len(sets) < 2 or side is not None and (side == side[0]).all():
        return []
    index, apart, out = InvertedLists(sets), np.arange(len(sets)), []
    order = np.argsort(index.sizes, kind="stable")
    rank = np.empty(len(sets), np.int64)
    rank[order] = np.arange(len(sets))
    for query in order:
        allowed = lambda docs, own=query: (rank[docs] > rank[own]) & (True if side is None else side[docs] != side[own])
        out += [(int(query), doc) for doc in divide_skip(index, int(query), percent, apart, allowed)]
    return out


# --- Spark -------------------------------------------------------------------------------------

def _sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, node, nid, bits, rooms of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, keys = Shingler(words), Keys(percent)
        for batch in batches:
            sets = [shingle(t.as_py()) for t in batch.column(1)]
            nodes = [node_of(s) if len(s) else None for s in sets]
            bits = [keys.bitmap(s) if len(s) >= keys.bounds[0] else None for s in sets]
            rooms = pa.array([keys.rooms(s) for s in sets], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array([x and short_id(x) for x in nodes], pa.int64()), pa.array(bits, pa.binary()), rooms],
                names=["doc_id", "n", "node", "nid", "bits", "rooms"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, node binary, nid long, bits binary, rooms array<int>")


def _key_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, nid) of every set; a task emits equal sets once, as far as it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, keys, seen = Shingler(words), Keys(percent), set()
        for batch in batches:
            found, owners, held = [], [], 0
            for text in batch.column(1):
                s = shingle(text.as_py())
                if len(s) < keys.bounds[0] or (nid := short_id(node_of(s))) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(nid)
                found.append(keys.of(s))
                owners.append(np.full(len(found[-1]), nid, np.int64))
                held += len(found[-1])
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(owners))], names=["key", "nid"])
                    found, owners, held = [], [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(owners))], names=["key", "nid"])

    return docs.mapInArrow(run, "key long, nid long")


GROUPS = "group long, nid long, members long, odd int, weight long"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, nid): the members of keys that several nodes share, one group for keys with equal members.

    ``weight`` is the number of keys. Pieces of a huge group come last in the order of keys and are never left.
    """
    held: dict[int, list] = {}
    cut = None  # the huge group's key, of which pieces have gone out

    def take(key: np.ndarray, nid: np.ndarray) -> int:
        new = np.r_[True, (key[1:] != key[:-1]) | (nid[1:] != nid[:-1])]
        key, nid = key[new], nid[new]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        counts = np.diff(np.r_[starts, len(key)])
        odd, piece = key[starts] & 1, key[starts] == cut if cut is not None else np.zeros(len(starts), bool)
        group = mixed(np.add.reduceat(mixed(nid.view(np.uint64)), starts) + (2 * counts + odd).astype(np.uint64) * _P1 + piece.astype(np.uint64) * _P2).view(np.int64)
        added = 0
        for i in np.flatnonzero(counts > 1):
            if (g := int(group[i])) in held:
                held[g][3] += 1
            else:
                held[g] = [nid[starts[i] : starts[i] + counts[i]].copy(), 0 if piece[i] else int(counts[i]), int(odd[i]), NEVER if piece[i] else 1]
                added += int(counts[i])
        return added

    def batch() -> pa.RecordBatch:
        sizes = [len(x[0]) for x in held.values()]
        columns = [np.array(list(held), np.int64), *(np.array([x[i] for x in held.values()], np.int64) for i in (1, 2, 3))]
        group, members, odd, weight = (pa.array(np.repeat(c, sizes)) for c in columns)
        out = pa.RecordBatch.from_arrays([group, pa.array(np.concatenate([x[0] for x in held.values()])), members, odd.cast(pa.int32()), weight], names=["group", "nid", "members", "odd", "weight"])
        held.clear()
        return out

    key, nid, total = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for b in batches:
        key = np.concatenate([key, b.column(0).to_numpy()])
        nid = np.concatenate([nid, b.column(1).to_numpy()])
        if not len(key):
            continue
        whole = int(np.searchsorted(key, key[-1]))  # the last key may go on
        if whole:
            total += take(key[:whole], nid[:whole])
            key, nid = key[whole:], nid[whole:]
        elif len(key) > 4 * GROUP_MEMBERS:
            new = np.r_[True, nid[1:] != nid[:-1]]  # tasks emit copies of their own
            key, nid = key[new], nid[new]
            if len(key) > 4 * GROUP_MEMBERS:  # pieces of a huge group overlap in one member
                cut = key[0]
                total += take(key, nid)
                key, nid = key[-1:], nid[-1:]
        if total > 1_000_000 and held:
            yield batch()
            total = 0
    if len(key):
        take(key, nid)
    if held:
        yield batch()


def _possible_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, now, piece, members = Keys(percent), None, False, []

        def close() -> list[tuple[int, int]]:
            nids = [m[0] for m in members]
            if piece or len(members) > GROUP_MEMBERS:  # links may be with members of other pieces, so each joins as a whole
                return list(zip(nids, nids[1:]))
            return [(nids[i], nids[j]) for i, j in possible_forest(keys, np.array([m[1] for m in members]), [m[2] for m in members])]

        def batch_of(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([max(e) for e in edges], pa.int64()), pa.array([min(e) for e in edges], pa.int64())], names=["a", "b"])

        out: list[tuple[int, int]] = []
        for batch in batches:
            for group, nid, n, bits, weight in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if group != now:
                    out += close() if len(members) > 1 else []
                    now, piece, members = group, weight >= NEVER, []
                if not members or members[-1][0] != nid:
                    members.append((nid, n, bits))
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
        out += close() if len(members) > 1 else []
        yield batch_of(out)

    return run


def forest_of(edges: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """A spanning forest of the edges."""
    parent, out = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in edges:
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            out.append((i, j))
    return out


LINKS = "a binary, b binary, others long"


def _search(words: int, percent: int, mode: str = "forest"):
    """Links inside each unit: rows (unit columns, block, node, copies, text), sorted by unit.

    Modes: a spanning ``forest``; every one of the ``pairs``; or ``counts``, a forest and for each linked set a row without
    b that tells how many rows of other sets (``others``) it is linked with.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, now, members = Shingler(words), None, []

        def close() -> pd.DataFrame:
            side = np.array([m[0] for m in members]) if now and now[1] != now[2] else None
            edges = (linked_forest if mode == "forest" else linked_pairs)([m[3] for m in members], percent, side)
            rows: list[tuple] = []
            if mode == "counts" and edges:
                i, j = np.array(edges).T
                copies = np.array([m[2] for m in members], np.int64)
                others = np.bincount(i, copies[j], len(members)) + np.bincount(j, copies[i], len(members))
                rows = [(members[k][1], None, int(others[k])) for k in np.flatnonzero(others)]
                edges = forest_of(edges, len(members))
            return pd.DataFrame(rows + [(members[i][1], members[j][1], 0) for i, j in edges], columns=["a", "b", "others"])

        for pdf in batches:
            for root, first, second, block, node, copies, text in pdf.itertuples(index=False, name=None):
                if (root, first, second) != now:
                    if len(members) > 1:
                        yield close()
                    now, members = (root, first, second), []
                s, node = shingle(text), bytes(node)
                if node_of(s) == node:  # else another row with the same id
                    members.append((block, node, copies, s))
        if len(members) > 1:
            yield close()

    return run


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    return _components(docs, words, percent, id_col, text_col)[0]


def jaccard_links(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, n_links (other rows linked with it)."""
    return _components(docs, words, percent, id_col, text_col, "counts")[0]


def jaccard_pairs(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every linked pair of different sets once, each set by the smallest id of its rows: a_id < b_id (or equal where rows share an id)."""
    return _components(docs, words, percent, id_col, text_col, "pairs")[1]


def _components(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, mode: str = "forest") -> tuple[DataFrame, DataFrame | None]:
    """The rows, with n_links in the mode ``counts``; and in the mode ``pairs`` the pairs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = rows.where(F.col("doc_id").isNotNull())
    sets = stored(_sets(rows, words, percent), "ngram-sets")
    nodes = sets.where(F.col("doc_id").isNotNull() & F.col("node").isNotNull())

    grouped = _key_rows(known, words, percent).repartition("key").sortWithinPartitions("key", "nid").mapInArrow(_groups, GROUPS)
    groups = stored(grouped.groupBy("group", "nid").agg(F.first("members").alias("members"), F.first("odd").alias("odd"), F.sum("weight").alias("weight")), "ngram-groups")
    bitmaps = nodes.where(F.col("bits").isNotNull()).groupBy("nid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("rooms").alias("rooms"))
    order = Window.partitionBy("nid", "odd").orderBy(F.desc("members"), "group").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    possible = (
        groups.join(bitmaps.hint("merge"), "nid").withColumn("left", F.sum("weight").over(order)).where(F.col("left") > F.get("rooms", "odd")).select("group", "nid", "n", "bits", "weight").repartition("group").sortWithinPartitions("group", "nid")
        .mapInArrow(_possible_links(percent), "a long, b long")
    )
    near = stored(connected_components(possible), "ngram-near")
    near = near.select(F.col("a").alias("nid"), F.col("b").alias("root")).unionByName(near.select(F.col("b").alias("nid"), F.col("b").alias("root")).distinct())

    members = stored(nodes.join(near, "nid").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("root").alias("root"), F.count(F.lit(1)).alias("copies")), "ngram-members")
    blocks = members.groupBy("root").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_DOCS)).cast("int").alias("blocks"))
    placed = members.join(blocks, "root").where(F.col("root").isNotNull()).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    units = placed.select("doc_id", "node", "copies", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = units.select("doc_id", "node", "copies", "root", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block")
    small = members.count() <= BROADCAST_ROWS
    wanted = F.broadcast(placed.select("doc_id").distinct()) if small else placed.select("doc_id").distinct()
    texts = known.join(wanted, "doc_id", "left_semi")
    found = (
        texts.join(units, "doc_id").select("root", "first", "second", "block", "node", "copies", "text")
        .repartition("root", "first", "second").sortWithinPartitions("root", "first", "second", "node")
        .mapInPandas(_search(words, percent, mode), LINKS)
    )
    if mode != "forest":
        found = stored(found, "ngram-links")
    links = found.where(F.col("b").isNotNull()).select("a", "b")
    if mode == "pairs":
        least = stored(nodes.groupBy("node").agg(F.min("doc_id").alias("least")), "ngram-least")
        a, b = (least.select(F.col("node").alias(c), F.col("least").alias(f"{c}_least")) for c in "ab")
        return sets, links.join(a, "a").join(b, "b").select(F.least("a_least", "b_least").alias("a_id"), F.greatest("a_least", "b_least").alias("b_id"))
    linked = connected_components(links)

    merged = nodes.groupBy("node").agg(F.min("doc_id").alias("least")).join(linked.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = merged.groupBy("root").agg(F.min("least").alias("component_id"))
    component = stored(merged.join(roots, "root").select("node", "component_id"), "ngram-components")
    alone = sets.where(F.col("doc_id").isNull() | F.col("node").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    if mode == "forest":
        return nodes.select("doc_id", "n", "node").join(component.hint("merge"), "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone), None
    others = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("others"))
    copies = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    counted = copies.join(others, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")).join(component.hint("merge"), "node")
    rows = nodes.select("doc_id", "n", "node").join(counted.hint("merge"), "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    return rows.unionByName(alone.withColumn("n_links", F.lit(0).cast("long"))), None


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is their component's smallest, and rows without an id, with all their columns."""
    found = jaccard_components(docs, words, percent, id_col, text_col)
    gone = stored(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct(), "ngram-gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
