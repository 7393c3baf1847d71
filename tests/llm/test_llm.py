"""Every operator on awkward rows: nulls, empty and very long texts, ties, repeated rows, extra columns, empty tables."""

import gzip
import hashlib
import io
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfolk.llm import chat, exact_dedup, images, langid, lm_scoring, mixing, ngram_join, packing, sharding, templates, warc

WORDS = "the of and to in that is was for on with as at by from are be this have it".split()
GERMAN = "der die und das von mit den ist im dem nicht ein eine als auch es an werden aus er".split()


def prose(n, seed, words=WORDS):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(words, n)) + "."


def text_rows():
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30", "x")
    return [
        (0, base, "en", "a"), (1, base, "en", "b"), (2, base, None, None), (3, near, "en", "a"), (4, None, "en", "a"), (5, "", "de", "a"), (6, "one two", "en", "a"), (7, "ONE two", "en", "a"),
        (8, prose(30_000, 1), "en", "a"), (9, prose(80, 2, GERMAN), "de", "a"), (9, prose(80, 2, GERMAN), "de", "a"), (None, "no id here", "en", "a"), (10, "12 34 !!", "en", "a"), (11, "   \n\t ", "en", "a"), (12, prose(80, 3), "en", "a"),
    ] + [(20 + i, prose(60, 100 + i, GERMAN if i % 2 else WORDS), "de" if i % 2 else "en", "c") for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 7, 8) for r in text_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest long")


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.where("false")


# --- n-gram join -----------------------------------------------------------------------------------

def brute_components(rows, words, percent):
    shingle = ngram_join.Shingler(words)
    sets = [(i, set(shingle(t).tolist())) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for j in range(i):
            b, t = sets[j]
            if s and t and a is not None and b is not None and 100 * len(s & t) >= percent * len(s | t):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (a, _) in enumerate(sets):
        least[find(i)].append(a)
    return Counter((a, len(s), None if a is None else min(least[find(i)])) for i, (a, s) in enumerate(sets))


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_ngram_components(docs, words, percent):
    got = Counter(tuple(r) for r in ngram_join.jaccard_components(docs, words, percent).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components([r[:2] for r in text_rows()], words, percent)


@pytest.mark.parametrize("block_docs", [1024, 3])
def test_ngram_links(spark, none, block_docs, monkeypatch):
    """Every linked pair and each row's number of links equal an all-pairs search, also across blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block_docs)
    rng = np.random.default_rng(8)
    texts = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(120)]
        for _ in range(6):
            own = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 3)):
                own[at] = f"x{rng.integers(10**9)}"
            texts.append(" ".join(own))
    texts += texts[:3] + [texts[0], "", None, "alone in the world"]
    rows = list(enumerate(texts)) + [(None, texts[0])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(i, frozenset(zip(*((t or "").split()[k:] for k in range(3))))) for i, t in rows]
    linked = lambda s, t: bool(s and t) and 100 * len(s & t) >= 80 * len(s | t)
    n_links = {i: sum(i != j and j is not None and linked(s, t) for j, t in sets) for i, s in sets if i is not None} | {None: 0}
    got = ngram_join.jaccard_links(table, 3, 80).collect()
    assert {r.doc_id: r.n_links for r in got} == n_links and len(got) == len(rows)
    least = {s: min(i for i, t in sets if s == t and i is not None) for i, s in sets if i is not None}
    pairs = {(min(a, b), max(a, b)) for s, a in least.items() for t, b in least.items() if s != t and linked(s, t)}
    found = [tuple(r) for r in ngram_join.jaccard_pairs(table, 3, 80).collect()]
    assert len(found) == len(set(found)) and set(found) == pairs
    assert len(pairs) > len(least) and ngram_join.jaccard_links(none).count() == 0


def test_ngram_empty_and_keep(docs, none):
    assert ngram_join.jaccard_components(none).count() == 0
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns and {1, 2, 3} & {r.doc_id for r in kept.collect()} == set()


@pytest.mark.parametrize("seed", range(6))
def test_divide_skip_and_keys_lose_nothing(seed):
    rng = np.random.default_rng(seed)
    percent = [60, 80, 90][seed % 3]
    base = [np.unique(rng.integers(0, 2**63, rng.integers(3, 120)).astype(np.uint64)) for _ in range(8)]
    sets = [np.unique(np.r_[b[rng.random(len(b)) > rng.random() * 0.3], rng.integers(0, 2**63, rng.integers(0, 6)).astype(np.uint64)]) for b in base for _ in range(6)]
    keys = ngram_join.Keys(percent)
    emitted, bits = [set(keys.of(s).tolist()) for s in sets], [keys.bitmap(s) for s in sets]
    label = list(range(len(sets)))
    for i, s in enumerate(sets):
        for j in range(i):
            inter = len(np.intersect1d(s, sets[j]))
            if 100 * inter >= percent * (len(s) + len(sets[j]) - inter):
                label = [label[i] if x == label[j] else x for x in label]
                assert set(s.tolist()) == set(sets[j].tolist()) or emitted[i] & emitted[j]
                assert ngram_join.possible_forest(keys, np.array([len(s), len(sets[j])]), [bits[i], bits[j]])
    found = list(range(len(sets)))
    for a, b in ngram_join.linked_forest(sets, percent):
        found = [found[a] if x == found[b] else x for x in found]
    assert len(set(zip(label, found))) == len(set(label)) == len(set(found))


@pytest.mark.parametrize("batch_rows", [7, 100_000])
def test_sets_may_leave_frequent_keys(batch_rows, monkeypatch):
    """Linked sets still share a key when each leaves its most frequent ones; huge groups' pieces stay."""
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "GROUP_MEMBERS", 5)
    rng, keys = np.random.default_rng(3), ngram_join.Keys(80)
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    common = [draw(60), draw(40)]
    base = [np.r_[draw(n), common[i % 2]] for i, n in enumerate(rng.integers(20, 160, 40))]
    sets = [np.unique(np.r_[b[rng.random(len(b)) > rng.random() * 0.25], draw(rng.integers(0, 9))]) for b in base for _ in range(3)]
    rows = sorted((int(k), i) for i, s in enumerate(sets) for k in keys.of(s).view(np.int64))
    parts = [rows[at : at + batch_rows] for at in range(0, len(rows), batch_rows)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], names=["key", "nid"]) for part in parts]
    weights, order = Counter(), {}
    for out in ngram_join._groups(iter(batches)):
        for group, nid, members, odd, weight in zip(*(c.to_pylist() for c in out.columns)):
            weights[group, nid] += weight
            order[group] = (odd, -members, group)
    kept, left = defaultdict(set), Counter()
    for group, nid in sorted(weights, key=lambda x: order[x[0]]):
        odd = order[group][0]
        left[nid, odd] += weights[group, nid]
        if left[nid, odd] > keys.rooms(sets[nid])[odd]:
            kept[group].add(nid)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for group in kept.values():
        first, *rest = group
        for i in rest:
            parent[find(i)] = find(first)
    linked = 0
    for i, s in enumerate(sets):
        for j in range(i):
            inter = len(np.intersect1d(s, sets[j]))
            if 100 * inter >= 80 * (len(s) + len(sets[j]) - inter):
                linked += 1
                assert find(i) == find(j)
                assert batch_rows < 100 or any(i in g and j in g for g in kept.values())
    assert linked > 10
    assert batch_rows < 100 or sum(map(len, kept.values())) < len(weights)  # in small batches the frequent keys are pieces, which stay


def test_pieces_of_huge_groups_join_whole(monkeypatch):
    """Linked sets in different pieces of one key stay connected, also where every row comes several times."""
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "GROUP_MEMBERS", 5)
    rng, keys = np.random.default_rng(5), ngram_join.Keys(80)
    sets = [np.unique(rng.integers(0, 2**64, 90 + i % 3, dtype=np.uint64)) for i in range(61)]
    sets[60] = np.sort(np.r_[sets[0][1:], rng.integers(0, 2**64, 1, dtype=np.uint64)])
    for copies, rows_a_batch in ((1, 7), (10, 7), (10, 33)):
        rows = [(4, i) for i in range(61) for _ in range(copies)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + rows_a_batch])], names=["key", "nid"]) for at in range(0, len(rows), rows_a_batch)]
        found = sorted(r[:2] + r[4:] for out in ngram_join._groups(iter(batches)) for r in zip(*(c.to_pylist() for c in out.columns)))
        columns = [[r[0] for r in found], [r[1] for r in found], [len(sets[r[1]]) for r in found], [keys.bitmap(sets[r[1]]) for r in found], [r[2] for r in found]]
        given = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["group", "nid", "n", "bits", "weight"])
        label = list(range(61))
        for out in ngram_join._possible_links(80)(iter([given])):
            for a, b in zip(*(c.to_pylist() for c in out.columns)):
                label = [label[a] if x == label[b] else x for x in label]
        assert label[0] == label[60]


# --- packing -----------------------------------------------------------------------------------------

def test_packing_round_trip(docs, none):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    want = Counter()
    for doc_id, text, *_ in text_rows():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want[doc_id] += len(ids)
        for r in rows:
            if r.doc_id == doc_id and doc_id != 9:
                assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert {k: sum(r.length for r in rows if r.doc_id == k) for k in want} == dict(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0
        total = sum(n for _, n in parts)
        assert total <= 2048 and total & (total - 1) == 0
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a\n b", "a \nb", "x<|endoftext|>y <|endoftext|>", "don't we're 12ab", "é ü ß", "　a b", "", " "])
def test_fast_tokens_equal_the_library(text):
    from public_tokenizers import PATTERN, path
    from tokenizers import Tokenizer

    encode = packing.byte_bpe(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), PATTERN)
    assert encode(text).tolist() == Tokenizer.from_file(path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


# --- chat ----------------------------------------------------------------------------------------------

def test_packing_scores_all_terms_and_fills_with_neighbours():
    """Neighbours equal BM25 over all terms, and related items go before unrelated ones until the window is full."""
    rng = np.random.default_rng(6)
    items = [rng.zipf(1.3, rng.integers(5, 300)).clip(0, 3000).astype(np.uint16) for _ in range(120)]
    # 0 shares its 30 rarest ids with 1 and 2, and 40 more frequent ids with 3, which holds none of the rarest.
    rare, common = np.arange(5000, 5030), np.arange(6000, 6040)
    items[:4] = [np.r_[rare, common].astype(np.uint16), rare.astype(np.uint16), rare.astype(np.uint16), common.astype(np.uint16)]
    items += [common[:20].astype(np.uint16)] * 40
    index, n = packing.BM25Index(items), len(items)
    counts, mean = [Counter(x.tolist()) for x in items], np.mean([len(x) for x in items])
    df = Counter(t for c in counts for t in c)
    k1, b = packing.K1, packing.B
    left = np.array([len(x) for x in items])
    left[7] = 0
    for seed in (0, 3, 9, 50):
        want = [sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * len(x) / mean)) for t in counts[seed] if t in c) for c, x in zip(counts, items)]
        assert np.allclose(index.scores(seed)[np.arange(n) != seed], np.delete(want, seed), rtol=1e-4, atol=1e-4)
        got = index.neighbours(seed, left, 10**9)
        assert set(got.tolist()) == {i for i in range(n) if want[i] > 0 and left[i]}
    assert 3 in index.neighbours(0, left, 10**9)
    some = index.neighbours(9, left, 500)
    assert left[some].sum() >= 500 and some.tolist() == index.neighbours(9, left, 10**9)[: len(some)].tolist()
    # 40 short items are related to the seed; the unrelated ones come first in input order, and must wait.
    short = [np.array([1, 2, 3], np.uint16)] + [np.array([50 + i] * 3, np.uint16) for i in range(60)] + [np.array([1, 70 + i, 2], np.uint16) for i in range(40)]
    first = next(packing.pack_shard([3] * len(short), packing.BM25Index(short), window=3 * 41))
    assert {i for i, _, _ in first} == {0, *range(61, 101)}


def test_templates():
    run = lambda source, **v: "".join(t for t, _ in templates.compile_template(source)(**v))
    assert run("{% for m in ms %}{{ loop.index }}{{ m.a|upper }}{% if not loop.last %},{% endif %}{% endfor %}", ms=[{"a": "x"}, {"a": "y"}]) == "1X,2Y"
    assert templates.fold(templates.parse("a{{ 'b' ~ 1 ~ 1 }}{% if false %}c{{ 'x' + 1 }}{% else %}d{% endif %}")) == [("text", "ab11d")]
    assert run("{% set x = 'k' %}{% if x == 'k' and x in 'ok' %}yes{% elif true %}no{% endif %}  {%- if true %}!{% endif %}") == "yes!"
    for bad in ("{{ x.__class__ }}", "{{ f() }}", "{% for %}{% endfor %}", "{% if x %}", "{{ 'a'.upper }}", "{{ missing }}"):
        with pytest.raises(templates.TemplateError):
            run(bad, x=1)


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "back\\slash <|turn|>", "<|end|>\n", "", None, "é\n\n", "<<|end|>|end|>", "\\<|end|>"]
    rows = [(c, t, r, x, 1) for c in (1, None) for t, (r, x) in enumerate(zip(["user", "assistant"] * 4, hard))] + [(2, 0, "a\nb<|end|>", "t", 1), (2, None, None, "first", 1), (3, 0, "assistant", "same", 1), (3, 0, "assistant", "same", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    rendered = chat.render(table)
    got = {r.conv_id: r for r in chat.digest(rendered).collect()}
    loss = "".join(x or "" for x in hard[1::2])
    turns = "".join(f"{r}\n{x or ''}\n" for r, x in zip(["user", "assistant"] * 4, hard))
    for c in (1, None):
        assert got[c].n_turns == 8 and got[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256("\nfirst\na\nb<|end|>\nt\n".encode()).hexdigest() and got[2].loss_chars == 0
    assert got[3].n_turns == 2 and got[3].loss_chars == 8
    for r in rendered.collect():
        assert r.formatted.count(chat.OPEN) == got[r.conv_id].n_turns
    assert chat.digest(chat.render(table.where("false"))).count() == 0


# --- language models and language ID -----------------------------------------------------------------------

def test_lm_counts(docs, none):
    held = langid.id_crc("doc_id") % 7 == 2
    rows = lm_scoring.score(docs, held).collect()
    counts, is_held = Counter(), lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    for doc_id, text, *_ in text_rows():
        if not is_held(doc_id):
            counts.update(lm_scoring.words_of(text))
    total, types = sum(counts.values()), len(counts)
    want = Counter()
    for doc_id, text, *_ in text_rows():
        w = lm_scoring.words_of(text)
        want[doc_id, is_held(doc_id), len(w), sum(x in counts for x in w), total, round(sum(math.log10((counts[x] + 1) / (total + types + 1)) for x in w), 3)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in rows) == want
    assert all(r.score <= 0 for r in rows)
    assert lm_scoring.score(none, held).count() == 0


def test_lm_learns_from_every_token(spark):
    """Each token of each training document is one example with its history, in blocks of any size."""
    texts = ["a b c a b", None, "", " ".join(f"w{i % 300}" for i in range(900)), "a"]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    vocabulary = lm_scoring.Vocabulary(lm_scoring.count_words(table), frequent=50)
    shared = spark.sparkContext.broadcast(lm_scoring._portable(vocabulary))
    index, before, want = vocabulary.index(), len(vocabulary.class_tokens), Counter()
    for t in texts:
        own = [vocabulary.class_of(w, index) for w in lm_scoring.words_of(t)]
        want.update((*(own[i - k] if i >= k else before for k in range(1, lm_scoring.HISTORY + 1)), own[i]) for i in range(len(own)))
    sequences = [bytes(r.classes) for r in lm_scoring.class_sequences(table, shared).collect()]
    for most in (1, 7, 10**6):
        assert Counter(tuple(x) for block in lm_scoring.blocks_of(iter(sequences), before, most) for x in block.tolist()) == want
    assert sum(want.values()) == 5 + 900 + 1 + len(texts)


def test_lm_is_normalised():
    model = lm_scoring.LogBilinear(np.arange(1, 21, dtype=float))
    rng = np.random.default_rng(0)
    examples = rng.integers(0, 20, (500, 4)).astype(np.int16)
    model.fit(examples)
    history = np.repeat(rng.integers(0, 21, (1, 3)), 20, 0)
    assert abs(np.exp(model.log_probabilities(history, np.arange(20))).sum() - 1) < 1e-4


def test_language_id(docs, none):
    rows = langid.identify(docs).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(text_rows())
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 10, 11))
    known = [r for r in rows if r.doc_id and r.doc_id >= 20]
    assert sum(r.lang_pred == ("de" if r.doc_id % 2 else "en") for r in known if r.held_out) >= 0.9 * sum(r.held_out for r in known)
    assert langid.identify(none).count() == 0
    assert langid.keep_identified(docs).columns == docs.columns


def test_cnn_tables_equal_the_network():
    rng = np.random.default_rng(3)
    model = langid.ByteCNN(["a", "b", "c"])
    x = rng.integers(0, 256, (5, langid.LENGTH)).astype(np.uint8)
    pooled = []
    for w, kernel in zip(langid.WIDTHS, model.filters):
        taps = np.einsum("be,kef->kbf", model.embed, kernel)
        pooled.append(sum(taps[k][x[:, k : langid.LENGTH - w + 1 + k]] for k in range(w)).max(1))
    logits = np.maximum(np.concatenate(pooled, 1) + model.bias, 0) @ model.out + model.out_bias
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    assert np.allclose(model.predictor()(x), p, atol=1e-4)


# --- sharding, dedup, mixing ---------------------------------------------------------------------------------

def test_sharding(docs, none, spark):
    rows = sharding.assign(docs).collect()
    assert len(rows) == len(text_rows()) and {r.law for r in rows} == {"key"}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.size for r in rows if r.doc_id in (4, 5)} == {1} and {r.text_crc32 for r in rows if r.doc_id == 4} == {0}
    assert sharding.assign(none).count() == 0
    many = spark.range(20_000).select(sharding.jump_shard(F.col("id"), 8).alias("s"), sharding.jump_shard(F.col("id"), 9).alias("g")).groupBy("s").agg(F.count("*").alias("n"), F.sum((F.col("s") != F.col("g")).cast("int")).alias("m")).collect()
    assert all(2200 < r.n < 2800 and 150 < r.m < 420 for r in many)


def test_exact_dedup(docs, none, spark):
    rows = exact_dedup.decide(docs).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text_sha256].append(r)
    assert len(rows) == len(text_rows()) and len(groups) == len({t or "" for _, t, *_ in text_rows()})
    for g in groups.values():
        ids = [r.doc_id for r in g if r.doc_id is not None]
        assert sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} and {r.keep_id for r in g} == {max(ids) if ids else None}
    index = exact_dedup.DigestIndex(spark)
    first = exact_dedup.drop_duplicates(docs.where("doc_id < 30"), index).count()
    again = exact_dedup.DigestIndex(spark, index.location, index.buckets)
    rest = exact_dedup.drop_duplicates(docs, again)
    assert rest.columns == docs.columns and first + rest.count() == len(groups)
    assert exact_dedup.decide(none).count() == 0


def test_mixing(docs, none, spark):
    labels = spark.createDataFrame([(20 + i, i % 2, 0) for i in range(60)] + [(8, None, 0), (12, 1, 1)], "doc_id long, quality int, toxic int")
    rows = mixing.mix(docs, labels).collect()
    assert len(rows) == len(text_rows()) and all(abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-9 and 0 <= r.rate <= 1 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (4, 5, 11)} == {0}
    assert mixing.mix(none, labels).count() == 0 and mixing.mix(docs, labels.where("false")).count() == len(rows)
    clashing = docs.withColumnsRenamed({"n_chars": "__mixn", "digest": "a.b"}).withColumn("__mix_rate", F.lit(5))
    kept = mixing.thin(clashing, labels)
    assert kept.columns == clashing.columns and {r["__mixn"] for r in kept.collect()} == {7} and {r["__mix_rate"] for r in kept.collect()} == {5}


def test_mixing_posteriors(spark, docs):
    """A document's posterior equals naive Bayes summed word by word, in fixed point."""
    rng = np.random.default_rng(1)
    weights = [[float(x) for x in rng.normal(0, 2, mixing.BUCKETS) * (rng.random(mixing.BUCKETS) < 0.2)] for _ in mixing.DOMAINS]
    model, name = mixing.DomainClassifier([0.7, 0.2, 0.1], weights), mixing._free(docs.columns)
    got = mixing.with_posteriors(docs, model, name).select("text", *(F.col(name(f"p_{d}")).alias(d) for d in mixing.DOMAINS)).collect()
    once = spark.createDataFrame([(w,) for w in sorted({w for t in text_rows() for w in (t[1] or "").split()})], "w string")
    hashed = {r.w: (r.a, r.b) for r in once.select("w", F.expr(f"pmod(hash(w), {mixing.BUCKETS}) a"), F.expr(f"pmod(hash(substring(w, -2, 2), 1), {mixing.BUCKETS}) b")).collect()}
    level = lambda x, kind, n: spark.range(1).select(F.pmod(F.hash(F.lit(kind), F.lit(min(math.floor(x * n), n - 1)).cast("bigint")), F.lit(mixing.BUCKETS))).first()[0]
    for r in got[:12]:
        words = (r.text or "").split()
        buckets = {b for w in words for b in hashed[w]} | {level(len(set(words)) / max(len(words), 1), "distinct", 10), level(math.log2(len(words) + 1) / 20, "length", 20)}
        scores = [math.log(p) + sum(w[b] for b in buckets) for p, w in zip(model.priors, weights)]
        z = [math.exp(x - max(scores)) for x in scores]
        assert np.allclose([r[d] for d in mixing.DOMAINS], np.array(z) / sum(z), atol=0.01)


def test_mixing_meets_targets(spark):
    """At the query's settings the fitted rates meet every target that can be met, as an independent threshold search shows."""
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.3, 0.05, 0.1], 3000)
    p[:2000] = rng.dirichlet([30, 0.2, 0.2], 2000)
    n = rng.integers(10, 2000, 3000)
    table = spark.createDataFrame([(int(a), *map(float, q)) for a, q in zip(n, p)], "n long, p_good double, p_poor double, p_toxic double")
    cells = mixing.cells_of(table, lambda c: c).cache()
    assert cells.count() <= (mixing.GRID + 1) * (mixing.GRID + 2) / 2
    fit = mixing.fit_rates(cells)
    got = cells.withColumn("rate", fit.now()["rate"]).agg(*(F.sum(F.col(f"m{k}") * F.col("rate")) for k in range(3))).first()
    assert fit.miss < 0.01 and all(abs(x / n.sum() - g) < 0.01 * g for x, g in zip(got, fit.goal) if g is not None)
    # The most good tokens that a mixture with so small a toxic share can have: thresholds on the ratio, over all documents.
    order = np.argsort(p[:, 2] / p[:, 0])
    total, toxic = np.cumsum(n[order]), np.cumsum((n * p[:, 2])[order])
    assert fit.goal[0] * n.sum() <= (n * p[:, 0])[order][: np.flatnonzero(toxic <= 0.011 * total)[-1] + 1].sum()
    unreachable = mixing.fit_rates(spark.createDataFrame([(0, 100.0, 40.0, 30.0, 30.0)], "cell int, n double, m0 double, m1 double, m2 double"))
    assert unreachable.miss > 0.5 and np.isfinite(unreachable.miss)


def test_dedup_with_clashing_columns(docs):
    clashing = docs.withColumnsRenamed({"n_chars": "a.b", "lang": "__xd_row"}).withColumn("__xd_digest", F.lit("x"))
    kept = exact_dedup.drop_duplicates(clashing)
    rows = kept.collect()
    assert kept.columns == clashing.columns and {r["a.b"] for r in rows} == {7} and {r["__xd_digest"] for r in rows} == {"x"}
    assert len(rows) == len({r[1] or "" for r in text_rows()}) and {r["__xd_row"] for r in rows} <= {r[2] for r in text_rows()}


def test_warc_and_language_keep_large_ids(spark):
    large = 2**53 + 1
    pages = spark.createDataFrame([(large, "u", "a"), (None, "u", "b"), (large + 2, "u", "a")], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.refers_to for r in warc.archive_round_trip(pages).collect()}
    assert got == {large: large + 2, None: None, large + 2: None}
    hot = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("html"))
    rows = warc.archive_round_trip(hot).collect()
    assert sum(r.record_type == "revisit" for r in rows) == 99 and {r.refers_to for r in rows if r.record_type == "revisit"} == {297}
    texts = spark.createDataFrame([(large, "hello"), (None, "\u00bd \u00b2 \u2167")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.lang_pred for r in langid.predict(texts, langid.ByteCNN(["de", "en"])).collect()}.keys() == {large, None}
    assert langid.has_letter("\u00bd x") and not langid.has_letter("\u00bd \u00b2 \u2167 12 !")


# --- WARC, images ------------------------------------------------------------------------------------------------

def test_warc_round_trip(spark):
    long = "x" * 3_000_000
    rows = [(1, "http://a/\r\nX", "<p>é</p>", 1), (2, None, "<p>é</p>", 1), (2, "u", "<p>é</p>", 1), (3, "u", None, 1), (4, "u", "", 1), (None, "u", "<p>é</p>", 1), (5, "u", long, 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = warc.archive_round_trip(table, with_payload=True).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        html = next(x[2] for x in rows if x[0] == r.page_id) or ""
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == warc.sha1_base32(html.encode())
        assert (r.record_type == "response") == (r.refers_to is None) and (r.record_type == "revisit" or bytes(r.payload) == html.encode())
    assert Counter((r.page_id, r.record_type) for r in got if r.page_id in (2, 3, 4)) == Counter({(2, "response"): 1, (2, "revisit"): 1, (3, "revisit"): 1, (4, "response"): 1})
    assert warc.archive_round_trip(table.where("false")).count() == 0


def test_warc_reader_finds_faults():
    good = warc.page_records(1, 0, "u", "hello", 1, 0, "2000-01-01T00:00:00Z")
    member = warc.gzip_member(good, 6)
    for size in (1, 7, 1 << 16):
        assert [b.partition(b"\r\n\r\n")[2] for _, b in warc.read_records(io.BytesIO(member * 3), size)] == [b"hello"] * 3
    assert gzip.decompress(member) == good
    for bad in (member[:-5], warc.gzip_member(good.replace(b"hello", b"hexlo"), 6), warc.gzip_member(good[:-4], 6), warc.gzip_member(b"x\r\n\r\n", 6)):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))


def brute_matches(query, indexed):
    """(query, image) pairs whose near descriptors, found by comparing all, agree on a similarity."""
    out = {}
    for q, a in query.items():
        for i, b in indexed.items():
            far = sum(np.bitwise_count(a[c][:, None] ^ b[c][None]).astype(int) for c in ("high", "low"))
            at, to = np.nonzero(far <= images.MOST_BITS)
            if len(at) >= images.LEAST_MATCHES and (n := images.similarity(a["place"][at], b["place"][to])[0]) >= images.LEAST_MATCHES:
                out[q, i] = n
    return out


def test_image_copies(spark):
    """Links equal an all-pairs search; crops, turns and other sizes are found; ids may be null or shared."""
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(24)] + [(30, None), (31, []), (None, [1.0])], "vec_id long, embedding array<double>")
    pictures = images.pictures(vectors)
    flat = spark.createDataFrame([(32, bytearray(images.to_pgm(np.full((64, 64), 9.0)))), (33, bytearray(b"P5\n4 4\n255\nxx")), (34, bytearray(b""))], "image_id long, image binary")
    index = pictures.unionByName(flat)
    asked = images.pictures(vectors.where("vec_id < 16"), edit=True)
    links, members = images.find_copies(asked, index)
    got = {(r.query_id, r.class_id): r.n_matches for r in links.collect()}
    known = lambda rows: {r.image_id: np.frombuffer(r.points, images.POINT) for r in rows.collect() if r.points}
    assert got == brute_matches(known(images.extract(asked, step=1)), known(images.extract(index)))
    assert {q for q, i in got if q == i} >= {i for i in range(16) if i % 3 != 1} and all(q == i for q, i in got) and any(q % 3 == 1 for q, _ in got)  # small resized crops are found in part
    assert Counter(r.image_id for r in members.collect()) == Counter([*range(24), 31 + 1, 33, 34])
    assert images.find_copies(asked.where("false"), index)[0].count() == 0
    # Rows that share an id are images of their own: each is found under the id, none mixes with the other.
    shared = index.where("image_id in (2, 3)").withColumn("image_id", F.lit(7).cast("long"))
    links, members = images.find_copies(asked.where("image_id in (2, 3)"), shared.unionByName(shared))
    assert {(r.query_id, r.class_id) for r in links.collect()} == {(2, 7), (3, 7)}
    assert [(r.class_id, r.class_size) for r in members.collect()] == [(7, 2)] * 4


def test_image_edits_are_found():
    """Of plain turns and other sizes at least 0.9 are found by all-pairs comparison at the operator's settings, and no other picture."""
    rng, tests = np.random.default_rng(3), images.pattern()
    pictures = np.stack([images.from_pgm(images.to_pgm(images.picture(rng.normal(size=8)))) for _ in range(20)])
    indexed = dict(enumerate(images.describe(pictures, tests, images.INDEX_STEP)))
    for edit in (np.rot90, lambda x: np.rot90(x, 2), lambda x: images.resized(x, 0.9), lambda x: images.resized(x, 1.2), lambda x: x[4:, 9:] * 0.9 + 5):
        asked = {k: images.describe(images.from_pgm(images.to_pgm(edit(x.astype(float))))[None], tests)[0] for k, x in enumerate(pictures)}
        found = brute_matches(asked, indexed)
        assert sum(q == i for q, i in found) >= 18 and all(q == i for q, i in found)
    large = images.describe(np.kron(pictures[0], np.ones((4, 4)))[None], tests)[0]
    assert len(large) > 3 * len(indexed[0])  # corners grow with the area
    assert images.from_pgm(None) is None and images.from_pgm(b"P5\n4 4\n255\nxx") is None and len(images.describe(np.zeros((1, 3, 3)), tests)[0]) == 0


def test_extract_describes_every_level(spark):
    """The table form has the corners of the whole pyramid, as the array form has them, for images of several sizes."""
    rng, tests = np.random.default_rng(8), images.pattern()
    drawn = [images.picture(rng.normal(size=8), size) for size in (64, 64, 96)]
    table = spark.createDataFrame([(n, bytearray(images.to_pgm(x))) for n, x in enumerate(drawn)], "image_id long, image binary")
    for step in (1, images.INDEX_STEP):
        for r in images.extract(table, step).collect():
            points = np.frombuffer(r.points, images.POINT)
            assert np.array_equal(points, images.describe(images.from_pgm(images.to_pgm(drawn[r.image_id]))[None], tests, step)[0])
            assert len(set((points["place"] & 15).tolist())) > 2


@pytest.mark.parametrize("broadcast", [True, False])
def test_near_descriptors_all_meet(spark, broadcast):
    """The bands find what an all-pairs Hamming search finds, up to MOST_BITS wherever the bits are."""
    rng = np.random.default_rng(4)
    own = [int.from_bytes(rng.bytes(16), "big") for _ in range(60)]
    turned = [(v ^ sum(1 << int(b) for b in rng.choice(128, n, replace=False))) for v in own for n in range(15) for _ in range(2)]
    evenly = [v ^ sum(1 << b for b in range(5, 128, 16)[:7]) for v in own]  # spread over all bands
    both = lambda v: [int.from_bytes(v.to_bytes(16, "big")[a : a + 8], "big", signed=True) for a in (0, 8)]
    table = lambda values: spark.createDataFrame([(n, 0, *both(v)) for n, v in enumerate(values)], "image_id long, place long, high long, low long")
    index = turned + evenly
    got = images.near_points(table(own), table(index), broadcast).select("q.image_id", "i.image_id").collect()
    assert set(map(tuple, got)) == {(a, b) for a, v in enumerate(own) for b, w in enumerate(index) if (v ^ w).bit_count() <= images.MOST_BITS}


# --- pipeline ------------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    table = docs.select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(20 + i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen[name] = Counter(r.doc_id for r in now.collect())
        assert k == 4 or now.columns == table.columns
    every = Counter(r[0] for r in text_rows())
    assert every - seen["language_id"] == Counter([4, 5, 10, 11])
    assert seen["language_id"] - seen["exact_dedup"] == Counter([0, 1, 9])
    assert 3 not in seen["near_dedup"] and 2 in seen["near_dedup"]
    assert set(seen["packing"]) == set(seen["mixing"])


@pytest.mark.parametrize("reach", [0.3, 40.0])
def test_lm_softmax_of_kept_histories(reach):
    """Histories met before and new ones, small and huge logits: each token's value is that of a plain softmax."""
    rng = np.random.default_rng(1)
    model = lm_scoring.LogBilinear(np.arange(1, 31, dtype=float))
    model.target[...] = rng.normal(0, reach, model.target.shape)
    scorer = lm_scoring.Normalised(model)
    for n in (1, 2_500, 2_500):
        history, target = rng.integers(0, 31, (n, lm_scoring.HISTORY)), rng.integers(0, 30, n)
        logits = (model.history[history].astype(float) * model.position).sum(1) @ model.target.T.astype(float) + model.bias
        top = logits.max(1)
        want = logits[np.arange(n), target] - top - np.log(np.exp(logits - top[:, None]).sum(1))
        assert np.allclose(scorer.log_probabilities(history, target), want, rtol=1e-4, atol=1e-4)


def test_lm_learns_a_chain():
    """A word order that always repeats is learned almost surely."""
    rng = np.random.default_rng(2)
    chain = (np.arange(4_000) * 7 % 20).astype(np.int16)
    examples = np.stack([chain[2:-1], chain[1:-2], chain[:-3], chain[3:]], 1)
    model = lm_scoring.LogBilinear(np.full(20, 100.0))
    before = model.log_probabilities(examples[:, :3], examples[:, 3]).mean()
    model.fit(examples[rng.permutation(len(examples))], epochs=20)
    assert before < -2.5 and model.log_probabilities(examples[:, :3], examples[:, 3]).mean() > -0.5


def test_lm_beats_the_base_on_held_out_texts(spark):
    """Word order that repeats is worth a tenth of a digit a token at least over counts alone."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(np.roll(WORDS, int(rng.integers(0, len(WORDS)))).tolist() * 3)) for i in range(300)]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), langid.id_crc("doc_id") % 7 == 2).where("held_out").collect()
    tokens = sum(r.n_tokens for r in got)
    assert len(got) > 20 and sum(r.score - r.base_score for r in got) / tokens > 0.1
