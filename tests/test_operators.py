"""Decisions, windows, blocking caps, readers and list checks on small tables."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfolk.operators import blocking, decide, diagnostics, features, model, retrieval, windows
from kinfolk.sources import records


def pairs(spark, rows):
    return spark.createDataFrame(rows, "q_id int, i_id int, p double")


def test_f05_values(spark):
    rows = spark.createDataFrame([(2, 3, 2), (0, 0, 0), (0, 2, 0), (3, 4, 3), (3, 2, 2), (3, 0, 0)], "g int, p int, tp int")
    got = [round(r[0], 6) for r in rows.select(decide.f05(F.col("g"), F.col("p"), F.col("tp"))).collect()]
    assert got == [0.714286, 1.0, 0.0, 0.789474, 0.909091, 0.0]


def test_expected_f_keeps_the_best_prefix(spark):
    df = decide.with_expected_f(pairs(spark, [(1, 1, 0.9), (1, 2, 0.6), (1, 3, 0.1)])).orderBy("rank")
    rows = df.collect()
    assert [round(r.ef, 6) for r in rows] == [0.803571, 0.78125, 0.588235]
    assert round(rows[0].ef_empty, 3) == 0.036 and [r.take for r in rows] == [True, False, False]


@pytest.mark.parametrize("p, q, i, out", [(0.98, 5, 5, 1.0), (0.98, 5, 10, 0.93), (0.98, 5, 11, 0.98), (0.98, -1, 5, 0.98)])
def test_house_number(spark, p, q, i, out):
    row = spark.createDataFrame([(p, q, i)], "p double, q int, i int").select(decide.adjust_house_number(F.col("p"), F.col("q"), F.col("i"))).first()
    assert round(row[0], 9) == out


def test_best_other(spark):
    rows = windows.with_top2(pairs(spark, [(1, 1, 0.7), (1, 2, 0.4), (2, 3, 0.5)]), "q_id", "p", "i_id").orderBy("q_id", "i_id").collect()
    assert [(r.top1, r.top2, r.best_other) for r in rows] == [(0.7, 0.4, 0.4), (0.7, 0.4, 0.7), (0.5, None, None)]


def test_metric_of_truth_is_one(spark):
    truth = pairs(spark, [(1, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)])
    entities = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "q_id int, country string")
    got = {r.country: r.macro_f05 for r in decide.macro_f05(decide.entity_counts(entities, truth, truth), "country").collect()}
    assert got == {"a": 1.0, "b": 1.0, None: 1.0}


@pytest.mark.parametrize("df, qdf, bit, kept", [(500, 100, 0, True), (500, 101, 0, False), (201, 1, 4, False), (200, 1, 4, True)])
def test_key_caps(spark, df, qdf, bit, kept):
    rows = [(f"i{n}", "i", "x") for n in range(df)] + [(f"q{n}", "q", "x") for n in range(qdf)]
    recs = spark.createDataFrame(rows, "rec_id string, side string, ckey string")
    keys = recs.withColumns({"bit": F.lit(bit), "ka": F.lit("k"), "kb": F.lit("")})
    assert blocking.key_join(keys, recs).count() == (df * qdf if kept else 0)


def test_blank_partitions_join_all(spark):
    q = spark.createDataFrame([(1, "us"), (2, "fr"), (3, "")], "rec_id int, ckey string")
    i = spark.createDataFrame([(10, "us"), (11, ""), (12, "de")], "rec_id int, ckey string")
    got = {tuple(r) for r in blocking.share_blank_partitions(q, i).select("rec_id", "ckey").collect()}
    assert got == {(10, "us"), (11, ""), (11, "us"), (11, "fr")}


def test_merge_retrievers(spark):
    keyed = spark.createDataFrame([("x", 1, 1, 2.0, 1, 0)], "ckey string, q_id int, i_id int, bscore double, bits long, brank long")
    other = spark.createDataFrame([("x", 1, 1), ("x", 1, 2)], "ckey string, q_id int, i_id int")
    got = {r.i_id: (r.bscore, r.bits, r.brank) for r in blocking.merge_retrievers(keyed, [(other, 8)]).collect()}
    assert got == {1: (2.0, 257, 0), 2: (0.0, 256, 90)}


def test_knn_finds_itself(spark):
    rows = spark.createDataFrame([(n, [float(n == k) for k in range(8)]) for n in range(8)], "rec_id long, vec array<double>")
    got = {r.q_id: r.i_id for r in retrieval.knn(rows, rows, 1).collect()}
    assert got == {n: n for n in range(8)}


def test_reader_repairs_lines(spark, tmp_path):
    path = tmp_path / "s.tsv"
    path.write_text("﻿entity_id\tbusiness_name\tbusiness_address\tcountry\r\nS2-1\tA \"q\"\tx\ty\tUS\r\n\r\nS2-2\tB\r\nS2-1\tagain\tz\tUS\r\n\tno id\tz\tUS\r\n", encoding="utf-8")
    got = sorted(tuple(r) for r in records.read_source(spark, str(path)).select("entity_id", "business_name", "business_address", "country").collect())
    assert got == [("S2-1", 'A "q"', "x y", "US"), ("S2-2", "B", "", "")]


def test_lists_and_faults(spark):
    entities = spark.createDataFrame([("S1-1",), ("S1-2",)], "q_id string")
    selected = spark.createDataFrame([("S1-1", "S2-a", 0.5), ("S1-1", "S3-b", 0.9), ("S1-1", "S1-x", 0.9), ("S1-1", "S2-a", 0.4)], "q_id string, i_id string, p double")
    lists = records.id_lists(entities, selected)
    assert {r.q_id: r.ids for r in lists.collect()} == {"S1-1": "S3-b,S2-a", "S1-2": ""}
    assert all(r.n == 0 for r in records.list_faults(lists, entities).collect())
    bad = spark.createDataFrame([("S1-1", "S2-a,S2-a"), ("S1-1", "X9-b"), ("S1-9", "")], "q_id string, ids string")
    assert {r.fault: r.n for r in records.list_faults(bad, entities).collect()} == {"repeated_row": 1, "repeated_id": 1, "bad_prefix": 1, "missing_row": 1, "extra_row": 1}


def test_tags(spark):
    row = spark.createDataFrame([("acme ltd", "ACME"), ], "a string, b string").select(diagnostics.name_tags(F.col("a"), F.col("b"), F.lower("a"), F.lower("b"))).first()[0]
    assert set(row) == {"legal_suffix_dropped", "name_truncated"}


def test_references_and_contract(spark):
    rows = features.reference_candidates(pairs(spark, [(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7)]).withColumnRenamed("p", "p1")).orderBy("i_id").collect()
    assert [(r.ref1, r.ref2) for r in rows] == [(2, 3), (1, 3), (1, 2)]
    with pytest.raises(ValueError):
        model.check_contract(["a", "b"], ["b", "a"])


def test_entity_subsample_keeps_clusters(spark):
    import zlib

    asks = [f"S1-{i}" for i in range(300)]
    truth = [(q, f"S2-{q}-{k}") for i, q in enumerate(asks) for k in range(i % 4)]
    index = [i for _, i in truth] + [f"S3-{k}" for k in range(200)]
    one = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    kept, own = model.entity_subsample(one(asks, "q_id"), one(index, "i_id"), spark.createDataFrame(truth, "q_id string, i_id string"), 0.3)
    wanted = {q for q in asks if zlib.crc32(b"dev" + q.encode()) % 1000 < 300}
    loose = {i for i in index if i.startswith("S3") and zlib.crc32(b"devx" + i.encode()) % 1000 < 300}
    assert {r.q_id for r in kept.collect()} == wanted and 0 < len(wanted) < 300 and loose
    assert sorted(r.i_id for r in own.collect()) == sorted({i for q, i in truth if q in wanted} | loose)


def test_hard_negatives_at_the_cap(spark):
    rows = [(q, i, int(i == 0), float(i % 3), None, i) for q in range(40) for i in range(10)]
    pairs = spark.createDataFrame(rows, "q_id long, i_id long, y int, bscore double, dcos double, brank int")
    negatives = sorted((-(b - 0.01 * i), q, i) for q, i, y, b, _, _ in rows if not y)
    got = model.hard_negatives(pairs, 97)
    assert sorted((r.q_id, r.i_id) for r in got.where("y = 0").collect()) == sorted((q, i) for _, q, i in negatives[:57]) and got.where("y = 1").count() == 40
    assert model.hard_negatives(pairs, 25).count() == 25 and model.hard_negatives(pairs, 25).where("y = 0").count() == 0 and model.hard_negatives(pairs, 9999).count() == 400


def test_gate_and_masks(spark):
    """Pairs beyond the gate have no sequence similarity, nor those with an empty side."""
    columns = [*features.NAME_COLUMNS, *features.ADDRESS_COLUMNS]
    record = lambda name, address: [name] * len(features.NAME_COLUMNS) + [address] * len(features.ADDRESS_COLUMNS)
    flags = "n_translit boolean, n_domain boolean, n_alias boolean, a_translit boolean, a_empty boolean, a_ncomp int"
    schema = ", ".join([f"{s}_{c} string" for s in "qi" for c in columns] + [f"{s}_{f}" for s in "qi" for f in flags.split(", ")] + ["brank int", "bits int"])
    row = lambda a, b, brank, empty=False: (*record(*a), *record(*b), *([False] * 4 + [False, 1]), *([False] * 4 + [empty, 1]), brank, 1)
    pairs = spark.createDataFrame([row(("acme", "1"), ("acme", "1"), 0), row(("acme", "1"), ("acme", "1"), 30), row(("", "1"), ("acme", "1"), 1), row(("", "1"), ("", ""), 2, True)], schema)
    got = {r.brank: r.asDict() for r in features.costly_features(features.address_features(features.name_features(pairs))).collect()}
    assert all(got[0][c] is not None for c in features.COSTLY) and all(got[30][c] is None for c in features.COSTLY)
    assert all(got[1][c] is None for c in features.FUZZY_NAME) and got[1]["a_ratio"] is not None and got[1]["n_jacc"] == 0
    assert got[2]["n_jacc"] is None and got[2]["n_first_eq"] == 1 and got[2]["a_tset"] is None


def test_headers_of_several_files(spark, tmp_path):
    """Each file's first line is a header; a record that reads entity_id stays; the first file's record counts."""
    for name, lines in {"a.tsv": ["entity_id\tbusiness_name\tbusiness_address\tcountry", "S2-1\tA\tx\tUS", "entity_id\tB\ty\tUS"], "b.tsv": ["entity_id\tbusiness_name\tbusiness_address\tcountry", "S2-1\tC\tz\tUS", "S2-2\tD\tz\tUS"]}.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    got = {r.entity_id: r.business_name for r in records.read_source(spark, str(tmp_path)).collect()}
    assert got == {"S2-1": "A", "entity_id": "B", "S2-2": "D"}
    (tmp_path / "truth").mkdir()
    for k in "ab":
        (tmp_path / "truth" / f"{k}.tsv").write_text(f"source1_entity_id\tmatched_entity_ids\nS1-{k}\tS2-1, ,S3-2\nS1-x\t{k}\n")
    assert {r.q_id: r.ids for r in records.read_truth(spark, str(tmp_path / "truth")).collect()} == {"S1-a": ["S2-1", "S3-2"], "S1-b": ["S2-1", "S3-2"], "S1-x": ["b"]}


def test_phonetic_key_family(spark):
    """Names that sound alike meet although no token is shared; the address side must share a skeleton."""
    from kinfolk.functions import phonetics, text
    from kinfolk.operators import blocking

    rows = spark.createDataFrame([(1, "q", "us", ["philips"], ["main"]), (2, "i", "us", ["filips"], ["main"]), (3, "i", "us", ["garden"], ["main"]), (4, "i", "us", None, []), (5, "i", "fr", ["philips"], ["main"])], "rec_id long, side string, ckey string, name array<string>, address array<string>")
    code = lambda t: F.get(phonetics.nysiis_all(F.array(t)), F.lit(0))
    names = blocking.rarest_rows(blocking.recoded(blocking.tokens_of(rows, "name"), code), 2, least_df=1)
    places = blocking.rarest_rows(blocking.recoded(blocking.tokens_of(rows, "address"), text.skeleton), 3, least_df=1)
    joined = blocking.key_join(blocking.cross_keys(names, places, 6), rows)
    assert {(r.q_id, r.i_id, r.bit) for r in joined.collect()} == ({(1, 2, 6)} if phonetics.nysiis("philips") == phonetics.nysiis("filips") else set())
    assert phonetics.nysiis("philips") == phonetics.nysiis("filips")


def test_codes_of_distinct_values(spark):
    from kinfolk.operators import blocking

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "")], "id int, t string")
    got = blocking.with_distinct(rows, "t", "up", F.upper)
    assert sorted((r.id, r.up) for r in got.collect()) == [(1, "A"), (2, "A"), (3, None), (4, "")]
    assert blocking.with_distinct(rows.where("false"), "t", "up", F.upper).count() == 0


def test_weighted_sample_follows_weights(spark):
    from kinfolk.operators import model

    rows = spark.range(4_000).select((F.col("id") % 50).alias("q_id"), F.col("id").alias("i_id"), F.when(F.col("id") % 2 == 0, 9.0).when(F.col("id") % 101 != 0, 1.0).alias("w"))
    got = model.weighted_sample(rows, "w", 500, "q_id", "i_id").collect()
    assert len({r.i_id for r in got}) == len(got) == 500 and all(r.w is not None for r in got)
    heavy = sum(r.w == 9.0 for r in got) / 500
    assert 0.82 < heavy < 0.96  # 0.9 at first, less as the heavy ones are used up
    assert sorted(r.i_id for r in model.weighted_sample(rows, "w", 500, "q_id", "i_id").collect()) == sorted(r.i_id for r in got)
    assert model.weighted_sample(rows, "w", 0, "q_id", "i_id").count() == 0 and model.weighted_sample(rows.where("false"), "w", 5, "q_id", "i_id").count() == 0
    assert model.weighted_sample(rows, "w", 10**6, "q_id", "i_id").count() == rows.where("w > 0").count()
    pairs = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.9), (3, 1, 0.1)], "q_id int, i_id int, p double")
    assert sorted((r.q_id, r.i_id) for r in model.truncated(pairs, 2).collect()) == [(1, 1), (2, 1)]


def test_unknown_ids_are_counted(spark):
    from kinfolk.operators import model

    ids, records = spark.createDataFrame([(1,), (2,), (2,), (9,), (None,)], "i int"), spark.createDataFrame([(1, "a"), (2, "b")], "i int, v string")
    found, unknown = model.known_ids(ids, records, "i")
    assert sorted((r.i, r.v) for r in found.collect()) == [(1, "a"), (2, "b"), (2, "b")] and unknown.first().n_unknown == 2


# --- BM25 ----------------------------------------------------------------------------------------

def brute_bm25(asked, held, k, k1=1.2, b=0.75):
    """{query: its k best (record, score)} of {id: words}, all compared with all."""
    n, mean = len(held), sum(map(len, held.values())) / len(held)
    df = Counter(w for words in held.values() for w in set(words))
    weight = lambda w, words: math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * words.count(w) * (k1 + 1) / (words.count(w) + k1 * (1 - b + b * len(words) / mean))
    usual = {w for w in df if df[w] <= max(50, n // 5)}
    out = {}
    for q, words in asked.items():
        scores = {i: round(sum(weight(w, own) for w in set(words) & usual & set(own)), 6) for i, own in held.items()}
        out[q] = sorted(((i, s) for i, s in scores.items() if s > 0), key=lambda x: (-x[1], x[0]))[:k]
    return {q: found for q, found in out.items() if found}


def worded(seed, n, copies=0):
    """Texts of frequent and rare words, some of them often in one text, and copies of the first."""
    rng = np.random.default_rng(seed)
    own = {i: [f"w{int(w)}" for w in 300 * rng.random(int(rng.integers(0, 60))) ** 2] for i in range(n)}
    return own | {n + c: own[1] for c in range(copies)}


def test_bm25_searches_whole_index_without_rows_of_pairs(spark, monkeypatch):
    ranked = []
    monkeypatch.setattr(retrieval, "top_k", lambda df, *a, top_k=retrieval.top_k: (ranked.append(df), top_k(df, *a))[1])
    monkeypatch.setattr(retrieval, "LEAST_BLOCK", 100, raising=False)
    held, asked = {"a": worded(1, 380, 40), "b": worded(2, 30), "c": {5: ["x"]}}, {"a": worded(3, 40, 2), "b": worded(4, 20), "d": {1: ["x"]}}
    table = lambda sides: spark.createDataFrame([(i, ckey, words) for ckey, own in sides.items() for i, words in own.items()] + [(9, None, ["w1"])], "rec_id long, ckey string, words array<string>")
    got = {}
    for r in retrieval.bm25(table(asked), table(held), "words", 7).orderBy("ckey", "q_id", "rank").collect():
        got.setdefault((r.ckey, r.q_id), []).append((r.i_id, r.score))
    want = {(ckey, q): found for ckey in "ab" for q, found in brute_bm25(asked[ckey], held[ckey], 7).items()}
    assert {q: [i for i, _ in found] for q, found in got.items()} == {q: [i for i, _ in found] for q, found in want.items()}
    assert all(abs(s - t) < 2e-6 for q in want for (_, s), (_, t) in zip(got[q], want[q]))
    assert ranked[0].count() <= 7 * 5 * (42 + 20)  # k rows a query and block, where each query shares words with nearly all records


@pytest.mark.parametrize("dense", [0, 3, 10_000])
def test_bm25_block_equals_all_sums(monkeypatch, dense):
    """Matrices, lists and both together choose the same records, in sums as in ties."""
    monkeypatch.setattr(retrieval, "DENSE_FLOOR", 0)
    monkeypatch.setattr(retrieval, "DENSE_TERMS", dense)
    held, asked = worded(5, 120, 30) | {500: ["w3"] * 70_000}, worded(6, 40, 1)
    names = sorted({w for own in (*held.values(), *asked.values()) for w in own})
    code = {w: 7919 * at - 3 for at, w in enumerate(names)}
    n, df, mean = len(held), Counter(w for own in held.values() for w in set(own)), sum(map(len, held.values())) / len(held)
    listed = [w for w in names if 0 < df[w] <= max(50, n // 5)]
    packed = lambda values, kind: np.array(values, kind).tobytes()
    terms = {i: sorted(set(own), key=code.get) for i, own in held.items()}
    block = retrieval._Block([packed([code[w] for w in listed], np.int64)], [packed([math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) for w in listed], np.float64)], list(held), [1.2 * (0.25 + 0.75 * len(own) / mean) for own in held.values()],
                             [packed([code[w] for w in terms[i]], np.int64) for i in held], [packed([held[i].count(w) for w in terms[i]], np.int32) for i in held], 1.2)
    want = brute_bm25(asked, held, 5)
    for q, (ids, scores) in zip(asked, block.best([packed([code[w] for w in set(own)], np.int64) for own in asked.values()], 5, 6)):
        assert ids.tolist() == [i for i, _ in want.get(q, [])] and np.allclose(scores, [s for _, s in want.get(q, [])], atol=2e-6)


def test_bm25_block_is_built_in_parts(monkeypatch):
    """What a unit of work needs while it builds is less than what it keeps, so that no copy of all postings is made."""
    import tracemalloc

    monkeypatch.setattr(retrieval, "ENTERED", 128, raising=False)
    rng, n, held = np.random.default_rng(7), 4000, 300
    codes, counts = np.arange(3000, dtype=np.int64), np.ones(held, np.int32).tobytes()
    owned = [np.sort(rng.choice(codes, held, replace=False)).tobytes() for _ in range(n)]
    given = [codes.tobytes()], [np.ones(len(codes)).tobytes()], list(range(n)), [1.2] * n, owned, [counts] * n, 1.2
    tracemalloc.start()
    try:
        block = retrieval._Block(*given)
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(block.lists) == len(codes) + 1 and peak < 2 * kept


def test_bm25_numbers_and_hashes_find_the_same(spark, monkeypatch):
    table = lambda own: spark.createDataFrame([(i, "a", words) for i, words in own.items()], "rec_id long, ckey string, words array<string>")
    asked, held = table(worded(3, 25)), table(worded(1, 90, 9) | {200: ["w250"] * 300})
    found = lambda: sorted(map(tuple, retrieval.bm25(asked, held, "words", 5).collect()))
    whole = found()
    for most, of_ckey in ((0, 5), (40, 5), (1000, 20)):
        monkeypatch.setattr(retrieval, "NUMBERED_TERMS", most)
        monkeypatch.setattr(retrieval, "NUMBERS", of_ckey)
        assert found() == whole


def test_largest_keeps_to_the_most(spark):
    rows = spark.createDataFrame([(v,) for v in [1] * 50 + [3] * 5 + [90, 100]], "v int")
    kept = lambda most: sorted(r.v for r in windows.largest(rows, "v", most).collect())
    assert (kept(1), kept(2), kept(10), kept(57)) == ([100], [90, 100], [3] * 5 + [90, 100], [1] * 50 + [3] * 5 + [90, 100])
    assert kept(0) == []


# --- rare tokens ---------------------------------------------------------------------------------

@pytest.mark.parametrize("looked_up", [0, 30, 10_000])
def test_rarest_tokens_shuffle_few_rows(spark, monkeypatch, looked_up):
    """The k rarest tokens equal those of all tokens, and frequent tokens don't leave the task but for k a record."""
    monkeypatch.setattr(blocking, "LOOKED_UP", looked_up, raising=False)
    sorted_rows = []
    monkeypatch.setattr(blocking, "top_k", lambda df, *a, top_k=blocking.top_k: (sorted_rows.append(df), top_k(df, *a))[1])
    own = [(i, "qi"[i % 2], "ab"[i % 3 > 0] if i % 11 else None, words or None) for i, words in worded(8, 120).items()] + [(900, "q", "c", ["lone", None]), (901, "i", "c", ["lone", "w1"])]
    table = spark.createDataFrame(own, "rec_id long, side string, ckey string, words array<string>")
    df = Counter((ckey, w) for _, _, ckey, words in own for w in set(words or ()) if ckey and w)
    want = {(i, side, ckey, w) for i, side, ckey, words in own if ckey for w in sorted({w for w in words or () if w and df[ckey, w] > 1}, key=lambda w: (df[ckey, w], w))[:3]}
    assert sorted(map(tuple, blocking.rarest(table, "words", 3).collect())) == sorted(want)
    if looked_up == 10_000:
        assert sorted_rows[0].count() <= 3 * len(own)
