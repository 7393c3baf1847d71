"""Registered queries against their SQL on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import pytest

from kinfolk.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
FAST = ["union_sources", "scan_dedupe_first", "partition_blank_country", "skeleton_tokens", "rare_topk_tokens", "block_union_score_bits_topk", "knn_topk", "group_rank_max_top2", "expected_f_select", "error_taxonomy", "oracle_topk_bound", "tag_rates",
        "block_ns", "block_an", "join_budget", "distinct_text_codes", "retrievers_merged", "error_taxonomy_by_country", "weighted_negatives", "shortlist_truncation", "known_id_lookup"]
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        db.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df, sql = catalogue.queries()[name](spark, str(DATA)), db.sql(catalogue.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    at = [sql.columns.index(c) for c in columns]
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == Counter(tuple(plain(r[i]) for i in at) for r in sql.fetchall())


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
