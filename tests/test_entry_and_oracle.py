"""Driver contract and the DuckDB oracle gate on the smallest fixture."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
FAST = ["user_degree", "reverse_adjacency", "common_friends", "label_candidates", "topk_recommend",
        "feature_table", "mask_pair_hist", "mask_diag_counts", "twohop_stats", "holdout_thinning",
        "auc", "fbeta_by_threshold", "best_threshold", "ndcg", "ranked_list_text", "profile_summary",
        "scaled_features"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert [f.name for f in df.schema.fields] == ["user_id", "rank", "candidate_id", "score"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(E.oracle_sql()[name])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert canon(df.columns, rows) == canon(list(rel.columns), orows)
