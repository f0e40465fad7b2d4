"""Operators keep no stage tables but those their result reads."""

import pytest

from linkgraph.llm.queries import QUERIES
from linkgraph.sources import store


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op9_suffix_array_dedup", "op10_jaccard_join"])
def test_stage_tables_are_freed(spark, nasty, name):
    paths, tables = set(store._stages), set(store._tables)
    out = QUERIES[name](spark, nasty)
    assert len(set(store._stages) - paths) == 1 and set(store._tables) == tables
    assert out.count() == spark.read.parquet(f"{nasty}/documents.parquet").count()
    assert not [t for t in spark.catalog.listTables() if "texts" in t.name]
