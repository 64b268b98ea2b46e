"""Queries say something of every row of their tables."""

import duckdb
import pytest
from metaloom.plans import catalogue

from tests.test_catalogue import DATA

WHOLE = {
    "og_article": ("orders", "o_orderkey"), "jsonld_nodes": ("orders", "o_orderkey"), "embedded_items": ("events", "event_id"), "embedded_best_string": ("events", "event_id"),
    "image_candidates": ("lineitem", "l_orderkey"), "media_dedupe": ("lineitem", "l_orderkey"), "score_images": ("lineitem", "l_orderkey"), "best_image": ("lineitem", "l_orderkey"),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_every_row_of_the_table_counts(spark, name):
    table, key = WHOLE[name]
    found = {r[key] for r in catalogue.QUERIES[name](spark, DATA).select(key).distinct().collect()}
    assert found == {k for (k,) in duckdb.connect().execute(f"SELECT DISTINCT {key} FROM '{DATA}/{table}.parquet'").fetchall()}


def test_a_redirect_to_nowhere_is_an_error(spark):
    found = {r.start: r for r in catalogue.QUERIES["redirect_chain"](spark, DATA).collect()}
    assert set(found) == set(range(25))
    assert tuple(found[24]) == (24, None, None, "No response for https://n.example.com/25")


def test_no_query_states_a_subset_of_its_ids():
    assert not [n for n, sql in catalogue.ORACLES.items() if "WHERE o_orderkey %" in sql or "WHERE event_id %" in sql or "WHERE l_orderkey %" in sql]
