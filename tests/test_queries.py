"""Every registered query against its SQL, on tables large enough that their columns say something."""

from __future__ import annotations

import pytest

from tidemark.plans import more_queries, panel_queries, pit_queries, text_queries, trend_queries

from .conftest import TABLES
from .oracle import compare

BLOCKS = [pit_queries, panel_queries, trend_queries, text_queries, more_queries]
BOTH = [(n, b) for b in BLOCKS for n in b.QUERIES if n in b.SQL]
#: Constant by their nature on these tables: one calendar, one book under several costs, counts of repeated rows.
CONSTANT = {
    "factor_scores": {"decile"},  # a day has fewer than ten names here; pooled_scores and band_scores have deciles
    "permutation_null": {"periods"},
    "band_book_grid": {"periods"},
    "decision_readout": {"ic_ok"},
    "scenario_grid": {"days", "years", "exposure", "gross_sharpe", "turnover"},
    "missing_report": {"n"},
    "extractor_verdict": {"features"},
    "repeated_bars": {"n"},
}
ALONE = [(n, b) for b in BLOCKS for n in b.QUERIES if n not in b.SQL]


@pytest.mark.parametrize(("name", "block"), BOTH, ids=[n for n, _ in BOTH])
def test_equals_sql(spark, name, block):
    ok, said = compare(spark, name, block.QUERIES[name], block.SQL[name], TABLES, frozenset(CONSTANT.get(name, ())))
    assert ok, said


@pytest.mark.parametrize(("name", "block"), ALONE, ids=[n for n, _ in ALONE])
def test_runs(spark, name, block):
    assert len(block.QUERIES[name](spark, TABLES).collect()) > 0  # collected, so no Python column is pruned away


def test_every_sql_has_a_query():
    for b in BLOCKS:
        assert set(b.SQL) <= set(b.QUERIES)
