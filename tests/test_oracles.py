"""Every registered query of the signal research part against its SQL on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from barloom.plans.oracles import ORACLES  # noqa: E402
from barloom.plans.queries import QUERIES  # noqa: E402

TABLES = "lineitem orders supplier".split()
#: Those that cover the others' work; the rest run with TEST_ALL=1.
CORE = ["bars_long", "bars_csv", "bars_folder", "propose_rules", "live_decisions", "altdata_csv", "panel_saved", "notebook_with_scores", "notebook_saved", "rules_saved", "insight_effects", "permutation_metrics", "moving_averages", "bollinger", "atr", "volume_z", "rsi", "pivots", "active_leg_levels", "confluence", "barrier_labels", "trades", "ticker_performance", "walk_forward_performance", "ticker_stats", "filter_sweep", "permutation_test", "asof_altdata", "panel_positions", "fold_assignment", "binary_metrics", "failure_notebook", "insight_categorical", "rule_registry", "holm"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("TEST_ALL") else CORE)
def test_equal(name, spark, duck, sf):
    got = QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    rows = sorted([str([plain(r[c]) for c in cols]) for r in got.collect()])
    cur = duck.execute(ORACLES[name])
    at = {c[0]: i for i, c in enumerate(cur.description)}
    assert sorted(at) == cols
    assert rows == sorted(str([plain(r[at[c]]) for c in cols]) for r in cur.fetchall())
