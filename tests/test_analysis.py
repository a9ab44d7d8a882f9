"""Sources and sinks, insights, rules, learning and streaming."""

import hashlib
import inspect
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import altdata, insight, learning, notebook, panel, permutation, rules, universe
from barloom.params import Params
from barloom.plans import queries
from barloom.scratch import new_path
from barloom.sources import bars, fixtures, sinks
from barloom.streaming import live


def planted(seed=0, n=200):
    rng = np.random.default_rng(seed)
    rows = []
    for kind, rsi, trend in (("FP", 75, 0.1), ("TP", 50, 0.9)):
        for i in range(n):
            rows.append((f"{kind}{i}", i, kind, float(rng.normal(rsi, 5)), float(rng.normal(0.02, 0.005)), int(rng.random() < trend), 1, 1, float(rng.normal()), "a" if kind == "FP" or i % 2 else "b", float(rng.normal(-0.02 if kind == "FP" else 0.03, 0.01))))
    return rows


COLS = "ticker string, bar_idx long, mistake_type string, rsi double, atr_pct double, trend_up int, regime_ok int, fib_near int, vol_z double, nearest_fib_level string, forward_return double"


@pytest.fixture(scope="module")
def nb(spark):
    return spark.createDataFrame(planted(), COLS).cache()


def test_p_values_against_tables():
    assert insight.student_p(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert insight.normal_p(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert insight.chi2_p(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert insight.chi2_p(18.307, 10) == pytest.approx(0.05, abs=1e-4)


def test_insights_find_what_was_planted(nb):
    s = {r.feature: r for r in insight.insights(nb).collect()}
    assert s["rsi"].effect_size > 3 and s["rsi"].direction == "↑ in FP" and s["rsi"].p_value_corrected < 1e-6
    assert s["trend_up"].kind == "binary" and s["trend_up"].effect_size < -0.5
    assert s["vol_z"].p_value_corrected > 0.01 and s["nearest_fib_level"].kind == "categorical"
    text = insight.report(insight.insights(nb), "FP", 200, 200)
    assert "rsi" in text and "vol_z" not in text
    assert "insufficient" in insight.report(None, "FP", 0, 3)
    assert insight.insights(nb.where("mistake_type = 'TP'")).count() == 0


def test_rules_find_what_was_planted(spark, nb, tmp_path):
    got = rules.propose(nb)
    found = [r.asDict() for r in got.collect()]
    assert found and ("rsi" in found[0]["py_expr"]) and not found[0]["enabled"] and found[0]["fp_tp_ratio"] > 2
    sinks.write_rules(got, f"{tmp_path}/rules")
    back = sorted(map(str, bars.read_rules(spark, f"{tmp_path}/rules").collect()))
    assert back == sorted(map(str, got.collect()))
    assert rules.propose(nb.where("mistake_type = 'FP'")).count() == 0
    same = nb.withColumn("rsi", F.lit(50.0)).withColumn("trend_up", F.lit(1)).withColumn("atr_pct", F.lit(0.02)).withColumn("vol_z", F.lit(0.0))
    assert rules.propose(same).count() == 0


def test_rules_apply_and_retire(spark, nb):
    rs = [{"name": "hot", "py_expr": "(rsi > 65)", "enabled": True}, {"name": "off", "py_expr": "(rsi > 0)", "enabled": False}, {"name": "bad", "py_expr": "(nothing > 0)", "enabled": True}]
    blocked = rules.applied(nb, rs).where("blocked")
    assert blocked.where("rsi <= 65").count() == 0 < blocked.count()
    assert rules.applied(nb, []).where("blocked").count() == 0
    old = spark.createDataFrame([("worse", 2, 20, 0.1, 1, 0), ("silent", 0, 0, None, 3, 3), ("fine", 20, 2, 10.0, 3, 0)], rules.REGISTRY)
    assert {r.name for r in rules.removals(old).collect()} == {"worse", "silent"}
    new = {r.name: r for r in rules.updated_registry(old, nb, rs).collect()}
    assert new["bad"].epochs_silent == 1 and new["hot"].cumulative_blocked_fp > 150 and new["fine"].epochs_active == 3 and "off" not in new


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/AAA.csv").write_text("Date,Open,HIGH,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,10\n2020-01-01,1,2,0.5,NaN,10\n")
    (tmp_path / "in/BBB.csv").write_text("Close,Open,High,Low,Volume,Date\n7,8,9,6,5,2020-01-01\n")
    (tmp_path / "in/CCC.csv").write_text("Date,Open\n2020-01-01,1\n")
    got = {(r.ticker, str(r.bar_ts.date())): r for r in bars.read_bar_folder(spark, str(tmp_path / "in")).collect()}
    assert set(got) == {("AAA", "2020-01-01"), ("AAA", "2020-01-02"), ("BBB", "2020-01-01")}
    assert got["AAA", "2020-01-01"].close is None and got["BBB", "2020-01-01"].close == 7.0
    assert bars.read_csv_bars(spark, str(tmp_path / "in/AAA.csv"), "X").count() == 2
    (tmp_path / "long.csv").write_text("Ticker,Date,Open,High,Low,Close,Volume\nA,2020-01-01,1,2,0.5,1.5,10\n,2020-01-01,1,2,0.5,1.5,10\n")
    long = bars.read_long_bars(spark, str(tmp_path / "long.csv"))
    assert long.count() == 1
    with pytest.raises(ValueError, match="missing columns"):
        bars.read_csv_bars(spark, str(tmp_path / "in/CCC.csv"))
    sinks.write_panel(bars.with_bar_index(long), str(tmp_path / "panel"))
    back = spark.read.parquet(str(tmp_path / "panel"))
    assert dict(back.dtypes)["close"] == "float" and back.first().month == "2020-01"
    sinks.write_csv(long, str(tmp_path / "out"), one_file=True)
    assert bars.read_stage(spark, str(tmp_path / "out") + "/*.csv").count() == 1
    (tmp_path / "alt.csv").write_text("Date,Ticker,metric,value\n2020-01-03,A,m,1\n2020-01-03,B,m,2\n")
    assert bars.read_altdata(spark, str(tmp_path / "alt.csv"), ticker="A").count() == 1
    inv = universe.file_inventory(spark, str(tmp_path / "in")).first()
    assert inv.n_files == 3 and inv.n_suspicious == 0


def test_business_days(spark):
    days = pd.date_range("2020-01-01", periods=14)
    d = spark.createDataFrame([(x.date(),) for x in days], "d date")
    for n in (1, 2, 5, 7):
        got = [r[0] for r in d.orderBy("d").select(altdata.business_days_later(F.col("d"), n)).collect()]
        assert got == [(x + pd.tseries.offsets.BusinessDay(n)).date() for x in days]


def test_draws(spark):
    d = permutation.random_draws(spark, Params(), 50).collect()
    assert len(d) > 40 and all(len(r.ratios) == 5 and list(r.ratios) == sorted(set(r.ratios)) and 0.2 <= min(r.ratios) and max(r.ratios) <= 0.8 for r in d)


def test_all_permutations(spark, sf):
    draws = permutation.random_draws(spark, queries.P).collect()
    assert all(list(r.ratios) == sorted(set(r.ratios)) and 0.2 <= r.ratios[0] and r.ratios[-1] <= 0.8 for r in draws)
    r = queries.permutation_test(spark, sf).first()
    assert r.n_perms == len(draws) == queries.P.n_permutations == 1000 and 0 <= r.p_value <= 1


def test_learning(spark, sf):
    p = queries.learning_panel(spark, sf)
    scores = learning.walk_forward_scores(p, n_splits=2, min_train=1000, params=queries.FEW, unit="date")
    assert scores.where("proba is null or proba < 0 or proba > 1").count() == 0 < scores.count()
    assert scores.groupBy("ticker", "bar_idx").count().where("count > 1").count() == 0
    cols = [c for c in panel.feature_columns(p) if c != "pos"]
    model = learning.fit(p, cols, queries.FEW)
    imp = learning.feature_importance(model, spark).collect()
    assert sum(r.importance for r in imp) == pytest.approx(1) and imp[0].importance >= imp[-1].importance


def test_learning_queries_run_the_defaults(spark, sf, monkeypatch):
    """Of what the queries pass to the operators, nothing makes the job smaller than the operators' defaults."""
    got = {}

    def seen(name, out):
        f = getattr(learning, name)

        def stub(*a, **k):
            b = inspect.signature(f).bind(*a, **k)
            b.apply_defaults()
            got[name] = {x: b.arguments[x] for x, v in inspect.signature(f).parameters.items() if v.default is not v.empty}, {x: v.default for x, v in inspect.signature(f).parameters.items() if v.default is not v.empty}
            return out

        monkeypatch.setattr(learning, name, stub)

    frame = spark.createDataFrame([("A", 0, 0, 0.0)], "ticker string, bar_idx long, label int, rsi double")
    monkeypatch.setattr(queries, "learning_panel", lambda *_: frame)
    monkeypatch.setattr(queries, "nb", lambda *_: frame)
    monkeypatch.setattr(notebook, "cluster_summary", lambda d: d)
    for name in ("walk_forward_scores", "rolling_scores", "fit", "cluster_failures"):
        seen(name, frame)
    for f in (queries.walkforward_oof, queries.rolling_oof, queries.failure_clusters):
        f(spark, sf)
    queries.final_model(spark, sf)
    assert len(got) == 4
    for name, (passed, default) in got.items():
        assert passed == default | ({"unit": "date"} if name == "walk_forward_scores" else {}), name


def test_many_folds_are_not_one_plan(spark):
    rows = spark.range(400).selectExpr("'A' as ticker", "id as bar_idx", "timestamp_seconds(id * 86400) as bar_ts", "cast(id % 2 as int) as label", "cast(id % 7 as double) as rsi", "id as pos")
    got = learning.rolling_scores(rows, min_train=380, refit_every=5, params={"trees": 1, "depth": 1})
    assert got.count() == 20 and got.select("fold").distinct().count() == 4
    assert "Union" not in got._jdf.queryExecution().toString()


def test_clusters(nb):
    got = learning.cluster_failures(nb, ["rsi", "vol_z"], n_clusters=3, seeds=2)
    assert got.where("mistake_type = 'TP' and cluster_id is not null").count() == 0
    assert got.where("mistake_type = 'FP'").select("cluster_id").distinct().count() == 3
    assert learning.cluster_failures(nb.limit(2), ["rsi"]).where("cluster_id is not null").count() == 0


def test_clusters_equal_plain_numpy(nb):
    cols, k, seeds = ["rsi", "atr_pct", "vol_z"], 4, 3
    got = learning.cluster_failures(nb, cols, n_clusters=k, seeds=seeds).where("mistake_type = 'FP'").toPandas()
    x = got[cols].to_numpy(float)
    for j in range(x.shape[1]):
        v = np.sort(x[~np.isnan(x[:, j]), j])
        x[np.isnan(x[:, j]), j] = v[(len(v) + 1) // 2 - 1]
    x = (x - x.mean(0)) / x.std(0)
    keys = list(zip(got.ticker, got.bar_idx, strict=True))
    far = lambda c: ((x[:, None] - np.array(c)) ** 2).sum(2)
    runs = []
    for s in range(seeds):
        c = []
        for step in range(k):
            u = np.array([(int(hashlib.md5(f"{s}:{step}:{t}:{b}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32 for t, b in keys])
            c.append(x[np.argmin(-np.log(u) / (np.maximum(far(c).min(1), 1e-300) if c else 1.0))])
        for _ in range(300):
            own = far(c).argmin(1)
            new = [x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)]
            moved = ((np.array(new) - np.array(c)) ** 2).sum()
            c = new
            if moved <= 1e-4:
                break
        runs.append((round(far(c).min(1).sum(), 6), s, far(c).argmin(1)))
    assert got.cluster_id.tolist() == min(runs, key=lambda r: r[:2])[2].tolist()


def test_budget_keeps_failures(nb):
    assert notebook.attribution_rows(nb, 10).groupBy("mistake_type").count().collect()[0]["count"] == 200
    assert notebook.attribution_rows(nb, 250).count() == 250


def test_history_only_warms_up(spark, sf):
    b = fixtures.bars(spark, sf)
    cut = F.col("bar_idx") < 300
    got = live.batch_decisions(b.where(~cut), Params(min_confluence=2), history=b.where(cut))
    assert got.count() > 0 and got.join(b.where(cut), ["ticker", "bar_ts"], "left_semi").count() == 0


def counted(d):
    """`d`, and an accumulator of the rows that were computed of it."""
    seen = d.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return d.mapInArrow(run, d.schema), seen


def noisy_notebook(spark, n=3000):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        rsi, kind = round(rng.gauss(50, 12), 3), rng.choice(["FP", "TP", "TN"])
        rows.append(("A", i, "FP" if kind == "TP" and rsi > 61.5 else kind, rsi, round(rng.gauss(0, 1), 4), int(rng.random() < 0.3), rng.gauss(0, 0.02)))
    return spark.createDataFrame(rows, "ticker string, bar_idx long, mistake_type string, rsi double, vol_z double, trend_up int, forward_return double")


def test_rules_are_proposed_from_one_computation_of_the_notebook(spark):
    nb = noisy_notebook(spark)
    d, seen = counted(nb)
    got = rules.propose(d, min_ratio=0.5, purity=0.3).collect()
    assert got and seen.value == 3000


def test_splits_equal_all_thresholds_tried(spark):
    """Two nodes, features of many values and of two; ranges that are ruled out lose no better split."""
    cols, weights, least = ["rsi", "vol_z", "trend_up"], (1.2, 0.9), 7
    d = noisy_notebook(spark).select(*[F.col(c).cast("double").alias(c) for c in cols], (F.col("mistake_type") == "FP").cast("long").alias("y"), (F.col("bar_idx") % 2).cast("int").alias("node")).cache()
    got = rules.best_splits(d, cols, weights, least)
    pure = lambda a, n: ((a * 1.2) ** 2 + ((n - a) * 0.9) ** 2) / (a * 1.2 + (n - a) * 0.9)
    for node in (0, 1):
        rows, best = d.where(f"node = {node}").collect(), (0.0, None)
        ta, tn = sum(r.y for r in rows), len(rows)
        for c in cols:
            line, la = sorted((r[c], r.y) for r in rows), 0
            for i, ((v, y), (w, _)) in enumerate(zip(line, line[1:], strict=False), 1):
                la += y
                if v < w and i >= least and tn - i >= least:
                    gain = round(pure(la, i) + pure(ta - la, tn - i) - pure(ta, tn), 9)
                    best = max(best, (gain, (c, (v + w) / 2)), key=lambda x: x[0])
        assert got[node] == best[1]


def test_clusters_come_from_one_computation_of_the_notebook(spark):
    d, seen = counted(noisy_notebook(spark, 600))
    got = notebook.cluster_summary(learning.cluster_failures(d, ["rsi", "vol_z"], n_clusters=3, seeds=2, rounds=3)).collect()
    assert len(got) == 3 and seen.value == 600


def test_strongest_attributions_come_from_one_computation(spark):
    rows = [("A", 0, "a", 0.1), ("A", 0, "b", 0.3), ("A", 0, "c", 0.1), ("A", 0, "d", -0.2), ("A", 1, "a", 0.0), ("B", 0, "b", -0.5), ("B", 0, "a", -0.5), ("B", 0, "c", -0.7)]
    d, seen = counted(spark.createDataFrame(rows, "ticker string, bar_idx long, feature string, value double"))
    got = {(r.ticker, r.bar_idx): (r.top_pos_features, r.top_neg_features) for r in notebook.top_attributions(d, 2).collect()}
    assert got == {("A", 0): ("b=+0.300;a=+0.100", "d=-0.200"), ("A", 1): ("", ""), ("B", 0): ("", "c=-0.700;a=-0.500")}
    assert seen.value == len(rows)


@pytest.mark.parametrize("name", ["attribution_topk", "notebook_with_scores"])
def test_queries_compute_their_bars_once(spark, sf, monkeypatch, name):
    """Two steps that read the same rows read a kept table."""
    from barloom.plans import queries as registered

    seen = []

    def counted_results(*args):
        d, n = counted(registered.outcomes.with_outcomes(registered.prepared(spark, sf), registered.P))
        seen.append(n)
        return d

    monkeypatch.setattr(registered, "with_results", counted_results)
    assert registered.QUERIES[name](spark, sf).count() > 0
    assert sum(n.value for n in seen) == 5334
