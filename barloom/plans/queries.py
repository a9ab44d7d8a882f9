"""Registered queries over the fixture tables: one per operator, with results rounded to 6 places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import indicators as ind
from barloom.functions.recursive import with_sequential
from barloom.operators import altdata, insight, learning, metrics, notebook, outcomes, panel, permutation, rules, signals, universe
from barloom.params import Params
from barloom.scratch import keep, new_path
from barloom.sources import fixtures, sinks
from barloom.sources.bars import normalise, read_altdata, read_bar_folder, read_csv_bars, read_long_bars, read_rules, read_stage, with_bar_index
from barloom.streaming import live

P = Params()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    df = df.select(*cols) if cols else df
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(f):
    QUERIES[f.__name__] = f
    return f


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.prepare(fixtures.bars(spark, sf_dir), P)


def with_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.with_outcomes(prepared(spark, sf_dir), P)


def all_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.trades(with_results(spark, sf_dir), signals.entry_signal(P))


def with_score(results: DataFrame) -> DataFrame:
    return results.where("label is not null and regime_ok = 1").withColumn("proba", fixtures.score())


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows in the regime with a probability that SQL can compute."""
    return with_score(with_results(spark, sf_dir))


def nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notebook.build(scored(spark, sf_dir))


# -- sources and indicators


def exported(spark, sf_dir) -> DataFrame:
    """Bars under the names of an export."""
    return fixtures.bars(spark, sf_dir).select(F.col("ticker").alias("Ticker"), F.col("bar_ts").alias("Date"), *[F.col(c).alias(c.title()) for c in ("open", "high", "low", "close", "volume")])


def numbered(bars: DataFrame) -> DataFrame:
    return with_bar_index(bars).select("ticker", F.to_date("bar_ts").alias("bar_date"), "open", "high", "low", "close", "volume", "bar_idx")


@query
def bars_long(spark, sf_dir):
    return numbered(normalise(exported(spark, sf_dir), "ticker"))


@query
def bars_csv(spark, sf_dir):
    """Bars written as CSV and read back."""
    path = new_path(spark, "bars") + ".csv"
    sinks.write_csv(exported(spark, sf_dir), path)
    return numbered(read_long_bars(spark, path, "Ticker"))


def folder_of_bars(spark, sf_dir) -> str:
    """A file a ticker, with two kinds of headers."""
    path = new_path(spark, "bar-folder")
    b, odd = exported(spark, sf_dir), F.substring("Ticker", -1, 1).isin("1", "3", "5", "7", "9")
    sinks.write_bar_folder(b.where(~odd), path, "Ticker")
    sinks.write_bar_folder(b.where(odd).select("Ticker", F.col("Volume").alias("VOLUME"), F.col("Close").alias("close"), F.col("Date").alias("date"), F.lit("x").alias("note"), "Low", "High", "Open"), path, "Ticker")
    return path


@query
def bars_folder(spark, sf_dir):
    """A folder with one CSV file a ticker, of mixed headers, read back."""
    return numbered(read_bar_folder(spark, folder_of_bars(spark, sf_dir)))


@query
def bars_file(spark, sf_dir):
    """One ticker's file read back."""
    return numbered(read_csv_bars(spark, folder_of_bars(spark, sf_dir) + "/S00001.csv", "S00001"))


@query
def altdata_csv(spark, sf_dir):
    """Alternative data written as CSV and read back."""
    path = new_path(spark, "altdata") + ".csv"
    d = fixtures.altdata(spark, sf_dir).select(F.col("ticker").alias("Ticker"), F.col("date").alias("Date"), "metric", "value")
    sinks.write_csv(d, path)
    got = read_altdata(spark, path)
    return got.groupBy(F.col("Ticker").alias("ticker"), "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.min("Date").alias("first_date"), F.max("Date").alias("last_date"))


@query
def panel_saved(spark, sf_dir):
    """The labelled panel written by month with single-precision floats, and read back."""
    path = new_path(spark, "panel")
    d = with_results(spark, sf_dir).where("label is not null and regime_ok = 1").select("ticker", "bar_idx", "bar_ts", "label", "confluence_count", "close")
    sinks.write_panel(d, path)
    got = read_stage(spark, path)
    return got.groupBy(F.date_format("bar_ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("wins"), F.sum("confluence_count").alias("confluence"), F.sum("bar_idx").alias("sum_bar_idx"))


@query
def file_inventory(spark, sf_dir):
    return universe.file_inventory(spark, sf_dir)


@query
def moving_averages(spark, sf_dir):
    b = fixtures.bars(spark, sf_dir)
    return rounded(b.withColumns({f"ma{n}": ind.moving_average("close", n) for n in (20, 50, 200)}), "ticker", "bar_idx", "ma20", "ma50", "ma200", places=7)


@query
def bollinger(spark, sf_dir):
    return rounded(fixtures.bars(spark, sf_dir).withColumns(ind.bollinger()), "ticker", "bar_idx", "bb_mid", "bb_up", "bb_low")


@query
def atr(spark, sf_dir):
    b = fixtures.bars(spark, sf_dir).withColumn("true_range", ind.true_range()).withColumn("atr", ind.atr()).withColumn("atr_pct", F.col("atr") / F.col("close"))
    return rounded(b, "ticker", "bar_idx", "true_range", "atr", "atr_pct")


@query
def volume_z(spark, sf_dir):
    return rounded(fixtures.bars(spark, sf_dir).withColumn("vol_z", ind.volume_z()), "ticker", "bar_idx", "vol_z")


@query
def ema_macd(spark, sf_dir):
    return rounded(with_sequential(fixtures.bars(spark, sf_dir)), "ticker", "bar_idx", "ema_fast", "ema_slow", "macd", "macd_sig", "macd_hist")


@query
def rsi(spark, sf_dir):
    return rounded(with_sequential(fixtures.bars(spark, sf_dir)), "ticker", "bar_idx", "rsi")


@query
def pivots(spark, sf_dir):
    return with_sequential(fixtures.bars(spark, sf_dir)).where("pivot <> 0").select("ticker", "bar_idx", "pivot", "pivot_confirmed_at")


# -- legs, levels, flags


@query
def active_leg_levels(spark, sf_dir):
    d = signals.with_levels(signals.with_active_leg(with_sequential(fixtures.bars(spark, sf_dir))), P.ratios, extensions=True)
    return rounded(d, "ticker", "bar_idx", "swing_low", "swing_high", "fib_236", "fib_382", "fib_500", "fib_618", "fib_786", "ext_1272", "ext_1618")


@query
def nearest_level(spark, sf_dir):
    return rounded(prepared(spark, sf_dir), "ticker", "bar_idx", "nearest_fib_dist", "nearest_fib_level")


@query
def retracement_depth(spark, sf_dir):
    return rounded(prepared(spark, sf_dir), "ticker", "bar_idx", "retracement_depth")


@query
def confluence(spark, sf_dir):
    return prepared(spark, sf_dir).select("ticker", "bar_idx", *signals.FLAGS, "regime_ok", "confluence_count")


@query
def entry_signals(spark, sf_dir):
    return prepared(spark, sf_dir).where(signals.entry_signal(P)).select("ticker", "bar_idx", "confluence_count", "nearest_fib_level")


# -- outcomes and trades


@query
def barrier_labels(spark, sf_dir):
    b = signals.with_indicators(fixtures.bars(spark, sf_dir), P)
    return rounded(outcomes.with_outcomes(b, P), "ticker", "bar_idx", "label", "barrier_touched", "forward_return", "forward_bars")


@query
def trades(spark, sf_dir):
    return rounded(all_trades(spark, sf_dir), "ticker", "entry_idx", "exit_idx", "entry_price", "exit_price", "ret", "bars_held", "confluence", "exit_reason", "nearest_fib")


@query
def ticker_performance(spark, sf_dir):
    return rounded(outcomes.performance(all_trades(spark, sf_dir)))


@query
def ticker_summary(spark, sf_dir):
    keys = fixtures.bars(spark, sf_dir).select("ticker").distinct()
    return rounded(outcomes.summary(all_trades(spark, sf_dir), keys))


@query
def equity_curve(spark, sf_dir):
    return rounded(outcomes.equity(all_trades(spark, sf_dir)), "ticker", "entry_idx", "equity", "drawdown")


@query
def walk_forward_performance(spark, sf_dir):
    return rounded(outcomes.walk_forward(prepared(spark, sf_dir), signals.entry_signal(P)), "ticker", "fold", "trades", "win_rate", "avg_ret", "median_ret", "max_drawdown", "cum_return", "avg_bars_held")


@query
def corpus_headline(spark, sf_dir):
    return rounded(outcomes.headline(outcomes.performance(all_trades(spark, sf_dir)), "avg_ret"))


# -- universe


@query
def ticker_stats(spark, sf_dir):
    s = universe.ticker_stats(fixtures.bars(spark, sf_dir))
    return rounded(s.withColumns({c: F.to_date(c) for c in ("first_date", "last_date")}))


@query
def universe_filter(spark, sf_dir):
    spec = universe.FilterSpec(min_dollar_volume=3e5)
    return spec.keep(universe.ticker_stats(fixtures.bars(spark, sf_dir))).select("ticker", "n_bars")


@query
def universe_bars(spark, sf_dir):
    b = fixtures.bars(spark, sf_dir)
    kept = universe.FilterSpec(min_dollar_volume=3e5).keep(universe.ticker_stats(b))
    return universe.restrict(b, kept).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query
def filter_sweep(spark, sf_dir):
    stats = universe.ticker_stats(fixtures.bars(spark, sf_dir))
    dims = universe.DIMENSIONS | {"min_dollar_volume": (0, 1e5, 2e5, 3e5, 4e5, 1e6), "min_bars": (252, 504, 520, 535, 550)}
    return rounded(universe.sweep(stats, outcomes.performance(all_trades(spark, sf_dir)), "avg_ret", universe.FilterSpec(min_dollar_volume=1e5), dims))


@query
def coverage_profile(spark, sf_dir):
    return rounded(universe.coverage_profile(universe.coverage(fixtures.bars(spark, sf_dir))))


@query
def survivorship(spark, sf_dir):
    return universe.survivorship(universe.coverage(fixtures.bars(spark, sf_dir)))


@query
def short_history(spark, sf_dir):
    return universe.short_history(universe.coverage(fixtures.bars(spark, sf_dir)), 0.98).select("ticker", "n_rows")


@query
def dollar_volume(spark, sf_dir):
    return rounded(universe.dollar_volume(fixtures.bars(spark, sf_dir)))


# -- permutation test


def drawn(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The metrics of all P.n_permutations random draws, the draws, and the candidates."""
    cand = keep(permutation.candidates(with_results(spark, sf_dir), P), "candidates")
    draws = permutation.random_draws(spark, P)
    return keep(permutation.draw_metrics(permutation.draw_trades(cand, draws, P), draws), "draws"), draws, cand


@query
def permutation_metrics(spark, sf_dir):
    m, draws, _ = drawn(spark, sf_dir)
    sums = draws.select("draw_id", F.aggregate("ratios", F.lit(0.0), lambda a, x: a + x).alias("ratio_sum"))
    return rounded(m.join(sums, "draw_id"))


@query
def permutation_test(spark, sf_dir):
    m, _, cand = drawn(spark, sf_dir)
    base = permutation.draw_trades(cand, [(0, list(P.ratios))], P).agg(F.avg("ret").alias("avg_ret"))
    return rounded(permutation.permutation_summary(m, base))


#: Names under which all draws were run before the queries above did so.
QUERIES |= {"permutation_metrics_full": permutation_metrics, "permutation_test_full": permutation_test}


# -- alternative data


def wide_alt(spark, sf_dir):
    return altdata.wide(fixtures.altdata(spark, sf_dir), list(fixtures.METRICS.values()))


@query
def altdata_wide(spark, sf_dir):
    return wide_alt(spark, sf_dir)


@query
def altdata_lagged(spark, sf_dir):
    return altdata.lagged(wide_alt(spark, sf_dir), 1)


@query
def asof_altdata(spark, sf_dir):
    return altdata.merge_asof(fixtures.bars(spark, sf_dir).select("ticker", "bar_idx", "bar_date"), altdata.lagged(wide_alt(spark, sf_dir), 1))


# -- panel and folds


@query
def panel_positions(spark, sf_dir):
    return panel.with_position(fixtures.bars(spark, sf_dir), "bar_date").select("ticker", "bar_idx", "pos")


@query
def dataset(spark, sf_dir):
    d = panel.dataset(with_results(spark, sf_dir), keys=("ticker", "bar_idx"))
    return rounded(d, "ticker", "bar_idx", "rsi", "macd_hist", "atr_pct", "vol_z", "nearest_fib_dist", "retracement_depth", "confluence_count", "label")


@query
def folds_expanding(spark, sf_dir):
    return panel.expanding_folds(spark, fixtures.bars(spark, sf_dir).count())


@query
def folds_sliding(spark, sf_dir):
    return panel.expanding_folds(spark, fixtures.bars(spark, sf_dir).count(), max_train=504)


@query
def folds_rolling(spark, sf_dir):
    return panel.rolling_folds(spark, fixtures.bars(spark, sf_dir).select("bar_date").distinct().count(), step=5, max_train=504)


@query
def fold_assignment(spark, sf_dir):
    b = panel.with_position(fixtures.bars(spark, sf_dir), "bar_date")
    got = panel.assign_folds(b, panel.expanding_folds(spark, b.count()))
    return got.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


# -- metrics, notebook, insights, rules


def with_fold(d: DataFrame) -> DataFrame:
    return d.withColumn("fold", F.pmod(F.col("bar_idx"), F.lit(5)))


@query
def binary_metrics(spark, sf_dir):
    return rounded(metrics.binary_metrics(with_fold(scored(spark, sf_dir)), ("fold",)))


@query
def oof_metrics(spark, sf_dir):
    return rounded(metrics.oof_metrics(with_fold(scored(spark, sf_dir))))


@query
def failure_notebook(spark, sf_dir):
    return rounded(nb(spark, sf_dir), "ticker", "bar_idx", "proba", "pred", "label", "mistake_type", "forward_return", "barrier_touched", "rsi", "nearest_fib_level", "confluence_count")


@query
def notebook_with_scores(spark, sf_dir):
    """Scores saved as a table of their own, read back and joined to the features."""
    d = with_results(spark, sf_dir).select(*notebook.KEYS, "bar_ts", "label", "forward_return", "barrier_touched", "regime_ok", "confluence_count")
    d, path = keep(d, "results"), new_path(spark, "scores")  # read for the scores and for the notebook
    sinks.write_scores(with_score(d).select("ticker", "bar_idx", "bar_ts", "proba"), path)
    return rounded(notebook.build(d, read_stage(spark, path)), "ticker", "bar_idx", "proba", "pred", "label", "mistake_type", "forward_return")


@query
def notebook_saved(spark, sf_dir):
    """The notebook's counts and returns from its saved CSV."""
    path = new_path(spark, "notebook") + ".csv"
    sinks.write_csv(nb(spark, sf_dir), path)
    return rounded(read_stage(spark, path).groupBy("mistake_type").agg(F.count(F.lit(1)).alias("n"), F.avg("forward_return").alias("mean_forward_return"), F.max("confluence_count").cast("long").alias("most_confluence")))


@query
def mistake_counts(spark, sf_dir):
    return notebook.mistake_counts(nb(spark, sf_dir))


@query
def fp_returns(spark, sf_dir):
    return rounded(notebook.mistake_returns(nb(spark, sf_dir)))


@query
def attribution_budget(spark, sf_dir):
    n = keep(nb(spark, sf_dir).select("ticker", "bar_idx", "mistake_type"), "notebook")
    return notebook.attribution_rows(n, 12_000).groupBy("mistake_type").agg(F.count(F.lit(1)).alias("n"), F.sum("bar_idx").alias("sum_bar_idx"))


def fixture_attributions(spark, sf_dir) -> DataFrame:
    cols = ("rsi", "vol_z", "atr_pct", "macd_hist")
    d = keep(scored(spark, sf_dir).select("ticker", "bar_idx", *cols), "scored")  # read for the statistics and for the values
    long = d.select("ticker", "bar_idx", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in cols])).alias("f")).select("ticker", "bar_idx", "f.*").where("x is not null")
    stats = long.groupBy("feature").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))  # a row per feature
    return long.join(F.broadcast(stats), "feature").select("ticker", "bar_idx", "feature", ((F.col("x") - F.col("m")) / F.col("s") / 10).alias("value"))


@query
def attribution_topk(spark, sf_dir):
    return notebook.top_attributions(fixture_attributions(spark, sf_dir), 2)


@query
def mean_attribution(spark, sf_dir):
    return rounded(notebook.mean_attribution(fixture_attributions(spark, sf_dir)))


@query
def insight_numeric(spark, sf_dir):
    s = insight.number_stats(insight.grouped(nb(spark, sf_dir)), ["rsi", "atr_pct", "macd_hist", "vol_z"])
    return rounded(s, "feature", "n1", "mean1", "sd1", "n2", "mean2", "sd2", "cohens_d")


@query
def insight_binary(spark, sf_dir):
    s = insight.number_stats(insight.grouped(nb(spark, sf_dir)), ["trend_up", "fib_near", "macd_confirm", "vol_confirm"])
    return rounded(s, "feature", "n1", "k1", "n2", "k2", "delta")


@query
def insight_categorical(spark, sf_dir):
    s = insight.category_stats(insight.grouped(nb(spark, sf_dir)), ["nearest_fib_level"])
    return rounded(s, "feature", "n1", "n2", "chi2", "dof", "cramers_v", "share1", "share2")


@query
def holm(spark, sf_dir):
    """Correction of stand-in p-values, one per order priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    p = o.groupBy(F.col("o_orderpriority").alias("feature")).agg((F.pmod(F.sum("o_orderkey"), F.lit(1000)) / 20000.0).alias("p_value"))
    return rounded(insight.holm(p))


@query
def insight_summary(spark, sf_dir):
    return insight.insights(nb(spark, sf_dir))


@query
def insight_effects(spark, sf_dir):
    """All of the summary that needs no distribution function."""
    return rounded(insight.insights(nb(spark, sf_dir), correct=False), "feature", "kind", "effect_size", "effect_label", "direction")


RULES = [
    {"name": "hot", "predicate": "rsi > 60", "py_expr": "(rsi > 60.0)", "enabled": True},
    {"name": "calm_trend", "predicate": "atr_pct <= 0.02 AND trend_up == 1", "py_expr": "(atr_pct <= 0.02) and (trend_up == 1)", "enabled": True},
    {"name": "far", "predicate": "nearest_fib_dist > 0.02", "py_expr": "(nearest_fib_dist > 0.02)", "enabled": False},
    {"name": "never", "predicate": "vol_z > 99", "py_expr": "(vol_z > 99)", "enabled": True},
    {"name": "broken", "predicate": "no_such > 1", "py_expr": "(no_such > 1)", "enabled": True},
]


@query
def rule_scores(spark, sf_dir):
    return rounded(rules.score(nb(spark, sf_dir), RULES))


@query
def rules_saved(spark, sf_dir):
    """Scored rules written as a JSON list and read back."""
    path = new_path(spark, "rules")
    s = rules.score(nb(spark, sf_dir), RULES)
    text = spark.createDataFrame([(r["name"], r["predicate"], r["py_expr"], r["enabled"]) for r in RULES], "name string, predicate string, py_expr string, enabled boolean")
    full = s.join(text, "name").select("name", "predicate", "py_expr", F.col("blocked_fp").alias("n_blocked_fp"), F.col("blocked_tp").alias("n_blocked_tp"), F.col("ratio").alias("fp_tp_ratio"), "blocked_avg_return", "enabled", F.lit("").alias("notes"))
    sinks.write_rules(full, path)
    return rounded(read_rules(spark, path).drop("notes", "predicate", "py_expr"))


@query
def apply_rules(spark, sf_dir):
    d = rules.applied(with_results(spark, sf_dir), RULES)
    return d.where(signals.entry_signal(P) & ~F.col("blocked")).select("ticker", "bar_idx")


@query
def rule_registry(spark, sf_dir):
    n = keep(nb(spark, sf_dir), "notebook")
    return rounded(rules.updated_registry(rules.updated_registry(None, n.where("bar_idx < 300"), RULES), n.where("bar_idx >= 300"), RULES))


@query
def rule_removals(spark, sf_dir):
    n = keep(nb(spark, sf_dir), "notebook")
    return rules.removals(rules.updated_registry(rules.updated_registry(None, n.where("bar_idx < 300"), RULES), n.where("bar_idx >= 300"), RULES), max_silent=2)


@query
def propose_rules(spark, sf_dir):
    return rules.propose(nb(spark, sf_dir), min_ratio=0.5, purity=0.3)


# -- learning

#: Few shallow trees, for tests only.
FEW = {"trees": 5, "depth": 3}


def learning_panel(spark, sf_dir) -> DataFrame:
    return keep(panel.with_position(panel.dataset(with_results(spark, sf_dir))), "panel")


@query
def walkforward_oof(spark, sf_dir):
    return learning.walk_forward_scores(learning_panel(spark, sf_dir), unit="date")


@query
def rolling_oof(spark, sf_dir):
    return learning.rolling_scores(learning_panel(spark, sf_dir))


def final_model(spark, sf_dir):
    d = learning_panel(spark, sf_dir)
    cols = [c for c in panel.feature_columns(d) if c != "pos"]
    return learning.fit(d, cols), d


@query
def feature_importance(spark, sf_dir):
    model, _ = final_model(spark, sf_dir)
    return learning.feature_importance(model, spark)


@query
def model_attribution(spark, sf_dir):
    model, d = final_model(spark, sf_dir)
    return notebook.mean_attribution(learning.attributions(model, d))


@query
def model_topk(spark, sf_dir):
    """What pushed the final model's score up and down: the notebook's rows within the attribution budget, with the
    strongest Shapley values of each."""
    model, d = final_model(spark, sf_dir)
    n = keep(nb(spark, sf_dir).select(*notebook.KEYS, "mistake_type"), "notebook")  # read three times
    rows = keep(notebook.attribution_rows(n), "budget")
    return notebook.top_attributions(learning.attributions(model, d.join(rows, ["ticker", "bar_idx"])))


@query
def failure_clusters(spark, sf_dir):
    cols = ["rsi", "atr_pct", "macd_hist", "vol_z"]
    got = learning.cluster_failures(nb(spark, sf_dir).select(*notebook.KEYS, "mistake_type", "forward_return", *cols), cols)
    return notebook.cluster_summary(got)


# -- streaming


@query
def live_decisions(spark, sf_dir):
    """Streams the bars from a folder until they are used up, and reads what was decided. A last bar of no ticker, long
    after all others, lets the watermark pass them."""
    source, sink = new_path(spark, "bars"), new_path(spark, "decisions")
    b = fixtures.bars(spark, sf_dir).select("ticker", "bar_ts", "open", "high", "low", "close", "volume")
    b.repartition(4, "ticker").write.parquet(source)
    end = b.agg((F.max("bar_ts") + F.expr("interval 1 year")).alias("bar_ts"), *[F.lit(1.0).alias(c) for c in b.columns[2:]])
    end.select(F.lit("").alias("ticker"), *b.columns[1:]).write.mode("append").parquet(source)
    stream = spark.readStream.schema(b.schema).parquet(source)
    q = live.live_decisions(stream, P).writeStream.format("parquet").option("checkpointLocation", new_path(spark, "stream")).option("path", sink).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return rounded(spark.read.schema(live.DECISION).parquet(sink).withColumn("bar_date", F.to_date("bar_ts")), "ticker", "bar_date", "action", "price", "stop", "take", "confluence", "nearest_fib", "reason")


@query
def live_decisions_warm(spark, sf_dir):
    """The same stream from bar 300 of each ticker on, with the bars before as the state to begin with: counts of
    decisions by ticker and reason."""
    source, sink = new_path(spark, "bars"), new_path(spark, "decisions")
    every = fixtures.bars(spark, sf_dir)
    cols = ["ticker", "bar_ts", "open", "high", "low", "close", "volume"]
    b = every.where("bar_idx >= 300").select(*cols)
    b.repartition(4, "ticker").write.parquet(source)
    end = b.agg((F.max("bar_ts") + F.expr("interval 1 year")).alias("bar_ts"), *[F.lit(1.0).alias(c) for c in b.columns[2:]])
    end.select(F.lit("").alias("ticker"), *b.columns[1:]).write.mode("append").parquet(source)
    history = keep(every.where("bar_idx < 300").select(*cols), "history")
    stream = spark.readStream.schema(b.schema).parquet(source)
    q = live.live_decisions(stream, P, history=history).writeStream.format("parquet").option("checkpointLocation", new_path(spark, "stream")).option("path", sink).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(live.DECISION).parquet(sink).groupBy("ticker", "action", "reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 4).alias("prices"))
