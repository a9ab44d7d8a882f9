"""Blocking rules: proposed from a shallow tree, scored on the notebook, applied, tracked, retired.

A rule is a row (name, predicate, py_expr, ...); its expression is Spark SQL over feature columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.scratch import forget, keep

NUMERIC = ("rsi", "atr_pct", "macd_hist", "vol_z", "confluence_count", "retracement_depth", "nearest_fib_dist")
BINARY = ("trend_up", "regime_ok", "fib_near")


#: Words of a rule's expression that are no columns.
WORDS = {"and", "or", "not", "is", "null", "in", "between", "like", "true", "false", "case", "when", "then", "else", "end"}


def usable(df: DataFrame, expr: str) -> bool:
    """Whether the expression names only columns that are there, and is a condition."""
    names = re.findall(r"[A-Za-z_]\w*(?!\w|\s*\()", re.sub(r"'[^']*'|\d\w*(?:\.\d\w*)?", "", expr))
    if {n.lower() for n in names} - WORDS - {c.lower() for c in df.columns}:
        return False
    try:
        return dict(df.select(F.expr(expr).alias("x")).dtypes)["x"] == "boolean"
    except AnalysisException:  # not a well-formed expression
        return False


def applied(df: DataFrame, rules: list[dict], only_enabled: bool = True, out: str = "blocked") -> DataFrame:
    """Adds `out`: whether any rule holds. Nulls count as false; rules that cannot be evaluated are left out.
    All rules are one expression, so one scan."""
    active = [r["py_expr"] for r in rules if (not only_enabled or r.get("enabled")) and usable(df, r["py_expr"])]
    return df.withColumn(out, F.coalesce(F.expr(" or ".join(f"coalesce(({e}), false)" for e in active)), F.lit(False)) if active else F.lit(False))


def score(nb: DataFrame, rules: list[dict]) -> DataFrame:
    """name, blocked_fp, blocked_tp, n_blocked, purity, ratio, blocked_avg_return: one pass for all rules."""
    rules = [r for r in rules if usable(nb, r["py_expr"])]
    hits = F.filter(F.array(*[F.when(F.expr(r["py_expr"]), F.lit(r["name"])) for r in rules]), lambda x: x.isNotNull())
    d = nb.select("mistake_type", "forward_return", F.explode(hits).alias("name"))
    d = d.groupBy("name").agg(F.count_if(F.col("mistake_type") == "FP").alias("blocked_fp"), F.count_if(F.col("mistake_type") == "TP").alias("blocked_tp"), F.count(F.lit(1)).alias("n_blocked"), F.avg("forward_return").alias("blocked_avg_return"))
    every = nb.sparkSession.createDataFrame([(r["name"],) for r in rules], "name string").join(d, "name", "left").na.fill(0, ["blocked_fp", "blocked_tp", "n_blocked"])
    fp, tp = F.col("blocked_fp"), F.col("blocked_tp")
    return every.withColumns({"purity": fp / F.greatest(F.lit(1), fp + tp), "ratio": fp / F.greatest(F.lit(1), tp)})


def worthwhile(scored: DataFrame, min_fp: int = 5, min_ratio: float = 2.0, purity: float = 0.7) -> DataFrame:
    return scored.where((F.col("blocked_fp") >= min_fp) & (F.col("purity") >= purity) & (F.col("ratio") >= min_ratio)).orderBy(F.desc("ratio"), F.desc("blocked_fp"), "name")


#: Ranges of a feature's values; only ranges that may hold the best split are looked at value by value.
RANGES = 256


def range_ends(rows: DataFrame, cols: list[str]) -> list[np.ndarray]:
    """Upper ends of each feature's ranges but the last, near its quantiles. Any ends give the same splits."""
    at = [k / RANGES for k in range(1, RANGES)]
    edges = rows.agg(*[F.percentile_approx(c, at, 10_000).alias(f"e{k}") for k, c in enumerate(cols)]).first()
    return [np.unique(np.array(e or [], np.float64)) for e in edges]


def _cells(ends: list[np.ndarray], b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(f, values, cell of each row) for each feature of a batch (node, y, features); a cell is node * RANGES + range."""
    node = b.column(0).to_numpy().astype(np.int64)
    for f, e in enumerate(ends):
        v = b.column(f + 2).to_numpy()
        yield f, v, node * RANGES + np.searchsorted(e, v, side="left")


def _range_sums(ends: list[np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, f, range, a, n, low, high of a batch's rows."""
    for b in batches:
        y = b.column(1).to_numpy()
        for f, v, cell in _cells(ends, b):
            order = np.lexsort((v, cell))
            at, first, n = np.unique(cell[order], return_index=True, return_counts=True)
            if len(at):
                a, v = np.add.reduceat(y[order], first), v[order]
                yield pa.record_batch([pa.array((at // RANGES).astype(np.int32)), pa.array(np.full(len(at), f, np.int32)), pa.array((at % RANGES).astype(np.int32)), pa.array(a), pa.array(n), pa.array(v[first]), pa.array(v[first + n - 1])], names=["node", "f", "range", "a", "n", "low", "high"])


def _range_values(ends: list[np.ndarray], wanted: list[np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, f, range, v, y of rows whose cell is wanted (a sorted array for each feature)."""
    for b in batches:
        y = b.column(1).to_numpy()
        for f, v, cell in _cells(ends, b):
            i = np.flatnonzero(np.isin(cell, wanted[f]))
            if len(i):
                yield pa.record_batch([pa.array((cell[i] // RANGES).astype(np.int32)), pa.array(np.full(len(i), f, np.int32)), pa.array((cell[i] % RANGES).astype(np.int32)), pa.array(v[i]), pa.array(y[i])], names=["node", "f", "range", "v", "y"])


def _pure(a, n, weights: tuple[float, float]):
    """Sum of squared class weights over their sum; the more, the purer."""
    one, zero = weights
    return ((a * one) * (a * one) + ((n - a) * zero) * ((n - a) * zero)) / (a * one + (n - a) * zero)


def _gain(la, ln, ta, tn, weights: tuple[float, float]):
    return _pure(la, ln, weights) + _pure(ta - la, tn - ln, weights) - _pure(ta, tn, weights)


def _open_ranges(sums: list, weights: tuple[float, float], least: int) -> tuple[list[tuple], list[tuple]]:
    """Splits between ranges (node, f, v, next, la, ln, ta, tn), and the ranges (node, f, range, rows of class 1 and rows
    before, ta, tn) inside of which a split may gain as much: the gain is convex in the class counts on the left, so
    inside a range it is at most that of a corner, where either class has passed none or all of the range's rows."""
    lines: dict[tuple[int, int], list] = {}
    for r in sorted(sums, key=lambda r: (r.node, r.f, r.range)):
        lines.setdefault((r.node, r.f), []).append(r)
    some = lambda a, n, ta, tn: float(_gain(a, n, ta, tn, weights)) if 0 < n < tn else 0.0
    between, inside, best = [], [], {}
    for (node, f), line in lines.items():
        ta, tn, la, ln = sum(r.a for r in line), sum(r.n for r in line), 0, 0
        for r, after in zip(line, [*line[1:], None], strict=True):
            if r.low < r.high:
                corners = [(la + a, ln + a + z) for a in (0, r.a) for z in (0, r.n - r.a)]
                inside.append((max(some(a, n, ta, tn) for a, n in corners), (node, f, r.range, la, ln, ta, tn)))
            la, ln = la + r.a, ln + r.n
            if after is not None and ln >= least and tn - ln >= least:
                between.append((node, f, r.high, after.low, la, ln, ta, tn))
                best[node] = max(best.get(node, 0.0), some(la, ln, ta, tn))
    slack = lambda node: 1e-6 + 1e-9 * best.get(node, 0.0)  # gains are compared after rounding
    return between, [x for bound, x in inside if bound >= best.get(x[0], 0.0) - slack(x[0])]


def best_splits(rows: DataFrame, cols: list[str], weights: tuple[float, float], least: int, ends: list[np.ndarray] | None = None) -> dict[int, tuple[str, float]]:
    """The best split (feature, threshold) of each node, over every threshold between two different values.

    rows: node, y (0 or 1), features without nulls. Class counts are summed over ranges of values first; they rule out
    most ranges, and only the rest are summed by value, with running sums inside a range. Gain is that of Gini impurity
    with classes weighed; a side has at least `least` rows; equal gains go by the order of features, then the smaller
    threshold."""
    spark, ends = rows.sparkSession, ends if ends is not None else range_ends(rows, cols)
    d = rows.select(F.col("node").cast("int").alias("node"), F.col("y").cast("long").alias("y"), *cols)
    sums = d.mapInArrow(partial(_range_sums, ends), "node int, f int, range int, a long, n long, low double, high double")
    sums = sums.groupBy("node", "f", "range").agg(F.sum("a").alias("a"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()  # a few hundred rows a node and feature
    between, inside = _open_ranges(sums, weights, least)
    at = spark.createDataFrame(between, "node int, f int, v double, next double, la long, ln long, ta long, tn long")
    if inside:
        wanted = [np.array(sorted(x[0] * RANGES + x[2] for x in inside if x[1] == f), np.int64) for f in range(len(cols))]
        v = d.mapInArrow(partial(_range_values, ends, wanted), "node int, f int, range int, v double, y long").groupBy("node", "f", "range", "v").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
        run = Window.partitionBy("node", "f", "range").orderBy("v")
        upto = run.rowsBetween(Window.unboundedPreceding, 0)
        v = v.withColumns({"sa": F.sum("a").over(upto), "sn": F.sum("n").over(upto), "next": F.lead("v").over(run)}).where("next is not null")
        r = spark.createDataFrame(inside, "node int, f int, range int, ba long, bn long, ta long, tn long")
        at = at.unionByName(v.join(F.broadcast(r), ["node", "f", "range"]).select("node", "f", "v", "next", (F.col("ba") + F.col("sa")).alias("la"), (F.col("bn") + F.col("sn")).alias("ln"), "ta", "tn"))
    c = F.col
    at = at.where(f"ln >= {least} and tn - ln >= {least}")
    gain = F.round(_gain(c("la"), c("ln"), c("ta"), c("tn"), weights), 9)
    at = at.select("node", F.struct(gain.alias("gain"), (-c("f")).alias("f"), (-c("v")).alias("v"), ((c("v") + c("next")) / 2).alias("at")).alias("best"))
    found = at.groupBy("node").agg(F.max("best").alias("best")).where("best.gain > 0").collect()  # a row a node
    return {x.node: (cols[-x.best.f], x.best.at) for x in found}


def tree_paths(rows: DataFrame, cols: list[str], weights: tuple[float, float], least: int, max_depth: int) -> list[list[tuple[str, str, float]]]:
    """Root-to-leaf paths (feature, <= or >, threshold), left to right, of a tree over rows (y, features)."""
    splits: dict[int, tuple[str, float]] = {}
    ends = range_ends(rows, cols)
    rows = rows.withColumn("node", F.lit(0))
    for _ in range(max_depth):
        found = best_splits(rows, cols, weights, least, ends)
        if not found:
            break
        splits |= found
        to = F.lit(None).cast("int")  # rows of leaves go
        for node, (f, at) in found.items():
            to = F.when(F.col("node") == node, F.when(F.col(f) <= at, 2 * node + 1).otherwise(2 * node + 2)).otherwise(to)
        rows = rows.withColumn("node", to).where("node is not null")

    def below(node: int, path: list) -> list:
        if node not in splits:
            return [path]
        f, at = splits[node]
        return below(2 * node + 1, [*path, (f, "<=", at)]) + below(2 * node + 2, [*path, (f, ">", at)])

    return below(0, [])


def condition(feature: str, op: str, threshold: float) -> str:
    if feature in BINARY:
        return f"{feature} == {int(op == '>')}"  # a split of zeros and ones: zeros go left
    return f"{feature} {op} {round(threshold, 4)}"


def propose(nb: DataFrame, features: list[str] | None = None, max_depth: int = 2, min_fp: int = 5, min_ratio: float = 2.0, purity: float = 0.7) -> DataFrame:
    """Candidate rules, none enabled: leaves of a balanced tree of FP against TP that block enough false
    positives at little cost, scored on the whole notebook."""
    spark = nb.sparkSession
    cols = features or [c for c in (*NUMERIC, *BINARY) if c in nb.columns]
    schema = "name string, predicate string, py_expr string, n_blocked_fp long, n_blocked_tp long, fp_tp_ratio double, blocked_avg_return double, enabled boolean, notes string"
    nb = keep(nb.select("mistake_type", "forward_return", *[c for c in dict.fromkeys(cols) if c != "forward_return"]), "notebook")  # read three times
    counts = {r.mistake_type: r.n for r in nb.groupBy("mistake_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    fp, tp = counts.get("FP", 0), counts.get("TP", 0)
    if fp < min_fp or tp < 5 or not cols:
        return spark.createDataFrame([], schema)
    d = nb.where("mistake_type in ('FP', 'TP')").select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols], (F.col("mistake_type") == "FP").cast("long").alias("y"))
    d = keep(d, "rule-rows")
    rules, weights = [], ((fp + tp) / (2 * fp), (fp + tp) / (2 * tp))
    paths = tree_paths(d, cols, weights, max(5, min_fp), max_depth)
    forget(d)
    for i, path in enumerate(paths):
        if path:
            parts = [condition(*x) for x in path]
            rules.append({"name": f"rule_{i:02d}", "predicate": " AND ".join(parts), "py_expr": " and ".join(f"({x})" for x in parts)})
    if not rules:
        return spark.createDataFrame([], schema)
    text = spark.createDataFrame([(r["name"], r["predicate"], r["py_expr"]) for r in rules], "name string, predicate string, py_expr string")
    good = worthwhile(score(nb, rules), min_fp, min_ratio, purity).join(text, "name")
    return good.select("name", "predicate", "py_expr", F.col("blocked_fp").alias("n_blocked_fp"), F.col("blocked_tp").alias("n_blocked_tp"), F.round("ratio", 3).alias("fp_tp_ratio"), F.round("blocked_avg_return", 5).alias("blocked_avg_return"), F.lit(False).alias("enabled"), F.lit("").alias("notes")).orderBy(F.desc("fp_tp_ratio"), F.desc("n_blocked_fp"), "name")


REGISTRY = "name string, cumulative_blocked_fp long, cumulative_blocked_tp long, last_seen_ratio double, epochs_active long, epochs_silent long"


def updated_registry(registry: DataFrame | None, nb: DataFrame, rules: list[dict]) -> DataFrame:
    """The registry after one more epoch: enabled rules add what they block; one that blocks nothing, or cannot be
    evaluated, was silent (the latter keeps its last ratio)."""
    enabled = [r for r in rules if r.get("enabled")]
    spark = nb.sparkSession
    old = registry if registry is not None else spark.createDataFrame([], REGISTRY)
    if not enabled:
        return old
    names = spark.createDataFrame([(r["name"], True) for r in enabled], "name string, now boolean")
    s = score(nb, enabled).select("name", "blocked_fp", "blocked_tp", F.col("ratio").alias("new_ratio"))
    d = old.join(names, "name", "full").join(s, "name", "left")
    now = F.coalesce("now", F.lit(False)).cast("long")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return d.select("name", (zero("cumulative_blocked_fp") + zero("blocked_fp")).alias("cumulative_blocked_fp"), (zero("cumulative_blocked_tp") + zero("blocked_tp")).alias("cumulative_blocked_tp"), F.coalesce("new_ratio", "last_seen_ratio").alias("last_seen_ratio"), (zero("epochs_active") + now).alias("epochs_active"), (zero("epochs_silent") + F.when(zero("blocked_fp") + zero("blocked_tp") == 0, now).otherwise(0)).alias("epochs_silent"))


def removals(registry: DataFrame, min_ratio: float = 1.5, max_silent: int = 3) -> DataFrame:
    """Rules that never fired for too long, or whose ratio is too low, or that have gone silent."""
    fp, tp, silent = F.col("cumulative_blocked_fp"), F.col("cumulative_blocked_tp"), F.col("epochs_silent") >= max_silent
    return registry.where(F.when((fp == 0) & (tp == 0), silent).otherwise((fp / F.greatest(F.lit(1), tp) < min_ratio) | silent)).select("name")
