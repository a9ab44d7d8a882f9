"""What sets one kind of mistake apart: effect sizes and tests over features, in one aggregation pass.

Counts, means and deviations come from Spark; p-values of the few dozen results are computed on the
driver from series and continued fractions for the incomplete beta and gamma functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.permutation import cohens_d
from barloom.operators.rules import BINARY, NUMERIC
from barloom.operators.signals import FLAGS
from barloom.scratch import keep

#: What rules are mined from, the flags that confluence counts, and the nearest level.
FEATURES = tuple(dict.fromkeys((*NUMERIC, *BINARY, *FLAGS, "nearest_fib_level")))


def feature_kinds(nb: DataFrame, cols: list[str]) -> dict[str, str]:
    """binary (numbers, all 0 or 1), numeric or categorical."""
    numeric = [c for c in cols if isinstance(nb.schema[c].dataType, T.NumericType)]
    row = nb.agg(*[F.coalesce(F.bool_and(F.col(c).isin(0, 1)), F.lit(True)).alias(c) for c in numeric]).first() if numeric else {}
    return {c: ("binary" if row[c] else "numeric") if c in numeric else "categorical" for c in cols}


def grouped(nb: DataFrame, failure: str = "FP", reference: tuple[str, ...] = ("TP", "TN")) -> DataFrame:
    """Rows of the two groups, with grp 1 (failure) or 2 (reference)."""
    return nb.withColumn("grp", F.when(F.col("mistake_type") == failure, 1).when(F.col("mistake_type").isin(*reference), 2)).where("grp is not null")


def number_stats(g: DataFrame, cols: list[str]) -> DataFrame:
    """feature, n1, mean1, sd1, k1, n2, mean2, sd2, k2, cohens_d, delta: columns stacked long, aggregated once."""
    long = g.select("grp", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])).alias("f")).select("grp", "f.*")
    pick = lambda i: F.when(F.col("grp") == i, F.col("x"))
    d = long.where("x is not null").groupBy("feature").agg(*[f(pick(i)).alias(f"{n}{i}") for i in (1, 2) for n, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp), ("k", F.sum))])
    c = F.col
    return d.withColumns({"cohens_d": cohens_d(c("n1"), c("mean1"), c("sd1"), c("n2"), c("mean2"), c("sd2")), "delta": c("mean1") - c("mean2")})


def category_stats(g: DataFrame, cols: list[str]) -> DataFrame:
    """feature, n1, n2, chi2, dof, cramers_v, mode1, share1, mode2, share2."""
    long = g.select("grp", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in cols])).alias("f")).select("grp", "f.*")
    t = long.where("v is not null").groupBy("feature", "v").agg(F.count_if(F.col("grp") == 1).alias("a"), F.count_if(F.col("grp") == 2).alias("b"))
    w = Window.partitionBy("feature")
    t = t.withColumns({"all1": F.sum("a").over(w), "all2": F.sum("b").over(w), "r": F.count(F.lit(1)).over(w)})
    c = F.col
    expected = lambda side: (c("a") + c("b")) * c(side) / (c("all1") + c("all2"))
    part = F.when(c("all1") > 0, F.pow(c("a") - expected("all1"), 2) / expected("all1")).otherwise(0.0) + F.when(c("all2") > 0, F.pow(c("b") - expected("all2"), 2) / expected("all2")).otherwise(0.0)
    t = t.withColumn("part", part)
    s = t.groupBy("feature", "all1", "all2", "r").agg(F.sum("part").alias("chi2"), F.max_by("v", F.struct(c("a"), c("v"))).alias("mode1"), F.max("a").alias("max1"), F.max_by("v", F.struct(c("b"), c("v"))).alias("mode2"), F.max("b").alias("max2"))
    v = F.when((c("r") > 1) & (c("all1") > 0) & (c("all2") > 0), F.sqrt(c("chi2") / (c("all1") + c("all2"))))
    return s.select("feature", c("all1").alias("n1"), c("all2").alias("n2"), "chi2", (c("r") - 1).alias("dof"), v.alias("cramers_v"), "mode1", (c("max1") / F.nullif(c("all1"), F.lit(0))).alias("share1"), "mode2", (c("max2") / F.nullif(c("all2"), F.lit(0))).alias("share2"))


def holm(p: DataFrame) -> DataFrame:
    """Adds p_value_corrected to rows with p_value (few rows)."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    by_p = Window.orderBy("p_value", "feature")
    d = p.withColumn("adj", F.least(F.lit(1.0), (n - F.row_number().over(by_p) + 1) * F.col("p_value")))
    return d.withColumn("p_value_corrected", F.max("adj").over(by_p.rowsBetween(Window.unboundedPreceding, 0))).drop("adj")


# -- p-values of a few results


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_p(t: float, dof: float) -> float:
    """Two-sided."""
    return beta_inc(dof / 2, 0.5, dof / (dof + t * t))


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_p(x: float, dof: int) -> float:
    """Upper tail: series for small x, else continued fraction of the incomplete gamma function."""
    a, x = dof / 2, x / 2
    if x <= 0 or dof <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b)
        c = b + num / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def welch_p(n1: int, m1: float, s1: float, n2: int, m2: float, s2: float) -> float:
    if n1 < 2 or n2 < 2:
        return 1.0
    v1, v2 = s1 * s1 / n1, s2 * s2 / n2
    if v1 + v2 == 0:
        return math.nan
    return student_p((m1 - m2) / math.sqrt(v1 + v2), (v1 + v2) ** 2 / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1)))


def proportion_p(k1: float, n1: int, k2: float, n2: int) -> float:
    pool = (k1 + k2) / (n1 + n2)
    se = math.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))
    return normal_p((k1 / n1 - k2 / n2) / se) if se else 1.0


SUMMARY = "feature string, kind string, effect_size double, effect_label string, direction string, p_value double, failure string, reference string"


def insights(nb: DataFrame, failure: str = "FP", reference: tuple[str, ...] = ("TP", "TN"), features: tuple[str, ...] = FEATURES, correct: bool = True) -> DataFrame:
    """One row per feature that can be tested, with corrected p-values; largest effect first. Empty if a group is."""
    spark, cols = nb.sparkSession, [c for c in features if c in nb.columns]
    nb = keep(nb.select("mistake_type", *cols), "notebook")  # read three times
    g, kinds = grouped(nb, failure, reference), feature_kinds(nb, cols)
    numbers = [c for c in cols if kinds[c] != "categorical"]
    texts = [c for c in cols if kinds[c] == "categorical"]
    rows = []
    turn = lambda e: f"↑ in {failure}" if e > 0 else f"↓ in {failure}" if e < 0 else "no shift"
    for r in number_stats(g, numbers).collect() if numbers else []:  # a row per feature
        if kinds[r.feature] == "numeric":
            if r.cohens_d is None:
                continue
            say = lambda m, s, n: f"{m:.4g} ± {s or 0:.4g} (n={n})"
            rows.append((r.feature, "numeric", r.cohens_d, "Cohen's d", turn(r.cohens_d), welch_p(r.n1, r.mean1, r.sd1, r.n2, r.mean2, r.sd2), say(r.mean1, r.sd1, r.n1), say(r.mean2, r.sd2, r.n2)))
        elif r.n1 and r.n2:
            say = lambda m, k, n: f"{m:.1%} (k={int(k)}/{n})"
            rows.append((r.feature, "binary", r.delta, "Δ proportion", turn(r.delta), proportion_p(r.k1, r.n1, r.k2, r.n2), say(r.mean1, r.k1, r.n1), say(r.mean2, r.k2, r.n2)))
    for r in category_stats(g, texts).collect() if texts else []:  # a row per feature
        if r.cramers_v is not None:
            rows.append((r.feature, "categorical", r.cramers_v, "Cramer's V", "shift", chi2_p(r.chi2, r.dof), f"mode={r.mode1} ({r.share1:.0%})", f"mode={r.mode2} ({r.share2:.0%})"))
    out = spark.createDataFrame(rows, SUMMARY)
    out = holm(out) if correct else out.withColumn("p_value_corrected", F.col("p_value"))
    return out.orderBy(F.desc(F.abs("effect_size")), "feature")


def report(summary: DataFrame, failure: str, n_failure: int, n_reference: int, alpha: float = 0.05, top_k: int = 10) -> str:
    """Text of the significant results (a few rows)."""
    if not n_failure or not n_reference:
        return f"insufficient data: |{failure}|={n_failure}, |ref|={n_reference}"
    rows = summary.collect()
    if not rows:
        return "no testable features"
    good = [r for r in rows if r.p_value_corrected <= alpha]
    lines = [f"{failure}: {n_failure} cases against {n_reference}. {len(rows)} features tested, {len(good)} significant at {alpha}."]
    for title, mark in ((f"elevated in {failure}", "↑"), (f"depressed in {failure}", "↓"), ("distribution shift", "shift")):
        part = [r for r in good[:top_k] if r.direction.startswith(mark)]
        lines += [f"[{title}]"] * bool(part) + [f"  {r.feature}: {r.failure} vs {r.reference} ({r.effect_label}={r.effect_size:+.3f}, p={r.p_value_corrected:.3g})" for r in part]
    return "\n".join(lines if good else [*lines, "(nothing stands out after correction)"])
