"""Classification metrics from (label, proba) rows, by groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.scratch import keep


def binary_metrics(scored: DataFrame, by: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """n, accuracy, f1, roc_auc (ties count half), pr_auc (average precision), pos_rate per group.

    Rows are first counted by score. Running counts go by ranges of the score: sums of whole ranges above (a
    few thousand rows a group), plus a window inside the range, so no task sees all scores. One class: null areas."""
    keys = list(by)
    pred = (F.col("proba") >= threshold).cast("int")
    y = F.col("label").cast("int")
    s = scored.where("proba is not null and label is not null").groupBy(*keys, "proba").agg(
        F.sum(y).cast("long").alias("p"), F.sum(1 - y).cast("long").alias("q"), F.sum(y * pred).cast("long").alias("tp"), F.sum((1 - y) * pred).cast("long").alias("fp"),
    )
    s = keep(s.withColumn("range", F.floor(F.col("proba") * 4096)), "score-counts")  # used twice
    above = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    r = s.groupBy(*keys, "range").agg(F.sum("p").alias("rp"), F.sum("q").alias("rq"))
    r = r.select(*keys, "range", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("rp", "rq")])
    inside = Window.partitionBy(*keys, "range").orderBy(F.desc("proba")).rowsBetween(Window.unboundedPreceding, 0)
    s = s.join(r, [*keys, "range"]).withColumns({"cp": F.col("rp") + F.sum("p").over(inside), "cq": F.col("rq") + F.sum("q").over(inside)})
    s = s.withColumns({"area": F.col("q") * (F.col("cp") - F.col("p") / 2.0), "step": F.col("p") * F.col("cp") / (F.col("cp") + F.col("cq"))})
    g = (s.groupBy(*keys) if keys else s.groupBy()).agg(*[F.sum(c).alias(c) for c in ("p", "q", "tp", "fp", "area", "step")])
    both = (F.col("p") > 0) & (F.col("q") > 0)
    n = F.col("p") + F.col("q")
    return g.select(
        *keys, n.alias("n"), ((F.col("tp") + F.col("q") - F.col("fp")) / n).alias("accuracy"), F.coalesce(2.0 * F.col("tp") / F.nullif(F.col("tp") + F.col("fp") + F.col("p"), F.lit(0)), F.lit(0.0)).alias("f1"),
        F.when(both, F.col("area") / F.col("p") / F.col("q")).alias("roc_auc"), F.when(both, F.col("step") / F.col("p")).alias("pr_auc"), (F.col("p") / n).alias("pos_rate"),
    )


def oof_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The metrics over all scored rows, with the number of folds and rows."""
    scored = keep(scored.select("fold", "label", "proba"), "scores")
    folds = scored.where("proba is not null").agg(F.countDistinct("fold").alias("folds"))
    return binary_metrics(scored, (), threshold).withColumnRenamed("n", "n_oof").join(F.broadcast(folds), F.lit(True))  # one row each
