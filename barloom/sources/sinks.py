"""Writing results. Small results may go to one file; panels are partitioned by date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_bar_folder(df: DataFrame, path: str, ticker: str = "ticker") -> None:
    """One CSV file with a header for each ticker, named by it. Each ticker is written by one task; files are then renamed."""
    spark = df.sparkSession
    work = f"{path}/_work"
    df.withColumn("part_", F.col(ticker)).drop(ticker).repartition("part_").write.mode("overwrite").option("header", True).partitionBy("part_").csv(work)
    paths, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    fs = paths(work).getFileSystem(conf)
    for folder in fs.listStatus(paths(work)):
        name = folder.getPath().getName()
        if folder.isDirectory() and name.startswith("part_="):
            for f in fs.listStatus(folder.getPath()):
                if f.getPath().getName().endswith(".csv"):
                    fs.rename(f.getPath(), paths(f"{path}/{name.removeprefix('part_=')}.csv"))
    fs.delete(paths(work), True)


def write_panel(panel: DataFrame, path: str, floats: bool = True, date: str = "bar_ts") -> None:
    """Parquet by month; doubles as floats, which halves them. A month's rows spread over tasks by ticker."""
    if floats:
        panel = panel.select(*[F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in panel.dtypes])
    month = F.date_format(date, "yyyy-MM")
    panel.withColumn("month", month).repartition("month", "ticker").sortWithinPartitions("month", date, "ticker").write.mode("overwrite").partitionBy("month").parquet(path)


def write_scores(scores: DataFrame, path: str, csv: bool = False) -> None:
    """Out-of-sample scores with date and ticker."""
    write_csv(scores, path) if csv else scores.write.mode("overwrite").parquet(path)


def write_rules(rules: DataFrame, path: str) -> None:
    """A JSON list, as it is read by read_rules. Rules are few."""
    one = rules.agg(F.to_json(F.collect_list(F.struct(*rules.columns))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)
