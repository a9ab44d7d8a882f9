"""Reading price bars, alternative data and saved stages.

One long table: ticker, bar_ts, open, high, low, close, volume. NaN becomes null at the door, since
Spark takes NaN as greater than every number. Order is never implicit: `bar_idx` numbers a ticker's bars.
"""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.csv import ConvertOptions, ReadOptions, read_csv
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close", "volume")
RULE_SCHEMA = "name string, predicate string, py_expr string, n_blocked_fp long, n_blocked_tp long, fp_tp_ratio double, blocked_avg_return double, enabled boolean, notes string"


def require(df: DataFrame, columns: list[str] | set[str], job: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns for {job}: {missing}")


def normalise(df: DataFrame, ticker: str | None = None, date: str = "date") -> DataFrame:
    """Prices by case-insensitive names as doubles, the date as bar_ts, rows without a ticker dropped."""
    by_lower = {c.lower(): c for c in df.columns}
    missing = [c for c in PRICES if c not in by_lower]
    if missing:
        raise ValueError(f"missing columns for bars: {missing}")
    col = lambda c: F.col(f"`{by_lower[c]}`")
    number = lambda c: F.when(~F.isnan(col(c).cast("double")), col(c).cast("double")).alias(c)
    ts = col(date.lower()).cast("timestamp") if date.lower() in by_lower else F.lit(None).cast("timestamp")
    keys = []
    if ticker is not None:
        if ticker.lower() not in by_lower:
            raise ValueError(f"missing column for bars: {ticker}")
        keys = [col(ticker.lower()).cast("string").alias("ticker")]
    out = df.select(*keys, ts.alias("bar_ts"), *map(number, PRICES))
    return out.where("ticker is not null") if keys else out


def read_csv_bars(spark: SparkSession, path: str, ticker: str = "ALL") -> DataFrame:
    """One CSV file with a header: one ticker's bars."""
    return normalise(spark.read.csv(path, header=True)).select(F.lit(ticker).alias("ticker"), "*")


#: Files up to this size are one row each; larger ones are split by Spark's CSV reader.
WHOLE_FILE = 64 << 20


def read_bar_folder(spark: SparkSession, folder: str, max_tickers: int | None = None) -> DataFrame:
    """One CSV file per ticker; the ticker is the file's name. Files without the price columns are left out.

    Files are read whole, many to a task, each with its own header, in one pass; only large files are looked at for
    their headers first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    names = files.select("path", "length", F.regexp_replace(F.url_decode(F.element_at(F.split("path", "/"), -1)), r"\.csv$", "").alias("ticker"), "content")
    if max_tickers:
        first = [r.path for r in names.select("path", "ticker").orderBy("ticker").limit(max_tickers).collect()]
        names = names.where(F.col("path").isin(first))
    large = [r.path for r in names.where(F.col("length") > WHOLE_FILE).select("path").collect()]
    schema = "ticker string, date string, " + ", ".join(f"{c} string" for c in PRICES)
    rows = names.where(F.col("length") <= WHOLE_FILE).select("ticker", "content").mapInArrow(_parsed, schema)
    out = normalise(rows, "ticker")
    return out.unionByName(_large_files(spark, large)) if large else out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bars of whole files, as text. A header names the columns in any order and case."""
    for b in batches:
        for ticker, content in zip(b.column("ticker"), b.column("content"), strict=True):
            text = content.as_py()
            head = next(csv.reader([text.split(b"\n", 1)[0].decode("utf-8-sig", "replace").strip()]), [])
            named = {c.strip().lower(): i for i, c in reversed(list(enumerate(head)))}
            if not set(PRICES) <= set(named) or not text.partition(b"\n")[2].strip():
                continue
            names = [str(i) for i in range(len(head))]
            t = read_csv(pa.BufferReader(text), read_options=ReadOptions(column_names=names, skip_rows=1), convert_options=ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=True, null_values=[""]))
            none = pa.nulls(len(t), pa.string())
            column = lambda c: t[names[named[c]]].combine_chunks() if c in named else none  # noqa: E731, B023
            yield from pa.table([pa.array([ticker.as_py()] * len(t), pa.string()), *[column(c) for c in ("date", *PRICES)]], names=["ticker", "date", *PRICES]).to_batches()


def _large_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A CSV scan maps columns by position, so files are read in groups of equal headers."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    groups: dict[str, list[str]] = defaultdict(list)
    for path in paths:
        head = lines.where((F.col("path") == path) & (F.col("at") == 0)).first()  # stops after a few lines
        groups[head.value if head else ""].append(path)
    stem = F.regexp_replace(F.url_decode(F.element_at(F.split(F.input_file_name(), "/"), -1)), r"\.csv$", "").alias("ticker")
    out = normalise(spark.createDataFrame([], "ticker string, date string, " + ", ".join(f"{c} string" for c in PRICES)), "ticker")
    for header, some in groups.items():
        if set(PRICES) <= {c.strip().strip('"').lower() for c in header.split(",")}:
            raw = spark.read.csv(some, header=True).withColumn("ticker_", stem)
            out = out.unionByName(normalise(raw.drop("ticker", "Ticker").withColumnRenamed("ticker_", "ticker"), "ticker"))
    return out


def read_long_bars(spark: SparkSession, path: str, ticker: str = "ticker") -> DataFrame:
    """One long file (CSV or Parquet) with a ticker column."""
    raw = spark.read.csv(path, header=True) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    return normalise(raw, ticker)


def read_altdata(spark: SparkSession, path: str, ticker: str | None = None, long: bool = True, date_col: str = "Date", ticker_col: str = "Ticker") -> DataFrame:
    """Alternative data as exported: (Date, Ticker, metric, value) or wide. Adds `seq`, the order of rows."""
    raw = spark.read.csv(path, header=True)
    require(raw, {date_col, *(("metric", "value") if long else ())}, "alternative data")
    raw = raw.withColumn(date_col, F.to_date(date_col)).withColumn("seq", F.monotonically_increasing_id())
    if ticker is not None and ticker_col in raw.columns:
        raw = raw.where(F.col(ticker_col) == ticker)
    return raw.withColumn("value", F.col("value").cast("double")) if long else raw


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """A saved stage (out-of-sample scores, a notebook): Parquet or CSV with a header."""
    return spark.read.csv(path, header=True, inferSchema=True) if ".csv" in path else spark.read.parquet(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RULE_SCHEMA).json(path, multiLine=True)


def with_bar_index(bars: DataFrame, order: str = "bar_ts", *ties: str) -> DataFrame:
    """Adds bar_idx, 0-based in each ticker."""
    return bars.withColumn("bar_idx", F.row_number().over(Window.partitionBy("ticker").orderBy(order, *ties)).cast("long") - 1)
