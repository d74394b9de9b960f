"""Reports: long and wide CSV tables, JSON objects, console and Markdown tables, loss logs, log scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import show
from ledgerline.operators.latency import lower_bound, upper_bound


def csv_options(writer):
    return writer.option("header", True).option("quote", '"').option("escape", '"').mode("overwrite")


def histogram_table(hist: DataFrame, ns_per_tick: float = 1.0) -> DataFrame:
    """run, label, median, metric, bucket bounds in ns, count; non-empty buckets only."""
    b = F.col("bucket")
    return hist.where("count > 0").select("run", "label", F.col("median").cast("int").alias("median"), "metric", (lower_bound(b) * ns_per_tick).alias("bucket_lo_ns"), (upper_bound(b) * ns_per_tick).alias("bucket_hi_ns"), "count")


def write_histogram(hist: DataFrame, path: str) -> None:
    csv_options(histogram_table(hist).write).csv(path)


def run_table(runs: DataFrame, counts: DataFrame, types: list[str]) -> DataFrame:
    """One wide row a run: its own columns, a count a type, and the count of other types."""
    pivot = counts.groupBy("run").pivot("type", types).agg(F.sum("n"))
    named = pivot.select("run", *(F.coalesce(F.col(t), F.lit(0)).alias(f"count_{t}") for t in types))
    known = sum((F.col(f"count_{t}") for t in types), F.lit(0))
    return runs.join(named, "run").withColumn("count_other", F.col("messages") - known)


def one_json(row: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """A summary row as one JSON object, with an array of runs if given."""
    if runs is None:
        return row.select(F.to_json(F.struct(*row.columns)).alias("value"))
    listed = runs.agg(F.sort_array(F.collect_list(F.struct(*runs.columns))).alias("runs"))
    return row.join(F.broadcast(listed), how="cross").select(F.to_json(F.struct(*row.columns, "runs")).alias("value"))  # one row each


def top_of_book_lines(top: DataFrame) -> DataFrame:
    """The console table of best prices."""
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return top.orderBy("symbol").select(F.format_string("%-10s %12s %14s %14s %12s %6d %6d", "symbol", dash(F.col("bid_shares")), dash(show.price(F.col("bid_price"))), dash(show.price(F.col("ask_price"))), dash(F.col("ask_shares")), "bid_levels", "ask_levels").alias("value"))


def message_mix_lines(mix: DataFrame) -> DataFrame:
    return mix.orderBy(F.desc("n"), F.desc("type")).select(F.format_string("%s %12d %7.3f%%", "type", "n", F.col("share_millionths") / 10000).alias("value"))


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(most).collect()
    lines = [df.columns, ["-"] * len(df.columns), *([("" if x is None else str(x)) for x in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def write_loss_log(log: DataFrame, path: str) -> None:
    log.select("packet", "seq", "count", "line", "action").orderBy("packet", "line").coalesce(1).write.mode("overwrite").option("sep", " ").csv(path)


def read_run_tables(spark: SparkSession, pattern: str) -> DataFrame:
    """Many CSV tables of runs as one, with the folder each came from."""
    return spark.read.csv(pattern, header=True, inferSchema=True, quote='"', escape='"').withColumn("cell", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def read_reports(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.json(pattern)


def scan_log(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The number that a pattern's first group finds in each matching line."""
    return spark.read.text(path).select(F.regexp_extract("value", pattern, 1).alias("x")).where("x <> ''").select(F.regexp_replace("x", ",", "").cast("double").alias("number"))


def decades(hist: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Buckets dealt anew to ``bins`` equal steps of log10 a decade, by their lower bounds."""
    low = F.greatest(lower_bound(F.col("bucket")), F.lit(1))
    return hist.groupBy(*keys, F.floor(F.log10(low.cast("double")) * bins + 1e-9).alias("bin")).agg(F.sum("count").alias("count"))


def nines(cdf: DataFrame) -> DataFrame:
    """-log10 of what is above, cut off at seven nines."""
    return cdf.withColumn("nines", -F.log10(F.greatest(1 - F.col("cum_count") / F.col("all_count"), F.lit(1e-7))))
