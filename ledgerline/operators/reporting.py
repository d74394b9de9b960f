"""Tables over many runs: cells of equal settings, clean runs, ranges, display order, samples, summaries of histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_histogram(runs: DataFrame, histograms: DataFrame, cell: list[str]) -> DataFrame:
    """Each run with the buckets of its cell's median run: an equi-join on the cell."""
    return runs.join(histograms, cell)


def clean_medians(runs: DataFrame, cell: list[str], value: str, passed: str, clean: str) -> DataFrame:
    """By cell: the median over its clean runs, how many they are, and whether all runs passed."""
    return runs.groupBy(*cell).agg(F.median(F.when(F.col(clean), F.col(value))).alias("median"), F.count_if(F.col(clean)).alias("clean_runs"), F.bool_and(passed).alias("all_passed"))


def ranges(runs: DataFrame, cell: list[str], values: list[str]) -> DataFrame:
    """Least and largest of each value by cell."""
    return runs.groupBy(*cell).agg(*(f(v).alias(f"{name}_{v}") for v in values for f, name in ((F.min, "least"), (F.max, "largest"))))


def most_runs(runs: DataFrame, cell: list[str]) -> DataFrame:
    """How many runs the largest cell has, and how many cells there are."""
    return runs.groupBy(*cell).agg(F.count("*").alias("n")).agg(F.max("n").alias("most_runs"), F.count("*").alias("cells"))


def select_cell(rows: DataFrame, **settings) -> DataFrame:
    """The rows of one cell: every named setting equal, a null only to a null."""
    for name, value in settings.items():
        rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
    return rows


def display_rank(column: Column, order: list[str]) -> Column:
    """Place in a fixed display order; what isn't named comes last."""
    at = F.array_position(F.array(*map(F.lit, order)), column)
    return F.when(at > 0, at).otherwise(len(order) + 1).cast("long")


def even_sample(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows, evenly spread over the order, the first among them: those numbered floor(i n / most)."""
    total = rows.count()
    if total <= most:
        return rows
    from ledgerline.operators.prefix import numbered

    at = F.col("_n") - 1
    # Row k is taken if some i has floor(i * total / most) = k.
    i = F.ceil(at * most / F.lit(float(total)))
    return numbered(rows, order, "_n").where((F.floor(i.cast("decimal(30,0)") * total / most) == at) & (i < most)).drop("_n")


def histogram_summary(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Count, exact mean, smallest possible and exact largest value of mergeable histograms (bucket, count, top, total)."""
    from ledgerline.operators.latency import lower_bound

    return hist.groupBy(*keys).agg(F.sum("count").alias("n"), (F.sum("total") / F.sum("count")).alias("mean"), F.min(lower_bound(F.col("bucket"))).alias("least"), F.max("top").alias("largest"))


def guarded_mean(total: Column, n: Column) -> Column:
    """0 without samples."""
    return F.when(n > 0, total / n).otherwise(0.0)


def ns_per_tick(ticks: Column, ns: Column) -> Column:
    return ns / ticks


def to_ticks(ns: Column, per_tick: float) -> Column:
    return F.floor(ns / per_tick).cast("long")


def to_ns(ticks: Column, per_tick: float) -> Column:
    return ticks * per_tick


def capacity(n: Column) -> Column:
    """1M, 64K, 100: whole binary multiples by their letter."""
    return F.when((n >= 1 << 20) & (n % (1 << 20) == 0), F.concat((n / (1 << 20)).cast("long").cast("string"), F.lit("M"))).when((n >= 1024) & (n % 1024 == 0), F.concat((n / 1024).cast("long").cast("string"), F.lit("K"))).otherwise(n.cast("string"))


def short_ns(ns: Column) -> Column:
    """Whole nanoseconds below a microsecond, else three digits and a unit."""
    digits = lambda x: F.when(x < 10, F.format_string("%.2f", x)).when(x < 100, F.format_string("%.1f", x)).otherwise(F.format_string("%.0f", x))
    return F.when(ns < 1_000, F.concat(ns.cast("long").cast("string"), F.lit(" ns"))).when(ns < 1_000_000, F.concat(digits(ns / 1e3), F.lit(" us"))).when(ns < 1_000_000_000, F.concat(digits(ns / 1e6), F.lit(" ms"))).otherwise(F.concat(digits(ns / 1e9), F.lit(" s")))


def verdict(checks: DataFrame, name: str, passed: str) -> DataFrame:
    """Whether all named checks passed, how many did not, and the first of those by name."""
    return checks.agg(F.bool_and(passed).alias("passed"), F.count_if(~F.col(passed)).alias("failed"), F.min(F.when(~F.col(passed), F.col(name))).alias("first_failed"))


def peaks(rows: DataFrame, keys: list[str], order: list[str], change: Column) -> DataFrame:
    """The largest running sum of changes by key."""
    from ledgerline.operators.prefix import running

    return running(rows, keys, order, {"_now": ("sum", change)}).groupBy(*keys).agg(F.max("_now").alias("peak"))

