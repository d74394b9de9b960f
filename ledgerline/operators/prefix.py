"""Running aggregates that no single task has to hold.

A window over a whole feed, or over one busy price level, runs in one task. Here rows are cut into chunks
of consecutive order values; chunk totals (few rows) are accumulated first, and each chunk then runs on
its own, starting from what came before it.
"""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16
#: The first numbers of ranges by the table they were written to.
_starts: dict[str, list[tuple[int, int]]] = {}


def running(df: DataFrame, keys: list[str], order: list[str], aggregates: dict[str, tuple[str, Column]], chunk: int = CHUNK) -> DataFrame:
    """Adds columns ``name: (sum | max, value)`` accumulated within ``keys`` in the order of ``order``,
    whose first column must be a whole number. Rows with equal order values are taken in any order."""
    cut = df.withColumn("_chunk", F.floor(F.col(order[0]) / chunk)).withColumns({f"_v_{n}": v for n, (_, v) in aggregates.items()})
    fold = {"sum": F.sum, "max": F.max}
    totals = cut.groupBy(*keys, "_chunk").agg(*(fold[kind](f"_v_{n}").alias(f"_t_{n}") for n, (kind, _) in aggregates.items()))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_chunk", *(fold[kind](f"_t_{n}").over(earlier).alias(f"_b_{n}") for n, (kind, _) in aggregates.items()))
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({f"_l_{n}": fold[kind](f"_v_{n}").over(within) for n, (kind, _) in aggregates.items()})
    joined = local.join(totals, [*keys, "_chunk"])
    out = {n: F.coalesce(F.col(f"_b_{n}"), F.lit(0)) + F.col(f"_l_{n}") if kind == "sum" else F.greatest(f"_b_{n}", f"_l_{n}") for n, (kind, _) in aggregates.items()}
    return joined.select(*df.columns, *(c.alias(n) for n, c in out.items()))


def numbered(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """Adds 1, 2, ... in a unique order. Ranges are sorted apart and written once; every range's first number, a row a
    range, is joined to its rows when they are read."""
    from ledgerline.plans.stage import shared_dir

    return number_ranges(df.sparkSession, write_ranges(df, order, f"{shared_dir(df.sparkSession)}/numbered-{uuid.uuid4().hex}"), name)


def write_ranges(df: DataFrame, order: list[str], path: str) -> str:
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    return path


def number_ranges(spark: SparkSession, path: str, name: str = "seq") -> DataFrame:
    """The table that ``numbered`` wrote, with its numbers."""
    rows = spark.read.parquet(path).withColumn("_range", F.shiftright("_id", 33))
    if path not in _starts:
        sizes = sorted(tuple(r) for r in rows.groupBy("_range").agg(F.count("*")).collect())  # a row a range
        _starts[path] = [(k, total - n) for (k, n), total in zip(sizes, accumulate(n for _, n in sizes))]
    starts = spark.createDataFrame(_starts[path], "_range long, _before long")
    return rows.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_id", "_range", "_before")
