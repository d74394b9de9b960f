"""Histograms with 32 buckets a power of two, percentiles that never under-report, and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUB_BITS, MAX_EXP = 5, 48
SUB = 1 << SUB_BITS
BUCKETS = SUB * (MAX_EXP - SUB_BITS + 2)


def bucket(v: Column) -> Column:
    """Bucket number of a value that isn't negative."""
    msb = F.length(F.bin(v)) - 1
    shift = msb - SUB_BITS
    scaled = F.call_function("shiftright", v, shift).bitwiseAND(SUB - 1)
    return F.when(v < SUB, v).when(msb > MAX_EXP, BUCKETS - 1).otherwise((shift + 1) * SUB + scaled).cast("long")


def lower_bound(i: Column) -> Column:
    return F.when(i < SUB, i).otherwise(F.call_function("shiftleft", (i % SUB + SUB).cast("long"), (F.floor(i / SUB) - 1).cast("int")))


def upper_bound(i: Column) -> Column:
    """Exclusive."""
    width = F.call_function("shiftleft", F.lit(1).cast("long"), (F.floor(i / SUB) - 1).cast("int"))
    return F.when(i < SUB, i + 1).otherwise(lower_bound(i) + width)


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Non-empty buckets: count, and the exact largest value and sum in each (so that histograms merge)."""
    return df.groupBy(*keys, bucket(F.col(value)).alias("bucket")).agg(F.count("*").alias("count"), F.max(value).alias("top"), F.sum(value).alias("total"))


def percentiles(hist: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """The upper end of the bucket that holds rank floor(q (n - 1)) + 1, but no more than the largest value."""
    whole, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bucket")
    df = hist.withColumns({"n": F.sum("count").over(whole), "top_all": F.max("top").over(whole), "seen": F.sum("count").over(upto)})
    df = df.withColumn("q", F.explode(F.array(*map(F.lit, qs)))).where(F.col("seen") >= F.floor(F.col("q") * (F.col("n") - 1)) + 1)
    first = df.groupBy(*keys, "q").agg(F.min("bucket").alias("bucket"), F.first("top_all").alias("top_all"))
    return first.select(*keys, F.round(F.col("q") * 1000000).cast("long").alias("q_millionths"), F.least(upper_bound(F.col("bucket")) - 1, F.col("top_all")).alias("value"))


def cumulative(hist: DataFrame, keys: list[str]) -> DataFrame:
    return hist.select(*keys, "bucket", F.sum("count").over(Window.partitionBy(*keys).orderBy("bucket")).alias("cum_count"), F.sum("count").over(Window.partitionBy(*keys)).alias("all_count"))


def median_run(runs: DataFrame, label: list[str], key: str, tie: str) -> DataFrame:
    """The upper-middle run of each label by key."""
    w = Window.partitionBy(*label)
    ranked = runs.withColumns({"rank": F.row_number().over(w.orderBy(key, tie)), "runs": F.count("*").over(w)})
    return ranked.where(F.col("rank") == F.floor(F.col("runs") / 2) + 1)


def spread(runs: DataFrame, label: list[str], value: str) -> DataFrame:
    """Median (mean of the middle two), least, largest, and (largest - least) / median in millionths."""
    out = runs.groupBy(*label).agg(F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("largest"))
    return out.withColumn("rel_millionths", F.round((F.col("largest") - F.col("least")) / F.col("median") * 1000000).cast("long"))
