"""Redundant packet lines in batch: first copy wins, gaps, contiguous prefix, re-requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.prefix import running


def first_copies(packets: DataFrame) -> DataFrame:
    """The copy of each packet that came first; equal arrivals go to the lower line."""
    return packets.groupBy("packet").agg(F.min(F.struct("arrival", "line")).alias("f"), F.max("messages").alias("messages"), F.count("*").alias("copies")).select("packet", "messages", "copies", "f.arrival", "f.line")


def line_statistics(packets: DataFrame) -> DataFrame:
    """By line: packets received, first copies, messages delivered by them."""
    first = first_copies(packets).select("packet", F.col("arrival").alias("first_arrival"), F.col("line").alias("first_line"))
    both = packets.join(first, "packet")
    won = (F.col("arrival") == F.col("first_arrival")) & (F.col("line") == F.col("first_line"))
    return both.groupBy("line").agg(F.count("*").alias("received"), F.count_if(won).alias("first_copies"), F.sum(F.when(won, F.col("messages")).otherwise(0)).alias("delivered"))


def missing(packets: DataFrame, sent: DataFrame, line: int) -> DataFrame:
    """Packets that a line never brought."""
    return sent.join(packets.where(F.col("line") == line), "packet", "left_anti").select(F.lit(line).alias("line"), "packet")


def islands(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers as [from, to). Starts and ends are found by equi-joins on the neighbour, then
    matched by rank among themselves, so only run ends are ever sorted."""
    rows = df.select(*keys, F.col(number).alias("n"))
    starts = rows.join(rows.select(*keys, (F.col("n") + 1).alias("n")), [*keys, "n"], "left_anti")
    ends = rows.join(rows.select(*keys, (F.col("n") - 1).alias("n")), [*keys, "n"], "left_anti")
    ranked = lambda df: running(df.select(*keys, "n"), keys, ["n"], {"_r": ("sum", F.lit(1))})
    a = ranked(starts).select(*keys, F.col("n").alias("from"), "_r")
    b = ranked(ends).select(*keys, (F.col("n") + 1).alias("to"), "_r")
    return a.join(b, [*keys, "_r"]).drop("_r")


def prefix_delivery(packets: DataFrame) -> DataFrame:
    """When each packet could be handed on in order: the running maximum of first arrivals."""
    return running(first_copies(packets), [], ["packet"], {"delivered_at": ("max", F.col("arrival"))}).withColumn("waited", F.col("delivered_at") - F.col("arrival"))


def chunks(ranges: DataFrame, size: int) -> DataFrame:
    """[from, to) cut into requests of at most ``size``."""
    df = ranges.withColumn("start", F.explode(F.sequence(F.col("from"), F.col("to") - 1, F.lit(size).cast("long"))))
    return df.withColumn("count", F.least(F.lit(size).cast("long"), F.col("to") - F.col("start")))


def admission(requests: DataFrame, retention: int, max_count: int) -> DataFrame:
    """What a retransmit server does with a request, rules in order, and how many messages it grants."""
    c = F.col
    refused = (
        F.when((c("count") == 0) | (c("count") == 65535), "bad")
        .when((c("seq") == 0) | (c("seq") >= c("next_seq")), "unpublished")
        .when(c("next_seq") - c("seq") > retention, "retention")
    )
    granted = F.least(F.least(c("count"), F.lit(max_count)), c("next_seq") - c("seq"))
    outcome = F.coalesce(refused, F.when(c("count") > max_count, "trimmed").otherwise("served"))
    return requests.withColumns({"outcome": outcome, "granted": F.when(refused.isNull(), granted).otherwise(0)})
