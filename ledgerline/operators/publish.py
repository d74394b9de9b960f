"""Published snapshots: change suppression with a heartbeat, and what a subscriber saw."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def suppress(snapshots: DataFrame, key: str, order: str, time: str, state: list[str], heartbeat: int) -> DataFrame:
    """Snapshots that differ from the one sent last, or come a heartbeat after it; numbered in publish_seq.

    What was sent last depends on earlier decisions, so each key is folded in order, batch by batch. Only the first row of
    a run of equal states and rows a heartbeat apart can be sent: equal neighbours closer than that to the
    start of their run are dropped before, without Python.
    """
    same = F.struct(*state)
    w = Window.partitionBy(key).orderBy(order)
    fresh = ~F.lag(same).over(w).eqNullSafe(same) | F.lag(order).over(w).isNull()
    runs = snapshots.withColumn("_new", fresh).withColumn("_run", F.sum(F.col("_new").cast("int")).over(w))
    started = runs.withColumn("_started", F.min(time).over(Window.partitionBy(key, "_run")))
    likely = started.where(F.col("_new") | (F.col(time) - F.col("_started") >= heartbeat)).drop("_new", "_started")
    kinds = dict(snapshots.dtypes)
    names = snapshots.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent_run, sent_at, sent, last = None, None, 0, None
        for batch in batches:
            keep, numbers = [], []
            for run, at, place in zip(*(batch.column(c).to_pylist() for c in ("_run", time, order))):
                if last is not None and place < last:
                    raise ValueError("snapshots came out of order")
                last = place
                take = run != sent_run or at - sent_at >= heartbeat
                keep.append(take)
                if take:
                    sent_run, sent_at, sent = run, at, sent + 1
                    numbers.append(sent)
            taken = batch.select(names).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(numbers, pa.int64())], names=[*names, "publish_seq"])

    ordered = likely.repartition(key).sortWithinPartitions(key, order)
    return ordered.groupBy(key).applyInArrow(fold, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", publish_seq long")


def top_snapshots(changes: DataFrame, every: int, last: int, n: int) -> DataFrame:
    """``seq, locate, bids, asks``: the ``n`` best levels (price:shares:orders, best first) of each book with any at every ``every``-th message.

    Changes are summed by stretch and level first; a level's state holds until its next stretch with a change, so
    it is expanded over the marks between. Books are ranked by mark, so no task holds a whole book's history.
    """
    c = F.col
    mark = F.ceil(c("seq") / every).cast("long") * every
    moved = changes.groupBy("locate", "side", "price", mark.alias("mark")).agg(F.sum("d_orders").alias("o"), F.sum("d_shares").alias("s"))
    w = Window.partitionBy("locate", "side", "price").orderBy("mark")
    held = moved.select("locate", "side", "price", "mark", F.sum("o").over(w).alias("orders"), F.sum("s").over(w).alias("shares"), F.lead("mark").over(w).alias("until")).where("orders > 0")
    upto = F.least(F.coalesce(c("until") - every, F.lit(last)), F.lit(last))
    state = held.where(c("mark") <= upto).withColumn("seq", F.explode(F.sequence("mark", upto, F.lit(every).cast("long")))).where(c("seq") <= last)
    best = F.when(c("side") == "B", -c("price")).otherwise(c("price"))
    top = state.withColumn("rank", F.row_number().over(Window.partitionBy("seq", "locate", "side").orderBy(best))).where(c("rank") <= n)
    text = lambda side: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c("side") == side, F.struct("rank", F.concat_ws(":", "price", "shares", "orders").alias("t"))))), lambda x: x["t"]), ",")
    return top.groupBy("seq", "locate").agg(text("B").alias("bids"), text("S").alias("asks"))


def subscriber_summary(received: DataFrame, topic: str, number: str, latency: str) -> DataFrame:
    """By topic: received, missed between neighbours, mean, median and 99th latency (element floor(.99 n), at most the last)."""
    w = Window.partitionBy(topic)
    rows = received.withColumns({"gap": F.col(number) - F.lag(number).over(w.orderBy(number)) - 1, "place": F.row_number().over(w.orderBy(latency, number)) - 1, "n": F.count("*").over(w)})
    p99 = F.max(F.when(F.col("place") == F.least(F.col("n") - 1, F.floor(F.col("n") * 99 / 100)), F.col(latency)))
    return rows.groupBy(topic).agg(F.count("*").alias("received"), F.coalesce(F.sum(F.greatest("gap", F.lit(0))), F.lit(0)).alias("missed"), F.median(latency).alias("median"), p99.alias("p99"))


def majority(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """The most frequent value; ties go to the one named first in ``order``."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(value))
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    return counts.agg(F.max(F.struct("n", (-rank).alias("r"), F.col(value).alias("v"))).alias("x")).select(F.col("x.v").alias(value), F.col("x.n").alias("n"))
