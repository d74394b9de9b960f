"""The recovery side: rate-limited retransmit servers, request rounds with backoff, snapshots."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.traffic import admission


def rate_limit(requests: DataFrame, burst: float, per_second: float) -> DataFrame:
    """Adds ``allowed``: a token bucket of each client, in order of arrival (nanoseconds). Bad requests take no token."""
    kinds = dict(requests.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("arrival", kind="stable")
        tokens, last, allowed = burst, None, []
        for at, bad in zip(pdf["arrival"], (pdf["count"] == 0) | (pdf["count"] == 65535)):
            if bad:
                allowed.append(True)
                continue
            tokens = min(burst, tokens + (0 if last is None else (at - last) * 1e-9 * per_second))
            last = at
            allowed.append(tokens >= 1)
            tokens -= tokens >= 1
        return pdf.assign(allowed=allowed)

    return requests.groupBy("client").applyInPandas(fold, ", ".join(f"`{c}` {kinds[c]}" for c in requests.columns) + ", allowed boolean")


def serve(requests: DataFrame, burst: float, per_second: float, retention: int, max_count: int) -> DataFrame:
    """Outcome and grant of every request, rate limit included, in the order the server checks."""
    judged = admission(rate_limit(requests, burst, per_second), retention, max_count)
    limited = ~F.col("allowed") & (F.col("outcome") != "bad")
    return judged.withColumns({"outcome": F.when(limited, "rate_limited").otherwise(F.col("outcome")), "granted": F.when(limited, 0).otherwise(F.col("granted"))}).drop("allowed")


def server_counters(served: DataFrame) -> DataFrame:
    return served.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("granted").alias("granted"))


def plan_recovery(gaps: DataFrame, threshold: int, retries: int, first_wait_ns: int, most_wait_ns: int = 1_000_000_000) -> DataFrame:
    """How a gap [from, to) is closed: re-requests in rounds, each waiting twice as long, or a snapshot.

    ``down_rounds`` is for how many rounds nothing answers. Adds cause, rounds and waited_ns.
    """
    n = F.col("to") - F.col("from")
    tried = F.least(F.col("down_rounds"), F.lit(retries))
    waits = F.transform(F.sequence(F.lit(0), F.lit(max(0, retries))), lambda k: F.least(F.lit(most_wait_ns), F.call_function("shiftleft", F.lit(first_wait_ns).cast("long"), k)))
    waited = F.aggregate(F.slice(waits, F.lit(1), tried.cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)
    snapshot = (n > threshold) | (F.col("down_rounds") >= retries)
    return gaps.withColumns({"cause": F.when(snapshot, "snapshot").otherwise("rerequest"), "rounds": F.when(n > threshold, 0).otherwise(F.when(snapshot, retries).otherwise(tried + 1)).cast("int"), "waited_ns": F.when(n > threshold, 0).otherwise(waited)})


def snapshot_orders(live: DataFrame, at: int) -> DataFrame:
    """The orders of a snapshot as adds just before ``at``, in the order a load must keep: locate, bids, price, queue."""
    return live.select(F.lit(at).cast("long").alias("seq"), F.lit("A").alias("type"), "root", "locate", "side", "price", "shares", "arrival").orderBy("locate", F.col("side"), "price", "arrival")
