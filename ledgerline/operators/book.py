"""Order-book state as relational operators over effects and level changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.u64 import level_move, unsigned, wrapped_hex
from ledgerline.operators.prefix import running

LEVEL = ["locate", "side", "price"]


def levels(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Non-empty price levels (of each group in ``by``): orders, shares."""
    keys = [*(by or []), *LEVEL]
    return changes.groupBy(*keys).agg(F.sum("d_orders").alias("orders"), F.sum("d_shares").alias("shares")).where("orders > 0")


def best_first() -> Column:
    """Ascending in this, bids come down and asks go up."""
    return F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price"))


def top_of_book(state: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Best bid and ask, their sizes, depths and the spread (null unless both sides are there), one row a locate.

    Plain aggregates: the best level is the extreme of a struct that begins with the price.
    """
    row, bid, ask = F.struct("price", "shares"), F.col("side") == "B", F.col("side") == "S"
    found = state.groupBy(*(by or []), "locate").agg(F.max(F.when(bid, row)).alias("b"), F.min(F.when(ask, row)).alias("a"), F.count_if(bid).alias("bid_levels"), F.count_if(ask).alias("ask_levels"))
    return found.select(*(by or []), "locate", F.col("b.shares").alias("bid_shares"), F.col("b.price").alias("bid_price"), F.col("a.price").alias("ask_price"), F.col("a.shares").alias("ask_shares"), "bid_levels", "ask_levels", (F.col("a.price") - F.col("b.price")).alias("spread"))


def top_levels(state: DataFrame, n: int) -> DataFrame:
    """The n best levels of each side with their rank."""
    return state.withColumn("rank", F.row_number().over(Window.partitionBy("locate", "side").orderBy(best_first()))).where(F.col("rank") <= n)


def depth(state: DataFrame) -> DataFrame:
    return state.groupBy("locate", "side").agg(F.count("*").alias("depth"), F.sum("orders").alias("orders"), F.sum("shares").alias("shares"))


def counters(fx: DataFrame) -> DataFrame:
    """One row; unknown references count as actions too. Duplicates can't occur in feeds this plan is for."""
    n = lambda cond, name: F.count_if(F.expr(cond)).alias(name)
    return fx.agg(
        n("type IN ('A', 'F')", "adds"), n("type IN ('E', 'C')", "executes"), n("type = 'X'", "cancels"), n("type = 'D'", "deletes"), n("type = 'U'", "replaces"), n("outcome = 'unknown'", "unknown_ref"), n("outcome = 'overfill'", "overfill"),
        (F.count_if(F.expr("outcome = 'add'")) - F.count_if(F.expr("outcome IN ('removed', 'overfill')"))).alias("live_orders"),
    )


def live_timeline(fx: DataFrame) -> DataFrame:
    """Orders alive after every message that changes their number: seq, change, live."""
    change = F.when(F.col("outcome") == "add", 1).when(F.col("outcome").isin("removed", "overfill"), -1)
    moves = fx.withColumn("change", change).where("change IS NOT NULL").select("seq", "change")
    return running(moves, [], ["seq"], {"live": ("sum", F.col("change"))})


def live_orders(fx: DataFrame) -> DataFrame:
    """The orders alive at the end, each where its last effective message left it."""
    last = fx.where("outcome <> 'unknown'").groupBy("root").agg(F.max(F.struct("seq", "locate", "side", "price", "open_after", "arrival", "generation", "outcome")).alias("x")).select("root", "x.*").where("open_after > 0")
    return last.select("root", "locate", "side", "price", F.col("open_after").alias("shares"), "arrival", (F.col("generation") + (F.col("outcome") == "replaced").cast("int")).alias("generation"))


def queue_positions(live: DataFrame) -> DataFrame:
    """Adds idx and shares_ahead within the level's queue."""
    out = running(live, LEVEL, ["arrival"], {"n": ("sum", F.lit(1)), "upto": ("sum", F.col("shares"))})
    return out.withColumns({"idx": F.col("n") - 1, "shares_ahead": F.col("upto") - F.col("shares")}).drop("n", "upto")


def order_walk(live: DataFrame) -> DataFrame:
    """Every order's place in the walk over locates, bids then asks, prices upwards, queues.

    Only level totals are accumulated across the whole book.
    """
    queued = queue_positions(live)
    totals = live.groupBy(*LEVEL).agg(F.count("*").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    books = totals.groupBy("locate").agg(F.sum("n").alias("n")).select("locate", before(Window.orderBy("locate")).alias("book"))  # a row a book
    starts = totals.select(*LEVEL, before(Window.partitionBy("locate").orderBy("side", "price")).alias("level")).join(F.broadcast(books), "locate")
    return queued.join(starts.select(*LEVEL, (F.col("book") + F.col("level")).alias("start")), LEVEL).withColumn("place", F.col("start") + F.col("idx")).drop("start")


def levels_after_each(changes: DataFrame) -> DataFrame:
    """The state of the level that a change touched, after it."""
    return running(changes, LEVEL, ["seq", "sub"], {"orders": ("sum", F.col("d_orders")), "shares": ("sum", F.col("d_shares"))}).drop("root", "d_orders", "d_shares")


def as_of(changes: DataFrame, boundaries: dict[str, int]) -> DataFrame:
    """Changes before each boundary (a seq), labelled; boundaries are few and known."""
    at = F.array(*(F.struct(F.lit(label).alias("as_of"), F.lit(seq).cast("long").alias("boundary")) for label, seq in boundaries.items()))
    return changes.select("*", F.inline(F.filter(at, lambda b: b["boundary"] > F.col("seq")))).drop("boundary")


def book_hashes(changes: DataFrame, every: int) -> DataFrame:
    """The order-independent book hash at every ``every``-th message, and at the end (checkpoint 0).

    A change moves the hash by (new level hash - old level hash); moves are summed by stretch, then
    accumulated over the stretches.
    """
    after = running(changes, LEVEL, ["seq", "sub"], {"orders": ("sum", F.col("d_orders")), "shares": ("sum", F.col("d_shares"))})
    move = unsigned(level_move("locate", "side", "price", "shares", "orders", "d_shares", "d_orders"))
    stretch = F.ceil(F.col("seq") / every).cast("long")
    sums = after.groupBy(stretch.alias("stretch")).agg(F.sum(move).alias("move"))
    return running(sums, [], ["stretch"], {"upto": ("sum", F.col("move"))}).select((F.col("stretch") * every).alias("book_msgs"), wrapped_hex(F.col("upto")).alias("book_hash"))


def differences(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows by key in which two states differ, or that only one of them has."""
    left, right = a.select(*keys, F.struct(*values).alias("a")), b.select(*keys, F.struct(*values).alias("b"))
    return left.join(right, keys, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def invariants(live: DataFrame, state: DataFrame) -> DataFrame:
    """Counts of what must not be: check, violations."""
    rebuilt = live.groupBy(*LEVEL).agg(F.count("*").alias("orders"), F.sum("shares").alias("shares"))
    one = lambda df, name: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
    return (
        one(differences(rebuilt, state, LEVEL, ["orders", "shares"]), "levels_match_orders")
        .unionByName(one(live.where("shares <= 0"), "order_without_shares"))
        .unionByName(one(state.where("orders <= 0 OR shares <= 0"), "empty_level_kept"))
    )
