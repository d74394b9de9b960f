"""What each message does to the order it addresses, by windows over the order's own messages.

Valid for feeds in which a reference is added once and every modify names its order's root (see
``operators.fold`` for feeds that break this). An order's life is cut into segments at its replaces; the
open shares before a message are the segment's opening shares less the reductions so far, if every earlier
segment still had shares when it was replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.plans.adapter import MESSAGES_SQL, messages
from ledgerline.plans.stage import staged

_ALL = 1 << 40


def effects(msgs: DataFrame) -> DataFrame:
    """One row a message: seq, ts_us, type, root, generation, locate, side, price, shares, open_before,
    open_after, outcome, old_price, arrival (the seq that put the order where it now is in its queue)."""
    root = Window.partitionBy("root")
    before = root.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    c = F.col
    add = c("type").isin("A", "F")
    first = F.when(add, c("seq"))
    df = msgs.withColumns({"add_seq": F.min(first).over(root), "own_side": F.max(F.when(add, c("side"))).over(root), "own_locate": F.max(F.when(add, c("locate"))).over(root)})
    df = df.withColumn("early", ~add & (c("add_seq").isNull() | (c("seq") < c("add_seq"))))
    replace = (c("type") == "U") & ~c("early")
    opens = add | replace
    last = lambda x: F.last(F.when(opens, x), ignorenulls=True).over(before)
    df = df.withColumns({"generation": F.count(F.when(replace, 1)).over(before).cast("int"), "seg_shares": last(c("shares")), "seg_price": last(c("price")), "seg_seq": last(c("seq"))})
    reduction = F.when(c("early"), 0).when(c("type").isin("E", "C", "X"), c("shares")).when(c("type") == "D", _ALL).otherwise(0).cast("long")
    within = Window.partitionBy("root", "generation").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("seg_open", F.greatest(c("seg_shares") - F.coalesce(F.sum(reduction).over(within), F.lit(0)), F.lit(0)))
    alive = F.coalesce(F.min(F.when(replace, (c("seg_open") > 0).cast("int"))).over(before), F.lit(1))
    df = df.withColumn("open_before", F.when(add | c("early"), 0).otherwise(alive * c("seg_open")).cast("long"))
    opened = c("open_before")
    outcome = F.when(add, "add").when(opened == 0, "unknown").when(c("type") == "U", "replaced").when((c("type") == "D") | (c("shares") == opened), "removed").when(c("shares") > opened, "overfill").otherwise("partial")
    df = df.withColumn("outcome", outcome)
    rests = c("outcome").isin("add", "replaced")
    return df.select(
        "seq", "ts_us", "type", "root", "generation", c("own_locate").alias("locate"), c("own_side").alias("side"), F.when(rests, c("price")).otherwise(c("seg_price")).alias("price"), "shares", "open_before",
        F.when(rests, c("shares")).when(c("outcome") == "partial", opened - c("shares")).otherwise(0).cast("long").alias("open_after"), "outcome", c("seg_price").alias("old_price"), F.when(rests, c("seq")).otherwise(c("seg_seq")).alias("arrival"),
    )


def deltas(fx: DataFrame) -> DataFrame:
    """Changes of price levels: seq, sub, root, locate, side, price, d_orders, d_shares (a replace makes two)."""
    c = F.col
    change = lambda sub, price, orders, shares: F.struct(F.lit(sub).alias("sub"), price.cast("long").alias("price"), F.lit(orders).alias("d_orders"), shares.cast("long").alias("d_shares"))
    gone = change(0, c("old_price"), -1, -c("open_before"))
    parts = (
        F.when(c("outcome") == "add", F.array(change(0, c("price"), 1, c("shares"))))
        .when(c("outcome") == "partial", F.array(change(0, c("old_price"), 0, -c("shares"))))
        .when(c("outcome") == "replaced", F.array(gone, change(1, c("price"), 1, c("shares"))))
        .otherwise(F.array(gone))
    )
    return fx.where("outcome <> 'unknown'").select("seq", "root", "locate", "side", F.inline(parts))


def staged_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, f"effects:{sf_dir}", lambda: effects(messages(spark, sf_dir)))


EFFECTS_SQL = f"""{MESSAGES_SQL}, e1 AS (
  SELECT *, min(CASE WHEN type = 'A' THEN seq END) OVER (PARTITION BY root) AS add_seq, max(side) OVER (PARTITION BY root) AS own_side, max(locate) OVER (PARTITION BY root) AS own_locate FROM msg
), e2 AS (SELECT *, type <> 'A' AND (add_seq IS NULL OR seq < add_seq) AS early FROM e1
), e3 AS (
  SELECT *, count(CASE WHEN type = 'U' AND NOT early THEN 1 END) OVER b AS generation, last_value(CASE WHEN type = 'A' OR type = 'U' AND NOT early THEN shares END IGNORE NULLS) OVER b AS seg_shares,
    last_value(CASE WHEN type = 'A' OR type = 'U' AND NOT early THEN price END IGNORE NULLS) OVER b AS seg_price, last_value(CASE WHEN type = 'A' OR type = 'U' AND NOT early THEN seq END IGNORE NULLS) OVER b AS seg_seq
  FROM e2 WINDOW b AS (PARTITION BY root ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), e4 AS (
  SELECT *, greatest(seg_shares - coalesce(sum(CASE WHEN early THEN 0 WHEN type IN ('E', 'C', 'X') THEN shares WHEN type = 'D' THEN {_ALL} ELSE 0 END)
    OVER (PARTITION BY root, generation ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS seg_open FROM e3
), e5 AS (
  SELECT *, CASE WHEN type = 'A' OR early THEN 0 ELSE seg_open * coalesce(min(CASE WHEN type = 'U' AND NOT early THEN (seg_open > 0)::INT END)
    OVER (PARTITION BY root ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) END AS ob FROM e4
), e6 AS (
  SELECT *, CASE WHEN type = 'A' THEN 'add' WHEN ob = 0 THEN 'unknown' WHEN type = 'U' THEN 'replaced' WHEN type = 'D' OR shares = ob THEN 'removed' WHEN shares > ob THEN 'overfill' ELSE 'partial' END AS outcome FROM e5
), fx AS (
  SELECT seq, ts_us, type, root, generation, own_locate AS locate, own_side AS side, CASE WHEN outcome IN ('add', 'replaced') THEN price ELSE seg_price END AS price, shares, ob::BIGINT AS open_before,
    (CASE WHEN outcome IN ('add', 'replaced') THEN shares WHEN outcome = 'partial' THEN ob - shares ELSE 0 END)::BIGINT AS open_after, outcome, seg_price AS old_price,
    CASE WHEN outcome IN ('add', 'replaced') THEN seq ELSE seg_seq END AS arrival FROM e6
), delta AS (
  SELECT seq, 0 AS sub, root, locate, side, price, 1 AS d_orders, shares AS d_shares FROM fx WHERE outcome = 'add'
  UNION ALL SELECT seq, 0, root, locate, side, old_price, 0, -shares FROM fx WHERE outcome = 'partial'
  UNION ALL SELECT seq, 0, root, locate, side, old_price, -1, -open_before FROM fx WHERE outcome IN ('removed', 'overfill', 'replaced')
  UNION ALL SELECT seq, 1, root, locate, side, price, 1, shares FROM fx WHERE outcome = 'replaced'
)"""
