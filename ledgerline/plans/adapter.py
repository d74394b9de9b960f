"""An order-event stream derived from ``orders`` (adds) and ``lineitem`` (modifies), and line traffic from ``events``.

Messages: seq, ts_us, type, root, locate, side, price, shares. A modify addresses the current reference of
its order; it carries no side or locate of its own, as on the wire.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.prefix import number_ranges, write_ranges
from ledgerline.plans.stage import shared_dir, staged_list

TYPES = ("A", "E", "C", "X", "D", "U")


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970, whatever the session's time zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")
    return F.unix_micros(column)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered stream; seq follows (ts, adds first, root, line, part, supplier)."""

    def make() -> list[str]:
        orders, lines = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        key, null = F.col("o_orderkey"), F.lit(None)
        adds = orders.select(
            micros(orders, "o_orderdate").alias("ts_us"), F.lit(0).alias("modify"), key.alias("root"), F.lit(0).alias("line"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("supp"), F.lit("A").alias("type"),
            (F.col("o_custkey") % 25 + 1).cast("int").alias("locate"), F.when(key % 2 == 0, "B").otherwise("S").alias("side"), (F.col("o_custkey") % 40 * 100 + 1000000).alias("price"), (key % 3 * 100 + 100).alias("shares"),
        )
        n = F.col("l_linenumber")
        kind = F.when(n <= 2, "E").when(n == 3, "C").when(n <= 5, "X").when(n == 6, "U").otherwise("D")
        changes = lines.select(
            micros(lines, "l_shipdate").alias("ts_us"), F.lit(1).alias("modify"), F.col("l_orderkey").alias("root"), n.alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), kind.alias("type"),
            null.cast("int").alias("locate"), null.cast("string").alias("side"), (F.col("l_partkey") % 40 * 100 + 1000000).alias("price"), (F.col("l_quantity") * 3).cast("long").alias("shares"),
        )
        path = f"{shared_dir(spark)}/messages-{uuid.uuid4().hex}"
        return [write_ranges(adds.unionByName(changes), ["ts_us", "modify", "root", "line", "part", "supp"], path)]

    (path,) = staged_list(spark, f"messages:{sf_dir}", make)
    return number_ranges(spark, path).select("seq", "ts_us", "type", "root", "locate", "side", "price", "shares")


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locate, symbol."""
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") + 1).cast("int").alias("locate"), F.col("n_name").alias("symbol"))


PACKET = 10


def line_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of ten events on two lines: packet, line, arrival. Losses, one-step delays and repeats follow
    from the packet's number; what both lines lost comes again on line 2, much later."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    packets = events.groupBy(F.floor(F.col("event_id") / PACKET).alias("packet")).agg(F.count("*").alias("messages"))
    p = F.col("packet")
    lost = [(p * 7919 + 3) % 11 == 0, (p * 104729 + 5) % 7 == 0]
    copies = F.array(
        F.when(~lost[0], F.struct(F.lit(0).alias("line"), (p * 10 + p * 31 % 17).alias("arrival"))),
        F.when(~lost[0] & (p % 13 == 0), F.struct(F.lit(0).alias("line"), (p * 10 + 55).alias("arrival"))),
        F.when(~lost[1], F.struct(F.lit(1).alias("line"), (p * 10 + 3 + p * 17 % 23).alias("arrival"))),
        F.when(lost[0] & lost[1], F.struct(F.lit(2).alias("line"), (p * 10 + 400).alias("arrival"))),
    )
    return packets.select("packet", "messages", F.inline(F.filter(copies, lambda c: c.isNotNull())))


MESSAGES_SQL = """
raw AS (
  SELECT epoch_us(o_orderdate) AS ts_us, 0 AS modify, o_orderkey AS root, 0 AS line, 0 AS part, 0 AS supp, 'A' AS type, (1 + o_custkey % 25)::INT AS locate,
    CASE WHEN o_orderkey % 2 = 0 THEN 'B' ELSE 'S' END AS side, 1000000 + 100 * (o_custkey % 40) AS price, 100 + 100 * (o_orderkey % 3) AS shares FROM orders
  UNION ALL
  SELECT epoch_us(l_shipdate), 1, l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_linenumber <= 2 THEN 'E' WHEN l_linenumber = 3 THEN 'C' WHEN l_linenumber <= 5 THEN 'X' WHEN l_linenumber = 6 THEN 'U' ELSE 'D' END,
    NULL, NULL, 1000000 + 100 * (l_partkey % 40), (3 * l_quantity)::BIGINT FROM lineitem
), msg AS (
  SELECT row_number() OVER (ORDER BY ts_us, modify, root, line, part, supp) AS seq, ts_us, type, root, locate, side, price::BIGINT AS price, shares::BIGINT AS shares FROM raw
)"""

PACKETS_SQL = f"""
pk AS (SELECT event_id // {PACKET} AS packet, count(*) AS messages FROM events GROUP BY 1),
copies AS (
  SELECT packet, messages, 0 AS line, packet * 10 + packet * 31 % 17 AS arrival FROM pk WHERE (packet * 7919 + 3) % 11 <> 0
  UNION ALL SELECT packet, messages, 0, packet * 10 + 55 FROM pk WHERE (packet * 7919 + 3) % 11 <> 0 AND packet % 13 = 0
  UNION ALL SELECT packet, messages, 1, packet * 10 + 3 + packet * 17 % 23 FROM pk WHERE (packet * 104729 + 5) % 7 <> 0
  UNION ALL SELECT packet, messages, 2, packet * 10 + 400 FROM pk WHERE (packet * 7919 + 3) % 11 = 0 AND (packet * 104729 + 5) % 7 = 0
)"""
