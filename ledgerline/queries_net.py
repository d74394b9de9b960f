"""Queries over line traffic: arbitration by arrival, gap closings, publisher's totals, requests, timing rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import packets, snapshot, traffic
from ledgerline.plans.adapter import MESSAGES_SQL, PACKET, PACKETS_SQL, line_packets, messages
from ledgerline.queries import _FIRST, EVERY, _VALUES, _values
from ledgerline.registry import query
from ledgerline.streaming.arbiter import counted, merged

#: Packets of a session; every session numbers its messages from 1.
SESSION = 100
_SESSIONS = f"{PACKETS_SQL}, s AS (SELECT packet // {SESSION} AS session, packet % {SESSION} AS place, messages, line, arrival, (arrival * 10 + line) * 1000000 + packet % {SESSION} AS moment FROM copies), f AS (SELECT session, place, min(moment) AS first_moment, arg_min(line, moment) AS first_line, arg_min(arrival, moment) AS first_arrival, max(messages) AS messages FROM s GROUP BY ALL)"


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of many sessions as an arbiter takes them, a byte a message."""
    p = F.col("packet")
    bodies = F.transform(F.sequence(F.lit(1), F.col("messages").cast("int")), lambda k: F.encode(F.chr(k), "UTF-8"))
    return line_packets(spark, sf_dir).select(F.floor(p / SESSION).cast("string").alias("session"), "line", "arrival", (p % SESSION * PACKET + 1).alias("seq"), F.col("messages").cast("int").alias("count"), bodies.alias("bodies"))


@query(f"WITH {_SESSIONS} SELECT session::VARCHAR AS session, place * {PACKET} + unnest(generate_series(1, messages)) AS seq, first_line AS line, first_arrival AS arrival FROM f")
def arbitrated_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in the order of their sessions, each once, with the line and arrival of the copy that was used; folded by arrival."""
    out = merged(_sessions(spark, sf_dir))
    return out.where("kind = 'message'").select("session", "seq", "line", "arrival")


@query(f"""WITH {_SESSIONS}, d AS (SELECT *, max(first_moment) OVER (PARTITION BY session ORDER BY place) AS known FROM f),
c AS (SELECT s.session, s.place, s.line, s.moment, s.moment = d.first_moment AS first, d.known, d.messages FROM s JOIN d USING (session, place))
SELECT session::VARCHAR AS session, count(*) FILTER (line = 0) AS packets_a, count(*) FILTER (line = 1) AS packets_b, count(*) FILTER (line = 2) AS packets_recovery, count(*) FILTER (first) AS applied, sum(messages) FILTER (first)::BIGINT AS messages,
  count(*) FILTER (NOT first AND moment > known) AS duplicates, count(*) FILTER (first AND moment < known) AS buffered, count(*) FILTER (NOT first AND moment < known) AS buffer_dups FROM c GROUP BY session""")
def arbitration_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the packets of each session."""
    shown = ["packets_a", "packets_b", "packets_recovery", "applied", "messages", "duplicates", "buffered", "buffer_dups"]
    return counted(_sessions(spark, sf_dir)).select("session", *shown)


_WAITING = f"""{PACKETS_SQL}, {_FIRST}, d AS (SELECT packet, arrival, line, max(arrival) OVER (ORDER BY packet) AS known FROM firsts),
late AS (SELECT packet, arrival, known, packet - row_number() OVER (ORDER BY packet) AS island FROM d WHERE known > arrival),
gaps AS (SELECT min(packet) AS a, max(packet) + 1 AS b, min(arrival) AS opened, max(known) AS closed FROM late GROUP BY island)"""


@query(f"""WITH {_WAITING} SELECT CASE WHEN line = 2 THEN 'rerequest' ELSE 'other line' END AS cause, (closed - opened) // 16 * 16 AS open_from, count(*) AS gaps, sum(b - a)::BIGINT AS packets FROM gaps JOIN d ON packet = a - 1 GROUP BY ALL""")
def gap_closings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps by what closed them and by how long they were open: runs of waiting packets, and the packet before each."""
    delivered = traffic.prefix_delivery(line_packets(spark, sf_dir))
    late = delivered.where("waited > 0")
    runs = traffic.islands(late, [], "packet")
    spans = late.join(runs.withColumn("packet", F.explode(F.sequence(F.col("from"), F.col("to") - 1))), "packet")
    gaps = spans.groupBy("from", "to").agg(F.min("arrival").alias("opened"), F.max("delivered_at").alias("closed"))
    before = traffic.first_copies(line_packets(spark, sf_dir)).select((F.col("packet") + 1).alias("from"), "line")
    closed = gaps.join(before, "from").withColumns({"cause": F.when(F.col("line") == 2, "rerequest").otherwise("other line"), "open_from": F.expr("(closed - opened) div 16 * 16")})
    return closed.groupBy("cause", "open_from").agg(F.count("*").alias("gaps"), F.sum(F.col("to") - F.col("from")).alias("packets"))


@query(f"""WITH {PACKETS_SQL}, c AS (SELECT line, packet, max(messages) AS messages, count(*) AS copies FROM copies WHERE line < 2 GROUP BY ALL)
SELECT l.line, CASE WHEN c.copies IS NULL THEN 'drop' WHEN c.copies > 1 THEN 'duplicate' ELSE 'send' END AS action, count(*) AS packets, sum(pk.messages)::BIGINT AS messages FROM pk CROSS JOIN (VALUES (0), (1)) l(line) LEFT JOIN c ON c.packet = pk.packet AND c.line = l.line GROUP BY ALL""")
def publisher_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets and messages by line and by what was done with them."""
    copies = line_packets(spark, sf_dir)
    sent = copies.groupBy("packet").agg(F.max("messages").alias("messages"), *(F.count_if(F.col("line") == k).alias(f"n{k}") for k in (0, 1)))
    action = lambda n: F.when(n == 0, "drop").when(n > 1, "duplicate").otherwise("send")
    each = sent.select("messages", F.inline(F.array(*(F.struct(F.lit(k).alias("line"), action(F.col(f"n{k}")).alias("action")) for k in (0, 1)))))
    return each.groupBy("line", "action").agg(F.count("*").alias("packets"), F.sum("messages").alias("messages"))


@query(f"""WITH {PACKETS_SQL}, got AS (SELECT DISTINCT packet FROM copies WHERE line = 0) SELECT pk.packet, (SELECT min(g.packet) FROM got g WHERE g.packet > pk.packet) AS gap_end FROM pk WHERE pk.packet NOT IN (SELECT packet FROM got)""")
def gap_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each packet that the first line lost, the next one that it brought: where the gap ends."""
    copies = line_packets(spark, sf_dir)
    gone = traffic.missing(copies, copies.select("packet").distinct(), 0)
    runs = traffic.islands(gone, [], "packet")
    last = copies.agg(F.max("packet")).first()[0]
    each = runs.select(F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("packet"), F.col("to").alias("gap_end"))
    return each.select("packet", F.when(F.col("gap_end") <= (last if last is not None else -1), F.col("gap_end")).alias("gap_end"))


@query(f"""WITH {PACKETS_SQL}, x AS (SELECT 26400 + line AS port, 'DAY' || packet % 3 AS session, messages FROM copies) SELECT CASE port WHEN 26400 THEN 0 WHEN 26401 THEN 1 END AS line, count(*) AS packets, count(*) FILTER (session = 'DAY1') AS same_session FROM x GROUP BY 1""")
def ports_and_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets by the line their port stands for, and those of the session that is asked for."""
    rows = line_packets(spark, sf_dir).select((F.col("line") + 26400).alias("port"), F.concat(F.lit("DAY"), (F.col("packet") % 3).cast("string")).alias("session"))
    return rows.groupBy(packets.line_of(F.col("port"), {26400: 0, 26401: 1}).alias("line")).agg(F.count("*").alias("packets"), F.count_if(F.col("session") == "DAY1").alias("same_session"))


@query("""WITH r AS (SELECT event_id, event_id * 13 % 5000 AS requested, event_id // 2 AS applied, event_id AS published FROM events) SELECT event_id, least(greatest(requested, applied), published) AS target FROM r""")
def snapshot_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a snapshot server brings its replica for each request."""
    e = F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", snapshot.target(e * 13 % 5000, F.expr("event_id div 2"), e).alias("target"))


@query(f"""WITH {MESSAGES_SQL}, n AS (SELECT max(seq) AS n FROM msg), cp AS (SELECT unnest(generate_series({EVERY}, (SELECT n FROM n), {EVERY})) AS book_msgs), snap AS (SELECT n // {EVERY} // 2 * {EVERY} AS half FROM n)
SELECT book_msgs, book_msgs < half AS skipped FROM cp, snap""")
def skipped_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a snapshot half-way, the checkpoints before it are skipped and one exactly at it is checked."""
    n = messages(spark, sf_dir).agg(F.max("seq")).first()[0] or 0
    at = n // EVERY // 2 * EVERY
    return spark.range(EVERY, n + 1, EVERY).select(F.col("id").alias("book_msgs"), (F.col("id") < at).alias("skipped"))


@query(f"""WITH {_VALUES}, t AS (SELECT event_type, v, user_id FROM vals) SELECT event_type, count(*) FILTER (user_id % 4 = 0 AND user_id % 3 <> 2) AS timed, count(*) FILTER (v >= 50000) AS paced, count(*) FILTER (user_id >= 30) AS warm, count(*) FILTER (event_type = 'click') AS on_topic FROM t GROUP BY event_type""")
def timing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which messages are timed (one in four, never what was recovered), in the pace window, after warm-up, of the topic."""
    u, v = F.col("user_id"), F.col("v")
    sampled, recovered = u % 4 == 0, u % 3 == 2
    n = lambda cond, name: F.count_if(cond).alias(name)
    return _values(spark, sf_dir).groupBy("event_type").agg(n(sampled & ~recovered, "timed"), n(v >= 50000, "paced"), n(u >= 30, "warm"), n(F.col("event_type") == "click", "on_topic"))


@query(f"""WITH {PACKETS_SQL}, s AS (SELECT packet, packet % 5 = 0 AND lag(packet % 5 = 0) OVER (ORDER BY packet) IS NOT TRUE AS held, messages FROM pk) SELECT packet, row_number() OVER (ORDER BY packet + CASE WHEN held THEN 1.5 ELSE 0 END) - 1 AS place FROM s""")
def delayed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which packets go out when some wait for their successor, one at a time."""
    from ledgerline.operators.prefix import numbered

    sent = line_packets(spark, sf_dir).groupBy("packet").agg(F.max("messages").alias("messages"))
    # A packet is held unless the one before it is: of a run of delayed packets every other one waits; here no two are neighbours.
    half = (F.col("packet") * 2 + F.when(F.col("packet") % 5 == 0, 3).otherwise(0)).alias("half")
    return numbered(sent.select("packet", half), ["half", "packet"], "n").select("packet", (F.col("n") - 1).alias("place"))
