"""Registered queries over the adapted stream, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators import book, latency, publish, traffic
from ledgerline.operators.fold import locate_digests
from ledgerline.plans.adapter import MESSAGES_SQL, PACKETS_SQL, directory, line_packets, messages
from ledgerline.plans.effects import EFFECTS_SQL, deltas, effects, staged_effects
from ledgerline.plans.stage import staged
from ledgerline.registry import ORACLES, QUERIES, query  # noqa: F401
from ledgerline.sources.feed import LEAST

KNOWN = ("A", "E", "C", "X", "D", "U")
#: Checkpoints every so many messages; snapshots every so many.
EVERY, SNAPSHOT_EVERY = 8192, 1000
QUANTILES = [0.5, 0.9, 0.99, 0.999]
LENGTHS = {k: LEAST[k] for k in KNOWN}


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas(staged_effects(spark, sf_dir))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, f"live:{sf_dir}", lambda: book.live_orders(staged_effects(spark, sf_dir)))


_LEVELS = "lv AS (SELECT locate, side, price, sum(d_orders)::BIGINT AS orders, sum(d_shares)::BIGINT AS shares FROM delta GROUP BY ALL HAVING sum(d_orders) > 0)"
_LIVE = """last AS (SELECT root, max(seq) AS seq FROM fx WHERE outcome <> 'unknown' GROUP BY root),
live AS (SELECT root, locate, side, price, open_after AS shares, arrival, (generation + (outcome = 'replaced')::INT)::INT AS generation FROM fx JOIN last USING (root, seq) WHERE open_after > 0)"""
_TOP = """SELECT locate, arg_max(shares, price) FILTER (side = 'B') AS bid_shares, max(price) FILTER (side = 'B') AS bid_price, min(price) FILTER (side = 'S') AS ask_price, arg_min(shares, price) FILTER (side = 'S') AS ask_shares,
  count(*) FILTER (side = 'B') AS bid_levels, count(*) FILTER (side = 'S') AS ask_levels, min(price) FILTER (side = 'S') - max(price) FILTER (side = 'B') AS spread"""


# --- the stream itself ---------------------------------------------------------------------------------


@query(f"WITH {MESSAGES_SQL} SELECT type, count(*) AS n, (count(*) * 1000000 // sum(count(*)) OVER ())::BIGINT AS share_millionths FROM msg GROUP BY type")
def message_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = messages(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))
    return mix.withColumn("share_millionths", F.floor(F.col("n") * 1000000 / F.sum("n").over(Window.partitionBy()))).orderBy(F.desc("n"), F.desc("type"))


@query(f"WITH {MESSAGES_SQL} SELECT count(*) AS messages, sum(2 + CASE type WHEN 'A' THEN 36 WHEN 'E' THEN 31 WHEN 'C' THEN 36 WHEN 'X' THEN 23 WHEN 'D' THEN 19 ELSE 35 END)::BIGINT AS bytes, count(*) FILTER (type NOT IN ('A', 'E', 'C', 'X', 'D', 'U')) AS malformed, coalesce(bool_or(type NOT IN ('A', 'E', 'C', 'X', 'D', 'U')), false) AS truncated FROM msg")
def parse_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.element_at(F.create_map(*(F.lit(x) for item in LENGTHS.items() for x in item)), F.col("type"))
    return messages(spark, sf_dir).agg(F.count("*").alias("messages"), F.sum(size + 2).alias("bytes"), F.count_if(size.isNull()).alias("malformed"), F.coalesce(F.bool_or(size.isNull()), F.lit(False)).alias("truncated"))


_PIVOT = ", ".join(f"count(*) FILTER (type = '{t}') AS count_{t}" for t in KNOWN)


@query(f"WITH {EFFECTS_SQL} SELECT coalesce(locate, 0) AS locate, count(*) AS messages, {_PIVOT}, count(*) FILTER (type NOT IN ('A', 'E', 'C', 'X', 'D', 'U')) AS count_other FROM fx GROUP BY 1")
def message_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = staged_effects(spark, sf_dir).groupBy(F.coalesce("locate", F.lit(0)).alias("locate"))
    return by.agg(F.count("*").alias("messages"), *(F.count_if(F.col("type") == t).alias(f"count_{t}") for t in KNOWN), F.count_if(~F.col("type").isin(*KNOWN)).alias("count_other"))


@query(f"WITH {MESSAGES_SQL}, cut AS (SELECT min(seq) AS stop FROM msg WHERE ts_us >= (SELECT (min(ts_us) + max(ts_us)) // 2 FROM msg)) SELECT type, count(*) AS n, max(seq) AS last_seq FROM msg, cut WHERE seq < stop GROUP BY type")
def time_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream up to the first message at or after the middle of its time: a cut by position."""
    m = messages(spark, sf_dir)
    middle = m.agg(F.expr("(min(ts_us) + max(ts_us)) div 2")).first()[0]
    at = m.where(F.col("ts_us") >= middle).agg(F.min("seq")).first()[0]
    return m.where(F.col("seq") < at).groupBy("type").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


@query(f"WITH {MESSAGES_SQL} SELECT seq, ts_us, type, root, shares FROM msg WHERE seq <= 1000")
def first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).where("seq <= 1000").select("seq", "ts_us", "type", "root", "shares")


@query(f"WITH {MESSAGES_SQL} SELECT type, count(*) AS n, min(seq) AS first_seq FROM msg WHERE (seq * 2654435761 % 4294967296) // 65536 % 16 = 0 GROUP BY type")
def sampled_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).where("(seq * 2654435761L % 4294967296L) div 65536 % 16 = 0").groupBy("type").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query(f"WITH {MESSAGES_SQL} SELECT seq, (seq - 1) * 1000000000 // 2000000 AS constant_ns, (ts_us - first_value(ts_us) OVER (ORDER BY seq)) * 1000 // 5000000 AS scaled_ns FROM msg")
def pace_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each message is due at 2 million a second, and at the feed's own pace sped up."""
    m = messages(spark, sf_dir)
    first = m.where("seq = 1").select("ts_us").first()
    base = first[0] if first else 0
    return m.select("seq", F.expr("(seq - 1) * 1000000000L div 2000000").alias("constant_ns"), F.expr(f"(ts_us - {base}L) * 1000 div 5000000").alias("scaled_ns"))


# --- effects and counters --------------------------------------------------------------------------------


@query(f"WITH {EFFECTS_SQL} SELECT type, outcome, count(*) AS n, sum(open_before)::BIGINT AS open_before, sum(open_after)::BIGINT AS open_after FROM fx GROUP BY ALL")
def effects_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_effects(spark, sf_dir).groupBy("type", "outcome").agg(F.count("*").alias("n"), F.sum("open_before").alias("open_before"), F.sum("open_after").alias("open_after"))


@query(f"WITH {EFFECTS_SQL} SELECT seq, root, type, open_before, open_after, outcome FROM fx")
def open_before_each_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_effects(spark, sf_dir).select("seq", "root", "type", "open_before", "open_after", "outcome")


@query(f"""WITH {EFFECTS_SQL}, moves AS (SELECT seq, type, sum(CASE outcome WHEN 'add' THEN 1 ELSE -1 END) OVER (ORDER BY seq) AS live FROM fx WHERE outcome IN ('add', 'removed', 'overfill'))
SELECT count(*) FILTER (type = 'A') AS adds, count(*) FILTER (type IN ('E', 'C')) AS executes, count(*) FILTER (type = 'X') AS cancels, count(*) FILTER (type = 'D') AS deletes, count(*) FILTER (type = 'U') AS replaces,
  count(*) FILTER (outcome = 'unknown') AS unknown_ref, count(*) FILTER (outcome = 'overfill') AS overfill, count(*) FILTER (outcome = 'add') - count(*) FILTER (outcome IN ('removed', 'overfill')) AS live_orders,
  (SELECT max(live) FROM moves)::BIGINT AS peak_live_orders FROM fx""")
def book_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    peak = peak_live_orders(spark, sf_dir).first()["peak_live_orders"]
    return book.counters(staged_effects(spark, sf_dir)).withColumn("peak_live_orders", F.lit(peak).cast("long"))


@query(f"WITH {EFFECTS_SQL} SELECT seq, (sum(CASE outcome WHEN 'add' THEN 1 ELSE -1 END) OVER (ORDER BY seq))::BIGINT AS live FROM fx WHERE outcome IN ('add', 'removed', 'overfill')")
def live_orders_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.live_timeline(staged_effects(spark, sf_dir)).select("seq", F.col("live").cast("long").alias("live"))


@query(f"WITH {EFFECTS_SQL}, t AS (SELECT seq, (sum(CASE outcome WHEN 'add' THEN 1 ELSE -1 END) OVER (ORDER BY seq))::BIGINT AS live FROM fx WHERE outcome IN ('add', 'removed', 'overfill')) SELECT max(live) AS peak_live_orders, min(seq) FILTER (live = (SELECT max(live) FROM t)) AS first_seq FROM t")
def peak_live_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    peak = F.max(F.struct("live", (-F.col("seq")).alias("at")))
    return live_orders_timeline(spark, sf_dir).agg(peak.alias("p")).select(F.col("p.live").alias("peak_live_orders"), (-F.col("p.at")).alias("first_seq"))


@query(f"WITH {EFFECTS_SQL} SELECT root, count(*) AS replaces, root * 1000 + count(*) AS final_ref, max(seq) AS last_replace FROM fx WHERE outcome = 'replaced' GROUP BY root")
def replace_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = staged_effects(spark, sf_dir).where("outcome = 'replaced'").groupBy("root").agg(F.count("*").alias("replaces"), F.max("seq").alias("last_replace"))
    return done.withColumn("final_ref", F.col("root") * 1000 + F.col("replaces"))


# --- the book ----------------------------------------------------------------------------------------------


@query(f"WITH {EFFECTS_SQL}, {_LEVELS} SELECT * FROM lv")
def final_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.levels(_deltas(spark, sf_dir))


@query(f"WITH {EFFECTS_SQL}, {_LEVELS}, top AS ({_TOP} FROM lv GROUP BY locate) SELECT n_name AS symbol, top.* FROM top JOIN nation ON n_nationkey + 1 = locate")
def top_of_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.top_of_book(final_levels(spark, sf_dir)).join(directory(spark, sf_dir), "locate")


@query(f"WITH {EFFECTS_SQL}, {_LEVELS} SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY locate, side ORDER BY CASE side WHEN 'B' THEN -price ELSE price END))::INT AS rank FROM lv) WHERE rank <= 5")
def top5_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.top_levels(final_levels(spark, sf_dir), 5)


@query(f"WITH {EFFECTS_SQL}, {_LEVELS} SELECT locate, side, count(*) AS depth, sum(orders)::BIGINT AS orders, sum(shares)::BIGINT AS shares FROM lv GROUP BY ALL")
def depth_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.depth(final_levels(spark, sf_dir))


@query(f"""WITH {EFFECTS_SQL}, span AS (SELECT min(ts_us) AS a, max(ts_us) AS b FROM msg), times AS (SELECT 'q' || i AS as_of, a + (b - a) * i // 4 AS t FROM span, range(1, 4) r(i)),
edge AS (SELECT as_of, min(seq) AS boundary FROM times JOIN msg ON ts_us >= t GROUP BY as_of),
lv AS (SELECT as_of, locate, side, price, sum(d_orders) AS orders, sum(d_shares)::BIGINT AS shares FROM delta JOIN edge ON seq < boundary GROUP BY ALL HAVING sum(d_orders) > 0)
{_TOP.replace("SELECT locate", "SELECT as_of, locate")} FROM lv GROUP BY as_of, locate""")  # fmt: skip
def book_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top of book before the first message at or after each quarter of the stream's time."""
    m = messages(spark, sf_dir)
    a, b = m.agg(F.min("ts_us"), F.max("ts_us")).first()
    times = {f"q{i}": a + (b - a) * i // 4 for i in (1, 2, 3)} if a is not None else {}
    first = m.agg(F.lit(0).alias("none"), *(F.min(F.when(F.col("ts_us") >= t, F.col("seq"))).alias(k) for k, t in times.items())).first()
    return book.top_of_book(book.levels(book.as_of(_deltas(spark, sf_dir), {k: first[k] for k in times}), ["as_of"]), ["as_of"])


@query(f"""WITH {EFFECTS_SQL} SELECT seq, sub, locate, side, price, (sum(d_orders) OVER w)::BIGINT AS orders, (sum(d_shares) OVER w)::BIGINT AS shares FROM delta
WINDOW w AS (PARTITION BY locate, side, price ORDER BY seq, sub)""")  # fmt: skip
def levels_after_each_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.levels_after_each(_deltas(spark, sf_dir))


_QUEUE = "queue AS (SELECT *, row_number() OVER w - 1 AS idx, (sum(shares) OVER w - shares)::BIGINT AS shares_ahead FROM live WINDOW w AS (PARTITION BY locate, side, price ORDER BY arrival ROWS UNBOUNDED PRECEDING))"


@query(f"WITH {EFFECTS_SQL}, {_LIVE}, {_QUEUE} SELECT root, locate, side, price, shares, arrival, generation, idx, shares_ahead FROM queue")
def queue_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.queue_positions(_live(spark, sf_dir))


@query(f"WITH {EFFECTS_SQL}, {_LIVE} SELECT row_number() OVER (ORDER BY locate, side, price, arrival) - 1 AS place, root, locate, side, price, shares FROM live")
def order_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.order_walk(_live(spark, sf_dir)).select("place", "root", "locate", "side", "price", "shares")


_REBUILT = "rebuilt AS (SELECT locate, side, price, count(*) AS orders, sum(shares)::BIGINT AS shares FROM live GROUP BY ALL)"
_BOTH = "both_ AS (SELECT a.orders AS ao, a.shares AS ash, b.orders AS bo, b.shares AS bsh FROM lv a FULL JOIN rebuilt b USING (locate, side, price))"
_DIFFER = "count(*) FILTER (ao IS DISTINCT FROM bo OR ash IS DISTINCT FROM bsh)"


@query(f"""WITH {EFFECTS_SQL}, {_LEVELS}, {_LIVE}, {_REBUILT}, {_BOTH} SELECT 'levels_match_orders' AS check, {_DIFFER} AS violations FROM both_
UNION ALL SELECT 'order_without_shares', count(*) FROM live WHERE shares <= 0 UNION ALL SELECT 'empty_level_kept', count(*) FROM lv WHERE orders <= 0 OR shares <= 0""")
def invariant_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.invariants(_live(spark, sf_dir), final_levels(spark, sf_dir))


@query(f"WITH {EFFECTS_SQL}, {_LEVELS}, {_LIVE}, {_REBUILT}, {_BOTH} SELECT count(*) AS levels, {_DIFFER} AS differing, {_DIFFER} = 0 AS equal FROM both_")
def books_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels summed from changes against levels rebuilt from the live orders."""
    rebuilt = _live(spark, sf_dir).groupBy(*book.LEVEL).agg(F.count("*").alias("orders"), F.sum("shares").alias("shares"))
    left, right = final_levels(spark, sf_dir).withColumn("a", F.struct("orders", "shares")), rebuilt.withColumn("b", F.struct("orders", "shares"))
    both = left.select(*book.LEVEL, "a").join(right.select(*book.LEVEL, "b"), book.LEVEL, "full_outer")
    wrong = F.count_if(~F.col("a").eqNullSafe(F.col("b")))
    return both.agg(F.count("*").alias("levels"), wrong.alias("differing"), (wrong == 0).alias("equal"))


def hash_sql(shift: int = 0) -> str:
    """Book hashes at checkpoints of sequences moved by ``shift``; the level hash is spelled out over named steps, as DuckDB has no macros inside a query."""
    w = "18446744073709551616::UHUGEINT"

    def steps(source: str, column: str, out: str, n: int) -> str:
        return (
            f"h{n}a AS (SELECT *, (({column} + 11400714819323198485::UHUGEINT) % {w}) AS x{n}a FROM {source}), "
            f"h{n}b AS (SELECT *, ((xor(x{n}a, x{n}a // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % {w}) AS x{n}b FROM h{n}a), "
            f"h{n}c AS (SELECT *, ((xor(x{n}b, x{n}b // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % {w}) AS x{n}c FROM h{n}b), "
            f"h{n}d AS (SELECT *, xor(x{n}c, x{n}c // 2147483648::UHUGEINT) AS {out} FROM h{n}c)"
        )

    state = """marks AS (SELECT DISTINCT ceil((seq + {s}) / {e})::BIGINT * {e} AS mark FROM delta),
st AS (SELECT mark, locate, side, price, sum(d_orders)::BIGINT AS orders, sum(d_shares)::BIGINT AS shares FROM delta JOIN marks ON seq + {s} <= mark GROUP BY ALL HAVING sum(d_orders) > 0),
k0 AS (SELECT *, locate::UHUGEINT * 1099511627776::UHUGEINT + ascii(side)::UHUGEINT * 4294967296::UHUGEINT + price::UHUGEINT AS k FROM st)""".replace("{e}", str(EVERY)).replace("{s}", str(shift))
    middle = f"k1 AS (SELECT *, xor(xor(where_hash, (shares::UHUGEINT * 2685821657736338717::UHUGEINT) % {w}), (orders::UHUGEINT * 281474976710656::UHUGEINT) % {w}) AS k2 FROM h1d)"
    last = f"SELECT mark AS book_msgs, lpad(lower(hex((sum(level_hash::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT)), 16, '0') AS book_hash FROM h2d GROUP BY mark"
    return f"WITH {EFFECTS_SQL}, {state}, {steps('k0', 'k', 'where_hash', 1)}, {middle}, {steps('k1', 'k2', 'level_hash', 2)} {last}"


@query(hash_sql())
def level_hash_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.book_hashes(_deltas(spark, sf_dir), EVERY)


@query()
def digest_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest chain and order hash of each locate, folded in order (one group a locate)."""
    return locate_digests(messages(spark, sf_dir), staged_effects(spark, sf_dir), EVERY)


_SNAP = f"""{EFFECTS_SQL}, marks AS (SELECT unnest(generate_series({SNAPSHOT_EVERY}, (SELECT max(seq) FROM msg), {SNAPSHOT_EVERY})) AS mark),
moved AS (SELECT (seq + {SNAPSHOT_EVERY} - 1) // {SNAPSHOT_EVERY} * {SNAPSHOT_EVERY} AS mark, locate, side, price, sum(d_orders) AS o, sum(d_shares) AS s FROM delta GROUP BY ALL),
held AS (SELECT mark, locate, side, price, sum(o) OVER w AS orders, sum(s) OVER w AS shares, lead(mark) OVER w AS until FROM moved WINDOW w AS (PARTITION BY locate, side, price ORDER BY mark)),
state AS (SELECT m.mark, h.locate, h.side, h.price, h.orders::BIGINT AS orders, h.shares::BIGINT AS shares FROM marks m JOIN held h ON h.mark <= m.mark AND (h.until IS NULL OR h.until > m.mark) WHERE h.orders > 0),
top AS (SELECT *, row_number() OVER (PARTITION BY mark, locate, side ORDER BY CASE side WHEN 'B' THEN -price ELSE price END) AS rank FROM state),
snap AS (SELECT mark, locate, coalesce(string_agg(price || ':' || shares || ':' || orders, ',' ORDER BY rank) FILTER (side = 'B'), '') AS bids, coalesce(string_agg(price || ':' || shares || ':' || orders, ',' ORDER BY rank) FILTER (side = 'S'), '') AS asks FROM top WHERE rank <= 5 GROUP BY mark, locate)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.top_snapshots(_deltas(spark, sf_dir), SNAPSHOT_EVERY, messages(spark, sf_dir).agg(F.max("seq")).first()[0] or 0, 5)


@query(f"WITH {_SNAP} SELECT mark AS seq, locate, bids, asks, (lag(bids || '/' || asks) OVER (PARTITION BY locate ORDER BY mark)) IS DISTINCT FROM bids || '/' || asks AS changed FROM snap")
def published_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best levels of each side of every book at every SNAPSHOT_EVERY-th message, and whether they differ from those before."""
    before = F.lag(F.concat_ws("/", "bids", "asks")).over(Window.partitionBy("locate").orderBy("seq"))
    return _snapshots(spark, sf_dir).withColumn("changed", ~before.eqNullSafe(F.concat_ws("/", "bids", "asks"))).select("seq", "locate", "bids", "asks", "changed")


@query("SELECT user_id, count(*) AS received, coalesce(sum(gap), 0)::BIGINT AS missed FROM (SELECT user_id, event_id // 50 - lag(event_id // 50) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS gap FROM events) WHERE gap IS NULL OR gap >= 0 GROUP BY user_id")
def publish_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subscriber's view of publish numbers: received, and missed between neighbours."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.floor(F.col("event_id") / 50).alias("n"))
    gap = F.col("n") - F.lag("n").over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return events.withColumn("gap", gap).where("gap IS NULL OR gap >= 0").groupBy("user_id").agg(F.count("*").alias("received"), F.coalesce(F.sum("gap"), F.lit(0)).alias("missed"))


# --- redundant lines -----------------------------------------------------------------------------------------

_FIRST = "firsts AS (SELECT packet, arg_min(line, arrival * 10 + line) AS line, min(arrival) AS arrival, max(messages) AS messages FROM copies GROUP BY packet)"


@query(f"""WITH {PACKETS_SQL}, {_FIRST} SELECT c.line, count(*) AS received, count(*) FILTER (c.arrival = f.arrival AND c.line = f.line) AS first_copies,
  coalesce(sum(c.messages) FILTER (c.arrival = f.arrival AND c.line = f.line), 0)::BIGINT AS delivered FROM copies c JOIN firsts f USING (packet) GROUP BY c.line""")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.line_statistics(line_packets(spark, sf_dir))


_ISLANDS = "isl AS (SELECT line, min(packet) AS \"from\", max(packet) + 1 AS \"to\" FROM (SELECT line, packet, packet - row_number() OVER (PARTITION BY line ORDER BY packet) AS g FROM gone) GROUP BY line, g)"
_GONE = "gone AS (SELECT l.line, pk.packet FROM pk, (VALUES (0), (1)) l(line) WHERE NOT EXISTS (SELECT 1 FROM copies c WHERE c.line = l.line AND c.packet = pk.packet))"


def _gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = line_packets(spark, sf_dir)
    sent = packets.select("packet").distinct()
    return traffic.missing(packets, sent, 0).unionByName(traffic.missing(packets, sent, 1))


@query(f"WITH {PACKETS_SQL}, {_GONE}, {_ISLANDS} SELECT * FROM isl")
def line_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.islands(_gone(spark, sf_dir), ["line"], "packet")


@query(f"WITH {PACKETS_SQL}, {_GONE} SELECT packet FROM gone GROUP BY packet HAVING count(*) = 2")
def missing_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets that neither line brought."""
    return _gone(spark, sf_dir).groupBy("packet").count().where("count = 2").select("packet")


@query(f"WITH {PACKETS_SQL}, {_FIRST}, d AS (SELECT packet, arrival, max(arrival) OVER (ORDER BY packet) AS delivered_at FROM firsts) SELECT packet, arrival, delivered_at, delivered_at - arrival AS waited FROM d WHERE delivered_at > arrival")
def gap_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets that had to wait for an earlier one, and how long."""
    return traffic.prefix_delivery(line_packets(spark, sf_dir)).where("waited > 0").select("packet", "arrival", "delivered_at", "waited")


@query(f"WITH {PACKETS_SQL}, {_GONE}, {_ISLANDS}, r AS (SELECT *, unnest(generate_series(\"from\" * 10, \"to\" * 10 - 1, 16)) AS start FROM isl) SELECT line, \"from\", \"to\", start, least(16, \"to\" * 10 - start)::BIGINT AS count FROM r")
def retransmit_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps in messages, cut into re-requests of at most 16."""
    ranges = line_gaps(spark, sf_dir).withColumns({"a": F.col("from"), "b": F.col("to"), "from": F.col("from") * 10, "to": F.col("to") * 10})
    return traffic.chunks(ranges, 16).select("line", F.col("a").alias("from"), F.col("b").alias("to"), "start", "count")


@query("""WITH r AS (SELECT event_id, user_id AS client, event_id * 37 % 1200 AS seq, CASE WHEN event_id % 23 = 0 THEN 0 WHEN event_id % 29 = 0 THEN 65535 ELSE event_id % 90 END AS cnt, event_id AS next_seq FROM events),
o AS (SELECT *, CASE WHEN cnt = 0 OR cnt = 65535 THEN 'bad' WHEN seq = 0 OR seq >= next_seq THEN 'unpublished' WHEN next_seq - seq > 5000 THEN 'retention' WHEN cnt > 64 THEN 'trimmed' ELSE 'served' END AS outcome FROM r)
SELECT outcome, count(*) AS n, sum(CASE WHEN outcome IN ('trimmed', 'served') THEN least(least(cnt, 64), next_seq - seq) ELSE 0 END)::BIGINT AS granted FROM o GROUP BY outcome""")
def retransmit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    count = F.when(e % 23 == 0, 0).when(e % 29 == 0, 65535).otherwise(e % 90)
    requests = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("client"), (e * 37 % 1200).alias("seq"), count.cast("long").alias("count"), e.alias("next_seq"))
    return traffic.admission(requests, 5000, 64).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("granted").alias("granted"))


@query(f"WITH {EFFECTS_SQL}, {_LEVELS} SELECT * FROM lv")
def arbitrated_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book from two lossy copies of the stream and what was recovered: first copies, then effects."""
    m = messages(spark, sf_dir)
    a, b = m.where("(seq * 7919 + 3) % 11 <> 0"), m.where("(seq * 104729 + 5) % 7 <> 0")
    recovered = m.where("(seq * 7919 + 3) % 11 = 0 AND (seq * 104729 + 5) % 7 = 0")
    merged = a.unionByName(b).unionByName(recovered).dropDuplicates(["seq"])
    return book.levels(deltas(effects(merged)))


# --- latency --------------------------------------------------------------------------------------------------

_BUCKET = f"CASE WHEN v < 32 THEN v WHEN length(bin(v)) - 1 > 48 THEN {latency.BUCKETS - 1} ELSE (length(bin(v)) - 5) * 32 + ((v >> (length(bin(v)) - 6)) & 31) END"
_VALUES = f"vals AS (SELECT event_type, user_id, floor(abs(value) * 1000)::BIGINT AS v FROM events WHERE value IS NOT NULL), hist AS (SELECT event_type, ({_BUCKET})::BIGINT AS bucket, count(*) AS count, max(v) AS top, sum(v)::BIGINT AS total FROM vals GROUP BY 1, 2)"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL").select("event_type", "user_id", F.floor(F.abs("value") * 1000).alias("v"))


@query(f"WITH {_VALUES} SELECT * FROM hist")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.histogram(_values(spark, sf_dir), ["event_type"], "v")


@query(f"""WITH {_VALUES}, c AS (SELECT event_type, bucket, sum(count) OVER (PARTITION BY event_type ORDER BY bucket) AS seen, sum(count) OVER (PARTITION BY event_type) AS n, max(top) OVER (PARTITION BY event_type) AS top FROM hist),
p AS (SELECT event_type, q, min(bucket) AS bucket, any_value(top) AS top FROM c, (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE, 0.999::DOUBLE]) AS q) WHERE seen >= floor(q * (n - 1)) + 1 GROUP BY event_type, q)
SELECT event_type, round(q * 1000000)::BIGINT AS q_millionths, least(CASE WHEN bucket < 32 THEN bucket ELSE ((32 + bucket % 32) << (bucket // 32 - 1)) + (1::BIGINT << (bucket // 32 - 1)) - 1 END, top)::BIGINT AS value FROM p""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.percentiles(latency_histogram(spark, sf_dir), ["event_type"], QUANTILES)


@query(f"WITH {_VALUES} SELECT event_type, bucket, (sum(count) OVER (PARTITION BY event_type ORDER BY bucket))::BIGINT AS cum_count, (sum(count) OVER (PARTITION BY event_type))::BIGINT AS all_count FROM hist")
def latency_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.cumulative(latency_histogram(spark, sf_dir), ["event_type"])


_RUNS = "runs AS (SELECT event_type, user_id % 9 AS run, count(*) AS messages FROM events GROUP BY ALL)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type", (F.col("user_id") % 9).alias("run")).agg(F.count("*").alias("messages"))


@query(f"WITH {_RUNS} SELECT event_type, run, messages FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY messages, run) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM runs) WHERE r = n // 2 + 1")
def median_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.median_run(_runs(spark, sf_dir), ["event_type"], "messages", "run").select("event_type", "run", "messages")


@query(f"WITH {_RUNS} SELECT event_type, median(messages)::DOUBLE AS median, min(messages) AS least, max(messages) AS largest, round((max(messages) - min(messages)) / median(messages) * 1000000)::BIGINT AS rel_millionths FROM runs GROUP BY event_type")
def run_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.spread(_runs(spark, sf_dir), ["event_type"], "messages")


# --- smaller pieces of the feed and network paths ------------------------------------------------------------


@query(f"""WITH {MESSAGES_SQL} SELECT type, count(*) AS n, coalesce(sum(shares) FILTER (type <> 'D'), 0)::BIGINT AS shares, coalesce(sum(price) FILTER (type IN ('A', 'C', 'U')), 0)::BIGINT AS price,
  count(*) FILTER (type = 'U') AS new_refs, count(*) FILTER (side = 'B') AS bids FROM msg GROUP BY type""")  # fmt: skip
def feed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream as binary frames and decoded again, partition by partition."""

    def run(batches):
        from ledgerline.sources.feed import decode_columns, encode

        for batch in batches:
            for part in (batch.slice(at, 8192) for at in range(0, batch.num_rows, 8192)):
                rows = part.to_pylist()
                data = b"".join(encode(r["type"], r["ts_us"] % (1 << 47), r["locate"] or 0, ref=r["root"], new_ref=r["root"] + 1, side=r["side"] or "", shares=r["shares"], price=r["price"]) for r in rows)
                yield decode_columns(data, rows[0]["seq"]).select(["type", "shares", "price", "new_ref", "side"])

    source = messages(spark, sf_dir).select("seq", "ts_us", "type", "root", "locate", "side", "price", "shares")
    decoded = source.mapInArrow(run, "type string, shares long, price long, new_ref long, side string")
    return decoded.groupBy("type").agg(F.count("*").alias("n"), F.coalesce(F.sum("shares"), F.lit(0)).alias("shares"), F.coalesce(F.sum("price"), F.lit(0)).alias("price"), F.count("new_ref").alias("new_refs"), F.count_if(F.col("side") == "B").alias("bids"))


@query(f"WITH {MESSAGES_SQL} SELECT seq, first_value(seq) OVER w AS index_seq, seq - first_value(seq) OVER w AS steps, first_value(ts_us) OVER w AS index_ts_us FROM msg WINDOW w AS (PARTITION BY (seq - 1) // 64 ORDER BY seq)")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of a sparse index (one in 64) that each sequence starts from: an equi-join on the slot."""
    m, slot = messages(spark, sf_dir), F.expr("(seq - 1) div 64").alias("slot")
    index = m.where("(seq - 1) % 64 = 0").select(slot, F.col("seq").alias("index_seq"), F.col("ts_us").alias("index_ts_us"))
    return m.select("seq", slot).join(index, "slot").select("seq", "index_seq", (F.col("seq") - F.col("index_seq")).alias("steps"), "index_ts_us")


@query("SELECT n_name AS symbol, min(n_nationkey + 1)::INT AS locate FROM nation GROUP BY n_name")
def symbol_locates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory(spark, sf_dir).groupBy("symbol").agg(F.min("locate").alias("locate"))


@query(f"""WITH {PACKETS_SQL}, s AS (SELECT *, CASE WHEN packet % 50 = 7 THEN 'OTHER     ' ELSE 'DAY1      ' END AS session FROM copies),
f AS (SELECT arg_min(session, arrival * 10 + line) AS session FROM s) SELECT s.line, count(*) FILTER (s.session = f.session) AS accepted, count(*) FILTER (s.session <> f.session) AS bad_session FROM s, f GROUP BY s.line""")  # fmt: skip
def session_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session seen first wins; packets of others are counted and left out."""
    session = F.rpad(F.when(F.col("packet") % 50 == 7, "OTHER").otherwise("DAY1"), 10, " ")
    packets = line_packets(spark, sf_dir).withColumn("session", session)
    first = packets.agg(F.min_by("session", F.struct("arrival", "line"))).first()[0]
    return packets.groupBy("line").agg(F.count_if(F.col("session") == F.lit(first)).alias("accepted"), F.count_if(F.col("session") != F.lit(first)).alias("bad_session"))


@query("""WITH t AS (SELECT event_type, event_id * 1000 AS t0, event_id * 1000 + event_id * 37 % 500 - 50 AS t1, event_id * 1000 + event_id * 37 % 500 + event_id * 13 % 90 AS t2 FROM events)
SELECT event_type, count(*) AS n, sum(greatest(t1 - t0, 0))::BIGINT AS queue_ns, sum(t2 - t1)::BIGINT AS book_ns, sum(greatest(t1 - t0, 0) + t2 - t1)::BIGINT AS total_ns, max(greatest(t1 - t0, 0) + t2 - t1) AS largest_ns FROM t GROUP BY event_type""")
def latency_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time in the queue (not below 0), in the book, and both."""
    e = F.col("event_id")
    stamps = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", (e * 1000).alias("t0"), (e * 1000 + e * 37 % 500 - 50).alias("t1"), (e * 1000 + e * 37 % 500 + e * 13 % 90).alias("t2"))
    queue, in_book = F.greatest(F.col("t1") - F.col("t0"), F.lit(0)), F.col("t2") - F.col("t1")
    return stamps.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(queue).alias("queue_ns"), F.sum(in_book).alias("book_ns"), F.sum(queue + in_book).alias("total_ns"), F.max(queue + in_book).alias("largest_ns"))


@query("""WITH r AS (SELECT event_type, event_id, floor(abs(value) * 1000)::BIGINT AS ns FROM events WHERE value IS NOT NULL),
w AS (SELECT *, event_id - lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS gap, row_number() OVER (PARTITION BY event_type ORDER BY ns, event_id) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM r)
SELECT event_type, count(*) AS received, coalesce(sum(greatest(gap, 0)), 0)::BIGINT AS missed, median(ns)::DOUBLE AS median, max(ns) FILTER (place = least(n - 1, n * 99 // 100)) AS p99 FROM w GROUP BY event_type""")
def subscriber_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    received = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL").select("event_type", "event_id", F.floor(F.abs("value") * 1000).alias("ns"))
    return publish.subscriber_summary(received, "event_type", "event_id", "ns")


@query(f"""WITH RECURSIVE {EFFECTS_SQL}, after_ AS (SELECT seq, sub, locate || ':' || side || ':' || price AS level, sum(d_orders) OVER w AS orders, sum(d_shares) OVER w AS shares FROM delta WINDOW w AS (PARTITION BY locate, side, price ORDER BY seq, sub)),
rows_ AS (SELECT level, seq, max(orders)::BIGINT AS orders, max(shares)::BIGINT AS shares FROM after_ GROUP BY ALL),
numbered_ AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY seq) AS n FROM rows_),
walk AS (
  SELECT level, n, seq, orders, shares, seq AS sent_seq, orders AS sent_orders, shares AS sent_shares, true AS sent FROM numbered_ WHERE n = 1
  UNION ALL
  SELECT r.level, r.n, r.seq, r.orders, r.shares, CASE WHEN t.go THEN r.seq ELSE w.sent_seq END, CASE WHEN t.go THEN r.orders ELSE w.sent_orders END, CASE WHEN t.go THEN r.shares ELSE w.sent_shares END, t.go
  FROM walk w JOIN numbered_ r ON r.level = w.level AND r.n = w.n + 1, LATERAL (SELECT r.orders <> w.sent_orders OR r.shares <> w.sent_shares OR r.seq - w.sent_seq >= 20000 AS go) t
) SELECT level, seq, orders, shares, row_number() OVER (PARTITION BY level ORDER BY seq) AS publish_seq FROM walk WHERE sent""")
def suppressed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level snapshots that differ from the one sent last for their level, or come 20,000 messages after it."""
    after = book.levels_after_each(_deltas(spark, sf_dir))
    key = F.concat_ws(":", "locate", "side", "price")
    return publish.suppress(after.select(key.alias("level"), "seq", "orders", "shares").groupBy("level", "seq").agg(F.max("orders").alias("orders"), F.max("shares").alias("shares")), "level", "seq", "seq", ["orders", "shares"], 20_000)


# The queries of the other modules register themselves.
from ledgerline import queries_feed, queries_files, queries_net, queries_reports  # noqa: E402, F401
