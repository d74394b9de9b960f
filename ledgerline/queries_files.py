"""Queries over formats: packets, shown values, report rows, files written and read again, requests of many clients."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import show
from ledgerline.functions.u64 import mix64, unsigned
from ledgerline.operators import book, packets, publish, recovery, verify
from ledgerline.plans.adapter import MESSAGES_SQL, PACKETS_SQL, messages
from ledgerline.plans.effects import EFFECTS_SQL
from ledgerline.plans.stage import shared_dir
from ledgerline.queries import _GONE, _ISLANDS, _LEVELS, _TOP, EVERY, _VALUES, final_levels, hash_sql, latency_cdf, latency_histogram, level_hash_checkpoint, line_gaps, message_mix, top_of_book
from ledgerline.queries_reports import _CELLS, _runs
from ledgerline.registry import query
from ledgerline.sinks import reports

#: Sessions of small packets: a session a user, a message an event, as long as its number says.
PAYLOAD = 200
_SIZE = "(event_id * 7 % 60 + 1)"
_WALK = f"""msgs AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, {_SIZE} AS size FROM events),
walk AS (SELECT user_id, seq, size, 22 + size AS used, 1 AS packet FROM msgs WHERE seq = 1
  UNION ALL SELECT m.user_id, m.seq, m.size, CASE WHEN w.used + 2 + m.size > {PAYLOAD} THEN 22 + m.size ELSE w.used + 2 + m.size END, w.packet + (w.used + 2 + m.size > {PAYLOAD})::INT FROM walk w JOIN msgs m ON m.user_id = w.user_id AND m.seq = w.seq + 1)"""


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as bodies, packed greedily."""
    e, u = F.col("event_id"), F.col("user_id")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id")
    body = F.encode(F.expr("repeat('x', cast(event_id * 7 % 60 + 1 as int))"), "UTF-8")
    return packets.packetise_sessions(events.select(F.format_string("U%06d", u).alias("session"), e.alias("order"), body.alias("body")), PAYLOAD)


@query(f"WITH RECURSIVE {_WALK} SELECT printf('U%06d', user_id) || '   ' AS session, min(seq) AS seq, count(*)::INT AS count, max(used)::INT AS bytes, true AS valid FROM walk GROUP BY user_id, packet")
def packet_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session, first sequence and count as the packets' own bytes tell them, their length, and whether they are whole."""
    return packets.headers(_packets(spark, sf_dir)).select("session", "seq", "count", F.length("data").alias("bytes"), packets.is_valid("data").alias("valid"))


@query(f"WITH RECURSIVE {_WALK} SELECT printf('U%06d', user_id) || '   ' AS name, seq, size::INT AS bytes FROM walk")
def packet_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of all packets, numbered from the packets' first sequences."""
    named = _packets(spark, sf_dir).withColumn("name", F.decode(F.substring("data", 1, 10), "ISO-8859-1"))
    return packets.explode_messages(named).select("name", "seq", F.length("body").alias("bytes"))


@query("""SELECT event_id, printf('%d.%04d', event_id * 12345 // 10000, event_id * 12345 % 10000) AS price, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS clock, s * 1000000000 AS parsed, rtrim('S' || event_id || '   ') AS symbol, CASE WHEN event_id % 5 > 0 THEN event_id / (event_id % 5) ELSE 0 END AS rate
FROM (SELECT event_id, event_id * 7 % 86400 AS s FROM events)""")
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, times of day there and back, trimmed symbols, messages a second."""
    e = F.col("event_id")
    ns = e * 7 % 86400 * 1_000_000_000
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", show.price(e * 12345).alias("price"), show.clock(ns).alias("clock"), show.symbol(F.concat(F.lit("S"), e.cast("string"), F.lit("   "))).alias("symbol"), show.rate(e, e % 5).alias("rate"))
    return rows.withColumn("parsed", show.parse_clock(F.col("clock")))


def _mix_sql(x: str) -> str:
    """A wrapping hash of an unsigned column, step by step."""
    w = "18446744073709551616::UHUGEINT"
    a = f"(({x}::UHUGEINT + 11400714819323198485::UHUGEINT) % {w})"
    return f"""a AS (SELECT *, {a} AS p FROM src), b AS (SELECT *, (xor(p, p // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % {w} AS q FROM a),
c AS (SELECT *, (xor(q, q // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % {w} AS r FROM b), d AS (SELECT *, xor(r, r // 2147483648::UHUGEINT) AS mixed FROM c)"""


@query(f"WITH src AS (SELECT event_id FROM events), {_mix_sql('event_id')} SELECT event_id, mixed::DECIMAL(20, 0) AS mixed FROM d")
def mixed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64-bit mixing function of every event's number."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", unsigned(mix64("event_id")).alias("mixed"))


@query(f"WITH {EFFECTS_SQL}, {_LEVELS}, r AS (SELECT locate, side, price, orders, shares, row_number() OVER (PARTITION BY locate, side ORDER BY CASE side WHEN 'B' THEN -price ELSE price END) AS rank FROM lv), b AS (SELECT * FROM r WHERE side = 'B' AND rank <= 5), a AS (SELECT * FROM r WHERE side = 'S' AND rank <= 5) SELECT coalesce(b.locate, a.locate) AS locate, coalesce(b.rank, a.rank)::INT AS rank, b.orders AS bid_orders, b.shares AS bid_shares, printf('%d.%04d', b.price // 10000, b.price % 10000) AS bid, printf('%d.%04d', a.price // 10000, a.price % 10000) AS ask, a.shares AS ask_shares, a.orders AS ask_orders FROM b FULL JOIN a ON a.locate = b.locate AND a.rank = b.rank")
def book_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best levels of both sides beside each other, as a live view shows them."""
    ranked = book.top_levels(final_levels(spark, sf_dir), 5)
    side = lambda s, name: ranked.where(F.col("side") == s).select("locate", "rank", F.col("orders").alias(f"{name}_orders"), F.col("shares").alias(f"{name}_shares"), show.price(F.col("price")).alias(name))
    return side("B", "bid").join(side("S", "ask"), ["locate", "rank"], "full_outer")


@query(f"WITH {MESSAGES_SQL}, m AS (SELECT type, count(*) AS n, (count(*) * 1000000 // sum(count(*)) OVER ())::BIGINT AS s FROM msg GROUP BY type) SELECT printf('%s %12d %7.3f%%', type, n, s / 10000) AS value FROM m")
def message_mix_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.message_mix_lines(message_mix(spark, sf_dir))


@query(f"""WITH {EFFECTS_SQL}, {_LEVELS}, top AS ({_TOP} FROM lv GROUP BY locate), t AS (SELECT n_name AS symbol, top.* FROM top JOIN nation ON n_nationkey + 1 = locate)
SELECT printf('%-10s %12s %14s %14s %12s %6d %6d', symbol, coalesce(bid_shares::VARCHAR, '-'), coalesce(printf('%d.%04d', bid_price // 10000, bid_price % 10000), '-'), coalesce(printf('%d.%04d', ask_price // 10000, ask_price % 10000), '-'), coalesce(ask_shares::VARCHAR, '-'), bid_levels, ask_levels) AS value FROM t""")
def top_of_book_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_of_book_lines(top_of_book(spark, sf_dir))


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) SELECT event_type, n FROM c ORDER BY n DESC, event_type LIMIT 1")
def majority_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent kind of event; of equal ones the first by name."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = sorted(r[0] for r in events.select("event_type").distinct().collect())
    return publish.majority(events, "event_type", names)


@query(f"WITH {_VALUES}, c AS (SELECT event_type, bucket, sum(count) OVER (PARTITION BY event_type ORDER BY bucket) AS seen, sum(count) OVER (PARTITION BY event_type) AS n FROM hist) SELECT event_type, bucket, round(-log10(greatest(1 - seen / n, 1e-7)) * 1000)::BIGINT AS thousandths FROM c")
def latency_nines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nines of the values lie up to each bucket, at most seven."""
    return reports.nines(latency_cdf(spark, sf_dir)).select("event_type", "bucket", F.round(F.col("nines") * 1000).cast("long").alias("thousandths"))


_BOUND = "CASE WHEN bucket < 32 THEN bucket ELSE (32 + bucket % 32) << (bucket // 32 - 1) END"


@query(f"WITH {_VALUES} SELECT 1 AS run, event_type AS label, 1 AS median, 'total' AS metric, ({_BOUND})::DOUBLE AS bucket_lo_ns, (CASE WHEN bucket < 32 THEN bucket + 1 ELSE ({_BOUND}) + (1::BIGINT << (bucket // 32 - 1)) END)::DOUBLE AS bucket_hi_ns, count FROM hist")
def histogram_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a histogram file, written as CSV and read again."""
    rows = reports.histogram_table(latency_histogram(spark, sf_dir).select(F.lit(1).alias("run"), F.col("event_type").alias("label"), F.lit(True).alias("median"), F.lit("total").alias("metric"), "bucket", "count"))
    path = f"{shared_dir(spark)}/histogram-{uuid.uuid4().hex}"
    reports.csv_options(rows.write).csv(path)
    return spark.read.csv(path, header=True, schema=rows.schema, quote='"', escape='"')


@query(f"""WITH {_CELLS}, t AS (SELECT (user_id % 18 // 2)::INT AS run, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT run, sum(n)::BIGINT AS messages, coalesce(sum(n) FILTER (event_type = 'click'), 0)::BIGINT AS count_click, coalesce(sum(n) FILTER (event_type = 'view'), 0)::BIGINT AS count_view, coalesce(sum(n) FILTER (event_type NOT IN ('click', 'view')), 0)::BIGINT AS count_other FROM t GROUP BY run""")
def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row a run: a count a type that is known, and the count of others."""
    runs = _runs(spark, sf_dir)
    totals = runs.groupBy("run").agg(F.sum("messages").alias("messages"))
    return reports.run_table(totals, runs.select("run", F.col("queue").alias("type"), F.col("messages").alias("n")), ["click", "view"]).select("run", "messages", "count_click", "count_view", "count_other")


@query(f"""WITH {_CELLS} SELECT '{{"queue":"' || queue || '","pinned":' || pinned || ',"run":' || run || ',"messages":' || messages || ',"passed":' || passed || '}}' AS value FROM runs""")
def run_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as JSON objects."""
    return reports.one_json(_runs(spark, sf_dir).select("queue", "pinned", "run", "messages", "passed"))


@query(f"WITH {_CELLS} SELECT queue, pinned, run, messages, passed FROM runs")
def reread_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written as files and read again."""
    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    run_json(spark, sf_dir).write.text(path)
    return reports.read_reports(spark, path).select("queue", F.col("pinned").cast("int").alias("pinned"), F.col("run").cast("int").alias("run"), "messages", "passed")


@query(f"WITH {_CELLS} SELECT queue, count(*) AS lines, sum(messages)::DOUBLE AS total FROM runs GROUP BY queue")
def scanned_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers found in the lines of logs, one log a queue."""
    runs, folder = _runs(spark, sf_dir), f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    line = F.format_string("run %d: replayed %,d msgs in 3 s", "run", "messages")
    runs.select("queue", line.alias("value")).write.partitionBy("queue").text(folder)
    found = spark.read.text(folder).select("queue", F.regexp_extract("value", r"replayed ([\d,]+) msgs", 1).alias("x"))
    return found.groupBy("queue").agg(F.count("*").alias("lines"), F.sum(F.regexp_replace("x", ",", "").cast("double")).alias("total"))


@query(f"{hash_sql().rsplit('SELECT mark', 1)[0]}SELECT mark AS book_msgs, mark = max(mark) OVER () AS final, lpad(lower(hex((sum(level_hash::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT)), 16, '0') AS level_digest FROM h2d GROUP BY mark")
def checkpoint_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints written as a text file and read again."""
    rows = level_hash_checkpoint(spark, sf_dir).select("book_msgs", F.col("book_hash").alias("level_digest"), F.lit("0" * 16).alias("order_hash"))
    path = f"{shared_dir(spark)}/checkpoints-{uuid.uuid4().hex}"
    verify.write_checkpoints(rows, path, "adapter", EVERY)
    return verify.read_checkpoints(spark, path).select("book_msgs", "final", "level_digest")


@query(f"WITH {MESSAGES_SQL}, cp AS (SELECT DISTINCT ceil(seq / {EVERY})::BIGINT AS k FROM msg), x AS (SELECT k, k % 4 = 3 AS differs FROM cp) SELECT count(*) AS \"left\", count(*) AS \"right\", count(*) FILTER (differs) AS differing, min(k * {EVERY}) FILTER (differs) AS first_difference, NOT bool_or(differs) AS passed FROM x")
def checkpoint_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' checkpoints compared, of which every fourth of one is spoilt."""
    rows = messages(spark, sf_dir).select(F.ceil(F.col("seq") / EVERY).cast("long").alias("k")).distinct().select((F.col("k") * EVERY).alias("book_msgs"), F.hex("k").alias("level_digest"), F.hex(F.col("k") + 1).alias("order_hash"))
    spoilt = rows.withColumn("order_hash", F.when((F.col("book_msgs") / EVERY).cast("long") % 4 == 3, "0").otherwise(F.col("order_hash")))
    return verify.compare(rows, spoilt)


@query(f"""WITH {PACKETS_SQL}, {_GONE}, {_ISLANDS}, g AS (SELECT line, "from" * 10 AS a, "to" * 10 AS b, "from" % 9 AS down FROM isl),
w AS (SELECT *, (SELECT coalesce(sum(least(1000000, 2000 << k)), 0) FROM range(0, 6) r(k) WHERE k < least(down, 6)) AS waited FROM g)
SELECT line, a AS "from", b AS "to", CASE WHEN b - a > 25 OR down >= 6 THEN 'snapshot' ELSE 'rerequest' END AS cause, (CASE WHEN b - a > 25 THEN 0 WHEN down >= 6 THEN 6 ELSE down + 1 END)::INT AS rounds, (CASE WHEN b - a > 25 THEN 0 ELSE waited END)::BIGINT AS waited_ns FROM w""")
def recovery_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each line's gaps are closed if the server is down for some rounds: rounds, time waited, snapshots."""
    gaps = line_gaps(spark, sf_dir).select("line", (F.col("from") * 10).alias("from"), (F.col("to") * 10).alias("to"), (F.col("from") % 9).cast("int").alias("down_rounds"))
    return recovery.plan_recovery(gaps, 25, 6, 2_000, 1_000_000).select("line", "from", "to", "cause", "rounds", "waited_ns")


_REQUESTS = "SELECT user_id AS client, event_id * 1000003 AS arrival, event_id * 37 % 1200 AS seq, CASE WHEN event_id % 23 = 0 THEN 0 WHEN event_id % 29 = 0 THEN 65535 ELSE event_id % 90 END AS cnt, event_id AS next_seq FROM events"


@query(f"""WITH RECURSIVE r AS ({_REQUESTS}), good AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY arrival) AS n FROM r WHERE cnt <> 0 AND cnt <> 65535),
walk AS (SELECT client, arrival, n, true AS allowed, 2.0::DOUBLE - 1 AS tokens FROM good WHERE n = 1
  UNION ALL SELECT g.client, g.arrival, g.n, t.held >= 1, t.held - (t.held >= 1)::INT FROM walk w JOIN good g ON g.client = w.client AND g.n = w.n + 1, LATERAL (SELECT least(2.0::DOUBLE, w.tokens + (g.arrival - w.arrival) * 1e-9::DOUBLE * 5.0::DOUBLE) AS held) t),
o AS (SELECT r.*, CASE WHEN cnt = 0 OR cnt = 65535 THEN 'bad' WHEN NOT allowed THEN 'rate_limited' WHEN seq = 0 OR seq >= next_seq THEN 'unpublished' WHEN next_seq - seq > 5000 THEN 'retention' WHEN cnt > 64 THEN 'trimmed' ELSE 'served' END AS outcome FROM r LEFT JOIN walk USING (client, arrival))
SELECT outcome, count(*) AS n, sum(CASE WHEN outcome IN ('trimmed', 'served') THEN least(least(cnt, 64), next_seq - seq) ELSE 0 END)::BIGINT AS granted FROM o GROUP BY outcome""")
def served_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a server with a token bucket a client makes of all requests."""
    e = F.col("event_id")
    count = F.when(e % 23 == 0, 0).when(e % 29 == 0, 65535).otherwise(e % 90).cast("long")
    requests = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("client"), (e * 1000003).alias("arrival"), (e * 37 % 1200).alias("seq"), count.alias("count"), e.alias("next_seq"))
    return recovery.server_counters(recovery.serve(requests, 2.0, 5.0, 5000, 64))
