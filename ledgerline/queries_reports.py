"""Queries over runs, histograms and samples: what the report layer shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import show
from ledgerline.operators import book, latency, reporting
from ledgerline.plans.effects import EFFECTS_SQL, deltas, staged_effects
from ledgerline.queries import _VALUES, _values, latency_histogram
from ledgerline.registry import query

#: Runs of cells: the kind of event by the part of its user; what passed and what was clean follow from counts.
_CELLS = """cells AS (SELECT event_type AS queue, (user_id % 2)::INT AS pinned, (user_id % 18 // 2)::INT AS run, count(*) AS messages, sum(floor(abs(coalesce(value, 0)) * 1000))::BIGINT AS ns FROM events GROUP BY ALL),
runs AS (SELECT *, messages % 7 <> 0 AS passed, messages % 5 <> 0 AS clean FROM cells)"""
CELL = ["queue", "pinned"]


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    cells = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("queue"), (u % 2).cast("int").alias("pinned"), F.floor(u % 18 / 2).cast("int").alias("run"))
    found = cells.agg(F.count("*").alias("messages"), F.sum(F.floor(F.abs(F.coalesce("value", F.lit(0.0))) * 1000)).cast("long").alias("ns"))
    return found.withColumns({"passed": F.col("messages") % 7 != 0, "clean": F.col("messages") % 5 != 0})


@query(f"WITH {_CELLS} SELECT queue, pinned, median(messages) FILTER (clean) AS median, count(*) FILTER (clean) AS clean_runs, bool_and(passed) AS all_passed FROM runs GROUP BY queue, pinned")
def clean_run_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.clean_medians(_runs(spark, sf_dir), CELL, "messages", "passed", "clean")


@query(f"WITH {_CELLS} SELECT queue, pinned, min(messages) AS least_messages, max(messages) AS largest_messages, min(ns) AS least_ns, max(ns) AS largest_ns FROM runs GROUP BY queue, pinned")
def cell_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.ranges(_runs(spark, sf_dir), CELL, ["messages", "ns"])


@query(f"WITH {_CELLS} SELECT max(n) AS most_runs, count(*) AS cells FROM (SELECT count(*) AS n FROM runs GROUP BY queue, pinned)")
def runs_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.most_runs(_runs(spark, sf_dir), CELL)


@query(f"WITH {_CELLS} SELECT * FROM runs WHERE queue = (SELECT min(event_type) FROM events) AND pinned = 1")
def cell_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of one cell: every setting equal."""
    runs = _runs(spark, sf_dir)
    first = runs.agg(F.min("queue")).first()[0]
    return reporting.select_cell(runs, queue=first, pinned=1)


@query(f"""WITH {_CELLS}, {_VALUES}, middle AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY queue, pinned ORDER BY messages, run) AS r, count(*) OVER (PARTITION BY queue, pinned) AS k FROM runs) WHERE r = k // 2 + 1)
SELECT queue, pinned, run, messages, bucket, count FROM middle JOIN (SELECT event_type, bucket, count FROM hist) h ON event_type = queue""")
def runs_with_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median run of each cell beside the buckets of its queue."""
    middle = latency.median_run(_runs(spark, sf_dir), CELL, "messages", "run").select("queue", "pinned", "run", "messages")
    return reporting.with_histogram(middle, latency_histogram(spark, sf_dir).select(F.col("event_type").alias("queue"), "bucket", "count"), ["queue"])


_ORDER = ["view", "purchase", "click"]


@query(f"WITH {_CELLS} SELECT queue, pinned, run, row_number() OVER (ORDER BY CASE queue WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'click' THEN 3 ELSE 4 END, queue, pinned, run) AS place FROM runs")
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a report in a fixed order of queues, then by name; numbered over the few rows of a report."""
    rank = reporting.display_rank(F.col("queue"), _ORDER)
    return _runs(spark, sf_dir).select("queue", "pinned", "run", F.row_number().over(Window.orderBy(rank, "queue", "pinned", "run")).cast("long").alias("place"))


@query("""WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k, count(*) OVER () AS total FROM events), wanted AS (SELECT DISTINCT i * (SELECT count(*) FROM events) // 100 AS k FROM range(0, 100) r(i))
SELECT event_id FROM n WHERE total <= 100 OR k IN (SELECT k FROM wanted)""")
def even_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most a hundred events, evenly spread."""
    return reporting.even_sample(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"), ["event_id"], 100).select("event_id")


@query(f"""WITH {_VALUES} SELECT event_type, sum(count)::BIGINT AS n, round(sum(total) / sum(count) * 1000)::BIGINT AS mean_thousandths, min(CASE WHEN bucket < 32 THEN bucket ELSE (32 + bucket % 32) << (bucket // 32 - 1) END)::BIGINT AS least, max(top) AS largest FROM hist GROUP BY event_type""")
def histogram_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, least bucket bound and largest value, from histograms alone."""
    out = reporting.histogram_summary(latency_histogram(spark, sf_dir), ["event_type"])
    return out.select("event_type", "n", F.round(F.col("mean") * 1000).cast("long").alias("mean_thousandths"), F.col("least").cast("long").alias("least"), "largest")


@query(f"WITH {_VALUES} SELECT event_type, count(*) FILTER (v % 16 = 0) AS samples, CASE WHEN count(*) FILTER (v % 16 = 0) > 0 THEN round(sum(v) FILTER (v % 16 = 0) / count(*) FILTER (v % 16 = 0) * 1000)::BIGINT ELSE 0 END AS mean_thousandths FROM vals GROUP BY event_type")
def mean_book_ns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean update time over the timed messages; 0 without any."""
    timed = F.col("v") % 16 == 0
    by = _values(spark, sf_dir).groupBy("event_type").agg(F.count_if(timed).alias("samples"), F.sum(F.when(timed, F.col("v"))).alias("total"))
    return by.select("event_type", "samples", F.round(reporting.guarded_mean(F.col("total"), F.col("samples")) * 1000).cast("long").alias("mean_thousandths"))


@query("SELECT event_id, CASE WHEN event_id > 0 AND event_id * 1024 % 1048576 = 0 THEN (event_id * 1024 // 1048576) || 'M' WHEN event_id > 0 THEN event_id || 'K' ELSE '0' END AS capacity, round(event_id * 12.5)::BIGINT AS ns, floor(event_id * 12.5 / 12.5)::BIGINT AS ticks, event_id * 37 // 1000 AS latency_us FROM events")
def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capacities with their letter, ticks to nanoseconds and back, send-to-receive time in microseconds."""
    e, tick = F.col("event_id"), 12.5
    ns = reporting.to_ns(e, tick)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", reporting.capacity(e * 1024).alias("capacity"), F.round(ns).cast("long").alias("ns"), reporting.to_ticks(ns, tick).alias("ticks"), F.expr("event_id * 37 div 1000").alias("latency_us"))


@query("""SELECT event_id, CASE WHEN n < 1000 THEN n || ' ns' WHEN n < 1000000 THEN printf('%.2f us', n / 1e3) WHEN n < 1000000000 THEN printf('%.2f ms', n / 1e6) ELSE printf('%.2f s', n / 1e9) END AS duration FROM (SELECT event_id, event_id * event_id * 128 AS n FROM events)""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nanoseconds in the unit that fits them."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", show.duration(F.col("event_id") * F.col("event_id") * 128).alias("duration"))


@query(f"WITH {EFFECTS_SQL}, state AS (SELECT locate, side, price, seq, sub, sum(d_orders) OVER (PARTITION BY locate, side, price ORDER BY seq, sub) AS now, d_orders FROM delta), moves AS (SELECT locate, seq, sub, CASE WHEN now > 0 AND now - d_orders = 0 THEN 1 WHEN now = 0 THEN -1 ELSE 0 END AS change FROM state), run AS (SELECT locate, sum(change) OVER (PARTITION BY locate ORDER BY seq, sub) AS levels FROM moves) SELECT locate, max(levels)::BIGINT AS peak_levels FROM run GROUP BY locate")
def peak_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most price levels that each book had at a time."""
    from ledgerline.operators.prefix import running

    moved = running(deltas(staged_effects(spark, sf_dir)), book.LEVEL, ["seq", "sub"], {"now": ("sum", F.col("d_orders"))})
    born = (F.col("now") > 0) & (F.col("now") == F.col("d_orders"))
    changes = moved.withColumn("change", F.when(born, 1).when(F.col("now") == 0, -1)).where("change IS NOT NULL").select("locate", "seq", "sub", "change")
    return reporting.peaks(changes, ["locate"], ["seq", "sub"], F.col("change")).select("locate", F.col("peak").cast("long").alias("peak_levels"))


@query("""WITH c AS (SELECT event_type AS name, count(*) % 2 = 0 AS ok FROM events GROUP BY event_type) SELECT bool_and(ok) AS passed, count(*) FILTER (NOT ok) AS failed, min(name) FILTER (NOT ok) AS first_failed FROM c""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("name")).agg((F.count("*") % 2 == 0).alias("ok"))
    return reporting.verdict(checks, "name", "ok")


@query(f"""WITH {_VALUES}, b AS (SELECT event_type, count, greatest(CASE WHEN bucket < 32 THEN bucket ELSE (32 + bucket % 32) << (bucket // 32 - 1) END, 1) AS low FROM hist) SELECT event_type, floor(log10(low::DOUBLE) * 10 + 1e-9)::BIGINT AS bin, sum(count)::BIGINT AS count FROM b GROUP BY ALL""")
def latency_decades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets dealt anew to ten equal steps a decade."""
    from ledgerline.sinks.reports import decades

    return decades(latency_histogram(spark, sf_dir), ["event_type"])
