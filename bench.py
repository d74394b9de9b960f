"""Times headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and the threads.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
QUERIES = ["message_mix", "effects_outcomes", "book_counters", "final_levels", "top_of_book", "book_as_of", "levels_after_each_message", "queue_position", "order_walk", "level_hash_checkpoint", "arbitrated_book", "line_dedup", "gap_episodes", "latency_percentiles"]


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from ledgerline.plans.adapter import messages
    from ledgerline.plans.effects import staged_effects
    from ledgerline.plans.feed_path import decoded, feed_files
    from ledgerline.queries import QUERIES as KNOWN
    from ledgerline.sources.feed import read_feed

    shared = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    done: dict[str, float] = {}

    def timed(name: str, run) -> None:
        began = time.perf_counter()
        run()
        done[name] = round(time.perf_counter() - began, 3)

    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    spark.range(1000).selectExpr("sum(id)").collect()
    timed("stage_messages", lambda: messages(spark, SF_DIR))
    timed("stage_effects", lambda: staged_effects(spark, SF_DIR))
    for name in QUERIES:
        timed(name, lambda name=name: sink(KNOWN[name](spark, SF_DIR)))

    # The same stream as binary files: written, decoded from byte ranges, replace chains resolved, replayed.
    n = messages(spark, SF_DIR).count()
    timed("write_feed", lambda: feed_files(spark, SF_DIR))
    timed("decode_feed", lambda: read_feed(spark, feed_files(spark, SF_DIR)).agg(F.count("*"), F.sum("shares")).collect())
    timed("feed_roots_staged", lambda: decoded(spark, SF_DIR))
    timed("feed_effects_and_levels", lambda: sink(KNOWN["feed_final_levels"](spark, SF_DIR)))
    rates = {"decode_msgs_per_sec": round(n / done["decode_feed"]), "book_msgs_per_sec": round(n / (done["stage_messages"] + done["stage_effects"] + done["final_levels"])), "effects_and_levels_msgs_per_sec": round(n / (done["stage_effects"] + done["final_levels"])), "seconds_per_million": {k: round(v / n * 1e6, 2) for k, v in done.items()}}
    print(json.dumps({"metric": "headline_total", "value": round(sum(done.values()), 3), "unit": "sec", "queries": done, "messages": n, **rates, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
