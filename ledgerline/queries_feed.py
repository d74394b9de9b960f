"""Queries that start from the binary feed: written from the adapter's stream, decoded, resolved, replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.u64 import unsigned, wrapped_hex
from ledgerline.operators import book
from ledgerline.plans import feed_path
from ledgerline.plans.adapter import MESSAGES_SQL
from ledgerline.plans.effects import EFFECTS_SQL, deltas
from ledgerline.queries import EVERY, _LEVELS, hash_sql
from ledgerline.registry import query
from ledgerline.sources.feed import decode_columns, encode_columns, feed_index, parse_counts, read_feed, truncated

#: The adapter's messages with the references they address; directory messages come before all of them.
WIRE_SQL = f"""{MESSAGES_SQL}, added AS (SELECT *, min(CASE WHEN type = 'A' THEN seq END) OVER (PARTITION BY root) AS add_seq, max(locate) OVER (PARTITION BY root) AS own FROM msg),
soon AS (SELECT *, add_seq IS NULL OR seq < add_seq AS early FROM added),
counted AS (SELECT *, count(CASE WHEN type = 'U' AND NOT early THEN 1 END) OVER b AS late, count(CASE WHEN type = 'U' AND early THEN 1 END) OVER b AS sooner FROM soon WINDOW b AS (PARTITION BY root ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wire AS (SELECT seq + (SELECT count(*) FROM nation) AS seq, CASE WHEN type = 'A' AND root % 10 = 3 THEN 'F' ELSE type END AS type, coalesce(own, 0) AS locate, side, price, shares, root * {feed_path.REFS} + CASE WHEN early THEN 0 ELSE late END AS ref,
  CASE WHEN type = 'U' THEN root * {feed_path.REFS} + CASE WHEN early THEN {feed_path.EARLY} + sooner ELSE late + 1 END END AS new_ref FROM counted)"""
_SIZE = "CASE type WHEN 'A' THEN 36 WHEN 'F' THEN 40 WHEN 'E' THEN 31 WHEN 'C' THEN 36 WHEN 'X' THEN 23 WHEN 'D' THEN 19 WHEN 'U' THEN 35 ELSE 39 END"
_FRAMES = f"{WIRE_SQL}, frame AS (SELECT type FROM wire UNION ALL SELECT 'R' FROM nation)"


@query(f"WITH {_FRAMES} SELECT count(*) AS messages, sum(2 + {_SIZE})::BIGINT AS bytes FROM frame")
def feed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and bytes of the feed's files, as the index finds them."""
    index = feed_index(spark, feed_path.feed_files(spark, sf_dir))
    return index.agg(F.sum("frames").alias("messages"), F.sum(F.col("stop") - F.col("start")).alias("bytes"))


@query(f"WITH {_FRAMES} SELECT count(*) AS messages, sum(2 + {_SIZE})::BIGINT AS bytes, count(*) FILTER ({_SIZE} < CASE type WHEN 'R' THEN 39 ELSE 19 END) AS malformed, bool_or({_SIZE} IS NULL) AS truncated FROM frame")
def feed_parse_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a parse of the files counts: frames, bytes, those too short for their type, and whether a file is cut off."""
    paths = feed_path.feed_files(spark, sf_dir)
    ends = truncated(spark, paths).agg(F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"))
    return parse_counts(spark, paths).agg(*(F.sum(c).alias(c) for c in ("messages", "bytes", "malformed"))).crossJoin(ends)  # one row each


@query(f"WITH {_FRAMES} SELECT type, count(*) AS n FROM frame GROUP BY type")
def feed_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_path.decoded(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {_FRAMES} SELECT type, count(*) AS frames, count(*) AS equal FROM frame GROUP BY type")
def feed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by type, and those that are the same bytes when their columns are written again."""

    def again(batches):
        for batch in batches:
            yield decode_columns(encode_columns(batch), 1)

    source = read_feed(spark, feed_path.feed_files(spark, sf_dir))
    columns = [c for c in source.columns if c != "seq"]
    copy = source.mapInArrow(again, source.schema)
    n = source.groupBy(*columns).agg(F.count("*").alias("n")).unionByName(copy.groupBy(*columns).agg((-F.count("*")).alias("n")))
    odd = n.groupBy(*columns).agg(F.sum("n").alias("n")).groupBy("type").agg(F.sum(F.abs("n")).alias("odd"))
    return source.groupBy("type").agg(F.count("*").alias("frames")).join(odd, "type").select("type", "frames", (F.col("frames") - F.col("odd")).alias("equal"))


@query(f"WITH {WIRE_SQL} SELECT lpad(lower(hex((sum(xor(ref::UBIGINT, coalesce(shares, 0)::UBIGINT)::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT)), 16, '0') AS checksum, count(*) AS messages FROM wire WHERE type <> 'D'")
def scan_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wrapping sum of reference xor shares over all messages with shares."""
    rows = feed_path.decoded(spark, sf_dir).where("type NOT IN ('R', 'D')")
    return rows.agg(wrapped_hex(F.sum(unsigned(F.col("ref").bitwiseXOR(F.col("shares"))))).alias("checksum"), F.count("*").alias("messages"))


@query(f"WITH {_FRAMES}, twice AS (SELECT type, count(*) AS n FROM frame GROUP BY type) SELECT count(*) AS types, (SELECT count(*) FROM (SELECT * FROM twice EXCEPT ALL SELECT type, count(*) FROM frame GROUP BY type)) AS differing FROM twice")
def repeat_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes over the files give the same counts."""
    counts = lambda: read_feed(spark, feed_path.feed_files(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))
    both = book.differences(counts(), counts(), ["type"], ["n"])
    return counts().agg(F.count("*").alias("types")).crossJoin(both.agg(F.count("*").alias("differing")))  # one row each


@query(f"""WITH RECURSIVE {WIRE_SQL}, link AS (SELECT new_ref AS ref, ref AS parent FROM wire WHERE type = 'U'),
chain AS (SELECT ref, parent, parent AS root, 1 AS steps FROM link UNION ALL SELECT c.ref, l.parent, l.parent, c.steps + 1 FROM chain c JOIN link l ON l.ref = c.parent)
SELECT ref, arg_max(root, steps) AS root FROM chain GROUP BY ref""")
def replace_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reference of every replacing reference's chain, found by pointer jumping."""
    return feed_path.decoded(spark, sf_dir).where("type = 'U'").select(F.col("new_ref").alias("ref"), "root")


@query(f"WITH {EFFECTS_SQL}, {_LEVELS} SELECT * FROM lv")
def feed_final_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price levels by the relational plan, from the files."""
    return book.levels(deltas(feed_path.feed_effects(spark, sf_dir)))


@query(f"WITH {EFFECTS_SQL}, {_LEVELS} SELECT * FROM lv")
def feed_fold_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the message-by-message fold of each locate."""
    return feed_path.fold_book(feed_path.decoded(spark, sf_dir))[0]


_COUNTS = """count(*) FILTER (type = 'A') AS adds, count(*) FILTER (type IN ('E', 'C')) AS executes, count(*) FILTER (type = 'X') AS cancels, count(*) FILTER (type = 'D') AS deletes, count(*) FILTER (type = 'U') AS replaces,
  (SELECT count(*) FROM nation) AS directory, count(*) FILTER (outcome = 'unknown') AS unknown_ref, count(*) FILTER (outcome = 'overfill') AS overfill,
  (SELECT count(*) - count(DISTINCT born) FROM (SELECT ref AS born FROM wire WHERE type IN ('A', 'F') UNION ALL SELECT new_ref FROM wire WHERE type = 'U')) AS duplicate_ref,
  count(*) FILTER (outcome = 'add') - count(*) FILTER (outcome IN ('removed', 'overfill')) AS live_orders"""
_BOTH_SQL = WIRE_SQL.split(MESSAGES_SQL, 1)[1]


@query(f"WITH {EFFECTS_SQL}{_BOTH_SQL} SELECT {_COUNTS} FROM fx")
def feed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of the book but its peak, by the relational plan."""
    msgs = feed_path.decoded(spark, sf_dir)
    born = msgs.where("type IN ('A', 'F')").select("ref").unionByName(msgs.where("type = 'U'").select(F.col("new_ref").alias("ref")))
    more = msgs.agg(F.count_if(F.col("type") == "R").alias("directory")).crossJoin(born.groupBy("ref").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_ref")))  # one row each
    return book.counters(feed_path.feed_effects(spark, sf_dir)).crossJoin(more).select("adds", "executes", "cancels", "deletes", "replaces", "directory", "unknown_ref", "overfill", "duplicate_ref", "live_orders")


@query(f"WITH {EFFECTS_SQL}{_BOTH_SQL} SELECT {_COUNTS} FROM fx")
def feed_fold_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, added up over the folds."""
    names = ["adds", "executes", "cancels", "deletes", "replaces", "directory", "unknown_ref", "overfill", "duplicate_ref", "live_orders"]
    return feed_path.fold_book(feed_path.decoded(spark, sf_dir))[1].agg(*(F.sum(c).alias(c) for c in names))


@query(hash_sql(25))
def feed_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book hash at every EVERY-th frame of the feed, its 25 directory messages included."""
    return book.book_hashes(deltas(feed_path.feed_effects(spark, sf_dir)), EVERY)


@query()
def feed_digest_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest chain and order hash of the whole feed at every EVERY-th message; sequential, so without SQL."""
    return feed_path.global_checkpoints(feed_path.decoded(spark, sf_dir), EVERY)
