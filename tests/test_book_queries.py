"""Every query with SQL against DuckDB, and the relational plan against the ordered fold."""

from pathlib import Path

import duckdb
import pytest

from ledgerline.functions import show, u64
from ledgerline.operators import book, latency
from ledgerline.operators.fold import Book, locate_digests, replay
from ledgerline.operators.prefix import numbered, running
from ledgerline.operators.verify import compare, read_checkpoints, write_checkpoints
from ledgerline.plans.adapter import messages
from ledgerline.plans.effects import deltas, staged_effects
from ledgerline.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    return sorted((tuple(round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert df.count() > 0
        return
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert plain(map(tuple, df.select(*columns).collect())) == plain(want)


@pytest.fixture(scope="module")
def replayed(spark):
    """The adapted stream, message by message."""
    b, states = Book(), []
    current: dict[int, int] = {}
    for r in messages(spark, SF).orderBy("seq").collect():
        ref = r.root * 1000 + current.get(r.root, 0)
        alive = ref in b.orders
        b.apply(r.type, ref, r.locate, r.side, r.price, r.shares, ref + 1)
        if r.type == "U" and alive:
            current[r.root] = current.get(r.root, 0) + 1
        states.append(b.hash)
    return b, states


def test_relational_book_equals_the_fold(spark, replayed):
    b, states = replayed
    found = {(r.locate, r.side, r.price): (r.orders, r.shares) for r in QUERIES["final_levels"](spark, SF).collect()}
    assert found == b.levels()
    c = QUERIES["book_counters"](spark, SF).first()
    assert all(c[k] == b.count[k] for k in ("adds", "executes", "cancels", "deletes", "replaces", "unknown_ref", "overfill", "live_orders", "peak_live_orders"))
    hashes = {r.book_msgs: r.book_hash for r in book.book_hashes(deltas(staged_effects(spark, SF)), 500).collect()}
    assert len(hashes) > 5 and all(h == f"{states[min(n, len(states)) - 1]:016x}" for n, h in hashes.items())
    queue = {r.root: (r.idx, r.shares_ahead) for r in QUERIES["queue_position"](spark, SF).collect()}
    assert queue == {ref // 1000: b.position(ref) for ref in b.orders}


def test_a_broken_effect_is_reported(spark):
    levels, live = QUERIES["final_levels"](spark, SF), book.live_orders(staged_effects(spark, SF))
    wrong = live.withColumn("shares", live.shares + (live.root == live.agg({"root": "max"}).first()[0]).cast("int"))
    assert {r.check: r.violations for r in book.invariants(wrong, levels).collect()}["levels_match_orders"] == 1


def test_running_totals_over_chunks(spark):
    rows = [(k % 3, (k * 37) % 501, k % 11 - 5) for k in range(500)]
    got = {(r.g, r.n): (r.s, r.m) for r in running(spark.createDataFrame(rows, "g int, n long, v long"), ["g"], ["n"], {"s": ("sum", book.F.col("v")), "m": ("max", book.F.col("v"))}, chunk=40).collect()}
    for g in range(3):
        total, top = 0, -99
        for _, n, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            total, top = total + v, max(top, v)
            assert got[g, n] == (total, top)


def test_numbering_follows_the_order(spark):
    rows = [(k * 7919 % 1000, k) for k in range(1000)]
    out = numbered(spark.createDataFrame(rows, "a long, b long"), ["a", "b"]).collect()
    assert [r.seq for r in sorted(out, key=lambda r: (r.a, r.b))] == list(range(1, 1001))
    assert numbered(spark.createDataFrame([], "a long"), ["a"]).count() == 0


def test_hash_functions(spark):
    assert u64.mix(0) == 0xE220A8397B1DCDAF
    df = spark.createDataFrame([(3, "B", 1000000, 500, 2), (3, "S", 4294967000, 1, 0)], "locate int, side string, price long, shares long, orders long")
    got = [r[0] % 2**64 for r in df.select(u64.level_hash("locate", "side", "price", "shares", "orders")).collect()]
    assert got == [u64.level_hash_of(3, "B", 1000000, 500, 2), 0]


def test_histogram_rules(spark):
    df = spark.createDataFrame([(v, "x") for v in range(1, 2001)], "v long, k string")
    hist = latency.histogram(df, ["k"], "v")
    for r in latency.percentiles(hist, ["k"], [0.0, 0.5, 0.99, 1.0]).collect():
        exact = int(r.q_millionths / 1e6 * 1999) + 1
        assert exact <= r.value <= exact * 33 / 32 + 1 and r.value <= 2000
    b = spark.range(0, 200000, 7).select("id", latency.bucket(book.F.col("id")).alias("b"))
    assert b.where((latency.lower_bound(book.F.col("b")) > book.F.col("id")) | (latency.upper_bound(book.F.col("b")) <= book.F.col("id"))).isEmpty()
    assert spark.range(1).select(latency.bucket(book.F.lit(2**62))).first()[0] == latency.BUCKETS - 1


def test_checkpoint_files(spark, tmp_path):
    steps = list(replay([("A", k, 1, "B", 100 + k, 10) for k in range(10)], 4))
    df = spark.createDataFrame(steps, "book_msgs long, level_digest string, order_hash string")
    write_checkpoints(df, str(tmp_path / "c"), "day", 4)
    back = read_checkpoints(spark, str(tmp_path / "c"))
    assert compare(df, back).first().passed and back.where("final").first().book_msgs == 10
    off = compare(df, back.replace(steps[1][1], "0" * 16, "level_digest")).first()
    assert (off.passed, off.first_difference) == (False, 8)


def test_digests_at_every_checkpoint(spark):
    msgs, fx = messages(spark, SF), staged_effects(spark, SF)
    sizes = {r.locate: r["count"] for r in fx.where("locate IS NOT NULL").groupBy("locate").count().collect()}
    got = locate_digests(msgs, fx, 10).collect()
    want = {(k, n) for k, size in sizes.items() for n in [*range(10, size, 10), size]}
    assert len(got) == len(want) > len(sizes) and {(r.locate, r.messages) for r in got} == want
    last = {r.locate: (r.messages, r.digest, r.order_hash) for r in locate_digests(msgs, fx, 0).collect()}
    assert {r.locate: (r.messages, r.digest, r.order_hash) for r in got if r.messages == sizes[r.locate]} == last


def test_formats(spark):
    F = book.F
    row = spark.range(1).select(show.price(F.lit(1234501)), show.clock(F.lit(34_200_123_456_789), True), show.parse_clock(F.lit("09:30:00")), show.parse_clock(F.lit("9h")), show.duration(F.lit(1500)), show.symbol(F.lit("AB \0 "))).first()
    assert tuple(row) == ("123.4501", "09:30:00.123", 34_200_000_000_000, None, "1.50 us", "AB")
