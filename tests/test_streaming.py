"""Arbitration and the book as streams: any cut into batches gives what one pass gives."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.arguments import drop_range, endpoint
from ledgerline.operators.fold import Book
from ledgerline.operators.packets import pack
from ledgerline.sinks.capture import write_bodies
from ledgerline.sources import capture
from ledgerline.sources.feed import frames, parse
from ledgerline.sources.synthetic import synthetic_feed
from ledgerline.streaming.arbiter import INPUT, SNAPSHOT, Arbiter, arbitrate, merged
from ledgerline.streaming.book import Ladder, book_stream, top


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def run(spark, tmp_path, batches, schema, plan, name):
    folder = tmp_path / name
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        q = plan(spark.readStream.schema(schema).parquet(str(folder / "in"))).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
    return spark.read.parquet(str(folder / "out"))


def traffic(seed, n=60):
    """Packets of two lossy, reordered lines, and what both lost, later."""
    r = random.Random(seed)
    out, at, seq = [], 0, 1
    while seq <= n:
        count = r.randrange(1, 5)
        bodies = [bytes([k % 256]) for k in range(seq, seq + count)]
        lost = [r.random() < 0.3, r.random() < 0.3]
        for line in (0, 1):
            if not lost[line]:
                out.append(("s", line, at + r.randrange(0, 40), seq, count, bodies))
        if all(lost):
            out.append(("s", 2, at + 100, seq, count, bodies))
        at, seq = at + 10, seq + count
    out.append(("s", 0, at + 200, seq, 0, []))
    return sorted(out, key=lambda p: (p[2], p[1], p[3])), seq - 1


@pytest.mark.parametrize("seed", range(30))
def test_each_message_once_in_order(seed):
    packets, n = traffic(seed)
    a = Arbiter({})
    for p in packets:
        a.packet(*p)
    got = [(m[2], m[6]) for m in a.out if m[0] == "message"]
    assert got == [(k, bytes([k % 256])) for k in range(1, n + 1)] and a.opened is None and not a.waiting


def test_snapshot_moves_on_and_late_copies_are_dropped():
    a = Arbiter({})
    a.packet("s", 0, 1, 10, 2, [b"a", b"b"])
    assert a.opened == 1 and not a.out
    a.packet("s", 2, 5, 11, SNAPSHOT, [])
    assert [m[:4] for m in a.out] == [("snapshot", "s", 1, 11), ("message", "s", 11, 12), ("gap", "s", 1, 5)]
    a.packet("s", 1, 6, 9, 3, [b"x", b"a", b"b"])
    assert len(a.out) == 3 and a.expected == 12


def test_arbiter_stream(rocks, tmp_path):
    packets, n = traffic(3)
    third = len(packets) // 3
    out = run(rocks, tmp_path, [packets[:third], packets[third : 2 * third], packets[2 * third :]], INPUT, arbitrate, "arbiter")
    got = sorted((r.seq, bytes(r.body)) for r in out.where("kind = 'message'").collect())
    assert got == [(k, bytes([k % 256])) for k in range(1, n + 1)]


@pytest.mark.parametrize("seed", range(6))
def test_ladder_equals_the_book(seed):
    """Levels changed by reference alone equal those of the whole book, odd references included."""
    b, ladders = Book(), {}
    rows = [r for r in parse(synthetic_feed(3000, seed, 3, wide=seed % 2 == 1))[0] if r["type"] != "R"]
    for r in [*rows, *rows[:40]]:  # some references twice
        values = [r.get(c) for c in ("side", "price", "shares", "new_ref")]
        b.apply(r["type"], r["ref"], r["locate"], *values)
        ladders.setdefault(r["locate"], Ladder({}, {})).apply(r["type"], r["ref"], *values)
    for k, ladder in ladders.items():
        assert ladder.levels == {(d, p): v for (locate, d, p), v in b.levels().items() if locate == k}


def test_capture_stream(spark, tmp_path):
    """Frames of two lines in capture files, read as a table and as a stream, merge into the messages that were sent."""
    feed = synthetic_feed(600, 5, 3)
    bodies = [body for _, body in frames(feed)]
    packets = list(pack(bodies, "DAY1", 1, 300))
    frame = lambda data, port: bytes(12) + b"\x08\x00" + struct.pack(">BBHHHBBH", 0x45, 0, 28 + len(data), 0, 0, 1, 17, 0) + bytes(8) + struct.pack(">HHHH", 1, port, 8 + len(data), 0) + data
    lines = [[(10**18 + 1000 * k + port, frame(p, port)) for k, p in enumerate(packets) if (k + port) % 7] for port in (26400, 26401)]
    mixed = sorted(lines[0] + lines[1] + [(5, b"junk"), (6, frame(b"short", 26400)), (7, frame(packets[0], 9))])
    folder = tmp_path / "captures"
    folder.mkdir()
    half = len(mixed) // 2
    capture.write_capture(str(folder / "a"), mixed[:half])
    capture.write_capture(str(folder / "b"), [(at // 1000 * 1000, f) for at, f in mixed[half:]], nanos=False, order=">")
    (folder / "b").write_bytes((folder / "b").read_bytes() + b"cut off")
    table = capture.read_captures(spark, [str(folder / "a"), str(folder / "b")])
    assert table.count() == len(mixed) and [bytes(r.frame) for r in table.where("capture = 0").orderBy("rx_ns").collect()] == [f for _, f in sorted(mixed[:half], key=lambda x: x[0])]
    ports = {26400: 0, 26401: 1}
    out = merged(capture.received(table, ports)).where("kind = 'message'")
    assert sorted((r.seq, bytes(r.body)) for r in out.collect()) == list(enumerate(bodies, 1))
    files = write_bodies(out.select("seq", "body"), str(tmp_path / "again"))
    assert b"".join(open(f, "rb").read() for f in files) == feed
    spark.dataSource.register(capture.CaptureSource)
    q = spark.readStream.format("ledger_capture").option("path", str(folder)).load().writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert spark.table("frames").count() == len(mixed)
    finally:
        q.stop()


def test_arguments(spark):
    rows = spark.createDataFrame([("host:80", "5-9"), (":1", "5-9:a"), ("*:70000", "7-8:ab"), ("nowhere", "x-2"), ("1.2.3.4:65535", "1-1:b")], "e string, r string")
    got = [(r.e and tuple(r.e), r.r and tuple(r.r)) for r in rows.select(endpoint(F.col("e")).alias("e"), drop_range(F.col("r")).alias("r")).collect()]
    assert got == [(("host", 80), (5, 9, True, True)), (("0.0.0.0", 1), (5, 9, True, False)), (None, (7, 8, True, True)), (None, None), (("1.2.3.4", 65535), (1, 1, False, True))]


def test_book_stream(rocks, tmp_path):
    schema = "locate int, seq long, kind string, ref long, side string, price long, shares long, new_ref long"
    b, rows = Book(), []
    for k, r in enumerate(parse(synthetic_feed(500, 9, 3))[0]):
        if r["type"] == "R":
            continue
        rows.append((r["locate"], k, r["type"], r["ref"], r.get("side"), r.get("price"), r.get("shares"), r.get("new_ref")))
        b.apply(r["type"], r["ref"], r["locate"], r.get("side"), r.get("price"), r.get("shares"), r.get("new_ref"))
    out = run(rocks, tmp_path, [rows[:200], rows[200:]], schema, book_stream, "book")
    last = {r.locate: r for r in out.orderBy("seq").collect()}
    assert set(last) == {1, 2, 3}
    assert all(([tuple(x) for x in r.bids], [tuple(x) for x in r.asks]) == (top(b, k, "B"), top(b, k, "S")) for k, r in last.items())
    assert out.groupBy("locate").agg(F.max("publish_seq").alias("a"), F.count("*").alias("b")).where("a <> b").isEmpty()
