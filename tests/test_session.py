"""A receiver's session under loss: each scenario ends with the golden book, or says why it could not."""

import pytest

from ledgerline.operators import snapshot
from ledgerline.operators.fold import Book
from ledgerline.operators.packets import END, HEARTBEAT
from ledgerline.operators.publisher import ENDS, Loss, fill, publish
from ledgerline.sources.feed import frames, parse
from ledgerline.sources.synthetic import synthetic_feed
from ledgerline.streaming.arbiter import SNAPSHOT, Arbiter, Recovery
from ledgerline.streaming.session import Follower, Servers, run_session

FEED = synthetic_feed(20_000, 21, 24)
BODIES = [b for _, b in frames(FEED)]
EVERY = 2048
SEEDS = pytest.mark.parametrize("seed", [1, 2, 3])


def run(loss, recovery=Recovery(), **more):
    return run_session(BODIES, loss, EVERY, recovery, **more)


def whole(r):
    assert r.passed and r.stop_reason == "end of session" and r.messages + 0 <= len(BODIES), r
    return r


def test_clean_run_sees_every_packet_twice():
    r = whole(run(Loss()))
    packets = sum(1 for _ in fill(BODIES))
    assert r.counters["gaps"] == 0 and packets - 4 <= r.counters["duplicates"] <= packets and r.counters["messages"] == len(BODIES)


def test_capture_is_the_stream_byte_for_byte():
    r = whole(run(Loss(seed=5, drop=(0.05, 0.0), duplicate=0.02, delay=0.02)))
    assert r.captured == BODIES and b"".join(len(b).to_bytes(2, "big") + b for b in r.captured) == FEED


@SEEDS
def test_one_lossy_line_needs_no_request(seed):
    assert whole(run(Loss(seed, drop=(0.01, 0.0)))).requests == 0


@SEEDS
def test_two_lossy_lines_need_no_snapshot(seed):
    assert whole(run(Loss(seed, drop=(0.01, 0.01)))).snapshots == 0


@SEEDS
def test_the_same_packets_lost_on_both_lines_are_requested(seed):
    r = whole(run(Loss(seed, both=0.01)))
    assert r.requests > 0 and r.causes["rerequest"] > 0 and r.snapshots == 0 and r.counters["packets_recovery"] > 0


@SEEDS
def test_a_burst_takes_many_requests(seed):
    r = whole(run(Loss(seed, ranges=((2, 150, 300),))))
    assert r.requests >= 10 and r.skipped == 0


@SEEDS
def test_a_gap_larger_than_the_buffer_is_recovered_whole(seed):
    r = whole(run(Loss(seed, ranges=((2, 100, 200),)), most=16))
    assert r.counters["overflow"] > 0 and r.skipped == 0 and r.counters["messages"] == len(BODIES)


@SEEDS
def test_duplicates_and_reordering(seed):
    r = whole(run(Loss(seed, delay=0.05, duplicate=0.05, drop=(0.002, 0.002))))
    assert r.counters["messages"] == len(BODIES)


@SEEDS
def test_a_server_that_is_down_for_a_while(seed):
    r = whole(run(Loss(seed, ranges=((2, 150, 170),)), servers=Servers(down_until=30_000)))
    assert r.retries > 0 and r.causes == {"rerequest": 1}


@SEEDS
def test_beyond_retention_a_snapshot_is_used(seed):
    r = whole(run(Loss(seed, ranges=((2, 100, 150),)), servers=Servers(retention=1_000)))
    assert r.snapshots >= 1 and r.causes["snapshot"] == 1


@SEEDS
def test_a_late_join_takes_one_snapshot(seed):
    r = whole(run(Loss(seed, ranges=((2, 0, 300),)), recovery=Recovery(threshold=5_000)))
    assert r.snapshots == 1 and r.skipped > 0 and r.matched > 0


@SEEDS
def test_line_a_dies(seed):
    r = whole(run(Loss(seed, dead_from=(150, None), drop=(0.0, 0.003))))
    assert r.counters["packets_a"] == 150


@SEEDS
def test_what_cannot_be_recovered_stops_with_a_reason(seed):
    r = run(Loss(seed, ranges=((2, 100, 110),)), servers=Servers(down_until=None, snapshots=False))
    assert not r.complete and r.stop_reason == "gap not recovered within the recovery timeout" and not r.final_match and r.invariants


def test_stop_reasons_without_recovery():
    assert run(Loss(ranges=((2, 100, 110),)), recovery=None).stop_reason == "idle with an unfilled gap"
    assert run_session([], Loss(dead_from=(0, 0))).stop_reason == "no packet arrived"
    assert run(Loss(dead_from=(300, 300))).stop_reason == "idle before end of session"


def test_a_snapshot_restores_book_and_digest():
    a, b = Follower(EVERY), Follower(EVERY)
    for seq, body in enumerate(BODIES[:9000], 1):
        a.apply(seq, body)
    b.apply(1, BODIES[0])
    b.load(a.take())
    assert b.state() == a.state() and b.book.levels() == a.book.levels() and b.book.symbols == a.book.symbols and b.book.is_sound()
    for seq, body in enumerate(BODIES[9000:], 9001):
        a.apply(seq, body)
        b.apply(seq, body)
    assert b.state() == a.state() and {k: v for k, v in a.checkpoints.items() if k >= 9000} == b.checkpoints
    b.book.clear()
    assert not b.book.levels() and b.book.hash == 0 and b.book.is_sound()
    assert [snapshot.target(*x) for x in ((5, 9, 20), (15, 9, 20), (30, 9, 20))] == [9, 15, 20]


def test_snapshot_tables(spark, tmp_path):
    book = Book()
    for r in parse(FEED)[0][:4000]:
        book.apply(r["type"], r.get("ref"), r["locate"], r.get("side"), r.get("price"), r.get("shares"), r.get("new_ref"), r.get("symbol"))
    orders = [(*level, ref, book.orders[ref][3], k) for level in book.queues for k, ref in enumerate(book.queues[level])]
    live = spark.createDataFrame(orders, "locate int, side string, price long, ref long, shares long, arrival long")
    for seq in (1000, 4000):
        snapshot.write_snapshot(live, seq, str(tmp_path / "snaps"))
    found = snapshot.fetch_snapshot(spark, str(tmp_path / "snaps"), 1001)
    assert {r.seq for r in found.select("seq").distinct().collect()} == {4000} and snapshot.fetch_snapshot(spark, str(tmp_path / "snaps"), 4001) is None
    again = Book()
    rows = sorted(snapshot.as_adds(found).collect(), key=lambda r: (r.locate, r.side, r.price, r.arrival))
    for r in rows:
        again.restore(r.ref, r.locate, r.side, r.price, r.shares)
    assert again.order_hash() == book.order_hash() and again.levels() == book.levels()


def test_publisher_rules():
    sent, log = publish(BODIES[:3000], Loss(3, dead_from=(40, None), ranges=((1, 5, 9),), delay=0.2, duplicate=0.1))
    assert {(p, line) for p, _, _, line, a in log if a == "drop"} == {(p, 0) for p in range(40, max(x[0] for x in log) + 1)} | {(p, 1) for p in range(5, 9)}
    ends = [x for x in sent if x[3] == END]
    assert len(ends) == ENDS and {x[1] for x in ends} == {1} and {x[2] for x in ends} == {3001} and sum(x[3] == HEARTBEAT for x in sent) == 1
    per_line = [[x[2] for x in sent if x[1] == 1 and x[3] not in (END, HEARTBEAT)]]
    late = [k for k, (a, b) in enumerate(zip(per_line[0], per_line[0][1:])) if b < a]
    assert late and all(per_line[0][k + 1] < per_line[0][k] for k in late)
    again, _ = publish(BODIES[:3000], Loss(3, dead_from=(40, None), ranges=((1, 5, 9),), delay=0.2, duplicate=0.1))
    assert again == sent and publish(BODIES[:3000], Loss(4, delay=0.2))[0] != publish(BODIES[:3000], Loss(3, delay=0.2))[0]
    burst = [p for p, _, _, line, a in publish(BODIES, Loss(2, burst=0.01, burst_packets=5))[1] if line == 0 and a == "drop"]
    runs = [b - a for a, b in zip(burst, burst[1:])]
    assert len(burst) >= 5 and runs.count(1) >= len(burst) // 2


def test_arbiter_rules():
    a = Arbiter({}, most=2, window=100)
    a.packet("s", 0, 1, 1, 3, [b"a", b"b", b"c"])
    a.packet("s", 1, 2, 1, 3, [b"a", b"b", b"c"])  # whole duplicate
    a.packet("s", 1, 3, 3, 2, [b"c", b"d"])  # overlap
    a.packet("x", 1, 4, 5, 1, [b"e"])  # another session
    a.packet("s", 1, 5, 9, 5, [b"i"])  # malformed
    a.packet("s", 0, 6, 7, 1, [b"g"])
    a.packet("s", 1, 7, 7, 2, [b"g", b"h"])  # reaches further
    a.packet("s", 0, 8, 10, 1, [b"j"])
    a.packet("s", 0, 9, 12, 1, [b"l"])  # no room
    a.packet("s", 0, 9, 500, 1, [b"z"])  # outside the window
    assert a.gap_end() == 501 and a.expected == 5 and a.opened == 6
    a.packet("s", 2, 10, 5, 2, [b"e", b"f"])
    assert a.expected == 9 and {k: v for k, v in a.count.items() if v} == {"packets_a": 5, "packets_b": 4, "packets_recovery": 1, "applied": 4, "messages": 8, "duplicates": 1, "overlaps": 1, "buffered": 2, "buffer_dups": 1, "overflow": 2, "bad_session": 1, "malformed": 1, "gaps": 1}
    a.packet("s", 2, 11, 11, SNAPSHOT, [])
    assert a.count["stale"] == 1 and a.count["resets"] == 1 and a.expected == 11
    a.packet("s", 2, 12, 5, SNAPSHOT, [])  # behind: changes nothing
    assert a.expected == 11 and not a.done()
    a.packet("s", 0, 13, 13, HEARTBEAT, [])
    a.packet("s", 0, 14, 13, END, [])
    a.packet("s", 2, 15, 11, 490, [bytes([k % 256]) for k in range(490)])
    assert a.done() and a.out[-1][0] == "complete" and [x[7] for x in a.out if x[0] == "gap"] == ["snapshot"]


@pytest.mark.parametrize("most", [None, 1, 10])
def test_in_order_packets_need_no_room(most):
    a = Arbiter({}, most=most)
    a.packet("s", 0, 1, 1, 100, [bytes([k]) for k in range(100)])
    assert a.expected == 101 and a.count["messages"] == 100
