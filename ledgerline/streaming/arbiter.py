"""Redundant lines merged in order, as a stateful stream keyed by session.

Each message is delivered once, in sequence. A packet that reaches past what is expected is delivered at
once from there on; one that starts later waits in state; what is late or already there is counted and dropped.
A heartbeat or an end of session only raises the highest known sequence; a snapshot row moves on to its
sequence. While something is missing, ``Recovery`` asks for it: after a wait for the other line re-requests go
out in rounds that wait twice as long each, and a gap that is too wide or out of rounds asks for a snapshot.
Time is the packets' arrival, so any cut into batches gives the same rows.

Input: session, line, arrival, seq, count, bodies. ``count`` -1 marks a snapshot that makes everything
before ``seq`` known. Output: kind (message, gap, snapshot, request, fetch, complete), session, seq, upto, line, arrival,
body, cause. A gap row runs from its opening to its closing time, and its cause is what closed it: the other line, a
re-request or a snapshot.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerline.operators.packets import END, HEARTBEAT

INPUT = "session string, line int, arrival long, seq long, count int, bodies array<binary>"
OUTPUT = "kind string, session string, seq long, upto long, line int, arrival long, body binary, cause string"
SNAPSHOT = -1
#: Packets of the lines and of recovery, control packets, what became of data packets, and what went wrong.
COUNTERS = "packets_a packets_b packets_recovery heartbeats ends applied messages duplicates overlaps buffered buffer_dups overflow stale bad_session malformed gaps resets".split()


@dataclass
class Recovery:
    """When to ask for what is missing. Times in the unit of the packets' arrival."""

    gap_wait: int = 500
    first_wait: int = 2_000
    most_wait: int = 1_000_000
    retries: int = 6
    threshold: int = 1_000_000
    # State: the end of the range asked for, the round, when it is over, what was expected at its start.
    asked: int = 0
    round: int = 0
    due: int = 0
    at: int = 0
    fetching: bool = False
    used: bool = False  # asked at all since the gap opened

    def clear(self) -> None:
        self.asked = self.round = self.due = self.at = 0
        self.fetching = self.used = False

    def tick(self, now: int, arbiter: Arbiter) -> list[tuple[str, int, int]]:
        """``(request | fetch, from, to)`` that fall due now."""
        if arbiter.opened is None:
            self.clear()
            return []
        if self.fetching:
            return []
        expected = arbiter.expected
        if self.asked <= expected:  # nothing is outstanding
            if now - arbiter.opened < self.gap_wait:
                return []
            upto = arbiter.gap_end()
            if upto - expected > self.threshold:
                return self._fetch(expected, upto)
            self.asked, self.round = upto, 0
        elif now < self.due:
            return []
        elif expected > self.at:  # progress: the rounds start anew
            self.round = 0
        else:
            self.round += 1
            if self.round > self.retries:
                return self._fetch(expected, self.asked)
        self.due, self.at, self.used = now + min(self.most_wait, self.first_wait << self.round), expected, True
        return [("request", expected, self.asked)]

    def _fetch(self, expected: int, upto: int) -> list[tuple[str, int, int]]:
        self.fetching = True
        return [("fetch", expected, upto)]


class Arbiter:
    """The rules alone. ``waiting`` is any mapping of a packet's sequence to (line, arrival, bodies).

    At most ``most`` packets wait, and none that starts ``window`` or more after what is expected; what doesn't
    fit is counted, and recovered with the rest of the gap.
    """

    def __init__(self, waiting, expected: int = 1, highest: int = 1, opened: int | None = None, end: int = 0, overflowed: bool = False, session: str | None = None, most: int | None = None, window: int | None = None, recovery: Recovery | None = None, count: dict | None = None) -> None:
        self.waiting, self.expected, self.highest, self.opened, self.end, self.overflowed, self.session = waiting, expected, highest, opened, end, overflowed, session
        self.most, self.window, self.recovery = most, window, recovery
        self.count = dict.fromkeys(COUNTERS, 0) | (count or {})
        self.starts = sorted(waiting)
        self.reset_in_gap = self.complete = False
        self.out: list[tuple] = []

    def packet(self, session: str, line: int, arrival: int, seq: int, count: int, bodies) -> None:
        if self.session is None:
            self.session = session
        if session != self.session:
            self.count["bad_session"] += 1
            return
        if count == SNAPSHOT:
            self.reset(line, arrival, seq)
        else:
            self.count[("packets_a", "packets_b", "packets_recovery")[min(line, 2)]] += 1
            if count == HEARTBEAT:
                self.count["heartbeats"] += 1
                self._seen(seq)
            elif count == END:
                self.count["ends"] += 1
                self.end = seq
                self._seen(seq)
            elif count != len(bodies):
                self.count["malformed"] += 1
            else:
                self._data(line, arrival, seq, [bytes(b) for b in bodies])
        self._track(line, arrival)
        self.tick(arrival)

    def reset(self, line: int, arrival: int, seq: int) -> None:
        """A snapshot makes everything before ``seq`` known; one that is behind changes nothing."""
        self.count["resets"] += 1
        if self.recovery:
            self.recovery.fetching = False
        if seq > self.expected:
            self.out.append(("snapshot", self.session, self.expected, seq, line, arrival, None, None))
            self.expected, self.reset_in_gap = seq, True
        self._seen(self.expected)
        self._drain()

    def tick(self, now: int) -> None:
        for kind, a, b in self.recovery.tick(now, self) if self.recovery else ():
            self.out.append((kind, self.session, a, b, None, now, None, None))
        if not self.complete and self.done():
            self.complete = True
            self.out.append(("complete", self.session, self.expected, self.end, None, now, None, None))

    def done(self) -> bool:
        return 0 < self.end <= self.expected

    def gap_end(self) -> int:
        """Where what is missing from ``expected`` on ends: at the next waiting packet, or at the highest known sequence
        if none waits or some did not fit."""
        return self.highest if self.overflowed else min([k for k in self.waiting if k > self.expected], default=self.highest)

    def _seen(self, seq: int) -> None:
        self.highest = max(self.highest, seq)

    def _data(self, line: int, arrival: int, seq: int, bodies: list[bytes]) -> None:
        end = seq + len(bodies)
        self._seen(end)
        if end <= self.expected:
            self.count["duplicates"] += 1
        elif seq <= self.expected:
            self.count["overlaps"] += seq < self.expected
            self._deliver(line, arrival, seq, bodies)
            self._drain()
        elif seq in self.waiting:
            self.count["buffer_dups"] += 1
            if len(bodies) > len(self.waiting[seq][2]):  # the lines may pack differently: keep what reaches further
                self.waiting[seq] = (line, arrival, bodies)
        elif self.most is not None and len(self.waiting) >= self.most or self.window is not None and seq >= self.expected + self.window:
            self.count["overflow"] += 1
            self.overflowed = True
        else:
            self.count["buffered"] += 1
            self.waiting[seq] = (line, arrival, bodies)
            heapq.heappush(self.starts, seq)

    def _deliver(self, line: int, arrival: int, seq: int, bodies: list[bytes]) -> None:
        fresh = bodies[self.expected - seq :]
        for k, body in enumerate(fresh, self.expected):
            self.out.append(("message", self.session, k, k + 1, line, arrival, body, None))
        self.expected += len(fresh)
        self.count["messages"] += len(fresh)
        self.count["applied"] += 1

    def _drain(self) -> None:
        while self.starts and self.starts[0] <= self.expected:
            seq = heapq.heappop(self.starts)
            line, arrival, bodies = self.waiting[seq]
            del self.waiting[seq]
            if seq + len(bodies) > self.expected:
                self._deliver(line, arrival, seq, bodies)
            else:
                self.count["stale"] += 1

    def _track(self, line: int, arrival: int) -> None:
        if self.highest > self.expected:
            if self.opened is None:
                self.opened = arrival
                self.count["gaps"] += 1
        elif self.opened is not None:
            cause = "snapshot" if self.reset_in_gap else "rerequest" if self.recovery and self.recovery.used else "other line"
            self.out.append(("gap", self.session, self.opened, arrival, line, arrival, None, cause))
            self.opened, self.overflowed, self.reset_in_gap = None, False, False


_AT = "expected long, highest long, opened long, end_ long, overflowed boolean, reset_in_gap boolean, complete boolean, counters array<long>, asked long, round long, due long, at long, fetching boolean, used boolean"


class ArbiterProcessor(StatefulProcessor):
    def __init__(self, most: int | None = None, window: int | None = None, recovery: Recovery | None = None) -> None:
        self.most, self.window, self.recovery = most, window, recovery

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", _AT)
        self.waiting = handle.getMapState("waiting", "seq long", "line int, arrival long, bodies array<binary>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.at.get() if self.at.exists() else None
        before = {k[0]: (v[0], v[1], [bytes(b) for b in v[2]]) for k, v in self.waiting.iterator()}
        settings = astuple(self.recovery)[:5] if self.recovery else ()
        recovery = Recovery(*settings, *(held[8:] if held else ())) if self.recovery else None
        arbiter = Arbiter(dict(before), *(held[:5] if held else ()), session=key[0], most=self.most, window=self.window, recovery=recovery, count=dict(zip(COUNTERS, held[7])) if held else None)
        if held:
            arbiter.reset_in_gap, arbiter.complete = held[5], held[6]
        for r in pd.concat(list(rows)).sort_values(["arrival", "line", "seq"], kind="stable").itertuples():
            arbiter.packet(r.session, int(r.line), int(r.arrival), int(r.seq), int(r.count_), r.bodies if r.bodies is not None else [])
        for k in before.keys() - arbiter.waiting.keys():
            self.waiting.removeKey((k,))
        for k, v in arbiter.waiting.items():
            if before.get(k) != v:
                self.waiting.updateValue((k,), v)
        state = astuple(recovery)[5:] if recovery else (0, 0, 0, 0, False, False)
        self.at.update((arbiter.expected, arbiter.highest, arbiter.opened, arbiter.end, arbiter.overflowed, arbiter.reset_in_gap, arbiter.complete, [arbiter.count[c] for c in COUNTERS], *state))
        yield pd.DataFrame(arbiter.out, columns=["kind", "session", "seq", "upto", "line", "arrival", "body", "cause"]).astype({"line": "Int32"})

    def close(self) -> None:
        pass


def arbitrate(packets: DataFrame, most: int | None = None, window: int | None = None, recovery: Recovery | None = None) -> DataFrame:
    """Rows of OUTPUT from a stream of packets; needs the RocksDB state store."""
    return packets.withColumnRenamed("count", "count_").groupBy("session").transformWithStateInPandas(ArbiterProcessor(most, window, recovery), OUTPUT, "Append", "None")


def _play(pdf: pd.DataFrame, most: int | None, window: int | None, recovery: Recovery | None = None) -> Arbiter:
    arbiter = Arbiter({}, most=most, window=window, recovery=replace(recovery) if recovery else None)
    for r in pdf.sort_values(["arrival", "line", "seq"], kind="stable").itertuples():
        arbiter.packet(r.session, int(r.line), int(r.arrival), int(r.seq), int(r.count_), r.bodies if r.bodies is not None else [])
    return arbiter


def merged(packets: DataFrame, most: int | None = None, window: int | None = None, recovery: Recovery | None = None) -> DataFrame:
    """Rows of OUTPUT from a table of packets; a session is one group."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pd.DataFrame(_play(pdf, most, window, recovery).out, columns=["kind", "session", "seq", "upto", "line", "arrival", "body", "cause"])
        return rows.astype({"line": "Int32"})

    return packets.withColumnRenamed("count", "count_").groupBy("session").applyInPandas(fold, OUTPUT)


def counted(packets: DataFrame, most: int | None = None, window: int | None = None) -> DataFrame:
    """``session`` and the COUNTERS of a table of packets, one row a session."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"session": pdf.session.iloc[0], **_play(pdf, most, window).count}])

    schema = "session string, " + ", ".join(f"{c} long" for c in COUNTERS)
    return packets.withColumnRenamed("count", "count_").groupBy("session").applyInPandas(fold, schema)
