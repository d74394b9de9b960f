"""The book as a stateful stream keyed by locate: orders and levels in state, changed top levels out.

A batch touches only the references its messages name and the levels those orders are at. Input: locate, seq, kind,
ref, side, price, shares, new_ref (modifies carry their order's locate). Output, once a batch and locate if the
top levels differ from those last sent: locate, seq, messages, publish_seq, bids, asks (arrays of price, shares,
orders; best first).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerline.operators.fold import Book

DEPTH = 5
_LEVELS = "array<struct<price: long, shares: long, orders: long>>"
OUTPUT = f"locate int, seq long, messages long, publish_seq long, bids {_LEVELS}, asks {_LEVELS}"


def best(levels: dict[tuple[str, int], tuple[int, int]], side: str, n: int = DEPTH) -> list[tuple[int, int, int]]:
    """(price, shares, orders) of the best levels of a side."""
    rows = sorted((p, s, o) for (d, p), (o, s) in levels.items() if d == side)
    return rows[::-1][:n] if side == "B" else rows[:n]


def top(book: Book, locate: int, side: str, n: int = DEPTH) -> list[tuple[int, int, int]]:
    """The same of a whole book."""
    return best({(d, p): v for (k, d, p), v in book.levels().items() if k == locate}, side, n)


class Ladder:
    """Levels of one stock, changed by messages; orders are looked up one by one.

    ``orders`` maps references to (side, price, shares) and ``levels`` (side, price) to (orders, shares).
    """

    def __init__(self, orders, levels: dict[tuple[str, int], tuple[int, int]]) -> None:
        self.orders, self.levels = orders, levels

    def _move(self, side: str, price: int, orders: int, shares: int) -> None:
        n, total = self.levels.get((side, price), (0, 0))
        if n + orders:
            self.levels[side, price] = n + orders, total + shares
        else:
            self.levels.pop((side, price), None)

    def _drop(self, ref: int) -> tuple[str, int, int] | None:
        if (order := self.orders.get(ref)) is not None:
            self.orders[ref] = None
            self._move(order[0], order[1], -1, -order[2])
        return order

    def _add(self, ref: int, side: str, price: int, shares: int) -> None:
        self._drop(ref)
        self.orders[ref] = side, price, shares
        self._move(side, price, 1, shares)

    def apply(self, kind: str, ref: int, side: str | None, price: int | None, shares: int | None, new_ref: int | None) -> None:
        if kind in "AF":
            self._add(ref, side, price, shares)
        elif kind == "U":
            if order := self._drop(ref):
                self._add(new_ref, order[0], price, shares)
        elif (order := self.orders.get(ref)) is not None:
            if kind == "D" or shares >= order[2]:
                self._drop(ref)
            else:
                self.orders[ref] = order[0], order[1], order[2] - shares
                self._move(order[0], order[1], 0, -shares)


class _Looked(dict):
    """Orders by reference, read from state when first asked for; None marks one that isn't there."""

    def __init__(self, state) -> None:
        super().__init__()
        self.state, self.before = state, {}

    def get(self, ref: int):
        if ref not in self:
            self.before[ref] = tuple(self.state.getValue((ref,))) if self.state.containsKey((ref,)) else None
            super().__setitem__(ref, self.before[ref])
        return self[ref]

    def flush(self) -> None:
        for ref, now in self.items():
            was = self.before.get(ref)
            if now is None and was is not None:
                self.state.removeKey((ref,))
            elif now is not None and now != was:
                self.state.updateValue((ref,), now)


class BookProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.orders = handle.getMapState("orders", "ref long", "side string, price long, shares long")
        self.levels = handle.getMapState("levels", "side string, price long", "orders long, shares long")
        self.sent = handle.getValueState("sent", "messages long, publish_seq long, top string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (locate,) = key
        messages, published, shown = self.sent.get() if self.sent.exists() else (0, 0, None)
        before = {(k[0], k[1]): (v[0], v[1]) for k, v in self.levels.iterator()}
        ladder, last = Ladder(_Looked(self.orders), dict(before)), 0
        number = lambda x: None if pd.isna(x) else int(x)
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            ladder.apply(r.kind, int(r.ref), r.side, number(r.price), number(r.shares), number(r.new_ref))
            messages, last = messages + 1, int(r.seq)
        ladder.orders.flush()
        for k in before.keys() - ladder.levels.keys():
            self.levels.removeKey(k)
        for k, v in ladder.levels.items():
            if before.get(k) != v:
                self.levels.updateValue(k, v)
        bids, asks = best(ladder.levels, "B"), best(ladder.levels, "S")
        now = repr((bids, asks))
        published += now != shown
        self.sent.update((messages, published, now))
        named = lambda side: [{"price": p, "shares": s, "orders": o} for p, s, o in side]
        yield pd.DataFrame([(locate, last, messages, published, named(bids), named(asks))] if now != shown else [], columns=["locate", "seq", "messages", "publish_seq", "bids", "asks"])

    def close(self) -> None:
        pass


def book_stream(messages: DataFrame) -> DataFrame:
    return messages.groupBy("locate").transformWithStateInPandas(BookProcessor(), OUTPUT, "Append", "None")
