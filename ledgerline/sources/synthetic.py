"""A seeded feed of odd events: unknown references, crossed replaces, overfills, types the book ignores."""

from __future__ import annotations

import random

from ledgerline.sources.feed import encode


def synthetic_feed(events: int, seed: int = 42, stocks: int = 16, wide: bool = False) -> bytes:
    r = random.Random(seed)
    out = [encode("R", k, k, symbol=f"S{k:03d}") for k in range(1, stocks + 1)]
    middle = [r.randrange(100_000, 2_000_000) // 100 * 100 for _ in range(stocks + 1)]
    live: list[tuple[int, int, str, int]] = []
    ref, ts = 0, 34_200_000_000_000
    for _ in range(events):
        ts += r.randrange(1, 50_000)
        roll, k = r.randrange(1000), r.randrange(1, stocks + 1)
        middle[k] = max(20_000, middle[k] + r.choice((-100, 0, 0, 100)))
        if roll < 330 or not live:
            side = r.choice("BS")
            away = 100 * r.randrange(1, 12)
            if wide and r.random() < 0.1:
                away = r.choice((51_200, 25, middle[k] // 2))
            price = max(1, middle[k] - away if side == "B" else middle[k] + away)
            shares = 100 * r.randrange(1, 9)
            ref += 1
            live.append((ref, k, side, shares))
            out.append(encode(r.choice("AAAAAAAAAF"), ts, k, ref=ref, side=side, shares=shares, price=price))
            continue
        i = r.randrange(len(live))
        old, stock, side, shares = live[i]
        if roll < 450:
            n = r.randrange(1, shares + 50)
            out.append(encode("C" if roll >= 420 else "E", ts, stock, ref=old, shares=n, price=middle[stock]))
            if n >= shares:
                live.pop(i)
            else:
                live[i] = (old, stock, side, shares - n)
        elif roll < 560:
            n = r.randrange(1, max(2, shares))
            out.append(encode("X", ts, stock, ref=old, shares=n))
            if n >= shares:
                live.pop(i)
            else:
                live[i] = (old, stock, side, shares - n)
        elif roll < 820:
            out.append(encode("D", ts, stock, ref=old))
            live.pop(i)
        elif roll < 960:
            ref += 1
            lean = -1 if (side == "B") != (r.random() < 0.1) else 1
            n = 100 * r.randrange(1, 9)
            out.append(encode("U", ts, stock, ref=old, new_ref=ref, shares=n, price=max(1, middle[stock] + lean * 100 * r.randrange(1, 9))))
            live[i] = (ref, stock, side, n)
        elif roll < 995:
            out.append(encode(r.choice("PIQ"), ts, stock, length=44))
        else:
            out.append(encode("D", ts, stock, ref=10_000_000 + roll))
    return b"".join(out)
