"""Operator 3: language-model scoring by a hierarchical Pitman-Yor model.

Model. A word depends on the whole word before it: the context restaurant of a token is the previous word (or the
start of the text). Context restaurants share one parent restaurant,
whose base measure is diffuse: its new tables are new words, so what it keeps back is the probability of
an unknown word, and a table a word is all it has. A table of a context restaurant is a customer of the
parent. Discounts are estimated from the counts of counts of all training tokens.

Seating. Buckets are ranges of word hashes whose number follows from the number of tokens, words and contexts are in
order within them, and each is sampled from a seed of its own: however documents are packed into blocks and tasks,
the scores are the same. All contexts of a word are in one bucket, so its customers at the parent are exact there.
A context's words are in many buckets. Every word that follows it has a first table, and their number is added up over
all buckets beforehand; a bucket takes its own further tables in proportion to the customers that may open such, while it
samples. In the end they are added up, too. Customers are seated by the rule, a dish's number doubling at
a time, then each step unseats a random SHARE of the customers of every dish and context, however many, and
seats them anew, in PARTS groups of dishes; those of a group at once, given all others. A block is seated as by a Pitman-Yor process that gives new tables
their weight at its start; a Metropolis step makes up for how the weight changes while tables open. SAMPLES
states after BURN_IN steps, GAP steps apart, are averaged; the predictive distribution of every context
sums to 1 with the unknown word.

Scale. Documents are packed into blocks; blocks and buckets exchange distinct words and pairs (see ``blocks``), buckets
exchange what they know of contexts. What nothing reads any more is deleted on the way.
The driver sees one row of totals, and no words. Words are told apart by 64-bit hashes, a word's contexts by 48 bits.

Cases: a null or empty text is its end alone; a very long text is a block of its own; equal texts get equal scores; a null id counts as the empty id; repeated rows are learned
and scored each; without training tokens every score is 0; extra columns are dropped; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.blocks import bucket_count, crc_fold, edges, pack, to_blocks, unpack
from ledgerline.llm.common import cut, drop, table, utf8

FOLDS_HELD_OUT = 2
BLOCK_CHARS = 12 << 20
#: Contexts of a ``Seating`` at least.
CONTEXTS = 257
STRENGTH, SHARE, PARTS, BURN_IN, SAMPLES, GAP, SEED = 1.0, 0.25, 32, 8, 4, 2, 20
#: Tables of a dish from which its customers are dealt apart from other dishes'.
MANY = 32
#: Buckets follow the number of all tokens, which no packing changes; about so many tokens ask for one key.
TOKENS_PER_KEY = 4
#: Neither is a word; the start comes before the first word and is never scored.
END, START = b"\n", b" "
_SCHEMA = "block long, docs binary, held binary, sizes binary, tokens binary, words binary, start long, stop long, n_tokens long"
_ARROW = pa.schema([("block", pa.int64()), *((n, pa.binary()) for n in "docs held sizes tokens words".split()), *((n, pa.int64()) for n in "start stop n_tokens".split())])


def make_block(number: int, rows: list) -> dict:
    """Tokens as numbers of words, which are sorted by hash; ``start`` and ``stop`` are those of START and END."""
    ids: defaultdict[bytes, int] = defaultdict(count().__next__)
    start, end = ids[START], ids[END]
    parts, sizes = [], []
    for _, text in rows:
        found = utf8(text).lower().split()
        parts += [np.fromiter(map(ids.__getitem__, found), np.int64, len(found)), [end]]
        sizes.append(len(found) + 1)
    words = list(ids)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    held = np.array([crc_fold(i) == FOLDS_HELD_OUT for i, _ in rows])
    return {
        "block": number, "docs": pack(np.array([[i is None, i or 0] for i, _ in rows]), np.int64), "held": pack(held, np.bool_), "sizes": pack(np.array(sizes), np.int32), "tokens": pack(place[np.concatenate(parts)], np.int32),
        "words": pack(hashes[order], np.uint64), "start": int(place[start]), "stop": int(place[end]), "n_tokens": sum(sizes),
    }


def pair_keys(tokens: np.ndarray, sizes: np.ndarray, start: int, n_words: int) -> np.ndarray:
    """Of every token: its word's number times the number of words, plus that of the whole word before it."""
    context = np.empty(len(tokens), np.int64)
    context[1:] = tokens[:-1]
    context[np.cumsum(sizes) - sizes] = start
    return tokens * np.int64(n_words) + context


def _short(hashes: np.ndarray) -> bytes:
    """Numbers below 2^48."""
    return pack(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6], np.uint8)


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((0, 8), np.uint8) if data is None else unpack(data, np.uint8).reshape(-1, 6)
    return np.pad(out, ((0, 0), (0, 8 - out.shape[1]))).view("<u8").ravel().astype(np.uint64)


def _cut_at(contexts: np.ndarray, buckets: int) -> np.ndarray:
    """Where contexts of each bucket begin and end."""
    return edges(contexts << np.uint64(16), buckets)


def _requests(blocks: DataFrame, buckets: int) -> DataFrame:
    """The part of a block's words and pairs that belongs to each bucket."""

    def split(batches):
        for batch in batches:
            for block, words, tokens, sizes, held, start in zip(*(c.to_pylist() for c in batch.columns)):
                w, sizes = unpack(words, np.uint64), unpack(sizes, np.int32).astype(np.int64)
                keys = pair_keys(unpack(tokens, np.int32), sizes, start, len(w)) * 2
                keys += np.repeat(~unpack(held, np.bool_), sizes)
                keys.sort()
                first = np.flatnonzero(np.concatenate(([True], keys[1:] >> 1 != keys[:-1] >> 1)))
                pn, pairs = np.add.reduceat(keys & 1, first), keys[first] >> 1
                pw, pc = pairs // len(w), w[pairs % len(w)] >> np.uint64(16)
                at = edges(w, buckets)
                pair_at = np.searchsorted(pw, at)
                for b in range(buckets):
                    x, y = at[b], at[b + 1]
                    if x < y:
                        p, q = pair_at[b], pair_at[b + 1]
                        yield pa.RecordBatch.from_pydict({"bucket": [b], "block": [block], "words": [pack(w[x:y], np.uint64)], "pair_word": [pack(np.bincount(pw[p:q] - x, minlength=y - x), np.int32)], "pair_context": [_short(pc[p:q])], "pair_count": [pack(pn[p:q], np.int32)]}, schema=_REQUEST)

    return blocks.select("block", "words", "tokens", "sizes", "held", "start").mapInArrow(split, "bucket int, block long, words binary, pair_word binary, pair_context binary, pair_count binary")


_REQUEST = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *((n, pa.binary()) for n in "words pair_word pair_context pair_count".split())])
_MERGED = "bucket int, words binary, contexts binary, pair_word binary, pair_context binary, pair_count binary, asked array<struct<block: long, words: binary, pairs: binary>>, total long, vocabulary long, pairs long, ones long, twos long, parent_ones long, parent_twos long"


def merge_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """All that blocks asked of one bucket: the union of words, contexts and pairs, and where each block's are in it."""
    words = [unpack(x, np.uint64) for x in pdf.words]
    union, where = np.unique(np.concatenate(words), return_inverse=True)
    word_at = np.split(where, np.cumsum([len(w) for w in words])[:-1])
    word = [np.repeat(at, unpack(n, np.int32)) for at, n in zip(word_at, pdf.pair_word)]
    contexts, context = np.unique(np.concatenate([_long(c) for c in pdf.pair_context]), return_inverse=True)
    pairs, where = np.unique(np.concatenate(word) * max(1, len(contexts)) + context, return_inverse=True)
    counts = np.bincount(where, weights=np.concatenate([unpack(x, np.int32) for x in pdf.pair_count]), minlength=len(pairs)).astype(np.int64)
    pair_at = np.split(where, np.cumsum([len(w) for w in word])[:-1])
    pair_word, pair_context = np.divmod(pairs, max(1, len(contexts)))
    seen = np.bincount(pair_word[counts > 0], minlength=len(union))
    asked = [{"block": b, "words": pack(np.diff(w, prepend=0), np.int32), "pairs": pack(np.diff(p, prepend=0), np.int32)} for b, w, p in zip(pdf.block, word_at, pair_at)]
    return pd.DataFrame([{
        "bucket": pdf.bucket.iloc[0], "words": pack(union, np.uint64), "contexts": _short(contexts), "pair_word": pack(np.bincount(pair_word, minlength=len(union)), np.int32), "pair_context": pack(pair_context, np.int32), "pair_count": pack(counts, np.int64), "asked": asked,
        "total": int(counts.sum()), "vocabulary": int((seen > 0).sum()), "pairs": int((counts > 0).sum()), "ones": int((counts == 1).sum()), "twos": int((counts == 2).sum()), "parent_ones": int((seen == 1).sum()), "parent_twos": int((seen == 2).sum()),
    }])


def _known(context: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By context: words that follow it, and customers beyond the first of each."""
    return np.bincount(context[counts > 0], minlength=n), np.bincount(context, weights=np.maximum(counts - 1, 0), minlength=n).astype(np.int64)


def context_totals(merged: DataFrame, buckets: int) -> DataFrame:
    """What ``_known`` gives, over all buckets: for each ``bucket``, of those of its contexts that may have further tables (by the
    context's own bucket ``part``); and first tables of all contexts of a part (``bucket`` null)."""

    def tell(batches):
        for batch in batches:
            for bucket, contexts, context, counts in zip(*(c.to_pylist() for c in batch.columns)):
                contexts = _long(contexts)
                first, more = _known(unpack(context, np.int32), unpack(counts, np.int64), len(contexts))
                live = first > 0
                contexts, first, more = contexts[live], first[live], more[live]
                at = _cut_at(contexts, buckets)
                for part, (x, y) in enumerate(zip(at[:-1], at[1:])):
                    if x < y:
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bucket], pa.int32()), *(pa.array([v], pa.binary()) for v in (_short(contexts[x:y]), pack(first[x:y], np.int32), pack(more[x:y], np.int64)))], names=["part", "bucket", "contexts", "first", "more"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        contexts = [_long(x) for x in pdf.contexts]
        union, where = np.unique(np.concatenate(contexts), return_inverse=True)
        own = [unpack(x, np.int64) for x in pdf.more]
        first, more = (np.bincount(where, weights=np.concatenate(x), minlength=len(union)).astype(np.int64) for x in ([unpack(x, np.int32) for x in pdf["first"]], own))
        part = pdf.part.iloc[0]
        out = [{"bucket": None, "part": part, "contexts": _short(union), "first": pack(first, np.int64), "more": None}]
        for bucket, at, m in zip(pdf.bucket, np.split(where, np.cumsum([len(x) for x in contexts])[:-1]), own):
            at = at[m > 0]
            out.append({"bucket": bucket, "part": part, "contexts": None, "first": pack(first[at], np.int64), "more": pack(more[at], np.int64)})
        return pd.DataFrame(out).astype({"bucket": "Int32"})

    told = merged.select("bucket", "contexts", "pair_context", "pair_count").mapInArrow(tell, "part int, bucket int, contexts binary, first binary, more binary")
    return told.groupBy("part").applyInPandas(add, "bucket int, part int, contexts binary, first binary, more binary")


def _lgamma(x: np.ndarray) -> np.ndarray:
    out, x = np.zeros(len(x)), np.array(x, float)
    for _ in range(8):
        low = x < 8
        out -= np.log(np.where(low, x, 1.0))
        x += low
    return out + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def _rising(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log of x (x + 1) ... (x + n - 1), less n log x."""
    return _lgamma(x + n) - _lgamma(x) - n * np.log(x)


class Seating:
    """Tables of the dishes (word in context) of a bucket, one flat array, those of a dish together."""

    def __init__(self, counts: np.ndarray, word: np.ndarray, context: np.ndarray, n_words: int, discount: float, parent_discount: float, spread: int, seed: int, elsewhere: tuple | None = None) -> None:
        """Of tables elsewhere there are as many as makes ``spread`` times those here; or, with ``elsewhere`` (by context, by word, of
        all), the first of two values plus, but for words, the second times those here."""
        self.counts, self.word, self.context, self.n_words = counts, word, context, n_words
        self.d, self.d0, self.rng = discount, parent_discount, np.random.default_rng(seed)
        self.elsewhere = elsewhere or ((np.zeros(CONTEXTS), np.full(CONTEXTS, spread)), 0, (0, spread))
        self.dish = np.arange(len(counts))  # dish of each table
        self.size = np.minimum(counts, 1)  # the first customer opens a table

    def tables(self) -> np.ndarray:
        return np.bincount(self.dish[self.size > 0], minlength=len(self.counts))

    def _count(self) -> None:
        """Tables by context and by word, and all."""
        t = self.tables()
        context, word, all_ = self.elsewhere
        self.by_context = context[0] + context[1] * np.bincount(self.context, weights=t, minlength=len(context[0]))
        self.by_word = word + np.bincount(self.word, weights=t, minlength=self.n_words)
        self.all = all_[0] + all_[1] * t.sum()

    def _totals(self, at: np.ndarray, gone: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of dishes ``at``, given all tables but those ``gone`` of its own: weight of its context for new tables, customers of its word at the parent less the discount, all customers there."""
        return STRENGTH + self.d * (self.by_context[self.context[at]] - gone), np.maximum(self.by_word[self.word[at]] - gone - self.d0, 0.1), STRENGTH + self.all - gone

    def _seat(self, dish: np.ndarray, size: np.ndarray, more: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``more`` customers a dish join the tables or open new ones, whose weight is ``weight`` and rises by the discount with each.

        Drawn as a whole: the share of all new tables is a beta variable, and so is, in turn, each table's of what
        the tables after it get. Returns the customers that join each table, and dish and size of the new ones.
        """
        n, rng, d = len(more), self.rng, self.d
        held = np.bincount(dish, weights=size - d, minlength=n)
        fresh = np.zeros(n, np.int64)
        some = np.flatnonzero(more > 0)
        fresh[some] = rng.binomial(more[some], rng.beta(weight[some], held[some]))
        joined, rest = np.zeros(len(size), np.int64), more - fresh
        t = np.bincount(dish, minlength=n)
        starts = np.cumsum(t) - t
        for k in np.flatnonzero((rest > 0) & (t > MANY)):
            own = slice(starts[k], starts[k] + t[k])
            share = rng.standard_gamma(size[own] - d)
            joined[own] = rng.multinomial(rest[k], share / share.sum())
        live, rank = np.flatnonzero((rest > 0) & (t <= MANY)), 0
        while len(live):
            at = starts[live] + rank
            own = size[at] - d
            held[live] -= own
            last = t[live] == rank + 1
            part = np.where(last, 1.0, rng.beta(own, np.where(last, 1.0, np.maximum(held[live], 1e-12))))
            joined[at] = rng.binomial(rest[live], part)
            rest[live] -= joined[at]
            live, rank = live[(rest[live] > 0) & ~last], rank + 1
        dishes, sizes, weight = [], [], weight.copy()
        live = np.flatnonzero(fresh)
        while len(live):
            weight[live] += d
            took = 1 + rng.binomial(fresh[live] - 1, rng.beta(1 - d, weight[live]))
            dishes.append(live)
            sizes.append(took)
            fresh[live] -= took
            live = live[fresh[live] > 0]
        none = [np.zeros(0, np.int64)]
        return joined, np.concatenate(dishes or none), np.concatenate(sizes or none)

    def _set(self, dish: np.ndarray, size: np.ndarray) -> None:
        live = size > 0
        dish, size = dish[live], size[live]
        order = np.argsort(dish, kind="stable")
        self.dish, self.size = dish[order], size[order]

    def start(self) -> None:
        seated = np.minimum(self.counts, 1)
        while (seated < self.counts).any():
            self._count()
            context, parent, total = self._totals(np.arange(len(self.counts)))
            more = np.minimum(seated, self.counts - seated)
            joined, dish, size = self._seat(self.dish, self.size, more, context * parent / total)
            self._set(np.concatenate((self.dish, dish)), np.concatenate((self.size + joined, size)))
            seated = seated + more

    def step(self) -> None:
        """A SHARE of all customers is seated anew."""
        self._count()
        part = np.where(self.counts >= 2, self.rng.integers(PARTS, size=len(self.counts)), PARTS)[self.dish]
        order = np.argsort(part, kind="stable")
        dish, size, at = self.dish[order], self.size[order], np.searchsorted(part[order], np.arange(PARTS + 1))
        done = [(dish[at[PARTS] :], size[at[PARTS] :])] + [self._step(dish[a:b], size[a:b]) for a, b in zip(at[:-1], at[1:]) if a < b]
        self._set(*map(np.concatenate, zip(*done)))

    def _step(self, dish: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tables of a group of dishes; one customer of each, chosen evenly, stays; of the others a SHARE leaves and is seated anew."""
        first = np.flatnonzero(np.concatenate(([True], dish[1:] != dish[:-1])))
        dishes, before = dish[first], np.diff(np.append(first, len(dish)))
        n = len(dishes)
        own, place = np.repeat(np.arange(n), before), np.cumsum(size) - size
        free = size.copy()
        free[np.searchsorted(place, place[first] + np.floor(self.rng.random(n) * self.counts[dishes]).astype(np.int64), side="right") - 1] -= 1
        left = size - self.rng.binomial(free, SHARE)
        kept = left > 0
        tables, more = np.bincount(own[kept], minlength=n), np.add.reduceat(size - left, first)
        context, parent, total = self._totals(dishes, before - tables)
        weight = context * parent / total
        joined, new, fresh = self._seat(own[kept], left[kept], more, weight)

        def fit(opened: np.ndarray) -> np.ndarray:
            """log of the weights that the tables opened had, over those they were seated by."""
            return _rising(context[odd] / self.d, opened) + _rising(parent[odd], opened) - _rising(total[odd], opened) - _rising(weight[odd] / self.d, opened)

        opened = np.bincount(new, minlength=n)
        odd = np.flatnonzero(opened != before - tables)  # where as many open as were closed, the weights are equal
        take, drawn = np.ones(n, bool), self.rng.random(n)
        take[odd] = np.log(drawn[odd]) < fit(opened[odd]) - fit((before - tables)[odd])
        change = np.where(take, tables + opened - before, 0)
        np.add.at(self.by_context, self.context[dishes], self.elsewhere[0][1][self.context[dishes]] * change)
        np.add.at(self.by_word, self.word[dishes], change)
        self.all += self.elsewhere[2][1] * change.sum()
        old, again = ~take[own], take[own[kept]]
        return np.concatenate((dish[old], dish[kept][again], dishes[new[take[new]]])), np.concatenate((size[old], (left[kept] + joined)[again], fresh[take[new]]))

    def sample(self) -> np.ndarray:
        """The mean number of tables by dish over the samples."""
        if not len(self.counts):
            return np.zeros(0)
        self.start()
        total = np.zeros(len(self.counts))
        for step in range(1, BURN_IN + SAMPLES * GAP + 1):
            self.step()
            if step > BURN_IN and not (step - BURN_IN) % GAP:
                total += self.tables()
        return total / SAMPLES


def discount(ones: int, twos: int) -> float:
    """Estimate from how many things were seen once and twice."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


_ANSWER = "bucket int, block long, source int, seen binary, customers binary, own binary, contexts binary, more binary, total double"


def seat_buckets(merged: DataFrame, totals: DataFrame, d: float, d0: float, buckets: int, pairs: int, total: int) -> DataFrame:
    """Answers for every block; what contexts have beyond first tables, for their own buckets (``block`` null); and ``total`` tables of a
    bucket (``source`` null, too)."""

    def run(bucket: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        (row,), back = bucket.to_dict("records"), back.sort_values("part")
        contexts, context, counts = _long(row["contexts"]), unpack(row["pair_context"], np.int32), unpack(row["pair_count"], np.int64)
        sizes = unpack(row["pair_word"], np.int32)
        n_words, word = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
        many = np.flatnonzero(counts > 1)  # one customer has a table, whatever is drawn
        open_ = np.flatnonzero(_known(context, counts, len(contexts))[1])
        contexts = contexts[open_]
        tables, more = np.minimum(counts, 1).astype(float), np.zeros(len(open_))
        if len(many):
            place = np.searchsorted(open_, context[many])
            own = _known(place, counts[many], len(open_))
            first, all_more = (np.concatenate([unpack(x, np.int64) for x in back[c]]) for c in ("first", "more"))
            scale, share = all_more / own[1], (total - pairs) / own[1].sum()
            elsewhere = (first - scale * own[0], scale), np.bincount(word[counts == 1], minlength=n_words), (pairs - share * len(many), share)
            tables[many] = Seating(counts[many], word[many], place, n_words, d, d0, buckets, SEED + row["bucket"], elsewhere).sample()
            more = np.bincount(place, weights=tables[many] - 1, minlength=len(open_))
        customers = np.bincount(word, weights=tables, minlength=n_words)
        seen = np.bincount(word, weights=counts, minlength=n_words).astype(np.int64)
        own = counts - d * tables
        out = [{"bucket": row["bucket"], "total": tables.sum()}]
        for a in row["asked"]:
            w, p = np.cumsum(unpack(a["words"], np.int32)), np.cumsum(unpack(a["pairs"], np.int32))
            out.append({"bucket": row["bucket"], "block": a["block"], "seen": pack(seen[w], np.int64), "customers": pack(customers[w], np.float32), "own": pack(own[p], np.float32)})
        at = _cut_at(contexts, buckets)
        out += [{"bucket": part, "source": row["bucket"], "contexts": _short(contexts[x:y]), "more": pack(more[x:y], np.float32)} for part, (x, y) in enumerate(zip(at[:-1], at[1:])) if x < y]
        names = [c.split()[0] for c in _ANSWER.split(", ")]
        return pd.DataFrame({c: pd.array([r.get(c) for r in out], {"block": "Int64", "source": "Int32", "bucket": "Int32", "total": "Float64"}.get(c, object)) for c in names})

    sides = merged.select("bucket", "contexts", "pair_word", "pair_context", "pair_count", "asked"), totals.where("bucket IS NOT NULL").select("bucket", "part", "first", "more")
    return sides[0].groupBy("bucket").cogroup(sides[1].groupBy("bucket")).applyInPandas(run, _ANSWER)


def context_tables(merged: DataFrame, totals: DataFrame, answers: DataFrame) -> DataFrame:
    """``bucket, block, tables``: of a block's words as contexts, all their tables."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        words = unpack(pdf.words.dropna().iloc[0], np.uint64) >> np.uint64(16)
        tables = np.zeros(len(words))
        for x in pdf[pdf["first"].notna()].itertuples():
            tables[np.searchsorted(words, _long(x.contexts))] += unpack(x.first, np.int64)
        for x in pdf[pdf.more.notna()].sort_values("source").itertuples():
            tables[np.searchsorted(words, _long(x.contexts))] += unpack(x.more, np.float32)
        out = [(pdf.bucket.iloc[0], a.block, pack(tables[np.cumsum(unpack(a.asked, np.int32))], np.float32)) for a in pdf[pdf.asked.notna()].itertuples()]
        return pd.DataFrame(out, columns=["bucket", "block", "tables"])

    parts = (
        merged.select("bucket", "words"), merged.select("bucket", F.inline("asked")).select("bucket", "block", F.col("words").alias("asked")),
        totals.where("bucket IS NULL").select(F.col("part").alias("bucket"), "contexts", "first"), answers.where("source IS NOT NULL").select("bucket", "source", "contexts", "more"),
    )
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy("bucket").applyInPandas(add, "bucket int, block long, tables binary")


class Predictive:
    """Averaged predictive probabilities, from totals by context."""

    def __init__(self, total: int, vocabulary: int, d: float, d0: float, by_context: np.ndarray, tables: np.ndarray, all_tables: float | None = None) -> None:
        self.total, self.vocabulary, self.d0 = total, vocabulary, d0
        self.all_tables = tables.sum() if all_tables is None else all_tables
        self.size = STRENGTH + by_context
        self.back = (STRENGTH + d * tables) / self.size  # what a context hands to the parent
        self.unknown = (STRENGTH + d0 * vocabulary) / (STRENGTH + self.all_tables)

    def parent(self, seen: np.ndarray, customers: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, (customers - self.d0) / (STRENGTH + self.all_tables), self.unknown)

    def pairs(self, own: np.ndarray, context: np.ndarray, parent: np.ndarray) -> np.ndarray:
        return own / self.size[context] + self.back[context] * parent

    def base(self, seen: np.ndarray) -> np.ndarray:
        return np.log10((seen + 1) / (self.total + self.vocabulary + 1))


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every document."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = cut(to_blocks(texts, BLOCK_CHARS, make_block, _SCHEMA, _ARROW))
    buckets = bucket_count((blocks.agg(F.sum("n_tokens")).first()[0] or 0) // TOKENS_PER_KEY)
    merged = cut(_requests(blocks, buckets).groupBy("bucket").applyInPandas(merge_bucket, _MERGED))
    sums = merged.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "vocabulary", "pairs", "ones", "twos", "parent_ones", "parent_twos"))).first()
    learned, vocabulary, pairs = sums[:3]
    d, d0 = discount(*sums[3:5]), discount(*sums[5:])
    drop(docs.sparkSession)
    totals = cut(context_totals(merged, buckets))
    answers = cut(seat_buckets(merged, totals, d, d0, buckets, pairs, learned))
    drop(docs.sparkSession)
    tables = cut(context_tables(merged, totals, answers))
    drop(docs.sparkSession, merged, totals)
    all_tables = answers.agg(F.coalesce(F.sum("total"), F.lit(0.0))).first()[0]

    def finish(key: tuple, block: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        block, answer = block.iloc[0], answer.sort_values("bucket")
        join = lambda c, kind: np.concatenate([unpack(x, kind) for x in answer[c].dropna()])
        seen, customers, own, tables = join("seen", np.int64), join("customers", np.float32).astype(float), join("own", np.float32).astype(float), join("tables", np.float32).astype(float)
        tokens, sizes, docs_ = unpack(block.tokens, np.int32), unpack(block.sizes, np.int32).astype(np.int64), unpack(block.docs, np.int64).reshape(-1, 2)
        pairs, token = np.unique(pair_keys(tokens, sizes, block.start, len(seen)), return_inverse=True)
        word, context = np.divmod(pairs, len(seen))
        followed = seen.copy()  # every word is followed by one, every text starts once
        followed[block.start] = seen[block.stop]
        model = Predictive(learned, vocabulary, d, d0, followed, tables, all_tables)
        logs = np.log10(model.pairs(own, context, model.parent(seen, customers)[word]))
        starts = np.cumsum(sizes) - sizes
        total = lambda values: np.add.reduceat(values, starts)
        return pd.DataFrame({
            "doc_id": pd.array([None if n else i for n, i in docs_.tolist()], "Int64"), "held_out": unpack(block.held, np.bool_), "n_tokens": sizes, "n_known": total((seen > 0)[tokens].astype(np.int64)),
            "train_tokens": learned, "base_score": total(model.base(seen)[tokens]), "score": total(logs[token]),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    told = answers.where("block IS NOT NULL").select("bucket", "block", "seen", "customers", "own").unionByName(tables, allowMissingColumns=True)
    sides = blocks.select("block", "docs", "held", "sizes", "tokens", "start", "stop"), told
    return sides[0].groupBy("block").cogroup(sides[1].groupBy("block")).applyInPandas(finish, schema)


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
