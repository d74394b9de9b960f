"""Operator 5: repeated windows by a depth-limited radix sort of suffixes.

A byte is removed if a WINDOW-byte string that covers it also starts anywhere else. Suffixes matter only
through WINDOW bytes, and only equal groups of them, so they are sorted by most-significant digits, and
what is alone in its group leaves. The digits are wide, and the first one is read where it is lowest:

1. First digit: of the GRAM-byte strings within a suffix's window, the one with the least hash (its
   anchor). Equal windows have equal anchors at equal distances. Neighbouring suffixes with one anchor
   form a run, some fifty suffixes on average, which is sorted as one. An anchor that occurs once ends its run.
2. Second digit: the whole string that a run covers. Runs that equal another are repeated in full; if
   that is so of all runs of an anchor, none of them needs another digit.
3. Third digit, for the runs of the other anchors, suffix by suffix: the window itself. Groups of two or
   more are exactly the repeated windows.

Each pass sends the distinct digits of a block of documents to even buckets by their hashes and gets a
code for each back, so a passage that a third of all rows hold arrives at most once a block, and no group
is ever gathered. Digits are compared by hashes from two independent tables: runs by 128 bits (anchor, content),
windows by 96 (content, and 32 of the other table's), so among 10^12 windows a false repeat is to be expected
once in 10^5 runs.

Cases: matches stay within a text; a null or empty text, and one shorter than WINDOW, loses nothing; a text longer than
a block is a block of its own, in about a hundred bytes of memory a byte; of equal anchors all are one;
repeated rows lose everything if they are long enough; null ids are kept; extra columns are dropped; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import pickle
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.blocks import block_rows, bucket_count, edges, pack, unpack
from ledgerline.llm.common import cut, shared_dir, table, utf8

WINDOW, GRAM = 200, 100
BLOCK_CHARS = 1 << 20
#: What is shuffled by block is small, the texts read from files are not, so tasks are counted by blocks.
BLOCKS_A_TASK = 8
_NEAR = WINDOW - GRAM + 1
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_ANCHOR, _CONTENT = np.random.default_rng(11).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_DIGIT = np.dtype([("a", np.uint64), ("s", np.uint32)])
# Codes of a run's anchor and string.
ALONE, REPEATED, OPEN, OPEN_REPEATED = 0, 1, 2, 3
_TIED = 4


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_held: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared, ...; kept for the blocks that follow unless a text is much longer than a block."""
    if (out := _held.get(base)) is None or len(out) < n:
        out = np.full(n + n // 8, base, np.uint64)
        out[:1] = 1
        out = np.cumprod(out, dtype=np.uint64)
        if n <= 2 * BLOCK_CHARS:
            _held[base] = out
    return out[:n]


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) over each ``width`` consecutive values."""
    n = len(values)
    if n < width:
        return values[:0]
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint64)
    grid[:n] = values
    grid[n:] = values[-1]
    grid = grid.reshape(rows, width)
    ahead = best.accumulate(grid, axis=1).ravel()
    behind = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: n - width + 1], ahead[width - 1 : n])


class Texts:
    """The runs of a block's texts, laid end to end."""

    def __init__(self, texts: list[bytes]) -> None:
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.raw)
        self.first = self.last = np.zeros(0, np.int64)
        self.anchor = self.string = np.zeros(0, np.uint64)
        self.tied = np.zeros(0, bool)
        if n < WINDOW:
            return
        up, self.back = _powers(_BASE, n), _powers(_BACK, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_ANCHOR[self.raw] * up, out=sums[1:])
        grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * self.back[: n - GRAM + 1])
        self.more = sums
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CONTENT[self.raw] * up, out=self.sums[1:])
        least = _sliding(grams, _NEAR, np.minimum)
        valid = np.zeros(len(least), bool)
        for end, size in zip(self.ends.tolist(), self.sizes.tolist()):
            if size >= WINDOW:
                valid[end - size : end - WINDOW + 1] = True
        least = np.where(valid, least, np.uint64(0))
        if not valid.any():
            return
        fresh = np.concatenate(([True], least[1:] != least[:-1]))
        starts = np.flatnonzero(fresh)
        stops = np.append(starts[1:], len(least)) - 1
        real = valid[starts]
        self.first, self.last = starts[real], stops[real]
        anchor = least[self.first]
        self.anchor = _mixed(anchor)  # least hashes are small; buckets want even ones
        self.string = _mixed(self.hashed(self.first, self.last + WINDOW) + (self.last - self.first).astype(np.uint64) * np.uint64(_BASE))
        # Anchors: grams that are the least of some window. Runs with two of them hold a string that repeats within.
        around = np.concatenate((np.zeros(_NEAR - 1, np.uint64), least, np.zeros(_NEAR - 1, np.uint64)))
        places = np.flatnonzero(_sliding(around, _NEAR, np.maximum) == grams)
        kinds, which = np.unique(grams[places], return_inverse=True)
        order = np.sort(which.astype(np.int64) * (n + 1) + places)
        kind = np.searchsorted(kinds, anchor).astype(np.int64) * (n + 1)
        self.tied = np.searchsorted(order, kind + self.last + _NEAR - 1, "right") - np.searchsorted(order, kind + self.first) > 1

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def windows(self, start: np.ndarray) -> np.ndarray:
        """The digits of windows: 64 bits of one hash and 32 of the other, which sort by the first."""
        out = np.empty(len(start), _DIGIT)
        if len(start):
            out["a"] = _mixed(self.hashed(start, start + WINDOW))
            out["s"] = _mixed((self.more[start + WINDOW] - self.more[start]) * self.back[start]) >> np.uint64(32)
        return out

    def digits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (anchor, string) in order, and how often each is here (2: or more), with the tied mark."""
        order = np.lexsort((self.string, self.anchor))
        a, s, t = self.anchor[order], self.string[order], self.tied[order]
        if not len(a):
            return a, s, np.zeros(0, np.uint8)
        starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (s[1:] != s[:-1]))))
        counts = np.minimum(np.diff(np.append(starts, len(a))), 2)
        return a[starts], s[starts], (counts + _TIED * np.maximum.reduceat(t, starts)).astype(np.uint8)

    def codes(self, anchors: np.ndarray, strings: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The code of each run, from those of its digits."""
        if not len(self.anchor):
            return np.zeros(0, np.uint8)
        kinds, kind = np.unique(anchors, return_inverse=True)
        own = np.searchsorted(kinds, self.anchor)
        names, name = np.unique(strings, return_inverse=True)
        whole = kind.astype(np.int64) * len(names) + name
        at = np.argsort(whole)
        return codes[at[np.searchsorted(whole[at], own.astype(np.int64) * len(names) + np.searchsorted(names, self.string))]]

    def results(self, doc_ids: list, windows: np.ndarray, wanted: np.ndarray) -> dict:
        """Result columns of the wanted documents, given the starts of all repeated windows."""
        marks = np.zeros(len(self.raw) + 1, np.int32)
        np.add.at(marks, windows, 1)
        np.add.at(marks, windows + WINDOW, -1)
        gone = np.cumsum(marks[:-1]) > 0
        out: dict = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for k in np.flatnonzero(wanted).tolist():
            a, b = int(self.ends[k] - self.sizes[k]), int(self.ends[k])
            lost = gone[a:b]
            out["doc_id"].append(doc_ids[k])
            out["n_bytes"].append(b - a)
            out["n_removed"].append(int(lost.sum()))
            out["n_spans"].append(int(np.count_nonzero(lost[1:] & ~lost[:-1])) + int(len(lost) and lost[0]))
            out["kept_sha256"].append(hashlib.sha256(self.raw[a:b][~lost].tobytes()).hexdigest())
        return out


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the given ranges."""
    n = last - first + 1
    return np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum())) if len(n) else np.zeros(0, np.int64)


_BLOCK = "block long, file string, at long, length long, a binary, s binary, n binary, n_keys long"
_BLOCK_ARROW = pa.schema([("block", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("a", pa.binary()), ("s", pa.binary()), ("n", pa.binary()), ("n_keys", pa.int64())])


def store_blocks(texts: DataFrame, folder: str) -> DataFrame:
    """Blocks of documents. Their texts go to files in the shared folder, one a task attempt, and stay there:
    what is shuffled later is digits, codes and the places of blocks in files."""

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        held: dict = {}

        def make(number: int, rows: list) -> dict:
            raw = [utf8(t) for _, t in rows]
            blob = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(
                pickle.dumps(([i for i, _ in rows], [len(t) for t in raw])) + b"".join(raw)
            )
            if not held:
                store.create_dir(root, recursive=True)
                held.update(file=f"texts-{uuid.uuid4().hex}", at=0)
                held["out"] = store.open_output_stream(f"{root}/{held['file']}")
            held["out"].write(blob)
            at, held["at"] = held["at"], held["at"] + len(blob)
            a, s, n = Texts(raw).digits()
            return {"block": number, "file": held["file"], "at": at, "length": len(blob), "a": pack(a, np.uint64), "s": pack(s, np.uint64), "n": pack(n, np.uint8), "n_keys": len(a)}

        yield from block_rows(batches, BLOCK_CHARS, make, _BLOCK_ARROW)
        if held:
            held["out"].close()

    return texts.mapInArrow(run, _BLOCK)


class Stored:
    """Reads blocks back by their places."""

    def __init__(self, folder: str) -> None:
        self.store, self.root = fs.FileSystem.from_uri(folder)

    def __call__(self, place: dict) -> tuple[list, list[bytes]]:
        with self.store.open_input_file(f"{self.root}/{place['file']}") as file:
            data = io.BytesIO(zstandard.ZstdDecompressor().decompress(file.read_at(place["length"], place["at"])))
        ids, sizes = pickle.load(data)
        return ids, [data.read(n) for n in sizes]


_ASK = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("s", pa.binary()), ("n", pa.binary())])
_ASKED = "bucket int, block long, a binary, s binary, n binary"


def _split(block: int, a: np.ndarray, s: np.ndarray, n: np.ndarray, buckets: int, kind: type = np.uint64):
    """The part of a block's sorted digits that belongs to each bucket."""
    at = edges(a, buckets)
    for b in range(buckets):
        x, y = at[b], at[b + 1]
        if x < y:
            yield pa.RecordBatch.from_pydict({"bucket": [b], "block": [block], "a": [pack(a[x:y], np.uint64)], "s": [pack(s[x:y], kind)], "n": [pack(n[x:y], np.uint8)]}, schema=_ASK)


def _ask(blocks: DataFrame, buckets: int) -> DataFrame:
    def split(batches):
        for batch in batches:
            for block, a, s, n in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _split(block, unpack(a, np.uint64), unpack(s, np.uint64), unpack(n, np.uint8), buckets)

    return blocks.select("block", "a", "s", "n").mapInArrow(split, _ASKED)


def _answers(pdf: pd.DataFrame, codes: np.ndarray, sizes: list[int]) -> pd.DataFrame:
    parts = np.split(codes, np.cumsum(sizes)[:-1])
    return pd.DataFrame({"bucket": pdf.bucket, "block": pdf.block, "codes": [pack(p, np.uint8) for p in parts]})


def judge_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Second digit: a code for each (anchor, string) of each block."""
    anchors = [unpack(x, np.uint64) for x in pdf.a]
    a, s, n = np.concatenate(anchors), np.concatenate([unpack(x, np.uint64) for x in pdf.s]), np.concatenate([unpack(x, np.uint8) for x in pdf.n])
    order = np.lexsort((s, a))
    a, s, n = a[order], s[order], n[order]
    new_a = np.concatenate(([True], a[1:] != a[:-1]))
    new_s = new_a | np.concatenate(([True], s[1:] != s[:-1]))
    string_at = np.flatnonzero(new_s)
    copies = np.add.reduceat((n & 3).astype(np.int64), string_at)
    tied = np.maximum.reduceat(n & _TIED, string_at) > 0
    anchor_at = np.flatnonzero(new_a[string_at])
    total = np.add.reduceat(copies, anchor_at)
    still_open = np.maximum.reduceat(((copies == 1) | tied).astype(np.uint8), anchor_at) > 0
    any_tied = np.maximum.reduceat(tied.astype(np.uint8), anchor_at) > 0
    of = np.cumsum(new_a[string_at]) - 1
    code = np.where((total == 1)[of] & ~any_tied[of], ALONE, np.where(~still_open[of], REPEATED, np.where(copies > 1, OPEN_REPEATED, OPEN))).astype(np.uint8)
    out = np.empty(len(a), np.uint8)
    out[order] = code[np.cumsum(new_s) - 1]
    return _answers(pdf, out, [len(x) for x in anchors])


def judge_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Third digit: whether each window occurs twice."""
    keys = [unpack(x, np.uint64) for x in pdf.a]
    a, s = np.concatenate(keys), np.concatenate([unpack(x, np.uint32) for x in pdf.s])
    which, _ = _kinds(a, s)
    n = np.bincount(which, weights=np.concatenate([unpack(x, np.uint8) for x in pdf.n]))
    return _answers(pdf, (n > 1)[which].astype(np.uint8), [len(x) for x in keys])


def _kinds(a: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the distinct (a, s), in order, each is, and where the first of each is."""
    order = np.lexsort((s, a))
    x, y = a[order], s[order]
    fresh = np.concatenate((np.ones(min(1, len(x)), bool), (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(fresh) - 1
    return which, order[fresh]


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _pieces(rows: pa.Table) -> tuple[dict, np.ndarray, np.ndarray]:
    """Of one block: its place, the codes of its runs and of its windows."""
    place, codes = {}, {1: [], 2: []}
    for row in rows.sort_by([("kind", "ascending"), ("bucket", "ascending")]).to_pylist():
        if row["kind"]:
            codes[row["kind"]].append(unpack(row["codes"], np.uint8))
        else:
            place = row
    return place, *(np.concatenate(c) if c else np.zeros(0, np.uint8) for c in codes.values())


def _open_windows(texts: Texts, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of open runs, their distinct digits in order, which digit each has, and how often each is here."""
    at = _spread(texts.first[codes >= OPEN], texts.last[codes >= OPEN])
    digits = texts.windows(at)
    which, first = _kinds(digits["a"], digits["s"])
    return at, digits[first], which, np.bincount(which, minlength=len(first))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every document."""
    folder = f"{shared_dir(docs.sparkSession)}/suffixes-{uuid.uuid4().hex}"
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = cut(store_blocks(texts, folder))
    n_keys, n_blocks = blocks.agg(F.sum("n_keys"), F.count("*")).first()
    buckets, parts = bucket_count(n_keys or 0), -(-n_blocks // BLOCKS_A_TASK) or 1
    answer = "bucket int, block long, codes binary"
    runs = cut(_ask(blocks, buckets).groupBy("bucket").applyInPandas(judge_runs, answer))
    none = F.lit(None)
    places = blocks.select("block", F.lit(0).alias("kind"), none.cast("int").alias("bucket"), none.cast("binary").alias("codes"), "file", "at", "length")
    coded = lambda df, kind: df.select("block", F.lit(kind).alias("kind"), "bucket", "codes", none.cast("string").alias("file"), none.cast("long").alias("at"), none.cast("long").alias("length"))
    # Windows of open runs may be several to a run, so they go to more buckets.
    finer = 4 * buckets

    def ask_windows(rows: pa.Table) -> pa.Table:
        place, codes, _ = _pieces(rows)
        if not (codes >= OPEN).any():
            return _ASK.empty_table()
        t = Texts(Stored(folder)(place)[1])
        _, keys, _, times = _open_windows(t, t.codes(*t.digits()[:2], codes))
        return pa.Table.from_batches(_split(place["block"], keys["a"], keys["s"], np.minimum(times, 2).astype(np.uint8), finer, np.uint32), schema=_ASK)

    def finish(rows: pa.Table) -> pa.Table:
        place, codes, found = _pieces(rows)
        ids, raw = Stored(folder)(place)
        t = Texts(raw)
        codes = t.codes(*t.digits()[:2], codes)
        sure = (codes == REPEATED) | (codes == OPEN_REPEATED)
        windows = _spread(t.first[sure], t.last[sure])
        if len(found):
            at, _, which, _ = _open_windows(t, codes)
            windows = np.unique(np.concatenate((windows, at[found[which] > 0])))
        return pa.Table.from_pydict(t.results(ids, windows, np.ones(len(ids), bool)), schema=_RESULT_ARROW)

    known = places.unionByName(coded(runs, 1))
    windows = cut(known.repartition(parts, "block").groupBy("block").applyInArrow(ask_windows, _ASKED).groupBy("bucket").applyInPandas(judge_windows, answer))
    return known.unionByName(coded(windows, 2)).repartition(parts, "block").groupBy("block").applyInArrow(finish, _RESULT)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: The contract in DuckDB: windows as hexadecimal substrings, islands of repeated ones, what lies between.
OP5_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 199, 0))) AS i FROM d)),
r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
m AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
  FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS before FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM m GROUP BY doc_id, g),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id),
p AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM s UNION ALL SELECT doc_id, max(b), NULL FROM s GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, CASE WHEN y IS NULL THEN 2 * (n - x) ELSE 2 * (y - x) END), '' ORDER BY x) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""
