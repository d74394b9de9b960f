"""Operator 9: benchmark decontamination by a broadcast set of normalised test n-grams.

Benchmark items become windows of ten consecutive words (a shorter item is one window). The distinct
windows go out in blocks of bounded size; each block is one pass over the documents, so a benchmark of
any size works and a usual one takes a single pass. Documents are scanned as arrays of word numbers: a
rolling hash finds candidate windows, and every candidate is verified word by word.

Cases: a null text or item has no words; an item without words never occurs; items with equal texts
are all reported; a very long document is scanned as arrays of a few numbers a word; repeated documents give repeated
rows; extra columns are dropped, or kept untouched by ``drop_contaminated``; an empty benchmark leaves every document
clean; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, map_batches, sha256, table, utf8

WINDOW = 10
#: Most windows in one broadcast block: tens of MB at the usual word lengths.
BLOCK = 250_000
#: Most bytes of item text in one broadcast block.
BLOCK_BYTES = 32 << 20
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return utf8(text).translate(_WORDS).split()


def windows(text: str | None) -> set[tuple[bytes, ...]]:
    """The windows of an item."""
    w = words(text)
    return {tuple(w[i : i + WINDOW]) for i in range(max(1, len(w) - WINDOW + 1))} if w else set()


def _roll(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive numbers."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ ids[k : k + len(out)]) * _ODD
        out ^= out >> np.uint64(29)
    return out


class Matcher:
    """Finds the windows of one block in documents."""

    def __init__(self, block: list[tuple[tuple[bytes, ...], list[int]]]) -> None:
        self.items = dict(block)
        self.number: dict[bytes, int] = {}
        for window, _ in block:
            for w in window:
                self.number.setdefault(w, len(self.number) + 1)
        by_length = defaultdict(list)
        for window, _ in block:
            by_length[len(window)].append([self.number[w] for w in window])
        self.hashes = {n: np.unique(np.concatenate([_roll(np.array(x, np.uint64), n) for x in rows])) for n, rows in by_length.items()}

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Occurrences as (first word, end) and the items that have them."""
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in found), np.uint64, len(found))
        spans, items = [], set()
        missing = np.concatenate(([0], np.cumsum(ids == 0)))
        for n, hashes in self.hashes.items():
            if len(ids) < n:
                continue
            whole = np.flatnonzero(missing[n:] == missing[:-n])
            if not len(whole):
                continue
            rolled = _roll(ids, n)[whole]
            for i in whole[np.isin(rolled, hashes)].tolist():
                if (owner := self.items.get(tuple(found[i : i + n]))) is not None:
                    spans.append((i, i + n))
                    items.update(owner)
        return spans, items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame) -> Iterator[list]:
    """The items, folded by window, in blocks that a broadcast can hold; items stream to the driver."""
    held: dict[tuple, list[int]] = defaultdict(list)
    size = 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        rows = iter(windows(row["text"]))
        while part := list(islice(rows, BLOCK)):
            for w in part:
                held[w].append(row["item_id"])
            size += sum(map(len, part[0])) * len(part)
            if len(held) >= BLOCK or size >= BLOCK_BYTES:
                yield list(held.items())
                held, size = defaultdict(list), 0
    if held:
        yield list(held.items())


def _scanned(docs: DataFrame, block: list) -> DataFrame:
    """One pass: ``doc_id, n_words, spans`` (flat first, end, ...) and ``items`` per document."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    built: list[Matcher] = []

    def each(doc_id: list, text: list) -> dict:
        if not built:
            built.append(Matcher(sent.value))
        out: dict = {"row": doc_id, "n_words": [], "spans": [], "items": []}
        for t in text:
            found = words(t)
            spans, items = built[0].scan(found)
            out["n_words"].append(len(found))
            out["spans"].append([x for s in merge_spans(spans) for x in s])
            out["items"].append(sorted(i for i in items if i is not None))
        return out

    return map_batches(docs, each, "row long, n_words long, spans array<int>, items array<long>")


def _digest(scanned: DataFrame) -> DataFrame:
    def each(row: list, n_words: list, spans: list, items: list) -> dict:
        merged = [merge_spans(list(zip(s[::2], s[1::2]))) for s in spans]
        hit = [sum(b - a for a, b in s) for s in merged]
        named = [sorted(map(str, set(i))) for i in items]
        return {"row": row, "n_words": n_words, "n_hit": hit, "n_items": list(map(len, named)), "items_sha256": [sha256(",".join(i)) for i in named], "contaminated": [h > 0 for h in hit], "word_spans": [[x for s in m for x in s] for m in merged]}

    return map_batches(scanned, each, "row long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, word_spans array<int>")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, word_spans`` for every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("row"), F.col("text").cast("string"))
    todo = list(islice(it := blocks(benchmark), 2))
    if len(todo) < 2:
        return _digest(_scanned(texts, todo[0] if todo else [])).withColumnRenamed("row", "doc_id")
    # Several passes: rows get a number that holds for all of them, and their findings are put together.
    numbered = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string")))
    parts = None
    for block in (b for source in (todo, it) for b in source):
        one = cut(_scanned(numbered.select("row", "text"), block))
        parts = one if parts is None else parts.unionByName(one)
    found = parts.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return numbered.select("row", "doc_id").join(_digest(found), "row").drop("row")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark window, all columns as they were."""
    kept = docs
    for block in blocks(benchmark):
        kept = _clean(kept, block)
    return kept


def _clean(docs: DataFrame, block: list) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for batch in batches:
            clean = [not matcher.scan(words(t))[0] for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("word_spans")


#: The whole contract in DuckDB: item windows joined to the document windows of the same length.
OP9_SQL = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM item WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM grams), occ AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM low, lengths WHERE len(w) >= n)
), hits AS (SELECT doc_id, item_id, i, occ.n FROM occ JOIN grams USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
