"""Operator 2: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``2r`` bits apart have a common word within ``r`` bits of each. So each
distinct fingerprint emits every word within ``r = 1`` bit of itself (65 words), words are shuffled,
and the fingerprints that meet at a word are linked to the least of them after an exact check. A
bucket holds at most 65 distinct fingerprints whatever the data, and all of its members are within
2 bits of each other, so the star keeps every component. Copies share a fingerprint and are folded
before the shuffle.

Cases: a null, empty or blank text has fingerprint zero and links like any other; a very long text is one array of
hashes; a bit with exactly half of the hashes is 0; rows with equal ids or texts share a component; extra columns
are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.llm.blocks import pack, unpack
from ledgerline.llm.common import ROWS, cut, cut_in_loop, map_batches, table, utf8
from ledgerline.llm.components import connected_components

SHINGLE, SEED, RADIUS = 3, 42, 2
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """Bit b is 1 if over half of the hashes have it."""
    n = len(hashes)
    rows = hashes.view(np.uint8).reshape(n, 8)
    counts = np.stack([np.bincount(rows[:, k], minlength=256) for k in range(8)]) @ _BITS
    return int.from_bytes(np.packbits((2 * counts > n).reshape(64), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None) -> int:
    """The majority of the hashes of all shingles, repeats included."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= SHINGLE else [b" ".join(words)]
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, max(1, len(words) - SHINGLE + 1)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long."""

    def each(doc_id: list, text: list) -> dict:
        return {"doc_id": doc_id, "fp": np.array([fingerprint(t) for t in text], np.uint64).view(np.int64)}

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), each, "doc_id long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """``u, v``: verified links between distinct fingerprints, enough to keep every component."""
    ball = fps.select(
        "fp",
        F.explode(F.expr("transform(sequence(-1, 63), i -> CASE WHEN i < 0 THEN fp ELSE fp ^ shiftleft(1L, i) END)")).alias("word"),
    )
    least = F.min("fp").over(Window.partitionBy("word"))
    met = ball.withColumn("least", least).where("fp <> least")
    return met.where(f"bit_count(fp ^ least) <= {RADIUS}").select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document."""
    marked = cut(fingerprints(docs))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(classes.select("fp")))
    rooted = cut(classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = cut(rooted.join(named, "root").select("fp", "component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return marked.join(by_fp, "fp", "left").select("doc_id", hexed.alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------------------------------------------
# Near copies as a filtering stage needs them: documents linked by pairs whose sets of five-word shingles
# have a Jaccard similarity of 0.8 or more. The first candidates come from ball hashing: fingerprints of the
# distinct shingles at most 2 bits apart. At a similarity of 0.8 some ten of 64 bits differ, and balls of half
# that have millions of words, so the other candidates come from prefixes: in any one order of all shingles,
# two such sets of sizes a and b have a common shingle among the first a - ceil(0.8 a) + 1 and the first
# b - ceil(0.8 b) + 1. The order is rare first, so what many documents say is seldom in a prefix. Every link
# is verified on the sets. Shingles are told apart by 64-bit hashes, of which 48 bits travel for verification: two sets of n
# and m shingles that are one short of the similarity pass with a probability of n m / 2^48.

#: Similarity as a fraction.
SIMILAR = 4, 5
#: Shingles are counted in so many slots for the order, which decides the cost and not the result.
SLOTS, PIECES = 1 << 22, 64
#: So many members of a bucket are judged with all others in the first round, four times as many in each later one.
AT_ONCE = 12
#: Bits of the filter that spares documents without candidates.
BITS = 1 << 26
_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_CACHED = 60_000
_hashes: dict[bytes, int] = {}


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    h = (h + _MIX[k]) * _MIX[(k + 1) % 4]
    h = (h ^ (h >> np.uint64(29))) * _MIX[(k + 2) % 4]
    return h ^ (h >> np.uint64(32))


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    n = max(1, min(n, len(words)))
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = _mix(out, 0) ^ words[k : k + len(out)]
    return out


def shingles(text: str | None) -> np.ndarray:
    """The distinct five-word shingles, ascending; all words of a shorter text are one, a blank text has none."""
    found = utf8(text).lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(_hashes) > _CACHED:
        _hashes.clear()
    for w in set(found).difference(_hashes):
        _hashes[w] = xxhash.xxh64_intdigest(w)
    words = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    return np.unique(_mix(_grams(words, 5), 1))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets reach the similarity; empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def prefix(found: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The shingles, rare first, of which similar sets have one in common."""
    n = len(found) - -(-SIMILAR[0] * len(found) // SIMILAR[1]) + 1 if len(found) else 0
    return found[np.lexsort((found, ranks[found % np.uint64(SLOTS)]))[:n]]


def _set_id(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes())


#: Bytes of a shingle's hash that travel for verification, the leading ones.
KEPT = 6


def pack_set(found: np.ndarray) -> bytes:
    """An ascending set by planes of bytes; the leading plane is all but free once it is compressed."""
    return found.view(np.uint8).reshape(-1, 8)[:, 8 - KEPT :].T.tobytes()


def unpack_set(held: bytes) -> np.ndarray:
    out = np.zeros((len(held) // KEPT, 8), np.uint8)
    out[:, 8 - KEPT :] = np.frombuffer(held, np.uint8).reshape(KEPT, -1).T
    return out.view(np.uint64).ravel()


def _signed(values: list) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield [c.to_pylist() for c in batch.slice(at, ROWS).columns]


def _set_ids(docs: DataFrame) -> DataFrame:
    """``doc_id, id, size, fp`` (equal sets, equal id) of every document, and rows with the ``counts`` of a ``piece`` of the slots."""
    schema = pa.schema([("doc_id", pa.int64()), ("id", pa.int64()), ("size", pa.int32()), ("fp", pa.int64()), ("piece", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        counts = np.zeros(SLOTS, np.int32)
        for doc_id, text in _slices(batches):
            sets = [shingles(t) for t in text]
            np.add.at(counts, (np.concatenate(sets) % np.uint64(SLOTS)).astype(np.int64), 1)
            none = [None] * len(sets)
            yield pa.RecordBatch.from_pydict({"doc_id": doc_id, "id": _signed([_set_id(x) for x in sets]), "size": [len(x) for x in sets], "fp": _signed([majority(x) if len(x) else 0 for x in sets]), "piece": none, "counts": none}, schema=schema)
        for k, piece in enumerate(np.split(counts, PIECES)):
            if piece.any():
                yield pa.RecordBatch.from_pydict({"doc_id": [None], "id": [None], "size": [None], "fp": [None], "piece": [k], "counts": [pack(piece, np.int32)]}, schema=schema)

    return docs.mapInArrow(run, "doc_id long, id long, size int, fp long, piece int, counts binary")


def _slot_ranks(marked: DataFrame) -> np.ndarray:
    """How often the shingles of each slot occur, on a scale of eighths of a doubling."""

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(unpack(x, np.int32).astype(np.int64) for x in pdf["counts"])
        return pd.DataFrame([{"piece": pdf.piece.iloc[0], "ranks": np.minimum(255, 8 * np.log2(1 + total)).astype(np.uint8).tobytes()}])

    out = np.zeros((PIECES, SLOTS // PIECES), np.uint8)
    for k, piece in marked.where("piece IS NOT NULL").select("piece", "counts").groupBy("piece").applyInPandas(add_up, "piece int, ranks binary").collect():
        out[k] = np.frombuffer(piece, np.uint8)
    return out.reshape(-1)


def _prefixes(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """``word, id, at``: the prefix of every set; ``at`` packs the set's size and, in its lower half, the shingle's place in the order."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = pa.schema([("word", pa.int64()), ("id", pa.int64()), ("at", pa.int64())])

    def run(batches):
        done = set()
        for _, text in _slices(batches):
            sets = {i: x for x in map(shingles, text) if len(x) and (i := _set_id(x)) not in done}
            if not sets:
                continue
            done.update(sets)
            parts = [prefix(x, held.value) for x in sets.values()]
            n = [len(x) for x in parts]
            at = np.concatenate([(len(x) << 32) + np.arange(k, dtype=np.int64) for x, k in zip(sets.values(), n)])
            yield pa.RecordBatch.from_pydict({"word": np.concatenate(parts).view(np.int64), "id": np.repeat(_signed(list(sets)), n), "at": at}, schema=schema)

    return docs.mapInArrow(run, "word long, id long, at long")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, held``: the sets of these ids and of a few others."""
    bit = F.col("id").bitwiseAND(BITS - 1)
    rows = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND((1 << 15) - 1))).collect()
    bits = docs.sparkSession.sparkContext.broadcast({k: bytes(b) for k, b in rows})
    schema = pa.schema([("id", pa.int64()), ("held", pa.binary())])

    def run(batches):
        whole = np.zeros(BITS // 8, np.uint8)
        for k, b in bits.value.items():
            whole[k << 12 : (k + 1) << 12] = np.frombuffer(b, np.uint8)
        for _, text in _slices(batches):
            sets = {_set_id(x): x for x in map(shingles, text)}
            asked = {i: x for i, x in sets.items() if whole[(i & BITS - 1) >> 3] >> (i & 7) & 1}
            yield pa.RecordBatch.from_pydict({"id": _signed(list(asked)), "held": [pack_set(x) for x in asked.values()]}, schema=schema)

    return docs.mapInArrow(run, "id long, held binary").groupBy("id").agg(F.first("held").alias("held"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``u, v`` that reach the similarity."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for u, v, a, b in _slices(batches):
            yes = [similar(unpack_set(x), unpack_set(y)) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_pydict({"u": [x for x, y in zip(u, yes) if y], "v": [x for x, y in zip(v, yes) if y]}, schema=schema)

    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("held").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("held").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


#: Whether the sizes m and n allow the similarity.
_FIT = f"{SIMILAR[1]} * least(m, n) >= {SIMILAR[0]} * greatest(m, n)"
#: Whether a shingle at places i and j of sets of sizes m and n can be the first that they share: so many must follow it.
_FIRST = f"ceil({SIMILAR[0]} * (m + n) / {sum(SIMILAR)}) <= least(m - i, n - j)"
#: Whether k shingles shared within the prefixes are enough: no more can be shared than the longer of what lies beyond them.
_REST = f"ceil({SIMILAR[0]} * %s / {SIMILAR[1]}) - 1"
_ENOUGH = f"k >= ceil({SIMILAR[0]} * (m + n) / {sum(SIMILAR)}) - greatest({_REST % 'm'}, {_REST % 'n'})"


def _judged(pairs: DataFrame, docs: DataFrame, words: DataFrame) -> DataFrame | None:
    """Distinct pairs of ``u, v`` whose sizes ``m, n`` allow the similarity, verified; None if there are none to verify.

    Before sets are read, the shingles that the two share within their prefixes are counted; a pair with too few goes.
    """
    one, two = F.struct("u", "m"), F.struct(F.col("v").alias("u"), F.col("n").alias("m"))
    fit = pairs.where(_FIT).select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()
    fit = cut_in_loop(fit.select("a.u", "a.m", F.col("b.u").alias("v"), F.col("b.m").alias("n")))
    side = lambda c: words.select(F.col("id").alias(c), F.col("words").alias(f"words_{c}"))
    shared = F.aggregate(F.array_intersect("words_u", "words_v"), F.lit(0).cast("long"), lambda k, x: k + x["weight"])
    pairs = cut_in_loop(fit.join(side("u"), "u").join(side("v"), "v").withColumn("k", shared).where(_ENOUGH).select("u", "v"))
    if pairs.isEmpty():
        return None
    return cut_in_loop(_verified(pairs, _sets(docs, pairs.select(F.explode(F.array("u", "v")).alias("id")))))


def _balls(classes: DataFrame) -> DataFrame:
    """``u, m, v, n``: of sets of one fingerprint all with the least, and the least of fingerprints that ball hashing links."""
    heads = cut_in_loop(classes.groupBy("fp").agg(F.min(F.struct("id", "size")).alias("head")))
    one = classes.join(heads, "fp").where("id <> head.id").select(F.col("head.id").alias("u"), F.col("head.size").alias("m"), F.col("id").alias("v"), F.col("size").alias("n"))
    side = lambda c, size: heads.select(F.col("fp").alias(f"{c}_fp"), F.col("head.id").alias(c), F.col("head.size").alias(size))
    near = links(heads.select("fp")).select(F.col("u").alias("u_fp"), F.col("v").alias("v_fp"))
    return one.unionByName(near.join(side("u", "m"), "u_fp").join(side("v", "n"), "v_fp").select("u", "m", "v", "n"))


def _buckets(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """``word, id, size, place, head, weight``: sets with a common shingle in their prefixes; of buckets with the same members the first in the order, which weighs their number."""
    at_word = Window.partitionBy("word")
    size, place = F.shiftright("at", 32).cast("int").alias("size"), F.col("at").bitwiseAND((1 << 32) - 1).cast("int").alias("place")
    rows = _prefixes(docs, ranks).repartition("word").distinct()
    met = rows.select("word", "id", size, place, F.count("*").over(at_word).alias("n"), F.bit_xor(F.xxhash64("id")).over(at_word).alias("who"), F.min(F.struct(place, F.col("id"), size)).over(at_word).alias("head"))
    met = cut(met.where("n > 1"))
    alike = met.where("id = head.id").groupBy("n", "who").agg(F.min_by("word", "place").alias("word"), F.count("*").alias("weight")).select("word", "weight")
    return cut(met.select("word", "id", "size", "place", "head").join(alike, "word"))


def _near_links(docs: DataFrame, classes: DataFrame, ranks: np.ndarray) -> DataFrame:
    """``node, root`` of the components of all similar pairs.

    Judged first are the pairs of ball hashing, and every set with the head of a bucket with which it shares
    most; a bucket's head is the set with the fewest rarer shingles, that is the nearest to what all have in common. Then,
    round by round, some members outside a bucket's largest component are judged with all members of other components in
    all of their buckets, and leave, until one component is left in each. So each pair of a bucket is judged or already in
    one component, and a group of copies costs about a pair a member. Of a pair's common shingles the first in the order
    must have enough left behind it, and enough must be within the prefixes.
    """
    met = _buckets(docs, ranks)
    star = met.where("id <> head.id").select(F.col("head.id").alias("u"), F.col("head.size").alias("m"), F.col("id").alias("v"), F.col("size").alias("n"), "weight")
    prefixes = cut_in_loop(met.groupBy("id").agg(F.collect_list(F.struct("word", "weight")).alias("words")))  # a part of a set at most
    best = star.where(_FIT).groupBy("u", "m", "v", "n").agg(F.sum("weight").alias("k")).groupBy("v", "n").agg(F.max_by(F.struct("u", "m"), F.struct("k", "u")).alias("to")).select("to.u", "to.m", "v", "n")
    linked = _judged(_balls(classes).unionByName(best), docs, prefixes)
    if linked is None:
        linked = classes.sparkSession.createDataFrame([], "u long, v long")
    roots = cut_in_loop(connected_components(linked))
    left, most = met.select("word", "id", "size", "place"), AT_ONCE
    while True:
        named = left.join(roots, left.id == roots.node, "left").select("word", "id", "size", "place", F.coalesce("root", "id").alias("root"))
        by_root = cut_in_loop(named.groupBy("word", "root").agg(F.count("*").alias("n")))
        words = by_root.groupBy("word").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("top")).where("roots > 1")
        left = cut_in_loop(named.join(words.select("word", F.col("top.root").alias("top")), "word"))
        if left.isEmpty():
            return roots
        rank = F.row_number().over(Window.partitionBy("word").orderBy("place", "id"))
        now = cut_in_loop(left.where("root <> top").withColumn("rank", rank).where(f"rank <= {most}").select("id").distinct().withColumn("now", F.lit(True)))
        held = cut_in_loop(left.join(now, "id", "left").select("word", "id", "size", "place", "root", "now"))
        one = held.where("now").select("word", F.col("id").alias("u"), F.col("size").alias("m"), F.col("place").alias("i"), F.col("root").alias("own")).alias("one")
        two = held.select("word", F.col("id").alias("v"), F.col("size").alias("n"), F.col("place").alias("j"), "root", "now").alias("two")
        pairs = one.join(two, F.expr(f"one.word = two.word AND own <> root AND (now IS NULL OR u < v) AND {_FIT} AND {_FIRST}"))
        found = _judged(pairs.select("u", "m", "v", "n"), docs, prefixes)
        if found is not None and not found.isEmpty():
            linked = linked.unionByName(found)
            roots = cut_in_loop(connected_components(linked))
        left = held.where("now IS NULL").select("word", "id", "size", "place")
        most *= 4


def near_copy_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id`` for documents linked by a similarity of 0.8 or more."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    seen = cut(_set_ids(texts))
    marked = seen.where("piece IS NULL").select("doc_id", "id", "size", "fp")
    classes = cut(marked.groupBy("id", "size", "fp").agg(F.min("doc_id").alias("least")))
    roots = _near_links(texts, classes, _slot_ranks(seen))
    rooted = cut(classes.join(roots, classes.id == roots.node).select("id", "least", "root"))
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    by_id = cut(rooted.join(named, "root").select("id", "component_id").unionByName(classes.join(rooted, "id", "left_anti").select("id", F.col("least").alias("component_id"))))
    return marked.join(by_id, "id", "left").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents, all columns as they were, without those that are near copies of one with a smaller id.

    Rows without an id stay; rows that share an id are one document and stay or go together. Texts without words
    are one group. Very long texts are judged whole; repeated rows and ties are one class; an empty table stays empty.
    """
    gone = cut(near_copy_classes(docs).where("doc_id > component_id").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, docs.doc_id == gone["_gone"], "left_anti")
