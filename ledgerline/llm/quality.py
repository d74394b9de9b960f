"""Operator 7: quality classifier by importance resampling.

Two generative models over hashed n-grams, one of target text (labelled good and not toxic) and one of raw text (all
documents), give every document the log of its importance weight, log p_target - log p_raw. A model draws features
one by one from a normalised distribution over the buckets; a document is taken as WORTH draws made up as its set of
features is, so that long and short ones are weighed alike. Documents are then drawn without replacement by Gumbel
top-k: key = log weight / TEMPERATURE + Gumbel noise, and the k largest keys stay, k being the number of documents
whose log weight reaches the threshold. The threshold is the one that best separates a calibration fifth of the labelled
rows, from which the models do not learn; a lost good row counts as CLEAN kept bad ones. The noise comes from a
hash of the text, so copies share their fate and a rerun gives the same rows.

The raw model's probabilities are proportional to how many of all documents have a feature; the target model's to theirs times a ratio, the posterior mean from the labelled rows that have the feature: with probability 1 - DIFFERENT a feature is
as frequent in target as in raw text (ratio 1), else its share of good rows has a beta prior about the overall share, of
strength STRENGTH. The k-th key is found exactly by radix refinement: four counts of at most 65,536 bins, never a sort.

Bounds: at most SAMPLE labelled rows fit the model (the smallest hashes of their ids; the only sample taken); a task sends
five numbers a bucket, and as many reach the driver, whatever the corpus.

Cases: a null or empty text has no features and log weight 0; a very long one is a set like any other;
labels that are null, repeated or without document are ignored or folded; without both kinds of labels, or without documents,
nothing is rejected; equal keys stay or go together; repeated rows count and are drawn each; extra columns are
dropped by ``classify`` and kept by ``accept``, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ledgerline.llm.blocks import pack, unpack
from ledgerline.llm.common import cut, map_batches, table, utf8

BUCKETS, SAMPLE, WORTH, TEMPERATURE, CLEAN = 1 << 18, 50_000, 1000, 1.0, 2.0
#: Prior: part of features that differ between target and raw text, and how many rows their beta prior is worth.
DIFFERENT, STRENGTH = 0.001, 1.0
#: Words, word pairs, and the repeat features.
TABLE = 2 * BUCKETS + 16
_TOKENS = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+")
_CACHED = 60_000
_known: dict[bytes, int] = {}


def features(text: str | None) -> np.ndarray:
    """Distinct bucket numbers: words in the lower half of the table, word pairs in the upper, repeats at its end.

    A token equal to the one before it, or before that, adds a feature that stands for how large a share
    of the text such tokens are (in eighths).
    """
    found = _TOKENS.findall(utf8(text).lower())
    if not found:
        return np.zeros(0, np.int64)
    if len(_known) > _CACHED:
        _known.clear()
    for w in set(found).difference(_known):
        _known[w] = xxhash.xxh64_intdigest(w)
    words = np.fromiter(map(_known.__getitem__, found), np.uint64, len(found))
    pairs = (words[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ words[1:]
    pairs = (pairs ^ (pairs >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    size = np.uint64(BUCKETS)
    parts = [words >> np.uint64(7) & (size - np.uint64(1)), (pairs >> np.uint64(33) & (size - np.uint64(1))) + size]
    for lag in (1, 2):
        same = int(np.count_nonzero(words[lag:] == words[:-lag]))
        if same:
            parts.append(np.array([2 * BUCKETS + 8 * lag - 8 + 8 * same // len(words)], np.uint64))
    return np.unique(np.concatenate(parts).astype(np.int64))


@dataclass
class Model:
    weights: np.ndarray  # log ratio of the probabilities by bucket
    threshold: float = -math.inf

    def log_weight(self, text: str | None) -> float:
        found = features(text)
        return WORTH * float(self.weights[found].mean(dtype=np.float64)) if len(found) else 0.0

    def key(self, text: str | None, log_weight: float) -> float:
        """What the top-k draw ranks by; without a threshold all documents are alike."""
        if not math.isfinite(self.threshold):
            return 0.0
        u = (xxhash.xxh64_intdigest(utf8(text), 7) + 0.5) / 2.0**64
        return log_weight / TEMPERATURE - math.log(-math.log(min(u, 1 - 2.0**-53)))


def model(good: np.ndarray, rows: np.ndarray, share: float, raw: np.ndarray) -> Model:
    """From the ``rows`` labelled rows with a feature, of which ``good`` are target, as ``share`` of all are, and the part ``raw`` of all documents that has it."""
    if not 0 < share < 1 or not raw.any():
        return Model(np.zeros(len(good), np.float32))
    a, b = STRENGTH * share, STRENGTH * (1 - share)
    bad = rows - good
    same = good * math.log(share) + bad * math.log(1 - share)
    other = log_gamma(good + a) + log_gamma(bad + b) - log_gamma(rows + STRENGTH) + (math.lgamma(STRENGTH) - math.lgamma(a) - math.lgamma(b))
    differs = 1 / (1 + np.exp(np.clip(same - other + math.log((1 - DIFFERENT) / DIFFERENT), -700, 700)))
    ratio = 1 - differs + differs * (good + a) / ((rows + STRENGTH) * share)
    return Model((np.log(ratio) - math.log((raw * ratio).sum() / raw.sum())).astype(np.float32))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series from 8 on, and the recurrence below."""
    out, x = np.zeros(len(x)), np.array(x, float)
    for _ in range(8):
        low = x < 8
        out -= np.log(np.where(low, x, 1.0))
        x += low
    return out + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


#: Counts of a bucket: documents, labelled rows to learn from, and the good ones of them.
_KINDS, _PIECES = 3, 32


def _counts(texts: DataFrame, chosen: dict[int, tuple[bool, bool]]) -> tuple[np.ndarray, int]:
    """``_KINDS`` counts by bucket, and the number of documents. Tasks send packed arrays, added up by pieces of the table."""
    sent = texts.sparkSession.sparkContext.broadcast(chosen)
    schema = pa.schema([("piece", pa.int32()), ("documents", pa.int64()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents = np.zeros((TABLE, _KINDS), np.int32), 0
        for batch in batches:
            for k, i in enumerate(batch.column(0).to_pylist()):
                good, later = sent.value.get(i, (False, True))
                held[features(batch.column(1)[k].as_py())] += np.array((1, not later, not later and good), np.int32)
                documents += 1
        for k, piece in enumerate(np.array_split(held, _PIECES)):
            if documents:
                yield pa.RecordBatch.from_pydict({"piece": [k], "documents": [documents], "counts": [pack(piece, np.int32)]}, schema=schema)

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"piece": pdf.piece.iloc[0], "documents": pdf.documents.sum(), "counts": pack(sum(unpack(x, np.int32).astype(np.int64) for x in pdf["counts"]), np.int64)}])

    rows = texts.mapInArrow(count, "piece int, documents long, counts binary").groupBy("piece").applyInPandas(add_up, "piece int, documents long, counts binary").collect()
    if not rows:
        return np.zeros((TABLE, _KINDS), np.int64), 0
    return np.concatenate([unpack(r["counts"], np.int64).reshape(-1, _KINDS) for r in sorted(rows, key=lambda r: r["piece"])]), rows[0]["documents"]


def separating(held_out: list[tuple[float, bool]]) -> float:
    """The threshold with the largest sum of the share of bad rows below it and CLEAN times that of good rows above; -inf without both kinds."""
    held_out = sorted(held_out)
    good, w = np.array([g for _, g in held_out], bool), np.array([x for x, _ in held_out])
    if good.all() or not good.any():
        return -math.inf
    # Cutting below row i rejects the first i rows; equal weights are not cut apart.
    merit = np.concatenate(([0], np.cumsum(np.where(good, -CLEAN / good.sum(), 1 / (~good).sum()))))
    merit[1:-1][w[1:] == w[:-1]] = -np.inf
    i = int(np.argmax(merit))
    return float(w[0] - 1 if i == 0 else w[-1] + 1 if i == len(w) else (w[i - 1] + w[i]) / 2)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Both models and the threshold; target from a bounded sample of labelled rows, raw from all documents."""
    spark = docs.sparkSession
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(((F.min("quality") == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)).alias("good"))
    sample = one.withColumn("h", F.xxhash64("doc_id")).orderBy("h").limit(SAMPLE).collect()
    chosen = {r["doc_id"]: (r["good"], r["h"] % 5 == 0) for r in sample}
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts, documents = _counts(texts, chosen)
    learned = [good for good, held in chosen.values() if not held]
    fitted = model(counts[:, 2], counts[:, 1], sum(learned) / max(1, len(learned)), counts[:, 0] / max(1, documents))
    trial = spark.sparkContext.broadcast(fitted)
    later = {i: good for i, (good, held) in chosen.items() if held}
    sent, ids = spark.sparkContext.broadcast(later), F.broadcast(spark.createDataFrame([(i,) for i in later], "doc_id long"))  # SAMPLE rows at most

    def calibrate(doc_id: list, text: list) -> dict:
        return {"doc_id": doc_id, "w": list(map(trial.value.log_weight, text)), "good": [sent.value[i] for i in doc_id]}

    # A repeated id counts once, as the largest weight it has.
    scored = map_batches(texts.join(ids, "doc_id", "left_semi"), calibrate, "doc_id long, w double, good boolean").groupBy("doc_id").agg(F.max("w").alias("w"), F.first("good").alias("good"))
    return replace(fitted, threshold=separating([(r["w"], r["good"]) for r in scored.collect()]))


def score(docs: DataFrame, fitted: Model) -> DataFrame:
    """``doc_id, log_weight, key, bits`` for every document; ``bits`` sorts as the key does."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted)

    def each(doc_id: list, text: list) -> dict:
        weights = [sent.value.log_weight(t) for t in text]
        keys = list(map(sent.value.key, text, weights))
        return {"doc_id": doc_id, "log_weight": weights, "key": keys, "bits": list(map(ordered_bits, keys))}

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), each, "doc_id long, log_weight double, key double, bits long")


def ordered_bits(key: float) -> int:
    """A signed 64-bit number that sorts as the double does."""
    n = int(np.float64(key + 0.0).view(np.int64))
    return n if n >= 0 else n ^ 0x7FFFFFFFFFFFFFFF


def kth_largest(scored: DataFrame, k: int) -> int | None:
    """The k-th largest ``bits`` by four counts of 16 bits each; None if there is none."""
    left = k
    if k <= 0:
        return None
    rows, prefix = scored.select(F.col("bits").alias("b")), 0
    for shift in (48, 32, 16, 0):
        digit = F.expr(f"shiftright(b, {shift})") if shift == 48 else F.expr(f"shiftright(b, {shift}) & 65535L")
        bins = rows.groupBy(digit.alias("d")).count().collect()
        for d, n in sorted(((r["d"], r["count"]) for r in bins), reverse=True):
            if left <= n:
                break
            left -= n
        else:
            return None
        rows = rows.where(digit == d)
        prefix = d << 48 if shift == 48 else prefix | d << shift
    return prefix


def _decide(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame, int | None]:
    """The model, all scores, and the least ``bits`` that is drawn."""
    fitted = fit(docs, labels)
    scored = cut(score(docs, fitted))
    k = scored.where(F.col("log_weight") >= fitted.threshold).count()
    return fitted, scored, kth_largest(scored, k)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, log_weight, gumbel_key, kept`` for every document."""
    _, scored, least = _decide(docs, labels)
    kept = F.lit(False) if least is None else F.col("bits") >= F.lit(least)
    return scored.select("doc_id", "log_weight", F.col("key").alias("gumbel_key"), kept.alias("kept"))


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are drawn, all columns as they were. Texts are scored once, beside their rows."""
    fitted = fit(docs, labels)
    if not math.isfinite(fitted.threshold):
        return docs
    spark, at = docs.sparkSession, docs.columns.index("text")
    sent = spark.sparkContext.broadcast(fitted)
    names = [next(n for k in range(len(docs.columns) + 2) if (n := f"{name}_{k}") not in docs.columns) for name in ("weight", "bits")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            weights = [sent.value.log_weight(t) for t in texts]
            bits = [ordered_bits(sent.value.key(t, w)) for t, w in zip(texts, weights)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights, pa.float64()), pa.array(bits, pa.int64())], names=[*batch.schema.names, *names])

    schema = StructType([*docs.schema.fields, StructField(names[0], DoubleType()), StructField(names[1], LongType())])
    scored = cut(docs.mapInArrow(run, schema))
    weight, bits = scored[names[0]], scored[names[1]]
    least = kth_largest(scored.select(bits.alias("bits")), scored.where(weight >= fitted.threshold).count())
    return scored.where(F.lit(False) if least is None else bits >= F.lit(least)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn documents; the classifier rejects the others."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("kept")
