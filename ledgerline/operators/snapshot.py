"""Snapshots of a whole book: taken, written, fetched, loaded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.fold import Book


@dataclass(frozen=True)
class Snapshot:
    """The book after message ``seq``: the book messages so far, their digest, symbols, and orders in queue order."""

    seq: int
    messages: int
    digest: int
    symbols: tuple[tuple[int, str], ...]
    orders: tuple[tuple[int, str, int, int, int], ...]  # locate, side, price, ref, shares


def take(book: Book, seq: int, messages: int = 0, digest: int = 0) -> Snapshot:
    """Orders by locate, bids before asks, prices upwards, each level in queue order."""
    orders = ((*level, ref, book.orders[ref][3]) for level in sorted(book.queues) for ref in book.queues[level])
    return Snapshot(seq, messages, digest, tuple(sorted(book.symbols.items())), tuple(orders))


def load(book: Book, snapshot: Snapshot) -> None:
    """The book as of the snapshot, whatever it was; counters of messages stay."""
    book.clear()
    book.symbols.update(snapshot.symbols)
    for locate, side, price, ref, shares in snapshot.orders:
        book.restore(ref, locate, side, price, shares)


def target(requested: Column | int, applied: Column | int, published: Column | int):
    """Which sequence a server brings its replica to: what was asked for, not behind where it is, not beyond what was sent."""
    if isinstance(requested, Column):
        return F.least(F.greatest(requested, applied), published)
    return min(max(requested, applied), published)


def write_snapshot(live: DataFrame, seq: int, folder: str) -> str:
    """Orders (locate, side, price, ref, shares, arrival) in queue order as Parquet under ``folder/seq=N``."""
    path = f"{folder}/seq={seq}"
    rows = live.select("locate", "side", "price", "ref", "shares", "arrival")
    rows.repartitionByRange("locate", "side", "price", "arrival").sortWithinPartitions("locate", "side", "price", "arrival").write.mode("overwrite").parquet(path)
    return path


def fetch_snapshot(spark: SparkSession, folder: str, least: int) -> DataFrame | None:
    """The earliest snapshot that covers ``least``; None if there is none. Only its own files are read."""
    snapshots = spark.read.parquet(folder)
    seq = snapshots.where(F.col("seq") >= least).agg(F.min("seq")).first()[0]
    return None if seq is None else snapshots.where(F.col("seq") == seq)


def as_adds(snapshot: DataFrame) -> DataFrame:
    """A snapshot's orders as adds at its sequence, for a plan that starts from it."""
    return snapshot.select(F.col("seq").cast("long").alias("seq"), F.lit("A").alias("type"), "ref", "locate", "side", "price", "shares", "arrival")
