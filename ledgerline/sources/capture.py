"""Packet captures (the classic file format of 24-byte headers and timed records) as a table and as a stream.

Rows: ``capture`` (the file's place in the order of names), ``rx_ns`` and ``frame``. ``received`` goes on to what a
receiver takes: line by destination port, session, sequence, count and message bodies.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ledgerline.operators.packets import headers, is_valid, line_of, message_bodies, parsed_frame
from ledgerline.sources.feed import _open

# First word of a file by the unit of its fractions of a second, and the link type of Ethernet.
MICROS, NANOS, ETHERNET = 0xA1B2C3D4, 0xA1B23C4D, 1
# End of fixed values.
SCHEMA = "capture int, rx_ns long, frame binary"
_ROWS = 4096


def write_capture(path: str, frames: list[tuple[int, bytes]], nanos: bool = True, order: str = "<") -> None:
    """``(rx_ns, frame)`` as one file."""
    unit = 1 if nanos else 1000
    with open(path, "wb") as out:
        out.write(struct.pack(order + "IHHiIII", NANOS if nanos else MICROS, 2, 4, 0, 0, 1 << 16, ETHERNET))
        for at, frame in frames:
            out.write(struct.pack(order + "IIII", at // 10**9, at % 10**9 // unit, len(frame), len(frame)) + frame)


def read_frames(path: str) -> Iterator[tuple[int, bytes]]:
    """``(rx_ns, frame)`` of a file, either byte order and unit; a record that is cut off ends it."""
    with _open(path) as f:
        head = f.read(24)
        if len(head) < 24:
            return
        for order in "<>":
            unit = {MICROS: 1000, NANOS: 1}.get(struct.unpack(order + "I", head[:4])[0])
            if unit:
                break
        else:
            raise ValueError(f"not a capture: {path}")
        while len(record := f.read(16)) == 16:
            second, part, size, _ = struct.unpack(order + "IIII", record)
            frame = f.read(size)
            if len(frame) < size:
                return
            yield second * 10**9 + part * unit, frame


def read_captures(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The frames of several captures, a task a file."""
    listed = spark.createDataFrame(list(enumerate(paths)), "capture int, path string").repartition(max(1, len(paths)), "capture")

    def run(batches):
        for batch in batches:
            for number, path in zip(*(c.to_pylist() for c in batch.columns)):
                held: list = []
                for row in read_frames(path):
                    held.append(row)
                    if len(held) == _ROWS:
                        yield _batch(number, held)
                        held = []
                if held:
                    yield _batch(number, held)

    return listed.mapInArrow(run, SCHEMA)


def _batch(number: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"capture": pa.array([number] * len(rows), pa.int32()), "rx_ns": pa.array([r[0] for r in rows], pa.int64()), "frame": pa.array([r[1] for r in rows], pa.binary())})


class _Stream(SimpleDataSourceStreamReader):
    """Files of a folder in order of their names; the offset is the number of files taken."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _files(self) -> list[str]:
        return sorted(f"{self.path}/{n}" for n in os.listdir(self.path) if not n.startswith((".", "_")))

    def initialOffset(self) -> dict:
        return {"files": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"files": min(start["files"] + 1, len(self._files()))}
        return iter(list(self.readBetweenOffsets(start, end))), end  # Spark copies this iterator

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for k, path in enumerate(self._files()[start["files"] : end["files"]], start["files"]):
            for at, frame in read_frames(path):
                yield k, at, frame


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger_capture"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options["path"])


def received(frames: DataFrame, ports: dict[int, int]) -> DataFrame:
    """Valid packets of the lines' ports as an arbiter takes them: session, line, arrival, seq, count, bodies."""
    parsed = frames.select("rx_ns", parsed_frame("frame").alias("f")).select(F.col("rx_ns").alias("arrival"), line_of(F.col("f.dst_port"), ports).alias("line"), F.col("f.payload").alias("data"))
    whole = headers(parsed.where("line IS NOT NULL")).where(is_valid("data"))
    return whole.select("session", "line", "arrival", "seq", "count", message_bodies("data").alias("bodies"))
