"""Delivered messages written again in the feed's framing, in order: files that follow each other."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerline.sources.feed import _open


def framed(body: bytes) -> bytes:
    return len(body).to_bytes(2, "big") + body


def write_bodies(messages: DataFrame, folder: str) -> list[str]:
    """``seq, body`` as files in order of ``seq``, one a task; only those of tasks that succeeded are named."""

    def run(batches):
        path, out = None, None
        for batch in batches:
            for seq, body in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = f"{folder}/{seq:020d}-{uuid.uuid4().hex}"
                    out = _open(path, write=True)
                out.write(framed(body))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path]})

    ordered = messages.select("seq", "body").repartitionByRange("seq").sortWithinPartitions("seq")
    return sorted(r.path for r in ordered.mapInArrow(run, "path string").collect())


def capture_batches(folder: str):
    """For ``foreachBatch`` of a stream of delivered messages: each batch goes to a folder of its own."""

    def write(batch: DataFrame, number: int) -> None:
        write_bodies(batch, f"{folder}/{number:012d}")

    return write
