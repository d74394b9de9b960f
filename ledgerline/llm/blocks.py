"""Exchanges between blocks of documents and buckets of keys.

A block is a bounded run of documents held by one row. It asks about its distinct keys (64-bit hashes);
the keys go to buckets by their leading bits, so buckets are even whatever the data: a key that a third
of all rows hold arrives at most once a block. The number of buckets follows the number of keys.
Arrays travel as Zstandard frames in binary columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: About so many keys of all blocks together meet in one bucket.
KEYS_PER_BUCKET = 1_000_000


def pack(values: np.ndarray, dtype: type) -> bytes:
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(np.ascontiguousarray(values, dtype).tobytes())


def unpack(data: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def bucket_count(keys: int) -> int:
    """A power of two, so that buckets are ranges of leading bits."""
    return 1 << max(0, (max(1, keys) // KEYS_PER_BUCKET).bit_length())


def edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets begin and end in sorted keys."""
    if buckets == 1:
        return np.array([0, len(keys)])
    starts = np.arange(buckets, dtype=np.uint64) << np.uint64(65 - buckets.bit_length())
    return np.append(np.searchsorted(keys, starts), len(keys))


def crc_fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7


def block_rows(batches: Iterator[pa.RecordBatch], size: int, make: Callable[[int, list], dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Runs of (doc_id, text) rows of at most ``size`` characters (one text at least) become rows of ``make``."""
    from pyspark import TaskContext

    number, held, chars = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            text = batch.column(1)[k].as_py()
            if held and chars + len(text or "") > size:
                yield pa.RecordBatch.from_pydict({c: [v] for c, v in make(number, held).items()}, schema=schema)
                number, held, chars = number + 1, [], 0
            held.append((batch.column(0)[k].as_py(), text))
            chars += len(text or "")
    if held:
        yield pa.RecordBatch.from_pydict({c: [v] for c, v in make(number, held).items()}, schema=schema)


def to_blocks(texts: DataFrame, size: int, make: Callable[[int, list], dict], schema: str, arrow: pa.Schema) -> DataFrame:
    return texts.mapInArrow(lambda batches: block_rows(batches, size, make, arrow), schema)
