"""Operator 8: WARC archives compressed with a Zstandard dictionary that they carry.

A dictionary is built from a bounded sample of the records, put into a leading skippable frame
(magic 0x184D2A5D) of every archive, and each record is one Zstandard frame made with it; a reader
needs nothing but the archive, and any record can be read alone from its offset. Of equal payloads
(SHA-1), the one with the largest page_id is the response and the others are revisits without payload.

Archives are files in the shared folder, one a task, written under a temporary name and renamed, so that
a repeated task replaces its own file. Roles come from a count per digest (a partial aggregate) joined
back by digest, which adaptive execution splits when one payload is very common.

Cases: a null html is an empty payload, a null url an empty target; a very long page is one record like any other; a null page_id is written without id
and loses to any other of its payload; repeated rows: of those that share the largest id of a payload
every one is the response; an empty table makes no archive and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, sample_texts, shared_dir, table, utf8

MAGIC = (0x184D2A5D).to_bytes(4, "little")
#: The dictionary is built from so many records (the smallest hashes of their ids; the only sample taken).
SAMPLE, DICTIONARY_BYTES, LEVEL = 400, 64 << 10, 3
#: Smallest payload, in bytes, that is stored once only.
LEAST = 0


def build_dictionary(payloads: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, the sampled payloads themselves are the (raw) one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, payloads).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(payloads)[-DICTIONARY_BYTES:]


def skippable(dictionary: bytes) -> bytes:
    return MAGIC + len(dictionary).to_bytes(4, "little") + dictionary


def _as_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: int | None) -> bytes:
    """One WARC/1.1 record; ``revisit`` is the page_id of the response with the same payload."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = {
        "WARC-Type": "response" if revisit is None else "revisit",
        "WARC-Record-ID": name(page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": str(len(payload)),
    }
    if revisit is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": name(revisit)}
    body = payload if revisit is None else b""
    head |= {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(body))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "surrogatepass") + b"\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives and returns their index: ``archive, offset, length`` a record."""
    spark = pages.sparkSession
    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sample = [utf8(t) for t in sample_texts(plain, "page_id", "html", SAMPLE)]
    dictionary = spark.sparkContext.broadcast(build_dictionary(sample))
    sha = F.sha1(F.col("html").cast("binary"))
    groups = cut(plain.select("page_id", sha.alias("sha"), F.length(F.col("html").cast("binary")).alias("n")).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("copies"), F.max("n").alias("n")).where(f"copies > 1 AND n >= {LEAST}").select("sha", "first"))
    roles = plain.withColumn("sha", sha).join(groups, "sha", "left").select("page_id", "url", "html", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        raw, task = dictionary.value, TaskContext.get()
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_as_dictionary(raw), write_checksum=True, write_content_size=True)
        name = f"part-{task.partitionId():06d}.warc.zst"
        draft, out, at, index = f"{root}/.{name}.{task.taskAttemptId()}", None, 0, []
        for batch in batches:
            for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(draft)
                    out.write(skippable(raw))
                    at = 8 + len(raw)
                payload = utf8(html)
                revisit = first if first is not None and first != page_id else None
                frame = squeeze.compress(record(page_id, url, payload, digest(payload), revisit))
                out.write(frame)
                index.append((at, len(frame)))
                at += len(frame)
        if out is not None:
            out.close()
            store.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"archive": [name] * len(index), "offset": [a for a, _ in index], "length": [n for _, n in index]}, schema=_INDEX)

    return cut(roles.mapInArrow(write, "archive string, offset long, length long"))


_INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def read_frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, by nothing but the archive."""
    raw, at = b"", 0
    while data[at : at + 4] == MAGIC:
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        raw, at = data[at + 8 : at + 8 + n], at + 8 + n
    expand = zstandard.ZstdDecompressor(dict_data=_as_dictionary(raw))
    while at < len(data):
        one, start = expand.decompressobj(), at
        parts = []
        while not one.eof and at < len(data):
            parts.append(one.decompress(data[at : at + (1 << 14)]))
            at = min(at + (1 << 14), len(data))
        at -= len(one.unused_data)
        if at == start:
            raise ValueError("an archive ends within a record")
        yield b"".join(parts)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Reads every record back from its archive, in runs of neighbouring records.

    ``page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload`` of each record; a
    response's payload is checked against its digest.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        opened: dict[str, tuple] = {}
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _RECORDS}
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive not in opened:
                    for file, _ in opened.values():
                        file.close()
                    opened.clear()
                    file = store.open_input_file(f"{root}/{archive}")
                    head = file.read_at(8, 0)
                    if head[:4] != MAGIC:
                        raise ValueError(f"{archive} doesn't begin with a dictionary")
                    raw = file.read_at(int.from_bytes(head[4:], "little"), 8)
                    opened[archive] = file, zstandard.ZstdDecompressor(dict_data=_as_dictionary(raw))
                file, expand = opened[archive]
                fields, body = parse(expand.decompress(file.read_at(length, offset)))
                found = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                response = fields["WARC-Type"] == "response"
                if response and digest(body) != found:
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
                number = lambda s: int(s) if (s := s.removeprefix("<urn:page:").removesuffix(">")) else None
                row = (number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], found, int(fields["X-Payload-Length"]), None if response else number(fields["WARC-Refers-To"]), body if response else None)
                for f, v in zip(_RECORDS, row):
                    out[f.name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_RECORDS)

    return index.mapInArrow(read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 is written out from the digest's bits, five at a time.
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS hex FROM p),
g AS (SELECT hex, max(page_id) AS top FROM d GROUP BY hex),
b AS (SELECT hex, top, list_transform(range(40), lambda i: strpos('0123456789abcdef', hex[i + 1]) - 1) AS x FROM g),
t AS (SELECT hex, top, list_transform(range(160), lambda j: (x[(j // 4)::INT + 1] >> (3 - j % 4)::INT) & 1) AS bits FROM b),
e AS (SELECT hex, top, array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(16 * bits[5*k+1] + 8 * bits[5*k+2] + 4 * bits[5*k+3] + 2 * bits[5*k+4] + bits[5*k+5])::INT + 1]), '') AS b32 FROM t)
SELECT page_id, n::BIGINT AS payload_bytes, b32 AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM d JOIN e USING (hex)
"""
