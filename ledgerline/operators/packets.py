"""MoldUDP-style packets: packing, headers, validation, seeded loss, UDP frames."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, StringType, StructField, StructType

# Fixed values of the packet format.
HEADER, PAYLOAD, MAX_COUNT, HEARTBEAT, END = 20, 1400, 65534, 0, 65535
# End of fixed values.


def pack(bodies: list[bytes], session: str, first: int = 1, payload: int = PAYLOAD, max_count: int = MAX_COUNT) -> Iterator[bytes]:
    """Greedy: blocks go in while they fit; one that is too large alone goes alone."""
    at = 0
    while at < len(bodies):
        parts, size = [], HEADER
        while at + len(parts) < len(bodies) and len(parts) < max_count:
            block = bodies[at + len(parts)]
            if parts and size + 2 + len(block) > payload:
                break
            parts.append(struct.pack(">H", len(block)) + block)
            size += 2 + len(block)
        yield session.ljust(10).encode()[:10] + struct.pack(">QH", first + at, len(parts)) + b"".join(parts)
        at += len(parts)


def packetise(messages: DataFrame, session: str, payload: int = PAYLOAD) -> DataFrame:
    """``session, seq, body`` -> ``packet, session, seq, count, data``. Greedy filling is sequential within a session."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        made = list(pack([bytes(b) for b in pdf.body], pdf.session.iloc[0], int(pdf.seq.iloc[0]), payload))
        heads = [struct.unpack_from(">QH", p, 10) for p in made]
        return pd.DataFrame({"packet": range(len(made)), "session": pdf.session.iloc[0], "seq": [h[0] for h in heads], "count": [h[1] for h in heads], "data": made})

    return messages.withColumn("session", F.lit(session)).groupBy("session").applyInPandas(one, "packet long, session string, seq long, count int, data binary")


def packetise_sessions(messages: DataFrame, payload: int = PAYLOAD) -> DataFrame:
    """``session, order, body`` -> ``packet, session, seq, count, data``: the sessions apart, each numbered from 1 in its order.

    Greedy filling needs what came before, so a session is one group; its sorted rows come in batches and only the open
    packet is held.
    """

    def one(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session = key[0].as_py().ljust(10).encode()[:10]
        seq, packet, held, size = 1, 0, [], HEADER
        out: list[tuple] = []

        def flush() -> None:
            nonlocal seq, packet, held, size
            data = session + struct.pack(">QH", seq, len(held)) + b"".join(struct.pack(">H", len(b)) + b for b in held)
            out.append((packet, session.decode(), seq, len(held), data))
            seq, packet, held, size = seq + len(held), packet + 1, [], HEADER

        last = None
        for batch in batches:
            for at, body in zip(batch.column("order").to_pylist(), batch.column("body").to_pylist()):
                if last is not None and at < last:
                    raise ValueError("a session's messages came out of order")
                last = at
                if held and (size + 2 + len(body) > payload or len(held) == MAX_COUNT):
                    flush()
                held.append(body)
                size += 2 + len(body)
            if out:
                yield _packed(out)
                out = []
        if held:
            flush()
            yield _packed(out)

    schema = "packet long, session string, seq long, count int, data binary"
    ordered = messages.select("session", "order", "body").repartition("session").sortWithinPartitions("session", "order")
    return ordered.groupBy("session").applyInArrow(one, schema)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["packet", "session", "seq", "count", "data"])


def _be(data: Column, start: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(data, start, n)), 16, 10)


def headers(packets: DataFrame) -> DataFrame:
    """Session, first sequence and count, read from the bytes; null where there are fewer than a header's."""
    data, whole = F.col("data"), F.length("data") >= HEADER
    return packets.withColumns({"session": F.when(whole, F.decode(F.substring(data, 1, 10), "ISO-8859-1")), "seq": F.when(whole, _be(data, 11, 8).cast("decimal(20,0)").cast("long")), "count": F.when(whole, _be(data, 19, 2).cast("int"))})


def blocks(data: bytes) -> list[bytes] | None:
    """Message bodies of a packet; None unless they fill it exactly and are as many as the header says."""
    if len(data) < HEADER:
        return None
    (count,) = struct.unpack_from(">H", data, 18)
    count = 0 if count == END else count
    out, at = [], HEADER
    for _ in range(count):
        if len(data) - at < 2:
            return None
        n = data[at] << 8 | data[at + 1]
        if len(data) - at - 2 < n:
            return None
        out.append(data[at + 2 : at + 2 + n])
        at += 2 + n
    return out if at == len(data) else None


@F.pandas_udf(BooleanType())
def is_valid(data: pd.Series) -> pd.Series:
    return data.map(lambda d: blocks(bytes(d)) is not None)


@F.pandas_udf(ArrayType(BinaryType()))
def message_bodies(data: pd.Series) -> pd.Series:
    """The messages of each valid packet; null for others."""
    return pd.Series([blocks(bytes(d)) if d is not None else None for d in data])


def explode_messages(packets: DataFrame) -> DataFrame:
    """One row a message of the valid packets: seq, body, and the packet's other columns."""
    keep = [c for c in packets.columns if c not in ("data", "seq", "count", "session")]
    found = packets.select(*keep, message_bodies("data").alias("_bodies"), _be(F.col("data"), 11, 8).cast("decimal(20,0)").cast("long").alias("_first"))
    return found.select(*keep, "_first", F.posexplode("_bodies").alias("_at", "body")).select(*keep, (F.col("_first") + F.col("_at")).alias("seq"), "body")


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from 53 hashed bits: the same for the same keys, on any executor."""
    return F.call_function("shiftrightunsigned", F.xxhash64(F.lit(seed), *keys), F.lit(11)) * (2.0**-53)


def lose(packets: DataFrame, line: int, seed: int, drop: float = 0.0, delay: float = 0.0, duplicate: float = 0.0, dead_from: int | None = None, ranges: list[tuple[int, int]] = ()) -> DataFrame:
    """Packets as one line brings them, with the action on each. Dead and ranges come before chance; then drop, delay, duplicate."""
    p = F.col("packet")
    dead = F.lit(False) if dead_from is None else p >= dead_from
    for a, b in ranges:
        dead = dead | ((p >= a) & (p < b))
    u = [uniform(seed, F.lit(line), p, F.lit(k)) for k in range(3)]
    action = F.when(dead | (u[0] < drop), "drop").when(u[1] < delay, "delay").when(u[2] < duplicate, "duplicate").otherwise("send")
    copies = F.when(F.col("action") == "duplicate", F.array(F.lit(0.0), F.lit(0.25))).when(F.col("action") == "delay", F.array(F.lit(1.5))).when(F.col("action") == "send", F.array(F.lit(0.0)))
    return packets.withColumns({"line": F.lit(line), "action": action}).withColumn("late", F.explode_outer(copies)).withColumn("order", p + F.col("late"))


def udp_payload(frame: bytes) -> tuple[str, int, bytes] | None:
    """Destination address, port and payload of an Ethernet frame with whole IPv4 UDP in it, tagged or not."""
    at = 12
    if len(frame) < 14:
        return None
    kind = int.from_bytes(frame[at : at + 2], "big")
    if kind == 0x8100:
        at += 4
        if len(frame) < at + 2:
            return None
        kind = int.from_bytes(frame[at : at + 2], "big")
    at += 2
    if kind != 0x0800 or len(frame) < at + 20 or frame[at] >> 4 != 4:
        return None
    size = (frame[at] & 15) * 4
    total = int.from_bytes(frame[at + 2 : at + 4], "big")
    fragment = int.from_bytes(frame[at + 6 : at + 8], "big") & 0x3FFF
    if size < 20 or frame[at + 9] != 17 or fragment or total < size + 8 or len(frame) < at + total:
        return None
    udp = at + size
    n = int.from_bytes(frame[udp + 4 : udp + 6], "big")
    if n < 8 or size + n > total:
        return None
    return ".".join(map(str, frame[at + 16 : at + 20])), int.from_bytes(frame[udp + 2 : udp + 4], "big"), frame[udp + 8 : udp + n]


@F.pandas_udf(StructType([StructField("dst_ip", StringType()), StructField("dst_port", IntegerType()), StructField("payload", BinaryType())]))
def parsed_frame(frame: pd.Series) -> pd.DataFrame:
    """``udp_payload`` of a column of frames; all three are null where a frame is refused."""
    rows = [udp_payload(bytes(f)) if f is not None else None for f in frame]
    return pd.DataFrame([r or (None, None, None) for r in rows], columns=["dst_ip", "dst_port", "payload"]).astype({"dst_port": "Int32"})


def line_of(port: Column, ports: dict[int, int]) -> Column:
    """The line that a destination port belongs to; null for others."""
    return F.element_at(F.create_map(*(F.lit(x) for item in ports.items() for x in item)), port)
