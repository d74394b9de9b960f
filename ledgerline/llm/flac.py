"""Operator 4: FLAC media columns.

``encode`` writes a mono stream of samples of 8 to 24 bits, each block with the smallest of constant, verbatim, fixed and
linear predictors (Levinson-Durbin on the block) and Rice residuals; ``decode`` reads any mono FLAC stream:
constant, verbatim, fixed and LPC subframes, both Rice methods and escaped partitions. It verifies the
header CRC-8 and frame CRC-16 of every frame and the MD5 of all samples, and returns PCM blocks with the
sample offset of each. ``seek`` goes by the SEEKTABLE and decodes from the nearest point on.

A linear predictor runs sample by sample; the frames of many streams run in step, a sample of each at a time.

Finding where Rice codes begin is a walk over a jump table (code start -> next code start); the table is
composed with itself four times and the walk takes every sixteenth step, so numpy does most of the work.

Contract form: payload = UTF-8 bytes, then bytes 255 up to a positive multiple of 576; sample = byte - 128.
Cases: a null or empty text is 576 bytes of 255; a very long text is many blocks, each coded alone; of equally small
subframes the linear one is written; a damaged stream raises ``ValueError``; equal texts give
equal rows, repeated rows repeated ones; extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import map_batches, table, utf8

UNIT, BLOCK, RATE = 576, 4608, 8000
#: Samples between seek points.
SEEK_EVERY = BLOCK * 4
_PAD = 255
#: Order of the predictors that are written, and their coefficients' shift and precision.
ORDER, SHIFT, PRECISION = 4, 12, 15


# --- checksums ------------------------------------------------------------------------------------


def _crc_table(poly: int, width: int) -> np.ndarray:
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for byte in range(256):
        crc = byte << (width - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly if crc & top else crc << 1) & mask
        out.append(crc)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8).tolist(), _crc_table(0x8005, 16)


@lru_cache(maxsize=1)
def _crc16_by_distance() -> np.ndarray:
    """Row d: what each byte value adds to the CRC of a frame in which d bytes follow it."""
    rows, at = np.empty((1024, 256), np.uint16), _CRC16
    for d in range(1024):
        rows[d] = at
        at = (at << np.uint16(8)) ^ _CRC16[at >> np.uint16(8)]
    return rows


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8[crc ^ b]
    return crc


def crc16(data: bytes) -> int:
    """The CRC is linear, so the bytes of a chunk are looked up at once and added up."""
    table, crc = _crc16_by_distance(), 0
    raw = np.frombuffer(data, np.uint8)
    for i in range(0, len(raw), 1024):
        chunk = raw[i : i + 1024].copy()
        if crc:  # the CRC so far is the same as two more bytes at the front
            chunk[0] ^= crc >> 8
            if len(chunk) > 1:
                chunk[1] ^= crc & 255
                carry = 0
            else:
                carry = (crc & 255) << 8
        else:
            carry = 0
        crc = int(np.bitwise_xor.reduce(table[np.arange(len(chunk) - 1, -1, -1), chunk])) ^ carry
    return crc


# --- writing --------------------------------------------------------------------------------------


def _number(n: int) -> bytes:
    """A frame number as FLAC codes it: UTF-8 stretched to 36 bits."""
    if n < 0x80:
        return bytes([n])
    out = []
    while n >= 1 << (6 - len(out)):
        out.append(0x80 | n & 63)
        n >>= 6
        if len(out) == 6:
            break
    lead = 0xFF << (7 - len(out)) & 0xFF
    return bytes([lead | n, *reversed(out)])


def _field(value: int, width: int) -> np.ndarray:
    return (value >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8)


def _fields(values: np.ndarray, width: int) -> np.ndarray:
    return (values.astype(np.int64)[:, None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8).ravel()


def rice_bits(residual: np.ndarray, k: int) -> np.ndarray:
    """The codes of a partition, as an array of bits."""
    folded = np.where(residual < 0, -2 * residual - 1, 2 * residual)
    high = folded >> k
    ends = np.cumsum(high + 1 + k)
    bits = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    stops = ends - 1 - k
    bits[stops] = 1
    for b in range(k):
        bits[stops + 1 + b] = folded >> (k - 1 - b) & 1
    return bits


def _best_rice(residual: np.ndarray) -> tuple[int, int]:
    """(parameter, bits) of the cheapest single partition."""
    folded = np.where(residual < 0, -2 * residual - 1, 2 * residual)
    near = max(0, int(folded.mean() + 0.5).bit_length() - 1) if len(folded) else 0
    return min(((k, int((folded >> k).sum()) + (1 + k) * len(folded)) for k in range(max(0, near - 1), min(30, near + 1) + 1)), key=lambda x: x[1])


def _coded(residual: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """A residual as one partition; parameters above 14 need the method with five bits."""
    wide = k > 14
    return _field(wide << 4, 6), _field(k, 4 + wide), rice_bits(residual, k)


def predictor(samples: np.ndarray, order: int) -> list[int] | None:
    """Coefficients of the least-squares predictor of a block, scaled; None if there is none that can be coded."""
    x, n = samples.astype(float), len(samples)
    if n <= 2 * order:
        return None
    r = [float(x[: n - k] @ x[k:]) for k in range(order + 1)]
    error, a = r[0], []
    for i in range(order):
        if error <= 0:
            return None
        k = (r[i + 1] - sum(c * r[i - j] for j, c in enumerate(a))) / error
        a = [c - k * d for c, d in zip(a, reversed(a))] + [k]
        error *= 1 - k * k
    out = [round(c * (1 << SHIFT)) for c in a]
    return out if all(abs(c) < 1 << (PRECISION - 1) for c in out) and any(out) else None


def _linear(samples: np.ndarray, width: int, coefficients: list[int], shift: int) -> tuple[int, tuple]:
    """(bits, (fields, residual, parameter)) of an LPC subframe."""
    n, order = len(samples), len(coefficients)
    guess = sum(c * samples[order - 1 - j : n - 1 - j] for j, c in enumerate(coefficients)) >> shift
    residual = samples[order:] - guess
    k, size = _best_rice(residual)
    head = _field(0b01000000 | (order - 1) << 1, 8), _fields(samples[:order], width), _field(PRECISION - 1, 4), _field(shift, 5), _fields(np.array(coefficients), PRECISION)
    return size + 27 + order * (width + PRECISION) + (k > 14), (head, residual, k)


def _subframe(samples: np.ndarray, width: int, lpc: tuple[list[int], int] | None) -> np.ndarray:
    """Bits of the smallest subframe (or of an LPC one with the given coefficients and shift)."""
    n = len(samples)
    if lpc is None and (samples == samples[0]).all():
        return np.concatenate((_field(0, 8), _fields(samples[:1], width)))
    found = [_linear(samples, width, *lpc)] if lpc else []
    if not found:
        if c := predictor(samples, ORDER):
            found.append(_linear(samples, width, c, SHIFT))
        residual, costs = samples, []
        for order in range(min(4, n - 1) + 1):
            if order:
                residual = np.diff(residual)
            costs.append((int(np.abs(residual).sum()), order, residual))
        _, order, residual = min(costs, key=lambda x: x[:2])
        k, size = _best_rice(residual)
        found.append((size + 18 + width * order + (k > 14), ((_field(0b10000 | order << 1, 8), _fields(samples[:order], width)), residual, k)))
        found.append((8 + width * n, ((_field(0b10, 8), _fields(samples, width)), None, 0)))
    head, residual, k = min(found, key=lambda x: x[0])[1]
    return np.concatenate((*head, *(() if residual is None else _coded(residual, k))))


_SIZE_CODES = {8: 1, 12: 2, 16: 4, 20: 5, 24: 6}


def _pcm(samples: np.ndarray, width: int) -> bytes:
    """Little-endian samples of as many whole bytes as the width needs, as the MD5 takes them."""
    size = -(-width // 8)
    return samples.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :size].tobytes()


def encode(samples: np.ndarray, width: int = 8, block: int = BLOCK, lpc: tuple[list[int], int] | None = None) -> bytes:
    """A mono stream of signed samples."""
    samples = samples.astype(np.int64)
    n, frames, sizes = len(samples), [], []
    for number, at in enumerate(range(0, n, block)):
        part = samples[at : at + block]
        head = b"\xff\xf8" + bytes([0x70 | 0x0, _SIZE_CODES[width] << 1]) + _number(number) + struct.pack(">H", len(part) - 1)
        head += bytes([crc8(head)])
        body = head + np.packbits(_subframe(part, width, lpc if lpc and len(part) > len(lpc[0]) else None)).tobytes()
        frames.append(body + struct.pack(">H", crc16(body)))
        sizes.append(len(frames[-1]))
    starts = np.concatenate(([0], np.cumsum(sizes))).tolist()
    points = [(at, starts[at // block], min(block, n - at)) for at in range(0, n, SEEK_EVERY) if at % block == 0]
    info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | (width - 1) << 36 | n).to_bytes(8, "big") + hashlib.md5(_pcm(samples, width)).digest()
    seek = b"".join(struct.pack(">QQH", *p) for p in points)
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


# --- reading --------------------------------------------------------------------------------------


class _Bits:
    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        a, b = self.at, self.at + n
        if b > 8 * len(self.data):
            raise ValueError("the stream ends within a frame")
        self.at = b
        whole = int.from_bytes(self.data[a >> 3 : (b + 7) >> 3], "big")
        return whole >> (-b % 8) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n

    def many(self, count: int, width: int) -> np.ndarray:
        """Signed numbers of one width."""
        if not width:
            return np.zeros(count, np.int64)
        if not self.at % 8 and width == 8:
            out = np.frombuffer(self.data, "i1", count, self.at >> 3).astype(np.int64)
            self.at += 8 * count
            return out
        if self.at + count * width > 8 * len(self.data):
            raise ValueError("the stream ends within a frame")
        first = self.at >> 3
        bits = np.unpackbits(np.frombuffer(self.data, np.uint8, ((self.at + count * width + 7) >> 3) - first, first))[self.at & 7 :][: count * width]
        self.at += count * width
        out = bits.reshape(count, width).astype(np.int64) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))
        return np.where(out >> (width - 1), out - (1 << width), out)

    def rice(self, count: int, k: int) -> np.ndarray:
        """Decoded residuals of one partition."""
        if not count:
            return np.zeros(0, np.int64)
        first, skip, known = self.at >> 3, self.at & 7, 4 * count + (1 + k) * count
        while True:  # how long the partition is shows only while it is decoded
            size = min((skip + known + 7) >> 3, len(self.data) - first)
            bits = np.unpackbits(np.frombuffer(self.data, np.uint8, size, first))[skip:]
            got = _rice_starts(bits, count, k)
            if got is not None:
                break
            if first + size >= len(self.data):
                raise ValueError("the stream ends within a residual")
            known *= 4
        starts, stops = got
        value = (stops - starts) << k
        for b in range(k):
            value += bits[stops + 1 + b].astype(np.int64) << (k - 1 - b)
        self.at += int(stops[-1]) + 1 + k
        return np.where(value & 1, -(value + 1 >> 1), value >> 1)


_STEP = 16


def _rice_starts(bits: np.ndarray, count: int, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Where each code starts and where its unary part stops; None if the bits don't hold ``count`` codes."""
    ones = np.flatnonzero(bits)
    if len(ones) < count:
        return None
    # Walk over the stop bits: after stop i the next code starts at ones[i] + 1 + k and stops at the first one there.
    rank = np.zeros(len(bits) + 2 + k, np.int32)
    np.cumsum(bits, out=rank[1 : len(bits) + 1], dtype=np.int32)
    rank[len(bits) + 1 :] = len(ones)
    jump = np.append(rank[ones + 1 + k], np.int32(len(ones)))
    far = jump
    for _ in range(4):
        far = far[far]
    heads, at, item = [], 0, far.item
    for _ in range((count + _STEP - 1) // _STEP):
        heads.append(at)
        at = item(at)
    walk = np.empty((_STEP, len(heads)), np.int64)
    walk[0] = heads
    for i in range(1, _STEP):
        walk[i] = jump[walk[i - 1]]
    index = walk.T.ravel()[:count]
    if index[-1] >= len(ones):
        return None
    stops = ones[index]
    if stops[-1] + 1 + k > len(bits):
        return None
    return np.concatenate(([0], stops[:-1] + 1 + k)), stops


def _residual(bits: _Bits, n: int, order: int) -> np.ndarray:
    method, parts = bits.take(2), bits.take(4)
    if method > 1 or n % (1 << parts):
        raise ValueError("a residual's coding isn't known")
    width, out = 4 + method, []
    for p in range(1 << parts):
        count = (n >> parts) - (order if p == 0 else 0)
        k = bits.take(width)
        out.append(bits.many(count, bits.take(5)) if k == (1 << width) - 1 else bits.rice(count, k))
    return np.concatenate(out)


class _Linear:
    """An LPC subframe before its predictor has run."""

    def __init__(self, start: np.ndarray, coefficients: list[int], shift: int, residual: np.ndarray, wasted: int) -> None:
        self.start, self.coefficients, self.shift, self.residual, self.wasted = start, coefficients, shift, residual, wasted


def _predicted(frames: list[_Linear]) -> list[np.ndarray]:
    """Samples of LPC subframes. Those of one order run in step, longest first, so that the ones that end drop off."""
    out: list = [None] * len(frames)
    for order in {len(f.coefficients) for f in frames}:
        own = sorted((k for k, f in enumerate(frames) if len(f.coefficients) == order), key=lambda k: -len(frames[k].residual))
        sizes = np.array([len(frames[k].residual) for k in own])
        x = np.zeros((order + sizes[0], len(own)), np.int64)
        for column, k in enumerate(own):
            x[:order, column] = frames[k].start
            x[order : order + sizes[column], column] = frames[k].residual
        c = np.array([frames[k].coefficients[::-1] for k in own], np.int64).T
        shift = np.array([frames[k].shift for k in own], np.int64)
        running = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left").tolist()  # longer than t
        for t, n in enumerate(running):
            x[t + order, :n] += (c[:, :n] * x[t : t + order, :n]).sum(axis=0) >> shift[:n]
        for column, k in enumerate(own):
            out[k] = x[: order + sizes[column], column] << frames[k].wasted
    return out


def _restore(bits: _Bits, n: int, width: int) -> np.ndarray | _Linear:
    """The samples of one subframe, or what its predictor needs."""
    if bits.take(1):
        raise ValueError("a subframe doesn't begin with 0")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.unary() + 1
        width -= wasted
    if kind == 0:
        out = np.full(n, bits.signed(width), np.int64)
    elif kind == 1:
        out = bits.many(n, width)
    elif 8 <= kind <= 12:
        order = kind - 8
        start = bits.many(order, width)
        out = _residual(bits, n, order)
        for k in range(order - 1, -1, -1):  # undo one difference at a time, from its own first value
            out = np.cumsum(np.concatenate((np.diff(start, k)[:1], out)))
        return out << wasted
    elif kind >= 32:
        order = kind - 31
        start = bits.many(order, width)
        precision, shift = bits.take(4) + 1, bits.signed(5)
        coefficients = [bits.signed(precision) for _ in range(order)]
        if precision == 16 or shift < 0:
            raise ValueError("a predictor's coding isn't known")
        return _Linear(start, coefficients, shift, _residual(bits, n, order), wasted)
    else:
        raise ValueError("a subframe's type isn't known")
    return out << wasted


_BLOCKS = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
_WIDTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}


class Stream:
    """Where a stream's parts are: width and number of samples, their MD5, seek points, the first frame."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, info, self.points = 4, False, None, []
        while not last:
            last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            if kind == 0:
                info = body
            elif kind == 3:
                self.points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
            at += 4 + size
        if info is None:
            raise ValueError("no stream information")
        packed = int.from_bytes(info[10:18], "big")
        if packed >> 41 & 7:
            raise ValueError("more than one channel")
        self.data, self.first, self.width, self.total, self.md5 = data, at, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, info[18:34]

    def frame(self, at: int) -> tuple[int, int, np.ndarray | _Linear]:
        """(where the next begins, samples, content) of the frame at a place; its checksums are verified."""
        data, bits = self.data, _Bits(self.data, at)
        if bits.take(15) != 0x7FFC:
            raise ValueError("a frame's sync code is missing")
        bits.take(1)
        size, rate, channels, depth = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        bits.take(1)
        lead = bits.take(8)
        bits.take(8 * max(0, 7 - (0xFF ^ lead).bit_length()) if lead < 0x80 else 8 * (7 - (0xFF ^ lead).bit_length()))
        n = bits.take(8) + 1 if size == 6 else bits.take(16) + 1 if size == 7 else _BLOCKS.get(size, 0)
        bits.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
        head = bits.at >> 3
        if crc8(data[at:head]) != bits.take(8):
            raise ValueError("a frame header's checksum is wrong")
        if channels or not n:
            raise ValueError("a frame's form isn't known")
        content = _restore(bits, n, _WIDTHS.get(depth, self.width))
        end = (bits.at + 7) >> 3
        if crc16(data[at:end]) != int.from_bytes(data[end : end + 2], "big"):
            raise ValueError("a frame's checksum is wrong")
        return end + 2, n, content

    def frames(self, at: int, offset: int) -> Iterator[tuple[int, int, np.ndarray | _Linear]]:
        """(sample offset, samples, content) of each frame from a place on."""
        while offset < self.total:
            at, n, content = self.frame(at)
            yield offset, n, content
            offset += n


def _run(contents: list[np.ndarray | _Linear]) -> list[np.ndarray]:
    done = iter(_predicted([c for c in contents if isinstance(c, _Linear)]))
    return [next(done) if isinstance(c, _Linear) else c for c in contents]


def all_blocks(streams: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """(sample offset, samples) of each frame of each stream, all checksums verified; predictors of all streams run in step."""
    opened = [Stream(data) for data in streams]
    parsed = [list(s.frames(s.first, 0)) for s in opened]
    samples = iter(_run([content for frames in parsed for _, _, content in frames]))
    out = [[(offset, next(samples)) for offset, _, _ in frames] for frames in parsed]
    for s, found in zip(opened, out):
        if s.md5 != bytes(16):
            md5 = hashlib.md5()
            for _, x in found:
                md5.update(_pcm(x, s.width))
            if md5.digest() != s.md5:
                raise ValueError("the samples' MD5 is wrong")
    return out


def blocks(data: bytes) -> list[tuple[int, np.ndarray]]:
    return all_blocks([data])[0]


def decode(data: bytes) -> np.ndarray:
    parts = [b for _, b in blocks(data)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def seek(data: bytes, sample: int) -> tuple[int, np.ndarray]:
    """The PCM block that holds a sample, and its offset; decoded from the last seek point at or before it."""
    stream = Stream(data)
    offset, place = max(((p[0], p[1]) for p in stream.points if p[0] <= sample), default=(0, 0))
    for at, n, content in stream.frames(stream.first + place, offset) if sample >= 0 else ():
        if sample < at + n:
            return at, _run([content])[0]
    raise IndexError(sample)


# --- columns --------------------------------------------------------------------------------------


def pad(raw: bytes) -> bytes:
    return raw + bytes([_PAD]) * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def store(raw: bytes) -> bytes:
    """The padded payload as a FLAC stream."""
    return encode(np.frombuffer(pad(raw), np.uint8).astype(np.int64) - 128)


def load(media: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """PCM blocks (sample offset, bytes of the payload) of each stream."""
    return [[(offset, (samples + 128).astype(np.uint8).tobytes()) for offset, samples in found] for found in all_blocks(media)]


def feature(pcm: bytes) -> str:
    """Sample count, blocks, root mean square (thousandths), zero crossings, peak."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};blocks={-(-len(x) // BLOCK)};rms={int(1000 * (int((x * x).sum()) / len(x)) ** 0.5)};zc={crossings};peak={int(np.abs(x).max())}"


def media_columns(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Stores every text, reads it back and describes it; the stream and its blocks too if asked for."""

    def each(doc_id: list, text: list) -> dict:
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(["media", "blocks"] if with_media else [])]
        out: dict = {"doc_id": doc_id} | {n: [] for n in names}
        raws = list(map(utf8, text))
        stored = list(map(store, raws))
        for raw, media, found in zip(raws, stored, load(stored)):
            pcm = b"".join(b for _, b in found)
            row = (len(raw), len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(pcm), media, [{"sample": o, "pcm": b} for o, b in found])
            for n, v in zip(names, row):
                out[n].append(v)
        return out

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", media binary, blocks array<struct<sample: long, pcm: binary>>" * with_media
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), each, schema)


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
