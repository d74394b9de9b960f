"""Operator 1: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of parts. Every adjacent pair whose bytes are in the vocabulary waits in
the bucket of its merge rank; a two-level bitmap over the ranks answers "lowest non-empty bucket" with two
find-first-set steps. A popped position is stale, and skipped, if its pair has changed.
The work is near-linear in the pre-token, so one pre-token of a whole document is fine.

Cases: a null or empty text has no tokens; a very long text or pre-token takes time in proportion to its length; equal
pairs merge from left to right; repeated rows give repeated rows; extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import map_batches, sha256, table

#: Longer pre-tokens, in bytes, are encoded but not remembered; most pre-tokens in a generation of those that are.
CACHED_BYTES, CACHED = 64, 300_000


class _Known(dict):
    """Pre-tokens that a worker has met, in two generations: what the older one holds moves up when it is
    met again, and the rest of it goes when the younger one is full."""

    def __init__(self, make) -> None:
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> str:
        ids = self.older.get(piece)
        if ids is None:
            ids, keep = self.make(piece)
            if not keep:
                return ids
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder for one rank file (lines of base64 token and rank)."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.named = {str(r): t for r, t in self.tokens.items()}
        self.pairs = [[self.ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]
        self.words = max(self.tokens) // 256 + 1
        self.splits = regex.compile(pattern)
        self.known = _Known(self.named_ids)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token.

        The rank queue: bit h of ``top`` says that ``low`` has a word h with a bit set, bit r of that word
        that the bucket of rank 256 h + r isn't empty. The leftmost position of a bucket goes first.
        """
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n, get = len(piece), ranks.get
        after, before = list(range(1, n + 2)), list(range(-1, n))
        pairs = self.pairs
        have = [pairs[a][b] for a, b in zip(piece, piece[1:])]  # the rank of the pair at a position, or -1
        have += (-1, -1)
        # A bucket is one position, or a heap of them.
        top, low, buckets = 0, [0] * self.words, {}
        for i, r in enumerate(have):
            if r >= 0:
                if r not in buckets:
                    buckets[r] = i
                    h = r >> 8
                    if not low[h]:
                        top |= 1 << h
                    low[h] |= 1 << (r & 255)
                elif type(bucket := buckets[r]) is int:
                    buckets[r] = [bucket, i]
                else:
                    bucket.append(i)
        while top:
            first = top & -top
            high = first.bit_length() - 1
            word = low[high]
            bit = word & -word
            rank = high << 8 | bit.bit_length() - 1
            i = buckets[rank]
            if type(i) is int:
                del buckets[rank]
                low[high] = word = word ^ bit
                if not word:
                    top ^= first
            else:
                bucket, i = i, heappop(i)
                if len(bucket) == 1:
                    buckets[rank] = bucket[0]
            if have[i] != rank:  # stale
                continue
            j = after[i]
            after[i] = end = after[j]
            before[end] = i
            have[j] = have[i] = -1
            # The pairs that the merged part makes with its neighbours, right and left.
            at = i
            r = get(piece[i : after[end]]) if end < n else None
            while True:
                if r is not None:
                    have[at] = r
                    if r not in buckets:
                        buckets[r] = at
                        h = r >> 8
                        if not low[h]:
                            top |= 1 << h
                        low[h] |= 1 << (r & 255)
                    elif type(bucket := buckets[r]) is int:
                        buckets[r] = [bucket, at] if bucket < at else [at, bucket]
                    else:
                        heappush(bucket, at)
                if at != i or (at := before[i]) < 0:
                    break
                have[at] = -1
                r = get(piece[at:end])
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(ranks[piece[i:j]])
            i = j
        return out

    def named_ids(self, piece: str) -> tuple[str, bool]:
        """The ids of a pre-token as decimals joined by spaces, and whether to remember them."""
        raw = piece.encode("utf-8", "surrogatepass")
        return " ".join(map(str, self.merge(raw))), len(raw) <= CACHED_BYTES

    def encode_text(self, text: str) -> str:
        """All ids of a text as decimals joined by spaces."""
        return " ".join(map(self.known.__getitem__, self.splits.findall(text)))

    def encode(self, text: str | None) -> list[int]:
        return list(map(int, self.encode_text(text or "").split()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_text(self, ids: str) -> bytes:
        return b"".join(map(self.named.__getitem__, ids.split()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker and file."""
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, ids: bool = False) -> DataFrame:
    """Per document ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and the ids themselves if asked for."""

    def each(doc_id: list, text: list) -> dict:
        tok, out = codec(vocabulary, pattern), {"doc_id": doc_id, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        if ids:
            out["token_ids"] = []
        for t in text:
            named = tok.encode_text(t or "")
            out["n_tokens"].append(named.count(" ") + 1 if named else 0)
            out["ids_sha256"].append(sha256(named))
            out["decoded_sha256"].append(sha256(tok.decode_text(named)))
            if ids:
                out["token_ids"].append(np.fromstring(named, np.int32, sep=" ") if named else np.zeros(0, np.int32))
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), each, schema)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
