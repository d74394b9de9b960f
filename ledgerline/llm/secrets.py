"""Operator 10: secret scan by an Aho-Corasick keyword prefilter.

One automaton pass over the ASCII-lower-cased text gives the places of all keywords; regular expressions
are then tried only there, anchored at the keyword. Kinds whose format holds a checksum are kept only if
it is right. Long hexadecimal runs have no keyword, so they are found by one direct pass.

Base kinds (exact by contract): assign, access, hex. Added kinds: ``ghtoken`` (prefix, 30 characters and
the CRC-32 of those in base 62), ``iban`` (remainder 1 modulo 97), ``card`` (Luhn). Spans are in code points.

Cases: a null or empty text has no spans; a very long text is passed over once; spans that start at one place are listed by
kind, and ``redact`` joins those that overlap; equal texts give equal spans; repeated rows give repeated rows;
extra columns are dropped, or kept untouched by ``redact``; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import map_batches, sha256, table

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "ghtoken", "iban", "card")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_GITHUB = re.compile(r"(gh[pousr]_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_IBAN = re.compile(r"[:\x20]{1,2}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_CARD = re.compile(r"[:\x20#]{1,3}([0-9](?:[\x20-]?[0-9]){12,18})(?![0-9])")
_DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Keyword (in lower case) and the kind that it announces.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "ghtoken", "gho_": "ghtoken", "ghu_": "ghtoken", "ghs_": "ghtoken", "ghr_": "ghtoken",
    "iban": "iban", "card": "card", "visa": "card", "mastercard": "card",
}


def _automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        made.add_word(word, (kind, len(word)))
    made.make_automaton()
    return made


_WORDS = _automaton()


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = _DIGITS62[r] + out
    return out.rjust(6, "0")


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _at(kind: str, text: str, start: int, length: int) -> tuple[int, int, bool] | None:
    """The match announced by a keyword at ``start``: its span, and whether it counts."""
    if kind == "assign":
        return (*m.span(), len(m[2]) >= 8) if (m := _ASSIGN.match(text, start)) else None
    if kind == "access":
        return (*m.span(), len(m[0]) >= 16) if (m := _ACCESS.match(text, start)) else None
    if kind == "ghtoken":
        return (*m.span(), base62_crc(m[2]) == m[3]) if (m := _GITHUB.match(text, start)) else None
    if kind == "iban":
        return (*m.span(1), mod97(m[1].replace(" ", ""))) if (m := _IBAN.match(text, start + length)) else None
    return (*m.span(1), luhn(re.sub("[^0-9]", "", m[1]))) if (m := _CARD.match(text, start + length)) else None


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """(kind number, start, end) of all spans by start, then kind; leftmost, non-overlapping within a kind."""
    if not text:
        return []
    hits = sorted((last - n + 1, kind, n) for last, (kind, n) in _WORDS.iter(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    ends, out = dict.fromkeys(KINDS, 0), []
    for start, kind, n in hits:
        if start >= ends[kind] and (m := _at(kind, text, start, n)):
            ends[kind] = m[1]
            if m[2]:
                out.append((m[0], KINDS.index(kind), m[1]))
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(k, a, b) for a, k, b in sorted(set(out))]


def scan_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every document."""

    def each(doc_id: list, text: list) -> dict:
        out: dict = {"doc_id": doc_id, "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
        for t in text:
            found = scan(t)
            for k, kind in enumerate(BASE):
                out[f"n_{kind}"].append(sum(x[0] == k for x in found))
            out["base_sha256"].append(sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found if k < len(BASE))))
            out["spans"].append(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found))
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), each, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_text(text: str | None) -> str | None:
    """Every span, overlaps joined, becomes ``[SECRET]``."""
    found = sorted((a, b) for _, a, b in scan(text))
    if not found:
        return text
    parts, at, k = [], 0, 0
    while k < len(found):
        a, b = found[k]
        while k + 1 < len(found) and found[k + 1][0] <= b:
            k += 1
            b = max(b, found[k][1])
        parts += [text[at:a], "[SECRET]"]
        at, k = b, k + 1
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with secrets taken out of ``text``; ``n_chars``, if there, follows; no row goes."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(names.index("text")).to_pylist()
            after = [redact_text(t) for t in before]
            for name, values in (("text", after), ("n_chars", [None if t is None else len(t) for t in after])):
                if name in names:
                    field = batch.schema.field(name)
                    old = batch.column(names.index(name)).to_pylist()
                    new = values if name == "text" else [n if x != y else o for n, x, y, o in zip(values, before, after, old)]
                    batch = batch.set_column(names.index(name), field, pa.array(new, field.type))
            yield batch

    return docs.mapInArrow(run, schema)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
