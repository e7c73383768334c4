"""Personal data: emails, IPv4 addresses, payment cards and phone numbers.

Plain identifiers are found in the text as it is. Disguised ones are found in
the text that the transducers of ``deobfuscate`` make of it, and mapped back to
source characters; one that overlaps a plain span of its kind is the same and
left out.

Null and empty texts have no spans. Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohorte.llm.common import sliced
from cohorte.llm.deobfuscate import LEAST_WORDS, normalised

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
# possessive: a run of digits is never given back, so long runs stay linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches; from each @ the name is read backwards, so long words cost one pass."""
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > low and text[a - 1] in _LOCAL:
            a -= 1
        host = _HOST.match(text, at + 1) if a < at else None
        if host:
            found.append(("email", a, host.end()))
            low = host.end()
        at = text.find("@", max(at + 1, low))
    return found


def identifiers(text: str) -> list[Span]:
    """The spans that the kinds' patterns and checks give, by kind and start."""
    found = emails(text)
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        d = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


_SPOKEN_PHONE = re.compile(r"(?<![0-9+.])[0-9](?:[\x20().-]{0,3}[0-9]){8,14}(?![0-9])")


def disguised(text: str, plain: list[Span]) -> list[Span]:
    """Spans of ``text`` that only its normalised form shows."""
    tape = normalised(text)
    if tape is None:
        return []
    seen = identifiers(tape.text)
    taken = _cover(seen, len(tape.text))
    for m in _SPOKEN_PHONE.finditer(tape.text):  # digit words need no leading plus
        a, b = m.span()
        spelled = sum(tape.end[i] - tape.start[i] > 1 and tape.text[i] != " " for i in range(a, b))
        if spelled >= LEAST_WORDS and not any(taken[a:b]):
            seen.append(("phone", a, b))
    known = {k: _cover([s for s in plain if s[0] == k], len(text)) for k in KINDS}
    spans = {(k, *tape.source(a, b)) for k, a, b in seen}
    return sorted((s for s in spans if not any(known[s[0]][s[1] : s[2]])), key=_order)


def _cover(spans: list[Span], n: int) -> bytearray:
    """One byte a character: 1 inside a span."""
    out = bytearray(n)
    for _, a, b in spans:
        out[a:b] = b"\1" * (b - a)
    return out


def _order(s: Span) -> tuple[int, int, int]:
    return KINDS.index(s[0]), s[1], s[2]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        counts, digests, every, added = [], [], [], []
        for text in batch.column("text").to_pylist():
            base = identifiers(text or "")
            more = disguised(text or "", base)
            counts.append([sum(s[0] == k for s in base) for k in KINDS])
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            every.append(joined(sorted(base + more, key=_order)))
            added.append(len(more))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(digests, pa.string()), pa.array(every, pa.string()), pa.array(added, pa.int64())],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"],
        )


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row: counts of plain spans by kind, the digest of them, all spans, and how many were disguised."""
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(_found, f"doc_id long, {counts}, base_sha256 string, spans string, n_disguised long")


def redact(text: str) -> str:
    """The text with every span, plain or disguised, replaced by its kind in brackets."""
    base = identifiers(text)
    spans = sorted(base + disguised(text, base), key=lambda s: (s[1], -s[2]))
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)  # what overlaps the span before goes with it
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars`` brought up to date; null texts stay."""
    names = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t if t is None else redact(t) for t in batch.column("text").to_pylist()]
            new = {"text": pa.array(texts, batch.schema.field("text").type)}
            if "n_chars" in names:
                kind = batch.schema.field("n_chars").type
                new["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, batch.column("n_chars").to_pylist(), strict=True)], kind)
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)

    return docs.mapInArrow(rows, T.StructType(docs.schema.fields))
