"""Secrets in texts, with weak candidates linked to the parts that complete them.

Three base patterns (assignments, access identifiers, hexadecimal runs) are reported
wherever they match.  Weak parts (an opaque token, a named user or client identifier, an
endpoint) mean nothing alone.  They are joined by intervals: a scope is a run of lines
without a blank one, and a weak part is reported only when a complementary part lies in its
scope, however far away; it is linked to the nearest.  Spans of one kind don't overlap, so
in sorted order the nearest partner is next to the place where the part would stand: no
pairs are enumerated.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sigloom.llm.common import slices, with_text

Span = tuple[str, int, int]

#: Base kinds in the order in which they are listed.
BASE = ("assign", "access", "hex")
WEAK = ("weak_secret", "weak_user", "endpoint")
#: What completes a weak part: an opaque token needs who or where, the others need a secret.
COMPLETES = {
    "weak_secret": ("access", "weak_user", "endpoint"),
    "weak_user": ("assign", "hex", "weak_secret"),
    "endpoint": ("assign", "hex", "weak_secret"),
}
#: Bits per character that an opaque token has at least.
TOKEN_BITS = 3.5

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ASSIGN_HINT = re.compile(r"(?i:passw|secret|token|api_?key)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+")
_USER = re.compile(r"""(?i:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key_?id)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9._@-]{3,})""", re.ASCII)
_ENDPOINT = re.compile(r"(?:https?|ftp|ssh|postgres(?:ql)?|mysql|redis|amqp|s3)://[A-Za-z0-9._~:@/-]{3,}")
_BLANK = re.compile(r"\n[\x20\t\r]*\n")


def opaque(token: str) -> bool:
    """Digits and letters of both cases or other signs, evenly enough spread to be random."""
    kinds = any(c.isdigit() for c in token) + any(c.islower() for c in token) + any(c.isupper() for c in token)
    if kinds < 3:
        return False
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values()) >= TOKEN_BITS


def base_spans(text: str) -> list[Span]:
    """The base matches that hold, by start and then kind."""
    found: list[Span] = []
    if _ASSIGN_HINT.search(text):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], BASE.index(x[0])))


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates that mean nothing alone; what a base span covers is none."""
    found: list[Span] = [("weak_secret", *m.span()) for m in _TOKEN.finditer(text) if opaque(m[0])]
    if ":" in text or "=" in text:
        found += [("weak_user", *m.span()) for m in _USER.finditer(text)]
    if "://" in text:
        found += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    starts, ends = [s for _, s, _ in base], [e for _, _, e in base]
    reach = [max(ends[: k + 1]) for k in range(len(ends))] if len(ends) < 64 else _running_most(ends)

    def covered(start: int, end: int) -> bool:
        k = bisect_left(starts, end)
        return k > 0 and reach[k - 1] > start

    return [x for x in found if not covered(x[1], x[2])]


def _running_most(values: list[int]) -> list[int]:
    out, most = [], 0
    for v in values:
        most = max(most, v)
        out.append(most)
    return out


def link(text: str, base: list[Span], weak: list[Span]) -> list[tuple[Span, Span]]:
    """Each weak part that has one, with its nearest complementary part in the same scope."""
    if not weak:
        return []
    blanks = [m.start() for m in _BLANK.finditer(text)]
    by_kind: dict[str, list[Span]] = {}
    for span in sorted([*base, *weak], key=lambda x: x[1]):
        by_kind.setdefault(span[0], []).append(span)
    starts = {k: [s for _, s, _ in v] for k, v in by_kind.items()}
    out = []
    for span in sorted(weak, key=lambda x: (x[1], WEAK.index(x[0]))):
        near = []
        for kind in COMPLETES[span[0]]:
            if kind in by_kind:
                k = bisect_left(starts[kind], span[1])
                for other in by_kind[kind][max(0, k - 1) : k + 1]:
                    gap = max(0, other[1] - span[2], span[1] - other[2])
                    if bisect_left(blanks, other[1]) == bisect_left(blanks, span[1]):
                        near.append((gap, other[1], other))
        if near:
            out.append((span, min(near)[2]))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan(text: str) -> tuple[list[Span], list[tuple[Span, Span]]]:
    """Base spans, and the linked weak parts with their partners."""
    base = base_spans(text)
    return base, link(text, base, weak_spans(text, base))


def _scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = {k: i for i, k in enumerate((*BASE, *WEAK))}
    for whole in batches:
        for batch in slices(whole):
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column("text").to_pylist():
                base, links = scan(text)
                spans = sorted([*base, *(w for w, _ in links)], key=lambda x: (x[1], order[x[0]]))
                row = (*(sum(k == kind for k, _, _ in base) for kind in BASE), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), ",".join(f"{listed([w])}~{listed([p])}" for w, p in links))
                for col, value in zip(cols, row, strict=True):
                    col.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "links"])


def find_credentials(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, links.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind,
    comma-joined; ``links`` pairs each weak part with the part that completes it, and of two as
    near with the one that begins first.  Texts of any length are scanned whole, in time that
    grows with their length.  Null texts count as empty and give no spans; repeated rows are
    scanned alike; an empty table gives an empty result.  Other columns are not read.
    """
    shape = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in BASE), *(T.StructField(n, T.StringType()) for n in ("base_sha256", "spans", "links"))])
    return with_text(docs, "doc_id").mapInArrow(_scan_rows, shape)
