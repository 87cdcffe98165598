"""Secrets in whole texts: fixed patterns, and random strings exposed by token efficiency.

Natural language is cheap for a byte-pair vocabulary, about three to five characters a token; random strings are dear.  A run of
key characters with letters, or a window of it between separators, is reported when its characters a token are fewer than `efficiency`,
unless it is a digest of a known length, a UUID, or overlaps a span that a fixed pattern has already found.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_PART = re.compile(r"[A-Za-z0-9]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)
EFFICIENCY = 2.0
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPANS = "array<struct<kind:string,start:long,end:long>>"


@functools.cache
def encoding(path: str, pattern: str):
    """A tiktoken encoding from a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def known_identifier(run: str) -> bool:
    """A digest of a known length, a UUID, or digits with nothing else."""
    return bool(_ALL_HEX.fullmatch(run) and len(run) in DIGESTS or _UUID.fullmatch(run) or not re.search("[A-Za-z]", run))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and non-overlapping a kind."""
    out = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _windows(parts: list[tuple[int, int]], costs: list[float]) -> Iterator[tuple[int, int]]:
    """Of consecutive parts the window of at least 16 characters that lies farthest below the efficiency, then those left and right of it.
    costs: what the text up to each part's start, then up to each part's end, lies below it."""
    todo = [(0, len(parts))]
    while todo:
        low, high = todo.pop()
        best, least, next_ = None, None, low
        for j in range(low, high):
            while next_ <= j and parts[j][1] - parts[next_][0] >= 16:
                if least is None or costs[next_] < costs[least]:
                    least = next_
                next_ += 1
            if least is not None and (gain := costs[len(parts) + j] - costs[least]) > 0 and (best is None or gain > best[0]):
                best = gain, least, j + 1
        if best:
            _, i, j = best
            yield parts[i][0], parts[j - 1][1]
            todo += [(low, i), (j, high)]


def random_runs(text: str, base: list[tuple[int, int, int]], encode, efficiency: float = EFFICIENCY) -> list[tuple[int, int, int]]:
    """Whole runs below the efficiency; of other runs the windows between separators that are below it, so that a name or a path beside a random
    string doesn't pay for it."""
    out = []
    for m in _RUN.finditer(text):
        run = m[0].strip("-_=+/")
        if len(run) < 16 or known_identifier(run):
            continue
        start = m.start() + m[0].index(run)
        taken = [(s - start, e - start) for s, _, e in base if s < start + len(run) and start < e]
        if not taken and len(run) < efficiency * len(encode(run)):
            out.append((start, 3, start + len(run)))
            continue
        # no window goes over a fixed pattern's span, a UUID or a digest
        closed = sorted(taken + [u.span() for u in _UUID.finditer(run)] + [p.span() for p in _PART.finditer(run) if len(p[0]) in DIGESTS and known_identifier(p[0])])
        at = 0
        for s, e in [*closed, (len(run), len(run))]:
            if s - at >= 16:
                out += [(start + a, 3, start + b) for a, b in _scored(run, at, s, encode, efficiency)]
            at = max(at, e)
    return out


def _scored(run: str, low: int, high: int, encode, efficiency: float) -> Iterator[tuple[int, int]]:
    parts = [p.span() for p in _PART.finditer(run, low, high)]
    starts, ends, cost, before = [], [], 0.0, low
    for s, e in parts:
        cost += efficiency * len(encode(run[before:s])) - (s - before)
        starts.append(cost)
        cost += efficiency * len(encode(run[s:e])) - (e - s)
        ends.append(cost)
        before = e
    for s, e in _windows(parts, starts + ends):
        # parts were encoded apart; the window itself decides
        if not known_identifier(run[s:e]) and e - s < efficiency * len(encode(run[s:e])):
            yield s, e


def scan(docs: DataFrame, path: str, pattern: str, efficiency: float = EFFICIENCY) -> DataFrame:
    """docs(doc, text): doc, spans by start and then kind, in code points with exclusive ends; null texts have none.

    assign, access and hex spans are those of the fixed patterns; random ones are added where they overlap none of those.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path, pattern).encode_ordinary
        for batch in batches:
            spans = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                more = random_runs(text, base, encode, efficiency) if text else []
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(base + more)])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(spans, ARROW_SPANS)], ["doc", "spans"])

    return docs.select(F.col("doc").cast("long").alias("doc"), "text").mapInArrow(lean(find), f"doc long, spans {SPANS}")


def redact(text: str | None, spans: list, mark: str = "[SECRET]") -> str | None:
    """text with each span, overlapping ones as one, replaced by mark."""
    if not text or not spans:
        return text
    out, at = [], 0
    end = -1
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if s < end:
            end = max(end, e)
            at = end
            continue
        out += [text[at:s], mark]
        at = end = e
    return "".join([*out, text[at:]])


def joined(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
