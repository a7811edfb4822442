"""Secrets in texts: strong patterns, and weak parts that count only beside their counterparts."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds in the order they are listed; the first three are complete secrets by themselves.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
#: A run of fewer signs fails as a whole, so asking for the least length at once gives the same spans.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Weak parts: names of accounts or key ids, free-standing keys, addresses of services.
IDENTIFIER = re.compile(r"(?:user(?:name)?|login|client_?id|account|key_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]{3,})|(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}", re.I | re.A)
#: Long runs of signs are looked at once, from where they begin, so texts of any length take time in proportion.
#: A key may follow '=' directly, as in files of KEY=value lines and URL parameters.
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"(?:jdbc:[a-z]+|[a-z][a-z0-9+]{1,9})://[^\s\"'<>]{3,}|(?<![a-z0-9.-])[a-z0-9.-]+\.amazonaws\.com\S*", re.A)
SCOPE = 300


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    out = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def weak_parts(text: str) -> list[tuple[str, int, int]]:
    """Candidates that mean little alone. A free-standing key mixes lower case, capitals and digits."""
    out = [("identifier", m.start(), m.end()) for m in IDENTIFIER.finditer(text)] if re.search("[:=]|A(?:SIA|ROA|IDA)", text) else []
    for m in SECRET.finditer(text):
        s = m[0]
        if any(c.islower() for c in s) and any(c.isupper() for c in s) and any(c.isdigit() for c in s):
            out.append(("secret", m.start(), m.end()))
    if "://" in text or "amazonaws" in text:
        out += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    return out


class Places:
    """Spans of one role, asked how many of them a stretch meets, by two searches in sorted ends."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends, self.same = sorted(s for s, _ in spans), sorted(e for _, e in spans), Counter(spans)

    def met(self, s: int, e: int) -> int:
        """Spans that reach from s on, up to e, both included; all that end before s also begin before it."""
        return bisect_right(self.starts, e) - bisect_left(self.ends, s)


def linked_parts(base: list[tuple[str, int, int]], weak: list[tuple[str, int, int]], scope: int = SCOPE, text: str = "") -> list[tuple[str, int, int]]:
    """Weak parts with a complement within scope code points: an interval join over sorted places.

    A secret needs an identifier (or access id) or an endpoint, an identifier or endpoint needs a
    secret (or a complete assign or hex secret); an endpoint alone with an identifier shows nothing.
    An address is no endpoint for a part of its own path, but for a parameter's value or a login in it.
    """
    role = {"access": 0, "identifier": 0, "assign": 1, "hex": 1, "secret": 1, "endpoint": 2}
    spans: list[list[tuple[int, int]]] = [[], [], []]
    for kind, s, e in base + weak:
        spans[role[kind]].append((s, e))
    places = [Places(p) for p in spans]
    taken = Places([(s, e) for _, s, e in base])

    def has(s: int, e: int, other: int) -> bool:
        p = places[other]
        if other == 2 and not (text[s - 1 : s] == "=" or text[s - 1 : s] == ":" and text[s] != "/"):
            # only addresses beside the part: one that ends up to scope before it, or begins up to scope behind it
            before = bisect_right(p.ends, s) - bisect_left(p.ends, s - scope)
            return before > 0 or bisect_right(p.starts, e + scope) > bisect_left(p.starts, e)
        return p.met(s - scope, e + scope) > p.same[(s, e)]

    wants = {"secret": (0, 2), "identifier": (1,), "endpoint": (1,)}
    return [(k, s, e) for k, s, e in weak if any(has(s, e, r) for r in wants[k]) and not taken.met(s + 1, e - 1)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))


def scan_text(text: str | None, scope: int = SCOPE) -> tuple[list, list]:
    """Base spans and linked weak spans of one whole text; null counts as empty."""
    text = text or ""
    base = base_spans(text)
    weak = weak_parts(text)
    return base, linked_parts(base, weak, scope, text) if weak else []


def secret_scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: doc_id, counts of the three base kinds, digest and all spans.

    Places are code points, ends exclusive. Weak parts are reported only where complementary parts
    lie within scope code points of each other, and never where they overlap a base span. Null and
    empty texts give no spans (the digest of the empty string); rows that repeat get equal results;
    an empty table gives no rows; other columns are not read.
    """

    def run(batches):
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for t in b.column(1).to_pylist():
                base, weak = scan_text(t, scope)
                for i, k in enumerate(KINDS[:3]):
                    cols[i].append(sum(x[0] == k for x in base))
                cols[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[4].append(joined(base + weak))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
