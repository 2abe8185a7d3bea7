"""Secret scan: named patterns, and sliding-window entropy over candidate strings with allow-list suppression."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts

KINDS = ("assign", "access", "hex", "hex_entropy", "base64_entropy")
BASE_KINDS = KINDS[:3]

# The three named patterns and the least length of what they must find.
_ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ASSIGN_LEAST, _ACCESS_LEAST, _HEX_LEAST = 8, 16, 32
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_RUN = {
    "hex_entropy": r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{%d,}",
    "base64_entropy": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}",
}

#: Strings that look random and are not secrets. A candidate that one of these matches as a whole is let go; ``_ALLOW_PART`` lets go
#: what a candidate has between two separators around its match, not the rest.
_ALLOW_WHOLE = re.compile(
    r"""(?:[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}"""  # UUID
    r"""|[A-Za-z]+|[0-9]+"""  # words and numbers
    r"""|[A-Za-z]+(?:[-_/][A-Za-z]+)+"""  # joined words, paths
    r"""|[0-9]+(?:[-_/][0-9]+)+)"""  # dates, ranges
)
_ALLOW_PART = re.compile(r"(?i:example|placeholder|changeme|xxxxxx|0123456789|abcdefghij|[^a-z0-9]{5})")
_PARTS = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]{5,}")
_SEPARATORS = "+/_=-"


@dataclass(frozen=True)
class EntropyRules:
    """Window length, and the least bits a character of a window for each class."""

    window: int = 20
    hex_bits: float = 3.0
    base64_bits: float = 3.85


def entropy_spans(run: str, window: int, least_bits: float) -> list[tuple[int, int, float]]:
    """Maximal stretches of ``run`` covered by windows of at least ``least_bits`` bits a character, with their largest entropy.

    Entropy is ``log2(w) - sum(c*log2(c))/w``; the sum is kept up to date by the one count that grows and the one that shrinks.
    """
    if len(run) < window:
        return []
    term = [0.0] + [c * log2(c) for c in range(1, window + 2)]  # a character may fill a window and enter once more
    counts: dict[str, int] = {}
    total, whole = 0.0, log2(window)
    spans: list[tuple[int, int, float]] = []
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += term[c + 1] - term[c]
        if i >= window:
            old = run[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += term[c - 1] - term[c]
        if i >= window - 1:
            bits = whole - total / window
            if bits >= least_bits - 1e-9:
                start = i - window + 1
                if spans and start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + 1, max(spans[-1][2], bits))
                else:
                    spans.append((start, i + 1, bits))
    return spans


def stretches(run: str) -> list[tuple[int, str]]:
    """Places and texts of ``run`` cut at its parts between separators that ``_ALLOW_PART`` matches; each such part is a text by itself."""
    if not _ALLOW_PART.search(run):
        return [(0, run)]
    out, at = [], 0
    for m in _PARTS.finditer(run):
        if _ALLOW_PART.search(m[0]):
            out += [(at, run[at : m.start()]), (m.start(), m[0])]
            at = m.end()
    out.append((at, run[at:]))
    return [(i, s) for i, s in out if s and not _ALLOW_WHOLE.fullmatch(s.strip(_SEPARATORS))]


def _mixed(text: str) -> bool:
    """Whether at least two of lower case, upper case and digits occur, digits among them or both cases thrice."""
    lower, upper, digits = (sum(map(f, text)) for f in (str.islower, str.isupper, str.isdigit))
    return digits >= 2 and lower + upper >= 2 or lower >= 3 and upper >= 3


class Cover:
    """Spans, asked whether one of them holds another span: the furthest end among those that start before it tells."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for start, end in sorted(spans):
            self.starts.append(start)
            self.ends.append(max(end, self.ends[-1]) if self.ends else end)

    def holds(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start)
        return i > 0 and self.ends[i - 1] >= end


class SecretScanner:
    """Finds the spans of one text: ``(kind, start, end, bits)`` by start, then kind; code points, end exclusive."""

    def __init__(self, rules: EntropyRules = EntropyRules()):
        self.rules = rules
        self.runs = {k: re.compile(p % rules.window) for k, p in _RUN.items()}
        self.any_run = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % min(rules.window, _HEX_LEAST))

    def base(self, text: str, long_run: bool = True) -> list[tuple[str, int, int, float]]:
        found = []
        low = text.lower()
        if any(h in low for h in _ASSIGN_HINTS):
            found += [("assign", m.start(), m.end(), 0.0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _ASSIGN_LEAST]
        if "AKIA" in text:
            found += [("access", m.start(), m.end(), 0.0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LEAST]
        if long_run:
            found += [("hex", m.start(), m.end(), 0.0) for m in _HEX.finditer(text)]
        return found

    def added(self, text: str, base: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
        found = []
        bits = {"hex_entropy": self.rules.hex_bits, "base64_entropy": self.rules.base64_bits}
        for kind in KINDS[3:]:
            covered = Cover([(s, e) for _, s, e, _ in base + found])  # spans of one kind never lie within each other
            for m in self.runs[kind].finditer(text):
                run = m[0]
                if _ALLOW_WHOLE.fullmatch(run):
                    continue
                for place, part in stretches(run):
                    for start, end, most in entropy_spans(part, self.rules.window, bits[kind]):
                        at, to, secret = m.start() + place + start, m.start() + place + end, part[start:end]
                        if _mixed(secret) and not _ALLOW_PART.search(secret) and not covered.holds(at, to):
                            found.append((kind, at, to, round(most, 4)))
        return found

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        long_run = self.any_run.search(text) is not None
        found = self.base(text, long_run)
        if long_run:
            found += self.added(text, found)
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_secrets(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: EntropyRules = EntropyRules()) -> DataFrame:
    """One row for each input row: the id and ``spans array<struct<kind,start,end,bits,secret>>``, ordered by start, then kind.

    A null or empty text has no spans; a null id stays null; repeated rows give repeated rows; an empty table gives none.
    Other columns of ``df`` are not read, so clashing names do no harm. Texts are scanned whole, and no shuffle is needed.
    ``bits`` is the largest window entropy of an added span and 0 for those found by name.
    """
    kind = dict(df.select(id_col).dtypes)[id_col]
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scanner = SecretScanner(rules)

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for text in texts(batch.column(1)):
            rows.append([{"kind": k, "start": s, "end": e, "bits": b, "secret": text[s:e]} for k, s, e, b in scanner.scan(text)])
        return {"id": batch.column(0), "spans": rows}

    out = map_arrow(source, run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,bits:double,secret:string>>")
    return out.select(F.col("id").alias(id_col), "spans")


def _digest(spans, only: tuple[str, ...] | None = None):
    kept = F.filter(spans, lambda s: s["kind"].isin(*only)) if only else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_report(df: DataFrame) -> DataFrame:
    """Counts and digests of the spans of ``documents``: a row for each row, whatever its id; null and empty texts have none (empty digests)."""
    found = scan_secrets(df)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(_digest(F.col("spans"), BASE_KINDS), 256).alias("base_sha256"),
        _digest(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS)))).cast("long").alias("n_added"),
    )
