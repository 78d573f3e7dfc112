"""Secret scan: fixed key patterns, and sliding-window entropy of candidate strings.

For each character class, the candidate strings are the runs of its characters of at
least one window. A window slides over a candidate; the counts of its characters are
kept up to date as one character enters and one leaves, so each step costs the same.
Windows with at least the class's Shannon entropy (bits per character) are joined to
spans. Two allow-lists suppress spans; base patterns are never suppressed. A part of a
candidate, between ``/`` and ``=``, that holds a placeholder is cut out, and windows lie
within what stays on either side. A span that as a whole is words, a path or digits is left
out. So a key beside an allowed word, name or path is still found.

Entropy is compared in integers (count x log2(count), scaled), so no rounding builds up.

Defined cases: null text is empty; overlapping spans of different kinds are all listed;
repeated rows are scanned alike; an empty table gives an empty result; other columns are
ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sessionrec.llm.common import documents, texts

# The base kinds, in the order in which equal starts are listed.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")

_SCALE = 1 << 32


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``characters``, with a window and its least entropy in bits per character."""

    kind: str
    characters: str
    window: int
    least: float

    def candidates(self) -> re.Pattern:
        return re.compile(f"[{self.characters}]{{{self.window},}}")


CLASSES = (
    CharacterClass("entropy_hex", "0-9A-Fa-f", 20, 2.9),
    CharacterClass("entropy_base64", "A-Za-z0-9+/=_-", 20, 3.7),
)

# Spans that look random but are not secret: words (capitals lead a word or fill it), paths,
# digit strings.
ALLOWED = (
    r"[/_=+-]*(?:(?:(?:[A-Z]?[a-z]+)+|[A-Z]+)(?:[/_=+-]+|$))*",
    r"[0-9_=+/-]*",
)
# Parts of a candidate that make it a placeholder or counting.
PLACEHOLDERS = (
    r"(?i:example|placeholder|changeme|your[_-]?(?:api|key|token|secret)|x{6,})",
    r"0123456789|1234567890|(?i:abcdefghij)",
)
_PART = re.compile(r"[^/=]+")


def dense_spans(text: str, window: int, least: float) -> list[tuple[int, int]]:
    """Joined spans of the windows of ``text`` with at least that entropy."""
    weight = [0] + [round(c * math.log2(c) * _SCALE) for c in range(1, window + 2)]
    # H = log2(window) - sum(c log2 c) / window
    most = round((math.log2(window) - least) * window * _SCALE)
    counts: dict[str, int] = {}
    total = 0
    spans: list[tuple[int, int]] = []
    for end, entering in enumerate(text, 1):
        c = counts.get(entering, 0)
        counts[entering] = c + 1
        total += weight[c + 1] - weight[c]
        if end > window:
            leaving = text[end - window - 1]
            c = counts[leaving]
            counts[leaving] = c - 1
            total += weight[c - 1] - weight[c]
        if end >= window and total <= most:
            start = end - window
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((start, end))
    return spans


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end), unordered."""
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    return found + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


class Scanner:
    """All spans of a text, for given classes and allow-list."""

    def __init__(self, classes=CLASSES, allowed=ALLOWED, placeholders=PLACEHOLDERS):
        self.classes = [(c, c.candidates()) for c in classes]
        self.allowed = re.compile("|".join(f"(?:{p})" for p in allowed)) if allowed else None
        self.placeholders = re.compile("|".join(f"(?:{p})" for p in placeholders)) if placeholders else None
        self.rank = {k: i for i, k in enumerate((*BASE_KINDS, *(c.kind for c in classes)))}

    def pieces(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """What parts with a placeholder leave of a candidate."""
        if self.placeholders is None or not self.placeholders.search(text, start, end):
            return [(start, end)]
        found = []
        for part in _PART.finditer(text, start, end):
            if self.placeholders.search(text, *part.span()):
                found.append((start, part.start()))
                start = part.end()
        return [*found, (start, end)]

    def entropy_spans(self, text: str) -> list[tuple[int, str, int]]:
        found = []
        for kind, pattern in self.classes:
            for m in pattern.finditer(text):
                for start, end in self.pieces(text, *m.span()):
                    for a, b in dense_spans(text[start:end], kind.window, kind.least):
                        a, b = start + a, start + b
                        if self.allowed is None or not self.allowed.fullmatch(text, a, b):
                            found.append((a, kind.kind, b))
        return found

    def ordered(self, spans):
        return sorted(spans, key=lambda s: (s[0], self.rank[s[1]], s[2]))


def listed(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, classes=CLASSES, allowed=ALLOWED, placeholders=PLACEHOLDERS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""

    def run(batches):
        scanner = Scanner(classes, allowed, placeholders)
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch["text"].to_pylist():
                base = scanner.ordered(base_spans(text))
                more = scanner.entropy_spans(text)
                kinds = [k for _, k, _ in base]
                counts.append([kinds.count(k) for k in BASE_KINDS] + [len(more)])
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(scanner.ordered(base + more)))
            columns = list(zip(*counts)) if counts else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *[pa.array(c, pa.int64()) for c in columns], pa.array(digests, pa.string()),
                 pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"],
            )

    return texts(docs).mapInArrow(
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string",
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
