"""Items longer than a limit cut into pieces at natural boundaries.

Token positions at which a piece may end are graded by what lies there: a part of the
message, a quoted message, a paragraph, a line of a sentence, a sentence, a line, a word,
or nothing. Dynamic programming over these positions finds the cuts with the least sum of
grades and size imbalance such that no piece has more than ``limit`` tokens and each piece
begins with the last ``overlap`` tokens of the one before.

The minimum is over the positions offered: all lines and stronger boundaries, and weaker ones
where these are more than ``gap`` tokens apart, which keeps the search near-linear in the length
of the text (``gap=0`` offers every position). A piece never begins or ends
within a character; where the overlap would, it begins up to three tokens earlier. A
piece is counted again by itself; if tokens fall differently there so that it is over
the limit, the whole item is cut anew with a lower limit, and if that ends, piece by piece
at the last position that keeps within it.

Defined results: items within the limit, null and empty ones give no piece; an item id
that occurs twice is cut twice; extra columns are ignored. Where one character with the overlap
before it has more tokens than the limit, no piece within the limit exists: that piece is over it
and says so in ``n_tokens``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlume.llm import tokens

LIMIT, OVERLAP, GAP = 2000, 100, 120
#: Boundaries by name with the penalty of cutting there, strongest first.
PENALTIES = {"part": 0.0, "message": 0.5, "paragraph": 1.0, "line of a sentence": 2.0, "sentence": 3.0, "line": 4.0, "word": 8.0, "none": 25.0}
IMBALANCE = 12.0
_NAMES = list(PENALTIES)
_COSTS = np.array(list(PENALTIES.values()))
#: Each pattern matches the white space (and reply marks) after which the next piece would begin.
_BOUNDARIES = [
    re.compile(rb"\r?\n(?=--[^\s-][^\n]{2,70}\r?\n(?:[!-9;-~]+:|\r?\n))|\n\r?\n(?=--[^\s][^\n]{2,70}\r?\n)|\A(?:[!-9;-~]+:[^\n]*\n(?:[ \t][^\n]*\n)*)+\r?\n"),
    re.compile(rb"\n(?=[> |:]*-{3,}[^\n-]{3,60}-{3,}\r?\n)|\n(?=[> |:]*_{10,}\r?\n)|\n(?=[> |:]*-- \r?\n)|\n(?=[> |:]*[^\n]{5,120}:\s*\r?\n[> |:]*>)"),
    re.compile(rb"\n(?:[>|: \t\r]*\n)+|(?:<br>|</p>|</div>)\s*\n(?:&nbsp;<br>\s*\n)+|</p>\s*|</div>\s*"),
    re.compile(rb"(?<=[.!?])[\"')]?\r?\n"),
    re.compile(rb"(?<=[.!?])[\"')]?[ \t]+"),
    re.compile(rb"\n"),
    re.compile(rb"[ \t\r\n]+"),
]


@dataclass(frozen=True)
class Piece:
    start: int  # in bytes of the text
    end: int
    n_tokens: int
    repeated: int  # tokens shared with the piece before
    boundary: str  # what the piece ends at


def _grades(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """For each token position, the strongest boundary there (index into PENALTIES)."""
    grades = np.full(len(offsets), len(_NAMES) - 1)
    for grade in range(len(_BOUNDARIES) - 1, -1, -1):
        spans = np.array([m.span() for m in _BOUNDARIES[grade].finditer(data)], dtype=np.int64).reshape(-1, 2)
        at = np.searchsorted(offsets, spans[:, 1], side="right") - 1  # the last position within the boundary
        at = at[(offsets[at] >= spans[:, 0])]
        grades[at] = grade
    return grades


def _candidates(grades: np.ndarray, allowed: np.ndarray, gap: int) -> np.ndarray:
    """Positions to consider: all natural ones, and weaker ones where these are far apart."""
    chosen = np.flatnonzero(allowed & (grades <= 5))
    for weakest in (6, 7):
        edges = np.concatenate(([0], chosen, [len(grades) - 1]))
        far = np.flatnonzero(np.diff(edges) > gap)
        if not len(far):
            break
        more = [np.flatnonzero(allowed[edges[i] + 1 : edges[i + 1]] & (grades[edges[i] + 1 : edges[i + 1]] <= weakest)) + edges[i] + 1 for i in far]
        chosen = np.unique(np.concatenate([chosen, *more]))
    return chosen


def _cut(n: int, grades: np.ndarray, allowed: np.ndarray, limit: int, overlap: int, gap: int) -> list[tuple[int, int]] | None:
    """Spans of token positions, or None if no cuts satisfy the limit."""
    inner = _candidates(grades, allowed, gap)
    at = np.concatenate(([0], inner[(inner > 0) & (inner < n)], [n]))
    # where a piece after a cut begins: the overlap before it, moved back to a character's start
    starts = np.maximum(at - overlap, 0)
    legal = np.flatnonzero(allowed)
    starts = legal[np.searchsorted(legal, starts, side="right") - 1]
    pieces = max(1, -(-(n - overlap) // max(1, limit - overlap)))
    even = (n + (pieces - 1) * overlap) / pieces
    cost, before = np.full(len(at), np.inf), np.full(len(at), -1)
    cost[0] = 0.0
    low = 0
    for i in range(1, len(at)):
        while low < i and at[i] - starts[low] > limit:
            low += 1
        if low == i:
            continue
        sizes = at[i] - starts[low:i]
        total = cost[low:i] + IMBALANCE * ((sizes - even) / limit) ** 2
        best = int(np.argmin(total))
        if np.isfinite(total[best]):
            cost[i] = total[best] + (_COSTS[grades[at[i]]] if at[i] < n else 0.0)
            before[i] = low + best
    if not np.isfinite(cost[-1]):
        return None
    spans, i = [], len(at) - 1
    while i > 0:
        spans.append((int(starts[before[i]]), int(at[i])))
        i = before[i]
    return spans[::-1]


def _by_counting(data: bytes, offsets: np.ndarray, allowed: np.ndarray, encoding, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans by counting each piece by itself: as long as they may be, one position more than the last at least."""
    n, legal, spans, start, done = len(offsets) - 1, np.flatnonzero(allowed), [], 0, 0
    count = lambda a, b: len(encoding.encode_ordinary(data[offsets[a] : offsets[b]].decode("utf-8")))
    while done < n:
        later = legal[legal > done]
        at = max(int(np.searchsorted(later, start + limit, side="right")) - 1, 0)
        while at and count(start, later[at]) > limit:
            at -= 1
        done = int(later[at])
        spans.append((start, done))
        start = int(legal[np.searchsorted(legal, max(done - overlap, 0), side="right") - 1])
    return spans


def split_text(text: str, encoding, lengths: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP, gap: int = GAP) -> list[Piece]:
    """The pieces of one text; none if it is within the limit."""
    if not text:
        return []
    ids = encoding.encode_ordinary(text)
    n = len(ids)
    if n <= limit:
        return []
    data = text.encode("utf-8")
    offsets = np.concatenate(([0], np.cumsum(lengths[np.array(ids)])))
    marks = np.frombuffer(data + b" ", dtype=np.uint8)
    allowed = (marks[offsets] & 0xC0) != 0x80
    grades = _grades(data, offsets)
    count = lambda spans: [len(encoding.encode_ordinary(data[offsets[a] : offsets[b]].decode("utf-8"))) for a, b in spans]
    most = limit
    while True:
        spans = _cut(n, grades, allowed, most, overlap, gap) if most > overlap else None
        if spans is None and gap and most > overlap:
            gap = 0
            continue
        if spans is None:
            spans = _by_counting(data, offsets, allowed, encoding, limit, overlap)
            again = count(spans)
            break
        again = count(spans)
        if max(again) <= limit:
            break
        most -= max(again) - limit
    return [
        Piece(int(offsets[a]), int(offsets[b]), counted, spans[i - 1][1] - a if i else 0, _NAMES[grades[b]] if b < n else "end")
        for i, ((a, b), counted) in enumerate(zip(spans, again))
    ]


def split_items(df: DataFrame, item: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, ranks: str = tokens.RANKS, with_text: bool = True, gap: int = GAP) -> DataFrame:
    """``item, piece, n_tokens, repeated, start_byte, end_byte, boundary[, piece_text]`` of every item over the limit.

    Needs no shuffle. Texts of at most ``limit`` bytes are skipped unread: each token has at least one byte.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    long = df.select(F.col(item).alias("item"), F.col(text).alias("text")).where(F.octet_length("text") > limit)
    kind = long.schema["item"].dataType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = tokens.encoding(ranks)
        lengths = np.array([len(encoding.decode_single_token_bytes(i)) for i in range(encoding.max_token_value + 1)])
        for batch in batches:
            out = []
            for key, body in zip(batch["item"], batch["text"]):
                data = body.encode("utf-8") if with_text else b""
                for i, p in enumerate(split_text(body, encoding, lengths, limit, overlap, gap)):
                    out.append((key, i + 1, p.n_tokens, p.repeated, p.start, p.end, p.boundary, *([data[p.start : p.end].decode("utf-8")] if with_text else [])))
            yield pd.DataFrame(out, columns=[*columns])

    columns = ["item", "piece", "n_tokens", "repeated", "start_byte", "end_byte", "boundary", *(["piece_text"] if with_text else [])]
    schema = f"item {kind}, piece int, n_tokens int, repeated int, start_byte long, end_byte long, boundary string" + ", piece_text string" * with_text
    return long.mapInPandas(split, schema).withColumnRenamed("item", item)
