"""Splitting oversized texts at natural boundaries.

Method: dynamic programming over all boundary positions of a text. A piece is a
run of words; a cut costs by the edge it uses (paragraph, sentence, word, inside
a word) and by how far the piece is from an even share of the text. Every piece
keeps both limits, and a piece after the first begins ``overlap_words`` words
before the cut.

Defined results
  * a text within both limits and a null text give no pieces; a blank text above
    the limits gives one empty piece;
  * words are cut only if one alone exceeds ``max_chars``; its parts, preferably
    ending at a sentence mark, then count as words for the overlap;
  * where the asked overlap would leave no room for a new word, whole words of at
    most a quarter of ``max_chars`` are shared instead;
  * the token count of a piece is the number of its white-space words;
  * repeated rows are each split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.constants import NON_WS, PAGE_JOINER

WORD = re.compile(r"\S+")
BLANK_LINE = re.compile(r"\n[^\S\n]*\n")
CLOSERS = "\"'”’»“)]」』）】›"
SENTENCE_TAIL = re.compile(rf"[.!?…。！？؟।;][{re.escape(CLOSERS)}]*$")
INNER_MARK = re.compile(r"[。！？…؟।][”’」』）»]*")
PARAGRAPH, SENTENCE, PLAIN, INSIDE = 0, 1, 2, 3
#: Cost of a cut by the kind of its edge; a piece costs PIECE, and its squared
#: deviation from an even share is weighed by BALANCE.
COST = np.array([0.0, 1.0, 8.0, 64.0])
PIECE, BALANCE = 4.0, 6.0
#: The part of max_chars that an overlap may take where the asked one does not fit.
SHORT = 4


@dataclass(frozen=True)
class Limits:
    max_words: int
    max_chars: int
    overlap_words: int

    def __post_init__(self):
        if self.max_words < 1 or self.max_chars < 1 or self.overlap_words < 0:
            raise ValueError(f"limits out of range: {self}")


def _parts(word: str, limit: int) -> list[int]:
    """Inner cut positions of a word longer than ``limit``: about eighths of the
    limit long, at sentence marks if there are any, never before a combining mark."""
    step = max(1, limit // 8)
    marks = [m.end() for m in INNER_MARK.finditer(word)]
    cuts, at, i = [], 0, 0
    while len(word) - at > step:
        while i < len(marks) and marks[i] <= at:
            i += 1
        best = None
        while i < len(marks) and marks[i] - at <= step:
            best = marks[i]
            i += 1
        if best is None:
            best = at + step
            back = best
            while back > at + 1 and re.match(r"[\u0300-\u036f\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u093a-ॏ\u200c\u200d]", word[back]):
                back -= 1
            best = back
        if best >= len(word):
            break
        cuts.append(best)
        at = best
    return cuts


def atoms(text: str, max_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (long ones in parts), and the kind of edge after each."""
    starts, ends, edge = [], [], []
    last = None
    for m in WORD.finditer(text):
        s, e = m.span()
        if last is not None:
            if BLANK_LINE.search(text, last, s):
                edge.append(PARAGRAPH)
            elif SENTENCE_TAIL.search(text[max(starts[-1], last - 6) : last]) and not text[s].islower() and not text[s].isdigit():
                edge.append(SENTENCE)
            else:
                edge.append(PLAIN)
        if e - s > max_chars:
            word = text[s:e]
            cuts = [0, *_parts(word, max_chars), len(word)]
            for a, b in zip(cuts, cuts[1:]):
                starts.append(s + a)
                ends.append(s + b)
                if b < len(word):
                    edge.append(SENTENCE if INNER_MARK.search(word, max(a, b - 3), b) else INSIDE)
        else:
            starts.append(s)
            ends.append(e)
        last = e
    edge.append(PARAGRAPH)
    return np.array(starts, np.int64), np.array(ends, np.int64), np.array(edge[-len(starts) :] if starts else [], np.int64)


def pieces(text: str, limits: Limits) -> list[tuple[int, int]]:
    """The (start, end) of each piece, in order."""
    s, e, edge = atoms(text, limits.max_chars)
    n = len(s)
    if not n:
        return [(0, 0)]
    most, chars, over = limits.max_words, limits.max_chars, min(limits.overlap_words, limits.max_words - 1)
    # begin[c]: the first word of a piece that follows a cut before word c
    at = np.arange(n)
    fits = np.searchsorted(s, e - chars, side="left")  # of a piece that ends with word c
    asked = np.maximum(at - over, 0)
    short = np.searchsorted(s, np.r_[s[0], e[:-1]] - chars // SHORT, side="left")
    begin = np.where(asked >= fits, asked, np.minimum(np.maximum(np.maximum(asked, fits), short), at))
    # low[c]: the first word from which a piece that ends before c + 1 keeps the limits
    low = np.maximum(fits, at - most + 1)
    if low[-1] == 0:
        return [(int(s[0]), int(e[-1]))]
    # every word edge is a candidate: state k is a piece that begins after a cut before word k
    first = begin.copy()
    first[0] = 0
    # the first state that a piece up to word c can have; where overlaps had to be cut short, later ones may still be too early
    oldest = np.searchsorted(np.maximum.accumulate(first), low, side="left").tolist()
    uneven = bool((first[1:] < first[:-1]).any())
    starts, ends = s[first].astype(np.float64), e.astype(np.float64)
    share = (e[-1] - s[0]) / max(1.0, np.ceil(max((e[-1] - s[0]) / chars, n / most)))
    at_cut = (PIECE + COST[edge]).tolist()
    at_cut[-1] = PIECE
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    prev = [0] * (n + 1)
    starts += share
    weight = BALANCE / share**2
    for c in range(n):
        a = oldest[c]
        if a > c:
            continue
        off = starts[a : c + 1] - ends[c]
        off *= off
        off *= weight
        off += best[a : c + 1]
        if uneven:
            off[first[a : c + 1] < low[c]] = np.inf
        j = int(off.argmin())
        best[c + 1] = off[j] + at_cut[c]
        prev[c + 1] = a + j
    assert np.isfinite(best[-1]), "every word fits the limits, so a way exists"
    out, k = [], n
    while k:
        p = prev[k]
        out.append((int(s[first[p]]), int(e[k - 1])))
        k = p
    return out[::-1]


def span_pieces(start: int, end: int, spans: list[dict] | None, length: int) -> list[dict] | None:
    """The spans of text[start:end]; None if the record's spans do not add up to its text."""
    if not spans:
        return None
    out, offset = [], 0
    for x in spans:
        if x is None or x["char_start"] is None or x["char_end"] is None:
            return None
        size = x["char_end"] - x["char_start"]
        lo, hi = max(start, offset), min(end, offset + size)
        if lo < hi:
            out.append(x | {"char_start": x["char_start"] + lo - offset, "char_end": x["char_start"] + hi - offset})
        offset += size + len(PAGE_JOINER)
    return out if offset - len(PAGE_JOINER) == length else None


SPAN = pa.struct(
    [("page_index", pa.int64()), ("page_label", pa.string()), ("char_start", pa.int64()), ("char_end", pa.int64())]
)
PIECES = pa.schema(
    [
        ("kind", pa.string()),
        ("row_key", pa.int64()),
        ("piece_index", pa.int64()),
        ("text", pa.string()),
        ("token_count", pa.int64()),
        ("char_start", pa.int64()),
        ("char_end", pa.int64()),
        ("spans", pa.list_(SPAN)),
    ]
)
PIECES_DDL = (
    "kind string, row_key long, piece_index long, text string, token_count long, char_start long, char_end long, "
    "spans array<struct<page_index: long, page_label: string, char_start: long, char_end: long>>"
)


def cut_batches(limits: dict[str, Limits]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, key, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for i, (a, b) in enumerate(pieces(text, limits[kind])):
                    part = text[a:b]
                    rows.append(
                        {
                            "kind": kind, "row_key": key, "piece_index": i, "text": part, "token_count": len(part.split()),
                            "char_start": a, "char_end": b, "spans": span_pieces(a, b, spans, len(text)),
                        }
                    )
            yield pa.RecordBatch.from_pylist(rows, schema=PIECES)

    return run


def oversized(rows: DataFrame, limits: dict[str, Limits]) -> DataFrame:
    """Rows (kind, row_key, text, spans) beyond a limit of their kind, found in the JVM.

    n words take at least 2n - 1 characters, so most texts need no word count.
    """
    size = F.length("text")
    too_big = F.lit(False)
    for kind, x in limits.items():
        words = F.regexp_count("text", F.lit(f"{NON_WS}+"))
        too_big = too_big | (
            (F.col("kind") == kind)
            & F.when(size > x.max_chars, True).when(size > 2 * x.max_words, words > x.max_words).otherwise(False)
        )
    return rows.filter(too_big)


def read_limits(limits: DataFrame) -> dict[str, Limits]:
    """The settings table (one row a kind) as a dict on the driver."""
    rows = limits.select("record_kind", "max_words", "max_chars", "overlap_words").limit(100).collect()
    return {r[0]: Limits(*map(int, r[1:])) for r in rows}


def split_oversized(rows: DataFrame, limits: dict[str, Limits]) -> DataFrame:
    """Pieces of every row (kind, row_key, text, spans) above the limits of its kind."""
    if not limits:
        limits = {}
        rows = rows.filter("false")
    return oversized(rows, limits).select("kind", "row_key", "text", "spans").mapInArrow(cut_batches(limits), PIECES_DDL)


def page_rows(pages: DataFrame) -> DataFrame:
    span = F.struct(
        F.col("page_index").cast("long").alias("page_index"),
        F.col("page_label").cast("string").alias("page_label"),
        F.lit(0).cast("long").alias("char_start"),
        F.length("text").cast("long").alias("char_end"),
    )
    return pages.select(F.lit("page").alias("kind"), F.col("line_no").cast("long").alias("row_key"), "text", F.array(span).alias("spans"))


def chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_no").cast("long").alias("row_key"), "text", "spans")
