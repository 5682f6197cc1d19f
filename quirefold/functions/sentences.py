"""Sentence spans of a text, by end marks and a list of abbreviations.

The list may be a fixed English one, or learnt from the texts at hand without
labels (``train_splitter``), by the type statistics of Kiss and Strunk (2006).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.constants import WS

BREAK = re.compile(r"[.!?][\"'”’)\]]*\s+")
PLAIN_BREAK = re.compile(r"[.!?]\s+")
LAST_WORD = re.compile(r"(\S+)\.[\"'”’)\]]*\s+$")
#: English words that end in a full stop within a sentence.
ABBREVIATIONS = frozenset(
    "dr mr mrs ms prof rev gen col sen rep st sr jr vs etc e.g i.e cf fig figs no nos vol vols p pp ed eds al approx "
    "inc ltd co corp dept est sect ch jan feb mar apr jun jul aug sep sept oct nov dec a.m p.m u.s u.k".split()
)


def spans_by_marks(text: str) -> list[tuple[int, int]]:
    """A break stands at white space after . ! or ?; the rest is a sentence, too."""
    return _spans(text, [m.span() for m in PLAIN_BREAK.finditer(text)])


def spans(text: str) -> list[tuple[int, int]]:
    """As ``spans_by_marks``, but closers may follow the mark, and no break stands
    after an abbreviation, an initial, or before a lower-case letter."""
    return _spans(text, _cuts(text, ABBREVIATIONS))


def _cuts(text: str, abbreviations: frozenset[str], starters: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    cuts = []
    for m in BREAK.finditer(text):
        after = text[m.end() : m.end() + 1]
        if after.islower():
            continue
        if m.group()[0] == "." and (w := LAST_WORD.search(text, max(0, m.start() - 24), m.end())):
            word = w.group(1).lstrip("([\"'“‘").lower()
            if len(word) == 1 and word.isalpha():
                continue
            if word in abbreviations and not (starters and _first_word(text, m.end()) in starters):
                continue
        cuts.append(m.span())
    return cuts


def _first_word(text: str, at: int) -> str:
    found = text[at : at + 48].split(None, 1)
    return found[0].strip(EDGES).lower() if found else ""


def _spans(text: str, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, start = [], len(text) - len(text.lstrip())
    end = len(text.rstrip())
    for a, b in cuts:
        stop = a + len(text[a:b].rstrip())
        if start < stop < end:
            out.append((start, stop))
            start = b
    if start < end:
        out.append((start, end))
    return out


SPLITTERS = {"marks": spans_by_marks, "abbreviations": spans}
Splitter = Callable[[str], list[tuple[int, int]]]


def splitter_of(splitter: str | Splitter) -> Splitter:
    """A splitter by its name, or a caller's own: a function from a text to ranges of code points."""
    if callable(splitter):
        return splitter
    if splitter not in SPLITTERS:
        raise ValueError(f"splitter must be a function or one of {', '.join(SPLITTERS)}")
    return SPLITTERS[splitter]


@dataclass(frozen=True)
class TrainedSplitter:
    """Splits as ``spans`` does, with learnt abbreviations; after one of them a break
    stands only before a word that often begins sentences."""

    abbreviations: frozenset[str]
    starters: frozenset[str] = frozenset()

    def __call__(self, text: str) -> list[tuple[int, int]]:
        return _spans(text, _cuts(text, self.abbreviations, self.starters))

    def to_json(self) -> str:
        return json.dumps({"abbreviations": sorted(self.abbreviations), "starters": sorted(self.starters)}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> TrainedSplitter:
        read = json.loads(text)
        return cls(frozenset(read["abbreviations"]), frozenset(read["starters"]))


#: Signs around a word that do not belong to it.
EDGES = "()[]\"'“”‘’«»,;:"


def _stripped(word: Column) -> Column:
    signs = "[" + re.escape(EDGES) + "]"
    return F.regexp_replace(F.lower(word), f"^{signs}+|{signs}+$", "")


def _words(rows: DataFrame, text: str) -> DataFrame:
    """(word, nxt): the words of all texts with the next one, in lower case, without signs around them."""
    split = F.filter(F.split(F.col(text), f"{WS}+"), lambda w: w != "")
    pairs = F.zip_with(split, F.slice(split, F.lit(2), F.greatest(F.size(split), F.lit(1))), lambda a, b: F.struct(a.alias("word"), b.alias("nxt")))
    return rows.select(F.explode(pairs).alias("p")).select(_stripped(F.col("p.word")).alias("word"), _stripped(F.col("p.nxt")).alias("nxt"))


def _fit(k: Column, n: Column, p: Column) -> Column:
    """The log likelihood of k of n at a share p."""
    safe = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
    return k * F.log(safe) + (n - k) * F.log(1 - safe)


def abbreviation_scores(rows: DataFrame, text: str = "text") -> DataFrame:
    """(word, dotted, plain, score) of every word that occurs with a full stop.

    The score is a likelihood ratio (a full stop follows the word nearly always,
    against: as often as any word), weighed down by the word's length and by its
    occurrences without a stop, and up by stops inside it.
    """
    words = _words(rows, text).select("word", F.col("word").rlike(r"\.$").alias("dot")).withColumn("word", F.regexp_replace("word", r"\.$", ""))
    counts = (
        words.filter(F.col("word").rlike(r"^\p{L}[\p{L}.]*$"))
        .groupBy("word")
        .agg(F.count_if("dot").alias("dotted"), F.count_if(~F.col("dot")).alias("plain"))
    )
    totals = counts.agg((F.sum("dotted") / F.sum(F.col("dotted") + F.col("plain"))).alias("share"))
    n = F.col("dotted") + F.col("plain")
    ratio = 2 * (_fit(F.col("dotted"), n, F.lit(0.99)) - _fit(F.col("dotted"), n, F.col("share")))
    letters = F.length(F.regexp_replace("word", r"\.", ""))
    weight = F.exp(-letters.cast("double")) * (F.length("word") - letters + 1) / F.pow(letters, F.col("plain"))
    scored = counts.filter("dotted > 0").crossJoin(F.broadcast(totals))  # one row
    return scored.select("word", "dotted", "plain", (ratio * weight).alias("score"))


def train_splitter(rows: DataFrame, text: str = "text", least_score: float = 0.3, least_starter: float = 30.0) -> TrainedSplitter:
    """Learn abbreviations and frequent sentence starters from all texts; no labels are needed.

    All counting is grouped sums; the driver gets the words of the model only, a
    small part of the vocabulary.
    """
    short = [r[0] for r in abbreviation_scores(rows, text).filter(F.col("score") >= least_score).select("word").collect()]
    listed = rows.sparkSession.createDataFrame([(w,) for w in short], "stem string")
    ends = _words(rows, text).filter(F.col("nxt").rlike(r"^\p{L}+$")).withColumn("stem", F.regexp_replace("word", r"[.!?]+$", ""))
    # a learnt abbreviation's stop is no end; the list is the model itself, so it fits every worker
    counted = (
        ends.groupBy("stem", "nxt", F.col("word").rlike(r"[.!?]$").alias("marked")).agg(F.count("*").alias("n"))
        .join(F.broadcast(listed.withColumn("short", F.lit(True))), "stem", "left")
        .groupBy("nxt")
        .agg(F.sum(F.when(F.col("marked") & F.col("short").isNull(), F.col("n")).otherwise(0)).alias("starts"), F.sum("n").alias("n"))
    )
    share = counted.agg((F.sum("starts") / F.sum("n")).alias("share"))
    k, n = F.col("starts"), F.col("n")
    ratio = 2 * (_fit(k, n, k / n) - _fit(k, n, F.col("share")))
    starters = counted.filter("starts > 0").crossJoin(F.broadcast(share)).filter((ratio >= least_starter) & (k / n > F.col("share"))).select("nxt").collect()
    return TrainedSplitter(frozenset(short), frozenset(r[0] for r in starters))
