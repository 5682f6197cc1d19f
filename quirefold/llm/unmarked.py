"""Sentence boundaries between words, for text without end marks.

Method: a hidden-event trigram model. The words of all texts, without their marks
and with a boundary token after each sentence, are one stream whose n-grams are
counted. In a block without any end mark, an unseen event (boundary or none) stands
between every two words; the words' probabilities depend on the events before them,
so forward and backward sums run over a lattice of two states a gap, and a boundary
is set where its posterior is above one half. In scripts without spaces a character
with its marks is a word.

The stream for training is made by the model for end marks (``sentences.train``)
from all blocks that have end marks. N-grams that make up SHARE of the stream have
entries, so the model's size is bounded at any number of texts.

Defined results: blocks with end marks are cut as ``sentences`` cuts them; null and
blank texts have no sentences; repeated rows each have theirs; without training
text every block is one sentence.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.sentences import BLANK, FOUND_DDL, MARK, THAI_GAP, Model, clean, train
from quirefold.session import staged

#: Share of the stream, and the least count, that give an n-gram an entry.
SHARE, LEAST = 1e-6, 2
#: Weight of the shorter context's probability, in words.
BACK_OFF = 3.0
#: Characters of scripts without spaces; Thai letters take their marks along.
DENSE = "⺀-鿿ぁ-ヿ豈-﫿\U00020000-\U0003ffff"
WORD = re.compile(rf"[{DENSE}]|[ก-ฯะาำเ-ๆ][ัิ-ฺ็-๎]*|[^\s{DENSE}ก-๎]+")
#: A word without the signs around it; combining marks at its end belong to it.
CORE = re.compile("\\w(?:.*[\\w\u0300-\u036f\u0591-\u05c7\u064b-\u065f\u0900-\u0903\u093a-\u0963\u0e31-\u0e4e])?", re.S)
B, SEP = "\x02", "\x1f"


def words(block: str) -> tuple[list[str], list[int], list[int]]:
    """Keys, starts and ends of the words of a block; signs alone belong to the word before."""
    keys, starts, ends = [], [], []
    for m in WORD.finditer(block):
        core = CORE.search(m.group())
        if core is None:
            if ends:
                ends[-1] = m.end()
            continue
        key = clean(core.group())
        keys.append("0" if key[0].isdigit() else key)
        starts.append(m.start())
        ends.append(m.end())
    return keys, starts, ends


def blocks(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in BLANK.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def is_marked(text: str, a: int, b: int) -> bool:
    """Whether a block has an end mark, or in Thai a space that may be one."""
    return MARK.search(text, a, b) is not None or THAI_GAP.search(text, a, b) is not None


def stream(block: str, ends: list[int]) -> list[str]:
    """The words of a block with a boundary token before the first and after each sentence."""
    keys, starts, _ = words(block)
    last = {bisect_left(starts, e) - 1 for e in ends}
    out = [B]
    for i, key in enumerate(keys):
        out.append(key)
        if i in last or i == len(keys) - 1:
            out.append(B)
    return out


NGRAM_DDL = "gram string, n long"


def count_ngrams(parts):
    """(kind, row_key, text) -> counts of the n-grams of blocks with end marks; "" counts the stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*parts)
        total: Counter = Counter()

        def flush():
            grams = list(total)
            for i in range(0, len(grams), 50_000):
                part = grams[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([total[g] for g in part], pa.int64())], names=["gram", "n"])
            total.clear()

        for batch in batches:
            for text in batch.column(2).to_pylist():
                if not text or not is_marked(text, 0, len(text)):
                    continue
                ends = model.boundaries(text)
                for a, b in blocks(text):
                    if not is_marked(text, a, b):
                        continue
                    own = [e - a for e in ends[bisect_left(ends, a + 1) : bisect_left(ends, b + 1)]]
                    s = stream(text[a:b], own)
                    if len(s) < 3:
                        continue
                    two = list(map(SEP.join, zip(s, s[1:])))
                    total[""] += len(s)
                    total.update(s)
                    total.update(two)
                    total.update(map(SEP.join, zip(two, s[2:])))
            if len(total) > 500_000:
                yield from flush()
        yield from flush()

    return run


class Words:
    """Interpolated probabilities of words and boundaries, and posteriors of boundaries."""

    def __init__(self, count: dict[str, int]):
        self.count = count
        self.size = max(1, count.get("", 1))
        self.memo: dict[str, float] = {}

    def p(self, before: str, last: str, word: str) -> float:
        """The probability of a word after two others."""
        key = before + SEP + last + SEP + word
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            c = self.count.get
            one = (c(word, 0) + 0.5) / (self.size + 1)
            two = (c(last + SEP + word, 0) + BACK_OFF * one) / (c(last, 0) + BACK_OFF)
            got = self.memo[key] = (c(key, 0) + BACK_OFF * two) / (c(before + SEP + last, 0) + BACK_OFF)
        return got

    def posteriors(self, keys: list[str]) -> list[float]:
        """Of a boundary after each word but the last."""
        n = len(keys)
        steps = []
        for i in range(n - 1):
            w, nxt = keys[i], keys[i + 1]
            enter = self.p(w, B, nxt)
            # rows: what stands before w (a word, a boundary); columns: the event after w (none, boundary)
            steps.append([(self.p(x, w, nxt), self.p(x, w, B) * enter) for x in (keys[i - 1] if i else B, B)])
        forward = [(0.0, 1.0)]
        for t in steps:
            a, b = forward[-1]
            x, y = a * t[0][0] + b * t[1][0], a * t[0][1] + b * t[1][1]
            forward.append((x / (x + y), y / (x + y)))
        back = [tuple(self.p(x, keys[-1], B) for x in (keys[-2] if n > 1 else B, B))]
        for t in reversed(steps):
            c, d = back[-1]
            x, y = t[0][0] * c + t[0][1] * d, t[1][0] * c + t[1][1] * d
            s = max(x, y)
            back.append((x / s, y / s))
        back.reverse()
        return [b * d / (a * c + b * d) for (a, b), (c, d) in zip(forward[1:], back[1:])]

    def ends(self, block: str) -> list[int]:
        """The end of every sentence of a block without marks."""
        keys, _, ends = words(block)
        stop = len(block.rstrip())
        if len(keys) < 2 or not self.count:
            return [stop] if stop else []
        return [*(e for e, p in zip(ends, self.posteriors(keys)) if p > 0.5), stop]


def train_words(rows: DataFrame, model: Model, share: float = SHARE) -> dict[str, int]:
    """N-gram counts over all texts; entries that make up enough of the stream come to the driver."""
    counts = staged(rows.mapInArrow(count_ngrams(model.parts()), NGRAM_DDL).groupBy("gram").agg(F.sum("n").alias("n")))
    size = counts.filter("gram = ''").agg(F.sum("n")).first()[0] or 0
    return {r[0]: r[1] for r in counts.filter(F.col("n") >= max(LEAST, share * size)).collect()} if size else {}


def cut(parts, shared):
    """``shared``: a Spark broadcast of n-gram counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, between = Model(*parts), Words(shared.value)
        for batch in batches:
            out = [[] for _ in range(5)]
            for kind, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not text or text.isspace():
                    continue
                marked = model.boundaries(text)
                ends: list[int] = []
                for a, b in blocks(text):
                    if is_marked(text, a, b):
                        ends += marked[bisect_left(marked, a + 1) : bisect_left(marked, b + 1)]
                    else:
                        ends += [a + e for e in between.ends(text[a:b])]
                at = 0
                for n, e in enumerate(ends):
                    while text[at].isspace():
                        at += 1
                    for column, value in zip(out, (kind, key, n, at, e)):
                        column.append(value)
                    at = e
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:])],
                names=["kind", "row_key", "sentence_index", "char_start", "char_end"],
            )

    return run


def sentences_between_words(rows: DataFrame, model: Model | None = None, counts: dict[str, int] | None = None) -> DataFrame:
    """As ``sentences.sentences``; blocks without end marks are cut between words, too."""
    rows = rows.select("kind", "row_key", "text")
    model = model or train(rows)
    shared = rows.sparkSession.sparkContext.broadcast(train_words(rows, model) if counts is None else counts)
    return rows.mapInArrow(cut(model.parts(), shared), FOUND_DDL)
