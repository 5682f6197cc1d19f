"""Row-producing functions on text: one row for each word, paragraph or sentence.

Offsets of every part need the lengths of all parts before it. Exploding and
summing in a window would shuffle one row a word; these run in Arrow batches
where the text is, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quirefold.functions.sentences import Splitter, splitter_of
from quirefold.functions.tokens import load
from quirefold.operators.kernels import split_paragraphs

Spans = Callable[[str], list[tuple[int, int]]]


def parts_of(rows: DataFrame, spans: Callable[[], Spans], number: str, text: str = "text") -> DataFrame:
    """The other columns of ``rows`` with ``number``, char_start and char_end of each part.

    Null and empty texts have no rows. ``spans`` makes the splitter on the worker.
    """
    kept = [f for f in rows.schema.fields if f.name != text]
    names = [*(f.name for f in kept), number, "char_start", "char_end"]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{number}` long", "char_start long", "char_end long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = spans()
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                row, no, start, end = [], [], [], []
                for i, value in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    for n, (a, b) in enumerate(split(value) if value else ()):
                        row.append(i)
                        no.append(n)
                        start.append(a)
                        end.append(b)
                taken = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(taken) for c in batch.columns[:-1]), *(pa.array(x, pa.int64()) for x in (no, start, end))], names=names
                )

    return rows.select(*(f"`{f.name}`" for f in kept), text).mapInArrow(run, ddl)


def word_rows(rows: DataFrame, text: str = "text", tokenizer="word-counter") -> DataFrame:
    """One row a token, of the word counter, a tokenizer file or a counter of the caller's."""
    return parts_of(rows, lambda: load(tokenizer).offsets, "token_no", text)


def paragraph_rows(rows: DataFrame, text: str = "text") -> DataFrame:
    return parts_of(rows, lambda: split_paragraphs, "paragraph_no", text)


def sentence_rows(rows: DataFrame, text: str = "text", splitter: str | Splitter = "abbreviations") -> DataFrame:
    split = splitter_of(splitter)
    return parts_of(rows, lambda: split, "sentence_no", text)
