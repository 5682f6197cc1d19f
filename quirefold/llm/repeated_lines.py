"""Lines repeated across one source's pages.

Method: each task keeps a mergeable heavy-hitter summary (Misra-Gries, merged by
subtracting the first counter beyond the capacity) of the line hashes of every
source it sees. Summaries are merged in a tree, FAN at a time, and cut back to the
capacity at each level, so a source that is in all tasks costs no task more than
FAN summaries. They name candidate lines; an exact second pass over the text
counts the distinct pages of the candidates. Confirmed lines are removed in a pass
over the pages through a broadcast set while that set is small, by a shuffle join
beyond that.

Defined results
  * two lines are the same if equal after trimming, white-space runs as one
    space, lower-casing and digit runs as one sign;
  * blank lines are never removed; rows with a null source, text or page index
    keep their text and count for nothing;
  * repeated rows of one page count as one page, yet each gets its removals;
  * an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import mix64, small_enough
from quirefold.session import staged

DIGIT_RUN = re.compile(r"\d+")
#: Counters kept for one slice of one source by one task.
CAPACITY = 8192
#: A source's lines are summarised in this many slices, so that one hot source
#: spreads over as many tasks.
SLICES = 64
#: Summaries of one slice that one task merges.
FAN = 32
#: Confirmed lines are broadcast up to this many rows (24 bytes each).
BROADCAST_ROWS = 1_000_000


def line_keys(text: str) -> list[str]:
    """The comparison form of each line of a text, in order; '' for a blank line."""
    folded = DIGIT_RUN.sub("0", text.lower())
    return [" ".join(line.split()) for line in folded.split("\n")]


def as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def source_hash(name: str) -> int:
    return xxhash.xxh64_intdigest(name)


class Summary:
    """Misra-Gries counters of (source, slice), held as sorted arrays."""

    def __init__(self, capacity: int = CAPACITY, slices: int = SLICES):
        self.capacity, self.slices = capacity, np.uint64(slices)
        self.source = np.empty(0, np.uint64)
        self.line = np.empty(0, np.uint64)
        self.count = np.empty(0, np.int64)
        self.error: dict[tuple[int, int], int] = {}

    def add(self, source: np.ndarray, line: np.ndarray, count: np.ndarray) -> None:
        """Merge more counters in; then cut every slice back to the capacity."""
        s = np.concatenate([self.source, source])
        v = np.concatenate([self.line, line])
        n = np.concatenate([self.count, count])
        if not len(s):
            return
        order = np.lexsort((v, s))
        s, v, n = s[order], v[order], n[order]
        first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (v[1:] != v[:-1])])
        s, v, n = s[first], v[first], np.add.reduceat(n, first)
        if len(s) > self.capacity:
            part = v % self.slices
            order = np.lexsort((-n, part, s))
            s, v, n, part = s[order], v[order], n[order], part[order]
            first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (part[1:] != part[:-1])])
            size = np.diff(np.r_[first, len(s)])
            for i, k in zip(first[size > self.capacity], size[size > self.capacity]):
                less = int(n[i + self.capacity])
                n[i : i + k] -= less
                at = (int(s[i]), int(part[i]))
                self.error[at] = self.error.get(at, 0) + less
            keep = n > 0
            s, v, n = s[keep], v[keep], n[keep]
        self.source, self.line, self.count = s, v, n

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The counters, and the error of each slice that was cut as a row without a line."""
        slices, step = self.slices, 50_000
        for i in range(0, len(self.line), step):
            v = self.line[i : i + step]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(as_long(self.source[i : i + step])),
                    pa.array((v % slices).astype(np.int32)),
                    pa.array(as_long(v)),
                    pa.array(self.count[i : i + step]),
                    pa.array(np.zeros(len(v), np.int64)),
                ],
                schema=SUMMARY,
            )
        bad = list(self.error.items())
        if bad:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(as_long(np.array([k[0] for k, _ in bad], np.uint64))),
                    pa.array([k[1] for k, _ in bad], pa.int32()),
                    pa.array([None] * len(bad), pa.int64()),
                    pa.array([0] * len(bad), pa.int64()),
                    pa.array([e for _, e in bad], pa.int64()),
                ],
                schema=SUMMARY,
            )


SUMMARY = pa.schema(
    [("src", pa.int64()), ("slice", pa.int32()), ("line", pa.int64()), ("n", pa.int64()), ("err", pa.int64())]
)
SUMMARY_DDL = "src long, slice int, line long, n long, err long"
LINES = pa.schema(
    [("row_id", pa.int64()), ("pos", pa.int32()), ("src", pa.int64()), ("page", pa.int64()), ("line", pa.int64()), ("line2", pa.int64())]
)
LINES_DDL = "row_id long, pos int, src long, page long, line long, line2 long"


def _rows(batch: pa.RecordBatch):
    """(source hash, page, text, row id) of the usable rows of a batch."""
    columns = [batch.column(i).to_pylist() for i in range(4)]
    for source, page, text, row in zip(*columns):
        if source is not None and page is not None and text:
            yield source, page, text, row


def summarise(capacity: int = CAPACITY, slices: int = SLICES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Summary(capacity, slices)
        hashes: dict[str, int] = {}
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            src, page, line = [], [], []
            for source, at, text, _ in _rows(batch):
                h = hashes.get(source)
                if h is None:
                    h = hashes[source] = source_hash(source)
                own = {digest(k) for k in line_keys(text) if k}
                line.extend(own)
                src.extend([h] * len(own))
                page.extend([at] * len(own))
            if len(hashes) > 100_000:
                hashes.clear()
            if not line:
                continue
            s, p, v = (np.array(x, dtype=t) for x, t in ((src, np.uint64), (page, np.int64), (line, np.uint64)))
            mark = mix64(s ^ mix64(v ^ mix64(p.view(np.uint64))))
            _, once = np.unique(mark, return_index=True)
            total.add(s[once], v[once], np.ones(len(once), np.int64))
        yield from total.batches()

    return run


def merge(capacity: int = CAPACITY, slices: int = SLICES):
    """Summaries (SUMMARY_DDL), all of a slice in one partition -> one of them, cut to the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Summary(capacity, slices)
        for batch in batches:
            src, part, line, n, err = (c for c in batch.columns[:5])
            lost = line.is_null().to_numpy(zero_copy_only=False)
            src = src.to_numpy(zero_copy_only=False).view(np.uint64)
            for i in np.flatnonzero(lost):
                at = (int(src[i]), part[int(i)].as_py())
                total.error[at] = total.error.get(at, 0) + err[int(i)].as_py()
            total.add(src[~lost], line.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)[~lost], n.to_numpy(zero_copy_only=False)[~lost])
        yield from total.batches()

    return run


def explode_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every non-blank line: row, position, source and a 128-bit key."""
    low = (1 << 64) - 1
    for batch in batches:
        out = [[] for _ in range(6)]
        for source, page, text, row in _rows(batch):
            h = source_hash(source)
            for pos, key in enumerate(line_keys(text)):
                if key:
                    out[0].append(row)
                    out[1].append(pos)
                    out[2].append(h)
                    out[3].append(page)
                    out[4].append(xxhash.xxh3_64_intdigest(key))
                    out[5].append(xxhash.xxh64_intdigest(key) & low)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(out[0], pa.int64()),
                pa.array(out[1], pa.int32()),
                *(
                    pa.array(as_long(np.array(x, np.uint64))) if k != 3 else pa.array(x, pa.int64())
                    for k, x in enumerate(out)
                    if k >= 2
                ),
            ],
            schema=LINES,
        )


def _usable(pages: DataFrame, source: str, page: str, text: str, row_id: str) -> DataFrame:
    return pages.select(
        F.col(source).cast("string").alias("src"),
        F.col(page).cast("long").alias("page"),
        F.col(text).alias("text"),
        F.col(row_id).cast("long").alias("row_id"),
    )


def candidate_lines(rows: DataFrame, min_pages: int, capacity: int = CAPACITY, slices: int = SLICES, fan: int = FAN) -> DataFrame:
    """(src, line) whose merged counter, plus the error of its slice, reaches the bar.

    A null line stands for a slice whose error alone reaches the bar: there the
    summary excludes nothing and every line of the slice goes to the exact count.
    """
    parts = staged(rows.mapInArrow(summarise(capacity, slices), SUMMARY_DDL).withColumn("task", F.spark_partition_id()))
    while (parts.agg(F.max("task")).first()[0] or 0) >= fan:
        group = F.floor(F.col("task") / fan)
        together = parts.withColumn("group", group).repartition("src", "slice", "group").drop("group", "task")
        # what lies in one partition is merged; the partition is the summary's number at the next level
        dense = F.pmod(F.spark_partition_id(), (F.lit(parts.agg(F.max("task")).first()[0]) / fan).cast("int") + 1)
        parts = staged(together.mapInArrow(merge(capacity, slices), SUMMARY_DDL).withColumn("task", dense))
    parts = parts.drop("task").repartition("src", "slice")
    merged = parts.groupBy("src", "slice", "line").agg(F.sum("n").alias("n"), F.sum("err").alias("err"))
    # only rows with a null line have an error; the window reuses the partitioning
    slice_err = F.sum("err").over(Window.partitionBy("src", "slice"))
    return (
        merged.withColumn("slice_err", slice_err)
        .filter(F.when(F.col("line").isNull(), F.col("err")).otherwise(F.col("n") + F.col("slice_err")) >= min_pages)
        .select("src", "slice", "line")
    )


def repeated_lines(
    pages: DataFrame,
    source: str = "doc_id",
    page: str = "page_index",
    text: str = "text",
    row_id: str = "line_no",
    min_pages: int = 5,
    capacity: int = CAPACITY,
    slices: int = SLICES,
    broadcast_rows: int = BROADCAST_ROWS,
    fan: int = FAN,
) -> DataFrame:
    """(row_id, pos) of every line that stands on ``min_pages`` pages of its source."""
    hits, confirmed, hint = _confirmed_lines(_usable(pages, source, page, text, row_id), min_pages, capacity, slices, broadcast_rows, fan)
    return hits.join(hint(confirmed), KEY, "left_semi").select("row_id", "pos")


KEY = ["src", "line", "line2"]


def _confirmed_lines(rows: DataFrame, min_pages: int, capacity: int, slices: int, broadcast_rows: int, fan: int):
    """(occurrences of candidate lines; the lines that are repeated enough; how to join these)."""
    found = staged(candidate_lines(rows, min_pages, capacity, slices, fan))
    named = found.filter("line IS NOT NULL").select("src", "line").distinct()
    open_slices = found.filter("line IS NULL").select("src", "slice").distinct()
    hint = F.broadcast if small_enough(found, broadcast_rows) else (lambda x: x)
    lines = rows.mapInArrow(explode_lines, LINES_DDL)
    hits = lines.join(hint(named), ["src", "line"], "left_semi")
    if not open_slices.isEmpty():
        # the unsigned remainder, as the summary takes it
        part = F.pmod(
            F.pmod(F.col("line"), F.lit(slices)) + F.when(F.col("line") < 0, F.lit(pow(2, 64, slices))).otherwise(F.lit(0)),
            F.lit(slices),
        ).cast("int")
        rest = lines.join(hint(named), ["src", "line"], "left_anti").withColumn("slice", part)
        hits = hits.select(*LINES.names).unionByName(
            rest.join(hint(open_slices), ["src", "slice"], "left_semi").select(*LINES.names)
        )
    hits = staged(hits.select(*LINES.names))
    confirmed = staged(
        hits.groupBy(*KEY).agg(F.countDistinct("page").alias("pages")).filter(F.col("pages") >= min_pages).select(*KEY)
    )
    small = small_enough(confirmed, broadcast_rows)
    return hits, confirmed, F.broadcast if small else (lambda x: x)


def drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, texts, gone = (batch.column(i).to_pylist() for i in range(3))
        clean, removed = [], []
        for text, positions in zip(texts, gone):
            if positions and text is not None:
                cut = set(positions)
                text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in cut)
            clean.append(text)
            removed.append(len(positions or ()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array(clean, pa.string()), pa.array(removed, pa.int64())],
            names=["row_id", "text", "removed_lines"],
        )


class LineSet:
    """Keys of confirmed lines as sorted arrays: 16 bytes a line."""

    def __init__(self, keys: np.ndarray):
        src, line, line2 = keys.view(np.uint64).reshape(-1, 3).T if len(keys) else np.empty((3, 0), np.uint64)
        mark = mix64(src ^ mix64(line))
        order = np.lexsort((line2, mark))
        self.mark, self.line2 = mark[order], line2[order]

    def holds(self, src: int, line: np.ndarray, line2: np.ndarray) -> np.ndarray:
        mark = mix64(np.uint64(src) ^ mix64(line))
        found = np.zeros(len(line), bool)
        at = np.searchsorted(self.mark, mark)
        # lines that share a mark follow each other
        todo = np.flatnonzero(at < len(self.mark))
        while len(todo):
            todo = todo[self.mark[at[todo]] == mark[todo]]
            found[todo] |= self.line2[at[todo]] == line2[todo]
            at[todo] += 1
            todo = todo[~found[todo] & (at[todo] < len(self.mark))]
        return found


def drop_confirmed(shared):
    """(src, page, text, row_id) -> (row_id, text, removed_lines); ``shared``: a Spark broadcast of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = LineSet(shared.value)
        low = (1 << 64) - 1
        for batch in batches:
            clean, removed = [], []
            for source, page, text, _ in zip(*(batch.column(i).to_pylist() for i in range(4))):
                n = 0
                if source is not None and page is not None and text:
                    keys = line_keys(text)
                    some = [i for i, k in enumerate(keys) if k]
                    line = np.array([xxhash.xxh3_64_intdigest(keys[i]) for i in some], np.uint64)
                    line2 = np.array([xxhash.xxh64_intdigest(keys[i]) & low for i in some], np.uint64)
                    gone = {some[i] for i in np.flatnonzero(lines.holds(source_hash(source), line, line2))}
                    n = len(gone)
                    if n:
                        text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
                clean.append(text)
                removed.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(3), pa.array(clean, pa.string()), pa.array(removed, pa.int64())], names=["row_id", "text", "removed_lines"]
            )

    return run


CLEAN_DDL = "row_id long, text string, removed_lines long"


def without_repeated_lines(
    pages: DataFrame,
    source: str = "doc_id",
    page: str = "page_index",
    text: str = "text",
    row_id: str = "line_no",
    min_pages: int = 5,
    capacity: int = CAPACITY,
    slices: int = SLICES,
    broadcast_rows: int = BROADCAST_ROWS,
    fan: int = FAN,
) -> DataFrame:
    """Every row with its text less the repeated lines: (row_id, text, removed_lines).

    While the confirmed lines are few they go to the pages; beyond that, the
    positions to be removed are joined to the pages by row.
    """
    rows = _usable(pages, source, page, text, row_id)
    hits, confirmed, _ = _confirmed_lines(rows, min_pages, capacity, slices, broadcast_rows, fan)
    if small_enough(confirmed, broadcast_rows):
        found = confirmed.select(*KEY).toArrow()  # at most broadcast_rows, 24 bytes each
        keys = np.stack([found.column(k).to_numpy() for k in KEY], axis=1)
        return rows.mapInArrow(drop_confirmed(pages.sparkSession.sparkContext.broadcast(keys)), CLEAN_DDL)
    gone = hits.join(confirmed, KEY, "left_semi").groupBy("row_id").agg(F.collect_list("pos").alias("gone"))
    return rows.select("row_id", "text").join(gone, "row_id", "left").select("row_id", "text", "gone").mapInArrow(drop_lines, CLEAN_DDL)
