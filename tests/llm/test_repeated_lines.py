import random
import re

import numpy as np
import pytest

from quirefold.llm.repeated_lines import Summary, repeated_lines, without_repeated_lines


def key(line):
    return re.sub(r"\d+", "0", " ".join(line.split()).lower())


def brute(rows, least=5):
    pages = {}
    for row, doc, page, text, _ in rows:
        if doc is not None and page is not None and text is not None:
            for line in text.split("\n"):
                if key(line):
                    pages.setdefault((doc, key(line)), set()).add(page)
    return sorted(
        (row, i)
        for row, doc, page, text, _ in rows
        if doc is not None and page is not None and text is not None
        for i, line in enumerate(text.split("\n"))
        if key(line) and len(pages[doc, key(line)]) >= least
    )


def corpus():
    rng = random.Random(8)
    rows, no = [], 0
    for doc in ["hot"] * 6 + ["a", "b", "c"]:
        base = no
        for p in range(40):
            lines = [f"line {rng.choice('abcdefgh')}{rng.choice('xyz') * rng.randint(1, 3)}" for _ in range(4)]
            lines += [f"Page {p} of 40", "  ALL\trights  reserved" if p % 2 else "All rights reserved"]
            rng.shuffle(lines)
            rows.append((no, doc, base + p, "\n".join(lines) + "\n\n", "x"))
            no += 1
    rows += [(no + 1, "a", 5000, "rare line", "x")] * 2 + [(no + 3, None, 1, "Page 1 of 40", "x"), (no + 4, "a", 6000, None, "x"), (no + 5, "a", 7000, "", "x")]
    rows += [(no + 10 + i, "copies", 1, "same page again", "x") for i in range(9)]
    return rows


@pytest.mark.parametrize("options", [{}, {"capacity": 4, "slices": 2}, {"broadcast_rows": 0}, {"fan": 2}, {"fan": 2, "capacity": 4, "slices": 2}])
def test_against_brute_force(spark, options):
    rows = corpus()
    frame = spark.createDataFrame(rows, "line_no long, doc_id string, page_index long, text string, src string").repartition(7)
    got = sorted((r.row_id, r.pos) for r in repeated_lines(frame, **options).collect())
    assert got == brute(rows)


def test_removal(spark):
    frame = spark.createDataFrame(corpus(), "line_no long, doc_id string, page_index long, text string, removed_lines string")
    got = {r.row_id: r for r in without_repeated_lines(frame).collect()}
    assert got[0].text is not None and "rights" not in got[0].text.lower()
    assert got[361].text == "rare line"
    joined = {r.row_id: r for r in without_repeated_lines(frame, broadcast_rows=0).collect()}
    assert joined == got and sum(r.removed_lines for r in got.values()) > 700
    assert without_repeated_lines(frame.filter("false")).count() == 0


def test_summary_merges_within_its_error():
    rng = np.random.default_rng(1)
    lines = np.minimum(rng.zipf(1.3, 20_000), 3000).astype(np.uint64)
    true = np.bincount(lines.astype(int))
    total = Summary(capacity=50, slices=4)
    for part in np.array_split(lines, 17):
        v, n = np.unique(part, return_counts=True)
        total.add(np.zeros(len(v), np.uint64), v, n)
    seen = dict(zip(total.line.tolist(), total.count.tolist()))
    for line, n in enumerate(true):
        error = total.error.get((0, line % 4), 0)
        assert seen.get(line, 0) <= n <= seen.get(line, 0) + error
