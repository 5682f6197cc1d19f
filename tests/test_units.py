import random

from quirefold.operators.sections import path_groups
from quirefold.operators.units import collected_spans, span_texts, spans_of_ranges, token_windows, unit_segments, unit_texts
from tests.test_pipeline import doc, frames, page


def test_segments_texts_and_spans(spark):
    _, pages = frames(spark, [doc(pages=3)], [page(index=0, text="hello world"), page(index=1, text="second page"), page(index=4, text="")])
    segments = unit_segments(pages, cross_page=True)
    assert sorted((r.page_index, r.g_start, r.g_end) for r in segments.collect()) == [(0, 0, 11), (1, 13, 24), (4, 26, 26)]
    assert unit_texts(pages, cross_page=True).first().text == "hello world\n\nsecond page\n\n"
    ranges = spark.createDataFrame([("d1", 0, 0, 6, 24), ("d1", 0, 1, 11, 13), ("d1", 0, 2, 12, 14)], "doc_key string, unit long, range_no long, s long, e long")
    parts = spans_of_ranges(ranges, segments)
    got = {r.range_no: [(x.page_index, x.char_start, x.char_end) for x in r.spans] for r in collected_spans(parts).collect()}
    assert got == {0: [(0, 6, 11), (1, 0, 11)], 2: [(1, 0, 1)]}
    assert unit_segments(pages).count() == 3


def test_ranges_over_several_blocks(spark):
    """As with a plain loop, for pages and ranges that cross blocks of text."""
    rng = random.Random(4)
    segments, at = [], 0
    for i in range(40):
        size = rng.choice([0, 5, 3000, 90_000, 200_000])
        segments.append(("d", 0, i, None, at, at + size))
        at += size + 2
    ranges = [("d", 0, k, a, a + rng.choice([0, 1, 50, 100_000, 400_000])) for k, a in enumerate(rng.sample(range(at), 60))]
    got = spans_of_ranges(
        spark.createDataFrame(ranges, "doc_key string, unit long, range_no long, s long, e long"),
        spark.createDataFrame(segments, "doc_key string, unit long, page_index long, page_label string, g_start long, g_end long"),
    ).collect()
    want = sorted((k, i, max(s, a) - a, min(e, b) - a) for _, _, k, s, e in ranges for _, _, i, _, a, b in segments if a < e and s < b)
    assert sorted((r.range_no, r.page_index, r.char_start, r.char_end) for r in got) == want


def test_runs_of_paths_over_several_blocks(spark):
    rng = random.Random(5)
    rows = []
    for d in "ab":
        for i in sorted(rng.sample(range(20_000), 300)):
            path = rng.choice([None, [], ["A"], ["A", "B"]]) if rng.random() < 0.3 or not rows else rows[-1][3]
            rows.append((d, len(rows), i, path))
    got = {r.seq: r.section_no for r in path_groups(spark.createDataFrame(rows, "doc_key string, seq long, page_index long, section_path array<string>")).collect()}
    for d in "ab":
        no, before = -1, None
        for _, seq, _, path in (r for r in rows if r[0] == d):
            if before is None or before != (path or []):
                no += 1
            before = path or []
            assert got[seq] == no


def test_windows(spark):
    counts = spark.createDataFrame([(n,) for n in (0, 1, 4, 5, 10, 11)], "n_tokens long")
    got = {}
    for r in token_windows(counts, 4, 1).collect():
        got.setdefault(r.n_tokens, []).append((r.first_token, r.last_token))
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [(0, 0)], 4: [(0, 3)], 5: [(0, 3), (3, 4)], 10: [(0, 3), (3, 6), (6, 9)], 11: [(0, 3), (3, 6), (6, 9), (9, 10)],
    }


def test_texts_from_spans(spark):
    _, pages = frames(spark, [doc(pages=2)], [page(index=0, text="ab😀cd"), page(index=1, text="efg")])
    ddl = "chunk_id string, doc_key string, spans array<struct<page_index: long, page_label: string, char_start: long, char_end: long>>"
    chunks = spark.createDataFrame([("x", "d1", [(0, None, 1, 3), (0, None, 3, 4), (1, None, 0, 2)]), ("y", "d1", [(9, None, 0, 1)])], ddl)
    assert {r.chunk_id: r.text for r in span_texts(chunks, pages).collect()} == {"x": "b😀c\n\nef", "y": None}
