import random
from math import ceil

from hypothesis import given, settings
from hypothesis import strategies as st

from quirefold.llm.split import BALANCE, COST, PIECE, Limits, atoms, pieces, span_pieces, split_oversized


def check(text, limits):
    found = pieces(text, limits)
    words = text.split()
    for a, b in found:
        part = text[a:b]
        assert part.strip() == part and (part or not words)
        assert len(part) <= limits.max_chars and len(part.split()) <= limits.max_words
    covered = set()
    for a, b in found:
        covered |= set(range(a, b))
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())
    if words and max(map(len, words)) <= limits.max_chars // (limits.overlap_words + 2):
        for (_, b), (a, _) in zip(found, found[1:]):
            assert len(text[a:b].split()) == min(limits.overlap_words, limits.max_words - 1)
    return found


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n。é", max_size=400), st.integers(1, 12), st.integers(8, 60), st.integers(0, 3))
def test_limits_and_cover(text, words, chars, overlap):
    check(text, Limits(words, chars, overlap))


def cost_of(found, text, limits):
    """What a way of cutting costs, after the definition."""
    s, e, edge = atoms(text, limits.max_chars)
    share = (e[-1] - s[0]) / max(1.0, ceil(max((e[-1] - s[0]) / limits.max_chars, len(s) / limits.max_words)))
    at = {int(x): int(k) for x, k in zip(e, edge)}
    total = 0.0
    for a, b in found:
        total += PIECE + BALANCE * (1 - (b - a) / share) ** 2 + (COST[at[b]] if b != e[-1] else 0)
    return total


def brute(text, limits):
    """The least cost over all ways of cutting at word edges (no overlap, no long words)."""
    s, e, edge = (x.tolist() for x in atoms(text, limits.max_chars))
    n = len(s)
    share = (e[-1] - s[0]) / max(1.0, ceil(max((e[-1] - s[0]) / limits.max_chars, n / limits.max_words)))
    best = [0.0] + [float("inf")] * n
    for c in range(n):
        for k in range(c + 1):
            if e[c] - s[k] <= limits.max_chars and c - k < limits.max_words:
                more = PIECE + BALANCE * (1 - (e[c] - s[k]) / share) ** 2 + (COST[edge[c]] if c < n - 1 else 0)
                best[c + 1] = min(best[c + 1], best[k] + more)
    return best[n]


def test_no_cheaper_way_exists():
    rng = random.Random(11)
    for _ in range(300):
        text = " ".join(rng.choice(["a", "bb", "ccc.", "dd", "ee\n\nf", "Gggg."]) for _ in range(rng.randint(5, 60)))
        limits = Limits(rng.randint(2, 12), rng.randint(20, 60), 0)
        if len(text.split()) > limits.max_words or len(text) > limits.max_chars:
            assert abs(cost_of(check(text, limits), text, limits) - brute(text, limits)) < 1e-6


def test_edges_are_preferred():
    text = "aa bb cc. dd ee ff.\n\ngg hh ii. jj kk ll."
    assert [text[a:b] for a, b in pieces(text, Limits(6, 100, 0))] == ["aa bb cc. dd ee ff.", "gg hh ii. jj kk ll."]


def test_many_small_texts():
    rng = random.Random(5)
    for _ in range(30):
        text = " ".join(rng.choice(["a", "bb", "ccc.", "dd"]) for _ in range(rng.randint(5, 14)))
        check(text, Limits(rng.randint(2, 5), 40, rng.randint(0, 1)))


def test_one_long_word():
    found = check("x" * 5200, Limits(512, 4000, 64))
    assert len(found) >= 2


def test_span_mapping():
    spans = [
        {"page_index": 4, "page_label": None, "char_start": 10, "char_end": 15},
        {"page_index": 5, "page_label": "6", "char_start": 0, "char_end": 4},
    ]
    got = span_pieces(3, 9, spans, 11)
    assert [(x["page_index"], x["char_start"], x["char_end"]) for x in got] == [(4, 13, 15), (5, 0, 2)]
    assert span_pieces(0, 3, spans, 12) is None
    assert span_pieces(0, 3, None, 12) is None


def test_frame(spark):
    ddl = "kind string, row_key long, text string, spans array<struct<page_index: long, page_label: string, char_start: long, char_end: long>>, extra int"
    long = " ".join(f"w{i}" for i in range(30))
    rows = [("page", 1, long, [(0, "1", 0, len(long))], 1), ("page", 2, None, None, 1), ("page", 3, "", None, 1), ("page", 4, "a b", None, 1), ("page", 5, " " * 500, None, 1), ("page", 1, long, None, 1)]
    got = split_oversized(spark.createDataFrame(rows, ddl), {"page": Limits(12, 300, 2)}).collect()
    assert {r.row_key for r in got} == {1, 5}
    assert all(r.token_count == len(r.text.split()) <= 12 for r in got)
    assert [r.text for r in got if r.row_key == 5] == [""]
    assert split_oversized(spark.createDataFrame([], ddl), {"page": Limits(12, 300, 2)}).count() == 0
