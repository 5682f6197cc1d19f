import random
from math import comb

import numpy as np
import pyarrow as pa
import pytest

from quirefold.llm.near_dup import BITS, PLANES, POSITIONS, JoinPlan, Kind, WordHashes, classes, compare_nodes, components, extra_trees, id_pairs, shingles, missed, signatures, similar_records, units

DDL = "kind int, id string, row_no long, text string, extra string"


def brute(rows, kinds):
    sets = {}
    for k, i, _, t, _ in rows:
        if i is None or t is None:
            continue
        u = t.lower().split() if kinds[k].unit == "word" else t.lower()
        if kinds[k].min_words and len(t.split()) < kinds[k].min_words:
            continue
        g = {tuple(u[j : j + kinds[k].size]) for j in range(len(u) - kinds[k].size + 1)}
        if g:
            sets.setdefault((k, i), []).append(g)
    ids = sorted(sets)
    return {
        (x[0], *sorted((x[1], y[1])))
        for a, x in enumerate(ids)
        for y in ids[a + 1 :]
        if x[0] == y[0] and any(len(s & t) / len(s | t) >= kinds[x[0]].threshold for s in sets[x] for t in sets[y])
    }


def corpus(seed, n):
    rng = random.Random(seed)
    rows, no = [], 0
    for i in range(n):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(3, 60))]
        for c in range(rng.choice([1, 1, 2, 4])):
            own = list(words)
            for _ in range(rng.randrange(3) if c else 0):
                own[rng.randrange(len(own))] = f"x{rng.randrange(999)}"
            rows.append((0, f"d{i}-{c}", no, " ".join(own), "e"))
            rows.append((1, f"p{i}-{c}", no, "/".join(own[:8]), "e"))
            no += 1
    rows += [(0, None, 9001, "a b c d", None), (0, "null", 9002, None, None), (0, "empty", 9003, "", None), (0, "d0-0", 9004, rows[0][3], None)]
    rows += [(0, f"copy{i}", 9100 + i, "the same words stand here again and again for all", None) for i in range(20)]
    return rows


@pytest.mark.parametrize("plan", [JoinPlan(), JoinPlan(trees=12), JoinPlan(trees=14, node_limit=6, max_level=3)])
def test_against_brute_force(spark, plan):
    kinds = (Kind("text", "word", 3, 0.5, 4), Kind("path", "char", 3, 0.6))
    rows = corpus(3, 90)
    links = similar_records(spark.createDataFrame(rows, DDL), kinds, plan)
    got = {tuple(r) for r in id_pairs(links).collect()}
    want = brute(rows, kinds)
    assert got <= want
    assert len(got) >= 0.99 * len(want)
    per_id = {(r.kind, r.id): r for r in classes(links).collect()}
    for k, i in per_id:
        assert per_id[(k, i)].links == sum((k, i) in ((p[0], p[1]), (p[0], p[2])) for p in got)
    for k, a, b in got:
        assert per_id[(k, a)].class_id == per_id[(k, b)].class_id


def test_hot_group_of_near_copies(spark):
    """A third of the rows are near copies of each other: the last level compares blocks."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(60):
        own = list(base)
        own[rng.randrange(40)] = f"z{i}"
        rows.append((0, f"hot{i:02d}", i, " ".join(own), None))
    rows += [(0, f"cold{i}", 100 + i, " ".join(f"c{i}-{j}" for j in range(40)), None) for i in range(120)]
    links = similar_records(spark.createDataFrame(rows, DDL), (Kind("text", "word", 3, 0.5),), JoinPlan(node_limit=8, max_level=2))
    assert id_pairs(links).count() == 60 * 59 // 2


def test_empty(spark):
    links = similar_records(spark.createDataFrame([], DDL), (Kind("text"),))
    assert id_pairs(links).count() == 0 and classes(links).count() == 0


def test_signature_estimates_similarity():
    a = [f"t{i}" for i in range(3000)]
    b = a[:2000] + [f"u{i}" for i in range(1000)]
    kind = Kind("x", "word", 1, 0.5)
    h, n = shingles(*units([" ".join(a), " ".join(b)], kind, WordHashes()), kind.size)
    sig = signatures(h, n)
    assert abs((sig["tokens"][0] == sig["tokens"][1]).mean() - 0.5) < 0.2
    assert len(np.unique(sig["tokens"])) > 60
    p = sig["planes"]
    agree = 128 - sum(int(np.bitwise_count((p[0, i] ^ p[1, i]) | (p[0, i + 1] ^ p[1, i + 1]))) for i in (0, 2))
    assert abs(agree / 128 - 0.625) < 0.16


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (200, 100), (300, 300)]
    got = {r.node: r["class"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, 200: 100}


@pytest.mark.parametrize("limit", [256, None])
def test_nodes_with_negative_and_positive_paths(limit):
    """Spark sorts paths as signed numbers: every pair of a node is compared on both sides of zero."""
    rng = np.random.default_rng(4)
    paths = np.sort(rng.integers(-(1 << 63), 1 << 63, 300) & ~np.int64(3))
    assert paths[0] < 0 < paths[-1]
    path = np.repeat(paths, rng.integers(1, 9, len(paths)))
    sketch = np.repeat(rng.integers(-(1 << 63), 1 << 63, (len(paths), PLANES)), np.unique(path, return_counts=True)[1], axis=0)
    sketch[rng.random(len(path)) < 0.3] ^= np.int64(-1)  # far from the rest of its node
    rep = np.arange(len(path))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(path), pa.array(rep), *(pa.array(sketch[:, i]) for i in range(PLANES))],
        names=["path", "rep", *(f"s{i}" for i in range(PLANES))],
    )
    got = [(r["a"], r["b"]) for out in compare_nodes((40, 40), limit)(iter([batch])) for r in out.to_pylist()]
    same = lambda a, b: path[a] == path[b] and (sketch[a] == sketch[b]).all()
    want = [(a, b) for a in range(len(path)) for b in range(a + 1, min(a + 9, len(path))) if same(a, b)]
    assert sorted(got) == want


def test_recall_of_a_hot_group_at_the_threshold(spark):
    """Pairs just above the threshold are met as often in nodes that stay large as in others."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(250):
        own = list(base)
        for at in rng.sample(range(60), 4):
            own[at] = f"z{i}-{at}"
        rows.append((0, f"hot{i:03d}", i, " ".join(own), None))
    kind = Kind("text", "word", 3, 0.5)
    sets = [{tuple(w[j : j + 3]) for j in range(58)} for w in (r[3].split() for r in rows)]
    want = {
        (0, rows[a][1], rows[b][1])
        for a in range(250)
        for b in range(a + 1, 250)
        if 0.5 <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.53
    }
    got = {tuple(r) for r in id_pairs(similar_records(spark.createDataFrame(rows, DDL), (kind,), JoinPlan(node_limit=4, block=64))).collect()}
    assert len(want) > 1000
    assert len(want & got) >= 0.97 * len(want)


@pytest.mark.parametrize("threshold", [0.5, 0.6])
def test_sketch_keeps_pairs_at_the_threshold(threshold):
    p = threshold + (1 - threshold) / 2**BITS
    least = Kind("x", "word", 3, threshold).least_matches
    assert sum(comb(POSITIONS, k) * p**k * (1 - p) ** (POSITIONS - k) for k in range(least)) < 2e-4


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8])
@pytest.mark.parametrize("depth", range(1, 9))
def test_trees_follow_the_depth(threshold, depth):
    """At any depth no more than the stated share of pairs at the threshold is missed."""
    plan = JoinPlan()
    assert missed(threshold, plan.trees, plan.base_level, depth, extra_trees(plan, threshold, depth)) <= plan.missed
    assert missed(threshold, plan.trees, 8, depth) > plan.missed or extra_trees(plan, threshold, depth) == 0
