import random
import time

from quirefold.llm.mixing import Target, largest_total, read_targets, route, select_documents, share_report


def test_flow_meets_quotas_with_least_repetition():
    targets = {"a": Target(0.5, 3), "b": Target(0.5, 1)}
    patterns = {("a",): 100, ("b",): 300, ("a", "b"): 50}
    total = largest_total(patterns, targets)
    moved, quota = route(patterns, targets, total)
    assert sum(moved.values()) == sum(quota.values())
    assert moved[("b",), "b"] <= 300
    assert total in (700, 701)  # b can have at most 350, a up to 450
    assert largest_total({("a",): 100}, {"a": Target(1.0, 3)}) == 300


def old_total(patterns, targets):
    """The largest total by bisection over subsets of sources (Hall's condition)."""
    names = sorted(targets)
    weight = sum(t.share for t in targets.values())
    best = float("inf")
    for bits in range(1, 1 << len(names)):
        need = {s for i, s in enumerate(names) if bits >> i & 1}
        supply = sum(n * min(max(targets[s].repeats for s in p), sum(targets[s].repeats for s in p if s in need)) for p, n in patterns.items())
        best = min(best, supply * weight / sum(targets[s].share for s in need))
    return best


def test_the_largest_total_is_that_of_the_tightest_sources():
    rng = random.Random(6)
    for _ in range(200):
        names = "abcde"[: rng.randint(1, 5)]
        targets = {s: Target(rng.uniform(0.05, 1), rng.randint(1, 4)) for s in names}
        patterns = {}
        for _ in range(rng.randint(1, 9)):
            patterns[tuple(sorted(rng.sample(names, rng.randint(1, len(names)))))] = rng.randint(1, 1000)
        total = largest_total(patterns, targets)
        assert abs(total - old_total(patterns, targets)) <= 1
        moved, quota = route(patterns, targets, total)
        assert sum(moved.values()) == sum(quota.values()) or total == 0
        for s in names:
            assert sum(n for (p, x), n in moved.items() if x == s) == quota[s]


def test_the_flow_repeats_as_little_as_possible():
    targets = {"a": Target(0.5, 5), "b": Target(0.5, 1)}
    moved, quota = route({("a",): 100, ("a", "b"): 200, ("b",): 100}, targets, 400)
    assert moved == {(("a",), "a"): 100, (("a", "b"), "a"): 100, (("a", "b"), "b"): 100, (("b",), "b"): 100}


def test_many_patterns():
    """The driver's part keeps up with a thousand patterns of thirty sources."""
    rng = random.Random(1)
    names = [f"s{i}" for i in range(30)]
    targets = {s: Target(rng.uniform(0.1, 1), rng.randint(1, 6)) for s in names}
    patterns = {}
    while len(patterns) < 3000:
        patterns[tuple(sorted(rng.sample(names, rng.randint(1, 6))))] = rng.randint(1, 10**6)
    for s in names:
        patterns[(s,)] = rng.randint(1, 10**6)
    began = time.perf_counter()
    total = largest_total(patterns, targets)
    moved, quota = route(patterns, targets, total)
    assert sum(moved.values()) == sum(quota.values()) and time.perf_counter() - began < 60


def test_rare_patterns_stand_for_one_source(spark):
    """Beyond the most patterns the driver takes, no document is lost and caps hold."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        for s in rng.sample("abcd", rng.randint(1, 3)):
            rows.append((len(rows), s, i, 10 + i % 7))
    documents = spark.createDataFrame(rows, "doc_id long, source string, text_key long, n_tokens long").cache()
    targets = {"m": {s: Target(0.25, 2) for s in "abcd"}}
    chosen = select_documents(documents, targets, most_patterns=4)
    report = {r.source: r for r in share_report(chosen, targets).collect()}
    assert all(abs(r.share - 0.25) < 0.01 and r.most_uses <= 2 for r in report.values())
    assert sum(r.tokens for r in report.values()) > 0.9 * 2 * sum({r[2]: r[3] for r in rows}.values())


def test_selection(spark):
    rng = random.Random(2)
    rows = []
    for i in range(4000):
        s = rng.choice(["big"] * 6 + ["mid"] * 3 + ["tiny"])
        rows.append((i, s, i, rng.randint(1, 60), "x"))
    rows += [(5000 + i, "mid", i, rows[i][3], "x") for i in range(50)]  # texts of big stand in mid, too
    rows += [(9000, None, 9000, 10, "x"), (9001, "big", 9001, 0, "x")]
    documents = spark.createDataFrame(rows, "doc_id long, source string, text_key long, n_tokens long, uses string").cache()
    table = spark.createDataFrame(
        [("m", "big", 0.4, 1), ("m", "mid", 0.3, 2), ("m", "tiny", 0.2, 4), ("m", "none", 0.1, 4)],
        "mix_name string, source string, target_share double, max_repeats long",
    )
    targets = read_targets(table)
    chosen = select_documents(documents, targets).cache()
    report = {r.source: r for r in share_report(chosen, targets).collect()}
    assert report["none"].tokens == 0
    for s, share in (("big", 0.4), ("mid", 0.3), ("tiny", 0.2)):
        assert abs(report[s].share - share / 0.9) < 0.005
        assert report[s].most_uses <= report[s].max_repeats
    by_text = {}
    key = {r[0]: r[2] for r in rows}
    for r in chosen.collect():
        by_text[key[r.doc_id]] = by_text.get(key[r.doc_id], 0) + r.uses
    assert max(by_text.values()) <= 4
    again = {tuple(r) for r in select_documents(documents.repartition(7), targets).collect()}
    assert again == {tuple(r) for r in chosen.collect()}
    assert select_documents(documents.filter("false"), targets).count() == 0


def test_the_bound_of_patterns_changes_no_result(spark):
    """However few patterns are broadcast, the largest total and the selection are those of all patterns."""
    rng = random.Random(5)
    rows = []
    for i in range(2000):
        for s in rng.sample("abcd", rng.choice((1, 1, 2, 3))):
            rows.append((len(rows), s, i, 10 + i % 7))
    documents = spark.createDataFrame(rows, "doc_id long, source string, text_key long, n_tokens long").cache()
    targets = {"m": {"a": Target(0.7, 1), "b": Target(0.1, 2), "c": Target(0.1, 1), "d": Target(0.1, 3)}}
    chosen = {tuple(r) for r in select_documents(documents, targets).collect()}
    assert chosen == {tuple(r) for r in select_documents(documents, targets, most_patterns=4).collect()}
    # "a" can have every text that it holds, and sets the total
    held = sum(r[3] for r in rows if r[1] == "a")
    assert abs(sum(r[3] * r[4] for r in chosen if r[1] == "a") - held) <= 100
