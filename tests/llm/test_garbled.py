import random

import pytest

from quirefold.llm.garbled import Pairs, broken, least_documents, repair, segments, ungarbled

CLEAN = {
    "de": "Die größere Mühle wurde geprüft und später für schöne Gäste geöffnet.",
    "fr": "La chaudière inondée fut réparée à côté de l'écluse, près du théâtre.",
    "ru": "Городская турбина была осмотрена, а соседняя ведомость осталась прежней.",
    "zh": "白龙的桥梁是否检查，大型大坝又在哪里？江泉南终于把水闸移动完毕！",
    "en": "It wasn’t closed… the “northern” jetty – long muddy – stayed at 12° for £3.",
}
WAYS = [
    ("de", "utf_8", "cp1252"), ("fr", "utf_8", "latin_1"), ("fr", "cp1252", "cp437"), ("ru", "cp1251", "koi8_r"),
    ("ru", "utf_8", "cp1251"), ("zh", "gbk", "latin_1"), ("en", "utf_8", "mac_roman"), ("de", "cp1252", "cp437"), ("fr", "mac_roman", "latin_1"), ("de", "cp850", "latin_1"),
]


def corpus():
    rng = random.Random(7)
    rows = []
    for i in range(400):
        lang = rng.choice(list(CLEAN))
        rows.append((i, " ".join([CLEAN[lang]] * rng.randint(1, 3))))
    return rows


def garble(text, right, wrong):
    return text.encode(right, "ignore").decode(wrong, "ignore")


def test_round_trip(spark):
    rows = corpus()
    want = {}
    for n, (lang, right, wrong) in enumerate(WAYS):
        clean = CLEAN[lang]
        if garble(clean, right, wrong).encode(wrong, "ignore") != clean.encode(right):
            continue
        want[1000 + n] = clean
        rows.append((1000 + n, garble(clean, right, wrong)))
    rows.append((2000, garble(garble(CLEAN["fr"], "utf_8", "latin_1"), "utf_8", "latin_1")))
    want[2000] = CLEAN["fr"]
    rows += [(3000, None), (3001, ""), (3002, "plain"), (3003, "lost � here"), (1000, rows[400][1])]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "row_id long, text string, runs string")
    got = ungarbled(frame).collect()
    assert len(got) == len(rows)
    assert {r.row_id for r in got if r.garbled} == set(want) | {3003}
    assert {r.row_id: r.text for r in got if r.row_id in want} == want
    assert ungarbled(frame.filter("false")).count() == 0


def test_segments_are_maximal():
    rng = random.Random(3)
    for _ in range(200):
        x = [rng.uniform(-1, 0.8) for _ in range(rng.randint(0, 12))]
        found = segments(x)
        best = max([0.0] + [sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)])
        assert max([0.0] + [sum(x[i:j]) for i, j in found]) == pytest.approx(best)


def test_the_model_is_bounded_by_shares():
    """However many documents there are, a pair without an entry counts for the same share."""
    small, large, huge = (Pairs({}, n) for n in (10**5, 10**8, 10**10))
    assert least_documents(1000) == least_documents(10**5) == 2 and least_documents(10**8) == 2000
    assert small.unseen == pytest.approx(large.unseen) == pytest.approx(huge.unseen)


def test_broken_characters_are_improbable_runs():
    model = Pairs({"é": 50, "é ": 40, "fé": 30}, 100)
    assert broken("\ufffd", model) and broken("a \ufffd b", model) and broken("x\x81y", model)
    assert not broken("café", model)


def test_rare_but_right_characters_stay():
    counts, n = {"°": 3, "2°": 3, "° ": 3, "é": 50, "é ": 40, "fé": 30}, 100
    text = "at 2° the café"
    assert repair(text, Pairs(counts, n))[:2] == (text, 0)
