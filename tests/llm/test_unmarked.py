import random
from itertools import product

import pytest

from quirefold.llm.unmarked import B, SEP, Words, sentences_between_words, stream, words

NAMES = ["Mira", "Jonas", "Tove", "Pavel"]
THINGS = ["gate", "mill", "crane", "barge", "lock"]
ENGLISH = [
    "{n} closed the {t} at noon", "the {t} of {n} was sold", "they saw a {t} near the old {t}", "nobody asked {n} about it",
    "in spring {n} repaired the {t}", "we moved it to the {t}",
]
CHINESE = ["林云关闭了旧水闸", "桥梁已经加固完毕", "他们在河边检查水泵", "南湾的大坝需要清理"]


def texts(seed, n, marked):
    """Texts of a made-up grammar, in blocks with end marks or in one without, and where their sentences end."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        dense = rng.random() < 0.3
        text, ends = "", []
        for k in range(rng.randint(2, 6)):
            piece = rng.choice(CHINESE if dense else ENGLISH)
            while "{" in piece:
                piece = piece.replace("{n}", rng.choice(NAMES), 1).replace("{t}", rng.choice(THINGS), 1)
            if marked:
                piece = piece[0].upper() + piece[1:] + ("。" if dense else ".")
            gap = "\n\n" if marked and rng.random() < 0.3 else "" if dense else " "
            text += (gap if k else "") + piece
            ends.append(len(text))
        out.append((text, ends))
    return out


def test_unmarked_text_is_cut_between_words(spark):
    """Trained on marked texts, held against others without marks, in two scripts."""
    train = [("page", i, t, 0) for i, (t, _) in enumerate(texts(1, 600, True))]
    held = texts(2, 150, False)
    rows = train + [("chunk", i, t, 0) for i, (t, _) in enumerate(held)]
    rows += [("chunk", 900, None, 0), ("chunk", 901, " \n\n ", 0), ("chunk", 902, "gate", 0), ("chunk", 903, "- !? -", 0), ("chunk", 902, "gate", 0)]
    frame = spark.createDataFrame(rows, "kind string, row_key long, text string, char_end int")
    got = {}
    for r in sentences_between_words(frame).collect():
        got.setdefault((r.kind, r.row_key), []).append(r.char_end)
    found = sum(len(got["chunk", i]) for i in range(len(held)))
    true = sum(len(e) for _, e in held)
    right = sum(len(set(got["chunk", i]) & set(e)) for i, (_, e) in enumerate(held))
    assert right / found > 0.95 and right / true > 0.95
    assert got["chunk", 902] == [4, 4] and ("chunk", 900) not in got and ("chunk", 901) not in got
    assert [got["page", i] for i in range(50)] == [e for _, e in texts(1, 600, True)[:50]]
    assert sentences_between_words(frame.filter("false")).count() == 0


def test_posteriors_equal_enumeration():
    rng = random.Random(3)
    keys = ["a", "b", "c", "a", "b"]
    count = {"": 100}
    for x in ["a", "b", "c", B]:
        count[x] = rng.randint(5, 30)
        for y in ["a", "b", "c", B]:
            count[x + SEP + y] = rng.randint(0, 9)
            for z in ["a", "b", "c", B]:
                count[x + SEP + y + SEP + z] = rng.randint(0, 4)
    model = Words(count)
    weight = {}
    for events in product((0, 1), repeat=len(keys) - 1):
        seq = [B, keys[0]]
        for e, k in zip(events, keys[1:]):
            seq += [B, k] if e else [k]
        seq.append(B)
        p = 1.0
        for i in range(2, len(seq)):
            p *= model.p(seq[i - 2], seq[i - 1], seq[i])
        weight[events] = p
    total = sum(weight.values())
    for i, got in enumerate(model.posteriors(keys)):
        assert got == pytest.approx(sum(w for e, w in weight.items() if e[i]) / total)


def test_words_and_stream():
    assert words("Die Mühle, 12 - alt.")[0] == ["die", "mühle", "0", "alt"]
    assert words("水闸。น้ำ")[0] == ["水", "闸", "น้", "\u0e4d\u0e32"]  # sara am in its compatibility parts
    assert words("नदी, पानी।")[0] == ["नदी", "पानी"]
    assert stream("a b. c", [4]) == [B, "a", "b", B, "c", B]
