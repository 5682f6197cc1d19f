import random
from collections import Counter

import pyarrow as pa
import pytest

from quirefold.llm.sentences import Model, count_events, events, latin_group, quoted, sentences, train

ENGLISH = [
    "Dr. {n} measured the pump at {n}.", "The gate at {n} was closed in {y}.", "See No. {d} for the crane of {n}.",
    "They shipped coal, timber, ropes, etc.", "Was the mill of {n} ever sold?", "It closed at {d} p.m.",
    "{n} wrote: “The seam failed. Nobody saw it.”", "It rose from {d}.5 to {d}.75 units!", "“Was it sold?” asked nobody in {n}... or so {n} said.",
    "Prof. {n} of St. {n} filed it.",
]
CHINESE = ["{y}年，丰石的轨道由南林负责。", "安河的水闸长{d}.5米，需要清理。", "林云说：“大坝坏了。没有人知道。”", "“桥梁加固了吗？”河丰在湾龙问道。", "水泵是否已经检查？", "他记下了合同……随后离开了。"]
THAI = ["คลองใหม่ที่แก้วไผ่ถูกเปลี่ยนโดยบ้านบ้าน", "ในหนองนามีวาล์วเก่า {d} แห่งที่ถูกซ่อม", "หนองนาบันทึกว่าโกดังถูกขายแล้ว"]


def corpus(seed=4, texts=500):
    rng = random.Random(seed)
    syllables = ["ba", "ko", "ri", "tu", "me", "lon", "var", "dis", "pel", "gor"]

    def name():
        return "".join(rng.choice(syllables) for _ in range(3)).capitalize()

    rows, ends = [], {}
    for i in range(texts):
        templates, glue = rng.choice([(ENGLISH, " "), (ENGLISH, " "), (ENGLISH, " "), (CHINESE, ""), (THAI, " ")])
        text, own = "", []
        for b in range(rng.randint(1, 4)):
            text += "\n\n" if b else ""
            if rng.random() < 0.2:
                text += "3. Notes on gates" if glue == " " and templates is ENGLISH else ""
                own += [len(text)] if text and not text.endswith("\n") and templates is ENGLISH else []
                text += "\n\n" if text and not text.endswith("\n") else ""
            for s in range(rng.randint(1, 4)):
                text += glue if s else ""
                piece = rng.choice(templates)
                while "{n}" in piece:
                    piece = piece.replace("{n}", name(), 1)
                piece = piece.replace("{d}", str(rng.randint(1, 99))).replace("{y}", str(rng.randint(1950, 2020)))
                if templates is ENGLISH and rng.random() < 0.3:
                    piece = piece.replace(" ", "\n", 1) if not piece.startswith(("Dr.", "Prof.")) else piece
                text += piece
                own.append(len(text))
        rows.append(("page", i, text, 1))
        ends[i] = own
    return rows, ends


def test_trained_on_the_texts_themselves(spark):
    rows, ends = corpus()
    frame = spark.createDataFrame(rows, "kind string, row_key long, text string, char_end int")
    got = {}
    for r in sentences(frame).collect():
        got.setdefault(r.row_key, []).append(r.char_end)
    right = sum(len(set(got[i]) & set(ends[i])) for i in ends)
    assert right / sum(map(len, got.values())) > 0.99
    assert right / sum(map(len, ends.values())) > 0.99


def test_nulls_blanks_and_repeats(spark):
    rows = [("page", 1, None), ("page", 2, " \n\n "), ("page", 3, "One. Two."), ("page", 3, "One. Two."), ("page", 4, "no mark at all")]
    frame = spark.createDataFrame(rows, "kind string, row_key long, text string")
    got = sorted((r.row_key, r.char_start, r.char_end) for r in sentences(frame).collect())
    assert [x for x in got if x[0] == 4] == [(4, 0, 14)]
    assert {x[0] for x in got} == {3, 4}
    assert sentences(frame.filter("false")).count() == 0


def test_counts_merge():
    texts = [t for _, _, t, _ in corpus(9, 40)[0]]

    def total(parts):
        out = {}
        for part in parts:
            batch = pa.RecordBatch.from_arrays([pa.array(["page"] * len(part)), pa.array(range(len(part))), pa.array(part)], names=["kind", "row_key", "text"])
            for b in count_events([batch]):
                for r in b.to_pylist():
                    k = (r["grp"], r["left"], r["right"], r["shape"])
                    out[k] = out.get(k, 0) + r["n"]
        return out

    assert total([texts]) == total([texts[:13], texts[13:]])


@pytest.mark.parametrize(
    ("text", "inside"),
    [
        ("He said “a. b.” Then", [(8, 14)]),
        ("end of it.” Then “x", [(-1, 10), (17, 20)]),
        ('say "a. b" now', [(4, 9)]),
        ("„a. b.“ und «c. d.»", [(0, 6), (12, 18)]),
        ("「a。『b。』c。」と", [(0, 9)]),
    ],
)
def test_quotations(text, inside):
    assert quoted(text, 0, len(text), True, True) == inside


def test_forward_backward_sums_to_enumeration():
    model = Model({("L", "a."): 0.4, ("L", "b."): 0.7}, {"L": {"LX": 0.5}}, {}, {"L": {"LX": 0.3}})
    run = [("L", "a.", "x.", None, "LX"), ("L", "b.", "x.", None, "LX")]
    scores = [model.odds(*x) for x in run]
    weight = {}
    for e in (0, 1):
        for f in (0, 1):
            first = scores[0][0] * scores[0][1] if e else 1 - scores[0][0]
            theta = scores[1][0] * (model.single if e else 1.0)
            weight[e, f] = first * (theta * scores[1][1] if f else 1 - theta)
    z = sum(weight.values())
    got = model.posteriors(run)
    assert got[0] == pytest.approx((weight[1, 0] + weight[1, 1]) / z)
    assert got[1] == pytest.approx((weight[0, 1] + weight[1, 1]) / z)


def test_model_is_bounded(spark):
    """By shares: no more contexts a group than the inverse of the share, at any number of texts."""
    rows, _ = corpus(5, 120)
    model = train(spark.createDataFrame(rows, "kind string, row_key long, text string, x int"), share=0.1, least=1, right_share=0.05)
    per_group = Counter(k[0] for k in model.theta if k[1][-1] not in "*~" and "|" not in k[1])
    assert per_group and max(per_group.values()) <= 10
    assert len(model.rights) <= 20 + len(model.starters)
    assert events("") == []


@pytest.mark.parametrize(
    ("text", "group"),
    [
        ("Il ponte è chiuso e gli operai della valle che", "Lit"), ("Het schip van de haven is niet een boot", "Lnl"), ("The mill of the town was sold", "Len"),
        ("Die Mühle und der Kran wurde verkauft", "Lde"), ("El molino y los barcos del puerto", "Les"), ("le pont et les bateaux du port", "Lfr"), ("12 kW", "L"),
    ],
)
def test_groups_of_latin_script(text, group):
    assert latin_group(text) == group
