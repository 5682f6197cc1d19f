import pytest

from quirefold.llm.lookalikes import FLAGS, normalise, one_form, resolved, respell


def flags(text):
    bits = normalise(text)[1]
    return {name for i, name in enumerate(FLAGS) if bits >> i & 1}


@pytest.mark.parametrize(
    ("text", "form", "why"),
    [
        ("ｖａｌｖｅ １２", "valve 12", {"compatibility"}),
        ("ﾀﾞム ﾎﾟﾝプ", "ダム ポンプ", {"compatibility"}),
        ("⽔⽊ ﬁlter", "水木 filter", {"compatibility"}),
        ("café が", "café が", {"decomposed"}),
        ("ga­te​﻿", "gate", {"invisible"}),
        ("a b　c", "a b c", {"blank"}),
        ("Entrе la gruе", "Entre la grue", {"mixed"}),
        ("Νeither of them", "Neither of them", {"mixed"}),
        ("е́té gruе", "été grue", {"mixed"}),
        ("руб. зa метр", "руб. за метр", {"mixed"}),
        # whole words in another script: respelled by context, never a case
        ("the асе of spades", "the ace of spades", {"whole_script"}),
        ("Между a Оржу", "Между а Оржу", {"whole_script"}),
        # a mixed word takes the block's main alphabet, whatever most of its own letters are
        ("Please log in to раураl now, as the bank asks.", "Please log in to paypal now, as the bank asks.", {"mixed"}),
        ("Завод Мicrosoft стоит у воды", "Завод Microsoft стоит у воды", {"mixed"}),
        # other alphabets
        ("the alոe tree and ցate", "the alne tree and gate", {"mixed"}),
        ("Ꭺll ⲟf it", "All of it", {"mixed"}),
        ("Երևան և Moscow", "Երևան և Moscow", set()),
        ("the word сажень stays, and в too", "the word сажень stays, and в too", set()),
        # not cases
        ("“quoted”，（full-width）…！", "“quoted”，（full-width）…！", set()),
        ("ทำงานน้ำ की क्‍ष x²", "ทำงานน้ำ की क्‍ष x²", set()),
        ("编号No.212 小さなダム\tx", "编号No.212 小さなダム\tx", set()),
        ("", "", set()),
    ],
)
def test_forms(text, form, why):
    assert (normalise(text)[0], flags(text)) == (form, why)
    assert normalise(form) == (form, 0)


def test_script_sets():
    assert resolved("水ダム") == {"Jpan"}
    assert resolved("pаge") == frozenset()
    assert resolved("12.") is None
    assert respell("сосна", "LATIN") is None


def test_frame(spark):
    rows = [("page", 1, -1, "gruе"), ("page", 1, -1, "gruе"), ("toc", 2, 0, None), ("toc", 2, 1, "")]
    got = one_form(spark.createDataFrame([(*r, 7) for r in rows], "kind string, line_no long, toc_pos long, text string, forms int")).collect()
    assert sorted((r.line_no, r.toc_pos, r.text, len(r.forms)) for r in got if r.text) == [(1, -1, "grue", 1)] * 2
    assert len(got) == 4
