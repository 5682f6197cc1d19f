import shutil
from pathlib import Path

import pytest

from quirefold.llm.tokens import TOKENIZER, counter, with_sizes

FOLDER = Path(TOKENIZER).parent
pytestmark = pytest.mark.skipif(not FOLDER.is_dir(), reason="no public tokenizers")
TEXTS = ["Die größere Mühle wurde 1912 geprüft.", "白龙的桥梁", "a", "", None, "x " * 5000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_sizes_of_every_vocabulary(spark, tmp_path, name):
    """The workers need no file: it is gone before they count."""
    path = str(shutil.copy(FOLDER / name, tmp_path / name))
    size = counter(path)
    rows = spark.createDataFrame([(i, t, "e") for i, t in enumerate(TEXTS)], "id int, text string, n string")
    frame = with_sizes(rows, path=path)
    Path(path).unlink()
    got = {r.id: r.n_tokens for r in frame.collect()}
    assert got == {i: size(t) if t else 0 for i, t in enumerate(TEXTS)} and got[0] > 5 and got[5] >= 5000
    assert frame.columns == ["id", "n", "n_tokens"]


def test_two_forms_of_one_vocabulary_agree():
    a, b = (counter(str(FOLDER / n)) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    assert [a(t) for t in TEXTS if t] == [b(t) for t in TEXTS if t]
