"""Token counters: the built-in word counter, tokenizers read from a file, and a caller's own.

A counter has ``count(text)``, ``offsets(text)`` (code-point pairs) and
``additive``: whether the count of joined pieces is the sum of their counts.
Any object of that kind can be given where a name can; it goes to the workers
by pickling.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache

WORD = re.compile(r"\S+")
WORD_COUNTER = "word-counter"


class WordCounter:
    additive = True

    def count(self, text: str) -> int:
        return len(text.split())

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in WORD.finditer(text)]


class FileTokenizer:
    """A tokenizer.json; special tokens are never added."""

    additive = False

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids) if text else 0

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return list(self.tokenizer.encode(text, add_special_tokens=False).offsets) if text else []


class FunctionCounter:
    """A counter made of two functions. Without ``offsets`` only counts are known,
    which is enough for the strategies page and sentence while no sentence is too long."""

    def __init__(self, count: Callable[[str], int], offsets: Callable[[str], list[tuple[int, int]]] | None = None, additive: bool = False):
        self.count, self._offsets, self.additive = count, offsets, additive

    def offsets(self, text: str) -> list[tuple[int, int]]:
        if self._offsets is None:
            raise ValueError("this counter has no token offsets")
        return self._offsets(text)


def load(source):
    """The counter that ``source`` names (the word counter, a JSON text, a local path), or is."""
    return _named(source) if isinstance(source, str) else source


@lru_cache(8)
def _named(source: str):
    """Cached, so a Python worker builds it once."""
    if source == WORD_COUNTER:
        return WordCounter()
    from tokenizers import Tokenizer

    if source.lstrip().startswith("{"):
        return FileTokenizer(Tokenizer.from_str(source))
    return FileTokenizer(Tokenizer.from_file(source))


#: Environment variable with the folder of local models: <folder>/<model name>/tokenizer.json.
MODEL_FOLDER = "QUIREFOLD_TOKENIZERS"


def resolve(model):
    """What to ship to the executors for a model: resolved once, on the driver.

    A path to a tokenizer.json, or a folder that holds one, is read here; a name is
    also looked for in the folder that MODEL_FOLDER names. Nothing is downloaded; an
    unknown name is an error. A counter object is shipped as it is.
    """
    if not isinstance(model, str):
        if not (callable(getattr(model, "count", None)) and callable(getattr(model, "offsets", None)) and hasattr(model, "additive")):
            raise TypeError("a counter needs count, offsets and additive")
        return model
    if model == WORD_COUNTER or model.lstrip().startswith("{"):
        return model
    places = [model, os.path.join(model, "tokenizer.json")]
    if folder := os.environ.get(MODEL_FOLDER):
        places.append(os.path.join(folder, model, "tokenizer.json"))
    for path in places:
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                return f.read()
    raise FileNotFoundError(f"no tokenizer file for {model!r}; give a path to a tokenizer.json or {WORD_COUNTER!r}")
