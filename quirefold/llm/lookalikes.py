"""Visually identical text with different characters, brought to one form.

Method: every word gets the intersection of the resolved script sets of its
letters (Han, kana and Hangul count for the writing systems that mix them). An
empty intersection of alphabets is a mixed-script word: it is respelled in the
main alphabet of its block if all its letters have look-alikes there, else in the
script to which most of its letters belong. A word wholly in one alphabet, all of
whose letters have look-alikes in the main alphabet, is a whole-script confusable
and is respelled too (form ``whole_script``, which TESTDATA does not count as a case).
Then compatibility forms of letters, digits, kana and ideographs, base letters
with combining marks, invisible characters and unusual blanks are normalised.

Punctuation is left alone, and so are Thai sara am, super- and subscripts and
joiners after a virama, which ordinary spelling needs.

Defined results: null stays null, empty stays empty; every row gives one row.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters that look alike, by their Latin letter: Cyrillic and Greek,
#: then Armenian, Cherokee, Coptic and Hebrew.
LOOK = """
a аα  c сϲⲥ  d ԁ  e е  g ց  h һհ  i іιᎥ  j јϳյ  k кκ  l ӏן  n ո  o оοօⲟס  p рρⲣ  q ԛզ  s ѕ  u υս  v ѵν  w ԝ  x хχⲭ  y уγ
A АΑᎪⲀ  B ВΒᏴⲂ  C СϹᏟⲤ  D Ꭰ  E ЕΕᎬⲈ  G ԌᏀ  H НΗᎻⲎ  I ІΙⲒ  J ЈͿᎫ  K КΚᏦⲔ  L ԼᏞ  M МΜᎷⲘ  N ΝⲚ  O ОΟՕⲞ  P РΡᏢⲢ  R Ꭱ
S ЅՏᏚ  T ТΤᎢⲦ  U Ս  V ѴᏙ  W ԜᎳ  X ХΧⲬ  Y УΥⲨ  Z ΖᏃ
"""
#: The letters of the alphabets that words are checked in.
LETTERS = {
    "LATIN": "A-Za-zªºÀ-ÖØ-öø-ʯḀ-ỿ", "GREEK": "Ͱ-ͳͶ-ϡϰ-Ͽἀ-῿", "CYRILLIC": "Ѐ-ҁҊ-ԯ", "ARMENIAN": "Ա-Ֆա-և", "HEBREW": "א-ת",
    "CHEROKEE": "Ꭰ-Ᏽᏸ-ᏽꭰ-ꮿ", "COPTIC": "Ⲁ-ⳤϢ-ϯ", "GEORGIAN": "ა-ჺჽ-ჿ",
}
ALPHABETS = tuple(LETTERS)
#: Writing systems whose scripts belong together.
SYSTEMS = {
    "CJK": {"Jpan", "Hanb", "Kore"}, "KANGXI": {"Jpan", "Hanb", "Kore"}, "HIRAGANA": {"Jpan"}, "KATAKANA": {"Jpan"},
    "KATAKANA-HIRAGANA": {"Jpan"}, "HALFWIDTH": {"Jpan"}, "HANGUL": {"Kore"}, "BOPOMOFO": {"Hanb"},
}
KEPT = {0x0E33, 0x0EB3, 0x00B5, 0x0587}
#: Decomposition tags of forms that stand for the ordinary character.
TAGS = ("<wide>", "<narrow>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")


@lru_cache(100_000)
def script_set(ch: str) -> frozenset[str] | None:
    """The resolved scripts of a letter; None stands for all."""
    if not ch.isalpha():
        return None
    name = unicodedata.name(ch, "").split(" ")[0]
    if name in ("MODIFIER", "MASCULINE", "FEMININE", "MICRO", ""):
        return None
    return frozenset(SYSTEMS.get(name, {name}))


def resolved(word: str) -> frozenset[str] | None:
    """The intersection over a word; empty for a mixed word, None if any script will do."""
    out: frozenset[str] | None = None
    for ch in word:
        own = script_set(ch)
        if own is not None:
            out = own if out is None else out & own
    return out


def _look() -> dict[str, dict[str, str]]:
    """For each alphabet, other letters with the letter that looks like them there."""
    out: dict[str, dict[str, str]] = {a: {} for a in ALPHABETS}
    for latin, others in re.findall(r"(\S) (\S+)", LOOK):
        alike = latin + others
        for target in alike:
            for alphabet in script_set(target) or ():
                if alphabet in out:
                    for ch in alike:
                        if ch != target and alphabet not in (script_set(ch) or ()):
                            out[alphabet].setdefault(ch, target)
    return out


_ALIKE = _look()


def _is_form(o: int) -> bool:
    """Whether a code point is a letter, digit, kana or ideograph in compatibility form."""
    ch = chr(o)
    if o in KEPT:
        return False
    shape = unicodedata.decomposition(ch)
    kind = unicodedata.category(ch)
    radical = 0x2E80 <= o < 0x2FE0
    if not shape or not (kind[0] == "L" or kind == "Nd" or radical):
        return False
    if shape[0] == "<":
        return shape.split(" ")[0] in TAGS and unicodedata.normalize("NFKC", ch) != ch
    return " " not in shape and 0xF900 <= o  # compatibility ideographs


def _is_blank(o: int) -> bool:
    return unicodedata.category(chr(o)) in ("Zs", "Zl", "Zp") and o != 0x20 or o in (0x0B, 0x0C, 0x85, 0x1C, 0x1D, 0x1E, 0x1F)


def _is_invisible(o: int) -> bool:
    return unicodedata.category(chr(o)) == "Cf" and not 0x600 <= o < 0x610 and o not in (0x6DD, 0x70F, 0x8E2) or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0) or 0xFE00 <= o < 0xFE10


#: Where such characters are; the letters and ideographs between need no test.
_BLOCKS = ((0x80, 0x3400), (0xA600, 0xAC00), (0xF900, 0x10000), (0x1D400, 0x1D800), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))


def _ranges(test) -> str:
    """A character class of the code points that pass a test."""
    out = []
    for low, high in _BLOCKS:
        start = None
        for o in range(low, high + 1):
            inside = o < high and test(o)
            if inside and start is None:
                start = o
            elif not inside and start is not None:
                out.append(f"\\U{start:08x}-\\U{o - 1:08x}")
                start = None
    return "".join(out)


FORM = re.compile(f"[{_ranges(_is_form)}]")
BLANK = re.compile(f"[\x0b\x0c\x1c-\x1f{_ranges(_is_blank)}]")
INVISIBLE = re.compile(rf"(?<![\u094d\u09cd\u0a4d\u0acd\u0b4d\u0bcd\u0c4d\u0ccd\u0dca])[{_ranges(_is_invisible)}]|[{_ranges(lambda o: _is_invisible(o) and o not in (0x200C, 0x200D))}]")
#: A base with marks that may have a precomposed form; Thai and most Indic marks have none.
MARKED = re.compile("[^\x00-\x1f][\u0300-\u036f\u0483-\u0487\u0653-\u093c\u0655\u3099\u309aﾞﾟ]+")
MARK = re.compile("[\u0300-\u036f\u0483-\u0487\u0653-\u093c\u0655\u3099\u309a]")
ALPHA_WORD = re.compile("(?:[" + "".join(LETTERS.values()) + "][\u0300-\u036f]*)+")
ANY_ALPHABET = {a: re.compile(f"[{x}]") for a, x in LETTERS.items()}
COMMON = ALPHABETS[:3]
RARE = re.compile("[" + "".join(LETTERS[a] for a in ALPHABETS[3:]) + "]")
BLOCK_GAP = re.compile(r"(\n[^\S\n]*\n)")
FLAGS = ("compatibility", "decomposed", "invisible", "blank", "mixed", "whole_script")
MIXED, WHOLE = 16, 32


def respell(word: str, target: str) -> str | None:
    """The word with every letter in the target alphabet, if look-alikes allow it."""
    out = []
    for ch in unicodedata.normalize("NFD", word):
        own = script_set(ch)
        if own is None or target in own:
            out.append(ch)
        elif ch in _ALIKE[target]:
            out.append(_ALIKE[target][ch])
        else:
            return None
    return unicodedata.normalize("NFC", "".join(out))


@lru_cache(200_000)
def one_script(word: str, main: str, certain: frozenset[str] = frozenset()) -> tuple[str, int]:
    """The consistent spelling of a word of alphabetic letters in a text mainly in ``main``, and what it was."""
    scripts = resolved(word)
    if scripts is None:
        return word, 0
    if scripts:
        if main in scripts or scripts & certain:
            return word, 0
        new = respell(word, main)
        return (word, 0) if new is None else (new, WHOLE)
    count = Counter(next(iter(s)) for ch in unicodedata.normalize("NFD", word) if (s := script_set(ch)))
    for target, _ in sorted(count.items(), key=lambda x: (x[0] != main, -x[1], x[0])):
        if target in _ALIKE and (new := respell(word, target)) is not None:
            return new, MIXED
    return word, MIXED


def alphabets_in(text: str) -> list[str]:
    found = [a for a in COMMON if ANY_ALPHABET[a].search(text)]
    if RARE.search(text):
        found += [a for a in ALPHABETS[3:] if ANY_ALPHABET[a].search(text)]
    return found


def respell_block(block: str) -> tuple[str, int]:
    """A block with every word of alphabetic letters in one script, and what its words were.

    The block's main alphabet is the one most of its letters have. A word of
    another alphabet is taken for a disguised word of the main one only if the
    block has no word that must be of that other alphabet.
    """
    present = alphabets_in(block)
    if len(present) < 2:
        return block, 0
    count = {a: len(ANY_ALPHABET[a].findall(block)) for a in present}
    main = max(present, key=lambda a: (count[a], a == "LATIN"))
    words = set(ALPHA_WORD.findall(block))
    certain = set()
    for word in words:
        scripts = resolved(word)
        if scripts and main not in scripts and respell(word, main) is None:
            certain |= scripts
    changed, flags = {}, 0
    for word in words:
        new, was = one_script(word, main, frozenset(certain))
        flags |= was
        if new != word:
            changed[word] = new
    if changed:
        block = ALPHA_WORD.sub(lambda m: changed.get(m.group(), m.group()), block)
    return block, flags


def _composes(text: str) -> bool:
    """Whether some base and its marks have a usual precomposed form."""
    for m in MARKED.finditer(text):
        x = m.group()
        if any("ﾞ" <= c <= "ﾟ" for c in x):
            continue
        y = unicodedata.normalize("NFC", x)
        if len(y) < len(x):
            return True
    return False


def normalise(text: str) -> tuple[str, int]:
    """(text in one form, bits of FLAGS that it needed)."""
    if text.isascii() and not BLANK.search(text):
        return text, 0
    flags = 0
    if INVISIBLE.search(text):
        flags |= 4
        text = INVISIBLE.sub("", text)
    if BLANK.search(text):
        flags |= 8
        text = BLANK.sub(" ", text)
    if FORM.search(text):
        flags |= 1
        # a halfwidth kana takes its sound mark along
        text = FORMS.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    if MARK.search(text) and _composes(text):
        flags |= 2
        text = MARKED.sub(lambda m: unicodedata.normalize("NFC", m.group()), text)
    if len(alphabets_in(text)) > 1:
        out = []
        for i, part in enumerate(BLOCK_GAP.split(text)):
            if i % 2 == 0:
                part, was = respell_block(part)
                flags |= was
            out.append(part)
        text = "".join(out)
    return text, flags


FORMS = re.compile(FORM.pattern + "+")
OUT_DDL = "kind string, line_no long, toc_pos long, text string, forms array<string>"


def normalise_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, forms = [], []
        for text in batch.column(3).to_pylist():
            flags = 0
            if text:
                text, flags = normalise(text)
            texts.append(text)
            forms.append([name for i, name in enumerate(FLAGS) if flags >> i & 1])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array(texts, pa.string()), pa.array(forms, pa.list_(pa.string()))],
            names=["kind", "line_no", "toc_pos", "text", "forms"],
        )


def page_and_toc_texts(pages: DataFrame, documents: DataFrame) -> DataFrame:
    page = pages.select(F.lit("page").alias("kind"), F.col("line_no").cast("long"), F.lit(-1).cast("long").alias("toc_pos"), "text")
    toc = documents.select(F.col("line_no").cast("long"), F.posexplode("toc").alias("toc_pos", "entry")).select(
        F.lit("toc").alias("kind"), "line_no", F.col("toc_pos").cast("long"), F.col("entry.text").alias("text")
    )
    return page.unionByName(toc)


def one_form(rows: DataFrame) -> DataFrame:
    """Rows (kind, line_no, toc_pos, text): text in one form, and the forms it held."""
    return rows.select("kind", "line_no", "toc_pos", "text").mapInArrow(normalise_batches, OUT_DDL)
