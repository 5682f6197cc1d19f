"""Column functions on text: white space as Python sees it, words, paragraphs, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.constants import NON_WS, WS


def is_blank(text: Column) -> Column:
    """True for text without a character beyond white space; null for null."""
    return ~text.rlike(NON_WS)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def word_count(text: Column) -> Column:
    """Tokens by the built-in counter: maximal runs of non-white space."""
    return F.regexp_count(text, F.lit(f"{NON_WS}+")).cast("long")


def runs(text: Column, piece: str, between: str) -> Column:
    """All alternating runs of two kinds; their lengths add up to offsets."""
    return F.regexp_extract_all(text, F.lit(f"({piece}|{between})"), F.lit(0))


def word_runs(text: Column) -> Column:
    return runs(text, f"{NON_WS}+", f"{WS}+")


def paragraph_runs(text: Column) -> Column:
    """Paragraphs and the breaks (two or more line feeds) between them."""
    return runs(text, "\n{2,}", "(?:(?!\n\n)[\\s\\S])+")


def sentence_pieces(text: Column) -> Column:
    """Sentences by end marks: a break stands at white space after . ! or ?"""
    cut = F.regexp_replace(strip(text), f"([.!?]){WS}+", "$1\u0001")
    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(F.split(cut, "\u0001"))
