"""Units of text as relations: the joined text of pages, and ranges of it.

These are the building blocks for work on offsets in SQL; a run does the same
inside its kernels. A unit is a page, or with ``cross_page`` a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.constants import PAGE_JOINER
from quirefold.operators.numbering import running_before

#: Characters of a unit's text that share a block, by which ranges meet pages.
BLOCK = 1 << 16


def unit_segments(pages: DataFrame, cross_page: bool = False) -> DataFrame:
    """(doc_key, unit, page_index, page_label, g_start, g_end): where each page lies in its unit's text.

    Page numbers must be unique in a document. A null text counts as empty.
    """
    rows = pages.select("doc_key", "page_index", "page_label", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
    if not cross_page:
        return rows.select("doc_key", F.col("page_index").alias("unit"), "page_index", "page_label", F.lit(0).cast("long").alias("g_start"), F.col("size").alias("g_end"))
    rows = rows.withColumn("step", F.col("size") + len(PAGE_JOINER))
    placed = running_before(rows, ["doc_key"], "page_index", "step", "g_start")
    return placed.select("doc_key", F.lit(0).cast("long").alias("unit"), "page_index", "page_label", F.col("g_start").cast("long"), (F.col("g_start") + F.col("size")).cast("long").alias("g_end"))


def unit_texts(pages: DataFrame, cross_page: bool = False) -> DataFrame:
    """(doc_key, unit, text): page texts in page order with a blank line between."""
    if not cross_page:
        return pages.select("doc_key", F.col("page_index").alias("unit"), "text")
    ordered = F.array_sort(F.collect_list(F.struct("page_index", "seq", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("doc_key").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), PAGE_JOINER).alias("text")).select("doc_key", F.lit(0).cast("long").alias("unit"), "text")


def token_windows(counts: DataFrame, max_tokens: int, overlap: int) -> DataFrame:
    """Rows with a column n_tokens -> one row a window: window_no, first_token, last_token.

    Windows advance by max_tokens - overlap; the first to reach the last token is the last.
    """
    if not 0 <= overlap < max_tokens:
        raise ValueError("overlap must be below max_tokens")
    step = max_tokens - overlap
    last = F.ceil(F.greatest(F.col("n_tokens") - max_tokens, F.lit(0)) / step).cast("long")
    return (
        counts.filter("n_tokens > 0")
        .withColumn("window_no", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("first_token", F.col("window_no") * step)
        .withColumn("last_token", F.least(F.col("first_token") + max_tokens, F.col("n_tokens")) - 1)
    )


def spans_of_ranges(ranges: DataFrame, segments: DataFrame) -> DataFrame:
    """Ranges (doc_key, unit, range_no, s, e) -> the parts of pages they cover, one row each.

    Both sides are put into blocks of BLOCK characters and joined by (unit, block),
    so in a large unit a range meets the pages near it only. A pair that shares
    several blocks counts in the first.
    """
    block = lambda x: F.floor(x / BLOCK).cast("long")
    spread = lambda rows, a, b: rows.withColumn("block", F.explode(F.sequence(block(F.col(a)), block(F.greatest(F.col(b) - 1, F.col(a))))))
    parts = (
        spread(ranges, "s", "e").join(spread(segments, "g_start", "g_end"), ["doc_key", "unit", "block"])
        .filter((F.col("g_start") < F.col("e")) & (F.col("s") < F.col("g_end")))
        .filter(F.col("block") == F.greatest(block(F.col("s")), block(F.col("g_start"))))
        .withColumn("char_start", F.greatest("s", "g_start") - F.col("g_start"))
        .withColumn("char_end", F.least("e", "g_end") - F.col("g_start"))
    )
    return parts.select("doc_key", "unit", "range_no", "page_index", "page_label", "char_start", "char_end")


def collected_spans(parts: DataFrame) -> DataFrame:
    """One row a range again: spans in page order."""
    span = F.struct("page_index", "page_label", "char_start", "char_end")
    return parts.groupBy("doc_key", "unit", "range_no").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def span_texts(chunks: DataFrame, pages: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, text) rebuilt from spans and page texts; a blank line stands where the page changes.

    Joined on (doc_key, page_index). Spans without their page make the text null.
    """
    spans = chunks.select(key, "doc_key", F.posexplode("spans").alias("pos", "x")).select(key, "doc_key", "pos", "x.page_index", "x.char_start", "x.char_end")
    texts = pages.select("doc_key", "page_index", F.col("text").alias("page_text"))
    cut = F.substring("page_text", F.col("char_start").cast("int") + 1, (F.col("char_end") - F.col("char_start")).cast("int"))
    parts = spans.join(texts, ["doc_key", "page_index"], "left").withColumn("part", cut)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "page_index", "part")))
    empty = F.struct(F.lit(None).cast("bigint").alias("page"), F.lit("").alias("text"))

    def step(state, x):
        joiner = F.when(state["page"].isNull() | (state["page"] == x["page_index"]), "").otherwise(PAGE_JOINER)
        return F.struct(x["page_index"].alias("page"), F.concat(state["text"], joiner, x["part"]).alias("text"))

    return parts.groupBy(key).agg(ordered.alias("ordered")).select(key, F.aggregate("ordered", empty, step)["text"].alias("text"))
