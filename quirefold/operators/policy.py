"""Which pages are cut, and why the others are not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.config import ChunkingConfig, SegmentationError
from quirefold.functions.text import is_blank


def with_reason(pages: DataFrame, cfg: ChunkingConfig) -> DataFrame:
    """``pages`` with a column ``reason``: needs_ocr, empty_text, or null for usable pages.

    The scan policy goes first: a blank scanned page is needs_ocr under skip and
    empty_text under include. A null text counts as blank, a null flag as false.
    """
    scanned = F.coalesce(F.col("needs_ocr"), F.lit(False)) & F.lit(cfg.on_ocr_needed == "skip")
    blank = F.coalesce(is_blank(F.col("text")), F.lit(True))
    return pages.withColumn("reason", F.when(scanned, "needs_ocr").when(blank, "empty_text"))


def refuse_scans(pages: DataFrame, cfg: ChunkingConfig) -> None:
    """Under the error policy, raise for the first scanned page in document and page order."""
    if cfg.on_ocr_needed != "error":
        return
    first = pages.filter("needs_ocr").select("doc_key", "doc_id", "page_index").orderBy("doc_key", "page_index", "seq").first()
    if first is not None:
        raise SegmentationError(f"document {first['doc_id']!r}, page {first['page_index']}: text recognition is needed")
