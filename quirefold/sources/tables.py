"""Documents and pages from tables that are keyed by doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.schemas import METADATA_FIELDS
from quirefold.session import small_or_shuffled


def from_tables(document_records: DataFrame, page_records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pages, orphans) of two tables of extraction records.

    Repeated lines of a document, and of a page that was delivered again, count
    once: the first line stays. Pages of no known document are orphans. Rows
    without a doc_id are dropped.
    """
    meta = F.struct(*(F.coalesce(F.col(f"metadata.{n}"), F.lit("")).alias(n) for n in METADATA_FIELDS))
    documents = (
        document_records.filter("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min_by(F.struct("source_path", "page_count", meta.alias("metadata"), "toc"), "line_no").alias("x"))
        .select(F.col("doc_id").alias("doc_key"), "doc_id", "x.source_path", "x.page_count", "x.metadata", "x.toc")
    )
    usable = page_records.filter("doc_id IS NOT NULL AND page_index IS NOT NULL")
    # which rows repeat a page is found on the keys alone; the text is not shuffled
    keys = usable.select("doc_id", "page_index", "line_no")
    repeated = keys.groupBy("doc_id", "page_index").agg(F.min("line_no").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = keys.join(repeated, ["doc_id", "page_index"]).filter("line_no > first").select("line_no")
    pages = usable.join(small_or_shuffled(later), "line_no", "left_anti").select(
        F.col("doc_id").alias("doc_key"), "doc_id", F.col("line_no").alias("seq"), "page_index", "page_label", "text", "needs_ocr"
    )
    # text rows meet the documents by broadcast while these are few; a large document is no hot key then
    known = small_or_shuffled(documents.select("doc_key"))
    return documents, pages.join(known, "doc_key", "left_semi"), pages.join(known, "doc_key", "left_anti")
