"""Row types of the inputs and outputs."""

from __future__ import annotations

from pyspark.sql import types as T

METADATA_FIELDS = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")

METADATA = T.StructType([T.StructField(n, T.StringType()) for n in METADATA_FIELDS])
TOC_ENTRY = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("level", T.LongType()), T.StructField("page_index", T.LongType())]
)
#: doc_key tells apart two documents that share a doc_id.
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_key", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("page_count", T.LongType()),
        T.StructField("metadata", METADATA),
        T.StructField("toc", T.ArrayType(TOC_ENTRY)),
    ]
)
#: seq orders rows of equal page_index, as they arrived.
PAGES = T.StructType(
    [
        T.StructField("doc_key", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("page_index", T.LongType()),
        T.StructField("page_label", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("needs_ocr", T.BooleanType()),
    ]
)
SPAN_DDL = "struct<page_index: bigint, page_label: string, char_start: bigint, char_end: bigint>"
CHUNK_DDL = (
    "doc_key string, record_type string, schema_version string, chunk_id string, doc_id string, chunk_index bigint, text string, strategy string, "
    f"token_count bigint, tokenizer_model string, spans array<{SPAN_DDL}>, section_path array<string>, source_doc struct<title: string, source_path: string>"
)
SKIPPED_DDL = "doc_key string, seq bigint, doc_id string, page_index bigint, reason string"
CHUNK_COLUMNS = (
    "record_type", "schema_version", "chunk_id", "doc_id", "chunk_index", "text", "strategy", "token_count",
    "tokenizer_model", "spans", "section_path", "source_doc",
)
