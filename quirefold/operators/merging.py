"""Merging of small pieces as an operator on frames; a run does the same inside its kernels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.config import ChunkingConfig
from quirefold.functions import tokens as tok
from quirefold.operators.kernels import Piece, Tools, merge_small
from quirefold.operators.segments import PIECE_SCHEMA
from quirefold.schemas import SPAN_DDL

MERGED_DDL = f"doc_key string, chunk_index bigint, text string, token_count bigint, spans array<{SPAN_DDL}>, section_path array<string>"
_SPAN_TYPE = PIECE_SCHEMA.field("spans").type
_FIELDS = ("page_index", "page_label", "char_start", "char_end")


def _merge(cfg: ChunkingConfig, tokenizer):
    """Rows of a unit together: its pages (piece null), then its pieces in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Tools(cfg, tok.load(tokenizer), None)
        out: list[tuple] = []
        unit, texts, held = None, {}, []

        def close():
            for x in merge_small(held, texts, tools):
                out.append((unit[0], x.no, x.text, x.tokens, [dict(zip(_FIELDS, s)) for s in x.spans], list(x.path)))

        def batch_of():
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), _SPAN_TYPE, pa.list_(pa.string()))
            names = ("doc_key", "chunk_index", "text", "token_count", "spans", "section_path")
            columns = list(zip(*out)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=list(names))

        for batch in batches:
            for doc, part, page, number, text, size, spans, path in zip(*(c.to_pylist() for c in batch.columns)):
                if (doc, part) != unit:
                    if held:
                        close()
                    unit, texts, held = (doc, part), {}, []
                if number is None:
                    texts[page] = text or ""
                else:
                    held.append(Piece(text, [[s[f] for f in _FIELDS] for s in spans], size, tuple(path or ()), number))
            if len(out) >= 2000:
                yield batch_of()
        if held:
            close()
        yield batch_of()

    return run


def merge_runts(chunks: DataFrame, pages: DataFrame, cfg: ChunkingConfig, tokenizer=tok.WORD_COUNTER) -> DataFrame:
    """Append pieces below ``cfg.min_chunk_tokens`` to the piece before, where section,
    pages and budget allow it; chunk_index is that of the first piece of each.

    ``chunks``: doc_key, chunk_index, text, token_count, spans, section_path; ``pages``:
    doc_key, page_index, text. Without ``cross_page`` pieces lie on one page each, and
    rows are spread by (document, page); with it a document's rows go together. Pieces
    without spans are dropped; null texts count as empty.
    """
    shipped = tok.resolve(tokenizer)
    part = F.lit(0).cast("bigint") if cfg.cross_page else F.col("page_index")
    own = chunks.filter(F.size("spans") > 0).withColumn("page_index", F.col("spans")[0]["page_index"])
    pieces = own.select(
        "doc_key", part.alias("part"), "page_index", F.col("chunk_index").cast("bigint").alias("number"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("token_count", F.lit(0)).cast("bigint").alias("size"), F.col("spans").cast(f"array<{SPAN_DDL}>").alias("spans"), "section_path",
    )
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    texts = pages.select(
        "doc_key", part.alias("part"), "page_index", null("bigint", "number"), "text", null("bigint", "size"), null(f"array<{SPAN_DDL}>", "spans"), null("array<string>", "section_path")
    )
    rows = texts.unionByName(pieces).repartition("doc_key", "part").sortWithinPartitions("doc_key", "part", F.col("number").asc_nulls_first())
    return rows.mapInArrow(_merge(cfg, shipped), MERGED_DDL)
