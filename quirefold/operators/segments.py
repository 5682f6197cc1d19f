"""From usable pages to chunks.

Without crossing pages, a page (with any repeated rows of its number) is a unit of
its own, and units are spread by (document, page): a large document is no hot key.
When no page is repeated, nothing is shuffled at all. Across pages the unit is the
document; that is what the option asks for, and its text must fit a worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.config import ChunkingConfig
from quirefold.constants import SCHEMA_VERSION
from quirefold.functions import tokens as tok
from quirefold.functions.sentences import Splitter, splitter_of
from quirefold.functions.text import word_count
from quirefold.operators.kernels import Page, Tools, segment
from quirefold.operators.numbering import chunk_id, running_before
from quirefold.schemas import SPAN_DDL
from quirefold.session import staged

PIECE_DDL = f"doc_key string, position bigint, ord bigint, text string, token_count bigint, spans array<{SPAN_DDL}>, section_path array<string>"
_SPAN = pa.struct([("page_index", pa.int64()), ("page_label", pa.string()), ("char_start", pa.int64()), ("char_end", pa.int64())])
PIECE_SCHEMA = pa.schema(
    [
        ("doc_key", pa.string()), ("position", pa.int64()), ("ord", pa.int64()), ("text", pa.string()), ("token_count", pa.int64()),
        ("spans", pa.list_(_SPAN)), ("section_path", pa.list_(pa.string())),
    ]
)
UNIT_COLUMNS = ("doc_key", "page_index", "page_label", "text", "section_path", "usable")


def segment_batches(cfg: ChunkingConfig, tokenizer, splitter: Splitter, by_page: bool):
    """Rows of UNIT_COLUMNS, those of a unit together and in order -> its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Tools(cfg, tok.load(tokenizer), splitter)
        out: list[list] = [[] for _ in PIECE_SCHEMA]
        unit, held = None, []

        def close():
            pages = [Page(i, label, text, tuple(path or ())) for _, i, label, text, path, usable in held if usable]
            texts = {r[1]: r[3] for r in held}
            for n, piece in enumerate(segment(pages, texts, tools)):
                spans = [dict(zip(("page_index", "page_label", "char_start", "char_end"), s)) for s in piece.spans]
                for column, value in zip(out, (held[0][0], held[0][1] if by_page else 0, n, piece.text, piece.tokens, spans, list(piece.path))):
                    column.append(value)

        def batch_of():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PIECE_SCHEMA)], schema=PIECE_SCHEMA)
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key = row[:2] if by_page else row[0]
                if held and key != unit:
                    close()
                    held = []
                unit = key
                held.append(row)
            if len(out[0]) >= 2000:
                yield batch_of()
        if held:
            close()
        yield batch_of()

    return run


def has_repeats(pages: DataFrame) -> bool:
    """Whether some (document, page) has more than one row; reads two columns."""
    return not pages.groupBy("doc_key", "page_index").count().filter("count > 1").isEmpty()


def whole_pages(usable: DataFrame) -> DataFrame:
    """Usable pages, each as one piece counted by words: nothing is cut, so nothing leaves the JVM."""
    span = F.struct("page_index", "page_label", F.lit(0).cast("bigint").alias("char_start"), F.length("text").cast("bigint").alias("char_end"))
    return usable.select(
        "doc_key", F.col("page_index").alias("position"), F.lit(0).cast("bigint").alias("ord"), "text", word_count(F.col("text")).alias("token_count"),
        F.array(span).cast(f"array<{SPAN_DDL}>").alias("spans"), F.lit(None).cast("array<string>").alias("section_path"),
    )


def pieces(pages: DataFrame, cfg: ChunkingConfig, paths: DataFrame, tokenizer=tok.WORD_COUNTER, splitter: str | Splitter = "abbreviations") -> DataFrame:
    """Pieces (PIECE_DDL) of pages with a ``reason`` column, as a stored table.

    position and ord give their order. ``paths`` (see section_paths) is used here
    only across pages, where a section bounds what is joined.
    """
    split = splitter_of(splitter)
    rows = pages.withColumn("usable", F.col("reason").isNull())
    by_page = not cfg.cross_page
    if by_page:
        rows = rows.withColumn("section_path", F.lit(None).cast("array<string>"))
        # skipped rows stay only where a usable row of the same page may need their text
        if has_repeats(pages):
            rows = rows.repartition("doc_key", "page_index").sortWithinPartitions("doc_key", "page_index", "seq")
        else:
            rows = rows.filter("usable")
            if cfg.strategy == "page" and isinstance(tokenizer, str) and tokenizer == tok.WORD_COUNTER:
                return staged(whole_pages(rows))
    else:
        rows = (
            rows.join(paths, ["doc_key", "page_index"], "left")
            .repartition("doc_key")
            .sortWithinPartitions("doc_key", "page_index", "seq")
        )
    return staged(rows.select(*UNIT_COLUMNS).mapInArrow(segment_batches(cfg, tokenizer, split, by_page), PIECE_DDL))


def chunks(cut: DataFrame, documents: DataFrame, cfg: ChunkingConfig, paths: DataFrame) -> DataFrame:
    """Chunk rows in the order of CHUNK_COLUMNS, plus doc_key.

    What a chunk gets from its document and page is put together for the units
    first, which have no text, so the text is joined once, by (document, position).
    """
    source = documents.select(
        "doc_key", "doc_id",
        F.struct(F.coalesce("metadata.Title", F.lit("")).alias("title"), F.col("source_path").alias("source_path")).alias("source_doc"),
    )
    units = cut.groupBy("doc_key", "position").agg(F.count("*").alias("_n"))
    units = running_before(units, ["doc_key"], "position", "_n", "_first").drop("_n").join(source, "doc_key")
    if cfg.cross_page:
        path = F.col("section_path")
    else:
        cut = cut.drop("section_path")
        units = units.join(paths.withColumnRenamed("page_index", "position"), ["doc_key", "position"], "left")
        path = F.coalesce("section_path", F.array().cast("array<string>"))
    index = (F.col("_first") + F.col("ord")).cast("long")
    return cut.join(units, ["doc_key", "position"]).select(
        "doc_key",
        F.lit("chunk").alias("record_type"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        chunk_id(F.col("doc_id"), index).alias("chunk_id"),
        "doc_id",
        index.alias("chunk_index"),
        "text",
        F.lit(cfg.strategy).alias("strategy"),
        "token_count",
        F.lit(cfg.tokenizer_model).alias("tokenizer_model"),
        "spans",
        path.alias("section_path"),
        "source_doc",
    )
