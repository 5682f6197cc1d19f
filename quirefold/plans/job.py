"""A chunking run over documents and pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.config import ChunkingConfig
from quirefold.functions import tokens as tok
from quirefold.functions.sentences import Splitter
from quirefold.operators import policy, segments
from quirefold.operators.sections import section_paths
from quirefold.schemas import DOCUMENTS, PAGES


@dataclass
class Run:
    """chunks: CHUNK_COLUMNS and doc_key; skipped: doc_id, page_index, reason (and doc_key, seq); stats: one row."""

    documents: DataFrame
    pages: DataFrame
    chunks: DataFrame
    skipped: DataFrame
    stats: DataFrame

    def register(self, prefix: str = "") -> None:
        """Make the frames known to SQL, with spans as one row each."""
        spans = self.chunks.select("chunk_id", "doc_id", F.posexplode("spans").alias("span_no", "span")).select(
            "chunk_id", "doc_id", "span_no", "span.*"
        )
        for name in ("documents", "pages", "chunks", "skipped", "stats"):
            getattr(self, name).createOrReplaceTempView(prefix + name)
        spans.createOrReplaceTempView(prefix + "spans")


def skipped_pages(pages: DataFrame, orphans: DataFrame | None) -> DataFrame:
    """Skipped pages of documents, and orphans, whose reason is invalid_record."""
    own = pages.filter("reason IS NOT NULL").select("doc_key", "seq", "doc_id", "page_index", "reason")
    if orphans is None:
        return own
    lost = orphans.select(
        F.lit(None).cast("string").alias("doc_key"), "seq", "doc_id", "page_index", F.lit("invalid_record").alias("reason")
    )
    return own.unionByName(lost)


def run_stats(documents: DataFrame, pages: DataFrame, chunks: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """One row of counters; ``invalid`` holds one row for each bad line or orphan."""
    parts = [
        documents.select(F.lit("documents_seen").alias("k"), F.lit(1).alias("n")),
        pages.select(F.lit("pages_seen").alias("k"), F.lit(1).alias("n")),
        pages.filter("reason IS NULL").select(F.lit("pages_chunked").alias("k"), F.lit(1).alias("n")),
        chunks.select(F.lit("chunks_written").alias("k"), F.lit(1).alias("n")),
    ]
    if invalid is not None:
        parts.append(invalid.select(F.lit("invalid_lines").alias("k"), F.lit(1).alias("n")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    count = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).cast("long").alias(k)
    return every.groupBy("k").agg(F.sum("n").alias("n")).agg(
        *map(count, ("documents_seen", "pages_seen", "pages_chunked", "chunks_written", "invalid_lines"))
    )


def run(
    documents: DataFrame,
    pages: DataFrame,
    cfg: ChunkingConfig | None = None,
    orphans: DataFrame | None = None,
    invalid: DataFrame | None = None,
    tokenizer=None,
    splitter: str | Splitter = "abbreviations",
) -> Run:
    """Cut pages (schemas.PAGES) of documents (schemas.DOCUMENTS) into chunks.

    The pieces are cut at once and stored in the shared folder; the frames of the
    result read them from there.
    ``tokenizer`` defaults to the config's model, resolved once on the driver; it may
    be a counter object (see functions.tokens), and ``splitter`` a function from a
    text to sentence ranges.
    Raises SegmentationError for a scanned page under the error policy.
    """
    cfg = cfg or ChunkingConfig()
    shipped = tok.resolve(cfg.tokenizer_model if tokenizer is None else tokenizer)
    # further columns of the frames are not looked at
    documents = documents.select(*(f.name for f in DOCUMENTS))
    pages = pages.select(*(f.name for f in PAGES))
    policy.refuse_scans(pages, cfg)
    judged = policy.with_reason(pages, cfg)
    paths = section_paths(documents, judged)
    made = segments.chunks(segments.pieces(judged, cfg, paths, shipped, splitter), documents, cfg, paths)
    return Run(documents, judged, made, skipped_pages(judged, orphans), run_stats(documents, judged, made, invalid))
