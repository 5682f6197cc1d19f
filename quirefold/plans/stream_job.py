"""From a JSONL file to a JSONL file: the whole run."""

from __future__ import annotations

import datetime

from pyspark.sql import SparkSession

from quirefold.config import ChunkingConfig
from quirefold.plans.job import Run, run
from quirefold.session import fetch_file, scratch
from quirefold.sources.jsonl import ordered_skips, read_records, write_lines


def now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")


def process(
    spark: SparkSession, source: str, target: str | None, cfg: ChunkingConfig | None = None, created_at: str | None = None,
    single_file: bool = False, tokenizer=None, splitter="abbreviations",
) -> Run:
    """Read ``source``, cut it, and write chunks and manifest to ``target``.

    Errors (strict lines, scans under the error policy, an unknown tokenizer) raise
    before anything is written.
    """
    cfg = cfg or ChunkingConfig()
    records = read_records(spark, source, cfg.strict)
    made = run(records.documents, records.pages, cfg, records.orphans, records.invalid, tokenizer, splitter)
    if target is not None:
        write_lines(made, cfg, target, created_at or now(), single_file)
    return made


def process_file(spark: SparkSession, source: str, target: str, cfg: ChunkingConfig | None = None, **options) -> Run:
    """As ``process``, with one ordinary output file on the driver's machine.

    Executors write to the shared folder; the driver copies the file from there.
    """
    folder = scratch(spark, "lines")
    made = process(spark, source, folder, cfg, single_file=True, **options)
    fetch_file(spark, folder, target)
    return made


def summary(made: Run, most: int | None = 1000) -> tuple[dict, list[dict]]:
    """The counters, and the skipped pages in stream order: the first ``most``, or all."""
    stats = made.stats.first().asDict()
    rows = ordered_skips(made.skipped, made.documents).select("doc_id", "page_index", "reason")
    rows = rows if most is None else rows.limit(most)
    return stats, [r.asDict() for r in rows.collect()]
