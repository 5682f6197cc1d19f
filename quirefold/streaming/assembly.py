"""Extraction output as a stream of files.

Positions mean nothing across micro-batches, so the stream is keyed by doc_id.
Text is never kept in state: a micro-batch appends its documents and pages to
tables, and ``finish`` cuts and numbers what has arrived. ``closing`` keeps, for
each document, only which pages were seen, and tells when it is whole and which
pages come late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirefold.config import ChunkingConfig
from quirefold.operators.policy import with_reason
from quirefold.plans.job import Run, run, run_stats
from quirefold.schemas import CHUNK_DDL, DOCUMENTS, PAGES, SKIPPED_DDL
from quirefold.session import delete_path
from quirefold.sources.jsonl import manifest_line
from quirefold.sources.records import read_line

_DOC = T.StructType([f for f in DOCUMENTS.fields if f.name != "doc_key"])
_PAGE = T.StructType([f for f in PAGES.fields if f.name not in ("doc_key", "seq")])
RECORDS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("idx", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("document", _DOC),
        T.StructField("page", _PAGE),
    ]
)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(RECORDS)
    here, idx = None, 0
    for batch in batches:
        rows = []
        for line, file, block in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != here:
                here, idx = (file, block), 0
            idx += 1
            if line.strip():
                kind, record, error = read_line(line)
                rows.append({"file": file, "block": block, "idx": idx, "kind": kind, "doc_id": record and record["doc_id"], "error": error, "document": record if kind == "document" else None, "page": record if kind == "page" else None})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def records(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The lines of all files in ``path``, now and later, as records (RECORDS)."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return lines.select("value", F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).mapInArrow(_parse, RECORDS)


CLOSING = "doc_id string, event string, page_index long, pages long"


def _close(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A micro-batch has no order: what closes a document is judged after all its rows."""
    count, seen, closed = state.get if state.exists else (-1, [], False)
    seen = set(seen)
    new: set[int] = set()
    for frame in frames:
        whole = frame["kind"] == "document"
        count = max([count, *map(int, frame["page_count"][whole])])
        new |= set(map(int, frame["page_index"][~whole])) - seen
    out = [(key[0], "late", i, len(seen)) for i in sorted(new)] if closed else []
    seen |= new
    if not closed and 0 <= count <= len(seen):
        closed = True
        out.append((key[0], "closed", None, len(seen)))
    state.update((count, sorted(seen), closed))
    yield pd.DataFrame(out, columns=["doc_id", "event", "page_index", "pages"]).astype({"page_index": "Int64", "pages": "int64"})


def closing(parsed: DataFrame) -> DataFrame:
    """Events of a stream of records: a document is whole (closed), a page comes late."""
    rows = parsed.filter("doc_id IS NOT NULL").select(
        "doc_id", "kind", F.coalesce("document.page_count", F.lit(-1)).alias("page_count"), F.coalesce("page.page_index", F.lit(-1)).alias("page_index")
    )
    return rows.groupBy("doc_id").applyInPandasWithState(
        _close, CLOSING, "page_count long, seen array<long>, closed boolean", "append", GroupStateTimeout.NoTimeout
    )


def append_batch(out: str):
    """A foreachBatch function; a batch that runs again replaces its own files."""

    def run_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/records/batch={number}")

    return run_batch


#: Parts of the output by a hash of doc_id; a call of ``finish`` cuts those with new records again.
BUCKETS = 64


def _documents_and_pages(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, their pages, orphans) of records; of repeated records the first to arrive stays."""
    arrival = F.struct("batch", "file", "block", "idx")
    documents = (
        rows.filter("kind = 'document'")
        .groupBy("doc_id")
        .agg(F.min_by("document", arrival).alias("d"))
        .select(F.col("doc_id").alias("doc_key"), "d.*")
    )
    pages = (
        rows.filter("kind = 'page'")
        .groupBy("doc_id", F.col("page.page_index").alias("page_index"))
        .agg(F.min_by(F.struct("batch", "page.text", "page.page_label", "page.needs_ocr"), arrival).alias("p"))
        .select(
            F.col("doc_id").alias("doc_key"), "doc_id", F.col("p.batch").alias("seq"), "page_index", "p.page_label", "p.text", "p.needs_ocr"
        )
    )
    known = documents.select("doc_key")
    return documents, pages.join(known, "doc_key", "left_semi"), pages.join(known, "doc_key", "left_anti")


def _progress(spark: SparkSession, out: str, settings: str) -> int:
    """The last batch that earlier calls with the same settings have cut; -1 at first."""
    try:
        done = spark.read.schema("batch long, settings string").json(f"{out}/progress").collect()  # one row
    except AnalysisException:
        return -1
    return next((r.batch for r in done if r.settings == settings), -1)


def finish(spark: SparkSession, out: str, cfg: ChunkingConfig, created_at: str | None = None, buckets: int = BUCKETS, **options) -> Run:
    """Chunks, skipped pages and manifest of all records so far, beside them in ``out``.

    A document's and a page's repeated records count once; as with tables, the first
    stays: of the earliest batch, in it of the file that is first by name, in it of
    the first line. Pages without a document are orphans. Only documents in buckets
    that got records since the last call with these settings are cut again; the
    counters and the manifest are those of everything.
    """
    schema = T.StructType([*RECORDS.fields, T.StructField("batch", T.LongType())])
    bucket = lambda key: F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    rows = spark.read.schema(schema).parquet(f"{out}/records")
    settings = f"{cfg.as_dict()} {buckets} {sorted(options.items(), key=str)}"
    done = _progress(spark, out, settings)
    last = rows.agg(F.max("batch")).first()[0]
    new = [r[0] for r in rows.filter((F.col("batch") > done) & F.col("doc_id").isNotNull()).select(bucket("doc_id")).distinct().collect()]
    some = rows if done < 0 else rows.filter(bucket("doc_id").isin(new))
    if done < 0 or new:
        documents, pages, orphans = _documents_and_pages(some)
        made = run(documents, pages, cfg, orphans, **options)
        for name, frame in (("chunks", made.chunks), ("skipped", made.skipped)):
            # the first call replaces what calls with other settings left; a call that failed is repeated, with its buckets
            for b in new if done >= 0 else ():
                delete_path(spark, f"{out}/{name}/bucket={b}")
            frame.withColumn("bucket", bucket("doc_id")).write.mode("append" if done >= 0 else "overwrite").partitionBy("bucket").parquet(f"{out}/{name}")
        spark.createDataFrame([(last, settings)], "batch long, settings string").coalesce(1).write.mode("overwrite").json(f"{out}/progress")
    documents, pages, orphans = _documents_and_pages(rows)
    judged = with_reason(pages, cfg)
    chunks = spark.read.schema(CHUNK_DDL).parquet(f"{out}/chunks")
    skipped = spark.read.schema(SKIPPED_DDL).parquet(f"{out}/skipped")
    invalid = rows.filter("kind = 'invalid'").select("kind").unionByName(orphans.select(F.lit("orphan").alias("kind")))
    whole = Run(documents, judged, chunks, skipped, run_stats(documents, judged, chunks, invalid))
    from quirefold.plans.stream_job import now

    manifest_line(spark, cfg, whole.stats, whole.skipped, whole.documents, created_at or now()).coalesce(1).write.mode("overwrite").text(f"{out}/manifest")
    return whole


def run_available(spark: SparkSession, source: str, out: str, checkpoint: str, cfg: ChunkingConfig, **options) -> Run:
    """Take in every file that is there, then finish. Call it again when more came."""
    query = (
        records(spark, source)
        .writeStream.foreachBatch(append_batch(out))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return finish(spark, out, cfg, **options)
