"""Lines of JSON in, lines of JSON out.

Each input file is a stream of its own: a page belongs to the document line
before it. A file may be read in many splits; every split is read once, in order,
and only one small row a split is needed to join them up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from quirefold.config import SegmentationError
from quirefold.constants import ENGINE_NAME, ENGINE_VERSION, SCHEMA_VERSION
from quirefold.schemas import CHUNK_COLUMNS, DOCUMENTS, PAGES
from quirefold.session import small_or_shuffled, staged
from quirefold.sources.records import read_line

_DOC = T.StructType([f for f in DOCUMENTS.fields if f.name != "doc_key"])
_PAGE = T.StructType([f for f in PAGES.fields if f.name not in ("doc_key", "seq")])
PARSED = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("idx", T.LongType()),
        T.StructField("kind", T.StringType()),  # document, page, invalid, end
        T.StructField("error", T.StringType()),
        T.StructField("doc_idx", T.LongType()),  # the last document line of this split so far
        T.StructField("document", _DOC),
        T.StructField("page", _PAGE),
    ]
)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a partition, in order -> records; after each split a row with its length."""
    schema = to_arrow_schema(PARSED)
    here, idx, doc = None, 0, None
    rows: list[dict] = []

    def end():
        return {"file": here[0], "block": here[1], "idx": idx, "kind": "end", "doc_idx": doc}

    for batch in batches:
        for line, file, block in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != here:
                if here is not None:
                    rows.append(end())
                here, idx, doc = (file, block), 0, None
            if line.strip():
                kind, record, error = read_line(line)
                if kind == "document":
                    doc = idx
                rows.append(
                    {
                        "file": file, "block": block, "idx": idx, "kind": kind, "error": error, "doc_idx": doc,
                        "document": record if kind == "document" else None, "page": record if kind == "page" else None,
                    }
                )
            idx += 1
        if len(rows) > 2000:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows = []
    if here is not None:
        rows.append(end())
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


@dataclass
class Records:
    """documents, pages, orphans (schemas of the same name; orphans as pages) and bad lines (file, line_no, error)."""

    documents: DataFrame
    pages: DataFrame
    orphans: DataFrame
    bad_lines: DataFrame

    @property
    def invalid(self) -> DataFrame:
        """One row for everything that counts as an invalid line."""
        return self.bad_lines.select("line_no").unionByName(self.orphans.select(F.col("seq").alias("line_no")))


def read_records(spark: SparkSession, path: str | list[str], strict: bool = False) -> Records:
    """Read extraction output. Bad lines are counted and passed over; with ``strict``
    the first one raises SegmentationError with its 1-based line number. Orphan
    pages (no document before them, or one of another doc_id) never raise."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    parsed = staged(lines.mapInArrow(_parse, PARSED))
    by_file = Window.partitionBy("file").orderBy("block")
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        parsed.filter("kind = 'end'")
        .select("file", "block", F.col("idx").alias("lines"), "doc_idx")
        .withColumn("base", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))
        .withColumn("carried", F.last(F.col("base") + F.col("doc_idx") + 1, ignorenulls=True).over(earlier))
        .select("file", "block", "base", "carried")
    )
    rows = (
        parsed.filter("kind <> 'end'")
        .join(splits, ["file", "block"])
        .withColumn("line_no", F.col("base") + F.col("idx") + 1)
        .withColumn("doc_line", F.coalesce(F.col("base") + F.col("doc_idx") + 1, F.col("carried")))
    )
    key = lambda line: F.format_string("%s#%012d", F.col("file"), F.col(line))
    bad = rows.filter("kind = 'invalid'").select("file", "line_no", "error")
    if strict:
        first = bad.orderBy("file", "line_no").first()
        if first is not None:
            raise SegmentationError(f"line {first['line_no']}: {first['error']}")
    documents = rows.filter("kind = 'document'").select(key("line_no").alias("doc_key"), "document.*")
    pages = rows.filter("kind = 'page'").select(
        F.when(F.col("doc_line").isNotNull(), key("doc_line")).alias("doc_key"), F.col("line_no").alias("seq"), "page.*"
    )
    owners = small_or_shuffled(documents.select("doc_key", F.col("doc_id").alias("owner")))
    owned = pages.join(owners, "doc_key", "left").withColumn("own", F.coalesce(F.col("owner") == F.col("doc_id"), F.lit(False)))
    columns = [f.name for f in PAGES]
    return Records(
        documents.select(*(f.name for f in DOCUMENTS)), owned.filter("own").select(*columns), owned.filter("NOT own").select(*columns), bad
    )


def numbered_lines(spark: SparkSession, path: str | list[str], *columns) -> DataFrame:
    """``columns`` of every line (column value) of text files, with its place in its file (pos, from 0).

    A file is read in many splits; only one small row a split is needed to number
    the lines. The columns are stored once, so take no more than is used.
    """
    own = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), *columns,
    )
    rows = staged(own)
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        rows.groupBy("_file", "_block")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
        .withColumn("_base", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)))
        .drop("_lines")
    )
    # a split's lines come in order and are numbered without a gap
    pos = (F.col("_base") + F.col("_id") - F.col("_first")).alias("pos")
    return rows.join(splits, ["_file", "_block"]).select(pos, *rows.columns[3:])


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """Chunks as JSON lines (column value), nulls and key order kept, with sort keys."""
    line = F.to_json(F.struct(*CHUNK_COLUMNS), {"ignoreNullFields": "false"})
    return chunks.select("doc_key", "chunk_index", line.alias("value"))


def ordered_skips(skipped: DataFrame, documents: DataFrame) -> DataFrame:
    """Skips in the order a reader of the stream learns of them: an orphan at its own
    line, a document's pages when the next document begins, in page order."""
    line = F.substring_index("doc_key", "#", -1).try_cast("long")
    file = F.substring_index("doc_key", "#", 1)
    nexts = documents.select(
        "doc_key", F.coalesce(F.lead(line).over(Window.partitionBy(file).orderBy(line)), F.lit(2**62)).alias("closes")
    )
    return (
        skipped.join(nexts, "doc_key", "left")
        .withColumn("at", F.coalesce("closes", "seq"))
        .withColumn("group", F.col("doc_key").isNotNull())
        .orderBy("at", "group", "doc_key", "page_index", "seq")
    )


def manifest(cfg, stats: dict, skipped: list[dict], created_at: str) -> dict:
    return {
        "record_type": "manifest",
        "schema_version": SCHEMA_VERSION,
        "created_at": created_at,
        "tool": {"name": ENGINE_NAME, "version": ENGINE_VERSION},
        "config": cfg.as_dict(),
        "stats": stats,
        "skipped_pages": skipped,
    }


def manifest_line(spark: SparkSession, cfg, stats: DataFrame, skipped: DataFrame, documents: DataFrame, created_at: str) -> DataFrame:
    """The manifest as one JSON line (column value), made on the executors.

    The format wants all skipped pages in this line; where they are too many for
    that, read the run's ``skipped`` frame instead.
    """
    lit = lambda v: F.lit(v)
    listed = (
        ordered_skips(skipped, documents)
        .select(F.struct("at", "group", "doc_key", "page_index", "seq").alias("k"), F.struct("doc_id", "page_index", "reason").alias("s"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("skipped_pages"))
    )
    row = stats.select(F.struct(*stats.columns).alias("stats")).crossJoin(listed)  # one row each
    config = F.struct(*(lit(v).alias(k) for k, v in cfg.as_dict().items()))
    tool = F.struct(lit(ENGINE_NAME).alias("name"), lit(ENGINE_VERSION).alias("version"))
    fields = F.struct(
        lit("manifest").alias("record_type"), lit(SCHEMA_VERSION).alias("schema_version"), lit(created_at).alias("created_at"),
        tool.alias("tool"), config.alias("config"), "stats", "skipped_pages",
    )
    return row.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"))


def write_lines(run, cfg, path: str, created_at: str, single_file: bool = False) -> None:
    """Write chunk lines in document order, then the manifest as the last line.

    As a folder, the chunks lie in ordered part files and the manifest in
    ``_manifest`` beside them; as a single file, all lines pass one task.
    """
    spark = run.chunks.sparkSession
    lines = chunk_lines(run.chunks)
    last = manifest_line(spark, cfg, run.stats, run.skipped, run.documents, created_at)
    if not single_file:
        lines.orderBy("doc_key", "chunk_index").select("value").write.mode("overwrite").text(path)
        last.coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/_manifest")
        return
    everything = lines.withColumn("end", F.lit(0)).unionByName(last.withColumn("end", F.lit(1)), allowMissingColumns=True)
    everything.orderBy("end", "doc_key", "chunk_index").select("value").coalesce(1).write.mode("overwrite").text(path)
