"""The registered queries of the core and their SQL.

All run over the whole tables document_records and page_records, keyed by doc_id
(repeated lines count once), except the line-stream queries, which take both
tables' lines in line_no order as one JSONL stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.config import ChunkingConfig, SegmentationError
from quirefold.functions import rows as parts
from quirefold.functions import text as fx
from quirefold.functions.sentences import abbreviation_scores
from quirefold.functions.tokens import WORD_COUNTER
from quirefold.operators import policy, units
from quirefold.operators.sections import path_groups, section_paths
from quirefold.plans import job, sql
from quirefold.schemas import METADATA_FIELDS
from quirefold.session import scratch
from quirefold.sources import jsonl
from quirefold.sources.tables import from_tables

CREATED = "2024-03-01T00:00:00+00:00"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _frames(spark: SparkSession, folder: str):
    return from_tables(_table(spark, folder, "document_records"), _table(spark, folder, "page_records"))


def _config(strategy: str, **options) -> ChunkingConfig:
    return ChunkingConfig(**{"strategy": strategy, "max_tokens": 64, "overlap": 0, "min_chunk_tokens": 0, "tokenizer_model": WORD_COUNTER} | options)


def _run(spark: SparkSession, folder: str, strategy: str, tokenizer: str | None = None, **options) -> job.Run:
    documents, pages, orphans = _frames(spark, folder)
    return job.run(documents, pages, _config(strategy, **options), orphans, tokenizer=tokenizer, splitter="marks")


def _spans(chunks: DataFrame) -> DataFrame:
    """Chunks with one row for each span."""
    return chunks.select("chunk_id", "doc_id", "chunk_index", "token_count", F.posexplode("spans").alias("span_no", "s")).select(
        "chunk_id", "doc_id", "chunk_index", "token_count", F.col("span_no").cast("long"), "s.page_index", "s.char_start", "s.char_end"
    )


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return _run(spark, folder, "recursive", max_tokens=128, min_chunk_tokens=16).chunks.drop("doc_key")


def page_chunks(spark, folder):
    made = _run(spark, folder, "page").chunks
    return made.select("chunk_id", "doc_id", "chunk_index", F.col("spans")[0]["page_index"].alias("page_index"), "token_count", "text")


def word_offsets(spark, folder):
    pages = _frames(spark, folder)[1].select("doc_id", "page_index", "text")
    return parts.word_rows(pages)


def token_count(spark, folder):
    pages = _table(spark, folder, "page_records")
    return pages.select("line_no", fx.word_count(F.col("text")).alias("token_count"), fx.is_blank(F.col("text")).alias("blank"))


def fixed_tiles(spark, folder):
    return _spans(_run(spark, folder, "fixed-size").chunks)


def fixed_sliding(spark, folder):
    return _spans(_run(spark, folder, "fixed-size", overlap=16).chunks)


def fixed_cross_page(spark, folder):
    return _spans(_run(spark, folder, "fixed-size", cross_page=True).chunks)


def paragraphs(spark, folder):
    return parts.paragraph_rows(_frames(spark, folder)[1].select("doc_id", "page_index", "text"))


def sentence_spans(spark, folder):
    return parts.sentence_rows(_frames(spark, folder)[1].select("doc_id", "page_index", "text"), splitter="marks")


def sentence_counts(spark, folder):
    pages = _table(spark, folder, "page_records")
    return pages.select("line_no", F.size(fx.sentence_pieces(F.col("text"))).cast("long").alias("sentences"))


def sentence_pack(spark, folder):
    return _spans(_run(spark, folder, "sentence").chunks)


def sentence_overlap(spark, folder):
    return _spans(_run(spark, folder, "sentence", overlap=24).chunks)


def recursive(spark, folder):
    return _spans(_run(spark, folder, "recursive").chunks)


def recursive_cross_page(spark, folder):
    return _spans(_run(spark, folder, "recursive", cross_page=True, min_chunk_tokens=8).chunks)


def section_index(spark, folder):
    documents, pages, _ = _frames(spark, folder)
    return section_paths(documents, pages).select(
        F.col("doc_key").alias("doc_id"), "page_index", F.array_join("section_path", " > ").alias("section_path")
    )


def section_groups(spark, folder):
    documents, pages, _ = _frames(spark, folder)
    grouped = path_groups(pages.join(section_paths(documents, pages), ["doc_key", "page_index"], "left"))
    return grouped.select("doc_id", "page_index", F.col("section_no").cast("long"))


def section_chunks(spark, folder):
    made = _run(spark, folder, "section", cross_page=True).chunks
    return _spans(made).join(made.select("chunk_id", F.array_join("section_path", " > ").alias("section_path")), "chunk_id")


def runt_merge(spark, folder):
    return _spans(_run(spark, folder, "page", cross_page=True, min_chunk_tokens=32).chunks)


def ocr_include(spark, folder):
    made = _run(spark, folder, "page", on_ocr_needed="include").chunks
    return made.select("chunk_id", "doc_id", "chunk_index", F.col("spans")[0]["page_index"].alias("page_index"), "token_count")


def ocr_reasons(spark, folder):
    pages = _frames(spark, folder)[1]
    judge = lambda how: policy.with_reason(pages, _config("page", on_ocr_needed=how)).select("doc_id", "page_index", "reason")
    return judge("skip").withColumnRenamed("reason", "under_skip").join(judge("include").withColumnRenamed("reason", "under_include"), ["doc_id", "page_index"])


def skipped_pages(spark, folder):
    return _run(spark, folder, "page").skipped.select("doc_id", "page_index", "reason")


def run_stats(spark, folder):
    return _run(spark, folder, "page").stats


def source_doc_join(spark, folder):
    made = _run(spark, folder, "page").chunks
    return made.select("chunk_id", "source_doc.title", "source_doc.source_path")


def chunk_ids(spark, folder):
    return _run(spark, folder, "fixed-size").chunks.select("doc_id", "chunk_index", "chunk_id")


def dedup_page_sort(spark, folder):
    pages = _frames(spark, folder)[1]
    return pages.select("doc_id", "page_index", F.col("seq").alias("line_no"), F.length("text").cast("long").alias("n_chars"))


# line streams


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Both tables as JSON lines (line_no, value)."""
    opts = {"ignoreNullFields": "false"}
    docs = _table(spark, folder, "document_records")
    meta = F.struct(*(F.coalesce(F.col(f"metadata.{n}"), F.lit("")).alias(n) for n in METADATA_FIELDS))
    doc = F.struct("record_type", "doc_id", "source_path", "page_count", meta.alias("metadata"), F.coalesce("toc", F.array()).alias("toc"))
    page = F.struct("record_type", "doc_id", "page_index", "page_label", "text", "needs_ocr")
    return docs.select("line_no", F.to_json(doc, opts).alias("value")).unionByName(
        _table(spark, folder, "page_records").select("line_no", F.to_json(page, opts).alias("value"))
    )


def _stream(spark: SparkSession, lines: DataFrame) -> jsonl.Records:
    """The lines as one file of the shared folder, read as a stream of records."""
    path = scratch(spark, "lines")
    lines.orderBy("line_no").select("value").coalesce(1).write.text(path)
    return jsonl.read_records(spark, path)


def orphans(spark, folder):
    read = _stream(spark, _lines(spark, folder))
    return read.orphans.select("doc_id", "page_index", F.col("seq").alias("stream_line"))


def positional_pages(spark, folder):
    read = _stream(spark, _lines(spark, folder))
    owner = F.substring_index("doc_key", "#", -1).cast("long")
    return read.pages.select("doc_id", "page_index", F.col("seq").alias("stream_line"), owner.alias("document_line"))


def invalid_lines(spark, folder):
    """Every seventh line is cut in the middle, every eleventh has a negative number."""
    lines = _lines(spark, folder)
    spoilt = (
        F.when(F.col("line_no") % 7 == 0, F.expr("substring(value, 1, length(value) div 2)"))
        .when(F.col("line_no") % 11 == 0, F.regexp_replace("value", '"(page_index|page_count)":\\d+,"(page_label|metadata)"', '"$1":-1,"$2"'))
        .otherwise(F.col("value"))
    )
    return _stream(spark, lines.withColumn("value", spoilt)).bad_lines.select("line_no")


def jsonl_roundtrip(spark, folder):
    read = _stream(spark, _lines(spark, folder))
    cfg = _config("page")
    made = job.run(read.documents, read.pages, cfg, read.orphans, read.invalid)
    path = scratch(spark, "chunks")
    jsonl.write_lines(made, cfg, path, CREATED)
    back = spark.read.schema(made.chunks.drop("doc_key").schema).json(f"{path}/part-*")
    return back.select("chunk_id", "doc_id", "chunk_index", "token_count", F.col("spans")[0]["char_end"].alias("char_end"))


def manifest(spark, folder):
    read = _stream(spark, _lines(spark, folder))
    cfg = _config("page")
    made = job.run(read.documents, read.pages, cfg, read.orphans, read.invalid)
    line = jsonl.manifest_line(spark, cfg, made.stats, made.skipped, made.documents, CREATED)
    kind = "record_type string, created_at string, config struct<strategy: string>, stats struct<documents_seen: long, pages_seen: long, pages_chunked: long, chunks_written: long, invalid_lines: long>, skipped_pages array<struct<doc_id: string, page_index: long, reason: string>>"
    x = line.select(F.from_json("value", kind).alias("m"))
    return x.select("m.record_type", "m.created_at", "m.config.strategy", "m.stats.*", F.size("m.skipped_pages").cast("long").alias("skipped"))


def word_level_tokenizer() -> str:
    """A tokenizer.json that gives one token for each white-space word."""
    return json.dumps(
        {
            "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
            "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None,
            "model": {"type": "WordLevel", "vocab": {"[UNK]": 0}, "unk_token": "[UNK]"},
        }
    )


def file_tokenizer(spark, folder):
    return _spans(_run(spark, folder, "fixed-size", overlap=16, tokenizer=word_level_tokenizer()).chunks)


def streaming_assembly(spark, folder):
    from quirefold.streaming.assembly import run_available

    lines = _lines(spark, folder)
    base = scratch(spark, "stream")
    lines.repartitionByRange(4, "line_no").sortWithinPartitions("line_no").select("value").write.text(f"{base}/in")
    run_available(spark, f"{base}/in", f"{base}/out", f"{base}/state", _config("page"))
    return spark.read.parquet(f"{base}/out/chunks").select("chunk_id", "doc_id", "chunk_index", "token_count")


def views(spark, folder):
    """SQL over the output frames: chunks and tokens by section depth."""
    made = _run(spark, folder, "page")
    made.register("qf_")
    return spark.sql(
        "SELECT CAST(size(section_path) AS BIGINT) AS depth, count(*) AS chunks, sum(token_count) AS tokens FROM qf_chunks GROUP BY 1"
    )


def unit_text_segments(spark, folder):
    pages = _frames(spark, folder)[1]
    return units.unit_segments(pages, cross_page=True).select(F.col("doc_key").alias("doc_id"), "page_index", "g_start", "g_end")


def unit_texts(spark, folder):
    return units.unit_texts(_frames(spark, folder)[1], cross_page=True).select(F.col("doc_key").alias("doc_id"), "text")


def token_windows(spark, folder):
    pages = _frames(spark, folder)[1].select("doc_id", "page_index", fx.word_count(F.col("text")).alias("n_tokens"))
    return units.token_windows(pages, 64, 16)


def range_spans(spark, folder):
    """Provenance of ranges of 500 characters of the joined texts."""
    pages = _frames(spark, folder)[1]
    size = units.unit_texts(pages, cross_page=True).select("doc_key", "unit", F.length("text").cast("long").alias("size"))
    ranges = size.withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("size div 500")))).select(
        "doc_key", "unit", "range_no", (F.col("range_no") * 500).alias("s"), F.least(F.col("range_no") * 500 + 500, F.col("size")).alias("e")
    )
    parts_ = units.spans_of_ranges(ranges, units.unit_segments(pages, cross_page=True))
    return parts_.select(F.col("doc_key").alias("doc_id"), "range_no", "page_index", "char_start", "char_end")


def rebuilt_texts(spark, folder):
    """Chunks whose text, rebuilt from their spans, differs (none), and all others, counted."""
    documents, pages, _ = _frames(spark, folder)
    made = job.run(documents, pages, _config("fixed-size", cross_page=True, min_chunk_tokens=8), splitter="marks").chunks
    back = units.span_texts(made, pages).withColumnRenamed("text", "rebuilt")
    return made.join(back, "chunk_id").groupBy((F.col("text") == F.col("rebuilt")).alias("equal")).agg(F.count("*").alias("chunks"))


def default_sentences(spark, folder):
    return parts.sentence_rows(_frames(spark, folder)[1].select("doc_id", "page_index", "text"))


def learnt_abbreviations(spark, folder):
    scores = abbreviation_scores(_table(spark, folder, "page_records"))
    return scores.filter("score >= 0.3").select("word", "dotted", "plain")


def _refusal(spark: SparkSession, work) -> DataFrame:
    try:
        work()
        said = None
    except SegmentationError as e:
        said = str(e)
    return spark.createDataFrame([(said,)], "message string")


def strict_refusal(spark, folder):
    """Where strict reading stops at lines of which every thirteenth is cut in the middle."""
    lines = _lines(spark, folder)
    cut = F.when(F.col("line_no") % 13 == 12, F.expr("substring(value, 1, length(value) div 2)")).otherwise(F.col("value"))
    path = scratch(spark, "lines")
    lines.withColumn("value", cut).orderBy("line_no").select("value").coalesce(1).write.text(path)
    said = _refusal(spark, lambda: jsonl.read_records(spark, path, strict=True))
    return said.select(F.regexp_extract("message", "^line ([0-9]+): ", 1).cast("long").alias("line_no"))


def scan_refusal(spark, folder):
    return _refusal(spark, lambda: _run(spark, folder, "page", on_ocr_needed="error"))


def single_file(spark, folder):
    """The lines of one output file in their order."""
    read = _stream(spark, _lines(spark, folder))
    cfg = _config("page")
    made = job.run(read.documents, read.pages, cfg, read.orphans, read.invalid)
    path = scratch(spark, "chunks")
    jsonl.write_lines(made, cfg, path, CREATED, single_file=True)
    lines = jsonl.numbered_lines(spark, path, F.from_json("value", "record_type string, chunk_id string").alias("x"))
    return lines.select("pos", "x.record_type", "x.chunk_id")


def skip_order(spark, folder):
    """Skipped pages as the manifest lists them."""
    read = _stream(spark, _lines(spark, folder))
    cfg = _config("page")
    made = job.run(read.documents, read.pages, cfg, read.orphans, read.invalid)
    line = jsonl.manifest_line(spark, cfg, made.stats, made.skipped, made.documents, CREATED)
    kind = "skipped_pages array<struct<doc_id: string, page_index: long, reason: string>>"
    x = line.select(F.posexplode(F.from_json("value", kind)["skipped_pages"]).alias("pos", "s"))
    return x.select(F.col("pos").cast("long"), "s.doc_id", "s.page_index", "s.reason")


def lax_values(spark, folder):
    """Pages whose numbers come as strings and floats, and whose flags come as words and numbers."""
    n, number, ocr = F.col("line_no"), F.col("page_index").cast("string"), F.col("needs_ocr")
    index = (
        F.when(n % 4 == 1, F.concat(F.lit('" '), number, F.lit(' "')))
        .when(n % 4 == 2, F.concat(number, F.lit(".0")))
        .when(n % 4 == 3, F.concat(F.lit('"'), number, F.lit('.0"')))
        .otherwise(number)
    )
    flag = (
        F.when(n % 3 == 1, F.when(ocr, '"Yes"').otherwise('"off"')).when(n % 3 == 2, F.when(ocr, "1").otherwise("0.0")).otherwise(ocr.cast("string"))
    )
    head = F.to_json(F.struct("record_type", "doc_id", "page_label", "text"), {"ignoreNullFields": "false"})
    line = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"page_index":'), index, F.lit(',"needs_ocr":'), flag, F.lit("}"))
    pages = _table(spark, folder, "page_records").select("line_no", line.alias("value"))
    docs = _lines(spark, folder).filter(F.col("value").startswith('{"record_type":"document"'))
    read = _stream(spark, docs.unionByName(pages))
    return read.pages.select("doc_id", "page_index", "needs_ocr", F.col("seq").alias("stream_line"))


def repeated_pages(spark, folder):
    """Pages with all their deliveries, cut in page order and in it as they arrived."""
    documents, _, _ = _frames(spark, folder)
    rows = _table(spark, folder, "page_records").filter("doc_id IS NOT NULL AND page_index IS NOT NULL")
    pages = rows.join(documents.select("doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("doc_key"), "doc_id", F.col("line_no").alias("seq"), "page_index", "page_label", "text", "needs_ocr"
    )
    made = job.run(documents, pages, _config("page")).chunks
    return made.select("chunk_id", "doc_id", "chunk_index", F.col("spans")[0]["page_index"].alias("page_index"), "token_count")


def late_pages(spark, folder):
    """Documents that became whole, and pages that came after, of four files in line order."""
    from quirefold.streaming.assembly import CLOSING, closing, records

    base = scratch(spark, "late")
    lines = _lines(spark, folder)
    top = lines.agg(F.max("line_no") + 1).first()[0] or 1
    for k in range(4):
        part = lines.filter(F.expr(f"line_no * 4 div {top} = {k}"))
        part.orderBy("line_no").select("value").coalesce(1).write.text(f"{base}/in/{k}")
    query = (
        closing(records(spark, f"{base}/in/*", 1)).writeStream.format("parquet").outputMode("append")
        .option("path", f"{base}/events").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(CLOSING).parquet(f"{base}/events")


QUERIES = {
    "q01_page_chunks": page_chunks,
    "q02_word_offsets": word_offsets,
    "q03_token_count": token_count,
    "q04_fixed_tiles": fixed_tiles,
    "q05_fixed_sliding": fixed_sliding,
    "q06_fixed_cross_page": fixed_cross_page,
    "q07_paragraphs": paragraphs,
    "q08_sentence_spans": sentence_spans,
    "q08b_sentence_counts": sentence_counts,
    "q09_sentence_pack": sentence_pack,
    "q10_sentence_overlap": sentence_overlap,
    "q11_recursive": recursive,
    "q11b_recursive_cross_page": recursive_cross_page,
    "q12_section_index": section_index,
    "q12b_section_groups": section_groups,
    "q13_section_chunks": section_chunks,
    "q14_runt_merge": runt_merge,
    "q15_ocr_reasons": ocr_reasons,
    "q16_ocr_include": ocr_include,
    "q17_skipped_pages": skipped_pages,
    "q18_orphans": orphans,
    "q18b_positional_pages": positional_pages,
    "q19_run_stats": run_stats,
    "q20_source_doc_join": source_doc_join,
    "q21_chunk_ids": chunk_ids,
    "q22_jsonl_roundtrip": jsonl_roundtrip,
    "q23_manifest": manifest,
    "q24_invalid_lines": invalid_lines,
    "q25_file_tokenizer": file_tokenizer,
    "q26_dedup_page_sort": dedup_page_sort,
    "q27_streaming_assembly": streaming_assembly,
    "q28_views": views,
    "q29_unit_segments": unit_text_segments,
    "q30_unit_texts": unit_texts,
    "q31_token_windows": token_windows,
    "q32_range_spans": range_spans,
    "q33_rebuilt_texts": rebuilt_texts,
    "q34_default_sentences": default_sentences,
    "q35_learnt_abbreviations": learnt_abbreviations,
    "q36_strict_refusal": strict_refusal,
    "q37_scan_refusal": scan_refusal,
    "q38_single_file": single_file,
    "q39_skip_order": skip_order,
    "q40_late_pages": late_pages,
    "q41_lax_values": lax_values,
    "q42_repeated_pages": repeated_pages,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
