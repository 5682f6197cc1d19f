import json
import os
import time

from quirefold.streaming.assembly import CLOSING, closing, records, run_available
from tests.test_pipeline import config, doc, page


def put(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n", encoding="utf-8")


def test_files_that_arrive_in_turn(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    put(source, "1.jsonl", [doc("a", 2), page("a", 0), page("z", 4), {"record_type": "x"}])
    made = run_available(spark, str(source), out, state, config())
    assert made.stats.first().chunks_written == 1
    put(source, "2.jsonl", [page("a", 1, "gamma"), page("a", 0), doc("b", 1), page("b", 0, ocr=True)])
    made = run_available(spark, str(source), out, state, config())
    stats = made.stats.first().asDict()
    assert stats == {"documents_seen": 2, "pages_seen": 3, "pages_chunked": 2, "chunks_written": 2, "invalid_lines": 2}
    assert sorted(r.chunk_id for r in spark.read.parquet(f"{out}/chunks").collect()) == ["a::c0000", "a::c0001"]
    assert json.loads(spark.read.text(f"{out}/manifest").first().value)["stats"] == stats


def test_the_first_of_repeated_records_stays(spark, tmp_path):
    """As with tables: neither the largest page count nor the smallest text decides."""
    source = tmp_path / "in"
    source.mkdir()
    put(source, "1.jsonl", [doc("a", 1, source_path="/first"), doc("a", 9, source_path="/second"), page("a", 0, "zeta"), page("a", 0, "alpha")])
    put(source, "2.jsonl", [doc("a", 12, source_path="/third"), page("a", 0, "aaa")])
    made = run_available(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state"), config())
    (row,) = made.chunks.collect()
    assert (row.text, row.source_doc.source_path) == ("zeta", "/first")


def test_only_documents_with_new_records_are_cut_again(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    put(source, "1.jsonl", [x for i in range(20) for x in (doc(f"d{i}", 2), page(f"d{i}", 0, "one two"))])
    run_available(spark, str(source), out, state, config())
    before = {(f.parent.name, f.name): f.stat().st_mtime_ns for f in (tmp_path / "out" / "chunks").rglob("part-*")}
    put(source, "2.jsonl", [page("d3", 1, "three"), page("d3", 0, "later text")])
    made = run_available(spark, str(source), out, state, config())
    after = {(f.parent.name, f.name): f.stat().st_mtime_ns for f in (tmp_path / "out" / "chunks").rglob("part-*")}
    assert len(before) > 10 and len(set(before) - set(after)) == 1  # the bucket of d3 alone was replaced
    assert made.stats.first().chunks_written == 21 and made.chunks.count() == 21
    assert {r.text for r in made.chunks.filter("doc_id = 'd3'").collect()} == {"one two", "three"}
    assert run_available(spark, str(source), out, state, config()).chunks.count() == 21  # nothing new
    assert run_available(spark, str(source), out, state, config("fixed-size", max_tokens=1, min_chunk_tokens=0)).chunks.count() == 41  # other settings


def test_a_document_that_comes_after_its_page(spark, tmp_path):
    """The page is skipped as an orphan at first and not any more when its document is there."""
    source = tmp_path / "in"
    source.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    put(source, "1.jsonl", [page("z", 0), doc("a"), page("a", 0)])
    made = run_available(spark, str(source), out, state, config())
    assert [(r.doc_id, r.reason) for r in made.skipped.collect()] == [("z", "invalid_record")]
    put(source, "2.jsonl", [doc("z")])
    made = run_available(spark, str(source), out, state, config())
    assert made.skipped.count() == 0 and made.stats.first().invalid_lines == 0
    assert sorted(r.chunk_id for r in made.chunks.collect()) == ["a::c0000", "z::c0000"]


def test_closing_and_late_pages(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def drain():
        query = (
            closing(records(spark, str(source), 1)).writeStream.format("parquet").outputMode("append")
            .option("path", str(tmp_path / "events")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return [(r.doc_id, r.event, r.page_index) for r in spark.read.schema(CLOSING).parquet(str(tmp_path / "events")).collect()]

    put(source, "1.jsonl", [page("a", 0), doc("a", 2), doc("b", 5), page("b", 1)])
    assert drain() == []
    put(source, "2.jsonl", [page("a", 1), page("a", 1)])
    os.utime(source / "2.jsonl", (time.time() + 5, time.time() + 5))
    put(source, "3.jsonl", [page("a", 7), page("b", 2)])
    os.utime(source / "3.jsonl", (time.time() + 10, time.time() + 10))
    events = drain()
    assert [e for e in events if e[1] == "closed"] == [("a", "closed", None)]
    assert ("a", "late", 7) in events and not any(e[0] == "b" for e in events)
