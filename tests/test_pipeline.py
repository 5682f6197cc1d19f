"""Streams of JSON lines, frames and outputs, end to end."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quirefold import cli, tool
from quirefold.config import ChunkingConfig, SegmentationError
from quirefold.functions import text as fx
from quirefold.functions.sentences import TrainedSplitter, train_splitter
from quirefold.functions.tokens import FileTokenizer, FunctionCounter, load, resolve
from quirefold.operators.merging import merge_runts
from quirefold.operators.numbering import running_before
from quirefold.operators.sections import section_paths
from quirefold.plans.catalog import word_level_tokenizer
from quirefold.plans.job import run
from quirefold.plans.stream_job import process, process_file, summary
from quirefold.schemas import DOCUMENTS, PAGES
from quirefold.sources.jsonl import numbered_lines, read_records
from quirefold.sources.records import Invalid, boolean, integer, read_line


def doc(doc_id="d1", pages=1, toc=(), **extra):
    return {"record_type": "document", "doc_id": doc_id, "source_path": f"/x/{doc_id}.pdf", "page_count": pages, "metadata": {"Title": doc_id.upper()}, "toc": list(toc)} | extra


def page(doc_id="d1", index=0, text="alpha beta", ocr=False, label=None, **extra):
    return {"record_type": "page", "doc_id": doc_id, "page_index": index, "page_label": label, "text": text, "needs_ocr": ocr} | extra


def entry(text, level, page_index):
    return {"text": text, "level": level, "page_index": page_index}


def config(strategy="page", **options):
    return ChunkingConfig(**{"strategy": strategy, "max_tokens": 50, "overlap": 0, "min_chunk_tokens": 1, "tokenizer_model": "word-counter"} | options)


@pytest.fixture
def stream(tmp_path):
    def write(*records, name="in.jsonl"):
        path = tmp_path / name
        path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in records) + "\n", encoding="utf-8")
        return str(path)

    return write


def results(made):
    stats, skipped = summary(made)
    rows = made.chunks.orderBy("doc_key", "chunk_index").collect()
    return rows, stats, [(s["doc_id"], s["page_index"], s["reason"]) for s in skipped]


def test_scan_policies(spark, stream):
    path = stream(doc(pages=2), page(text="real content"), page(index=1, text="x", ocr=True))
    rows, stats, skipped = results(process(spark, path, None, config()))
    assert len(rows) == 1 and skipped == [("d1", 1, "needs_ocr")]
    assert stats == {"documents_seen": 1, "pages_seen": 2, "pages_chunked": 1, "chunks_written": 1, "invalid_lines": 0}
    assert len(results(process(spark, path, None, config(on_ocr_needed="include")))[0]) == 2
    with pytest.raises(SegmentationError, match="d1.*page 1"):
        process(spark, path, None, config(on_ocr_needed="error"))


def test_positions_and_orphans(spark, stream):
    path = stream(doc("A"), page("A", 0, ocr=True), page("Z", 7), "", doc("B"), page("B"), page("A", 3))
    rows, stats, skipped = results(process(spark, path, None, config()))
    assert [r.chunk_id for r in rows] == ["B::c0000"]
    assert skipped == [("Z", 7, "invalid_record"), ("A", 0, "needs_ocr"), ("A", 3, "invalid_record")]
    assert stats["invalid_lines"] == 2 and stats["pages_seen"] == 2
    rows, stats, skipped = results(process(spark, stream(page("d99"), doc(), page()), None, config()))
    assert len(rows) == 1 and skipped == [("d99", 0, "invalid_record")]


def test_a_file_in_many_splits_keeps_its_order(spark, stream):
    records = []
    for i in range(60):
        records += [doc(f"d{i}", 3)] + [page(f"d{i}", j, f"page {i} {j} " + "w " * 40) for j in range(3)]
    path = stream(*records)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        read = read_records(spark, path)
        assert read.orphans.count() == 0 and read.documents.count() == 60
        assert sorted(r.seq for r in read.pages.collect()) == [i for i in range(1, 241) if i % 4 != 1]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bad_lines(spark, stream):
    path = stream(doc(), "{not json", {"record_type": "page", "doc_id": "d1"}, page())
    rows, stats, _ = results(process(spark, path, None, config()))
    assert len(rows) == 1 and stats["invalid_lines"] == 2
    with pytest.raises(SegmentationError, match="line 2"):
        process(spark, path, None, config(strict=True))


def test_closed_metadata_and_repeated_ids(spark, stream):
    rows, stats, skipped = results(process(spark, stream(doc(metadata={"Extra": "x"}), page()), None, config()))
    assert not rows and stats["invalid_lines"] == 2 and skipped == [("d1", 0, "invalid_record")]
    rows, stats, _ = results(process(spark, stream(doc(), page(), doc(), page()), None, config()))
    assert [r.chunk_id for r in rows] == ["d1::c0000"] * 2 and stats["documents_seen"] == 2


@pytest.mark.parametrize(
    ("value", "want"), [(3, 3), (3.0, 3), ("3", 3), (" 3 ", 3), ("3.0", 3), (True, 1), (3.5, None), (None, None), ("x", None), ("", None), ([1], None)]
)
def test_integers(value, want):
    if want is None:
        with pytest.raises(Invalid):
            integer(value, "x")
    else:
        assert integer(value, "x") == want


def test_lax_and_refused_lines():
    kind, record, _ = read_line(json.dumps(page(page_index="3", needs_ocr="yes", other=1)))
    assert kind == "page" and (record["page_index"], record["needs_ocr"]) == (3, True)
    for bad in ("[1]", "12", '{"record_type": "x"}', json.dumps(page(text=None)), json.dumps(page(needs_ocr=2)), json.dumps(page(index=-1)), json.dumps(doc(page_count=10**30)), '{"record_type": ["page"]}', json.dumps(doc(toc=[{"text": "a", "level": 0, "x": 1}]))):
        assert read_line(bad)[0] == "invalid", bad
    label = page()
    del label["page_label"]
    assert read_line(json.dumps(label))[0] == "invalid"
    assert boolean("TRUE", "x") is True and boolean(0.0, "x") is False


def frames(spark, docs, pages):
    d = spark.createDataFrame([(x["doc_id"], x["doc_id"], x["source_path"], x["page_count"], tuple([x["metadata"]["Title"]] + [""] * 7), [tuple(e.values()) for e in x["toc"]]) for x in docs], DOCUMENTS)
    p = spark.createDataFrame([(x["doc_id"], x["doc_id"], i, x["page_index"], x["page_label"], x["text"], x["needs_ocr"]) for i, x in enumerate(pages)], PAGES)
    return d, p


@pytest.mark.parametrize(
    ("toc", "pages", "want"),
    [
        ([("Ch 1", 0, 0), ("1.1", 1, 1), ("Ch 2", 0, 3)], 5, ["Ch 1", "Ch 1>1.1", "Ch 1>1.1", "Ch 2", "Ch 2"]),
        ([("Ch 1", 0, 2)], 4, ["", "", "Ch 1", "Ch 1"]),
        ([("Intro", 0, None), ("Ch 1", 0, 0)], 2, ["Ch 1", "Ch 1"]),
        ([("Top", 0, 0), ("Deep", 2, 1)], 2, ["Top", "Top>Deep"]),
        ([], 3, ["", "", ""]),
        ([("A", 0, 5), ("B", 0, 2)], 8, ["", "", "B", "B", "B", "B", "B", "B"]),
        ([("Ch 1", 0, 0), ("1.1", 1, 0)], 2, ["Ch 1>1.1", "Ch 1>1.1"]),
        ([("N", 0, -3)], 2, ["N", "N"]),
    ],
)
def test_outline(spark, toc, pages, want):
    d, p = frames(spark, [doc(pages=pages, toc=[entry(*e) for e in toc])], [page(index=i) for i in range(pages)])
    got = {r.page_index: ">".join(r.section_path) for r in section_paths(d, p).collect()}
    assert [got.get(i, "") for i in range(pages)] == want


def test_an_outline_over_a_huge_page_number(spark):
    d, p = frames(spark, [doc(pages=1, toc=[entry("A", 0, 0), entry("B", 0, 300)])], [page(index=i) for i in (0, 299, 300, 2_000_000_000)])
    assert {r.page_index: r.section_path for r in section_paths(d, p).collect()} == {0: ["A"], 299: ["A"], 300: ["B"], 2_000_000_000: ["B"]}


def test_a_callers_own_counter_and_splitter(spark):
    """A token for each letter, and sentences that end at semicolons."""
    letters = FunctionCounter(lambda t: sum(c.isalpha() for c in t), lambda t: [(i, i + 1) for i, c in enumerate(t) if c.isalpha()])
    halves = lambda t: [m.span() for m in re.finditer(r"[^; ][^;]*;?", t)]
    d, p = frames(spark, [doc()], [page(text="ab cd; ef; gh")])
    rows = run(d, p, config("sentence", max_tokens=6), tokenizer=letters, splitter=halves).chunks.orderBy("chunk_index").collect()
    assert [(r.text, r.token_count) for r in rows] == [("ab cd; ef;", 6), ("gh", 2)]
    rows = run(d, p, config("fixed-size", max_tokens=3), tokenizer=letters).chunks.orderBy("chunk_index").collect()
    assert [r.text for r in rows] == ["ab c", "d; ef", "gh"]
    with pytest.raises(ValueError):
        run(d, p, config(), splitter="none")
    with pytest.raises(TypeError):
        run(d, p, config(), tokenizer=len)
    with pytest.raises(ValueError):
        FunctionCounter(len).offsets("x")


def test_model_folder(tmp_path, monkeypatch):
    (tmp_path / "own" / "model").mkdir(parents=True)
    (tmp_path / "own" / "model" / "tokenizer.json").write_text(word_level_tokenizer())
    monkeypatch.setenv("QUIREFOLD_TOKENIZERS", str(tmp_path))
    assert load(resolve("own/model")).count("a b") == 2


def test_learnt_abbreviations(spark):
    """Words nearly always followed by a stop are learnt in any language, common ends of sentences are not."""
    rng = random.Random(2)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)]
    texts = []
    for _ in range(400):
        body = " ".join(rng.choice(words) for _ in range(8))
        texts.append(f"Kade {body} prof. Lund {body}. Kade zzgl. {body} u.a. {rng.choice(words)} {body}.")
    texts += ["", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    model = train_splitter(rows)
    assert {"prof", "zzgl", "u.a"} <= model.abbreviations and not set(words) & model.abbreviations
    assert "kade" in model.starters
    text = "He met prof. Lund there. Kade left. It is zzgl. Kade again."
    assert [text[a:b] for a, b in model(text)] == ["He met prof. Lund there.", "Kade left.", "It is zzgl.", "Kade again."]
    assert TrainedSplitter.from_json(model.to_json()) == model
    assert train_splitter(rows.limit(0)) == TrainedSplitter(frozenset(), frozenset())


def test_contract_and_paths(spark, stream):
    text = "one two three. four five."
    path = stream(doc(pages=3, toc=[entry("Ch 1", 0, 0)]), page(text=text), page(index=1, text="a b c d. e f."), page(index=2, ocr=True))
    rows, stats, _ = results(process(spark, path, None, config("recursive", max_tokens=4, overlap=1, min_chunk_tokens=2), splitter="marks"))
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert all(r.section_path == ["Ch 1"] and r.source_doc.title == "D1" for r in rows)
    texts = {0: text, 1: "a b c d. e f."}
    for r in rows:
        assert r.text == "".join(texts[s.page_index][s.char_start : s.char_end] for s in r.spans)


def test_repeated_page_numbers_merge_with_the_last_text(spark):
    d, p = frames(spark, [doc(pages=1)], [page(text="a b c d"), page(text="e f")])
    made = run(d, p, config(min_chunk_tokens=3, max_tokens=10))
    (row,) = made.chunks.collect()
    assert [(s.page_index, s.char_start, s.char_end) for s in row.spans] == [(0, 0, 7)]
    assert row.text == "e f"


def test_whole_pages_need_no_python(spark):
    """The same rows as through the kernels, which a counter object of the same results goes to."""
    texts = ["a b\x1cc", "été 😀", "  x ", "\u3000", "one\n\ntwo"]
    d, p = frames(spark, [doc(pages=5)], [page(index=i, text=t, label=str(i)) for i, t in enumerate(texts)])
    words = load("word-counter")
    rows = [sorted(map(str, run(d, p, config(min_chunk_tokens=3), tokenizer=t).chunks.collect())) for t in (None, words)]
    assert rows[0] == rows[1] and len(rows[0]) == 4


def test_wide_ids_and_one_hot_document(spark):
    d, p = frames(spark, [doc(pages=10_001), doc("d2", 1)], [page(index=i, text="w") for i in range(10_001)] + [page("d2")])
    made = run(d, p, config())
    ids = {r.chunk_id for r in made.chunks.select("chunk_id").collect()}
    assert "d1::c10000" in ids and "d1::c0007" in ids and "d2::c0000" in ids and len(ids) == 10_002


def test_running_sums_by_blocks(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randint(0, 5)) for g in "ab" for i in rng.sample(range(-50, 400), 90)] + [("c", 3, None)]
    got = running_before(spark.createDataFrame(rows, "g string, i long, n long"), ["g"], "i", "n", "before", block=16).collect()
    for r in got:
        assert r.before == sum(n or 0 for g, i, n in rows if g == r.g and i < r.i)


def test_word_level_file_equals_the_word_counter(spark):
    tokenizer = load(resolve(word_level_tokenizer()))
    assert isinstance(tokenizer, FileTokenizer) and tokenizer.count("") == 0 and tokenizer.offsets("alpha beta") == [(0, 5), (6, 10)]
    texts = ["one two three. four five six. seven", "a b c\n\nd e f g h i j k l m"]
    d, p = frames(spark, [doc(pages=2)], [page(index=i, text=t) for i, t in enumerate(texts)])
    for strategy in ("fixed-size", "sentence", "recursive"):
        for cross in (False, True):
            cfg = config(strategy, max_tokens=4, overlap=1, min_chunk_tokens=2, cross_page=cross)
            rows = [sorted(map(str, run(d, p, cfg, tokenizer=t).chunks.drop("tokenizer_model").collect())) for t in (None, word_level_tokenizer())]
            assert rows[0] == rows[1]
    with pytest.raises(FileNotFoundError):
        resolve("no/such-model")


def test_results_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    d, p = frames(spark, [doc(f"d{i}", 4) for i in range(6)], [page(f"d{i}", j, " ".join(["word."] * rng.randint(0, 30))) for i in range(6) for j in range(4)])
    cfg = config("recursive", max_tokens=9, min_chunk_tokens=3, cross_page=True)
    one = sorted(map(str, run(d, p, cfg).chunks.collect()))
    assert one == sorted(map(str, run(d.repartition(3), p.repartition(5), cfg).chunks.collect())) and one


def test_nulls_and_clashing_columns(spark):
    d, p = frames(spark, [doc(pages=3)], [page(index=i) for i in range(3)])
    more = {n: F.lit(1) for n in ("reason", "usable", "section_path", "position", "_n", "chunk_index", "x")}
    p = p.withColumns({"text": F.when(F.col("page_index") != 1, F.col("text")), "needs_ocr": F.lit(None).cast("boolean")}).withColumns(more)
    d = d.withColumns({"toc": F.lit(None).cast(d.schema["toc"].dataType), "metadata": F.lit(None).cast(d.schema["metadata"].dataType)} | more)
    for cross in (False, True):
        made = run(d, p, config("recursive", cross_page=cross))
        assert made.chunks.count() == (1 if cross else 2)
        assert [tuple(r) for r in made.skipped.select("page_index", "reason").collect()] == [(1, "empty_text")]
        assert made.chunks.first().source_doc.title == ""


def test_empty_frames(spark):
    d, p = frames(spark, [], [])
    for cross in (False, True):
        made = run(d, p, config("section", cross_page=cross))
        assert made.chunks.count() == 0
        assert made.stats.first().asDict() == dict.fromkeys(("documents_seen", "pages_seen", "pages_chunked", "chunks_written", "invalid_lines"), 0)


def test_output_file(spark, stream, tmp_path):
    path, out = stream(doc(pages=2), page(text="été 😀"), page(index=1, ocr=True)), str(tmp_path / "out.jsonl")
    process_file(spark, path, out, config(), created_at="2024-01-01T00:00:00+00:00")
    lines = open(out, encoding="utf-8").read().splitlines()
    chunk, last = json.loads(lines[0]), json.loads(lines[-1])
    assert len(lines) == 2 and list(chunk)[:3] == ["record_type", "schema_version", "chunk_id"] and "été 😀" in lines[0]
    assert chunk["spans"] == [{"page_index": 0, "page_label": None, "char_start": 0, "char_end": 5}]
    assert last["record_type"] == "manifest" and last["stats"]["chunks_written"] == 1
    assert last["skipped_pages"] == [{"doc_id": "d1", "page_index": 1, "reason": "needs_ocr"}]
    first = open(out, "rb").read()
    process_file(spark, path, out, config(), created_at="2024-01-01T00:00:00+00:00")
    assert open(out, "rb").read() == first


def test_command_line(spark, stream, tmp_path, capsys, monkeypatch):
    ns = cli.parser().parse_args([])
    assert (ns.strategy, ns.max_tokens, ns.overlap, ns.min_chunk_tokens) == ("recursive", 512, 64, 20)
    for bad in (["--strategy", "x"], ["--max-tokens", "0"], ["--overlap", "-1"]):
        with pytest.raises(SystemExit) as e:
            cli.main(bad)
        assert e.value.code == 2
    assert cli.main(["--max-tokens", "10"]) == 2
    path, out = stream(doc(), page()), str(tmp_path / "o.jsonl")
    args = ["--tokenizer-model", "word-counter", "--strategy", "page"]
    assert cli.main([path, "-o", out, *args], spark) == 0
    assert json.loads(open(out).read().splitlines()[-1])["record_type"] == "manifest"
    with open(path) as f:
        monkeypatch.setattr("sys.stdin", f)
        assert cli.main(args, spark) == 0
    assert '"manifest"' in capsys.readouterr().out
    assert cli.main([stream("{", name="bad.jsonl"), "-o", out, "--strict", *args], spark) == 1
    assert cli.main([path, "-o", out, "--tokenizer-model", "no/such"], spark) == 1


def test_tool(spark, stream, tmp_path):
    properties = tool.TOOL_SPEC["input_schema"]["properties"]
    assert len(properties) == 9 and "strict" not in properties and properties["max_tokens"]["default"] == 512
    good = {"input_path": stream(doc(), page()), "output_path": str(tmp_path / "o.jsonl"), "tokenizer_model": "word-counter", "unknown": 1}
    got = tool.run_tool(good, spark)
    assert got["ok"] and got["chunks_written"] == 1 and got["pages_skipped"] == []
    some = tool.run_tool(good | {"input_path": stream(doc(pages=2), page(), page(index=1, ocr=True), name="ocr.jsonl")}, spark)
    assert some["pages_skipped"] == [{"doc_id": "d1", "page_index": 1, "reason": "needs_ocr"}]
    assert tool.run_tool({"output_path": "x"}, spark)["ok"] is False
    assert tool.run_tool(good | {"max_tokens": 3}, spark)["ok"] is False
    assert tool.run_tool(good | {"input_path": str(tmp_path / "none.jsonl")}, spark)["ok"] is False


def test_settings():
    for bad in (dict(strategy="x"), dict(max_tokens=0), dict(overlap=512), dict(min_chunk_tokens=512), dict(on_ocr_needed="x"), dict(max_tokens=True)):
        with pytest.raises(ValueError):
            ChunkingConfig(**bad)


def test_white_space_columns(spark):
    texts = ["a\x1cb", "　x y ", "\xa0\x85", "", None, "p. q! r"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", "t", fx.word_count(F.col("t")).alias("n"), fx.is_blank(F.col("t")).alias("b"), fx.strip(F.col("t")).alias("s"), fx.sentence_pieces(F.col("t")).alias("p")).collect()
    for r in got:
        if r.t is None:
            assert r.n is None and r.b is None
        else:
            assert (r.n, r.b, r.s) == (len(r.t.split()), not r.t.strip(), r.t.strip())
    assert got[5].p == ["p.", "q!", "r"] and got[2].p == []


@pytest.mark.parametrize("cross", [False, True])
def test_merging_frames_equals_merging_in_a_run(spark, cross):
    rng = random.Random(9)
    d, p = frames(
        spark,
        [doc(f"d{i}", 5, toc=[entry("A", 0, 0), entry("B", 0, 3)]) for i in range(5)],
        [page(f"d{i}", j, "\n\n".join(" ".join(["w"] * rng.randint(1, 9)) for _ in range(rng.randint(1, 5)))) for i in range(5) for j in range(5)],
    )
    cut = run(d, p, config("recursive", max_tokens=10, min_chunk_tokens=0, cross_page=cross)).chunks
    merged = merge_runts(cut, p, config("recursive", max_tokens=10, min_chunk_tokens=4, cross_page=cross))
    want = run(d, p, config("recursive", max_tokens=10, min_chunk_tokens=4, cross_page=cross)).chunks
    columns = ["doc_key", "text", "token_count", "spans", "section_path"]
    got = sorted(merged.collect(), key=lambda r: (r.doc_key, r.chunk_index))
    assert [[r[c] for c in columns] for r in got] == [[r[c] for c in columns] for r in want.orderBy("doc_key", "chunk_index").collect()]
    assert 0 < merged.count() < cut.count() and merge_runts(cut.limit(0), p, config()).count() == 0


def test_views(spark):
    d, p = frames(spark, [doc(pages=1)], [page()])
    run(d, p, config()).register("t_")
    assert spark.sql("SELECT c.doc_id, s.char_end FROM t_chunks c JOIN t_spans s USING (chunk_id)").first().char_end == 10


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    rng = random.Random(4)
    files = [["x" * rng.randint(0, 90) if i % 5 else "" for i in range(n)] for n in (400, 1, 37)]
    for k, lines in enumerate(files):
        (tmp_path / f"{k}.txt").write_text("".join(f"{k}:{i}:{x}\n" if x else "\n" for i, x in enumerate(lines)))
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = [tuple(r) for r in numbered_lines(spark, str(tmp_path), F.col("value")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    assert sorted(got) == sorted((i, f"{k}:{i}:{x}" if x else "") for k, lines in enumerate(files) for i, x in enumerate(lines))
