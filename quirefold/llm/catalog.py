"""The registered queries of the training-text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.constants import NON_WS
from quirefold.llm.common import table
from quirefold.llm import garbled as garbled8
from quirefold.llm import lookalikes as looks3
from quirefold.llm import mixing as mixing7
from quirefold.llm import near_dup as near1
from quirefold.llm import packing as packing6
from quirefold.llm import repeated_lines as lines4
from quirefold.llm import sentences as sentences5
from quirefold.llm import split as split2
from quirefold.llm import sql
from quirefold.llm import tokens
from quirefold.llm import unmarked as unmarked5
from quirefold.session import staged


#: The comparison that the test data state: three words and 0.5 for chunks of at
#: least 30 words, three characters and 0.6 for source paths.
STATED_KINDS = (near1.Kind("chunk", "word", 3, 0.5, 30), near1.Kind("path", "char", 3, 0.6))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunk_records").select(
        F.lit(0).alias("kind"), F.col("chunk_id").alias("id"), F.col("chunk_no").alias("row_no"), "text"
    )
    paths = table(spark, folder, "document_records").select(
        F.lit(1).alias("kind"), F.col("doc_id").alias("id"), F.col("line_no").alias("row_no"), F.col("source_path").alias("text")
    )
    return chunks.unionByName(paths)


def _kind_name():
    return F.element_at(F.array(*(F.lit(k.name) for k in STATED_KINDS)), F.col("kind") + 1)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    links = near1.similar_records(_records(spark, folder), STATED_KINDS)
    return near1.id_pairs(links).select(_kind_name().alias("kind"), "id_a", "id_b")


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    links = near1.similar_records(_records(spark, folder), STATED_KINDS)
    return near1.classes(links).withColumn("kind", _kind_name())


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    rows = split2.page_rows(table(spark, folder, "page_records")).unionByName(
        split2.chunk_rows(table(spark, folder, "chunk_records"))
    )
    return split2.split_oversized(rows, split2.read_limits(table(spark, folder, "split_limits")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_pieces(spark, folder).filter("piece_index = 0").select("kind", "row_key")


def p2_audit(spark: SparkSession, folder: str) -> DataFrame:
    """One row a kind: the rows that were divided, and how many pieces break a rule (none)."""
    limits = table(spark, folder, "split_limits")
    cut = staged(p2_pieces(spark, folder))
    whole = split2.page_rows(table(spark, folder, "page_records")).unionByName(split2.chunk_rows(table(spark, folder, "chunk_records")))
    order = Window.partitionBy("kind", "row_key").orderBy("piece_index")
    words = lambda x: F.regexp_count(x, F.lit(f"{NON_WS}+"))
    between = lambda a, b: F.substring(F.col("whole"), a + 1, b - a)
    rows = (
        cut.join(whole.select("kind", "row_key", F.col("text").alias("whole")), ["kind", "row_key"])
        .join(F.broadcast(limits), F.col("record_kind") == F.col("kind"))  # two rows
        .withColumn("before", F.lag("char_end").over(order))
        .withColumn("last", F.lead("char_end").over(order).isNull())
        .withColumn("sizes", F.aggregate("spans", F.lit(0).cast("long"), lambda x, y: x + y["char_end"] - y["char_start"]))
        .withColumn("gap", between(F.coalesce(F.least("before", "char_start"), F.lit(0)).cast("int"), F.col("char_start").cast("int")))
        .withColumn("tail", F.when(F.col("last"), between(F.col("char_end").cast("int"), F.length("whole"))).otherwise(""))
        .withColumn("shared", F.when(F.col("before") > F.col("char_start"), words(between(F.col("char_start").cast("int"), F.col("before").cast("int")))))
    )
    n = lambda x, name: F.count_if(x).alias(name)
    return rows.groupBy("kind").agg(
        F.count_distinct("row_key").alias("divided"),
        n(words("text") > F.col("max_words"), "too_many_words"),
        n(F.length("text") > F.col("max_chars"), "too_long"),
        n(words("text") != F.col("token_count"), "wrong_count"),
        n(F.col("text") != between(F.col("char_start").cast("int"), F.col("char_end").cast("int")), "wrong_text"),
        n(F.col("gap").rlike(NON_WS) | F.col("tail").rlike(NON_WS), "left_out"),
        n(F.col("shared") > F.col("overlap_words"), "shared_too_much"),
        n(F.col("sizes") + 2 * (F.size("spans") - 1) != F.length("text"), "wrong_spans"),
    )


def p3_one_form(spark: SparkSession, folder: str) -> DataFrame:
    rows = looks3.page_and_toc_texts(table(spark, folder, "page_records"), table(spark, folder, "document_records"))
    return looks3.one_form(rows)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    # words wholly in another script are respelled, too, but are no cases
    cases = F.size(F.array_remove("forms", "whole_script")) > 0
    return p3_one_form(spark, folder).filter(cases).select("kind", "line_no", "toc_pos")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = lines4.repeated_lines(table(spark, folder, "page_records"))
    return found.select(F.col("row_id").alias("line_no"), F.col("pos").cast("long").alias("line_pos"))


def p4_clean_pages(spark: SparkSession, folder: str) -> DataFrame:
    clean = lines4.without_repeated_lines(table(spark, folder, "page_records"))
    return clean.withColumnRenamed("row_id", "line_no")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return split2.page_rows(table(spark, folder, "page_records")).select("kind", "row_key", "text").unionByName(
        split2.chunk_rows(table(spark, folder, "chunk_records")).select("kind", "row_key", "text")
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences5.sentences(_texts(spark, folder)).select("kind", "row_key", "char_end")


def p5_between_words(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences where blocks without end marks are cut between words."""
    return unmarked5.sentences_between_words(_texts(spark, folder)).select("kind", "row_key", "char_end")


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("item_id"), "text")
    return staged(tokens.with_sizes(rows))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    capacities = packing6.read_capacities(table(spark, folder, "container_sizes"))
    packed = packing6.pack_items(_sizes(spark, folder), capacities)
    return packed.withColumn("item_id", F.col("item_id").cast("long")).withColumnRenamed("item_id", "doc_id")


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    capacities = packing6.read_capacities(table(spark, folder, "container_sizes"))
    return packing6.fill_report(packing6.pack_items(_sizes(spark, folder), capacities), capacities)


def p6_audit(spark: SparkSession, folder: str) -> DataFrame:
    """One row a kind: containers over capacity, tokens and items out of place (none), and whether the fill is high."""
    sizes = table(spark, folder, "container_sizes")
    items = _sizes(spark, folder).filter("n_tokens > 0")
    packed = staged(packing6.pack_items(items, packing6.read_capacities(sizes)))
    bins = packed.groupBy("container_kind", "container").agg(F.sum("tokens").alias("tokens"))
    kinds = F.broadcast(sizes)
    by_bin = bins.join(kinds, "container_kind").groupBy("container_kind").agg(
        F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("over_full"),
        (F.count("*") <= F.sum("tokens") / (0.95 * F.first("capacity_tokens")) + 1).alias("well_filled"),
    )
    total = items.agg(F.sum("n_tokens").alias("all_tokens"), F.count("*").alias("all_items"))
    by_item = (
        packed.groupBy("container_kind", "item_id").agg(F.count("*").alias("pieces"), F.count_distinct("piece").alias("distinct"), F.sum("tokens").alias("tokens"))
        .join(kinds, "container_kind")
        .groupBy("container_kind")
        .agg(
            F.sum("tokens").alias("placed"), F.count("*").alias("items"), F.count_if(F.col("pieces") != F.col("distinct")).alias("twice"),
            F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("needlessly_divided"),
        )
        .crossJoin(F.broadcast(total))  # one row
    )
    return by_bin.join(by_item, "container_kind").select(
        "container_kind", "over_full", "well_filled", "twice", "needlessly_divided",
        (F.col("all_tokens") - F.col("placed")).alias("lost_tokens"), (F.col("all_items") - F.col("items")).alias("lost_items"),
    )


def _sourced(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "source", F.xxhash64("text").alias("text_key"), "text")
    return staged(tokens.with_sizes(rows))


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    return mixing7.select_documents(_sourced(spark, folder), mixing7.read_targets(table(spark, folder, "source_targets")))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = mixing7.read_targets(table(spark, folder, "source_targets"))
    return mixing7.share_report(mixing7.select_documents(_sourced(spark, folder), targets), targets)


def p7_audit(spark: SparkSession, folder: str) -> DataFrame:
    """One row a mix: sources that miss their share by more than the largest documents, and documents used too often (none)."""
    targets = mixing7.read_targets(table(spark, folder, "source_targets"))
    sourced = _sourced(spark, folder)
    chosen = staged(mixing7.select_documents(sourced, targets))
    report = mixing7.share_report(chosen, targets)
    present = F.broadcast(sourced.filter("n_tokens > 0").groupBy("source").agg(F.max("n_tokens").alias("largest")))
    whole = Window.partitionBy("mix_name")
    due = F.col("target_share") / F.sum(F.when(F.col("largest").isNotNull(), F.col("target_share"))).over(whole)
    rows = (
        report.join(present, "source", "left")
        .withColumn("due", F.when(F.col("largest").isNotNull(), due).otherwise(0.0))
        .withColumn("total", F.sum("tokens").over(whole))
        .withColumn("room", 8.0 * F.max("largest").over(whole) / F.col("total"))
    )
    own = sourced.select("doc_id", F.col("source").alias("of"))
    wrong = chosen.join(own, "doc_id").groupBy("mix_name").agg(F.count_if(F.col("of") != F.col("source")).alias("wrong_source"))
    twice = chosen.groupBy("mix_name", "source", "doc_id").count().groupBy("mix_name").agg(F.count_if(F.col("count") > 1).alias("listed_twice"))
    return (
        rows.groupBy("mix_name")
        .agg(
            F.count("*").alias("sources"),
            F.count_if(F.col("most_uses") > F.col("max_repeats")).alias("used_too_often"),
            F.count_if(F.abs(F.col("share") - F.col("due")) > F.col("room")).alias("off_share"),
        )
        .join(wrong, "mix_name")
        .join(twice, "mix_name")
    )


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("row_id"), "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled8.ungarbled(_documents(spark, folder)).filter("garbled").select(F.col("row_id").alias("doc_id"))


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    return garbled8.ungarbled(_documents(spark, folder)).withColumnRenamed("row_id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_classes": p1_classes, "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_audit": p2_audit, "p3_found": p3_found, "p3_one_form": p3_one_form, "p4_found": p4_found, "p4_clean_pages": p4_clean_pages, "p5_found": p5_found, "p5_between_words": p5_between_words, "p6_containers": p6_containers, "p6_fill": p6_fill, "p6_audit": p6_audit, "p7_selection": p7_selection, "p7_shares": p7_shares, "p7_audit": p7_audit, "p8_found": p8_found, "p8_restored": p8_restored}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
