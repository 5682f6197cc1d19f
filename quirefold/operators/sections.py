"""Section paths of pages from a document's outline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Page numbers that share a block: for ranges that meet pages, and for runs of pages.
BLOCK, RUN_BLOCK = 256, 4096


def transitions(toc) -> F.Column:
    """For each outline entry with a page: (page_index, path of its ancestors and itself).

    An entry's ancestors are the nearest earlier ones of smaller level.
    """
    known = F.filter(toc, lambda e: e["page_index"].isNotNull())
    empty = F.struct(
        F.array().cast("array<struct<text:string,level:bigint>>").alias("stack"),
        F.array().cast("array<struct<start:bigint,path:array<string>>>").alias("found"),
    )

    def step(state, entry):
        stack = F.concat(
            F.filter(state["stack"], lambda x: x["level"] < entry["level"]),
            F.array(F.struct(entry["text"].alias("text"), entry["level"].alias("level"))),
        )
        here = F.struct(entry["page_index"].alias("start"), F.transform(stack, lambda x: x["text"]).alias("path"))
        return F.struct(stack.alias("stack"), F.concat(state["found"], F.array(here)).alias("found"))

    return F.aggregate(known, empty, step)["found"]


def section_paths(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_key, page_index, section_path) for every page that lies in a section.

    Entry i holds the pages from its own to the next entry's, the last one those to
    the document's end. Where ranges meet, the later entry wins; a range that runs
    backwards is empty; negative starts begin at page 0. A document without pages
    by its own count, or with a null or empty outline, has none. Ranges meet the
    blocks of page numbers that exist, then the pages of each block; the join is on
    (document, block), so a large document is no hot key, and however large a page
    number is, nothing is expanded.
    """
    last = pages.groupBy("doc_key").agg((F.max("page_index") + 1).alias("pages"))
    toc = documents.filter(F.size("toc") > 0).select("doc_key", "page_count", transitions(F.col("toc")).alias("entries"))
    upper = F.greatest(F.coalesce("page_count", F.lit(0)), F.col("pages"))
    entry = F.col("entries")
    ranges = (
        toc.join(last, "doc_key")
        .withColumn("upper", upper)
        .select("doc_key", "upper", "pages", entry, F.posexplode("entries").alias("i", "x"))
        .withColumn("start", F.greatest(F.col("x.start"), F.lit(0)))
        .withColumn("end", F.coalesce(F.try_element_at("entries", F.col("i") + 2)["start"], F.col("upper")))
        .withColumn("end", F.least("end", "pages"))
        .filter("start < end")
    )
    at = F.floor(F.col("page_index") / BLOCK)
    numbers = pages.select("doc_key", "page_index").distinct().withColumn("block", at)
    held = numbers.select("doc_key", "block").distinct()
    inside = (
        ranges.select("doc_key", "i", F.col("x.path").alias("path"), "start", "end")
        .join(held, "doc_key")
        .filter((F.col("start") < (F.col("block") + 1) * BLOCK) & (F.col("end") > F.col("block") * BLOCK))
    )
    return (
        numbers.join(inside, ["doc_key", "block"])
        .filter((F.col("start") <= F.col("page_index")) & (F.col("page_index") < F.col("end")))
        .groupBy("doc_key", "page_index")
        .agg(F.max_by("path", "i").alias("section_path"))
    )


def path_groups(pages: DataFrame) -> DataFrame:
    """Number the runs of neighbouring pages with an equal path (column ``section_no``).

    Pages are numbered inside blocks of page numbers; a document's blocks, one row
    each, pass on the last path and the count so far. No task sees a whole large
    document.
    """
    own = pages.withColumn("_path", F.coalesce("section_path", F.array().cast("array<string>"))).withColumn("_block", F.floor(F.col("page_index") / RUN_BLOCK))
    order = Window.partitionBy("doc_key", "_block").orderBy("page_index", "seq")
    inside = (
        own.withColumn("_first", F.row_number().over(order) == 1)
        .withColumn("_new", F.when(F.lag("_path").over(order).eqNullSafe(F.col("_path")) | F.col("_first"), 0).otherwise(1))
        .withColumn("_so_far", F.sum("_new").over(order))
    )
    at = F.struct("page_index", "seq")
    blocks = inside.groupBy("doc_key", "_block").agg(F.min_by("_path", at).alias("_head"), F.max_by("_path", at).alias("_tail"), F.sum("_new").alias("_runs"))
    by_block = Window.partitionBy("doc_key").orderBy("_block")
    begins = blocks.withColumn("_own", F.when(F.lag("_tail").over(by_block).eqNullSafe(F.col("_head")), 0).otherwise(1))
    # runs that begin in earlier blocks, and whether one begins with this block
    before = F.sum(F.col("_own") + F.col("_runs")).over(by_block) - F.col("_runs")
    numbered = begins.select("doc_key", "_block", before.alias("_before"))
    return (
        inside.join(numbered, ["doc_key", "_block"])
        .withColumn("section_no", F.col("_before") + F.col("_so_far") - 1)
        .drop("_path", "_block", "_first", "_new", "_so_far", "_before")
    )
