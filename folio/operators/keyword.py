"""Keyword search: in one document (summary and units with snippets) and across a corpus (occurrences with context)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import context, keyword_pattern, matches, sentence_breaks, snippet, tidy_match


def units(paragraphs: DataFrame, pages: DataFrame) -> DataFrame:
    """The paragraphs of documents that have any, else their pages: doc_id, unit_ord, page, paragraph_index, text."""
    own = paragraphs.select("doc_id", F.col("index").alias("unit_ord"), "page", F.col("index").alias("paragraph_index"), "text")
    rest = pages.join(paragraphs.select("doc_id").distinct(), "doc_id", "left_anti")
    rest = rest.select("doc_id", F.col("number").alias("unit_ord"), F.col("number").alias("page"), F.lit(None).cast("int").alias("paragraph_index"), "text")
    return own.unionByName(rest)


def line_units(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as one page each, a paragraph for every line (numbers count blank lines)."""
    lines = documents.select(F.col(key).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("unit_ord", "text"))
    return lines.select("doc_id", "unit_ord", F.lit(1).alias("page"), F.col("unit_ord").alias("paragraph_index"), "text")


def page_units(turns: DataFrame, key: str, number: str, text: str = "text") -> DataFrame:
    """Rows of (key, number from 0, text) as pages without paragraphs."""
    page = (F.col(number) + 1).cast("int")
    return turns.select(F.col(key).alias("doc_id"), page.alias("unit_ord"), page.alias("page"), F.lit(None).cast("int").alias("paragraph_index"), F.col(text).alias("text"))


def unit_hits(unit: DataFrame, keyword: str) -> DataFrame:
    """Units that hold the keyword: occurrences (matches do not overlap) and the snippet of the first."""
    pattern = keyword_pattern(keyword)
    head = F.element_at(F.split("text", pattern, 2), 1)
    first = F.regexp_extract("text", pattern, 0)
    return unit.filter(F.col("text").rlike(pattern)).select(
        "doc_id",
        "unit_ord",
        "page",
        "paragraph_index",
        F.regexp_count("text", F.lit(pattern)).cast("long").alias("occurrences"),
        snippet(F.col("text"), F.length(head), F.length(first)).alias("snippet"),
    )


def lexical_summary(hits: DataFrame) -> DataFrame:
    """Per document with hits: all occurrences, the distinct pages in order, and the first unit's snippet."""
    return hits.groupBy("doc_id").agg(
        F.sum("occurrences").alias("occurrences"),
        F.array_sort(F.collect_set("page")).alias("pages"),
        F.min_by("snippet", "unit_ord").alias("snippet"),
        F.count(F.lit(1)).alias("n_units"),
    )


def occurrences(unit: DataFrame, keyword: str) -> DataFrame:
    """A row for every occurrence in the corpus, numbered from 1 in the reading order of its document."""
    pattern = keyword_pattern(keyword, hyphenated=True)
    hits = unit.filter(F.col("text").rlike(pattern)).withColumn("breaks", sentence_breaks(F.col("text")))
    hits = hits.withColumn("m", F.explode(matches(F.col("text"), pattern)))
    order = Window.partitionBy("doc_id").orderBy("unit_ord", "m.start")
    return hits.select(
        "doc_id",
        "page",
        "paragraph_index",
        F.lit(keyword).alias("keyword"),
        F.col("m.start").alias("start"),
        tidy_match(F.col("m.text")).alias("match_text"),
        context(F.col("text"), F.col("m.start"), F.length("m.text"), F.col("breaks")).alias("context"),
        F.row_number().over(order).cast("long").alias("occurrence_index"),
    )


def counts(unit: DataFrame, keyword: str) -> DataFrame:
    """(doc_id, match_count) of documents with matches: no offsets are made, and sums are partial before the shuffle."""
    pattern = keyword_pattern(keyword, hyphenated=True)
    hits = unit.filter(F.col("text").rlike(pattern))
    return hits.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(pattern))).cast("long").alias("match_count"))


def rollup(documents: DataFrame, unit: DataFrame, keyword: str) -> DataFrame:
    """Every document's match_count, those without matches included."""
    joined = documents.select("doc_id").join(counts(unit, keyword), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("match_count", F.lit(0)).cast("long").alias("match_count"))


def totals(per_document: DataFrame) -> DataFrame:
    return per_document.agg(
        F.count(F.lit(1)).alias("documents_searched"),
        F.count_if(F.col("match_count") > 0).alias("documents_with_matches"),
        F.coalesce(F.sum("match_count"), F.lit(0)).cast("long").alias("total_matches"),
    )


def scanned(pages: DataFrame) -> DataFrame:
    """Documents of which most pages hold little text and an image: doc_id, page_count, scanned_pages, looks_scanned."""
    from folio.functions.text import strip

    bare = (F.length(strip(F.col("text"))) < 100) & (F.col("n_images") > 0)
    out = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"), F.count_if(bare).alias("scanned_pages"))
    return out.withColumn("looks_scanned", F.col("scanned_pages") * 2 > F.col("page_count"))


def display_names(paths: DataFrame) -> DataFrame:
    """path and name: the base name where it is unique, else the whole path."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    alone = F.count(F.lit(1)).over(Window.partitionBy("base")) == 1
    return paths.withColumn("base", base).select("path", F.when(alone, F.col("base")).otherwise(F.col("path")).alias("name"))
