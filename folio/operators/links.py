"""Broken references: links without a target, mentions of missing captions, cue words without what they point to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import SPACE, collapse, display, matches, number_parts, strip

# Fixed values.
REFERENCE = r"(?i)\b(Section|Clause|Chapter|Figure|Table)\s+(\d+(?:\.\d+)*)|\b(Appendix)\s+([A-Z]\b|\d+(?:\.\d+)*)"
HEADING_KINDS = ["Section", "Clause", "Chapter", "Appendix"]
CAPTION_KINDS = ["Figure", "Table"]
CAPTION = r"(?i)^(Table|Figure)\s+(\d+(?:\.\d+)*)((?:[.-]\d+)*)\s*[:.–—-]?\s*(.*)?$"
CUE = r"(?i)\b(?:see\s*/\s*refer(?:s|red)?\s+to|see\s+also|refer(?:s|red)?\s+to|see|described\s+in|shown\s+in|depicted\s+in)[ \t]*"
NEXT = r"""^[A-Za-z0-9:/'"\-]+"""
FUNCTION_WORDS = ["to", "in", "for", "on", "at", "of", "and", "or", "from"]
CUE_SUBJECTS = [
    "i", "you", "we", "they", "he", "she", "it", "user", "users", "operator", "operators", "can", "could", "will", "would", "should", "may", "might", "do", "does", "did", "to", "not", "never", "cannot",
]
EXACT, SIBLING, LINK_SNIPPET = 0.95, 0.72, 12


def link_reason(target_page, target_name, page_count):
    """Why a link is broken, null if it is not."""
    return (
        F.when(target_page.isNotNull(), F.when((target_page < 1) | (target_page > page_count), "target page out of range"))
        .when(target_name.isNotNull(), "named destination not found")
    )


def broken_links(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Internal links with their reason, those that have one. documents: (doc_id, page_count)."""
    rows = links.filter("is_internal").join(documents.select("doc_id", "page_count"), "doc_id")
    return rows.withColumn("reason", link_reason(F.col("target_page"), F.col("target_name"), F.col("page_count"))).filter("reason IS NOT NULL").drop("page_count")


def resolve_names(links: DataFrame, dests: DataFrame) -> DataFrame:
    """target_page of links by name, null where the name has no page. dests: (doc_id, name, page)."""
    known = dests.filter("page >= 0").groupBy("doc_id", F.col("name").alias("target_name")).agg(F.min("page").alias("target_page"))
    return links.join(known, ["doc_id", "target_name"], "left")


def reference(text) -> tuple:
    """Kind (capitalised) and number of the first reference in a text, null if there is none."""
    kind = F.concat(F.regexp_extract(text, REFERENCE, 1), F.regexp_extract(text, REFERENCE, 3))
    number = F.concat(F.regexp_extract(text, REFERENCE, 2), F.regexp_extract(text, REFERENCE, 4))
    return F.when(kind != "", F.initcap(F.lower(kind))), F.when(number != "", number)


def evidence(links: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """links with evidence_text and evidence_source: target name, link text, paragraph of the page, or the raw link.

    The first that holds a reference counts. Paragraphs: the first on the link's page with a reference and the link text's
    first characters; only links that need it take part in that join.
    """
    name, text = F.regexp_replace("target_name", "_", " "), F.col("text")
    rows = links.withColumn("first", F.when(reference(name)[0].isNotNull(), name).when(reference(text)[0].isNotNull(), text))
    source = F.when(reference(name)[0].isNotNull(), "target_name").when(reference(text)[0].isNotNull(), "link_text")
    rows = rows.withColumn("source", source).withColumn("snippet", F.substring(strip(text), 1, LINK_SNIPPET))
    need = rows.filter("source IS NULL AND snippet <> ''").select("doc_id", "page", "ord", "snippet")
    cited = paragraphs.filter(F.col("text").rlike(REFERENCE)).select("doc_id", "page", "index", F.col("text").alias("paragraph"))
    found = need.join(cited, ["doc_id", "page"]).filter("instr(paragraph, snippet) > 0")
    found = found.groupBy("doc_id", "ord").agg(F.min_by("paragraph", "index").alias("paragraph"))
    rows = rows.join(found, ["doc_id", "ord"], "left")
    return rows.select(
        *links.columns,
        F.coalesce("first", "paragraph", F.when(strip(text) != "", text), "target_name").alias("evidence_text"),
        F.coalesce("source", F.when(F.col("paragraph").isNotNull(), "paragraph"), F.lit("raw")).alias("evidence_source"),
    )


def suggest_headings(references: DataFrame, headings: DataFrame) -> DataFrame:
    """references (doc_id, ref, kind, number) with the heading of that number (0.95), else its neighbour's (0.72).

    A neighbour differs by one in the last part only, so both are equal joins on number lists.
    """
    wanted = references.filter(F.col("kind").isin(HEADING_KINDS)).withColumn("parts", number_parts(F.col("number"))).filter("parts IS NOT NULL")
    size = F.size("parts")
    near = lambda d: F.concat(F.slice("parts", F.lit(1), size - 1), F.array(F.element_at("parts", -1) + d))
    keys = F.array(
        F.struct(F.col("parts").alias("p"), F.lit(0).alias("rank")),
        F.struct(near(-1).alias("p"), F.lit(1).alias("rank")),
        F.struct(near(1).alias("p"), F.lit(1).alias("rank")),
    )
    have = headings.withColumn("p", number_parts(F.col("number"))).filter("p IS NOT NULL")
    have = have.select("doc_id", "p", "ord", F.struct("text", "number", "page").alias("heading"))
    asked = wanted.select("doc_id", "ref", F.inline(keys)).join(have, ["doc_id", "p"])
    best = asked.groupBy("doc_id", "ref").agg(F.min_by(F.struct("heading", "rank"), F.struct("rank", "ord")).alias("b"))
    return references.join(best, ["doc_id", "ref"], "left").select(
        *references.columns,
        F.col("b.heading.text").alias("suggested_heading"),
        F.col("b.heading.number").alias("suggested_heading_number"),
        F.col("b.heading.page").alias("suggested_page"),
        F.when(F.col("b.rank") == 0, EXACT).when(F.col("b.rank") == 1, SIBLING).alias("confidence"),
    )


def captions(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, kind, number, page, text): the first caption of each kind and number; the first line of a paragraph counts."""
    line = F.element_at(F.split(strip(F.col("text")), "\n"), 1)
    rows = paragraphs.withColumn("line", line).filter(F.col("line").rlike(CAPTION))
    kind, number = F.initcap(F.lower(F.regexp_extract("line", CAPTION, 1))), F.concat(F.regexp_extract("line", CAPTION, 2), F.regexp_extract("line", CAPTION, 3))
    rows = rows.select("doc_id", kind.alias("kind"), number.alias("number"), "index", F.struct("page", F.col("line").alias("text")).alias("c"))
    return rows.groupBy("doc_id", "kind", "number").agg(F.min_by("c", "index").alias("c")).select("doc_id", "kind", "number", "c.page", "c.text")


def suggest_captions(references: DataFrame, found: DataFrame) -> DataFrame:
    """references with the page and text of their caption (0.95), null where there is none."""
    have = found.select("doc_id", "kind", "number", F.col("page").alias("caption_page"), F.col("text").alias("caption"))
    return references.join(have, ["doc_id", "kind", "number"], "left").withColumn("caption_confidence", F.when(F.col("caption").isNotNull(), EXACT))


def prose_references(paragraphs: DataFrame, found: DataFrame, reported: DataFrame | None = None) -> DataFrame:
    """Mentions of figures and tables without caption, in documents with captions of that kind: doc_id, page, index, kind, number.

    The first mention in a document, other than on pages where it is reported already (doc_id, page, kind, number). The
    caption line that opens a paragraph mentions nothing.
    """
    pattern = r"(?i)\b(?:Figure|Table)\s+\d+(?:\.\d+)*"
    text = strip(F.col("text"))
    line = F.element_at(F.split(text, "\n"), 1)
    body = F.when(strip(line).rlike(CAPTION), F.substring(text, F.length(line) + 2, F.lit(1 << 30))).otherwise(text)
    rows = paragraphs.filter(F.col("text").rlike(pattern))
    rows = rows.select("doc_id", "page", "index", F.posexplode(F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).alias("at", "m"))
    kind, number = F.initcap(F.lower(F.regexp_extract("m", r"^(\w+)", 1))), F.regexp_extract("m", r"(\d+(?:\.\d+)*)$", 1)
    rows = rows.select("doc_id", "page", "index", "at", kind.alias("kind"), number.alias("number"))
    rows = rows.join(found.select("doc_id", "kind").distinct(), ["doc_id", "kind"], "left_semi")
    rows = rows.join(found, ["doc_id", "kind", "number"], "left_anti")
    rows = rows if reported is None else rows.join(reported, ["doc_id", "page", "kind", "number"], "left_anti")
    first = rows.groupBy("doc_id", "kind", "number").agg(F.min(F.struct("index", "at", "page")).alias("m"))
    return first.select("doc_id", "m.page", "m.index", "m.at", "kind", "number")


def missing_references(paragraphs: DataFrame) -> DataFrame:
    """Cues that nothing follows: doc_id, page, index, cue, start, reason, context; one for each page and place in the paragraph.

    Lines of a paragraph are read as one.
    """
    rows = paragraphs.withColumn("text", F.translate("text", "\n", " "))
    rows = rows.filter(F.col("text").rlike(CUE)).withColumn("m", F.explode(matches(F.col("text"), CUE)))
    start, end = F.col("m.start"), F.col("m.start") + F.length("m.text")
    before = F.lower(F.regexp_extract(F.substring("text", F.lit(1), start), rf"([A-Za-z']+){SPACE}*$", 1))
    rest = F.substring("text", end + 1, F.lit(1 << 30))
    after = F.regexp_extract(rest, NEXT, 0)
    empty = F.lower(after).isin(FUNCTION_WORDS) | after.startswith(":")
    rows = rows.filter(~before.isin(CUE_SUBJECTS) & empty)
    around = F.substring("text", F.greatest(start - 10, F.lit(0)) + 1, start + 70 - F.greatest(start - 10, F.lit(0)))
    why = F.when(after.startswith(":"), "reference cue followed immediately by punctuation").otherwise(F.concat(F.lit("cue followed by '"), after, F.lit("', with no reference text between them")))
    rows = rows.select("doc_id", "page", "index", collapse(F.col("m.text")).alias("cue"), start.alias("start"), why.alias("reason"), display(strip(around)).alias("context"))
    first = F.row_number().over(Window.partitionBy("doc_id", "page", "start").orderBy("index"))
    return rows.withColumn("n", first).filter("n = 1").drop("n")


def reported_links(links: DataFrame, documents: DataFrame, paragraphs: DataFrame, headings: DataFrame, found: DataFrame) -> DataFrame:
    """Broken links with their evidence and what they may have meant: a heading, else a caption.

    Columns of links, and kind, number, evidence_text, evidence_source, reason, suggested_heading,
    suggested_heading_number, suggested_page, confidence.
    """
    rows = evidence(broken_links(links, documents), paragraphs)
    kind, number = reference(F.col("evidence_text"))
    rows = rows.withColumns({"kind": kind, "number": number})
    asked = suggest_captions(suggest_headings(rows.select("doc_id", F.col("ord").alias("ref"), "kind", "number"), headings), found)
    asked = asked.select(
        "doc_id",
        F.col("ref").alias("ord"),
        F.coalesce("suggested_heading", "caption").alias("suggested_heading"),
        F.when(F.col("suggested_heading").isNotNull(), F.col("suggested_heading_number")).alias("suggested_heading_number"),
        F.coalesce("suggested_page", "caption_page").alias("suggested_page"),
        F.coalesce("confidence", "caption_confidence").cast("double").alias("confidence"),
    )
    return rows.join(asked, ["doc_id", "ord"])
