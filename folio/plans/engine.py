"""Features as plans: a registry of functions from document tables to findings, run by name and put together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators import keyword, links, semantic, spell, structure
from folio.operators.findings import summary

Tables = dict[str, DataFrame]
#: `part` tells the passes of a feature apart, `ord` orders the findings of a pass within their document.
FINDINGS = "doc_id string, feature string, part int, ord bigint, page int, message string, confidence double, details string"
LINK_COLUMNS = ["reference_type", "reference_text", "evidence_source", "link_text", "reason", "suggested_heading", "suggested_heading_number", "suggested_page", "suggestion_confidence"]
SEARCH_COLUMNS = ["query", "match_type", "occurrences", "pages", "snippet", "paragraph_index", "score", "relevance", "chunk_index"]
CORPUS_COLUMNS = ["keyword", "document", "page", "paragraph_index", "match_text", "context", "occurrence_index"]
SPELL_COLUMNS = ["word", "suggestion", "incorrect_word", "suggested_correction", "issue_type", "method", "original_sentence", "corrected_sentence", "paragraph_index"]


@dataclass
class Feature:
    name: str
    run: Callable[[Tables, dict], DataFrame]
    formats: tuple[str, ...] = ()
    columns: list[str] = field(default_factory=list)


def finding(rows: DataFrame, feature: str, part: int, ord_: Column, message: Column, confidence: Column, details: dict[str, Column]) -> DataFrame:
    """rows (doc_id, page, ...) as findings; details keep their nulls."""
    values = [c.alias(k) for k, c in details.items()]
    return rows.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.lit(feature).alias("feature"),
        F.lit(part).alias("part"),
        ord_.cast("long").alias("ord"),
        F.col("page").cast("int").alias("page"),
        message.alias("message"),
        confidence.cast("double").alias("confidence"),
        F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("details"),
    )


def _where() -> Column:
    paragraph = F.when(F.col("paragraph_index").isNotNull(), F.concat(F.lit(", paragraph "), F.col("paragraph_index"))).otherwise("")
    return F.concat(F.lit("page "), F.col("page"), paragraph)


def semantic_note(o: dict) -> str | None:
    """Why a search has no passages; None if it has."""
    encoder = o.get("encoder", semantic.hashed_encoder)
    return "off" if encoder is None else semantic.unavailable(encoder, o.get("encoder_dim"))


def _keyword_search(t: Tables, o: dict) -> DataFrame:
    """A summary of each document, its units with the query, then the passages nearest to it that do not hold it.

    options: query; encoder (makes the encoder; None: no passages), encoder_dim (what its vectors must have), min_score. An
    encoder that is unavailable costs the passages only.
    """
    query = o.get("query") or o.get("keyword")
    unit = keyword.units(t["paragraphs"], t["pages"])
    hits = keyword.unit_hits(unit, query)
    quoted, none = X.shown(F.lit(query)), F.lit(None)

    def details(kind, occurrences, pages, snippet, paragraph=none, score=none, relevance=none, chunk=none):
        made = (F.lit(query), F.lit(kind), occurrences, pages, snippet, paragraph.cast("int"), score.cast("double"), relevance.cast("string"), chunk.cast("int"))
        return dict(zip(SEARCH_COLUMNS, made))

    total = keyword.lexical_summary(hits).withColumn("page", F.element_at("pages", 1))
    message = F.concat(quoted, F.lit(" found "), F.col("occurrences"), F.lit(" time(s) on page(s) "), F.array_join("pages", ", "))
    one = finding(total, "keyword_search", 0, F.lit(0), message, none, details("lexical_summary", F.col("occurrences"), F.col("pages"), F.col("snippet")))
    message = F.concat(quoted, F.lit(" found "), F.col("occurrences"), F.lit(" time(s) on "), _where())
    two = finding(hits, "keyword_search", 1, F.col("unit_ord"), message, none, details("lexical", F.col("occurrences"), F.array("page"), F.col("snippet"), F.col("paragraph_index")))
    encoder = o.get("encoder", semantic.hashed_encoder)
    if semantic_note(o) is not None:
        return one.unionByName(two)
    near = semantic.search(structure.chunks(unit), query, X.keyword_pattern(query), encoder, least=o.get("min_score"))
    message = F.concat(
        F.lit("Possible semantic match for "), quoted, F.lit(" on "), _where(), F.lit(" ("), F.col("relevance"), F.format_string(" similarity %.3f, no exact match)", "score")
    )
    more = details("semantic", F.lit(0).cast("long"), F.array("page"), X.collapse(F.col("text")), F.col("paragraph_index"), F.col("score"), F.col("relevance"), F.col("chunk_index"))
    return one.unionByName(two).unionByName(finding(near, "keyword_search", 2, F.col("rank"), message, F.col("score"), more))


def _corpus_search(t: Tables, o: dict) -> DataFrame:
    query = o.get("keyword") or o.get("query")
    hits = keyword.occurrences(keyword.units(t["paragraphs"], t["pages"]), query).withColumn("document", F.col("doc_id").cast("string"))
    if "documents" in t and "path" in t["documents"].columns:
        paths = t["documents"].select("doc_id", F.col("path").alias("__path"))
        hits = hits.join(paths, "doc_id", "left").withColumn("document", F.coalesce("__path", "document"))
    message = F.concat(X.shown(F.lit(query)), F.lit(" found on "), _where())
    return finding(hits, "multi_doc_keyword_search", 0, F.col("occurrence_index"), message, F.lit(None), {c: F.col(c) for c in CORPUS_COLUMNS})


def _broken_links(t: Tables, o: dict) -> DataFrame:
    """Links without a target, mentions of missing captions, cues without what they point to.

    Tables links, headings and documents (page_count) are needed for the first pass only.
    """
    found = links.captions(t["paragraphs"])
    parts, reported, text, null = [], None, F.lit(None).cast("string"), F.lit(None)

    def details(kind, shown, source, reason, link=text, heading=text, number=text, page=null, score=null):
        return dict(zip(LINK_COLUMNS, (kind, shown, F.lit(source) if isinstance(source, str) else source, link, reason, heading, number, page.cast("int"), score.cast("double"))))

    if "links" in t:
        headings = t["headings"]
        if "number" not in headings.columns:
            headings = structure.split_heading(headings).withColumn("text", F.col("title"))
        broken = links.reported_links(t["links"], t["documents"], t["paragraphs"], headings, found)
        reported = broken.filter("kind IS NOT NULL").select("doc_id", "page", "kind", "number").distinct()
        shown = X.display(F.col("evidence_text"))
        message = F.concat(F.lit("Broken "), F.coalesce("kind", F.lit("internal")), F.lit(" reference "), X.shown(shown), F.lit(" ("), F.col("reason"), F.lit(")"))
        c = F.col
        more = details(c("kind"), shown, c("evidence_source"), c("reason"), c("text"), c("suggested_heading"), c("suggested_heading_number"), c("suggested_page"), c("confidence"))
        parts.append(finding(broken, "broken_links", 0, F.col("ord"), message, F.col("confidence"), more))
    prose = links.prose_references(t["paragraphs"], found, reported)
    text_of = F.concat_ws(" ", "kind", "number")
    message = F.concat(F.lit("Reference to "), text_of, F.lit(" but the document has no "), text_of)
    more = details(F.col("kind"), text_of, "prose", F.lit("no matching caption found in this document"))
    # Places in a paragraph follow its number, so that one number orders both.
    place = F.col("index").cast("long") * F.lit(1 << 31)
    parts.append(finding(prose, "broken_links", 1, place + F.col("at"), message, F.lit(None), more))
    missing = links.missing_references(t["paragraphs"])
    message = F.concat(F.lit("Cross-reference after "), X.shown(F.col("cue")), F.lit(" is missing its text: "), X.shown(F.col("context")))
    more = details(F.lit("Cross-reference"), F.col("context"), "prose", F.col("reason"))
    parts.append(finding(missing, "broken_links", 2, place + F.col("start"), message, F.lit(None), more))
    return reduce(DataFrame.unionByName, parts)


def _spell_check(t: Tables, o: dict) -> DataFrame:
    """options: spell_mode (dictionary, t5 or both), terms, vocabulary (word, zipf; else the paragraphs' own), corrector."""
    p = t["paragraphs"]
    rows = structure.sentences(p.withColumn("__key", F.struct("doc_id", "page", "index")), "__key")
    rows = rows.select("doc_id.doc_id", "doc_id.page", F.col("doc_id.index").alias("paragraph_index"), "pos", "sentence")
    vocab = o.get("vocabulary")
    if vocab is None:
        vocab = spell.vocabulary(p.select(F.explode(F.transform(spell.tokens(F.col("text")), F.lower)).alias("word")))
    found = spell.check(rows, spell.terms(p.sparkSession, o.get("terms")), vocab, o.get("spell_mode") or "t5", o.get("corrector"))
    kind = F.when(F.col("source") == "dictionary", "dictionary_spelling").otherwise("contextual_spelling")
    word, new = F.col("word"), F.col("suggestion")
    more = dict(zip(SPELL_COLUMNS, (word, new, word, new, kind, F.col("method"), F.col("sentence"), F.col("corrected"), F.col("paragraph_index"))))
    message = F.concat(F.lit("Possible spelling error: "), X.shown(word), F.lit(" -> "), X.shown(new))
    place = F.col("paragraph_index").cast("long") * F.lit(1 << 31) + F.col("pos")
    return finding(found, "spell_check", 0, place, message, F.lit(None), more)


REGISTRY: dict[str, Feature] = {
    f.name: f
    for f in (
        Feature("broken_links", _broken_links, columns=LINK_COLUMNS),
        Feature("keyword_search", _keyword_search, columns=SEARCH_COLUMNS),
        Feature("spell_check", _spell_check, ("pdf", "docx"), SPELL_COLUMNS[2:]),
        Feature("multi_doc_keyword_search", _corpus_search, columns=[c for c in CORPUS_COLUMNS if c != "page"]),
    )
}
NEED_QUERY = ("keyword_search", "multi_doc_keyword_search")


def select(names: list[str] | str) -> list[str]:
    """Feature names in order; `all` is every one; unknown names are an error."""
    wanted = list(REGISTRY) if names in ("all", ["all"]) else [names] if isinstance(names, str) else list(dict.fromkeys(names))
    unknown = [n for n in wanted if n not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown features: {', '.join(unknown)}")
    return wanted


def supported(tables: Tables, feature: Feature) -> Tables:
    """The tables without documents of formats that the feature does not take; all of them where formats are not known."""
    if not feature.formats or "documents" not in tables or "format" not in tables["documents"].columns:
        return tables
    own = tables["documents"].filter(F.col("format").isin(*feature.formats)).select("doc_id")
    return {name: t.join(own, "doc_id", "left_semi") for name, t in tables.items()}


def results(tables: Tables, found: DataFrame, states: list[tuple[str, str, str | None]]) -> DataFrame:
    """(doc_id, feature, status, error, findings) for every document and feature of a run.

    A document that could not be read fails with its error, one of a format that the feature does not take is skipped;
    otherwise the feature's own state holds.
    """
    docs = tables["documents"]
    have = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    listed = F.array(
        *[
            F.struct(
                F.lit(n).alias("feature"),
                F.lit(s).alias("state"),
                F.lit(e).cast("string").alias("why"),
                F.array(*map(F.lit, REGISTRY[n].formats)).cast("array<string>").alias("formats"),
            )
            for n, s, e in states
        ]
    )
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), have("format").alias("format"), have("parse_error").alias("parse_error"), F.inline(listed))
    other = (F.size("formats") > 0) & F.col("format").isNotNull() & ~F.array_contains("formats", F.col("format"))
    status = F.when(F.col("parse_error").isNotNull(), "failed").when(other, "skipped").otherwise(F.col("state"))
    error = F.when(F.col("parse_error").isNotNull(), F.col("parse_error")).when(~F.coalesce(other, F.lit(False)), F.col("why"))
    return summary(rows.select("doc_id", "feature", status.alias("status"), error.alias("error")), found)


def run(tables: Tables, names: list[str] | str, options: dict | None = None) -> tuple[DataFrame, list[tuple[str, str, str | None]]]:
    """All findings of the features named, as one plan, and (feature, status, error) of each: ok, failed or skipped."""
    options, parts, states = options or {}, [], []
    for name in select(names):
        query = options.get("query") or options.get("keyword")
        if name in NEED_QUERY and query is not None and not isinstance(query, str):
            states.append((name, "failed", "the query must be text"))
        elif name == "multi_doc_keyword_search" and not (query or "").strip():
            states.append((name, "failed", "keyword must not be empty"))
        elif name in NEED_QUERY and not (query or "").strip():
            states.append((name, "skipped", "a query is needed"))
        else:
            try:
                parts.append(REGISTRY[name].run(supported(tables, REGISTRY[name]), options))
                states.append((name, "ok", None))
            except Exception as e:  # the contract: a feature fails, not the run
                states.append((name, "failed", str(e)))
    spark: SparkSession = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([], FINDINGS)
    for p in parts:
        out = out.unionByName(p)
    return out, states
