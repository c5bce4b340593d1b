"""Queries over the driver's tables for each operator, with SQL of their own for DuckDB where SQL can express them.

Where the tables hold no misspellings, cross references, headings or line geometry, they are derived from every row of a
table by an expression that both engines share; the answers are always computed by the SQL from those rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators import findings, keyword, links, router, semantic, spell, structure
from folio.plans import engine
from folio.sources import documents as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


RUNS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')"
TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+')"
LINES = "SELECT doc_id, i - 1 AS unit_ord, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"


def occurrences_sql(word: str, source: str, page: str, index: str) -> str:
    return f"""
WITH u AS ({source}),
r AS (SELECT doc_id, unit_ord, i, rs[i] AS run, sum(length(rs[i])) OVER (PARTITION BY doc_id, unit_ord ORDER BY i) - length(rs[i]) AS start
  FROM (SELECT doc_id, unit_ord, rs, unnest(range(1, len(rs) + 1)) AS i FROM (SELECT doc_id, unit_ord, {RUNS.format("line")} AS rs FROM u)))
SELECT doc_id, {page} AS page, {index} AS paragraph_index, start::INTEGER AS start, run AS match_text,
  row_number() OVER (PARTITION BY doc_id ORDER BY unit_ord, start) AS occurrence_index
FROM r WHERE lower(run) = '{word}'"""


@query(occurrences_sql("the", LINES, "1::INTEGER", "unit_ord::INTEGER"))
def corpus_occurrences(spark, sf_dir):
    found = keyword.occurrences(keyword.line_units(table(spark, sf_dir, "documents")), "the")
    return found.drop("keyword", "context")


CONVERSATIONS_SQL = occurrences_sql("la", "SELECT conv_id AS doc_id, turn + 1 AS unit_ord, text AS line FROM conversations", "unit_ord::INTEGER", "NULL::INTEGER")


@query(CONVERSATIONS_SQL)
def conversation_occurrences(spark, sf_dir):
    unit = keyword.page_units(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return keyword.occurrences(unit, "la").drop("keyword", "context")


_HIT = r"(?is)^(.*?(?:^|[^\p{L}\p{N}_]))the(?:[^\p{L}\p{N}_]|$)"
_UNIT_SQL = f"""
WITH h AS (SELECT doc_id, unit_ord, line, len(list_filter({TOKENS.format("line")}, lambda x: lower(x) = 'the')) AS n,
  length(regexp_extract(line, '{_HIT}', 1)) AS s FROM ({LINES})),
u AS (SELECT doc_id, unit_ord, n AS occurrences, CASE WHEN s > 60 THEN '...' ELSE '' END
  || trim(regexp_replace(line[greatest(s - 60, 0) + 1:s + 63], '\\s+', ' ', 'g')) || CASE WHEN s + 63 < length(line) THEN '...' ELSE '' END AS snippet
  FROM h WHERE n > 0)"""


@query(f"{_UNIT_SQL} SELECT doc_id, unit_ord::INTEGER AS unit_ord, 1::INTEGER AS page, unit_ord::INTEGER AS paragraph_index, occurrences::BIGINT AS occurrences, snippet FROM u")
def lexical_units(spark, sf_dir):
    return keyword.unit_hits(keyword.line_units(table(spark, sf_dir, "documents")), "the")


@query(
    f"{_UNIT_SQL} SELECT doc_id, sum(occurrences)::BIGINT AS occurrences, [1::INTEGER] AS pages, first(snippet ORDER BY unit_ord) AS snippet, count(*) AS n_units FROM u GROUP BY doc_id"
)
def lexical_summary(spark, sf_dir):
    return keyword.lexical_summary(keyword.unit_hits(keyword.line_units(table(spark, sf_dir, "documents")), "the"))


_ROLLUP = f"SELECT doc_id, sum(len(list_filter({TOKENS.format('text')}, lambda x: lower(x) = 'token')))::BIGINT AS match_count FROM documents GROUP BY doc_id"


@query(_ROLLUP)
def corpus_rollup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return keyword.rollup(docs, keyword.line_units(docs), "token")


@query(
    f"SELECT count(*) AS documents_searched, count(*) FILTER (match_count > 0) AS documents_with_matches, sum(match_count)::BIGINT AS total_matches FROM ({_ROLLUP})"
)
def corpus_totals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return keyword.totals(keyword.rollup(docs, keyword.line_units(docs), "token"))


@query(
    f"""WITH r AS (SELECT doc_id, i, rs[i] AS a, rs[i + 1] AS b, rs[i + 2] AS c
  FROM (SELECT doc_id, rs, unnest(range(1, len(rs) - 1)) AS i FROM (SELECT doc_id, {RUNS.format("text")} AS rs FROM documents)))
SELECT doc_id, count(*) AS occurrences FROM r WHERE lower(a) = 'of' AND lower(c) = 'the' AND regexp_full_match(b, '\\s+') GROUP BY doc_id"""
)
def phrase_search(spark, sf_dir):
    pattern = X.keyword_pattern("of the")
    rows = table(spark, sf_dir, "documents").filter(F.col("text").rlike(pattern))
    return rows.select("doc_id", F.regexp_count("text", F.lit(pattern)).cast("long").alias("occurrences"))


@query(
    r"""SELECT doc_id, (i - 1)::INTEGER AS pos, s AS sentence FROM (
  SELECT doc_id, unnest(range(1, len(ss) + 1)) AS i, unnest(ss) AS s FROM (
    SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM documents))"""
)
def sentences(spark, sf_dir):
    return structure.sentences(table(spark, sf_dir, "documents"))


@query(
    """WITH w AS (SELECT unnest(regexp_extract_all(text, '[^\\s]+')) AS word FROM documents)
SELECT word, count(*) AS n FROM w WHERE regexp_matches(word, '[a-z][A-Z]|\\p{Nd}|_') OR (word = upper(word) AND word <> lower(word) AND length(word) > 1)
  OR lower(word) IN ('gnodeb','enodeb','mocn','rsrp','rsrq','sinr','airscale_rnc','nodeb','ranslicing','oss','bts') GROUP BY word"""
)
def protected_terms(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))).alias("word"))
    distinct = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return spell.protected(distinct, spell.terms(spark)).filter("protected").select("word", "n")


@query(
    """WITH t AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
l AS (SELECT page_id, unnest(range(0, len(h))) AS ord, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))
SELECT page_id, ord::INTEGER AS ord, href FROM l WHERE href NOT IN (SELECT path FROM t)"""
)
def page_links(spark, sf_dir):
    return sources.dangling_links(table(spark, sf_dir, "pages"))


@query(
    """SELECT word, log10(count(*) / sum(count(*)) OVER ()) + 9 AS zipf FROM (
  SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents) GROUP BY word"""
)
def vocabulary(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.transform(spell.tokens(F.col("text")), F.lower)).alias("word"))
    return spell.vocabulary(words)


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, e.label AS doc_id, e.vec_id, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
  FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND e.label <> q.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, doc_id, vec_id, round(score, 6) AS score, rank::INTEGER AS rank, CASE WHEN score >= 0.6 THEN 'strong' WHEN score >= 0.45 THEN 'moderate' ELSE 'weak' END AS relevance FROM r WHERE rank <= 5"""
)
def semantic_topk(spark, sf_dir):
    return semantic.label_search(table(spark, sf_dir, "embeddings"))


_FOUND = "SELECT doc_id % 5 AS g, doc_id AS ord, CASE WHEN doc_id % 37 = 0 THEN 'semantic' ELSE 'lexical' END AS match_type FROM documents"


@query(
    f"""WITH f AS ({_FOUND}), a AS (SELECT *, match_type = 'semantic' AS rare, count(*) OVER (PARTITION BY g) AS n, sum((match_type = 'semantic')::INT) OVER (PARTITION BY g) AS k,
  row_number() OVER (PARTITION BY g, match_type ORDER BY ord) AS i FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY CASE WHEN n > 20 AND rare THEN 1 ELSE 0 END, ord) AS position FROM a WHERE rare OR n <= 20 OR i <= greatest(0, 20 - k))
SELECT g, ord, match_type, position::INTEGER AS position FROM b WHERE position <= 20"""
)
def truncate_budget(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 37 == 0, "semantic").otherwise("lexical")
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("g"), F.col("doc_id").alias("ord"), kind.alias("match_type"))
    return findings.truncate(rows, 20, ("g",))


@query("SELECT source AS doc_id, count(*) AS match_count, least(count(*), 30)::BIGINT AS listed, count(*) > 30 AS truncated FROM documents GROUP BY source")
def truncate_per_document(spark, sf_dir):
    return findings.per_document(table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id")), 30)


@query(
    """SELECT conv_id AS doc_id, count(*) AS page_count, count(*) FILTER (length(trim(text)) < 100 AND turn % 2 = 0) AS scanned_pages,
  2 * count(*) FILTER (length(trim(text)) < 100 AND turn % 2 = 0) > count(*) AS looks_scanned FROM conversations GROUP BY conv_id"""
)
def scanned_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "text", F.when(F.col("turn") % 2 == 0, 1).otherwise(0).alias("n_images"))
    return keyword.scanned(rows)


_FINDINGS = (
    "SELECT source AS document, 1 AS page, CASE WHEN doc_id % 3 = 0 THEN 'broken_links' WHEN doc_id % 3 = 1 THEN 'spell_check' ELSE 'keyword_search' END AS feature, "
    "'finding ' || lang AS message, 's' || doc_id AS suggestion, doc_id AS ord FROM documents"
)


def _findings(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "broken_links").when(F.col("doc_id") % 3 == 1, "spell_check").otherwise("keyword_search")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("document"), F.lit(1).alias("page"), kind.alias("feature"), F.concat(F.lit("finding "), "lang").alias("message"), F.concat(F.lit("s"), F.col("doc_id")).alias("suggestion"), F.col("doc_id").alias("ord")
    )


@query(f"SELECT * FROM ({_FINDINGS}) WHERE feature = 'spell_check' AND contains(lower(concat_ws(' ', document, page, feature, message, suggestion)), 'finding de')")
def findings_filter(spark, sf_dir):
    return findings.search(_findings(spark, sf_dir), "Finding DE", feature="spell_check")


@query(
    f"""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT coalesce(sum(coalesce(n_chars, 0)), 0)::BIGINT FROM documents) AS pages, count(*) AS findings,
  count(*) FILTER (feature = 'broken_links') AS broken_links, count(*) FILTER (feature = 'keyword_search') AS keyword_search, 0::BIGINT AS multi_doc_keyword_search,
  count(*) FILTER (feature = 'spell_check') AS spell_check FROM ({_FINDINGS})"""
)
def history_rollup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("n_chars").alias("page_count"))
    return findings.history(docs, _findings(spark, sf_dir))


@query(f"SELECT document AS doc_id, feature, 'ok' AS status, count(*) AS findings FROM ({_FINDINGS}) GROUP BY document, feature")
def summary_sheet(spark, sf_dir):
    rows = _findings(spark, sf_dir).withColumnRenamed("document", "doc_id")
    results = rows.select("doc_id", "feature").distinct().withColumn("status", F.lit("ok"))
    return findings.summary(results, rows)


@query(
    f"""SELECT ord, id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id
FROM (SELECT ord, document, row_number() OVER (ORDER BY document NULLS FIRST, ord) AS id FROM ({_FINDINGS})) WINDOW w AS (ORDER BY id)"""
)
def finding_neighbours(spark, sf_dir):
    return findings.neighbours(_findings(spark, sf_dir)).select("ord", "id", "previous_id", "next_id")


@query(f"SELECT document, ord, coalesce(lag(document) OVER (ORDER BY document NULLS FIRST, ord) IS DISTINCT FROM document OR row_number() OVER (ORDER BY document NULLS FIRST, ord) = 1, false) AS new_document FROM ({_FINDINGS})")
def group_headers(spark, sf_dir):
    return findings.group_headers(_findings(spark, sf_dir)).select("document", "ord", "new_document")


@query("SELECT doc_id, sha256(coalesce(text, '') || chr(0)) AS digest FROM documents")
def text_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", semantic.text_key(F.array(F.coalesce("text", F.lit("")))).alias("digest"))


@query(
    "SELECT doc_id, CASE WHEN length(c) > 80 THEN c[1:79] || '…' ELSE c END AS shown FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents)"
)
def displayed_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.display(F.col("text")).alias("shown"))


def _tables(spark, units: DataFrame) -> engine.Tables:
    """Units as the paragraphs, or where they have no number as the pages, of documents."""
    own = units.filter("paragraph_index IS NOT NULL").select("doc_id", "page", F.col("paragraph_index").alias("index"), "text")
    return {"paragraphs": own, "pages": units.filter("paragraph_index IS NULL").select("doc_id", F.col("page").alias("number"), "text")}


@query(
    f"""{_UNIT_SQL}
SELECT doc_id::VARCHAR AS doc_id, 0::INTEGER AS part, 0::BIGINT AS ord, 1::INTEGER AS page, '''the'' found ' || sum(occurrences)::BIGINT || ' time(s) on page(s) 1' AS message FROM u GROUP BY doc_id
UNION ALL SELECT doc_id::VARCHAR, 1, unit_ord, 1, '''the'' found ' || occurrences || ' time(s) on page 1, paragraph ' || unit_ord FROM u"""
)
def keyword_feature(spark, sf_dir):
    tables = _tables(spark, keyword.line_units(table(spark, sf_dir, "documents")))
    found, _ = engine.run(tables, "keyword_search", {"query": "the", "encoder": None})
    return found.select("doc_id", "part", "ord", "page", "message")


@query(
    f"""SELECT doc_id::VARCHAR AS doc_id, occurrence_index AS ord, page, '''la'' found on page ' || page AS message FROM ({CONVERSATIONS_SQL})"""
)
def corpus_feature(spark, sf_dir):
    tables = _tables(spark, keyword.page_units(table(spark, sf_dir, "conversations"), "conv_id", "turn"))
    found, _ = engine.run(tables, "multi_doc_keyword_search", {"keyword": "la"})
    return found.select("doc_id", "ord", "page", "message")


_BOTH = "('a', 1, 0, 'The value was read form the OSS. Teh batery is flat.'), ('a', 1, 1, 'Their lenght and gNodeB batery.'), ('b', 2, 0, 'TEH network form.')"


from folio import queries_derived  # noqa: E402,F401  its queries join those above
