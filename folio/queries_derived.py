"""Queries on rows derived from whole tables: words and their neighbours, lines made into captions and mentions, links of pages.

An expression that both engines know makes the rows, so that the SQL has the same input; what is asked about them it computes
by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators import findings, keyword, links, router, semantic, spell, structure
from folio.plans import engine
from folio.queries import LINES, ORACLE_SQL, RUNS, query, table
from folio.sources import documents as sources
from folio.sources import reports


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(words) -> str:
    return "(" + ", ".join(map(quote, words)) + ")"


def at(template: str, *values: str) -> str:
    """The template with {0}, {1} filled in; other braces stay."""
    for i, v in enumerate(values):
        template = template.replace(f"{{{i}}}", v)
    return template


# --- words ---------------------------------------------------------------------------------------------------------------

_W = "regexp_extract_all({}, '[A-Za-z]+')"
_WORDS = f"(SELECT DISTINCT lower(unnest({_W.format('text')})) AS word FROM documents)"
_PAIRS = f"(SELECT DISTINCT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT {_W.format('text')} AS w FROM documents)))"
_ZIPF = f"(SELECT word, n, log10(n / sum(n) OVER ()) + 9 AS zipf FROM (SELECT word, count(*) AS n FROM (SELECT lower(unnest({_W.format('text')})) AS word FROM documents) GROUP BY word))"
_SENTENCES = r"""(SELECT doc_id, i - 1 AS pos, s AS sentence FROM (SELECT doc_id, unnest(range(1, len(ss) + 1)) AS i, unnest(ss) AS s FROM (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM documents)))"""
_LIKELY = "levenshtein(lower({0}), lower({1})) <= CASE WHEN length({0}) <= 3 THEN 1 ELSE 2 END"
_SWAPPED = "(length({0}) = length({1}) AND levenshtein(lower({0}), lower({1})) = 2 AND damerau_levenshtein(lower({0}), lower({1})) = 1)"
_LOOKS = r"(regexp_matches({0}, '[a-z][A-Z]|\p{{Nd}}|_') OR ({0} = upper({0}) AND {0} <> lower({0}) AND length({0}) > 1))"
#: Forms of a word that are misspelt, or look like another form of it.
_ALTERED = (
    "CASE length(word) % 4 WHEN 0 THEN substr(word, 1, length(word) - 2) || reverse(substr(word, length(word) - 1)) WHEN 1 THEN substr(word, 1, 1) || substr(word, 3) "
    "WHEN 2 THEN word || 'er' ELSE substr(word, 1, 2) || 'x' || substr(word, 3) END"
)
_SUFFIX_SWAP = """(least(length({0}), length({1})) >= 6 AND coalesce(list_max(list_filter(range(1, least(length({0}), length({1})) + 1), lambda i: {0}[:i] = {1}[:i])), 0) >= greatest(length({0}), length({1})) - 2
  AND list_sort(string_split({0}[coalesce(list_max(list_filter(range(1, least(length({0}), length({1})) + 1), lambda i: {0}[:i] = {1}[:i])), 0) + 1:], ''))
   <> list_sort(string_split({1}[coalesce(list_max(list_filter(range(1, least(length({0}), length({1})) + 1), lambda i: {0}[:i] = {1}[:i])), 0) + 1:], '')))"""


def word_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(spell.tokens(F.col("text"))).alias("word")).select(F.lower("word").alias("word"))


def words(spark, sf_dir) -> DataFrame:
    return word_rows(spark, sf_dir).distinct()


def pairs(spark, sf_dir) -> DataFrame:
    """The distinct pairs (a, b) of words that follow one another."""
    w = table(spark, sf_dir, "documents").select(spell.tokens(F.col("text")).alias("w")).filter(F.size("w") > 1)
    last = F.size("w") - 1
    next_to = F.arrays_zip(F.slice("w", F.lit(1), last).alias("a"), F.slice("w", F.lit(2), last).alias("b"))
    return w.select(F.inline(next_to).alias("a", "b")).distinct()


@query(f"SELECT a, b, {_LIKELY.format('a', 'b')} AS likely, {_SWAPPED.format('a', 'b')} AS transposed FROM {_PAIRS}")
def edit_rules(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return pairs(spark, sf_dir).select("a", "b", spell.likely(a, b).alias("likely"), F.coalesce(spell.transposed(a, b), F.lit(False)).alias("transposed"))


@query(f"SELECT word AS a, b, {_SWAPPED.format('word', 'b')} AS transposed, {_SUFFIX_SWAP.format('word', 'b')} AS swap FROM (SELECT word, {_ALTERED} AS b FROM {_WORDS} WHERE length(word) > 2)")
def suffix_swaps(spark, sf_dir):
    rows = words(spark, sf_dir).filter("length(word) > 2").select(F.col("word").alias("a"), F.expr(_ALTERED).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("a", "b", F.coalesce(spell.transposed(a, b), F.lit(False)).alias("transposed"), spell.suffix_swap(a, b).alias("swap"))


_LOOSE = ", ".join(
    f"CASE WHEN word LIKE '%{x}' AND length(word) >= {4 + len(x)} THEN [word[:-{len(x) + 1}], word[:-{len(x) + 1}] || 'e'] ELSE [] END" for x in ("ing", "ed", "er", "ers", "ly")
)


@query(
    f"""SELECT word, list_filter([CASE WHEN word LIKE '%s' AND word NOT LIKE '%ss' THEN word[:-2] END, CASE WHEN word LIKE '%ed' THEN word[:-2] END, CASE WHEN word LIKE '%ing' THEN word[:-4] || 'e' END], lambda x: x IS NOT NULL) AS regular,
  flatten([{_LOOSE}]) AS loose FROM {_WORDS}"""
)
def word_stems(spark, sf_dir):
    regular, loose = spell.stems(F.col("word"))
    return words(spark, sf_dir).select("word", regular.alias("regular"), loose.alias("loose"))


@query(
    f"""WITH v AS {_ZIPF}, p AS (SELECT DISTINCT lower(a) AS original, lower(b) AS suggestion FROM {_PAIRS})
SELECT original, suggestion FROM p JOIN v x ON x.word = original JOIN v y ON y.word = suggestion WHERE NOT (x.zipf >= 4 AND y.zipf >= 4) OR {_SWAPPED.format('original', 'suggestion')}"""
)
def verified_changes(spark, sf_dir):
    rows = pairs(spark, sf_dir).select(F.lower("a").alias("original"), F.lower("b").alias("suggestion")).distinct()
    return spell.verified(rows, spell.vocabulary(word_rows(spark, sf_dir)))


_CANDIDATES = f"(SELECT a AS original, CASE length(a) % 3 WHEN 0 THEN a ELSE b END AS suggested, {_LOOKS.format('a')} AS is_protected, {_LIKELY.format('a', 'b')} AS is_valid FROM {_PAIRS})"


@query(
    f"""SELECT DISTINCT *, CASE WHEN is_protected THEN 'reject_protected_term' WHEN NOT is_valid THEN 'reject_invalid_candidate' WHEN original = suggested THEN 'reject_no_change' ELSE 'accept' END AS decision
FROM {_CANDIDATES}"""
)
def correction_decisions(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    rows = pairs(spark, sf_dir).select(
        a.alias("original"), F.when(F.length("a") % 3 == 0, a).otherwise(b).alias("suggested"), spell.looks_protected(a).alias("is_protected"), spell.likely(a, b).alias("is_valid")
    )
    return spell.decide(rows.distinct())


@query(
    f"""SELECT DISTINCT a AS original, lower(b) AS suggestion, CASE WHEN a = upper(a) THEN upper(b) WHEN a[1] = upper(a[1]) THEN upper(b[1]) || lower(b[2:]) ELSE lower(b) END AS cased FROM {_PAIRS}"""
)
def matched_case(spark, sf_dir):
    rows = pairs(spark, sf_dir).select(F.col("a").alias("original"), F.lower("b").alias("suggestion")).distinct()
    return rows.withColumn("cased", X.match_case(F.col("original"), F.col("suggestion")))


_CHANGED = r"(SELECT doc_id, pos, sentence, w[1] AS word, upper(w[1]) || 'x' AS new, w FROM (SELECT *, regexp_extract_all(sentence, '[A-Za-z]+') AS w FROM {}) WHERE len(w) > 0)".format(_SENTENCES)


def _first_words(texts: DataFrame) -> DataFrame:
    rows = structure.sentences(texts).withColumn("w", spell.tokens(F.col("sentence"))).filter(F.size("w") > 0)
    return rows.withColumn("word", F.get("w", F.lit(0))).withColumn("new", F.concat(F.upper("word"), F.lit("x")))


@query(
    f"""SELECT doc_id, pos::INTEGER AS pos, word, CASE WHEN list_contains(rs, word) THEN array_to_string(rs[:list_position(rs, word) - 1] || [new] || rs[list_position(rs, word) + 1:], '') ELSE sentence END AS made
FROM (SELECT *, {RUNS.format("sentence")} AS rs FROM {_CHANGED})"""
)
def replaced_words(spark, sf_dir):
    rows = _first_words(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "pos", "word", X.replace_word(F.col("sentence"), F.col("word"), F.col("new")).alias("made"))


@query(
    f"""SELECT doc_id, pos::INTEGER AS pos, word AS original, new AS suggestion FROM {_CHANGED.replace("FROM documents", "FROM (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)")}
WHERE len(w) = 1 OR list_unique(list_transform(w, lambda x: lower(x))) > 1"""
)
def word_level_changes(spark, sf_dir):
    """Each sentence against itself with its first word changed; where all its words are one, that is no change one for one."""
    rows = _first_words(table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn")))
    after = F.concat_ws(" ", "new", F.array_join(F.slice("w", F.lit(2), F.size("w")), " "))
    changed = rows.select("doc_id", "pos", F.explode(spell.word_changes(F.array_join("w", " "), after)).alias("c"))
    return changed.select("doc_id", "pos", "c.original", "c.suggestion")


_MERGED = f"(SELECT doc_id, turn, sentence, w[i] AS word, reverse(w[i]) || i AS suggestion, CASE i % 2 WHEN 0 THEN 't5' ELSE 'dictionary' END AS method, i AS prio FROM (SELECT conv_id AS doc_id, turn, text AS sentence, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT *, {_W.format('text')} AS w FROM conversations)))"


@query(
    f"""SELECT doc_id, turn AS paragraph_index, sentence, lower(word) AS word, first(suggestion ORDER BY prio) AS suggestion,
  CASE WHEN count(*) > 1 THEN 'both' ELSE first(method) END AS method FROM {_MERGED} GROUP BY doc_id, turn, sentence, lower(word)"""
)
def spell_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("paragraph_index"), F.col("text").alias("sentence"))

    def one(word, i):
        method = F.when((i + 1) % 2 == 0, "t5").otherwise("dictionary")
        return F.struct(word.alias("word"), F.concat(F.reverse(word), i + 1).alias("suggestion"), method.alias("method"), (i + 1).alias("prio"))

    return spell.merge_findings(rows.withColumn("found", F.transform(spell.tokens(F.col("sentence")), one)))


_FREQUENT = f"(SELECT word, zipf FROM {_ZIPF} WHERE n >= 10)"
_KNOWN = "SELECT word FROM v WHERE zipf >= 2.5"


@query(
    f"""WITH v AS {_FREQUENT},
o AS (SELECT DISTINCT x.word, coalesce(v.zipf, 0) AS zipf FROM (SELECT {_ALTERED} AS word FROM v WHERE length(word) > 2) x LEFT JOIN v USING (word)
  WHERE length(x.word) >= 3 AND regexp_full_match(x.word, '[a-z]+') AND coalesce(v.zipf, 0) < 3.3),
k AS (SELECT * FROM o WHERE length(word) <= 3 OR NOT (
  (word LIKE '%s' AND word NOT LIKE '%ss' AND word[:-2] IN ({_KNOWN})) OR (word LIKE '%ed' AND word[:-2] IN ({_KNOWN})) OR (word LIKE '%ing' AND word[:-4] || 'e' IN ({_KNOWN})))),
l AS (SELECT DISTINCT word FROM (SELECT word, unnest(flatten([{_LOOSE}])) AS stem FROM k WHERE zipf < 1 AND length(word) > 3) WHERE stem IN ({_KNOWN})),
c AS (SELECT k.word, k.zipf, v.word AS other, v.zipf AS better, damerau_levenshtein(k.word, v.word) AS far FROM k JOIN v ON abs(length(k.word) - length(v.word)) <= 2 AND k.word <> v.word
  WHERE k.word NOT IN (SELECT word FROM l) AND v.zipf >= 3 AND damerau_levenshtein(k.word, v.word) <= 2),
f AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY far, better DESC, other) AS n FROM c
  WHERE (length(word) > 3 OR ({_SWAPPED.format('word', 'other')} AND better >= zipf + 1.5)) AND (zipf < 1 OR (far = 1 AND length(other) >= length(word) AND better >= zipf + 1.5)))
SELECT word, other AS suggestion FROM f WHERE n = 1 AND NOT {_SUFFIX_SWAP.format('word', 'other')}"""
)
def dictionary_suggest(spark, sf_dir):
    """Altered forms of the documents' words that occur ten times or more, against those words."""
    vocab = spell.vocabulary(word_rows(spark, sf_dir), 10)
    return spell.suggest(vocab.filter("length(word) > 2").select(F.expr(_ALTERED).alias("word")), vocab)


@query(f"SELECT word, log10(n / greatest(sum(n) OVER (), 1)) + 9 AS zipf FROM (SELECT word, sum(frequency) AS n FROM (SELECT lower(trim(a)) AS word, length(b)::DOUBLE AS frequency FROM {_PAIRS}) GROUP BY word)")
def frequency_words(spark, sf_dir):
    return spell.frequency_list(pairs(spark, sf_dir).select(F.col("a").alias("word"), F.length("b").cast("double").alias("frequency")))


_MISSPELT = "replace(replace(text, ' for ', ' form '), ' and ', ' recieve ')"
_MISSPELT_SENTENCES = _SENTENCES.replace("FROM documents", f"FROM (SELECT doc_id, {_MISSPELT} AS text FROM documents)")
_MAP = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in spell.CONFUSIONS.items())
_FITS = f"(lower(w[i]) <> 'form' OR coalesce(lower(w[i - 1]) IN {listed(spell.FORM_AFTER)}, false) OR coalesce(lower(w[i + 1]) IN {listed(spell.FORM_BEFORE)}, false))"


@query(
    f"""WITH t AS (SELECT doc_id, pos, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, pos, {_W.format('sentence')} AS w FROM {_MISSPELT_SENTENCES}))
SELECT doc_id, pos::INTEGER AS pos, (i - 1)::INTEGER AS word_index, w[i] AS word, suggestion FROM t JOIN (VALUES {_MAP}) m(wrong, suggestion) ON wrong = lower(w[i])
WHERE {_FITS} AND NOT {_LOOKS.format('w[i]')} AND {_LIKELY.format('w[i]', 'suggestion')}"""
)
def confusion_findings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.expr(_MISSPELT))
    return spell.confusions(structure.sentences(docs), spell.terms(spark))


_RECIEVED = "replace(text, ' and ', ' recieve ')"


@query(
    rf"""WITH l AS (SELECT doc_id, unit_ord, line FROM ({LINES.replace("FROM documents", f"FROM (SELECT doc_id, {_RECIEVED} AS text FROM documents)")})),
s AS (SELECT doc_id, unit_ord, unnest(range(1, len(ss) + 1)) AS pos, unnest(ss) AS sentence FROM (
  SELECT doc_id, unit_ord, list_filter(list_transform(regexp_extract_all(line, '[^.!?]+[.!?]?'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM l)),
h AS (SELECT *, len(list_filter({_W.format('sentence')}, lambda x: x = 'recieve')) AS n FROM s)
SELECT doc_id::VARCHAR AS doc_id, 1 AS page, unit_ord::VARCHAR AS paragraph_index, 'Possible spelling error: ''recieve'' -> ''receive''' AS message,
  'contextual_spelling' AS issue_type, CASE WHEN sum(n) > 1 THEN 'both' ELSE 't5' END AS method, regexp_replace(sentence, '\brecieve\b', 'receive', 'g') AS corrected_sentence
FROM h WHERE n > 0 GROUP BY doc_id, unit_ord, sentence"""
)
def spell_feature(spark, sf_dir):
    unit = keyword.line_units(table(spark, sf_dir, "documents").withColumn("text", F.expr(_RECIEVED)))
    paragraphs = unit.select("doc_id", "page", F.col("paragraph_index").alias("index"), "text")
    found, _ = engine.run({"paragraphs": paragraphs}, "spell_check", {"vocabulary": spell.vocabulary(word_rows(spark, sf_dir))})
    d = lambda k: F.get_json_object("details", f"$.{k}").alias(k)
    return found.select("doc_id", "page", d("paragraph_index"), "message", d("issue_type"), d("method"), d("corrected_sentence"))


# --- lines as paragraphs with captions and mentions -----------------------------------------------------------------------

_MADE = (
    "CASE unit_ord % 6 WHEN 0 THEN 'Table ' || (length(line) % 7) || ': ' || line WHEN 1 THEN 'As Table ' || (length(line) % 9) || ' and figure ' || (doc_id % 4) || ' show, ' || line "
    "WHEN 2 THEN 'Figure ' || (doc_id % 3) || '.' || (length(line) % 3) || ' - ' || line WHEN 3 THEN 'They see for more, ' || line || ' see  in the guide' "
    "WHEN 4 THEN line || ' Refer to for ' || doc_id || ', see: ' || (length(line) % 5) ELSE line END"
)
_P = f"(SELECT doc_id, 1 AS page, unit_ord::INTEGER AS \"index\", {_MADE} AS text FROM ({LINES}))"


def made_paragraphs(spark, sf_dir) -> DataFrame:
    lines = keyword.line_units(table(spark, sf_dir, "documents")).withColumnRenamed("text", "line")
    return lines.select("doc_id", "page", F.col("unit_ord").alias("index"), F.expr(_MADE).alias("text"))


_CAPTIONS = rf"""SELECT doc_id, kind, number, first(page ORDER BY "index") AS page, first(line ORDER BY "index") AS text FROM (
  SELECT *, upper(line[1]) || lower(regexp_extract(line, '(?i)^(Table|Figure)', 1)[2:]) AS kind, regexp_extract(line, '(?i)^(?:Table|Figure)\s+(\d+(?:\.\d+)*(?:[.-]\d+)*)', 1) AS number
  FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS line FROM {_P}) WHERE regexp_matches(line, '(?i)^(Table|Figure)\s+\d')) GROUP BY doc_id, kind, number"""


@query(_CAPTIONS)
def caption_index(spark, sf_dir):
    return links.captions(made_paragraphs(spark, sf_dir))


_MENTIONS = rf"""SELECT doc_id, page, kind, number, min("index") AS "index" FROM (
    SELECT doc_id, page, "index", upper(m[1]) || lower(regexp_extract(m, '^(\w+)', 1)[2:]) AS kind, regexp_extract(m, '(\d+(?:\.\d+)*)$', 1) AS number
    FROM (SELECT doc_id, page, "index", unnest(regexp_extract_all(text, '(?i)\b(?:Figure|Table)\s+\d+(?:\.\d+)*')) AS m FROM {_P} WHERE NOT regexp_matches(text, '(?i)^\s*(Table|Figure)\s+\d'))) GROUP BY doc_id, page, kind, number"""
_PROSE = f"""SELECT doc_id, page, "index", kind, number FROM ({_MENTIONS}) m WHERE EXISTS (SELECT 1 FROM c WHERE c.doc_id = m.doc_id AND c.kind = m.kind)
  AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = m.doc_id AND c.kind = m.kind AND c.number = m.number)"""


@query(f"WITH c AS ({_CAPTIONS}) {_PROSE}")
def prose_references(spark, sf_dir):
    p = made_paragraphs(spark, sf_dir)
    return links.prose_references(p, links.captions(p)).select("doc_id", "page", "index", "kind", "number")


_CUE = quote(links.CUE)
_MISSING = rf"""SELECT doc_id, page, "index", cue, start, CASE WHEN after[1] = ':' THEN 'reference cue followed immediately by punctuation' ELSE 'cue followed by ''' || after || ''', with no reference text between them' END AS reason FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page, start ORDER BY "index") AS n FROM (
    SELECT doc_id, page, "index", trim(regexp_replace(m, '\s+', ' ', 'g')) AS cue, start, lower(regexp_extract(text[1:start], '([A-Za-z'']+)\s*$', 1)) AS before,
      regexp_extract(text[start + length(m) + 1:], '^[A-Za-z0-9:/''"-]+') AS after FROM (
      SELECT doc_id, page, "index", text, ms[i] AS m, (list_sum(list_transform(gs[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda z: length(z))), 0))::INTEGER AS start FROM (
        SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, {_CUE}) AS ms, string_split_regex(text, {_CUE}) AS gs FROM {_P} WHERE regexp_matches(text, {_CUE})))))
  WHERE before NOT IN {listed(links.CUE_SUBJECTS)} AND (lower(after) IN {listed(links.FUNCTION_WORDS)} OR after[1] = ':')) WHERE n = 1"""


@query(_MISSING)
def missing_references(spark, sf_dir):
    return links.missing_references(made_paragraphs(spark, sf_dir)).select("doc_id", "page", "index", "cue", "start", "reason")


_ASKED = "CASE ord % 3 WHEN 0 THEN 'Table' ELSE 'Figure' END"
_ASKED_NUMBER = "CASE ord % 3 WHEN 2 THEN (ord % 3) || '.' || (doc_id % 3) ELSE '' || (doc_id % 8) END"


@query(
    f"""SELECT r.*, c.page AS caption_page, c.text AS caption, CASE WHEN c.text IS NOT NULL THEN 0.95 END::DOUBLE AS caption_confidence
FROM (SELECT doc_id, ord::INTEGER AS ref, {_ASKED} AS kind, {_ASKED_NUMBER} AS number FROM (SELECT doc_id, unnest(range(0, 6)) AS ord FROM documents)) r LEFT JOIN ({_CAPTIONS}) c USING (doc_id, kind, number)"""
)
def suggest_caption(spark, sf_dir):
    refs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("ord"))
    refs = refs.select("doc_id", F.col("ord").alias("ref"), F.expr(_ASKED).alias("kind"), F.expr(_ASKED_NUMBER).alias("number"))
    return links.suggest_captions(refs, links.captions(made_paragraphs(spark, sf_dir))).withColumn("caption_confidence", F.col("caption_confidence").cast("double"))


_TURNS = "(SELECT CASE conv_id % 2 WHEN 0 THEN conv_id ELSE -conv_id END AS doc_id, turn, text FROM conversations)"


@query(
    f"""SELECT doc_id, "index" AS unit_ord, page, "index" AS paragraph_index, text FROM {_P}
UNION ALL SELECT doc_id, (turn + 1)::INTEGER, (turn + 1)::INTEGER, NULL, text FROM {_TURNS} WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""
)
def document_units(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    turns = turns.select(F.when(F.col("conv_id") % 2 == 0, F.col("conv_id")).otherwise(-F.col("conv_id")).alias("doc_id"), (F.col("turn") + 1).cast("int").alias("number"), "text")
    return keyword.units(made_paragraphs(spark, sf_dir), turns)


# --- orders as headings, references and lines -----------------------------------------------------------------------------

_HEADING = "CASE o_orderkey % 3 WHEN 0 THEN '  ' || (o_orderkey % 7) || '.' || (o_custkey % 9) || '. ' || o_orderstatus || ' ' WHEN 1 THEN o_custkey || ' ' || o_orderstatus ELSE o_orderpriority END"
_NUMBERED = r"^\s*((?:\d+\.)*\d+)\.?\s+(.*)$"


@query(
    f"""SELECT o_orderkey AS id, nullif(regexp_extract(t, '{_NUMBERED}', 1), '') AS number,
  trim(CASE WHEN regexp_matches(t, '{_NUMBERED}') THEN regexp_extract(t, '{_NUMBERED}', 2) ELSE t END) AS title FROM (SELECT o_orderkey, {_HEADING} AS t FROM orders)"""
)
def heading_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_HEADING).alias("t"))
    return structure.split_heading(rows, "t").select("id", "number", "title")


_HEAD_COLUMNS = {"doc_id": "o_custkey", "ord": "o_orderkey", "text": "o_orderpriority", "number": "(o_orderkey % 4 + 1) || '.' || (o_orderkey % 5)", "page": "o_orderkey % 9 + 1"}
_REF_COLUMNS = {
    "doc_id": "o_custkey", "ref": "o_orderkey", "kind": "CASE o_orderkey % 5 WHEN 0 THEN 'Section' WHEN 1 THEN 'Clause' WHEN 2 THEN 'Chapter' WHEN 3 THEN 'Figure' ELSE 'Appendix' END",
    "number": "CASE o_orderkey % 11 WHEN 0 THEN 'A' ELSE (o_orderkey % 4 + 1) || '.' || (o_orderkey % 7) END",
}


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


def _orders(spark, sf_dir, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*[F.expr(e).alias(n) for n, e in columns.items()])


@query(
    f"""WITH h AS (SELECT *, list_transform(string_split(number, '.'), lambda x: x::BIGINT) AS p FROM (SELECT {_columns(_HEAD_COLUMNS)} FROM orders)),
r AS (SELECT *, CASE WHEN kind IN ('Section','Clause','Chapter','Appendix') AND regexp_full_match(number, '[0-9.]+') THEN list_transform(string_split(number, '.'), lambda x: try_cast(x AS BIGINT)) END AS p
  FROM (SELECT {_columns(_REF_COLUMNS)} FROM orders)),
j AS (SELECT r.doc_id, r.ref, h.text, h.number AS hn, h.page, CASE WHEN r.p = h.p THEN 0 ELSE 1 END AS rank, h.ord FROM r JOIN h ON r.doc_id = h.doc_id AND (r.p = h.p
  OR (len(r.p) = len(h.p) AND r.p[1:len(r.p) - 1] = h.p[1:len(h.p) - 1] AND abs(r.p[len(r.p)] - h.p[len(h.p)]) = 1))),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ref ORDER BY rank, ord) AS n FROM j)
SELECT r.doc_id, r.ref, r.kind, r.number, b.text AS suggested_heading, b.hn AS suggested_heading_number, b.page AS suggested_page,
  CASE b.rank WHEN 0 THEN 0.95 WHEN 1 THEN 0.72 END::DOUBLE AS confidence FROM r LEFT JOIN b ON r.doc_id = b.doc_id AND r.ref = b.ref AND b.n = 1"""
)
def suggest_heading(spark, sf_dir):
    found = links.suggest_headings(_orders(spark, sf_dir, _REF_COLUMNS), _orders(spark, sf_dir, _HEAD_COLUMNS))
    return found.withColumn("confidence", F.col("confidence").cast("double"))


_LINE_COLUMNS = {
    "doc_id": "o_custkey", "page": "CAST(1 AS INT)", "pos": "o_orderkey", '"left"': "CAST(72 AS DOUBLE)", '"right"': "CAST(200 + o_orderkey % 201 AS DOUBLE)", "top": "CAST((o_orderkey % 9973) * 12 AS DOUBLE)",
    "text": "CASE o_orderkey % 7 WHEN 0 THEN '- ' || o_orderpriority WHEN 1 THEN '2.1 ' || o_orderstatus WHEN 2 THEN o_orderpriority || '.' ELSE o_orderpriority END",
}
_L = f"(SELECT {_columns(_LINE_COLUMNS)} FROM orders)"


def _lines(spark, sf_dir) -> DataFrame:
    return _orders(spark, sf_dir, {n.strip('"'): e for n, e in _LINE_COLUMNS.items()})


_PITCH = f"SELECT doc_id, page, coalesce(median(step) FILTER (step > 0), 0.0)::DOUBLE AS pitch FROM (SELECT doc_id, page, top - lag(top) OVER (PARTITION BY doc_id, page ORDER BY pos) AS step FROM {_L}) GROUP BY doc_id, page"


@query(_PITCH)
def line_pitch(spark, sf_dir):
    return structure.line_pitch(_lines(spark, sf_dir))


@query(
    rf"""WITH l AS (SELECT *, lead(text) OVER w AS nxt, lead(top) OVER w - top AS step, max("right") OVER p AS r, min("left") OVER p AS l FROM {_L} JOIN ({_PITCH}) USING (doc_id, page)
  WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos), p AS (PARTITION BY doc_id, page)),
b AS (SELECT *, coalesce(pitch > 0 AND (step > 1.35 * pitch OR step <= 0), false) OR ("right" < r - 0.1 * (r - l) AND regexp_matches(text, '[.!?:;]$'))
  OR coalesce(regexp_matches(nxt, '^(?:[-–—*•]|\(?[0-9]{{1,3}}[.)]|\(?[a-zA-Z][.)])\s') OR (regexp_matches(nxt, '^\s*((?:\d+\.)*\d+)\.?\s+') AND NOT regexp_matches(nxt, '[.!?:;]$')), false)
  OR ("right" < r - 0.1 * (r - l) AND regexp_matches(text, '^\s*((?:\d+\.)*\d+)\.?\s+') AND NOT regexp_matches(text, '[.!?:;]$')) AS brk FROM l),
g AS (SELECT *, coalesce(sum(brk::INT) OVER (PARTITION BY doc_id, page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM b)
SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1)::INTEGER AS "index", string_agg(text, chr(10) ORDER BY pos) AS text FROM g GROUP BY doc_id, page, grp"""
)
def paragraph_split(spark, sf_dir):
    return structure.split_paragraphs(_lines(spark, sf_dir))


# --- links of pages ---------------------------------------------------------------------------------------------------------

_LINK_COLUMNS = {
    "doc_id": "page_id", "ord": "CAST(ord AS INT)", "page": "CAST(ord % 3 + 1 AS INT)",
    "text": "CASE ord % 4 WHEN 0 THEN 'See Section ' || (length(href) % 5) || '.' || (ord % 3) WHEN 1 THEN 'here' WHEN 2 THEN ' More on ' || substr(href, 2, 4) ELSE '' END",
    "target_page": "CASE WHEN ord % 3 = 0 THEN CAST(length(href) % 9 AS INT) END", "target_name": "CASE ord % 3 WHEN 1 THEN 'Clause_' || (ord % 4) || '.1' WHEN 2 THEN href END", "is_internal": "ord % 5 <> 4",
}
_HREFS = "(SELECT page_id, unnest(range(0, len(h))) AS ord, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS h FROM pages))"
_LINKS = f"(SELECT {_columns(_LINK_COLUMNS)} FROM {_HREFS})"
_COUNTS = "(SELECT page_id AS doc_id, CAST(4 + page_id % 3 AS INT) AS page_count FROM pages)"
_CITED_TEXT = "'More on ' || substr(href, 2, 4) || ' in Section 2.' || ord"
_CITED = f"(SELECT page_id AS doc_id, CAST(ord % 3 + 1 AS INT) AS page, CAST(ord AS INT) AS \"index\", {_CITED_TEXT} AS text FROM {_HREFS})"


def _links(spark, sf_dir) -> DataFrame:
    return sources.page_links(table(spark, sf_dir, "pages")).select(*[F.expr(e).alias(n) for n, e in _LINK_COLUMNS.items()])


def _counts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.expr("CAST(4 + page_id % 3 AS INT)").alias("page_count"))


def _cited(spark, sf_dir) -> DataFrame:
    rows = sources.page_links(table(spark, sf_dir, "pages"))
    return rows.select(F.col("page_id").alias("doc_id"), F.expr("CAST(ord % 3 + 1 AS INT)").alias("page"), F.col("ord").alias("index"), F.expr(_CITED_TEXT).alias("text"))


_REASONS = f"""SELECT l.*, CASE WHEN target_page < 1 OR target_page > page_count THEN 'target page out of range' ELSE 'named destination not found' END AS reason
FROM {_LINKS} l JOIN {_COUNTS} d USING (doc_id) WHERE is_internal AND (target_page < 1 OR target_page > page_count OR (target_page IS NULL AND target_name IS NOT NULL))"""


@query(_REASONS)
def link_reasons(spark, sf_dir):
    return links.broken_links(_links(spark, sf_dir), _counts(spark, sf_dir))


_REF = quote(links.REFERENCE)


def _evidence(source: str) -> str:
    return f"""(WITH l AS (SELECT *, replace(target_name, '_', ' ') AS name, trim(text) AS bare FROM ({source})),
f AS (SELECT l.doc_id, l.ord, first(c.text ORDER BY c."index") AS paragraph FROM l JOIN {_CITED} c ON c.doc_id = l.doc_id AND c.page = l.page AND l.bare <> '' AND contains(c.text, substr(l.bare, 1, 12)) AND regexp_matches(c.text, {_REF}) GROUP BY l.doc_id, l.ord)
SELECT l.* EXCLUDE (name, bare), CASE WHEN regexp_matches(name, {_REF}) THEN name WHEN regexp_matches(text, {_REF}) THEN text WHEN paragraph IS NOT NULL THEN paragraph WHEN bare <> '' THEN text ELSE target_name END AS evidence_text,
  CASE WHEN regexp_matches(name, {_REF}) THEN 'target_name' WHEN regexp_matches(text, {_REF}) THEN 'link_text' WHEN paragraph IS NOT NULL THEN 'paragraph' ELSE 'raw' END AS evidence_source FROM l LEFT JOIN f USING (doc_id, ord))"""


@query(f"SELECT * FROM {_evidence(f'SELECT * FROM {_LINKS}')}")
def evidence_cascade(spark, sf_dir):
    return links.evidence(_links(spark, sf_dir), _cited(spark, sf_dir))


@query(
    f"""SELECT l.page_id AS doc_id, l.ord::INTEGER AS ord, l.href AS target_name, t.page AS target_page FROM {_HREFS} l LEFT JOIN (
  SELECT page_id, href, min(ord - 1)::INTEGER AS page FROM {_HREFS} WHERE ord % 2 = 0 AND ord - 1 >= 0 GROUP BY page_id, href) t USING (page_id, href)"""
)
def named_destinations(spark, sf_dir):
    rows = sources.page_links(table(spark, sf_dir, "pages")).withColumnRenamed("page_id", "doc_id")
    dests = rows.filter("ord % 2 = 0").select("doc_id", F.col("href").alias("name"), (F.col("ord") - 1).alias("page"))
    return links.resolve_names(rows.select("doc_id", "ord", F.col("href").alias("target_name")), dests)


_FEATURE_HEADS = "(SELECT page_id AS doc_id, ord, 'Part ' || ord AS text, (ord % 4) || '.1' AS number, ord + 1 AS page FROM (SELECT page_id, unnest(range(0, 6)) AS ord FROM pages WHERE page_id % 2 = 0))"


@query(
    rf"""WITH b AS (SELECT * FROM {_evidence(_REASONS)}),
k AS (SELECT *, regexp_extract(evidence_text, {_REF}, 1) || regexp_extract(evidence_text, {_REF}, 3) AS k0, regexp_extract(evidence_text, {_REF}, 2) || regexp_extract(evidence_text, {_REF}, 4) AS number FROM b),
q AS (SELECT *, CASE WHEN k0 <> '' THEN upper(k0[1]) || lower(k0[2:]) END AS kind, list_transform(string_split(number, '.'), lambda x: try_cast(x AS BIGINT)) AS p FROM k),
h AS (SELECT *, list_transform(string_split(number, '.'), lambda x: x::BIGINT) AS p FROM {_FEATURE_HEADS}),
s AS (SELECT q.doc_id, q.ord, min(CASE WHEN q.p = h.p THEN 0 ELSE 1 END) AS rank FROM q JOIN h ON q.doc_id = h.doc_id AND q.kind IN ('Section', 'Clause', 'Chapter', 'Appendix')
  AND len(q.p) = len(h.p) AND q.p[1:len(q.p) - 1] = h.p[1:len(h.p) - 1] AND abs(q.p[len(q.p)] - h.p[len(h.p)]) <= 1 GROUP BY q.doc_id, q.ord)
SELECT doc_id::VARCHAR AS doc_id, q.ord::BIGINT AS ord, page, 'Broken ' || coalesce(kind, 'internal') || ' reference ''' || trim(regexp_replace(evidence_text, '\s+', ' ', 'g')) || ''' (' || reason || ')' AS message,
  CASE rank WHEN 0 THEN 0.95 WHEN 1 THEN 0.72 END::DOUBLE AS confidence FROM q LEFT JOIN s USING (doc_id, ord)"""
)
def broken_links_feature(spark, sf_dir):
    """The links of all pages, with headings for half of them; paragraphs hold sections, so neither captions nor cues."""
    rows = table(spark, sf_dir, "pages").filter("page_id % 2 = 0").select(F.col("page_id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("ord"))
    heads = rows.select("doc_id", "ord", F.expr("'Part ' || ord").alias("text"), F.expr("(ord % 4) || '.1'").alias("number"), (F.col("ord") + 1).alias("page"))
    tables = {"paragraphs": _cited(spark, sf_dir), "links": _links(spark, sf_dir), "headings": heads, "documents": _counts(spark, sf_dir)}
    found, _ = engine.run(tables, "broken_links")
    return found.filter("part = 0").select("doc_id", "ord", "page", "message", "confidence")


_PATHS = "(SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)"


@query(
    f"""SELECT path, CASE WHEN count(*) OVER (PARTITION BY regexp_extract(path, '([^/]*)$', 1)) = 1 THEN regexp_extract(path, '([^/]*)$', 1) ELSE path END AS name FROM {_PATHS}"""
)
def display_names(spark, sf_dir):
    return keyword.display_names(sources.page_targets(table(spark, sf_dir, "pages")))


#: Six ways to write a path, with the file kind, the normal form and the reason of each.
_TARGET = "CASE n WHEN 0 THEN 'in' || path || '.pdf' WHEN 1 THEN '/in//./x/..' || path || '.DOCX' WHEN 2 THEN 'in' || path || '.txt' WHEN 3 THEN 'in' || path || '/' WHEN 4 THEN '  ' ELSE '../in' || path || '.pdf' END"
_KIND = "CASE n WHEN 3 THEN 'folder' WHEN 4 THEN 'none' WHEN 5 THEN 'none' ELSE 'file' END"


@query(
    f"""SELECT DISTINCT {_TARGET} AS target, CASE n WHEN 0 THEN 'in' || path || '.pdf' WHEN 1 THEN '/in' || path || '.DOCX' WHEN 3 THEN 'in' || path END AS path,
  CASE n WHEN 2 THEN 'unsupported file type (expected .pdf or .docx)' WHEN 4 THEN 'not a usable path' WHEN 5 THEN 'no such file or folder' END AS reason
FROM (SELECT path, unnest(range(0, 6)) AS n FROM (SELECT rtrim(path, '/') AS path FROM {_PATHS}) WHERE path <> '')"""
)
def discovery(spark, sf_dir):
    rows = sources.page_targets(table(spark, sf_dir, "pages")).select(F.expr("rtrim('/', path)").alias("path")).filter("path <> ''")
    rows = rows.select("path", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("n"))
    return sources.discover(rows.select(F.expr(_TARGET).alias("target"), F.expr(_KIND).alias("kind")).distinct())


_FILES = "'/d' || path || CASE length(path) % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DocX' ELSE '.html' END"


@query(
    f"""WITH f AS (SELECT DISTINCT {_FILES} AS path FROM (SELECT rtrim(path, '/') AS path FROM {_PATHS}) WHERE path <> ''),
t AS (SELECT DISTINCT '/d/' || string_split(path, '/')[2] AS folder FROM (SELECT rtrim(path, '/') AS path FROM {_PATHS}) WHERE path <> '' AND length(string_split(path, '/')[2]) % 2 = 0)
SELECT path FROM f WHERE regexp_matches(lower(path), '\\.(pdf|docx)$') AND (EXISTS (SELECT 1 FROM t WHERE starts_with(path, folder || '/')) OR length(path) % 5 = 0)"""
)
def folder_documents(spark, sf_dir):
    rows = sources.page_targets(table(spark, sf_dir, "pages")).select(F.expr("rtrim('/', path)").alias("path")).filter("path <> ''")
    files = rows.select(F.expr(_FILES).alias("path")).distinct()
    top = rows.select(F.split("path", "/")[1].alias("top")).filter("length(top) % 2 = 0")
    targets = top.select(F.expr("'/d//x/../' || top || '/'").alias("target"), F.lit("folder").alias("kind"))
    targets = targets.union(files.filter("length(path) % 5 = 0").select("path", F.lit("file"))).distinct()
    return sources.documents_of(targets, files)


# --- requests -------------------------------------------------------------------------------------------------------------

_ASK = (
    "CASE turn % 6 WHEN 0 THEN 'find typos in ' || text WHEN 1 THEN 'where is \"' || substr(text, 1, 12) || '\" mentioned' WHEN 2 THEN 'search every document for ' || text "
    "WHEN 3 THEN 'check the links and the spelling, ' || text WHEN 4 THEN text ELSE 'run all checks on ' || text END"
)
_REQUESTS = f"(SELECT conv_id * 1000 + turn AS id, trim({_ASK}) AS request FROM conversations)"
_RULE = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({{0}}), {quote(w)})' for w in ws)} THEN {quote(f)}" for f, ws in router.RULES) + f" ELSE {quote(router.DEFAULT)} END"
_WHY = "CASE " + " ".join(f"WHEN contains(lower({{0}}), {quote(w)}) THEN {quote(f'matched the keyword {quote(w)}')}" for _, ws in router.RULES for w in ws) + " ELSE 'no check-specific wording; treating the request as a search' END"
_CLAUSES = f"list_filter(string_split_regex({{0}}, {quote(router.CLAUSE)}), lambda c: trim(c) <> '')"
_QUOTED, _ACRONYM = quote(router.QUOTED), r"'(?:^|[^\p{L}\p{N}_])([A-Z][A-Z0-9_]+)(?:[^\p{L}\p{N}_]|$)'"
_REST = f"list_filter(regexp_extract_all(lower({{0}}), '[A-Za-z0-9_]+'), lambda w: w NOT IN {listed(router.STOPWORDS)})"
_KEYWORDS = (
    f"CASE WHEN trim(regexp_extract({{0}}, {_QUOTED}, 1)) <> '' THEN trim(regexp_extract({{0}}, {_QUOTED}, 1)) WHEN regexp_extract({{0}}, {_ACRONYM}, 1) <> '' THEN regexp_extract({{0}}, {_ACRONYM}, 1) "
    f"WHEN len({_REST}) > 0 THEN array_to_string({_REST}, ' ') ELSE {{0}} END"
)
_STANDARD = "[" + ", ".join(map(quote, router.STANDARD)) + "]"

def _in_order(xs: str) -> str:
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


def _requests(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.trim(F.expr(_ASK)).alias("request"))


_ROUTED = f"(SELECT id, request, cs, fs, {_in_order('fs')} AS names FROM (SELECT *, list_transform(cs, lambda c: {at(_RULE, 'c')}) AS fs FROM (SELECT *, {at(_CLAUSES, 'request')} AS cs FROM {_REQUESTS})))"
_EVERY = f"regexp_matches(request, {quote(router.EVERYTHING)})"


@query(
    f"""SELECT id, CASE WHEN request = '' OR {_EVERY} THEN {_STANDARD} WHEN len(names) > 1 THEN names ELSE [{at(_RULE, 'request')}] END AS features, {at(_KEYWORDS, 'request')} AS keywords FROM {_ROUTED}"""
)
def router_requests(spark, sf_dir):
    return _requests(spark, sf_dir).select("id", router.features(F.col("request")).alias("features"), router.keywords(F.col("request")).alias("keywords"))


_OPTION = f"CASE {{1}} WHEN 'keyword_search' THEN {{0}} WHEN 'multi_doc_keyword_search' THEN {_KEYWORDS} END"


@query(
    f"""WITH r AS {_ROUTED},
c AS (SELECT id, i, trim(cs[i]) AS c, fs[i] AS f FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM r)),
o AS (SELECT id, last(q ORDER BY i) AS query FROM (SELECT id, i, {at(_OPTION, 'c', 'f')} AS q FROM (SELECT *, row_number() OVER (PARTITION BY id, f ORDER BY i) AS n FROM c) WHERE n = 1) WHERE q IS NOT NULL GROUP BY id)
SELECT id, CASE WHEN request = '' OR {_EVERY} THEN {_STANDARD} WHEN len(names) > 1 THEN names ELSE [{at(_RULE, 'request')}] END AS features,
  CASE WHEN request = '' OR {_EVERY} THEN NULL WHEN len(names) > 1 THEN o.query ELSE {at(_OPTION, 'request', at(_RULE, 'request'))} END AS query, 'rules' AS method, NULL::DOUBLE AS confidence,
  CASE WHEN request = '' THEN 'empty request; running the standard checks' WHEN {_EVERY} THEN 'asked for a full check' WHEN len(names) > 1 THEN 'compound request; routed ' || len(cs) || ' clauses separately'
    ELSE {at(_WHY, 'request')} END AS reason FROM r LEFT JOIN o USING (id)"""
)
def routed_requests(spark, sf_dir):
    return router.route(_requests(spark, sf_dir))


#: Requests in words of their own, and the feature each is meant for.
_LABELLED = (
    ("are any of the links dead", "broken_links"), ("does the toc still point to the right places", "broken_links"), ("verify each cross-reference", "broken_links"), ("which reference goes nowhere", "broken_links"),
    ("fix my spelling", "spell_check"), ("point out typos please", "spell_check"), ("did I misspell anything", "spell_check"), ("is there a wrong word somewhere", "spell_check"),
    ("what does it say on handover", "keyword_search"), ("timer expiry behaviour", "keyword_search"), ("show the part on paging", "keyword_search"), ("explain the retry limit", "keyword_search"),
    ("look for PIN across the manuals", "multi_doc_keyword_search"), ("scan the folder for SIM", "multi_doc_keyword_search"), ("which of all documents name RSRP", "multi_doc_keyword_search"), ("compare our manuals on MOCN", "multi_doc_keyword_search"),
)
_LABELLED_SQL = "(VALUES " + ", ".join(f"({quote(a)}, {quote(b)})" for a, b in _LABELLED) + ") AS v(request, expected)"


@query(f"SELECT avg(CASE WHEN {at(_RULE, 'request')} = expected THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy FROM {_LABELLED_SQL}")
def routing_accuracy(spark, sf_dir):
    rows = spark.createDataFrame(_LABELLED, "request string, expected string")
    return router.accuracy(rows.withColumn("features", router.features(F.col("request"))))


_AXES = {"broken_links": 0, "keyword_search": 1, "spell_check": 2}


@query(
    """SELECT id, CASE WHEN m < 0.1 THEN NULL WHEN a = m THEN 'broken_links' WHEN b = m THEN 'keyword_search' ELSE 'spell_check' END AS feature, round(m, 6) AS score FROM (
  SELECT *, greatest(a, b, c) AS m FROM (SELECT vec_id AS id, embedding[1]::DOUBLE / n AS a, embedding[2]::DOUBLE / n AS b, embedding[3]::DOUBLE / n AS c FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)))"""
)
def nearest_feature(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    dims = rows.select(F.size("vector")).first()[0]
    found = router.nearest(rows, {f: [1.0 if i == j else 0.0 for j in range(dims)] for f, i in _AXES.items()}, 0.1)
    return found.withColumn("score", F.round("score", 6))


@query(
    """SELECT DISTINCT keyword, CASE WHEN x = '' THEN 'search' ELSE x END AS slug FROM (SELECT keyword, lower(regexp_replace(regexp_replace(keyword, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))[1:40] AS x
FROM (SELECT substr(text, 1, 60) AS keyword FROM conversations))"""
)
def report_slugs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.substring("text", 1, 60).alias("keyword")).distinct()
    return rows.select("keyword", X.slug(F.col("keyword")).alias("slug"))


@query(
    """SELECT ord, CASE WHEN n = 1 THEN base ELSE feature[1:28] || '~' || n END AS title
FROM (SELECT *, feature[1:31] AS base, row_number() OVER (PARTITION BY feature[1:31] ORDER BY ord) AS n FROM (SELECT doc_id AS ord, source || '_' || substr(text, 1, 40) AS feature FROM documents))"""
)
def sheet_titles(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.concat("source", F.lit("_"), F.substring("text", 1, 40)).alias("feature"))
    return findings.sheet_titles(rows)


# --- contexts and chunks ----------------------------------------------------------------------------------------------------

_BREAK = quote(r"""[.!?]["')\]”’]*\s+""")
_STARTS = "(list_sum(list_transform({1}[1:{2}], lambda z: length(z))) + coalesce(list_sum(list_transform({0}[1:{2} - 1], lambda z: length(z))), 0))::INTEGER"
_TIDY = r"trim(regexp_replace(replace({}, '­', ''), '\s+', ' ', 'g'))"


@query(
    rf"""WITH o AS ({ORACLE_SQL["corpus_occurrences"].replace("= 'the'", "= 'that'")}),
b AS (SELECT doc_id, unit_ord, line, bs, gs, CASE WHEN len(bs) > 0 THEN list_transform(range(1, len(bs) + 1), lambda i: {{'s': {_STARTS.format('bs', 'gs', 'i')}, 'n': length(bs[i])}}) ELSE [] END AS br
  FROM (SELECT doc_id, unit_ord, line, regexp_extract_all(line, {_BREAK}) AS bs, string_split_regex(line, {_BREAK}) AS gs FROM ({LINES}))),
j AS (SELECT o.*, b.line, o.start + 4 AS fin, length(b.line) AS n, list_max(list_transform(list_filter(br, lambda x: x.s + x.n <= o.start AND x.s >= o.start - 250), lambda x: x.s + x.n)) AS l0,
  list_min(list_transform(list_filter(br, lambda x: x.s >= o.start + 4 AND x.s <= o.start + 4 + 250), lambda x: x.s + length(rtrim(line[x.s + 1:x.s + x.n], ' ' || chr(9) || chr(10) || chr(13))))) AS r0
  FROM o JOIN b ON b.doc_id = o.doc_id AND b.unit_ord = o.paragraph_index),
k AS (SELECT *, coalesce(l0, CASE WHEN start <= 250 THEN 0 END) AS l, coalesce(r0, CASE WHEN n - fin <= 250 THEN n END) AS r, greatest(start - 80, 0) AS low, least(fin + 80, n) AS high FROM j)
SELECT doc_id, page, paragraph_index, 'that' AS keyword, start, match_text, occurrence_index,
  CASE WHEN l IS NOT NULL AND r IS NOT NULL AND r - l <= 250 THEN {_TIDY.format('line[l + 1:r]')}
    ELSE CASE WHEN low > 0 THEN '...' ELSE '' END || {_TIDY.format(r"CASE WHEN low > 0 THEN regexp_replace(line[low + 1:start], '^[^\s]*\s', '') ELSE line[low + 1:start] END || line[start + 1:fin] || CASE WHEN high < n THEN regexp_replace(line[fin + 1:high], '\s[^\s]*$', '') ELSE line[fin + 1:high] END")}
      || CASE WHEN high < n THEN '...' ELSE '' END END AS context FROM k"""
)
def corpus_contexts(spark, sf_dir):
    return keyword.occurrences(keyword.line_units(table(spark, sf_dir, "documents")), "that")


def _chunk_sql(units: str) -> str:
    """Chunks of (doc_id, unit_ord, line): doc_id, unit_ord, pos, char_start, text. Pieces first, then greedy packing."""
    return rf"""(WITH RECURSIVE u AS (SELECT row_number() OVER () AS rid, doc_id, unit_ord, line FROM {units}),
s0 AS (SELECT rid, line, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT rid, line, regexp_extract_all(line, '(?s).*?[.!?]\s+|.+') AS ss FROM u WHERE line <> '')),
s1 AS (SELECT rid, line, (coalesce(list_sum(list_transform(ss[1:i - 1], lambda z: length(z))), 0))::BIGINT AS a, ss[i] AS x FROM s0),
s2 AS (SELECT rid, line, a, a + length(CASE WHEN regexp_matches(x, '(?s)[.!?]\s+$') THEN regexp_replace(x, '\s+$', '') ELSE x END) AS e FROM s1),
cuts AS (
  SELECT rid, line, a, e, 0::BIGINT AS stop, a AS cursor, 0 AS k FROM s2 WHERE trim(line[a + 1:e], ' ' || chr(9) || chr(13)) <> ''
  UNION ALL
  SELECT rid, line, a, e, st, CASE WHEN st < e AND line[st + 1] = ' ' THEN st + 1 ELSE st END, k + 1 FROM (
    SELECT *, CASE WHEN cursor + 400 >= e THEN e WHEN strpos(reverse(line[cursor + 2:cursor + 400]), ' ') > 0 THEN cursor + 400 - strpos(reverse(line[cursor + 2:cursor + 400]), ' ') ELSE cursor + 400 END AS st FROM cuts WHERE cursor < e)),
p AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY x, stop) AS j, x, stop AS y FROM (
    SELECT rid, line, stop, k, coalesce(lag(cursor) OVER (PARTITION BY rid, a ORDER BY k), a) AS x FROM cuts) WHERE k > 0 AND trim(line[x + 1:stop], ' ' || chr(9) || chr(13)) <> ''),
packed AS (
  SELECT rid, j, x AS first, x AS last, y AS fin, 1 AS chunk FROM p WHERE j = 1
  UNION ALL
  SELECT p.rid, p.j, CASE WHEN p.y - q.first <= 400 THEN q.first WHEN p.y - q.last <= 400 THEN q.last ELSE p.x END, p.x, p.y, CASE WHEN p.y - q.first <= 400 THEN q.chunk ELSE q.chunk + 1 END
  FROM packed q JOIN p ON p.rid = q.rid AND p.j = q.j + 1),
c AS (SELECT rid, chunk, min(first) AS a, max(fin) AS b FROM packed GROUP BY rid, chunk)
SELECT doc_id, unit_ord, chunk AS pos, a AS char_start, line[a + 1:b] AS text FROM c JOIN u USING (rid))"""


@query(
    f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY unit_ord, pos) - 1)::INTEGER AS chunk_index, 1 AS page, unit_ord::INTEGER AS paragraph_index, char_start::INTEGER AS char_start, text
FROM {_chunk_sql(f"({LINES})")}"""
)
def chunks(spark, sf_dir):
    return structure.chunks(keyword.line_units(table(spark, sf_dir, "documents")))


_VOWELS = "aeiou"


def vowel_encoder():
    """Counts of vowels: a stand-in encoder whose inner products are whole numbers, so that SQL has the same."""
    return lambda texts: [[float(t.count(v)) for v in _VOWELS] for t in texts]


def _count(text: str, v: str) -> str:
    return f"(length({text}) - length(replace({text}, '{v}', '')))"


_ASKED_FOR = semantic.QUERY_PREFIX + "the"


@query(
    f"""WITH t AS (SELECT conv_id AS doc_id, turn + 1 AS unit_ord, text AS line FROM conversations),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit_ord, pos) - 1 AS chunk_index FROM {_chunk_sql("t")}),
s AS (SELECT *, {" + ".join(f"{_ASKED_FOR.count(v)} * {_count('text', v)}" for v in _VOWELS)} AS score FROM c WHERE NOT regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])the([^\\p{{L}}\\p{{N}}_]|$)')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, unit_ord, chunk_index) AS rank FROM s)
SELECT doc_id::VARCHAR AS doc_id, rank::BIGINT AS ord, unit_ord::INTEGER AS page, score::DOUBLE AS confidence FROM r WHERE rank <= 5"""
)
def search_passages(spark, sf_dir):
    """The semantic third of keyword search over all conversations."""
    unit = keyword.page_units(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    tables = {"paragraphs": unit.limit(0).select("doc_id", "page", F.col("paragraph_index").alias("index"), "text"), "pages": unit.select("doc_id", F.col("page").alias("number"), "text")}
    found, _ = engine.run(tables, "keyword_search", {"query": "the", "encoder": vowel_encoder, "encoder_dim": 5})
    return found.filter("part = 2").select("doc_id", "ord", "page", "confidence")


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'suggested: ' || source || ' (p' || (doc_id % 9) || ')  |  confidence 0.95' WHEN doc_id % 3 = 1 THEN 'no confident suggestion' ELSE '' END AS detail,
  CASE WHEN doc_id % 3 = 0 THEN source || ' (p' || (doc_id % 9) || ')' ELSE '—' END AS suggestion, n_chars || CASE WHEN n_chars = 1 THEN ' match' ELSE ' matches' END AS matches FROM documents"""
)
def finding_details(spark, sf_dir):
    page = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 9)
    made = F.struct(F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("suggested_heading"), page.alias("suggested_page"), F.when(F.col("doc_id") % 3 < 2, "Section").alias("reference_type"), F.when(F.col("doc_id") % 3 == 0, 0.95).alias("suggestion_confidence"))
    rows = table(spark, sf_dir, "documents").withColumn("details", F.to_json(made))
    return rows.select(
        "doc_id", reports.finding_detail(F.col("details"), F.lit(None).cast("double")).alias("detail"), reports.suggestion(F.col("details")).alias("suggestion"), reports.plural(F.col("n_chars"), "match").alias("matches")
    )
