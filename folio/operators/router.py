"""Routing of plain-language requests to checks, as columns: by rules, or by the nearest description where an encoder is given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
RULES = (
    ("broken_links", ["link", "links", "cross-reference", "cross reference", "reference", "toc", "table of contents", "broken"]),
    ("spell_check", ["spell", "spelling", "typo", "typos", "misspell", "grammar", "wrong word"]),
    ("multi_doc_keyword_search", ["across", "every document", "all documents", "each document", "folder", "these files"]),
)
DEFAULT = "keyword_search"
STANDARD = ["broken_links", "keyword_search", "spell_check"]
EVERYTHING = r"(?i)\b(everything|all (?:the )?checks?|full check|check it all|complete check|run all)\b"
CLAUSE = r"(?i)\s*(?:,|;|\band\b|\balso\b|\bplus\b)\s*"
STOPWORDS = (
    "a", "about", "across", "all", "an", "and", "any", "are", "be", "ch", "check", "doc", "docs", "document", "documents", "does", "each", "every", "explain", "explains",
    "file", "files", "find", "for", "in", "is", "it", "list", "look", "me", "mention", "mentions", "occurrence", "occurrences", "of", "pdf", "pdfs", "say", "says", "search",
    "show", "tell", "that", "the", "these", "this", "those", "to", "what", "where", "which", "with",
)
THRESHOLD = 0.55
QUOTED, ACRONYM = r"""["“‘'](.+?)["”’']""", r"(?<![\p{L}\p{N}_])([A-Z][A-Z0-9_]+)(?![\p{L}\p{N}_])"


def by_rules(text: Column) -> Column:
    """The first feature one of whose words occurs, else keyword search."""
    low = F.lower(text)
    out = None
    for feature, words in RULES:
        hit = None
        for w in words:
            hit = low.contains(w) if hit is None else hit | low.contains(w)
        out = F.when(hit, feature) if out is None else out.when(hit, feature)
    return out.otherwise(DEFAULT)


def features(request: Column) -> Column:
    """The features of a request: the standard ones if blank or for everything, those of its clauses if several, else one."""
    clauses = F.filter(F.split(request, CLAUSE), lambda c: F.trim(c) != "")
    several = F.array_distinct(F.transform(clauses, by_rules))
    standard = F.array(*map(F.lit, STANDARD))
    blank = request.isNull() | (F.trim(request) == "")
    return F.when(blank | request.rlike(EVERYTHING), standard).when(F.size(several) > 1, several).otherwise(F.array(by_rules(request)))


def keywords(request: Column) -> Column:
    """What to search for: a quoted phrase, else the first word in capitals, else the words that are no stopwords."""
    quoted, acronym = F.regexp_extract(request, QUOTED, 1), F.regexp_extract(request, ACRONYM, 1)
    words = F.filter(F.regexp_extract_all(F.lower(request), F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda w: ~w.isin(*STOPWORDS))
    rest = F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(request)
    return F.when(F.trim(quoted) != "", F.trim(quoted)).when(acronym != "", acronym).otherwise(rest)


def nearest(vectors: DataFrame, descriptions: dict[str, list[float]], threshold: float = 0.55) -> DataFrame:
    """(id, feature, score): the description nearest to each request vector, null below the threshold; ties: the first one."""
    from .semantic import cosine

    listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("feature"), F.array(*map(F.lit, v)).alias("d")) for i, (f, v) in enumerate(descriptions.items())])
    scored = F.transform(listed, lambda x: F.struct(cosine(F.col("vector"), x["d"]).alias("score"), (-x["i"]).alias("i"), x["feature"].alias("feature")))
    best = vectors.select("id", F.array_max(scored).alias("b"))
    return best.select("id", F.when(F.col("b.score") >= threshold, F.col("b.feature")).alias("feature"), F.col("b.score").alias("score"))


#: What each feature does, for an encoder to compare requests with.
DESCRIPTIONS = {
    "broken_links": "check that links, references and tables of contents lead somewhere",
    "keyword_search": "look for a topic or term in one document",
    "spell_check": "look for misspelt words",
    "multi_doc_keyword_search": "look for a term in many documents at once",
}


def by_rules_with_reason(text: Column) -> Column:
    """struct<feature, method, confidence, reason> of one request or clause by the rules."""
    low, out = F.lower(text), None
    for feature, words in RULES:
        for w in words:
            made = F.struct(F.lit(feature).alias("feature"), F.lit("rules").alias("method"), F.lit(None).cast("double").alias("confidence"), F.lit(f"matched the keyword '{w}'").alias("reason"))
            out = F.when(low.contains(w), made) if out is None else out.when(low.contains(w), made)
    rest = F.lit("no check-specific wording; treating the request as a search")
    return out.otherwise(F.struct(F.lit(DEFAULT).alias("feature"), F.lit("rules").alias("method"), F.lit(None).cast("double").alias("confidence"), rest.alias("reason")))


def option_of(feature: Column, text: Column) -> Column:
    """The query that a feature is given: the text itself, its one term for the search of a corpus, none for checks."""
    return F.when(feature == "keyword_search", text).when(feature == "multi_doc_keyword_search", keywords(text))


def route(requests: DataFrame, make_encoder: Callable | None = None, descriptions: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """requests (id, request) as id, features, query, method, confidence, reason.

    Each clause (and the whole, where clauses agree) goes to the nearest description if an encoder is given, its vector is
    known and near enough; to the rules otherwise. An encoder that fails leaves all to the rules.
    """
    from .semantic import embed, unavailable

    text = F.trim(F.coalesce("request", F.lit("")))
    clauses = F.transform(F.filter(F.split(text, CLAUSE), lambda c: F.trim(c) != ""), F.trim)
    rows = requests.select("id", text.alias("request"), clauses.alias("clauses"))
    pieces = rows.select("id", "request", F.size("clauses").alias("n"), F.posexplode(F.concat(F.array("request"), "clauses")).alias("pos", "text"))
    pieces = pieces.filter((F.col("pos") == 0) | (F.col("n") > 1))
    made = by_rules_with_reason(F.col("text"))
    if make_encoder is not None and unavailable(make_encoder) is None:
        names = descriptions or DESCRIPTIONS
        vectors = [[float(x) for x in v] for v in make_encoder()(list(names.values()))]
        found = embed(pieces.select(F.struct("id", "pos").alias("id"), "text"), make_encoder).filter("embedding IS NOT NULL")
        near = nearest(found.withColumnRenamed("embedding", "vector"), dict(zip(names, vectors)), threshold).filter("feature IS NOT NULL")
        near = near.select("id.id", "id.pos", F.col("feature").alias("near"), "score")
        pieces = pieces.join(near, ["id", "pos"], "left")
        why = F.concat(F.lit("closest match to the "), "near", F.lit(" description ("), F.format_string("%.2f", "score"), F.lit(")"))
        by_meaning = F.struct(F.col("near").alias("feature"), F.lit("semantic").alias("method"), F.round("score", 3).alias("confidence"), why.alias("reason"))
        made = F.when(F.col("near").isNotNull(), by_meaning).otherwise(made)
    pieces = pieces.withColumn("d", made).withColumn("query", option_of(F.col("d.feature"), F.col("text")))
    got = pieces.groupBy("id").agg(
        F.first("request").alias("request"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "d", "query"))).alias("all")
    )
    several = F.filter("all", lambda x: x["pos"] > 0)
    names = F.array_distinct(F.transform(several, lambda x: x["d"]["feature"]))
    first = lambda name: F.element_at(F.filter(several, lambda x: x["d"]["feature"] == name), 1)
    queries = F.filter(F.transform(names, lambda x: first(x)["query"]), lambda x: x.isNotNull())
    methods = F.array_join(F.array_sort(F.array_distinct(F.transform(several, lambda x: x["d"]["method"]))), "+")
    whole = F.col("all")[0]
    standard, none = F.array(*map(F.lit, STANDARD)), F.lit(None)
    case = lambda blank, every, compound, one: F.when(F.col("request") == "", blank).when(F.col("request").rlike(EVERYTHING), every).when(F.size(names) > 1, compound).otherwise(one)
    return got.select(
        "id",
        case(standard, standard, names, F.array(whole["d"]["feature"])).alias("features"),
        case(none, none, F.get(queries, F.size(queries) - 1), whole["query"]).cast("string").alias("query"),
        case(F.lit("rules"), F.lit("rules"), methods, whole["d"]["method"]).alias("method"),
        case(none, none, none, whole["d"]["confidence"]).cast("double").alias("confidence"),
        case(
            F.lit("empty request; running the standard checks"),
            F.lit("asked for a full check"),
            F.concat(F.lit("compound request; routed "), F.col("n"), F.lit(" clauses separately")),
            whole["d"]["reason"],
        ).alias("reason"),
    )


def accuracy(routed: DataFrame) -> DataFrame:
    return routed.agg(F.avg((F.element_at("features", 1) == F.col("expected")).cast("double")).alias("accuracy"))
