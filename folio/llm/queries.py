"""One query opN_<name> for each corpus operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archive, decontaminate, language, licenses, lm, packing, secrets, sharding, simhash, topk
from .common import read_table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read_table(spark, sf_dir, "documents"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(read_table(spark, sf_dir, "embeddings"))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive_pages(read_table(spark, sf_dir, "pages"))


def op4_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(read_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(read_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op9_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_topk_search,
        op3_warc_archive,
        op4_slot_sharding,
        op5_license_scan,
        op6_simhash_dedup,
        op7_secret_scan,
        op8_language_id,
        op9_length_packing,
        op10_decontamination,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    return f"regexp_extract_all({_LOWER.format(f"coalesce({text}, '')")}, '{_ALNUM}')"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
) WHERE rank <= 5
"""

_WARC = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (payload_digest)
"""

_DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words("text")} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item, m, array_to_string(w[p:p + m - 1], ' ') AS g FROM (
    SELECT item, w, least(8, len(w)) AS m, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS p FROM i WHERE len(w) > 0
  )
),
dw AS (
  SELECT rid, m, p, array_to_string(w[p:p + m - 1], ' ') AS g FROM (
    SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m
  )
),
hits AS (SELECT rid, item, m, p FROM dw JOIN iw USING (m, g)),
covered AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + m)) AS q FROM hits) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(items.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered c USING (rid) LEFT JOIN items USING (rid)
"""


def _license_sql() -> str:
    rows = ", ".join(f"({_quote(name)}, {_quote(text)})" for name, text in licenses.TEMPLATES)
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    templates = licenses.Templates()
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (
  SELECT rid, i, ls[i] AS line, {_words("ls[i]")} AS w FROM (
    SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT rid, string_split(t, chr(10)) AS ls FROM d)
  )
),
r AS (SELECT *, sum(CASE WHEN len(w) > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM l),
p AS (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY run) AS k, flatten(list(w ORDER BY i)) AS w, count(*) AS n
  FROM r WHERE len(w) > 0 GROUP BY rid, run
),
q AS (
  SELECT rid, k, w, n, {grams} AS b FROM p WHERE len({grams}) <= {templates.high}
  UNION ALL
  SELECT rid, k, w, n, {grams} AS b FROM (SELECT q.rid, p.k, q.w || p.w AS w, q.n + p.n AS n FROM q JOIN p ON p.rid = q.rid AND p.k = q.k + 1)
  WHERE len({grams}) <= {templates.high}
),
u AS (
  SELECT rid, w FROM l
  UNION ALL SELECT rid, {_words("s")} FROM (
    SELECT rid, unnest(string_split_regex(line, '[.;!?][ \\t]+')) AS s FROM l WHERE regexp_matches(line, '[.;!?][ \\t]+'))
  UNION ALL SELECT rid, w FROM q WHERE n > 1
),
g AS (SELECT rid, row_number() OVER () AS uid, {grams} AS b FROM u),
t AS (SELECT name, {grams} AS b FROM (SELECT name, {_words("text")} AS w FROM (VALUES {rows}) AS v(name, text))),
s AS (
  SELECT rid, uid, name, 2 * len(list_intersect(g.b, t.b)) / (len(g.b) + len(t.b))::DOUBLE AS dice
  FROM g JOIN t ON 2 * least(len(g.b), len(t.b)) >= {licenses.LEAST} * (len(g.b) + len(t.b))
),
m AS (
  SELECT rid, count(DISTINCT uid) AS n, first(name ORDER BY dice DESC, name) AS name, max(dice) AS dice
  FROM s WHERE dice >= {licenses.LEAST} GROUP BY rid
)
SELECT doc_id, name AS license, dice, coalesce(n, 0)::BIGINT AS n_matches FROM d LEFT JOIN m USING (rid)
"""


def _secret_sql() -> str:
    parts = []
    for k, rule in enumerate(secrets.RULES):
        pattern = rule.pattern
        if rule.flags:  # letters in either case, spelt out
            out, inside = "", False
            for i, c in enumerate(pattern):
                escaped = i and pattern[i - 1] == "\\"
                inside = (inside or c == "[") and c != "]"
                hexa = i > 2 and pattern[i - 3 : i - 1] == "\\x" or i > 1 and pattern[i - 2 : i] == "\\x"
                out += f"[{c.upper()}{c.lower()}]" if c.isalpha() and not inside and not escaped and not hexa else c
            pattern = out
        if rule.kind == "hex":  # runs are maximal, so the shorter ones need not be listed
            pattern = "[0-9a-f]{16,}"
        q = _quote(pattern)
        kept = f"length(regexp_extract(x, {q}, {rule.group})) >= {rule.least}" if rule.least else "true"
        parts.append(f"""
SELECT rid, {k} AS k, '{rule.kind}' AS kind, s, s + length(x) AS e FROM (
  SELECT rid, ms[i] AS x,
    (list_sum(list_transform(gs[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda z: length(z))), 0))::BIGINT AS s
  FROM (SELECT rid, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT rid, regexp_extract_all(t, {q}) AS ms, string_split_regex(t, {q}) AS gs FROM d WHERE regexp_matches(t, {q})))
) WHERE {kept}""")
    count = lambda kind: f"count(*) FILTER (kind = '{kind}')"
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE_RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
a AS (
  SELECT rid, {", ".join(f"{count(r.kind)} AS n_{r.kind}" for r in secrets.BASE_RULES)},
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (kind IN ({base})) AS b,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM f GROUP BY rid
)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secrets.BASE_RULES)},
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""


ORACLE_SQL: dict[str, str] = {
    "op2_topk_search": _TOPK,
    "op3_warc_archive": _WARC,
    "op5_license_scan": _license_sql(),
    "op7_secret_scan": _secret_sql(),
    "op10_decontamination": _DECONTAMINATION,
}
