"""What is done with findings: capped lists, filters, summaries, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 100


def truncate(findings: DataFrame, limit: int = LIMIT, keys: tuple[str, ...] = (), scarce: str = "semantic") -> DataFrame:
    """At most `limit` findings (of each key), scarce ones (match_type) first in line for a place; order as given by `ord`.

    Others keep their head up to what the scarce ones leave. Over the limit the others come first.
    """
    by = [F.col(k) for k in keys] or [F.lit(0)]
    rare = F.col("match_type") == scarce
    whole = Window.partitionBy(*by)
    rows = findings.withColumn("__rare", rare).withColumn("__all", F.count(F.lit(1)).over(whole))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by, "__rare").orderBy("ord")))
    rows = rows.withColumn("__room", F.greatest(F.lit(0), F.lit(limit) - F.sum(F.col("__rare").cast("int")).over(whole)))
    rows = rows.filter(F.col("__rare") | (F.col("__all") <= limit) | (F.col("__n") <= F.col("__room")))
    over = F.col("__all") > limit
    order = Window.partitionBy(*by).orderBy(F.when(over & F.col("__rare"), 1).otherwise(0), "ord")
    rows = rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
    return rows.select(*findings.columns, "position")


def per_document(findings: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, match_count, listed, truncated): true counts, and how many of the first `limit` are listed."""
    out = findings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("match_count"))
    return out.select("doc_id", "match_count", F.least("match_count", F.lit(limit)).cast("long").alias("listed"), (F.col("match_count") > limit).alias("truncated"))


def search(findings: DataFrame, text: str, document: str | None = None, feature: str | None = None) -> DataFrame:
    """Findings of a document and feature in whose columns the text occurs, in either case."""
    parts = F.lower(F.concat_ws(" ", "document", "page", "feature", "message", "suggestion"))
    rows = findings.filter(parts.contains(text.lower()))
    rows = rows if document is None else rows.filter(F.col("document") == document)
    return rows if feature is None else rows.filter(F.col("feature") == feature)


def neighbours(findings: DataFrame) -> DataFrame:
    """Findings numbered from 1 by document and order, with the numbers before and after.

    Rows are numbered within their document; only one row a document meets in one place, for the running total.
    """
    sizes = findings.groupBy("document").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy(F.asc_nulls_first("document"))) - F.col("__n")
    sizes = sizes.select(F.col("document").alias("__document"), before.alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    rows = findings.withColumn("id", F.row_number().over(Window.partitionBy("document").orderBy("ord")))
    rows = rows.join(sizes, F.col("document").eqNullSafe(F.col("__document"))).withColumn("id", F.col("id") + F.col("__before"))
    rows = rows.withColumns({"previous_id": F.when(F.col("id") > 1, F.col("id") - 1), "next_id": F.when(F.col("id") < F.col("__all"), F.col("id") + 1)})
    return rows.drop("__document", "__before", "__all")


def history(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: documents, pages, findings in all and of each feature."""
    pages = documents.select(F.lit(1).alias("d"), F.coalesce("page_count", F.lit(0)).alias("p"), F.lit(None).cast("string").alias("feature"))
    rows = pages.unionByName(findings.select(F.lit(0).alias("d"), F.lit(0).alias("p"), "feature"))
    of = lambda f: F.count_if(F.col("feature") == f).alias(f)
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    features = ("broken_links", "keyword_search", "multi_doc_keyword_search", "spell_check")
    return rows.agg(total("d", "documents"), total("p", "pages"), F.count("feature").alias("findings"), *map(of, features))


def summary(results: DataFrame, findings: DataFrame) -> DataFrame:
    """Each result (doc_id, feature, status, error) with its number of findings."""
    n = findings.groupBy("doc_id", "feature").agg(F.count(F.lit(1)).alias("findings"))
    return results.join(n, ["doc_id", "feature"], "left").withColumn("findings", F.coalesce("findings", F.lit(0)).cast("long"))


def sheet_titles(features: DataFrame) -> DataFrame:
    """(ord, title) of 31 characters at most; a title taken already becomes its first 28 and ~n, n from 2."""
    base = F.substring("feature", 1, 31)
    n = F.row_number().over(Window.partitionBy(F.substring("feature", 1, 31)).orderBy("ord"))
    return features.withColumn("n", n).select("ord", F.when(F.col("n") == 1, base).otherwise(F.concat(F.substring("feature", 1, 28), F.lit("~"), F.col("n"))).alias("title"))


def group_headers(rows: DataFrame) -> DataFrame:
    """Rows with `new_document` at the first of each document, in order of document and `ord`."""
    first = F.row_number().over(Window.partitionBy("document").orderBy("ord")) == 1
    return rows.withColumn("new_document", first)
