"""Reports of findings: workbooks, streamed through the driver a sheet at a time, and tables through Spark's writers."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.findings import LIMIT

from .office import write_xlsx

SHEET_ROWS = 1_048_575


def keyword_sheet(occurrences: DataFrame) -> DataFrame:
    return occurrences.select(
        F.col("document").alias("Document"), F.col("page").alias("Page"), F.col("keyword").alias("Keyword"), F.col("match_text").alias("Match"), F.col("context").alias("Context")
    )


def _sheets(title: str, header: list[str], rows: Iterator, **more) -> tuple[list[dict], int]:
    """Rows in as many sheets as they need, numbered from the second on, and how many rows there are. None are left out."""
    sheets, total = [], 0
    while True:
        own = list(itertools.islice(rows, SHEET_ROWS))
        if sheets and not own:
            return sheets, total
        name = title if not sheets else f"{title[:24]} ({len(sheets) + 1})"
        sheets.append({"title": name, "header": header, "rows": own, **more})
        total += len(own)
        if len(own) < SHEET_ROWS:
            return sheets, total


def write_keyword_report(occurrences: DataFrame, path: str) -> str:
    """Occurrences in the order of document and occurrence; a sheet holds SHEET_ROWS, more go to further sheets."""
    rows = (list(r) for r in keyword_sheet(occurrences.orderBy("document", "occurrence_index")).toLocalIterator())
    sheets, _ = _sheets("Keyword Search", ["Document", "Page", "Keyword", "Match", "Context"], rows, widths=(32, 8, 18, 18, 100), wrapped=(4,))
    return _write(path, sheets)


def write_report(results: list[tuple[str, str, DataFrame, list[str], str | None]], path: str) -> str:
    """A summary sheet and those of each (feature, status, findings, detail columns, error); the summary counts all findings."""
    sheets, summary, taken = [], [], {}
    for feature, status, findings, columns, error in results:
        title = feature[:31]
        taken[title] = taken.get(title, 0) + 1
        title = title if taken[title] == 1 else f"{feature[:28]}~{taken[title]}"
        rows = (list(r) for r in findings.select("page", "message", "confidence", *columns).toLocalIterator())
        own, n = _sheets(title, ["page", "message", "confidence", *columns], rows)
        summary.append([feature, status, n, error])
        sheets += own
    return _write(path, [{"title": "Summary", "header": ["Feature", "Status", "Findings", "Error"], "rows": summary}, *sheets])


def write_overview(findings: DataFrame, path: str) -> str:
    """A workbook of all findings: a summary with the total and the count of each feature, then a sheet for each."""
    shown = findings.withColumn("suggestion", suggestion(F.col("details")))
    counts = {r["feature"]: r["count"] for r in shown.groupBy("feature").count().orderBy("feature").toLocalIterator()}
    sheets = [{"title": "Summary", "header": ["Feature", "Findings"], "rows": [["Total", sum(counts.values())], *([k, n] for k, n in counts.items())]}]
    for feature in counts:
        rows = shown.filter(F.col("feature") == feature).orderBy("doc_id", "part", "ord").select("doc_id", "page", "message", "suggestion", "confidence")
        sheets += _sheets(feature[:31], ["Document", "Page", "Finding", "Suggestion", "Confidence"], (list(r) for r in rows.toLocalIterator()))[0]
    return _write(path, sheets)


def _detail(details: Column, name: str) -> Column:
    return F.get_json_object(details, f"$.{name}")


def suggestion(details: Column) -> Column:
    """What a finding suggests: a correction, else a heading with its page, else a dash."""
    heading, page = _detail(details, "suggested_heading"), _detail(details, "suggested_page")
    heading = F.when(page.isNotNull(), F.concat(heading, F.lit(" (p"), page, F.lit(")"))).otherwise(heading)
    return F.coalesce(_detail(details, "suggested_correction"), _detail(details, "suggestion"), heading, F.lit("—"))


def finding_detail(details: Column, confidence: Column) -> Column:
    """The line under a finding: what is suggested and how sure that is; empty if there is nothing to say."""
    some = lambda name: F.when(_detail(details, name) != "", _detail(details, name))
    made, page = F.coalesce(*map(some, ("suggested_heading", "suggestion", "suggested_correction"))), _detail(details, "suggested_page")
    first = F.when(made.isNotNull(), F.concat(F.lit("suggested: "), made, F.when(page.isNotNull(), F.concat(F.lit(" (p"), page, F.lit(")"))).otherwise("")))
    first = first.when(some("reference_type").isNotNull(), "no confident suggestion")
    sure = F.coalesce(confidence, _detail(details, "suggestion_confidence").cast("double"))
    return F.concat_ws("  |  ", first, F.when(sure.isNotNull(), F.format_string("confidence %.2f", sure)))


def plural(n: Column, word: str) -> Column:
    return F.concat(n, F.lit(f" {word}"), F.when(n == 1, "").otherwise("es"))


def printed_matches(occurrences: DataFrame) -> DataFrame:
    """(document, ord, line): the lines printed for the matches of each document: its name, its pages, their contexts."""
    from pyspark.sql import Window

    order = Window.partitionBy("document").orderBy("occurrence_index")
    rows = occurrences.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("document")))
    rows = rows.withColumns({"nth": F.row_number().over(order), "before": F.lag("page").over(order)})
    new_page = ~F.col("page").eqNullSafe(F.col("before")) | (F.col("nth") == 1)
    head = F.when(F.col("nth") == 1, F.concat("document", F.lit("  ("), plural(F.col("n"), "match"), F.lit(")")))
    lines = F.array(head, F.when(new_page, F.concat(F.lit("  Page "), "page")), F.concat(F.lit("    "), "context"))
    rows = rows.select("document", "occurrence_index", F.posexplode(lines).alias("pos", "line")).filter("line IS NOT NULL")
    return rows.select("document", (F.col("occurrence_index") * 3 + F.col("pos")).alias("ord"), "line")


def report_path(slug: str, documents: int, chosen: str | None = None, suppressed: bool = False) -> str | None:
    """Where a search writes its workbook: nowhere if suppressed, the chosen path, else a default from two documents on."""
    if suppressed:
        return None
    return chosen or (f"keyword_matches_{slug or 'search'}.xlsx" if documents >= 2 else None)


def _write(path: str, sheets: list[dict]) -> str:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(write_xlsx(sheets))
    return path


def payload(findings: DataFrame, columns: list[str], limit: int = LIMIT) -> DataFrame:
    """(doc_id, json): true counts and the first `limit` findings of each document."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    rows = findings.withColumn("n", n).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).filter(F.col("n") <= limit)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", F.struct(*columns).alias("f")))), lambda x: x["f"])
    out = rows.groupBy("doc_id").agg(F.first("all").alias("total"), listed.alias("findings"))
    return out.select("doc_id", F.to_json(F.struct("total", (F.col("total") > limit).alias("truncated"), "findings")).alias("json"))


def append_history(run: DataFrame, path: str, run_id: str) -> None:
    """One more run in the history, as a part of the table."""
    run.withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/run={run_id}")


def read_history(spark, path: str) -> DataFrame:
    """The runs of the history, the latest first."""
    return spark.read.parquet(path).orderBy(F.desc("at"))


def delete_history(spark, path: str, run_id: str | None = None) -> None:
    """Remove one run, or all of them."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path if run_id is None else f"{path}/run={run_id}")
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
