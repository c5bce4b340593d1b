"""Document files as tables. Parsing runs in Arrow batches on the executors; a file that fails gives its error as a row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.structure import split_heading, split_paragraphs

from .office import read_docx, read_xlsx, term_column

SCHEMA = (
    "path string, format string, page_count int, scanned_pages int, parse_error string, pages array<struct<number:int,text:string>>, "
    "paragraphs array<struct<page:int,index:int,text:string>>, headings array<struct<ord:int,text:string,level:int,page:int>>, "
    "lines array<struct<page:int,pos:int,text:string,left:double,right:double,top:double>>, "
    "links array<struct<ord:int,page:int,text:string,target_page:int,target_name:string,is_internal:boolean>>"
)


def _lines(number: int, page) -> list[dict]:
    """The full text lines of a PDF page with their places; images and other blocks hold none."""
    found = [line for block in page.get_text("dict")["blocks"] if block.get("type") == 0 for line in block["lines"]]
    texts = [("".join(span["text"] for span in line["spans"]).strip(), line["bbox"]) for line in found]
    keep = [(t, box) for t, box in texts if t]
    return [{"page": number, "pos": i, "text": t, "left": float(b[0]), "right": float(b[2]), "top": float(b[1])} for i, (t, b) in enumerate(keep)]


def _links(number: int, page, names: dict, goto: int, named: int) -> list[dict]:
    """Links within the document: to a page (0 where it has none), or to a name, whose page is null if nothing has it."""
    out = []
    for link in page.get_links():
        if link["kind"] == goto:
            name, target = None, link.get("page", -1) + 1
        elif link["kind"] == named:
            name = link.get("nameddest") or link.get("name")
            at = (names.get(name) or {}).get("page")
            target = at + 1 if isinstance(at, int) and at >= 0 else None
        else:
            continue
        try:
            text = page.get_textbox(link["from"]).strip()
        except Exception:  # the contract: a link whose text cannot be read has none
            text = ""
        out.append({"page": number, "text": text, "target_page": target, "target_name": name, "is_internal": True})
    return out


def _parse(path: str, data: bytes, text_only: bool) -> dict:
    row = {"path": path, "format": path.lower().rpartition(".")[2], "page_count": 0, "scanned_pages": 0, "parse_error": None, "pages": [], "paragraphs": [], "headings": [], "lines": [], "links": []}
    try:
        if row["format"] == "docx":
            made = read_docx(data)
            row["pages"] = [{"number": 1, "text": "\n".join(t for _, t in made["paragraphs"])}]
            row["page_count"] = 1
            row["paragraphs"] = [{"page": 1, "index": i, "text": t} for i, t in made["paragraphs"]]
            if not text_only:
                row["headings"] = [{"ord": o, "text": t, "level": n, "page": 1} for o, t, n in made["headings"]]
        elif row["format"] == "pdf":
            import pymupdf  # optional: without it the row names the missing library

            with pymupdf.open(stream=data, filetype="pdf") as pdf:
                if pdf.needs_pass:
                    raise ValueError("the file needs a password")
                names = {} if text_only else pdf.resolve_names()
                for i, page in enumerate(pdf):
                    text = page.get_text("text")
                    if not text_only:
                        row["lines"] += _lines(i + 1, page)
                        row["links"] += _links(i + 1, page, names, pymupdf.LINK_GOTO, pymupdf.LINK_NAMED)
                    row["pages"].append({"number": i + 1, "text": text})
                    row["scanned_pages"] += len(text.strip()) < 100 and bool(page.get_images())
                row["page_count"] = len(row["pages"])
                row["links"] = [{"ord": o, **x} for o, x in enumerate(row["links"])]
                if not text_only:
                    row["headings"] = [{"ord": o, "text": t, "level": n, "page": p} for o, (n, t, p) in enumerate(pdf.get_toc())]
        else:
            raise ValueError(f"unsupported file type: {row['format']}")
    except Exception as e:  # the contract: one bad file is a row with an error, never a failed job
        row["parse_error"] = f"{type(e).__name__}: {e}"
    return row


def read_documents(spark: SparkSession, path: str, text_only: bool = False) -> DataFrame:
    """All .docx and .pdf files below path, one row each, with doc_id. text_only leaves headings, lines and links unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.filter(F.lower("path").rlike(r"\.(pdf|docx)$")).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_parse(p, bytes(c), text_only) for p, c in zip(b["path"], b["content"])])

    return files.mapInPandas(run, SCHEMA).withColumn("doc_id", F.regexp_replace("path", "^file:/*", "/"))


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """documents, pages, paragraphs, headings (with number and title) and links of parsed files.

    Paragraphs of a PDF are made from the places of its lines; those of other formats come with the file.
    """
    pages = parsed.select("doc_id", F.inline("pages"))
    own = parsed.select("doc_id", F.inline("paragraphs"))
    split = split_paragraphs(parsed.select("doc_id", F.inline("lines")), pages)
    headings = split_heading(parsed.select("doc_id", F.inline("headings")))
    return {
        "documents": parsed.select("doc_id", "path", "format", "page_count", "scanned_pages", "parse_error"),
        "pages": pages,
        "paragraphs": own.unionByName(split),
        "headings": headings.withColumn("text", F.col("title")),
        "links": parsed.select("doc_id", F.inline("links")),
    }


def normal_path(path: Column) -> Column:
    """Without repeated slashes, `.` parts, and parts that a `..` takes back."""
    absolute = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))

    def step(done, x):
        back = (x == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        lost = (x == "..") & (F.size(done) == 0) & absolute
        return F.when(back, F.slice(done, F.lit(1), F.size(done) - 1)).when(lost, done).otherwise(F.concat(done, F.array(x)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    joined = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(kept, "/"))
    return F.when(joined == "", ".").otherwise(joined)


SUPPORTED = r"\.(pdf|docx)$"


def walk(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of every file below a folder; the listing is Spark's, no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"))


def discover(targets: DataFrame) -> DataFrame:
    """Targets (target, kind: file, folder or none) as (target, path, reason): usable ones with a path, others with why not."""
    reason = (
        F.when(F.col("target").isNull() | (F.trim("target") == ""), "not a usable path")
        .when(F.col("kind") == "none", "no such file or folder")
        .when((F.col("kind") == "file") & ~F.lower("target").rlike(SUPPORTED), "unsupported file type (expected .pdf or .docx)")
    )
    return targets.select("target", F.when(reason.isNull(), normal_path(F.col("target"))).alias("path"), reason.alias("reason"))


def documents_of(targets: DataFrame, files: DataFrame) -> DataFrame:
    """The distinct, sorted (path) of documents that targets (target, kind) name or hold. files: (path), as walk gives.

    A folder gives the supported files below it; a file reached twice counts once.
    """
    usable = discover(targets).filter("path IS NOT NULL").join(targets.select("target", "kind").distinct(), "target")
    named = usable.filter("kind = 'file'").select("path")
    own = files.select(normal_path(F.col("path")).alias("path")).filter(F.lower("path").rlike(SUPPORTED))
    # A file lies in each of the folders above it; so the join is on equal folders.
    at = F.filter(F.sequence(F.lit(1), F.length("path")), lambda i: F.substring("path", i, F.lit(1)) == "/")
    above = F.transform(at, lambda i: F.when(i == 1, F.lit("/")).otherwise(F.substring("path", F.lit(1), i - 1)))
    inside = own.withColumn("folder", F.explode(F.concat(above, F.when(~F.col("path").startswith("/"), F.array(F.lit("."))).otherwise(F.array().cast("array<string>")))))
    inside = inside.join(usable.filter("kind = 'folder'").select(F.col("path").alias("folder")).distinct(), "folder", "left_semi").select("path")
    return named.union(inside).distinct().orderBy("path")


def collect_files(targets: DataFrame, files: DataFrame) -> DataFrame:
    """As documents_of, but a file that is named is taken whatever its type."""
    folders = documents_of(targets.filter("kind = 'folder'"), files)
    named = targets.filter("kind = 'file'").select(F.col("target").alias("path"))
    return named.union(folders).distinct().orderBy("path")


def uploads(found: DataFrame, names: DataFrame) -> DataFrame:
    """Findings (doc_id, ...) with the `document_name` under which their file was handed in. names: (path, name)."""
    given = names.select(F.col("path").alias("doc_id"), F.col("name").alias("document_name"))
    return found.join(given, "doc_id", "left").withColumn("document_name", F.coalesce("document_name", "doc_id"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(term) of the first sheet of a workbook; empty where it cannot be read."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in b["content"]:
                try:
                    terms = term_column(read_xlsx(bytes(c)))
                except Exception:  # the contract: an unreadable workbook leaves the defaults
                    terms = []
                yield pd.DataFrame({"term": pd.Series(terms, dtype="str")})

    return files.mapInPandas(run, "term string")


def page_links(pages: DataFrame) -> DataFrame:
    """Links of web pages: page_id, ord, href."""
    hrefs = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(hrefs).alias("ord", "href"))


def page_targets(pages: DataFrame) -> DataFrame:
    """(path): what pages can be reached by, without host, query and fragment."""
    return pages.select(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path")).distinct()


def dangling_links(pages: DataFrame) -> DataFrame:
    """Links of pages to paths that no page has: page_id, ord, href."""
    return page_links(pages).join(page_targets(pages), F.col("href") == F.col("path"), "left_anti")
