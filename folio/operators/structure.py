"""Text structure: paragraphs from line geometry, heading numbers, sentences and chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import strip

# Fixed values.
GAP, RAGGED = 1.35, 0.10
HEADING = r"(?d)^\s*((?:\p{Nd}+\.)*\p{Nd}+)\.?\s+(.*)$"
LINE_END = r"""[.!?:;]["'’”)\]]?$"""
LIST_ITEM = r"^(?:[-–—*•●·]|\(?[0-9]{1,3}[.)]|\(?[a-zA-Z][.)])\s"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
CHUNK = 400


def split_heading(headings: DataFrame, text: str = "text") -> DataFrame:
    """number (null if there is none) and title of each heading."""
    number = F.regexp_extract(text, HEADING, 1)
    return headings.withColumns(
        {
            "number": F.when(number != "", number),
            "title": strip(F.when(number != "", F.regexp_extract(text, HEADING, 2)).otherwise(F.col(text))),
        }
    )


def line_pitch(lines: DataFrame) -> DataFrame:
    """(doc_id, page, pitch): the median of the positive steps between lines of a page, 0 if there is none."""
    step = F.col("top") - F.lag("top").over(Window.partitionBy("doc_id", "page").orderBy("pos"))
    steps = lines.withColumn("step", step)
    return steps.groupBy("doc_id", "page").agg(F.coalesce(F.median(F.when(F.col("step") > 0, F.col("step"))), F.lit(0.0)).alias("pitch"))


def blank_breaks(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, page, pos) of lines that a blank line follows; none for pages whose full lines are not as many as `lines`."""
    raw = pages.select("doc_id", F.col("number").alias("page"), F.posexplode(F.split("text", LINE_BREAK, -1)).alias("i", "line"))
    full = F.length(strip(F.col("line"))) > 0
    order = Window.partitionBy("doc_id", "page").orderBy("i")
    raw = raw.withColumn("n", F.sum(full.cast("int")).over(order)).withColumn("full", full)
    raw = raw.withColumn("all", F.sum(F.col("full").cast("int")).over(Window.partitionBy("doc_id", "page")))
    own = lines.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("have"))
    blank = raw.filter((~F.col("full")) & (F.col("n") > 0)).join(own, ["doc_id", "page"]).filter("have = all")
    return blank.select("doc_id", "page", (F.col("n") - 1).cast("int").alias("pos")).distinct()


def split_paragraphs(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Paragraphs of pages from their lines (doc_id, page, pos from 0, text, left, right, top): doc_id, page, index, text.

    One ends where a blank line follows, the step to the next line is over GAP pitches or not downward, a short line ends a
    sentence, the next line opens a list item or numbered heading, or a short line is itself a numbered heading.
    """
    page, order = Window.partitionBy("doc_id", "page"), Window.partitionBy("doc_id", "page").orderBy("pos")
    rows = lines.join(line_pitch(lines), ["doc_id", "page"])
    if pages is not None:
        rows = rows.join(blank_breaks(pages, lines).withColumn("blank", F.lit(True)), ["doc_id", "page", "pos"], "left")
    else:
        rows = rows.withColumn("blank", F.lit(False))
    width = F.max("right").over(page) - F.min("left").over(page)
    width = F.when(width == 0, 1.0).otherwise(width)
    rows = rows.withColumns(
        {"next": F.lead("text").over(order), "step": F.lead("top").over(order) - F.col("top"), "short": F.col("right") < F.max("right").over(page) - RAGGED * width}
    )
    ends = F.col("text").rlike(LINE_END)
    heading = lambda c: c.rlike(HEADING) & ~c.rlike(LINE_END)
    opens = F.col("next").rlike(LIST_ITEM) | heading(F.col("next"))
    broken = (
        F.coalesce("blank", F.lit(False))
        | ((F.col("pitch") > 0) & ((F.col("step") > GAP * F.col("pitch")) | (F.col("step") <= 0)))
        | (F.col("short") & ends)
        | opens
        | (F.col("short") & heading(F.col("text")))
    )
    rows = rows.withColumn("broken", F.coalesce(broken, F.lit(False)).cast("int"))
    group = F.coalesce(F.sum("broken").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("group", group)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    out = rows.groupBy("doc_id", "page", "group").agg(text.alias("text"))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "group")) - 1
    return out.select("doc_id", "page", index.cast("int").alias("index"), "text")


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, sentence): pieces up to . ! or ?, trimmed, blank ones left out."""
    found = F.regexp_extract_all(F.col(text), F.lit("[^.!?]+[.!?]?"), F.lit(0))
    found = F.filter(F.transform(found, strip), lambda x: x != "")
    return documents.select(F.col(key).alias("doc_id"), F.posexplode(found).alias("pos", "sentence"))


def _pieces(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """A span in pieces of up to CHUNK characters, cut at the last space before the limit where there is one; no blank ones."""
    out = []
    while start < end:
        at = min(start + CHUNK, end)
        if at < end:
            space = text.rfind(" ", start + 1, at)
            at = space if space > 0 else at
        out.append((start, at))
        start = at + (at < end and text[at] == " ")
    return [(a, b) for a, b in out if text[a:b].strip()]


def chunk_text(text: str) -> list[tuple[int, str]]:
    """(char_start, text) of chunks of up to CHUNK characters: whole sentences, the last one carried over if it still fits."""
    spans, start = [], 0
    for m in re.finditer(r"(?<=[.!?])\s+", text):
        spans.append((start, m.start()))
        start = m.end()
    spans.append((start, len(text)))
    pieces = [p for a, b in spans if text[a:b].strip() for p in _pieces(text, a, b)]
    chunks: list[list[tuple[int, int]]] = []
    for p in pieces:
        if chunks and p[1] - chunks[-1][0][0] <= CHUNK:
            chunks[-1].append(p)
            continue
        last = chunks[-1][-1] if chunks else None
        carry = last is not None and len(chunks[-1]) > 1 and p[1] - last[0] <= CHUNK
        chunks.append([last, p] if carry else [p])
    return [(c[0][0], text[c[0][0] : c[-1][1]]) for c in chunks]


def chunks(unit: DataFrame) -> DataFrame:
    """Chunks of units in reading order: doc_id, chunk_index (from 0 in the document), page, paragraph_index, char_start, text."""

    @F.pandas_udf("array<struct<char_start:int,text:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"char_start": a, "text": x} for a, x in chunk_text(t or "")])

    rows = unit.select("*", F.posexplode(cut("text")).alias("pos", "c"))
    order = Window.partitionBy("doc_id").orderBy("unit_ord", "pos")
    index = (F.row_number().over(order) - 1).cast("int")
    return rows.select("doc_id", index.alias("chunk_index"), "page", "paragraph_index", F.col("c.char_start").alias("char_start"), F.col("c.text").alias("text"))
