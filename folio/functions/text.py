"""Column expressions over text: whole-word patterns, match offsets, snippets, context, cleaning.

Patterns name their character classes outright, so that they mean the same in every engine: WORD are letters, digits and
the underscore of any script, SPACE is all white space.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
#: A line-end hyphenation (soft hyphen, hyphen or non-breaking hyphen before a line break), or a soft hyphen alone.
HYPHENATION = r"(?:[­‐‑-][ \t]*\r?\n" + SPACE + r"*|­)?"
SNIPPET_RADIUS, CONTEXT_RADIUS, LONGEST_SENTENCE = 60, 80, 250


def collapse(c: Column) -> Column:
    """White space runs become single spaces, ends are trimmed."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def quoted(token: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}&~#-])", r"\\\1", token)


def keyword_pattern(keyword: str, hyphenated: bool = False) -> str:
    """The keyword as a whole-word literal in either case, its words any white space apart.

    With `hyphenated`, a line-end hyphenation may stand between any two of its letters or digits.
    """
    words = keyword.split()
    if not words:
        raise ValueError("the keyword is blank")
    edge = WORD if not hyphenated else r"[\p{L}\p{N}_­]"

    def one(word: str) -> str:
        out = ""
        for i, c in enumerate(word):
            if hyphenated and i and word[i - 1].isalnum() and c.isalnum():
                out += HYPHENATION
            out += quoted(c)
        return out

    return f"(?iu)(?<!{edge}){f'{SPACE}+'.join(map(one, words))}(?!{edge})"


def matches(text: Column, pattern: str) -> Column:
    """All matches as array<struct<start,text>>, start in code points: one fold over the gaps and matches, each found once."""
    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda v, g: F.struct(v.alias("v"), F.length(g).alias("gap"))
    )
    none = F.array().cast("array<struct<start:int,text:string>>")

    def step(s, x):
        start = s["at"] + x["gap"]
        more = F.array_append(s["out"], F.struct(start.alias("start"), x["v"].alias("text")))
        # The last gap has no match after it.
        return F.when(x["v"].isNull(), s).otherwise(F.struct((start + F.length(x["v"])).alias("at"), more.alias("out")))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] with bounds clipped."""
    low = F.greatest(start, F.lit(0))
    return F.substring(text, low + 1, F.greatest(end - low, F.lit(0)))


def snippet(text: Column, start: Column, length: Column, radius: int = SNIPPET_RADIUS) -> Column:
    """The surroundings of a match, with dots where they are cut."""
    end = start + length
    return F.concat(
        F.when(start > radius, "...").otherwise(""),
        collapse(cut(text, start - radius, end + radius)),
        F.when(end + radius < F.length(text), "...").otherwise(""),
    )


def tidy_match(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"[­‐‑-][ \t]*\r?\n\s*|­", ""))


def tidy_context(c: Column) -> Column:
    joined = F.regexp_replace(c, r"­\s*", "")
    return collapse(F.regexp_replace(joined, r"([‐‑-])[ \t]*\r?\n\s*", "$1"))


def sentence_breaks(text: Column) -> Column:
    """Where sentences end in a text, as array<struct<start,text>>; made once for a text, however many matches it has."""
    return matches(text, r"""[.!?]["')\]”’]*""" + SPACE + r"+|\n[ \t]*\n")


def context(text: Column, start: Column, length: Column, breaks: Column) -> Column:
    """The sentence around a match; where it is longer than LONGEST_SENTENCE or has no near edge, a window of whole words."""
    end = start + length
    before = F.filter(breaks, lambda b: (b["start"] + F.length(b["text"]) <= start) & (b["start"] >= start - LONGEST_SENTENCE))
    after = F.filter(breaks, lambda b: (b["start"] >= end) & (b["start"] <= end + LONGEST_SENTENCE))
    left = F.array_max(F.transform(before, lambda b: b["start"] + F.length(b["text"])))
    right = F.array_min(F.transform(after, lambda b: b["start"] + F.length(F.regexp_replace(b["text"], f"{SPACE}+$", ""))))
    left = F.coalesce(left, F.when(start <= LONGEST_SENTENCE, 0))
    right = F.coalesce(right, F.when(F.length(text) - end <= LONGEST_SENTENCE, F.length(text)))
    sentence = left.isNotNull() & right.isNotNull() & (right - left <= LONGEST_SENTENCE)
    low, high = F.greatest(start - CONTEXT_RADIUS, F.lit(0)), F.least(end + CONTEXT_RADIUS, F.length(text))
    head = F.when(low > 0, F.regexp_replace(cut(text, low, start), rf"^[^\t-\r ]*[\t-\r ]", "")).otherwise(cut(text, low, start))
    tail = F.when(high < F.length(text), F.regexp_replace(cut(text, end, high), r"[\t-\r ][^\t-\r ]*$", "")).otherwise(cut(text, end, high))
    window = F.concat(head, cut(text, start, end), tail)
    window = F.concat(F.when(low > 0, "...").otherwise(""), tidy_context(window), F.when(high < F.length(text), "...").otherwise(""))
    return F.when(sentence, tidy_context(cut(text, left, right))).otherwise(window)


def display(c: Column, most: int = 80) -> Column:
    x = collapse(c)
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…"))).otherwise(x)


def shown(c: Column) -> Column:
    """In quotes, double ones if only single ones are inside."""
    double = c.contains("'") & ~c.contains('"')
    return F.when(double, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.regexp_replace(c, "'", r"\\'"), F.lit("'")))


def match_case(original: Column, suggestion: Column) -> Column:
    """The suggestion in the original's case: all capitals (also of one letter), a capital first, or as it is."""
    upper = (original == F.upper(original)) & (original != F.lower(original))
    capital = F.substring(original, 1, 1) != F.lower(F.substring(original, 1, 1))
    rest = F.concat(F.upper(F.substring(suggestion, 1, 1)), F.substring(suggestion, 2, 1 << 30))
    return F.when(upper, F.upper(suggestion)).when(capital, rest).otherwise(suggestion)


def replace_word(text: Column, word: Column, new: Column) -> Column:
    """The first whole occurrence of word (case matters) replaced."""
    pattern = F.concat(F.lit(f"(?<!{WORD})\\Q"), word, F.lit(f"\\E(?!{WORD})"))
    head = F.element_at(F.split(text, pattern, 2), 1)
    hit = F.length(head) < F.length(text)
    return F.when(hit, F.concat(head, new, F.substring(text, F.length(head) + F.length(word) + 1, F.lit(1 << 30)))).otherwise(text)


def number_parts(number: Column) -> Column:
    """'3.2' as [3, 2]; null if a part is no number."""
    parts = F.transform(F.split(number, r"\."), lambda x: x.try_cast("bigint"))
    return F.when(~F.exists(parts, lambda x: x.isNull()), parts)


def slug(c: Column, most: int = 40) -> Column:
    """A file name part: lower-case letters and digits with underscores, `search` if nothing is left."""
    x = F.substring(F.lower(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")), 1, most)
    return F.when(x == "", "search").otherwise(x)
