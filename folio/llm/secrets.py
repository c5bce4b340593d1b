"""Secret scan with a trigram inverted index.

From each rule's regular expression a Boolean query over byte trigrams is derived: every match must hold them. A block of
texts is indexed by the trigrams that any query names (trigram -> sorted text numbers); the queries' postings are
intersected and united, and only the candidates so found are searched with the rule itself. A rule without any mandatory
trigram (such as a run of hex digits) scans every text.

Spans are in code points, end exclusive. Per rule they are leftmost and do not overlap; a match that the rule's length test
refuses is dropped but has used up its characters.

Defined results: null and empty texts have no spans; repeated rows each get theirs; columns named like the new ones are
replaced.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as parser
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

#: Literal alternatives that a query keeps before it falls back to their trigrams.
EXACT = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and how many characters `group` must have for a match to count."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0
    base: bool = False

    def spans(self, text: str, compiled: re.Pattern) -> list[tuple[int, int]]:
        if not self.least:
            return [m.span() for m in compiled.finditer(text)]
        return [m.span() for m in compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 18, True),
    Rule("hex", r"[0-9a-f]+", 0, 0, 16, True),
)
#: Further formats of published keys.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}=*", re.I | re.A),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{4,128}@"),
)
RULES = BASE_RULES + MORE_RULES


# --- trigram queries: True (no condition), ("and", parts), ("or", parts), or a trigram ------------------------------------


def _and(parts):
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts)))


def _or(parts):
    parts = list(dict.fromkeys(parts))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _literals(strings: set[bytes]):
    """The query that one of the strings occurs."""
    if any(len(s) < 3 for s in strings):
        return True
    return _or([_and([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _parse(items) -> tuple[set[bytes] | None, list]:
    """Of a sequence: all its possible strings, if they are few, and queries that hold anyway."""
    exact: set[bytes] | None = {b""}
    held: list = []

    def close():
        nonlocal exact
        if exact is not None:
            held.append(_literals(exact))

    whole = True
    for op, arg in items:
        own: set[bytes] | None = None
        queries: list = []
        if op is C.LITERAL:
            own = {chr(arg).lower().encode()} if arg < 128 else None
        elif op is C.IN:
            chars: set[bytes] | None = set()
            for kind, x in arg:
                if kind is C.LITERAL and x < 128:
                    chars.add(chr(x).lower().encode())
                elif kind is C.RANGE and x[1] < 128 and x[1] - x[0] < 8:
                    chars |= {chr(y).lower().encode() for y in range(x[0], x[1] + 1)}
                else:
                    chars = None
                    break
            own = chars if chars and len(chars) <= 8 else None
        elif op is C.SUBPATTERN:
            own, queries = _parse(arg[-1])
        elif op is C.BRANCH:
            branches = [_parse(x) for x in arg[1]]
            if all(e is not None for e, _ in branches) and sum(len(e) for e, _ in branches) <= EXACT:
                own = set().union(*(e for e, _ in branches))
            else:
                queries = [_or([_and([*q, _literals(e) if e is not None else True]) for e, q in branches])]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            e, q = _parse(body)
            if low == 0:
                own = e | {b""} if high == 1 and e is not None else None
            elif low == high and e is not None and len(e) == 1:
                own = {next(iter(e)) * low}
            else:
                queries = [*q, _literals(e) if e is not None else True]
        elif op is C.AT:
            own = {b""}
        if own is not None and exact is not None and len(own) * len(exact) <= EXACT:
            exact = {a + b for a in exact for b in own}
            held += queries
            continue
        close()
        held += queries
        exact, whole = (own if own is not None and len(own) <= EXACT else {b""}), False
    if whole:
        return exact, held
    close()
    return None, held


def trigram_query(pattern: str):
    """A Boolean query over the trigrams of the lower-cased text that every text with a match fulfils."""
    exact, held = _parse(parser.parse(pattern))
    return _and([*held, True if exact is None else _literals(exact)])


def trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


class TrigramIndex:
    """Postings of the wanted trigrams over a block of texts."""

    def __init__(self, wanted: list[bytes]):
        self.codes = np.sort(np.array([int.from_bytes(w, "big") for w in wanted], np.int64))
        self.first = np.zeros(256, bool)
        self.first[[w[0] for w in wanted]] = True
        self.pairs = np.zeros(1 << 16, bool)
        self.pairs[[w[0] << 8 | w[1] for w in wanted]] = True
        self.postings: dict[int, np.ndarray] = {}
        self.size = 0

    def build(self, texts: list[bytes]) -> None:
        self.size, self.postings = len(texts), {}
        block = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
        if len(block) < 3 or not len(self.codes):
            return
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        two = block[:-2].astype(np.uint16) << 8 | block[1:-1]
        at = np.flatnonzero(self.pairs[two])
        codes = two[at].astype(np.int64) << 8 | block[at + 2]
        which = np.searchsorted(self.codes, codes)
        ok = self.codes[np.minimum(which, len(self.codes) - 1)] == codes
        rows = np.searchsorted(starts, at[ok], "right") - 1
        both = np.unique(which[ok] * self.size + rows)  # a trigram across a line break between texts names none of them
        which, rows = both // self.size, both % self.size
        for k in np.unique(which).tolist():
            self.postings[int(self.codes[k])] = rows[which == k]

    def candidates(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if isinstance(query, bytes):
            return self.postings.get(int.from_bytes(query, "big"), np.zeros(0, np.int64))
        out = None
        for part in query[1]:
            rows = self.candidates(part)
            if out is None:
                out = rows
            else:
                out = np.intersect1d(out, rows, True) if query[0] == "and" else np.union1d(out, rows)
            if query[0] == "and" and not len(out):
                break
        return out


SPANS = T.StructType(
    [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))]
)


def finder(rules: tuple[Rule, ...]):
    """f(texts) -> for each text its (start, order of the rule, kind, end), sorted."""
    compiled = [re.compile(r.pattern, r.flags) for r in rules]
    queries = [trigram_query(r.pattern) for r in rules]
    index = TrigramIndex(sorted(set().union(*map(trigrams, queries))))

    def f(texts: list[bytes | None]) -> list[list[tuple[int, int, str, int]]]:
        found: list[list] = [[] for _ in texts]
        index.build([t or b"" for t in texts])
        strings: dict[int, str] = {}
        for k, (rule, pattern, query) in enumerate(zip(rules, compiled, queries)):
            for i in index.candidates(query).tolist():
                if texts[i]:
                    if i not in strings:
                        strings[i] = texts[i].decode("utf-8", "replace")
                    found[i] += [(a, k, rule.kind, b) for a, b in rule.spans(strings[i], pattern)]
        for x in found:
            x.sort()
        return found

    return f


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with `spans`: kind, start and end of every secret, by start and then in the order of the rules."""

    def make():
        find = finder(rules)
        return lambda texts, _: [[[{"kind": k, "start": a, "end": b} for a, _, k, b in x] for x in find(texts)]]

    return map_texts(docs, text, SPANS, make, keep=keep)


REPORT = T.StructType(
    [
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the three base kinds, the digest of their spans, and all spans as kind:start:end."""
    found = find_secrets(docs.select("doc_id", "text"), keep=["doc_id"])
    base = [r.kind for r in BASE_RULES]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret in the text replaced by [KIND]; overlapping spans become one, named after the first.

    `length`, where docs have such a column, becomes the new number of characters of a changed text.
    """
    new = [docs.schema[text]] + ([docs.schema[length]] if length in docs.columns else [])

    def make():
        find = finder(rules)

        def f(texts, part):
            out = []
            for raw, spans in zip(texts, find(texts)):
                if not spans:
                    out.append(raw and raw.decode("utf-8", "replace") if raw is not None else None)
                    continue
                t, done, pieces = raw.decode("utf-8", "replace"), 0, []
                for a, _, kind, b in spans:
                    if a >= done:
                        pieces += [t[done:a], f"[{kind.upper()}]"]
                    done = max(done, b)
                out.append("".join([*pieces, t[done:]]))
            out = ["" if t == b"" else t for t in out]
            columns = [out]
            if len(new) > 1:
                had = part.column(part.schema.get_field_index(length)).to_pylist()
                columns.append([n if not s else len(o) for n, o, s in zip(had, out, map(_changed, texts, out))])
            return columns

        return f

    made = map_texts(docs, text, T.StructType(new), make, also=[length] if len(new) > 1 else [])
    return made.select(*[F.col(f"`{c}`") for c in docs.columns])


def _changed(raw: bytes | None, out: str | None) -> bool:
    return raw is not None and out is not None and raw != out.encode("utf-8", "replace")


def digest(spans: str) -> str:
    return sha256(spans.encode()).hexdigest()
