"""The document operators: queries against their SQL, and rules on fixtures."""

import json
import re

import pytest

from folio import queries
from folio.functions import text as X
from folio.operators import keyword, links, router, semantic, spell, structure
from folio.plans import engine
from folio.sources import documents, office, reports
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "documents embeddings pages benchmark conversations orders".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(f'\"{c}\"' for c in cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert plain(map(tuple, got.select(*[f"`{c}`" for c in cols]).collect())) == plain(want)


@pytest.mark.parametrize(
    ("text", "word", "n"),
    [
        ("reauthentication differs from authentication.", "authentication", 1), ("Logged ERR#01 twice: ERR#01.", "ERR#01", 2), ("written in c++ here", "c++", 1), ("no dots or stars", ".*", 0),
        ("The configuration\nworkflow.", "configuration workflow", 1), ("em-\nbedded control", "embedded", 1), ("The em­\nbedded board", "embedded", 1), ("develop­\nments", "develop", 0),
    ],
)
def test_keyword_pattern(spark, text, word, n):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.regexp_count("t", F.lit(X.keyword_pattern(word, hyphenated=True)))).first()[0] == n


def test_blank_keyword():
    with pytest.raises(ValueError, match="blank"):
        X.keyword_pattern(" \n")


def test_context_and_tidying(spark):
    t = "Intro here. The system uses em-\nbedded control. Next one."
    unit = spark.createDataFrame([("d", 0, 1, 0, t)], "doc_id string, unit_ord int, page int, paragraph_index int, text string")
    r = keyword.occurrences(unit, "embedded").first()
    assert (r.match_text, r.context) == ("embedded", "The system uses em-bedded control.")


def test_matches_are_those_of_finditer(spark):
    t = "the 😀 The tHe other; the\nthe."
    found = spark.createDataFrame([(t,)], "t string").select(X.matches(F.col("t"), X.keyword_pattern("the")).alias("m")).first().m
    assert [(x.start, x.text) for x in found] == [(m.start(), m[0]) for m in re.finditer(r"(?i)(?<!\w)the(?!\w)", t)]


def test_pieces_are_cut_before_the_limit():
    text = "a" * 300 + " " + "b" * 99 + " " + "c" * 50
    assert [c for _, c in structure.chunk_text(text)] == ["a" * 300, "b" * 99 + " " + "c" * 50]
    assert structure.chunk_text(" " * 900 + "x") == [(800, " " * 100 + "x")] and structure.chunk_text(" " * 900) == []


def test_case_and_corrections(spark):
    rows = spark.createDataFrame([("A", "an"), ("TEH", "the"), ("Teh", "the"), ("teh", "the")], "a string, b string")
    assert [r[0] for r in rows.select(X.match_case(F.col("a"), F.col("b"))).collect()] == ["AN", "THE", "The", "the"]
    texts = ["teh cat and teh dog", "read, form it", "a form; form the base", "Recieve GNODEB٣"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(spell.corrected(F.col("t"))).collect()]
    assert got == ["the cat and the dog", "read, from it", "a from; form the base", "receive GNODEB٣"]


def test_models_that_fail(spark):
    p = spark.createDataFrame([("d", 1, 0, "Taken form there. An apple."), ("d", 1, 1, "Pears")], "doc_id string, page int, index int, text string")
    t = {"paragraphs": p, "pages": spark.createDataFrame([], "doc_id string, number int, text string")}

    def broken():
        raise OSError("no weights")

    def fails():
        def f(texts):
            if len(texts) == 1 and texts[0].startswith("Represent"):
                return [[1.0, 0.0]]
            raise ValueError("a bad passage")

        return f

    found, states = engine.run(t, "keyword_search", {"query": "apple", "encoder": broken})
    assert states == [("keyword_search", "ok", None)] and {r.part for r in found.collect()} == {0, 1}
    assert engine.semantic_note({"encoder": broken}) == "unavailable: semantic search failed (no weights)"
    assert engine.semantic_note({"encoder": fails, "encoder_dim": 768}) == "unavailable: expected 768-dim embeddings, got 2"
    assert engine.semantic_note({"encoder": None}) == "off" and engine.semantic_note({}) is None
    assert {r.part for r in engine.run(t, "keyword_search", {"query": "apple", "encoder": fails})[0].collect()} == {0, 1}
    vocab = spark.createDataFrame([("from", 6.0)], "word string, zipf double")
    rows = engine.run(t, "spell_check", {"corrector": lambda: lambda texts: 1 / 0, "vocabulary": vocab})[0].collect()
    assert {json.loads(r.details)["word"] for r in rows} == {"form"}
    seen = spell.prompted(lambda: lambda prompts, max_length: [f"{max_length}:{x}" for x in prompts])()
    assert seen(["x"]) == [f"128:{spell.INSTRUCTION}x"]
    assert engine.run(t, "multi_doc_keyword_search", {"keyword": " "})[1] == [("multi_doc_keyword_search", "failed", "keyword must not be empty")]


def test_routing_by_meaning(spark):
    rows = spark.createDataFrame([(1, "dead ends"), (2, "odd one"), (3, "dead ends and search the folder for SIM"), (4, None), (5, "run all checks")], "id int, request string")
    axes = {"broken_links": "dead", "spell_check": "letters"}
    encoder = lambda: lambda texts: [[float("dead" in x), float("letters" in x), 1e-3] for x in texts]
    got = {r.id: r for r in router.route(rows, encoder, axes).collect()}
    assert (got[1].features, got[1].method, got[1].confidence, got[1].reason) == (["broken_links"], "semantic", 1.0, "closest match to the broken_links description (1.00)")
    assert (got[2].features, got[2].query, got[2].method) == (["keyword_search"], "odd one", "rules")
    assert (got[3].features, got[3].query, got[3].method) == (["broken_links", "multi_doc_keyword_search"], "SIM", "rules+semantic")
    assert got[4].features == got[5].features == router.STANDARD and got[4].reason.startswith("empty")
    assert [r.method for r in router.route(rows.filter("id = 1"), lambda: 1 / 0).collect()] == ["rules"]


def test_reports(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reports, "SHEET_ROWS", 4)
    rows = [("d", 1 + i // 5, "k", "k", "c" * 40_000 if i == 0 else f"context {i}", i + 1) for i in range(10)]
    found = spark.createDataFrame(rows, "document string, page int, keyword string, match_text string, context string, occurrence_index long")
    reports.write_keyword_report(found, f"{tmp_path}/k.xlsx")
    import zipfile

    names = zipfile.ZipFile(f"{tmp_path}/k.xlsx").namelist()
    assert sum("worksheets" in n and n.endswith(".xml") for n in names) == 3
    first = office.read_xlsx(open(f"{tmp_path}/k.xlsx", "rb").read())[1][4]
    assert len(first) <= 32_767 and first.endswith("more characters]")
    lines = [r.line for r in reports.printed_matches(found.filter("occurrence_index > 1")).orderBy("document", "ord").collect()]
    assert lines[:3] == ["d  (9 matches)", "  Page 1", "    context 1"] and lines.count("  Page 2") == 1
    assert [reports.report_path("x", n, c, s) for n, c, s in ((1, None, False), (2, None, False), (1, "a.xlsx", False), (5, "a.xlsx", True))] == [None, "keyword_matches_x.xlsx", "a.xlsx", None]
    t = {"paragraphs": spark.createDataFrame([("d", 1, 0, "Read form the OSS.")], "doc_id string, page int, index int, text string")}
    made, _ = engine.run(t, "spell_check", {"vocabulary": spark.createDataFrame([("from", 6.0)], "word string, zipf double")})
    assert office.read_xlsx(open(reports.write_overview(made, f"{tmp_path}/o.xlsx"), "rb").read())[1] == ["Total", "1"]
    assert json.loads(reports.payload(made, ["message"]).first().json)["total"] == 1
    for run in "ab":
        reports.append_history(spark.createDataFrame([(run, 1)], "name string, n int"), f"{tmp_path}/h", run)
    reports.delete_history(spark, f"{tmp_path}/h", "a")
    assert [r.name for r in reports.read_history(spark, f"{tmp_path}/h").collect()] == ["b"]
    reports.delete_history(spark, f"{tmp_path}/h")
    assert not (tmp_path / "h").exists()


def test_folders(spark, tmp_path):
    for n in ("a.docx", "sub/b.PDF", "sub/c.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    files = documents.walk(spark, str(tmp_path))
    targets = spark.createDataFrame([(f"{tmp_path}/", "folder"), (f"{tmp_path}/sub/../a.docx", "file"), (f"{tmp_path}/sub/c.txt", "file"), ("", "none")], "target string, kind string")
    assert [r.path for r in documents.documents_of(targets, files).collect()] == [f"{tmp_path}/a.docx", f"{tmp_path}/sub/b.PDF"]
    assert f"{tmp_path}/sub/c.txt" in [r.path for r in documents.collect_files(targets, files).collect()]
    got = documents.uploads(spark.createDataFrame([("/tmp/1", 1)], "doc_id string, n int"), spark.createDataFrame([("/tmp/1", "x.pdf")], "path string, name string")).first()
    assert got.document_name == "x.pdf"
    (tmp_path / "words.tsv").write_text("The\t30\nthe\t60\nof\t10\nx9\t5\n")
    zipf = {r.word: round(r.zipf, 3) for r in spell.read_frequencies(spark, f"{tmp_path}/words.tsv").collect()}
    assert zipf == {"the": 8.954, "of": 8.0}


def test_chunks():
    text = "One sentence here. " * 60 + "x" * 900
    made = structure.chunk_text(text)
    assert all(len(c) <= 400 and text[a : a + len(c)] == c for a, c in made)
    assert structure.chunk_text("") == [] and structure.chunk_text("short.") == [(0, "short.")]


def test_office_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(office.write_docx([("Title", "Heading 1"), ("", None), ("Body & more the end", None)]))
    (tmp_path / "b.docx").write_bytes(b"broken")
    rows = {r.path.rpartition("/")[2]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert [(p["index"], p.text) for p in rows["a.docx"].paragraphs] == [(0, "Title"), (2, "Body & more the end")]
    assert rows["a.docx"].headings[0].level == 1 and rows["b.docx"].parse_error
    sheet = office.read_xlsx(office.write_xlsx([{"title": "T", "header": ["Name", "Acronym"], "rows": [["x", "ABC"], [None, "D & E"]]}]))
    assert office.term_column(sheet) == ["ABC", "D & E"] and office.term_column([]) == []


def test_engine(spark, tmp_path):
    p = spark.createDataFrame([("d", 1, 0, "Retrieved form the OSS. See  for the rest. Table 9 here."), ("d", 1, 1, "Table 1: Sizes")], "doc_id string, page int, index int, text string")
    pages = spark.createDataFrame([("d", 1, "x")], "doc_id string, number int, text string")
    found, states = engine.run({"paragraphs": p, "pages": pages}, "all", {"query": "sizes"})
    assert [s for _, s, _ in states] == ["ok"] * 4
    assert {(r.feature, r.message) for r in found.collect()} >= {("spell_check", "Possible spelling error: 'form' -> 'from'"), ("broken_links", "Reference to Table 9 but the document has no Table 9")}
    assert [s for _, s, _ in engine.run({"paragraphs": p, "pages": pages}, ["keyword_search"], {"query": " "})[1]] == ["skipped"]
    assert [s for _, s, _ in engine.run({"paragraphs": p, "pages": pages}, ["keyword_search"], {"query": 4})[1]] == ["failed"]
    with pytest.raises(ValueError, match="unknown"):
        engine.select(["nope"])
    path = reports.write_report([("keyword_search", "ok", found.filter("feature = 'keyword_search'"), ["details"], None)], f"{tmp_path}/r/out.xlsx")
    # a summary, a unit with the word, and the nearest paragraph without it
    assert office.read_xlsx(open(path, "rb").read())[1][:3] == ["keyword_search", "ok", "3"]


def test_engine_modes(spark):
    p = spark.createDataFrame([("d", 1, 0, "Taken form there. The recieve line."), ("d", 1, 1, "Sizes")], "doc_id string, page int, index int, text string")
    t = {"paragraphs": p, "pages": spark.createDataFrame([], "doc_id string, number int, text string")}
    vocab = spark.createDataFrame([("receive", 5.0), ("form", 5.0), ("from", 6.0)], "word string, zipf double")
    got = {}
    for mode in spell.MODES:
        rows = engine.run(t, "spell_check", {"spell_mode": mode, "vocabulary": vocab})[0].collect()
        got[mode] = sorted((json.loads(r.details)["word"], json.loads(r.details)["method"], json.loads(r.details)["issue_type"]) for r in rows)
    assert got["t5"] == [("form", "t5", "contextual_spelling"), ("recieve", "t5", "contextual_spelling")]
    assert got["dictionary"] == [("recieve", "dictionary", "dictionary_spelling")]
    assert got["both"] == [("form", "t5", "contextual_spelling"), ("recieve", "both", "contextual_spelling")]
    shout = lambda: lambda texts: [x.replace("Sizes", "Sises") for x in texts]
    rows = engine.run(t, "spell_check", {"corrector": shout, "vocabulary": vocab})[0].collect()
    assert [json.loads(r.details)["suggestion"] for r in rows] == ["Sises"]
    assert engine.run(t, "spell_check", {"spell_mode": "loud"})[1][0][1] == "failed"
    found = engine.run(t, "keyword_search", {"query": "sizes"})[0].orderBy("part").collect()
    assert [list(json.loads(r.details)) for r in found] == [engine.SEARCH_COLUMNS] * 3
    assert [json.loads(r.details)["match_type"] for r in found] == ["lexical_summary", "lexical", "semantic"]


def test_results_of_each_document(spark):
    rows = [("a", "docx", None), ("b", "txt", None), ("c", "pdf", "ValueError: bad")]
    text = spark.createDataFrame([(d, 1, 0, "Read form the OSS.") for d in "ab"], "doc_id string, page int, index int, text string")
    t = {"documents": spark.createDataFrame(rows, "doc_id string, format string, parse_error string"), "paragraphs": text, "pages": spark.createDataFrame([], "doc_id string, number int, text string")}
    found, states = engine.run(t, ["spell_check", "multi_doc_keyword_search"], {"keyword": "read"})
    got = {(r.doc_id, r.feature): (r.status, r.error, r.findings) for r in engine.results(t, found, states).collect()}
    other = "multi_doc_keyword_search"
    assert got == {
        ("a", "spell_check"): ("ok", None, 1), ("b", "spell_check"): ("skipped", None, 0), ("c", "spell_check"): ("failed", "ValueError: bad", 0),
        ("a", other): ("ok", None, 1), ("b", other): ("ok", None, 1), ("c", other): ("failed", "ValueError: bad", 0),
    }


def test_changes_are_not_moved_to_be_verified(spark, tmp_path):
    words = [("form", 5.0), ("from", 6.0), ("than", 4.0), ("then", 4.5), ("rare", 3.9)]
    vocab = spark.createDataFrame(words, "word string, zipf double")
    rows = [("Form", "from"), ("than", "then"), ("rare", "then"), ("then", "thex"), (None, "then"), ("thna", "than")]
    changes = spark.createDataFrame(rows, "original string, suggestion string")
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        got = spell.verified(changes, vocab)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert {tuple(r) for r in got.collect()} == set(rows) - {("than", "then")}
    finally:
        spark.conf.set(setting, before)


def test_words_are_told_without_folds(spark):
    from folio import queries_derived as derived

    for rows in (derived.pairs(spark, SF), derived.word_rows(spark, SF)):
        assert "lambda" not in rows._jdf.queryExecution().analyzed().toString()
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    words = [re.findall("[A-Za-z]+", r.text) for r in texts]
    assert {tuple(r) for r in derived.pairs(spark, SF).collect()} == {p for w in words for p in zip(w, w[1:])}


def test_edit_rules_stop_at_two_edits(spark):
    import itertools

    words = ["".join(w) for n in range(5) for w in itertools.product("aBc", repeat=n)]
    rows = [(x, y) for x in words for y in words[::3]] + [(None, "a"), ("a", None)]
    a, b = F.col("a"), F.col("b")
    given = spark.createDataFrame(rows, "a string, b string")
    made = given.select("a", "b", spell.likely(a, b).alias("l"), spell.transposed(a, b).alias("t"), F.levenshtein(F.lower(a), F.lower(b)).alias("d"))
    for r in made.collect():
        if r.d is None:
            assert (r.l, r.t) == (None, None)
            continue
        x, y = r.a.lower(), r.b.lower()
        swap = x != y and any(x[:i] + x[i + 1] + x[i] + x[i + 2 :] == y for i in range(len(x) - 1))
        assert (r.l, r.t) == (r.d <= (1 if len(x) <= 3 else 2), swap)
    # Every distance that is asked for has a limit.
    assert "None" not in given.select(spell.likely(a, b))._jdf.queryExecution().optimizedPlan().toString()


def test_findings_of_a_sentence_move_once(spark):
    kind = "doc_id int, paragraph_index int, sentence string, found array<struct<word:string,suggestion:string,method:string,prio:int>>"
    a, b, c = ("Teh", "the", "t5", 2), ("teh", "tech", "dictionary", 1), ("cat", "cut", "dictionary", 3)
    rows = [(1, 0, "s", [a, c]), (1, 0, "s", [b]), (2, 0, "s", [c]), (3, 0, "s", [c]), (3, 0, "s", [c]), (4, 0, "s", []), (4, 0, "s", None), (5, 0, None, [(None, "x", "t5", 1)]), (6, 0, "t", [("x", "y", "t5", None)])]
    found = spell.merge_findings(spark.createDataFrame(rows, kind))
    want = [(1, 0, "s", "cat", "cut", "dictionary"), (1, 0, "s", "teh", "tech", "both"), (2, 0, "s", "cat", "cut", "dictionary"), (3, 0, "s", "cat", "cut", "both"), (5, 0, None, None, "x", "t5"), (6, 0, "t", "x", None, None)]
    assert plain(map(tuple, found.collect())) == plain(want)
    moved = queries.QUERIES["spell_merge"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert moved.count("Exchange hashpartitioning") == 1 and moved.index("Generate") < moved.index("Exchange hashpartitioning")


def test_deletions_are_dealt_out(spark):
    vocab = spark.createDataFrame([("planners", 6.0), ("garden", 5.0)], "word string, zipf double")
    words = spark.createDataFrame([("gardne",), ("plannrs",)], "word string")
    found = spell.suggest(words, vocab)
    assert {tuple(r) for r in found.collect()} == {("gardne", "garden"), ("plannrs", "planners")}
    # Words, vocabulary and pairs are each dealt to a stated number of tasks before the work on them; the plan has near and far pairs apart.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 6


def test_best_candidate_alone_counts(spark):
    vocab = spark.createDataFrame([("planners", 6.0), ("planneth", 3.2)], "word string, zipf double")
    words = spark.createDataFrame([("plannerx",)], "word string")
    assert spell.suggest(words, vocab).collect() == []  # the best is another form of the word


def test_prose_and_cues(spark):
    rows = [("d", 1, 0, "Table 1: Sizes\nas Table 4 shows"), ("d", 1, 1, "In Table 5 or Table 5, see\nto it"), ("d", 2, 2, "In Table 5 and Table 6")]
    p = spark.createDataFrame(rows, "doc_id string, page int, index int, text string")
    reported = spark.createDataFrame([("d", 1, "Table", "5")], "doc_id string, page int, kind string, number string")
    got = links.prose_references(p, links.captions(p), reported)
    assert sorted((r.page, r.number) for r in got.collect()) == [(1, "4"), (2, "5"), (2, "6")]
    assert [(r.cue, r.start) for r in links.missing_references(p).collect()] == [("see", 23)]


def test_search_in_blocks(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    one, many = semantic.label_search(e), semantic.label_search(e, broadcast_bytes=2000)
    assert one.count() > 0 and one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_search_of_odd_vectors(spark, tmp_path, monkeypatch):
    import duckdb

    nan, inf = float("nan"), float("inf")
    odd = [None, [nan, 1.0], [inf, -1.0], [-inf, 0.0], [0.0, -0.0], [3e38, 3e38], [1e-30, 2e-30]]
    rows = [(i, odd[i % 17] if i % 17 < len(odd) else [(i % 5) / 7, (i % 3) / 11], [0, 1, 2, None][i % 4]) for i in range(400)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    cols = ["query_id", "doc_id", "vec_id", "score", "rank", "relevance"]
    want = plain(con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL['semantic_topk']})").fetchall())
    assert plain(map(tuple, semantic.label_search(e).select(*cols).collect())) == want
    monkeypatch.setattr(semantic, "TILE_BYTES", 4000)
    tiled = semantic.label_search(e, broadcast_bytes=500).select(*cols)
    assert plain(map(tuple, tiled.collect())) == want
    # A row is made for the best of a tile only, not for each pair.
    assert "Join" not in tiled._jdf.queryExecution().executedPlan().toString()


def test_search_of_many_equal_vectors():
    import numpy as np

    q, v = np.array([[1.0, 2.0], [-1.0, 0.5]]), np.repeat([[0.5, 0.25], [0.1, 0.7]], 100_000, axis=0)
    qi, vi, scores = semantic.best_pairs(q, v, 3)
    assert (qi.tolist(), vi.tolist()) == ([0, 0, 0, 1, 1, 1], [100_000, 100_001, 100_002] * 2)
    assert scores.tolist() == [0.1 + 2 * 0.7] * 3 + [-0.1 + 0.5 * 0.7] * 3


def test_word_changes_and_distance(spark):
    r = spark.createDataFrame([("The cat sat", "the dog sat")], "a string, b string").select(spell.word_changes("a", "b").alias("c")).first()
    assert [(x.original, x.suggestion) for x in r.c] == [("cat", "dog")]
    assert [spell._damerau(*p) for p in (("ca", "abc"), ("teh", "the"), ("", "ab"), ("abc", "abc"))] == [2, 1, 2, 0]


def test_first_words_of_long_sentences_match_sql(spark, tmp_path):
    import duckdb

    long = " ".join(["ab cd ef gh"] * 60)
    texts = [long + ".", "x " * 300 + ".", "x y " * 150 + "z.", "he hex hex. he he. He. One two.", f"one two three four {long} one two three four {long}"]
    rows = [(i, 0, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = queries.QUERIES["word_level_changes"](spark, str(tmp_path)).select("doc_id", "pos", "original", "suggestion").collect()
    assert plain(map(tuple, got)) == plain(con.sql(queries.ORACLE_SQL["word_level_changes"]).fetchall())


def test_semantic_search(spark):
    rows = [("d", 1, 0, "apples and pears"), ("d", 1, 1, "query words here"), ("d", 2, 2, "words of a query")]
    chunks = spark.createDataFrame(rows, "doc_id string, page int, chunk_index int, text string")
    got = semantic.search(chunks, "query words", X.keyword_pattern("query words")).orderBy("rank").collect()
    assert [r.chunk_index for r in got] == [2, 0]


def test_stream(spark, tmp_path):
    from folio.streaming.search import stream_hits

    spark.createDataFrame([(1, "a key\nno\nkey key")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    q = stream_hits(stream, "key").writeStream.format("memory").queryName("hits").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("hits").collect()) == [(1, 0, 1), (1, 2, 2)]


class FakePdf(list):
    """Two pages as the PDF library gives them."""

    needs_pass = False

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def resolve_names(self):
        return {"known": {"page": 1}, "lost": {"page": -1}}

    def get_toc(self):
        return [[1, "3.1 Errors", 2]]


class FakePage:
    def __init__(self, lines, links=()):
        self.lines, self.links = lines, links

    def get_text(self, kind):
        if kind == "text":
            return "\n".join(t for t, _ in self.lines)
        rows = [{"spans": [{"text": t[:3]}, {"text": t[3:]}], "bbox": (72.0, top, 400.0, top + 10)} for t, top in self.lines]
        return {"blocks": [{"type": 1}, {"type": 0, "lines": rows}]}

    def get_images(self):
        return ["image"]

    def get_links(self):
        return self.links

    def get_textbox(self, rect):
        if rect is None:
            raise ValueError
        return " See Section 3.1 "


def test_pdf(spark, monkeypatch):
    import sys
    from types import SimpleNamespace

    at = [{"kind": 1, "page": -1, "from": 1}, {"kind": 4, "nameddest": "known", "from": 1}, {"kind": 4, "name": "lost", "from": None}, {"kind": 2, "from": 1}]
    pdf = FakePdf([FakePage([("first line", 100.0), ("second line", 112.0), ("  ", 124.0), ("far below", 160.0)], at), FakePage([("alone", 100.0)])])
    monkeypatch.setitem(sys.modules, "pymupdf", SimpleNamespace(open=lambda **_: pdf, LINK_GOTO=1, LINK_NAMED=4))
    row = documents._parse("x.pdf", b"", False)
    assert row["parse_error"] is None and (row["page_count"], row["scanned_pages"]) == (2, 2)
    assert [(x["ord"], x["target_page"], x["target_name"], x["text"]) for x in row["links"]] == [
        (0, 0, None, "See Section 3.1"), (1, 2, "known", "See Section 3.1"), (2, None, "lost", "")
    ]
    t = documents.tables(spark.createDataFrame([row], documents.SCHEMA).withColumn("doc_id", F.col("path")))
    assert [(p.page, p["index"], p.text) for p in t["paragraphs"].orderBy("index").collect()] == [(1, 0, "first line\nsecond line"), (1, 1, "far below"), (2, 2, "alone")]
    found, states = engine.run(t, "broken_links")
    assert states == [("broken_links", "ok", None)]
    rows = [(r.message, json.loads(r.details)["suggested_heading"], r.confidence) for r in found.orderBy("ord").collect()]
    assert rows == [("Broken Section reference 'See Section 3.1' (target page out of range)", "Errors", 0.95), ("Broken internal reference 'lost' (named destination not found)", None, None)]
    text = documents._parse("x.pdf", b"", True)
    assert not text["lines"] and not text["links"] and text["pages"] == row["pages"]
