"""The pipeline, stage by stage, on a small folder of planted cases, and the registered queries."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline

SYLLABLES = {"en": ["the", "and", "ing", "er", "on", "th", "ed"], "fr": ["eau", "que", "tion", "é", "ère", "ou", "ment"]}


def prose(rng, lang, n=120):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    path = tmp_path_factory.mktemp("sf")
    items = [(i, prose(rng, "en", 25)) for i in range(5)]
    rows = [(i, prose(rng, x), x, "s") for i, x in ((i, rng.choice(["en", "fr"])) for i in range(80))]
    near = rows[3][1].split()
    near[60] = "changed"
    rows += [(100, rows[3][1], rows[3][2], "s"), (101, " ".join(near), rows[3][2], "s")]
    rows += [(102, prose(rng, "en", 50) + " " + items[2][1], "en", "s"), (103, "12345 %% 678", "en", "s"), (104, None, None, None)]
    rows += [(105, prose(rng, "fr") + ' token = "0123456789abcdef0123"', "fr", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id: r for r in made.collect()}
        docs = made
    clean = set(range(80))
    assert set(seen["language_id"]) == clean | {100, 101, 102, 105}
    assert set(seen["simhash_dedup"]) == clean | {102, 105}
    assert set(seen["decontamination"]) == clean | {105}
    redacted = seen["secret_scan"][105]
    assert redacted.text.endswith(' [ASSIGN]"') and redacted.n_chars == len(redacted.text)
    assert set(seen["packing"]) == clean | {105}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == clean | {105}


def test_language_stage_drops_junk(spark, folder):
    """Keyboard noise, other scripts, hex and base64 lines go; unseen documents of the learnt languages stay."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = [lambda: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(4, 10))) for _ in range(40))]
    noise.append(lambda: " ".join("".join(chr(rng.randint(0x430, 0x44F)) for _ in range(6)) for _ in range(40)))
    noise.append(lambda: "".join(rng.choice(letters + letters.upper() + "0123456789+/") for _ in range(400)))
    noise.append(lambda: " ".join(f"{rng.getrandbits(64):016x}" for _ in range(20)))
    junk = [(1000 + i, rng.choice(noise)(), None, "s", 0) for i in range(100)]
    good = [(2000 + i, prose(rng, rng.choice(["en", "fr"])), None, "s", 0) for i in range(100)]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.union(spark.createDataFrame(junk + good, docs.schema))
    left = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, folder).collect()}
    assert sum(i in left for i, *_ in junk) <= 10 and sum(i in left for i, *_ in good) >= 99


def test_registration():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
