"""Texts of megabytes, and single words of a megabyte, in all operators and the stages."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import conversation_repair, lexical_search, pii, queries
from tests.llm.rows import PROSE, table, words

CHANCE = random.Random(12)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
LONG = [
    (1, " ".join("".join(CHANCE.choices(LETTERS, k=CHANCE.randint(2, 9))) for _ in range(300_000)), "en", "a"),
    (2, "".join(CHANCE.choices(LETTERS, k=1_000_000)), "en", "a"),
    (3, "7" * 1_000_000, "de", "b"),
    (4, "1." * 20_000 + "@" * 1000 + "a@b.c" * 1000, "de", "b"),
    (5, "\n".join(f"{PROSE} {i}" for i in range(20_000)), None, None),
    (6, "中文" * 300_000, "en", "b"),
    (7, PROSE, "en", "a"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("long")
    table(spark, LONG).write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if int(n[2:].split("_")[0]) <= 10))
def test_queries_take_long_texts_whole(spark, folder, name):
    rows = {r.doc_id: r for r in queries.QUERIES[name](spark, folder).collect()}
    assert sorted(rows) == [i for i, *_ in LONG]
    texts = {i: t for i, t, *_ in LONG}
    for i, r in rows.items():
        if "n_bytes" in r:
            assert r.n_bytes == len(texts[i].encode())
        if "n_words" in r:
            assert r.n_words == len(words(texts[i]))
        if name == "op7_near_dedup":
            w = words(texts[i])
            assert r.n_shingles == (len(set(zip(w, w[1:], strict=False))) if len(w) > 1 else 1)


def test_stages_take_long_texts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() >= len(LONG) - 3


def test_a_text_of_very_many_values(spark):
    """Placing and masking grow with the length of a text, not with the square of its values."""
    n = 40_000
    text = " ".join(f"user{i}@mail{i % 97}.example.com" for i in range(n))
    found = pii.find_pii(table(spark, [(1, text, "en", "a"), (2, "mail x@y.zz now", "en", "a")]))
    got = {r.doc_id: r for r in found.select("doc_id", F.size("email").alias("n"), F.get("email", F.lit(n - 1))["end"].alias("end"), pii.masked(F.col("text")).alias("clean")).collect()}
    assert got[1].n == n and got[1].end == len(text) and got[1].clean == " ".join(["[EMAIL]"] * n) and got[2].clean == "mail [EMAIL] now"


def test_searches_and_repairs_take_long_texts(spark):
    items = spark.createDataFrame([(0, LONG[0][1]), (1, LONG[1][1] + " " + "7" * 1_000_000), (2, PROSE)], "item_id long, text string")
    hits = {}
    for r in lexical_search.ranked_search(table(spark, LONG), items, cell_postings=1000).collect():
        hits.setdefault(r.item_id, []).append(r.doc_id)
    assert hits[0][0] == 1 and sorted(hits[1][:2]) == [2, 3] and set(hits[2]) >= {5, 7}
    turns = [(1, i, ("user", "assistant")[i % 2], t) for i, (_, t, *_) in enumerate(LONG)] + [(2, 0, "user", LONG[2][1] + ".")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in conversation_repair.repair_conversations(rows, rows).collect()}
    assert got[1].truncated == 6 and got[1].audit == "KKKKKKKI" and got[2].audit == "KI"
    lines = [f"{r}:{t}" for _, _, r, t in turns[:-1]] + ["assistant:"]
    assert got[1].repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
