"""Ranked search by treaps equals scores of all documents."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import lexical_search, oracles
from factloom.llm.queries import QUERIES
from tests.compare import duck, of_frame, of_sql
from tests.llm import rows

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(TERM, text or "")]


def brute(docs, items, k):
    found = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(1 for _, w in found if w), sum(len(w) for _, w in found)
    df = {}
    for _, words in found:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        ranked = []
        for doc, words in found:
            m, score = 50 + 50 * len(words) * n_docs // max(1, n_terms), 0
            for t in wanted & set(words):
                tf = words.count(t)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 20 * m))
            if score > 0:
                ranked.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(ranked)[:k], 1)]
    return out


def key(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


def items_table(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")


ITEMS = [(0, rows.PROSE), (1, None), (2, "nothing_here §"), (3, "The MIT Licence: word7 word8, é WORD7"), (3, "anna"), (None, "river mill"), (5, "one")]


@pytest.mark.parametrize("settings", [{}, {"broadcast_terms": 0}, {"cell_postings": 20, "item_block": 2}, {"cell_postings": 7, "k": 2}])
def test_equals_brute_force_on_awkward_rows(spark, settings, monkeypatch):
    monkeypatch.setattr(lexical_search, "LEAF", 2)
    k = settings.get("k", 50)
    got = lexical_search.ranked_search(rows.table(spark), items_table(spark, ITEMS), **settings).collect()
    want = brute([(r[0], r[1]) for r in rows.TEXTS], ITEMS, k)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_many_documents_with_ties_and_copies(spark):
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 3, 20, 60])))) for i in range(1500)]
    docs += [(2000 + i, docs[7][1]) for i in range(200)] + [(9999, " ".join(["w1"] * 50_000))]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 30])))) for i in range(12)]
    table = spark.createDataFrame([(i, t, None, None, 0, *["x"] * 10) for i, t in docs], rows.SCHEMA)
    got = lexical_search.ranked_search(table, items_table(spark, items), k=50, cell_postings=2000, item_block=5).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(docs, items, 50))


def test_treaps_keep_both_orders_and_prune():
    rng = np.random.default_rng(3)
    n = 4000
    doc = np.r_[np.arange(n), np.sort(rng.choice(n, 50, replace=False))]
    term = np.r_[np.zeros(n, int), np.ones(50, int)]
    impact = np.r_[rng.integers(1, 50, n), rng.integers(100_000, 900_000, 50)]
    treaps = lexical_search.Treaps(term, doc, impact, n)
    for node in range(n + 50):
        for child, side in ((treaps.left[node], -1), (treaps.right[node], 1)):
            if child >= 0:
                assert (treaps.doc[child] - treaps.doc[node]) * side > 0 and treaps.impact[child] <= treaps.impact[node]
    scored = []
    plain = treaps.scores
    treaps.scores = lambda t, w, a, b: scored.append((b - a).sum()) or plain(t, w, a, b)
    docs, scores = treaps.top(np.array([0, 1, 7]), np.array([1, 3, 5]), 10)
    whole = plain(np.array([0, 1]), np.array([1, 3]), np.array([0]), np.array([n]))
    order = np.lexsort((np.arange(n), -whole))[:10]
    assert docs.tolist() == order.tolist() and scores.tolist() == whole[order].tolist()
    # documents without the heavy term are seldom looked at
    assert sum(scored) < n / 2


def test_empty_tables(spark):
    none = rows.table(spark, []), items_table(spark, [])
    assert lexical_search.ranked_search(none[0], items_table(spark, ITEMS)).isEmpty()
    assert lexical_search.ranked_search(rows.table(spark), none[1]).isEmpty()
    assert lexical_search.ranked_search(*none).columns == ["item_id", "rank", "doc_id", "score"]


def test_query_equals_sql_and_ranks_every_item(spark, sf):
    got = QUERIES["op11_lexical_search"](spark, sf)
    assert of_frame(got) == of_sql(duck(sf), oracles.ORACLES["op11_lexical_search"])
    assert got.select("item_id").distinct().count() == spark.read.parquet(f"{sf}/benchmark.parquet").count()
    assert dict(got.dtypes)["rank"] == "int" and got.agg(F.max("rank")).first()[0] == 50
