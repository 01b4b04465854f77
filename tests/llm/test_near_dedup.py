import random

from factloom.llm import near_dedup
from factloom.llm.components import connected_components
from tests.llm.rows import TEXTS, table, words

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    """(id, n_shingles, component_id, kept), over all pairs of rows."""
    sets = [shingles(t, k) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        first = min(ids) if ids else None
        out.append((doc, len(sets[i]), first if sets[i] else doc, doc == first if sets[i] else True))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_awkward_rows(spark):
    for k in (2, 5):
        assert result(near_dedup.near_duplicates(table(spark), words=k)) == brute(TEXTS, k)


def test_texts_fetched_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST_CLASSES", 0)
    assert result(near_dedup.near_duplicates(table(spark), words=2)) == brute(TEXTS, 2)


def test_null_ids_with_and_without_equal_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, "en", "s")] * 4 + [(None, text + " x", "en", "s"), (5, text + " y", "en", "s"), (5, "another text of few words here", "en", "s"), (None, "alone and on its own", "en", "s")]
    assert result(near_dedup.near_duplicates(table(spark, rows), words=2)) == brute(rows, 2)


def test_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(near_dedup.near_duplicates(docs, words=2)) == brute(rows, 2)


def variants(chance, n, length, changes, first=0):
    base = [f"w{chance.randrange(10**6)}" for _ in range(length)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(chance.randint(0, changes)):
            w[chance.randrange(length)] = f"x{chance.randrange(10**6)}"
        out.append((first + i, " ".join(w), "en", "s"))
    return out


def test_near_copies_around_the_threshold(spark):
    chance = random.Random(11)
    rows = [r for g in range(8) for r in variants(chance, 12, 60, 6, 100 * g)]
    assert result(near_dedup.near_duplicates(table(spark, rows), words=2)) == brute(rows, 2)


def test_large_neighbourhoods_lose_no_link(spark):
    """Lists whose head is not alike all members: the crossing pairs must find the rest."""
    chance = random.Random(3)
    rows = variants(chance, 90, 50, 6) + variants(chance, 20, 40, 3, 1000)
    want = brute(rows, 2)
    assert result(near_dedup.near_duplicates(table(spark, rows), words=2)) == want
    assert len({r[2] for r in want}) > 3


def test_empty_table(spark):
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 300), (300, 250), (None, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100, 200: 200, 250: 200, 300: 200}


def test_counts_of_blocks():
    import numpy as np

    rng = np.random.default_rng(5)
    left, right = rng.integers(0, 6, (9, 12)) * 100 + np.arange(12), rng.integers(0, 6, (14, 12)) * 100 + np.arange(12)
    assert (near_dedup.collisions(left, right) == (left[:, None] == right[None]).sum(axis=2)).all()
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(20)] + [np.array([10**12], np.uint64)]
    for columns in (8192, 7):
        got = near_dedup.common_counts(sets[:8], sets[8:], columns)
        assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[8:]] for a in sets[:8]]
    assert near_dedup.common_counts(sets[-1:], sets[:3]).sum() == 0


def test_texts_alike_but_not_alike_enough(spark, monkeypatch):
    """A shared frame of three quarters of the words: nearly every pair collides, none is linked but the copies."""
    chance = random.Random(9)
    frame = [f"f{i}" for i in range(90)]
    rows = [(i, " ".join(frame + [f"o{chance.randrange(10**6)}" for _ in range(30)]), "en", "s") for i in range(250)]
    rows += [(1000 + i, rows[i][1] + " end", "en", "s") for i in range(20)]
    monkeypatch.setattr(near_dedup, "BLOCK", 60)
    assert result(near_dedup.near_duplicates(table(spark, rows), words=2)) == brute(rows, 2)
