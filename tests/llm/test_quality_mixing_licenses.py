import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.llm import licenses, mixing, oracles, quality
from tests.llm.rows import TEXTS, table, words


def oracle(sql, rows):
    import pandas as pd

    con = duckdb.connect()
    frame = pd.DataFrame([(i, t, lang, s) for i, t, lang, s in rows], columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, lang, source FROM frame")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return sorted((tuple(sorted(zip(names, r, strict=True))) for r in cur.fetchall()), key=str)


def rows_of(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=str)


def test_quality_equals_sql(spark):
    rows = [r for r in TEXTS if "\x00" not in (r[1] or "")]
    assert rows_of(quality.quality_rules(table(spark, rows), cleaned=False)) == oracle(oracles.quality_sql(), rows)


def test_quality_counts_and_cleaning(spark):
    for r, (_, text, *_) in zip(quality.quality_rules(table(spark)).collect(), TEXTS, strict=True):
        text = text or ""
        w = words(text)
        triples = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {i + k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words) == (dup, len(inside))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        if r.kept:
            assert not r.base_failed and all(not words(x) or quality.line_passes(x, True) for x in r.clean_text.split("\n"))
    assert quality.quality_rules(table(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("line", "passes"),
    [("Home | News | Sport | About", False), ("A plain sentence about the weather in the north.", True), ("Please Click Here for more.", False), ("one two three four five six seven eight nine ten eleven twelve", False), ("A heading without an end", True), ("buy!!! now!!! cheap!!! pills!!! here!!! today!!!", False), ("Of, it. No.", True), ("¿Qué pasó? ¡Nada!", True)],
)
def test_line_rules(line, passes):
    assert quality.line_passes(line) is passes


def test_last_line_may_be_cut_off():
    line = "one two three four five six seven eight nine ten eleven twelve"
    assert quality.line_passes(line, last=True) and not quality.line_passes(line)


def test_clean_documents_are_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = quality.quality_rules(docs, keep=("doc_id", "quality"), cleaned=False).where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert len(good) > 10 and sum(good) / len(good) > 0.97


def brute_mix(rows):
    size = [len(words(t)) for _, t, *_ in rows]
    sources = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[3] == s) for s in sources}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    target, open_, budget = {}, set(sources), 1.5 * sum(size)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in over}
        open_ -= over
    return size, total, target


def test_mixing(spark):
    size, total, target = brute_mix(TEXTS)
    got = mixing.mix_sources(table(spark), carry=("source", "text")).collect()
    assert len(got) == len(TEXTS)
    assert Counter((r.doc_id, r["size"], r.source) for r in got) == Counter((i, n, s) for (i, _, _, s), n in zip(TEXTS, size, strict=True))
    taken = defaultdict(int)
    for r in got:
        assert math.isclose(r.target, target[r.source]) and r.source_size == total[r.source] and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in total:
        largest = max((n for n, r in zip(size, TEXTS, strict=True) if r[3] == s), default=0)
        assert abs(taken[s] - target[s]) <= largest / 2 + 1e-6


def test_mixing_equals_sql(spark):
    rows = [r for r in TEXTS if "\x00" not in (r[1] or "")]
    got = mixing.mix_sources(table(spark, rows)).select("doc_id", "size", "source_size", "target", "taken")
    assert rows_of(got) == oracle(oracles.mixing_sql(), rows)
    again = mixing.mix_sources(table(spark, rows).repartition(3)).select("doc_id", "size", "source_size", "target", "taken")
    assert rows_of(again) == rows_of(got)


def test_quality_weight_favours(spark):
    from pyspark.sql import functions as F

    rows = [(i, "plain words of prose here" if i % 2 else "p!l!a!i!n w!o!r!d!s o!f! p!r!o!s!e h!e!r!e", "en", s) for i in range(3000) for s in ("a", "b", "c")]
    got = mixing.mix_sources(table(spark, rows), carry=("source", "text")).where("source = 'c' and not chosen")
    left = {r.plain: r["count"] for r in got.groupBy((~F.contains("text", F.lit("!"))).alias("plain")).count().collect()}
    assert left[False] > 1.3 * left[True]


def test_edge_bins_are_cut_until_small(spark, monkeypatch):
    rows = [(i, f"some words of prose {i} here " * (1 + i % 7), "en", "abc"[i % 3] if i % 5 else None) for i in range(2000)] + [(7, "twice the same", "en", "a")] * 300
    want = rows_of(mixing.mix_sources(table(spark, rows)))
    assert rows_of(mixing.mix_sources(table(spark, rows)).select("doc_id", "size", "source_size", "target", "taken")) == oracle(oracles.mixing_sql(), rows)
    monkeypatch.setattr(mixing, "BINS", 4)
    monkeypatch.setattr(mixing, "EDGE_ROWS", 8)
    assert rows_of(mixing.mix_sources(table(spark, rows))) == want


@pytest.mark.parametrize("same_id", [7, None])
def test_equal_rows_at_the_edge_are_split(spark, monkeypatch, same_id):
    """A source of equal rows comes within a row of its target, and its rows are ordered in parts."""
    ten = "one two three four five six seven eight nine {}"
    rows = [(i, ten.format(i), "en", s) for s in ("a", "b") for i in range(1000)] + [(same_id, ten.format("x"), "en", "c")] * 1000
    monkeypatch.setattr(mixing, "EDGE_ROWS", 64)
    for carry in ((), ("text", "source", "n_chars")):
        mixed = mixing.mix_sources(table(spark, rows), carry=carry)
        got = mixed.groupBy("target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n"), F.sum("size").alias("size")).collect()
        assert sum(r.n for r in got) == 3000 and sum(r["size"] for r in got) == 30_000
        assert all(abs(r.taken - r.target) <= 10 for r in got), got
    assert rows_of(mixed.select("doc_id", "size", "source_size", "target", "taken")) == oracle(oracles.mixing_sql(), rows)


def test_equal_rows_in_a_hot_source_reach_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EDGE_ROWS", 64)
    seen = []
    plain = mixing.saved
    monkeypatch.setattr(mixing, "saved", lambda df, label: seen.append((label, plain(df, label))) or seen[-1][1])
    rows = [(None, "a b c", "en", "hot")] * 900 + [(i, "d e f", "en", s) for i, s in enumerate("xyzx" * 20)]
    mixed = mixing.mix_sources(table(spark, rows))
    assert mixed.count() == len(rows)
    parts = dict(seen)["mix-copies"].groupBy("__part").count().collect()
    assert len(parts) == 15 and max(r["count"] for r in parts) < 120


def test_empty_mix(spark):
    assert mixing.mix_sources(table(spark, [])).count() == 0


def test_licenses_equal_sql(spark):
    rows = [r for r in TEXTS if "\x00" not in (r[1] or "")]
    rows += [(200 + i, "Intro line.\n\n" + t.replace(". ", ".\n") + "\n\nOutro line.", "en", "s") for i, (_, t) in enumerate(licenses.TEMPLATES)]
    rows += [(300, "released under the mit licence", "en", "s"), (301, "Licensed under the Apache License Version 2.0\nReleased under the MIT License", "en", "s")]
    from pyspark.sql import functions as F

    got = licenses.scan_licenses(table(spark, rows)).select("doc_id", "license", F.round("dice", 6).alias("dice"), F.array_join(F.array_distinct(F.transform("matches", lambda m: m["license"])), ",").alias("licenses"))
    assert rows_of(got) == oracle(oracles.licenses_sql(), rows)
    best = {r.doc_id: r.license for r in got.collect()}
    assert all(best[200 + i] == name for i, (name, _) in enumerate(licenses.TEMPLATES)) and best[12] == "MIT" and best[16] is None
    assert licenses.scan_licenses(table(spark, [])).count() == 0


def test_every_template_equals_itself(spark):
    rows = [(i, t, "en", "s") for i, (_, t) in enumerate(licenses.TEMPLATES)]
    got = {r.doc_id: {m.license: m.dice for m in r.matches} for r in licenses.scan_licenses(table(spark, rows)).collect()}
    assert len(licenses.TEMPLATES) > 30
    for i, (name, _) in enumerate(licenses.TEMPLATES):
        assert got[i][name] == 1.0, name


def test_licenses_inside_longer_texts(spark):
    text = dict(licenses.whole_texts())
    prose = "The river runs past the old mill.\nThe miller counts his sacks.\n\n" * 20
    bsd = next(t for n, t in licenses.NOTICES if n == "BSD-3-Clause" and len(t) > 500)
    rows = [
        (1, prose + text["BSD-3-Clause"] + "\n\n" + prose, "en", "s"), (2, prose + text["GPL-2.0"] + "\n\n" + prose, "en", "s"), (3, bsd, "en", "s"),
        (4, "Some words first. Released under the MIT License. Contact the author.", "en", "s"), (5, text["CC0-1.0"], "en", "s"), (6, text["LGPL-3.0"], "en", "s"),
        (7, text["MIT"].replace("\n\n", "\n"), "en", "s"), (8, "Copyright law is a matter of taste. " * 300, "en", "s"), (9, prose + text["MIT"] + "\n\n" + prose + text["Apache-2.0"], "en", "s"),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(table(spark, rows)).collect()}
    assert {i: r.license for i, r in got.items()} == {1: "BSD-3-Clause", 2: "GPL-2.0", 3: "BSD-3-Clause", 4: "MIT", 5: "CC0-1.0", 6: "LGPL-3.0", 7: "MIT", 8: None, 9: "Apache-2.0"}
    assert {m.license for m in got[9].matches} == {"MIT", "Apache-2.0"} and got[2].dice == 1.0


def brute_dice(a, b):
    a, b = Counter(licenses.bigrams(a)), Counter(licenses.bigrams(b))
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))


def test_dice_counts_repeated_bigrams(spark):
    (name, text), repeated = licenses.NOTICES[0], "Licensed under the Apache License Version 2.0 Licensed under the"
    r = licenses.scan_licenses(table(spark, [(1, repeated, "en", "s")]), templates=((name, text),), dice=0.5).first()
    assert math.isclose(r.dice, brute_dice(repeated, text))


def test_no_near_match_is_lost(spark):
    """Templates with any one word replaced score what the definition says."""
    assert licenses.scan_licenses(table(spark, [(1, "Shared under CC BY-NC 4.0.", "en", "s")])).first().dice == pytest.approx(10 / 12)
    rows, want = [], {}
    for name, text in licenses.NOTICES:
        plain = re.sub(r"[\W_]+", " ", text.lower()).split()
        for at in range(0, len(plain), max(1, len(plain) // 12)):
            near = " ".join([*plain[:at], "zebra", *plain[at + 1 :]])
            if brute_dice(near, text) >= licenses.DICE:
                want[len(rows)] = (name, brute_dice(near, text))
            rows.append((len(rows), near, "en", "s"))
    for name, text in licenses.whole_texts():
        plain = re.sub(r"[\W_]+", " ", text.lower()).split()
        near = " ".join("zebra" if i % 11 == 5 else w for i, w in enumerate(plain))
        want[len(rows)] = (name, brute_dice(near, text))
        rows.append((len(rows), near, "en", "s"))
    got = {r.doc_id: {m.license: m.dice for m in r.matches} for r in licenses.scan_licenses(table(spark, rows)).collect()}
    assert len(want) > 100 and all(math.isclose(d, want[i][1]) or d > want[i][1] for i in want for d in [got[i].get(want[i][0], 0.0)])


def test_telling_words_leave_too_little():
    """Without a telling word, no template keeps enough bigrams."""
    words_ = set(licenses.telling_words())
    for _, own in licenses.prepared():
        kept = [g for g in own if not words_ & set(g.split())]
        assert len(kept) < licenses.bounds(len(own), licenses.DICE)[0]


def test_license_scan_is_native(spark):
    plan = licenses.scan_licenses(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
