import textwrap
from collections import defaultdict

import corpus_pipeline
from factloom.llm import oracles, quality
from tests.llm.rows import OTHER, table, words
from tests.llm.test_quality_mixing_licenses import oracle, rows_of

CLEAN = " ".join(f"word{i}" + "." * (i % 23 == 22) for i in range(161))
HINDI = "\n".join(" ".join(f"शब्द{i}{chr(0x915 + k)}" for k in range(14)) + "।" for i in range(6))
URDU = "\n".join(" ".join(f"لفظ{i}{chr(0x627 + k)}" for k in range(14)) + "۔؟"[i % 2] for i in range(6))
WRAPPED = textwrap.fill(CLEAN, 110) + "\n\n" + OTHER
CUT = textwrap.fill(CLEAN, 110)[:-15]
MENUS = "\n".join(f"Home {i} | News | Sport | About" for i in range(60))
JUNK = "\n".join(" ".join(f"junk{i}x{k}" for k in range(14)) for i in range(6))


def test_pipeline_keeps_clean_documents_of_all_scripts_and_widths(spark):
    rows = [(i, t, "xx", "s") for i, t in enumerate((HINDI, URDU, WRAPPED, CUT, JUNK))]
    got = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, table(spark, rows), "").collect()}
    assert got == {i: t for i, t, *_ in rows[:4]}


def test_failed_lines_end_a_paragraph():
    menu = "Home | News | Sport | About"
    long = "one two three four five six seven eight nine ten eleven twelve"
    *_, text, removed = quality.judge("\n".join([long, menu, WRAPPED]))
    assert text == WRAPPED and removed == 2


def test_the_query_keeps_all_scripts_and_equals_sql(spark):
    rows = [(i, t, "xx", "s") for i, t in enumerate((HINDI, URDU, WRAPPED, CUT, JUNK, "", None, "a\n\nb", MENUS))]
    got = quality.quality_rules(table(spark, rows), cleaned=False)
    assert rows_of(got) == oracle(oracles.quality_sql(), rows)
    assert [r.kept for r in got.orderBy("doc_id").collect()] == [True] * 4 + [False] * 5


def brute_common(texts):
    """Common lines from the definition, over distinct texts; the share of rows is below the least number here."""
    seen = defaultdict(list)
    for t in {t for t in texts if t}:
        bodies = [b for line in t.split("\n") if (b := line.strip(" \t\n\x0b\x0c\r"))]
        for b in dict.fromkeys(bodies):
            i = bodies.index(b)
            if len(words(b)) < 12:
                seen[b].append((tuple(words(bodies[i - 1])[-3:]) if i else (), tuple(words(bodies[i + 1])[:3]) if i + 1 < len(bodies) else ()))
    return {b for b, beside in seen.items() if len(beside) >= 20 and 2 * len(set(beside)) >= len(beside)}


def corpus():
    """Texts with one footer, copies of a text that all hold one heading, and a heading of few texts."""
    rows = [(i, "\n".join([f"Story {i} of the river", CLEAN.replace("word", f"w{i}x"), "Written by the river desk", f"Number {i}"]), "en", "s") for i in range(24)]
    rows += [(100 + i, "\n".join(["The mill by the hill", CLEAN.replace("word7 ", f"other{i} "), "Said the miller"]), "en", "s") for i in range(40)]
    rows += [(200 + i, "\n".join([f"Tale {i}", "A heading of some", CLEAN.replace("word", f"z{i}x")]), "en", "s") for i in range(19)]
    return rows + [(300 + i, rows[0][1], "en", "s") for i in range(30)]


def test_boilerplate_is_learned_from_different_neighbours(spark):
    rows = corpus()
    want = brute_common([r[1] for r in rows])
    assert want == {"Written by the river desk"}
    assert quality.common_lines(table(spark, rows)) == {quality.line_key(b) for b in want}
    got = {r.doc_id: r for r in quality.quality_rules(table(spark, rows)).collect()}
    assert "river desk" not in got[0].clean_text and got[0].kept and got[0].n_removed_lines == 1
    assert got[100].n_removed_lines == got[200].n_removed_lines == 0
    plain = quality.quality_rules(table(spark, rows), cleaned=False)
    assert rows_of(plain) == oracle(oracles.quality_sql(), rows)


def test_a_million_common_lines_are_an_array():
    """Eight bytes a line, in the driver and in each worker, and found as in a set."""
    import pickle

    import numpy as np

    values = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 1_000_000, dtype=np.int64)
    held = quality.Hashes(values)
    assert len(pickle.dumps(held)) < 8_100_000
    assert all(int(v) in held for v in values[:200]) and 12345 not in held and quality.line_key("x") not in held and 0 not in quality.Hashes(values[:0])
