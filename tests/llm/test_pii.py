import hashlib
import re

import pytest
import regex

from factloom.llm import pii
from tests.llm.rows import TEXTS, ordered, table

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    return [[(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in PLAIN.items()]


HARD = ["a@b.c_x@y.z", "a@b.c.d@e.f", "1.2.3.4.5", "00000255.1.1.0256", "1-2-3-4 5 6 7 8 9 0 1 2 3 4 5 2", "+1(((((555))) 12 34 56", "++4 11 22 33 44", "é😀a@b.cc 4111111111111111é+49 30 1234567", "1." * 3000, "7" * 5000, "a" * 5000 + "@", "a.b@c-d.e-f..g"]


def test_base_spans_equal_plain_patterns(spark):
    rows = [*TEXTS, *((100 + i, t, "en", "z") for i, t in enumerate(HARD))]
    found = pii.find_pii(table(spark, rows)).collect()
    got = ordered((r.doc_id, r.text, *[[(s.start, s.end) for s in r[k]] for k in pii.KINDS]) for r in found)
    assert got == ordered((i, t or "", *brute(t)) for i, t, *_ in rows)


def test_more_matches_than_a_chunk(spark, monkeypatch):
    rows = [(i, "10.0.0.1 é a@b.cc, " * n, "en", "z") for i, n in enumerate((1, 3, 4, 5, 700))]
    monkeypatch.setattr(pii, "CHUNK", 4)
    for r in pii.find_pii(table(spark, rows)).collect():
        assert [[(s.start, s.end) for s in r[k]] for k in pii.KINDS] == brute(rows[r.doc_id][1])


def test_base_spans_over_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = pii.find_pii(docs).select("doc_id", pii.span_digest(pii.KINDS).alias("d")).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(found) == len(texts)
    for r in found:
        want = ",".join(f"{k}:{a}:{b}" for k, spans in zip(PLAIN, brute(texts[r.doc_id]), strict=True) for a, b in spans)
        assert r.d == want


def test_digest_of_the_query(spark):
    from pyspark.sql import functions as F

    r = pii.find_pii(table(spark)).where("doc_id = 6").select(F.sha2(pii.span_digest(pii.KINDS), 256).alias("h"), pii.span_digest(pii.KINDS).alias("d")).first()
    text = next(t for i, t, *_ in TEXTS if i == 6)
    values = ("email", "anna.b@mail.example.com"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")
    assert r.d == ",".join(f"{k}:{text.index(v)}:{text.index(v) + len(v)}" for k, v in values)
    assert r.h == hashlib.sha256(r.d.encode()).hexdigest()


@pytest.fixture(scope="module")
def corpus():
    rows = [(i, f"Entry {chr(97 + i)}: the quibblesworth account of eve@corp.example.com was opened near town {i}.", "en", "s") for i in range(5)]
    rows += [(50 + i, f"A plain account was opened near town number {i}.", "en", "s") for i in range(40)]
    return rows


TERM = regex.compile(r"[\p{L}\p{N}]{2,}")


def shared(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": value.rpartition("@")[2], "ip": value.rpartition(".")[0], "card": digits[:6], "phone": digits[:5]}[kind]


def bare(text, spans):
    """The text with blanks for the spans."""
    at, parts = 0, []
    for a, b in sorted(spans):
        if a >= at:
            parts.append(text[at:a])
        at = max(at, b)
    return " ".join([*parts, text[at:]])


def brute_terms(rows):
    """The disclosure rule over a small corpus, text by text."""
    import math

    texts = sorted({t or "" for _, t, *_ in rows})
    holders, holds = {}, {}
    for t in texts:
        spans = brute(t)
        for kind, own in zip(PLAIN, spans, strict=True):
            for a, b in own:
                value = t[a:b].lower()
                for e in (f"{kind}:{value}", f"{kind} group:{shared(kind, value)}"):
                    holders.setdefault(e, set()).add(t)
        for w in set(TERM.findall(bare(t, [x for own in spans for x in own]).lower())):
            holds.setdefault(w, set()).add(t)
    out, n = {}, len(texts)
    for own in holders.values():
        if len(own) < pii.SUPPORT or len(own) == n:
            continue
        for w, those in holds.items():
            both = own & those
            if len(both) < pii.SUPPORT:
                continue
            share = math.log(len(both) * n / (len(own) * len(those))) / math.log(n / len(own))
            if share >= pii.GENERALISE:
                for t in both:
                    out.setdefault(t, {})[w] = max(out.get(t, {}).get(w, False), share >= pii.REMOVE)
    return out


def test_terms_that_reveal_are_sanitised(spark, corpus):
    want = brute_terms(corpus)
    assert want and all("quibblesworth" in terms for terms in want.values())
    found = pii.find_pii(table(spark, corpus)).withColumn("clean", pii.masked(pii.F.col("text"))).collect()
    for r in found:
        terms = want.get(r.text, {})
        for kind, removed in (("generalised", False), ("removed", True)):
            assert {s.value.lower() for s in r[kind]} == {w for w, gone in terms.items() if gone is removed}
            assert all(r.text[s.start : s.end] == s.value for s in r[kind])
        if r.doc_id < 50:
            assert "[EMAIL]" in r.clean and "quibblesworth" not in r.clean and "account" in r.clean and "Entry" not in r.clean
        else:
            assert r.clean == r.text


def test_far_short_and_mixed_terms_and_values_that_share_a_domain(spark):
    """A project code stands far from the addresses, each of which is in one text only."""
    filler = "the river runs past the old mill and the miller counts his sacks of grain. " * 20
    rows = [(i, f"{filler} Project X7q is new. {filler} Write to p{i}@corp.example.com soon.", "en", "s") for i in range(4)]
    rows += [(50 + i, f"{filler} number {i} soon new is project write to.", "en", "s") for i in range(60)]
    want = brute_terms(rows)
    assert all(set(terms) == {"x7q"} for terms in want.values()) and len(want) == 4
    found = {r.doc_id: r for r in pii.find_pii(table(spark, rows)).withColumn("clean", pii.masked(pii.F.col("text"))).collect()}
    assert all([s.value for s in found[i].removed] == ["X7q"] and "X7q" not in found[i].clean for i in range(4))
    assert all(found[50 + i].clean == found[50 + i].text for i in range(60))


def test_classes_of_generalised_terms(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("2024",), ("X7q",), ("Ada",), ("mill",)], "v string").select(pii.label("generalised", F.col("v")).alias("x")).collect()
    assert [r.x for r in got] == ["[NUMBER]", "[CODE]", "[NAME]", "[WORD]"]


def test_terms_counted_by_shuffle(spark, corpus, monkeypatch):
    want = sorted(map(str, pii.find_pii(table(spark, corpus)).collect()))
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    assert sorted(map(str, pii.find_pii(table(spark, corpus)).collect())) == want


def test_query_equals_sql(spark, corpus, tmp_path):
    """The query over a table with awkward rows and with terms that reveal."""
    from factloom.llm import oracles, queries
    from tests.llm.test_quality_mixing_licenses import oracle, rows_of

    rows = [*corpus, *(r for r in TEXTS if "\x00" not in (r[1] or "")), *((100 + i, t, "en", "z") for i, t in enumerate(HARD))]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of(queries.op1_pii(spark, str(tmp_path)))
    assert got == oracle(oracles.pii_sql(), rows)
    assert any("removed:" in dict(r)["spans"] for r in got)


def test_no_python_on_the_main_path(spark):
    found = pii.find_pii(table(spark)).withColumn("clean", pii.masked(pii.F.col("text")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    assert pii.find_pii(table(spark, [])).count() == 0


def test_overlapping_kinds_are_masked_once(spark):
    rows = [(1, "write to 10.0.0.1@x.example now", "en", "s")]
    r = pii.find_pii(table(spark, rows)).select(pii.masked(pii.F.col("text")).alias("c"), "email", "ip").first()
    assert len(r.email) == 1 and len(r.ip) == 1
    assert r.c in ("write to [EMAIL] now", "write to [IP] now")
