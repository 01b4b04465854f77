"""The pipeline stage by stage against plain Python over the same rows."""

import hashlib
import math
from collections import Counter

import pytest
import regex
import sentencepiece

import corpus_pipeline
from factloom.llm import mixing, pii, quality, queries
from tests.llm import test_near_dedup, test_pii
from tests.llm.rows import TEXTS, table, words
from tests.llm.test_quality_mixing_licenses import brute_mix
from tests.llm.test_quality_paragraphs import brute_common

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage_rows(df):
    assert df.columns == COLUMNS
    return Counter(tuple(r) for r in df.collect())


def brute_quality(rows):
    out, common = [], frozenset(map(quality.line_key, brute_common([r[1] for r in rows])))
    for i, t, lang, s, _ in rows:
        *_, kept, clean, _ = quality.judge(t or "", common, min_words=1)
        if kept:
            out.append((i, clean, lang, s, len(clean)))
    return out


def brute_dedup(rows):
    kept = {doc for doc, _, _, keep in test_near_dedup.brute([r[:4] for r in rows], 5) if keep}
    return [r for r in rows if r[0] in kept]


def brute_pii(rows):
    risky = test_pii.brute_terms([r[:4] for r in rows])
    out = []
    for i, t, lang, s, _ in rows:
        spans = [(a, b, pii.LABELS[k]) for k, part in zip(pii.KINDS, test_pii.brute(t), strict=True) for a, b in part]
        taken, terms = [(a, b) for a, b, _ in spans], risky.get(t, {})
        for m in regex.finditer(r"[\p{L}\p{N}]+", t):
            if m[0].lower() in terms and not any(a < m.end() and m.start() < b for a, b in taken):
                kind = next((name for shape, name in pii.CLASSES if regex.search(shape, m[0])), "[WORD]")
                spans.append((m.start(), m.end(), "" if terms[m[0].lower()] else kind))
        at, parts = 0, []
        for a, b, label in sorted(spans):
            if a >= at:
                parts += [t[at:a], label]
            at = max(at, b)
        clean = "".join([*parts, t[at:]])
        out.append((i, clean, lang, s, len(clean)))
    return out


def brute_copies(rows):
    size, total, target = brute_mix([r[:4] for r in rows])

    def key(i, text):
        digits = hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13]
        u = (int(digits, 16) + 0.5) / 2**52
        plain, lines, own = sum(c not in quality.PUNCTUATION for c in text), [x for x in text.split("\n") if words(x)], words(text)
        return -math.log(u) / (0.5 + (plain / len(text) * (len(set(lines)) / len(lines)) * min(1.0, len(set(own)) / (3 * math.sqrt(len(own)))) if own else 0))

    out = []
    for s in total:
        own = sorted((key(r[0], r[1]), r[0], n, r) for r, n in zip(rows, size, strict=True) if r[3] == s)
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest, ahead = target[s] - epochs * total[s], 0
        for *_, n, r in own:
            out += [r] * (epochs + (n > 0 and ahead + n / 2 <= rest))
            ahead += n
    return out


def corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS)
    return docs, [tuple(r) for r in docs.collect()]


def test_stages_over_a_table(spark, sf):
    docs, rows = corpus(spark, sf)
    plain = [brute_quality, brute_dedup, brute_pii, brute_copies]
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:4], plain, strict=True):
        rows = brute(rows)
        docs = stage(spark, docs, sf)
        got = stage_rows(docs)
        assert got == Counter(rows), name
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    last = Counter(tuple(r) for r in corpus_pipeline.STAGES[4][1](spark, docs, sf).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for i, t, _, s, _ in rows:
        ids = library.encode(t)
        want[i, s, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert last == want
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_clean_documents_stay(spark, sf):
    """Documents that a labeller called good pass the first stage, apart from near-copies the second."""
    docs, _ = corpus(spark, sf)
    good = docs.join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id").select(*COLUMNS)
    assert corpus_pipeline.quality_rules(spark, good, sf).count() > 0.98 * good.count()


@pytest.mark.parametrize("at", range(5))
def test_awkward_rows_and_empty_tables(spark, sf, at):
    _, stage = corpus_pipeline.STAGES[at]
    docs = table(spark)
    out = stage(spark, docs, sf)
    assert out.count() <= 2 * len(TEXTS)
    if at < 4:
        assert out.columns == COLUMNS
    assert stage(spark, table(spark, []), sf).count() == 0


def test_one_document_of_each_group_stays(spark, sf):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text, "en", "s") for i in range(5)] + [(9, text + " more", "en", "s"), (20, "something else entirely here now", "en", "s")]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), sf).collect()) == [0, 20]


def test_stages_are_as_asked():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert words("a b") == ["a", "b"]
