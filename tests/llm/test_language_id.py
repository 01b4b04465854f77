import zlib

import numpy as np
import pytest

from factloom.llm import language_id, queries
from tests.llm.rows import table

ENGLISH = ["the house by the river is old and the garden is full of apple trees", "we walked to the market and bought bread and cheese for the evening"]
GERMAN = ["das haus am fluss ist alt und der garten ist voller apfelbäume", "wir gingen zum markt und kauften brot und käse für den abend"]
RUSSIAN = ["дом у реки старый и сад полон яблонь", "мы пошли на рынок и купили хлеб и сыр на вечер"]


def learned(spark):
    rows = [(i, t, lang, "s") for lang, texts in (("en", ENGLISH), ("de", GERMAN), ("ru", RUSSIAN)) for i, t in enumerate(texts * 5)]
    return language_id.train(table(spark, rows + [(1, None, "en", "s"), (2, "no language", None, "s")]))


def test_mixed_text_has_spans(spark):
    model = learned(spark)
    text = ENGLISH[0] + ". " + GERMAN[1] + ". " + RUSSIAN[0]
    (lang,), (score,), (spans,) = language_id.predict(model, [text])
    assert [s[2] for s in spans] == ["en", "de", "ru"] and 0 < score < 1 and lang in ("en", "de")
    assert text[spans[2][0] : spans[2][1]] == RUSSIAN[0]
    assert abs(spans[1][0] - text.index("wir")) <= 12


def test_no_letters_and_no_training(spark):
    model = learned(spark)
    rows = language_id.language_spans(table(spark), model).collect()
    for r in rows:
        assert (r.lang_pred == "und") == (not r.spans) and 0 <= r.score <= 1
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    nothing = language_id.train(table(spark, []))
    assert language_id.predict(nothing, ["hello"])[0] == ["und"]
    assert language_id.language_spans(table(spark, []), model).count() == 0


def test_viterbi_equals_brute_force():
    import itertools

    chance = np.random.default_rng(2)
    for _ in range(20):
        sizes = chance.integers(1, 6, 4)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        scores = chance.normal(size=(sizes.sum(), 3))
        labels = language_id.viterbi(scores, starts, sizes, 1.5)
        for a, n in zip(starts, sizes, strict=True):
            def value(path):
                return sum(scores[a + i, k] for i, k in enumerate(path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:], strict=False))

            best = max(map(value, itertools.product(range(3), repeat=int(n))))
            assert abs(value(labels[a : a + n]) - best) < 1e-9


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def test_sample_bound(spark):
    rows = [(i, f"text number {i} about nothing", "en", "s") for i in range(400)]
    model = language_id.train(table(spark, rows), max_rows=100)
    assert model.languages == ["en"]


def test_small_languages_and_hot_texts(spark):
    """A language of few texts is learned whole, a text that fills the table counts once, more labels than the bound are refused."""
    rows = [(i, f"english text number {i} about nothing", "en", "s") for i in range(3000)] + [(9000 + i, "one hot text", "de", "s") for i in range(2000)]
    rows += [(5000 + i, t, "ru", "s") for i, t in enumerate(RUSSIAN)]
    got = [(r.lang, r.text) for r in language_id.training_rows(table(spark, rows), max_rows=300).collect()]
    count = {k: sum(lang == k for lang, _ in got) for k in ("en", "de", "ru")}
    assert count["ru"] == 2 and count["de"] == 1 and 50 < count["en"] < 160 and len(set(got)) == len(got)
    with pytest.raises(ValueError, match="max_languages"):
        language_id.training_rows(table(spark, rows), max_languages=2)


def test_no_language_is_lost_by_its_size():
    """Of ten thousand million texts some are learned, in about the share."""
    limits = language_id.hash_limits({"en": 10**10, "de": 10**6, "fr": 3}, 20_000)
    assert limits["fr"] == language_id.HASHES and all(0 < limits[x] < language_id.HASHES for x in ("en", "de"))
    assert limits["en"] / language_id.HASHES * 10**10 == pytest.approx(6666, rel=1e-6)
    bits = language_id.hash_limits({f"l{i}": 2 * 10**8 for i in range(100)}, 20_000)
    assert all(v / language_id.HASHES * 2 * 10**8 == pytest.approx(200, rel=1e-6) for v in bits.values())


def test_word_scores_and_scripts_equal_plain_python(spark):
    """Bucket counts, naive Bayes scores and candidates by script, word by word."""
    rows = [(i, t, lang, "s") for lang, texts in (("en", ENGLISH), ("de", GERMAN), ("ru", RUSSIAN)) for i, t in enumerate(texts)]
    model = language_id.train(table(spark, rows))
    mask = (1 << 64) - 1

    def buckets(word):
        codes, out = [2, *(ord(c) for c in word.lower()), 3], []
        for n in language_id.ORDERS:
            for i in range(len(codes) - n + 1):
                h = 0
                for k, c in enumerate(codes[i : i + n]):
                    h = (h * 0x100000001B3 + c + k + 1) & mask
                out.append((h * 0x9E3779B97F4A7C15 & mask) >> 47)
        return out

    counts = np.zeros((language_id.BUCKETS, 3))
    scripts = {}
    for _, t, lang, _ in rows:
        for word in "".join(c if c.isalpha() else " " for c in t).split():
            k = model.languages.index(lang)
            scripts.setdefault("cyrillic" if ord(word[0]) > 0x400 else "latin", set()).add(k)
            np.add.at(counts[:, k], buckets(word), 1)
    chance = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * language_id.BUCKETS))
    for word in ("house", "Haus", "дом", "zebra"):
        allowed = scripts["cyrillic" if ord(word[0]) > 0x400 else "latin"]
        score = chance[buckets(word)].sum(axis=0) / len(language_id.ORDERS)
        want = max(sorted(allowed), key=lambda k: score[k])
        assert language_id.predict(model, [word])[0] == [model.languages[want]]
        words = language_id.split_words([word])
        bucket, _ = language_id.grams(words)
        assert sorted(bucket.tolist()) == sorted(buckets(word)) and np.abs(model.scores[bucket].sum(axis=0) / len(language_id.ORDERS) - score).max() < 1e-3
