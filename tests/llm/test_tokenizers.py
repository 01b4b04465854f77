import hashlib

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factloom.llm import queries, sentencepiece_codec, token_counts
from tests.llm.rows import TEXTS, table

PIECES, BPE = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
HARD = ["aaaaaaaaaaa aaaaaa", "ΑΣ İstanbul ß ſ Ǆ ﬁ 中文 字 1234 ½ Ⅳ don't I'll 'S 'RE", "é x y \x1c\x85z", "a<|endoftext|>b <|startoftext|> x<|x|>", "K Å ª º ² ¼ ʰ", "  a  b ", "▁x ", "<s> </s> <unk> <0x41>", "﻿ﬃ"]
ALL = [*TEXTS, *((100 + i, t, "en", "s") for i, t in enumerate(HARD))]


def test_pieces_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = sentencepiece_codec.encode_texts(table(spark, ALL), PIECES, keep=("doc_id", "source")).collect()
    assert len(rows) == len(ALL)
    for r, (i, text, _, source) in zip(rows, ALL, strict=True):
        text = text or ""
        ids = library.encode(text)
        assert (r.doc_id, r.source, r.ids, r.decoded) == (i, source, ids, library.decode(ids))
        raw = text.encode()
        assert len(r.begins) == len(r.ends) == len(ids)
        if ids:
            # spans follow each other and cover the text
            assert r.begins[0] == 0 and r.ends[-1] == len(raw) and r.ends[:-1] == r.begins[1:]


def test_spans_hold_the_pieces():
    codec = sentencepiece_codec.Codec(PIECES)
    text = "The café ▁ 中 opened"
    ids, begins, ends = codec.encode(text)
    for i, a, b in zip(ids, begins, ends, strict=True):
        piece = codec.library.id_to_piece(i)
        if not piece.startswith("<0x"):
            assert text.encode()[a:b].decode().strip(" ") == piece.replace("▁", " ").strip(" ") or "▁" in text.encode()[a:b].decode()


@pytest.mark.parametrize("remove", [False, True])
@pytest.mark.parametrize("escape", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_character_map_equals_the_library(remove, escape, prefix):
    import random

    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=prefix, remove_extra_whitespaces=remove, escape_whitespaces=escape)
    spec = next(v for n, v, *_ in sentencepiece_codec._fields(normalizer.serialized_model_proto()) if n == 3)
    codec = sentencepiece_codec.Codec.__new__(sentencepiece_codec.Codec)
    codec.map = sentencepiece_codec.CharacterMap({n: v for n, v, *_ in sentencepiece_codec._fields(spec)}[2])
    codec.dummy_prefix, codec.remove_extra, codec.escape = prefix, remove, escape
    chance = random.Random(7)
    for _ in range(500):
        text = "".join(chance.choices("ab  \tﬁ①ÅéＡ　株㍿​\x01ｶﾞ½", k=chance.randint(0, 9)))
        body, at = codec.normalise(text)
        assert body.decode() == normalizer.normalize(text)
        assert len(at) == len(body) + 1 and all(x <= y for x, y in zip(at, at[1:], strict=False)) and at[-1] <= len(text.encode())


def test_decode_ids(spark):
    coded = sentencepiece_codec.encode_texts(table(spark, ALL), PIECES).cache()
    got = [r.decoded for r in sentencepiece_codec.decode_ids(coded, PIECES).collect()]
    assert got == [r.decoded for r in coded.collect()]


def test_query_hashes(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op3_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_counts_equal_the_library(spark, sf):
    library = Tokenizer.from_file(BPE)
    rows = token_counts.token_counts(table(spark, ALL), BPE).collect()
    for r, (i, text, *_) in zip(rows, ALL, strict=True):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) == (i, len((text or "").encode()), n, n > 2048)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op6_token_counts(spark, sf).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_empty_tables(spark):
    assert sentencepiece_codec.encode_texts(table(spark, []), PIECES).count() == 0
    assert token_counts.token_counts(table(spark, []), BPE).count() == 0


def test_long_pretokens_equal_the_library():
    import random
    import time

    library, count = Tokenizer.from_file(BPE), token_counts.counter(BPE)
    chance = random.Random(5)
    texts = ["a" * 3001, "ab" * 2000 + "a", "".join(chance.choices("abcdefgh", k=5000)), "".join(chance.choices("ACGT", k=20000)), "中文字" * 700, "x" * 513 + " short " + "y" * 512, "".join(chance.choices("etaoin", k=4000)) * 2]
    assert count(texts)[1] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    word = "".join(chance.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    start = time.perf_counter()
    (n,) = count([word])[1]
    took = time.perf_counter() - start
    assert n == len(library.encode(word, add_special_tokens=False).ids) and took < 20, took


def test_special_strings_of_any_form(tmp_path):
    import json

    with open(BPE, encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"].append({"id": 49999, "content": "[MARK]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    texts = ["a[MARK]b [MARK]", "no mark", "[MARK]<|endoftext|>"]
    library = Tokenizer.from_file(path)
    assert token_counts.counter(path)(texts)[1] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
