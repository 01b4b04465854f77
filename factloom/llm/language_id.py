"""Language identification by word: script ranges, then Viterbi with a switching penalty.

Words are runs of letters. The script of a word's first letter, found in fixed code-point ranges,
leaves the languages that were seen in that script; each of them scores the word by hashed character
n-grams (naive Bayes); Viterbi over the words of a text, with a penalty for each change of language,
labels spans. A document's language is the one with most letters in its spans.

Training reads labelled rows only, each distinct text of a language once, at most about
``MAX_TRAINING_ROWS`` of them: each language has an equal share of that number, and beyond its share
texts are kept by their hash. So small languages are learned whole, and a text that fills the corpus
counts once. More than ``max_languages`` labels are refused, none is left out. The model is a
table of ``BUCKETS`` rows for each language, so what is broadcast does not grow with the corpus.

Cases: null texts and texts without letters are ``und`` with score 0 and have no spans; rows with a
null language do not train; if no row trains, all texts are ``und``; ties go to the language first
in alphabetical order; repeated rows are labelled alike; an empty table gives an empty table; other
columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import map_texts

#: Documented bounds of the training sample: texts, and languages.
MAX_TRAINING_ROWS, MAX_LANGUAGES = 20_000, 100
#: Values of the hash that chooses texts: far more than any corpus has texts.
HASHES = 1 << 62
BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
SWITCH_PENALTY = 12.0
#: A language is a candidate for a script if it has this share of its training letters' words there.
SCRIPT_SHARE = 0.001

#: First code point of each script range and the script's name.
SCRIPT_RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "other"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB10, "other"), (0xFF21, "latin"), (0xFF5B, "other"), (0x20000, "han"),
)
SCRIPTS = tuple(dict.fromkeys(name for _, name in SCRIPT_RANGES))
_RANGE_STARTS = np.array([start for start, _ in SCRIPT_RANGES])
_RANGE_SCRIPT = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES])
_TOP = 0x32000
_PRIME, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_tables: list[np.ndarray] = []


def _letters() -> list[np.ndarray]:
    """Lower case and letterhood of each code point; made once in a process."""
    if not _tables:
        chars = [chr(c) for c in range(_TOP)]
        _tables.append(np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars], np.uint32))
        _tables.append(np.array([c.isalpha() for c in chars]))
    return _tables


@dataclass
class Words:
    """Words of a slice of texts: document, start, size, script and number among distinct words."""

    doc: np.ndarray
    start: np.ndarray
    size: np.ndarray
    script: np.ndarray
    number: np.ndarray
    first: np.ndarray
    codes: np.ndarray
    doc_start: np.ndarray


def split_words(texts: list[str]) -> Words:
    lower, letter = _letters()
    flat = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    flat = np.minimum(flat, _TOP - 1)
    codes, inside = lower[flat].astype(np.uint64), letter[flat]
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    start, size = edges[::2], edges[1::2] - edges[::2]
    doc_start = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]) if texts else np.zeros(0, np.int64)
    doc = np.searchsorted(doc_start, start, side="right") - 1
    script = _RANGE_SCRIPT[np.searchsorted(_RANGE_STARTS, codes[start].astype(np.int64), side="right") - 1] if len(start) else np.zeros(0, np.int64)
    if not len(start):
        return Words(doc, start, size, script, start, start, codes, doc_start)
    where, owner = _spread(start, size)
    powers = np.cumprod(np.full(int(size.max()) + 1, _PRIME))
    key = np.add.reduceat((codes[where] + np.uint64(7)) * powers[where - start[owner]], np.cumsum(size) - size)
    key = (key ^ size.astype(np.uint64)) * _MIX
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    return Words(doc, start, size, script, number, first, codes, doc_start)


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all rows of a ragged array, and the row of each."""
    owner = np.repeat(np.arange(len(start)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + start[owner], owner


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the distinct words with a mark at both ends: bucket, and number of the word."""
    start, size = words.start[words.first], words.size[words.first]
    wide = size + 2
    where, owner = _spread(start - 1, wide)
    position = where - start[owner] + 1
    codes = np.where(position == 0, np.uint64(2), words.codes[np.clip(where, 0, len(words.codes) - 1)])
    codes[position == wide[owner] - 1] = 3
    buckets, owners, rolling = [], [], np.zeros(len(codes), np.uint64)
    for n in ORDERS:
        rolling = rolling[: len(codes) - n + 1] * _PRIME + codes[n - 1 :] + np.uint64(n)
        fits = (position + n <= wide[owner])[: len(rolling)]
        buckets.append((rolling[fits] * _MIX >> np.uint64(47)).astype(np.int64))
        owners.append(owner[: len(rolling)][fits])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """Learned languages in alphabetical order, log chances by bucket, and candidates by script."""

    languages: list[str]
    scores: np.ndarray
    candidates: np.ndarray


def count_batches(batches):
    """Counts of (language, bucket) in labelled texts; scripts have the buckets below zero."""
    counts: dict[str, np.ndarray] = {}
    for frame in batches:
        for lang, rows in frame.groupby("lang"):
            table = counts.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
            texts = rows["text"].tolist()
            for i in range(0, len(texts), 500):
                words = split_words(texts[i : i + 500])
                if not len(words.start):
                    continue
                often = np.bincount(words.number)
                bucket, owner = grams(words)
                table[:BUCKETS] += np.bincount(bucket, often[owner], BUCKETS).astype(np.int64)
                table[BUCKETS:] += np.bincount(words.script, minlength=len(SCRIPTS))
    for lang, table in counts.items():
        at = np.flatnonzero(table)
        yield pd.DataFrame({"lang": lang, "bucket": np.where(at < BUCKETS, at, BUCKETS - 1 - at), "n": table[at]})


def training_rows(labelled: DataFrame, text: str = "text", lang: str = "lang", max_rows: int = MAX_TRAINING_ROWS, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """(lang, text): distinct texts of each language up to its share of ``max_rows``, chosen by hash."""
    rows = labelled.select(labelled[lang].cast("string").alias("lang"), labelled[text].cast("string").alias("text")).dropna()
    sizes = rows.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n")).limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages: pass max_languages, the model has {BUCKETS} rows for each")
    if not sizes:
        return rows
    limits = hash_limits({r["lang"]: r["n"] for r in sizes}, max_rows)
    known = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return rows.where(F.pmod(F.xxhash64("text"), F.lit(HASHES)) < F.try_element_at(known, "lang")).dropDuplicates(["lang", "text"])


def hash_limits(sizes: dict[str, int], max_rows: int) -> dict[str, int]:
    """Texts of a language whose hash, of ``HASHES`` values, is below this are learned: its share of
    ``max_rows``, or all."""
    share = max(1, max_rows // len(sizes))
    return {lang: HASHES if n <= share else HASHES * share // n for lang, n in sizes.items()}


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", max_rows: int = MAX_TRAINING_ROWS, max_languages: int = MAX_LANGUAGES) -> Model:
    """Learn from rows with a text and a language; see the module for the bound ``max_rows``."""
    rows = training_rows(labelled, text, lang, max_rows, max_languages)
    sums = rows.mapInPandas(count_batches, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique())
    table = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    at = np.where(sums["bucket"] >= 0, sums["bucket"], BUCKETS - 1 - sums["bucket"]).astype(np.int64)
    np.add.at(table, (at, np.searchsorted(languages, sums["lang"].to_numpy(dtype=object)) if languages else at), sums["n"].to_numpy())
    chances = (table[:BUCKETS] + 0.5) / (table[:BUCKETS].sum(axis=0) + 0.5 * BUCKETS)
    scripts = table[BUCKETS:]
    candidates = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(axis=0))
    candidates |= ~candidates.any(axis=1, keepdims=True)
    return Model(languages, np.log(chances).astype(np.float32), candidates)


def viterbi(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best labels of many rows of words at once. scores: (words, languages); rows: ``starts``, ``sizes``."""
    labels = np.zeros(len(scores), np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    alive = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left")  # rows longer than t
    if not len(alive):
        return labels
    best = scores[starts[: alive[0]]].astype(np.float64)
    came = np.zeros(scores.shape, bool)  # changed language into this one
    source = np.zeros(len(scores), np.int32)
    for t in range(1, len(alive)):
        m = alive[t]
        at, old = starts[:m] + t, best[:m]
        top = old.argmax(axis=1)
        other = old[np.arange(m), top][:, None] - penalty
        changed = other > old
        came[at], source[at] = changed, top
        best[:m] = np.maximum(old, other) + scores[at]
        # keeps sums small, changes no comparison
        best[:m] -= best[:m].max(axis=1, keepdims=True)
    label = best.argmax(axis=1)
    for t in range(len(alive) - 1, -1, -1):
        m = alive[t]
        at = starts[:m] + t
        labels[at] = label[:m]
        if t:
            label[:m] = np.where(came[at, label[:m]], source[at], label[:m])
    return labels


def predict(model: Model, texts: list[str | None], penalty: float = SWITCH_PENALTY, spans: bool = True):
    """Language, score (share of letters) and spans (start, end, language; code points) of each text."""
    texts = [t or "" for t in texts]
    words = split_words(texts)
    langs, share, found = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    if not len(words.start) or not model.languages:
        return langs, share, found
    bucket, owner = grams(words)
    n = len(words.first)
    table = np.stack([np.bincount(owner, model.scores[bucket, k], n) for k in range(len(model.languages))], axis=1) / len(ORDERS)
    scores = np.where(model.candidates[words.script], table[words.number], -1e6)
    doc, begin, size = np.unique(words.doc, return_index=True, return_counts=True)
    labels = viterbi(scores, begin, size, penalty)
    letters = np.zeros((len(texts), len(model.languages)))
    np.add.at(letters, (words.doc, labels), words.size)
    winner, total = letters.argmax(axis=1), letters.sum(axis=1)
    for d in doc.tolist():
        langs[d], share[d] = model.languages[winner[d]], float(letters[d, winner[d]] / total[d])
    if spans:
        first = np.flatnonzero(np.r_[True, (np.diff(words.doc) != 0) | (np.diff(labels) != 0)])
        last = np.r_[first[1:], len(labels)] - 1
        shift = words.doc_start[words.doc[first]]
        for d, a, b, k in zip(words.doc[first].tolist(), (words.start[first] - shift).tolist(), (words.start[last] + words.size[last] - shift).tolist(), labels[first].tolist(), strict=True):
            found[d].append((a, b, model.languages[k]))
    return langs, share, found


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))


def language_spans(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """One row for each document: ``keep``, lang_pred, score and spans. A narrow map; the model
    (fixed size) is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(texts):
            langs, share, spans = predict(held.value, texts, penalty)
            return langs, share, [[{"start": a, "end": b, "lang": k} for a, b, k in s] for s in spans]

        return work

    return map_texts(docs, keep, text, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("spans", SPANS)], make, limit=4 << 20)
