"""Quality rules: line-first cleaning.

Every line is judged by itself with punctuation, navigation and boilerplate rules; lines that fail
are removed; a document that loses too much of its text is rejected. Before that, two plain
document rules hold: at least ``MIN_WORDS`` words, and at most half of the words in repeated
three-word windows.

A long line ends like a sentence of any script, or is a wrapped line of a paragraph that does.
Boilerplate is learned from the corpus, beside a few fixed phrases: a short line that stands in many
texts between ever different words is no text of theirs: the ``BESIDE`` words before it and after it
tell. Copies of a text repeat them along with the line, so they are no such evidence. Lines travel as hashes, one row for each short
line of a text, and a common line stands in 1 of 100,000 texts at least, so the table of common lines
that all tasks see has at most 100,000 times the mean number of lines in a text, whatever the corpus.

Cases: a null text counts as empty, has no words and is rejected; rows repeat as they are; columns
beyond the id and the text are not looked at, so clashing names do no harm; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator, Set

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import map_texts, slices

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
#: A line with so many of these is a menu or a breadcrumb trail.
SEPARATORS, MAX_SEPARATORS = "|»›•·", 3
#: A line of so many words ends like a sentence, unless it is the last, where the text may be cut off.
SENTENCE_WORDS, ENDINGS = 12, ".!?:;\"')]»”’…"
#: Unicode's sentence ends; they are endings, too.
STOPS = ".!?…։؝؞؟۔؛܀܁܂߹।॥༎།၊။።፧፨᙮។៕᠃᠉᥄᥅᪨᪩᪪᪫᭚᭛᭞᭟᰻᰼᱾᱿‼‽⁇⁈⁉⸮⸼。꓿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉꩝꩞꩟꫰꫱꯫﹒﹖﹗！．？｡"
#: In a line of so many words, ASCII punctuation makes up at most so many hundredths of the characters without spaces.
DENSE_WORDS, MAX_PUNCTUATION = 6, 15
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here",
    "subscribe to our", "sign up for", "enable javascript", "lorem ipsum", "share on facebook", "back to top",
)
#: A line of fewer than ``SENTENCE_WORDS`` words is common if it stands in so many texts, in this share
#: of all rows at least, and between different words (so many of either neighbour) in half of them.
COMMON_TEXTS, COMMON_SHARE, BESIDE = 20, 1e-5, 3
#: Hundredths of the words' characters that cleaning may remove.
MAX_LOST = 40

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PUNCTUATION, _SYMBOLS, _SEPARATORS = (re.compile(f"[{re.escape(x)}]") for x in (PUNCTUATION, SYMBOLS, SEPARATORS))
_STOP = re.compile(f"[{re.escape(STOPS)}](?:[\\x20\\x09-\\x0D]|$)")
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_SPACE = " \t\n\x0b\x0c\r"
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def line_key(body: str) -> int:
    """A line's hash, white space at its ends aside."""
    return xxhash.xxh64_intdigest(body.encode("utf-8", "surrogatepass")) - (1 << 63)


def _line_test(body: str, common: Container[int]) -> tuple[bool, bool]:
    """Does a line pass the rules that look at it alone, and does it have to end like a sentence?"""
    n = len(body.encode("utf-8", "surrogatepass").split())
    if len(_SEPARATORS.findall(body)) >= MAX_SEPARATORS:
        return False, False
    if n >= DENSE_WORDS and 100 * len(_PUNCTUATION.findall(body)) > MAX_PUNCTUATION * _solid(body):
        return False, False
    if n < SENTENCE_WORDS and common and line_key(body) in common:
        return False, False
    return not _BOILERPLATE.search(body.translate(_LOWER)), n >= SENTENCE_WORDS and body[-1] not in ENDINGS


def _solid(text: str) -> int:
    """Code points that are no ASCII white space."""
    return len(text) - sum(text.count(c) for c in _SPACE)


def line_passes(line: str, last: bool = False, common: Container[int] = frozenset()) -> bool:
    """The rules for one line that holds a word; ``last``: no line with a word follows."""
    sound, must_end = _line_test(line.strip(_SPACE), common)
    return sound and (last or not must_end)


def spared_lines(bodies: list[str], sound: list[bool], end: int) -> set[int]:
    """Lines whose end is no ground to remove them: they end like a sentence of any script, or are
    wrapped lines of a paragraph that does. The text's last paragraph may be cut off, if it holds a
    sentence end anywhere. A paragraph ends at a line that is not ``sound``: blank, or failed."""
    out: set[int] = set()
    part: list[int] = []
    for i in range(len(bodies) + 1):
        if i < len(bodies) and sound[i]:
            part.append(i)
            continue
        ends = [bodies[k][-1] in ENDINGS + STOPS for k in part]
        whole = bool(part) and (ends[-1] or (part[-1] == end and any(_STOP.search(bodies[k]) for k in part)))
        out.update(k for k, e in zip(part, ends, strict=True) if e or whole)
        part = []
    return out


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    size = len(seen)
    _, pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
    _, at, counts = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    many = counts[at] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= many
    return int(inside.sum())


def judge(text: str, common: Container[int] = frozenset(), min_words: int = MIN_WORDS) -> tuple[int, int, int, int, int, bool, bool, str, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, the text
    without failed lines, and the number of lines removed."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars, lines = _solid(text), text.split("\n")
    bodies = [line.strip(_SPACE) for line in lines]
    end = max((i for i, body in enumerate(bodies) if body), default=0)
    first: dict[str, int] = {}
    again = [bool(body) and first.setdefault(line, i) != i for i, (line, body) in enumerate(zip(lines, bodies, strict=True))]
    tests = [_line_test(body, common) if body else (False, False) for body in bodies]
    spared: set[int] = set()
    if any(must_end for _, must_end in tests):
        spared = spared_lines(bodies, [sound and not a for (sound, _), a in zip(tests, again, strict=True)], end) | {end}
    left, removed, lost = [], 0, 0
    for i, (line, body) in enumerate(zip(lines, bodies, strict=True)):
        sound, must_end = tests[i]
        if body and (again[i] or not sound or (must_end and i not in spared)):
            removed += 1
            lost += _solid(body)
        else:
            left.append(line)
    repeated = repeated_words(words)
    failed = len(words) < min_words or 100 * repeated > 50 * len(words)
    kept = not failed and 100 * lost <= MAX_LOST * chars
    return len(words), chars, len(_SYMBOLS.findall(text)), sum(again), repeated, failed, kept, "\n".join(left), removed


def short_lines(text: str) -> dict[int, int]:
    """The short lines of a text by hash, each with the hash of the words beside its first place."""
    bodies = [body for line in text.split("\n") if (body := line.strip(_SPACE))]
    split = [body.encode("utf-8", "surrogatepass").split() for body in bodies]
    out: dict[int, int] = {}
    for i, body in enumerate(bodies):
        if len(split[i]) < SENTENCE_WORDS and (key := line_key(body)) not in out:
            before, after = split[i - 1][-BESIDE:] if i else [], split[i + 1][:BESIDE] if i + 1 < len(split) else []
            out[key] = xxhash.xxh64_intdigest(b" ".join(before) + b"\n" + b" ".join(after)) - (1 << 63)
    return out


class Hashes(Set):
    """A sorted array of 64-bit hashes as a set: eight bytes each, in the driver and in every worker."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.sort(values.astype(np.int64))

    def __contains__(self, key: int) -> bool:
        at = int(np.searchsorted(self.values, key))
        return at < len(self.values) and int(self.values[at]) == key

    def __iter__(self) -> Iterator[int]:
        return iter(self.values.tolist())

    def __len__(self) -> int:
        return len(self.values)


def common_lines(docs: DataFrame, text: str = "text") -> Hashes:
    """Hashes of the corpus's common lines; see the module for their bound."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0):
                rows = [(line, beside, line_key(t)) for t in part.column(0).to_pylist() if t for line, beside in short_lines(t).items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["line", "beside", "whole"])

    n = docs.count()
    lines = docs.select(docs[text].cast("string")).mapInArrow(run, "line long, beside long, whole long").distinct()
    # a text has each line once, so its neighbours divide the texts of a line
    found = lines.groupBy("line", "beside").agg(F.count("*").alias("n")).groupBy("line").agg(F.sum("n").alias("texts"), F.count("*").alias("places"))
    found = found.where((F.col("texts") >= COMMON_TEXTS) & (F.col("texts") >= COMMON_SHARE * n) & (2 * F.col("places") >= F.col("texts")))
    return Hashes(found.select("line").toArrow()["line"].to_numpy())


FIELDS = (
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()),
    ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("clean_text", T.StringType()), ("n_removed_lines", T.LongType()),
)


def quality_rules(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", cleaned: bool = True, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each document: the ``keep`` columns, the counts and verdict of :func:`judge`,
    and, with ``cleaned``, the text without failed lines. A narrow map without a shuffle, after one
    pass that counts short lines."""
    fields = [f for f in FIELDS if cleaned or f[0] != "clean_text"]
    at = [i for i, f in enumerate(FIELDS) if f in fields]
    held = docs.sparkSession.sparkContext.broadcast(common_lines(docs, text))

    def make():
        common = held.value

        def work(texts):
            rows = [judge(t or "", common, min_words) for t in texts]
            return [[r[i] for r in rows] for i in at]

        return work

    return map_texts(docs, keep, text, fields, make)
