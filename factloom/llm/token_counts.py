"""Token counts of a byte-pair tokenizer by rank-synchronous array merging.

Each slice of texts becomes its distinct pre-tokens, held as one ragged numpy array of symbol ids
(flat values and row starts). In every round each pre-token finds its lowest-ranked adjacent pair
and all pre-tokens apply theirs at once; rounds end when no pair has a rank. The symbols that
survive are the tokens of the pre-token, and a text's count is the sum over its pre-tokens.

A pre-token of more than ``LONG`` symbols (base64, unspaced script) is merged by itself, by the same
rule: its pairs are filed by rank, the lowest rank is taken at all its places at once, and only the
pairs beside them are looked up anew. So its time grows with its length, not with the square.

The normaliser and the splitting pattern are read from the tokenizer file. Texts in ASCII and the
Latin blocks are normalised and split here; other texts go through the tokenizer library's
normaliser and splitter, whose Unicode tables are then the authority. Special strings inside a text
are one token each, as the library does by default.

Cases: null and empty texts have no tokens; repeated rows are counted alike; an empty table gives
an empty table; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import Counter

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factloom.llm.common import map_texts

#: Code points below this have settled properties in all Unicode versions in use.
SETTLED = 0x250
#: Distinct pre-tokens a task remembers between slices, up to so many letters; the memory forgets all when full.
REMEMBERED, SHORT = 1 << 18, 64
#: Symbols beyond which a pre-token is merged by itself.
LONG = 512


class RankMerger:
    """Merges of a byte-level BPE model with word-end symbols."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splitter = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(splitter["pattern"]["Regex"])
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.of_char = {c: vocab[c] for c in vocab if len(c) == 1}
        self.of_last = {c[0]: vocab[c] for c in vocab if len(c) == 1 + len(self.suffix) and c.endswith(self.suffix)} if self.suffix else self.of_char
        # byte to printable symbol: printable Latin-1 bytes stand for themselves, the rest follow from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        table = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(own))}
        self.symbol = [table[b] for b in range(256)]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.width = len(vocab)
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        special = [t["content"] for t in spec["added_tokens"]]
        self.specials = sorted(special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if special else None

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings; those of foreign scripts as byte symbols with a NUL before."""
        if text.isascii() or max(text) < chr(SETTLED):
            # lower-casing letter by letter, as the library does; below SETTLED no rule looks at context
            return self.pattern.findall(unicodedata.normalize("NFC", text).lower())
        plain = self.library.normalizer.normalize_str(text)
        return ["\0" + p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def symbols(self, pretoken: str) -> list[int]:
        units = list(pretoken[1:]) if pretoken[0] == "\0" and len(pretoken) > 1 else [self.symbol[b] for b in pretoken.encode()]
        return [*(self.of_char[u] for u in units[:-1]), self.of_last[units[-1]]]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges stands for none."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], len(self.keys))

    def merge_long(self, row: list[int]) -> int:
        """Number of symbols that survive in one long row."""
        n, none = len(row), len(self.keys)
        # the place behind the last has a symbol of no pair
        symbol = np.array([*row, -1], np.int64)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        filed: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(places: np.ndarray, ranks: np.ndarray) -> None:
            places, ranks = places[ranks < none], ranks[ranks < none]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for part, rank in zip(np.split(places, cuts), ranks[np.r_[0, cuts]].tolist() if len(ranks) else [], strict=False):
                if rank not in filed:
                    filed[rank] = []
                    heapq.heappush(heap, rank)
                filed[rank].append(part)

        def rank_at(places: np.ndarray) -> np.ndarray:
            right = symbol[after[places]]
            return np.where(right < 0, none, self.ranks_of(symbol[places], np.maximum(right, 0)))

        left = n
        file(np.arange(n - 1), self.ranks_of(symbol[: n - 1], symbol[1:n]))
        while heap:
            rank = heapq.heappop(heap)
            places = np.unique(np.concatenate(filed.pop(rank)))
            places = places[symbol[places] >= 0]
            places = places[rank_at(places) == rank]
            if not len(places):
                continue
            # of overlapping places in a run (a a a) the first, third, ... apply, from the left
            fresh = np.r_[True, after[places[:-1]] != places[1:]]
            at = np.arange(len(places))
            places = places[(at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0]
            gone = after[places]
            symbol[places] = self.made[rank]
            symbol[gone] = -2
            after[places] = after[gone]
            before[after[places]] = places
            left -= len(places)
            near = before[places]
            near = np.concatenate([places, near[near >= 0]])
            # a place beside two merges may be filed twice; it is taken once
            file(near, rank_at(near))
        return left

    def merge(self, rows: list[list[int]]) -> np.ndarray:
        """Number of symbols that survive in each row."""
        long = [i for i, r in enumerate(rows) if len(r) > LONG]
        if long:
            final = np.zeros(len(rows), np.int64)
            short = [i for i, r in enumerate(rows) if len(r) <= LONG]
            final[short] = self.merge([rows[i] for i in short])
            final[long] = [self.merge_long(rows[i]) for i in long]
            return final
        lengths = np.array([len(r) for r in rows], np.int64)
        flat = np.fromiter((s for r in rows for s in r), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(rows)), lengths)
        none = len(self.keys)
        final = lengths.copy()
        while len(flat) > 1:
            rank = np.where(owner[:-1] == owner[1:], self.ranks_of(flat[:-1], flat[1:]), none)
            best = np.full(len(rows), none, np.int64)
            np.minimum.at(best, owner[:-1], rank)
            hit = (rank < none) & (rank == best[owner[:-1]])
            if not hit.any():
                break
            # of overlapping hits in a run (a a a) the first, third, ... apply, from the left
            where = np.flatnonzero(hit)
            fresh = np.r_[True, np.diff(where) > 1]
            place = np.arange(len(where)) - np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
            where = where[place % 2 == 0]
            flat[where] = self.made[rank[where]]
            alive = np.ones(len(flat), bool)
            alive[where + 1] = False
            final -= np.bincount(owner[where], minlength=len(rows))
            # rows without a hit are settled and leave the arrays
            busy = best < none
            alive &= busy[owner]
            flat, owner = flat[alive], owner[alive]
        return final


def counter(path: str):
    """A function from texts to token counts."""
    merger, known = RankMerger(path), {}

    def work(texts: list[str | None]) -> tuple[list[int], list[int]]:
        sizes, bags, extra = [], [], []
        for text in texts:
            text = text or ""
            sizes.append(len(text.encode("utf-8", "surrogatepass")))
            parts, n = [text], 0
            if any(special in text for special in merger.specials):
                n = len(merger.special.findall(text))
                parts = merger.special.split(text)
            extra.append(n)
            bags.append(Counter(p for part in parts if part for p in merger.pretokens(part)))
        new = list({p for bag in bags for p in bag if p not in known})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list({p for bag in bags for p in bag})
        here = dict(zip(new, merger.merge([merger.symbols(p) for p in new]).tolist(), strict=True)) if new else {}
        counts = [n + sum((here[p] if p in here else known[p]) * k for p, k in bag.items()) for n, bag in zip(extra, bags, strict=True)]
        known.update((p, n) for p, n in here.items() if len(p) <= SHORT)
        return sizes, counts

    return work


def token_counts(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", limit: int = 2048) -> DataFrame:
    """One row for each document: ``keep``, n_bytes, n_tokens and over_limit (n_tokens > limit).
    A narrow map without a shuffle; ``path`` is the tokenizer file on every executor."""

    def make():
        count = counter(path)

        def work(texts):
            sizes, tokens = count(texts)
            return sizes, tokens, [n > limit for n in tokens]

        return work

    return map_texts(docs, keep, text, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())], make)
