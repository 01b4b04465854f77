"""Extension points: embedder, fact extractor, reranker, judge, and deterministic offline defaults.

A hook is a column function, so a model client plugs in as a Pandas UDF of the same shape. The
defaults need no network: hashed bags of words, sentences as facts, word overlap as scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.config import next_backoff
from factloom.functions import metrics
from factloom.functions.text import entity_candidates, once, overlap, strip_fence, tokens
from factloom.functions.vectors import unit
from factloom.schemas import JUDGE_JSON

DIM = 64


class GraphSearchClient(Protocol):
    """Anything that answers queries (qid, ...) with hits (qid, fact_text, score, ...)."""

    def search(self, queries: DataFrame, limit: int) -> DataFrame: ...


def hashing_embedder(dim: int = DIM) -> Callable[[Column], Column]:
    """Unit vectors of signed word counts by hash, made of built-in functions."""

    def embed(text: Column) -> Column:
        words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")
        slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(2 * dim)))
        counts = F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: (F.size(F.filter(slots, lambda s: s == i)) - F.size(F.filter(slots, lambda s: s == i + dim))).cast("double"),
        )
        return F.aggregate(
            F.array(counts),
            F.array().cast("array<float>"),
            lambda _, v: F.transform(v, lambda x: F.coalesce(F.try_divide(x, F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y))), F.lit(0.0)).cast("float")),
        )

    return embed


def pandas_embedder(dim: int = DIM) -> Callable[[Column], Column]:
    """The shape of a model-backed embedder: Arrow batches, the model loaded once for each task."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zlib

        import numpy as np

        # a model would be loaded here
        for texts in batches:
            out = []
            for text in texts:
                v = np.zeros(dim, np.float32)
                for w in (text or "").lower().split():
                    h = zlib.crc32(w.encode()) % (2 * dim)
                    v[h % dim] += 1 if h < dim else -1
                n = float(np.sqrt((v * v).sum()))
                out.append((v / n if n else v).tolist())
            yield pd.Series(out)

    return embed


def sentence_extractor(body: Column) -> Column:
    """Sentences as facts, with their capitalised words as entities."""
    parts = F.filter(F.transform(F.split(body, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")
    return F.transform(parts, lambda s: F.struct(s.alias("fact"), F.array_distinct(F.transform(entity_candidates(s), lambda w: F.regexp_replace(w, r"[\p{P}\p{S}]+$", ""))).alias("entities")))


@F.udtf(returnType="fact string, entities array<string>")
class FactTable:
    """:func:`sentence_extractor` as a table function, to be joined laterally: facts come one by one, so a long
    body never makes one large array. A model that reads a body in parts has this shape."""

    def __init__(self) -> None:
        import re
        import unicodedata

        self.parts, self.words = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n+"), re.compile(r"\s+")
        self.kind = unicodedata.category

    def eval(self, body: str):
        start = 0
        for cut in [*self.parts.finditer(body or ""), None]:
            fact = (body or "")[start : cut.start() if cut else None].strip(" ")
            start = cut.end() if cut else start
            if fact:
                names = [w for w in self.words.split(fact) if len(w) > 2 and self.kind(w[0]) == "Lu"]
                yield fact, list(dict.fromkeys(self._plain(w) for w in names))

    def _plain(self, word: str) -> str:
        while word and self.kind(word[-1])[0] in "PS":
            word = word[:-1]
        return word


def facts_laterally(rows: DataFrame, body: str, table=FactTable) -> DataFrame:
    """Rows with a fact of their body each, by a table function: the columns of ``rows``, fact and entities."""
    return rows.lateralJoin(table(F.col(body).outer()))


def overlap_model() -> Callable[[list[str]], list[str]]:
    """A model for :func:`factloom.operators.reranking.rerank` that needs no network: the share of the query's
    words in each numbered passage of a prompt, as JSON."""
    import json
    import re

    words = lambda text: set(text.lower().split())

    def reply(prompt: str) -> str:
        query, *passages = re.split(r"\n\[\d+\] ", prompt.removeprefix("Query: "))
        wanted = words(query)
        return json.dumps([{"passage_id": i, "score": len(wanted & words(p)) / len(wanted) if wanted else 0.0} for i, p in enumerate(passages)])

    return lambda prompts: [reply(p) for p in prompts]


def overlap_reranker(query: Column, passage: Column) -> Column:
    """Share of the query's words in the passage."""
    return F.coalesce(overlap(tokens(passage), tokens(query)), F.lit(0.0))


def overlap_judge(query: Column, context: Column, expected: Column) -> Column:
    """Sufficiency of a context: no context 0, no expected answer 0.5, else the share of the answer's words."""
    score = F.when(F.coalesce(context, F.lit("")) == "", 0.0).when(F.coalesce(expected, F.lit("")) == "", 0.5).otherwise(metrics.sufficiency(context, expected))
    return F.struct(score.alias("score"), F.coalesce(overlap(tokens(context), tokens(query)), F.lit(0.0)).alias("relevance"))


def judged_reply(reply: Column, context: Column, expected: Column) -> Column:
    """A judge's JSON reply as score and sub-scores; no context 0, no expected answer 0.5; a reply that
    cannot be read falls back to the share of the answer's words in the context."""
    parsed = F.from_json(strip_fence(reply), JUDGE_JSON)
    read = F.coalesce(F.try_parse_json(strip_fence(reply)).isNotNull() & parsed.isNotNull(), F.lit(False))
    none = F.coalesce(context, F.lit("")) == ""
    asked = read & ~none & (F.coalesce(expected, F.lit("")) != "")
    score = F.when(none, 0.0).when(F.coalesce(expected, F.lit("")) == "", 0.5).when(read, F.coalesce(parsed["score"], F.lit(0.0))).otherwise(metrics.sufficiency(context, expected))
    parts = [F.when(asked, F.coalesce(parsed[c], F.lit(0.0))).alias(c) for c in ("information_presence", "completeness", "temporal_info", "no_contradiction")]
    return F.struct(score.alias("score"), F.when(asked, "llm_judge").otherwise("simple").alias("method"), *parts)


def prefixed(embed: Callable[[Column], Column], prefix: str) -> Callable[[Column], Column]:
    """An embedder of models that want a word before each text, such as ``query: `` or ``passage: ``."""
    return lambda text: embed(F.concat(F.lit(prefix), F.coalesce(text, F.lit(""))))


#: Words that models of some families want before a text, by task.
TASKS = {"query": "query: ", "passage": "passage: "}


def shortened(embed: Callable[[Column], Column], dim: int) -> Callable[[Column], Column]:
    """An embedder whose vectors are cut to their first ``dim`` numbers and made unit vectors again, for models
    that are trained to be cut; zero vectors stay."""
    return lambda text: once(F.slice(embed(text), 1, dim), lambda v: F.transform(unit(v), lambda x: x.cast("float")))


EMBEDDERS = {"hashing": hashing_embedder, "pandas": pandas_embedder}


def create_embedder(name: str, task: str | None = None, output_dim: int | None = None, **settings) -> Callable[[Column], Column]:
    """An embedder by name, for a task (``query`` or ``passage``: its word comes before each text) and with an
    output dimension. Others are added to ``EMBEDDERS``."""
    if name not in EMBEDDERS:
        raise ValueError(f"no embedder {name}: there are {', '.join(sorted(EMBEDDERS))}")
    embed = EMBEDDERS[name](**settings)
    embed = prefixed(embed, TASKS[task]) if task else embed
    return shortened(embed, output_dim) if output_dim else embed


def within(call: Callable[[list[str]], list[str]], seconds: float) -> Callable[[list[str]], list[str]]:
    """A call that gives up after some seconds, with a TimeoutError; the thread it ran in is left behind."""

    def limited(prompts: list[str]) -> list[str]:
        from concurrent.futures import ThreadPoolExecutor

        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(call, prompts).result(timeout=seconds)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return limited


def generator(call: Callable[[list[str]], list[str]], retries: int = 3, delay: float = 1.0, timeout: float | None = None) -> Callable[[Column], Column]:
    """A text model as a column function: Arrow batches, calls repeated after an error, or after ``timeout``
    seconds without a reply, with a growing pause; what still fails is null, so that the caller's fallback
    applies."""
    call = within(call, timeout) if timeout else call

    @F.pandas_udf(T.StringType())
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import time

        for prompts in batches:
            pause, out = 0.0, None
            for _ in range(retries):
                try:
                    out = call(prompts.tolist())
                    break
                except Exception:
                    pause = next_backoff(max(pause, delay), True, False)
                    time.sleep(pause)
            yield pd.Series(out if out is not None else [None] * len(prompts), dtype="object")

    return generate


def sufficiency_hook(queries: DataFrame, facts: DataFrame, generate: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """A ``sufficiency`` of the agent: the query's text and its facts in order go to a text model."""

    def ask(state: DataFrame) -> DataFrame:
        rows = state.join(facts.select("fact_id", "fact_text"), "fact_id")
        texts = F.transform(F.array_sort(F.collect_list(F.struct("round", "leg", "rank", "fact_text"))), lambda r: F.concat(F.lit("- "), r["fact_text"]))
        prompt = rows.groupBy("qid").agg(F.array_join(texts, "\n").alias("facts")).join(queries.select("qid", "text"), "qid")
        return prompt.select("qid", generate(F.concat_ws("\n", "text", "facts")).alias("reply"))

    return ask
