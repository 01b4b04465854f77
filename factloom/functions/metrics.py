"""Evaluation metrics as expressions over array and string columns.

Facts are arrays of texts. Defaults for empty sides differ by metric and are stated with each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import once, overlap, tokens


def _pool(texts: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(texts, tokens)))


def _share(hits: Column, of: Column) -> Column:
    return F.size(hits).cast("double") / F.size(of)


def _covered(words: Column, texts: Column, share: float) -> Column:
    """Texts with more than ``share`` of their words among ``words``."""
    return once(words, lambda w: F.filter(texts, lambda f: F.coalesce(overlap(w, tokens(f)) > share, F.lit(False))))


def context_recall(retrieved: Column, required: Column) -> Column:
    """Required facts with more than half of their words retrieved. Nothing required: 1; nothing retrieved: 0."""
    hits = _covered(_pool(retrieved), required, 0.5)
    return F.when(F.size(required) == 0, 1.0).when(F.size(retrieved) == 0, 0.0).otherwise(_share(hits, required))


def context_precision(retrieved: Column, relevant: Column) -> Column:
    """Retrieved facts with more than 0.3 of their words relevant. An empty side: 0."""
    hits = _covered(_pool(relevant), retrieved, 0.3)
    return F.when((F.size(retrieved) == 0) | (F.size(relevant) == 0), 0.0).otherwise(_share(hits, retrieved))


def fact_coverage(context: Column, facts: Column) -> Column:
    """Non-empty facts with more than half of their words in the context. No facts: 1; no context: 0."""
    covered = once(F.filter(facts, lambda f: f != ""), lambda named: F.when(F.size(named) == 0, 0.0).otherwise(_share(_covered(tokens(context), named, 0.5), named)))
    return F.when(F.size(facts) == 0, 1.0).when(F.coalesce(context, F.lit("")) == "", 0.0).otherwise(covered)


def _matches(fact: Column, wanted: Column) -> Column:
    """Half or more of the wanted words; an answer of blanks only is matched by any fact."""
    return F.when(F.size(wanted) == 0, F.lit(True)).otherwise(overlap(tokens(fact), wanted) >= 0.5)


def hit_rate(retrieved: Column, expected: Column) -> Column:
    """1 if a fact matches the expected answer. Empty answer or no facts: 0."""
    hit = once(tokens(expected), lambda wanted: F.exists(retrieved, lambda f: _matches(f, wanted)).cast("double"))
    return F.when((F.coalesce(expected, F.lit("")) == "") | (F.size(retrieved) == 0), 0.0).otherwise(hit)


def reciprocal_rank(retrieved: Column, expected: Column) -> Column:
    """1 / rank of the first fact that matches, else 0."""
    place = once(tokens(expected), lambda wanted: F.array_position(F.transform(retrieved, lambda f: _matches(f, wanted)), True))
    return F.when(F.coalesce(expected, F.lit("")) == "", 0.0).otherwise(F.when(place > 0, F.lit(1.0) / place).otherwise(0.0))


def temporal_recall(retrieved: Column, references: Column) -> Column:
    """References that some retrieved text holds, case aside. No references: 1; nothing retrieved: 0."""
    low = F.transform(retrieved, lambda t: F.lower(t))
    hits = once(low, lambda texts: F.filter(references, lambda r: (r != "") & once(F.lower(r), lambda x: F.exists(texts, lambda t: F.contains(t, x)))))
    return F.when(F.size(references) == 0, 1.0).when(F.size(retrieved) == 0, 0.0).otherwise(_share(hits, references))


def sufficiency(context: Column, answer: Column) -> Column:
    """Share of the answer's words in the context; an empty side: 0."""
    return F.coalesce(overlap(tokens(context), tokens(answer)), F.lit(0.0))


def answer_f1(generated: Column, expected: Column) -> Column:
    """F1 of word sets. No generated answer: 0; no expected answer: 0.5."""
    def f1(a: Column, b: Column) -> Column:
        common = F.size(F.array_intersect(a, b)).cast("double")
        return F.coalesce(F.try_divide(2 * common, (F.size(a) + F.size(b)).cast("double")), F.lit(0.0))

    both = once(tokens(generated), lambda a: once(tokens(expected), lambda b: f1(a, b)))
    return F.when(F.coalesce(generated, F.lit("")) == "", 0.0).when(F.coalesce(expected, F.lit("")) == "", 0.5).otherwise(both)


def rank_agreement(predicted: Column, actual: Column) -> Column:
    """(Kendall's tau + 1) / 2 over common items; an item's last position counts.

    Fewer than two items: 1; fewer than two common items: 0.5. Items are placed once; a pair is
    concordant if the later one of the predicted order is later in the actual order, too.
    """
    last = lambda items, x: F.size(items) - F.array_position(F.reverse(items), x)
    places = F.array_sort(F.transform(F.array_intersect(predicted, actual), lambda x: F.struct(last(predicted, x).alias("p"), last(actual, x).alias("a"))))
    # the second places in the order of the first: concordant pairs are those that ascend
    ordered = F.transform(places, lambda x: x["a"])

    def tau(a: Column) -> Column:
        n = F.size(a)
        above = lambda x, i: F.size(F.filter(F.slice(a, i + 2, n), lambda y: y > x)).cast("double")
        concordant = F.aggregate(F.transform(a, above), F.lit(0.0), lambda s, x: s + x)
        pairs = (n * (n - 1)).cast("double") / 2
        return F.when(n < 2, 0.5).otherwise((((2 * concordant - pairs) / pairs) + 1) / 2)

    return F.when((F.size(predicted) < 2) | (F.size(actual) < 2), 1.0).otherwise(once(ordered, tau))


def session_hit(retrieved: Column, relevant: Column) -> Column:
    return F.arrays_overlap(retrieved, relevant).cast("double")


def session_reciprocal_rank(retrieved: Column, relevant: Column, distinct: bool = True) -> Column:
    """1 / place of the first relevant session; ``distinct`` counts each retrieved session once."""
    ordered = F.array_distinct(retrieved) if distinct else retrieved
    ranks = F.filter(F.transform(ordered, lambda s, i: F.when(F.array_contains(relevant, s), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(F.lit(1.0) / F.array_min(ranks), F.lit(0.0))


def heuristic_sufficiency(n: Column, high: Column, mean: Column) -> tuple[Column, Column]:
    """Enough facts, and confidence: ``high`` of ``n`` facts score above 0.7, ``mean`` is their mean score."""
    return (high >= 5) | ((n >= 10) & (mean > 0.6)), F.least(F.lit(1.0), high / 5.0 * mean)
