"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a word budget: its share of all budgets by weight, never more than ``MOST`` times
its own size, the excess shared again by weight (water filling). A source first gives whole epochs
(every document once each), then a fraction: documents in the order of exponential keys, scaled by
their quality weight, until the rest of the budget is reached; the document at the edge is taken if
that comes nearer.

No row is shuffled. Keys are cut into ``BINS`` bins; sums by source and bin find the bin at the edge
of each source, and that bin is cut again until it holds few rows. Only those rows are ordered, which
gives one edge key for each source; then each row compares its key with the edge. A source with a
third of all rows is therefore spread over all tasks. The table of sources is joined by Spark, which
broadcasts it only below its size limit.

Cases: a null source is a source of its own, last in the order; a null or empty text has size 0 and
gives nothing; a null id is a valid id; rows with equal id, text and source have equal keys and fall
together, but for those at the edge, of which as many are taken as come nearest to the target (which of
them is open: they stand for each other); an empty table gives an empty table; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import WORD, forget, saved, text_of
from factloom.llm.quality import PUNCTUATION

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, "mix"
#: Bins of each cut (a power of two), and rows of a source's edge bin that are ordered in one task.
BINS, EDGE_ROWS = 1024, 50_000


def document_weight(text: Column) -> Column:
    """Quality weight from 0.5 to 1.5, of measures that the quality rules use: the share of characters
    that are no ASCII punctuation, times the share of lines that are no repetition, times the variety
    of the words (distinct ones over three times the root of their number, 1 at most)."""
    plain = F.coalesce(F.try_divide(F.length(F.translate(text, PUNCTUATION, "")), F.length(text)), F.lit(0.0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    fresh = F.coalesce(F.try_divide(F.size(F.array_distinct(lines)), F.size(lines)), F.lit(0.0))
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    variety = F.coalesce(F.try_divide(F.size(F.array_distinct(words)), 3 * F.sqrt(F.size(words))), F.lit(0.0))
    return F.lit(0.5) + plain * fresh * F.least(F.lit(1.0), variety)


def sampling_key(id_col: Column, weight: Column, seed: str = SEED) -> Column:
    """Exponential variate divided by the weight, the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(uniform) / weight


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Water filling. ``sizes``: (source_key, source, source_size), one row a source; adds target.

    The windows run over sources, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last(), "source_key")
    cyclic = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cyclic, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    line = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last(), "source_key")
    whole = Window.partitionBy()
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(whole)).alias("budget"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
    )
    level = (F.col("budget") - F.col("capped")) / F.col("open")
    ranked = ranked.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    # the first level that its own source does not cut; if rounding hides it, no source is cut
    ranked = ranked.withColumn("level", F.first("level", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return ranked.select("source_key", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = (), seed: str = SEED) -> DataFrame:
    """One row for each document: id, ``carry`` columns, size, source_size, target (of its source),
    epochs (whole), chosen (in the fraction) and taken (words)."""

    def scored(df: DataFrame, extra: tuple[str, ...]) -> DataFrame:
        body = text_of(df, text)
        name = df[source].cast("string")
        key = sampling_key(df[id_col], document_weight(body), seed)
        return df.select(
            df[id_col].alias("__id"),
            *[df[c].alias(f"__carry_{c}") for c in extra],
            name.alias("__source"),
            F.when(name.isNull(), "0").otherwise(F.concat(F.lit("1"), name)).alias("source_key"),
            F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
            key.alias("key"),
            F.least(1 - F.exp(-key), F.lit(1 - 2.0**-53)).alias("u"),
        )

    lean = saved(scored(docs, ()), "mix-rows")
    cut = lambda low, width: F.floor((F.col("u") - low) / width * BINS).cast("int")

    def edges(rows: DataFrame, plan: DataFrame | None):
        """Sums by bin, and the bin where the words so far pass the rest: its part of ``u`` and its rows."""
        bins = rows.groupBy("source_key", "low", "width", "before", cut(F.col("low"), F.col("width")).alias("bin"))
        bins = saved(bins.agg(F.max("__source").alias("source"), F.sum("size").alias("words"), F.count("*").alias("n")), "mix-bins")
        if plan is None:
            plan = saved(planned(bins), "mix-plan")
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("source_key").orderBy("bin"))
        edge = bins.withColumn("upto", upto).join(plan.select("source_key", "rest"), "source_key").where("upto - words <= rest and rest < upto")
        part = F.col("width") / BINS
        edge = saved(edge.select("source_key", (F.col("low") + F.col("bin") * part).alias("low"), part.alias("width"), (F.col("upto") - F.col("words")).alias("before"), "n"), "mix-edge")
        forget(bins)
        return plan, edge

    def planned(bins: DataFrame) -> DataFrame:
        sources = bins.groupBy("source_key").agg(F.max("source").alias("source"), F.sum("words").alias("source_size"))
        epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
        return source_targets(sources).withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    def inside(edge: DataFrame) -> DataFrame:
        """Rows of the edge bins. Bounds are multiples of powers of two, so no row falls between two."""
        rows = lean.join(edge.drop("n"), "source_key")
        return rows.where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("low") + F.col("width")))

    zero = F.lit(0.0)
    plan, edge = edges(lean.withColumns({"low": zero, "width": F.lit(1.0), "before": F.lit(0).cast("long")}), None)
    # a bin of equal keys stays as it is: its width falls below what a double can tell apart
    while not edge.where((F.col("n") > EDGE_ROWS) & (F.col("width") > 1e-13)).isEmpty():
        fine = edge.where((F.col("n") <= EDGE_ROWS) | (F.col("width") <= 1e-13))
        _, finer = edges(inside(edge.join(fine.select("source_key"), "source_key", "left_anti")), plan)
        both = saved(fine.unionByName(finer), "mix-edge")
        forget(edge, finer)
        edge = both
    # equal rows are one row here, with their number
    triples = inside(edge).groupBy("source_key", "before", "key", "__id", "size").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("source_key").orderBy("key", "__id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0))
    last = triples.withColumn("ahead", ahead).join(plan.select("source_key", "rest"), "source_key").where("ahead + size / 2 <= rest")
    fit = F.when(F.col("size") == 0, F.col("copies")).otherwise(F.floor((F.col("rest") - F.col("ahead")) / F.col("size") + 0.5)).cast("long")
    last = last.groupBy("source_key").agg(F.max(F.struct("key", "__id", "size", F.least("copies", fit).alias("take"), "copies")).alias("last"))
    last = last.select("source_key", F.struct("last.key", "last.__id", "last.size").alias("edge"), "last.take", "last.copies")
    final = saved(plan.join(edge.select("source_key", F.col("low").alias("edge_low")), "source_key", "left").join(last, "source_key", "left"), "mix-final")
    forget(plan, edge)

    place = F.struct("key", "__id", "size")
    cut_copies = F.coalesce((F.col("take") < F.col("copies")) & (place == F.col("edge")), F.lit(False))
    chosen = (F.col("u") < F.col("edge_low")) | F.coalesce(place <= F.col("edge"), F.lit(False))
    rows = scored(docs, carry) if carry else lean
    out = rows.join(final, "source_key").withColumn("chosen", F.coalesce(chosen, F.lit(False)))
    cut_sources = final.where("take < copies")
    if not cut_sources.isEmpty():
        out = out.where(~cut_copies).unionByName(_first_copies(_edge_rows(docs, cut_sources, id_col, source, lambda d: scored(d, carry)).join(final, "source_key").where(cut_copies)))
    return out.select(
        F.col("__id").alias(id_col),
        *[F.col(f"__carry_{c}").alias(c) for c in carry],
        "size", "source_size", "target", "epochs", "chosen",
        (F.col("size") * (F.col("epochs") + F.col("chosen").cast("long"))).alias("taken"),
    )


def _edge_rows(docs: DataFrame, cut_sources: DataFrame, id_col: str, source: str, scored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scored rows that have the source and the id of an edge; only these are scored again."""
    wanted = cut_sources.select(F.substring("source_key", 2, 1 << 30).alias("__name"), (F.col("source_key") == "0").alias("__none"), F.col("edge.__id").alias("__edge_id"))
    name = docs[source].cast("string")
    return scored(docs.join(wanted, docs[id_col].eqNullSafe(F.col("__edge_id")) & (F.coalesce(name, F.lit("")) == F.col("__name")) & (name.isNull() == F.col("__none")), "left_semi"))


def _first_copies(copies: DataFrame) -> DataFrame:
    """Equal rows at the edge of a source, of which ``take`` are chosen.

    The rows are written with a number. Parts of about ``EDGE_ROWS`` take their share of the number to
    take by prefix sums of their sizes, so no task orders more than a part."""
    parts = F.ceil(F.col("copies") / EDGE_ROWS)
    held = saved(copies.withColumn("__row", F.monotonically_increasing_id()).withColumn("__part", F.pmod(F.xxhash64("__row"), parts)), "mix-copies")
    sizes = held.groupBy("source_key", "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("source_key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = saved(sizes.select("source_key", "__part", before.alias("__before")), "mix-parts")
    place = F.row_number().over(Window.partitionBy("source_key", "__part").orderBy("__row"))
    numbered = held.join(sizes, ["source_key", "__part"]).withColumn("chosen", F.col("__before") + place <= F.col("take"))
    return numbered.drop("__row", "__part", "__before")
