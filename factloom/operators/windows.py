"""Rolling and tumbling budgets, sessions, running caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def utc(ts: str | Column) -> Column:
    """A timestamp with the session's zone (UTC) from one without a zone."""
    return (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")


def rolling(log: DataFrame, key: str, ts: str, seconds: int, amount: Column | None = None, name: str = "rolling") -> DataFrame:
    """Requests, or the sum of ``amount``, in the last ``seconds`` up to each row, its own included.

    Parts of a key by time keep a busy key out of one task: rows meet the rows of their own time
    cell, and of the cell before as look-back only.
    """
    micros = seconds * 1_000_000
    at = F.unix_micros(utc(ts))
    rows = log.withColumn("__at", at).withColumn("__cell", F.floor(at / (16 * micros)))
    value = F.lit(1) if amount is None else amount
    own = rows.withColumns({"__value": value, "__own": F.lit(True)})
    edge = own.where(F.col("__at") >= (F.col("__cell") + 1) * (16 * micros) - micros).withColumns({"__cell": F.col("__cell") + 1, "__own": F.lit(False)})
    window = Window.partitionBy(key, "__cell").orderBy("__at").rangeBetween(-micros, 0)
    return own.unionByName(edge).withColumn(name, F.sum("__value").over(window)).where("__own").drop("__at", "__cell", "__value", "__own")


def tumbling(log: DataFrame, ts: str, width: str, *by: str, amount: str | None = None) -> DataFrame:
    """Counts and sums of epoch-aligned windows."""
    sums = [F.sum(amount).alias("total")] if amount else []
    return log.groupBy(F.window(utc(ts), width).alias("w"), *by).agg(F.count("*").alias("n"), *sums).select(F.col("w.start").alias("start"), *by, "n", *(["total"] if amount else []))


def sliding(log: DataFrame, ts: str, width: str, slide: str, *by: str, amount: str | None = None) -> DataFrame:
    sums = [F.sum(amount).alias("total")] if amount else []
    return log.groupBy(F.window(utc(ts), width, slide).alias("w"), *by).agg(F.count("*").alias("n"), *sums).select(F.col("w.start").alias("start"), *by, "n", *(["total"] if amount else []))


def sessions(log: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    """Session windows of a key: start, end, n."""
    return log.groupBy(F.session_window(utc(ts), gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_cap(rows: DataFrame, by: str, order: list[Column | str], cap: int) -> DataFrame:
    """The first ``cap`` rows of each group in order."""
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("ord") <= cap)


def cumulative_text(rows: DataFrame, by: str, order: str, text: str, separator: str = "\n", last: int | None = None) -> DataFrame:
    """Adds cumulative: the texts of the group up to each row, in order. All of them are as much text as the
    square of the group; with ``last`` only that many are joined, and the result grows with the rows."""
    window = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding if last is None else 1 - last, 0)
    return rows.withColumn("cumulative", F.array_join(F.collect_list(text).over(window), separator))


def within_budget(log: DataFrame, key: str, ts: str, rpm: int, tpm: int, tokens: str) -> DataFrame:
    """Adds allowed: both rolling minutes, requests and tokens, are within their bounds."""
    out = rolling(log, key, ts, 60, name="requests_60s")
    out = rolling(out, key, ts, 60, F.col(tokens), "tokens_60s")
    return out.withColumn("allowed", (F.col("requests_60s") <= rpm) & (F.col("tokens_60s") <= tpm))
