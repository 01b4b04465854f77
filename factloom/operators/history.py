"""What was there before: searches over the earlier rows of a session, without joining each row to them.

``history_search`` ranks the earlier turns of a session for each asking turn by shared words. Turns and
questions of a session are dealt to chunks; a cell sweeps its questions and turns in order with a running
index of words, so a question meets what was stored before it and no pair is a row. ``running_top`` keeps
the best rows so far: chunks of a session give their own best, these are merged in order, and each chunk
starts from what its predecessors leave. In both the rows moved grow with the turns, not with their
square, and a session with a third of all rows is spread over its chunks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factloom.operators.products import fields, whole

#: Turns of a chunk (about), and chunks of a session at most: a turn goes to as many cells.
CHUNK, CHUNKS = 4096, 16


class History:
    """A running index: words of turns in order, and the best of them for a question."""

    def __init__(self) -> None:
        self.places: dict[str, list[int]] = {}
        self.n = 0

    def add(self, words: list[str]) -> None:
        """The next turn; its words are distinct."""
        for w in words:
            self.places.setdefault(w, []).append(self.n)
        self.n += 1

    def top(self, words: list[str], k: int) -> list[tuple[int, float]]:
        """Places and scores of the best ``k`` turns so far: share of the question's words they hold, the
        newest first among equals."""
        held = [self.places[w] for w in words if w in self.places]
        counts = np.bincount(np.concatenate([np.asarray(x) for x in held]), minlength=self.n) if held else np.zeros(self.n, np.int64)
        order = counts * (self.n + 1) + np.arange(self.n)
        first = np.argpartition(order, self.n - k)[self.n - k :] if k < self.n else np.arange(self.n)
        first = first[np.argsort(-order[first])]
        return [(int(i), float(counts[i]) / len(words) if words else 0.0) for i in first]


def history_search(turns: DataFrame, questions: DataFrame, k: int, chunk: int = CHUNK, chunks: int = CHUNKS) -> DataFrame:
    """session_id, asked, turn, score, rank: for each question the best ``k`` turns stored before it.

    ``turns``: session_id, turn, words (distinct); ``questions``: session_id, asked, words. A turn number is
    unique in its session; of equal scores the later turn comes first."""
    parts = turns.groupBy("session_id").agg(F.least(F.lit(chunks), F.ceil(F.count("*") / chunk)).cast("int").alias("parts"))
    parts = parts.select(F.col("session_id").alias("__session"), "parts")
    same = F.col("session_id").eqNullSafe(F.col("__session"))
    spread = lambda c: F.pmod(F.xxhash64(c), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    stored = turns.select(*[F.col(c).alias(c) for c in ("session_id", "turn", "words")]).join(parts, same).select("session_id", "turn", "words", spread("turn").alias("stored"), every.alias("asking"))
    asked = questions.select(*[F.col(c).alias(c) for c in ("session_id", "asked", "words")]).join(parts, same).select("session_id", "asked", "words", spread("asked").alias("asking"), every.alias("stored"))

    def run(some: pa.Table, questions: pa.Table) -> pa.Table:
        some, questions = some.sort_by("turn"), questions.sort_by("asked")
        numbers, words = some["turn"].to_pylist(), some["words"].to_pylist()
        history, rows = History(), []
        for i, (at, wanted) in enumerate(zip(questions["asked"].to_pylist(), questions["words"].to_pylist(), strict=True)):
            while history.n < len(numbers) and numbers[history.n] < at:
                history.add(words[history.n] or [])
            rows += [(i, numbers[place], score) for place, score in history.top(wanted or [], k)]
        at, turn, score = zip(*rows, strict=True) if rows else ((), (), ())
        picked = questions.take(pa.array(at, pa.int64()))
        return pa.table([whole(picked["session_id"]), whole(picked["asked"]), pa.array(turn, some.schema.field("turn").type), pa.array(score, pa.float64())], names=["session_id", "asked", "turn", "score"])

    by = ("session_id", "stored", "asking")
    kinds = T.StructType([turns.schema["session_id"], questions.schema["asked"], turns.schema["turn"], *fields(("score", T.DoubleType()))])
    hits = stored.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, kinds)
    order = Window.partitionBy("session_id", "asked").orderBy(F.desc("score"), F.desc("turn"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def running_top(rows: DataFrame, by: str, order: str, score: str, k: int, chunk: int = CHUNK) -> DataFrame:
    """``by``, asked, ``order``, rank: for each row, asked being its number, the best ``k`` rows of its group up
    to it, itself included; of equal scores the earlier first. ``order`` is a number, unique in its group."""
    slim = rows.select(by, order, F.col(score).cast("double").alias("score"), F.floor(F.col(order) / chunk).alias("chunk"))
    best = F.row_number().over(Window.partitionBy(by, "chunk").orderBy(F.desc("score"), order))
    tops = slim.withColumn("place", best).where(F.col("place") <= k).drop("place")

    def carried(some: pa.Table) -> pa.Table:
        """What each chunk finds from those before it: ``k`` rows of a chunk come in, at most ``k`` go out."""
        some = some.sort_by([("chunk", "ascending")])
        out, now, last = [], [], None
        for group, number, value, at in zip(*(some[c].to_pylist() for c in (by, order, "score", "chunk")), strict=True):
            if at != last:
                if last is not None:
                    now = heapq.nsmallest(k, now)
                    out += [(group, n, -s, at) for s, n in now]
                last = at
            now.append((-value, number))
        columns = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, some.schema, strict=True)], schema=some.schema)

    before = tops.groupBy(by).applyInArrow(carried, slim.schema)

    def sweep(some: pa.Table, earlier: pa.Table) -> pa.Table:
        some = some.sort_by(order)
        heap = [(s, -n) for s, n in zip(earlier["score"].to_pylist(), earlier[order].to_pylist(), strict=True)]
        heapq.heapify(heap)
        out = []
        for group, number, value in zip(*(some[c].to_pylist() for c in (by, order, "score")), strict=True):
            heapq.heappush(heap, (value, -number))
            if len(heap) > k:
                heapq.heappop(heap)
            out += [(group, number, -n, i) for i, (_, n) in enumerate(sorted(heap, reverse=True), 1)]
        kinds = [some.schema.field(by).type, some.schema.field(order).type, some.schema.field(order).type, pa.int64()]
        columns = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[by, "asked", order, "rank"])

    number = slim.schema[order].dataType
    kinds = T.StructType([slim.schema[by], *fields(("asked", number), (order, number), ("rank", T.LongType()))])
    return slim.groupBy(by, "chunk").cogroup(before.groupBy(by, "chunk")).applyInArrow(sweep, kinds)
