"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from factloom.shared import forget, saved, scratch, scratch_dir

__all__ = ["documents", "forget", "map_texts", "saved", "scratch", "scratch_dir", "slices", "text_of"]

#: A word of the document contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Text handed to a Python kernel at once; a single longer text still goes alone and whole.
SLICE_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, text_at: int, limit: int = SLICE_BYTES, also: int | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text (and of a second column, ``also``), or one row."""
    start, held = 0, 0
    lengths = pc.binary_length(batch.column(text_at)).to_pylist()
    if also is not None:
        lengths = [(n or 0) + (m or 0) for n, m in zip(lengths, pc.binary_length(batch.column(also)).to_pylist(), strict=True)]
    for i, n in enumerate(lengths):
        n = n or 0
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    keep: Sequence[str],
    text: str,
    fields: Sequence[tuple[str, T.DataType]],
    make: Callable[[], Callable[[list[str | None]], Sequence[Sequence]]],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Narrow map over whole texts: ``make()`` once a task, its result once a slice of rows.

    Returns the ``keep`` columns and one column for each of ``fields``; no shuffle. Memory of a task
    is bounded by an Arrow batch and ``limit`` bytes of text, or by the longest text.
    """
    chosen = df.select(*[df[c] for c in keep], df[text].cast("string").alias("__text"))
    schema = T.StructType([*chosen.schema.fields[:-1], *(T.StructField(n, t) for n, t in fields)])
    kinds = [to_arrow_type(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, len(keep), limit):
                out = work(part.column(len(keep)).to_pylist())
                made = [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=schema.names)

    return chosen.mapInArrow(run, schema)
