"""Tables written to the folder that all executors share.

Long plans are cut by written tables: they survive lost executors, and a step is computed once
however often its result is used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open: list[list[DataFrame]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written tables: ``spark.checkpoint.dir`` of the session.

    A folder of our own is made only where the setting is absent and the session is local (tests);
    on a cluster without the setting this fails rather than write to one machine's disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    path = f"{scratch_dir(df.sparkSession)}/factloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    if _open:
        _open[-1].append(table)
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables made by :func:`saved` that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for parent in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes, at its end, all tables saved inside: for callers that have written the result away.

    An operator's result is lazy and may read tables that it saved, so it cannot delete the last ones
    itself."""
    _open.append([])
    try:
        yield
    finally:
        forget(*_open.pop())
