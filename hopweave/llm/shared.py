"""Shared storage and table helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests) a temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="hopweave-")
    spark.sparkContext.setCheckpointDir(made)
    return made


_SCRATCH: list[list[str]] = []


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, so a lost
    executor costs only the tasks it was running."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hopweave-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table that ``materialise`` made, which nothing may read any more."""
    _delete(df.sparkSession, df._written_to)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` makes inside are deleted at the end; what is to outlive them is to be
    written by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _delete(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of an Arrow batch; texts of the default number of rows fill workers and their JVM alike.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Set the session to hand rows to Python in batches of ``BATCH_ROWS`` unless it has its own setting. Only
    the registered queries and the stages of the pipeline do so, never the operators."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def as_text(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator needs, text as string; extra columns never clash."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        *[F.col(f"`{m}`") for m in more],
    )


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names for columns that ``df`` doesn't have, in either case of letters."""
    held = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out
