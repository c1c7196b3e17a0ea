"""Shared storage of intermediate tables, and the versioned table of URL states."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

URL_STATE = "url string, host string, depth int, done boolean, status int, last timestamp, num_visit int, num_retry int, num_error int, next_at timestamp, score int"
PROCESSING, FINISHED, ERROR = 0, 1, 2


def workspace(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir`` of the session; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="hopweave-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """``df`` written and read again, without its lineage."""
    path = f"{workspace(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class StateStore:
    """The table of URL states under a path. Every save adds a version with the states that are new or have
    changed; the last row of a URL in a complete version counts, so nothing saved before is lost."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        """Numbers of the complete versions."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def read(self, version: int) -> DataFrame:
        """The rows saved as one version."""
        return self.spark.read.schema(URL_STATE).parquet(f"{self.path}/v{version}")

    def load(self) -> DataFrame:
        found = None
        for v in self.versions():
            rows = self.read(v).withColumn("__v", F.lit(v))
            found = rows if found is None else found.union(rows)
        if found is None:
            return self.spark.createDataFrame([], URL_STATE)
        names = [c for c in found.columns if c != "__v"]
        return found.groupBy("url").agg(F.max_by(F.struct(*names), "__v").alias("r")).select("r.*")

    def save(self, state: DataFrame) -> int:
        """Add a version; columns that ``state`` lacks are null. Its number."""
        v = (self.versions() or [-1])[-1] + 1
        kinds = self.spark.createDataFrame([], URL_STATE).schema
        rows = state.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in state.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds])
        rows.write.mode("overwrite").parquet(f"{self.path}/v{v}")
        return v

    def unfinished(self) -> DataFrame:
        """States of the URLs to go on with after a stop."""
        return self.load().where("NOT done")

    def compact(self) -> None:
        """Write all states as one more version, so that the versions before it can be deleted."""
        self.save(self.load())


def save_jdbc(state: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> None:
    """Append states to a table of a database by their four-part key (``state.four_part``)."""
    state.write.jdbc(url, table, mode="append", properties=properties or {})
