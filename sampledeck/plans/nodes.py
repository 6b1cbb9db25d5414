"""Results that several branches of a program use, made once: written to the shared folder, read by
each branch, and deleted when the program's own result is there."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from sampledeck.plans.observation import Signal


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one where none is
    named, which a local session alone can do with."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.mkdtemp(prefix='sampledeck-')}"


def new_folder(spark: SparkSession, name: str = "node") -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Node:
    signal: Signal
    url: str

    def release(self) -> None:
        """Deletes the files. Plans that read them can't run any more."""
        spark = self.signal.data.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.url)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def finished(self, result: DataFrame) -> DataFrame:
        """result, which must be small, worked out and written; this node is released."""
        out = kept(result, f"{self.url}-result")
        self.release()
        return out


def kept(df: DataFrame, url: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(url)
    return df.sparkSession.read.schema(df.schema).parquet(url)


def materialised(signal: Signal) -> Node:
    """signal as files of the shared folder, with its weights."""
    url = new_folder(signal.data.sparkSession)
    data = kept(signal.data, f"{url}/data")
    weights = signal.weighing(lambda w: replace(w, table=kept(w.table, f"{url}/weights")))
    return Node(Signal(data, signal.obs, weights), url)
