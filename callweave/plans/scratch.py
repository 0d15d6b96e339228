"""Tables cut from their lineage: written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the cluster names one, or the folder set on the context; with a local master alone, else a temporary folder of this session's.

    A driver's temporary folder is of no use to executors on other machines, so a cluster without a shared folder is an error.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="callweave-"))
    return context._jsc.sc().getCheckpointDir().get()


def merged(df: DataFrame) -> DataFrame:
    """``df`` to be joined by sort and merge. Spark broadcasts a table by the size of its files; the rows of packed names and ids take
    ten times that and more of the driver's memory, several tables at once."""
    return df.hint("merge")


class Scratch:
    """``save`` writes a frame and rereads it, so that a lost executor costs no recomputation of what lies before; ``drop`` deletes one that nothing reads any more.

    With ``merge`` what it saves is joined as ``merged`` says."""

    def __init__(self, spark: SparkSession, merge: bool = False) -> None:
        self.spark, self.merge, self.root, self.paths = spark, merge, f"{shared_dir(spark).rstrip('/')}/callweave-{uuid.uuid4().hex}", {}

    def path(self) -> str:
        return f"{self.root}/{uuid.uuid4().hex}"

    def save(self, df: DataFrame) -> DataFrame:
        df.write.parquet(path := self.path())
        out = self.spark.read.schema(df.schema).parquet(path)
        out = merged(out) if self.merge else out
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if id(df) in self.paths:
                self.delete(self.paths.pop(id(df))[1])

    def delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
