"""Tables that a query makes on its way: written to the folder that driver and executors share, deleted when it is done."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, in one process (tests), a temporary folder where that is unset."""
    root, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not root:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}"
    return root.rstrip("/")


class Scratch:
    """``with Scratch(spark) as s``: paths and tables that go at the end of the block, but for those that are ``kept``."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def path(self, name: str) -> str:
        self.paths.append(f"{shared_folder(self.spark)}/orrery-{name}-{uuid.uuid4().hex}")
        return self.paths[-1]

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """Written and read back: what follows survives a lost executor and recomputes nothing."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def kept(self, df: DataFrame, name: str = "result") -> DataFrame:
        """The same for the result, which stays."""
        out = self.stored(df, name)
        self.paths.pop()
        return out

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
