"""Intermediate tables in the shared checkpoint folder.

A table that several plans read is written once as Parquet where every executor can read it, so a lost executor costs a
read and not a recomputation. The folder is the one named in ``spark.checkpoint.dir``; only where that is unset (tests in
local mode) a temporary folder is used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group: small ones need little memory to write and can be read by many tasks.
ROW_GROUP = 16 << 20
_LOCAL: list[str] = []
#: Whether Spark removes the shuffle files of a plan when it has run; nothing reads those of a table that is written.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/harvestry"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="harvestry-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


class Scratch:
    """Written tables of one operator call; ``drop`` deletes those that no later plan reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(CLEAN, None)
        self.spark.conf.set(CLEAN, "true")
        try:
            df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
        finally:
            self.spark.conf.set(CLEAN, before) if before is not None else self.spark.conf.unset(CLEAN)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t)))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
