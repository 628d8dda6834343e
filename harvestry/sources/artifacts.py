"""Stored page bodies and files: content hash and size, safe places below a root, metadata rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestry.functions.checks import file_name, relative_path
from harvestry.sources.staging import staged

#: How often another id is tried for a path that is taken.
TRIES = 16


def measure(df: DataFrame, content: str) -> DataFrame:
    """df with content_hash (SHA-256, lower-case hex) and byte_size of a text or binary column."""
    return df.withColumns({"content_hash": F.sha2(F.col(content).cast("binary"), 256), "byte_size": F.octet_length(content).cast("long")})


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content, content_hash, byte_size) of the files of a folder and those below it."""
    return measure(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder), "content")


def place(df: DataFrame, id_: str, folder: str, name: str) -> DataFrame:
    """df with safe_relative_path, <folder>/<id>-<name>; null where folder or name is not safe."""
    return df.withColumn("safe_relative_path", F.concat(relative_path(F.col(folder)), F.lit("/"), F.col(id_), F.lit("-"), file_name(F.col(name))))


def reserve(placed: DataFrame, id_: str, taken: DataFrame | None = None, tries: int = TRIES) -> DataFrame:
    """placed with the id and path of each artifact free: a path that is taken gets another id, and so on up to some tries.

    Of equal paths the one with the least row digest keeps its own; what a try gives follows from the row, so a rerun gives
    the same. Raises if a path cannot be reserved. taken has a column safe_relative_path. Rows equal in everything are one artifact.
    """
    rows = placed.distinct().withColumns({"__seed": F.sha2(F.to_json(F.struct(*placed.columns)), 256), "__try": F.lit(0), id_: F.col(id_).cast("string")})
    rows = staged(rows, "places")
    done, rows = rows.where("safe_relative_path is null"), rows.where("safe_relative_path is not null")
    used = taken.select("safe_relative_path") if taken is not None else placed.limit(0).select("safe_relative_path")
    for i in range(tries):
        used_ = used.select(F.col("safe_relative_path").alias("__p")).distinct()
        first = F.row_number().over(Window.partitionBy("safe_relative_path").orderBy("__try", "__seed")) == 1
        free = rows.withColumn("__first", first).join(used_, F.col("safe_relative_path") == F.col("__p"), "left")
        free = staged(free.withColumn("__free", F.col("__first") & F.col("__p").isNull()).drop("__first", "__p"), "reserved")
        one = free.where("__free").drop("__free")
        done = done.unionByName(one)
        rows = free.where("not __free").drop("__free")
        if rows.isEmpty():
            return done.drop("__seed", "__try")
        used = used.unionByName(one.select("safe_relative_path"))
        h = F.sha2(F.concat_ws("|", "__seed", F.lit(i + 1)), 256)
        new = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
        rest = F.expr(f"substr(safe_relative_path, length(safe_relative_path) - locate('/', reverse(safe_relative_path)) + 2 + length(`{id_}`))")
        folder = F.expr("substr(safe_relative_path, 1, length(safe_relative_path) - locate('/', reverse(safe_relative_path)) + 1)")
        rows = rows.withColumns({"safe_relative_path": F.concat(folder, new, rest), id_: new, "__try": F.lit(i + 1)})
    raise FileExistsError(f"no free name in {tries} tries")


def collisions(placed: DataFrame) -> DataFrame:
    """Paths that more than one artifact has."""
    return placed.where("safe_relative_path is not null").groupBy("safe_relative_path").agg(F.count("*").alias("rows")).where("rows > 1")


def record(measured: DataFrame, id_: str, run_id: str, media_type: str = "text/html") -> DataFrame:
    """Metadata rows of measured artifacts."""
    return measured.select(F.col(id_).cast("string").alias("artifact_id"), F.lit(run_id).alias("run_id"), "content_hash", "byte_size", F.lit(media_type).alias("media_type"))
