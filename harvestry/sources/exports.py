"""Exports of approved rows, with a manifest of counts and checksums; backups and their check.

Formats: JSON lines, CSV, Markdown, Parquet, each as a folder that many tasks write; a JSON array and a SQLite file, which
are one file each by their nature, are written through the driver a partition at a time.
"""

from __future__ import annotations

import json
import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestry.operators.provenance import approved
from harvestry.sources.artifacts import read_files

SQLITE_TYPES = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.ShortType: "INTEGER", T.ByteType: "INTEGER", T.BooleanType: "INTEGER", T.DoubleType: "REAL", T.FloatType: "REAL", T.BinaryType: "BLOB"}
COMMIT = "_MANIFEST"


def markdown(df: DataFrame) -> DataFrame:
    """One text row a record: a heading with its first column, and a line a field."""
    first, *rest = df.columns
    lines = [F.concat(F.lit("## "), F.coalesce(F.col(first).cast("string"), F.lit("")))] + [F.concat(F.lit(f"- **{c}**: "), F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\s+", " "), F.lit(""))) for c in rest]
    return df.select(F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("value"))


def write(df: DataFrame, path: str, format_: str) -> None:
    """A folder (json array and sqlite: a file) at a path where nothing is yet."""
    if format_ == "jsonl":
        df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
    elif format_ == "csv":
        df.write.mode("errorifexists").option("header", "true").option("escape", '"').csv(path)
    elif format_ == "markdown":
        markdown(df).write.mode("errorifexists").text(path)
    elif format_ == "parquet":
        df.write.mode("errorifexists").parquet(path)
    elif format_ == "json":
        _json_array(df, path)
    elif format_ == "sqlite":
        sqlite_table(df, path, "records")
    else:
        raise ValueError(f"no format {format_!r}")


def _json_array(df: DataFrame, path: str) -> None:
    with open(f"{path}.partial", "x", encoding="utf-8") as f:
        f.write("[")
        for i, r in enumerate(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toLocalIterator()):
            f.write(",\n" * bool(i) + r[0])
        f.write("]\n")
    os.rename(f"{path}.partial", path)


def sqlite_table(df: DataFrame, path: str, table: str, replace: bool = False) -> int:
    """Typed columns; made new, or put in the place of the old table only when rows and columns have been counted again."""
    kinds = [(f.name, next((v for k, v in SQLITE_TYPES.items() if isinstance(f.dataType, k)), "TEXT"), isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))) for f in df.schema]
    quote = lambda x: '"' + x.replace('"', '""') + '"'
    rows = df.select(*[F.to_json(n) if nested else F.col(n) if kind != "TEXT" else F.col(n).cast("string") for n, kind, nested in kinds])
    with sqlite3.connect(path) as db:
        if not replace and db.execute("select 1 from sqlite_master where name = ?", (table,)).fetchone():
            raise FileExistsError(f"{table} is in {path}")
        stage = quote(f"{table}__staging")
        db.execute(f"drop table if exists {stage}")
        db.execute(f"create table {stage} ({', '.join(f'{quote(n)} {kind}' for n, kind, _ in kinds)})")
        n = 0
        for r in rows.toLocalIterator():
            db.execute(f"insert into {stage} values ({', '.join('?' * len(kinds))})", tuple(r))
            n += 1
        if db.execute(f"select count(*) from {stage}").fetchone()[0] != n:
            raise ValueError("rows were lost on the way")
        db.execute(f"drop table if exists {quote(table)}")
        db.execute(f"alter table {stage} rename to {quote(table)}")
    return n


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(file, byte_size, content_hash) of the files of an export, hidden ones left out."""
    files = read_files(spark, folder).where(~F.col("path").rlike(r"/[_.][^/]*\z"))
    return files.select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("file"), "byte_size", "content_hash")


def history(told: DataFrame, there: DataFrame) -> DataFrame:
    """told (manifests, whatever else they hold) with ``status``: AVAILABLE, FILE_CHANGED, or FILE_REMOVED for a file that is gone; no row goes."""
    now = there.select(F.col("file").alias("__f"), F.col("content_hash").alias("__h"))
    status = F.when(F.col("__f").isNull(), "FILE_REMOVED").when(F.col("__h") != F.col("content_hash"), "FILE_CHANGED").otherwise("AVAILABLE")
    return told.join(now, F.col("file") == F.col("__f"), "left").withColumn("status", status).drop("__f", "__h")


def export(records: DataFrame, folder: str, format_: str = "jsonl", provenance: DataFrame | None = None) -> dict:
    """Approved records, with their provenance if it is given, and a manifest; returns the manifest's totals."""
    spark, chosen = records.sparkSession, approved(records)
    write(chosen, f"{folder}/records", format_)
    if provenance is not None:
        write(provenance.join(chosen.select(F.col("key").alias("__k")), F.col("record_id") == F.col("__k"), "left_semi"), f"{folder}/provenance", "jsonl")
    files = manifest(spark, folder)
    files.write.mode("errorifexists").json(f"{folder}/{COMMIT}")
    total = files.agg(F.count("*").alias("files"), F.sum("byte_size").alias("bytes")).first()
    return {"files": total["files"], "bytes": total["bytes"], "records": chosen.count()}


def backup(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet, and a manifest with rows, files and checksums."""
    rows = {}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
        rows[name] = df.count()
    spark = next(iter(tables.values())).sparkSession
    files = read_files(spark, folder, "*.parquet").select(F.regexp_extract("path", r"([^/]+/[^/]+)\z", 1).alias("file"), "byte_size", "content_hash")
    files.withColumn("rows_by_table", F.lit(json.dumps(rows))).write.mode("errorifexists").json(f"{folder}/{COMMIT}")


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """(file, problem) for files that are missing, changed or not in the manifest; empty for a sound backup."""
    told = spark.read.json(f"{folder}/{COMMIT}").select("file", F.col("content_hash").alias("told"))
    there = read_files(spark, folder, "*.parquet").select(F.regexp_extract("path", r"([^/]+/[^/]+)\z", 1).alias("__f"), F.col("content_hash").alias("now"))
    j = told.join(there, F.col("file") == F.col("__f"), "full_outer")
    problem = F.when(F.col("now").isNull(), "MISSING").when(F.col("told").isNull(), "UNKNOWN").when(F.col("told") != F.col("now"), "CHANGED")
    return j.select(F.coalesce("file", "__f").alias("file"), problem.alias("problem")).where("problem is not null")


def restore(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a backup by name, once its files and rows are those of the manifest."""
    problems = verify(spark, folder).limit(10).collect()
    if problems:
        raise ValueError("the backup is not sound: " + ", ".join(f"{r['file']} {r['problem']}" for r in problems))
    first = spark.read.json(f"{folder}/{COMMIT}").select("rows_by_table").first()
    rows = json.loads(first[0]) if first else {}
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in rows}
    for name, df in tables.items():
        if df.count() != rows[name]:
            raise ValueError(f"{name} has not the rows that the backup tells")
    return tables


def probe(folder: str) -> dict[str, bool]:
    """What a local destination can do: be reached, written, renamed in and cleaned."""
    out = {"reachable": os.path.isdir(folder), "write": False, "rename": False, "drop": False}
    if out["reachable"]:
        a, b = os.path.join(folder, ".probe"), os.path.join(folder, ".probe2")
        try:
            with open(a, "x") as f:
                f.write("x")
            out["write"] = True
            os.rename(a, b)
            out["rename"] = True
            os.remove(b)
            out["drop"] = True
        except OSError:
            pass
    return out
