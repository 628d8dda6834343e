"""Where each value came from: rows by record and field, and the trace of a value back to its page, run and version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def emit(records: DataFrame, key: str, fields: dict[str, str], context: dict[str, Column | str]) -> DataFrame:
    """One row a record and field: record_id, field, raw_value, norm_value, and the context columns.

    fields: the normalized column by the raw one. A value that is null in both forms gives no row. The hash of the page is part
    of the context, so lineage stays when the page itself is cleaned up.
    """
    pairs = F.array(*[F.struct(F.lit(norm).alias("field"), F.col(raw).cast("string").alias("raw_value"), F.col(norm).cast("string").alias("norm_value")) for raw, norm in fields.items()])
    own = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in context.items()]
    out = records.select(F.col(key).alias("record_id"), *own, F.explode(pairs).alias("p"))
    return out.select("record_id", "p.field", "p.raw_value", "p.norm_value", *context).where("raw_value is not null or norm_value is not null")


def trace(provenance: DataFrame, runs: DataFrame, versions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Provenance rows with their run's type, version's state and artifact's path; what is gone is null, no row is lost."""
    r = runs.select(F.col("run_id").alias("__r"), "run_type", F.col("crawler_version_id").alias("version_id"))
    v = versions.select(F.col("id").alias("__v"), F.col("state").alias("version_state"))
    a = artifacts.groupBy("content_hash").agg(F.min("safe_relative_path").alias("artifact_path")).withColumnRenamed("content_hash", "__a")
    out = provenance.join(r, F.col("run_id") == F.col("__r"), "left").join(v, F.col("version_id") == F.col("__v"), "left").join(a, F.col("artifact_hash") == F.col("__a"), "left")
    return out.drop("__r", "__v", "__a")


def approved(records: DataFrame, state: str = "state") -> DataFrame:
    """What a standard export may hold."""
    return records.where(F.col(state) == "APPROVED")
