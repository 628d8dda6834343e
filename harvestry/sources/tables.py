"""Tables: directories of Parquet files as views, rows in memory, point look-ups, and appends behind guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_MATCHERS = T.ArrayType(_schema(kind=_S, host=_S, pattern=_S, query=T.MapType(_S, _S)))
#: The tables of the data model.
SCHEMAS = {
    "collections": _schema(id=_S, name=_S, tags=T.ArrayType(_S)),
    "sources": _schema(id=_S, original_url=_S, canonical_url=_S, target=_S, status=_S, run_ids=T.ArrayType(_S), artifact_ids=T.ArrayType(_S)),
    "crawlers": _schema(id=_S, name=_S, collection_id=_S, operational_defaults_json=_S, active_published_version_id=_S, active_draft_version_id=_S),
    "crawler_versions": _schema(id=_S, crawler_id=_S, state=_S, semantic_configuration_json=_S),
    "seeds": _schema(id=_S, crawler_version_id=_S, url=_S, enabled=_B, label=_S, page_type_id=_S),
    "page_types": _schema(id=_S, crawler_version_id=_S, name=_S, priority=_I, matchers=_MATCHERS),
    "transitions": _schema(id=_S, crawler_version_id=_S, source_page_type_id=_S, target_page_type_id=_S, enabled=_B, priority=_I, max_links_per_source_page=_I, total_budget=_L, depth_contribution=_I, deduplicate=_B),
    "discovered_urls": _schema(run_id=_S, source_url=_S, source_page_type=_S, transition_id=_S, raw_href=_S, original_url=_S, canonical_url=_S, depth=_I, status=_S, discovered_at=_TS),
    "settings": _schema(scope=_S, scope_id=_S, key=_S, state=_S, value=_S, updated_at=_TS),
    "runs": _schema(run_id=_S, run_type=_S, status=_S, crawler_id=_S, crawler_version_id=_S, snapshot_json=_S, snapshot_hash=_S, checkpoint_compatibility_hash=_S, actor=_S, created_at=_TS),
    "artifacts": _schema(artifact_id=_S, run_id=_S, source_id=_S, content_hash=_S, byte_size=_L, media_type=_S, safe_relative_path=_S, created_at=_TS, metadata=_S),
    "audit_events": _schema(id=_S, event_type=_S, actor=_S, occurred_at=_S, entity_type=_S, entity_id=_S, payload_json=_S),
    "record_versions": _schema(dataset=_S, key=_S, version=_I, state=_S, values=_S, run_id=_S),
    "provenance": _schema(record_id=_S, field=_S, source_url=_S, canonical_url=_S, run_id=_S, page_type=_S, artifact_hash=_S, selector=_S, raw_value=_S, norm_value=_S, extracted_at=_TS),
    "progress_events": _schema(stream_id=_S, seq=_L, event_id=_S, kind=_S, ts=_TS, payload=_S),
    "destinations": _schema(id=_S, name=_S, destination_kind=_S, configuration=_S, secret_env_name=_S, created_at=_TS, updated_at=_TS),
    "test_evidence": _schema(id=_S, crawler_version_id=_S, urls=T.ArrayType(_S), findings=T.ArrayType(_S), created_at=_TS),
}


class NotFound(LookupError):
    """A row that has to be there is not."""


def open_folder(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a folder, each also a temporary view; read with their own schema where the model has one."""
    out = {}
    for name in names or list(SCHEMAS):
        reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
        out[name] = reader.parquet(f"{path}/{name}.parquet")
        out[name].createOrReplaceTempView(name)
    return out


def in_memory(spark: SparkSession, name: str, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMAS[name])


def lookup(df: DataFrame, key: str, value, required: bool = False) -> DataFrame:
    """The row of a key, by a filter that reaches the scan; an error if it has to be there and is not."""
    found = df.where(F.col(key) == value)
    if required and found.isEmpty():
        raise NotFound(f"{key} = {value!r}")
    return found


def append(df: DataFrame, path: str, *guards: DataFrame) -> None:
    """Append rows if no guard has a violation; the first few are in the error."""
    for g in guards:
        bad = g.take(5)
        if bad:
            raise ValueError("; ".join(f"{r['code']} {r['entity_id']}: {r['message']}" for r in bad))
    df.write.mode("append").parquet(path)


def pasted(spark: SparkSession, text: str) -> DataFrame:
    """(position, url, accepted, reason) for each line of a pasted list, in order; a bad one stops no other."""
    from harvestry.functions.urls import canonical, is_valid

    lines = [(i, x.strip()) for i, x in enumerate(text.splitlines()) if x.strip()]
    df = spark.createDataFrame(lines, "position int, url string")
    return df.select("position", "url", is_valid(F.col("url")).alias("accepted"), F.when(~is_valid(F.col("url")), "VALIDATION_ERROR").alias("reason"), canonical(F.col("url")).alias("canonical_url"))


def create_or_reuse(found: DataFrame, sources: DataFrame) -> DataFrame:
    """found (original_url, canonical_url) with the source_id of a known source, or null where one is new."""
    s = sources.groupBy(F.col("canonical_url").alias("__c")).agg(F.min("id").alias("source_id"))
    return found.join(s, F.col("canonical_url") == F.col("__c"), "left").drop("__c")
