"""Immutable run snapshots: validation, canonical JSON, two content hashes, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestry.functions.checks import is_blank, is_sha256

#: What decides whether a run may go on from another's checkpoint.
RESUME_FIELDS = ("run_type", "configuration", "selected_seed_ids", "settings")
RESUME_ROBOTS = ("decision", "affected_scope", "user_agent")


def _json(column: Column, kind: T.DataType) -> Column:
    """A value as JSON text with keys in order; null is written out."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f'"{f.name}":'), _json(column.getField(f.name), f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        body = F.concat(F.lit("{"), *[x for i, p in enumerate(parts) for x in ((F.lit(","), p) if i else (p,))], F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        body = F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: _json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(column))
        body = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_json(e.key, T.StringType()), F.lit(":"), _json(e.value, kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, T.StringType):
        quoted = F.to_json(F.struct(column.alias("x")))  # JSON's own escapes
        body = F.substring(quoted, 6, 1 << 30)
        body = F.substring(body, F.lit(1), F.length(body) - 1)
    else:
        body = column.cast("string")
    return F.when(column.isNull(), F.lit("null")).otherwise(body)


def canonical(df: DataFrame, column: str) -> Column:
    """A column of df as canonical JSON: keys sorted at every depth, compact, nulls written, arrays in order."""
    return _json(F.col(column), df.schema[column].dataType)


def canonical_sha256(df: DataFrame, column: str) -> Column:
    return F.sha2(canonical(df, column), 256)


def violations(run: str = "run") -> Column:
    """Array of what is wrong with a snapshot struct; empty for a valid one."""
    c = lambda name: F.col(f"{run}.{name}")
    quick = c("run_type") == "QUICK_SCRAPE"
    ad_hoc = c("configuration.kind") == "quick_scrape"
    rules = [
        (is_blank(c("actor")), "actor is empty"),
        (is_blank(c("created_at")), "creation time is empty"),
        (is_blank(c("settings.user_agent.value")), "user agent is empty"),
        (~F.coalesce(c("settings.user_agent.value") == c("robots.user_agent"), F.lit(False)), "user agents differ"),
        ((c("robots.decision.decision") == "OVERRIDE") & is_blank(c("robots.decision.reason")), "override without a reason"),
        (quick & ad_hoc & c("robots.crawler_version_id").isNotNull(), "quick scrape names a version"),
        (quick & ~ad_hoc, "quick scrape needs an ad-hoc configuration"),
        (~quick & ad_hoc, "only a quick scrape has an ad-hoc configuration"),
        (~quick & ~ad_hoc & ~F.coalesce(c("robots.crawler_version_id") == c("configuration.crawler_version_id"), F.lit(False)), "robots audit names another version"),
        (~quick & ~ad_hoc & ~is_sha256(c("configuration.semantic_config_hash")), "configuration hash is not a SHA-256"),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(text)) for test, text in rules]), lambda x: x.isNotNull())


def hashed(runs: DataFrame, run: str = "run") -> DataFrame:
    """runs with snapshot_hash, checkpoint_compatibility_hash and violations."""
    resume = F.struct(*[F.col(f"{run}.{f}").alias(f) for f in RESUME_FIELDS], *[F.col(f"{run}.robots.{f}").alias(f"robots_{f}" if f != "user_agent" else f) for f in RESUME_ROBOTS])
    out = runs.withColumn("__resume", resume)
    return out.withColumns({"snapshot_hash": canonical_sha256(out, run), "checkpoint_compatibility_hash": canonical_sha256(out, "__resume"), "violations": violations(run)}).drop("__resume")


def tampered(stored: DataFrame, run: str = "run") -> DataFrame:
    """Stored runs whose hashes are not those of their content."""
    again = hashed(stored.withColumnsRenamed({"snapshot_hash": "__s", "checkpoint_compatibility_hash": "__c"}), run)
    return again.where(~F.col("__s").eqNullSafe(F.col("snapshot_hash")) | ~F.col("__c").eqNullSafe(F.col("checkpoint_compatibility_hash"))).drop("__s", "__c")


def resumable(runs: DataFrame, others: DataFrame) -> DataFrame:
    """(run_id, resumes_run_id, compatible) for runs that name a run to resume: the two have one compatibility hash; false where that run is not there."""
    o = others.select(F.col("run_id").alias("__r"), F.col("checkpoint_compatibility_hash").alias("__h"))
    j = runs.where("resumes_run_id is not null").join(o, F.col("resumes_run_id") == F.col("__r"), "left")
    return j.select("run_id", "resumes_run_id", F.coalesce(F.col("checkpoint_compatibility_hash") == F.col("__h"), F.lit(False)).alias("compatible"))


def changed(before: DataFrame, after: DataFrame, key: str = "run_id", mutable: tuple[str, ...] = ("status",)) -> DataFrame:
    """Rows of after that change an immutable column of before."""
    fixed = [c for c in before.columns if c != key and c not in mutable]
    b = before.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in fixed])
    differs = F.lit(False)
    for c in fixed:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return after.join(b, F.col(key) == F.col("__k")).where(differs).select(*after.columns)


def robots_payload(robots: str = "robots") -> Column:
    """The audit payload of a robots decision; no reason where robots are respected."""
    c = lambda n: F.col(f"{robots}.{n}")
    reason = F.when(c("decision.decision") == "OVERRIDE", c("decision.reason"))
    return F.to_json(F.struct(c("decision.decision").alias("decision"), reason.alias("reason"), c("actor").alias("actor"), c("decided_at").alias("decided_at"), c("affected_scope").alias("affected_scope"), c("user_agent").alias("user_agent"), c("crawler_version_id").alias("crawler_version_id")))
