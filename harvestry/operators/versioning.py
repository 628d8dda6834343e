"""Versions, pointers and audit as an append-only log: guards before an append, pointers derived from the events.

Every guard is a DataFrame of violations (severity, code, entity_id, message); an append goes ahead if it is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the audit log records.
DRAFT_ACTIVATED, PUBLISHED, REACTIVATED, RUN_CREATED = "CRAWLER_DRAFT_ACTIVATED", "CRAWLER_VERSION_PUBLISHED", "CRAWLER_VERSION_REACTIVATED", "CRAWL_RUN_CREATED"


def violation(severity: str, code: str, entity: Column, message: Column) -> list[Column]:
    return [F.lit(severity).alias("severity"), F.lit(code).alias("code"), entity.cast("string").alias("entity_id"), message.alias("message")]


def changes_to_published(versions: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows (id, crawler_id, state, semantic_configuration_json) that would change a published version."""
    fixed = versions.where("state = 'PUBLISHED'").select(F.col("id").alias("__v"))
    return incoming.join(fixed, F.col("id") == F.col("__v"), "left_semi").select(*violation("ERROR", "CONFLICT", F.col("id"), F.lit("a published version cannot change")))


def changes_under_published(versions: DataFrame, children: DataFrame, parent: str = "crawler_version_id") -> DataFrame:
    """Rows of child tables (seeds, page types, transitions) whose version is published."""
    fixed = versions.where("state = 'PUBLISHED'").select(F.col("id").alias("__v"))
    return children.join(fixed, F.col(parent) == F.col("__v"), "left_semi").select(*violation("ERROR", "CONFLICT", F.col("id"), F.lit("rows under a published version cannot change")))


def matchers_under_published(versions: DataFrame, page_types: DataFrame, matchers: DataFrame) -> DataFrame:
    """The same for matchers, two tables away from their version."""
    types = page_types.join(versions.where("state = 'PUBLISHED'").select(F.col("id").alias("__v")), F.col("crawler_version_id") == F.col("__v")).select(F.col("id").alias("__t"))
    return matchers.join(types, F.col("page_type_id") == F.col("__t"), "left_semi").select(*violation("ERROR", "CONFLICT", F.col("id"), F.lit("matchers under a published version cannot change")))


def draft_guard(crawlers: DataFrame, drafts: DataFrame) -> DataFrame:
    """Drafts (id, crawler_id, state) that cannot become active: not a draft, no such crawler, or another draft is active."""
    c = crawlers.select(F.col("id").alias("__c"), "active_draft_version_id")
    j = drafts.join(c, F.col("crawler_id") == F.col("__c"), "left")
    free = F.col("active_draft_version_id").isNull() | (F.col("active_draft_version_id") == F.col("id"))
    why = F.when(F.col("__c").isNull(), "no such crawler").when(F.col("state") != "DRAFT", "not a draft").when(~free, "another draft is active")
    return j.withColumn("__why", why).where("__why is not null").select(*violation("ERROR", "CONFLICT", F.col("id"), F.col("__why")))


def reactivation_guard(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted rows (crawler_id, version_id) that are not a published version of that crawler."""
    ok = versions.where("state = 'PUBLISHED'").select(F.col("id").alias("__v"), F.col("crawler_id").alias("__c"))
    bad = wanted.join(ok, (F.col("version_id") == F.col("__v")) & (F.col("crawler_id") == F.col("__c")), "left_anti")
    return bad.select(*violation("ERROR", "CONFLICT", F.col("version_id"), F.lit("not a published version of this crawler")))


def drafts_per_crawler(crawlers: DataFrame, versions: DataFrame) -> DataFrame:
    """Crawlers with more than one active draft, and pointers to versions that are missing or another crawler's."""
    v = versions.select(F.col("id").alias("__v"), F.col("crawler_id").alias("__c"), F.col("state").alias("__s"))
    out = None
    for column, state in (("active_draft_version_id", "DRAFT"), ("active_published_version_id", "PUBLISHED")):
        bad = crawlers.where(F.col(column).isNotNull()).join(v, (F.col(column) == F.col("__v")) & (F.col("id") == F.col("__c")) & (F.col("__s") == state), "left_anti")
        one = bad.select(*violation("ERROR", "NOT_FOUND", F.col("id"), F.lit(f"{column} points nowhere")))
        out = one if out is None else out.unionByName(one)
    return out


def event_id(event: str, version: Column, at: Column) -> Column:
    """Ids that repeat with their event, so a second append is found out."""
    return {DRAFT_ACTIVATED: F.concat_ws(":", F.lit("draft-activate"), version, at), PUBLISHED: F.concat_ws(":", F.lit("publish"), version), REACTIVATED: F.concat_ws(":", F.lit("reactivate"), version, at), RUN_CREATED: F.concat_ws(":", F.lit("run"), version)}[event]


def repeated_events(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming audit rows whose id is in the log, or comes twice."""
    twice = incoming.groupBy("id").count().where("count > 1").select("id")
    known = incoming.join(log.select(F.col("id").alias("__i")), F.col("id") == F.col("__i"), "left_semi").select("id")
    return twice.unionByName(known).distinct().select(*violation("ERROR", "CONFLICT", F.col("id"), F.lit("the event is in the log")))


def pointers(log: DataFrame) -> DataFrame:
    """(crawler_id, active_draft_version_id, active_published_version_id) from the log (crawler_id, version_id, event_type, occurred_at, id).

    The last publication or reactivation gives the published version; the last activated draft is active unless that very
    version was published or reactivated later.
    """
    at = F.struct("occurred_at", "id")
    live = F.col("event_type").isin(PUBLISHED, REACTIVATED)
    # first by version, so that no row holds a crawler's whole history
    each = log.groupBy("crawler_id", "version_id").agg(F.max(F.when(live, at)).alias("live"), F.max(F.when(~live, at)).alias("drafted"))
    draft = F.struct("version_id", (F.col("live") > F.col("drafted")).alias("over"))
    out = each.groupBy("crawler_id").agg(F.max_by("version_id", "live").alias("published"), F.max_by(draft, "drafted").alias("draft"))
    return out.select("crawler_id", F.when(~F.coalesce("draft.over", F.lit(False)), F.col("draft.version_id")).alias("active_draft_version_id"), F.col("published").alias("active_published_version_id"))


def publish(crawlers: DataFrame, version: Column | str) -> DataFrame:
    """Crawlers after this version of theirs is published: published pointer set, draft pointer cleared if it was the same."""
    v = version if isinstance(version, Column) else F.lit(version)
    return crawlers.withColumns({"active_draft_version_id": F.nullif("active_draft_version_id", v), "active_published_version_id": v})


def clone(versions: DataFrame, new_id: Column) -> DataFrame:
    """Drafts with the content of published versions."""
    return versions.where("state = 'PUBLISHED'").withColumns({"id": new_id, "state": F.lit("DRAFT")})


def draft_from_scrape(runs: DataFrame, crawler_id: Column, version_id: Column) -> DataFrame:
    """Draft versions with the configuration of quick scrapes that ended with a result; other runs give none."""
    ok = runs.where(F.col("run_type") == "QUICK_SCRAPE").where(F.col("status").isin("COMPLETED", "PARTIAL_RESULT"))
    return ok.select(version_id.alias("id"), crawler_id.alias("crawler_id"), F.lit("DRAFT").alias("state"), F.col("configuration_json").alias("semantic_configuration_json"), F.col("run_id").alias("from_run_id"))


def audit_counts(log: DataFrame, entity: str = "entity_id") -> DataFrame:
    return log.groupBy(entity).agg(F.count("*").alias("events"))


def migration_checksum(sql: Column) -> Column:
    """SHA-256 of the SQL text as a JSON string."""
    quoted = F.to_json(F.struct(sql.alias("x")))
    body = F.substring(quoted, 6, 1 << 30)
    return F.sha2(F.substring(body, F.lit(1), F.length(body) - 1), 256)


def migration_plan(known: list[tuple[str, str, str]], applied: DataFrame, last: str | None = None) -> DataFrame:
    """(version, name, sql, checksum, state) for each known migration up to last: APPLIED, PENDING or CHECKSUM_MISMATCH; UNSUPPORTED for those applied but not known."""
    if any(a[0] >= b[0] for a, b in zip(known, known[1:], strict=False)):
        raise ValueError("migrations are not in ascending order")
    spark = applied.sparkSession
    rows = spark.createDataFrame(known, "version string, name string, sql string").withColumn("checksum", migration_checksum(F.col("sql")))
    if last is not None:
        rows = rows.where(F.col("version") <= last)
    a = applied.select(F.col("version").alias("__v"), F.col("checksum").alias("__c"))
    state = F.when(F.col("__v").isNull(), "PENDING").when(F.col("checksum") == F.col("__c"), "APPLIED").otherwise("CHECKSUM_MISMATCH")
    out = rows.join(a, F.col("version") == F.col("__v"), "left").select("version", "name", "sql", "checksum", state.alias("state"))
    ids = [k[0] for k in known]
    strange = applied.where(~F.col("version").isin(ids)).select("version", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("sql"), "checksum", F.lit("UNSUPPORTED").alias("state"))
    return out.unionByName(strange)


def lifecycle(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """rows (id, status, trashed_at) after actions (id, action, at, confirmation), of which the last of each row counts.

    ARCHIVE and TRASH take a row out of view, RESTORE brings it back; DELETE needs the row to be in the trash and its id as
    confirmation. Deleted rows stay as evidence (status DELETED), and no action changes them.
    """
    last = actions.groupBy(F.col("id").alias("__i")).agg(F.max(F.struct("at", "action", "confirmation")).alias("__a"))
    a, status = F.col("__a.action"), F.col("status")
    may_delete = (status == "TRASHED") & (F.col("__a.confirmation") == F.col("id").cast("string"))
    new = F.when(a == "ARCHIVE", "ARCHIVED").when(a == "TRASH", "TRASHED").when(a == "RESTORE", "ACTIVE").when((a == "DELETE") & may_delete, "DELETED").otherwise(status)
    out = rows.join(last, F.col("id") == F.col("__i"), "left").withColumn("__new", F.when(F.col("__i").isNull() | (status == "DELETED"), status).otherwise(new))
    since = F.when(F.col("__new").isin("TRASHED", "DELETED"), F.when(status.isin("TRASHED", "DELETED"), F.col("trashed_at")).otherwise(F.col("__a.at")))
    return out.withColumns({"trashed_at": since, "status": F.col("__new")}).select(*rows.columns)


def disabled_jobs(jobs: DataFrame, rows: DataFrame, column: str = "crawler_id") -> DataFrame:
    """Jobs that are not over and whose owner is in the trash or gone."""
    gone = rows.where(F.col("status").isin("TRASHED", "DELETED")).select(F.col("id").alias("__i"))
    return jobs.where(F.col("state").isin("QUEUED", "RUNNING")).join(gone, F.col(column) == F.col("__i"), "left_semi")


def trash(rows: DataFrame, now: Column, days: int = 30, status: str = "status", since: str = "trashed_at") -> DataFrame:
    """rows with ``expired``: in the trash for longer than days."""
    return rows.withColumn("expired", (F.col(status) == "TRASHED") & (F.datediff(now, F.col(since)) > days))
