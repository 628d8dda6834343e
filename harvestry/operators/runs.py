"""Runs beside each other: comparison, progress, pacing, queue, retention, overviews and integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compare(metrics: DataFrame, left: str, right: str, run: str = "run_id", metric: str = "metric", value: str = "value") -> DataFrame:
    """(metric, left_value, right_value, delta) of two runs; a metric that one lacks counts as 0 in delta."""
    pick = lambda r: F.sum(F.when(F.col(run) == r, F.col(value)))
    out = metrics.where(F.col(run).isin(left, right)).groupBy(metric).agg(pick(left).alias("left_value"), pick(right).alias("right_value"))
    return out.withColumn("delta", F.coalesce("right_value", F.lit(0)) - F.coalesce("left_value", F.lit(0)))


def compare_classification(left: DataFrame, right: DataFrame, url: str = "url") -> DataFrame:
    """(url, left_type, right_type, change) for what two versions make of the same URLs."""
    r = right.select(F.col(url).alias("__u"), F.col("page_type_id").alias("right_type"), F.lit(True).alias("__r"))
    j = left.select(F.col(url), F.col("page_type_id").alias("left_type"), F.lit(True).alias("__l")).join(r, F.col(url) == F.col("__u"), "full_outer")
    change = F.when(F.col("__l").isNull(), "ONLY_RIGHT").when(F.col("__r").isNull(), "ONLY_LEFT").when(F.col("left_type").eqNullSafe(F.col("right_type")), "SAME").otherwise("CHANGED")
    return j.select(F.coalesce(url, "__u").alias(url), "left_type", "right_type", change.alias("change"))


def retry_after_ms(header: Column, now: Column) -> Column:
    """Milliseconds that a Retry-After header asks to wait, as seconds or as an HTTP date; 0 for a date that is over, null for anything else."""
    text = F.trim(header)
    at = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), "GMT$", "+0000"), F.lit("dd MMM yyyy HH:mm:ss xx"))
    later = F.greatest(F.unix_millis(at) - F.unix_millis(now.cast("timestamp")), F.lit(0).cast("long"))
    return F.when(text.rlike(r"^[0-9]{1,9}\z"), text.try_cast("long") * 1000).when(text.rlike(r"GMT\z") & at.isNotNull(), later)


def backoff_ms(attempt: Column, base: int = 1000, most: int = 300_000) -> Column:
    """The wait after a failed attempt (from 1) without a Retry-After: doubled each time, up to a most."""
    return F.least(F.lit(base) * F.pow(F.lit(2), F.least(attempt, F.lit(30)) - 1), F.lit(most)).cast("long")


def pacing(urls_: DataFrame, delay_ms: Column | int, host: str = "host", order: tuple[str, ...] = ("url",), bucket_rows: int | None = None, wait_ms: Column | None = None) -> DataFrame:
    """urls_ with earliest_ms: when each request of a host may start, one delay after the one before.

    wait_ms is what the answer to a request asked to wait (retry_after_ms, backoff_ms; null for nothing); the next request of
    the host comes after the longer of the two. Sums within a host are made by buckets of a hash of the order columns with the
    sums of the buckets before, so a host with a third of all URLs is many tasks. delay_ms may be a column.
    """
    buckets = bucket_rows or 64
    delay = F.lit(delay_ms) if isinstance(delay_ms, int) else delay_ms
    gap = delay if wait_ms is None else F.greatest(delay, wait_ms)
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in order])
    d = urls_.withColumns({"__b": F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int") % buckets, "__gap": gap.cast("long")})
    counts = d.groupBy(F.col(host).alias("__h"), F.col("__b").alias("__c")).agg(F.sum("__gap").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__h").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("__h", "__c", before.alias("__base"))
    place = F.coalesce(F.sum("__gap").over(Window.partitionBy(host, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = d.withColumn("__i", place).join(bases, F.col(host).eqNullSafe(F.col("__h")) & (F.col("__b") == F.col("__c")))
    return out.withColumn("earliest_ms", (F.col("__i") + F.col("__base")).cast("long")).drop("__b", "__gap", "__h", "__c", "__base", "__i")


def sequence(events: DataFrame, stream: str, order: tuple[str, ...]) -> DataFrame:
    """events with seq: 1, 2, 3, ... within a stream by a total order."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(stream).orderBy(*order)).cast("long"))


def replay(log: DataFrame, last: int, seq: str = "seq", id_: str = "event_id") -> DataFrame:
    """Events after the last one seen, each once."""
    return log.where(F.col(seq) > last).dropDuplicates([id_])


def terminal(log: DataFrame, stream: str, kind: str, seq: str, kinds: tuple[str, ...]) -> DataFrame:
    """(stream, last_kind, events, is_terminal)."""
    out = log.groupBy(stream).agg(F.max_by(kind, seq).alias("last_kind"), F.count("*").alias("events"))
    return out.withColumn("is_terminal", F.col("last_kind").isin(*kinds))


def durations(log: DataFrame, stream: str, ts: str) -> DataFrame:
    return log.groupBy(stream).agg(F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), (F.unix_seconds(F.max(ts).cast("timestamp")) - F.unix_seconds(F.min(ts).cast("timestamp"))).alias("seconds"))


def stale(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease is over."""
    return jobs.where((F.col("state") == "RUNNING") & (F.col("lease_expires_at") < now))


def acquire(jobs: DataFrame, claims: DataFrame, now: Column, seconds: int = 60) -> DataFrame:
    """jobs after the claims (job_id, worker) on them: a queued job that is due runs with a lease of its first claimant.

    Of several claims on one job the one with the smallest worker counts. Jobs that run, are done or are not due stay as they are.
    """
    c = claims.groupBy(F.col("job_id").alias("__j")).agg(F.min("worker").alias("__w"))
    free = F.col("__w").isNotNull() & (F.col("state") == "QUEUED") & (F.col("scheduled_at") <= now)
    got = F.coalesce(free, F.lit(False))
    new = {"state": F.lit("RUNNING"), "lease_owner": F.col("__w"), "heartbeat_at": now, "lease_expires_at": now + F.expr(f"interval {seconds} seconds"), "attempts": F.col("attempts") + 1}
    return jobs.join(c, F.col("job_id") == F.col("__j"), "left").withColumns({n: F.when(got, v).otherwise(F.col(n)) for n, v in new.items()}).select(*jobs.columns)


def heartbeat(jobs: DataFrame, beats: DataFrame, seconds: int = 60) -> DataFrame:
    """jobs after heartbeats (job_id, worker, at): a lease goes on from the last beat of its owner.

    Beats of other workers and beats after the end of the lease as it was change nothing.
    """
    mine = (F.col("job_id") == F.col("__j")) & (F.col("lease_owner") == F.col("__w"))
    held = jobs.where("state = 'RUNNING'").select("job_id", "lease_owner", "lease_expires_at")
    ok = beats.select(F.col("job_id").alias("__j"), F.col("worker").alias("__w"), F.col("at").alias("__at"))
    last = held.join(ok, mine).where("__at <= lease_expires_at").groupBy(F.col("job_id").alias("__k")).agg(F.max("__at").alias("__last"))
    later = F.col("__last") > F.col("heartbeat_at")
    new = {"heartbeat_at": F.col("__last"), "lease_expires_at": F.col("__last") + F.expr(f"interval {seconds} seconds")}
    return jobs.join(last, F.col("job_id") == F.col("__k"), "left").withColumns({n: F.when(later, v).otherwise(F.col(n)) for n, v in new.items()}).select(*jobs.columns)


def recover(jobs: DataFrame, checkpoints: DataFrame, now: Column) -> DataFrame:
    """(job_id, outcome) of stale jobs: RECOVERABLE with a checkpoint (job_id, config_hash) of their configuration, else FAILED."""
    c = checkpoints.select(F.col("job_id").alias("__j"), F.col("config_hash").alias("__h")).distinct()
    found = stale(jobs, now).join(c, (F.col("job_id") == F.col("__j")) & (F.col("config_hash") == F.col("__h")), "left")
    return found.select("job_id", F.when(F.col("__j").isNotNull(), "RECOVERABLE").otherwise("FAILED").alias("outcome"))


def cancel(units: DataFrame, runs_: DataFrame) -> DataFrame:
    """units (run_id, unit_id, state) of runs (run_id, cancelled_at) after these were cancelled.

    Units that wait are never begun; those at work end at their own boundary, of which only their result tells; those that
    ended stay. Runs without a time were not cancelled.
    """
    c = runs_.where(F.col("cancelled_at").isNotNull()).select(F.col("run_id").alias("__r")).distinct()
    over = F.when(F.col("state") == "PENDING", "NOT_STARTED").when(F.col("state") == "RUNNING", "STOPPING").otherwise(F.col("state"))
    return units.join(c, F.col("run_id") == F.col("__r"), "left").withColumn("state", F.when(F.col("__r").isNotNull(), over).otherwise(F.col("state"))).drop("__r")


def checkpoint(units: DataFrame) -> DataFrame:
    """(run_id, completed, pending, failed, status): what a run's checkpoint counts; CANCELLED once no unit of a stopped run is at work."""
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    left, working = n("NOT_STARTED", "PENDING"), n("STOPPING", "RUNNING")
    status = F.when(n("STOPPING") > 0, "CANCELLING").when(n("NOT_STARTED") > 0, "CANCELLED").when(left + working > 0, "RUNNING").when(n("FAILED") > 0, "PARTIAL_RESULT").otherwise("COMPLETED")
    return units.groupBy("run_id").agg(n("COMPLETED").alias("completed"), (left + working).alias("pending"), n("FAILED").alias("failed"), status.alias("status"))


def retries(attempts: DataFrame, most: int) -> DataFrame:
    """(job_id, attempts, last_error, may_retry)."""
    out = attempts.groupBy("job_id").agg(F.max("attempt").alias("attempts"), F.max_by("error", "attempt").alias("last_error"))
    return out.withColumn("may_retry", F.col("last_error").isNotNull() & (F.col("attempts") < most))


def queue(jobs: DataFrame, n: int) -> DataFrame:
    """The next n queued jobs: by priority, then time, then id."""
    return jobs.where("state = 'QUEUED'").orderBy(F.desc("priority"), "scheduled_at", "job_id").limit(n)


def moved(jobs: DataFrame, job_id: str, up: bool) -> DataFrame:
    """jobs with one job's priority just beyond that of its neighbour."""
    edge = jobs.where(F.col("job_id") != job_id).agg(F.max("priority") if up else F.min("priority")).first()[0]
    return jobs if edge is None else jobs.withColumn("priority", F.when(F.col("job_id") == job_id, F.lit(edge + (1 if up else -1))).otherwise(F.col("priority")))


def counts_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"))


def retention(runs: DataFrame, keep: int, by: str, order: tuple, days: int | None = None, now: Column | None = None, at: str = "created_at") -> DataFrame:
    """runs with ``retained``: the latest keep of each group, or younger than days."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    young = F.datediff(now, F.col(at)) <= days if days is not None else F.lit(False)
    return runs.withColumn("retained", (rank <= keep) | young)


def retention_preview(rows: DataFrame, category: str, size: str) -> DataFrame:
    """(category, retained, rows, bytes): what would stay and what would go."""
    return rows.groupBy(category, "retained").agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))


def disk_pressure(artifacts: DataFrame, budget: int, warn: float = 0.8, critical: float = 0.95) -> DataFrame:
    """One row: bytes, share and state OK, WARNING or STORAGE_CRITICAL."""
    share = F.coalesce(F.sum("byte_size"), F.lit(0)) / F.lit(budget)
    return artifacts.agg(F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"), share.alias("share"), F.when(share >= critical, "STORAGE_CRITICAL").when(share >= warn, "WARNING").otherwise("OK").alias("state"))


def references(entity_id: str, **tables: tuple[DataFrame, str]) -> DataFrame:
    """(table, rows) that name an entity, before it goes for good."""
    each = [df.where(F.col(c) == entity_id).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, (df, c) in sorted(tables.items())]
    return reduce(DataFrame.unionByName, each)


def search(text: str, **tables: tuple[DataFrame, str, str]) -> DataFrame:
    """(kind, id, name) of entities whose name holds the text, whatever its case."""
    each = [df.where(F.lower(F.col(name)).contains(text.lower())).select(F.lit(kind).alias("kind"), F.col(id_).cast("string").alias("id"), F.col(name).alias("name")) for kind, (df, id_, name) in sorted(tables.items())]
    return reduce(DataFrame.unionByName, each)


def activity(items: DataFrame, n: int) -> DataFrame:
    """The n items to look at first: failed and partial ones, then drafts, then the rest, the latest first."""
    rank = F.when(F.col("status").isin("FAILED", "PARTIAL_RESULT"), 0).when(F.col("status") == "DRAFT", 1).otherwise(2)
    return items.orderBy(rank, F.desc("at"), "id").limit(n)


def overview(crawlers: DataFrame, versions: DataFrame, runs: DataFrame) -> DataFrame:
    """(crawler_id, versions, drafts, runs, last_run_status) of each crawler."""
    v = versions.groupBy(F.col("crawler_id").alias("__v")).agg(F.count("*").alias("versions"), F.count_if(F.col("state") == "DRAFT").alias("drafts"))
    r = runs.groupBy(F.col("crawler_id").alias("__r")).agg(F.count("*").alias("runs"), F.max_by("status", F.struct("created_at", "run_id")).alias("last_run_status"))
    j = crawlers.join(v, F.col("id") == F.col("__v"), "left").join(r, F.col("id") == F.col("__r"), "left")
    return j.select(F.col("id").alias("crawler_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("versions", "drafts", "runs")], "last_run_status")


def integrity(*checks: DataFrame) -> DataFrame:
    """All violations of several checks (severity, code, entity_id, message)."""
    return reduce(DataFrame.unionByName, checks)


def publish_gate(facts: DataFrame) -> DataFrame:
    """facts (crawler_version_id, check, ok) as violations; checks that only warn are warnings."""
    warn = ("tested", "coverage", "matcher_breadth", "growth")
    severity = F.when(F.col("check").isin(*warn), "WARNING").otherwise("ERROR")
    return facts.where(~F.coalesce("ok", F.lit(False))).select(severity.alias("severity"), F.lit("VALIDATION_ERROR").alias("code"), F.col("crawler_version_id").alias("entity_id"), F.concat(F.lit("failed: "), "check").alias("message"))


def overlay(statuses: DataFrame, transitions: DataFrame) -> DataFrame:
    """(kind, id, links, enqueued) of a run for each page type and each transition of a graph, those without links too."""
    count = [F.count("*").alias("links"), F.count_if(F.col("status") == "ENQUEUED").alias("enqueued")]
    nodes = statuses.where("target_page_type is not null").groupBy(F.col("target_page_type").alias("id")).agg(*count).select(F.lit("PAGE_TYPE").alias("kind"), "id", "links", "enqueued")
    used = statuses.where("transition_id is not null").groupBy(F.col("transition_id").alias("__t")).agg(*count)
    edges = transitions.join(used, F.col("id") == F.col("__t"), "left").select(F.lit("TRANSITION").alias("kind"), "id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("enqueued", F.lit(0)).alias("enqueued"))
    return nodes.unionByName(edges)


def with_previous(runs_: DataFrame, by: str, order: tuple[str, ...], *columns: str) -> DataFrame:
    """runs_ with previous_<column> of the run before of the same group."""
    w = Window.partitionBy(by).orderBy(*order)
    return runs_.withColumns({f"previous_{c}": F.lag(c).over(w) for c in columns})


def review_grid(items: DataFrame, states: tuple[str, ...], order: tuple, limit: int) -> DataFrame:
    """One page of a review: the items in these states by a total order."""
    return items.where(F.col("state").isin(*states)).orderBy(*order).limit(limit)


def log_filter(log: DataFrame, **equal: str) -> DataFrame:
    """Log rows that have all of these values."""
    for column, value in equal.items():
        log = log.where(F.col(column) == value)
    return log


def seeds(rows: DataFrame, chosen: tuple | None = None) -> DataFrame:
    """Enabled seeds, all or the chosen ones."""
    out = rows.where("enabled")
    return out if chosen is None else out.where(F.col("id").isin(*chosen))


def orphans(rows: DataFrame, column: str, target: DataFrame, target_column: str) -> DataFrame:
    """Violations of a foreign key; nulls are none."""
    t = target.select(F.col(target_column).alias("__t"))
    bad = rows.where(F.col(column).isNotNull()).join(t, F.col(column) == F.col("__t"), "left_anti")
    return bad.select(F.lit("ERROR").alias("severity"), F.lit("NOT_FOUND").alias("code"), F.col(column).cast("string").alias("entity_id"), F.lit(f"{column} has no target").alias("message"))
