import hashlib
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from harvestry.functions.matching import Matcher, PageType
from harvestry.operators import curation, discovery, extraction, runs, settings, snapshots, versioning
from harvestry.operators.curation import Field
from harvestry.sources import artifacts, exports, tables

SITE = [PageType("list", "List", 0, (Matcher("PathPrefix", "/list"),)), PageType("item", "Item", 0, (Matcher("PathGlob", "/item/*"),)), PageType("x1", "X1", 0, (Matcher("PathPrefix", "/tie"),)), PageType("x2", "X2", 0, (Matcher("PathPrefix", "/tie"),))]
STEPS = [discovery.Transition("t", "list", "item", max_links_per_page=2, total_budget=3)]
SCOPE = discovery.Scope("registrable", ("a.test",), ("bad.a.test",))


def test_every_link_has_the_status_of_its_first_stage(spark):
    hrefs = ["/item/1", "/item/1?utm_source=x", "javascript:x()", "http://", "http://other.test/", "http://bad.a.test/item/9", "/nothing", "/tie/1", "/list/2", "/item/2", "/item/3", "/done"]
    found = spark.createDataFrame([("http://a.test/list", i, h) for i, h in enumerate(hrefs)], "source_url string, position int, raw_href string")
    done = spark.createDataFrame([("http://a.test/done",)], "canonical_url string")
    got = {r["position"]: r["status"] for r in discovery.classify_links(found, SITE, STEPS, SCOPE, completed=done).collect()}
    assert [got[i] for i in range(12)] == ["ENQUEUED", "DUPLICATE", "BLOCKED", "INVALID_URL", "EXTERNAL", "BLOCKED", "UNMATCHED", "AMBIGUOUS_PAGE_TYPE", "NO_ELIGIBLE_TRANSITION", "ENQUEUED", "BUDGET_EXCLUDED", "ALREADY_COMPLETED"]


def test_total_budget(spark):
    found = spark.createDataFrame([(f"http://a.test/list{i}", 0, f"/item/{i}") for i in range(10)], "source_url string, position int, raw_href string")
    got = discovery.classify_links(found, SITE, STEPS, SCOPE).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in got} == {"ENQUEUED": 3, "BUDGET_EXCLUDED": 7}
    with pytest.raises(ValueError):
        discovery.Transition("t", "a", "b", max_links_per_page=0)


def test_the_total_budget_takes_sources_by_two_digits_of_their_hash(spark):
    pages = [f"http://a.test/list{i}" for i in range(1200)]
    found = spark.createDataFrame([(u, 0, f"/item/{i}") for i, u in enumerate(pages)], "source_url string, position int, raw_href string")
    steps = [discovery.Transition("t", "list", "item", max_links_per_page=2, total_budget=601)]
    got = {r["source_url"] for r in discovery.classify_links(found, SITE, steps, SCOPE).where("status = 'ENQUEUED'").collect()}
    assert got == set(sorted(pages, key=lambda u: (hashlib.md5(u.encode()).hexdigest()[:2], u))[:601])


def test_of_a_page_that_was_fetched_twice_one_link_is_first(spark):
    rows = [("http://a.test/list", 0, "/item/1", k) for k in (4, 3, 3, 8)]
    found = spark.createDataFrame(rows, "source_url string, position int, raw_href string, page_id int")
    got = [(r["page_id"], r["status"]) for r in discovery.classify_links(found, SITE, STEPS, SCOPE).collect()]
    assert sorted(got) == [(3, "DUPLICATE"), (3, "ENQUEUED"), (4, "DUPLICATE"), (8, "DUPLICATE")]


def test_a_batch_that_skips_rows_is_partially_approved(spark):
    d = curation.issues(spark.createDataFrame([("a", "x"), ("b", " "), ("c", "y")], "key string, name string"), [Field("name", required=True)], "key")
    told = lambda which: tuple(curation.batch_summary(curation.approve_all_valid(d.where(which))).first())
    assert told("key = 'b'") == (0, 0, 1, "PARTIALLY_APPROVED") and told("true") == (2, 0, 1, "PARTIALLY_APPROVED")
    assert told("key <> 'b'") == (2, 0, 0, "APPROVED") and told("false") == (0, 0, 0, "NOTHING_APPROVED")


def test_links_of_a_page(spark):
    page = "<a href='/a'>One <b>x</b></a><!-- <a href=/no> --><script>'<a href=/no>'</script><a name=q>no</a><A HREF=\"/b?x=1&amp;y=2\" rel='nofollow next'>Next</A><a href=/c>3"
    got = discovery.links(spark.createDataFrame([("u", page), ("v", None)], "url string, html string")).collect()
    assert [(r["raw_href"], r["anchor_text"], r["rel_next"]) for r in got] == [("/a", "One x", False), ("/b?x=1&y=2", "Next", True), ("/c", "3", False)]


def test_frontier_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "source_url string, target_url string")
    seeds = spark.createDataFrame([("a",)], "canonical_url string")
    got = {r["canonical_url"]: (r["depth"], r["path"]) for r in discovery.frontier(seeds, edges, 3, 100).collect()}
    assert got == {"a": (0, []), "b": (1, ["a"]), "c": (2, ["a", "b"]), "d": (3, ["a", "b", "c"])}
    assert discovery.frontier(seeds, edges, 9, 2).count() == 2


def test_robots(spark):
    rules, delay = discovery.robots_rules("User-agent: *\nDisallow: /p\nAllow: /p/ok # c\nCrawl-delay: 1.5\nUser-agent: other\nDisallow: /", "me")
    allowed = lambda p: spark.range(1).select(discovery.robots_allows(F.lit(p), rules).alias("x")).first()["x"]
    assert delay == 1.5 and [allowed(p) for p in ("/p/x", "/p/ok/1", "/q")] == [False, True, True]


@pytest.mark.parametrize("n", range(5))
@pytest.mark.parametrize("state", ["CUSTOM", "RESET_TO_BUILT_IN"])
def test_settings(spark, n, state):
    names = [x for x, _ in settings.LAYERS]
    layers = {x: (F.lit(state if i == n else "CUSTOM" if i > n else None), F.lit(11 + i)) for i, x in enumerate(names)}
    r = spark.range(1).select(settings.resolve(layers, F.lit(99)).alias("r")).first()["r"]
    assert tuple(r) == ((11 + n, settings.LAYERS[n][1]) if state == "CUSTOM" else (99, "BUILT_IN_DEFAULT"))


def test_quick_scrape_and_inheritance(spark):
    layers = {"run_profile": (F.lit("CUSTOM"), F.lit(1)), "crawler": (F.lit("CUSTOM"), F.lit(2)), "collection": (F.lit("CUSTOM"), F.lit(44)), "global": (F.lit("CUSTOM"), F.lit(55))}
    pick = lambda x, q: tuple(spark.range(1).select(settings.resolve(x, F.lit(99), q).alias("r")).first()["r"])
    assert pick(layers, True) == (44, "COLLECTION_OVERRIDE") and pick(layers, False) == (1, "RUN_PROFILE") and pick({}, False) == (99, "BUILT_IN_DEFAULT")


RUN = "run_type string, configuration struct<kind:string,crawler_version_id:string,semantic_config_hash:string>, selected_seed_ids array<string>, run_profile_id string, settings struct<user_agent:struct<value:string,source:string>,max_pages:struct<value:bigint,source:string>>, robots struct<decision:struct<decision:string,reason:string>,actor:string,decided_at:string,affected_scope:string,user_agent:string,crawler_version_id:string>, actor string, created_at string"


def run_row(**change):
    row = {
        "run_type": "PRODUCTION_RUN", "configuration": ("crawler_version", "v1", "a" * 64), "selected_seed_ids": ["s1"], "run_profile_id": None, "settings": (("ua", "GLOBAL_SETTING"), (100, "RUN_PROFILE")),
        "robots": (("RESPECT", None), "me", "t", "all", "ua", "v1"), "actor": "me", "created_at": "2024-01-01T00:00:00Z",
    }
    return tuple((row | change).values())


def hashes(spark, *rows):
    return snapshots.hashed(spark.createDataFrame(list(rows), RUN).select(F.struct("*").alias("run"))).collect()


def test_snapshot_hashes(spark):
    same, other_actor, other_setting, other_robot_time = hashes(spark, run_row(), run_row(actor="you"), run_row(settings=(("ua", "GLOBAL_SETTING"), (101, "RUN_PROFILE"))), run_row(robots=(("RESPECT", None), "me", "later", "all", "ua", "v1")))
    assert same["violations"] == [] and same["snapshot_hash"] != other_actor["snapshot_hash"] and same["checkpoint_compatibility_hash"] == other_actor["checkpoint_compatibility_hash"] == other_robot_time["checkpoint_compatibility_hash"]
    assert same["checkpoint_compatibility_hash"] != other_setting["checkpoint_compatibility_hash"]
    told = {"run_type": "PRODUCTION_RUN", "configuration": {"kind": "crawler_version", "crawler_version_id": "v1", "semantic_config_hash": "a" * 64}, "selected_seed_ids": ["s1"], "run_profile_id": None, "settings": {"user_agent": {"value": "ua", "source": "GLOBAL_SETTING"}, "max_pages": {"value": 100, "source": "RUN_PROFILE"}}, "robots": {"decision": {"decision": "RESPECT", "reason": None}, "actor": "me", "decided_at": "t", "affected_scope": "all", "user_agent": "ua", "crawler_version_id": "v1"}, "actor": "me", "created_at": "2024-01-01T00:00:00Z"}
    assert same["snapshot_hash"] == hashlib.sha256(json.dumps(told, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@pytest.mark.parametrize(
    "change",
    [{"actor": " "}, {"created_at": ""}, {"robots": (("RESPECT", None), "me", "t", "all", "other", "v1")}, {"robots": (("OVERRIDE", " "), "me", "t", "all", "ua", "v1")}, {"robots": (("RESPECT", None), "me", "t", "all", "ua", "v2")}, {"run_type": "QUICK_SCRAPE"}, {"configuration": ("quick_scrape", None, None)}, {"configuration": ("crawler_version", "v1", "zz")}],
)
def test_snapshot_violations(spark, change):
    assert hashes(spark, run_row(**change))[0]["violations"]


def test_tampering(spark):
    stored = snapshots.hashed(spark.createDataFrame([run_row(), run_row(actor="x")], RUN).select(F.struct("*").alias("run")))
    stored = stored.drop("violations").withColumn("snapshot_hash", F.when(F.col("run.actor") == "x", "0").otherwise(F.col("snapshot_hash")))
    assert [r["run"]["actor"] for r in snapshots.tampered(stored).collect()] == ["x"]


def test_versions(spark):
    versions = spark.createDataFrame([("p", "c", "PUBLISHED", "{}"), ("d", "c", "DRAFT", "{}"), ("e", "c2", "DRAFT", "{}")], tables.SCHEMAS["crawler_versions"])
    crawlers = tables.in_memory(spark, "crawlers", [("c", "C", None, None, "p", "d"), ("c2", "D", None, None, "d", None)])
    ids = lambda df: sorted(r["entity_id"] for r in df.collect())
    assert ids(versioning.changes_to_published(versions, versions)) == ["p"]
    wanted = spark.createDataFrame([("d", "c", "DRAFT"), ("x", "c", "DRAFT"), ("e", "c2", "DRAFT"), ("p", "c", "PUBLISHED"), ("y", "none", "DRAFT")], "id string, crawler_id string, state string")
    assert ids(versioning.draft_guard(crawlers, wanted)) == ["p", "x", "y"]
    assert ids(versioning.reactivation_guard(versions, spark.createDataFrame([("c", "p"), ("c2", "p"), ("c", "d")], "crawler_id string, version_id string"))) == ["d", "p"]
    assert ids(versioning.drafts_per_crawler(crawlers, versions)) == ["c2"]
    with pytest.raises(ValueError, match="published"):
        tables.append(versions, "/nowhere", versioning.changes_to_published(versions, versions))
    with pytest.raises(ValueError):
        versioning.migration_plan([("2", "a", "x"), ("1", "b", "y")], spark.createDataFrame([], "version string, checksum string"))


def test_pointers(spark):
    log = spark.createDataFrame([("c", "v1", "CRAWLER_DRAFT_ACTIVATED", "1", "a"), ("c", "v1", "CRAWLER_VERSION_PUBLISHED", "2", "b"), ("c", "v2", "CRAWLER_DRAFT_ACTIVATED", "3", "c"), ("d", "w", "CRAWLER_DRAFT_ACTIVATED", "1", "d"), ("d", "w", "CRAWLER_VERSION_PUBLISHED", "2", "e")], "crawler_id string, version_id string, event_type string, occurred_at string, id string")
    assert sorted(map(tuple, versioning.pointers(log).collect())) == [("c", "v2", "v1"), ("d", None, "w")]
    assert [r["entity_id"] for r in versioning.repeated_events(log, log.where("id = 'a'")).collect()] == ["a"]


def test_recrawl_truth_table(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v string, w string")
    old, new, gone = rows(("same", "1", "x"), ("changed", "1", "x"), ("missing", "1", "x"), (None, "1", "x")), rows(("same", "1", " x "), ("changed", "2", "x"), ("new", "1", "x"), ("back", "1", "x"), (None, "1", "x")), spark.createDataFrame([("back",), ("stays gone",)], "k string")
    fields = [Field("v"), Field("w", compare="whitespace")]
    full = {r["k"]: (r["change"], r["changed_fields"], r["diagnostic"]) for r in curation.diff(old, new, ["k"], fields, True, gone).collect()}
    assert full == {"same": ("UNCHANGED", [], False), "changed": ("UPDATED_CANDIDATE", ["v"], False), "missing": ("MISSING_CANDIDATE", [], False), "new": ("NEW_CANDIDATE", [], False), "back": ("RESTORED_CANDIDATE", [], False), None: ("UNCHANGED", [], False)}
    part = {r["k"]: (r["change"], r["diagnostic"]) for r in curation.diff(old, new, ["k"], fields, False, gone).collect()}
    assert "missing" not in part and part["new"] == ("NEW_CANDIDATE", True) and part["same"] == ("UNCHANGED", False)
    assert {r["change"] for r in curation.diff(old, old, ["k"], fields, True).collect()} == {"UNCHANGED"}


def test_merge_keeps_all(spark):
    c = spark.createDataFrame([("1", "f", "a", "x"), ("1", "f", "a", "y"), ("2", "f", "a", "x"), ("2", "f", "b", "y"), ("3", "f", " ", "x"), ("4", "f", "a", "x")], "key string, field string, value string, source string")
    now = spark.createDataFrame([("1", "f", None), ("4", "f", "a")], "key string, field string, value string")
    assert {r["key"]: r["outcome"] for r in curation.merge(c, now).collect()} == {"1": "ENRICHMENT", "2": "FIELD_CONFLICT", "4": "NO_CHANGE"}
    assert curation.preferred(c, ["y", "x"]).count() == 6


def test_issues(spark):
    d = spark.createDataFrame([("a", "long enough", "1"), ("a", "x", "no"), (None, None, None)], "k string, t string, n string")
    got = [sorted((i["severity"][0], i["code"]) for i in r["issues"]) for r in curation.issues(d, [Field("t", required=True, min_length=3), Field("n", "int")], "k").orderBy(F.desc_nulls_last("t")).collect()]
    assert sorted(got) == sorted([[("E", "DUPLICATE_KEY"), ("E", "INVALID_TYPE"), ("W", "SHORT_TEXT")], [("E", "DUPLICATE_KEY")], [("E", "EMPTY_KEY"), ("E", "MISSING_REQUIRED"), ("W", "MISSING_OPTIONAL")]])


def test_extraction(spark):
    pages = spark.createDataFrame([("http://h/a", "<div class=c><h2>A</h2><a href=x>1,5</a></div><div class=c><h2> B  b</h2></div>"), ("http://h/b", None)], "url string, html string")
    fields = [extraction.FieldRule("name", ("h3", "h2")), extraction.FieldRule("link", ("a",), "url:href", "url"), extraction.FieldRule("n", ("a",), type="number", format=", .")]
    got = [tuple(r) for r in extraction.typed(extraction.extract(pages, fields, ".c"), fields).select("url", "record_no", "name", "name_selector", "link", F.col("n").cast("double")).collect()]
    assert got == [("http://h/a", 0, "A", "h2", "http://h/x", 1.5), ("http://h/a", 1, "B b", "h2", None, None)]


def test_records_of_a_url_are_numbered_over_its_pages(spark):
    pages = [("u", 9, "<i>a</i><i>b</i>"), ("u", 3, "<i>c</i>"), ("v", 4, "<i>d</i>"), ("v", 5, None), (None, 6, "<i>e</i>")]
    found = extraction.extract(spark.createDataFrame(pages, "url string, page_id long, html string"), [extraction.FieldRule("t", ("b",), "presence")], "i", page="page_id")
    assert found.columns == ["url", "record_no", "t_raw", "t_selector"]
    assert sorted((r["url"] or "", r["record_no"]) for r in found.collect()) == [("", 0), ("u", 0), ("u", 1), ("u", 2), ("v", 0)]
    html = [("u", k, "".join(f"<li><a href={k}-{i}>" for i in range(3))) for k in (2, 1)]
    found = extraction.extract(spark.createDataFrame(html, "url string, page_id long, html string"), [extraction.FieldRule("h", ("a",), "attr:href")], "li", page="page_id")
    assert [r["h_raw"] for r in found.orderBy("record_no").collect()] == ["1-0", "2-0", "1-1", "2-1", "1-2", "2-2"]


def test_artifacts(spark, tmp_path):
    got = artifacts.measure(spark.createDataFrame([("hello",)], "c string"), "c").first()
    assert got["content_hash"] == hashlib.sha256(b"hello").hexdigest() and got["byte_size"] == 5
    (tmp_path / "f.txt").write_bytes(b"hello")
    assert artifacts.read_files(spark, str(tmp_path)).first()["content_hash"] == got["content_hash"]
    placed = artifacts.place(spark.createDataFrame([("1", "../outside", "a"), ("1", "ok", "CON"), ("1", "ok", "a b")], "id string, folder string, name string"), "id", "folder", "name")
    assert [r["safe_relative_path"] for r in placed.collect()] == [None, None, "ok/1-a_b"]


def test_exports(spark, tmp_path):
    records = spark.createDataFrame([("a", 1, "x\ny", "APPROVED"), ("b", 2, None, "DRAFT"), ("c", 3, '"q"', "APPROVED")], "key string, n int, t string, state string")
    for kind in ("jsonl", "csv", "parquet", "markdown"):
        told = exports.export(records, str(tmp_path / kind), kind)
        assert told["records"] == 2 and told["files"] >= 1
        with pytest.raises(Exception, match="(?i)exist"):
            exports.export(records, str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "jsonl/records")).count() == 2
    exports.write(records, str(tmp_path / "all.json"), "json")
    assert [r["n"] for r in json.loads((tmp_path / "all.json").read_text())] == [1, 2, 3]
    path = str(tmp_path / "x.db")
    assert exports.sqlite_table(records, path, "r") == 3
    with pytest.raises(FileExistsError):
        exports.sqlite_table(records, path, "r")
    assert exports.sqlite_table(records.limit(1), path, "r", replace=True) == 1
    with sqlite3.connect(path) as db:
        assert db.execute("select n, typeof(n) from r").fetchall() == [(1, "integer")]


def test_only_sound_backups_are_restored(spark, tmp_path):
    folder = tmp_path / "b"
    exports.backup({"t": spark.range(5).repartition(2), "empty": spark.range(0)}, str(folder))
    back = exports.restore(spark, str(folder))
    assert sorted(r[0] for r in back["t"].collect()) == [0, 1, 2, 3, 4] and back["empty"].collect() == []
    next(folder.glob("t/*.parquet")).unlink()
    with pytest.raises(ValueError, match="MISSING"):
        exports.restore(spark, str(folder))


def test_backup(spark, tmp_path):
    exports.backup({"t": spark.range(5)}, str(tmp_path / "b"))
    assert exports.verify(spark, str(tmp_path / "b")).count() == 0
    part = next((tmp_path / "b/t").glob("*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    (tmp_path / "b/t" / f".{part.name}.crc").unlink(missing_ok=True)
    assert [r["problem"] for r in exports.verify(spark, str(tmp_path / "b")).collect()] == ["CHANGED"]
    assert all(exports.probe(str(tmp_path)).values())


def test_pasted_urls(spark):
    got = tables.pasted(spark, "http://a/\n\nnonsense\n https://b/x#y ").orderBy("position").collect()
    assert [(r["accepted"], r["canonical_url"]) for r in got] == [(True, "http://a/"), (False, None), (True, "https://b/x")]


def test_lookup(spark):
    assert tables.lookup(spark.range(3), "id", 9).isEmpty()
    with pytest.raises(tables.NotFound):
        tables.lookup(spark.range(3), "id", 9, required=True)


def test_runs(spark):
    m = spark.createDataFrame([("a", "pages", 3), ("b", "pages", 5), ("b", "errors", 1)], "run_id string, metric string, value int")
    assert sorted(map(tuple, runs.compare(m, "a", "b").collect())) == [("errors", None, 1, 1), ("pages", 3, 5, 2)]
    paced = runs.pacing(spark.createDataFrame([("h", f"u{i}") for i in range(50)] + [("g", "z")], "host string, url string"), 100)
    assert sorted(r["earliest_ms"] for r in paced.where("host = 'h'").collect()) == [100 * i for i in range(50)]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    from harvestry.streaming import progress

    def put(name, rows):
        spark.createDataFrame(rows, "stream_id string, event_id string, kind string, ts string, payload string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in" / name))

    args = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    put("1", [("s", "b", "x", "2024-01-01 00:00:02", ""), ("s", "a", "x", "2024-01-01 00:00:01", ""), ("s", "a", "x", "2024-01-01 00:00:01", ""), ("r", "c", "x", "2024-01-01 00:00:01", "")])
    progress.log(progress.numbered(progress.once(progress.read(spark, str(tmp_path / "in/*"), progress.EVENT))), *args)
    put("2", [("s", "d", "x", "2024-01-01 00:00:03", "")])
    progress.log(progress.numbered(progress.once(progress.read(spark, str(tmp_path / "in/*"), progress.EVENT))), *args)
    got = sorted((r["stream_id"], r["seq"], r["event_id"]) for r in spark.read.parquet(args[0]).collect())
    assert got == [("r", 1, "c"), ("s", 1, "a"), ("s", 2, "b"), ("s", 3, "d")]


def test_leases_and_cancellation_with_nulls_and_ties(spark):
    now = F.lit("2020-01-01 00:00:00").cast("timestamp")
    jobs = spark.createDataFrame(
        [("a", "QUEUED", "2019-12-31", None, None, None, 0), ("b", "QUEUED", "2020-01-02", None, None, None, 0), (None, "QUEUED", None, None, None, None, 0), ("d", "RUNNING", "2019-01-01", "w", "2019-12-31 23:59:30", "2020-01-01 00:00:30", 1)],
        "job_id string, state string, scheduled_at string, lease_owner string, heartbeat_at string, lease_expires_at string, attempts int",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("scheduled_at", "heartbeat_at", "lease_expires_at")})
    claims = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x"), ("b", "x"), ("d", "x"), (None, "x"), ("zz", "x")], "job_id string, worker string")
    got = {r["job_id"]: r for r in runs.acquire(jobs, claims, now, 60).collect()}
    assert len(got) == 4 and (got["a"]["lease_owner"], got["a"]["attempts"], got["b"]["state"], got["d"]["lease_owner"], got[None]["state"]) == ("x", 1, "QUEUED", "w", "QUEUED")
    beats = spark.createDataFrame([("d", "w", "2020-01-01 00:00:10"), ("d", "w", "2020-01-01 00:00:31"), ("d", "x", "2020-01-01 00:00:20"), (None, "w", None)], "job_id string, worker string, at string").withColumn("at", F.col("at").cast("timestamp"))
    after = {r["job_id"]: r for r in runs.heartbeat(jobs, beats, 60).collect()}
    assert len(after) == 4 and after["d"]["heartbeat_at"].second == 10 and after["d"]["lease_expires_at"].minute == 1 and after["a"]["heartbeat_at"] is None
    units = spark.createDataFrame([("r", 1, "COMPLETED"), ("r", 2, "RUNNING"), ("r", 3, "PENDING"), ("s", 1, "PENDING"), (None, 1, "PENDING")], "run_id string, unit_id int, state string")
    stop = spark.createDataFrame([("r", "now"), ("r", "again"), ("s", None), (None, "now")], "run_id string, cancelled_at string")
    units = runs.cancel(units, stop)
    assert sorted(r["state"] for r in units.collect()) == ["COMPLETED", "NOT_STARTED", "PENDING", "PENDING", "STOPPING"]
    assert {r["run_id"]: r["status"] for r in runs.checkpoint(units).collect()} == {"r": "CANCELLING", "s": "RUNNING", None: "RUNNING"}
    assert runs.acquire(jobs.limit(0), claims, now).count() == 0 and runs.checkpoint(units.limit(0)).count() == 0


def test_waits_that_servers_ask_for(spark):
    now = F.lit("2020-01-01 00:00:00").cast("timestamp")
    d = spark.createDataFrame([(" 7 ",), ("Wed, 01 Jan 2020 00:00:05 GMT",), ("Tue, 31 Dec 2019 23:00:00 GMT",), ("-3",), ("x GMT",), ("",), (None,)], "h string")
    assert [r[0] for r in d.select(runs.retry_after_ms(F.col("h"), now)).collect()] == [7000, 5000, 0, None, None, None, None]
    waits = spark.range(1, 41).select(runs.backoff_ms(F.col("id"))).collect()
    assert [w[0] for w in waits[:4]] == [1000, 2000, 4000, 8000] and waits[-1][0] == 300_000


def test_life_cycle_keeps_evidence(spark):
    rows = spark.createDataFrame([("a", "ACTIVE", None), ("b", "TRASHED", "2020-01-01"), ("c", "TRASHED", "2020-01-01"), ("d", "DELETED", "2020-01-01"), ("e", "ACTIVE", None)], "id string, status string, trashed_at string")
    actions = spark.createDataFrame([("a", "TRASH", "2020-02-01", None), ("b", "DELETE", "2020-02-01", "b"), ("c", "DELETE", "2020-02-01", "C"), ("d", "RESTORE", "2020-02-01", None), ("e", "DELETE", "2020-02-01", "e")], "id string, action string, at string, confirmation string")
    out = {r["id"]: (r["status"], r["trashed_at"]) for r in versioning.lifecycle(rows, actions).collect()}
    assert out == {"a": ("TRASHED", "2020-02-01"), "b": ("DELETED", "2020-01-01"), "c": ("TRASHED", "2020-01-01"), "d": ("DELETED", "2020-01-01"), "e": ("ACTIVE", None)}


def test_reserved_names(spark):
    from harvestry.sources import artifacts

    d = spark.createDataFrame([("1", 1, "f", "n.html"), ("1", 2, "f", "n.html"), ("1", 2, "f", "n.html"), ("2", 3, "f/g", "m"), ("3", 4, "/", "m"), ("4", 5, None, None)], "id string, row int, folder string, name string")
    placed = artifacts.place(d, "id", "folder", "name")
    taken = spark.createDataFrame([("f/g/2-m",), (None,)], "safe_relative_path string")
    out = artifacts.reserve(placed, "id", taken).collect()
    paths = [r["safe_relative_path"] for r in out]
    assert len(out) == 5 and paths.count(None) == 2 and len(set(paths)) == 4 and "f/1-n.html" in paths and "f/g/2-m" not in paths
    assert all(r["safe_relative_path"] is None or r["safe_relative_path"].split("/")[-1].startswith(r["id"] + "-") for r in out)
    assert paths == [r["safe_relative_path"] for r in artifacts.reserve(placed, "id", taken).collect()] or sorted(map(str, paths)) == sorted(str(r["safe_relative_path"]) for r in artifacts.reserve(placed, "id", taken).collect())
    with pytest.raises(FileExistsError):
        artifacts.reserve(placed, "id", taken, tries=1)
    assert artifacts.reserve(placed.limit(0), "id").count() == 0


def test_issues_of_identity_references_and_data_sets(spark):
    d = spark.createDataFrame([(1, "x", 5), (1, "y", 5), (2, "z", 6), (2, "z", None), (None, "q", 7)], "key int, name string, ref int")
    target = spark.createDataFrame([(5,), (5,), (None,)], "id int")
    out = curation.issues(d, [], "key", ("name",), {"ref": (target, "id")}).collect()
    assert sorted((str(r["key"]), r["name"], tuple(sorted(i["code"] for i in r["issues"]))) for r in out) == [
        ("1", "x", ("DUPLICATE_KEY", "IDENTITY_CONFLICT")), ("1", "y", ("DUPLICATE_KEY", "IDENTITY_CONFLICT")), ("2", "z", ("DUPLICATE_KEY",)), ("2", "z", ("DUPLICATE_KEY", "UNRESOLVED_REFERENCE")),
        ("None", "q", ("EMPTY_KEY", "UNRESOLVED_REFERENCE")),
    ]
    assert curation.dataset_issues(d.limit(0), ("name", "ref")).count() == 0
    empty = spark.createDataFrame([(None, " ")] * 3, "a string, b string")
    assert sorted((r["code"], r["field"], r["share"]) for r in curation.dataset_issues(empty, ("a", "b")).collect()) == [("LOW_COVERAGE", "a", 0.0), ("LOW_COVERAGE", "b", 0.0)]
