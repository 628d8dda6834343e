"""All queries for the curation operators by name, each with the SQL that it must agree with.

Rules, scopes and budgets for the synthetic tables are here; the operators know none of them. SQL texts are DuckDB's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harvestry.functions import checks, ids, urls
from harvestry.functions.matching import Matcher, PageType, classify
from harvestry.operators import curation, discovery, extraction, provenance, runs, settings, snapshots, versioning
from harvestry.operators.curation import Field
from harvestry.session import ship, table
from harvestry.sources import artifacts, exports, staging, tables

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _FOUND[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Query]:
    return {name: (lambda spark, sf_dir, f=f: f(ship(spark), sf_dir)) for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}


# --- URLs

PAGE_TYPES = [
    PageType("list", "Listing", 1, (Matcher("Regex", "[?&]page=[0-9]+"),)),
    PageType("article", "Article", 0, (Matcher("PathGlob", "/*.html"), Matcher("Regex", "^https?://[^/]+/[a-z][a-z]/[0-9]+"))),
    PageType("english", "English", 0, (Matcher("PathPrefix", "/en/"),)),
    PageType("blog", "Blog", 2, (Matcher("Regex", "^https?://blog[.]"),)),
]
#: Canonical URL in SQL: no fragment, no tracking, sorted parameters, no trailing slash.
CANONICAL = """
parsed as (
  select *, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) as scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) as host,
    coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]+(/[^?#]*)', 1), ''), '/') as path, regexp_extract(url, '[?]([^#]*)', 1) as q from pages
), canon as (
  select *, scheme || '://' || host || case when length(path) > 1 then regexp_replace(path, '/$', '') else path end
    || case when kept = '' then '' else '?' || kept end as canonical_url
  from (select *, coalesce(list_aggregate(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' and not regexp_matches(lower(x), '^(utm_[^=]*|fbclid|gclid)(=|$)'))), 'string_agg', '&'), '') as kept from parsed)
)"""
RESOLVED = """
scored as (
  select *, regexp_matches(canonical_url, '[?&]page=[0-9]+') as is_list, regexp_matches(regexp_extract(canonical_url, '^[a-z]+://[^/]+([^?]*)', 1), '^/.*[.]html$') as is_html,
    regexp_matches(canonical_url, '^https?://[^/]+/[a-z][a-z]/[0-9]+') as is_article, starts_with(regexp_extract(canonical_url, '^[a-z]+://[^/]+([^?]*)', 1), '/en/') as is_english,
    regexp_matches(canonical_url, '^https?://blog[.]') as is_blog from canon
), typed as (
  select *, case when is_blog then 'blog' when is_list then 'list' when is_english then 'english' when is_html or is_article then 'article' end as winner,
    case when is_blog or is_list or is_html or is_english or is_article then 'Matched' else 'Unmatched' end as decision from scored
)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url").withColumn("canonical_url", urls.canonical(F.col("url")))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by decision and page type, over canonical URLs that were seen first."""
    return page_type_distribution(ship(spark), sf_dir)


@query(f"with {CANONICAL} select page_id, url, canonical_url from canon")
def url_canonicalize(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "url", "canonical_url")


@query("""select page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) as scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) as host,
  coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]+(/[^?#]*)', 1), ''), '/') as path, regexp_extract(url, '[?]([^#]*)', 1) as query, regexp_extract(url, '#(.*)$', 1) as fragment,
  len(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> ''))::int as n_params from pages""")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query(u).alias("query"), urls.fragment(u).alias("fragment"), F.size(urls.params(urls.query(u))).alias("n_params"))


@query(f"with {CANONICAL} select page_id, canonical_url, row_number() over (partition by canonical_url order by page_id) > 1 as is_duplicate from canon")
def url_dedupe_first_seen(spark, sf_dir):
    return discovery.first_seen(_pages(spark, sf_dir), "canonical_url", ["page_id"]).select("page_id", "canonical_url", "is_duplicate")


@query(f"with {CANONICAL} select count(*) as pages, count(distinct canonical_url) as canonical_urls, count(distinct host) as hosts from canon")
def url_distinct_counts(spark, sf_dir):
    d = _pages(spark, sf_dir)
    return d.agg(F.count("*").alias("pages"), F.count_distinct("canonical_url").alias("canonical_urls"), F.count_distinct(urls.host(F.col("url"))).alias("hosts"))


@query(f"with {CANONICAL}, {RESOLVED} select page_id, decision, winner as page_type_id from typed")
def page_type_resolve(spark, sf_dir):
    return classify(_pages(spark, sf_dir), "canonical_url", PAGE_TYPES).select("page_id", "resolved.decision", "resolved.page_type_id")


@query(f"with {CANONICAL}, {RESOLVED}, firsts as (select *, row_number() over (partition by canonical_url order by page_id) as rn from typed) select decision, winner as page_type_id, count(*) as pages, count(distinct host) as hosts from firsts where rn = 1 group by all")
def page_type_distribution(spark, sf_dir):
    first = discovery.first_seen(_pages(spark, sf_dir), "canonical_url", ["page_id"]).where("not is_duplicate")
    d = classify(first, "canonical_url", PAGE_TYPES)
    return d.groupBy("resolved.decision", "resolved.page_type_id").agg(F.count("*").alias("pages"), F.count_distinct(urls.host(F.col("canonical_url"))).alias("hosts"))


TIED = [PageType("b", "B", 1, (Matcher("PathPrefix", "/en/"),)), PageType("a", "A", 1, (Matcher("PathPrefix", "/en/"),)), PageType("c", "C", 0, (Matcher("PathPrefix", "/fr/"), Matcher("PathPrefix", "/fr")))]


@query(f"with {CANONICAL} select page_id, case when starts_with(path, '/en/') then 'Ambiguous' when starts_with(path, '/fr/') then 'Matched' else 'Unmatched' end as decision, case when starts_with(path, '/en/') then 'A,B' when starts_with(path, '/fr/') then 'C' else '' end as candidates from canon")
def page_type_ambiguous(spark, sf_dir):
    d = classify(_pages(spark, sf_dir), "canonical_url", TIED)
    return d.select("page_id", "resolved.decision", F.array_join(F.transform("resolved.candidates", lambda c: c.getField("name")), ",").alias("candidates"))


@query(f"with {CANONICAL} select page_id, canonical_url from canon where not regexp_matches(path, '^/[a-z][a-z]/[0-9]+/?$')")
def page_type_unmatched(spark, sf_dir):
    rule = [PageType("number", "Number", 0, (Matcher("Regex", "^https?://[^/]+/[a-z][a-z]/[0-9]+/?([?]|$)"),))]
    return classify(_pages(spark, sf_dir), "canonical_url", rule).where("resolved.decision = 'Unmatched'").select("page_id", "canonical_url")


@query(f"""with {CANONICAL} select page_id, host, case when regexp_matches(host, '(^|[.])(spam-farm|cheap-pills)[.]') then 'BLOCKED' when regexp_matches(host, '(^|[.])example[.](com|net)$') then 'IN_SCOPE' else 'EXTERNAL' end as scope,
  array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as registrable_domain from canon""")
def domain_scope_classify(spark, sf_dir):
    h = urls.host(F.col("url"))
    blocked = h.rlike(r"(^|[.])(spam-farm|cheap-pills)[.]")
    scope = F.when(blocked, "BLOCKED").when(urls.in_scope(h, "registrable", ("example.com", "example.net")), "IN_SCOPE").otherwise("EXTERNAL")
    return table(spark, sf_dir, "pages").select("page_id", h.alias("host"), scope.alias("scope"), urls.registrable_domain(h).alias("registrable_domain"))


@query("select page_id, case when strpos(url, '?') > 0 then regexp_extract(url, '^([^?#]*)', 1) || '?[redacted]' else regexp_extract(url, '^([^?#]*)', 1) end as safe_url from pages")
def url_redacted(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.redacted(F.col("url")).alias("safe_url"))


# --- links and discovery

LINKS = """
links as (
  select page_id, source_url, position - 1 as position, regexp_extract(a, 'href="([^"]*)"', 1) as raw_href from (
    select page_id, url as source_url, unnest(found) as a, generate_subscripts(found, 1) as position from (select *, regexp_extract_all(regexp_replace(html, '<script.*?</script>', '', 'gs'), '<a [^>]*>') as found from pages))
)"""


def _links(spark, sf_dir):
    return discovery.links(table(spark, sf_dir, "pages"), keep=("page_id",))


@query(f"with {LINKS} select page_id, position::int as position, raw_href from links")
def links_extract(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "position", "raw_href")


@query(f"with {LINKS} select page_id, position::int as position, regexp_extract(source_url, '^([a-z]+://[^/]+)', 1) || raw_href as target_url from links where starts_with(raw_href, '/')")
def links_resolved(spark, sf_dir):
    d = _links(spark, sf_dir).where(F.col("raw_href").startswith("/"))
    return d.select("page_id", "position", urls.resolve(F.col("raw_href"), F.col("source_url")).alias("target_url"))


@query(f"""with {LINKS}, pages_ as (select *, row_number() over (partition by source_url order by position, raw_href) as rn from links), ranked as (select *, row_number() over (partition by rn <= 3 order by substr(md5(source_url), 1, 3), source_url, position, raw_href) as place from pages_)
  select page_id, position::int as position, raw_href, case when rn <= 3 and place <= 500 then 'ENQUEUED' else 'BUDGET_EXCLUDED' end as status from ranked""")
def links_budgeted(spark, sf_dir):
    """Links of one transition, three a page and 500 in all."""
    one = F.struct(F.lit("t").alias("id"), F.lit(3).cast("long").alias("links"), F.lit(500).cast("long").alias("budget"))
    d = _links(spark, sf_dir).withColumns({"original_url": F.col("raw_href"), "transition": one, "__status": F.lit(None).cast("string")})
    return discovery.budget(d).select("page_id", "position", "raw_href", "status")


SITE = [PageType("page", "Page", 0, (Matcher("Regex", "^https?://[^/]+/[a-z][a-z]/[0-9]+"),)), PageType("term", "Term", 0, (Matcher("Regex", "^https?://[^/]+/[A-Za-z]+$"),))]
STEPS = [discovery.Transition("page-term", "page", "term", total_budget=400, max_links_per_page=4)]
SCOPE = discovery.Scope("registrable", ("example.com", "example.net"), ("spam-farm.example.com", "cheap-pills.example.net"))
STATUSES = f"""with {LINKS}, seen as (
  select *, lower(regexp_extract(source_url, '^[a-z]+://([^/?#]+)', 1)) as host, regexp_extract(source_url, '^([a-z]+://[^/?#]+)', 1) || raw_href as original_url from links
), canon as (
  select *, case when length(raw_href) > 1 then regexp_replace(original_url, '/$', '') else original_url end as canonical_url from seen
), early as (
  select *, case when host in ('spam-farm.example.com', 'cheap-pills.example.net') or ends_with(host, '.spam-farm.example.com') or ends_with(host, '.cheap-pills.example.net') then 'BLOCKED'
    when not regexp_matches(host, '(^|[.])example[.](com|net)$') then 'EXTERNAL' end as e from canon
), dup as (
  select *, case when e is null then row_number() over (partition by case when e is null then canonical_url end, e order by source_url, position) end as k from early
), late as (
  select *, case when e is not null then e when k > 1 then 'DUPLICATE' when not regexp_matches(canonical_url, '^https?://[^/]+/([A-Za-z]+$|[a-z][a-z]/[0-9]+)') then 'UNMATCHED'
    when not (regexp_matches(canonical_url, '^https?://[^/]+/[A-Za-z]+$') and regexp_matches(source_url, '^https?://[^/]+/[a-z][a-z]/[0-9]+')) then 'NO_ELIGIBLE_TRANSITION' end as s from dup
), paged as (
  select *, case when s is null then row_number() over (partition by source_url, s is null order by position) end as p from late
), ranked as (
  select *, case when p <= 4 then row_number() over (partition by p <= 4 order by substr(md5(source_url), 1, 2), source_url, position) end as r from paged
), statuses as (select *, coalesce(s, case when p <= 4 and r <= 400 then 'ENQUEUED' else 'BUDGET_EXCLUDED' end) as status from ranked)"""


def _statuses(spark, sf_dir):
    return discovery.classify_links(_links(spark, sf_dir), SITE, STEPS, SCOPE)


@query(f"{STATUSES} select page_id, position::int as position, canonical_url, status from statuses")
def discovery_status(spark, sf_dir):
    return _statuses(spark, sf_dir).select("page_id", "position", "canonical_url", "status")


@query(f"""{STATUSES} select count(distinct source_url) as pages_sampled, count(*) as links_found, count(distinct canonical_url) as canonical_urls, count(*) filter (status = 'DUPLICATE') as duplicates_prevented,
  count(*) filter (status = 'AMBIGUOUS_PAGE_TYPE') as ambiguous, count(*) filter (status = 'UNMATCHED') as unmatched, count(*) filter (status = 'EXTERNAL') as external, count(*) filter (status = 'BLOCKED') as blocked,
  count(*) filter (status = 'BUDGET_EXCLUDED') as budget_hits, count(*) filter (status = 'ENQUEUED') as enqueued from statuses""")
def discovery_preview(spark, sf_dir):
    return discovery.preview(_statuses(spark, sf_dir))


@query(f"with {LINKS}, g as (select raw_href, count(*) as links from links group by 1) select raw_href, links, links / (select sum(links) from g)::double as share, links / (select sum(links) from g)::double > 0.01 as warning from g")
def growth_share(spark, sf_dir):
    return discovery.growth(_links(spark, sf_dir), "raw_href", 0.01)


@query("select h || p as page_path, count(distinct q) as queries, count(distinct q) > 1 as warning from (select lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) as h, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) as p, regexp_extract(url, '[?]([^#]*)', 1) as q from pages) group by 1")
def query_explosion(spark, sf_dir):
    return discovery.query_explosion(table(spark, sf_dir, "pages"), "url", 1)


@query("select page_id, regexp_matches(url, '[?&](page|p|offset|start)=[0-9]+|/page/[0-9]+/?$') as is_pagination from pages")
def pagination_detect(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", discovery.is_pagination(F.col("url"), F.lit(""), F.lit(False)).alias("is_pagination"))


@query("""with recursive edges as (select distinct o_custkey % 97 as a, (o_custkey * 7 + 1) % 97 as b from orders), reach(n, d) as (select 3::bigint, 0 union select b, d + 1 from reach join edges on n = a where d < 6)
  select 'n' || n as canonical_url, min(d)::int as depth from reach group by n""")
def frontier_reachability(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("a"), ((F.col("o_custkey") * 7 + 1) % 97).alias("b")).distinct()
    edges = o.select(F.concat(F.lit("n"), "a").alias("source_url"), F.concat(F.lit("n"), "b").alias("target_url"))
    seeds = spark.createDataFrame([("n3",)], "canonical_url string")
    return discovery.frontier(seeds, edges, 6, 1000).select("canonical_url", "depth")


@query("select page_id, case when starts_with(p, '/en/7') then true when starts_with(p, '/en/') then false else true end as allowed from (select page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) as p from pages)")
def robots_filter(spark, sf_dir):
    rules, _ = discovery.robots_rules("User-agent: *\nDisallow: /\n\nUser-agent: harvest\nDisallow: /en/\nAllow: /en/7\nCrawl-delay: 2\n", "harvest/1.0")
    return table(spark, sf_dir, "pages").select("page_id", discovery.robots_allows(urls.path(F.col("url")), rules).alias("allowed"))


@query("""with p as (select url, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) as host, ('0x' || substr(md5(url), 1, 4))::int % 64 as b from pages)
  select url, host, ((row_number() over (partition by host order by b, url)) - 1) * 250 as earliest_ms from p""")
def domain_pacing(spark, sf_dir):
    d = table(spark, sf_dir, "pages").select("url", urls.host(F.col("url")).alias("host"))
    return runs.pacing(d, 250)


# --- names, titles, artifacts, extraction

TITLED = "trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '\\s+', ' ', 'g'))"


@query(f"select page_id, case when {TITLED} <> '' then {TITLED} else lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) end as source_name from pages")
def source_naming(spark, sf_dir):
    title, og = extraction.titles(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", urls.source_name(title, og, F.col("url")).alias("source_name"))


@query("select c_custkey, lower(c_mktsegment) || '__' || 'customer_' || lpad(c_custkey::varchar, 9, '0') as table_name, trim(c_name || ' ' || c_mktsegment) as dataset_name from customer")
def dataset_naming(spark, sf_dir):
    d = table(spark, sf_dir, "customer")
    return d.select("c_custkey", urls.table_name(F.col("c_mktsegment"), F.col("c_name")).alias("table_name"), urls.dataset_name(F.col("c_name"), F.col("c_mktsegment")).alias("dataset_name"))


@query("select o_orderkey, 'order-' || o_orderkey || '-' || strftime(o_orderdate, '%Y-%m-%d') || '-' || substr(md5(o_orderkey::varchar), 1, 8) as file_name from orders")
def export_file_names(spark, sf_dir):
    d = table(spark, sf_dir, "orders")
    return d.select("o_orderkey", urls.export_name(F.concat(F.lit("Order "), "o_orderkey"), F.col("o_orderdate"), F.md5(F.col("o_orderkey").cast("string"))).alias("file_name"))


@query("select page_id, sha256(html) as content_hash, octet_length(encode(html))::bigint as byte_size from pages")
def artifact_hash_size(spark, sf_dir):
    return artifacts.measure(table(spark, sf_dir, "pages"), "html").select("page_id", "content_hash", "byte_size")


@query("select p_partkey, case when p_name in ('CON') then null else 'parts/' || p_partkey || '-' || regexp_replace(p_name, '[^A-Za-z0-9._-]', '_', 'g') end as safe_relative_path from part")
def artifact_paths(spark, sf_dir):
    d = table(spark, sf_dir, "part").withColumns({"folder": F.lit("./parts"), "id": F.col("p_partkey").cast("string")})
    return artifacts.place(d, "id", "folder", "p_name").select("p_partkey", "safe_relative_path")


FIELDS = [extraction.FieldRule("heading", ("article h1", "h1")), extraction.FieldRule("first_link", ("nav li > a",), "url:href"), extraction.FieldRule("ad", (".ad",)), extraction.FieldRule("has_form", ("form",), "presence", "boolean")]


@query("""select url, 0 as record_no, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&middot;', '·'), '\\s+', ' ', 'g')) as heading,
  regexp_extract(url, '^([a-z]+://[^/]+)', 1) || regexp_extract(html, '<nav><ul><li><a href="([^"]*)"', 1) as first_link, trim(regexp_replace(regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's'), '\\s+', ' ', 'g')) as ad,
  regexp_matches(html, '<form[ >]') as has_form from pages""")
def fields_extract(spark, sf_dir):
    d = extraction.typed(extraction.extract(table(spark, sf_dir, "pages"), FIELDS), FIELDS)
    return d.select("url", "record_no", "heading", "first_link", "ad", "has_form")


@query(f"with {LINKS} select source_url as url, (row_number() over (partition by source_url order by position) - 1)::int as record_no, raw_href as href from links")
def records_extract(spark, sf_dir):
    d = extraction.extract(table(spark, sf_dir, "pages"), [extraction.FieldRule("href", ("a",), "attr:href")], "nav li", page="page_id")
    return d.select("url", "record_no", F.col("href_raw").alias("href"))


@query("select '.ad' as selector, count(*) filter (html like '%class=\"ad\"%') as pages, count(*) filter (html like '%class=\"ad\"%') / count(*)::double as coverage, 2 as rank from pages")
def field_suggestions(spark, sf_dir):
    return extraction.suggestions(table(spark, sf_dir, "pages"))


@query("select case when n >= 3 then 'RECORDS' else 'DOCUMENT' end as mode, count(*) as pages from (select len(regexp_extract_all(html, '<li>')) as n from pages) group by 1")
def mode_suggestion(spark, sf_dir):
    return extraction.mode(table(spark, sf_dir, "pages")).groupBy("mode").agg(F.count("*").alias("pages"))


@query("""select page_id, false as has_script, html like '%<article>%' as has_article, len(regexp_extract_all(html, '<li><a href="/'))::int as n_links, len(regexp_extract_all(regexp_replace(html, '<(script|style)>.*?</(script|style)>', '', 'gs'), '<p>'))::int as n_paragraphs,
  regexp_extract(html, '<h1>(.*?)</h1>', 1) as heading from pages""")
def preview_sanitized(spark, sf_dir):
    d = extraction.preview(table(spark, sf_dir, "pages"))
    return d.select("page_id", F.col("preview_html").rlike("(?i)<script|<style|javascript:| on[a-z]+=").alias("has_script"), F.col("preview_html").contains("<article>").alias("has_article"), F.regexp_count("preview_html", F.lit('<li><a href="/')).alias("n_links"), F.regexp_count("preview_html", F.lit("<p>")).alias("n_paragraphs"), F.regexp_extract("preview_html", "<h1>(.*?)</h1>", 1).alias("heading"))


#: A path of tags and what shows it in the pages of the test tables.
SHAPES = {
    "/html": "<html", "/html/head": "<head>", "/html/head/meta": "<head>.*<meta ", "/html/head/title": "<title>", "/html/head/style": "<style>", "/html/head/script": "<script>", "/html/body": "<body>",
    "/html/body/nav": "<nav>", "/html/body/nav/ul": "<nav><ul>", "/html/body/nav/ul/li": "<ul><li>", "/html/body/nav/ul/li/a": "<li><a ", "/html/body/div": '</nav>.*<div class="ad">', "/html/body/article": "<article>",
    "/html/body/article/h1": "<article><h1>", "/html/body/article/p": "</h1><p>", "/html/body/article/p/b": "<p><b>", "/html/body/article/p/b/br": "<p><b>[^<]*<br>", "/html/body/footer": "<footer>",
}


@query(f"""with shapes(path, shown) as (values {", ".join(f"('{path}', '{shown}')" for path, shown in SHAPES.items())}),
  prints as (select page_id, sha256(string_agg(path, chr(10) order by path)) as fingerprint from pages, shapes where regexp_matches(html, shown, 's') group by 1) select fingerprint, count(*) as pages from prints group by 1""")
def structure_fingerprints(spark, sf_dir):
    return extraction.structure(table(spark, sf_dir, "pages")).groupBy("fingerprint").agg(F.count("*").alias("pages"))


@query("""select p_partkey, p_type, case p_type when 'ECONOMY' then 'application/pdf' when 'STANDARD' then 'text/html' else 'image/png' end as content_type, case p_type when 'STANDARD' then 'WEB_PAGE' else 'FILE_ASSET' end as target,
  case p_type when 'ECONOMY' then false else true end as mismatch from part""")
def intake_route(spark, sf_dir):
    kind = F.when(F.col("p_type") == "ECONOMY", "application/pdf").when(F.col("p_type") == "STANDARD", "text/html").otherwise("image/png")
    url = F.concat(F.lit("https://x.test/a"), F.when(F.col("p_type") == "STANDARD", "").otherwise(".pdf"))
    d = table(spark, sf_dir, "part").withColumns({"content_type": kind, "u": url})
    mismatch = F.when(F.col("p_type") == "STANDARD", True).otherwise(extraction.type_mismatch(F.col("u"), F.col("content_type")))
    return d.select("p_partkey", "p_type", "content_type", extraction.intake(F.col("u"), F.col("content_type")).alias("target"), mismatch.alias("mismatch"))


# --- settings, snapshots, versions

LAYER_STATES = [("INHERIT", 0), ("CUSTOM", 1), ("RESET_TO_BUILT_IN", 2)]
_SETTING = {name: f"(o_orderkey // {3**i}) % 3" for i, (name, _) in enumerate(settings.LAYERS)}
_PICK = " ".join(f"when (o_orderkey // {3**i}) % 3 = 1 then" + " {" + str(i) + "} when (o_orderkey // " + f"{3**i}) % 3 = 2 then" + " {b}" for i in range(5))


@query("select o_orderkey, case " + _PICK.format(*[str(11 + i) for i in range(5)], b="99") + " else 99 end as value, case " + _PICK.format(*[f"'{s}'" for _, s in settings.LAYERS], b="'BUILT_IN_DEFAULT'") + " else 'BUILT_IN_DEFAULT' end as source from orders")
def settings_resolve(spark, sf_dir):
    def state(i: int):
        n = F.floor(F.col("o_orderkey") / 3**i) % 3
        return F.when(n == 1, "CUSTOM").when(n == 2, "RESET_TO_BUILT_IN")

    layers = {name: (state(i), F.lit(11 + i)) for i, (name, _) in enumerate(settings.LAYERS)}
    return table(spark, sf_dir, "orders").withColumn("r", settings.resolve(layers, F.lit(99))).select("o_orderkey", "r.value", "r.source")


@query("""with s as (select o_orderstatus as key, case o_custkey % 3 when 0 then 'GLOBAL' when 1 then 'COLLECTION' else 'RUN_PROFILE' end as scope, o_orderpriority as value, o_orderdate, o_orderkey from orders),
  last as (select * from (select *, row_number() over (partition by key, scope order by o_orderdate desc, o_orderkey desc) as rn from s) where rn = 1)
  select key, arg_max(value, case scope when 'RUN_PROFILE' then 3 when 'COLLECTION' then 2 else 1 end) as value,
    case max(case scope when 'RUN_PROFILE' then 3 when 'COLLECTION' then 2 else 1 end) when 3 then 'RUN_PROFILE' when 2 then 'COLLECTION_OVERRIDE' else 'GLOBAL_SETTING' end as source from last group by key""")
def settings_stored(spark, sf_dir):
    scope = F.when(F.col("o_custkey") % 3 == 0, "GLOBAL").when(F.col("o_custkey") % 3 == 1, "COLLECTION").otherwise("RUN_PROFILE")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("key"), scope.alias("scope"), F.lit("CUSTOM").alias("state"), F.col("o_orderpriority").alias("value"), "o_orderdate", "o_orderkey")
    last = settings.latest(rows, ("key", "scope"), ("o_orderdate", "o_orderkey"))
    keys = rows.select("key").distinct().withColumn("built_in", F.lit("none"))
    return settings.resolve_stored(last, keys)


@query("""select c_nationkey, max(c_custkey) as c_custkey, arg_max(c_name, c_custkey) as c_name, min(c_custkey) as first_custkey from customer group by 1""")
def upsert_latest(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name", F.col("c_custkey").alias("first_custkey"))
    return settings.latest(d, ("c_nationkey",), ("c_custkey",), ("first_custkey",))


@query("select count(*) filter (k % 7 <> 0 and k % 3 <> 0) as valid, count(*) filter (k % 7 = 0) as bad_env, count(*) filter (k % 3 = 0) as secret from (select p_partkey as k from part)")
def configuration_checks(spark, sf_dir):
    k = F.col("p_partkey")
    env = F.when(k % 7 == 0, "lower_name").otherwise("CRAWL_KEY_1")
    name = F.when(k % 3 == 0, "Nested_Token").otherwise("page_limit")
    bad, secret = ~checks.is_env_name(env), checks.is_secret_key(name)
    return table(spark, sf_dir, "part").agg(F.count_if(~bad & ~secret).alias("valid"), F.count_if(bad).alias("bad_env"), F.count_if(secret).alias("secret"))


@query("select p_partkey, p_partkey % 4 in (1, 3) as holds_secret from part")
def json_secret_scan(spark, sf_dir):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, '{"a": {"b": [1, 2]}}').when(k == 1, '{"a": [{"api_key": 1}]}').when(k == 2, '["x", null]').otherwise('{"h": "Bearer abc"}')
    return table(spark, sf_dir, "part").select("p_partkey", checks.json_holds_secret(text).alias("holds_secret"))


@query("""select event_id, '{"event_type":"' || event_type || '","props":' || replace(props, ' ', '') || ',"user_id":' || user_id || '}' as canonical_json, sha256('{"event_type":"' || event_type || '","props":' || replace(props, ' ', '') || ',"user_id":' || user_id || '}') as hash from events""")
def canonical_json_hash(spark, sf_dir):
    text = F.concat(F.lit('{"user_id": '), "user_id", F.lit(', "props": '), "props", F.lit(', "event_type": "'), "event_type", F.lit('"}'))
    d = table(spark, sf_dir, "events").select("event_id", checks.canonical_json(text).alias("canonical_json"))
    return d.withColumn("hash", F.sha2("canonical_json", 256))


SNAPSHOT = """'{"actor":"user-' || o_custkey || '","checkpoint":null,"limits":{"max_depth":3,"max_pages":' || o_orderkey || '},"run_type":"PRODUCTION_RUN","seeds":["' || o_orderstatus || '","' || o_orderpriority || '"]}'"""


@query(f"select o_orderkey, sha256({SNAPSHOT}) as snapshot_hash from orders")
def snapshot_hash(spark, sf_dir):
    run = F.struct(F.lit("PRODUCTION_RUN").alias("run_type"), F.array("o_orderstatus", "o_orderpriority").alias("seeds"), F.struct(F.col("o_orderkey").alias("max_pages"), F.lit(3).alias("max_depth")).alias("limits"), F.concat(F.lit("user-"), "o_custkey").alias("actor"), F.lit(None).cast("string").alias("checkpoint"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", run.alias("run"))
    return d.select("o_orderkey", snapshots.canonical_sha256(d, "run").alias("snapshot_hash"))


@query("select o_orderkey from orders where o_orderkey % 11 = 0")
def snapshot_tampered(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.struct("o_custkey", "o_orderstatus").alias("run"))
    d = d.withColumn("stored", snapshots.canonical_sha256(d, "run"))
    d = d.withColumn("run", F.struct(F.col("run.o_custkey"), F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("run.o_orderstatus")).alias("o_orderstatus")))
    return d.where(snapshots.canonical_sha256(d, "run") != F.col("stored")).select("o_orderkey")


@query("select version, name, sha256('\"' || sql || '\"') as checksum, case when version = '0002' then 'CHECKSUM_MISMATCH' when version = '0003' then 'PENDING' else 'APPLIED' end as state from (values ('0001', 'a', 'create table a'), ('0002', 'b', 'create table b'), ('0003', 'c', 'create table c')) t(version, name, sql)")
def migration_status(spark, sf_dir):
    known = [("0001", "a", "create table a"), ("0002", "b", "create table b"), ("0003", "c", "create table c")]
    applied = spark.createDataFrame([("0001", "create table a"), ("0002", "create table bb")], "version string, sql string").select("version", versioning.migration_checksum(F.col("sql")).alias("checksum"))
    return versioning.migration_plan(known, applied).select("version", "name", "checksum", "state")


def _log(spark, sf_dir):
    """Events read as an audit log: signups activate drafts, purchases publish, clicks go back to an old version."""
    kind = F.when(F.col("event_type") == "signup", versioning.DRAFT_ACTIVATED).when(F.col("event_type") == "purchase", versioning.PUBLISHED).when(F.col("event_type") == "click", versioning.REACTIVATED)
    d = table(spark, sf_dir, "events").withColumn("kind", kind).where("kind is not null")
    return d.select(F.col("user_id").alias("crawler_id"), (F.col("event_id") % 13).alias("version_id"), F.col("kind").alias("event_type"), F.col("ts").alias("occurred_at"), F.col("event_id").alias("id"))


@query("""with l as (select user_id as c, event_id % 13 as v, event_type = 'signup' as draft, ts, event_id from events where event_type in ('signup', 'purchase', 'click')),
  p as (select c, arg_max(v, (ts, event_id)) as v from l where not draft group by c), d as (select c, arg_max(v, (ts, event_id)) as v, max((ts, event_id)) as at from l where draft group by c)
  select coalesce(p.c, d.c) as crawler_id, case when not exists (select 1 from l where not l.draft and l.c = d.c and l.v = d.v and (l.ts, l.event_id) > d.at) then d.v end as active_draft_version_id, p.v as active_published_version_id from p full join d on p.c = d.c""")
def current_pointer(spark, sf_dir):
    return versioning.pointers(_log(spark, sf_dir))


@query("select user_id as entity_id, count(*) as events from events group by 1")
def audit_count_by_entity(spark, sf_dir):
    return versioning.audit_counts(table(spark, sf_dir, "events").withColumnRenamed("user_id", "entity_id"))


@query("select o_orderkey::varchar as entity_id, 'ERROR' as severity, 'CONFLICT' as code from orders where o_orderstatus = 'F' and o_orderkey % 5 = 0")
def published_immutable(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    versions = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "PUBLISHED").otherwise("DRAFT").alias("state"))
    incoming = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("id"))
    return versioning.changes_to_published(versions, incoming).select("entity_id", "severity", "code")


@query("select l_orderkey::varchar || '-' || l_linenumber as entity_id, count(*) as rows from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F' group by 1")
def published_children_frozen(spark, sf_dir):
    versions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "PUBLISHED").otherwise("DRAFT").alias("state"))
    children = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("crawler_version_id"))
    return versioning.changes_under_published(versions, children).groupBy("entity_id").agg(F.count("*").alias("rows"))


@query("select o_orderkey, nullif(o_custkey, 7) as active_draft_version_id, 7 as active_published_version_id from orders")
def publish_pointers(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("active_draft_version_id"), F.lit(None).cast("int").alias("active_published_version_id"))
    return versioning.publish(d, F.lit(7))


@query("select o_orderkey, o_totalprice from orders where o_orderkey = 42 and o_orderstatus is not null")
def point_lookup(spark, sf_dir):
    return tables.lookup(table(spark, sf_dir, "orders"), "o_orderkey", 42).where("o_orderstatus is not null").select("o_orderkey", "o_totalprice")


# --- curation


@query("select l_orderkey, l_linenumber, count(*) as rows, count(*) - 1 as excess from lineitem group by 1, 2 having count(*) > 1")
def unique_key_violations(spark, sf_dir):
    return curation.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("select sha256(text) as content_hash, count(*) as rows, min(doc_id) as first_id from documents where text is not null group by 1 having count(*) > 1")
def content_duplicates(spark, sf_dir):
    return curation.content_duplicates(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("select doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g')))::int as squeezed_length, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as squeezed_hash from documents")
def whitespace_normalized_compare(spark, sf_dir):
    t = checks.squeezed(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).alias("squeezed_length"), F.sha2(t, 256).alias("squeezed_hash"))


RULES = [Field("name", required=True, min_length=9), Field("size", "int", required=True), Field("price", "double"), Field("note")]


def _parts(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select((k % 1900).alias("key"), F.when(k % 50 == 0, " ").otherwise(F.col("p_name")).alias("name"), F.when(k % 70 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("size"), F.col("p_retailprice").cast("string").alias("price"), F.when(k % 3 == 0, "x").alias("note"))


CHECKED = """with p as (select p_partkey % 1900 as key, case when p_partkey % 50 = 0 then ' ' else p_name end as name, case when p_partkey % 70 = 0 then 'n/a' else p_size::varchar end as size, case when p_partkey % 3 = 0 then 'x' end as note from part),
  c as (select *, trim(name) = '' as e1, size = 'n/a' as e2, count(*) over (partition by key) > 1 as e3, trim(name) <> '' and length(name) < 9 as w1, note is null as w2 from p)"""


@query(f"""{CHECKED} select code, severity, count(*) as rows from (select 'MISSING_REQUIRED' as code, 'ERROR' as severity from c where e1 union all select 'INVALID_TYPE', 'ERROR' from c where e2 union all select 'DUPLICATE_KEY', 'ERROR' from c where e3
  union all select 'SHORT_TEXT', 'WARNING' from c where w1 union all select 'MISSING_OPTIONAL', 'WARNING' from c where w2) group by all""")
def validation_issues(spark, sf_dir):
    d = curation.issues(_parts(spark, sf_dir), RULES, "key")
    return d.select(F.explode("issues").alias("i")).groupBy("i.code", "i.severity").agg(F.count("*").alias("rows"))


@query(f"""{CHECKED} select count(*) filter (not (e1 or e2 or e3)) as approved, count(*) filter (not (e1 or e2 or e3) and (w1 or w2)) as with_warning, count(*) filter (e1 or e2 or e3) as skipped, 'PARTIALLY_APPROVED' as outcome from c""")
def approve_all_valid(spark, sf_dir):
    return curation.batch_summary(curation.approve_all_valid(curation.issues(_parts(spark, sf_dir), RULES, "key")))


DIFF_FIELDS = [Field("o_orderstatus"), Field("o_totalprice", "double"), Field("o_orderpriority", compare="whitespace"), Field("o_custkey", compare="ignore")]


def _two_runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_custkey")
    k = F.col("o_orderkey")
    old = o.where(k % 10 != 1)
    new = o.where(k % 10 != 2).withColumns({"o_totalprice": F.when(k % 10 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), "o_orderpriority": F.concat(F.lit(" "), F.col("o_orderpriority")), "o_custkey": F.col("o_custkey") + 1})
    return old, new, o.where((k % 100 == 1)).select("o_orderkey")


_CHANGE = "case when o_orderkey % 100 = 1 then 'RESTORED_CANDIDATE' when o_orderkey % 10 = 1 then 'NEW_CANDIDATE' when o_orderkey % 10 = 2 then 'MISSING_CANDIDATE' when o_orderkey % 10 = 3 then 'UPDATED_CANDIDATE' else 'UNCHANGED' end"


@query(f"select o_orderkey, {_CHANGE} as change, case when o_orderkey % 10 = 3 then 'o_totalprice' else '' end as changed, false as diagnostic from orders")
def recrawl_diff(spark, sf_dir):
    old, new, gone = _two_runs(spark, sf_dir)
    return curation.diff(old, new, ["o_orderkey"], DIFF_FIELDS, True, gone).select("o_orderkey", "change", F.array_join("changed_fields", ",").alias("changed"), "diagnostic")


@query(f"select change, count(*) as rows, change <> 'UNCHANGED' as diagnostic from (select {_CHANGE} as change from orders where o_orderkey % 10 <> 2) group by 1")
def recrawl_diff_partial_guard(spark, sf_dir):
    old, new, gone = _two_runs(spark, sf_dir)
    run = F.struct(F.lit("PRODUCTION_RUN").alias("run_type"), F.lit("PARTIAL_RESULT").alias("status"), *[F.lit(True).alias(c) for c in curation.COMPLETE])
    gate = spark.range(1).select(run.alias("run")).select(curation.is_complete("run").alias("ok")).first()["ok"]
    return curation.diff(old, new, ["o_orderkey"], DIFF_FIELDS, gate, gone).groupBy("change", "diagnostic").agg(F.count("*").alias("rows"))


@query(f"select count(*) filter (c = 'UNCHANGED') as unchanged, count(*) filter (c = 'UPDATED_CANDIDATE') as updated_candidate, count(*) filter (c = 'NEW_CANDIDATE') as new_candidate, count(*) filter (c = 'MISSING_CANDIDATE') as missing_candidate, count(*) filter (c = 'RESTORED_CANDIDATE') as restored_candidate, true as needs_review from (select {_CHANGE} as c from orders)")
def no_change_outcome(spark, sf_dir):
    old, new, gone = _two_runs(spark, sf_dir)
    return curation.no_change(curation.diff(old, new, ["o_orderkey"], DIFF_FIELDS, True, gone))


def _candidates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.lit("ship_mode").alias("field"), F.col("l_returnflag").alias("value"), F.col("l_linestatus").alias("source"))


@query("""with c as (select l_orderkey as key, count(*) as n_candidates, count(distinct l_returnflag) as n_values, min(l_returnflag) as least, max(l_returnflag) as most from lineitem group by 1),
  cur as (select o_orderkey, case when o_orderkey % 2 = 0 then 'A' end as v from orders)
  select key, 'ship_mode' as field, n_candidates, n_values, least, most, case when n_values = 1 and v is null then 'ENRICHMENT' when n_values = 1 and least = v then 'NO_CHANGE' else 'FIELD_CONFLICT' end as outcome from c left join cur on key = o_orderkey""")
def field_merge_candidates(spark, sf_dir):
    now = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit("ship_mode").alias("field"), F.when(F.col("o_orderkey") % 2 == 0, "A").alias("value"))
    return curation.merge(_candidates(spark, sf_dir), now)


@query("select l_orderkey as key, l_returnflag as value, l_linestatus as source, (rank() over (partition by l_orderkey order by case l_linestatus when 'O' then 1 when 'F' then 2 else 3 end))::int as preference from lineitem")
def preferred_source_rank(spark, sf_dir):
    return curation.preferred(_candidates(spark, sf_dir), ["O", "F"]).select("key", "value", "source", "preference")


@query("select o_orderkey as entity_id, o_custkey as reference, 'WARNING' as severity, 'UNRESOLVED_REFERENCE' as code from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def relationship_unresolved(spark, sf_dir):
    approved = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return curation.unresolved(table(spark, sf_dir, "orders"), "o_custkey", approved, "c_custkey", "o_orderkey")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def missing_label_warning(spark, sf_dir):
    return curation.unresolved(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "labels"), "doc_id", "doc_id").select(F.col("entity_id").alias("doc_id"))


@query("select 'lang' as field, count(*) filter (lang is not null and trim(lang) <> '') as matched, count(*) as total, count(*) filter (lang is not null and trim(lang) <> '') / count(*)::double as coverage from documents union all select 'source', count(*) filter (trim(source) <> ''), count(*), count(*) filter (trim(source) <> '') / count(*)::double from documents")
def selector_coverage(spark, sf_dir):
    return curation.coverage(table(spark, sf_dir, "documents"), "lang", "source")


@query("""with m as (select o_orderstatus as dataset, year(o_orderdate) as run_no, count(*) as records from orders group by 1, 2), p as (select *, lag(records) over (partition by dataset order by run_no) as b from m)
  select dataset, run_no, records, coalesce(abs(records - b) > 0.5 * b, false) as anomaly from p""")
def schema_drift(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("dataset"), F.year("o_orderdate").cast("long").alias("run_no")).agg(F.count("*").alias("records"))
    m = m.withColumns({"coverage": F.lit(1.0), "mismatch_rate": F.lit(0.0), "key_failures": F.lit(0)})
    return curation.drift(m).select("dataset", "run_no", "records", F.exists("signals", lambda x: x.code == "RECORD_COUNT").alias("anomaly"))


@query("select l_orderkey, l_linenumber, l_quantity, lead(l_linenumber) over (partition by l_orderkey order by l_linenumber) as superseded_by from (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity from lineitem group by 1, 2)")
def record_supersession(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("version")).agg(F.max("l_quantity").alias("l_quantity"))
    return curation.superseded(d, "l_orderkey").withColumnRenamed("version", "l_linenumber")


@query("select o_orderkey as key, o_orderkey % 4 as base_version, 3 as current_version from orders where o_orderkey % 4 <> 3")
def optimistic_conflicts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    versions = o.select("key", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("version"))
    _, bad = curation.new_versions(versions, o.withColumn("base_version", F.col("key") % 4))
    return bad.select("key", "base_version", "current_version")


# --- provenance, exports, runs


@query("""select page_id as record_id, field, raw_value, norm_value, url as source_url, sha256(html) as artifact_hash from (
  select page_id, url, html, 'host' as field, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as raw_value, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) as norm_value from pages
  union all select page_id, url, html, 'scheme', regexp_extract(url, '^([a-z]+):', 1), regexp_extract(url, '^([a-z]+):', 1) from pages)""")
def field_provenance(spark, sf_dir):
    u = F.col("url")
    d = table(spark, sf_dir, "pages").withColumns({"host_raw": urls.part(u, 3), "host": urls.host(u), "scheme_raw": urls.part(u, 1), "scheme": urls.scheme(u), "hash": F.sha2("html", 256)})
    return provenance.emit(d, "page_id", {"host_raw": "host", "scheme_raw": "scheme"}, {"source_url": "url", "artifact_hash": "hash"})


@query("""select l_orderkey as record_id, l_linenumber, o_orderstatus as run_type, c_mktsegment as version_state from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey""")
def field_provenance_trace(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), "l_linenumber", F.col("l_orderkey").alias("run_id"), F.lit("x").alias("artifact_hash"))
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("run_type"), F.col("o_custkey").alias("crawler_version_id"))
    v = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("state"))
    a = spark.createDataFrame([], "content_hash string, safe_relative_path string")
    return provenance.trace(p, r, v, a).select("record_id", "l_linenumber", "run_type", "version_state")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
def approved_export_view(spark, sf_dir):
    d = table(spark, sf_dir, "orders").withColumn("state", F.when(F.col("o_orderstatus") == "F", "APPROVED").otherwise("DRAFT"))
    return provenance.approved(d).select("o_orderkey", "o_totalprice")


@query("""select event_type as metric, sum(v) filter (d = 1) as left_value, sum(v) filter (d = 2) as right_value, coalesce(sum(v) filter (d = 2), 0) - coalesce(sum(v) filter (d = 1), 0) as delta
  from (select event_type, day(ts) as d, count(*) as v from events where day(ts) in (1, 2) group by 1, 2) group by 1""")
def run_comparison(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").cast("string").alias("run_id"), F.col("event_type").alias("metric")).agg(F.count("*").alias("value"))
    return runs.compare(m, "1", "2")


@query(f"with {CANONICAL}, {RESOLVED} select page_id, winner as left_type, case when is_english then 'english' end as right_type, case when winner is not distinct from case when is_english then 'english' end then 'SAME' else 'CHANGED' end as change from typed")
def draft_vs_published(spark, sf_dir):
    d = _pages(spark, sf_dir)
    left = classify(d, "canonical_url", PAGE_TYPES).select("page_id", "resolved.page_type_id")
    right = classify(d, "canonical_url", [PAGE_TYPES[2]]).select("page_id", "resolved.page_type_id")
    return runs.compare_classification(left, right, "page_id")


@query("select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as seq from events")
def progress_sequence(spark, sf_dir):
    return runs.sequence(table(spark, sf_dir, "events"), "user_id", ("ts", "event_id")).select("event_id", "user_id", "seq")


@query("select event_id, event_type from events where event_id > 700")
def progress_replay_after(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return runs.replay(e.unionByName(e.where("event_id % 10 = 0")), 700, "event_id", "event_id").select("event_id", "event_type")


@query("select user_id, arg_max(event_type, event_id) as last_kind, count(*) as events, arg_max(event_type, event_id) in ('purchase', 'error') as is_terminal from events group by 1")
def terminal_state(spark, sf_dir):
    return runs.terminal(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", ("purchase", "error"))


@query("select user_id, min(ts) as started_at, max(ts) as ended_at, (floor(epoch(max(ts))) - floor(epoch(min(ts))))::bigint as seconds from events group by 1")
def run_durations(spark, sf_dir):
    return runs.durations(table(spark, sf_dir, "events"), "user_id", "ts")


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) <= 3 as retained from orders")
def retention_latest_n(spark, sf_dir):
    return runs.retention(table(spark, sf_dir, "orders"), 3, "o_custkey", (F.desc("o_orderdate"), F.desc("o_orderkey"))).select("o_custkey", "o_orderkey", "retained")


@query("select o_orderstatus, r as retained, count(*) as rows, sum(o_orderkey)::bigint as bytes from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) <= 3 as r from orders) group by 1, 2")
def retention_preview(spark, sf_dir):
    d = runs.retention(table(spark, sf_dir, "orders"), 3, "o_custkey", (F.desc("o_orderdate"), F.desc("o_orderkey")))
    return runs.retention_preview(d, "o_orderstatus", "o_orderkey")


@query("select o_orderkey, o_orderpriority from orders where o_orderstatus = 'O' order by o_orderpriority desc, o_orderdate, o_orderkey limit 25")
def queue_next(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("DONE").alias("state"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("scheduled_at"), F.col("o_orderkey").alias("job_id"))
    return runs.queue(jobs, 25).select(F.col("job_id").alias("o_orderkey"), F.col("priority").alias("o_orderpriority"))


@query("select o_orderstatus as state, count(*) as rows from orders group by 1")
def queue_overview(spark, sf_dir):
    return runs.counts_by(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "state"), "state")


@query("select o_orderkey as job_id from orders where o_orderstatus = 'P' and o_orderdate < timestamp '1995-06-01'")
def stale_leases(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("DONE").alias("state"), F.col("o_orderdate").alias("lease_expires_at"))
    return runs.stale(jobs, F.lit("1995-06-01").cast("timestamp")).select("job_id")


@query("select l_orderkey as job_id, max(l_linenumber)::int as attempts, max(l_linenumber) < 4 as may_retry from lineitem group by 1")
def bounded_retries(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("attempt"), F.lit("timeout").alias("error"))
    return runs.retries(a, 4).select("job_id", "attempts", "may_retry")


@query("select sum(octet_length(encode(html)))::bigint as bytes, 'OK' as state from pages")
def disk_pressure(spark, sf_dir):
    d = artifacts.measure(table(spark, sf_dir, "pages"), "html")
    return runs.disk_pressure(d, 1 << 40).select("bytes", "state")


@query("select 'lineitem' as \"table\", (select count(*) from lineitem where l_partkey = 5) as rows union all select 'part', (select count(*) from part where p_partkey = 5)")
def impact_analysis(spark, sf_dir):
    return runs.references(5, lineitem=(table(spark, sf_dir, "lineitem"), "l_partkey"), part=(table(spark, sf_dir, "part"), "p_partkey"))


@query("select 'nation' as kind, n_nationkey::varchar as id, n_name as name from nation where lower(n_name) like '%1%' union all select 'region', r_regionkey::varchar, r_name from region where lower(r_name) like '%1%'")
def metadata_search(spark, sf_dir):
    return runs.search("1", nation=(table(spark, sf_dir, "nation"), "n_nationkey", "n_name"), region=(table(spark, sf_dir, "region"), "r_regionkey", "r_name"))


@query("select o_orderkey as id, o_orderstatus from orders order by case o_orderstatus when 'F' then 0 when 'P' then 1 else 2 end, o_orderdate desc, o_orderkey limit 20")
def recent_activity(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "P", "DRAFT").otherwise("SUCCEEDED")
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", status.alias("status"), F.col("o_orderdate").alias("at"))
    return runs.activity(d, 20).select("id", "o_orderstatus")


@query("""select c_custkey as crawler_id, coalesce(v, 0) as versions, coalesce(d, 0) as drafts, coalesce(v, 0) as runs, s as last_run_status from customer left join
  (select o_custkey, count(*) as v, count(*) filter (o_orderstatus = 'O') as d, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as s from orders group by 1) on c_custkey = o_custkey""")
def crawler_overview(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    crawlers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    versions = o.select(F.col("o_custkey").alias("crawler_id"), F.when(F.col("o_orderstatus") == "O", "DRAFT").otherwise("PUBLISHED").alias("state"))
    done = o.select(F.col("o_custkey").alias("crawler_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("run_id"))
    return runs.overview(crawlers, versions, done)


@query("select o_orderkey::varchar as entity_id, case o_orderstatus when 'F' then 'WARNING' else 'ERROR' end as severity from orders where o_orderstatus in ('F', 'O')")
def publish_gate(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    facts = o.select(F.col("o_orderkey").cast("string").alias("crawler_version_id"), F.when(F.col("o_orderstatus") == "F", "coverage").otherwise("unique_key").alias("check"), (F.col("o_orderstatus") == "P").alias("ok"))
    return runs.publish_gate(facts).select("entity_id", "severity")


@query("select user_id::varchar as stream_id, row_number() over (partition by user_id order by ts, event_id::varchar) as seq, event_id::varchar as event_id, event_type as kind from events")
def progress_stream_dedupe(spark, sf_dir):
    """A file stream in which every event comes twice, each taken once and numbered within its user, appended to a log and read back."""
    from harvestry.streaming import progress

    base = _folder(spark, "progress")
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("payload"))
    for _ in range(2):
        e.repartition(2, "stream_id").write.mode("append").parquet(f"{base}/in")
    stream = progress.once(progress.read(spark, f"{base}/in", progress.EVENT, 1), delay="4000 days")
    progress.log(progress.numbered(stream), f"{base}/log", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/log").select("stream_id", "seq", "event_id", "kind")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{staging.folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- more of the model


@query("select event_id, substr(lpad(to_hex(epoch_ms(ts)), 12, '0'), 1, 8) as first_part, true as is_v7 from events")
def typed_ids(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", ids.uuid7(F.col("ts").cast("timestamp"), F.col("event_id")).alias("id"))
    return d.select("event_id", F.upper(F.split_part("id", F.lit("-"), F.lit(1))).alias("first_part"), ids.is_uuid7(F.col("id")).alias("is_v7"))


@query("select l_orderkey::varchar as entity_id, 'NOT_FOUND' as code, count(*) as rows from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 3 <> 0) group by 1")
def foreign_key_orphans(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0")
    return runs.orphans(table(spark, sf_dir, "lineitem"), "l_orderkey", parents, "o_orderkey").groupBy("entity_id", "code").agg(F.count("*").alias("rows"))


@query("""select user_id, d, events, lag(events) over (partition by user_id order by d) as previous_events from (select user_id, day(ts) as d, count(*) as events from events group by 1, 2)""")
def previous_run(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id", F.dayofmonth("ts").cast("long").alias("d")).agg(F.count("*").alias("events"))
    return runs.with_previous(d, "user_id", ("d",), "events")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus in ('O', 'P') order by o_totalprice desc, o_orderkey limit 50")
def review_grid(spark, sf_dir):
    d = table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "state")
    return runs.review_grid(d, ("O", "P"), (F.desc("o_totalprice"), "o_orderkey"), 50).select("o_orderkey", "o_totalprice")


@query("select event_id, user_id from events where event_type = 'error' and user_id = 8")
def log_filter(spark, sf_dir):
    return runs.log_filter(table(spark, sf_dir, "events"), event_type="error", user_id="8").select("event_id", "user_id")


@query("select s_suppkey as id, s_name as url from supplier where s_acctbal > 0 and s_suppkey in (1, 3, 5, 7)")
def seed_selection(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("url"), (F.col("s_acctbal") > 0).alias("enabled"))
    return runs.seeds(rows, (1, 3, 5, 7)).select("id", "url")


@query(f"""{STATUSES}, terms as (select *, regexp_matches(canonical_url, '^https?://[^/]+/[A-Za-z]+$') as to_term, regexp_matches(canonical_url, '^https?://[^/]+/[a-z][a-z]/[0-9]+') as to_page, regexp_matches(source_url, '^https?://[^/]+/[a-z][a-z]/[0-9]+') as from_page from statuses)
  select 'PAGE_TYPE' as kind, case when to_page then 'page' else 'term' end as id, count(*) as links, count(*) filter (status = 'ENQUEUED') as enqueued from terms where to_page or to_term group by 1, 2
  union all select 'TRANSITION', 'page-term', count(*) filter (from_page and to_term), count(*) filter (status = 'ENQUEUED') from terms union all select 'TRANSITION', 'unused', 0, 0""")
def graph_overlay(spark, sf_dir):
    edges = spark.createDataFrame([("page-term",), ("unused",)], "id string")
    return runs.overlay(_statuses(spark, sf_dir), edges)


@query("""with o as (select *, case o_orderkey % 4 when 0 then 'QUICK_SCRAPE' else 'PRODUCTION_RUN' end as run_type, case when o_orderkey % 3 = 0 then 'quick_scrape' else 'crawler_version' end as kind from orders)
  select o_orderkey, (run_type = 'QUICK_SCRAPE') = (kind = 'quick_scrape') and o_orderkey % 7 <> 0 and (kind = 'quick_scrape' or o_orderkey % 5 <> 0) as valid from o""")
def run_compatibility(spark, sf_dir):
    """Which runs fit their configuration, user agent and configuration hash."""
    k = F.col("o_orderkey")
    ad_hoc = k % 3 == 0
    version = F.when(~ad_hoc, "v1")
    robots = F.struct(F.struct(F.lit("RESPECT").alias("decision"), F.lit(None).cast("string").alias("reason")).alias("decision"), F.lit("me").alias("actor"), F.lit("t").alias("decided_at"), F.lit("all").alias("affected_scope"), F.when(k % 7 == 0, "other").otherwise("ua").alias("user_agent"), version.alias("crawler_version_id"))
    run = F.struct(
        F.when(k % 4 == 0, "QUICK_SCRAPE").otherwise("PRODUCTION_RUN").alias("run_type"),
        F.struct(F.when(ad_hoc, "quick_scrape").otherwise("crawler_version").alias("kind"), version.alias("crawler_version_id"), F.when(k % 5 == 0, "short").otherwise(F.repeat(F.lit("a"), 64)).alias("semantic_config_hash")).alias("configuration"),
        F.array(F.lit("s")).alias("selected_seed_ids"), F.struct(F.struct(F.lit("ua").alias("value")).alias("user_agent")).alias("settings"), robots.alias("robots"), F.lit("me").alias("actor"), F.lit("now").alias("created_at"),
    )
    d = table(spark, sf_dir, "orders").select("o_orderkey", run.alias("run"))
    return d.select("o_orderkey", (F.size(snapshots.violations("run")) == 0).alias("valid"))


@query("""with r as (select o_orderkey as run_id, o_orderkey - 7 as resumes_run_id, o_orderstatus || o_orderpriority as h from orders)
  select a.run_id, a.resumes_run_id, coalesce(a.h = b.h, false) as compatible from r a left join r b on a.resumes_run_id = b.run_id""")
def resume_compatibility(spark, sf_dir):
    k = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select(k.alias("run_id"), (k - 7).alias("resumes_run_id"), F.sha2(F.concat("o_orderstatus", "o_orderpriority"), 256).alias("checkpoint_compatibility_hash"))
    return snapshots.resumable(d, d)


@query("""select o_orderkey, case when o_orderkey % 2 = 0 then '{"decision":"OVERRIDE","reason":"why ' || o_orderkey || '","actor":"me"}' else '{"decision":"RESPECT","actor":"me"}' end as payload from orders""")
def robots_payload(spark, sf_dir):
    none = F.lit(None).cast("string")
    k = F.col("o_orderkey")
    decision = F.struct(F.when(k % 2 == 0, "OVERRIDE").otherwise("RESPECT").alias("decision"), F.concat(F.lit("why "), k.cast("string")).alias("reason"))
    robots = F.struct(decision.alias("decision"), F.lit("me").alias("actor"), *[none.alias(c) for c in ("decided_at", "affected_scope", "user_agent", "crawler_version_id")])
    return table(spark, sf_dir, "orders").select("o_orderkey", robots.alias("robots")).select("o_orderkey", snapshots.robots_payload("robots").alias("payload"))


@query("select o_orderkey as run_id from orders where o_orderkey % 9 = 0")
def snapshot_immutable(spark, sf_dir):
    before = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("snapshot"), F.col("o_orderstatus").alias("status"))
    after = before.withColumns({"snapshot": F.when(F.col("run_id") % 9 == 0, F.col("snapshot") + 1).otherwise(F.col("snapshot")), "status": F.lit("DONE")})
    return snapshots.changed(before, after).select("run_id")


@query("select * from (values ('price', 'TYPE', 'number', 'text'), ('extra', 'MISSING_FIELD', null, 'text'), ('gone', 'MISSING_FIELD', 'text', null), ('name', 'REQUIRED', 'text', 'text')) t(name, mismatch, type, right_type)")
def contract_mismatches(spark, sf_dir):
    left = spark.createDataFrame([("name", "text", True), ("price", "number", False), ("gone", "text", False), ("same", "url", False)], "name string, type string, required boolean")
    right = spark.createDataFrame([("name", "text", False), ("price", "text", False), ("extra", "text", False), ("same", "url", False)], "name string, type string, required boolean")
    return curation.contract_mismatches(left, right)


@query(f"""with {CANONICAL}, known as (select canonical_url, min(page_id) as source_id from canon where page_id % 2 = 0 group by 1)
  select page_id, 'src-' || source_id as source_id from canon left join known using (canonical_url)""")
def source_reuse(spark, sf_dir):
    d = _pages(spark, sf_dir)
    known = d.where("page_id % 2 = 0").groupBy("canonical_url").agg(F.min("page_id").alias("n")).select("canonical_url", F.concat(F.lit("src-"), "n").alias("id"))
    return tables.create_or_reuse(d, known).select("page_id", "source_id")


@query("select o_orderkey, o_orderstatus = 'F' and date_diff('day', o_orderdate, timestamp '1998-01-01') > 30 as expired from orders")
def trash_expiry(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "TRASHED").otherwise("ACTIVE").alias("status"), F.col("o_orderdate").alias("trashed_at"))
    return versioning.trash(d, F.lit("1998-01-01").cast("timestamp")).select("o_orderkey", "expired")


@query("select o_custkey as review_id, count(*) filter (o_orderstatus = 'O') as unresolved, case when count(*) filter (o_orderstatus = 'O') > 0 then 'CLOSED_WITH_UNRESOLVED_ITEMS' else 'CLOSED' end as state from orders group by 1")
def review_close(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("review_id"), F.when(F.col("o_orderstatus") == "O", "NEW_CANDIDATE").otherwise("APPROVED").alias("state"))
    return curation.close_review(items)


@query("select p_partkey, concat_ws(',', case when p_size >= 40 then 'size' end, case when p_retailprice < 0 then 'price' end, case when p_type not in ('ECONOMY', 'STANDARD') then 'type' end, case when (p_type = 'ECONOMY') <> (p_size < 20) then 'coupled' end) as broken from part")
def check_constraints(spark, sf_dir):
    size, type_ = F.col("p_size"), F.col("p_type")
    names = checks.broken(size=size < 40, price=F.col("p_retailprice") >= 0, type=type_.isin("ECONOMY", "STANDARD"), coupled=(type_ == "ECONOMY") == (size < 20))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names, ",").alias("broken"))


@query("select page_id, len(regexp_extract_all(html, '<a href=')) as assets from pages where html like '%.pdf\"%'")
def asset_discovery(spark, sf_dir):
    return extraction.assets(table(spark, sf_dir, "pages").withColumn("url", F.col("page_id").cast("string"))).groupBy(F.col("source_url").cast("long").alias("page_id")).agg(F.count("*").alias("assets"))


@query("""select n_nationkey, case when n_nationkey % 3 = 0 then null else '1234.500000000' end as number, n_nationkey % 2 = 0 as flag, date '2024-01-01' + n_nationkey::int as day from nation""")
def typed_normalization(spark, sf_dir):
    k = F.col("n_nationkey")
    d = table(spark, sf_dir, "nation")
    number = checks.number(F.when(k % 3 == 0, "EUR 5").otherwise(" 1.234,5 "), ",", ".")
    day = checks.timestamp(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), k), "dd/MM/yyyy"), "dd/MM/yyyy")
    return d.select("n_nationkey", number.cast("string").alias("number"), checks.boolean(F.when(k % 2 == 0, "Yes").otherwise("no")).alias("flag"), day.cast("date").alias("day"))


@query("select o_custkey || chr(31) || lower(o_orderpriority) as key, count(*) as rows from orders where o_custkey % 10 <> 0 group by 1 having count(*) > 1")
def normalized_keys(spark, sf_dir):
    k = checks.key((F.when(F.col("o_custkey") % 10 != 0, F.concat(F.lit(" "), F.col("o_custkey").cast("string"))), ("trim",)), (F.col("o_orderpriority"), ("lower",)))
    return curation.duplicate_keys(table(spark, sf_dir, "orders").withColumn("key", k).where("key is not null"), "key").select("key", "rows")


@query("select 'orders' as dataset, count(*) as records, sum(o_totalprice::decimal(18, 2))::double as total, 0::bigint as changed_files from orders where o_orderstatus = 'F'")
def export_manifest(spark, sf_dir):
    """Approved records, written as an export, read again, and its files held against the manifest."""
    d = table(spark, sf_dir, "orders").withColumns({"state": F.when(F.col("o_orderstatus") == "F", "APPROVED").otherwise("DRAFT"), "key": F.col("o_orderkey").cast("string")})
    folder = _folder(spark, "export")
    exports.export(d, folder)
    told, now = spark.read.json(f"{folder}/{exports.COMMIT}"), exports.manifest(spark, f"{folder}/records")
    same = told.join(now.select(F.col("content_hash").alias("h"), F.col("byte_size").alias("b")), (F.col("content_hash") == F.col("h")) & (F.col("byte_size") == F.col("b")), "left_anti").count()
    back = spark.read.schema(d.schema).json(f"{folder}/records").where("state = 'APPROVED'")
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return back.agg(F.lit("orders").alias("dataset"), F.count("*").alias("records"), total.alias("total"), F.lit(same).cast("long").alias("changed_files"))


FORMATS = ("csv", "jsonl", "parquet")


@query("select f as format, o_orderkey, o_orderstatus, o_totalprice::decimal(18, 2)::double as o_totalprice, o_orderpriority from orders, (values ('csv'), ('jsonl'), ('parquet')) t(f)")
def export_formats(spark, sf_dir):
    """All orders, written and read again in each format that many tasks write."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("o_totalprice"), "o_orderpriority")
    out = None
    for kind in FORMATS:
        folder = _folder(spark, f"format-{kind}")
        exports.write(d, folder, kind)
        reader = spark.read.schema(d.schema)
        back = {"csv": lambda r=reader, f=folder: r.option("header", "true").option("escape", '"').csv(f), "jsonl": lambda r=reader, f=folder: r.json(f), "parquet": lambda r=reader, f=folder: r.parquet(f)}[kind]()
        back = back.select(F.lit(kind).alias("format"), *d.columns)
        out = back if out is None else out.unionByName(back)
    return out


@query("select o_orderkey, '## ' || o_orderkey || chr(10) || '- **o_orderstatus**: ' || o_orderstatus || chr(10) || '- **o_orderpriority**: ' || o_orderpriority || chr(10) as value from orders")
def export_markdown(spark, sf_dir):
    """Each order as a piece of Markdown."""
    d = exports.markdown(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))
    return d.select(F.regexp_extract("value", "^## ([0-9]+)", 1).cast("long").alias("o_orderkey"), "value")


@query("select 'nation' as name, count(*) as rows, sum(n_nationkey)::bigint as keys from nation union all select 'orders', count(*), sum(o_orderkey)::bigint from orders")
def backup_restore(spark, sf_dir):
    """Two tables backed up, checked and restored."""
    folder = _folder(spark, "backup")
    exports.backup({n: table(spark, sf_dir, n) for n in ("nation", "orders")}, folder)
    back = exports.restore(spark, folder)
    parts = [back[n].agg(F.lit(n).alias("name"), F.count("*").alias("rows"), F.sum(k).cast("long").alias("keys")) for n, k in (("nation", "n_nationkey"), ("orders", "o_orderkey"))]
    return parts[0].unionByName(parts[1])


@query("select o_orderkey::varchar as entity_id, 'DUPLICATE' as problem from orders where o_orderkey % 100 = 0 union all select l_orderkey::varchar, 'ORPHAN' from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 3 <> 0)")
def integrity_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    log = o.select(F.col("o_orderkey").cast("string").alias("id"))
    again = log.where("cast(id as long) % 100 = 0")
    found = runs.integrity(versioning.repeated_events(log, again), runs.orphans(table(spark, sf_dir, "lineitem"), "l_orderkey", o.where("o_orderkey % 3 <> 0"), "o_orderkey"))
    return found.select("entity_id", F.when(F.col("code") == "CONFLICT", "DUPLICATE").otherwise("ORPHAN").alias("problem"))


@query("select count(*) as conversations, count(*) filter (ok) as complete from (select conv_id, max(turn) - min(turn) + 1 = count(distinct turn) as ok from conversations group by 1)")
def ordered_sequences(spark, sf_dir):
    """Streams whose numbers have no gap."""
    d = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 == F.count_distinct("turn")).alias("ok"))
    return d.agg(F.count("*").alias("conversations"), F.count_if("ok").alias("complete"))


# --- leases, cancellation, life cycles, waiting, reserved names

AT = "timestamp '1996-01-01'"


def _jobs(spark, sf_dir):
    """Orders as jobs: those with status O wait, those with P run under a lease of 60 seconds from their date."""
    none, at, busy = F.lit(None).cast("timestamp"), F.col("o_orderdate").cast("timestamp"), F.col("o_orderstatus") == "P"
    state = F.when(F.col("o_orderstatus") == "O", "QUEUED").when(busy, "RUNNING").otherwise("DONE")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), state.alias("state"), at.alias("scheduled_at"), F.when(busy, F.col("o_custkey") % 5).alias("lease_owner"), F.when(busy, at).otherwise(none).alias("heartbeat_at"),
        F.when(busy, at + F.expr("interval 60 seconds")).otherwise(none).alias("lease_expires_at"), F.lit(1).alias("attempts"), (F.col("o_orderkey") % 4).alias("config_hash"),
    )


@query(f"""with c as (select l_orderkey, min(l_suppkey) as w from lineitem where l_linenumber <= 2 group by 1)
  select o_orderkey as job_id, case when got then 'RUNNING' when o_orderstatus = 'O' then 'QUEUED' when o_orderstatus = 'P' then 'RUNNING' else 'DONE' end as state, case when got then w when o_orderstatus = 'P' then o_custkey % 5 end as lease_owner,
    case when got then {AT} + interval 60 second when o_orderstatus = 'P' then o_orderdate + interval 60 second end as lease_expires_at, case when got then 2 else 1 end as attempts
  from (select *, coalesce(w is not null and o_orderstatus = 'O' and o_orderdate <= {AT}, false) as got from orders left join c on o_orderkey = l_orderkey)""")
def lease_acquire(spark, sf_dir):
    claims = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("worker"))
    return runs.acquire(_jobs(spark, sf_dir), claims, F.expr(AT)).select("job_id", "state", "lease_owner", "lease_expires_at", "attempts")


@query("""with b as (select l_orderkey, l_suppkey % 5 as w, o_orderdate + to_seconds((l_linenumber * 20)::int) as beat from lineitem join orders on l_orderkey = o_orderkey),
  g as (select o_orderkey as k, max(beat) as last from orders join b on o_orderkey = l_orderkey and w = o_custkey % 5 where o_orderstatus = 'P' and beat <= o_orderdate + interval 60 second group by 1)
  select o_orderkey as job_id, coalesce(last, o_orderdate) as heartbeat_at, coalesce(last, o_orderdate) + interval 60 second as lease_expires_at from orders left join g on k = o_orderkey where o_orderstatus = 'P'""")
def lease_heartbeat(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    begun = jobs.select(F.col("job_id").alias("l_orderkey"), F.col("scheduled_at").alias("from"))
    beats = table(spark, sf_dir, "lineitem").join(begun, "l_orderkey").select(F.col("l_orderkey").alias("job_id"), (F.col("l_suppkey") % 5).alias("worker"), F.timestamp_millis(F.unix_millis("from") + F.col("l_linenumber") * 20_000).alias("at"))
    return runs.heartbeat(jobs, beats).where("state = 'RUNNING'").select("job_id", "heartbeat_at", "lease_expires_at")


@query(f"select o_orderkey as job_id, case when o_orderkey % 4 = o_orderkey % 3 then 'RECOVERABLE' else 'FAILED' end as outcome from orders where o_orderstatus = 'P' and o_orderdate + interval 60 second < {AT}")
def lease_recovery(spark, sf_dir):
    saved = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 3).alias("config_hash"))
    return runs.recover(_jobs(spark, sf_dir), saved, F.expr(AT))


@query("""with u as (select l_orderkey, case when l_linenumber = 1 then 'COMPLETED' when l_linenumber = 2 then 'FAILED' when l_linenumber = 3 and l_orderkey % 4 = 0 then 'RUNNING' else 'PENDING' end as s, l_orderkey % 2 = 0 as stopped from lineitem),
  c as (select l_orderkey as run_id, any_value(stopped) as stopped, count(*) filter (s = 'COMPLETED') as completed, count(*) filter (s in ('PENDING', 'RUNNING')) as pending, count(*) filter (s = 'FAILED') as failed, count(*) filter (s = 'RUNNING') as working from u group by 1)
  select run_id, completed, pending, failed, case when stopped and working > 0 then 'CANCELLING' when stopped and pending > 0 then 'CANCELLED' when pending > 0 then 'RUNNING' when failed > 0 then 'PARTIAL_RESULT' else 'COMPLETED' end as status from c""")
def run_cancellation(spark, sf_dir):
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    state = F.when(n == 1, "COMPLETED").when(n == 2, "FAILED").when((n == 3) & (k % 4 == 0), "RUNNING").otherwise("PENDING")
    units = table(spark, sf_dir, "lineitem").select(k.alias("run_id"), n.alias("unit_id"), state.alias("state"))
    stopped = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("cancelled_at"))
    return runs.checkpoint(runs.cancel(units, stopped))


@query("""with a as (select o_custkey as k, max((epoch_us(o_orderdate), o_orderkey)) as m from orders group by 1),
  l as (select k, m[2] % 5 as what, m[2] % 10 < 5 as sure from a)
  select c_custkey as id, case when k is null or what = 4 then s when what = 0 then 'ARCHIVED' when what = 1 then 'TRASHED' when what = 2 then 'ACTIVE' when s = 'TRASHED' and sure then 'DELETED' else s end as status
  from (select c_custkey, case when c_custkey % 2 = 0 then 'TRASHED' else 'ACTIVE' end as s from customer) left join l on k = c_custkey""")
def lifecycle_states(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "TRASHED").otherwise("ACTIVE").alias("status"), F.lit("1992-01-01").cast("timestamp").alias("trashed_at"))
    k, last = F.col("o_orderkey"), Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    orders = table(spark, sf_dir, "orders").withColumn("__n", F.row_number().over(last)).withColumn("at", F.col("o_orderdate") - F.make_dt_interval(hours=F.col("__n")))
    action = F.element_at(F.array(*[F.lit(a) for a in ("ARCHIVE", "TRASH", "RESTORE", "DELETE", "NOTE")]), (k % 5 + 1).cast("int"))
    actions = orders.select(F.col("o_custkey").alias("id"), action.alias("action"), "at", F.when(k % 10 < 5, F.col("o_custkey").cast("string")).otherwise("yes").alias("confirmation"))
    return versioning.lifecycle(rows, actions).select("id", "status")


@query("select o_orderkey as job_id from orders join customer on o_custkey = c_custkey where o_orderstatus = 'O' and c_custkey % 3 = 0")
def trash_disables_jobs(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("crawler_id"), F.when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("DONE").alias("state"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "TRASHED").otherwise("ACTIVE").alias("status"))
    return versioning.disabled_jobs(jobs, rows).select("job_id")


@query("""select 'v' || o_orderkey as id, 'c' || o_custkey as crawler_id, 'DRAFT' as state, '{"status":"' || o_orderstatus || '"}' as semantic_configuration_json, o_orderkey as from_run_id from orders where o_orderstatus = 'F' and o_orderkey % 2 = 0""")
def scrape_drafts(spark, sf_dir):
    done = F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("FAILED")
    scrapes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, "QUICK_SCRAPE").otherwise("TEST_RUN").alias("run_type"), done.alias("status"), F.to_json(F.struct(F.col("o_orderstatus").alias("status"))).alias("configuration_json"))
    return versioning.draft_from_scrape(scrapes, F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("v"), F.col("run_id").cast("string")))


@query("""with p as (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) as host, ('0x' || substr(md5(page_id::varchar), 1, 4))::int % 64 as b,
    case page_id % 7 when 0 then 3000 when 1 then 86400000 when 2 then 250 when 3 then 0 else 250 end as wait from pages)
  select page_id, host, coalesce(sum(greatest(250, wait)) over (partition by host order by b, page_id rows between unbounded preceding and 1 preceding), 0)::bigint as earliest_ms from p""")
def pacing_retry_after(spark, sf_dir):
    k = F.col("page_id") % 7
    header = F.when(k == 0, "3").when(k == 1, "Tue, 02 Jan 1996 00:00:00 GMT").when(k == 2, "soon").when(k == 3, "Sun, 31 Dec 1995 00:00:00 GMT")
    d = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return runs.pacing(d, 250, order=("page_id",), wait_ms=runs.retry_after_ms(header, F.expr(AT)))


@query("select l_orderkey as job_id, l_linenumber, least(1000 * (1 << (l_linenumber - 1)), 20000)::bigint as wait_ms from lineitem")
def retry_backoff(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber", runs.backoff_ms(F.col("l_linenumber"), most=20_000).alias("wait_ms"))


@query("""with p as (select p_partkey, p_partkey % 150 as k, count(*) over (partition by p_partkey % 150) as n from part)
  select count(*) as artifacts, count(*) as paths, (count(distinct k) filter (k <> 3))::bigint as kept_their_id, count(*) - (count(distinct k) filter (k <> 3)) as moved from p""")
def artifact_reservations(spark, sf_dir):
    """Artifacts of which some share an id, and one path is taken by an older one: every path is free, one of each id keeps it."""
    k = F.concat(F.lit("a"), (F.col("p_partkey") % 150).cast("string"))
    placed = artifacts.place(table(spark, sf_dir, "part").select(k.alias("id"), k.alias("was"), "p_partkey", F.lit("parts/x").alias("folder"), F.lit("page one.html").alias("name")), "id", "folder", "name")
    taken = spark.range(1).select(F.lit("parts/x/a3-page_one.html").alias("safe_relative_path"))
    d = artifacts.reserve(placed, "id", taken)
    same = (F.col("id") == F.col("was")) & (F.col("safe_relative_path") == F.concat(F.lit("parts/x/"), "id", F.lit("-page_one.html")))
    ends = F.col("safe_relative_path") == F.concat(F.lit("parts/x/"), "id", F.lit("-page_one.html"))
    return d.agg(F.count("*").alias("artifacts"), F.count_distinct(F.when(ends, F.col("safe_relative_path"))).alias("paths"), F.count_if(same).alias("kept_their_id"), F.count_if(~same).alias("moved"))


@query("select o_orderkey::varchar as file, case o_orderkey % 3 when 0 then 'FILE_REMOVED' when 1 then 'FILE_CHANGED' else 'AVAILABLE' end as status, o_custkey as records from orders")
def export_history(spark, sf_dir):
    k = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders")
    told = d.select(k.cast("string").alias("file"), F.sha2(k.cast("string"), 256).alias("content_hash"), F.col("o_custkey").alias("records"))
    there = d.where(k % 3 != 0).select(k.cast("string").alias("file"), F.sha2(F.when(k % 3 == 1, F.lit("x")).otherwise(k.cast("string")), 256).alias("content_hash"))
    return exports.history(told, there).select("file", "status", "records")


@query("""with p as (select p_partkey % 90 as key, p_brand as brand, p_partkey % 30 as nation from part), c as (select *, count(*) over (partition by key) as n, min(brand) over (partition by key) <> max(brand) over (partition by key) as differs from p)
  select code, severity, count(*) as rows from (select 'DUPLICATE_KEY' as code, 'ERROR' as severity from c where n > 1 union all select 'IDENTITY_CONFLICT', 'ERROR' from c where n > 1 and differs
    union all select 'UNRESOLVED_REFERENCE', 'WARNING' from c where nation not in (select n_nationkey from nation)) group by all""")
def validation_identity(spark, sf_dir):
    k = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select((k % 90).alias("key"), F.col("p_brand").alias("brand"), (k % 30).alias("nation"))
    d = curation.issues(d, [Field("brand")], "key", ("brand",), {"nation": (table(spark, sf_dir, "nation"), "n_nationkey")})
    return d.select(F.explode("issues").alias("i")).groupBy("i.code", "i.severity").agg(F.count("*").alias("rows"))


@query("""select 'WARNING' as severity, 'LOW_COVERAGE' as code, 'note' as field, round(count(*) filter (o_orderkey % 5 = 0) / count(*), 9) as share from orders
  union all select 'WARNING', 'UNUSUAL_DISTRIBUTION', 'grade', round(count(*) filter (o_orderkey % 20 <> 0) / count(*), 9) from orders""")
def dataset_warnings(spark, sf_dir):
    k = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select(F.when(k % 5 == 0, F.concat(F.lit("n"), k.cast("string"))).alias("note"), F.when(k % 20 == 0, "B").otherwise("A").alias("grade"), "o_orderstatus")
    d = curation.dataset_issues(d, ("note", "grade", "o_orderstatus"))
    return d.withColumn("share", F.round("share", 9))


@query("""select o_orderkey, 'CONFLICT' as code, 'order ' || o_orderkey || ' has changed' as message, true as recoverable, 0 as actions from orders where o_orderstatus = 'F'
  union all select o_orderkey, 'NOT_FOUND', 'no order ' || o_orderkey, false, 2 from orders where o_orderstatus = 'P'""")
def error_envelopes(spark, sf_dir):
    k, d = F.col("o_orderkey").cast("string"), table(spark, sf_dir, "orders")
    changed = checks.conflict(F.concat(F.lit("order "), k, F.lit(" has changed")))
    gone = checks.error("NOT_FOUND", F.concat(F.lit("no order "), k), recoverable=False, actions=("reload", "search"))
    rows = d.where("o_orderstatus = 'F'").select("o_orderkey", changed.alias("e")).unionByName(d.where("o_orderstatus = 'P'").select("o_orderkey", gone.alias("e")))
    return rows.select("o_orderkey", "e.code", "e.message", "e.recoverable", F.size("e.suggested_actions").alias("actions"))
