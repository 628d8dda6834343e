"""Discovering URLs: links of pages, the staged pipeline with a status for every link, the frontier, and its reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry.functions import urls
from harvestry.functions.matching import PageType, resolve_page_type
from harvestry.sources.staging import staged

#: Statuses by precedence: the first stage that stops a link names it.
INVALID, BLOCKED, EXTERNAL, DUPLICATE, COMPLETED, UNMATCHED, AMBIGUOUS, NO_TRANSITION, BUDGET, ENQUEUED = (
    "INVALID_URL", "BLOCKED", "EXTERNAL", "DUPLICATE", "ALREADY_COMPLETED", "UNMATCHED", "AMBIGUOUS_PAGE_TYPE", "NO_ELIGIBLE_TRANSITION", "BUDGET_EXCLUDED", "ENQUEUED",
)
ANCHOR = r"""(?is)<a\b([^>]*?\bhref\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)[^>]*)>(.*?)(?=</a>|<a\b|\z)"""
HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
NEXT_WORDS = r"(?i)^\s*(next|older|more|load more|weiter|suivant|siguiente|[0-9]{1,4}|»|›|>)\s*$"


def links(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row an anchor with an href, in page order: keep, source_url, position, raw_href, anchor_text, rel_next."""
    bare = F.regexp_replace(F.regexp_replace(F.col(html), "(?is)<!--.*?-->", ""), "(?is)<(script|style)\\b.*?</\\1\\s*>", "")
    found = F.arrays_zip(F.regexp_extract_all(bare, F.lit(ANCHOR), F.lit(1)).alias("attributes"), F.regexp_extract_all(bare, F.lit(ANCHOR), F.lit(2)).alias("inner"))
    out = pages.select(*keep, F.col(url).alias("source_url"), F.posexplode(found).alias("position", "__a"))
    raw = F.concat(*[F.coalesce(F.regexp_extract("__a.attributes", HREF, i), F.lit("")) for i in (1, 2, 3)])
    text = F.trim(F.regexp_replace(F.regexp_replace("__a.inner", "<[^>]*>", " "), r"\s+", " "))
    return out.select(*keep, "source_url", "position", F.replace(raw, F.lit("&amp;"), F.lit("&")).alias("raw_href"), text.alias("anchor_text"), F.col("__a.attributes").rlike(r"(?i)\brel\s*=\s*[\"']?[^\"'>]*\bnext\b").alias("rel_next"))


def is_pagination(raw_href: Column, text: Column, rel_next: Column) -> Column:
    """Whether a link looks like one to another page of a list."""
    return F.coalesce(rel_next | text.rlike(NEXT_WORDS) | raw_href.rlike(r"(?i)[?&](page|p|offset|start)=\d+|/page/\d+/?$"), F.lit(False))


@dataclass(frozen=True)
class Transition:
    """An edge between page types."""

    transition_id: str
    source: str
    target: str
    priority: int = 0
    enabled: bool = True
    max_links_per_page: int = 1 << 30
    total_budget: int = 1 << 40
    depth: int = 1
    deduplicate: bool = True
    pattern: str | None = None

    def __post_init__(self):
        if self.max_links_per_page <= 0:
            raise ValueError("a transition needs room for a link per page")


@dataclass(frozen=True)
class Scope:
    mode: str
    domains: tuple[str, ...]
    blocked: tuple[str, ...] = ()


def first_seen(df: DataFrame, key: str, order: list) -> DataFrame:
    """df with is_duplicate: false for the first row of each key by a total order; rows without a key are no duplicates.

    The first is a grouped minimum, combined before the shuffle, and joined back: a key with very many rows is no window.
    """
    rank = F.struct(*[F.col(c) for c in order])
    first = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min(rank).alias("__first"))
    joined = df.join(first, F.col(key) == F.col("__k"), "left")
    return joined.withColumn("is_duplicate", F.coalesce(F.col("__first") != rank, F.lit(False))).drop("__k", "__first")


def classify_links(
    found: DataFrame, page_types: list[PageType], transitions: list[Transition], scope: Scope, policy: urls.CanonicalPolicy = urls.CanonicalPolicy(),
    completed: DataFrame | None = None, robots: tuple[str, ...] = (),
) -> DataFrame:
    """Every link with resolved and canonical URL, page types, transition, depth and one status; no row is dropped.

    found: source_url, position, raw_href, optionally depth. completed: canonical_url of pages done before. robots: path
    prefixes that may not be crawled. Budgets take links in the order of priority, source and position. Links that agree in
    both (a page that was fetched twice) are told apart by the other columns of found, so one of them is first, and only one.
    """
    depth = F.col("depth") if "depth" in found.columns else F.lit(0)
    own = [f.name for f in found.schema if f.name not in ("depth", "source_url", "position", "raw_href") and "map<" not in f.dataType.simpleString()]
    ties = ("original_url", *own, "__row")
    href = F.col("raw_href")
    d = found.withColumn("original_url", urls.resolve(href, F.col("source_url")))
    d = d.withColumns({"canonical_url": urls.canonical(F.col("original_url"), policy), "__from": urls.canonical(F.col("source_url"), policy)})
    d = staged(d.withColumn("__row", F.monotonically_increasing_id()), "links")  # read for the source's and the target's type, and short from here on
    d = d.withColumns({"target": resolve_page_type(F.col("canonical_url"), page_types), "source": resolve_page_type(F.col("__from"), page_types)})
    usable = [t for t in transitions if t.enabled]
    best = F.lit(None).cast("struct<id:string,priority:int,depth:int,links:long,budget:long,unique:boolean>")
    for t in sorted(usable, key=lambda t: (t.priority, t.transition_id)):
        fits = (F.col("source.page_type_id") == t.source) & (F.col("target.page_type_id") == t.target)
        if t.pattern:
            fits = fits & F.col("canonical_url").rlike(t.pattern)
        this = F.struct(F.lit(t.transition_id).alias("id"), F.lit(t.priority).alias("priority"), F.lit(t.depth).alias("depth"), F.lit(t.max_links_per_page).cast("long").alias("links"), F.lit(t.total_budget).cast("long").alias("budget"), F.lit(t.deduplicate).alias("unique"))
        best = F.when(fits, this).otherwise(best)
    d = d.withColumn("transition", best)
    valid = ~urls.is_dangerous(href) & F.col("canonical_url").isNotNull()
    shut = F.lit(False)
    for prefix in robots:
        shut = shut | urls.path(F.col("canonical_url")).startswith(prefix)
    inside = urls.in_scope(urls.host(F.col("canonical_url")), scope.mode, scope.domains, scope.blocked)
    barred = urls.in_scope(urls.host(F.col("canonical_url")), "allowlist", scope.blocked) if scope.blocked else F.lit(False)
    early = F.when(urls.is_dangerous(href), BLOCKED).when(~valid, INVALID).when(shut | barred, BLOCKED).when(~inside, EXTERNAL)
    d = staged(d.withColumn("__early", early).withColumn("depth", depth), "typed").withColumn("__key", F.when(F.col("__early").isNull() & F.coalesce(F.col("transition.unique"), F.lit(True)), F.col("canonical_url")))
    d = first_seen(d, "__key", ["depth", "source_url", "position", *ties])
    if completed is not None:
        done = completed.select(F.col("canonical_url").alias("__done")).distinct()
        d = d.join(done, F.col("canonical_url") == F.col("__done"), "left")
    else:
        d = d.withColumn("__done", F.lit(None).cast("string"))
    late = (
        F.when(F.col("__early").isNotNull(), F.col("__early")).when(F.col("is_duplicate"), DUPLICATE).when(F.col("__done").isNotNull(), COMPLETED)
        .when(F.col("target.decision") == "Unmatched", UNMATCHED).when(F.col("target.decision") == "Ambiguous", AMBIGUOUS).when(F.col("transition").isNull(), NO_TRANSITION)
    )
    d = staged(d.withColumn("__status", late), "statuses")  # ranked and counted by the budget
    d = budget(d, ties, digits=2)
    return d.select(
        *[c for c in found.columns if c != "depth"], "original_url", "canonical_url", F.col("source.page_type_id").alias("source_page_type"), F.col("target.page_type_id").alias("target_page_type"),
        F.col("target.decision").alias("decision"), F.col("transition.id").alias("transition_id"), (F.col("depth") + F.coalesce("transition.depth", F.lit(0))).cast("int").alias("depth"), "status",
    )


def budget(d: DataFrame, ties: tuple[str, ...] = ("original_url",), digits: int = 3) -> DataFrame:
    """Status of links that nothing else stopped: within the links of a page and the total of the transition, or not.

    The total is taken in two steps. Running numbers within a bucket of sources, on top of the buckets' sums before, rank the
    links of a transition without gathering them all in one task. Buckets are the first hex digits of the source's MD5: sources
    are in the order of these, then of their URLs. ties: columns that order links of one source and position.
    """
    # links that another stage has stopped take no part, nor do links beyond their page's share rank with the others
    per_page = Window.partitionBy("source_url", F.col("transition.id")).orderBy("position", *ties)
    d_open = d.where(F.col("__status").isNull()).withColumn("__fits", F.row_number().over(per_page) <= F.col("transition.links"))
    # buckets in the order of sources, by a hash prefix, so that ranks depend on the rows alone
    d_open = d_open.withColumn("__bucket", F.substring(F.md5("source_url"), 1, digits))
    counts = d_open.where("__fits").groupBy(F.col("transition.id").alias("__t"), F.col("__bucket").alias("__b")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__t").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("__t", "__b", before.alias("__base"))
    within = Window.partitionBy(F.col("transition.id"), "__fits", "__bucket").orderBy("source_url", "position", *ties)
    d_open = d_open.withColumn("__rank", F.row_number().over(within))
    d_open = d_open.join(bases, (F.col("transition.id") == F.col("__t")) & (F.col("__bucket") == F.col("__b")), "left")
    ok = F.col("__fits") & (F.col("__rank") + F.coalesce("__base", F.lit(0)) <= F.col("transition.budget"))
    told = d_open.withColumn("status", F.when(ok, ENQUEUED).otherwise(BUDGET)).select(*d.columns, "status")
    return told.unionByName(d.where(F.col("__status").isNotNull()).withColumn("status", F.col("__status")))


def frontier(seeds: DataFrame, edges: DataFrame, max_depth: int, max_pages: int, save=None) -> DataFrame:
    """(canonical_url, depth, parent, path) for all that the seeds reach: breadth first, each URL once, cycles allowed.

    seeds: canonical_url. edges: source_url, target_url, depth (what the step costs, at least 1). Each step is written by
    ``save`` (default: staged), so plans stay short and an executor may be lost.
    """
    save = save or (lambda df: staged(df, "frontier"))
    empty = F.array().cast("array<string>")
    seen = save(seeds.select("canonical_url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), empty.alias("path")).distinct())
    new = seen
    for at in range(max_depth):
        step = new.join(edges, new["canonical_url"] == edges["source_url"])
        cost = edges["depth"] if "depth" in edges.columns else F.lit(1)
        step = step.select(F.col("target_url").alias("canonical_url"), (new["depth"] + cost).cast("int").alias("depth"), F.col("source_url").alias("parent"), F.concat("path", F.array("source_url")).alias("path"))
        best = step.where(F.col("depth") <= max_depth).groupBy("canonical_url").agg(F.min(F.struct("depth", "parent", "path")).alias("b")).select("canonical_url", "b.*")
        new = save(best.join(seen.select(F.col("canonical_url").alias("__s")), F.col("canonical_url") == F.col("__s"), "left_anti"))
        room = max_pages - seen.count()
        found = new.count()
        if not found or room <= 0:
            break
        if found > room:  # the first of the step by name
            new = save(new.orderBy("depth", "canonical_url").limit(room))
        seen = save(seen.unionByName(new))
    return seen


def preview(statuses: DataFrame) -> DataFrame:
    """One row of totals over classified links."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    return statuses.agg(
        F.count_distinct("source_url").alias("pages_sampled"), F.count("*").alias("links_found"), F.count_distinct("canonical_url").alias("canonical_urls"), count(DUPLICATE).alias("duplicates_prevented"),
        count(AMBIGUOUS).alias("ambiguous"), count(UNMATCHED).alias("unmatched"), count(EXTERNAL).alias("external"), count(BLOCKED).alias("blocked"), count(BUDGET).alias("budget_hits"), count(ENQUEUED).alias("enqueued"),
    )


def growth(statuses: DataFrame, by: str = "transition_id", warn: float = 0.8) -> DataFrame:
    """(by, links, share, warning): which transition brings most of the URLs."""
    grouped = statuses.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("links"))
    total = grouped.agg(F.sum("links")).first()[0] or 1
    share = F.col("links") / F.lit(total)
    return grouped.select(by, "links", share.alias("share"), (share > warn).alias("warning"))


def query_explosion(found: DataFrame, url: str = "canonical_url", warn: int = 100) -> DataFrame:
    """Paths with their numbers of different queries."""
    place = F.concat(urls.host(F.col(url)), urls.path(F.col(url)))
    return found.select(place.alias("page_path"), urls.query(F.col(url)).alias("q")).groupBy("page_path").agg(F.count_distinct("q").alias("queries")).withColumn("warning", F.col("queries") > warn)


def robots_rules(text: str, agent: str) -> tuple[tuple[tuple[str, bool], ...], float | None]:
    """((path prefix, allowed), ...) and the crawl delay of a robots file for an agent; the agent's group before the general one."""
    groups: dict[str, list] = {}
    delays: dict[str, float] = {}
    now, fresh = [], True
    for line in text.splitlines():
        name, _, value = line.partition("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            now = now if not fresh else []
            now = [*now, value.lower()]
            fresh = False
            groups.setdefault(value.lower(), [])
        elif name in ("allow", "disallow") and now:
            fresh = True
            for a in now:
                if value:
                    groups[a].append((value, name == "allow"))
        elif name == "crawl-delay" and now:
            fresh = True
            for a in now:
                delays[a] = float(value) if value.replace(".", "", 1).isdigit() else 0.0
    own = next((a for a in sorted(groups, key=len, reverse=True) if a != "*" and a in agent.lower()), "*")
    return tuple(groups.get(own, ())), delays.get(own)


def robots_allows(path: Column, rules: tuple[tuple[str, bool], ...]) -> Column:
    """The longest rule that a path begins with decides, allow before disallow."""
    out = F.lit(True)
    for prefix, allowed in sorted(rules, key=lambda r: (len(r[0]), r[1])):
        out = F.when(path.startswith(prefix), F.lit(allowed)).otherwise(out)
    return out
