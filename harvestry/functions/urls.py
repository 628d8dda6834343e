"""URLs as column expressions: parts, canonical form, scope and names.

A URL is split by one regular expression instead of ``parse_url``, which raises on what crawled pages contain and keeps the
case of hosts. Everything stays in the JVM; patterns are literals, so each compiles once a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, user information, host, port, path, query, fragment.
PATTERN = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#@]*)@)?([^/?#:@\[\]]+|\[[0-9A-Fa-f:.]+\])(?::([0-9]*))?(/[^?#]*)?(\?[^#]*)?(#.*)?\z"
SCHEMES = ("http", "https")
#: Parameters that only track, by name or beginning of it.
TRACKING_PREFIXES, TRACKING_NAMES = ("utm_",), ("fbclid", "gclid")
#: Schemes that run code or carry data.
DANGEROUS_SCHEMES = ("javascript", "data", "vbscript")
DEFAULT_PORTS = {"http": "80", "https": "443"}


def part(url: Column, group: int) -> Column:
    """A group of PATTERN; empty where it is missing, null for a null URL."""
    return F.regexp_extract(F.trim(url), PATTERN, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    return F.lower(part(url, 3))


def port(url: Column) -> Column:
    """The port as text, empty if it is the scheme's own."""
    p, s = part(url, 4), scheme(url)
    usual = F.lit(False)
    for name, number in DEFAULT_PORTS.items():
        usual = usual | ((s == name) & (p == number))
    return F.when(usual, F.lit("")).otherwise(p)


def path(url: Column) -> Column:
    """The path without dot segments, at least a slash."""
    p = part(url, 5)
    kept = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda out, s: F.when(s == ".", out).when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(s))),
    )
    plain = F.when(p.rlike(r"/\.\.?(/|\z)"), F.concat(F.lit("/"), F.regexp_replace(F.array_join(kept, "/"), r"^/+", ""))).otherwise(p)
    return F.when(p == "", F.lit("/")).otherwise(plain)


def query(url: Column) -> Column:
    """The query without its question mark."""
    return F.substring(part(url, 6), 2, 1 << 30)


def fragment(url: Column) -> Column:
    return F.substring(part(url, 7), 2, 1 << 30)


def is_valid(url: Column) -> Column:
    """True for an absolute web URL; false for null."""
    return F.coalesce(F.trim(url).rlike(PATTERN) & scheme(url).isin(*SCHEMES), F.lit(False))


def is_dangerous(href: Column) -> Column:
    return F.coalesce(F.lower(F.trim(href)).rlike(rf"^({'|'.join(DANGEROUS_SCHEMES)}):"), F.lit(False))


def params(query_: Column) -> Column:
    """Decoded pairs of a query in order, as structs (k, v); pairs without anything are left out."""
    pairs = F.filter(F.split(query_, "&"), lambda x: x != "")
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    return F.transform(pairs, lambda x: F.struct(decode(F.regexp_extract(x, "^([^=]*)", 1)).alias("k"), decode(F.regexp_extract(x, "^[^=]*=(.*)\\z", 1)).alias("v")))


def normalized(url: Column) -> Column:
    """The parsed form that equality of URLs is decided on: case of scheme and host, default port, dot segments, slash."""
    p = port(url)
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(p != "", F.concat(F.lit(":"), p)).otherwise(F.lit("")), path(url), part(url, 6), part(url, 7))


@dataclass(frozen=True)
class CanonicalPolicy:
    """How URLs become canonical.

    Parameters are sorted by name and value, repeated ones stay; tracking parameters and those in ``drop`` go, unless ``keep``
    names them. One trailing slash goes except from the root. Schemes and www hosts are not merged.
    """

    drop_fragment: bool = True
    strip_slash: bool = True
    drop_tracking: bool = True
    drop: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    only: tuple[str, ...] = field(default=())


def canonical(url: Column, policy: CanonicalPolicy = CanonicalPolicy()) -> Column:
    """The canonical form; null where the URL is not a valid web URL."""
    name = lambda x: F.regexp_extract(x, "^([^=]*)", 1)

    def stays(x: Column) -> Column:
        n = F.lower(name(x))
        gone = F.lit(False)
        if policy.drop_tracking:
            for prefix in TRACKING_PREFIXES:
                gone = gone | n.startswith(prefix)
            gone = gone | n.isin(*TRACKING_NAMES)
        if policy.drop:
            gone = gone | name(x).isin(*policy.drop)
        if policy.keep:
            gone = gone & ~name(x).isin(*policy.keep)
        if policy.only:
            gone = gone | ~name(x).isin(*policy.only)
        return ~gone & (x != "")

    pairs = F.filter(F.split(query(url), "&"), stays)
    ordered = F.transform(F.array_sort(F.transform(pairs, lambda x: F.struct(name(x).alias("k"), x.alias("p")))), lambda s: s.p)
    q = F.array_join(ordered, "&")
    p = path(url)
    if policy.strip_slash:
        p = F.when(F.length(p) > 1, F.regexp_replace(p, "/\\z", "")).otherwise(p)
    own = port(url)
    out = F.concat(scheme(url), F.lit("://"), host(url), F.when(own != "", F.concat(F.lit(":"), own)).otherwise(F.lit("")), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    if not policy.drop_fragment:
        out = F.concat(out, part(url, 7))
    return F.when(is_valid(url), out)


def resolve(href: Column, base: Column) -> Column:
    """href as an absolute URL on the page at base: absolute, scheme-relative, rooted, query, fragment and relative forms."""
    origin = F.concat(scheme(base), F.lit("://"), part(base, 3), F.when(part(base, 4) != "", F.concat(F.lit(":"), part(base, 4))).otherwise(F.lit("")))
    h = F.trim(href)
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    joined = (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(origin, path(base), h))
        .when(h.startswith("#"), F.concat(origin, path(base), part(base, 6), h))
        .when(h == "", F.concat(origin, path(base), part(base, 6)))
        .otherwise(F.concat(origin, folder, h))
    )
    # bound once: the parts of the result are read many times
    return F.get(F.transform(F.array(joined), lambda x: F.when(x.rlike(PATTERN), normalized(x)).otherwise(x)), F.lit(0))


def registrable_domain(host_: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """The last two labels of a host, or three under a two-label public suffix that is given."""
    labels = F.split(host_, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), n), ".")
    return F.when(last(2).isin(*suffixes), last(3)).otherwise(last(2)) if suffixes else last(2)


def in_scope(host_: Column, mode: str, domains: tuple[str, ...], blocked: tuple[str, ...] = ()) -> Column:
    """Whether a host is in scope. mode: seed_domains (the hosts themselves), registrable (and their subdomains), allowlist, allow_block."""
    under = lambda names: F.exists(F.array(*[F.lit(x) for x in names]), lambda d: (host_ == d) | host_.endswith(F.concat(F.lit("."), d))) if names else F.lit(False)
    if mode == "seed_domains":
        return host_.isin(*domains)
    if mode in ("registrable", "allowlist"):
        return under(domains)
    if mode == "allow_block":
        return (under(domains) if domains else F.lit(True)) & ~under(blocked)
    raise ValueError(f"no scope mode {mode!r}")


def trimmed(text: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(text, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


def source_name(title: Column, og_title: Column, url: Column) -> Column:
    """A page's title, else its social title, else host and path, else the host, else a stock name."""
    own = lambda x: F.when(trimmed(x) != "", trimmed(x))
    h, p = host(url), F.regexp_replace(path(url), "^/+|/+\\z", "")
    return F.coalesce(own(title), own(og_title), F.when((h != "") & (p != ""), F.concat(h, F.lit("/"), p)).when(h != "", h), F.lit("Untitled Source"))


def dataset_name(source: Column, page_type: Column) -> Column:
    return trimmed(F.concat(trimmed(source), F.lit(" "), trimmed(page_type)))


def redacted(url: Column) -> Column:
    """A URL for logs: no query, no user information, no fragment."""
    bare = F.concat(scheme(url), F.lit("://"), host(url), path(url))
    return F.when(part(url, 6) != "", F.concat(bare, F.lit("?[redacted]"))).otherwise(bare)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+\\z", "")


def export_name(name: Column, date: Column, id_: Column) -> Column:
    return F.concat_ws("-", slug(name), F.date_format(date, "yyyy-MM-dd"), F.substring(id_, 1, 8))


def table_name(collection: Column, dataset: Column) -> Column:
    return F.concat_ws("__", F.regexp_replace(slug(collection), "-", "_"), F.regexp_replace(slug(dataset), "-", "_"))
