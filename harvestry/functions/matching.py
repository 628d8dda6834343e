"""URL matchers and page types compiled to column expressions.

Definitions are small and known when a plan is made: each matcher's specificity is computed once on the driver and enters
the plan as a literal, each predicate is evaluated once a row, and resolving a page type is a projection without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.functions import urls

# Kinds of matchers by rank.
RANKS = {"ExactUrl": 4, "ExactHostPathTemplate": 3, "PathPrefix": 2, "PathGlob": 2, "Regex": 1}
#: Constructs of Java's patterns that matchers do not have.
FOREIGN = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|[*+?}]\+")


@dataclass(frozen=True)
class Matcher:
    """One rule for URLs. pattern: the URL, path template, prefix, glob or regular expression."""

    kind: str
    pattern: str
    host: str | None = None
    query: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        if self.kind not in RANKS:
            raise ValueError(f"no matcher kind {self.kind!r}")
        if self.kind == "PathGlob" and not self.pattern:
            raise ValueError("a glob must not be empty")
        if self.kind == "ExactUrl" and not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]", self.pattern):
            raise ValueError(f"not an absolute URL: {self.pattern!r}")
        if self.kind == "ExactHostPathTemplate" and not self.host:
            raise ValueError("a template needs a host")
        if self.kind == "Regex":
            if FOREIGN.search(self.pattern):
                raise ValueError(f"look-around, back references and possessive repeats are not allowed: {self.pattern!r}")
            try:
                re.compile(self.pattern)
            except re.error as e:
                raise ValueError(f"not a regular expression: {self.pattern!r}") from e

    @property
    def label(self) -> str:
        return f"{self.host}{self.pattern}" if self.kind == "ExactHostPathTemplate" else self.pattern

    @property
    def specificity(self) -> tuple[int, int, int, int, int]:
        """Rank, literal segments, query constraints, literal characters, and the wildcards negated: larger is more specific."""
        text = (urlsplit(self.pattern).path or "/") if self.kind == "ExactUrl" else self.pattern
        segments = sum(1 for s in text.split("/") if s and not set(s) & set("*{("))
        pairs = len(parse_qsl(urlsplit(self.pattern).query, keep_blank_values=True)) if self.kind == "ExactUrl" else len(self.query) if self.kind == "ExactHostPathTemplate" else 0
        letters = sum(1 for c in text if c.isascii() and c.isalnum())
        return RANKS[self.kind], segments, pairs, letters, -sum(text.count(c) for c in "*{(")

    def matches(self, url: Column) -> Column:
        """Whether a URL, as text, matches; never null."""
        path = urls.path(url)
        on_host = F.lit(True) if self.host is None else urls.host(url) == self.host.lower()
        if self.kind == "ExactUrl":
            found = urls.normalized(url) == urls.normalized(F.lit(self.pattern))
        elif self.kind == "ExactHostPathTemplate":
            parts = [s for s in self.pattern.split("/") if s]
            each = "".join("/+" + ("[^/]+" if s.startswith("{") and s.endswith("}") else re.escape(s)) for s in parts)
            found = on_host & path.rlike(f"^{each}/*\\z")
            if self.query:
                have = urls.params(urls.query(url))
                for pair in self.query:
                    found = found & F.array_contains(have, F.struct(F.lit(pair[0]).alias("k"), F.lit(pair[1]).alias("v")))
        elif self.kind == "PathPrefix":
            found = on_host & path.startswith(self.pattern)
        elif self.kind == "PathGlob":
            found = on_host & path.rlike("^" + ".*".join(re.escape(x) for x in self.pattern.split("*")) + "\\z")
        else:
            found = urls.normalized(url).rlike(re.sub(r"(?<!\\)\$$", r"\\z", self.pattern))
        return F.coalesce(found, F.lit(False))

    def to_row(self) -> dict:
        return {"kind": self.kind, "host": self.host, "pattern": self.pattern, "query": dict(self.query)}

    @staticmethod
    def from_row(row: dict) -> Matcher:
        """The matcher of a stored row, validated again."""
        return Matcher(row["kind"], row["pattern"], row.get("host"), tuple(sorted((row.get("query") or {}).items())))


@dataclass(frozen=True)
class PageType:
    page_type_id: str
    name: str
    priority: int = 0
    matchers: tuple[Matcher, ...] = field(default=())


_KEY = "struct<priority:int,rank:int,segments:int,query:int,characters:int,wildcards:int>"


def resolve_page_type(url: Column, page_types: list[PageType]) -> Column:
    """struct(decision, page_type_id, name, candidates): Matched, Ambiguous or Unmatched.

    Of a type, the most specific matcher that matches stands for it; of the types, priority counts first and specificity
    next; whoever shares the top is a candidate. Candidates are in the order of name, patterns and id.
    """

    def candidate(t: PageType) -> Column:
        by_key: dict[tuple, list[Matcher]] = {}
        for m in t.matchers:
            by_key.setdefault(m.specificity, []).append(m)
        out = F.lit(None)
        for k in sorted(by_key):  # the most specific is tested first, so it comes last here
            tests = [(m.label, m.matches(url)) for m in by_key[k]]
            found = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(test, F.lit(label)) for label, test in tests]), lambda x: x.isNotNull())))
            some = tests[0][1]
            for _, test in tests[1:]:
                some = some | test
            key = F.struct(*[F.lit(x).cast("int").alias(n) for n, x in zip(("priority", "rank", "segments", "query", "characters", "wildcards"), (t.priority, *k), strict=True)])
            kind = by_key[k][0].kind
            kind = "PathPrefixOrGlob" if kind in ("PathPrefix", "PathGlob") else kind
            own = F.struct(F.lit(t.name).alias("name"), found.alias("patterns"), F.lit(t.page_type_id).alias("page_type_id"), F.lit(t.priority).alias("priority"), F.lit(kind).alias("kind"), key.alias("key"))
            out = F.when(some, own).otherwise(out)
        return out

    used = [t for t in page_types if t.matchers]
    none = f"array<struct<name:string,patterns:array<string>,page_type_id:string,priority:int,kind:string,key:{_KEY}>>"
    if not used:
        return F.struct(F.lit("Unmatched").alias("decision"), F.lit(None).cast("string").alias("page_type_id"), F.lit(None).cast("string").alias("name"), F.array().cast(none).alias("candidates"))
    found = F.filter(F.array(*[candidate(t) for t in used]), lambda c: c.isNotNull())
    best = F.transform(F.array(found), lambda cs: F.filter(cs, lambda c: c.key == F.array_max(F.transform(cs, lambda x: x.key))))
    chosen = F.array_sort(F.get(best, F.lit(0)))
    return F.get(
        F.transform(
            F.array(chosen),
            lambda c: F.struct(
                F.when(F.size(c) == 0, "Unmatched").when(F.size(c) == 1, "Matched").otherwise("Ambiguous").alias("decision"),
                F.when(F.size(c) == 1, F.get(c, F.lit(0)).page_type_id).alias("page_type_id"),
                F.when(F.size(c) == 1, F.get(c, F.lit(0)).getField("name")).alias("name"),
                c.alias("candidates"),
            ),
        ),
        F.lit(0),
    )


def classify(df: DataFrame, url: str, page_types: list[PageType]) -> DataFrame:
    """df with the column ``resolved``. The rules are evaluated over whatever column the URLs are in; no shuffle."""
    return df.withColumn("resolved", resolve_page_type(F.col(url), page_types))
