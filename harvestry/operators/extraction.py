"""Extracting typed records from pages by selectors, and what helps to choose these."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry.functions import checks, html

TITLE, OG_TITLE = r"(?is)<title[^>]*>(.*?)</title>", r"""(?is)<meta[^>]*property=["']og:title["'][^>]*content=["']([^"']*)["']"""
# Extensions by kind, and content types by extension.
FILE_TYPES = {"pdf": "application/pdf", "zip": "application/zip", "csv": "text/csv", "json": "application/json", "xml": "application/xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "mp4": "video/mp4", "mp3": "audio/mpeg"}
RECORDS_FROM = 3


@dataclass(frozen=True)
class FieldRule:
    """Where a field is: selectors by preference, the source of the value, its type and notation."""

    name: str
    selectors: tuple[str, ...]
    source: str = "text"
    type: str = "text"
    format: str = ""


def extract(pages: DataFrame, fields: list[FieldRule], container: str | None = None, url: str = "url", source: str = "html", page: str | None = None) -> DataFrame:
    """One row a record: url, record_no, and for each field <name>_raw and <name>_selector; a page is one record without a container.

    record_no counts within a page. With ``page``, a column that orders the pages of one URL (which may be fetched more than
    once), it counts within the URL, by place on the page and then by page, so that url and record_no are a key.
    """
    rules = [(f.name, f.selectors, f.source) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(2 + 2 * len(rules))]
            rows: list[int] = []
            for row, (page_url, text) in enumerate(zip(*[c.to_pylist() for c in b.columns[:2]], strict=True)):
                root = html.parse(text)
                for i, node in enumerate(html.select(root, container) if container else [root]):
                    out[0].append(page_url), out[1].append(i), rows.append(row)
                    for k, (_, selectors, kind) in enumerate(rules):
                        found = next(((n[0], s) for s in selectors if (n := html.select(node, s))), (None, None))
                        out[2 + 2 * k].append(html.value(found[0], kind, page_url or "")), out[3 + 2 * k].append(found[1])
            types = [pa.string(), pa.int32()] + [pa.string()] * (2 * len(rules))
            own = [c.take(pa.array(rows, pa.int32())) for c in b.columns[2:]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(out, types, strict=True)], *own], [*names, *b.schema.names[2:]])

    names = ["url", "record_no"] + [f"{f.name}_{x}" for f in fields for x in ("raw", "selector")]
    schema = "url string, record_no int, " + ", ".join(f"`{n}` string" for n in names[2:])
    read = [F.col(url).alias("url"), F.col(source).alias("html")]
    if page is None:
        return pages.select(*read).mapInArrow(run, schema)
    found = pages.select(*read, F.col(page).alias("__page")).mapInArrow(run, f"{schema}, __page {dict(pages.dtypes)[page]}")
    within = Window.partitionBy("url").orderBy("record_no", "__page", *names[2:])
    return found.withColumn("record_no", F.row_number().over(within) - 1).drop("__page")


def typed(records: DataFrame, fields: list[FieldRule]) -> DataFrame:
    """records with a typed column for each field beside its raw text; what does not fit the type is null."""
    convert = {
        "text": lambda c, f: c, "rich_text": lambda c, f: c, "raw_html": lambda c, f: c, "number": lambda c, f: checks.number(c, *(f.split() or (".", ","))), "boolean": lambda c, f: checks.boolean(c),
        "datetime": lambda c, f: checks.timestamp(c, f or "yyyy-MM-dd"), "url": lambda c, f: checks.canonical(c), "image_url": lambda c, f: checks.canonical(c),
    }
    return records.withColumns({f.name: convert[f.type](F.col(f"{f.name}_raw"), f.format) for f in fields})


def titles(page_html: Column) -> tuple[Column, Column]:
    """The title and the social title of a page, white space squeezed."""
    own = lambda p: checks.squeezed(F.regexp_extract(page_html, p, 1))
    return own(TITLE), own(OG_TITLE)


def assets(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(source_url, asset_url, kind, status) for images and linked files; URL_ONLY until something downloads them."""
    from harvestry.functions.urls import resolve

    images = F.transform(F.regexp_extract_all(F.col(source), F.lit(r"""(?is)<img\b[^>]*\bsrc\s*=\s*["']([^"']+)["']"""), F.lit(1)), lambda x: F.struct(x.alias("href"), F.lit("IMAGE").alias("kind")))
    files = F.filter(F.regexp_extract_all(F.col(source), F.lit(r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']+)["']"""), F.lit(1)), lambda x: extension(x).isin(*FILE_TYPES))
    files = F.transform(files, lambda x: F.struct(x.alias("href"), F.lit("FILE").alias("kind")))
    out = pages.select(F.col(url).alias("source_url"), F.explode(F.concat(images, files)).alias("a"))
    return out.select("source_url", resolve(F.col("a.href"), F.col("source_url")).alias("asset_url"), "a.kind", F.lit("URL_ONLY").alias("status"))


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(url, "[?#].*", ""), r"\.([A-Za-z0-9]{1,5})\z", 1))


def type_mismatch(url: Column, content_type: Column) -> Column:
    """Whether a content type is not that of the extension; false where either is not known."""
    usual = F.create_map(*[F.lit(x) for kv in FILE_TYPES.items() for x in kv])[extension(url)]
    return F.coalesce(F.lower(F.split_part(content_type, F.lit(";"), F.lit(1))) != usual, F.lit(False))


def intake(url: Column, content_type: Column) -> Column:
    """FILE_ASSET for what is surely no page, else WEB_PAGE."""
    sure = F.coalesce(~F.lower(content_type).rlike("html|^text/plain|^$"), extension(url).isin(*FILE_TYPES))
    return F.when(F.coalesce(sure, F.lit(False)), "FILE_ASSET").otherwise("WEB_PAGE")


def mode(pages: DataFrame, source: str = "html", least: int = RECORDS_FROM) -> DataFrame:
    """pages with ``mode``: RECORDS where some structure repeats, DOCUMENT elsewhere; advice only."""

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([html.repeated(t) for t in texts.to_pylist()], pa.int32())

    return pages.withColumn("repeats", count(F.col(source))).withColumn("mode", F.when(F.col("repeats") >= least, "RECORDS").otherwise("DOCUMENT"))


def preview(pages: DataFrame, source: str = "html") -> DataFrame:
    """pages with ``preview_html``, safe to show."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([html.sanitized(t or "") for t in texts.to_pylist()], pa.string())

    return pages.withColumn("preview_html", clean(F.col(source)))


def structure(pages: DataFrame, source: str = "html") -> DataFrame:
    """pages with ``tag_paths`` and their ``fingerprint``."""

    @F.arrow_udf("array<string>")
    def paths(texts: pa.Array) -> pa.Array:
        return pa.array([html.fingerprint(t or "") for t in texts.to_pylist()], pa.list_(pa.string()))

    return pages.withColumn("tag_paths", paths(F.col(source))).withColumn("fingerprint", F.sha2(F.array_join("tag_paths", "\n"), 256))


def divergence(a: Column, b: Column) -> Column:
    """1 - Jaccard similarity of two sets of tag paths."""
    return 1 - F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def suggestions(pages: DataFrame, source: str = "html", least: float = 0.5) -> DataFrame:
    """(selector, pages, coverage, rank): classes, ids and data attributes on many pages, the stable ones first."""
    total = pages.count()
    found = F.array_distinct(
        F.concat(
            F.transform(F.regexp_extract_all(F.col(source), F.lit(r"""(?i)\bclass\s*=\s*["']([\w-]+)"""), F.lit(1)), lambda x: F.concat(F.lit("."), x)),
            F.transform(F.regexp_extract_all(F.col(source), F.lit(r"""(?i)\bid\s*=\s*["']([\w-]+)"""), F.lit(1)), lambda x: F.concat(F.lit("#"), x)),
            F.transform(F.regexp_extract_all(F.col(source), F.lit(r"""(?i)\s(data-[\w-]+)\s*="""), F.lit(1)), lambda x: F.concat(F.lit("["), x, F.lit("]"))),
        )
    )
    out = pages.select(F.explode(found).alias("selector")).groupBy("selector").agg(F.count("*").alias("pages")).withColumn("coverage", F.col("pages") / F.lit(max(total, 1)))
    rank = F.when(F.col("selector").startswith("#"), 1).when(F.col("selector").startswith("."), 2).otherwise(3)
    return out.where(F.col("coverage") >= least).withColumn("rank", rank)


def fragile(selector: Column) -> Column:
    return selector.contains(":nth-child")
