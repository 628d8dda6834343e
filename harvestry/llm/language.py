"""Language identification by Bayesian evidence fusion (operator 3).

The posterior of a language is the product of four kinds of evidence, in log space:

- the text: trigrams of the bytes of the whole folded text, in hashed buckets, whose log likelihoods by language come from a
  bounded sample of rows with a declared language; their sum is tempered because trigrams overlap;
- the declared markup language, through a table of how often a page of one language declares another, estimated by
  grouped aggregation and smoothed;
- the address suffix (the last label of the host, read from the host or address, or a column of its own): its counts of
  languages found by text alone, smoothed towards those of the whole corpus;
- the host: its counts, the same way, smoothed towards those of its suffix.

A suffix counts by how it moves the corpus's shares, a host by how it moves its suffix's, so that no page counts twice; of both
a document's own count is left out.

Sample: about SAMPLE rows a declared language, those whose hashed key falls below a share that follows from the counts. All
other counts cover all rows.

A row's declared language both marks it for the sample and is evidence for it.

Cases: a null or empty text, or one without letters, has no text evidence; the other evidence decides, and the row is not
kept. A null declared language, suffix or host is no evidence. Ties go to the alphabetically first language. Repeated rows
count each. With no declared language anywhere the language is null. Input columns may have any names; the result has only
``keep`` and the columns named below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.llm.store import Scratch
from harvestry.llm.texts import as_bytes, pieces, small_batches

#: Rows a declared language that the text model is fitted on, about.
SAMPLE = 3000
#: Declared languages up to which the text model is a dense table; with more only the trigrams that a language has are kept.
LANGUAGES = 64
#: Trigrams that a worker holds before it counts them.
HELD = 1 << 20
#: Trigram buckets.
BUCKETS = 1 << 16
#: Weight of the text's log likelihood, for trigrams overlap.
TEMPER = 1 / 3
#: Pseudo-documents by which a host's counts are drawn to its suffix's, and a suffix's to the corpus's.
PULL = 10.0
#: Posterior below which a document is not kept.
LEAST = 0.6


def _trigrams(text: bytes) -> np.ndarray:
    """Bucket of each character trigram of the text in lower case, white space, digits and punctuation being one space."""
    b = np.frombuffer(b" " + text + b" ", dtype=np.uint8)
    c = _FOLD[b]
    c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]].astype(np.uint32)
    if len(c) < 3:
        return np.zeros(0, dtype=np.int64)
    k = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    return ((k * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, many = [], 0

    def counted() -> pa.RecordBatch:
        cell, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array((cell // BUCKETS).astype(np.int32)), pa.array((cell % BUCKETS).astype(np.int32)), pa.array(n.astype(np.int64))], ["at", "bucket", "n"])

    for b in pieces(batches):
        for at, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
            held.append(at * BUCKETS + _trigrams(text))
            many += len(held[-1])
            if many > HELD:
                yield counted()
                held, many = [], 0
    if many:
        yield counted()


class Dense:
    """Log likelihood by bucket and language."""

    def __init__(self, at: np.ndarray, bucket: np.ndarray, n: np.ndarray, languages: int):
        counts = np.zeros((BUCKETS, languages))
        counts[bucket, at] = n
        model = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * BUCKETS))
        self.model = (model - model.mean(1, keepdims=True)).astype(np.float32)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(self.model.shape[1])
        for at in range(0, len(grams), 1 << 16):
            out += self.model[grams[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return out


class Sparse:
    """The same up to a number that all languages share: what an unseen trigram has, and by how much a seen one has more."""

    def __init__(self, at: np.ndarray, bucket: np.ndarray, n: np.ndarray, languages: int):
        order = np.argsort(bucket, kind="stable")
        self.at, self.more = at[order].astype(np.int32), np.log((n[order] + 0.1) / 0.1).astype(np.float32)
        self.starts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        self.unseen = np.log(0.1 / (np.bincount(at, n, languages) + 0.1 * BUCKETS))

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        grams, times = np.unique(grams, return_counts=True)
        out = times.sum() * (self.unseen - self.unseen.mean())
        for at in range(0, len(grams), 256):
            g, t = grams[at : at + 256], times[at : at + 256]
            n = self.starts[g + 1] - self.starts[g]
            cells = np.arange(n.sum()) + np.repeat(self.starts[g] - np.r_[0, np.cumsum(n)[:-1]], n)
            out += np.bincount(self.at[cells], self.more[cells] * np.repeat(t, n), len(out))
        return out


def _scorer(model: Dense | Sparse, languages: int):
    @F.arrow_udf("struct<text: array<double>, n: bigint>")
    def score(column: pa.Array) -> pa.Array:
        sums, n = np.zeros((len(column), languages)), np.zeros(len(column), dtype=np.int64)
        for i, text in enumerate(as_bytes(column)):
            grams = _trigrams(text)
            n[i], sums[i] = len(grams), model(grams)
        rows = pa.FixedSizeListArray.from_arrays(pa.array((sums * TEMPER).ravel()), languages).cast(pa.list_(pa.float64()))
        return pa.StructArray.from_arrays([rows, pa.array(n)], ["text", "n"])

    return score


def text_model(docs: DataFrame, declared: str, text: str, key: str, sample: int = SAMPLE) -> tuple[list[str], Dense | Sparse | None]:
    """All declared languages and the log likelihoods by language of a text's trigrams."""
    found = sorted((r[0], r["n"]) for r in docs.where(F.col(declared).isNotNull()).groupBy(declared).agg(F.count("*").alias("n")).collect())  # as many rows as languages
    names = [x for x, _ in found]
    if not names:
        return [], None
    at = _place(names, declared)
    share = F.get(F.lit([min(1.0, sample / n) for _, n in found]), F.col("__at"))
    hashed = F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    chosen = docs.select(at.alias("__at"), F.col(text).alias("__t"), hashed.alias("__u")).where(F.col("__at").isNotNull() & (F.col("__u") < share))
    partial = chosen.select("__at", "__t").mapInArrow(_counter, "at int, bucket int, n long")
    table = partial.groupBy("at", "bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows a language at most
    return names, (Dense if len(names) <= LANGUAGES else Sparse)(*[table[c].to_numpy() for c in ("at", "bucket", "n")], len(names))


def _place(names: list[str], declared: str) -> Column:
    return F.create_map(*[F.lit(v) for i, x in enumerate(names) for v in (x, i)])[F.col(declared)]


def suffix_of(host: Column) -> Column:
    """The last label of a host or address in lower case; null for a name without a dot and for a number (an IP address)."""
    name = F.regexp_extract(F.lower(F.trim(host)), r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1)
    last = F.regexp_extract(name, r"\.([^.]*[^.0-9][^.]*)\.?$", 1)
    return F.when(last != "", last)


def _best(scores: Column) -> Column:
    """Index of the largest score, the first of equal ones."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def identify(
    docs: DataFrame, key: str = "doc_id", text: str = "text", declared: str | None = "lang", host: str | None = "source", suffix: str | None = None,
    keep: tuple[str, ...] = ("doc_id",), least: float = LEAST, sample: int = SAMPLE, wide: bool = False,
) -> DataFrame:
    """keep, language, posterior, text_language, n_trigrams, kept for each row of docs.

    declared names the column whose values also mark the sample that the text model is fitted on; suffix the one with the
    address suffix (None: it is the last label of the host). Scored rows are written once, for the priors and for
    the result; with wide, for a keep that holds texts, only what the priors need is written and the texts are scored twice.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    small_batches(spark)
    names, model = text_model(docs, declared, text, key, sample)
    n = len(names)
    if not n:
        return docs.select(*keep, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_language"), F.lit(0).cast("long").alias("n_trigrams"), F.lit(False).alias("kept"))
    none = F.lit(None).cast("string")
    own = docs.select(*[F.col(k).alias(k) for k in keep], F.col(declared).alias("__declared"), (F.col(host) if host else none).alias("__host"), (F.col(suffix) if suffix else suffix_of(F.col(host)) if host else none).alias("__suffix"), F.col(text).alias("__t"))
    # only the text goes to Python
    scored = own.withColumn("__score", _scorer(model, n)("__t")).select(*own.columns[:-1], F.col("__score.text").alias("__text"), F.col("__score.n").alias("n_trigrams"))
    at = _place(names, "__declared")
    scored = scored.withColumns({"__found": F.when(F.col("n_trigrams") > 0, _best(F.col("__text"))), "__at": at})
    # a row number in kept: a filter on it stays above the scores, whose long expressions it would copy
    scored = scored.withColumn("__barrier", F.monotonically_increasing_id()) if wide else scratch.write("language", scored)
    seen = scratch.write("language-found", scored.select("__host", "__suffix", "__found", "__at")) if wide else scored
    seen = seen.where("__found is not null")
    def counts_by(column: str) -> DataFrame:
        """Counts of languages by column, as an array: pairs are grouped first, so that a language costs no column."""
        pairs = seen.where(F.col(column).isNotNull()).groupBy(column, "__found").agg(F.count("*").cast("double").alias("n"))
        by = pairs.groupBy(column).agg(F.map_from_entries(F.collect_list(F.struct("__found", "n"))).alias("m"))
        return by.select(column, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("counts"))

    # the corpus, and how languages are declared: a row a language, and a pair of languages, at most
    table = np.zeros((n, n))
    for r in seen.where("__at is not null").groupBy("__found", "__at").count().collect():
        table[r["__found"], r["__at"]] = r["count"]
    corpus = np.zeros(n)
    for r in seen.groupBy("__found").count().collect():
        corpus[r["__found"]] = r["count"]
    base = (corpus + 1) / (corpus.sum() + n)
    said = np.log((table + 0.5 + 2 * np.eye(n)) / (table.sum(1, keepdims=True) + 0.5 * n + 2))
    prior = lambda own, parent: F.zip_with(own, parent, lambda c, p: (c + PULL * p))
    share = lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y))
    base_ = F.lit(base.tolist())
    suffixes = scratch.write("language-suffixes", counts_by("__suffix").toDF("__s", "__sc"))
    hosts = scratch.write("language-hosts", counts_by("__host").toDF("__h", "__hc"))
    heard = spark.createDataFrame([(j, said[:, j].tolist()) for j in range(n)], "__j int, __said array<double>")
    both = scored.join(hosts, scored["__host"] == hosts["__h"], "left").join(suffixes, scored["__suffix"] == suffixes["__s"], "left").join(F.broadcast(heard), scored["__at"] == heard["__j"], "left")
    others = lambda a: F.transform(a, lambda c, i: F.greatest(c - F.when(F.col("__found") == i, 1.0).otherwise(0.0), F.lit(0.0)))
    both = both.withColumn("__parent", F.coalesce(share(prior(others(F.col("__sc")), base_)), base_))
    both = both.withColumn("__prior", F.coalesce(share(prior(others(F.col("__hc")), F.col("__parent"))), F.col("__parent")))
    host_prior = F.transform("__prior", lambda x: F.log(x))
    fused = F.zip_with(F.zip_with("__text", host_prior, lambda a, b: a + b), F.coalesce("__said", F.lit([0.0] * n)), lambda a, b: a + b)
    both = both.withColumn("__fused", fused)
    top = F.array_max("__fused")
    posterior = 1 / F.aggregate("__fused", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    name = lambda i: F.get(F.lit(names), i)
    out = both.withColumns({"language": name(_best(F.col("__fused"))), "posterior": posterior, "text_language": name(F.col("__found"))})
    return out.select(*keep, "language", "posterior", "text_language", "n_trigrams", ((F.col("n_trigrams") > 0) & (F.col("posterior") >= least) & ((F.col("__barrier") >= 0) if wide else F.lit(True))).alias("kept"))
