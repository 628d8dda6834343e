"""Mixing sources to target weights by Poisson replication (operator 9, DataFrame functions only).

Each source gets the repetition rate that brings its expected share of the output to its weight. A document is repeated as
often as the inverse of the Poisson distribution with that mean says at a uniform number hashed from a seed and its key;
the copies are then shuffled over all partitions by another hash. Nothing depends on the order or partitioning of the rows.

Cases: a null source is a source of its own; a source without a weight gets none and its rows go (weights given), or the
weight of its size (weights not given). Rows that repeat a key get the same number of copies each; null keys count as the
empty key. Null texts are mixed like any other. Empty input gives an empty result. Input columns may have any names that do
not begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.llm.store import Scratch

#: Without weights, a source weighs its number of documents to this power.
POWER = 0.7
SEED = 20
#: A rate above this is split into equal Poisson parts, whose sum has the same distribution; exp(-rate) stays exact.
PART = 64
#: Sources up to which their rates are broadcast (some kB a source, at most 100 MB).
BROADCAST = 50_000
SALTS = 64


def _uniform(*of: Column) -> Column:
    """A number in [0, 1) hashed from strings."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *of)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, source: str, weights: dict | None = None, power: float = POWER, epochs: float = 1.0) -> DataFrame:
    """(source, n_docs, weight, rate): rate is the mean number of copies; epochs is the output's size over the input's."""
    by = docs.groupBy(F.col(source).alias("__source")).agg(F.count("*").alias("n_docs"))
    everything = by
    if weights is None:
        by = by.withColumn("__raw", F.pow(F.col("n_docs").cast("double"), F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "__k string, __raw double")
        by = by.join(given, by["__source"].eqNullSafe(given["__k"])).drop("__k")
    n = float(everything.agg(F.sum("n_docs")).first()[0] or 0)
    w = float(by.agg(F.sum("__raw")).first()[0] or 1)
    out = by.withColumn("weight", F.col("__raw") / w).withColumn("rate", F.col("weight") * (n * epochs) / F.col("n_docs"))
    return out.select("__source", "n_docs", "weight", "rate")


def _table(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... of the Poisson distribution, to where the rest is nothing in double precision."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("t"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("a"))

    def step(s: Column, k: Column) -> Column:
        t = s.t * rate / k
        return F.struct(t.alias("t"), (s.c + t).alias("c"), F.concat(s.a, F.array(s.c + t)).alias("a"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s.a)


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", weights: dict | None = None, power: float = POWER, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """docs with its columns, repeated and shuffled, and copy (from 1), rate, shuffle_key (in place of columns so named)."""
    docs = docs.drop("copy", "rate", "shuffle_key")
    scratch = Scratch(docs.sparkSession)
    by = scratch.write("mixing-rates", rates(docs, source, weights, power, epochs))
    parts = F.greatest(F.ceil(F.col("rate") / PART).cast("int"), F.lit(1))
    by = by.select("__source", "rate", parts.alias("__parts"), _table(F.col("rate") / parts).alias("__cdf"))
    own = F.coalesce(F.col(key).cast("string"), F.lit(""))
    if by.count() <= BROADCAST:
        joined = docs.join(F.broadcast(by), docs[source].eqNullSafe(by["__source"]))
    else:  # a source may hold a third of the rows: its rate goes to SALTS places
        salted = by.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = docs.withColumn("__own_salt", F.pmod(F.xxhash64(own, F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
        joined = left.join(salted, left[source].eqNullSafe(salted["__source"]) & (left["__own_salt"] == salted["__salt"]))
    draws = F.aggregate(F.sequence(F.lit(1), F.col("__parts")), F.lit(0), lambda s, j: s + _count(F.col("__cdf"), _uniform(F.lit(str(seed)), own, j.cast("string"))))
    copies = joined.withColumn("__n", draws).where("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    shuffle_key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), own, F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    out = copies.select(*[docs[c] for c in docs.columns], "copy", "rate", shuffle_key.alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def _count(table: Column, u: Column) -> Column:
    """The least k whose table entry is above u; u is computed once."""
    return F.get(F.transform(F.array(u), lambda x: F.size(F.filter(table, lambda c: c <= x))), F.lit(0))


#: What mix() gives on the ids and sources of documents, in DuckDB.
ORACLE = f"""
with by_source as (select source, count(*) as n from documents group by source),
rates as (select source, n, (pow(n::double, {POWER}) / (select sum(pow(n::double, {POWER})) from by_source)) * ((select sum(n) from by_source)::double) / n as rate from by_source),
parts as (select *, greatest(ceil(rate / {PART})::int, 1) as parts from rates),
terms as (
  select source, k, exp(-rate / parts) * exp(sum(case when k = 0 then 0 else ln(rate / parts) - ln(k) end) over (partition by source order by k)) as t
  from parts, generate_series(0, 200) as g(k)
), tables as (
  select source, list(c order by k) as cdf from (select source, k, sum(t) over (partition by source order by k) as c from terms) group by source
), drawn as (
  select doc_id, d.source, rate,
    list_sum(list_transform(generate_series(1, parts), lambda j: len(list_filter(cdf, lambda c: c <= (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::varchar, '') || '|' || j::varchar), 1, 13))::bigint)::double / {1 << 52}))))::int as n
  from documents d join parts p on d.source is not distinct from p.source join tables t on d.source is not distinct from t.source
)
select doc_id, source, copy::int as copy, rate, ('0x' || substr(md5('{SEED}|order|' || coalesce(doc_id::varchar, '') || '|' || copy::varchar), 1, 15))::bigint as shuffle_key
from (select *, unnest(generate_series(1, n)) as copy from drawn where n > 0)
"""
