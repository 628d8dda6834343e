"""The queries of this subpackage by name, and the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from harvestry.llm import extract, jaccard, language, lmscore, mixing, nearest, packing, quality, sharding, toxicity
from harvestry.session import ship, table

#: Bytes of text in a shard, and the failure rate of a host, in the queries that show splitting and rejection on small tables.
SMALL_SHARD, STRICT_HOSTS = 16 << 10, 0.07


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def shards_of_small_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first operator with a limit that small tables exceed, so that buckets are split to different depths."""
    return sharding.shard(table(spark, sf_dir, "documents"), limit=SMALL_SHARD)


def hosts_judged_strictly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seventh operator with a limit that some hosts of small tables exceed, so that their documents go."""
    return quality.quality(table(spark, sf_dir, "documents"), limit=STRICT_HOSTS)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best others for every fiftieth vector."""
    return nearest.search(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents, how often and in what order, bring the sources to their weights."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by text, declared language and host."""
    return language.identify(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every document by a model of those that are not held out."""
    return lmscore.score(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces placed in sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract.extract(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules with host verdicts over all documents."""
    return quality.quality(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {"op1_sharding": op1_sharding, "shards_of_small_limit": shards_of_small_limit, "hosts_judged_strictly": hosts_judged_strictly, "op2_ngram_jaccard_join": op2_ngram_jaccard_join, "op3_language_id": op3_language_id, "op4_lm_scoring": op4_lm_scoring, "op5_packing": op5_packing, "op8_exact_topk": op8_exact_topk, "op6_html_extraction": op6_html_extraction, "op9_mixing": op9_mixing, "op7_quality_rules": op7_quality_rules, "op10_toxicity": op10_toxicity}
    return {name: (lambda spark, sf_dir, f=f: f(ship(spark), sf_dir)) for name, f in own.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.oracle(), "shards_of_small_limit": sharding.oracle(SMALL_SHARD), "op7_quality_rules": quality.oracle(), "hosts_judged_strictly": quality.oracle(STRICT_HOSTS), "op8_exact_topk": nearest.ORACLE, "op9_mixing": mixing.ORACLE}
