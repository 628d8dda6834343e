"""The pipeline, stage by stage, on the smallest data set and on odd rows; the queries with SQL against it."""

import os
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import connect, plain

import corpus_pipeline
from harvestry.llm import registry

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    df = registry.queries()[name](spark, SF)
    told = connect(SF).execute(registry.oracle_sql()[name])
    columns = [d[0] for d in told.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(told.fetchall(), columns)


@needs_tables
def test_small_limits_split_and_reject(spark):
    shards = registry.queries()["shards_of_small_limit"](spark, SF)
    assert shards.select("depth").distinct().count() > 2 and shards.where(f"shard_bytes > {registry.SMALL_SHARD} and shard_rows > 1").isEmpty()
    judged = registry.queries()["hosts_judged_strictly"](spark, SF)
    assert not judged.where("host_rejected and not base_failed").isEmpty() and not judged.where("kept").isEmpty() and judged.where("host_rejected and kept").isEmpty()


@needs_tables
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


@needs_tables
def test_stages(spark):
    from test_native import counts
    from test_texts import brute_links

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    all_rows, out = {r["doc_id"]: r for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, SF)
        assert name == "packing" or df.columns == docs.columns
        out[name] = df.collect()
        docs = spark.createDataFrame(out[name], df.schema)
    base = {i for i, r in all_rows.items() if (c := counts(r["text"]))[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    assert {r["doc_id"] for r in out["quality_rules"]} == base
    spoken = {r["doc_id"] for r in out["language_id"]}
    assert len(spoken) > 0.98 * len(base)
    classes = brute_links([(i, all_rows[i]["text"]) for i in spoken], 5, 80)
    assert {r["doc_id"] for r in out["near_duplicates"]} == {v[1] for v in classes.values()}
    copies = Counter(r["doc_id"] for r in out["mixing"])
    assert set(copies) <= {v[1] for v in classes.values()} and 0.7 * len(set(copies)) < len(out["near_duplicates"])
    packed = Counter()
    for r in out["packing"]:
        packed[r["doc_id"]] += r["piece"] == 0
    assert packed == copies


def test_odd_rows(spark):
    rows = [(1, "x", 2, None), (1, None, 2, "z"), (None, "word " * 60, 3, "s"), (2, " ".join(f"w{i}" for i in range(80)), 1, "s"), (3, " ".join(f"w{i}" for i in range(80)), 1, "s")]
    docs = spark.createDataFrame([(i, t, "en", s, n, "k", 0.5) for i, t, n, s in rows], "doc_id long, text string, lang string, source string, n_chars int, kept string, rate double")
    for name, stage in corpus_pipeline.STAGES:
        for d in (docs, docs.limit(0)):
            got = stage(spark, d, "")
            assert name == "packing" or got.columns == docs.columns
            got.collect()


def test_pieces_hold_ids():
    assert zlib.crc32(np.array([1], dtype="<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0")
