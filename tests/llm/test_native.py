"""Quality rules, sharding and mixing against plain Python, and their edge cases."""

import math
import re
from collections import Counter, defaultdict

import pytest

from harvestry.llm import mixing, quality, sharding
from harvestry.llm.store import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, rate double, copy int, n_words string, kept string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1.0, 2, "x", "y") for i, t, s in rows], SCHEMA)


LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(30_000))
EDGE = [(1, None, "a"), (2, "", "a"), (3, " \t\r\n", None), (4, "one", "a"), (5, "a b c a b c a b c", "b"), (6, "x\n\nx\n x\nx", "b"), (7, "# $ é|<", "b"), (8, LONG, "c"), (None, "q r s", None), (9, "a b c d", "c"), (9, "a b c d", "c"), (10, "a b a b a", "d"), (11, "\x1c \xa0 z", "d")]


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    seen, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    rows = [tuple(r) for r in quality.quality(docs(spark, EDGE)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    told = [(i, *counts(t)) for i, t, _ in EDGE]
    told = [(*r, r[1] < 50 or 100 * r[5] > 50 * r[1]) for r in told]
    assert sorted(map(str, rows)) == sorted(map(str, told))


def test_windows_whose_hashes_meet_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(quality, "POSITION_BITS", 62)  # two hash bits: nearly all windows agree in them
    rows = quality.counts(docs(spark, [(1, "a b c d e f g h a b c x y z", "s"), (2, "a b c d e f", "s")]).select("doc_id", "text")).select("doc_id", "n_repeat_words").collect()
    assert sorted(map(tuple, rows)) == [(1, 6), (2, 0)]


def test_bad_hosts_take_their_documents_down(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good, f"h{i % 20}") for i in range(400)] + [(1000 + i, "spam spam" if i % 10 else good, "bad") for i in range(100)] + [(2000, "short", "tiny")]
    got = {r["doc_id"]: r for r in quality.quality(docs(spark, rows)).collect()}
    assert all(got[i]["kept"] for i in range(400))
    assert all(not got[1000 + i]["kept"] and got[1000 + i]["host_rejected"] for i in range(100))
    assert not got[2000]["kept"] and not got[2000]["host_rejected"]  # one document says little about a host
    wide = {r["doc_id"]: r["kept"] for r in quality.quality(docs(spark, rows), wide=True).where("kept").collect()}
    assert sorted(wide) == sorted(i for i, r in got.items() if r["kept"])


@pytest.mark.parametrize("op", [quality.quality, sharding.shard, lambda d: mixing.mix(d.select("doc_id", "source"))])
def test_empty(spark, op):
    assert op(docs(spark, []).limit(0)).collect() == []


def test_shards(spark):
    rows = [(i, "x" * (i * 7 % 50), "s") for i in range(500)] + [(7, "y" * 40, "s")] * 30 + [(600, "z" * 900, "s"), (None, None, "s")]
    got = sharding.shard(docs(spark, rows), limit=300).collect()
    assert len(got) == len(rows)
    size, n = Counter(), Counter()
    for r in got:
        size[r["shard"]] += r["n_bytes"]
        n[r["shard"]] += 1
    assert all(size[r["shard"]] == r["shard_bytes"] and n[r["shard"]] == r["shard_rows"] and len(r["shard"]) == r["depth"] for r in got)
    assert all(v <= 300 or n[k] == 1 for k, v in size.items())
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    parents = defaultdict(int)
    for k, v in size.items():  # only what was too large was split
        for d in range(len(k)):
            parents[k[:d]] += v
    assert all(v > 300 for v in parents.values())


def test_mixing(spark):
    rows = [(i, "t", "big") for i in range(6000)] + [(10_000 + i, "t", "small") for i in range(600)] + [(20_000 + i, "t", None) for i in range(300)]
    d = docs(spark, rows)
    got = mixing.mix(d, weights={"big": 1, "small": 2}).collect()
    n = Counter(r["source"] for r in got)
    assert abs(n["big"] - 2300) < 5 * math.sqrt(2300) and abs(n["small"] - 4600) < 5 * math.sqrt(4600) and None not in n
    copies = Counter(r["doc_id"] for r in got if r["source"] == "small")
    rate = 6900 * 2 / 3 / 600
    for k in range(4, 12):  # the distribution is Poisson's
        p = math.exp(-rate) * rate**k / math.factorial(k)
        assert abs(sum(v == k for v in copies.values()) - 600 * p) < 6 * math.sqrt(600 * p + 1)
    again = mixing.mix(d.repartition(7), weights={"big": 1, "small": 2}).select("doc_id", "copy").collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["copy"]) for r in got)


def test_large_rates_are_split(spark):
    d = docs(spark, [(i, "t", "one") for i in range(20)] + [(100 + i, "t", "many") for i in range(2000)])
    n = Counter(r["doc_id"] for r in mixing.mix(d.select("doc_id", "source"), weights={"one": 1.0}).collect())
    assert len(n) == 20 and abs(sum(n.values()) - 2020) < 5 * math.sqrt(2020) and min(n.values()) > 50


def test_null_sources_without_weights(spark):
    got = mixing.mix(docs(spark, [(i, None, None if i % 2 else "a") for i in range(2000)]), power=1.0).collect()
    n = Counter(r["source"] for r in got)
    assert abs(n[None] - 1000) < 160 and abs(n["a"] - 1000) < 160


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plans_of_shards_do_not_grow_with_depth(spark, monkeypatch):
    written, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, name, df: (written.append(plan_of(df)), write(self, name, df))[1])
    rows = [(i, "x" * (1 + i % 3), "s") for i in range(3000)]
    got = sharding.shard(docs(spark, rows), limit=20)
    # one aggregate rolls up all depths of a round
    assert max(r["depth"] for r in got.collect()) > 8 and max(p.count("Aggregate [") for p in written) <= 2
    # tables with more than a few rows are never broadcast, whatever Spark takes for small
    few = sorted(map(str, got.collect()))
    monkeypatch.setattr(sharding, "FEW", 0)
    many = sharding.shard(docs(spark, rows), limit=20)
    assert sorted(map(str, many.collect())) == few and "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_key_are_split_by_their_own_bits(spark):
    rows = [(7, "x" * 10, "s")] * 40 + [(None, "y" * 30, "s")] * 3 + [(1, "z" * 200, "s"), (1, "", "s")]
    got = sharding.shard(docs(spark, rows), limit=25).collect()
    assert len(got) == len(rows) and min(r["depth"] for r in got if r["doc_id"] == 7) > sharding.HALF
    assert all(r["shard_bytes"] <= 25 or r["shard_rows"] == 1 for r in got)
