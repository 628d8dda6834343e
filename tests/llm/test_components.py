import random

import pytest

from harvestry.llm import components as cc
from harvestry.llm.store import Scratch


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(cc, "ONE_TASK", one_task)
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 40)] + [(200, i) for i in range(100, 160)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(45)] + [(7, 7), (500, 499), (499, 500)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    got = cc.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["root"] for r in got} == {x: find(x) for x in list(top)}
    assert cc.components(spark.createDataFrame([], "a binary, b binary"), Scratch(spark)).collect() == []
