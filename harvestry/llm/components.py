"""Connected components of links between nodes, by alternating large and small stars.

Every round is a few grouped minima and joins over the links, written to the shared folder; nothing is collected but counts.
A node with very many links costs no task more than its share: minima are taken before the shuffle, and the joins are
between written tables, which Spark splits where a key is hot. Up to ONE_TASK links, counted first, one task of bounded
memory finds the components instead of many rounds of tiny tasks; beyond that the rounds do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm.store import Scratch

#: Links that one task takes at most (about 100 bytes each).
ONE_TASK = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and their roots from links (u, v): least labels along the links, and along labels, until none changes."""
    parts = list(batches)
    if not parts:
        return
    ends = pa.chunked_array([b.column(0) for b in parts] + [b.column(1) for b in parts]).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(ends.dictionary)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    u, v = np.split(rank[ends.indices.to_numpy()], 2)
    label = np.arange(len(order))
    while (differ := label[u] != label[v]).any():
        a, b = label[u[differ]], label[v[differ]]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((up := label[label]) != label).any():
            label = up
    nodes = ends.dictionary.take(order)
    for at in range(0, len(nodes), 10_000):
        yield pa.RecordBatch.from_arrays([nodes.slice(at, 10_000), nodes.take(pa.array(label[at : at + 10_000]))], ["node", "root"])


def components(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of links (a, b), roots among them; root is the least node of the component."""
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.write("cc-links", ordered)
    if edges.count() <= ONE_TASK:
        kind = edges.schema["u"].dataType.simpleString()
        roots = scratch.write("cc-roots", edges.coalesce(1).mapInArrow(_joined, f"node {kind}, root {kind}"))
        scratch.drop(edges)
        return roots
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write("cc-least", both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m")))
        # large star: neighbours above a node go to the least node about it
        large = both.where("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write("cc-large", large)
        scratch.drop(edges, least)
        # small star: the node and its neighbours below it go to the least of these
        least = scratch.write("cc-least", large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x"))
        small = large.join(least, F.col("u") == F.col("x")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()
        edges = scratch.write("cc-links", small)
        scratch.drop(large, least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
