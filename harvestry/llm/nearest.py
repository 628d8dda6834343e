"""Exact top-k search by a Voronoi join (operator 8).

Vectors become whole numbers (each component times a scale, rounded down); the score is their inner product.

1. Pivots: of a hashed sample of the vectors those farthest apart, about the square root of the number of vectors and at most
   PIVOT_BYTES in all. Every vector, and every query, belongs to the cell of its nearest pivot.
2. Summaries: of each cell the number, the largest distance to the pivot and the largest norm, of its vectors and of its
   queries. For a query cell A with pivot a and a data cell B with pivot b, all scores lie within
   a.b +- (r_A |b| + n_A r_B), n_A the largest norm of a query. From the lower bounds and the numbers of vectors follows a
   score that the k best of each query in A reach for certain; only data cells whose upper bound reaches it matter to A.
3. Query cells near each other form groups of at most about GROUP_BYTES of queries (a cell with more is several groups). A
   vector is copied to those groups only that have a query cell to which its cell matters.
4. A group's data are cut into stripes of about STRIPE vectors; a task holds the queries of a group and reads a stripe, best
   cells first. Each cell is compared with the query cells to which it still matters, given the k best so far too. The k best of
   the stripes are merged.

What is broadcast are the summaries, bounded by PIVOT_BYTES, and a number a group. If no bound excludes anything, as for
vectors without clusters in many dimensions, all pairs are compared, and each vector is copied to every group.

Bounds are computed in double precision and widened by more than its error; scores are exact: products run in double
precision where all partial sums stay below 2**53, else in Python's whole numbers.

Cases: vectors that are null or hold null or non-finite components, and rows with a null id, take no part. Vectors of
different lengths do not meet. Rows that repeat an id are each a candidate for others, and none for a query of that id (the
bounds leave out as many rows as any query's id of the cell has); such a query is answered once for each row. Ties go to the
smaller id. Empty input gives an empty result. Only ``key`` and ``vector`` are read. A score beyond 64 bits is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestry.llm.store import Scratch

#: Bytes of all pivots of one length, and of the queries of a group (as doubles); fewest pivots.
PIVOT_BYTES, GROUP_BYTES, LEAST_PIVOTS = 4 << 20, 8 << 20, 16
#: Vectors of a stripe, about.
STRIPE = 1 << 13
SCALE = 256
#: Widening of the bounds, relative.
SLACK = 1e-9
NONE = np.iinfo(np.int64).min


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as doubles with whole values."""
    return np.floor(vectors * float(scale))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact."""
    top = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if top < 2.0**53:
        return np.rint(a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], dtype=object) @ np.array([[int(x) for x in r] for r in b], dtype=object).T
    if any(abs(x) >= 1 << 63 for x in exact.ravel()):
        raise OverflowError("a score does not fit 64 bits")
    return exact.astype(np.int64)


def apart(vectors: np.ndarray, most: int) -> np.ndarray:
    """At most so many of the vectors, each the farthest from those before it."""
    chosen, far = [0], np.full(len(vectors), np.inf)
    while len(chosen) < min(most, len(vectors)):
        far = np.minimum(far, ((vectors - vectors[chosen[-1]]) ** 2).sum(1))
        if not far.max() > 0:
            break
        chosen.append(int(far.argmax()))
    return vectors[chosen]


def _assigner(pivots: dict[int, np.ndarray], scale: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            lengths = pa.compute.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
            cell, far, norm = np.zeros(b.num_rows, dtype=np.int32), np.zeros(b.num_rows), np.zeros(b.num_rows)
            for n in np.unique(lengths):
                rows, p = np.flatnonzero(lengths == n), pivots[int(n)]
                v = whole(vectors[starts[rows][:, None] + np.arange(n)], scale)
                for at in range(0, len(rows), 1024):
                    part, own = v[at : at + 1024], rows[at : at + 1024]
                    best = ((p * p).sum(1) - 2 * part @ p.T).argmin(1)
                    cell[own] = best
                    far[own] = np.sqrt(((part - p[best]) ** 2).sum(1))
                    norm[own] = np.sqrt((part * part).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(lengths.astype(np.int32)), pa.array(cell), pa.array(far), pa.array(norm)], ["id", "row", "vector", "dim", "cell", "far", "norm"])

    return assign


class Summary:
    """Cells of vectors of one length: pivots, numbers and radii of data, radii and norms of queries, and what matters to whom."""

    def __init__(self, pivots: np.ndarray, rows: list, k: int):
        self.pivots, self.size = pivots, np.sqrt((pivots * pivots).sum(1))
        n = len(pivots)
        self.n, self.radius, self.largest = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n)
        self.asked, self.reach, self.norm, self.same = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64)
        for r in rows:
            c = r["cell"]
            self.n[c], self.radius[c], self.largest[c] = r["n"], r["r"], r["l"]
            self.asked[c], self.reach[c], self.norm[c], self.same[c] = r["q"], r["qr"] or 0.0, r["ql"] or 0.0, r["same"] or 0
        # for each query cell a score that the k best of all its queries reach
        self.least = np.full(n, -np.inf)
        for a in np.flatnonzero(self.asked):
            low, _ = self.bounds(np.array([a]), np.arange(n))
            order = np.argsort(-low[0])
            enough = np.flatnonzero(np.cumsum(self.n[order]) >= k + self.same[a])
            if len(enough):
                self.least[a] = low[0][order][enough[0]]

    def bounds(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest scores of queries of cells a with data of cells b."""
        mid = self.pivots[a] @ self.pivots[b].T
        wide = self.reach[a][:, None] * self.size[b] + self.norm[a][:, None] * self.radius[b]
        slack = SLACK * (1 + np.abs(mid) + wide)
        most = self.norm[a][:, None] * self.largest[b] * (1 + SLACK)
        return np.maximum(mid - wide - slack, -most), np.minimum(mid + wide + slack, most)

    def matters(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.bounds(a, b)[1] >= self.least[a][:, None]) & (self.n[b] > 0)

    def group(self, most: int) -> list[list[int]]:
        """Query cells near each other, with about most queries in all; halves along the widest axis."""
        done, todo = [], [np.flatnonzero(self.asked)]
        while todo:
            cells = todo.pop()
            if len(cells) <= 1 or self.asked[cells].sum() <= most:
                if len(cells):
                    done.append(cells.tolist())
                continue
            p = self.pivots[cells]
            cells = cells[np.argsort(p[:, np.argmax(p.max(0) - p.min(0))], kind="stable")]
            half = np.searchsorted(np.cumsum(self.asked[cells]), self.asked[cells].sum() / 2) + 1
            half = min(max(int(half), 1), len(cells) - 1)
            todo += [cells[:half], cells[half:]]
        return done


class Plan:
    """Groups of query cells: of each cell its groups (several for a part each, where it has very many queries), and of each group its stripes."""

    def __init__(self, summaries: dict[int, Summary], stripe: int, group_bytes: int):
        self.summaries, self.of, self.cells, self.stripes = summaries, {}, [], []
        for dim, s in sorted(summaries.items()):
            most = max(1, group_bytes // (8 * max(dim, 1)))
            for cells in s.group(most):
                parts = -(-int(s.asked[cells].sum()) // most) if len(cells) == 1 else 1
                needed = s.matters(np.array(cells), np.arange(len(s.n))).any(axis=0)
                for _ in range(parts):
                    for c in cells:
                        self.of.setdefault((dim, c), []).append(len(self.cells))
                    self.cells.append((dim, cells))
                    self.stripes.append(max(1, -(-int(s.n[needed].sum()) // stripe)))
        self.found: dict = {}

    def needed_by(self, dim: int, cell: int) -> tuple[np.ndarray, np.ndarray]:
        """Groups to which a data cell matters, and its greatest score there."""
        if (dim, cell) not in self.found:
            s, groups, tops = self.summaries[dim], [], []
            asked = np.flatnonzero(s.asked)
            top = s.bounds(asked, np.array([cell]))[1][:, 0]
            for c, t, ok in zip(asked.tolist(), top.tolist(), (top >= s.least[asked]).tolist(), strict=True):
                if ok:
                    groups += self.of[dim, c]
                    tops += [t] * len(self.of[dim, c])
            once, which = np.unique(np.array(groups, dtype=np.int64), return_inverse=True)
            most = np.full(len(once), -np.inf)
            np.maximum.at(most, which, np.array(tops))
            self.found[dim, cell] = once, most
        return self.found[dim, cell]


def _hash(a: np.ndarray) -> np.ndarray:
    x = a.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def _sender(plan: Plan, every: int):
    """Copies of the data for the groups that need them, and of the queries for the stripes of their group."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows, dims, cells = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
            h = _hash(rows)
            for kind in (0, 1):  # queries, data
                take, group, stripe, rank = [], [], [], []
                for i, (dim, cell) in enumerate(zip(dims.tolist(), cells.tolist(), strict=True)):
                    if kind:
                        groups, top = plan.needed_by(dim, cell)
                        for g, t in zip(groups.tolist(), top.tolist(), strict=True):
                            take.append(i), group.append(g), stripe.append(int(h[i] % np.uint64(plan.stripes[g]))), rank.append(-t)
                    elif ids[i] % every == 0:
                        own = plan.of[dim, cell]
                        g = own[int(h[i] % np.uint64(len(own)))]
                        for x in range(plan.stripes[g]):
                            take.append(i), group.append(g), stripe.append(x), rank.append(0.0)
                for at in range(0, len(take), 4096):
                    t = pa.array(take[at : at + 4096], pa.int64())
                    part = slice(at, at + 4096)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group[part], pa.int32()), pa.array(stripe[part], pa.int32()), pa.array([kind] * len(t), pa.int32()), pa.array(rank[part], pa.float64()), *[b.column(c).take(t) for c in (4, 0, 1, 2)]],
                        ["group", "stripe", "kind", "rank", "cell", "id", "row", "vector"],
                    )

    return send


class _Task:
    """The queries of a group and their k best so far."""

    def __init__(self, dim: int, summary: Summary, k: int, scale: int):
        self.dim, self.summary, self.k, self.scale = dim, summary, k, scale
        self.queries, self.rows, self.compared = [], None, 0

    def ready(self) -> None:
        self.queries.sort(key=lambda q: q[0])
        cell = np.array([q[0] for q in self.queries], dtype=np.int64)
        self.ids, self.rows = (np.array([q[i] for q in self.queries], dtype=np.int64) for i in (1, 2))
        self.q = whole(np.array([q[3] for q in self.queries], dtype=np.float64).reshape(len(cell), self.dim), self.scale)
        self.cells, self.starts = np.unique(cell, return_index=True)
        self.ends = np.r_[self.starts[1:], len(cell)].astype(np.int64)
        self.score, self.vec = np.full((len(cell), self.k), NONE), np.full((len(cell), self.k), np.iinfo(np.int64).max)
        self.queries = []

    def read(self, cell: int, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Compare the vectors of a data cell with the queries to which it matters."""
        top = self.summary.bounds(self.cells, np.array([cell]))[1][:, 0]
        worst = np.minimum.reduceat(self.score[:, -1], self.starts)  # of each query cell the query that is worst off
        wanted = np.flatnonzero((top >= self.summary.least[self.cells]) & (top >= worst))
        if not len(wanted):
            return
        own = np.concatenate([np.arange(self.starts[c], self.ends[c]) for c in wanted])
        for at in range(0, len(own), 2048):
            some = own[at : at + 2048]
            s = scores(self.q[some], vectors)
            self.compared += s.size
            better = (s >= self.score[some, -1][:, None]) & (ids[None, :] != self.ids[some][:, None])
            q, v = np.nonzero(better)
            if not len(q):
                continue
            changed = np.unique(q)
            rows = some[changed]
            q_all = np.r_[np.repeat(np.arange(len(changed)), self.k), np.searchsorted(changed, q)]
            s_all, v_all = np.r_[self.score[rows].ravel(), s[q, v]], np.r_[self.vec[rows].ravel(), ids[v]]
            order = np.lexsort((v_all, -s_all.astype(np.float64) if np.abs(s).max() < 1 << 52 else _negated(s_all), q_all))
            q_all, s_all, v_all = q_all[order], s_all[order], v_all[order]
            first = np.searchsorted(q_all, np.arange(len(changed)))
            keep = first[:, None] + np.arange(self.k)
            self.score[rows], self.vec[rows] = s_all[keep], v_all[keep]

    def results(self) -> pa.RecordBatch:
        q, j = np.nonzero(self.score != NONE) if self.rows is not None else (np.zeros(0, np.int64),) * 2
        columns = [pa.array(self.ids[q]), pa.array(self.rows[q]), pa.array(self.vec[q, j]), pa.array(self.score[q, j]), pa.nulls(len(q), pa.int64())] if len(q) else [pa.nulls(0, pa.int64())] * 5
        # a last row without a query has the number of pairs that were compared
        return pa.RecordBatch.from_arrays([pa.concat_arrays([c, pa.array([x], pa.int64())]) for c, x in zip(columns, (None, None, None, None, self.compared), strict=True)], ["query_id", "row", "vec_id", "score", "compared"])


def _negated(s: np.ndarray) -> np.ndarray:
    """An order of whole numbers from the greatest to the least, without overflow."""
    return ~s


def _solver(plan: Plan, k: int, scale: int):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, task, cell, ids, vectors = None, None, None, [], []

        def flush() -> None:
            nonlocal ids, vectors
            if ids and task.rows is not None:
                task.read(cell, np.array(ids, dtype=np.int64), whole(np.array(vectors, dtype=np.float64).reshape(len(ids), task.dim), scale))
            ids, vectors = [], []

        for b in batches:
            for group, stripe, kind, _, own, id_, row, vector in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (group, stripe) != now:
                    if now is not None:
                        flush()
                        yield task.results()
                    now, cell = (group, stripe), None
                    dim = plan.cells[group][0]
                    task = _Task(dim, plan.summaries[dim], k, scale)
                if not kind:
                    task.queries.append((own, id_, row, vector))
                    continue
                if task.rows is None and task.queries:
                    task.ready()
                if own != cell or len(ids) == 1024:
                    flush()
                    cell = own
                ids.append(id_), vectors.append(vector)
        if now is not None:
            flush()
            yield task.results()

    return solve


def _found(vectors: DataFrame, key: str, vector: str, every: int, k: int, scale: int, pivots: int | None, stripe: int, group_bytes: int) -> DataFrame:
    """The k best of every query in each stripe, and rows with the numbers of pairs compared."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    good = F.col("vector").isNotNull() & F.col("id").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.select(F.col(key).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(vector).cast("array<double>").alias("vector")).where(good)
    own = scratch.write("nearest-rows", own)
    dims = {r["d"]: r["n"] for r in own.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row a length
    centres = {}
    for d, n in dims.items():  # a bounded sample by hash; distinct, for copies make one cell
        want = pivots or max(LEAST_PIVOTS, math.isqrt(n))
        want = max(1, min(want, PIVOT_BYTES // (8 * max(d, 1))))
        share = min(1.0, 4 * want / n)
        picked = own.where((F.size("vector") == d) & (F.pmod(F.xxhash64("row", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20)))
        rows = picked.select("vector").distinct().orderBy(F.xxhash64("vector")).limit(4 * want).collect()
        rows = rows or own.where(F.size("vector") == d).select("vector").limit(1).collect()
        centres[d] = apart(whole(np.array([r[0] for r in rows], dtype=np.float64).reshape(len(rows), d), scale), want)
    schema = "id long, row long, vector array<double>"
    placed = scratch.write("nearest-cells", own.mapInArrow(_assigner(centres, scale), f"{schema}, dim int, cell int, far double, norm double"))
    asks = F.col("id") % every == 0
    # rows that share a query's id are no candidates for it
    same = placed.where(asks).groupBy(F.col("dim").alias("__d"), F.col("id").alias("__id")).agg(F.count("*").alias("m"), F.collect_set("cell").alias("cells")).where("m > 1")
    same = same.select("__d", "m", F.explode("cells").alias("__c")).groupBy("__d", "__c").agg(F.max("m").alias("m"))
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("r"), F.max("norm").alias("l"), F.count_if(asks).alias("q"), F.max(F.when(asks, F.col("far"))).alias("qr"), F.max(F.when(asks, F.col("norm"))).alias("ql"))
    cells = cells.join(same, (F.col("dim") == F.col("__d")) & (F.col("cell") == F.col("__c")), "left").withColumn("same", F.coalesce("m", F.lit(1)))
    by_dim: dict[int, list] = {d: [] for d in dims}
    for r in cells.collect():  # a row a pivot at most
        by_dim[r["dim"]].append(r)
    plan = Plan({d: Summary(centres[d], rows, k) for d, rows in by_dim.items()}, stripe, group_bytes)
    work = placed.select("id", "row", "vector", "dim", "cell").mapInArrow(_sender(plan, every), "group int, stripe int, kind int, rank double, cell int, id long, row long, vector array<double>")
    work = work.repartition("group", "stripe").sortWithinPartitions("group", "stripe", "kind", "rank", "cell")
    return work.mapInArrow(_solver(plan, k, scale), "query_id long, row long, vec_id long, score long, compared long")


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, scale: int = SCALE, pivots: int | None = None, stripe: int = STRIPE, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best others for each row whose key is divisible by every."""
    found = _found(vectors, key, vector, every, k, scale, pivots, stripe, group_bytes).where(F.col("query_id").isNotNull())
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def compared(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, scale: int = SCALE, pivots: int | None = None, stripe: int = STRIPE, group_bytes: int = GROUP_BYTES) -> int:
    """How many pairs of a query and a vector a search compares."""
    return _found(vectors, key, vector, every, k, scale, pivots, stripe, group_bytes).agg(F.sum("compared")).first()[0] or 0


#: The same by comparing each query with every row, in DuckDB.
ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s) where rank <= 5
"""
