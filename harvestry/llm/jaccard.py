"""N-gram Jaccard join with a token-group matrix (operator 2).

Documents are sets of word shingles, as 64-bit hashes. Two documents are linked when their sets' Jaccard similarity is at
least num/100. The class of a document is its connected component, its name the least document id in it. All links are found.

1. Every shingle goes to a bucket that counts the documents it occurs in. Shingles are ordered from the rarest to the most
   frequent. Two sets that are linked share one of the first n - ceil(num/100 * n) + 1 shingles of each: its prefix. Shingles of
   one document only are shared by none, so a set with enough of these is linked with nothing, and most sets end here.
2. Equal sets become one node (128-bit digest) with the number of its rows. Nodes are partitioned into groups of similar
   documents: those that share a shingle of their prefixes, directly or through others. A link never leaves its group.
3. Groups over a bound of rows or tokens are cut into blocks. For each pair of blocks of one group, a task holds the two
   blocks, cut into small groups of similar sets with the union of their tokens. The matrix of tokens and these groups gives
   the overlap of every set with every union; only where it reaches the overlap that the threshold asks for, the group is
   opened and its sets are compared exactly. A task returns for each set its links, counted by rows, and one neighbour in a
   spanning forest of the links.
4. Components of the forest edges give the classes.

The most frequent shingles of a sample, FREQUENT of them at most, stand last in the order and are not sent, so that no bucket
gets one from a large part of all documents; any order finds all links. Nothing is emitted for pairs; a task's memory is
bounded by a bucket or by two blocks; a set larger than a block is a block of its own.

Cases: a null text, or one without words, has an empty set, no links, and its own id as its class (rows of one id share
it); with fewer words than a shingle has, the whole sequence is the one shingle. Rows with a null id take part in links;
a class of such rows only has a null name. Rows that repeat an id keep a row each. Ties cannot arise: a class is named by
the least id. Only ``key`` and ``text`` are read, whatever other columns there are. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm.blobs import ROWS, Batches, Out, grouped, pack_counts, split, stream, streamed, unpack_counts
from harvestry.llm.components import components
from harvestry.llm.store import Scratch
from harvestry.llm.texts import as_bytes, pieces, small_batches, words

#: Bytes of text a bucket; tokens about that a batch of documents sends to a bucket, and the least and most tokens of a batch.
BUCKET, ROW, BATCH = 8 << 20, 1 << 13, (1 << 17, 1 << 20)
#: Rows about of the sample in which frequent shingles are found, rows of it that such a shingle is in, and most of them.
SAMPLE, OFTEN, FREQUENT = 2000, 20, 1 << 16
#: Sets and tokens of a block, and sets of a small group.
BLOCK_SETS, BLOCK_TOKENS, GROUP_SETS = 256, 1 << 18, 16
#: Groups' members up to which their ids are broadcast to the texts (16 bytes each).
BROADCAST = 500_000
#: Words whose hashes a worker remembers.
REMEMBER = 120_000
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Shingles:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: bytes) -> np.ndarray:
        ws = words(text)
        if not ws:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        get, one = known.get, xxhash.xxh3_64_intdigest
        out = []
        for w in ws:
            h = get(w)
            if h is None:
                h = known[w] = one(w)
            out.append(h)
        h = np.array(out, dtype=np.uint64)
        k = min(self.width, len(h))
        n = len(h) - k + 1
        mixed = h[:n].copy()
        for i in range(1, k):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[1] + h[i : i + n] * _MIX[0]
        if len(h) < self.width:  # a short text is equal to equal texts only
            mixed = mixed * _MIX[2] + np.uint64(k)
        mixed ^= mixed >> np.uint64(31)
        mixed *= _MIX[2]
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)


def digest(tokens: np.ndarray) -> bytes:
    """The name of a set."""
    return xxhash.xxh3_128_digest(tokens.tobytes())


# Kinds of rows between buckets (blobs.py).
OWN, TOKENS, SHARED = range(3)


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens of sets of n, the first in any common order, a linked set shares one with."""
    return n - -(-percent * n // 100) + 1


def _sampler(width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for b in pieces(batches):
            sets = [shingles(t) for t in as_bytes(b.column(0))]
            token, n = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    return count


def _asker(width: int, frequent: np.ndarray, buckets: int):
    """The tokens of sets to their buckets; ids, sizes, digests and frequent tokens in a row of the batch."""
    least = min(max(ROW * buckets, BATCH[0]), BATCH[1])
    maybe = np.zeros(1 << 20, dtype=bool)
    maybe[frequent >> np.uint64(44)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shingles, out, batch, held, many = Shingles(width), Out(), TaskContext.get().partitionId() << 24, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal batch, many
            sets = [s for _, _, some in held for s in some]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            tokens, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
            often = np.flatnonzero(maybe[tokens >> np.uint64(44)])
            place = np.minimum(np.searchsorted(frequent, tokens[often]), max(len(frequent) - 1, 0))
            real = frequent[place] == tokens[often] if len(frequent) else np.zeros(0, dtype=bool)
            often, place = often[real], place[real]
            ids = stream(*[pa.concat_arrays([h[k] for h in held]) for k in (0, 1)])
            out.add(batch % buckets, OWN, i=batch, p=ids, q=n.tobytes(), r=b"".join([digest(s) for s in sets]), s=np.stack([doc[often], place]).astype("<u4").tobytes())
            left = np.ones(len(tokens), dtype=bool)
            left[often] = False
            tokens, doc = tokens[left], doc[left].astype("<u2" if len(sets) < 1 << 16 else "<u4")
            order, parts = split((tokens % np.uint64(buckets)).astype(np.int32))
            tokens, doc = tokens[order], doc[order]
            for to, lo, hi in parts:
                out.add(to, TOKENS, src=to, i=batch, p=tokens[lo:hi].tobytes(), q=doc[lo:hi].tobytes())
            yield from out.ready()
            held.clear()
            batch, many = batch + 1, 0

        for b in pieces(batches, 1 << 20):
            if b.num_rows:
                sets = [shingles(t) for t in as_bytes(b.column(2))]
                held.append((b.column(0), b.column(1), sets))
                many += sum(len(s) for s in sets)
                if many >= least:
                    yield from flush()
        if held:
            yield from flush()
        yield from out.ready(last=True)

    return run


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents the tokens of a bucket are; those of one only are left out."""
    out = Out()

    def each(state: list, row: tuple) -> None:
        if row[1] == OWN:
            out.add(0, OWN, 0, *row[3:])
        else:
            state.append((row[2], row[3], np.frombuffer(row[4], np.uint64), np.frombuffer(row[5], f"<u{len(row[5]) * 8 // len(row[4])}")))

    def end(state: list) -> None:
        if not state:
            return
        _, which, n = np.unique(np.concatenate([t for _, _, t, _ in state]), return_inverse=True, return_counts=True)
        n = n[which]
        at = 0
        for src, batch, tokens, doc in state:
            here = n[at : at + len(tokens)]
            at += len(tokens)
            some = here > 1
            if some.any():
                out.add(0, SHARED, src=src, i=batch, p=tokens[some].tobytes(), q=doc[some].astype("<u4").tobytes(), r=pack_counts(here[some]))

    yield from grouped(batches, 0, lambda to: [], each, end, out)


def _chooser(percent: int):
    """Rows with the tokens of their prefixes that other rows have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches()

        def each(state: dict, row: tuple) -> None:
            if row[1] == OWN:
                state["own"] = row
            else:
                state["shared"].append((np.frombuffer(row[5], "<u4"), unpack_counts(row[6]), np.frombuffer(row[4], np.uint64)))

        def end(state: dict) -> None:
            _, _, _, _, ids, sizes, digests, often = state["own"]
            (own, mark), n = streamed(ids), np.frombuffer(sizes, np.int64)
            doc, place = np.frombuffer(often, "<u4").reshape(2, -1)
            # frequent tokens come after all others, by their place
            parts = [*state["shared"], (doc, place.astype(np.int64) + (1 << 40), place.astype(np.uint64))]
            doc, rarity, token = (np.concatenate(x) for x in zip(*parts, strict=True))
            here = np.bincount(doc, minlength=len(n))
            wanted = np.maximum(prefix(n, percent) - (n - here), 0)
            use = wanted[doc] > 0
            doc, rarity, token = doc[use], rarity[use], token[use]
            order = np.lexsort((token, rarity, doc))
            doc, token = doc[order], token[order]
            rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
            keep = rank < wanted[doc]
            doc, token = doc[keep], token[keep]
            ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(n)))]
            keys = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(token.view(np.int64)))
            names = [digests[16 * i : 16 * i + 16] if n[i] else None for i in range(len(n))]
            for at in range(0, len(n), 4096):
                out.rows.append(pa.RecordBatch.from_arrays([own[at : at + 4096], mark[at : at + 4096], pa.array(n[at : at + 4096]), pa.array(names[at : at + 4096], pa.binary()), keys[at : at + 4096]], ["__id", "__mark", "n_shingles", "node", "buckets"]))

        yield from grouped(batches, 3, lambda batch: {"shared": []}, each, end, out)

    return run


def _reader(width: int):
    """(node, set) of the rows whose text still has that set."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for b in pieces(batches, 1 << 20):
            sets = [shingles(t) for t in as_bytes(b.column(1))]
            good = [i for i, (s, n) in enumerate(zip(sets, b.column(0).to_pylist(), strict=True)) if len(s) and digest(s) == n]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good, pa.int64())), pa.array([sets[i].tobytes() for i in good], pa.binary())], ["node", "tokens"])

    return read


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Numbers of common tokens of each set of a with each of b."""
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    tokens = np.concatenate([*a, *b])
    rows = np.repeat(np.arange(len(a) + len(b), dtype=np.int32), [len(s) for s in (*a, *b)])
    order = np.argsort(tokens, kind="stable")
    tokens, rows = tokens[order], rows[order]
    first = np.r_[True, tokens[1:] != tokens[:-1]]
    column = np.cumsum(first) - 1
    in_a = rows < len(a)
    # only tokens on both sides count
    both = np.bincount(column, in_a) * np.bincount(column, ~in_a) > 0
    use = both[column]
    rows, column, in_a = rows[use], (np.cumsum(both) - 1)[column[use]], in_a[use]
    wide = max(64, (1 << 21) // (len(a) + len(b)))
    starts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + wide, wide))
    for i, (lo, hi) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        if lo == hi:
            continue
        m = np.zeros((len(a) + len(b), wide), dtype=np.float32)
        m[rows[lo:hi], column[lo:hi] - i * wide] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def links(a: list[np.ndarray], b: list[np.ndarray] | None, num: int) -> np.ndarray:
    """(n, 2) links between a and b, or within a (b None); indices into each side."""
    other = a if b is None else b
    if not a or not other:
        return np.zeros((0, 2), dtype=np.int64)
    size, others = np.array([len(s) for s in a]), np.array([len(s) for s in other])
    # small groups of similar sets: near in their least tokens and in size
    order = sorted(range(len(other)), key=lambda i: (int(other[i][0]), len(other[i])))
    groups = [order[i : i + GROUP_SETS] for i in range(0, len(order), GROUP_SETS)]
    unions = [np.unique(np.concatenate([other[i] for i in g])) for g in groups]
    # the matrix of tokens and groups: overlaps of every set with every union
    overlap = _common(a, unions).astype(np.int64)
    found = []
    for g, inside in zip(groups, overlap.T, strict=True):
        g = np.array(g)
        opened = np.flatnonzero((100 * inside >= num * size) & (100 * others[g].max() >= num * size) & (100 * size >= num * others[g].min()))
        if not len(opened):
            continue
        common = _common([a[i] for i in opened], [other[i] for i in g]).astype(np.int64)
        x, y = np.nonzero(100 * common >= num * (size[opened][:, None] + others[g][None, :] - common))
        found.append(np.stack([opened[x], g[y]], axis=1))
    out = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
    return out[out[:, 0] < out[:, 1]] if b is None else out


def _solver(num: int):
    def solved(side: dict[int, list], same: bool) -> pa.RecordBatch | None:
        a, b = side[0], side[1]
        own = a + b
        # of two blocks one may be empty; what is within the other is the task of that block with itself
        if len(own) < 2 or (not same and not (a and b)):
            return None
        found = links([r[2] for r in a], [r[2] for r in b] if b else None, num)
        if not len(found):
            return None
        if b:
            found = found + np.array([0, len(a)])
        top = list(range(len(own)))

        def find(i: int) -> int:
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return i

        n_links = np.zeros(len(own), dtype=np.int64)
        weight = np.array([r[1] for r in own], dtype=np.int64)
        np.add.at(n_links, found[:, 0], weight[found[:, 1]])
        np.add.at(n_links, found[:, 1], weight[found[:, 0]])
        for i, j in found.tolist():
            i, j = find(i), find(j)
            if i != j:
                top[max(i, j)] = min(i, j)
        linked = np.flatnonzero(n_links).tolist()
        return pa.RecordBatch.from_arrays([pa.array([own[i][0] for i in linked], pa.binary()), pa.array([own[find(i)][0] for i in linked], pa.binary()), pa.array(n_links[linked])], ["node", "neighbour", "n_links"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, same, side = None, True, {0: [], 1: []}
        for b in batches:
            for key, part, node, weight, tokens, one in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if key != now:
                    if now is not None and (out := solved(side, same)) is not None:
                        yield out
                    now, same, side = key, one, {0: [], 1: []}
                side[part].append((node, weight, np.frombuffer(tokens, dtype=np.uint64)))
        if now is not None and (out := solved(side, same)) is not None:
            yield out

    return solve


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """key, n_shingles, component_id, n_links for each row of docs; n_links counts the other rows it is linked with."""
    return _classes(docs, key, text, width, percent).select(F.col("__id").alias(key), "n_shingles", "component_id", "n_links")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each class, all columns: the one with the least key. Texts without words are a class each row.

    The keys that go are broadcast while they are few (BROADCAST), else joined; rows that share a key are told apart by
    their sets, and of rows equal in both one stays.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    classes = scratch.write("jaccard-all", _classes(docs, key, text, width, percent).where("node is not null").select("__id", "node", "root"))
    stays = classes.groupBy("root").agg(F.min(F.struct("__id", "node")).alias("k")).select(F.col("k.__id").alias("__k"), F.col("k.node").alias("__kn"))
    stays = scratch.write("jaccard-stays", stays)
    goes = classes.join(stays, F.col("__id").eqNullSafe(F.col("__k")) & (F.col("node") == F.col("__kn")), "left_anti").select("__id", "node").distinct()
    goes = scratch.write("jaccard-goes", goes)
    shared = scratch.write("jaccard-shared", classes.groupBy("__id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("__id").alias("__shared")))

    def picked(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= BROADCAST else ids

    gone = goes.select("__id").distinct()
    if shared.isEmpty():
        return docs.join(picked(gone), docs[key].eqNullSafe(gone["__id"]), "left_anti")
    clear = docs.join(picked(shared), docs[key].eqNullSafe(shared["__shared"]), "left_anti")
    clear = clear.join(picked(gone), clear[key].eqNullSafe(gone["__id"]), "left_anti")
    some = docs.join(picked(shared), docs[key].eqNullSafe(shared["__shared"]), "left_semi")
    row = some.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(key).alias("__id"), F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in row.schema.fields[:-1])
    row = scratch.write("jaccard-shared-rows", row.mapInArrow(_namer(width), f"{fields}, node binary"))
    words_ = row.where("node is not null").join(goes.withColumnsRenamed({"__id": "__g", "node": "__gn"}), F.col("__id").eqNullSafe(F.col("__g")) & (F.col("node") == F.col("__gn")), "left_anti").dropDuplicates(["__id", "node"])
    return clear.unionByName(words_.unionByName(row.where("node is null")).select("__row.*"))


def _namer(width: int):
    """The digest of the set in place of the text, which is the last column."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for b in pieces(batches, 1 << 20):
            sets = [shingles(t) for t in as_bytes(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([digest(x) if len(x) else None for x in sets], pa.binary())], [*b.schema.names[:-1], "node"])

    return name


def _classes(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """__id, n_shingles, node, root, component_id, n_links for each row of docs."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    small_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("__id"), F.xxhash64(text).alias("__mark"), F.col(text).alias("__text"))
    sizes = own.agg(F.sum(F.octet_length("__text")).alias("bytes"), F.count("*").alias("n")).first()
    buckets = max(1, -(-int(sizes["bytes"] or 0) // BUCKET))
    share = min(1.0, SAMPLE / max(sizes["n"], 1))
    some = own.where(F.pmod(F.xxhash64("__id", "__mark", F.lit(5)), F.lit(1 << 20)) < share * (1 << 20)).select("__text")
    often = some.mapInArrow(_sampler(width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    often = [r["token"] for r in often.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()]  # 8 bytes each
    frequent = np.sort(np.array(often, dtype=np.int64).view(np.uint64))
    asked = own.mapInArrow(_asker(width, frequent, buckets), ROWS).repartition("to").sortWithinPartitions("to", "kind", "i")
    told = asked.mapInArrow(_counter, ROWS).repartition("i").sortWithinPartitions("i", "kind", "src")
    rows = scratch.write("jaccard-rows", told.mapInArrow(_chooser(percent), f"__id {kind}, __mark long, n_shingles long, node binary, buckets array<long>"))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min(F.struct("__id", "__mark")).alias("__first"), F.min("__id").alias("__least"), F.count("*").alias("__weight"), F.first("n_shingles").alias("__n"), F.first("buckets").alias("buckets"))
    nodes = scratch.write("jaccard-nodes", nodes)
    spread = nodes.select("node", F.explode("buckets").alias("bucket"))
    # buckets with one set are most of them and go before the join
    hubs = spread.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("__k")).where("__k > 1").select(F.col("bucket").alias("__b"), "hub")
    hubs = scratch.write("jaccard-buckets", hubs)
    near = spread.join(hubs, F.col("bucket") == F.col("__b")).where("hub <> node").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    groups = components(near, scratch).withColumnRenamed("root", "__group").withColumnRenamed("node", "__node")
    members = nodes.drop("buckets").join(groups, F.col("node") == F.col("__node")).drop("__node")
    members = scratch.write("jaccard-members", members)
    sizes = members.groupBy("__group").agg(F.count("*").alias("__c"), F.sum("__n").alias("__t"))
    blocks = F.greatest(F.ceil(F.col("__c") / BLOCK_SETS), F.ceil(F.col("__t") / BLOCK_TOKENS)).cast("int")
    sizes = scratch.write("jaccard-groups", sizes.select(F.col("__group").alias("__g"), blocks.alias("__blocks")))
    placed = members.join(sizes, F.col("__group") == F.col("__g")).drop("__g")
    # texts of the members only: their ids go to the texts while they are few, else both are shuffled
    picked = placed.select("node", F.col("__first.__id").alias("__id"), F.col("__first.__mark").alias("__mark"))
    count = members.count()
    picked = F.broadcast(picked) if count <= BROADCAST else picked.hint("shuffle_hash")
    sets = own.join(picked, own["__id"].eqNullSafe(picked["__id"]) & (own["__mark"] == picked["__mark"])).select("node", "__text").mapInArrow(_reader(width), "node binary, tokens binary")
    sets = scratch.write("jaccard-sets", sets.dropDuplicates(["node"])) if count else sets
    s = sets.select(F.col("node").alias("__s"), "tokens")
    full = placed.join(s, F.col("node") == F.col("__s"))
    block = F.pmod(F.xxhash64("node", F.lit(5)), F.col("__blocks")).cast("int")
    full = full.withColumn("__own", block).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    pair = F.struct("__group", F.least("__own", "__other").alias("i"), F.greatest("__own", "__other").alias("j"))
    full = full.select(pair.alias("__pair"), F.when(F.col("__own") > F.col("__other"), 1).otherwise(0).alias("__side"), "node", "__weight", "tokens", (F.col("__own") == F.col("__other")).alias("__same"))
    full = full.select(F.md5(F.concat_ws("|", F.hex("__pair.__group"), "__pair.i", "__pair.j")).alias("__task"), "__side", "node", "__weight", "tokens", "__same")
    tasks = full.repartition("__task").sortWithinPartitions("__task", "__side")
    found = scratch.write("jaccard-links", tasks.mapInArrow(_solver(percent), "node binary, neighbour binary, n_links long"))
    scratch.drop(sets) if count else None
    classes = components(found.select(F.col("node").alias("a"), F.col("neighbour").alias("b")), scratch)
    degree = found.groupBy("node").agg(F.sum("n_links").alias("__near")).withColumnRenamed("node", "__d")
    own_class = nodes.drop("buckets").join(classes.withColumnRenamed("node", "__c"), F.col("node") == F.col("__c"), "left").join(degree, F.col("node") == F.col("__d"), "left")
    own_class = scratch.write("jaccard-classes", own_class.select("node", "__least", "__weight", F.coalesce("root", "node").alias("__root"), F.coalesce("__near", F.lit(0)).alias("__near")))
    names = own_class.groupBy("__root").agg(F.min("__least").alias("component_id")).withColumnRenamed("__root", "__r")
    named = scratch.write("jaccard-names", own_class.join(names, F.col("__root") == F.col("__r")).select(F.col("node").alias("__x"), F.col("__root").alias("root"), "component_id", (F.col("__weight") - 1 + F.col("__near")).alias("n_links")))
    scratch.drop(nodes, own_class)
    out = rows.select("__id", "n_shingles", "node").join(named, F.col("node") == F.col("__x"), "left")
    component = F.when(F.col("node").isNull(), F.col("__id")).otherwise(F.col("component_id"))
    return out.select("__id", "n_shingles", "node", "root", component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
