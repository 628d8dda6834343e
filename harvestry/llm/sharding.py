"""Sharding by extendible hashing (operator 1, DataFrame functions only).

The directory is indexed by the leading bits of a hash of the key. A bucket over the byte limit is split on the next bit,
and only that bucket, until every bucket fits. Sizes are summed per cell of equal leading bits before they are shuffled,
and all depths are rolled up from the cells in one aggregate, so the documents are read once and plans are equally small
whatever the depth. Only tables of few rows are broadcast.

The hash has 120 bits: 60 of the MD5 of the key, then 60 that differ from row to row, so that rows with one key can still be
split (rows with a null key hash as the empty key). A single row beyond the limit stays alone in its shard. A null text has
no bytes. Empty input gives an empty result. Only the columns in ``keep`` are carried; they may have any names that do not
begin with two underscores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.llm.store import Scratch

#: Bits of one half of the hash.
HALF = 60
#: Bytes of text in a shard at most.
LIMIT = 64 << 20
#: Bits that a round looks ahead beyond the bits that equal buckets would need.
AHEAD = 3
#: Rows of a table that may be broadcast; joins with more shuffle both sides, whatever the files' size.
FEW = 10_000


def _bits60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _cell(depth: int) -> list[Column]:
    """The first depth bits of the hash as two numbers."""
    if depth <= HALF:
        return [F.shiftright("__h", HALF - depth).alias("__a"), F.lit(0).cast("long").alias("__b")]
    return [F.col("__h").alias("__a"), F.shiftright("__t", 2 * HALF - depth).alias("__b")]


def _name(half: str) -> Column:
    """The bits of a prefix of ``depth`` bits, 1 at least, as text; half is the number that its last bit is in."""
    if half == "__a":
        return F.lpad(F.bin("__pa"), F.col("depth"), "0")
    return F.concat(F.lpad(F.bin("__pa"), HALF, "0"), F.lpad(F.bin("__pb"), F.col("depth") - HALF, "0"))


def _prefix(half: str, depth: int) -> dict[str, Column]:
    """The prefix of ``__d`` bits of a cell of depth bits, as two numbers."""
    up = F.expr(f"shiftright({half}, {depth} - __d)")
    return {"__pa": up, "__pb": F.lit(0).cast("long")} if half == "__a" else {"__pa": F.col("__a"), "__pb": up}


def _buckets(cells: DataFrame, low: int, depth: int, limit: int) -> DataFrame:
    """depth, __pa, __pb, shard, shard_bytes, shard_rows, __open for the shallowest prefixes that cover the cells and fit.

    Of prefixes that do not fit at the last depth, ``__open`` is true. What fits, fits at all greater depths, so these are the
    prefixes whose parent does not fit. The two children of a parent meet in one row of the aggregate.
    """
    half = "__a" if depth <= HALF else "__b"
    number = "__pa" if half == "__a" else "__pb"
    each = cells.select("__a", "__b", "__n", "__r", F.explode(F.sequence(F.lit(low + 1), F.lit(depth))).alias("__d")).withColumns(_prefix(half, depth))
    each = each.withColumns({"__bit": F.col(number).bitwiseAND(1), number: F.shiftright(number, 1)})
    sums = [F.coalesce(F.sum(F.when(F.col("__bit") == bit, F.col(c))), F.lit(0)).alias(f"{c}{bit}") for bit in (0, 1) for c in ("__n", "__r")]
    pairs = each.groupBy("__d", "__pa", "__pb").agg(*sums).where((F.col("__n0") + F.col("__n1") > limit) & (F.col("__r0") + F.col("__r1") > 1))
    child = [F.struct((F.col(number) * 2 + bit).alias("own"), F.col(f"__n{bit}").alias("n"), F.col(f"__r{bit}").alias("r")) for bit in (0, 1)]
    found = pairs.select("__d", "__pa", "__pb", F.explode(F.array(*child)).alias("__c")).where("__c.r > 0").withColumn(number, F.col("__c.own"))
    fits = (F.col("__c.n") <= limit) | (F.col("__c.r") == 1) | (F.col("__d") == 2 * HALF)
    found = found.where(fits | (F.col("__d") == depth)).select(F.col("__d").alias("depth"), "__pa", "__pb", F.col("__c.n").alias("shard_bytes"), F.col("__c.r").alias("shard_rows"), (~fits).alias("__open"))
    return found.withColumn("shard", _name(half))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df.hint("merge")


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    """keep, n_bytes, shard (its prefix bits), depth, shard_bytes, shard_rows for each row of docs."""
    scratch = Scratch(docs.sparkSession)
    own = F.coalesce(F.col(key).cast("string"), F.lit(""))
    keys = docs.select(*[F.col(k).alias(k) for k in keep], F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), _bits60(own).alias("__h"), F.monotonically_increasing_id().alias("__row"))
    keys = keys.withColumn("__t", _bits60(F.concat_ws("|", F.col("__h").cast("string"), F.col("__row").cast("string")))).drop("__row")
    keys = scratch.write("shard-keys", keys)
    total, rows = keys.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    if total <= limit or rows <= 1:
        return keys.select(*keep, "n_bytes", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(total).cast("long").alias("shard_bytes"), F.lit(rows).cast("long").alias("shard_rows"))
    done, low, left = [], 0, keys
    depth = min(HALF, max(0, math.ceil(math.log2(max(total, 1) / max(limit, 1)))) + AHEAD)
    while True:
        cells = left.select(*_cell(depth), "n_bytes").groupBy("__a", "__b").agg(F.sum("n_bytes").alias("__n"), F.count("*").alias("__r"))
        cells = scratch.write("shard-cells", cells)
        buckets = scratch.write("shard-buckets", _buckets(cells, low, depth, limit))
        n_buckets, n_open, least = buckets.agg(F.count("*"), F.count_if("__open"), F.min("depth")).first()
        # each cell may look up its prefix of every depth that a bucket has; it has one bucket
        wide = cells.select("__a", "__b", F.explode(F.sequence(F.lit(least), F.lit(depth))).alias("__d")).withColumns(_prefix("__a" if depth <= HALF else "__b", depth))
        buckets_ = buckets.withColumnsRenamed({"__pa": "__qa", "__pb": "__qb"})
        found = wide.join(_small(buckets_, n_buckets), (F.col("__d") == F.col("depth")) & (F.col("__pa") == F.col("__qa")) & (F.col("__pb") == F.col("__qb")))
        leaf = scratch.write("shard-leaves", found.select(F.col("__a").alias("__la"), F.col("__b").alias("__lb"), "depth", "shard", "shard_bytes", "shard_rows", "__open"))
        scratch.drop(cells, buckets)
        n_cells = leaf.count()
        placed = left.withColumns(dict(zip(("__a", "__b"), _cell(depth), strict=True)))
        on = (F.col("__a") == F.col("__la")) & (F.col("__b") == F.col("__lb"))
        done.append(placed.join(_small(leaf.where("not __open"), n_cells), on).select(*keep, "n_bytes", "shard", "depth", "shard_bytes", "shard_rows"))
        if not n_open:
            break
        left = scratch.write("shard-open", placed.join(_small(leaf.where("__open"), n_cells), on, "left_semi").select(*left.columns))
        low, depth = depth, min(HALF if depth < HALF else 2 * HALF, depth + 8)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> None:
    """docs, all columns, as Parquet with a folder for each shard."""
    placed = shard(docs, key, text, tuple(docs.columns), limit)
    placed.repartition("shard").write.partitionBy("shard").parquet(path)


def oracle(limit: int = LIMIT) -> str:
    """What shard() gives on documents, in DuckDB; the row bits matter only for rows that share a doc_id."""
    return f"""
with recursive keys as (
  select doc_id, octet_length(encode(coalesce(text, '')))::bigint as n_bytes, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from documents
), sums as (
  select d, h >> ({HALF} - d) as p, sum(n_bytes)::bigint as n, count(*) as r from keys, generate_series(0, {HALF}) as g(d) group by all
), leaves as (
  select * from sums where n <= {limit} or r = 1
)
select doc_id, n_bytes, first(case when d = 0 then '' else lpad(bin(p), d::int, '0') end order by d) as shard, min(d)::int as depth,
  first(n order by d) as shard_bytes, first(r order by d) as shard_rows
from keys join leaves on p = h >> ({HALF} - d) group by doc_id, n_bytes, h
"""
