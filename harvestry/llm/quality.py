"""Quality rules with verdicts on hosts (operator 7, DataFrame functions only).

Every document gets counts of its words, symbols, repeated lines and repeated three-word windows. Rule failures are
aggregated by host, the failure rates are shrunk towards the corpus with a beta prior fitted to the hosts by moments, and
hosts whose shrunken rate is beyond a limit take all their documents down.

Cases: a null text counts as a text without words and fails the base rules. A null host is no host: its documents keep
the base verdict. Rows that repeat a doc_id are judged each by its own text. Input columns may have any names; the
result holds only the columns named below. Empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.llm.store import Scratch

SPACE = r"[\x20\x09-\x0D]+"
#: Bits of a packed window that hold its position; longer texts go the slow way.
POSITION_BITS = 22
#: A host goes if the shrunken failure rate of one of its rules is above this.
HOST_LIMIT = 0.5
#: Documents that the prior counts for at least, so that one document never decides about its host.
LEAST_PRIOR = 5.0
#: Rejected hosts up to which they are broadcast.
BROADCAST = 100_000
#: Document rules besides the base rules, judged by host only: share of symbols in word characters, of repeated lines.
SYMBOL_SHARE, LINE_SHARE = 0.1, 0.3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
RULES = ("short", "repetitive", "symbols", "lines")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(positions: Column) -> Column:
    """Words covered by three-word windows at these ascending positions."""
    steps = F.zip_with(positions, F.slice(positions, 2, F.greatest(F.size(positions), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)


def _sorted_neighbours(keys: Column, positions: Column, same) -> Column:
    """Positions, ascending, of the entries of sorted keys that are like an entry beside them."""
    n = F.size(keys)
    like_next = F.zip_with(keys, F.slice(keys, 2, n), lambda a, b: F.coalesce(same(a, b), F.lit(False)))
    return _let(like_next, lambda flags: F.array_sort(F.filter(F.transform(positions, lambda p, i: F.when(F.get(flags, i) | F.coalesce(F.get(flags, i - 1), F.lit(False)), p)), lambda p: p.isNotNull())))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with COUNTS (long) of the whole text in place of the text.

    Windows are compared by 64-bit hashes, packed as 42 hash bits and 22 position bits so that one primitive sort brings
    equal windows together; where two neighbours agree in the 42 bits but not in their words, or a text has over 4 million
    words, the windows themselves are sorted instead. The counts are exact either way.
    """
    text_ = F.coalesce(F.col(text), F.lit(""))
    others = [c for c in docs.columns if c != text]
    lines = F.filter(F.split(text_, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select(*others, F.array_remove(F.split(text_, SPACE), "").alias("__w"), lines.alias("__l"), F.regexp_count(text_, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))
    w, mask = F.col("__w"), (1 << POSITION_BITS) - 1
    hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))), 1, F.greatest(F.size(w) - 2, F.lit(0)))
    d = d.select(*others, "__w", "n_symbols", F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), F.size("__l").cast("long").alias("n_lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), F.sort_array(hashes).alias("__h"))
    h = F.col("__h")
    # positions whose hash bits agree with the entry before or after
    pairs = F.filter(F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.when(F.shiftrightunsigned(a, POSITION_BITS) == F.shiftrightunsigned(b, POSITION_BITS), F.struct(a.bitwiseAND(F.lit(mask)).cast("int").alias("a"), b.bitwiseAND(F.lit(mask)).cast("int").alias("b")))), lambda p: p.isNotNull())
    d = d.select(*others, "__w", *[c for c in COUNTS if c != "n_repeat_words"], pairs.alias("__p"))
    p = F.col("__p")
    # array and size are read more than once below, so the optimiser keeps this projection apart
    at = lambda i, k: F.get(w, i + k)
    honest = F.forall(p, lambda x: (at(x.a, 0) == at(x.b, 0)) & (at(x.a, 1) == at(x.b, 1)) & (at(x.a, 2) == at(x.b, 2)))
    fast = _covered(F.array_sort(F.array_distinct(F.flatten(F.transform(p, lambda x: F.array(x.a, x.b))))))
    windows = F.array_sort(F.slice(F.transform(w, lambda x, i: F.struct(F.array(x, at(i, 1), at(i, 2)).alias("w"), i.alias("i"))), 1, F.greatest(F.size(w) - 2, F.lit(0))))
    slow = _let(windows, lambda s: _covered(_sorted_neighbours(F.transform(s, lambda x: x.w), F.transform(s, lambda x: x.i), lambda a, b: a == b)))
    repeated = F.when(F.col("n_words") > mask, slow).when(F.size(p) == 0, F.lit(0).cast("long")).when(honest, fast).otherwise(slow)
    return d.select(*others, *[c for c in COUNTS if c != "n_repeat_words"], repeated.alias("n_repeat_words"))


def failures() -> dict[str, Column]:
    """The document rules over COUNTS; true where a document fails. The first two are the base rules."""
    c = {k: F.col(k) for k in COUNTS}
    return {
        "short": c["n_words"] < 50,
        "repetitive": 100 * c["n_repeat_words"] > 50 * c["n_words"],
        "symbols": c["n_symbols"] > SYMBOL_SHARE * c["word_chars"],
        "lines": c["n_dup_lines"] > LINE_SHARE * c["n_lines"],
    }


def hosts(judged: DataFrame, host: str, scratch: Scratch, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: (host, n_host, rate_<rule> shrunken, host_rejected).

    The prior of a rule is the beta distribution whose mean and variance are those of the rates of the hosts, weighted by
    their documents; where the hosts do not vary beyond chance, it is so strong that all get the corpus rate.
    """
    by = judged.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n_host"), *[F.sum(F.col(f"__{r}").cast("long")).alias(f"f_{r}") for r in RULES])
    by = scratch.write("quality-by-host", by)
    n = F.col("n_host")
    one = by.agg(
        F.sum(n).alias("__n"), F.count("*").alias("__k"), F.sum(n.cast("double") * n).alias("__n2"),
        *[F.sum(f"f_{r}").alias(f"__s_{r}") for r in RULES],
        *[F.sum(F.col(f"f_{r}").cast("double") * F.col(f"f_{r}") / n).alias(f"__q_{r}") for r in RULES],
    )
    m = one.first()
    total, k = float(m["__n"] or 0), int(m["__k"])
    rates = []
    for r in RULES:
        mean = float(m[f"__s_{r}"] or 0) / total if total else 0.0
        between = 0.0
        if k > 1:
            spare = total - float(m["__n2"]) / total
            between = (float(m[f"__q_{r}"]) - total * mean * mean - (k - 1) * mean * (1 - mean)) / spare if spare > 0 else 0.0
        strength = min(max(mean * (1 - mean) / between - 1, LEAST_PRIOR), 1e6) if between > 0 else 1e6
        rates.append(((F.col(f"f_{r}") + mean * strength) / (n + strength)).alias(f"rate_{r}"))
    out = by.select(host, "n_host", *rates)
    return out.withColumn("host_rejected", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > limit)


def quality(docs: DataFrame, host: str = "source", text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: float = HOST_LIMIT, wide: bool = False) -> DataFrame:
    """keep, COUNTS, base_failed, host_rejected, kept for each row of docs. host and keep are columns of docs.

    Judged rows are written once, for hosts and for the result; with wide, for a keep that holds texts, nothing of the rows is
    written and the texts are judged twice.
    """
    scratch = Scratch(docs.sparkSession)
    named = docs.select(*[F.col(k).alias(k) for k in keep], F.col(host).alias("__host"), F.col(text).alias("__text"))
    judged = counts(named, "__text")
    if wide:  # a row number in kept: a filter on it stays above the counts, whose long expressions it would copy
        judged = judged.withColumn("__barrier", F.monotonically_increasing_id())
    judged = judged.withColumns({f"__{r}": c for r, c in failures().items()})
    judged = judged if wide else scratch.write("quality", judged)
    verdicts = scratch.write("quality-hosts", hosts(judged, "__host", scratch, limit).where("host_rejected").select(F.col("__host").alias("__bad")))
    # hosts that go are few beside documents, yet not bounded: beyond BROADCAST they are joined by a shuffle
    verdicts = F.broadcast(verdicts) if verdicts.count() <= BROADCAST else verdicts
    joined = judged.join(verdicts, judged["__host"] == verdicts["__bad"], "left")
    base = F.col("__short") | F.col("__repetitive")
    rejected = F.col("__bad").isNotNull()
    kept = ~base & ~rejected & ((F.col("__barrier") >= 0) if wide else F.lit(True))
    return joined.select(*keep, *COUNTS, base.alias("base_failed"), rejected.alias("host_rejected"), kept.alias("kept"))


def _rate_sql(rule: str) -> str:
    """The shrunken failure rate of a rule in DuckDB, over by_host and one."""
    mean = f"(s_{rule} / total)"
    between = f"case when k > 1 and total - n2 / total > 0 then (q_{rule} - total * {mean} * {mean} - (k - 1) * {mean} * (1 - {mean})) / (total - n2 / total) else 0 end"
    strength = f"case when {between} > 0 then least(greatest({mean} * (1 - {mean}) / ({between}) - 1, {LEAST_PRIOR}), 1e6) else 1e6 end"
    return f"(f_{rule} + {mean} * ({strength})) / (n + ({strength}))"


def oracle(limit: float = HOST_LIMIT) -> str:
    """What quality() gives on documents, in DuckDB."""
    return rf"""
with d as (
  select row_number() over () as rid, doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents
), windows as (
  select rid, i, count(*) over (partition by rid, w[i], w[i + 1], w[i + 2]) > 1 as again from (select rid, w, unnest(range(1, len(w) - 1)) as i from d)
), covered as (
  select rid, count(distinct p) as n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) as p from windows where again) group by rid
), c as (
  select d.rid, doc_id, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines
  from d left join covered on d.rid = covered.rid
), r as (
  select *, n_words < 50 as short, 100 * n_repeat_words > 50 * n_words as repetitive, n_symbols > {SYMBOL_SHARE} * word_chars as symbols, n_dup_lines > {LINE_SHARE} * n_lines as lines from c
), by_host as (
  select source, count(*)::double as n, {", ".join(f"count(*) filter ({x})::double as f_{x}" for x in RULES)} from r where source is not null group by source
), one as (
  select sum(n) as total, count(*) as k, sum(n * n) as n2, {", ".join(f"sum(f_{x}) as s_{x}, sum(f_{x} * f_{x} / n) as q_{x}" for x in RULES)} from by_host
), bad as (select source from by_host, one where greatest({", ".join(_rate_sql(x) for x in RULES)}) > {limit})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, short or repetitive as base_failed, source is not null and source in (from bad) as host_rejected,
  not (short or repetitive) and not (source is not null and source in (from bad)) as kept from r
"""
