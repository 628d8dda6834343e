"""Language-model scoring with hierarchical Pitman-Yor restaurants (operator 4).

Tokens are the lower-cased words and an end after each text. Every word of the training texts, and the end, is a context with
a restaurant of its own over the tokens that follow it; all these share one parent, the root restaurant over all words. A
customer that a context seats at a new table is a customer of the root. The root's base is diffuse: each of its tables is
another word, and a new table is a word that training does not have. So the root gives word w (customers - d0) / (s0 + all
customers), and all unknown words together (s0 + d0 * words) / (s0 + all customers); the outcomes are those of the base score.

Gibbs sampling: a state is the number of tables of every pair of words, for the rest of a seating does not matter (seating.py).
A pair that occurs once has one table. Each sweep draws the tables of every other pair given the tables of all other pairs in
its context and at the root as they were after the sweep before: pairs are drawn side by side, as distributed samplers do. After
BURN sweeps, SWEEPS more are averaged: what a context keeps for a word, what it leaves to its parent, and the root's probability.
Averages of the last two are multiplied for a token, so the probabilities of a context's outcomes sum to one. A text is scored
with these averages and its perplexity follows. The discounts follow from how many counts are one and two.

Nothing that grows with the corpus is collected. Words are 64-bit hashes. Pairs live in buckets by their context, words in
buckets of their own; buckets ask each other for counts by rows of packed arrays (blobs.py), one row for all that a bucket
wants of another, so a hot word is one entry a bucket. A context with more than a bucket's share of tokens is split into
several by the word that follows. Buckets hold about BUCKET bytes of text. Documents are scored in ROUNDS parts, which bounds
the disk for their tokens. What is broadcast has a fixed bound: short codes of at most CODES frequent words (found in a
sample; they only save space) with their counts, and the scores of at most HOT pairs, those that occur most, which therefore
never travel.

Cases: a null or empty text is the end token alone. A null id is neither held out nor trained on. Repeated rows are scored
each, and counted each in training. Without training rows all counts are 0 and N and V too; the base is then
log10(0.5/0.5) = 0 a token, and so is the score. A long text may have more tokens than a batch; it is then a batch of its own.
Only ``key`` and ``text`` are read, whatever other columns there are. Empty input gives an empty result. Two words with one
hash count as one word: the chance is below 1e-4 for 50 million words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.llm.blobs import ROWS, Batches, Out, grouped, mixed, pack, pack_counts, placed, split, stream, streamed, unpack, unpack_counts
from harvestry.llm.seating import draw
from harvestry.llm.store import Scratch
from harvestry.llm.texts import as_bytes, pieces, small_batches, words

#: Bytes of text a bucket, parts that documents are scored in.
BUCKET, ROUNDS = 10 << 20, 2
#: Tokens about that a batch of documents sends to a bucket, and the least and most tokens of a batch.
ROW, BATCH = 1 << 13, (1 << 17, 1 << 19)
#: Words at most that have a short code, rows about of the sample that they are found in, and the longest such word.
CODES, SAMPLE, LONGEST = 1 << 16, 4000, 64
#: Pairs at most whose scores are broadcast, and the count from which on a histogram does not tell counts apart.
HOT, CAP = 400_000, 100_000
#: Bits of the table in which hot pairs are looked up.
HOT_PLACES = 21
#: Words whose keys a worker remembers, tokens that it counts before it hands the counts on.
REMEMBER, FLUSH = 200_000, 1_000_000
#: Strength of the contexts' restaurants and of the root.
STRENGTH, ROOT = 5.0, 50.0
BURN, SWEEPS = 2, 3
END = b"\n"  # no word holds it; its code is 0

# Kinds of rows. A bucket reads its rows in this order.
PAIRS, MULTI, FIXED, TABLES, REPLY, ASK, DISH, WORD, HISTORY, TOLD, KNOWN, TRAIN, HELD, OWN, SCORE, WANT, REST, HOTPAIR, CODE, CONTEXT, STAT, COUNTS = range(22)


class Keys(dict):
    """The key of each word: its code, or a hash that is no code."""

    def __init__(self, codes: dict[bytes, int]):
        super().__init__(codes)
        self.codes = codes

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        h = self[word] = h if h >= CODES else h | 1 << 62
        return h

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of all tokens, of the tokens before them (a text begins after an end), and the number of tokens of each text."""
        if len(self) > REMEMBER + len(self.codes):
            self.clear()
            self.update(self.codes)
        ws: list[bytes] = []
        ends = []
        for t in texts:
            ws += words(t)
            ws.append(END)
            ends.append(len(ws))
        w = np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws)).view(np.int64)
        return w, np.r_[0, w[:-1]], np.diff(np.r_[0, ends])


def named(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The key of a pair of words: four bytes for two codes, else a negative hash."""
    both = (u >= 0) & (u < CODES) & (w >= 0) & (w < CODES)
    far = (mixed(u) ^ (w.view(np.uint64) * np.uint64(0x94D049BB133111EB))) | np.uint64(1 << 63)
    return np.where(both, (u << 16) | w, far.view(np.int64))


class Places:
    """The bucket of each pair: that of its context, or one of several where a context is hot."""

    def __init__(self, buckets: int, parts: np.ndarray):
        self.buckets, self.parts = buckets, parts

    def __call__(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        code = (u >= 0) & (u < len(self.parts))
        parts = np.where(code, self.parts[np.where(code, u, 0)], 1) if len(self.parts) else np.ones(len(u), dtype=np.int64)
        salt = (mixed(w) % parts.astype(np.uint64)).view(np.int64)
        return placed(u + salt * np.int64(0x5851F42D4C957F2D), self.buckets)

    def hot(self, u: np.ndarray) -> np.ndarray:
        code = (u >= 0) & (u < len(self.parts))
        return code & (self.parts[np.where(code, u, 0)] > 1) if len(self.parts) else np.zeros(len(u), dtype=bool)


# --- counting


def _word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        n = Counter(w for t in as_bytes(b.column(0)) for w in words(t) if len(w) <= LONGEST)
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.binary()), pa.array(n.values(), pa.int64())], ["word", "n"])


def _counter(codes: dict[bytes, int], places: Places):
    """Counts of the pairs of some millions of tokens at a time, to their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, out, held, many = Keys(codes), Out(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            u, w = (np.concatenate(x) for x in zip(*held, strict=True))
            _, first, n = np.unique(named(u, w), return_index=True, return_counts=True)
            u, w = u[first], w[first]
            order, parts = split(places(u, w))
            u, w, n = u[order], w[order], n[order]
            for to, a, b in parts:
                out.add(to, PAIRS, p=pack(u[a:b]), q=pack(w[a:b]), r=pack_counts(n[a:b]))
                yield from out.ready()
            held.clear()

        for b in pieces(batches, 1 << 20):
            if b.num_rows:
                w, u, _ = keys.tokens(as_bytes(b.column(0)))
                held.append((u, w))
                many += len(w)
                if many > FLUSH:
                    yield from flush()
                    many = 0
        if held:
            yield from flush()
        yield from out.ready(last=True)

    return run


def _asked(out: Out, kind: int, b: int, w: np.ndarray, buckets: int, **counts: np.ndarray) -> None:
    """Rows to the words' buckets about distinct words in ascending order."""
    order, parts = split(placed(w, buckets))
    for to, lo, hi in parts:
        at = order[lo:hi]
        out.add(to, kind, src=b, p=pack(w[at]), **{k: pack_counts(x[at]) for k, x in counts.items()})


def _answered(rows: list[np.ndarray], w: np.ndarray, buckets: int) -> np.ndarray:
    """What the words' buckets have answered, for distinct words in ascending order."""
    order, _ = split(placed(w, buckets))
    out = np.empty(len(w), dtype=rows[0].dtype if rows else np.int64)
    out[order] = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    return out


def _merger(places: Places):
    """The pairs of a bucket with their counts, by context, and what its words' buckets must know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, buckets, stat, counts = Out(), places.buckets, Counter(), Counter()

        def end(state: tuple[int, list]) -> None:
            bucket, parts = state
            u, w, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, first, which = np.unique(named(u, w), return_index=True, return_inverse=True)
            c = np.bincount(which, c).astype(np.int64)
            u, w = u[first], w[first]
            order = np.argsort(u, kind="stable")
            u, w, c = u[order], w[order], c[order]
            once, n = np.unique(u, return_counts=True)
            out.add(bucket, PAIRS, p=pack(once), q=pack_counts(n), r=pack(w), s=pack_counts(c))
            more = c > 1
            context = np.repeat(np.arange(len(once)), n)
            alone, all_ = np.bincount(context[~more], minlength=len(once)), np.bincount(context, c, len(once)).astype(np.int64)
            used = np.unique(context[more])
            out.add(bucket, MULTI, p=pack(once[used]), q=pack_counts(np.bincount(context[more], minlength=len(once))[used]), r=pack(w[more]), s=pack_counts(c[more]))
            out.add(bucket, FIXED, p=pack_counts(alone[used]), q=pack_counts(all_[used]))
            dishes, which = np.unique(w, return_inverse=True)
            _asked(out, DISH, bucket, dishes, buckets, q=np.bincount(which, c).astype(np.int64), r=np.bincount(which, ~more).astype(np.int64))
            dishes, which = np.unique(w[more], return_inverse=True)
            _asked(out, ASK, bucket, dishes, buckets, q=np.bincount(which, minlength=len(dishes)))
            for i in np.flatnonzero(places.hot(once)):
                out.add(int(once[i]), CONTEXT, src=0, i=int(all_[i]))
                out.add(int(once[i]), CONTEXT, src=1, i=int(n[i]))
                out.add(int(once[i]), CONTEXT, src=2, i=int(alone[i]))
            stat["once"] += int((c == 1).sum())
            stat["twice"] += int((c == 2).sum())
            counts.update(dict(zip(*(x.tolist() for x in np.unique(np.minimum(c, CAP), return_counts=True)), strict=True)))

        def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from batches
            for i, k in enumerate(("once", "twice")):
                out.add(i, STAT, i=stat[k])
            for c, n in counts.items():
                out.add(c, COUNTS, i=n)
            yield from out.ready(last=True)

        each = lambda state, row: state[1].append((unpack(row[4]), unpack(row[5]), unpack_counts(row[6])))
        yield from last(grouped(batches, 0, lambda b: (b, []), each, end, out))

    return run


# --- seating


class Root:
    """The root's parameters: discount, customers and words."""

    def __init__(self, stat: dict[int, int]):
        self.all, once, twice, self.words = (stat.get(k, 0) for k in range(4))
        self.d = min(max(once / max(once + 2 * twice, 1), 0.05), 0.9)


def _word_seats(buckets: int, sweep: int, first: bool):
    """Customers of the root by word, from what the pairs' buckets say, and the answer to these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, stat = Out(), Counter()

        def each(state: dict, row: tuple) -> None:
            if row[1] == ASK:
                state["ask"].append((row[2], unpack(row[4]), unpack_counts(row[5])))
            elif row[1] == DISH:
                state["dish"].append((unpack(row[4]), unpack_counts(row[5]), unpack_counts(row[6])))
            else:
                state["w"], state["alone"] = unpack(row[4]), unpack_counts(row[6])

        def end(state: dict) -> None:
            if first:
                w, c, alone = (np.concatenate(x) for x in zip(*state["dish"], strict=True))
                state["w"], which = np.unique(w, return_inverse=True)
                c, state["alone"] = (np.bincount(which, x).astype(np.int64) for x in (c, alone))
                out.add(state["to"], WORD, p=pack(state["w"]), q=pack_counts(c), r=pack_counts(state["alone"]))
                stat[4] += int(c.sum())
                for k in np.flatnonzero((state["w"] >= 0) & (state["w"] < CODES)):
                    out.add(int(state["w"][k]), CODE, i=int(c[k]))
            w = state["w"]
            customers = state["alone"].copy()
            for _, asked, tables in state["ask"]:
                customers[np.searchsorted(w, asked)] += tables
            for to, asked, _ in state["ask"]:
                out.add(to, REPLY, src=state["to"], p=pack_counts(customers[np.searchsorted(w, asked)]))
            if sweep >= BURN:
                out.add(state["to"], HISTORY, src=sweep, p=pack_counts(customers))
            for k, x in enumerate((customers.sum(), (customers == 1).sum(), (customers == 2).sum(), len(w))):
                stat[k] += int(x)

        yield from grouped(batches, 0, lambda to: {"to": to, "ask": [], "dish": []}, each, end, out)
        for k, x in stat.items():
            out.add(k, STAT, i=x)
        yield from out.ready(last=True)

    return run


def _pair_seats(places: Places, d: float, root: Root, tables: dict[int, int], sweep: int):
    """A sweep over the pairs of a bucket; tables: of the hot contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out()

        def each(state: dict, row: tuple) -> None:
            kind = row[1]
            if kind == MULTI:
                state["u"], state["n"], state["w"], state["c"] = unpack(row[4]), unpack_counts(row[5]), unpack(row[6]), unpack_counts(row[7])
            elif kind == FIXED:
                state["alone"] = unpack_counts(row[4])
            elif kind == TABLES:
                state["t"], state["sum"] = unpack_counts(row[4]), unpack_counts(row[5])
            else:
                state["answer"].append(unpack_counts(row[4]))

        def end(state: dict) -> None:
            u, w, c = state["u"], state["w"], state["c"]
            t = state.get("t", np.ones(len(c), dtype=np.int64))
            context = np.repeat(np.arange(len(u)), state["n"])
            dishes, which = np.unique(w, return_inverse=True)
            customers = _answered(state["answer"], dishes, places.buckets)[which]
            hot = places.hot(u)
            now = np.bincount(context, t, len(u)) + state["alone"]
            now[hot] = [tables[x] for x in u[hot].tolist()]
            rng = np.random.default_rng([sweep, state["to"]])
            t = draw(c, t, d, STRENGTH, now[context] - t, customers - t - root.d, root.all - t + ROOT, rng)
            sums = state.get("sum", 0) + (t if sweep >= BURN else 0) + np.zeros(len(t), dtype=np.int64)
            out.add(state["to"], TABLES, p=pack_counts(t), q=pack_counts(sums))
            _asked(out, ASK, state["to"], dishes, places.buckets, q=np.bincount(which, t, len(dishes)).astype(np.int64))
            now = np.bincount(context, t, len(u)).astype(np.int64)
            for i in np.flatnonzero(hot):
                out.add(int(u[i]), CONTEXT, src=1, i=int(now[i]))

        yield from grouped(batches, 0, lambda to: {"to": to, "answer": []}, each, end, out)

    return run


# --- what the model says


def _word_told(roots: list[Root]):
    """The root's averaged probability of each word, and the answer to the buckets that have it in a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out()

        def each(state: dict, row: tuple) -> None:
            if row[1] == DISH:
                state["dish"].append((row[2], unpack(row[4])))
            elif row[1] == WORD:
                state["w"], state["c"] = unpack(row[4]), unpack_counts(row[5])
            else:
                state["p"].append((unpack_counts(row[4]) - roots[row[2] - BURN].d) / (ROOT + roots[row[2] - BURN].all))

        def end(state: dict) -> None:
            w, c, p = state["w"], state["c"], sum(state["p"]) / SWEEPS
            out.add(state["to"], KNOWN, p=pack(w), q=pack_counts(c), r=p.astype("<f8").tobytes())
            for to, asked in state["dish"]:
                at = np.searchsorted(w, asked)
                out.add(to, TOLD, src=state["to"], p=p[at].astype("<f8").tobytes(), q=pack_counts(c[at]))
            coded = (w >= 0) & (w < CODES)
            out.add(0, CODE, p=pack(w[coded]), q=p[coded].astype("<f8").tobytes())

        yield from grouped(batches, 0, lambda to: {"to": to, "dish": [], "p": []}, each, end, out)

    return run


class Told:
    """The pairs of a bucket: keys in order, log10 of the probability and the count of the word; contexts: what each leaves to the root."""

    def __init__(self, state: dict, places: Places, d: float, hot: dict[int, tuple[float, float]]):
        self.u, n, w, self.c = unpack(state["pairs"][4]), unpack_counts(state["pairs"][5]), unpack(state["pairs"][6]), unpack_counts(state["pairs"][7])
        t = np.ones(len(w))
        t[self.c > 1] = unpack_counts(state["tables"]) / SWEEPS
        context = np.repeat(np.arange(len(self.u)), n)
        customers, tables = np.bincount(context, self.c, len(self.u)), np.bincount(context, t, len(self.u))
        for i in np.flatnonzero(places.hot(self.u)):
            customers[i], tables[i] = hot[int(self.u[i])]
        self.left = (STRENGTH + d * tables) / (STRENGTH + customers)
        dishes, which = np.unique(w, return_inverse=True)
        p, count = (_answered([x[k] for x in state["told"]], dishes, places.buckets)[which] for k in (0, 1))
        p = (self.c - d * t) / (STRENGTH + customers)[context] + self.left[context] * p
        key = named(self.u[context], w)
        order = np.argsort(key)
        self.key, self.log10, self.count, self.coded = key[order], np.log10(p[order]), count[order], ((w >= 0) & (w < CODES))[order]
        self.times = self.c[order]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, self.key[at] == key


def _read_model(state: dict, row: tuple) -> bool:
    """Keep a row of the model in a bucket's state."""
    if row[1] == PAIRS:
        state["pairs"] = row
    elif row[1] == TABLES:
        state["tables"] = row[5]
    elif row[1] == TOLD:
        state["told"].append((np.frombuffer(row[4], "<f8"), unpack_counts(row[5])))
    else:
        return False
    return True


def _hottest(places: Places, d: float, hot: dict, least: int):
    """The pairs that occur least times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out()

        def end(state: dict) -> None:
            told = Told(state, places, d, hot)
            at = np.flatnonzero(told.times >= least)
            out.add(0, HOTPAIR, p=pack(told.key[at], 4), q=told.log10[at].astype("<f8").tobytes(), r=pack_counts(told.count[at]))

        yield from grouped(batches, 0, lambda to: {"to": to, "told": []}, _read_model, end, out)

    return run


def _base(c: np.ndarray, n: int, v: int) -> np.ndarray:
    return np.log10((c + 0.5) / (n + 0.5 * (v + 1)))


def _asker(codes: dict[bytes, int], counts: np.ndarray, places: Places, hot: tuple[np.ndarray, ...], n: int, v: int):
    """The tokens of texts, to the buckets of their pairs; what codes and hot pairs settle stays in a row of the batch."""
    hot_key, hot_log10, hot_count = hot
    least = min(max(ROW * places.buckets, BATCH[0]), BATCH[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, out = Keys(codes), Out()
        batch = TaskContext.get().partitionId() << 24
        place = np.full(1 << HOT_PLACES, -1, dtype=np.int32)  # of pairs that meet in a place one is hot, the others travel
        place[mixed(hot_key) >> np.uint64(64 - HOT_PLACES)] = np.arange(len(hot_key))

        def read() -> Iterator[tuple]:
            """Keys, keys before, tokens a text, ids and whether held, of some texts with enough tokens for a batch."""
            held, many = [], 0
            for b in pieces(batches, 1 << 20):
                if b.num_rows:
                    w, u, tokens = keys.tokens(as_bytes(b.column(1)))
                    held.append((w, u, tokens, ~b.column(2).to_numpy(zero_copy_only=False).astype(bool), b.column(0)))
                    many += len(w)
                    if many >= least:
                        yield tuple(zip(*held, strict=True))
                        held, many = [], 0
            if held:
                yield tuple(zip(*held, strict=True))

        for *parts, ids in read():
            w, u, tokens, held = (np.concatenate(x) for x in parts)
            m = len(tokens)
            doc = np.repeat(np.arange(m), tokens)
            coded = (w >= 0) & (w < CODES)
            c = np.where(coded, counts[np.where(coded, w, 0)], 0)
            key = named(u, w)
            at = place[mixed(key) >> np.uint64(64 - HOT_PLACES)]
            told = at >= 0
            told[told] = hot_key[at[told]] == key[told]
            score, clear = np.zeros(len(w)), coded | told
            if told.any():
                score[told], c[told] = hot_log10[at[told]], hot_count[at[told]]
            sums = [np.bincount(doc, x, m) for x in (np.where(clear, _base(c, n, v), 0.0), score, clear & (c > 0))]
            rest = np.flatnonzero(~told)
            order, parts = split(2 * places(u[rest], w[rest]).astype(np.int64) + held[doc[rest]])
            rest = rest[order]
            for src, lo, hi in parts:
                own = rest[lo:hi]
                if src & 1:
                    out.add(src >> 1, HELD, src=src, i=batch, p=pack(u[own]), q=pack(w[own]))
                else:
                    out.add(src >> 1, TRAIN, src=src, i=batch, p=pack(key[own], 4))
            out.add(batch % places.buckets, OWN, i=batch, p=stream(pa.concat_arrays(ids)), q=np.stack([*sums, tokens, held]).astype("<f8").tobytes(), r=doc[rest].astype("<u2" if m < 1 << 16 else "<u4").tobytes(), s=np.packbits(coded[rest]).tobytes())
            yield from out.ready()
            batch += 1
        yield from out.ready(last=True)

    return run


def _pair_scorer(places: Places, d: float, hot: dict[int, tuple[float, float]], by_code: np.ndarray):
    """The scores of the pairs that a bucket is asked for; of new pairs what the context leaves to the root, and words without a code."""
    left_of = {k: np.log10((STRENGTH + d * t) / (STRENGTH + n)) for k, (n, t) in hot.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out()

        def each(state: dict, row: tuple) -> None:
            if _read_model(state, row):
                return
            to, kind, src, batch = row[:4]
            if kind == OWN:
                out.add(to, OWN, 0, batch, *row[4:])
                return
            if "model" not in state:
                state["model"] = Told(state, places, d, hot) if "pairs" in state else None
                for k in ("pairs", "tables", "told"):
                    state.pop(k, None)
            model, later = state["model"], {}
            if kind == TRAIN:
                at, _ = model.find(unpack(row[4], 4))
                score, count = model.log10[at], model.count[at][~model.coded[at]]
            else:
                u, w = unpack(row[4]), unpack(row[5])
                coded = (w >= 0) & (w < CODES)
                score, count, known = np.zeros(len(u)), np.zeros(len(u), dtype=np.int64), np.zeros(len(u), dtype=bool)
                if model is not None:
                    at, known = model.find(named(u, w))
                    score[known], count[known] = model.log10[at[known]], model.count[at[known]]
                    place = np.minimum(np.searchsorted(model.u, u), len(model.u) - 1)
                    some = ~known & (model.u[place] == u)
                    score[some] = np.log10(model.left[place[some]])
                few = np.flatnonzero(~known & places.hot(u))
                score[few] = [left_of.get(x, 0.0) for x in u[few].tolist()]
                new = np.flatnonzero(~known & coded)
                score[new] += by_code[w[new]]
                count, new = count[~coded], np.flatnonzero(~known & ~coded)
                later = {"r": new.astype("<u4").tobytes(), "s": pack(w[new])}
            out.add(to, SCORE, src=src, i=batch, p=score.astype("<f4").tobytes(), q=pack_counts(count), **later)

        yield from grouped(batches, 0, lambda to: {"to": to, "told": []}, each, lambda state: None, out)

    return run


def _word_scorer(unknown: float):
    """The root's share of the score of new pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out()

        def each(state: dict, row: tuple) -> None:
            if row[1] == KNOWN:
                state["w"], state["c"], state["p"] = unpack(row[4]), unpack_counts(row[5]), np.frombuffer(row[6], "<f8")
                return
            w = unpack(row[5])
            p, c = np.full(len(w), unknown), np.zeros(len(w), dtype=np.int64)
            if "w" in state:
                at = np.minimum(np.searchsorted(state["w"], w), len(state["w"]) - 1)
                known = state["w"][at] == w
                p[known], c[known] = state["p"][at[known]], state["c"][at[known]]
            out.add(0, REST, src=row[2], i=row[3], p=row[4], q=np.log10(p).astype("<f4").tobytes(), r=pack_counts(c))

        yield from grouped(batches, 0, lambda to: {"to": to}, each, lambda state: None, out)

    return run


def _summer(n: int, v: int, buckets: int):
    """Sums over the tokens of a batch's documents, and words to ask the words' buckets for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out()

        def each(state: dict, row: tuple) -> None:
            if row[1] == OWN:
                state["batch"], state["ids"], state["sums"] = row[3], row[4], np.frombuffer(row[5], "<f8").reshape(5, -1)
                m = state["sums"].shape[1]
                state["doc"] = np.frombuffer(row[6], "<u2" if m < 1 << 16 else "<u4").astype(np.int64)
                state["coded"] = np.unpackbits(np.frombuffer(row[7], np.uint8), count=len(state["doc"])).astype(bool)
                return
            x = np.frombuffer(row[4], "<f4")
            if row[6]:
                state["later"].append((state["many"] + np.frombuffer(row[6], "<u4").astype(np.int64), unpack(row[7])))
            state["many"] += len(x)
            state["score"].append(x), state["count"].append(unpack_counts(row[5]))

        def end(state: dict) -> None:
            doc, coded = state["doc"], state["coded"]
            base, score, known, tokens, held = (x.copy() for x in state["sums"])
            m, c, here = len(base), np.zeros(len(doc), dtype=np.int64), ~coded
            if state["score"]:
                c[~coded] = np.concatenate(state["count"])
                score += np.bincount(doc, np.concatenate(state["score"]).astype(np.float64), m)
            if state["later"]:
                at, w = (np.concatenate(x) for x in zip(*state["later"], strict=True))
                here[at] = False
                order, parts = split(placed(w, buckets))
                asked, w = doc[at[order]].astype("<u4"), w[order]
                for wb, lo, hi in parts:
                    out.add(wb, WANT, src=wb, i=state["batch"], p=asked[lo:hi].tobytes(), q=pack(w[lo:hi]))
            base += np.bincount(doc[here], _base(c[here], n, v), m)
            known += np.bincount(doc[here], c[here] > 0, m)
            out.add(0, OWN, i=state["batch"], p=state["ids"], q=np.stack([base, score, known, tokens, held]).astype("<f8").tobytes())

        yield from grouped(batches, 3, lambda batch: {"score": [], "count": [], "later": [], "many": 0}, each, end, out)

    return run


def _finisher(n: int, v: int):
    """The documents of a batch, with what the words' buckets add to their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches()

        def each(state: dict, row: tuple) -> None:
            if row[1] == OWN:
                state["ids"], state["sums"] = streamed(row[4])[0], np.frombuffer(row[5], "<f8").reshape(5, -1).copy()
                return
            doc, c, sums = np.frombuffer(row[4], "<u4"), unpack_counts(row[6]), state["sums"]
            for k, x in ((0, _base(c, n, v)), (1, np.frombuffer(row[5], "<f4")), (2, c > 0)):
                sums[k] += np.bincount(doc, x, sums.shape[1])

        def end(state: dict) -> None:
            base, score, known, tokens, held = state["sums"]
            whole = lambda x: pa.array(x.astype(np.int64))
            out.rows.append(pa.RecordBatch.from_arrays([state["ids"], pa.array(held > 0), whole(tokens), whole(known), pa.array(np.full(len(base), n, dtype=np.int64)), pa.array(base), pa.array(score)], ["__id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))

        yield from grouped(batches, 3, lambda batch: {}, each, end, out)

    return run


# --- all of it


def remainder(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5


def _from(histogram: dict[int, int], most: int) -> int:
    """The least count such that at most most things have it or more, the last count standing for more."""
    least, many = CAP + 1, 0
    for c in sorted(histogram, reverse=True):
        many += histogram[c]
        if many > most:
            break
        least = c
    return least


def _numbers(rows: DataFrame, kind: int) -> dict[tuple[int, int], int]:
    """Sums of i by (to, src) of rows of a kind; few, by the bounds of what is put in them."""
    return {(r["to"], r["src"]): int(r["n"]) for r in rows.where(F.col("kind") == kind).groupBy("to", "src").agg(F.sum("i").alias("n")).collect()}


def _dealt(rows: DataFrame, *kinds: int) -> DataFrame:
    """Rows of these kinds, those of a bucket together and in order."""
    return rows.where(F.col("kind").isin(*kinds)).repartition("to").sortWithinPartitions("to", "kind", "i", "src")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row of docs."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    small_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text"))
    train = own.where(remainder(F.col("__id")) != 1).select("__text")
    sizes = own.agg(F.sum(F.octet_length("__text")).alias("bytes"), F.count("*").alias("n")).first()
    buckets = max(1, -(-int(sizes["bytes"] or 0) // BUCKET))
    # short codes of words that are frequent in a sample
    share = min(1.0, SAMPLE / max(sizes["n"], 1))
    some = own.where(F.pmod(F.xxhash64("__id", F.lit(13)), F.lit(1 << 20)) < share * (1 << 20)).select("__text")
    found = some.mapInArrow(_word_counter, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = scratch.write("lm-sample", found.where("n > 1"))
    seen = found.orderBy(F.desc("n"), "word").limit(CODES - 1).collect()  # CODES words of LONGEST bytes at most
    codes = {END: 0} | {bytes(r["word"]): i + 1 for i, r in enumerate(seen)}
    times = np.array([sum(r["n"] for r in seen) // 20, *[r["n"] for r in seen]], dtype=np.float64)
    places = Places(buckets, np.ceil(times / max(times.sum(), 1) * buckets).clip(1).astype(np.int64))
    scratch.drop(found)
    # all pairs of the training texts
    pairs = scratch.write("lm-pairs", _dealt(train.mapInArrow(_counter(codes, places), ROWS), PAIRS).mapInArrow(_merger(places), ROWS))
    stat, histogram = _numbers(pairs, STAT), {c: n for (c, _), n in _numbers(pairs, COUNTS).items()}
    once, twice = stat.get((0, 0), 0), stat.get((1, 0), 0)
    d = min(max(once / max(once + 2 * twice, 1), 0.05), 0.9)
    contexts = _numbers(pairs, CONTEXT)
    total, tables, alone = ({c: n for (c, src), n in contexts.items() if src == k} for k in range(3))
    tables_sum = dict.fromkeys(tables, 0)
    words_ = scratch.write("lm-words", _dealt(pairs, ASK, DISH).mapInArrow(_word_seats(buckets, -1, True), ROWS))
    stat = {k: n for (k, _), n in _numbers(words_, STAT).items()}
    root, n_all, v_all = Root(stat), stat.get(4, 0), stat.get(3, 0)
    counts = np.zeros(CODES, dtype=np.int64)
    for (code, _), n in _numbers(words_, CODE).items():
        counts[code] = n
    roots, history, answers, seats = [], [], words_, None
    for sweep in range(BURN + SWEEPS):
        state = pairs.where(F.col("kind").isin(MULTI, FIXED)).unionByName(answers.where(F.col("kind") == REPLY))
        state = state if seats is None else state.unionByName(seats.where(F.col("kind") == TABLES))
        now = scratch.write("lm-seats", _dealt(state, MULTI, FIXED, TABLES, REPLY).mapInArrow(_pair_seats(places, d, root, tables, sweep), ROWS))
        tables = alone | {c: n + alone[c] for (c, _), n in _numbers(now, CONTEXT).items()}
        asked = words_.where(F.col("kind") == WORD).unionByName(now.where(F.col("kind") == ASK))
        next_ = scratch.write("lm-answers", _dealt(asked, WORD, ASK).mapInArrow(_word_seats(buckets, sweep, False), ROWS))
        if answers is not words_ and sweep <= BURN:
            scratch.drop(answers)
        if seats is not None:
            scratch.drop(seats)
        answers, seats = next_, now
        root = Root({k: n for (k, _), n in _numbers(answers, STAT).items()})
        if sweep >= BURN:
            roots.append(root)
            history.append(answers)
            tables_sum = {c: n + tables[c] for c, n in tables_sum.items()}
    told = words_.where(F.col("kind") == WORD).unionByName(pairs.where(F.col("kind") == DISH))
    for h in history:
        told = told.unionByName(h.where(F.col("kind") == HISTORY))
    told = scratch.write("lm-told", _dealt(told, DISH, WORD, HISTORY).mapInArrow(_word_told(roots), ROWS))
    scratch.drop(words_, *history)
    unknown = float(np.mean([(ROOT + r.d * r.words) / (ROOT + r.all) for r in roots]))
    hot_contexts = {c: (total[c], n / SWEEPS) for c, n in tables_sum.items()}
    # the model's rows by bucket, and the scores of its most frequent pairs
    model = pairs.where(F.col("kind") == PAIRS).unionByName(seats.where(F.col("kind") == TABLES)).unionByName(told.where(F.col("kind") == TOLD))
    least = _from(histogram, HOT)
    parts = _dealt(model, PAIRS, TABLES, TOLD).mapInArrow(_hottest(places, d, hot_contexts, least), ROWS).select("p", "q", "r").collect()  # HOT pairs at most
    hot = [np.concatenate([f(r[k]) for r in parts] or [np.zeros(0)]) for k, f in (("p", lambda x: unpack(x, 4)), ("q", lambda x: np.frombuffer(x, "<f8")), ("r", unpack_counts))]
    order = np.argsort(hot[0])
    hot = (hot[0][order].astype(np.int64), hot[1][order].astype(np.float32), hot[2][order].astype(np.int64))
    by_code = np.full(CODES, np.log10(unknown))
    for r in told.where(F.col("kind") == CODE).select("p", "q").collect():  # CODES words at most
        by_code[unpack(r["p"])] = np.log10(np.frombuffer(r["q"], "<f8"))
    asker = _asker(codes, counts, places, hot, n_all, v_all)
    asked = own.withColumn("__trained", F.coalesce(remainder(F.col("__id")) != 1, F.lit(False)))
    results = []
    for part in range(ROUNDS):
        mine = asked.where(F.pmod(F.xxhash64("__id", F.octet_length("__text")), F.lit(ROUNDS)) == part)
        rows = model.unionByName(mine.mapInArrow(asker, ROWS))
        scores = _dealt(rows, PAIRS, TABLES, TOLD, TRAIN, HELD, OWN).mapInArrow(_pair_scorer(places, d, hot_contexts, by_code), ROWS)
        scores = scratch.write("lm-scores", scores)
        batches = lambda df: df.repartition("i").sortWithinPartitions("i", "kind", "src")
        sums = scratch.write("lm-sums", batches(scores).mapInArrow(_summer(n_all, v_all, buckets), ROWS))
        scratch.drop(scores)
        wanted = told.where(F.col("kind") == KNOWN).unionByName(sums.where(F.col("kind") == WANT))
        rest = _dealt(wanted, KNOWN, WANT).mapInArrow(_word_scorer(unknown), ROWS)
        done = batches(sums.where(F.col("kind") == OWN).unionByName(rest)).mapInArrow(_finisher(n_all, v_all), f"__id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        results.append(scratch.write("lm-results", done))
        scratch.drop(sums)
    scratch.drop(pairs, seats, told)
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    trained_null = F.when(F.col("__id").isNull(), F.lit(False)).otherwise(F.col("held_out"))
    return out.select(F.col("__id").alias(key), trained_null.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
