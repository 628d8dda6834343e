"""Packing documents into sequences by the linear grouping scheme (operator 5).

Documents become token ids and, where longer than a sequence, pieces of one sequence each and a rest. Only the histogram of
piece lengths, at most one count a length, reaches the driver, whatever the number of documents; there the packing is made
for all pieces of a length at once:

1. lengths above a limit are sorted and split into groups of equal cardinality; each is rounded up to its group's largest;
2. for these few sizes, a linear program over configurations (multisets of sizes that fit) is solved by column generation,
   its solution is rounded down, and the rest is packed by best fit decreasing;
3. the actual lengths replace the rounded sizes in their slots, the longest in the configurations with the most;
4. the small lengths, longest first, go where they leave the least room, then into new sequences.

The scheme is tried with a few limits and numbers of groups (SCHEMES) and the one with the fewest sequences is kept. With
half a sequence as the limit no two large pieces meet, and the scheme does what best fit decreasing does, so it never needs
more sequences than that. The plan is a list of runs: so many sequences with the same lengths. Its size depends on the sequence
length only. Each piece then finds its run by its rank among the pieces of its length; ranks come from counts by (length,
bucket of the key), so no task gets all pieces of a length.

Cases: a null or empty text is the end token alone. Repeated rows are packed each; a null key is kept. Empty input gives an
empty result. The special tokens of the tokenizer, where a text spells them, become their ids, as the library does it.
"""

from __future__ import annotations

import os
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestry.llm.store import Scratch
from harvestry.llm.texts import as_bytes, pieces, small_batches

CAPACITY = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"
#: What is tried: lengths above this share of a sequence are large, and form this many groups.
SCHEMES = ((1 / 8, 24), (1 / 8, 96), (1 / 4, 96), (1 / 2, 24))
#: Bits of the table of late words, words whose ids a worker keeps, and bytes of text that it takes at once.
PLACES, KEPT, LONG = 20, 2_500_000, 1 << 19
#: White space to the tokenizer (fixed values: the characters with the Unicode property White_Space).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Buckets that the pieces of one length are ranked in, independent of each other.
RANK_BUCKETS = 1024

assert sys.byteorder == "little"
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_HELD: dict = {}


class WordIds:
    """Token ids of texts split at ASCII spaces and newlines.

    The tokenizer drops white space and never joins what it separates, so the ids of a text are those of its words one
    after the other. Each word is encoded once. Words are known by a 64-bit hash, computed for all words of a batch at once
    from running sums over the bytes; a table with a place for each hash holds the words of late, sorted arrays hold all, and
    both are emptied when they have KEPT words. A-Z are put in lower case beforehand, as the tokenizer would. Texts that may
    spell a special token, or hold white space only (for which the library has ids), go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = max(self.tokenizer.get_added_tokens_decoder().items())
        # words of letters alone need no normaliser and are one piece each: the model itself, told apart by word ends
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = self.plain.model.end_of_word_suffix
        self.ends = np.array([bool(suffix) and str(self.plain.id_to_token(i)).endswith(suffix) for i in range(self.plain.get_vocab_size())])
        random = np.random.default_rng(17)
        self.letter = random.integers(0, 1 << 64, 256, dtype=np.uint64)
        factor = 0x9E3779B97F4A7C13  # 3 modulo 4: its powers stay apart
        self.powers, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.factor, self.back = np.uint64(factor), np.uint64(pow(factor, -1, 1 << 64))
        self._forget()

    def _forget(self) -> None:
        self.place_hash = np.zeros(1 << PLACES, dtype=np.uint64)
        self.place_word = np.full(1 << PLACES, -1, dtype=np.int32)
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []  # sorted hashes, words
        self.n, self.start = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.pool = np.zeros(1 << 18, dtype="<u4")
        self.size, self.begin = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)  # of the words' own bytes
        self.bytes = np.zeros(1 << 18, dtype=np.uint8)
        self.words = self.used = self.spelt = 0
        self.exact: dict[bytes, int] = {}

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        while len(self.powers) < len(data) + 1:
            for name, f in (("powers", self.factor), ("inverse", self.back)):
                x = getattr(self, name)
                setattr(self, name, np.concatenate([x, x * np.uint64(int(x[-1]) * int(f) % (1 << 64))]))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.letter[data] * self.powers[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def _encode(self, new: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        out, letters, others = [b""] * len(new), [], []
        for i, w in enumerate(new):
            x = w.decode("utf-8", "replace")
            if x.isalpha() and x.islower() and len(x) < 64 and unicodedata.is_normalized("NFC", x) and x.lower() == x:
                letters.append((i, x))
            else:
                others.append((i, x if x.strip(WHITE) else ""))
        if not self.ends.any():
            others, letters = others + letters, []
        between, at = self.special[1].content, self.special[0]
        for some, tokenizer, join in ((letters, self.plain, " "), (others, self.tokenizer, between)):
            for k in range(0, len(some), 500):
                part = some[k : k + 500]
                text = join.join([x for _, x in part]) + ("" if tokenizer is self.plain else between)
                ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
                cut = np.flatnonzero(self.ends[ids] if tokenizer is self.plain else ids == at)
                data, skip = ids.tobytes(), tokenizer is not self.plain
                stops = cut.tolist()
                if len(stops) != len(part):
                    raise ValueError("the tokenizer does not keep words apart")
                last = 0
                for (i, _), stop in zip(part, stops, strict=True):
                    out[i] = data[4 * last : 4 * (stop + 1 - skip)]
                    last = stop + 1
        return out

    def _learned(self, new: list[bytes]) -> np.ndarray:
        """Numbers of new words, which are encoded and kept."""
        found = self._encode(new)
        n, ids = np.array([len(x) // 4 for x in found]), np.frombuffer(b"".join(found), dtype="<u4")
        size, own = np.array([len(x) for x in new]), np.frombuffer(b"".join(new), dtype=np.uint8)
        for name, least in (("n", self.words + len(new)), ("start", self.words + len(new)), ("size", self.words + len(new)), ("begin", self.words + len(new)), ("pool", self.used + len(ids)), ("bytes", self.spelt + len(own) + 8)):
            x = getattr(self, name)
            if least > len(x):
                setattr(self, name, np.concatenate([x, np.zeros(max(least - len(x), len(x)), dtype=x.dtype)]))
        mine = slice(self.words, self.words + len(new))
        self.n[mine], self.start[mine] = n, self.used + np.r_[0, np.cumsum(n)[:-1]]
        self.size[mine], self.begin[mine] = size, self.spelt + np.r_[0, np.cumsum(size)[:-1]]
        self.pool[self.used : self.used + len(ids)], self.bytes[self.spelt : self.spelt + len(own)] = ids, own
        self.words, self.used, self.spelt = self.words + len(new), self.used + len(ids), self.spelt + len(own)
        return np.arange(mine.start, mine.stop)

    def _differ(self, text: bytes, starts: np.ndarray, ends: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where the bytes of the text are not those of the word, compared eight at a time."""
        held = text + bytes(8)
        here, there = (np.ndarray((len(x) - 7,), "<u8", x, strides=(1,)) for x in (held, self.bytes))
        size, begin = ends - starts, self.begin[word]
        mask = _MASKS[np.minimum(size, 8)]
        bad = (self.size[word] != size) | (((here[starts] ^ there[begin]) & mask) != 0)
        long = np.flatnonzero((size > 8) & ~bad)
        at = 8
        while len(long):
            off = np.minimum(at, size[long] - 8)
            bad[long[here[starts[long] + off] != there[begin[long] + off]]] = True
            at += 8
            long = long[size[long] > at]
        return np.flatnonzero(bad)

    def _find(self, h: np.ndarray, text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The words of hashes, learned if they are new; h has each hash once."""
        out = np.full(len(h), -1, dtype=np.int64)
        for hashes, words in self.runs:
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            here = hashes[at] == h
            out[here] = words[at[here]]
        new = np.flatnonzero(out < 0)
        if not len(new):
            return out
        out[new] = self._learned([text[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        self.runs.append((h[new], out[new].astype(np.int32)))
        if len(self.runs) > 10:  # the smaller ones become one
            self.runs.sort(key=lambda r: -len(r[0]))
            some, self.runs = self.runs[2:], self.runs[:2]
            hashes, words = (np.concatenate(x) for x in zip(*some, strict=True))
            order = np.argsort(hashes)
            self.runs.append((hashes[order], words[order]))
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.words > KEPT:
            self._forget()
        plain = [b"" if b"<|" in t else t.lower() for t in texts]
        text = b"\n".join(plain) + b"\n"
        data = np.frombuffer(text, dtype=np.uint8)
        inside = (data != 32) & (data != 10)
        turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            turns = np.r_[0, turns]
        starts, ends = turns[::2], turns[1::2]
        h = self._hashes(data, starts, ends)
        place = (h >> np.uint64(64 - PLACES)).astype(np.int64)
        word = self.place_word[place].astype(np.int64)
        miss = np.flatnonzero((self.place_hash[place] != h) | (word < 0))
        if len(miss):
            once, first, which = np.unique(h[miss], return_index=True, return_inverse=True)
            found = self._find(once, text, starts[miss[first]], ends[miss[first]])
            word[miss] = found[which]
            self.place_hash[place[miss]], self.place_word[place[miss]] = h[miss], word[miss]
        for i in self._differ(text, starts, ends, word).tolist():
            own = text[starts[i] : ends[i]]
            if own not in self.exact:
                self.exact[own] = int(self._learned([own])[0])
            word[i] = self.exact[own]
        n = self.n[word]
        upto = np.r_[0, np.cumsum(n)]
        ids = self.pool[np.repeat(self.start[word] - upto[:-1], n) + np.arange(upto[-1])]
        begin = np.r_[0, np.cumsum([len(t) + 1 for t in plain])]
        cut = upto[np.searchsorted(starts, begin)]
        out = [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        for i, t in enumerate(texts):
            if t and not len(out[i]):
                out[i] = np.array(self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4")
        return out


def _in_parts(texts: list[bytes], ids: WordIds) -> list[np.ndarray]:
    """The ids of each text; a very long one goes through in parts that end at spaces."""
    if not any(len(t) > LONG for t in texts):
        return ids.encode(texts)
    out = []
    for t in texts:
        parts, at = [], 0
        while b"<|" not in t and len(t) - at > LONG and (end := t.find(b" ", at + LONG)) >= 0:
            if t[at:end].decode("utf-8", "replace").strip(WHITE):
                parts += ids.encode([t[at:end]])
            at = end
        if not at or t[at:].decode("utf-8", "replace").strip(WHITE):
            parts += ids.encode([t[at:]])
        out.append(np.concatenate(parts) if parts else np.zeros(0, dtype="<u4"))
    return out


def _cutter(path: str, capacity: int, end: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", "1")  # a task has one core
        if path not in _HELD:
            _HELD[path] = WordIds(path)
        ids, tail = _HELD[path], np.array([end], dtype="<u4").tobytes()
        for b in pieces(batches, 1 << 19):
            row, piece, start, length, crc = [], [], [], [], []
            for i, data in enumerate(_in_parts(as_bytes(b.column(b.num_columns - 1)), ids)):
                data = data.tobytes() + tail
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    row.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            kept = [c.take(pa.array(row, pa.int64())) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], [*b.schema.names[:-1], "piece", "start", "length", "ids_crc32"])

    return cut


# --- the plan, from the histogram alone


class Run:
    """n sequences, each with these lengths (with their counts) and this much room."""

    __slots__ = ("n", "room", "has")

    def __init__(self, n: int, room: int, has: dict[int, int]):
        self.n, self.room, self.has = n, room, has


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most that a multiset of sizes within capacity is worth, and how often it has each size."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i, (s, w) in enumerate(zip(sizes, worth, strict=True)):
        if w <= 1e-12:
            continue
        for at in range(s, capacity + 1, s):  # blocks of s: within a block nothing depends on itself
            lo, hi = at, min(at + s, capacity + 1)
            new = best[lo - s : hi - s] + w
            more = new > best[lo:hi] + 1e-15
            best[lo:hi][more], last[lo:hi][more] = new[more], i
    has, at = np.zeros(len(sizes), dtype=np.int64), int(np.argmax(best))
    value = best[at]
    while at > 0 and last[at] >= 0:
        has[last[at]] += 1
        at -= sizes[last[at]]
    return float(value), has


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and whole numbers of sequences that meet at most the demand: the LP's optimum rounded down.

    A revised simplex method on columns that a knapsack finds; it is stopped after 12 pivots a size, for any basis on the way
    is a valid packing.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.linalg.inv(basis)
    for pivot in range(12 * k):
        x = inverse @ demand
        value, column = _knapsack(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        up = step > 1e-9
        if not up.any():
            break
        out = int(np.flatnonzero(up)[np.argmin(x[up] / step[up])])
        basis[:, out] = column
        if pivot % 64 == 63:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
    x = inverse @ demand
    left, chosen = demand.astype(np.int64).copy(), []
    for j in np.argsort(-x):
        has = np.rint(basis[:, j]).astype(np.int64)
        n = int(np.floor(x[j] + 1e-6))
        if has.any():
            n = min(n, int((left[has > 0] // has[has > 0]).min()))
        if n > 0:
            chosen.append((has, n))
            left -= has * n
    return chosen


def best_fit(runs: list[Run], lengths: dict[int, int], capacity: int) -> list[Run]:
    """All pieces of these lengths, longest first, each where it leaves the least room; equal sequences move as one run."""
    rooms: dict[int, list[Run]] = defaultdict(list)
    for r in runs:
        rooms[r.room].append(r)
    open_ = np.zeros(capacity + 1, dtype=bool)
    for room in rooms:
        open_[room] = True
    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            fits = np.flatnonzero(open_[length:])
            if not len(fits):
                each = min(capacity // length, left)
                n = left // each
                rooms[capacity - each * length].append(Run(n, capacity - each * length, {length: each}))
                open_[capacity - each * length] = True
                left -= n * each
                continue
            room = int(fits[0]) + length
            r = rooms[room].pop()
            open_[room] = bool(rooms[room])
            n = min(r.n, left)
            if n < r.n:
                rooms[room].append(Run(r.n - n, room, dict(r.has)))
                open_[room] = True
            r.n, r.room = n, room - length
            r.has[length] = r.has.get(length, 0) + 1
            rooms[r.room].append(r)
            open_[r.room] = True
            left -= n
    return [r for same in rooms.values() for r in same]


def _substitute(chosen: list[tuple[np.ndarray, int]], groups: list[list[tuple[int, int]]], capacity: int) -> tuple[list[Run], dict[int, int]]:
    """Runs of actual lengths in the configurations' slots, and the lengths that got none."""
    left = [list(g) for g in groups]  # each longest first
    runs = []
    for has, n in chosen:
        slots = [g for g in np.flatnonzero(has) for _ in range(int(has[g]))]
        todo = n
        # one length a slot for as many sequences as all the slots' next lengths last
        queues = []
        for g in slots:
            need, mine = n, []
            while need:
                length, count = left[g][0]
                take = min(count, need)
                mine.append([length, take])
                need -= take
                if take == count:
                    left[g].pop(0)
                else:
                    left[g][0] = (length, count - take)
            queues.append(mine)
        while todo:
            step = min(q[0][1] for q in queues)
            has_now = Counter(q[0][0] for q in queues)
            runs.append(Run(step, capacity - sum(length * c for length, c in has_now.items()), dict(has_now)))
            for q in queues:
                q[0][1] -= step
                if not q[0][1]:
                    q.pop(0)
            todo -= step
    rest: Counter = Counter()
    for g in left:
        for length, count in g:
            rest[length] += count
    return runs, rest


def scheme(histogram: dict[int, int], capacity: int, large: float, groups: int) -> list[Run]:
    """Runs that hold every piece of the histogram, with this limit of large lengths and this number of groups."""
    big = sorted((k for k in histogram if k > large * capacity), reverse=True)
    small = {k: v for k, v in histogram.items() if k <= large * capacity}
    found: list[list[tuple[int, int]]] = []
    each, room = -(-sum(histogram[k] for k in big) // groups), 0
    for k in big:
        left = histogram[k]
        while left:
            if not room:
                found.append([])
                room = each
            take = min(room, left)
            found[-1].append((k, take))
            room -= take
            left -= take
    # groups of one rounded size are one size
    merged: dict[int, list[tuple[int, int]]] = {}
    for g in found:
        merged.setdefault(g[0][0], []).extend(g)
    sizes, members = np.array(list(merged), dtype=np.int64), list(merged.values())
    chosen = configurations(sizes, np.array([sum(c for _, c in m) for m in members], dtype=float), capacity) if len(sizes) else []
    runs, rest = _substitute(chosen, members, capacity)
    return best_fit(runs, {**rest, **small}, capacity)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, schemes: tuple[tuple[float, int], ...] = SCHEMES) -> list[Run]:
    """Runs that hold every piece of the histogram, by the best of the schemes."""
    histogram = {int(k): int(v) for k, v in histogram.items() if v}
    return min((scheme(histogram, capacity, *x) for x in schemes), key=lambda runs: sum(r.n for r in runs))


def slots(runs: list[Run]) -> tuple[np.ndarray, ...]:
    """Runs as slots by (length, rank): length, first rank, first sequence, pieces of the length in a sequence, offset."""
    taken: Counter = Counter()
    out, sequence = [], 0
    for r in runs:
        at = 0
        for length in sorted(r.has, reverse=True):
            each = r.has[length]
            out.append((length, taken[length], sequence, each, at))
            taken[length] += each * r.n
            at += each * length
        sequence += r.n
    out.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def _placer(table: tuple[np.ndarray, ...]):
    length, rank, sequence, each, offset = table
    big = np.int64(1) << 40  # pieces of one length in all
    keys = length * big + rank if len(length) else length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, r = (b.column(b.schema.names.index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            at = np.searchsorted(keys, own * big + r, side="right") - 1
            inside = r - rank[at]
            cols = [c for c, n in zip(b.columns, b.schema.names, strict=True) if n != "__rank"]
            names = [n for n in b.schema.names if n != "__rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence[at] + inside // each[at]), pa.array(offset[at] + (inside % each[at]) * own)], [*names, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), key: str = "doc_id", capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None) -> DataFrame:
    """keep, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row; key must be in keep.

    tokenizer is the path of a tokenizer file of the tokenizers library that drops white space (default: the public one
    named TOKENIZER), the same on every executor.
    """
    import public_tokenizers

    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    small_batches(spark)
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    own = docs.select(*[F.col(k).alias(k) for k in keep], F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    cut = own.mapInArrow(_cutter(path, capacity, end), f"{fields}, piece int, start long, length long, ids_crc32 long")
    cut = scratch.write("packing-pieces", cut)
    bucket = F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(RANK_BUCKETS)).cast("int")
    counted = cut.withColumn("__bucket", bucket).groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    counted = scratch.write("packing-counts", counted)
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most capacity rows
    table = slots(plan(histogram, capacity))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = scratch.write("packing-bases", counted.select("length", "__bucket", F.coalesce(before, F.lit(0)).alias("__base")))
    order = Window.partitionBy("length", "__bucket").orderBy(key, "piece", "ids_crc32", "start")
    ranked = cut.withColumn("__bucket", bucket).withColumn("__rank", F.row_number().over(order) - 1)
    b = bases.select(F.col("length").alias("__l"), F.col("__bucket").alias("__b"), "__base")
    ranked = ranked.join(b, (ranked["length"] == b["__l"]) & (ranked["__bucket"] == b["__b"]))
    ranked = ranked.select(*keep, "piece", "start", "length", "ids_crc32", (F.col("__rank") + F.col("__base")).cast("long").alias("__rank"))
    return ranked.mapInArrow(_placer(table), f"{fields}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
