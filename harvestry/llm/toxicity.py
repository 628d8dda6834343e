"""Toxicity of texts by a bidirectional gated recurrent network with attention pooling (operator 10), trained in numpy.

A text is scored as its worst window; windows of WINDOW words start every STRIDE words, half a window, and at the end, so
every word of the whole text is in two, but for the first and last few, and every passage of STRIDE words lies whole in one. A word enters by what is known of the word itself and by its character
n-grams (3 to 5 bytes with the word's ends marked): learned vectors of both, and how unevenly both are spread over the two
labels in the training texts; and by its characters one after the other, which two small gated recurrent layers read forwards
and backwards. A word that was never seen still has its n-grams and characters. Two gated recurrent layers read the window
forwards and backwards, an attention layer weighs the states, and a logistic unit scores their weighted mean.

Training: a bounded sample of the labelled rows that are not held out, at most about SAMPLE of each label, chosen by hashed
id; whole texts. The network learns from the worst window of each text, looked
for among the two with the most evidence and one more; the last step and the scoring look at all. While it trains, the spread of a word or n-gram is
taken from the other folds of the sample, so that it looks as it will on unseen texts. The last step fits the scale and
offset of the score to the sample, weighted to the labels' share among all training rows.

Cases: a null or empty text has the score of a text without evidence. Very long texts are scored a thousand windows at a time,
very long words are read in stretches of LONG bytes. Labels that are null or repeat an id: nulls are left
out, the largest label of an id counts. Without rows of both labels every score is 0. Repeated rows are scored each; a null
id is never in training nor held out (held_out false). Other columns are not read, whatever their names. Empty input gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.llm.texts import as_bytes, pieces, small_batches

WINDOW, STRIDE = 48, 24
HIDDEN, ATTEND = 8, 8
#: Units of the layers over characters, dimensions of a character's vector, and bytes that they read at a stretch.
SPELL, LETTER, LONG = 5, 5, 64
#: Dimensions of the learned vectors, and hashed n-grams and words that have one.
VECTOR, GRAMS, WORDS = 6, 1 << 16, 1 << 16
#: Buckets of the counts by label, so many that hardly any two frequent things meet; their first 16 bits are those above.
COUNTED = 1 << 20
#: Training rows of each label at most, about; folds; passes; texts of a step.
SAMPLE, FOLDS, EPOCHS, STEP = 2000, 4, 8, 32
#: Words whose inputs a worker remembers.
REMEMBER = 250_000
THRESHOLD = 0.7


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of the words, where each word's begin, and the bucket of each word."""
    marked = np.frombuffer(b"".join([b"\x02" + w + b"\x03" for w in words]), dtype=np.uint8).astype(np.uint64)
    n = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(n)
    owner = np.repeat(np.arange(len(words)), n)
    left = np.repeat(ends, n) - np.arange(len(marked))  # bytes to the end of the word, this one included
    h, power, found, of = np.zeros(len(marked), dtype=np.uint64), np.uint64(1), [], []
    whole = np.zeros(len(words), dtype=np.uint64)
    for k in range(5):
        if k >= len(marked):
            break
        h[: len(marked) - k] += (marked[k:] + np.uint64(1)) * power * np.uint64(0x9E3779B97F4A7C15)
        power = np.uint64((int(power) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF)
        if k >= 2:
            ok = left > k
            x = h[ok] ^ (h[ok] >> np.uint64(29))
            x = x * np.uint64(0x94D049BB133111EB) + np.uint64(k)
            found.append((x >> np.uint64(44)).astype(np.int64)), of.append(owner[ok])
    place = np.arange(len(marked)) - np.repeat(ends - n, n)
    mixed = (marked + np.uint64(1)) * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    if len(words):
        whole = np.add.reduceat(mixed, ends - n)
    grams, of_ = np.concatenate(found) if found else np.zeros(0, np.int64), np.concatenate(of) if of else np.zeros(0, np.int64)
    order = np.argsort(of_, kind="stable")
    return grams[order], np.searchsorted(of_[order], np.arange(len(words))), ((whole ^ (whole >> np.uint64(33))) * np.uint64(0x94D049BB133111EB) >> np.uint64(44)).astype(np.int64)


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the words, where each word's begin, and how many it has."""
    length = np.array([len(w) for w in words], dtype=np.int64)
    return np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(length) - length, length


def spread(toxic: np.ndarray, all_: np.ndarray, share: float) -> np.ndarray:
    """How far counts of texts with something are from the label's share, squashed: 0 is as expected."""
    z = (toxic - all_ * share) / np.sqrt(all_ * share * (1 - share) + 1)
    return (np.sign(z) * np.log1p(np.abs(z))).astype(np.float32)


def evidence(words: np.ndarray, grams: np.ndarray, starts: np.ndarray, by_word: np.ndarray, by_gram: np.ndarray) -> np.ndarray:
    """Four features of each word: its own spread, its n-grams' mean spread, and how many lean to either label."""
    if not len(words):
        return np.zeros((0, 4), dtype=np.float32)
    n = np.diff(np.r_[starts, len(grams)])
    s = by_gram[grams]
    up, down = (np.log1p(np.add.reduceat((sign * s > 1.3).astype(np.float32), starts)) for sign in (1, -1))
    return np.stack([by_word[words], np.add.reduceat(s, starts) / n, up, down], axis=1).astype(np.float32)


def windows(n: int) -> np.ndarray:
    """Where the windows of n words begin."""
    if n <= WINDOW:
        return np.zeros(1, dtype=np.int64)
    return np.unique(np.r_[np.arange(0, n - WINDOW, STRIDE), n - WINDOW])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters and passes; the two directions are the first axis of the recurrent weights."""

    INPUT = 2 * VECTOR + 4 + 2 * SPELL

    def __init__(self, seed: int = 0):
        r, f = np.random.default_rng(seed), np.float32
        h = HIDDEN
        self.p = {
            "words": (r.normal(0, 0.02, (WORDS, VECTOR))).astype(f), "grams": (r.normal(0, 0.02, (GRAMS, VECTOR))).astype(f),
            "w": r.normal(0, 0.3, (2, self.INPUT, 3 * h)).astype(f), "b": np.tile(np.r_[np.zeros(h), np.ones(h), np.zeros(h)], (2, 1, 1)).astype(f),
            "u": r.normal(0, 0.3, (2, h, 3 * h)).astype(f), "a": r.normal(0, 0.3, (2 * h, ATTEND)).astype(f), "v": r.normal(0, 0.3, ATTEND).astype(f),
            "o": r.normal(0, 0.3, 2 * h).astype(f), "c": np.full(1, -2, dtype=f),
            "letters": r.normal(0, 0.5, (256, LETTER)).astype(f), "lw": r.normal(0, 0.3, (2, LETTER, 3 * SPELL)).astype(f), "lb": np.zeros((2, 3 * SPELL), dtype=f), "lu": r.normal(0, 0.3, (2, SPELL, 3 * SPELL)).astype(f),
        }

    def spell(self, data: np.ndarray, first: np.ndarray, length: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The last states of the layers over the characters of words, which lie in data; of words over LONG bytes the mean over their parts."""
        h, u = SPELL, self.p["lu"]
        parts = -(-length // LONG)
        word = np.repeat(np.arange(len(length)), parts)
        at = (np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)) * LONG
        first, length = first[word] + at, np.minimum(length[word] - at, LONG)
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        state = np.zeros((2, len(order), h), dtype=np.float32)
        table = np.stack([self.p["letters"] @ self.p["lw"][d] + self.p["lb"][d] for d in (0, 1)])
        for t in range(int(length.max(initial=0))):
            k = int(np.searchsorted(-length, -t, side="left"))  # words with more than t characters
            here = np.stack([data[first[:k] + t], data[first[:k] + length[:k] - 1 - t]])
            both = np.stack([table[0][here[0]], table[1][here[1]]])
            before = state[:, :k].copy()
            hid = before @ u
            gates = _sigmoid(both[:, :, : 2 * h] + hid[:, :, : 2 * h])
            r, z = gates[:, :, :h], gates[:, :, h:]
            new = np.tanh(both[:, :, 2 * h :] + r * hid[:, :, 2 * h :])
            state[:, :k] = new + z * (before - new)
            if keep is not None:
                keep.append((k, here, before, hid, r, z, new))
        each = np.empty((len(order), 2 * h), dtype=np.float32)
        each[order] = np.concatenate([state[0], state[1]], axis=1)
        if keep is not None:
            keep.append((order, word, parts))
        out = np.zeros((len(parts), 2 * h), dtype=np.float32)
        np.add.at(out, word, each)
        return out / np.maximum(parts, 1)[:, None].astype(np.float32)

    def spell_back(self, keep: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the layers over characters for the gradient of what spell() gave."""
        h, p = SPELL, self.p
        order, word, parts = keep[-1]
        grad = (grad / np.maximum(parts, 1)[:, None])[word]
        d_state = np.stack([grad[order, :h], grad[order, h:]]).astype(np.float32)
        g, d_table = {"lu": np.zeros_like(p["lu"])}, np.zeros((2, 256, 3 * h), dtype=np.float32)
        for k, here, before, hid, r, z, new in reversed(keep[:-1]):
            d = d_state[:, :k]
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (before - new) * z * (1 - z)
            d_r = d_new * hid[:, :, 2 * h :] * r * (1 - r)
            d_hid = np.concatenate([d_r, d_z, d_new * r], axis=2)
            for i in (0, 1):
                np.add.at(d_table[i], here[i], np.concatenate([d_r[i], d_z[i], d_new[i]], axis=1))
            g["lu"] += before.transpose(0, 2, 1) @ d_hid
            d_state[:, :k] = d * z + d_hid @ p["lu"].transpose(0, 2, 1)
        g["lw"] = np.stack([p["letters"].T @ d_table[i] for i in (0, 1)])
        g["lb"] = d_table.sum(axis=1)
        g["letters"] = sum(d_table[i] @ p["lw"][i].T for i in (0, 1))
        return g

    def inputs(self, seen: np.ndarray, words: np.ndarray, grams: np.ndarray, starts: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        """The input vectors of distinct words with these features (evidence()), each with its n-grams and what spell() gave."""
        n = np.diff(np.r_[starts, len(grams)])[:, None].astype(np.float32)
        if not len(words):
            return np.zeros((0, self.INPUT), dtype=np.float32)
        return np.concatenate([seen, self.p["words"][words >> 4], np.add.reduceat(self.p["grams"][grams >> 4], starts, axis=0) / n, spelt], axis=1).astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Inputs' share of the gates, both directions; row 0 stands for no word and leaves the state as it is."""
        g = np.concatenate([x @ self.p["w"][d] + self.p["b"][d] for d in (0, 1)], axis=1)
        none = np.zeros((1, g.shape[1]), dtype=np.float32)
        none[:, np.r_[HIDDEN : 2 * HIDDEN, 4 * HIDDEN : 5 * HIDDEN]] = 40
        return np.concatenate([none, g])

    def forward(self, table: np.ndarray | tuple[np.ndarray, np.ndarray], ids: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows (rows of ids into table, 0: no word); the table may be given as its two directions."""
        h, k = HIDDEN, 3 * HIDDEN
        n, t = ids.shape
        state, u = np.zeros((2, n, h), dtype=np.float32), self.p["u"]
        states = np.empty((t, n, 2 * h), dtype=np.float32)
        both = np.empty((2, n, k), dtype=np.float32)
        sides = table if isinstance(table, tuple) else (np.ascontiguousarray(table[:, :k]), np.ascontiguousarray(table[:, k:]))
        hid, gates, new = np.empty_like(both), np.empty((2, n, 2 * h), dtype=np.float32), np.empty_like(state)
        for i in range(t):
            for side, at in ((0, i), (1, t - 1 - i)):
                np.take(sides[side], ids[:, at], axis=0, out=both[side], mode="clip")
            if keep is not None:  # each step keeps arrays of its own
                state, hid, gates, new = state.copy(), np.empty_like(hid), np.empty_like(gates), np.empty_like(new)
            np.matmul(state, u, out=hid, casting="same_kind")
            np.add(both[:, :, : 2 * h], hid[:, :, : 2 * h], out=gates)
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            r, z = gates[:, :, :h], gates[:, :, h:]
            np.multiply(r, hid[:, :, 2 * h :], out=new)
            new += both[:, :, 2 * h :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((state, hid, r, z, new))
                state = new + z * (state - new)
            else:
                state -= new
                state *= z
                state += new
            states[i, :, :h], states[t - 1 - i, :, h:] = state[0], state[1]
        inner = np.tanh(states @ self.p["a"])
        e = inner @ self.p["v"]
        e[ids.T == 0] = -1e9
        e[0] = np.where((ids == 0).all(1), 0, e[0])
        e = np.exp(e - e.max(0))
        weight = e / e.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logit = pooled @ self.p["o"] + self.p["c"][0]
        if keep is not None:
            keep.append((states, inner, weight, pooled))
        return logit

    def backward(self, x: np.ndarray, ids: np.ndarray, keep: list, grad: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters (vectors aside) and of the inputs x, for the gradient of the logits."""
        h, p = HIDDEN, self.p
        n, t = ids.shape
        states, inner, weight, pooled = keep[-1]
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("words", "grams", "letters", "lw", "lb", "lu")}
        g["o"], g["c"] = grad @ pooled, np.array([grad.sum()], dtype=np.float32)
        d_pooled = grad[:, None] * p["o"]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_states = weight[:, :, None] * d_pooled
        d_e = weight * (d_weight - (weight * d_weight).sum(0))
        d_inner = d_e[:, :, None] * p["v"] * (1 - inner * inner)
        g["v"] = np.einsum("tn,tna->a", d_e, inner)
        g["a"] = np.einsum("tnh,tna->ha", states, d_inner)
        d_states += d_inner @ p["a"].T
        d_table = np.zeros((len(x) + 1, 6 * h), dtype=np.float32)
        d_state = np.zeros((2, n, h), dtype=np.float32)
        for i in reversed(range(t)):
            state, hid, r, z, new = keep[i]
            d_state[0] += d_states[i, :, :h]
            d_state[1] += d_states[t - 1 - i, :, h:]
            d_new = d_state * (1 - z) * (1 - new * new)
            d_z = d_state * (state - new) * z * (1 - z)
            d_r = d_new * hid[:, :, 2 * h :] * r * (1 - r)
            d_hid = np.concatenate([d_r, d_z, d_new * r], axis=2)
            d_in = np.concatenate([d_r, d_z, d_new], axis=2)
            np.add.at(d_table[:, : 3 * h], ids[:, i], d_in[0])
            np.add.at(d_table[:, 3 * h :], ids[:, t - 1 - i], d_in[1])
            g["u"] += state.transpose(0, 2, 1) @ d_hid
            d_state = d_state * z + d_hid @ p["u"].transpose(0, 2, 1)
        d_table = d_table[1:]
        d_x = np.zeros_like(x)
        for d in (0, 1):
            part = d_table[:, 3 * h * d : 3 * h * (d + 1)]
            g["w"][d], g["b"][d] = x.T @ part, part.sum(0)
            d_x += part @ p["w"][d].T
        return g, d_x


class _Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.n = params, rate, 0
        self.m, self.s = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))

    def step(self, grads: dict) -> None:
        self.n += 1
        fix = self.rate * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, g in grads.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            self.m[k][at] = m = 0.9 * self.m[k][at] + 0.1 * g
            self.s[k][at] = s = 0.999 * self.s[k][at] + 0.001 * g * g
            self.p[k][at] -= fix * m / (np.sqrt(s) + 1e-8)


class Model:
    """A trained scorer: the network, the spreads of words and n-grams, and the scale of the score."""

    def __init__(self, network: Network, by_word: np.ndarray, by_gram: np.ndarray, scale: float, offset: float):
        self.network, self.by_word, self.by_gram, self.scale, self.offset = network, by_word, by_gram, scale, offset
        self.known: dict[bytes, int] = {}
        self.table = self._sides(network.project(np.zeros((0, Network.INPUT), dtype=np.float32)))

    @staticmethod
    def _sides(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.ascontiguousarray(rows[:, : 3 * HIDDEN]), np.ascontiguousarray(rows[:, 3 * HIDDEN :])

    def _ids(self, split: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.known) > REMEMBER:
            self.known, self.table = {}, tuple(x[:1] for x in self.table)
        known = self.known
        new = list(set().union(*split).difference(known))
        if new:
            grams, starts, whole = gram_buckets(new)
            seen = evidence(whole, grams, starts, self.by_word, self.by_gram)
            rows = self.network.project(self.network.inputs(seen, whole, grams, starts, self.network.spell(*letters(new))))[1:]
            known.update(zip(new, range(len(known) + 1, len(known) + 1 + len(new)), strict=True))
            if len(known) + 1 > len(self.table[0]):  # grown in blocks, not a batch at a time
                more = max(len(rows), min(len(self.table[0]), 1 << 15))
                self.table = tuple(np.concatenate([x, np.zeros((more, x.shape[1]), dtype=x.dtype)]) for x in self.table)
            for x, own in zip(self.table, self._sides(rows), strict=True):
                x[len(known) + 1 - len(new) : len(known) + 1] = own
        return [np.fromiter(map(known.__getitem__, ws), dtype=np.int32, count=len(ws)) for ws in split]

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """The logit of the worst window of each text."""
        docs = self._ids([t.lower().split() for t in texts])
        out = np.full(len(docs), -np.inf, dtype=np.float32)
        rows, owner = [], []

        def run() -> None:
            if rows:
                ids = np.stack(rows)
                np.maximum.at(out, owner, self.network.forward(self.table, ids))
                rows.clear(), owner.clear()

        for i, d in enumerate(docs):
            if len(d) < WINDOW:
                rows.append(np.pad(d, (0, WINDOW - len(d)))), owner.append(i)
            else:
                for at in windows(len(d)):
                    rows.append(d[at : at + WINDOW]), owner.append(i)
                    if len(rows) == 1024:
                        run()
        run()
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        return _sigmoid(self.scale * self.logits(texts).astype(np.float64) + self.offset)

    def __reduce__(self):
        return Model, (self.network, self.by_word, self.by_gram, self.scale, self.offset)


def train(texts: list[bytes], labels: list[int], share: float, epochs: int = EPOCHS, seed: int = 0) -> Model:
    """A model of the labels (0 or 1); share is that of label 1 among all rows like these."""
    y = np.array(labels, dtype=np.float32)
    rng = np.random.default_rng(seed)
    place: dict[bytes, int] = {}
    docs = [np.array([place.setdefault(w, len(place)) for w in t.lower().split()], dtype=np.int32) for t in texts]
    vocabulary = list(place) or [b"-"]
    grams, starts, whole = gram_buckets(vocabulary)
    data, first, size = letters(vocabulary)
    fold = rng.permutation(len(docs)) % FOLDS
    lengths = np.diff(np.r_[starts, len(grams)])

    def grams_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of these words one after the other, and where each word's begin."""
        n = lengths[words]
        begin = np.r_[0, np.cumsum(n)[:-1]] if len(n) else n
        return grams[np.repeat(starts[words] - begin, n) + np.arange(n.sum())], begin

    counts = {k: np.zeros((FOLDS, 2, COUNTED), dtype=np.float32) for k in ("w", "g")}
    for d, f, label in zip(docs, fold, labels, strict=True):
        own = np.unique(d)
        if len(own):
            counts["w"][f, label, np.unique(whole[own])] += 1
            counts["g"][f, label, np.unique(grams_of(own)[0])] += 1
    total = {k: c.sum(0) for k, c in counts.items()}
    mine = max(y.sum(), 1) / max(len(y), 2)

    def spreads(without: int | None) -> tuple[np.ndarray, np.ndarray]:
        left = {k: total[k] - (counts[k][without] if without is not None else 0) for k in counts}
        return tuple(spread(left[k][1], left[k][0] + left[k][1], mine) for k in ("w", "g"))

    net = Network(seed)
    adam = _Adam(net.p, 0.01)
    seen = [evidence(whole, grams, starts, *spreads(f)) for f in range(FOLDS)]
    batches = []
    for f in range(FOLDS):
        own = rng.permutation(np.flatnonzero(fold == f))
        batches += [(f, own[i : i + STEP]) for i in range(0, len(own), STEP)]
    cut = []  # the windows of each text: rows of words, -1 for none
    for d in docs:
        if len(d) < WINDOW:
            cut.append(np.pad(d, (0, WINDOW - len(d)), constant_values=-1)[None, :])
        else:
            cut.append(d[windows(len(d))[:, None] + np.arange(WINDOW)])
    for epoch in range(epochs):
        adam.rate = 0.01 * (1 - 0.9 * epoch / epochs)
        for b in rng.permutation(len(batches)):
            f, rows = batches[b]
            sight = np.append(seen[f][:, 0] + seen[f][:, 1] + seen[f][:, 2], np.float32(-9))
            ids, owner = [], []
            for i in rows:  # the windows with the most evidence and one by chance stand for all
                v = sight[cut[i]]
                most = np.argsort(-v.max(1) - 0.1 * v.mean(1), kind="stable")[:2]
                for k in {*most.tolist(), int(rng.integers(len(cut[i])))}:
                    ids.append(cut[i][k]), owner.append(i)
            ids, owner = np.stack(ids), np.array(owner)
            used, local = np.unique(ids, return_inverse=True)
            local = local.reshape(ids.shape)
            if used[0] < 0:
                used = used[1:]
            else:
                local = local + 1
            if not len(used):
                continue
            g, begin = grams_of(used)
            spelling: list = []
            x = net.inputs(seen[f][used], whole[used], g, begin, net.spell(data, first[used], size[used], spelling))
            logits = net.forward(net.project(x), local)
            order = np.lexsort((-logits, owner))
            worst = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
            keep: list = []
            got = net.forward(net.project(x), local[worst], keep)
            grad = ((_sigmoid(got) - y[owner[worst]]) / len(worst)).astype(np.float32)
            grads, d_x = net.backward(x, local[worst], keep, grad)
            n, ends = lengths[used], 4 + 2 * VECTOR
            grads |= net.spell_back(spelling, d_x[:, ends:])
            for name, at, d in (("words", whole[used] >> 4, d_x[:, 4 : 4 + VECTOR]), ("grams", g >> 4, np.repeat(d_x[:, 4 + VECTOR : ends] / n[:, None], n, axis=0))):
                rows_, inverse = np.unique(at, return_inverse=True)
                grads[name] = rows_, np.stack([np.bincount(inverse, d[:, k], len(rows_)) for k in range(VECTOR)], axis=1).astype(np.float32)
            adam.step(grads)
    margins = np.zeros(len(docs))
    for f in range(FOLDS):
        model, own = Model(net, *spreads(f), 1.0, 0.0), np.flatnonzero(fold == f)
        for at in range(0, len(own), 64):
            margins[own[at : at + 64]] = model.logits([texts[i] for i in own[at : at + 64]])
    scale, offset = _calibrate(margins, y, share)
    return Model(net, *spreads(None), scale, offset)


def _calibrate(margin: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Scale and offset of the logit by weighted logistic regression with a light pull to scale 1."""
    n1, n0 = max(y.sum(), 1), max(len(y) - y.sum(), 1)
    weight = np.where(y > 0, share / n1, (1 - share) / n0) * len(y)
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * margin + b)
        d, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        grad = np.array([(d * margin).sum() + (a - 1), d.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1, (h * margin).sum()], [(h * margin).sum(), h.sum()]])
        step = np.linalg.solve(hess, grad)
        step *= min(1, 2 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
    return float(max(a, 1e-3)), float(b)




def _scorer(model: Model | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2 << 20):
            texts = as_bytes(b.column(b.num_columns - 1))
            s = model.score(texts) if model is not None else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s.astype(np.float64))], [*b.schema.names[:-1], "score"])

    return score


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """A model from a bounded sample of the labelled rows that are not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("__key")).agg(F.max(F.col(label)).alias("__y"))
    n = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count("*").alias("n")).collect() if r["__y"] in (0, 1)}
    if len(n) < 2:
        return None
    share = F.when(F.col("__y") == 1, min(1.0, sample / n[1])).otherwise(min(1.0, sample / n[0]))
    chosen = known.where(F.col("__y").isin(0, 1) & (F.pmod(F.xxhash64("__key", F.lit(9)), F.lit(1 << 20)) < share * (1 << 20)))
    # about 2 * sample ids, by the bound above
    rows = docs.join(F.broadcast(chosen), docs[key] == F.col("__key")).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col("__y").cast("int").alias("y")).toArrow().sort_by([("k", "ascending"), ("t", "ascending")])
    return train(as_bytes(rows["t"].combine_chunks()), rows["y"].to_pylist(), n[1] / (n[0] + n[1]))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """key, held_out, score, predicted for each row of docs; a model may be given, else one is fitted."""
    small_batches(docs.sparkSession)
    model = model or fit(docs, labels, key, text, label)
    own = docs.select(F.col(key).alias("__id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("__text"))
    scored = own.mapInArrow(_scorer(model), f"__id {docs.schema[key].dataType.simpleString()}, held_out boolean, score double")
    return scored.select(F.col("__id").alias(key), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
