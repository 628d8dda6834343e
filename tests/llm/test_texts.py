"""Near duplicates, language, packing, language model and toxicity against plain versions, and their edge cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from harvestry.llm import extract, jaccard, language, lmscore, nearest, packing, seating, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, node string, score double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "x", 0.0) for i, t, lang, s in rows], SCHEMA)


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [a + b for a in "bcdfgl" for b in ("a", "ei", "on", "ust", "ir")] + ["the", "of"]
    rows = []
    for i in range(n):
        text = prose(rng, rng.choice([3, 9, 40, 200]), words)
        rows.append((i, text, "en" if i % 2 else "de", f"s{i % 3}"))
        if i % 5 == 0:
            w = text.split()
            for k in range(2):
                w = list(w)
                w[rng.randrange(len(w))] = f"new{k}"
                rows.append((1000 + 2 * i + k, " ".join(w), "en", "s1"))
    return rows


EDGE = [(5000, None, "en", "s0"), (5001, "", None, None), (5002, "  \n", "en", None), (5003, "one two", "de", "s1"), (5004, "ONE two", "de", "s1"), (None, "just a null id here", "en", "s1"), (5005, "same row", "en", "s2"), (5005, "same row", "en", "s2"), (5006, "Ä ä", "fr", "s9")]


def brute_links(rows, width, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    top, n = {i: i for i in sets}, Counter()

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                n[i] += 1
                n[j] += 1
                i_, j_ = find(i), find(j)
                top[max(i_, j_)] = min(i_, j_)
    return {i: (len(sets[i]), find(i), n[i]) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_links(spark, width, percent):
    rows = corpus() + [r for r in EDGE if r[0] not in (None, 5005)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.join(docs(spark, rows), width=width, percent=percent).collect()}
    assert got == brute_links(rows, width, percent)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w), "en", "s"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.join(docs(spark, rows)).collect()}
    assert got == brute_links(rows, 3, 90)


def test_few_long_sets_are_counted_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 200)  # about a block a set, so some blocks are empty
    rows = [(10 * g + k, " ".join([f"g{g}w{i}" for i in range(200)] + [f"k{k}"]), "en", "s") for g in range(20) for k in range(3)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.join(docs(spark, rows)).collect()}
    assert got == brute_links(rows, 3, 90)


def test_links_of_repeated_rows_and_null_ids(spark):
    got = sorted(((r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard.join(docs(spark, [(3, "a b c d", "", ""), (3, "a b c d", "", ""), (None, "a b c d", "", ""), (None, "z z z", "", ""), (4, None, "", ""), (4, "", "", "")])).collect()), key=str)
    assert got == sorted([(3, 3, 2), (3, 3, 2), (None, 3, 2), (None, None, 0), (4, 4, 0), (4, 4, 0)], key=str)


def test_one_document_of_a_class_stays(spark):
    rows = corpus()
    told = {v[1] for v in brute_links(rows, 5, 80).values()}
    kept = jaccard.deduplicate(docs(spark, rows))
    assert {r["doc_id"] for r in kept.collect()} == told and kept.columns == docs(spark, []).columns
    odd = [(1, "a b c d e f g", "", ""), (1, "a b c d e f g", "", ""), (1, "x y z u v w", "", ""), (2, "a b c d e f g", "", ""), (3, None, "", ""), (3, None, "", ""), (None, "q r s t u v", "", ""), (4, "x y z u v w", "", "")]
    assert sorted(((r["doc_id"], r["text"]) for r in jaccard.deduplicate(docs(spark, odd)).collect()), key=str) == sorted([(1, "a b c d e f g"), (1, "x y z u v w"), (3, None), (3, None), (None, "q r s t u v")], key=str)


def test_linked_sets_share_a_token_of_their_prefixes():
    rng = np.random.default_rng(4)
    for percent in (50, 80, 90, 95):
        for _ in range(300):
            n = int(rng.integers(1, 60))
            a = rng.choice(1000, n, replace=False)
            b = np.unique(np.r_[a[rng.random(n) > 0.1], 2000 + np.arange(rng.integers(0, 4))])
            common = len(np.intersect1d(a, b))
            if len(b) and 100 * common >= percent * (n + len(b) - common):
                order = rng.permutation(3000)
                first = [sorted(x, key=lambda t: order[t])[: int(jaccard.prefix(np.array([len(x)]), percent)[0])] for x in (a.tolist(), b.tolist())]  # noqa: B023
                assert set(first[0]) & set(first[1])


def test_no_link_is_lost_among_frequent_passages(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE", 100)
    monkeypatch.setattr(jaccard, "OFTEN", 3)
    monkeypatch.setattr(jaccard, "BUCKET", 4000)
    rng = random.Random(8)
    passages = [prose(rng, 40, [f"p{i}" for i in range(300)]) for _ in range(6)]
    rows = []
    for i in range(150):
        text = " ".join(rng.sample(passages, 3) + [prose(rng, rng.choice([1, 4, 12, 40]), [f"o{i}x{k}" for k in range(50)])])
        for k in range(rng.choice([1, 1, 2, 4])):
            w = text.split()
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"c{k}y{rng.randrange(100)}"
            rows.append((10 * i + k, " ".join(w), "en", "s"))
    for percent in (90, 80):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.join(docs(spark, rows), percent=percent).collect()}
        assert got == brute_links(rows, 3, percent)


def test_language(spark):
    rng = random.Random(5)
    own = {"en": ["the", "and", "thing", "with", "house"], "de": ["der", "und", "nicht", "haus", "schön"], "fr": ["le", "été", "maison", "avec", "que"]}
    rows = [(i, prose(rng, 30, own[x]), x, x + "-host") for i, x in enumerate(["en", "de", "fr"] * 60)]
    hidden = [(900 + i, prose(rng, 20, own[x]), None, None) for i, x in enumerate(["en", "de", "fr"] * 20)]
    wrong = [(990, prose(rng, 40, own["de"]), "en", "en-host")]
    got = {r["doc_id"]: r for r in language.identify(docs(spark, rows + hidden + wrong + EDGE)).collect()}
    assert all(got[900 + i]["language"] == x and got[900 + i]["kept"] for i, x in enumerate(["en", "de", "fr"] * 20))
    assert got[990]["language"] == "de" and not got[5000]["kept"] and got[5000]["language"] == "en" and not got[5001]["kept"]
    close = {r["doc_id"]: r["language"] for r in language.identify(docs(spark, [*rows, (1, "xx", None, "fr-host"), (2, "xx", None, "de-host")]).where("doc_id > 2 or text = 'xx'")).collect()}
    assert close[1] == "fr" and close[2] == "de"  # the host decides where the text does not
    assert language.identify(docs(spark, []).limit(0)).collect() == []
    assert [r["language"] for r in language.identify(docs(spark, [(1, "abc", None, "h")])).collect()] == [None]


def test_more_languages_than_a_dense_table_has(spark):
    rng = random.Random(9)
    own = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5)] for k in range(80)}
    rows = [(100 * k + i, prose(rng, 30, own[x]), x, f"{x}-host") for k, x in enumerate(own) for i in range(4)]
    hidden = [(9000 + k, prose(rng, 30, own[x]), None, None) for k, x in enumerate(own)]
    got = {r["doc_id"]: r for r in language.identify(docs(spark, rows + hidden)).collect()}
    assert all(got[9000 + k]["language"] == x and got[100 * k]["language"] == x and got[9000 + k]["kept"] for k, x in enumerate(own))
    cells = np.unique(np.random.default_rng(1).integers(0, 3 * language.BUCKETS, 5000))
    table = cells // language.BUCKETS, cells % language.BUCKETS, np.arange(len(cells)) % 7 + 1
    grams = table[1][:900]
    a, b = language.Dense(*table, 3)(grams), language.Sparse(*table, 3)(grams)
    assert np.allclose(a - a.mean(), b - b.mean(), atol=1e-2)


def test_the_suffix_decides_on_rare_hosts(spark):
    rng = random.Random(5)
    own = {"en": ["the", "and", "thing", "with", "house"], "de": ["der", "und", "nicht", "haus", "schön"], "fr": ["le", "été", "maison", "avec", "que"]}
    rows = [(i, prose(rng, 30, own[x]), x, f"a{i}.example.{dict(en='uk').get(x, x)}") for i, x in enumerate(["en", "de", "fr"] * 60)]
    asked = [(900, "xx", None, "new.example.fr"), (901, "xx", None, "https://me@new.example.DE.:80/x.fr?y=a.fr"), (902, "xx", None, "new.example.uk")]
    got = {r["doc_id"]: r["language"] for r in language.identify(docs(spark, rows + asked)).collect()}
    assert (got[900], got[901], got[902]) == ("fr", "de", "en")
    hosts = spark.createDataFrame([(x,) for x in ("src0", "10.0.0.1", "a.b.fr", "", None, "http://x.com/a.b", "fr.")], "h string")
    assert [r[0] for r in hosts.select(language.suffix_of(hosts["h"])).collect()] == [None, None, "fr", None, None, "com", None]


def brute_posteriors(rows):
    """(language, posterior) by the formulas of the module's docstring, row by row."""
    names = sorted({r[2] for r in rows if r[2] is not None})
    counts = {x: Counter() for x in names}
    for _, text, lang, _ in rows:
        if lang is not None:
            counts[lang].update(language._trigrams((text or "").encode()).tolist())
    total = {x: sum(c.values()) for x, c in counts.items()}
    likely = lambda x, g: math.log((counts[x][g] + 0.1) / (total[x] + 0.1 * language.BUCKETS))
    texts, found = [], []
    for _, text, _, _ in rows:
        grams = language._trigrams((text or "").encode()).tolist()
        texts.append({x: language.TEMPER * sum(likely(x, g) for g in grams) for x in names})
        found.append(max(names, key=lambda x: (texts[-1][x], -names.index(x))) if grams else None)
    suffixes = [s.rsplit(".", 1)[1] if s and "." in s else None for *_, s in rows]
    corpus = Counter(f for f in found if f)
    base = {x: (corpus[x] + 1) / (sum(corpus.values()) + len(names)) for x in names}
    said = Counter((f, r[2]) for f, r in zip(found, rows, strict=True) if f and r[2])
    out = []
    for k, (_, _, lang, host) in enumerate(rows):
        prior = base
        for at, where in ((suffixes[k], suffixes), (host, [r[3] for r in rows])):
            if at is not None and any(w == at and f for w, f in zip(where, found, strict=True)):
                own = {x: sum(w == at and f == x and i != k for i, (w, f) in enumerate(zip(where, found, strict=True))) + language.PULL * prior[x] for x in names}
                prior = {x: v / sum(own.values()) for x, v in own.items()}
        score = {x: texts[k][x] + math.log(prior[x]) for x in names}
        if lang is not None:
            for x in names:
                score[x] += math.log((said[x, lang] + 0.5 + 2 * (x == lang)) / (sum(said[x, y] for y in names) + 0.5 * len(names) + 2))
        best = max(names, key=lambda x: (score[x], -names.index(x)))
        out.append((best, 1 / sum(math.exp(v - score[best]) for v in score.values())))
    return out


def test_posteriors_are_those_of_a_plain_version(spark):
    rng = random.Random(4)
    own = {"en": ["the", "and", "thing", "with"], "de": ["der", "und", "nicht", "schön"], "fr": ["le", "été", "maison", "avec"]}
    rows = []
    for i in range(150):
        x = rng.choice(list(own))
        shared = [rng.choice(["a", "o", "de", "et"]) for _ in range(rng.randrange(4))]
        text = " ".join([rng.choice(own[x]) for _ in range(rng.choice([0, 0, 1, 2]))] + shared)
        rows.append((i, rng.choice([text, text, None]) if i % 9 == 0 else text, rng.choice([x, x, x, rng.choice(list(own)), None]), rng.choice([f"h{rng.randrange(5)}.{x}", f"{x}.example", "plain", None])))
    got = {r["doc_id"]: r for r in language.identify(docs(spark, rows)).collect()}
    for (i, *_), (name, posterior) in zip(rows, brute_posteriors(rows), strict=True):
        assert got[i]["language"] == name and math.isclose(got[i]["posterior"], posterior, rel_tol=1e-3), i


def test_operators_take_rows_with_their_own_column_names_and_very_long_texts(spark):
    long = "word of a very long text " * 60_000
    names = "doc_id long, text string, lang string, source string, language string, posterior double, piece int, `offset` long, `a.b` string, predicted int, shard string, component_id long, score double, node binary, rank int"
    rows = [(i, t, "en", "s", "x", 0.5, 1, 2, "z", 0, "0", 5, 1.5, b"n", 3) for i, t in enumerate([long, long + "x", "short text", None, "", "w" * 500_000])]
    d = spark.createDataFrame(rows, names)
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    for f in (language.identify, lmscore.score, packing.pack, jaccard.join, lambda x: toxicity.toxicity(x, labels, model=toxicity.Model(toxicity.Network(0), np.zeros(toxicity.COUNTED, np.float32), np.zeros(toxicity.COUNTED, np.float32), 1.0, 0.0))):
        got = f(d).collect()
        assert {r["doc_id"] for r in got} == set(range(6))
    assert sorted(r["doc_id"] for r in jaccard.deduplicate(d).collect()) == [0, 2, 3, 4, 5]
    pages = spark.createDataFrame([(1, "u", "<article>" + "<p>" + "a long paragraph it is. " * 20_000 + "</p></article>", "t", 4)], "page_id long, url string, html string, text string, n_chars int")
    assert extract.extract(pages).first()["n_chars"] > 400_000
    vectors = spark.createDataFrame([(50, [1.0, 0.0], 1, 2.0), (51, [0.5, 0.5], 1, 2.0)], "vec_id long, embedding array<double>, rank int, score double")
    assert [tuple(r) for r in nearest.search(vectors).collect()] == [(50, 1, 51, 256 * 128)]


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = [*corpus(), *EDGE, (7000, "long word " * 9000, "", ""), (7001, "a\xa0\xa0b \r\n <|endoftext|> It's", "", ""), (7002, "\xa0 \r", "", "")]
    got = packing.pack(docs(spark, rows), capacity=512).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    told = defaultdict(list)
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        told[i] += [(k, 512 * k, len(ids[512 * k : 512 * (k + 1)]), zlib.crc32(ids[512 * k : 512 * (k + 1)].tobytes())) for k in range(-(-len(ids) // 512))]
    assert {i: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in v) for i, v in by.items()} == {i: sorted(v) for i, v in told.items()}
    for v in sequences.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r["length"] for r in got)
    assert len(sequences) <= 1.1 * total / 512 + 2
    assert packing.pack(docs(spark, []).limit(0)).collect() == []


def test_plan_is_whole_and_close_to_the_bound():
    rng = np.random.default_rng(0)
    for histogram in (Counter(rng.integers(1, 4097, 5000).tolist()), Counter(rng.integers(1200, 2500, 20000).tolist()), Counter({4096: 3}), Counter({2049: 10, 1: 5}), Counter()):
        runs = packing.plan(histogram)
        placed = Counter()
        for r in runs:
            assert sum(k * v for k, v in r.has.items()) + r.room == packing.CAPACITY and r.room >= 0 and r.n > 0
            for k, v in r.has.items():
                placed[k] += v * r.n
        assert placed == histogram
        assert sum(r.n for r in runs) <= sum(r.n for r in packing.best_fit([], dict(histogram), packing.CAPACITY))


def test_words_with_one_hash_keep_their_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    ids, plain = packing.WordIds(path), Tokenizer.from_file(path)
    for n in (1024, 2048):  # such words have one sum of powers modulo 2**64, whatever the powers
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        other = word.translate(str.maketrans("ab", "ba"))
        texts = [f"x {word} y", f"{other} z", f"{word} {other} {word}", other, word]
        for _ in range(2):
            assert [x.tolist() for x in ids.encode([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_language_model(spark):
    rng = random.Random(8)
    phrases = [prose(rng, 4, [f"w{i}" for i in range(40)]) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(rng.randrange(2, 30))) + f" only{i}", "en", "s") for i in range(300)] + [r for r in EDGE if r[0] not in (None, 5005)]
    got = {r["doc_id"]: r for r in lmscore.score(docs(spark, rows)).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    split = {i: [*(t or "").encode().lower().split(), 0] for i, t, *_ in rows}
    c = Counter(w for i, ws in split.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in split.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (held(i), len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(got[i]["base_score"], base, rel_tol=1e-9) and got[i]["score"] < 0
    rows_out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in rows_out) > sum(r["base_score"] for r in rows_out)
    few = lmscore.score(docs(spark, [(None, "a b", "", ""), (1, "x", "", ""), (1, "x", "", "")])).collect()
    assert len(few) == 3 and lmscore.score(docs(spark, []).limit(0)).collect() == []


def test_every_word_is_a_context(spark):
    n = 400  # each left word has one right word, and all of them occur as often
    rows = [(i, " ".join(f"left{(i + k * 7) % n} right{(i + k * 7) % n}" for k in range(10)), "", "") for i in range(1000)]
    held = [i for i in range(2000, 9000) if zlib.crc32(str(i).encode()) % 5 == 1][: 2 * n]
    asked = [(held[k], f"left{k} right{k}", "", "") for k in range(n)] + [(held[n + k], f"left{k} right{(k + 1) % n}", "", "") for k in range(n)]
    got = {r["doc_id"]: r["score"] for r in lmscore.score(docs(spark, rows + asked)).collect()}
    assert all(got[held[k]] > got[held[n + k]] + 1.5 for k in range(n))


def test_tables_are_drawn_from_their_distribution():
    rng = np.random.default_rng(5)
    for c, d, strength, others, sent, up in ((6, 0.6, 5.0, 20, 3.4, 900.0), (30, 0.3, 2.0, 0, 0.7, 60.0), (70, 0.75, 5.0, 300, 40.0, 2000.0), (200, 0.5, 5.0, 50, 9.5, 400.0)):
        t = np.arange(1, c + 1)
        rise = [sum(math.log(strength + d * (others + j)) + math.log((sent + j) / (up + j)) for j in range(k)) for k in t]
        p = seating.stirling(d, c)[c, 1:] + rise
        p = np.exp(p - p.max())
        p /= p.sum()
        n, now = 20_000, np.ones(20_000, dtype=np.int64)
        for _ in range(1 if c <= seating.EXACT else 25):
            now = seating.draw(np.full(n, c), now, d, strength, *(np.full(n, float(x)) for x in (others, sent, up)), rng)
        mean, deviation = (p * t).sum(), math.sqrt((p * t * t).sum() - (p * t).sum() ** 2)
        assert abs(now.mean() - mean) < 0.05 * deviation + 0.01 and abs(now.std() - deviation) < 0.08 * deviation + 0.01
        assert np.abs(np.bincount(now, minlength=c + 1)[1:] / n - p).max() < 0.03


def test_seatings_are_counted_right():
    for d in (0.1, 0.5, 0.8):
        table = seating.stirling(d, 300)
        for c in (41, 300):
            t = np.arange(1, c + 1)
            assert np.abs(seating.log_stirling(np.full(c, c), t, d) - table[c, 1 : c + 1]).max() < 0.1


def held_ids(n, start=10**6):
    return [i for i in range(start, start + 12 * n) if zlib.crc32(str(i).encode()) % 5 == 1][:n]


def trained_ids(n):
    return [i for i in range(2 * n + 20) if zlib.crc32(str(i).encode()) % 5 != 1][:n]


def seated_by_customer(texts, asked, sweeps=120, burn=40, seed=0):
    """The average over sweeps of the log10 probabilities of texts, by a sampler that moves one customer after the other."""
    rng = random.Random(seed)
    pairs = [(u, w) for t in texts for u, w in zip(["$", *t], [*t, "$"], strict=True)]
    counts = Counter(Counter(pairs).values())
    d = min(max(counts[1] / max(counts[1] + 2 * counts[2], 1), 0.05), 0.9)
    sizes, of = defaultdict(list), [None] * len(pairs)
    at_root, tables = Counter(), Counter()
    n_root, words = 0, set(w for _, w in pairs)

    def root(w, d0):
        return (at_root[w] - d0) / (lmscore.ROOT + n_root) if at_root[w] else 1e-9

    def root_discount():
        n = Counter(at_root.values())
        return min(max(n[1] / max(n[1] + 2 * n[2], 1), 0.05), 0.9)

    total = defaultdict(list)
    for sweep in range(sweeps):
        d0 = root_discount()
        for k, (u, w) in enumerate(pairs):
            mine = sizes[u, w]
            if of[k] is not None:
                mine[of[k]] -= 1
                if not mine[of[k]]:
                    tables[u] -= 1
                    at_root[w] -= 1
                    n_root -= 1
            weights = [max(x - d, 0) if x else 0 for x in mine] + [(lmscore.STRENGTH + d * tables[u]) * root(w, d0)]
            pick = rng.choices(range(len(weights)), weights)[0]
            if pick == len(mine):
                pick = mine.index(0) if 0 in mine else len(mine)
                if pick == len(mine):
                    mine.append(0)
                tables[u] += 1
                at_root[w] += 1
                n_root += 1
            mine[pick] += 1
            of[k] = pick
        if sweep < burn:
            continue
        d0, n = root_discount(), Counter(u for u, _ in pairs)
        for i, t in asked.items():
            for k, (u, w) in enumerate(zip(["$", *t], [*t, "$"], strict=True)):
                p0 = (at_root[w] - d0) / (lmscore.ROOT + n_root) if w in words else (lmscore.ROOT + d0 * len(words)) / (lmscore.ROOT + n_root)
                own, up = (max(sum(sizes[u, w]) - d * sum(x > 0 for x in sizes[u, w]), 0) / (lmscore.STRENGTH + n[u]), (lmscore.STRENGTH + d * tables[u]) / (lmscore.STRENGTH + n[u])) if n[u] else (0, 1)
                total[i, k].append(own + up * p0)
    return {i: sum(math.log10(np.mean(total[i, k])) for k in range(len(t) + 1)) for i, t in asked.items()}


def test_scores_agree_with_a_sampler_of_single_customers(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(20)]
    texts = [[vocabulary[min(int(rng.expovariate(0.25)), 19)] for _ in range(rng.randrange(1, 12))] for _ in range(120)]
    asked = dict(zip(held_ids(40), [t + ["new"] * (k % 3 == 0) for k, t in enumerate(texts[:20] + [[rng.choice(vocabulary) for _ in range(6)] for _ in range(20)])], strict=True))
    rows = [(i, " ".join(t), "", "") for i, t in [*zip(trained_ids(len(texts)), texts, strict=True), *asked.items()]]
    got = {r["doc_id"]: r for r in lmscore.score(docs(spark, rows)).collect()}
    told = seated_by_customer(texts, asked)
    for i, t in asked.items():
        assert abs(got[i]["score"] - told[i]) < 0.05 * (len(t) + 1), (t, got[i]["score"], told[i])
        assert math.isclose(got[i]["perplexity"], 10 ** (-got[i]["score"] / (len(t) + 1)), rel_tol=1e-9)
    assert abs(sum(got[i]["score"] - told[i] for i in asked)) < 0.01 * sum(len(t) + 1 for t in asked.values())


def toxic_rows(n=240):
    rng = random.Random(7)
    words = [a + b for a in "bcdfglmnprst" for b in ("a", "ei", "on", "ust", "ir", "emo")]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.choice([20, 60, 300]))]
        if i % 3 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vilest", "grubber", "zzag" + rng.choice(words)])
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 0, int(i % 3 == 0)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    ls = spark.createDataFrame([*labels, (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs(spark, rows + EDGE[:5]), ls).collect()}
    out = [(got[i]["predicted"], y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in labels)
    assert sum(p == y for p, y in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[5000]["score"] == got[5001]["score"] and got[5000]["predicted"] == 0
    assert [r["score"] for r in toxicity.toxicity(docs(spark, rows[:2]), ls.limit(0)).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(docs(spark, []).limit(0), ls.limit(0)).collect() == []


def test_gradients(monkeypatch):
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5, net.INPUT))
    ids = rng.integers(1, 6, (3, 6))
    ids[0, 4:] = 0

    def loss():
        t = np.concatenate([net.project(np.zeros((0, net.INPUT))), net.project(x)[1:]]).astype(np.float64)
        return float((net.forward(t, ids) * [1.0, -2.0, 0.5]).sum())

    keep = []
    net.forward(net.project(x), ids, keep)
    grads, d_x = net.backward(x, ids, keep, np.array([1.0, -2.0, 0.5]))
    for name in ("u", "a", "v", "o", "w", "b"):
        at = tuple(int(rng.integers(n)) for n in net.p[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-2 - grads[name][at]) < 2e-2 * (1 + abs(grads[name][at])), name
    assert d_x.shape == x.shape


def test_characters_are_read_in_order_and_learned(monkeypatch):
    monkeypatch.setattr(toxicity, "LONG", 4)
    net = toxicity.Network(5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words_ = [b"a", b"ab", b"ba", "zé".encode(), b"abcdefghij"]
    wanted = np.random.default_rng(1).normal(size=(5, 2 * toxicity.SPELL))
    h = toxicity.SPELL
    sigmoid = lambda v: 1 / (1 + math.exp(-v))

    def plain(word, d):
        state = [0.0] * h
        for byte in word if d == 0 else reversed(word):
            x, hid = net.p["letters"][byte] @ net.p["lw"][d] + net.p["lb"][d], np.array(state) @ net.p["lu"][d]
            r, z = ([sigmoid(x[i + k * h] + hid[i + k * h]) for i in range(h)] for k in (0, 1))
            state = [(1 - z[i]) * math.tanh(x[i + 2 * h] + r[i] * hid[i + 2 * h]) + z[i] * state[i] for i in range(h)]
        return state

    told = [np.mean([plain(w[i : i + 4], 0) + plain(w[i : i + 4], 1) for i in range(0, len(w), 4)], axis=0) for w in words_]
    assert np.allclose(net.spell(*toxicity.letters(words_)), told, atol=1e-5) and not np.allclose(told[1], told[2], atol=1e-3)
    keep = []
    net.spell(*toxicity.letters(words_), keep)
    grads = net.spell_back(keep, wanted)
    for name, at in (("lu", (0, 1, 2)), ("lu", (1, 3, 11)), ("lw", (1, 2, 3)), ("lb", (0, 12)), ("letters", (97, 1)), ("letters", (98, 3))):
        old, sides = net.p[name][at], []
        for step in (1e-2, -1e-2):
            net.p[name][at] = old + step
            sides.append(float((net.spell(*toxicity.letters(words_)) * wanted).sum()))
        net.p[name][at] = old
        assert abs((sides[0] - sides[1]) / 2e-2 - grads[name][at]) < 1e-2 * (1 + abs(grads[name][at])), name


def test_every_word_is_in_a_window():
    for n in (0, 1, 47, 48, 49, 80, 500, 513):
        at = toxicity.windows(n)
        assert {i for s in at for i in range(s, min(s + toxicity.WINDOW, n))} == set(range(n))
        for passage in range(max(0, n - toxicity.STRIDE + 1)):  # a passage of a stride lies whole in a window
            assert any(s <= passage and passage + toxicity.STRIDE <= max(s + toxicity.WINDOW, n if n < toxicity.WINDOW else 0) for s in at)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("just some text. It goes on for a while, as texts do when they are long enough.", "just some text. It goes on for a while, as texts do when they are long enough."),
        ("<nav><a href=/>Home</a></nav><article><h1>T &amp; t</h1><p>One<br>two <b>three</b>.<p>Four.</article><footer>&copy; x</footer>", "T & t\n\nOne two three.\n\nFour."),
        ("<main><p>Words that make a paragraph of some length here.</p><aside>no</aside><form>no<input></form><div class='ad-box ad'>no</div><div class=cookie-notice>no</div><section id=comments><p>A reader has said a lot of words about this here.</p></section></main>", "Words that make a paragraph of some length here."),
        (
            "<body class='has-sidebar header-top'><div class=page-with-sidebar><div class=site-header><p>Site</p></div><div id=content class=site-content><div class=post><div class=post-header><h1>Title</h1></div>"
            "<div class=entry-content><p>Some real words make this paragraph long.</p><ul><li>first</li><li>second</li></ul><p>End.</p></div><div class=entry-footer>Filed under x</div><div class='share buttons'>Share this</div></div>"
            "<div id=comments><ol class=commentlist><li class=comment><p>I really like what has been written here, thanks a lot.</p></li></ol></div></div>"
            "<div class=sidebar><article><h2>Teaser</h2></article><ul><li><a href=/r>Recent post</a></li></ul></div></div><footer>Imprint</footer>",
            "Title\n\nSome real words make this paragraph long.\n\nfirst\n\nsecond\n\nEnd.",
        ),
        ("<form id=aspnet><div class=menu><a href=/>x</a></div><div class=content><h1>T</h1><p>A paragraph in a page that is one form, as some are.</p></div></form>", "T\n\nA paragraph in a page that is one form, as some are."),
        ("<article><p>a<script>if (x < '</p>') y()</script>b<style>p{}</style></p><!-- c --><p title='\"'>d</p>", "a b\n\nd"), ("<article><p>cut <b>off</", "cut off"), ("<article><p>cut <a href=\"x", "cut"),
    ],
)
def test_extraction(page, text):
    assert extract.main_text(page) == text


def test_minimum_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(1, 9)
        score = [rng.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 2) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        cost = lambda x: sum(s if not k else 0 for s, k in zip(score, x, strict=True) if s > 0) + sum(-s if k else 0 for s, k in zip(score, x, strict=True) if s < 0) + sum(w for (i, j), w in edges.items() if x[i] != x[j])  # noqa: B023, E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert math.isclose(cost(extract.minimum_cut(score, edges)), best, abs_tol=1e-9)


def signs(html):
    elements, blocks = extract.read(html)
    extract.judge(elements, blocks)
    return [text for e, text, linked in blocks if extract.odds(elements[e], text, linked) > 0]


def test_the_cut_decides_where_the_classifier_is_unsure():
    story = [f"paragraph {k} tells " + "what happened then and there " * 6 + "." for k in range(4)]
    # a long comment between short lines of a section of comments: by itself it would be content
    comment = "as a reader i must say " + "that this is not how it was " * 45 + "."
    page = "<body><article>" + "".join(f"<p>{p}</p>" for p in story * 5) + f"</article><div class='comments'><p>Ann wrote</p><p>{comment}</p><p>Bob wrote</p></div></body>"
    assert comment in signs(page) and extract.main_text(page) == "\n\n".join(p.strip() for p in story * 5)
    # a short line between paragraphs: by itself it would be boilerplate
    page = "<body><div>" + f"<p>{story[0]}</p><p>So it went</p><p>{story[1]}</p>" + "</div><div><a href='/'>home</a> <a href='/b'>all</a></div></body>"
    assert "So it went" not in signs(page) and extract.main_text(page) == "\n\n".join([story[0], "So it went", story[1]])
    # advertising inside the article stays cut off
    page = "<article>" + f"<p>{story[0]}</p><div class='ad'>Buy the best things now, today only.</div><p>{story[1]}</p>" + "</article>"
    assert extract.main_text(page) == "\n\n".join(story[:2])


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "u", "<article><p>é</p></article>"), (2, "u", "<article><p>é</p></article>")], "page_id long, url string, html string")
    assert sorted(map(str, map(tuple, extract.extract(pages).collect()))) == sorted(map(str, [(1, "u", "", 0), (None, None, "", 0), (2, "u", "é", 1), (2, "u", "é", 1)]))
    assert extract.extract(pages.limit(0)).collect() == []


def brute_top(rows, every, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(b) == len(a))
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


def test_nearest(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.2) + (i % 4) for _ in range(6)]) for i in range(300)] + [(1000 + i, [0.5] * 6) for i in range(150)]
    rows += [(2000, None), (2050, [1.0, None, 1, 1, 1, 1]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (None, [1.0] * 6), (2200, [1.0, 2.0]), (2201, [2.0, 1.0]), (2250, [])]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for small in ({"pivots": 8, "stripe": 40, "group_bytes": 100}, {"pivots": 40, "stripe": 25}, {}):
        assert sorted(map(tuple, nearest.search(d, **small).collect())) == brute_top(rows, 50, 5)
    assert nearest.search(d.limit(0)).collect() == []
    huge = spark.createDataFrame([(0, [5e6, 5e6]), (1, [5e6, 3e6]), (2, [-5e6, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, nearest.search(huge).collect())) == brute_top([(r[0], r[1]) for r in huge.collect()], 50, 5)


def test_nearest_with_repeated_ids_in_small_cells(spark):
    rng = random.Random(9)
    rows = [(100, [50.0 + rng.random(), 1.0]) for _ in range(60)] + [(i, [rng.gauss(0, 30), rng.gauss(0, 30)]) for i in range(101, 400)] + [(50, [40.0, 40.0])] * 7
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, nearest.search(d, pivots=64, stripe=50, group_bytes=64).collect())) == brute_top(rows, 50, 5)


def test_nearest_compares_few_pairs_of_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(0, 1, (40, 16))
    rows = [(i, (centre[i % 40] * 8 + rng.normal(0, 0.1, 16)).tolist()) for i in range(4000)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert nearest.compared(d) < 0.3 * 80 * 4000
