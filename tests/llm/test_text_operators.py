"""Operators 2, 4, 6, 8, 9 and 10 against brute force, the library and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from threadmill.llm import bpe, decontaminate, kneser_ney, langid, quality, simhash
from threadmill.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("word_bpe_49k.json")


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def key(x):
    return tuple((v is None, str(v)) for v in x)


# 2


TEXTS = ["Hello  World's <|endoftext|> it's 123", "ΟΔΟΣ Σ İstanbul ﬁ", "日本語🎉🎉👍", "\x00\x1c\x1dx\x85　y", "don'T WE'LL ''s", "Ⅷ ½²", "é", "<|startoftext|>", "a" * 300, "zq" * 40, "\u0558a \U00010940b x\ua7cby 1\u208f2"]


def test_bpe_equals_the_library(docs, corpus):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(PATH), bpe.ForcedBoundaryBpe(bpe.load(PATH))
    for t in TEXTS:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    got = bpe.encode_decode_digest(docs, bpe.load(PATH)).collect()
    want = []
    for r in corpus:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_bpe_round_trip_keeps_columns(docs, empty):
    d = bpe.load(PATH)
    out = bpe.decode(bpe.encode(docs, d), d)
    assert set(docs.columns) | {"decoded"} == set(out.columns) and out.count() == docs.count()
    assert bpe.encode(empty, d).collect() == [] and bpe.encode_decode_digest(empty, d).collect() == []


def test_bpe_tables_can_overflow(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_ENTRIES", 5)
    own, fresh = bpe.ForcedBoundaryBpe(bpe.load(PATH)), bpe.ForcedBoundaryBpe(bpe.load(PATH))
    for t in TEXTS * 2:
        assert own.encode(t) == fresh.encode(t)


# 4


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(1)
    syllables = {"en": "the ing tion er and th".split(), "fr": "eau ou elle que é ment".split(), "de": "sch ein ung ü keit ß".split()}
    rows = [(i, " ".join("".join(rng.choice(syllables[x]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 80))), x) for i in range(300) for x in [rng.choice(list(syllables))]]
    rows += [(900, None, "en"), (901, "", None), (902, "12 ### !!", "de"), (903, "ÉÀ" * 3, None), (None, "thing the and", "en"), (5, "ein schein", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_language_of_held_out_texts(languages):
    model = langid.fit(languages, F.coalesce("doc_id", F.lit(0)) % 3 != 1, per_language=60)
    got = langid.predict(languages, model, ("doc_id", "lang")).collect()
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] % 3 == 1 and r["doc_id"] < 300]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == languages.count()
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[900]["rejected"] and by[903]["lang_pred"] != "und"
    assert not any(r["rejected"] for r in held)


def test_far_texts_are_rejected_and_short_ones_kept(spark, languages):
    model = langid.fit(languages, F.lit(True), per_language=60)
    rows = [(1, "我们今天去公园散步天气很好" * 20), (2, "qxz wvk jjx " * 40), (3, "qxz"), (4, "thing tion and the ering " * 10)]
    got = {r["doc_id"]: r["rejected"] for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}


def test_language_without_training_rows(languages, empty):
    assert langid.fit(empty, F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.predict(languages, None).collect()} == {"und"}
    assert langid.predict(empty, None).collect() == []


# 6


def fingerprint(text, n):
    w = WORD.findall(low(text))
    shingles = [" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if sum(x >> j & 1 for x in h) * 2 > len(h))


def test_simhash_groups_match_brute_force(docs, corpus):
    fps = [fingerprint(r[1], 4) for r in corpus]
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    least = defaultdict(list)
    for i, r in enumerate(corpus):
        if r[0] is not None:
            least[root(i)].append(r[0])
    want = [(r[0], f"{f:016x}", min(least[root(i)], default=None)) for i, (r, f) in enumerate(zip(corpus, fps, strict=True))]
    assert sorted(map(tuple, simhash.near_duplicate_digest(docs).collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("n", [10, 10**6, 10**9])
def test_pigeonhole_masks_meet_every_close_pair(n):
    masks, rng = simhash.block_masks(n, 4), random.Random(n)
    for _ in range(300):
        difference = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not difference & m for m in masks)


def test_links_inside_large_groups_connect_all():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fp = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64)) for b in base]))[:, None]
    a, b = simhash.linked(np.zeros(len(fp), np.uint64), fp, 4)
    assert (np.bitwise_count(fp[a, 0] ^ fp[b, 0]) <= 4).all() and len(simhash._thinned(fp[a, 0], fp[b, 0])[0]) == len(fp) - 3


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(5, 5), (None, 3), (7, 6)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_similar_texts_leave_one(spark, docs, empty):
    rng = random.Random(5)
    rows = []
    for g in range(30):
        words = [f"g{g}w{rng.randint(0, 999)}" for _ in range(400)]
        for c in range(4):
            changed = list(words)
            changed[50 * c + 7] = f"c{c}"
            rows.append((g * 10 + c, " ".join(changed), "x", f"k{c}"))
    rows += [rows[0], (1000, None, None, None), (1001, "", None, None), (None, rows[8][1], None, None)]
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, _key string, root string"))
    assert sorted(r["doc_id"] for r in out.collect()) == [*(10 * g for g in range(30)), 1000]
    assert out.columns == ["doc_id", "text", "_key", "root"]
    assert simhash.drop_near_duplicates(empty).collect() == [] and simhash.near_duplicate_digest(empty).collect() == []


# 8

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(rows, items, width=10):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        for k in range(max(1, len(w) - width + 1)) if w and i is not None else ():
            windows[tuple(w[k : k + width])].add(str(i))
    out = []
    for r in rows:
        w, hit, found = ALNUM.findall(low(r[1])), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= x
        out.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def benchmark(spark, corpus):
    texts = [r[1] for r in corpus if r[1]]
    items = [(i, " ".join(t.split()[5:25]).upper()) for i, t in enumerate(texts[:12])] + [(50, "the"), (51, "and, so and"), (52, None), (53, ""), (54, "..."), (55, "the"), (None, "a"), (9, "nothing of this kind is in any of the many texts here at all"), (56, texts[0])]
    return items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("max_windows", [2_000_000, 15])
def test_contamination_matches_brute_force(docs, corpus, benchmark, max_windows):
    got = decontaminate.decontamination_digest(docs, benchmark[1], max_windows=max_windows)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(contamination(corpus, benchmark[0]), key=key)


def test_contaminated_spans_and_documents_go(docs, corpus, benchmark, empty):
    out = decontaminate.remove_contaminated(docs, benchmark[1]).collect()
    facts = {(r[0], r[1]): f for r, f in zip(corpus, contamination(corpus, benchmark[0]), strict=True)}
    assert len(out) == sum(f[2] <= 0.5 * f[1] for r in corpus for f in [facts[r[0], r[1]]])
    clean = {(r[0], r[1]) for r in corpus if not facts[r[0], r[1]][5]}
    assert clean <= {(r["doc_id"], r["text"]) for r in out}
    assert decontaminate.remove_contaminated(empty, benchmark[1]).collect() == []
    none = decontaminate.decontamination_digest(docs, benchmark[1].where("false")).collect()
    assert len(none) == len(corpus) and not any(r["contaminated"] for r in none)


# 9


def test_quality_of_held_out_texts(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 120))]
        bad = i % 4 == 0
        if bad:
            kind = rng.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + "###" for w in words] if kind == 1 else [w for w in words[:8] for _ in range(12)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), 0))
    labels += [(0, 0, 0), (1000, 1, 0), (7, None, 0), (None, 1, 1)]
    rows += [(500, None), (501, ""), (None, "x y"), (502, "x")]
    d, l = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(d, l, F.coalesce("doc_id", F.lit(0)) % 5 != 0)
    got = quality.score(d, model).collect()
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 5 == 0]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got) and len(got) == len(rows)


def test_quality_without_labels(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none, F.lit(True))
    assert model is None and {r["score"] for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.score(empty, model).collect() == []


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    y = (x[:, 0] - 0.5 * x[:, 2] > -0.8).astype(int)
    m = quality.fit_ranking(x, y)
    s = m.score(x)
    assert ((s >= 0.3).astype(int) == y).mean() > 0.93


# 10


def kneser_ney_by_hand(rows, train, order):
    tokens = [[*WORD.findall(low(t)), "</s>"] for _, t in rows]
    grams = lambda t, k: zip(*(([*["<s>"] * (order - 1), *t][order - k + j :]) for j in range(k)))  # noqa: E731  those of k tokens, in order of the last
    count, levels = Counter(), {order: Counter()}
    for (i, _), t in zip(rows, tokens, strict=True):
        if train(i):
            count.update(t)
            levels[order].update(grams(t, order))
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    n, v, total = sum(count.values()), len(count), sum(levels[1].values())
    often = lambda values: np.array([sum(x == k for x in values) for k in (1, 2, 3, 4)] + [len(values)])
    d = {k: kneser_ney.discounts(often(list(levels[k].values()))) for k in levels}
    context = {k: defaultdict(lambda: [0, 0, 0, 0]) for k in levels}
    for k in levels:
        for g, c in levels[k].items():
            context[k][g[:-1]][0] += c
            context[k][g[:-1]][min(c, 3)] += 1

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / (v + 1)
        if g[:-1] not in context[k]:
            return lower
        c, m = context[k][g[:-1]], levels[k][g]
        return max(m - d[k][min(m, 3)], 0) / c[0] + (d[k][1] * c[1] + d[k][2] * c[2] + d[k][3] * c[3]) / c[0] * lower

    out = []
    for (i, _), t in zip(rows, tokens, strict=True):
        out.append((i, len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(g)) for g in grams(t, order))))
    start = ("<s>",) * (order - 1)
    assert abs(sum(p((*start, w)) for w in count) + p((*start, "\x00unknown")) - 1) < 1e-9
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("none", [False, True])
def test_scores_match_a_model_by_hand(docs, corpus, none, order):
    train = (lambda i: False) if none else (lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2)
    condition = F.lit(False) if none else F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    got = sorted(map(tuple, kneser_ney.score(docs, condition, order=order, batch_bytes=1 << 14).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[5]))
    want = sorted(kneser_ney_by_hand([r[:2] for r in corpus], train, order), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[5]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9) and g[5] == pytest.approx(w[5], rel=1e-9)


def test_scores_of_no_rows(empty):
    assert kneser_ney.score(empty, F.lit(True)).collect() == []
