"""Operators 1, 4 and 9 and the pipeline's run against plain loops over the same rules."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmill.llm import hnsw, langid, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 1


def nearest_by_hand(rows, k=10):
    """Distances by math.dist, which neither overflows nor loses small differences."""
    out = {}
    for q, x in rows:
        if q % 10 == 0:
            near = sorted((math.dist(x, y), i) for i, y in rows if i != q)
            out[q] = near[:k]
    return out


@pytest.mark.parametrize("kind,scale", [("float", 1e20), ("float", 1e-30), ("double", 1e150), ("double", 1e-200), ("mixed", 1.0)])
def test_sizes_of_vectors_do_not_matter(spark, kind, scale):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 6)) * scale
    if kind == "mixed":  # two worlds: tiny vectors near to each other, and huge ones
        x[::2] *= 1e-12
        x[1::2] *= 1e12
    if kind == "float":
        x = x.astype(np.float32).astype(np.float64)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{'float' if kind == 'float' else 'double'}>").repartition(3)
    got = {}
    for r in hnsw.nearest(table, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = nearest_by_hand(rows)
    assert set(got) == set(want)
    for q, near in want.items():
        mine = sorted(got[q])
        assert [v for _, v, _ in mine] == [i for _, i in near]
        assert [s for _, _, s in mine] == pytest.approx([d for d, _ in near], rel=1e-12)


def test_distances_beyond_double_precision_are_infinite(spark):
    rows = [(0, [1.5e308, 0.0]), (1, [-1.5e308, 0.0]), (2, [1.5e308, 1.0])]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 1.0), (1, math.inf)]


# 4


def grams_by_hand(text):
    """Counts of hashed 2- and 3-grams of bytes, letters lower-cased, all else a space; grams that begin and end with a space do not count."""
    raw = bytearray(langid._LETTER[b] for b in text.encode())
    for i in range(1, len(raw)):
        if raw[i - 1] == 0xC3 and 0x80 <= raw[i] <= 0x9E:
            raw[i] += 0x20
    out = {}
    for tables in (langid._TABLES[:2], langid._TABLES[2:]):
        k = len(tables)
        for i in range(len(raw) - k + 1):
            if raw[i] != 0x20 or raw[i + k - 1] != 0x20:
                code = sum(int(t[raw[i + j]]) for j, t in enumerate(tables)) & 0xFFFFFFFF
                slot = code >> (32 - langid.BITS)
                out[slot] = out.get(slot, 0) + 1
    return out


def test_languages_by_hand(spark):
    rng = random.Random(11)
    syllables = {"en": "the ing tion er and th".split(), "fr": "eau ou elle que É ment".split()}
    text = lambda x, n: " ".join("".join(rng.choice(syllables[x]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(x, rng.randint(3, 80)), x) for i in range(120) for x in [rng.choice(list(syllables))]]
    rows += [(200, None, "en"), (201, "", "fr"), (202, "12 ###", None), (203, "ZÀ", None), (5, rows[5][1], "en"), (204, "qq zz " * 200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(docs, F.lit(True))
    learned = [grams_by_hand(t) for _, t, x in rows if t is not None and x is not None]
    df = np.zeros(langid.SIZE)
    for g in learned:
        df[list(g)] += 1
    idf = np.log((1 + len(learned)) / (1 + df)) + 0.1
    assert np.allclose(model.idf, idf, atol=1e-5)
    for r in langid.predict(docs, model, ("doc_id", "text")).collect():
        t = r["text"]
        if not t or not any(map(str.isalpha, t)):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0, True)
            continue
        g = grams_by_hand(t)
        x = {s: math.log1p(c) * idf[s] for s, c in g.items()}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1
        cosine = [sum(v * float(c[s]) for s, v in x.items()) / norm for c in model.matrix]
        best = int(np.argmax(cosine))
        assert r["score"] == pytest.approx(min(max(cosine[best], 0), 1), abs=1e-4)
        close = [model.languages[i] for i, c in enumerate(cosine) if c > cosine[best] - 1e-4]
        assert r["lang_pred"] in close
        size = langid.length_class(np.array([sum(g.values())]))[0]
        if abs(cosine[best] - model.floor[best, max(size, 0)]) > 1e-3 and len(set(close)) == 1:
            assert r["rejected"] == (size >= 0 and cosine[best] < model.floor[best, size])


# 9


def features_by_hand(text):
    raw = (text or "").encode()
    words, lines = [w.encode() for w in WORD.findall(text or "")], [x for x in raw.split(b"\n") if x]
    n, size = len(words), max(len(raw), 1)
    count = lambda test: sum(map(test, raw))
    upper = count(lambda b: 65 <= b <= 90) + sum(a == 0xC3 and 0x80 <= b <= 0x9E for a, b in zip(raw, raw[1:]))
    lower, high, digit = count(lambda b: 97 <= b <= 122), count(lambda b: b >= 0xC0), count(lambda b: 48 <= b <= 57)
    plain = count(lambda b: b in b".,;:'\"()-?")
    symbol = count(lambda b: 0x21 <= b <= 0x7E and not chr(b).isalnum() and b not in b".,;:'\"()-?")
    lengths = [len(w) for w in words]
    mean = sum(lengths) / max(n, 1)
    letters = lambda w: any(65 <= b <= 90 or 97 <= b <= 122 or b >= 0x80 for b in w)
    return [
        math.log1p(n), upper / max(upper + lower + high, 1), digit / size, plain / size, symbol / size, min(symbol / max(n, 1), 3),
        sum(a == b for a, b in zip(words, words[1:])) / max(n - 1, 1) if n > 1 else 0, len(set(words)) / n if n else 1, len(set(words)) / n**0.85 if n else 1, mean,
        math.sqrt(max(sum(x * x for x in lengths) / max(n, 1) - mean * mean, 0)), sum(not letters(w) for w in words) / max(n, 1), len(set(lines)) / len(lines) if lines else 1, math.log1p(n / max(len(lines), 1)),
    ]


def test_quality_by_hand(spark, docs, corpus):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(20, 120))) if i % 2 else "buy now!!! " * rng.randint(3, 30) + str(rng.randrange(10**9)), i % 2) for i in range(200)]
    learn = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = quality.fit(learn, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"), F.lit(True))
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["score"], r["predicted"]) for r in quality.score(docs, model, ("doc_id", "text")).collect()))
    want = []
    for r in corpus:
        x = np.array(features_by_hand(r[1]))
        z = np.clip((x - model.centre) / model.spread, -5, 5)
        raw = float(np.concatenate((z, z * z)) @ model.weights)
        score = 1 / (1 + math.exp(-min(max(model.slope * (raw - model.threshold) + math.log(quality.THRESHOLD / (1 - quality.THRESHOLD)), -500), 500)))
        want.append((r[0] is None, r[0] or 0, r[1] or "", score))
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=1e-9) and g[4] == (g[3] >= quality.THRESHOLD)


# the pipeline


def test_run_against_stages_by_hand(spark, tmp_path):
    """All five stages over small tables: the language decision is the operator's, which test_languages_by_hand holds; the others are plain loops."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    import public_tokenizers

    from .test_near_dedup import survivors
    from .test_repeats import brute, word_list

    rng = random.Random(21)
    vocabulary = [f"{a}{b}" for a in ("the", "ing", "tion", "er", "and") for b in ("a", "e", "o", "th", "s", "ly", "un")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, items = text(60), [text(14), text(30)]
    rows = [(i, text(rng.randint(40, 120))) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " " + text(3)) for i in range(6)] + [(200 + i, f"{text(50)} {passage} {text(30)}") for i in range(4)] + [(300, f"{text(40)} {items[0]} {text(20)}"), (301, items[1]), (302, f"{items[1]}. {text(5)}"), (400, None), (401, ""), (402, "1 2 3")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    known = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, str(tmp_path)).select("doc_id").collect()}
    now = [(i, t) for i, t in rows if i in known]
    assert {400, 401, 402}.isdisjoint(known)
    stay = set(survivors(now))
    now = [(i, t) for i, t in now if i in stay]
    cut = []
    for (i, _), (words, covered) in zip(now, brute(now, 50, word_list), strict=True):
        cut.append((i, " ".join(w for w, c in zip(words, covered, strict=True) if not c)))
    clean, norm = [], lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    windows = {tuple(w[k : k + min(10, len(w))]) for w in map(norm, items) for k in range(max(1, len(w) - 9))}
    for i, t in cut:
        w = norm(t)
        hit = [False] * len(w)
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = [True] * n
        if not w or sum(hit) <= 0.5 * len(w):
            clean.append((i, [x for x, h in zip(w, hit, strict=True) if not h]))
    out = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {i for i, _ in clean} and 301 not in out and out[300]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, words in clean:
        assert "".join(norm(library.decode(out[i], skip_special_tokens=False).replace("</w>", ""))) == "".join(words)
