import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, batch int, `kept` string, hit string, train boolean, fp string, ids string"


def sentence(rng, n, words=400):
    return " ".join(f"w{int(rng.paretovariate(0.8)) % words}{rng.choice('abcdefgh')}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, shared passages, ties, repeated rows, nulls, empty, blank and very long texts."""
    rng = random.Random(3)
    texts = [sentence(rng, rng.randint(1, 160)) for _ in range(60)]
    passage = sentence(rng, 70)
    for i in range(0, 60, 7):
        texts[i] += " " + passage + ("\n" if i % 2 else " ") + sentence(rng, 20)
    texts += [texts[3], texts[3], texts[5] + " more words here", "x" * 200 + " y", "é" * 60 + " ünïcödé ÀÉ ok", "é" * 60, "", None, " \t\n ", "The THE the", "a", "12 34 !!", "and so " * 300]
    texts.append(sentence(rng, 30_000))
    texts.append(texts[-1][:5000] + " tail")
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, rng.choice(["en", "fr", None]), f"s{i % 3}", len(t or ""), 0.5, 7, "k", "h", True, "f", "i") for i, t in zip(ids, texts, strict=True)]
    rows.append(rows[4])  # a repeated row
    rows.append((rows[9][0], texts[11], "en", "s", 1, 0.1, 1, "k", "h", False, "f", "i"))  # an id twice
    rows.append((None, texts[2], "en", None, None, None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
