"""The near-duplicate stage against brute force on sets of five-word shingles."""

import random

import numpy as np

from threadmill.llm import simhash


def sets_of(text, k=5):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def survivors(rows, similarity=0.8):
    """doc_ids that stay: the least of each component of links, over all pairs."""
    sets, ids = [sets_of(t) for _, t in rows], [i for i, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both >= similarity * (len(sets[x]) + len(sets[y]) - both) - 1e-9:
                parent[root(x)] = root(y)
    least = {}
    for x, i in enumerate(ids):
        least[root(x)] = min(i, least.get(root(x), i))
    return sorted(least.values())


def kept(spark, rows):
    return sorted(r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())


def draw(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_template_groups_keep_every_link(spark):
    """Texts that share a template at 0.75, each with one twin at 0.9: all twins are found in a group of any size."""
    rng = random.Random(1)
    template, rows = draw(rng, 240), []
    for i in range(150):
        own = draw(rng, 36)
        twin = own[:-13] + draw(rng, 13)
        rows += [(i, " ".join(template + own)), (1000 + i, " ".join(template + twin))]
    want = survivors(rows)
    assert want == list(range(150)) and kept(spark, rows) == want


def test_crowded_keys_are_searched_whole(spark):
    """Without frequent shingles told, all texts of a template meet under its shingles."""
    rng = random.Random(4)
    template = draw(rng, 200)
    rows = [(i, " ".join(template + draw(rng, rng.randint(18, 34)))) for i in range(60)]
    rows += [(100 + i, " ".join([*rows[i][1].split()[:-4], *draw(rng, 4)])) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    groups = simhash.similar_groups(frame, sample=0)
    least = sorted(r["m"] for r in groups.groupBy("root").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "m").collect())
    assert least == survivors(rows)


def test_a_repeated_line_does_not_merge_texts(spark):
    """Two texts of other words around one line repeated 20 times have an equal fingerprint and stay both."""
    rng = random.Random(2)
    line = " ".join(draw(rng, 6))
    rows = [(i, " ".join([*draw(rng, 12), *[line] * 20, *draw(rng, 13)])) for i in range(6)]
    assert kept(spark, rows) == survivors(rows) == list(range(6))


def test_long_texts_are_compared_whole(spark):
    """Pairs of long texts at similarities around 0.8 go by their whole sets."""
    rng, rows = random.Random(3), []
    for i in range(60):
        base = draw(rng, 1200)
        cut = 1200 - (120 + i // 2)  # 0.79 to 0.83
        rows += [(i, " ".join(base)), (1000 + i, " ".join(base[:cut] + draw(rng, 1200 - cut)))]
    want = survivors(rows)
    assert 60 < len(want) < 120 and kept(spark, rows) == want


def test_repeats_do_not_hide_a_link(spark):
    """200 equal words with a line once and ten times: sets are alike to 0.9 though the counts are not."""
    rng = random.Random(5)
    body, line = draw(rng, 200), draw(rng, 8)
    rows = [(1, " ".join(body + line)), (2, " ".join(body + line * 10)), (3, " ".join(draw(rng, 200)))]
    assert kept(spark, rows) == survivors(rows) == [1, 3]


def test_pairs_meet_under_their_first_key_only():
    """Entries know the keys before them in their owner's order, so that a pair is left out wherever it shares an earlier one."""
    key, owner, place = np.array([7, 5, 9, 5, 9, 7], np.uint64), np.array([0, 0, 0, 1, 1, 1]), np.array([4, 0, 2, 1, 3, 8])
    one, two, three = (x.to_pylist() for x in simhash.keys_before(key, owner, place))
    assert one == [9, None, 5, None, 5, 9] and two == [5, None, None, None, None, 5] and three == [None] * 6
    assert [x.to_pylist() for x in simhash.keys_before(key[:0], owner[:0], place[:0])] == [[], [], []]
    assert simhash.keys_before(key[:1], owner[:1], place[:1])[2].to_pylist() == [None]
