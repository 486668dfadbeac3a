"""Operators 3 and 5 against brute force over all windows."""

import hashlib
import re

import numpy as np
import pytest

from threadmill.llm import suffix_array, suffix_tree
from threadmill.llm.repeats import Scheme, repeated
from threadmill.llm.suffix_array import HashedText, remove_repeated_bytes
from threadmill.llm.suffix_tree import deep_nodes, remove_repeated_words

LAST = 1 << 62


def brute(rows, width, split):
    """For each (id, text): symbols and which are covered by a window that starts under a smaller id."""
    parts = [(LAST if r[0] is None else r[0], split(r[1])) for r in rows]
    least = {}
    for i, s in parts:
        for k in range(len(s) - width + 1):
            w = s[k : k + width]
            least[w] = min(least.get(w, LAST + 1), i)
    out = []
    for i, s in parts:
        covered = [False] * len(s)
        for k in range(len(s) - width + 1):
            if least[s[k : k + width]] < i:
                covered[k : k + width] = [True] * width
        out.append((s, covered))
    return out


def runs(covered):
    out = []
    for k, c in enumerate(covered):
        if c and (k == 0 or not covered[k - 1]):
            out.append([k, k])
        if c:
            out[-1][1] = k + 1
    return out


def key(x):
    return tuple((v is None, str(v)) for v in x)


def word_list(text):
    return tuple(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("batch_bytes", [1 << 12, 2 << 20])
def test_bytes_match_brute_force(docs, corpus, batch_bytes):
    got = [(r["doc_id"], r["n_bytes"], r["spans"], bytes(r["kept"])) for r in remove_repeated_bytes(docs, 50, batch_bytes=batch_bytes).collect()]
    want = []
    for r, (s, c) in zip(corpus, brute(corpus, 50, lambda t: (t or "").encode()), strict=True):
        want.append((r[0], len(s), runs(c), bytes(b for b, x in zip(s, c, strict=True) if not x)))
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("width,gram", [(13, 5), (50, 18)])
def test_words_match_brute_force(docs, corpus, width, gram):
    got = [(r["doc_id"], r["n_words"], r["spans"], r["kept"]) for r in remove_repeated_words(docs, width, gram, batch_bytes=1 << 14).collect()]
    want = []
    for r, (s, c) in zip(corpus, brute(corpus, width, word_list), strict=True):
        want.append((r[0], len(s), runs(c), " ".join(w for w, x in zip(s, c, strict=True) if not x)))
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("module,of_words,width,gram,split", [(suffix_array, False, 50, 18, lambda t: (t or "").encode()), (suffix_tree, True, 13, 5, word_list)])
def test_hot_anchors_are_split_and_give_the_same(docs, corpus, module, of_words, width, gram, split):
    import pyarrow as pa

    def finish(table, b, covered):
        return pa.table({"doc_id": table.column("doc_id"), "n": np.add.reduceat(np.concatenate((covered, [False])).astype(np.int64), b.first[:-1]) * (np.diff(b.first) > 0)})

    got = repeated(docs.select("doc_id", "text"), Scheme(width, gram, of_words, hot=2), module.resolve, finish, "doc_id long, n long", batch_bytes=1 << 14)
    want = [(r[0], sum(c)) for r, (_, c) in zip(corpus, brute(corpus, width, split), strict=True)]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_cut_keeps_untouched_texts_and_nulls(docs, corpus):
    got = remove_repeated_words(docs, 13, keep=("doc_id", "text"), cut=True).collect()
    for r in got:
        if not r["spans"]:
            assert r["kept"] == r["text"]
        else:
            left = [w for k, w in enumerate(word_list(r["text"])) if not any(a <= k < b for a, b in r["spans"])]
            assert list(word_list(r["kept"])) == left


def test_empty_table(empty):
    assert remove_repeated_bytes(empty).collect() == []
    assert remove_repeated_words(empty).collect() == []


def test_suffix_sort_and_extension():
    data = np.frombuffer(b"banana bandana ananas banana bandana" * 3, np.uint8)
    text = HashedText(np.concatenate((data, np.zeros(60, np.uint8))), 20)
    at = np.arange(len(data))
    raw = text.data.tobytes()
    order = text.sort(at, np.zeros(len(at), np.int64))
    assert [raw[i : i + 20] for i in order] == sorted(raw[i : i + 20] for i in at)
    for p, q in [(0, 36), (1, 3), (0, 7)]:
        n = int(text.extension(np.array([p]), np.array([q]))[0])
        assert raw[p : p + n] == raw[q : q + n] and (n == 20 or raw[p + n] != raw[q + n])


def test_tree_nodes_at_depth():
    symbols = np.array([1, 2, 3, 9, 1, 2, 3, 8, 1, 2, 4, 7])
    leaf, node = deep_nodes(symbols, np.array([0, 4, 8]), np.zeros(3, np.int64), 3)
    assert sorted(leaf.tolist()) == [0, 1] and len(set(node.tolist())) == 1


def test_digest_query_matches_sql_form(docs, corpus):
    rows = {(r["doc_id"], bytes(r["kept"])) for r in remove_repeated_bytes(docs, 50).collect()}
    assert all(len(hashlib.sha256(k).hexdigest()) == 64 for _, k in rows)


def thue_morse(a, b, n):
    """Two words of 2**n letters whose polynomial hashes modulo 2**64 are equal, whatever the base."""
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def test_words_of_one_polynomial_hash_are_told_apart(spark):
    """Pairs of texts that differ in one long word of an equal hash: nothing repeats, many of them in each batch."""
    one, other = thue_morse("a", "b", 11)
    rows = []
    for i in range(60):
        left, right = " ".join(f"l{i}x{k}" for k in range(5)), " ".join(f"r{i}x{k}" for k in range(5))
        rows += [(2 * i, f"{left} {one} {right}"), (2 * i + 1, f"{left} {other} {right}")]
    out = remove_repeated_words(spark.createDataFrame(rows, "doc_id long, text string"), 11, 4).collect()
    assert all(r["spans"] == [] and r["n_words"] == 11 for r in out) and len(out) == 120


def test_equal_hashes_of_different_windows_are_not_merged(docs, corpus, monkeypatch):
    """With a hash that is the same for all spans, only the symbols themselves tell the segments of a batch apart."""
    from threadmill.llm import repeats

    def check(table):
        for scheme in (Scheme(13, 5, True), Scheme(50, 18, False)):
            b = repeats.Batch(table, scheme)
            b.segments(np.ones(len(b.unique), bool), np.zeros(len(b.unique), bool))
            plain = len(b.rep)
            with monkeypatch.context() as m:
                m.setattr(repeats, "span_hash", lambda prefix, start, end: np.zeros(len(start), np.uint64))
                b.segments(np.ones(len(b.unique), bool), np.zeros(len(b.unique), bool))
            assert len(b.rep) >= plain
            for i in range(len(b.start)):
                r = b.rep[b.rep_of[i]]
                assert b.texts(np.array([i]))[0].tobytes().split() == b.texts(np.array([r]))[0].tobytes().split() and b.windows[i] == b.windows[r]

    check(docs.select("doc_id", "text").toArrow())


def test_suffixes_of_equal_hashes_are_sorted_by_their_bytes(monkeypatch):
    from threadmill.llm import suffix_array
    from threadmill.llm.repeats import Segments

    texts = [b"abcdefghij0123456789", b"abcdefghijKLMNOPQRST", b"abcdefghij0123456789"]
    one = np.ones(3, np.int64)
    s = Segments(np.zeros(3, np.uint64), one, 0 * one, np.array([5, 6, 7]), 20 * one, np.frombuffer(b"".join(texts), np.uint8))
    monkeypatch.setattr(suffix_array, "SYMBOL", np.ones(256, np.uint64))  # all strings of a length have one hash
    assert suffix_array.resolve(s, 20).tolist() == [0, 0, 1]


def test_letters_grow_with_the_input(spark):
    """Five times the input, at most about five times the letters, and none that is empty."""
    import random

    from threadmill.llm.rounds import Rounds, filled, pack, shard_cuts, unpack

    rng, sent = random.Random(1), []
    for n in (200, 1000, 5000):
        rows = [(i, " ".join(str(rng.randrange(10**6)) for _ in range(40))) for i in range(n)]
        rounds = Rounds(spark.createDataFrame(rows, "doc_id long, text string"), 1 << 11, least=4, reference=1 << 15)

        def ask(table, _, shards=rounds.shards):
            keys = np.unique(np.array([hash(t) for t in table.column("text").to_pylist()], np.int64).view(np.uint64))
            for s, part in filled(shard_cuts(keys, shards)):
                yield s, pack(key=keys[part])

        letters = rounds.ask(ask).collect()
        assert all(len(unpack(bytes(r["data"]))["key"]) for r in letters)
        sent.append(len(letters))
    assert sent[2] <= 7 * sent[1] and sent[1] <= 7 * sent[0]


def test_repeated_rows_are_dealt_over_all_batches(spark):
    from threadmill.llm.rounds import Rounds

    rounds = Rounds(spark.createDataFrame([(1, "a b c")] * 2000, "doc_id long, text string").repartition(2), least=24)
    got = rounds.parcels.groupBy("batch").count().collect()
    assert len(got) == rounds.batches == 24
