"""Operator 10, language-model scores by an interpolated modified Kneser-Ney n-gram model.

The n-grams are counted on the executors. For each order, from the highest
down, every batch of documents sends its distinct n-grams as sorted hash
arrays to shards by the hash of their context, so that all continuations of a
context meet in one shard. A shard merges them into its part of the model, one
sorted array of hashes with their counts, and looks every batch's n-grams up
there: counts, and the statistics of their contexts. Each n-gram is owned by
one batch, which counts it as one that stands before its last words; these
counts are those of the next lower order. Words themselves are compared, not
hashed. The model is never gathered in one place.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from .common import LONG, LOWER, U64, buffers, free_name, mixed, numbered_words, schema_with, slices, word_hashes, words, xxh64_of
from .rounds import Rounds, filled, gathered, pack, shard_cuts

END, START = U64(0x9B97F4A7C1500001), U64(0x2545F4914F6CDD1D)  # hashes of the two marks
SLICE = 1 << 20
CONTEXT = ("over", "one", "two", "more")  # how many n-grams of a context are counted once, twice and more often, and the sum of what these are counted over three


def narrow(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


class Grams:
    """Distinct n-grams in order of their hashes, the context's bits before those of the last word."""

    def __init__(self, key: np.ndarray, context: int):
        self.order = np.argsort(key)
        ordered = key[self.order]
        self.new = np.ones(len(key), bool)
        self.new[1:] = ordered[1:] != ordered[:-1]
        self.key = ordered[self.new]
        self.example = np.minimum.reduceat(self.order, np.flatnonzero(self.new)) if len(key) else self.order  # the first of each
        self.context = context

    @cached_property
    def of(self) -> np.ndarray:
        """Of each n-gram that was given its place among the distinct ones."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.new) - 1
        return out

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """The sum of the weights of those that were given, for each distinct one."""
        return np.add.reduceat(weight[self.order].astype(np.int64), np.flatnonzero(self.new)) if len(self.key) else np.zeros(0, np.int64)

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct contexts, in order, and each n-gram's."""
        return np.unique(cut_to(self.key, self.context), return_inverse=True)


def cut_to(key: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of each key; keys are dealt by those of the context, so that none is split."""
    return key >> U64(64 - bits) << U64(64 - bits)


def pack_grams(key: np.ndarray, context: int, **more: np.ndarray) -> bytes:
    """Distinct n-grams in order of their hashes, each context once, as the steps from one context, and from one last word of a context, to the next."""
    last = key & U64((1 << 64 - context) - 1)
    head = key >> U64(64 - context)
    fresh = np.ones(len(key), bool)
    fresh[1:] = head[1:] != head[:-1]
    step = last.copy()
    step[1:] -= np.where(fresh[1:], U64(0), last[:-1])
    return pack(head=narrow(np.diff(head[fresh], prepend=U64(0))), fresh=np.packbits(fresh), step=narrow(step), **more)


def unpacked_grams(letter: dict[str, np.ndarray], context: int) -> np.ndarray:
    """The n-grams of ``pack_grams``."""
    fresh = np.unpackbits(letter["fresh"], count=len(letter["step"])).astype(bool)
    run = np.cumsum(fresh) - 1
    last = np.cumsum(letter["step"], dtype=U64)
    begin = np.flatnonzero(fresh)
    before = last[begin] - letter["step"][begin].astype(U64)
    return np.cumsum(letter["head"], dtype=U64)[run] << U64(64 - context) | (last - before[run])


def layout(k: int, size: int) -> tuple[int, int]:
    """Bits of the context and of the last word in the 64-bit hash of an n-gram of k tokens, for an input of so many bytes: a larger input has more contexts to tell apart."""
    context = min(max(size, 1).bit_length() + 6, 42) if k == 2 else min(max(size, 1).bit_length() + 10, 46)
    context = max(context, 36 if k == 2 else 40)
    return context, 64 - context


def distinct_hashes(distinct: pa.Array) -> np.ndarray:
    """``safe_hashes`` of distinct words, from their own bytes alone."""
    data, offsets = buffers(distinct)
    out = word_hashes(data, offsets[:-1], offsets[1:])
    long = np.flatnonzero(np.diff(offsets) > LONG)
    out[long] = xxh64_of(distinct.take(pa.array(long)))
    return out


class Tokens:
    """A batch's texts as tokens, each text's words (told apart by their bytes) and then one end."""

    def __init__(self, table: pa.Table, train: str, bits: dict[int, tuple[int, int]]):
        self.bits = bits
        data, offsets = buffers(table.column("text"))
        self.learn = np.asarray(pc.fill_null(table.column(train), False).combine_chunks().to_numpy(zero_copy_only=False), bool)
        data = LOWER[data]
        found = [(a, words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in slices(offsets, SLICE)]
        starts, ends = (np.concatenate([x[i] + offsets[a] for a, x in found]) for i in (0, 1))
        number, self.distinct = numbered_words(data, starts, ends)
        n = np.concatenate([np.diff(x[2]) for _, x in found]) + 1
        self.first = np.concatenate(([0], np.cumsum(n)))
        end = len(self.distinct)
        self.word = np.full(int(self.first[-1]), end, np.int32)
        inner = np.ones(len(self.word), bool)
        inner[self.first[1:] - 1] = False
        self.word[inner] = number
        self.hash = np.concatenate((distinct_hashes(self.distinct), [END, START]))
        self.learned = np.repeat(self.learn, n)
        self.place = np.arange(len(self.word)) - np.repeat(self.first[:-1], n)

    def grams(self, k: int) -> Grams:
        """The n-grams of k tokens that end in each token; before a text stand start marks."""
        context = np.full(len(self.word), U64(k))
        for back in range(1, k):
            before = np.full(len(self.word), len(self.hash) - 1, np.int32)
            if back < len(self.word):
                before[back:] = self.word[:-back]
            before[self.place < back] = len(self.hash) - 1
            context = mixed(context * U64(0xD1342543DE82EF95) + self.hash[before])
        last = mixed(self.hash[self.word] + U64(1))
        bits, of_word = self.bits[k]
        return Grams(cut_to(context, bits) | (last >> U64(64 - of_word) << U64(64 - bits - of_word)), bits)

    def vocabulary(self) -> tuple[np.ndarray, np.ndarray]:
        """The order of the distinct words and the end by hash, and these hashes; of equal ones the least word first."""
        order = np.argsort(self.hash[:-1])
        hashes = self.hash[:-1][order]
        if (hashes[1:] == hashes[:-1]).any():
            names = np.array([*self.distinct.to_pylist(), b""], object)
            order = np.lexsort((np.argsort(np.argsort(names)), self.hash[:-1]))
        return order, hashes


def discounts(n: np.ndarray) -> np.ndarray:
    """The discounts for counts 0, 1, 2 and 3 or more, from how many things were counted 1, 2, 3 and 4 times; half a count where there are too few."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    if not n1 or not n2:
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return np.array([0, *(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))])


def how_often(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3, 4, and above 0."""
    return np.concatenate((np.bincount(np.minimum(counts, 5), minlength=6)[1:5], [np.count_nonzero(counts)])).astype(np.int64)


def token_scores(levels: list[tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]], before: np.ndarray, of_words: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
    """Probability of each token, from the words up.

    ``before``: how many n-grams' first words stand before the token's word;
    ``levels``: for each higher order the n-gram's count, its context's
    statistics, and how often counts are 1 to 4.
    """
    d = discounts(of_words)
    p = np.full(len(before), 1 / (vocabulary + 1))
    if total:
        n1, n2, seen = float(of_words[0]), float(of_words[1]), float(of_words[4])
        rest = (d[1] * n1 + d[2] * n2 + d[3] * (seen - n1 - n2)) / total
        p = np.maximum(before - d[np.minimum(before, 3)], 0) / total + rest * p
    for count, context, often in levels:
        d = discounts(often)
        mass = context["total"].astype(float)
        known = mass > 0
        mass[~known] = 1
        rest = (d[1] * context["one"] + d[2] * context["two"] + d[3] * context["more"]) / mass
        p = np.where(known, np.maximum(count - d[np.minimum(count, 3)], 0) / mass + rest * p, p)
    return p


def _told(letter: dict[str, np.ndarray], name: str, n: int) -> np.ndarray:
    """Totals over the shards; zeros if no shard had anything to report."""
    return letter[name] if len(letter[name]) else np.zeros(n, np.int64)


def score(docs: DataFrame, train: Column, keep: tuple[str, ...] = ("doc_id",), order: int = 3, batch_bytes: int = 6 << 20) -> DataFrame:
    """The ``keep`` columns with n_tokens, n_known, train_tokens, base_score and score (log10).

    Tokens are the words (ASCII white space between them, A-Z lower-cased) and
    one end. The model of ``order`` tokens learns from the rows where ``train``
    holds (null: not) and scores all rows; before each text stand order - 1
    start marks. base_score is the sum over an add-one unigram model of the
    same tokens. Word counts go by the words themselves, those of longer
    n-grams by 64-bit hashes (``layout``). A null text counts as empty and has the end only.
    With no training row every token has the probability of one unknown word.
    Repeated rows are learned and scored as often as they stand; an empty
    table gives no rows.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    mark = free_name("train", docs.columns)
    rounds = Rounds(docs.select(*dict.fromkeys([*keep, "doc_id", "text"]), train.alias(mark)), batch_bytes)
    shards = rounds.shards
    schema = schema_with(docs, keep, "n_tokens long, n_known long, train_tokens long, base_score double, score double")
    bits = {k: layout(k, rounds.bytes) for k in range(2, order + 1)}
    number = {k: order + 1 - k for k in range(1, order + 1)}  # of each order's round

    def standing_before(t: Tokens, k: int, came: dict) -> tuple[Grams, np.ndarray]:
        """The n-grams of order k + 1, and of each whether this batch counts it for the next lower order."""
        longer = t.grams(k + 1)
        return longer, np.flatnonzero(gathered(came.get(number[k + 1], []), shard_cuts(cut_to(longer.key, longer.context), shards), "mine", bool))

    def asker(k: int):
        def ask(table, came):
            t = Tokens(table, mark, bits)
            own = t.grams(k)
            if k == order:
                count = own.counts(t.learned)
            else:
                longer, mine = standing_before(t, k, came)
                counted = np.zeros(len(t.word), bool)
                counted[longer.example[mine]] = True
                count = own.counts(counted)
            for s, part in filled(shard_cuts(cut_to(own.key, own.context), shards)):
                yield s, pack_grams(own.key[part], own.context, count=narrow(count[part]))

        return ask

    def answerer(k: int):
        return lambda got: answer_grams(got, bits[k][0])

    def answer_grams(got, context_bits):
        keys = [unpacked_grams(x, context_bits) for _, x in got]
        model = Grams(np.concatenate(keys), context_bits)
        total = model.counts(np.concatenate([x["count"] for _, x in got]))
        contexts, context = model.contexts()
        stats = [np.bincount(context, w, minlength=len(contexts)).astype(np.int64) for w in (np.maximum(total - 3, 0), total == 1, total == 2, total > 2)]
        owned = np.zeros(len(total), bool)
        out, at = [], 0
        for key in keys:
            own = model.of[at : at + len(key)]
            at += len(own)
            mine = (total[own] > 0) & ~owned[own]
            owned[own] = True
            asked = np.searchsorted(contexts, np.unique(cut_to(key, context_bits)))
            out.append(pack(count=narrow(total[own]), mine=np.packbits(mine), **{c: narrow(v[asked]) for c, v in zip(CONTEXT, stats, strict=True)}))
        return [*out, pack(often=how_often(total))]

    def ask_words(table, came):
        t = Tokens(table, mark, bits)
        seen = np.bincount(t.word[t.learned], minlength=len(t.hash) - 1)
        longer, mine = standing_before(t, 1, came)
        before = np.bincount(t.word[longer.example[mine]], minlength=len(t.hash) - 1)
        place, hashes = t.vocabulary()
        named = pa.concat_arrays([t.distinct.cast(pa.large_binary()), pa.array([b""], pa.large_binary())])
        data, offsets = buffers(named.take(pa.array(place)))
        for s, part in filled(shard_cuts(hashes, shards)):
            name = data[offsets[part.start] : offsets[part.stop]]
            yield s, pack(name=name, size=narrow(np.diff(offsets[part.start : part.stop + 1])), seen=narrow(seen[place][part]), before=narrow(before[place][part]))

    def answer_words(got):
        size, seen, before = (np.concatenate([x[c] for _, x in got]).astype(np.int64) for c in ("size", "seen", "before"))
        name = np.concatenate([x["name"] for _, x in got])
        flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size)))), pa.py_buffer(name)])
        own = flat.dictionary_encode().indices.to_numpy()
        seen, before = (np.bincount(own, x).astype(np.int64) for x in (seen, before))
        ends = np.cumsum([len(x["size"]) for _, x in got])
        out = [pack(seen=narrow(seen[part]), before=narrow(before[part])) for part in np.split(own, ends[:-1])]
        return [*out, pack(whole=np.array([seen.sum(), np.count_nonzero(seen), before.sum()]), often=how_often(before))]

    def end(table, came):
        t = Tokens(table, mark, bits)
        place, hashes = t.vocabulary()
        cuts = shard_cuts(hashes, shards)
        seen, before = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        seen[place], before[place] = (gathered(came[number[1]], cuts, c) for c in ("seen", "before"))
        (_, letter), = came[-number[1]]
        n_train, vocabulary, total = (int(v) for v in _told(letter, "whole", 3))
        levels = []
        for k in range(2, order + 1):
            own = t.grams(k)
            cuts = shard_cuts(cut_to(own.key, own.context), shards)
            contexts, context = own.contexts()
            context_cuts = shard_cuts(contexts, shards)
            stats = {c: gathered(came[number[k]], context_cuts, c) for c in CONTEXT}
            stats["total"] = stats.pop("over") + stats["one"] + 2 * stats["two"] + 3 * stats["more"]
            stats = {c: x[context][own.of] for c, x in stats.items()}
            levels.append((gathered(came[number[k]], cuts, "count")[own.of], stats, _told(came[-number[k]][0][1], "often", 5)))
        p = token_scores(levels, before[t.word], _told(letter, "often", 5), total, vocabulary)
        c = seen[t.word]
        by_doc = lambda x: np.add.reduceat(x, t.first[:-1])
        base = by_doc(np.log10((c + 1) / (n_train + vocabulary + 1)))
        return pa.table(
            [*(table.column(x) for x in keep), pa.array(np.diff(t.first)), pa.array(by_doc((c > 0).astype(np.int64))), pa.array(np.full(table.num_rows, n_train)), pa.array(base), pa.array(by_doc(np.log10(p)))],
            names=[*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    post, last = [], []
    for k in range(order, 0, -1):
        asked = rounds.ask(asker(k) if k > 1 else ask_words, *last)
        answered = rounds.answer(number[k], asked, answerer(k) if k > 1 else answer_words)
        last = [answered]
        post += [answered, rounds.totals(number[k], answered, ("often",) if k > 1 else ("often", "whole"))]
    return rounds.finish(end, schema, *post)
