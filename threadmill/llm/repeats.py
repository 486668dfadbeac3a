"""Passages that start in a document with a smaller id: what operators 3 and 5 share.

A window is ``width`` symbols of one document. Among the hashes of the k-grams
inside a window the least one is its anchor; equal windows have the same
anchor at the same place, and the windows around one anchor form a segment.
Round 1 asks which anchors occur in two documents; all other windows are
unique. Round 2 sends the segments of those anchors to the shard of their
anchor, where the operator's own index (suffix sort or suffix tree) compares
the texts. Segments of an anchor that is very frequent are first split into
their single windows, dealt by the hash of the whole window, so that a
passage which a third of all documents hold is spread over all shards.
Of the segments that hold the same symbols within a batch, symbol by symbol,
only one is sent.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SYMBOL, U64, buffers, gram_hashes, ids_of, mixed, numbered_words, prefix_hashes, ranges, safe_hashes, slices, span_hash, words
from .rounds import Rounds, filled, gathered, pack, shard_cuts

SLICE = 1 << 19  # bytes whose hash arrays are held at once
COMPARED = 1 << 22  # symbols that are compared at once


@dataclass(frozen=True)
class Scheme:
    """width: symbols of a window; gram: symbols of an anchor; of_words: symbols are words and not bytes; hot: occurrences beyond which an anchor's segments are split."""

    width: int
    gram: int
    of_words: bool
    hot: int = 4096


def anchors(symbols: np.ndarray, offsets: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each anchor's place, the first and last window start that have it, and its hash."""
    width, span = scheme.width, scheme.width - scheme.gram + 1
    grams = gram_hashes(symbols, scheme.gram)
    n = len(symbols) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    half = U64(0xFFFFFFFF)
    least = (grams & ~half) | np.arange(len(grams), dtype=U64)  # ties go to the first place
    size = 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    valid = np.ones(n, bool)
    cross = (offsets[1:-1, None] - np.arange(1, width)[None]).ravel()
    valid[cross[(cross >= 0) & (cross < n)]] = False
    starts = np.flatnonzero(valid)
    place = (least[starts] & half).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(starts) - 1])) if len(first) else first
    place = place[first]
    # least hashes crowd the low end of the range; mixed once more they spread over all shards
    return place, starts[first], starts[last], mixed(grams[place] + U64(1))


class Batch:
    """The documents of a batch as symbols, their anchors and segments; the same each time it is made from the same rows."""

    def __init__(self, table: pa.Table, scheme: Scheme):
        self.scheme = scheme
        ids = ids_of(table.column("doc_id"))
        data, offsets = buffers(table.column("text"))
        self.ids, self.data, self.offsets = ids, data, offsets
        self.parts: list[int] = []  # first symbol of each slice
        place, low, high, hashes, firsts = [], [], [], [], [np.zeros(1, np.int64)]
        if scheme.of_words:
            found = [words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, SLICE)]
            shifts = [offsets[a] for a, _ in slices(offsets, SLICE)]
            self.starts, self.ends = (np.concatenate([np.zeros(0, np.int64), *(x[i] + shift for x, shift in zip(found, shifts, strict=True))]) for i in (0, 1))
            self.number, distinct = numbered_words(data, self.starts, self.ends)
            self.hash_of = safe_hashes(data, self.starts, self.ends, distinct, self.number)
        done = 0
        for k, (a, b) in enumerate(slices(offsets, SLICE)):
            first = found[k][2] if scheme.of_words else offsets[a : b + 1] - offsets[a]
            p, l, h, g = anchors(self.symbols(done, done + int(first[-1])), first, scheme)
            self.parts.append(done)
            place.append(p + done)
            low.append(l + done)
            high.append(h + done)
            hashes.append(g)
            firsts.append(first[1:] + done)
            done += int(first[-1])
        join = lambda x, kind=np.int64: np.concatenate(x) if x else np.zeros(0, kind)
        self.place, self.low, self.high, self.hash = join(place), join(low), join(high), join(hashes, U64)
        self.first = np.concatenate(firsts)  # of each document's first symbol
        self.unique, self.own, self.count = np.unique(self.hash, return_inverse=True, return_counts=True)

    def symbols(self, low: int, high: int) -> np.ndarray:
        return self.hash_of[self.number[low:high]] if self.scheme.of_words else SYMBOL[self.data[low:high]]

    def doc_of(self, symbol: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, symbol, "right") - 1

    def two_docs(self) -> np.ndarray:
        """Of each unique anchor hash: whether it stands in two documents of this batch."""
        ids = self.ids[self.doc_of(self.place)]
        least = np.full(len(self.unique), np.iinfo(np.int64).max)
        most = np.full(len(self.unique), np.iinfo(np.int64).min)
        np.minimum.at(least, self.own, ids)
        np.maximum.at(most, self.own, ids)
        return least != most

    def segments(self, shared: np.ndarray, hot: np.ndarray) -> None:
        """Makes the segments of shared anchors and, of those equal in this batch, the one with the least document id."""
        width = self.scheme.width
        plain = np.flatnonzero(shared[self.own] & ~hot[self.own])
        split = np.flatnonzero(shared[self.own] & hot[self.own])
        sizes = self.high[split] - self.low[split] + 1
        single = ranges(self.low[split], sizes)
        self.start = np.concatenate((self.low[plain], single))
        self.windows = np.concatenate((self.high[plain] - self.low[plain] + 1, np.ones(len(single), np.int64)))
        self.lead = np.concatenate((self.place[plain] - self.low[plain], np.zeros(len(single), np.int64)))
        key = np.concatenate((self.hash[plain], np.zeros(len(single), U64)))
        content = np.zeros(len(self.start), U64)
        for done, following in zip(self.parts, [*self.parts[1:], int(self.first[-1])], strict=True):
            at = np.flatnonzero((self.start >= done) & (self.start < following))
            if not len(at):
                continue
            symbols = self.symbols(done, following)
            low = self.start[at] - done
            content[at] = span_hash(prefix_hashes(symbols), low, low + self.windows[at] + width - 1)
        is_single = np.arange(len(key)) >= len(plain)
        key[is_single] = mixed(content[is_single])
        content = mixed(content + self.windows.astype(U64) + (self.lead.astype(U64) << U64(16)))
        self.doc = self.ids[self.doc_of(self.start)]
        order = np.lexsort((self.doc, content, key))
        new = np.ones(len(order), bool)
        k, c = key[order], content[order]
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        rep = order[new]  # sorted by key
        rep_of = np.empty(len(order), np.int64)
        rep_of[order] = np.cumsum(new) - 1
        odd = self.unlike(rep[rep_of])
        if len(odd):  # equal hashes of different texts: each stands for itself
            rep_of[odd] = len(rep) + np.arange(len(odd))
            rep = np.concatenate((rep, odd))
            order = np.argsort(key[rep], kind="stable")
            place = np.empty(len(rep), np.int64)
            place[order] = np.arange(len(rep))
            rep, rep_of = rep[order], place[rep_of]
        self.rep, self.rep_of, self.key = rep, rep_of, key

    def unlike(self, other: np.ndarray) -> np.ndarray:
        """The segments that do not hold the same symbols as these others, compared themselves."""
        size = self.windows + self.scheme.width - 1
        same = (self.windows == self.windows[other]) & (self.lead == self.lead[other])
        todo = np.flatnonzero(same & (other != np.arange(len(other))))
        symbols = self.number if self.scheme.of_words else self.data
        for a, b in slices(np.concatenate(([0], np.cumsum(size[todo]))), COMPARED):
            one = todo[a:b]
            differ = symbols[ranges(self.start[one], size[one])] != symbols[ranges(self.start[other[one]], size[one])]
            heads = np.cumsum(size[one]) - size[one]
            same[one[np.add.reduceat(differ, heads, dtype=np.int64) > 0]] = False
        return np.flatnonzero(~same)

    def texts(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of these segments and their lengths; of words, all that stands between the first and the last."""
        low, high = self.start[which], self.start[which] + self.windows[which] + self.scheme.width - 1
        if self.scheme.of_words and len(which):
            low, high = self.starts[low], self.ends[high - 1]
        return self.data[ranges(low, high - low)], high - low


@dataclass
class Segments:
    """Segments that a shard compares: windows around the anchors of a range of keys."""

    key: np.ndarray
    windows: np.ndarray
    lead: np.ndarray
    doc: np.ndarray
    size: np.ndarray  # bytes
    data: np.ndarray

    def part(self, which: np.ndarray, begin: np.ndarray) -> Segments:
        return Segments(self.key[which], self.windows[which], self.lead[which], self.doc[which], self.size[which], self.data[ranges(begin[which], self.size[which])])


#: Gives for each segment a bit mask of its windows (bit j: the j-th) that also occur in a segment of the same key with a smaller doc.
Resolver = Callable[[Segments, int], np.ndarray]


def repeated(docs: DataFrame, scheme: Scheme, resolve: Resolver, finish: Callable[[pa.Table, Batch, np.ndarray], pa.Table], schema, batch_bytes: int = 2 << 20, chunk: int = 1 << 20) -> DataFrame:
    """finish(rows, batch, covered) for each batch, where covered marks the symbols of repeated windows.

    A null doc_id counts as larger than any other; equal ids are one document
    for the comparison. ``chunk`` bounds the bytes a shard compares at once
    (the segments of one anchor, of which there are no more than
    ``scheme.hot``, stay together).
    """
    rounds = Rounds(docs, batch_bytes)
    shards = rounds.shards

    def ask_anchors(table, _):
        b = Batch(table, scheme)
        two, count = b.two_docs(), np.minimum(b.count, 65535).astype(np.uint16)
        for s, part in filled(shard_cuts(b.unique, shards)):
            yield s, pack(hash=b.unique[part], two=np.packbits(two[part]), count=count[part])

    def answer_anchors(got):
        sizes = [len(x["hash"]) for _, x in got]
        hashes = np.concatenate([x["hash"] for _, x in got])
        two = np.concatenate([np.unpackbits(x["two"], count=n) for (_, x), n in zip(got, sizes, strict=True)])
        count = np.concatenate([x["count"] for _, x in got]).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        n = int(new.sum())
        shared = (np.bincount(group, minlength=n) > 1) | (np.bincount(group, two, minlength=n) > 0)
        hot = shared & (np.bincount(group, count, minlength=n) > scheme.hot)
        out, at = [], 0
        for n in sizes:
            own = group[at : at + n]
            out.append(pack(shared=np.packbits(shared[own]), hot=np.packbits(hot[own])))
            at += n
        return out

    def with_segments(table, came):
        b = Batch(table, scheme)
        cuts = shard_cuts(b.unique, shards)
        b.segments(*(gathered(came.get(1, []), cuts, name, bool) for name in ("shared", "hot")))
        return b

    def ask_segments(table, came):
        b = with_segments(table, came)
        for s, part in filled(shard_cuts(b.key[b.rep], shards)):
            which = b.rep[part]
            data, size = b.texts(which)
            yield s, pack(key=b.key[which], windows=b.windows[which].astype(np.uint8), lead=b.lead[which].astype(np.uint8), doc=b.doc[which], size=size.astype(np.uint32), data=data)

    def answer_segments(got):
        whole = Segments(*(np.concatenate([x[c] for _, x in got]).astype(kind) for c, kind in (("key", U64), ("windows", np.int64), ("lead", np.int64), ("doc", np.int64), ("size", np.int64), ("data", np.uint8))))
        begin = np.cumsum(whole.size) - whole.size
        order = np.argsort(whole.key, kind="stable")
        keys = whole.key[order]
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        weight = np.concatenate(([0], np.cumsum(whole.size[order])))
        mask = np.zeros(len(order), U64)
        edges = np.concatenate((heads, [len(order)]))
        at = 0
        while at < len(edges) - 1:
            upto = max(at + 1, int(np.searchsorted(weight[edges], weight[edges[at]] + chunk, "right")) - 1)
            which = order[edges[at] : edges[upto]]
            mask[which] = resolve(whole.part(which, begin), scheme.width)
            at = upto
        out, at = [], 0
        for _, x in got:
            own = mask[at : at + len(x["key"])]
            at += len(own)
            out.append(pack(some=np.packbits(own != 0), mask=own[own != 0]))
        return out

    def end(table, came):
        b = with_segments(table, came)
        cuts = shard_cuts(b.key[b.rep], shards)
        mask = np.zeros(len(b.rep), U64)
        for s, x in came.get(2, []):
            low, high = int(cuts[s]), int(cuts[s + 1])
            mask[low:high][np.unpackbits(x["some"], count=high - low).astype(bool)] = x["mask"]
        every = (U64(1) << b.windows.astype(U64)) - U64(1)
        own = np.where(b.doc > b.doc[b.rep][b.rep_of], every, mask[b.rep_of])
        change = np.zeros(int(b.first[-1]) + 1, np.int32)
        full = own == every
        np.add.at(change, b.start[full], 1)
        np.add.at(change, (b.start + b.windows + scheme.width - 1)[full], -1)
        left = np.flatnonzero(~full & (own != 0))
        for j in range(int(b.windows[left].max()) if len(left) else 0):
            at = b.start[left[(own[left] >> U64(j)) & U64(1) == 1]] + j
            np.add.at(change, at, 1)
            np.add.at(change, at + scheme.width, -1)
        return finish(table, b, np.cumsum(change[:-1]) > 0)

    first = rounds.answer(1, rounds.ask(ask_anchors), answer_anchors)
    second = rounds.answer(2, rounds.ask(ask_segments, first), answer_segments)
    return rounds.finish(end, schema, first, second)


def runs_by_doc(covered: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of covered symbols within a document: document, start, end."""
    n = len(covered)
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    before = np.concatenate(([False], covered[:-1])) & ~edge[:n] if n else covered
    start = np.flatnonzero(covered & ~before)
    after = np.concatenate((covered[1:], [False])) & ~edge[1:] if n else covered
    end = np.flatnonzero(covered & ~after) + 1
    return np.searchsorted(first, start, "right") - 1, start, end
