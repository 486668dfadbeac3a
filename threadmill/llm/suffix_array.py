"""Operator 5, removal of repeated byte strings by a hash-compared suffix sort.

Suffixes are compared through the polynomial hashes of their prefixes: a
binary search finds their common extension in a logarithmic number of steps,
the next byte orders them, and a merge sort of such comparisons gives the
suffix array. Neighbours whose common extension reaches the window are equal;
their bytes are compared before they count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import INVERSE, SYMBOL, U64, mixed, powers, prefix_hashes, ranges, schema_with, span_hash
from .repeats import Scheme, Segments, repeated, runs_by_doc


class HashedText:
    """Suffixes of a text, each looked at up to ``width`` bytes."""

    def __init__(self, data: np.ndarray, width: int):
        self.data, self.width = data, width
        self.prefix = prefix_hashes(SYMBOL[data])
        self.inverse = powers(INVERSE, len(self.prefix))

    def extension(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at p and q, by binary search over prefix hashes."""
        prefix, inverse = self.prefix, self.inverse
        own, other = prefix[p], prefix[q]
        up, uq = inverse[p], inverse[q]
        shared = np.zeros(len(p), np.int64)
        step = 1 << (self.width.bit_length() - 1)
        while step:
            longer = np.minimum(shared + step, self.width)
            same = (prefix[p + longer] - own) * up == (prefix[q + longer] - other) * uq
            shared = np.where(same, longer, shared)
            step >>= 1
        return shared

    def less(self, p: np.ndarray, q: np.ndarray, or_equal: bool) -> np.ndarray:
        shared = self.extension(p, q)
        whole = shared == self.width
        shared = np.where(whole, 0, shared)
        return np.where(whole, or_equal, self.data[p + shared] < self.data[q + shared])

    def equal(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Byte by byte."""
        out = np.ones(len(p), bool)
        for j in range(self.width):
            out &= self.data[p + j] == self.data[q + j]
        return out

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes at ``at`` within each group (groups are sorted already): bottom-up merge sort of all groups at once.

        A suffix's place after a merge is its place in its own run plus the
        number of suffixes of the other run before it, found by binary search.
        """
        n = len(at)
        order = np.arange(n)
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
        size = np.diff(np.concatenate((head, [n])))
        run = 1
        while len(size) and run < size.max():
            which = np.flatnonzero(size > run)  # groups with a pair of runs
            slot = ranges(head[which], size[which])
            base, length = np.repeat(head[which], size[which]), np.repeat(size[which], size[which])
            inside = slot - base
            pair = inside // (2 * run) * (2 * run)
            left = inside - pair < run
            middle = np.minimum(pair + run, length)
            low = np.where(left, middle, pair)
            high = np.where(left, np.minimum(pair + 2 * run, length), middle)
            begin = low.copy()
            own = at[order[slot]]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                probe = (low[open_] + high[open_]) // 2
                other = at[order[base[open_] + probe]]
                before = np.where(left[open_], self.less(other, own[open_], False), self.less(other, own[open_], True))
                low[open_] = np.where(before, probe + 1, low[open_])
                high[open_] = np.where(before, high[open_], probe)
            rank = np.where(left, inside - pair, inside - middle) + (low - begin)
            merged = order.copy()
            merged[base + pair + rank] = order[slot]
            order = merged
            run *= 2
        return order


def resolve(s: Segments, width: int) -> np.ndarray:
    """Which windows of each segment also occur under the same key with a smaller doc."""
    text = HashedText(s.data, width)
    begin = np.cumsum(s.size) - s.size
    every = (U64(1) << s.windows.astype(U64)) - U64(1)
    out = np.zeros(len(s.key), U64)
    # equal segments are sorted once, for the one with the least doc
    whole = mixed(span_hash(text.prefix, begin, begin + s.size) + s.windows.astype(U64) + (s.lead.astype(U64) << U64(16)))
    order = np.lexsort((s.doc, whole, s.key))
    k, w = s.key[order], whole[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
    head = order[new]
    own_head = np.empty(len(order), np.int64)
    own_head[order] = head[np.cumsum(new) - 1]
    same = _equal_spans(s, begin, own_head)
    own_head = np.where(same, own_head, np.arange(len(order)))
    out[s.doc > s.doc[own_head]] = every[s.doc > s.doc[own_head]]
    # suffixes of the remaining segments, where a key has several
    alone = np.flatnonzero(own_head == np.arange(len(order)))
    alone = alone[np.argsort(s.key[alone], kind="stable")]
    _, at, many = np.unique(s.key[alone], return_inverse=True, return_counts=True)
    alone = alone[many[at] > 1]
    if not len(alone):
        return np.where(s.doc > s.doc[own_head], every, out[own_head])
    owner = np.repeat(alone, s.windows[alone])
    j = ranges(np.zeros(len(alone), np.int64), s.windows[alone])
    suffix = begin[owner] + j
    offset = s.lead[owner] - j  # the anchor's place in the window: equal windows have the same
    order = np.lexsort((offset, s.key[owner]))
    owner, j, suffix, offset = owner[order], j[order], suffix[order], offset[order]
    key = s.key[owner]
    group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]) | (offset[1:] != offset[:-1]))))
    array = text.sort(suffix, group)
    owner, j, suffix, group = owner[array], j[array], suffix[array], group[array]
    equal = (group[1:] == group[:-1]) & (text.extension(suffix[1:], suffix[:-1]) == width)
    if not text.equal(suffix[1:][equal], suffix[:-1][equal]).all():
        # different bytes of one hash have spoilt the order: sort by the bytes themselves
        array = np.lexsort((*(s.data[suffix + k] for k in range(width - 1, -1, -1)), group))
        owner, j, suffix, group = owner[array], j[array], suffix[array], group[array]
        equal = (group[1:] == group[:-1]) & text.equal(suffix[1:], suffix[:-1])
    block = np.concatenate(([0], np.cumsum(~equal)))
    starts = np.flatnonzero(np.concatenate(([True], ~equal)))
    least = np.minimum.reduceat(s.doc[owner], starts)
    hit = s.doc[owner] > least[block]
    np.bitwise_or.at(out, owner[hit], U64(1) << j[hit].astype(U64))
    return np.where(s.doc > s.doc[own_head], every, out[own_head])


def _equal_spans(s: Segments, begin: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Whether each segment's bytes are those of its head."""
    same = s.size == s.size[head]
    other = np.flatnonzero(same & (head != np.arange(len(head))))
    if len(other):
        differ = s.data[ranges(begin[other], s.size[other])] != s.data[ranges(begin[head[other]], s.size[other])]
        edges = np.cumsum(s.size[other]) - s.size[other]
        same[other[np.add.reduceat(differ, edges, dtype=np.int64) > 0]] = False
    return same


def remove_repeated_bytes(docs: DataFrame, width: int = 50, gram: int = 18, keep: tuple[str, ...] = ("doc_id",), batch_bytes: int = 2 << 20) -> DataFrame:
    """The ``keep`` columns with n_bytes, spans (removed byte ranges, maximal) and kept (the remaining bytes).

    Removed is each byte covered by a string of ``width`` bytes that also
    starts in a document with a smaller doc_id, judged on the input. Matches
    never cross documents. Null and empty texts give no bytes and no spans;
    texts shorter than ``width`` stay whole; a null doc_id counts as larger
    than any other, and rows of equal doc_id do not count against each other.
    """
    schema = schema_with(docs, keep, "n_bytes long, spans array<array<long>>, kept binary")

    def finish(table, b, covered):
        doc, start, end = runs_by_doc(covered, b.first)
        spans = [[] for _ in range(table.num_rows)]
        for d, x, y in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True):
            base = int(b.first[d])
            spans[d].append([x - base, y - base])
        left = b.data[~covered]
        size = np.concatenate(([0], np.cumsum(~covered)))[b.first]
        raw = left.tobytes()
        kept = [raw[x:y] for x, y in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
        return pa.table([*(table.column(c) for c in keep), pa.array(np.diff(b.offsets)), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], names=[*keep, "n_bytes", "spans", "kept"])

    return repeated(docs.select(*dict.fromkeys([*keep, "doc_id", "text"])), Scheme(width, gram, False), resolve, finish, schema, batch_bytes)
