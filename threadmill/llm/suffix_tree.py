"""Operator 3, removal of repeated word passages by prefix-partitioned suffix trees.

Suffixes are dealt to shards by a part of their first ``width`` words: the
word gram that anchors it, or, where a gram is very frequent, all of its first
words, so that every group fits in memory. A shard grows the tree of each
group top down: a node's suffixes are split by their next word, a suffix alone
in its node is a leaf and is dropped, and the internal nodes at depth
``width`` are the repeats. Words are compared themselves, not only hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, numbered_words, ranges, schema_with, words
from .repeats import Scheme, Segments, repeated, runs_by_doc


def deep_nodes(symbols: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes (indices into ``at``) below internal nodes at ``depth``, and their node.

    ``group`` holds the prefix groups, each the root of a subtree. Level by
    level, nodes whose suffixes all go on with the same word are only
    lengthened; the others are split.
    """
    alive = np.argsort(group, kind="stable")
    node = group[alive]
    for level in range(depth + 1):
        if not len(alive):
            break
        head = np.concatenate(([True], node[1:] != node[:-1]))
        size = np.diff(np.concatenate((np.flatnonzero(head), [len(node)])))
        inner = np.repeat(size > 1, size)
        alive, node = alive[inner], np.repeat(np.arange(len(size)), size)[inner]
        if level == depth or not len(alive):
            break
        head = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        size = np.diff(np.concatenate((head, [len(node)])))
        word = symbols[at[alive] + level]
        differs = np.add.reduceat(word != np.repeat(word[head], size), head, dtype=np.int64) > 0
        fork = np.repeat(differs, size)
        if fork.any():
            some = np.flatnonzero(fork)
            order = some[np.lexsort((word[some], node[some]))]
            alive[some], word[some] = alive[order], word[order]
            cut = np.concatenate(([True], (node[1:] != node[:-1]) | (fork[1:] & (word[1:] != word[:-1]))))
            node = np.cumsum(cut) - 1
    return alive, node


def resolve(s: Segments, width: int) -> np.ndarray:
    """Which windows of each segment also occur under the same key with a smaller doc."""
    offsets = np.concatenate(([0], np.cumsum(s.size)))
    starts, ends, first = words(s.data, offsets)
    symbols = numbered_words(s.data, starts, ends)[0]
    owner = np.repeat(np.arange(len(s.key)), s.windows)
    j = ranges(np.zeros(len(s.key), np.int64), s.windows)
    offset = s.lead[owner] - j  # the anchor's place in the window: equal windows have the same
    key = s.key[owner]
    order = np.lexsort((offset, key))
    owner, j, offset, key = owner[order], j[order], offset[order], key[order]
    group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (offset[1:] != offset[:-1])))) if len(key) else key.astype(np.int64)
    leaf, node = deep_nodes(symbols, first[:-1][owner] + j, group, width)
    out = np.zeros(len(s.key), U64)
    if len(leaf):
        head = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        size = np.diff(np.concatenate((head, [len(node)])))
        doc = s.doc[owner[leaf]]
        hit = leaf[doc > np.repeat(np.minimum.reduceat(doc, head), size)]
        np.bitwise_or.at(out, owner[hit], U64(1) << j[hit].astype(U64))
    return out


def remove_repeated_words(docs: DataFrame, width: int = 13, gram: int = 5, keep: tuple[str, ...] = ("doc_id",), cut: bool = False, batch_bytes: int = 2 << 20) -> DataFrame:
    """The ``keep`` columns with n_words, spans (removed word ranges, maximal) and kept.

    Removed is each word covered by a window of ``width`` words that also
    starts in a document with a smaller doc_id, judged on the input. Words are
    separated by ASCII white space and never changed. ``kept`` is the
    remaining words joined by one space or, with ``cut``, the text with the
    removed words and the white space after them cut out (null stays null).
    Null and empty texts have no words; texts of fewer than ``width`` words
    stay whole; a null doc_id counts as larger than any other, and rows of
    equal doc_id do not count against each other.
    """
    schema = schema_with(docs, keep, "n_words long, spans array<array<long>>, kept string")

    def finish(table, b, covered):
        doc, start, end = runs_by_doc(covered, b.first)
        n = table.num_rows
        spans, removed = [[] for _ in range(n)], [[] for _ in range(n)]
        for d, x, y in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True):
            base = int(b.first[d])
            spans[d].append([x - base, y - base])
            following = int(b.starts[y]) if y < b.first[d + 1] else int(b.offsets[d + 1])
            removed[d].append((int(b.starts[x]), following))
        raw = b.data.tobytes()
        texts = table.column("text").to_pylist() if cut else [None] * n
        for d in range(n):
            if cut and not removed[d]:
                continue
            parts, at = [], int(b.offsets[d])
            for x, y in removed[d]:
                parts.append(raw[at:x])
                at = y
            parts.append(raw[at : int(b.offsets[d + 1])])
            text = b"".join(parts)
            texts[d] = (text if cut else b" ".join(text.split())).decode()
        return pa.table([*(table.column(c) for c in keep), pa.array(np.diff(b.first), pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(texts, pa.string())], names=[*keep, "n_words", "spans", "kept"])

    return repeated(docs.select(*dict.fromkeys([*keep, "doc_id", "text"])), Scheme(width, gram, True), resolve, finish, schema, batch_bytes)
