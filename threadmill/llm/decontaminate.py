"""Operator 8, benchmark decontamination.

A hash set of the benchmark's normalised word windows is broadcast, every
training text is scanned window by window, and each hit of the hash set is
compared word by word before it counts. The set that is broadcast has a
bound: a larger benchmark is split into blocks of ``max_windows`` windows
that are scanned one after the other; each gives the hits of the texts that
have any, by a digest of the text, and their union is joined to the documents
at the end, so nothing is dropped and no text is written.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, KEPT, LOWER, U64, doc_slices, free_name, gram_hashes, owners, schema_with, set_aside, word_hashes, words
from .components import written

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FILTER_BITS = 20


def item_windows(text: str | None, width: int) -> list[bytes]:
    """The windows of an item, words joined by a space: those of ``width`` words, or the whole if it is shorter."""
    found = _WORD.findall((text or "").encode().translate(bytes(LOWER)))
    if not found:
        return []
    return [b" ".join(found[i : i + width]) for i in range(max(1, len(found) - width + 1))]


_made: dict[str, WindowSet] = {}
KEPT.append(_made)


def window_set(name: str, windows: dict[bytes, list[str]]) -> WindowSet:
    """The set of these windows, made once in a worker; only the last one is kept."""
    if name not in _made:
        _made.clear()
        _made[name] = WindowSet(windows)
    return _made[name]


class WindowSet:
    """Windows by length in words: sorted hashes, a bit filter over their low bits, and the windows with their items."""

    def __init__(self, windows: dict[bytes, list[str]]):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, dict[int, list[tuple[bytes, list[str]]]]]] = {}
        lengths = defaultdict(list)
        for window in windows:
            lengths[window.count(b" ") + 1].append(window)
        for n, some in lengths.items():
            data = np.frombuffer(b"".join(some), np.uint8)
            offsets = np.cumsum([0, *map(len, some)])
            starts, ends, _ = words(data, offsets, ALNUM)
            hashes = gram_hashes(word_hashes(data, starts, ends), n)[::n]
            table = defaultdict(list)
            for h, window in zip(hashes.tolist(), some, strict=True):
                table[h].append((window, windows[window]))
            ordered = np.unique(hashes)
            sieve = np.zeros(1 << FILTER_BITS, bool)
            sieve[ordered & U64(len(sieve) - 1)] = True
            self.by_length[n] = ordered, sieve, dict(table)

    def hits(self, data: np.ndarray, offsets: np.ndarray):
        """(first word of each document, for each hit its first word, its length and its items)."""
        data = LOWER[data]
        starts, ends, first = words(data, offsets, ALNUM)
        owner = owners(first)
        hashes = word_hashes(data, starts, ends)
        at: list[tuple[int, int, list[str]]] = []
        raw = data.tobytes()
        for n, (ordered, sieve, table) in self.by_length.items():
            grams = gram_hashes(hashes, n)
            maybe = np.flatnonzero(sieve[grams & U64(len(sieve) - 1)])
            maybe = maybe[owner[maybe] == owner[maybe + n - 1]]
            place = np.minimum(np.searchsorted(ordered, grams[maybe]), len(ordered) - 1)
            for i in maybe[ordered[place] == grams[maybe]].tolist():
                here = b" ".join([raw[s:e] for s, e in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist(), strict=True)])
                at += [(i, n, items) for window, items in table[int(grams[i])] if window == here]
        return first, starts, ends, at


def _blocks(benchmark: DataFrame, width: int, max_windows: int):
    """Dictionaries window -> items of at most ``max_windows`` windows, counted once for each item that has them (or of one item's), read item by item."""
    block: dict[bytes, dict[str, None]] = defaultdict(dict)
    size = 0
    plain = lambda block: {w: list(items) for w, items in block.items()}
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        if row[0] is None:
            continue
        found = set(item_windows(row[1], width))
        if size and size + len(found) > max_windows:
            yield plain(block)
            block, size = defaultdict(dict), 0
        size += len(found)
        for window in found:
            block[window][row[0]] = None
    yield plain(block)


def _scanned(known: WindowSet, data: np.ndarray, offsets: np.ndarray):
    """For each document of a slice: its number of words, the hit word ranges, the same as byte ranges, and the items."""
    first, starts, ends, at = known.hits(data, offsets)
    by_doc = defaultdict(list)
    for i, n, items in at:
        by_doc[int(np.searchsorted(first, i, "right")) - 1].append((i, n, items))
    hit, span, found = [], [], []
    for d in range(len(offsets) - 1):
        base, own = int(offsets[d]), by_doc.get(d, ())
        hit.append(merged([[i - int(first[d]), i + n - int(first[d])] for i, n, _ in own]))
        span.append(merged([[int(starts[i]) - base, int(ends[i + n - 1]) - base] for i, n, _ in own]))
        found.append(sorted({x for _, _, items in own for x in items}))
    return np.diff(first), hit, span, found


def _scan(frame: DataFrame, block: dict[bytes, list[str]], schema, make) -> DataFrame:
    """make(rows, bytes, offsets, n_words, hit, span, items) gives the batch to return."""
    shared, name = frame.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches):
        known = window_set(name, shared.value)
        for rows, data, offsets in doc_slices(batches):
            yield make(rows, data, offsets, *_scanned(known, data, offsets))

    return frame.mapInArrow(run, schema)


_PAIRS = pa.list_(pa.list_(pa.int64()))


def _facts(names: list[str]):
    def make(rows, data, offsets, n_words, hit, span, found):
        arrays = [rows.column(c) for c in names] + [pa.array(n_words, pa.int64()), pa.array(hit, _PAIRS), pa.array(span, _PAIRS), pa.array(found, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, names=[*names, "n_words", "hit", "span", "items"])

    return make


def _scan_all(docs: DataFrame, benchmark: DataFrame, carried: list[str], width: int, max_windows: int, schema, make) -> DataFrame:
    """One block is one pass over the documents; several are one pass each, and a join of what they found."""
    frame, found, waiting = docs.select(*carried), None, None
    texts = docs.where("text IS NOT NULL").select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text")
    some = lambda *x: _facts(["digest"])(*x).filter(pa.array([bool(h) for h in x[4]], pa.bool_()))
    for block in _blocks(benchmark, width, max_windows):
        if waiting is not None:
            own = written(_scan(texts, waiting, "digest string, " + HITS, some))
            found = own if found is None else found.unionByName(own)
        waiting = block
    if found is None:
        return _scan(frame, waiting, schema, make)
    found = found.unionByName(written(_scan(texts, waiting, "digest string, " + HITS, some)))
    united = found.groupBy("digest").agg(F.flatten(F.collect_set("hit")).alias("hit"), F.flatten(F.collect_set("span")).alias("span"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))  # a row for each block at most, once equal texts are set aside
    key = free_name("digest", carried)
    told = frame.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), F.sha2(F.col("text").cast("binary"), 256).alias(key)).join(united.withColumnRenamed("digest", key), key, "left").select("row.*", F.struct("hit", "span", "items").alias(key))

    def run(batches):
        for rows, data, offsets in doc_slices(batches):
            known = rows.column(key)
            hit, span, items = ([x or [] for x in known.field(k).to_pylist()] for k in range(3))
            starts = words(data, offsets, ALNUM)[2]
            yield make(rows, data, offsets, np.diff(starts), [merged(x) for x in hit], [merged(x) for x in span], items)

    return told.mapInArrow(run, schema)


def window_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_windows: int = 2_000_000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each document the words that lie in a benchmark window and the items found.

    Words are maximal runs of ASCII letters and digits and of code points
    beyond ASCII; A-Z are lower-cased. Returns the ``keep`` columns with
    n_words, hit (array of [from, to) word ranges, merged), span (the same as
    byte ranges of the text) and items (distinct, sorted as strings). Null
    texts have no words; items that are null, empty or without an id are
    ignored; equal items all count. One row for each row, repeated ones too;
    an empty table gives none, and an empty benchmark no hits.
    """
    names = list(keep)
    return _scan_all(docs, benchmark, list(dict.fromkeys([*names, "text"])), width, max_windows, schema_with(docs, names, HITS), _facts(names))


HITS = "n_words long, hit array<array<long>>, span array<array<long>>, items array<string>"


def merged(ranges: list[list[int]]) -> list[list[int]]:
    """Sorted ranges, united where they overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def decontamination_digest(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_windows: int = 2_000_000) -> DataFrame:
    """The result of ``window_hits`` as counts and digests, one row per row of ``docs``."""
    hits = window_hits(docs, benchmark, width, max_windows)
    n_hit = F.expr("aggregate(hit, 0L, (acc, x) -> acc + x[1] - x[0])")
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_share: float = 0.5, max_windows: int = 2_000_000) -> DataFrame:
    """Documents without the benchmark's passages: the spans of hit words are cut out of the text, and a document
    of which more than ``max_share`` of the words are hit goes as a whole. Other columns stay; untouched documents are unchanged.
    """
    packed, restore = set_aside(docs, ("doc_id", "text"))
    names = packed.columns

    def cut(rows, data, offsets, n_words, hit, span, found):
        share = np.array([sum(b - a for a, b in h) / n if n else 0.0 for h, n in zip(hit, n_words.tolist(), strict=True)])
        texts = rows.column("text").to_pylist() if any(span) else None
        for d, spans in enumerate(span):
            if spans and share[d] <= max_share:
                raw, at, out = data[offsets[d] : offsets[d + 1]].tobytes(), 0, []
                for a, b in spans:
                    out.append(raw[at:a])
                    at = b
                texts[d] = b"".join([*out, raw[at:]]).decode()
        kind = rows.schema.field("text").type
        columns = [pa.array(texts, kind) if c == "text" and texts is not None else rows.column(c) for c in names]
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(share <= max_share))

    return restore(_scan_all(packed, benchmark, names, width, max_windows, packed.schema, cut))
