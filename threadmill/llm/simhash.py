"""Operator 6, SimHash near-duplicates by pigeonhole blocks.

Fingerprints are cut into blocks. If two differ in at most d bits, at most d
of b blocks differ, so b - d blocks agree: every choice of b - d blocks is a
join key, and each close pair meets under one of them at least. Only
distinct fingerprints are joined, and of the close pairs under a key only a
spanning forest is emitted, so a group of copies costs edges in proportion to
its size. Every link is verified by its Hamming distance.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, LOWER, SOLID, U64, buffers, doc_slices, give_back, gram_hashes, hash_share, ids_of, mixed, numbered_words, ranges, safe_hashes, schema_with, set_aside, slices, words
from .components import components, ensure_checkpoint_dir, written
from .rounds import Rounds, filled, gathered, pack, shard_cuts

_SPACED = LOWER.copy()
_SPACED[~SOLID] = 0x20
PAIRWISE = 24  # groups up to this size are compared all at once


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all word shingles in order, repeats included, and how many each document has."""
    data = _SPACED[data]
    starts, ends, first = words(data, offsets)
    n_words = np.diff(first)
    n = np.where(n_words >= shingle, n_words - shingle + 1, (n_words > 0).astype(np.int64))
    if not n.sum():
        return np.zeros(0, U64), n
    before = np.cumsum(n) - n
    low = np.arange(int(n.sum())) - np.repeat(before - first[:-1], n)
    high = np.minimum(low + shingle, np.repeat(first[1:], n)) - 1
    raw = data.tobytes()
    digest = xxhash.xxh64_intdigest
    s, e = starts[low], ends[high]
    wide = np.concatenate(([0], np.cumsum((starts[1:] - ends[:-1]) != 1)))  # white space of more than one byte
    odd = np.flatnonzero(wide[high] != wide[low])
    hashes = np.array([digest(raw[a:b], seed) for a, b in zip(s.tolist(), e.tolist())], U64)
    for i in odd.tolist():
        hashes[i] = digest(b" ".join(raw[s[i] : e[i]].split()), seed)
    return hashes, n


def fingerprint_arrays(hashes: np.ndarray, n: np.ndarray, parts: int = 1) -> np.ndarray:
    """Documents x parts: the SimHash of each document's n hashes in parts of 64 bits, 0 without any.

    The first part is over the hashes themselves, each other over a mix of them.
    """
    out = np.zeros((len(n), parts), U64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    heads = (np.cumsum(n) - n)[some]
    for part in range(parts):
        own = mixed(hashes + U64(part * int(BASE) % (1 << 64))) if part else hashes
        bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
        out[some, part] = np.packbits(counts * 2 > n[some, None], axis=1, bitorder="little").view(U64)[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of each row with fp, its fingerprint as a signed long; a null text has no words."""
    schema = schema_with(docs, keep, "fp long")

    def run(batches):
        for rows, data, offsets in doc_slices(batches):
            fp = fingerprint_arrays(*shingle_hashes(data, offsets, shingle))[:, 0].view(np.int64)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(fp)], names=[*keep, "fp"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def block_masks(n: int, distance: int) -> list[int]:
    """The masks of all choices of blocks; more and longer keys for more fingerprints, with the same result at every n."""
    blocks = distance + 2
    while blocks < 2 * distance + 2 and (64 * (blocks - distance) / blocks) < np.log2(max(n, 2)) + 2:
        blocks += 1
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(some) for some in combinations(parts, blocks - distance)]


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, whose parts lie along the last axis."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def _forest(fp: np.ndarray, index: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links of a spanning forest among the fingerprints of one key: each is compared with those not yet reached."""
    rest, a, b = index, [], []
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            here = todo.pop()
            close = _differing(fp[rest], fp[here]) <= distance
            if close.any():
                found = rest[close].tolist()
                a += [here] * len(found)
                b += found
                todo += found
                rest = rest[~close]
    return a, b


def linked(keys: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (indices) among the fingerprints (n x parts) under each key, each verified."""
    order = np.lexsort((fp[:, 0], keys))
    keys, fp = keys[order], fp[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((heads, [len(keys)])))
    out_a, out_b = [], []
    group = np.repeat(np.arange(len(heads)), sizes)
    small = np.repeat((sizes > 1) & (sizes <= PAIRWISE), sizes)
    for step in range(1, PAIRWISE):
        at = np.flatnonzero(small[:-step] & (group[step:] == group[:-step])) if step < len(fp) else np.zeros(0, np.int64)
        if not len(at):
            break
        close = at[_differing(fp[at], fp[at + step]) <= distance]
        out_a.append(close)
        out_b.append(close + step)
    for h in np.flatnonzero(sizes > PAIRWISE).tolist():
        a, b = _forest(fp, np.arange(heads[h], heads[h] + sizes[h]), distance)
        out_a.append(np.array(a, np.int64))
        out_b.append(np.array(b, np.int64))
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate(out_a)], order[np.concatenate(out_b)]


def _thinned(a: np.ndarray, b: np.ndarray) -> tuple[list, list]:
    """Of these links those that join two trees."""
    parent: dict = {}

    def root(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    keep_a, keep_b = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            keep_a.append(x)
            keep_b.append(y)
    return keep_a, keep_b


def close_links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links that connect all fingerprints within ``distance`` bits, from a frame of distinct fp."""
    masks = block_masks(distinct.count(), distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    choices = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(signed)))
    keyed = distinct.select("fp", F.explode(choices).alias("k")).select(F.xxhash64("k.choice", "k.part").alias("key"), "fp").repartition("key")

    def run(batches):
        parts = [(b.column("key").to_numpy(), b.column("fp").to_numpy()) for b in batches]
        if not parts:
            return
        keys, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        a, b = linked(keys, fp.view(U64)[:, None], distance)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in _thinned(fp[a], fp[b])], names=["a", "b"])

    return keyed.mapInArrow(run, "a long, b long")


def near_duplicate_groups(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fp and component_id of each row: the smallest doc_id among all that links of ``distance`` bits reach.

    Null and empty texts have no words, as have texts of white space only;
    texts without words have fingerprint 0 and are linked like any other;
    an empty table gives no rows; repeated rows and ids keep their rows; a component that holds null ids only
    has a null component_id.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    marked = fingerprints(docs, shingle).checkpoint()
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    roots = components(close_links(distinct, distance))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicate_digest(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """near_duplicate_groups with the fingerprint as 16 lowercase hexadecimal digits."""
    return near_duplicate_groups(docs, shingle, distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Groups by a similarity of shingle sets: links by fingerprints first, then an exact join by prefixes for those they miss.


def set_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every shingle in order, made from hashes of its words, and how many each document has."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    n_words = np.diff(first)
    n = np.where(n_words >= shingle, n_words - shingle + 1, (n_words > 0).astype(np.int64))
    if not n.sum():
        return np.zeros(0, U64), n
    number, distinct = numbered_words(data, starts, ends)
    symbols = safe_hashes(data, starts, ends, distinct, number)[number]
    grams = gram_hashes(symbols, shingle)
    low = ranges(first[:-1], n)
    out = np.zeros(len(low), U64)
    whole = np.repeat(n_words >= shingle, n)
    out[whole] = grams[low[whole]]
    before = np.cumsum(n) - n
    for d in np.flatnonzero((n_words < shingle) & (n_words > 0)).tolist():  # the whole text is one shingle
        part = symbols[first[d] : first[d + 1]]
        out[before[d]] = gram_hashes(part, len(part))[0] + U64(len(part))
    return out, n


def shingle_sets(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each document in ascending order, one document after the other, and n+1 offsets."""
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(n) + 1))


def set_digests(sets: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each set."""
    raw = sets.tobytes()
    return [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def pack_set(ascending: np.ndarray) -> bytes:
    """The upper 40 bits of each hash, byte by byte place, so that the like ones stand together."""
    return np.ascontiguousarray((ascending >> U64(24)).view(np.uint8).reshape(-1, 8)[:, 4::-1].T).tobytes()


def unpack_set(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, 4::-1] = np.frombuffer(raw, np.uint8).reshape(5, -1).T
    return out.view(U64)[:, 0]


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets; 1 if both are empty."""
    both = len(np.intersect1d(x, y))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def _at_least(x) -> np.ndarray:
    """The least whole number that is x, but for rounding errors, or more."""
    return np.ceil(np.asarray(x) - 1e-9).astype(np.int64)


def prefixes(sets: np.ndarray, first: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set of n hashes the first n - ceil(similarity x n) + 1, rare hashes first: (hash, owner, place).

    The order is by the counts in ``common`` (ascending hashes, their counts;
    0 for others), then by the hash, so it is the same for all sets. Two sets
    of at least that similarity share a hash of both prefixes in any such order.
    """
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    known, counts = common
    count = np.zeros(len(sets), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, sets), len(known) - 1)
        count = np.where(known[at] == sets, counts[at], 0)
    order = np.lexsort((sets, count, owner))
    n = np.diff(first)
    place = np.arange(len(sets)) - first[owner]
    take = place <= (n - _at_least(similarity * n))[owner]
    return sets[order][take], owner[take], place[take]


def narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint16) if not len(values) or int(values.max()) < 1 << 16 else values.astype(np.uint32)


def has_partner(key: np.ndarray, size: np.ndarray, place: np.ndarray, similarity: float, reach: int = 64) -> np.ndarray:
    """Which entries share their key with one of whose set they can be similar enough: never false for such a pair.

    Common shingles are at most as many as follow the first one in either set.
    Beyond ``reach`` entries in order of size only the sizes are looked at.
    """
    order = np.lexsort((place, size, key))
    k, n, p = key[order], size[order], place[order]
    out = np.zeros(len(k), bool)
    left = np.arange(len(k))
    for step in range(1, reach + 1):
        left = left[left + step < len(k)]
        near = left + step
        same = (k[left] == k[near]) & (n[left] >= _at_least(similarity * n[near]))
        left, near = left[same], near[same]
        if not len(left):
            break
        ok = np.minimum(n[left] - p[left], n[near] - p[near]) >= _at_least(similarity / (1 + similarity) * (n[left] + n[near]))
        if step == reach:
            ok[:] = True
        out[left[ok]] = True
        out[near[ok]] = True
    got = np.empty(len(k), bool)
    got[order] = out
    return got


MARKS = tuple(f"m{k}" for k in range(1, 9))
BEFORE = ("b1", "b2", "b3")


def keys_before(key: np.ndarray, owner: np.ndarray, place: np.ndarray, reach: int = len(BEFORE)) -> list[pa.Array]:
    """Of each entry the keys that stand one, two .. places before it among its owner's entries; null where there is none."""
    order = np.lexsort((place, owner))
    out = []
    for back in range(1, reach + 1):
        none, value = np.ones(len(key), bool), np.zeros(len(key), np.int64)
        later, earlier = order[back:], order[:-back]
        none[later] = owner[later] != owner[earlier]
        value[later] = key[earlier].view(np.int64)
        out.append(pa.array(value, mask=none))
    return out


def slot_marks(sets: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Of each set which of 512 equal ranges hold a hash, as eight numbers of 64 bits."""
    n = len(first) - 1
    marks = np.zeros((n, 64 * len(MARKS)), np.uint8)
    marks[np.repeat(np.arange(n), np.diff(first)), (sets >> U64(55)).astype(np.int64)] = 1
    both = np.packbits(marks, axis=1).view(np.int64).reshape(n, len(MARKS))
    return [both[:, k] for k in range(len(MARKS))]


def spreads(sets: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Of each set how many of its hashes fall into each of as many equal ranges (a power of two) as it has hashes; the first byte tells the numbers' width."""
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        bits = max(6, (b - a - 1).bit_length())
        count = np.bincount((sets[a:b] >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
        out.append(b"\1" + count.astype(np.uint8).tobytes() if count.max() < 256 else b"\4" + count.astype(np.uint32).tobytes())
    return out


def may_be_similar(x: bytes, y: bytes, similarity: float) -> bool:
    """False only where the sets of these spreads have too little in common: in a range at most the smaller number."""
    x, y = (np.frombuffer(v, np.uint8 if v[0] == 1 else np.uint32, offset=1).astype(np.int64) for v in (x, y))
    if len(x) > len(y):
        x, y = y, x
    both = int(np.minimum(x, y.reshape(len(x), -1).sum(1)).sum())
    return both >= similarity * (int(x.sum()) + int(y.sum()) - both) - 1e-9


def frequent_shingles(texts: DataFrame, share: float, shingle: int, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` shingles (ascending) that occur in three or more of a sample of the texts, the most frequent ones, and their counts."""

    def hashes_only(batches):
        for _, data, offsets in doc_slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(*set_hashes(data, offsets, shingle))[0].view(np.int64))], names=["h"])
        give_back()

    some = texts.where(hash_share("text", 6) < share).mapInArrow(hashes_only, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2").checkpoint()
    left, least = most, 3
    for row in some.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).collect():  # no more rows than texts in the sample
        left -= row["c"]
        if left < 0:
            least = row["n"] + 1
            break
    top = some.where(F.col("n") >= least).toArrow()
    known, counts = top.column("h").to_numpy().view(U64), top.column("n").to_numpy()
    order = np.argsort(known)
    return known[order], counts[order]


class _Nodes:
    """The texts of a batch as shingle sets; texts of equal sets are one node, told by a digest."""

    def __init__(self, table: pa.Table, shingle: int):
        data, offsets = buffers(table.column("text"))
        sets, sizes, digests = [], [], []
        for a, b in slices(offsets, 1 << 20):
            own, first = shingle_sets(*set_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle))
            sets.append(own)
            sizes.append(np.diff(first))
            digests += set_digests(own, first)
        self.doc = ids_of(table.column("doc_id"))
        raw = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(U64)
        self.text = [xxhash.xxh3_128_digest(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        order = np.lexsort((np.array(self.text, "S16"), self.doc, raw[:, 1], raw[:, 0]))
        ordered = raw[order]
        new = np.ones(len(order), bool)
        new[1:] = (ordered[1:] != ordered[:-1]).any(1)
        self.row = order[new]  # of each node, in order of the digests, the row of the least doc
        self.node = np.empty(len(order), np.int64)
        self.node[order] = np.cumsum(new) - 1  # of each row
        self.high, self.low = raw[self.row, 0], raw[self.row, 1]
        self.digest = [digests[r] for r in self.row.tolist()]
        self._sets = np.concatenate([np.zeros(0, U64), *sets])
        self._first = np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))))

    def sets(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets of these nodes, one after the other, and their offsets."""
        begin, size = self._first[self.row[nodes]], np.diff(self._first)[self.row[nodes]]
        return self._sets[ranges(begin, size)], np.concatenate(([0], np.cumsum(size)))


#: what 0: a node of a batch with its least doc and that text's digest; 1: a node under a key that another node has too, and its keys before; 2: a node with such keys, its fingerprint (key), its set, the ranges that this is in and how it spreads over slots.
PARTS = f"what int, batch int, key long, node binary, n int, place int, {', '.join(f'{m} long' for m in BEFORE + MARKS)}, doc long, spread binary, data binary"
_PARTS_ARROW = pa.schema([("what", pa.int32()), ("batch", pa.int32()), ("key", pa.int64()), ("node", pa.binary()), ("n", pa.int32()), ("place", pa.int32()), *((m, pa.int64()) for m in BEFORE + MARKS), ("doc", pa.int64()), ("spread", pa.binary()), ("data", pa.binary())])


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, sample: int = 10_000, keep: tuple[str, ...] = ("doc_id",), distance: int = 4, batch_bytes: int = 4 << 20) -> DataFrame:
    """The ``keep`` columns of each row with root, the same for rows that links of at least ``similarity`` connect, and stays, true for one row of each root: that of the least doc_id (null last).

    A link is a Jaccard similarity of the sets of shingles (hashes, compared by
    40 bits) of that much, over whole sets of any size. Texts of equal sets are one node.
    Nodes are linked in three steps, each candidate being verified by the
    whole sets, and a step sees only what those before it left apart:

    1. fingerprints within ``distance`` bits, by pigeonhole blocks;
    2. nodes that share a shingle of both prefixes (``prefixes``, a condition
       that no pair at ``similarity`` can miss) with the least node under it;
    3. under each such shingle, the nodes outside the largest group of linked
       ones with all others.

    A pair that shares several such shingles needs to meet under the first one
    only: a shingle goes whose nodes all have the same one just before it, and
    under the others a pair is left out that shares one of the ``BEFORE``.
    No link is lost, whatever the size of a group. ``sample`` texts tell the
    frequent shingles, which stand last in the prefixes' order; they bear on
    speed only. Null texts and texts without words have the empty set, and are
    one node; repeated rows are rows of one node; an empty table gives none.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    frame = docs.select(*dict.fromkeys([*keep, "doc_id", "text"]))
    rounds = Rounds(frame, batch_bytes)
    shards = rounds.shards
    common = spark.sparkContext.broadcast(frequent_shingles(frame.select("text").where("text IS NOT NULL"), sample / max(rounds.rows, 1), shingle))

    def ask_owners(table, _):
        b = _Nodes(table, shingle)
        for s, part in filled(shard_cuts(b.high, shards)):
            yield s, pack(high=b.high[part], low=b.low[part])

    def answer_owners(got):
        """A node is owned by the first batch that has it."""
        high, low = (np.concatenate([x[c] for _, x in got]) for c in ("high", "low"))
        order = np.lexsort((np.arange(len(high)), low, high))
        own = np.ones(len(high), bool)
        own[order[1:]] = (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
        ends = np.cumsum([len(x["high"]) for _, x in got])
        return [pack(own=np.packbits(part)) for part in np.split(own, ends[:-1])]

    def keys_of(table, came):
        """The batch, its own nodes, and their prefixes' (key, node, size of its set, place), sorted."""
        b = _Nodes(table, shingle)
        own = np.flatnonzero(gathered(came.get(1, []), shard_cuts(b.high, shards), "own", bool))
        sets, first = b.sets(own)
        key, owner, place = prefixes(sets, first, common.value, similarity)
        size = np.diff(first)[owner]
        order = np.lexsort((owner, size, key))
        return b, own, key[order], owner[order], size[order], place[order]

    def ask_keys(table, came):
        *_, key, _, size, place = keys_of(table, came)
        for s, part in filled(shard_cuts(key, shards)):
            yield s, pack(key=key[part], size=narrow(size[part]), place=narrow(place[part]))

    def answer_keys(got):
        key, size, place = (np.concatenate([x[c].astype(kind) for _, x in got]) for c, kind in (("key", U64), ("size", np.int64), ("place", np.int64)))
        shared = has_partner(key, size, place, similarity)
        ends = np.cumsum([len(x["key"]) for _, x in got])
        return [pack(shared=np.packbits(part)) for part in np.split(shared, ends[:-1])]

    def parts_of(number, table, came):
        b, own, key, owner, size, place = keys_of(table, came)
        cuts = shard_cuts(key, shards)
        some = np.flatnonzero(gathered(came.get(2, []), cuts, "shared", bool))
        key, owner, size, place = key[some], owner[some], size[some], place[some]
        involved = np.unique(owner)
        sets, first = b.sets(own[involved])
        fp = fingerprint_arrays(sets, np.diff(first))[:, 0]
        spread, packed = spreads(sets, first), [pack_set(sets[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
        n, m, k = len(b.row), len(key), len(involved)
        names = np.array(b.digest, object)
        none = lambda count, kind: pa.nulls(count, kind)
        columns = {
            "what": np.repeat(np.arange(3, dtype=np.int32), (n, m, k)), "batch": np.full(n + m + k, number, np.int32), "key": np.concatenate((np.zeros(n, U64), key, fp)).view(np.int64),
            "node": pa.array(np.concatenate((names, names[own[owner]], names[own[involved]])).tolist(), pa.binary()), "n": np.concatenate((np.zeros(n), size, np.diff(first))).astype(np.int32),
            "place": np.concatenate((np.zeros(n), place, np.zeros(k))).astype(np.int32), **{c: pa.chunked_array([none(n, pa.int64()), x, none(k, pa.int64())]) for c, x in zip(BEFORE, keys_before(key, owner, place), strict=True)},
            **{c: pa.chunked_array([none(n + m, pa.int64()), pa.array(x)]) for c, x in zip(MARKS, slot_marks(sets, first), strict=True)}, "doc": np.concatenate((b.doc[b.row], np.zeros(m + k, np.int64))),
            "spread": pa.chunked_array([none(n + m, pa.binary()), pa.array(spread, pa.binary())]), "data": pa.chunked_array([pa.array([b.text[r] for r in b.row.tolist()], pa.binary()), none(m, pa.binary()), pa.array(packed, pa.binary())]),
        }
        return pa.table({c: columns[c] for c in _PARTS_ARROW.names}, schema=_PARTS_ARROW)

    first = rounds.answer(1, rounds.ask(ask_owners), answer_owners)
    second = rounds.answer(2, rounds.ask(ask_keys, first), answer_keys)
    parts = written(rounds.rows_of(parts_of, PARTS, first, second), "what")
    nodes, every = parts.where("what = 0").select("batch", "node", "doc", "data"), parts.where("what = 1").select("key", "node", "n", "place", *BEFORE)
    sets = parts.where("what = 2").select("node", F.col("key").alias("fp"), "spread", "data")
    # whoever meets under a key that all its nodes have the same key before meets under that one
    alike = (F.count("*") == F.count(BEFORE[0])) & (F.min(BEFORE[0]) == F.max(BEFORE[0]))
    needed = every.groupBy("key").agg(F.coalesce(alike, F.lit(False)).alias("alike")).where("NOT alike").select("key")
    marked = every.join(needed, "key", "left_semi").join(parts.where("what = 2").select("node", *MARKS), "node")
    rows = written(marked.select("key", "node", F.struct("n", "place", *MARKS).alias("v"), F.struct(*BEFORE).alias("before")))

    def test(enough):
        def run(batches):
            for batch in batches:
                ok = [enough(p, q) for p, q in zip(*(batch.column(c).to_pylist() for c in ("x", "y")), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
            give_back()

        return run

    def tested(pairs: DataFrame, column: str, enough) -> DataFrame:
        """The pairs whose nodes' ``column`` passes; only nodes of pairs are dealt out."""
        some = sets.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi")
        both = pairs.join(some.select(F.col("node").alias("a"), F.col(column).alias("x")), "a").join(some.select(F.col("node").alias("b"), F.col(column).alias("y")), "b")
        return written(both.select("a", "b", "x", "y").mapInArrow(test(enough), "a binary, b binary"), records=256)

    def verified(pairs: DataFrame) -> DataFrame:
        """By the most that the sets can have in common, then by the sets themselves."""
        return tested(tested(written(pairs), "spread", lambda x, y: may_be_similar(x, y, similarity)), "data", lambda x, y: jaccard(unpack_set(x), unpack_set(y)) >= similarity - 1e-9)

    def possible(a: str, b: str):
        """Whether two sets can be similar enough, if this is the first shingle in order that they share, and by the ranges of hashes that only one of them has any in."""
        x, y = ({c: F.col(f"{v}.{c}") for c in ("n", "place", *MARKS)} for v in (a, b))
        shared = F.ceil(F.lit(similarity / (1 + similarity)) * (x["n"] + y["n"]) - 1e-9)
        own = lambda p, q: sum(F.bit_count(p[m].bitwiseAND(F.bitwise_not(q[m]))) for m in MARKS)
        return (F.least(x["n"] - x["place"], y["n"] - y["place"]) >= shared) & (F.least(x["n"] - own(x, y), y["n"] - own(y, x)) >= shared)

    def met(a: str, b: str):
        """Whether a pair certainly shares an earlier key."""
        return F.coalesce(reduce(or_, (F.col(f"{a}.{x}") == F.col(f"{b}.{y}") for x in BEFORE for y in BEFORE)), F.lit(False))

    def with_root(frame: DataFrame, roots: DataFrame) -> DataFrame:
        return frame.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    # 1: the least node of a fingerprint stands for all that have it
    stands = sets.groupBy("fp").agg(F.min("node").alias("head"))
    equal = sets.join(stands, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    close = close_links(stands.select("fp"), distance)
    ends = stands.select(F.col("fp").alias("a"), F.col("head").alias("head_a")), stands.select(F.col("fp").alias("b"), F.col("head").alias("head_b"))
    near = close.distinct().join(ends[0], "a").join(ends[1], "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    links = verified(equal.unionByName(near))
    # 2: the least node under a key
    known = with_root(rows.drop("before"), components(links))
    least = known.groupBy("key").agg(F.min(F.struct("node", "root", "v")).alias("c"))
    star = known.join(least, "key").where((F.col("root") != F.col("c.root")) & possible("v", "c.v"))
    links = links.unionByName(verified(star.select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()))
    # 3: those outside a key's largest group, with all others
    known = written(with_root(rows, components(links)))
    most = known.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
    apart = known.join(most, "key").where("root <> most").select("key", *(F.col(c).alias(f"{c}_b") for c in ("node", "v", "before", "root")))
    crossed = known.join(apart, "key").where((F.col("root") != F.col("root_b")) & possible("v", "v_b") & ~met("before", "before_b"))
    pairs = crossed.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()
    roots = components(links.unionByName(verified(pairs)))
    # every batch learns its nodes' roots, and which of them stay
    named = written(with_root(nodes, roots))
    stay = named.groupBy("root").agg(F.min(F.struct("doc", "batch", "node")).alias("s")).select(F.col("s.batch").alias("batch"), F.col("s.node").alias("node"), F.lit(True).alias("stays"))
    told = named.join(stay, ["batch", "node"], "left").select("batch", "node", "root", F.coalesce("stays", F.lit(False)).alias("stays"))

    def tell(table):
        node, root = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8) for c in ("node", "root"))
        return pack(node=node, root=root, stays=np.array(table.column("stays").to_pylist(), np.uint8))

    schema = schema_with(docs, keep, "root binary, stays boolean")

    def end(table, came):
        b = _Nodes(table, shingle)
        (_, x), = came[3]
        cut = lambda a: [a[16 * i : 16 * i + 16].tobytes() for i in range(len(a) // 16)]
        known = dict(zip(cut(x["node"]), zip(cut(x["root"]), x["stays"].tolist(), strict=True), strict=True))
        root = [known[d][0] for d in b.digest]
        stays = np.zeros(table.num_rows, bool)
        stays[b.row] = [bool(known[d][1]) for d in b.digest]
        return pa.table([*(table.column(c) for c in keep), pa.array([root[k] for k in b.node.tolist()], pa.binary()), pa.array(stays)], names=[*keep, "root", "stays"])

    return rounds.finish(end, schema, rounds.letters(3, told, tell))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of ``similar_groups``: that of the smallest doc_id (null last), once if it is repeated.

    Rows keep all their columns, whatever their names. Texts without words,
    null texts included, are one group.
    """
    packed, restore = set_aside(docs, ("doc_id", "text"))
    return restore(similar_groups(packed, shingle, similarity, keep=tuple(packed.columns)).where("stays"))
