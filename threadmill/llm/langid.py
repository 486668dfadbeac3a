"""Operator 4, language identification by nearest centroid.

A text becomes the TF-IDF vector of its hashed byte 2- and 3-grams (letters
lower-cased, all else a space), of unit length. Each language has several
centroids from spherical k-means; a text takes the language of the centroid of
highest cosine, and is rejected if even that is too far away. Document
frequencies, centroids and floors come from all training rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, doc_slices, give_back, hash_share, mixed, schema_with, slices

BITS = 12
SIZE = 1 << BITS
UNKNOWN = "und"
UNIT = 1 << 15  # parts of one in a vector that is summed: sums of ROWS rows are exact in single precision
BLOCK = 64  # sums in a row of a table
ROWS = 256  # rows whose dense vectors are held at once
#: Classes of length, each up to the next: about so many letters, half the number of grams. Shorter texts are not judged by distance.
LADDER = 2 ** np.arange(4, 14)

_SPACE = 0x20
_LETTER = np.full(256, _SPACE, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True
_TABLES = [(mixed(np.arange(256, dtype=U64) + U64(1000 * i + 1)) & U64(0xFFFFFFFF)).astype(np.uint32) for i in range(5)]


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x SIZE counts of hashed 2- and 3-grams within each document."""
    n = len(offsets) - 1
    data = _LETTER[data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1  # Latin-1 capitals
    data[upper] += 0x20
    owner = np.repeat(np.arange(n, dtype=np.int64) << BITS, np.diff(offsets))
    out = np.zeros(n * SIZE, np.int64)
    for tables in (_TABLES[:2], _TABLES[2:]):
        k = len(tables)
        m = len(data) - k + 1
        if m <= 0:
            continue
        code = tables[0][data[:m]]
        for j in range(1, k):
            code = code + tables[j][data[j : j + m]]
        keep = (owner[:m] == owner[k - 1 :]) & ((data[:m] != _SPACE) | (data[k - 1 :] != _SPACE))
        out += np.bincount((owner[:m] + (code >> np.uint32(32 - BITS)))[keep], minlength=n * SIZE)
    return out.reshape(n, SIZE)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    n = len(offsets) - 1
    before = np.concatenate(([0], np.cumsum(_ASCII_LETTER[data])))
    out = before[offsets[1:]] > before[offsets[:-1]]
    high = np.concatenate(([0], np.cumsum(data >= 0x80)))
    for d in np.flatnonzero(~out & (high[offsets[1:]] > high[offsets[:-1]])).tolist():
        out[d] = any(map(str.isalpha, data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace")))
    return out


@dataclass
class Centroids:
    languages: list[str]  # of each centroid
    matrix: np.ndarray  # centroids x SIZE, unit length
    idf: np.ndarray
    floor: np.ndarray  # centroids x classes of length: the cosine below which a text is rejected

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log(counts.astype(np.float32) + 1) * self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        return x / np.where(norm > 0, norm, 1)[:, None]


def length_class(grams: np.ndarray) -> np.ndarray:
    """The class in LADDER of texts with so many grams; -1 for those too short to judge."""
    return np.searchsorted(LADDER, grams / 2, "right") - 1


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text cut from end to end by halves, into a piece of each shorter class of length than its own and two of the shortest, and whole: bytes, offsets, owners.

    Texts longer than all classes are cut in equal parts first.
    """
    out, owner = [], []
    for d, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if high - low < LADDER[0]:
            continue
        turned = zlib.crc32(data[low:high].tobytes()) >> 1 & 1  # whether the shorter pieces come last
        parts = (high - low) // int(2 * LADDER[-1]) + 1
        ends = [low + (high - low) * i // parts for i in range(parts + 1)]
        before = len(out)
        for a, b in zip(ends, ends[1:]):
            top = int(np.searchsorted(LADDER, b - a, "right")) - 1
            cuts = [0, *((b - a) >> k for k in range(top, -1, -1))] if top else []
            cuts = [b - x for x in reversed(cuts)] if turned else [a + x for x in cuts]
            out += [data[x:y] for x, y in zip(cuts, cuts[1:])]
        out.append(data[low:high])
        owner += [d] * (len(out) - before)
    sizes = np.array([len(x) for x in out], np.int64)
    return np.concatenate([np.zeros(0, np.uint8), *out]), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), np.array(owner, np.int64)


def _halves(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(data[a:b].tobytes()) & 1 for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.int64)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def _group_sums(rows: DataFrame, idf: np.ndarray, state: dict) -> dict:
    """For each (language, half) the sums of its vectors by group; a vector's group is the highest of its products with ``state``'s directions, less their offsets.

    Vectors are taken in whole parts of 1 / UNIT, so that sums are the same in any order. A group without rows sums to zero.
    """
    shared = rows.sparkSession.sparkContext.broadcast((idf, state))
    names = ["lang", "half", "c", "block", *(f"s{k}" for k in range(BLOCK))]

    def run(batches):
        idf_, directions = shared.value
        scale, total = Centroids([], np.zeros((0, SIZE), np.float32), idf_, np.zeros((0, 0))), {}
        for some, data, offsets in doc_slices(batches, rows=ROWS):
            x = scale.vectors(gram_counts(data, offsets))
            for key, own in _by_key(some.column("lang").to_pylist(), _halves(data, offsets)).items():
                if directions is None:
                    group, k = np.zeros(len(own), np.int64), 1
                elif key in directions:
                    towards, less = directions[key]
                    group, k = np.argmax(x[own] @ towards.T - less, axis=1), len(towards)
                else:
                    continue
                here = (group == np.arange(k)[:, None]).astype(np.float32) @ np.rint(x[own] * UNIT)
                total[key] = total.get(key, 0) + here.astype(np.int64)
        for (lang, half), sums in total.items():
            c, block = (v.ravel() for v in np.mgrid[: len(sums), : SIZE // BLOCK])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(np.full(len(c), half)), pa.array(c), pa.array(block), *(pa.array(v) for v in sums.reshape(-1, BLOCK).T.copy())], names=names)
        give_back()

    summed = rows.mapInArrow(run, "lang string, " + ", ".join(f"{n} long" for n in names[1:])).groupBy(*names[:4]).agg(*(F.sum(n).alias(n) for n in names[4:])).toArrow()
    out: dict = {}
    if summed.num_rows:
        values = np.stack([summed.column(n).to_numpy() for n in names[4:]], axis=1)
        half, c, block = (summed.column(n).to_numpy() for n in names[1:4])
        for lang, h, c_, b, v in zip(summed.column("lang").to_pylist(), half.tolist(), c.tolist(), block.tolist(), values, strict=True):
            out.setdefault((lang, h), {}).setdefault(c_, np.zeros((SIZE // BLOCK, BLOCK)))[b] = v
    return {key: {c_: v.ravel() for c_, v in groups.items() if v.any()} for key, groups in out.items()}


def _by_key(names: list, halves: np.ndarray) -> dict[tuple[str, int], np.ndarray]:
    """The rows of each (language, half)."""
    out: dict = {}
    for i, key in enumerate(zip(names, halves.tolist(), strict=True)):
        out.setdefault(key, []).append(i)
    return {key: np.array(own) for key, own in out.items()}


def _spherical_means(rows: DataFrame, idf: np.ndarray, clusters: int, rounds: int, seed: int) -> dict:
    """Centroids of each (language, half) from all its rows: groups by fixed random directions from the mean, then rounds of k-means."""
    mean = {key: _unit(groups[0]) for key, groups in _group_sums(rows, idf, None).items() if groups}
    random = np.random.default_rng(seed).normal(size=(clusters, SIZE)).astype(np.float32)
    state = {key: (random, random @ m.astype(np.float32)) for key, m in sorted(mean.items())}
    centroids: dict = {}
    for _ in range(rounds + 1):
        if not state:
            break
        found, moved = _group_sums(rows, idf, state), 0.0
        for key in state:
            old = centroids.get(key)
            size = len(old) if old is not None else clusters
            new = np.stack([_unit(found[key][c]) if c in found[key] else old[c] for c in range(size) if c in found[key] or old is not None])
            moved = max(moved, 1.0 if old is None else 1 - float((old * new).sum(1).min()))
            centroids[key] = new
        if moved < 1e-5:
            break
        state = {key: (c.astype(np.float32), np.zeros(len(c), np.float32)) for key, c in centroids.items()}
    return {key: c.astype(np.float32) for key, c in centroids.items()}


def fit(docs: DataFrame, train: Column, per_language: int | None = None, clusters: int = 4, slack: float = 1.0, seed: int = 4, max_languages: int = 1000, rounds: int = 4) -> Centroids | None:
    """Learns from all rows where ``train`` holds and lang is not null; None if there are none.

    Each half of a language's rows (by a hash of the text) gives ``clusters``
    centroids by ``rounds`` rounds of spherical k-means on the executors; the
    model holds those of both. A text is rejected below ``slack`` times the
    cosine that all but a thousandth of its language's pieces of its class of
    length reach, each half measured by the centroids of the other. Pieces are
    the texts whole, and once more cut from end to end by halves. A class of fewer than 1,000 pieces, too few to show a
    thousandth, is judged with those of the next shorter classes. Null and
    empty texts teach nothing; repeated rows count as often as they stand.
    More than ``max_languages`` different labels are an error: the model is
    broadcast, and they bound it. A caller who wants less than the whole may
    give ``per_language``, about so many rows a language for all but the
    document frequencies; none is left out unless asked.
    """
    spark = docs.sparkSession
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if not per:
        return None
    if len(per) > max_languages:
        raise ValueError(f"more than {max_languages} languages")

    def frequencies(batches):
        total, n = np.zeros(SIZE, np.int64), 0
        for some, data, offsets in doc_slices(batches, rows=ROWS):
            total += (gram_counts(data, offsets) > 0).sum(0)
            n += some.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, SIZE)), pa.array(np.concatenate(([n], total)))], names=["gram", "n"])
        give_back()

    df = np.zeros(SIZE + 1)
    for r in rows.select("text").mapInArrow(frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        df[r["gram"] + 1] = r["n"]
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 0.1).astype(np.float32)
    if per_language is not None:
        share = F.create_map(*(x for lang, n in per.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))))
        rows = rows.where(hash_share("doc_id", seed) < share[F.col("lang")])
    rows = rows.select("lang", "text")
    centroids = _spherical_means(rows, idf, clusters, rounds, seed)
    if not centroids:
        return None
    shared = spark.sparkContext.broadcast((idf, centroids))

    def measure(batches):
        """How many pieces of each language and class of length have which cosine, in whole 65,536ths, with the centroids of the other half."""
        idf_, known = shared.value
        scale, total = Centroids([], np.zeros((0, SIZE), np.float32), idf_, np.zeros((0, 0))), {}
        for some, data, offsets in doc_slices(batches, rows=ROWS):
            names, which = some.column("lang").to_pylist(), _halves(data, offsets)
            part, bounds, owner = pieces(data, offsets)
            for a, b in slices(bounds, 1 << 20, ROWS):
                counts = gram_counts(part[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                x, size = scale.vectors(counts), length_class(counts.sum(1))
                for (lang, half), own in _by_key([names[d] for d in owner[a:b].tolist()], which[owner[a:b]]).items():
                    matrix = known.get((lang, 1 - half), known.get((lang, half)))
                    if matrix is not None:
                        steps = np.clip((x[own] @ matrix.T).max(1) * 65536, 0, 65536).astype(np.int64)
                        code, n = np.unique(size[own][size[own] >= 0] << 20 | steps[size[own] >= 0], return_counts=True)
                        for key, more in zip(code.tolist(), n.tolist(), strict=True):
                            total[lang, key] = total.get((lang, key), 0) + more
        codes = np.array([key for _, key in total], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in total], pa.string()), pa.array(codes >> 20), pa.array(codes & 0xFFFFF), pa.array(list(total.values()), pa.int64())], names=["lang", "k", "cosine", "n"])
        give_back()

    def floors(table: pa.Table) -> pa.Table:
        k, cosine, n = (table.column(c).to_numpy() for c in ("k", "cosine", "n"))
        floor = []
        for top in range(len(LADDER)):
            low = top
            while n[(k >= low) & (k <= top)].sum() < 1000 and low:
                low -= 1
            own = np.flatnonzero((k >= low) & (k <= top))
            own = own[np.argsort(cosine[own])]
            until = np.cumsum(n[own])
            place = 0.001 * (until[-1] - 1) if len(own) else 0.0
            a, b = (cosine[own][np.searchsorted(until, x, "right")] if len(own) else 0 for x in (int(place), int(np.ceil(place))))
            floor.append(slack * float(a + (b - a) * (place - int(place))) / 65536)
        return pa.table({"lang": [table.column("lang")[0].as_py()], "floor": [floor]}, schema=pa.schema([("lang", pa.string()), ("floor", pa.list_(pa.float64()))]))

    measured = rows.mapInArrow(measure, "lang string, k long, cosine long, n long").groupBy("lang", "k", "cosine").agg(F.sum("n").alias("n"))
    floor_of = {r["lang"]: r["floor"] for r in measured.groupBy("lang").applyInArrow(floors, "lang string, floor array<double>").collect()}
    order = sorted(centroids)
    languages = [lang for lang, half in order for _ in centroids[lang, half]]
    return Centroids(languages, np.concatenate([centroids[key] for key in order]), idf, np.array([floor_of.get(lang, [0.0] * len(LADDER)) for lang in languages]))


def predict(docs: DataFrame, model: Centroids | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with lang_pred, score (cosine, 0 to 1) and rejected.

    One row for each row, repeated ones too; an empty table gives none. A text
    that is null or has no letter, and every text under a model without
    languages, gives ``und``, score 0, and is rejected. A text that is too far
    from all centroids keeps the nearest one's language and is rejected, unless
    it has fewer than about 16 letters: too few to judge by distance. Ties go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = schema_with(docs, keep, "lang_pred string, score double, rejected boolean")

    def run(batches):
        known = shared.value
        for some, data, offsets in doc_slices(batches, rows=ROWS):
            n = some.num_rows
            if known is None:
                lang, score, out = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
            else:
                counts = gram_counts(data, offsets)
                cosine = known.vectors(counts) @ known.matrix.T
                best = cosine.argmax(1)
                letters = has_letter(data, offsets)
                score = np.where(letters, np.clip(cosine[np.arange(n), best].astype(float), 0, 1), 0)
                lang = [known.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                size = length_class(counts.sum(1))
                out = ~letters | ((score < known.floor[best, np.maximum(size, 0)]) & (size >= 0))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(out)], names=[*keep, "lang_pred", "score", "rejected"])
        give_back()

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
