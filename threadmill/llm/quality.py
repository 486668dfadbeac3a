"""Operator 9, a quality classifier by Bradley-Terry pairwise ranking.

Texts are described by a dozen of ratios. All preference pairs (a text
labelled 1 over one labelled 0) give a linear score by logistic loss on the
difference of their features; a quantile of all training scores is the
threshold, and a logistic curve through it turns scores into numbers from 0 to
1. The sum over all pairs goes by bins of scores: rows of one bin, 1/32 wide,
meet the other label with the bin's mean score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_slices, owners, schema_with, word_hashes, words
from .components import written

THRESHOLD = 0.3
UNIT = 1024
STEP = 2.0**-5  # width of a bin of scores; bins beyond LAST are one
LAST = 4095
RUN = 16  # bins that share their sums of products, which only steer the steps
LIMIT = 127.0  # scores beyond are as good as equal

_CLASSES = np.zeros((5, 256), bool)  # upper, lower, digit, plain punctuation, other symbol
_CLASSES[0, 0x41:0x5B] = True
_CLASSES[1, 0x61:0x7B] = True
_CLASSES[2, 0x30:0x3A] = True
for _c in b".,;:'\"()-?":
    _CLASSES[3, _c] = True
_CLASSES[4, 0x21:0x7F] = True
_CLASSES[4] &= ~_CLASSES[:4].any(0)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x features; empty texts give a row of zeros but for the ratios of distinct things, which are 1."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)

    def per_doc(flag):
        total = np.concatenate(([0], np.cumsum(flag)))
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    upper, lower, digit, plain, symbol = (per_doc(c[data]) for c in _CLASSES)
    upper += per_doc(np.concatenate(([False], (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E))) if len(data) else data == 0)
    high = per_doc(data >= 0xC0)
    starts, ends, first = words(data, offsets)
    hashes, owner, n_words = word_hashes(data, starts, ends), owners(first), np.diff(first).astype(float)
    some = np.maximum(n_words, 1)
    at = lambda flag, own=owner: np.bincount(own[flag], minlength=n).astype(float)

    def distinct(keys, own):
        order = np.lexsort((keys, own))
        new = np.ones(len(keys), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (own[order][1:] != own[order][:-1])
        return np.bincount(own[order][new], minlength=n).astype(float)

    again = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    length = (ends - starts).astype(float)
    mean_length = np.bincount(owner, length, minlength=n) / some
    no_text = _no_letters(data, starts, ends)
    line_table = np.ones(256, bool)
    line_table[0x0A] = False
    l_starts, l_ends, l_first = words(data, offsets, line_table)
    l_owner, l_n = owners(l_first), np.maximum(np.diff(l_first), 1).astype(float)
    columns = [
        np.log1p(n_words),
        upper / np.maximum(upper + lower + high, 1),
        digit / size,
        plain / size,
        symbol / size,
        np.minimum(symbol / some, 3),
        np.where(n_words > 1, np.bincount(owner[1:][again], minlength=n) / np.maximum(n_words - 1, 1), 0),
        np.where(n_words > 0, distinct(hashes, owner) / some, 1),
        np.where(n_words > 0, distinct(hashes, owner) / some ** 0.85, 1),
        mean_length,
        np.sqrt(np.maximum(np.bincount(owner, length**2, minlength=n) / some - mean_length**2, 0)),
        at(no_text) / some,
        np.where(np.diff(l_first) > 0, distinct(word_hashes(data, l_starts, l_ends), l_owner) / l_n, 1),
        np.log1p(n_words / l_n),
    ]
    return np.stack(columns, axis=1)


def _no_letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    letters = np.concatenate(([0], np.cumsum(_CLASSES[0][data] | _CLASSES[1][data] | (data >= 0x80))))
    return letters[ends] == letters[starts]


@dataclass
class Ranking:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -5, 5)
        return np.concatenate((z, z * z), axis=1) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.threshold) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, n: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Newton's method on the logistic loss of rows that count ``n`` times, with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _whole(z: np.ndarray) -> np.ndarray:
    """z and its squares in whole 1024ths, so that sums are exact and the same in any order."""
    return np.rint(np.concatenate((z, z * z), axis=1) * UNIT)


def _pair_sums(whole: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (label, bin, i) and sums: for i = -1 the rows of a bin of scores and their sums, for others row i of the sums of products in a run of RUN bins."""
    bins = np.clip(np.rint(whole @ weights / (UNIT * STEP)), -LAST, LAST).astype(np.int64)
    keys, sums = [], []
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        own = own[np.argsort(bins[own], kind="stable")]
        x, at = whole[own], bins[own]
        start = np.flatnonzero(np.diff(at, prepend=-LAST - 1))
        if not len(start):
            continue
        keys.append(np.stack((np.full(len(start), label), at[start], np.full(len(start), -1)), axis=1))
        sums.append(np.column_stack((np.diff(start, append=len(at)), np.add.reduceat(x, start))))
        start = np.flatnonzero(np.diff(at // RUN, prepend=-LAST - 1))
        for low, high in zip(start.tolist(), [*start[1:].tolist(), len(at)]):
            d = x.shape[1]
            keys.append(np.stack((np.full(d, label), np.full(d, at[low] // RUN), np.arange(d)), axis=1))
            sums.append(np.column_stack((np.zeros(d), x[low:high].T @ x[low:high])))
    return np.concatenate(keys), np.concatenate(sums).astype(np.int64)


def _pair_step(keys: np.ndarray, sums: np.ndarray, weights: np.ndarray, pairs: float, ridge: float) -> np.ndarray:
    """Newton's step for the mean logistic loss of all pairs of unlike labels, taken ``pairs`` times, with a ridge."""
    n, s, mean, products, runs = {}, {}, {}, {}, {}
    for label in (0, 1):
        own = keys[:, 0] == label
        fine = np.flatnonzero(own & (keys[:, 2] < 0))
        n[label], s[label] = sums[fine, 0].astype(float), sums[fine, 1:] / UNIT
        mean[label] = s[label] @ weights / n[label]
        rows = np.flatnonzero(own & (keys[:, 2] >= 0))
        rows = rows[np.lexsort((keys[rows, 2], keys[rows, 1]))]
        d = len(weights)
        products[label] = sums[rows, 1:].reshape(-1, d, d) / UNIT**2
        runs[label] = np.searchsorted(keys[rows[::d], 1], keys[fine, 1] // RUN)
    towards, curve = {1: np.zeros(len(n[1])), 0: np.zeros(len(n[0]))}, {1: np.zeros(len(n[1])), 0: np.zeros(len(n[0]))}
    cross = np.zeros((len(weights), len(weights)))
    for low in range(0, len(n[1]), 256):
        part = slice(low, low + 256)
        wrong = 1 / (1 + np.exp(np.clip(mean[1][part, None] - mean[0], -500, 500)))
        bend = wrong * (1 - wrong)
        towards[1][part], curve[1][part] = wrong @ n[0], bend @ n[0]
        towards[0] += n[1][part] @ wrong
        curve[0] += n[1][part] @ bend
        cross += s[1][part].T @ bend @ s[0]
    gradient = towards[0] @ s[0] - towards[1] @ s[1]
    hessian = -cross - cross.T
    for label in (0, 1):
        count = len(products[label])
        each = np.bincount(runs[label], n[label] * curve[label], count) / np.bincount(runs[label], n[label], count)
        hessian += np.tensordot(each, products[label], 1)
    scale = pairs / (n[0].sum() * n[1].sum())
    return np.linalg.solve(scale * hessian + ridge * np.eye(len(weights)), scale * gradient + ridge * weights)


def _learn(centre: np.ndarray, spread: np.ndarray, total: Callable, pairs: float, ridge: float, rounds: int = 15) -> Ranking | None:
    """The model of all rows; ``total(f)`` gives the summed (keys, sums) of f(x, y) over all of them."""
    centre, spread = (np.asarray(v, np.float32).astype(float) for v in (centre, spread))  # rounded: the same whatever the order of the rows
    model = Ranking(centre, np.where(spread > 1e-9, spread, 1), np.zeros(2 * len(centre)), 0.0, 1.0)

    def whole(x):
        return _whole(np.clip((x - model.centre) / model.spread, -5, 5))

    for _ in range(rounds):
        weights = model.weights
        keys, sums = total(lambda x, y, weights=weights: _pair_sums(whole(x), y, weights))
        if len(np.unique(keys[:, 0])) < 2:
            return None
        step = _pair_step(keys, sums, weights, pairs, ridge)
        model.weights = weights - step
        if np.abs(step).max() < 1e-3:
            break

    def fixed(x):
        return np.rint(np.clip(model.raw(x), -LIMIT, LIMIT) * 2.0**20).astype(np.int64)

    def counts(keys):
        keys, n = np.unique(keys, axis=0, return_counts=True)
        return keys, n[:, None]

    keys, n = total(lambda x, y: counts(np.stack((y, fixed(x) >> 12, np.zeros(len(y), np.int64)), axis=1)))
    n = n[:, 0]
    order = np.argsort(keys[:, 1], kind="stable")
    until = np.cumsum(n[order])
    n_bad, n_all = int(n[keys[:, 0] == 0].sum()), int(n.sum())
    places = [n_bad - 1, n_bad]  # the quantile of the share of zeros lies between the rows of these ranks
    high = [int(keys[order, 1][np.searchsorted(until, k, "right")]) for k in places]

    def low_parts(x, y):
        value = fixed(x)
        value = value[np.isin(value >> 12, high)]
        return counts(np.stack((np.zeros(len(value), np.int64), value, np.zeros(len(value), np.int64)), axis=1))

    values, times = total(low_parts)
    by = np.argsort(values[:, 1])
    value, inside = values[by, 1], np.cumsum(times[by, 0])
    found = []
    for k, h in zip(places, high, strict=True):
        before = int(n[keys[:, 1] < h].sum()) - int(times[by, 0][(value >> 12) < h].sum())
        found.append(value[np.searchsorted(inside, k - before, "right")] / 2.0**20)
    model.threshold = float(found[0] + (found[1] - found[0]) * (1 - n_bad / n_all))
    centred = np.stack(((keys[:, 1] + 0.5) / 256 - model.threshold, np.ones(len(keys))), axis=1)
    model.slope = float(max(_logistic(centred, keys[:, 0].astype(float), 1.0, n)[0], 1e-3))
    return model


def fit_ranking(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, ridge: float = 5.0) -> Ranking | None:
    """Bradley-Terry weights from all pairs of unlike labels, as if there were ``pairs`` (against the ridge); None unless both labels occur."""
    if not len(x):
        return None
    return _learn(x.mean(0), x.std(0), lambda f: f(x, y), pairs, ridge)


def fit(docs: DataFrame, labels: DataFrame, train: Column, pairs: int = 60_000, ridge: float = 5.0) -> Ranking | None:
    """Learns from all labelled rows where ``train`` holds, and all pairs of them.

    Labels that are null or not 0 or 1 are ignored; if a document has several,
    the lowest counts. Repeated documents count as often as they stand; no
    labels, or labels of one kind only, give no model. Features of all texts
    meet the labels, so no text is shuffled; those of labelled rows are kept
    in the checkpoint folder, and each round sums them on the executors.
    """
    known = labels.where(train & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("long").alias("y"))

    def describe(batches):
        for some, data, offsets in doc_slices(batches):
            x = features(data, offsets)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), rows], names=["doc_id", "x"])

    described = docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(describe, schema_with(docs, ("doc_id",), "x array<double>"))
    rows = written(described.join(known, "doc_id").select("y", "x"), records=10_000)
    d = len(features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0])
    got = rows.agg(*(f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(d))).first()
    if got[0] is None:
        return None

    def total(f):
        def run(batches):
            keys, sums = [], []
            for batch in batches:
                if batch.num_rows:
                    k, s = f(batch.column("x").flatten().to_numpy().reshape(-1, d), batch.column("y").to_numpy())
                    keys.append(k)
                    sums.append(s)
            if keys and sum(map(len, keys)):
                keys, owner = np.unique(np.concatenate(keys), axis=0, return_inverse=True)
                out = np.zeros((len(keys), sums[0].shape[1]), np.int64)
                np.add.at(out, owner.ravel(), np.concatenate(sums))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*keys.T.copy(), *out.T.copy())], names=names)

        width = f(np.zeros((1, d)), np.zeros(1, np.int64))[1].shape[1]
        names = ["y", "bin", "i", *(f"s{k}" for k in range(width))]
        table = rows.mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy(*names[:3]).agg(*(F.sum(c).alias(c) for c in names[3:])).toArrow()
        out = np.stack([table.column(c).to_numpy() for c in names], axis=1) if table.num_rows else np.zeros((0, len(names)), np.int64)
        out = out[np.lexsort(out[:, 2::-1].T)]
        return out[:, :3], out[:, 3:]

    return _learn(np.array(got[:d]), np.array(got[d:]), total, pairs, ridge)


def score(docs: DataFrame, model: Ranking | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with score (0 to 1) and predicted (1 if score >= 0.3).

    Null and empty texts get the score of a text without words. Without a
    model (labels of both kinds never seen) every score is 0.5. Equal texts
    have equal scores, repeated rows are scored each, and an empty table gives
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = schema_with(docs, keep, "score double, predicted int")

    def run(batches):
        known = shared.value
        for some, data, offsets in doc_slices(batches):
            out = np.full(some.num_rows, 0.5) if known is None else known.score(features(data, offsets))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
