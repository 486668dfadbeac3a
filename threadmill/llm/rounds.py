"""Rounds of questions between batches of documents and shards of keys.

Documents are dealt once into batches of a bounded size, as compressed
parcels. In a round every batch sends each shard that it has keys for one
packed array, the shard answers every array in its own order, and the answers
come back to the batch. A key that many documents share reaches a shard at
most once from each batch, so no task ever gathers the rows of one key.
Parcels and answers are dealt by batch in the same way, so that all rounds are
one plan in which each exchange is written once and reused.

The number of letters is at most batches x shards. Both grow with the root of
the input (a batch's size grows with it too, up to ``MOST`` bytes), so letters
grow in proportion to the input; nothing is sent where there are no keys.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import U64, free_name, give_back

MAIL = "shard int, batch int, data binary"
MAIL_ARROW = pa.schema([("shard", pa.int32()), ("batch", pa.int32()), ("data", pa.binary())])
#: kind 0 is a parcel of documents, k > 0 an answer of round k by shard ``peer``, -k what all batches are told of round k.
POST = "batch int, kind int, peer int, data binary"
POST_ARROW = pa.schema([("batch", pa.int32()), ("kind", pa.int32()), ("peer", pa.int32()), ("data", pa.binary())])
HELD = 8 << 20  # bytes of rows that a task deals at once
REFERENCE = 1 << 30  # input from which batches grow
MOST = 128 << 20  # the largest size that batches grow to
TURN = 0x9E3779B97F4A7C15  # where the next copy of a row goes


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed binary; the bytes of wide numbers are stored place by place, so that alike ones stand together."""
    head, parts = [], []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head.append([name, a.dtype.str, len(a)])
        parts.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if a.dtype.itemsize > 1 and len(a) else a.tobytes())
    body = b"".join(parts)
    title = json.dumps([head, len(body)], separators=(",", ":")).encode()
    return len(title).to_bytes(4, "little") + title + pa.compress(body, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    size = int.from_bytes(blob[:4], "little")
    head, length = json.loads(blob[4 : 4 + size])
    body = np.frombuffer(pa.decompress(blob[4 + size :], length, codec="zstd", asbytes=True), np.uint8)
    out, at = {}, 0
    for name, kind, n in head:
        kind = np.dtype(kind)
        part = body[at : at + n * kind.itemsize]
        at += n * kind.itemsize
        out[name] = np.ascontiguousarray(part.reshape(kind.itemsize, n).T).view(kind)[:, 0] if kind.itemsize > 1 and n else part.view(kind)
    return out


def pack_rows(parts: list[pa.RecordBatch]) -> bytes:
    table = pa.Table.from_batches(parts).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    raw = sink.getvalue()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def unpack_rows(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd")).read_all()


def shard_cuts(ordered: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range begins in sorted 64-bit keys (shards+1 entries)."""
    edges = np.array([(i << 64) // shards for i in range(1, shards)], U64)
    return np.concatenate(([0], np.searchsorted(ordered, edges), [len(ordered)])).astype(np.int64)


def filled(cuts: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(shard, its part of the keys) of the shards that have any."""
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        yield s, slice(int(cuts[s]), int(cuts[s + 1]))


def gathered(got: list[tuple[int, dict[str, np.ndarray]]], cuts: np.ndarray, name: str, kind=np.int64) -> np.ndarray:
    """The answers' arrays of that name at the places of their shards' keys."""
    out = np.zeros(int(cuts[-1]), kind)
    for s, x in got:
        low, high = int(cuts[s]), int(cuts[s + 1])
        out[low:high] = np.unpackbits(x[name], count=high - low) if kind is bool else x[name]
    return out


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _letters(numbers: list[int], data: list[bytes]) -> list[tuple[int, dict[str, np.ndarray]]]:
    return sorted(((k, unpack(d)) for k, d in zip(numbers, data, strict=True)), key=lambda x: x[0])


class Rounds:
    """docs (with doc_id and text) dealt into batches of about ``batch_bytes``, times the root of the input in ``reference``."""

    def __init__(self, docs: DataFrame, batch_bytes: int = 2 << 20, least: int = 24, reference: int = REFERENCE):
        total, self.rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
        self.bytes = total
        size = max(batch_bytes, min(MOST, int(batch_bytes * math.sqrt(total / reference))))
        self.batches = batches = max(least, -(-total // size))
        self.shards = max(16, self.batches // 4)
        self.tasks = max(8, self.batches // 3)
        key = free_name("key", docs.columns)

        def deal(frames):
            """Equal rows go to batch after batch, however many they are."""
            seen: dict[int, int] = {}
            pending: dict[int, list[pa.RecordBatch]] = {}
            held = 0
            for frame in frames:
                keys = frame.column(key).to_numpy()
                turn = []
                for k in keys.tolist():
                    turn.append(n := seen.get(k, 0))
                    seen[k] = n + 1
                number = ((keys.view(U64) + np.array(turn, U64) * U64(TURN)) % U64(batches)).astype(np.int64)
                order = np.argsort(number, kind="stable")
                rows = frame.select([c for c in frame.schema.names if c != key]).take(pa.array(order))
                number = number[order]
                heads = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(number) else number
                for low, high in zip(heads.tolist(), [*heads[1:].tolist(), len(number)]):
                    pending.setdefault(int(number[low]), []).append(rows.slice(low, high - low))
                held += rows.nbytes
                if held > HELD:
                    yield from parcels(pending)
                    pending, held = {}, 0
            yield from parcels(pending)
            pending.clear()
            give_back()

        def parcels(pending):
            rows, size = [], 0
            for number, parts in sorted(pending.items()):
                rows.append((number, 0, 0, pack_rows(parts)))
                size += len(rows[-1][3])
                if size > 8 << 20:
                    yield from _table(POST_ARROW, rows).to_batches()
                    rows, size = [], 0
            if rows:
                yield from _table(POST_ARROW, rows).to_batches()

        keyed = docs.withColumn(key, F.xxhash64("doc_id", F.xxhash64("text")))
        self.parcels = self.by_batch(keyed.mapInArrow(deal, POST))

    def by_batch(self, post: DataFrame) -> DataFrame:
        return post.repartition(self.tasks, "batch")

    def _grouped(self, run: Callable[[int, pa.Table, dict], pa.Table], post: tuple[DataFrame, ...], schema) -> DataFrame:
        """run(batch, docs, what came by kind) for each batch."""
        every = self.parcels
        for p in post:
            every = every.unionByName(p)
        empty = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).empty_table()

        def open_post(table):
            kind, peer, data = (table.column(c).to_pylist() for c in ("kind", "peer", "data"))
            parts = sorted(d for k, d in zip(kind, data, strict=True) if k == 0)
            if not parts:  # the shards' reports, and letters to all where a batch has no documents
                return empty
            docs = pa.concat_tables([unpack_rows(d) for d in parts]).combine_chunks()
            came = {}
            for k in {k for k in kind if k}:
                own = [i for i, x in enumerate(kind) if x == k]
                came[k] = _letters([peer[i] for i in own], [data[i] for i in own])
            out = run(table.column("batch")[0].as_py(), docs, came)
            del docs, came, data
            give_back()
            return out

        return every.groupBy("batch").applyInArrow(open_post, schema)

    def ask(self, make: Callable[[pa.Table, dict], Iterator[tuple[int, bytes]]], *post: DataFrame) -> DataFrame:
        """make(docs, what came) gives (shard, data) for shards."""

        def run(number, docs, came):
            return _table(MAIL_ARROW, [(shard, number, data) for shard, data in make(docs, came)])

        return self._grouped(run, post, MAIL)

    def answer(self, kind: int, sent: DataFrame, reply: Callable[[list], list[bytes]]) -> DataFrame:
        """reply(list of (batch, arrays)) gives one binary for each, in that order, and after them one for ``totals`` if there are more."""

        def run(table):
            shard = table.column("shard")[0].as_py()
            got = _letters(table.column("batch").to_pylist(), table.column("data").to_pylist())
            answers = reply(got)
            rows = [(batch, kind, shard, data) for (batch, _), data in zip(got, answers)]
            count = len(got)
            del got
            give_back()
            return _table(POST_ARROW, rows + [(-1, kind, shard, data) for data in answers[count:]])

        return self.by_batch(sent.repartition(max(8, self.shards // 2), "shard").groupBy("shard").applyInArrow(run, POST))

    def totals(self, kind: int, answered: DataFrame, names: tuple[str, ...]) -> DataFrame:
        """A letter to all batches (kind -k): the sums over all shards of the arrays that the shards report after their answers."""

        def partial(batches):
            sums: dict[str, np.ndarray] = {}
            for b in batches:
                for number, data in zip(b.column("batch").to_pylist(), b.column("data")):
                    if number < 0:
                        x = unpack(data.as_py())
                        sums = {n: sums.get(n, 0) + x[n].astype(np.int64) for n in names}
            flat = [(n, i, v) for n, a in sums.items() for i, v in enumerate(a.tolist())]
            columns = zip(*flat, strict=True) if flat else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64()))], names=["name", "i", "v"])

        def letter(batches):
            rows = sorted((n, i, v) for b in batches for n, i, v in zip(*(b.column(c).to_pylist() for c in ("name", "i", "v"))))
            sums = {n: np.array([v for m, _, v in rows if m == n], np.int64) for n in names}
            yield from _table(POST_ARROW, [(-1, -kind, 0, pack(**sums))]).to_batches()

        # all columns are read, so that the exchange of the answers stays the one that the batches read
        summed = answered.mapInArrow(partial, "name string, i int, v bigint").groupBy("name", "i").agg(F.sum("v").alias("v")).coalesce(1)
        told = summed.mapInArrow(letter, POST)
        return self.by_batch(told.select(F.explode(F.sequence(F.lit(0), F.lit(self.batches - 1))).alias("batch"), "kind", "peer", "data"))

    def rows_of(self, make: Callable[[int, pa.Table, dict], pa.Table], schema, *post: DataFrame) -> DataFrame:
        """make(batch, docs, what came) gives rows of a batch."""
        return self._grouped(make, post, schema)

    def letters(self, kind: int, rows: DataFrame, make: Callable[[pa.Table], bytes]) -> DataFrame:
        """Letters of that kind to the batches: make(the rows of a batch) of rows with a column ``batch``."""

        def run(table):
            return _table(POST_ARROW, [(table.column("batch")[0].as_py(), kind, 0, make(table))])

        return self.by_batch(rows.repartition(self.tasks, "batch").groupBy("batch").applyInArrow(run, POST))

    def finish(self, make: Callable[[pa.Table, dict], pa.Table], schema, *post: DataFrame) -> DataFrame:
        """make(docs, what came) gives the result rows of a batch."""
        return self._grouped(lambda _, docs, came: make(docs, came), post, schema)
