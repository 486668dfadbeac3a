"""Operator 2, BPE encoding and decoding by forced-boundary splitting.

A merge can only join two neighbouring symbols if their last and first bytes
stand side by side inside some vocabulary token. Byte pairs that occur inside
no token are therefore certain cuts: the fragments between them are encoded
independently, and the ids are concatenated. Fragments repeat far more often
than texts, so each worker keeps a bounded table of fragments it has encoded.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models

from .common import KEPT, doc_slices, forget_tables, give_back, schema_with

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
MAX_ENTRIES = 150_000  # words of each of two generations, and fragments


@lru_cache(1)
def disputed() -> regex.Pattern:
    """Characters that are letters or numbers in one version of Unicode and not in another: the installed libraries' tables are of several."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = set()
    for kind in "LN":
        out |= set(regex.findall(rf"\p{{{kind}}}", every)) ^ {c for c in every if unicodedata.category(c)[0] == kind}
    return regex.compile("[" + "".join(map(regex.escape, sorted(out))) + "]") if out else regex.compile(r"(?!)")


@lru_cache(1)
def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class ForcedBoundaryBpe:
    """Encoder for a byte-level BPE file with an end-of-word suffix.

    ``definition`` is the text of a tokenizers JSON file: NFC, white space
    runs to one space, lower case; words by its split pattern; bytes; merges
    by rank with the suffix glued to a word's last byte; special tokens are
    recognised in the raw text. The merges inside a fragment are the
    library's; one model knows the suffix (a word's last fragment), the other
    does not (the fragments before it). Without ``texts`` no decoded texts are
    kept, which halves the tables, and ``digests`` cannot be asked for.
    """

    def __init__(self, definition: str, texts: bool = True):
        self.decodes = texts
        spec = json.loads(definition)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.last = models.BPE(vocab=self.vocab, merges=merges, end_of_word_suffix=self.suffix or None)
        self.inner = models.BPE(vocab=self.vocab, merges=merges)
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.word = regex.compile(splits[0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.any_special = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        letters = byte_letters()
        self.letters = dict(letters)
        self.definition, self.library = definition, None  # the whole tokenizer is made only for texts that need its table
        bytes_of = {c: b for b, c in letters.items()}
        #: joinable[0][a, b]: a and b stand side by side inside a token; joinable[1]: with the suffix glued to b.
        self.joinable = np.zeros((2, 256, 256), bool)
        for token in self.vocab:
            final = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
            body = [bytes_of[c] for c in (token[: -len(self.suffix)] if final else token) if c in bytes_of]
            for i in range(1, len(body)):
                self.joinable[int(final and i == len(body) - 1), body[i - 1], body[i]] = True
        if not self.suffix:
            self.joinable[1] = self.joinable[0]
        self.pieces = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.id_bytes = {i: i.to_bytes(4, "little") for i in self.pieces}
        self.forget()

    def fragments_of(self, some: list[str]) -> tuple[list[str], list[int]]:
        """The words' fragments, cut wherever two bytes stand side by side in no token, and how many each word has; all but a word's last end in a space."""
        raw = [w.encode() for w in some]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        final = np.zeros(len(data), np.int8)
        final[ends - 1] = 1
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = ~self.joinable[final[1:], data[:-1], data[1:]]
        cut[ends] = True
        cuts = np.flatnonzero(cut)
        last = np.searchsorted(cuts, ends) - 1  # each word's last fragment
        text = data.tobytes().decode("latin-1").translate(self.letters)
        at = cuts.tolist()
        flat = [text[a:b] for a, b in zip(at, at[1:])]
        inner = np.ones(len(flat), bool)
        inner[last] = False
        for i in np.flatnonzero(inner).tolist():
            flat[i] += " "
        return flat, np.diff(last, prepend=-1).tolist()

    def encode_fragments(self, some: list[str]) -> list[tuple[bytes, str]]:
        """Each fragment's ids as little-endian bytes and its decoded text, from the table or the model."""
        known = self.fragments
        if len(known) > MAX_ENTRIES:
            known.clear()
        inner, last, id_bytes, pieces = self.inner.tokenize, self.last.tokenize, self.id_bytes, self.pieces
        for f in set(some).difference(known):
            ids = [t.id for t in (inner(f[:-1]) if f[-1] == " " else last(f))]
            known[f] = b"".join([id_bytes[i] for i in ids]), " ".join([pieces[i] for i in ids]) if self.decodes else ""
        return [known[f] for f in some]

    def normalise(self, text: str) -> str:
        return text.lower() if text.isascii() else _lower(unicodedata.normalize("NFC", text))

    def words_of(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if disputed().search(text):  # the library's own table decides
                bytes_of = {c: b for b, c in self.letters.items()}
                library = self.library = self.library or Tokenizer.from_str(self.definition)
                pieces = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
                return [bytes(bytes_of[c] for c in piece).decode() for piece, _ in pieces]
        return self.word.findall(self.normalise(text))

    def segments(self, text: str) -> list[str | int]:
        """The text's words, and the ids of special tokens in it."""
        if self.any_special is None or not self.any_special.search(text):
            return self.words_of(text)
        out: list[str | int] = []
        for i, part in enumerate(self.any_special.split(text)):
            if i % 2:
                out.append(self.special[part])
            else:
                out += self.words_of(part)
        return out

    def learn(self, found: list[list[str | int]]) -> None:
        """Brings all words of ``found`` into the tables; words not used for a generation are forgotten."""
        if len(self.ids) > MAX_ENTRIES:
            self.ids, self.texts, self.old_ids, self.old_texts = {}, {}, self.ids, self.texts
        ids, texts = self.ids, self.texts
        missing = set().union(*found).difference(ids)
        again = [s for s in missing if s in self.old_ids]
        ids.update((s, self.old_ids[s]) for s in again)
        if self.decodes:
            texts.update((s, self.old_texts[s]) for s in again)
        missing.difference_update(again)
        for s in [s for s in missing if s.__class__ is int]:  # special tokens
            ids[s] = self.id_bytes[s]
            if self.decodes:
                texts[s] = self.pieces[s]
            missing.remove(s)
        if not missing:
            return
        some = list(missing)
        flat, counts = self.fragments_of(some)
        done, at = self.encode_fragments(flat), 0
        for s, n in zip(some, counts, strict=True):
            parts = done[at : at + n]
            at += n
            ids[s] = parts[0][0] if n == 1 else b"".join([p[0] for p in parts])
            if self.decodes:
                texts[s] = parts[0][1] if n == 1 else " ".join([p[1] for p in parts if p[1]])

    def forget(self) -> None:
        """Empties the tables; workers live on after a task, and other operators need the memory."""
        self.ids: dict[str | int, bytes] = {}
        self.texts: dict[str | int, str] = {}
        self.old_ids: dict[str | int, bytes] = {}
        self.old_texts: dict[str | int, str] = {}
        self.fragments: dict[str, tuple[bytes, str]] = {}

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        found = [self.segments(t) for t in texts]
        self.learn(found)
        return [np.frombuffer(b"".join(map(self.ids.__getitem__, some)), "<u4") for some in found]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> str:
        """As the library does for a file without a decoder: the pieces joined by one space."""
        return " ".join([self.pieces[i] for i in ids if i in self.pieces])

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text the number of ids, and the digests of the ids and of their decoding."""
        found = [self.segments(t) for t in texts]
        self.learn(found)
        for some in found:
            ids = b"".join(map(self.ids.__getitem__, some))
            decoded = " ".join(filter(None, map(self.texts.__getitem__, some)))
            yield len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    def digest(self, text: str) -> tuple[int, str, str]:
        return next(self.digests([text]))


def _lower(text: str) -> str:
    """Code point by code point, without the rule for a final sigma."""
    return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()


_made: dict[str, ForcedBoundaryBpe] = {}
KEPT.append(_made)


def tokenizer_of(definition: str, texts: bool = True) -> ForcedBoundaryBpe:
    """One encoder per worker, definition and need of decoded texts."""
    key = f"{hashlib.sha256(definition.encode()).hexdigest()} {texts}"
    if key not in _made:
        forget_tables()  # a step that begins here needs none of an earlier one's
        _made[key] = ForcedBoundaryBpe(definition, texts)
        give_back()
    return _made[key]


def load(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode_digest(docs: DataFrame, definition: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens and the SHA-256 of the ids (little-endian 32-bit) and of the decoded text.

    A null text counts as empty: no ids, and the digest of nothing. Repeated
    rows and equal ids give a row each, an empty table none; texts of any
    length are encoded whole. The definition (a few MB, fixed by the
    vocabulary) is broadcast once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches):
        bpe = tokenizer_of(shared.value)
        for batch, _, _ in doc_slices(batches):
            n, ids, decoded = zip(*bpe.digests([t or "" for t in batch.column("text").to_pylist()]), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def encode(docs: DataFrame, definition: str) -> DataFrame:
    """The rows of ``docs`` with a column ids (array of int): the encoding of each text, empty for null and empty ones.

    All rows and other columns stay as they are, repeated rows too; a column
    that was called ids is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    rest = [c for c in docs.columns if c != "ids"]
    schema = schema_with(docs, rest, "ids array<int>")

    def run(batches):
        bpe = tokenizer_of(shared.value, texts=False)
        for batch, _, _ in doc_slices(batches):
            ids = bpe.encode_all([t or "" for t in batch.column("text").to_pylist()])
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            packed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], names=[*rest, "ids"])
        bpe.forget()
        give_back()

    return docs.select(*rest).mapInArrow(run, schema)


def decode(frame: DataFrame, definition: str) -> DataFrame:
    """The rows of ``frame`` with a column decoded: the text of their ids; null ids give null."""
    shared = frame.sparkSession.sparkContext.broadcast(definition)
    rest = [c for c in frame.columns if c != "decoded"]
    schema = schema_with(frame, rest, "decoded string")

    def run(batches):
        bpe = tokenizer_of(shared.value)
        for batch in batches:
            out = [None if not x.is_valid else bpe.decode(x.as_py()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*rest, "decoded"])

    return frame.select(*rest).mapInArrow(run, schema)
