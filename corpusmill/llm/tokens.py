"""Encoding a corpus with a public byte-level BPE vocabulary.

The vocabulary is serialised into a sentencepiece BPE model by hand: pieces are the
vocabulary's byte-mapped strings in order of id, each scored by its negative rank, so
the merges happen in the order of the ranks; the normaliser is the identity. Texts are
cut into the vocabulary's pre-tokens, which are byte-mapped and encoded on their own.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

#: Default place of the vocabulary; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of text whose ids a worker remembers (emptied beyond), and their greatest length.
CACHE, CACHED_CHARS = 300_000, 48


def byte_map() -> list[str]:
    """The printable character that stands for each byte: itself if it's printable, else the next from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer: bytes, a float of 32 bits, or a number."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(pieces: list[str]) -> bytes:
    """A BPE model whose ids are the places of the pieces; one id past them is the unknown piece."""
    body = b"".join(_field(1, _field(1, p.encode()) + _field(2, -float(i)) + _field(3, 1)) for i, p in enumerate(pieces))
    body += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + b"".join(_field(k, -1) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return body + _field(2, trainer) + _field(3, normalizer)


def load_pieces(path: str) -> list[str]:
    """The byte-mapped pieces of a vocabulary file, by id. Ids must be 0, 1, 2 and so on."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    pieces = sorted(vocab, key=vocab.get)
    if [vocab[p] for p in pieces] != list(range(len(pieces))):
        raise ValueError("the vocabulary's ids have gaps")
    return pieces


class Codec:
    """Encodes and decodes texts; one for each worker."""

    def __init__(self, model: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(PATTERN)
        chars = byte_map()
        self.table = {b: c for b, c in enumerate(chars)}
        self.bytes = {c: b for b, c in enumerate(chars)}
        self.cache: dict[str, tuple[int, ...]] = {}

    def _encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin and end where pre-tokens do."""
        tokens: list[str] = []
        counts = []
        for t in texts:
            found = self.pattern.findall(t)
            counts.append(len(found))
            tokens += [x.encode("utf-8").decode("latin-1").translate(self.table) for x in found]
        ids = self.sp.encode(tokens, out_type=int, num_threads=1)
        out, at = [], 0
        for n in counts:
            out.append([i for x in ids[at : at + n] for i in x])
            at += n
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; none for an empty or null one.

        A single space between characters that aren't white space always begins a pre-token, so texts
        with no other spaces are cut there, and the pieces' ids are remembered."""
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        plan: list[list[str] | None] = []
        new: dict[str, None] = {}
        whole: list[str] = []
        for t in texts:
            if not t:
                plan.append([])
                continue
            if not t.isascii() or "  " in t or " \n" in t or "\n " in t or t[0] == " " or t[-1] == " " or any(c in t for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"):
                plan.append(None)
                whole.append(t)
                continue
            pieces = t.replace(" ", "\0 ").split("\0") if "\0" not in t else None
            plan.append(pieces)
            if pieces is None:
                whole.append(t)
            else:
                new.update(dict.fromkeys(p for p in pieces if p not in cache))
        fresh = dict(zip(new, map(tuple, self._encode(list(new))))) if new else {}
        cache.update((p, x) for p, x in fresh.items() if len(p) <= CACHED_CHARS)
        long = {p: x for p, x in fresh.items() if len(p) > CACHED_CHARS}
        direct = iter(self._encode(whole) if whole else [])
        out = []
        for pieces in plan:
            if pieces is None:
                out.append(next(direct))
                continue
            ids: list[int] = []
            for p in pieces:
                ids += cache[p] if p in cache else long[p]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, by the inverse of the byte map. Ids that cut a character give U+FFFD."""
        text = "".join(map(self.sp.id_to_piece, ids))
        return bytes(self.bytes[c] for c in text).decode("utf-8", "replace")


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """key and ids (array of int) of every row: whole texts, special tokens' strings as ordinary text.

    Null and empty texts have the empty array; repeated rows stay; other columns aren't read. Nothing is shuffled. The driver reads the
    vocabulary; the model made from it, under a megabyte, is sent to the workers.
    """
    model = df.sparkSession.sparkContext.broadcast(sentencepiece_model(load_pieces(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                ids = codec.encode(part.column(1).to_pylist())
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["key", "ids"])

    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, ids array<int>")
