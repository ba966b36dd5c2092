"""Byte-level BPE encoding and decoding with a sentencepiece model made from a rank file.

A rank file lists byte strings by rank; the merge of lowest rank goes first, the leftmost
of equal ones. A sentencepiece BPE model does the same for pieces of the highest score, so
that the vocabulary is serialised directly as such a model: each byte is written as one
printable character, a piece's score is its negative rank, and normalising is the
identity. Which vocabulary strings the merges don't reach is found out once, on the
driver; they are tokens by themselves, as a whole pre-token that has a rank always is.
Texts are split into pre-tokens by the pattern; distinct ones are encoded by the model
and remembered in the worker, in a table of a bounded number of bytes. Decoding is the
inverse mapping, from an id to its piece and from a piece's characters to bytes.

Libraries know different versions of Unicode. Characters that the pattern's library takes
for another class than the library that the ranks were made for are found out on the
driver; where a text holds one, it is split with stand-ins of the right class in place.

Defined results: a null or empty text has no ids; ids of null decode to no bytes, and
ids that hold a null or a number without rank decode to null; texts are never cut and rows
that repeat an id are encoded each on their own; an empty table gives an empty result.
Only the named columns are looked at.
"""

from __future__ import annotations

import base64
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardline.llm.common import Memo
from shardline.session import ship_package

ROWS = 128
#: Field numbers and enumerated values of the sentencepiece model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE, UNKNOWN = 1, 2, 3, 2
MODEL_TYPE, BPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 2, 4, 40, 41, 42, 43
NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5
UNKNOWN_PIECE = ""
#: One character per byte: 256 neighbouring letters, none of them a space mark.
FIRST = 0x4E00
_CHARS = {b: chr(FIRST + b) for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file (base64, blank, rank), by rank."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(word) for word, rank in map(bytes.split, filter(bytes.strip, f))}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks are not 0, 1, 2, ...")
    return [found[i] for i in range(len(found))]


def as_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_CHARS)


def as_bytes(piece: str) -> bytes:
    return bytes(ord(c) - FIRST for c in piece)


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(tag: int, n: int) -> bytes:
    return _varint(tag << 3) + _varint(n)


def _block(tag: int, data: bytes) -> bytes:
    return _varint(tag << 3 | 2) + _varint(len(data)) + data


def sentencepiece_model(ranks: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; the unknown piece, which no
    text meets, comes behind them."""
    pieces = [_block(PIECE_TEXT, as_chars(word).encode()) + _varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", -float(i))
              for i, word in enumerate(ranks)]
    pieces.append(_block(PIECE_TEXT, UNKNOWN_PIECE.encode()) + _varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", 0.0)
                  + _number(PIECE_TYPE, UNKNOWN))
    trainer = b"".join(_number(k, v) for k, v in (
        (MODEL_TYPE, BPE), (VOCAB_SIZE, len(pieces)), (UNK_ID, len(ranks)), (BOS_ID, -1), (EOS_ID, -1), (PAD_ID, -1)))
    identity = _block(NAME, b"identity") + b"".join(
        _number(k, 0) for k in (ADD_DUMMY_PREFIX, REMOVE_EXTRA_SPACES, ESCAPE_SPACES))
    return b"".join(_block(PIECES, p) for p in pieces) + _block(TRAINER, trainer) + _block(NORMALIZER, identity)


def library_class(pattern: str) -> set[str]:
    """The characters that the ranks' own library finds by a class of the pattern."""
    import tiktoken

    lone = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)},
                             special_tokens={})
    found = set()
    for lo in range(0, 0x110000, 1 << 12):
        part = "".join(map(chr, (c for c in range(lo, lo + (1 << 12)) if not 0xD800 <= c < 0xE000)))
        found.update(lone.decode_bytes(lone.encode_ordinary(part)).decode())
    return found


def stand_ins() -> dict[int, str]:
    """Characters of which the two libraries think differently, and what to take instead."""
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    out = {}
    own = {k: library_class(k) for k in (r"\p{L}", r"\p{N}", r"\s")}
    here = {k: set(regex.findall(k, every)) for k in own}
    for c in set().union(*(own[k] ^ here[k] for k in own)):
        kind = next((k for k in own if c in own[k]), None)
        out[ord(c)] = {r"\p{L}": "a", r"\p{N}": "0", r"\s": "\t", None: "#"}[kind]
    return out


@dataclass
class Codec:
    """What a worker needs to encode and decode; made on the driver by :func:`codec`."""

    ranks: list[bytes]
    model: bytes
    pattern: str
    whole: dict[str, int]  # pre-tokens with a rank that merging doesn't reach
    odd: dict[int, str] = field(default_factory=dict)

    def open(self) -> "ByteBpe":
        return ByteBpe(self)


class ByteBpe:
    """Encoder and decoder in a worker."""

    def __init__(self, codec: Codec):
        import sentencepiece

        self.codec, self.known = codec, Memo(48 << 20)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=codec.model)
        self.split = regex.compile(codec.pattern).findall
        self.spans = regex.compile(codec.pattern).finditer
        self.odd = frozenset(map(chr, codec.odd))
        self.may_be_odd = re.compile(f"[{min(self.odd, default=chr(0x10FFFF))}-\U0010FFFF]").search

    def pre_tokens(self, text: str) -> list[str]:
        if not text.isascii() and self.may_be_odd(text) and not self.odd.isdisjoint(text):
            return [text[m.start():m.end()] for m in self.spans(text.translate(self.codec.odd))]
        return self.split(text)

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        rest = [p for p in parts if p not in self.codec.whole]
        found = self.model.encode([as_chars(p.encode()) for p in rest], num_threads=1) if rest else []
        new = {p: struct.pack(f"<{len(ids)}I", *ids) for p, ids in zip(rest, found)}
        return new | {p: struct.pack("<I", self.codec.whole[p]) for p in parts if p in self.codec.whole}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as little-endian unsigned 32-bit numbers."""
        split = [self.pre_tokens(t) for t in texts]
        known = self.known.look_up(set().union(*split), self._learn)
        return [b"".join(map(known.__getitem__, parts)) for parts in split]

    def decode(self, ids) -> bytes | None:
        """The bytes of an array of ids: every id's piece, every character's byte."""
        try:
            return b"".join(map(self.bytes_of, ids))
        except (IndexError, TypeError):
            return None

    def bytes_of(self, i: int) -> bytes:
        if i < 0:
            raise IndexError(i)
        return self.pieces[i]

    @property
    def pieces(self) -> list[bytes]:
        found = self.__dict__.get("_pieces")
        if found is None:
            found = self.__dict__["_pieces"] = [as_bytes(self.model.id_to_piece(i)) for i in range(len(self.codec.ranks))]
        return found


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, with what can be proved of it offline."""
    ranks = read_ranks(path)
    made = Codec(ranks, sentencepiece_model(ranks), pattern, {}, stand_ins())
    model = made.open().model
    for lo in range(0, len(ranks), 4096):
        for i, ids in enumerate(model.encode([as_chars(r) for r in ranks[lo:lo + 4096]], num_threads=1), lo):
            if ids != [i]:
                try:
                    made.whole[ranks[i].decode()] = i
                except UnicodeDecodeError:
                    continue  # no text's pre-token
    return made


def default_codec(ranks: str = "byte_bpe_50k.tiktoken") -> Codec:
    import public_tokenizers

    return codec(public_tokenizers.path(ranks), public_tokenizers.PATTERN)


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) // 4 for p in parts])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _in_workers(df: DataFrame, made: Codec, id_col: str, value_col: str, value: str, work, schema: str) -> DataFrame:
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(made)  # as large as the vocabulary

    def run(batches):
        bpe = shared.value.open()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield work(bpe, batch.column(0).slice(at, ROWS), batch.column(1).slice(at, ROWS))

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(value_col).alias(value)).mapInArrow(run, f"doc_id {kind}, {schema}")


def encode(df: DataFrame, made: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every row."""
    def work(bpe, ids, texts):
        return pa.RecordBatch.from_arrays([ids, _lists(bpe.encode([t or "" for t in texts.to_pylist()]))], ["doc_id", "ids"])

    return _in_workers(df, made, id_col, text_col, "text", work, "ids array<int>")


def decode(df: DataFrame, made: Codec, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded of every row of ids."""
    def work(bpe, ids, lists):
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([bpe.decode(x or []) for x in lists.to_pylist()], pa.binary())], ["doc_id", "decoded"])

    return _in_workers(df, made, id_col, ids_col, "ids", work, "decoded binary")


def round_trip(df: DataFrame, made: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded of every row: both ways in one pass over the texts."""
    def work(bpe, ids, texts):
        coded = bpe.encode([t or "" for t in texts.to_pylist()])
        back = [bpe.decode(np.frombuffer(c, np.int32).tolist()) for c in coded]
        return pa.RecordBatch.from_arrays([ids, _lists(coded), pa.array(back, pa.binary())], ["doc_id", "ids", "decoded"])

    return _in_workers(df, made, id_col, text_col, "text", work, "ids array<int>, decoded binary")


def round_trip_digest(df: DataFrame, made: Codec | None = None) -> DataFrame:
    """The contract's columns, one row per row of ``df``."""
    both = round_trip(df, made or default_codec())
    text = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
