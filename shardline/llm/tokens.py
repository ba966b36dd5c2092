"""Token counts and token ids with the files of public tokenizers.

Counting uses the whole-token shortcut: which vocabulary strings encode alone as
one token is proved once, on the driver, with the library itself; pre-tokens found
in that set count one, and only the rest is merged by the library. Counts of
space-separated chunks are remembered in the worker, in a table of a bounded number of
bytes.

Defined results: a null text counts as empty; special strings inside texts are
handled as the library's default does; texts are never cut. An empty table gives
an empty result.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardline.llm.common import Memo
from shardline.session import ship_package

ROWS = 128
#: The pre-token pattern of the byte-level vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BPE_SPLIT = regex.compile(PRE_TOKEN)
#: White space that a cut at single spaces could tear apart.
_TORN = re.compile(r"\s \s|\s $|  ")
#: Characters on which the library's classes and those of ``regex`` surely agree.
_PLAIN = re.compile(r"[ -ɏ]*", re.DOTALL)
#: Latin-1 letters, and ASCII symbols but no apostrophe behind them.
SIMPLE_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def tokenizer_json(name: str) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


_LOADED: dict = {}


def load_tokenizer(spec: str):
    """The tokenizer of a JSON text, and the tables of what it gave, by name: the last
    one asked for stays in the worker process, so that a worker holds one set of tables."""
    key = hash(spec)
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED.clear()
        _LOADED[key] = (Tokenizer.from_str(spec), {})
    return _LOADED[key]


def table(spec: str, name: str, limit: int) -> Memo:
    """The worker's table of that name, of at most ``limit`` bytes."""
    return load_tokenizer(spec)[1].setdefault(name, Memo(limit))


def _bytes_to_chars() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable
    Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(spec: str) -> frozenset[str]:
    """The vocabulary strings proved to be one pre-token and to encode alone as
    one token."""
    tok, _ = load_tokenizer(spec)
    byte = _bytes_to_chars()
    names = []
    for s in tok.get_vocab(with_added_tokens=False):
        if all(c in byte for c in s):
            try:
                names.append(bytes(byte[c] for c in s).decode())
            except UnicodeDecodeError:
                continue
    names = [s for s in names if _BPE_SPLIT.findall(s) == [s] and _PLAIN.fullmatch(s)]
    return frozenset(s for s, e in zip(names, tok.encode_batch_fast(names, add_special_tokens=False))
                     if len(e.ids) == 1)


class Counter:
    """Token counts of texts, chunk by chunk."""

    def __init__(self, spec: str, whole: frozenset[str]):
        self.tok, self.known = load_tokenizer(spec)[0], table(spec, "chunks", 48 << 20)
        self.whole = whole
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def merged(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        """Whole texts; the library takes those that single spaces would tear."""
        odd = [bool(_TORN.search(t)) or any(s in t for s in self.special) for t in texts]
        chunks = [[] if o else self._chunks(t) for t, o in zip(texts, odd)]
        counts = self.known.look_up(set().union(*chunks), self._learn)
        return [self.merged([t])[0] if o else sum(map(counts.__getitem__, c))
                for t, o, c in zip(texts, odd, chunks)]

    @staticmethod
    def _chunks(text: str) -> list[str]:
        head, *rest = text.split(" ")
        return ([head] if head else []) + [" " + c for c in rest]

    def _learn(self, chunks: set[str]) -> dict[str, int]:
        """Whole pre-tokens count one; the other pre-tokens are merged."""
        counts, rest, owner = {}, [], []
        for c in chunks:
            if c in self.whole:
                counts[c] = 1
                continue
            parts = _BPE_SPLIT.findall(c) if _PLAIN.fullmatch(c) else [c]
            left = [p for p in parts if p not in self.whole]
            counts[c] = len(parts) - len(left)
            rest += left
            owner += [c] * len(left)
        for c, n in zip(owner, self.merged(rest) if rest else []):
            counts[c] += n
        return counts


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                 tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    spark = df.sparkSession
    ship_package(spark)
    spec = tokenizer_json(tokenizer)
    shared = spark.sparkContext.broadcast((spec, whole_tokens(spec)))  # as large as the vocabulary

    def counted(batches):
        counter = Counter(*shared.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), ROWS):
                part = [t or "" for t in texts.slice(at, ROWS).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, ROWS), pa.array([len(t.encode()) for t in part], pa.int64()),
                     pa.array(counter.count(part), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        counted, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def text_runs(column: pa.Array, chars: int = 1 << 20):
    """(first row, texts) of pieces of a column, of about ``chars`` characters."""
    lo, size, texts = 0, 0, []
    for k, value in enumerate(column):
        texts.append(value.as_py())
        size += len(texts[-1] or "")
        if size >= chars or k == len(column) - 1:
            yield lo, texts
            lo, size, texts = k + 1, 0, []


def run_bounds(column: pa.Array, size: int = 1 << 22):
    """(first row, rows) of pieces of a column of texts, of about ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = np.flatnonzero(np.diff(ends // size, prepend=-1)).tolist()
    yield from ((lo, hi - lo) for lo, hi in zip(first, first[1:] + [len(column)]))


class WordIds:
    """Token ids of whole texts for a tokenizer that lower-cases and drops white space, as
    bytes (little-endian unsigned 32-bit). Texts are split and their distinct words found by
    Arrow, many texts at once.

    A word of Latin-1 letters, with ASCII symbols but no apostrophe behind them, is two
    pre-tokens at most, and normalising only lower-cases it; its letters go straight to
    the library's merge model, and words that differ in case or symbols share them. All
    other words go through the whole tokenizer. Letters and other words are remembered in
    the worker."""

    _ODD_BREAK = "[\x1c-\x1f]"  # Arrow splits at these, the library doesn't
    _PARTS = "^(?P<letters>" + SIMPLE_WORD.pattern[1:].replace("(", "(?P<symbols>", 1) + "$"

    def __init__(self, spec: str):
        self.tok, self.known = load_tokenizer(spec)[0], table(spec, "words", 8 << 20)
        self.model, self.letters = self.tok.model, table(spec, "letters", 40 << 20)
        chars = {b: c for c, b in _bytes_to_chars().items()}
        self.as_bytes = {i: "".join(chars[b] for b in chr(i).encode()) for i in range(128, 256)}

    def _letters(self, word: str) -> bytes:
        """Letters the worker's table doesn't know."""
        ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.as_bytes))]
        found = struct.pack(f"<{len(ids)}I", *ids)
        if self.letters.room > 2 * Memo.SLOT:
            self.letters.keep(word, found)
        return found

    def _whole(self, words: set[str]) -> dict[str, bytes]:
        words = list(words)
        return {w: struct.pack(f"<{len(e)}I", *e.ids)
                for w, e in zip(words, self.tok.encode_batch_fast(words, add_special_tokens=False))}

    def _others(self, words: pa.Array) -> pa.Array:
        """Each word by the whole tokenizer."""
        listed = words.to_pylist()
        known = self.known.look_up(set(listed), self._whole)
        return pa.array(map(known.__getitem__, listed), pa.large_binary())

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words."""
        parts = pc.extract_regex(words, self._PARTS)
        simple = parts.is_valid()
        letters, symbols = parts.drop_null().flatten()
        letters, symbols = pc.utf8_lower(letters).dictionary_encode(), symbols.dictionary_encode()
        known = self.letters.get
        heads = pa.array([known(w) or self._letters(w) for w in letters.dictionary.to_pylist()], pa.large_binary())
        joined = pc.binary_join_element_wise(heads.take(letters.indices),
                                             self._others(symbols.dictionary).take(symbols.indices),
                                             pa.scalar(b"", pa.large_binary()))
        both = pa.concat_arrays([joined, self._others(words.filter(pc.invert(simple)))])
        simple = simple.to_numpy(zero_copy_only=False)
        at = np.empty(len(words), np.int64)
        at[simple], at[~simple] = np.arange(len(joined)), np.arange(len(joined), len(words))
        return both.take(pa.array(at))

    def of(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of an Arrow column without nulls."""
        words = pc.utf8_split_whitespace(texts)
        odd = pc.match_substring_regex(texts, self._ODD_BREAK)
        if pc.any(odd).as_py():
            words = pa.array([[t] if o else w for t, o, w in zip(texts.to_pylist(), odd.to_pylist(), words.to_pylist())],
                             words.type)
        coded = words.flatten().dictionary_encode()
        ids = self._words(coded.dictionary).take(coded.indices)
        if not len(ids):
            return [b""] * len(texts)
        # the ids of all words lie one behind the other
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[ids.offset:]
        bounds = ends[np.cumsum(pc.list_value_length(words).to_numpy())].tolist()
        data = memoryview(data) if data else b""
        return [bytes(data[lo:hi]) for lo, hi in zip([int(ends[0]), *bounds], bounds)]

    def ids(self, texts: list[str]) -> list[bytes]:
        return self.of(pa.array(texts, pa.string()))
