"""Alignment of the tokens that two tokenizers make of the same text.

A is a byte-level BPE vocabulary (it gets a space and the text), B a sentencepiece BPE
model (it adds the space itself). Tokens are byte ranges of space + text. Two tokens are
linked when their ranges overlap; where a token of A and one of B both end the text is cut,
and the tokens between two cuts are a group.

Merging is done in lockstep: one state vector holds a pointer into A and one into B for
each stretch of the batch's documents, of at most ``LANE`` tokens of A, so that a long
document is as many lanes. Each step links the two tokens that all lanes point at, notes a
cut where they end together, moves the pointer whose token ends first (both at a cut),
and drops the lanes that are done. A lane starts with the B token that holds its first
byte; as each link belongs to the lane of its A token, nothing is left out or said twice.

How often a pair of ids is linked in the corpus is counted by shards: consecutive
documents of a task with up to ``SHARD_LINKS`` links share a list of their distinct pairs,
and each document holds numbers of that list. Only lists are shuffled to sum up the
counts, and go back to their shard with the sums.

Tokenizers are asked for words, with the space before them, where single spaces separate
them; neither merges over such a place (for B this is checked on its pieces). Arrow splits
about 4 MB of texts at once and finds their distinct words; what a word gave is remembered
in the worker process, in a table of a bounded number of bytes, and put together by Arrow.
All other texts go to the tokenizers whole.

Defined results: texts that are null, empty, or whose A or B bytes differ from space +
text (U+2581 or a character that a tokenizer rewrites) have no tokens, links and
groups; rows that repeat an id are documents of their own; an empty table gives an empty
result. Only the named columns are looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardline.llm.common import Memo, giving_back, staged
from shardline.llm.tokens import SIMPLE_WORD, _bytes_to_chars, text_runs, tokenizer_json
from shardline.session import ship_package

LANE, BATCH_CHARS, SHARD_LINKS = 64, 1 << 22, 1 << 20
SPACE = "▁"
_BLANK = "[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Texts with white space that a cut at single spaces could tear apart, or with B's sign for a space.
_NO_WORDS = f"^ |{SPACE}|  |{_BLANK} {_BLANK}|{_BLANK} $"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def merge_lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_at: np.ndarray, lane: int = LANE):
    """(link_a, link_b, cut_a, cut_b): token numbers of all links, in order, and the last
    tokens of all groups. ``a_ends`` and ``b_ends`` are ends of tokens in the joined bytes
    of all documents, ``a_at`` where each document's A tokens begin, and their number."""
    sizes = np.diff(a_at)
    lanes = -(-sizes // lane)
    first = np.repeat(a_at[:-1], lanes) + lane * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    last = np.minimum(first + lane, np.repeat(a_at[1:], lanes))
    # a pair's numbers add up to a place of its own: each step moves one of them or both
    at_a = np.full(len(a_ends) + len(b_ends), -1, np.int32)
    at_b, cuts = at_a.copy(), np.zeros(len(at_a), bool)
    i = first.copy()
    j = np.searchsorted(b_ends, np.append(0, a_ends)[i], "right")
    while len(i):
        end_a, end_b = a_ends[i], b_ends[j]
        place = i + j
        at_a[place], at_b[place], cuts[place] = i, j, end_a == end_b
        i, j = i + (end_a <= end_b), j + (end_b <= end_a)
        going = i < last
        if not going.all():
            i, j, last = i[going], j[going], last[going]
    linked = np.flatnonzero(at_a >= 0)
    cut = np.flatnonzero(cuts)
    return at_a[linked], at_b[linked], at_a[cut], at_b[cut]


@dataclass
class Aligned:
    """A batch of documents: ids, links and cuts of all, and where each document's begin."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray

    @property
    def link_at(self) -> np.ndarray:
        return np.searchsorted(self.link_a, self.a_at)

    @property
    def cut_at(self) -> np.ndarray:
        return np.searchsorted(self.cut_a, self.a_at)


@dataclass
class Vocabularies:
    """What a worker needs; made on the driver by :func:`vocabularies`."""

    a_json: str
    b_model: bytes
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    by_words: bool  # no piece of B goes over a space behind another character
    by_letters: bool  # A splits letters from what follows and leaves them as they are


def _b_piece(model, i: int) -> bytes:
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(SPACE, " ").encode()


def vocabularies(a_file: str = A_FILE, b_file: str = B_FILE) -> Vocabularies:
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(b_file), "rb") as f:
        b_model = f.read()
    model = sentencepiece.SentencePieceProcessor(model_proto=b_model)
    a_json = tokenizer_json(a_file)
    names = Tokenizer.from_str(a_json).get_vocab(with_added_tokens=True)
    byte = _bytes_to_chars()
    a_bytes = [b""] * (1 + max(names.values()))
    for name, i in names.items():
        a_bytes[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    by_words = not any(p.lstrip(SPACE).find(SPACE) >= 0 for p in pieces)
    spec = json.loads(a_json)
    split = spec["pre_tokenizer"] or {}
    by_letters = (spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                  and not any(SIMPLE_WORD.match(t["content"].strip()) for t in spec["added_tokens"]))
    return Vocabularies(a_json, b_model, a_bytes, [_b_piece(model, i) for i in range(len(pieces))], by_words, by_letters)


class Aligner:
    """Tokenizes and aligns batches of texts in a worker."""

    def __init__(self, vocab: Vocabularies):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.vocab, self.known = vocab, Memo(64 << 20)
        self.a = Tokenizer.from_str(vocab.a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=vocab.b_model)
        self.a_size = np.array([len(x) for x in vocab.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in vocab.b_bytes], np.int64)
        self.space = self.b.piece_to_id(SPACE)
        chars = {b: c for c, b in _bytes_to_chars().items()}
        self.a_space, self.as_chars = chars[32], {i: "".join(chars[b] for b in chr(i).encode()) for i in range(128, 256)}
        self.tails = Memo(1 << 20)
        self.a_table, self.b_table = (pa.array(x, pa.large_binary()) for x in (vocab.a_bytes, vocab.b_bytes))

    def _a_encoded(self, texts: list[str]) -> list[list[int]]:
        """A ids of the texts behind a space. The letters of a plain word are one pre-token with the
        space and go straight to the merge model, and the symbols behind them are another one."""
        rest = lambda x: [e.ids for e in self.a.encode_batch_fast(x, add_special_tokens=False)]
        found = [SIMPLE_WORD.fullmatch(t) if self.vocab.by_letters else None for t in texts]
        others = iter(rest([" " + t for t, m in zip(texts, found) if m is None]))
        tails = self.tails.look_up({m[2] for m in found if m}, lambda x: dict(zip(x, rest(list(x)))))
        merge = self.a.model.tokenize
        letters = {x: [t.id for t in merge(self.a_space + (x if x.isascii() else x.translate(self.as_chars)))]
                   for x in {m[1] for m in found if m}}
        return [next(others) if m is None else letters[m[1]] + tails[m[2]] if m[2] else letters[m[1]] for m in found]

    def _encoded(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """A ids of the texts behind a space and B ids, None where the bytes aren't those of the text."""
        data = [b" " + t.encode() for t in texts]
        a = self._a_encoded(texts)
        b = self.b.encode(texts, num_threads=1)
        b = [x if t else [self.space] for x, t in zip(b, texts)]
        (a_ids, a_at), (b_ids, b_at) = self._flat(a), self._flat(b)
        a_data, b_data = a_ids.tobytes(), b_ids.tobytes()
        ids = [(a_data[i:j], b_data[k:m]) for i, j, k, m in zip(
            *((4 * at[s]).tolist() for at in (a_at, b_at) for s in (slice(-1), slice(1, None))))]
        size = np.fromiter(map(len, data), np.int64, len(data))
        same = ((np.add.reduceat(self.a_size[a_ids], a_at[:-1]) == size)
                & (np.add.reduceat(self.b_size[b_ids], b_at[:-1]) == size))
        # the bytes of all texts with the same lengths at once
        of_text = np.flatnonzero(same)
        joined = np.frombuffer(b"".join(data if same.all() else [data[k] for k in of_text]), np.uint8)
        for found, at, table in ((a_ids, a_at, self.a_table), (b_ids, b_at, self.b_table)):
            own = found if same.all() else found[np.repeat(same, np.diff(at))]
            wrong = np.flatnonzero(np.frombuffer(_data_of(table.take(pa.array(own))), np.uint8) != joined)
            if len(wrong):
                for k in set(of_text[np.searchsorted(np.cumsum(size[of_text]), wrong, "right")].tolist()):
                    ids[k] = None
        return [x if s else None for x, s in zip(ids, same.tolist())]

    @staticmethod
    def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each list begin, and their number; all lists have some."""
        at = np.cumsum([0] + [len(x) for x in ids])
        return np.fromiter(chain.from_iterable(ids), np.int32, at[-1]), at

    def _of_words(self, words: list[str]) -> list[tuple[bytes, bytes] | None]:
        """:meth:`_encoded` of distinct words, from the worker's table where it knows them."""
        got = list(map(self.known.get, words))
        fresh = [k for k, x in enumerate(got) if x is None]
        if fresh:
            for k, x in zip(fresh, self._encoded([words[k] for k in fresh])):
                got[k] = x
                if x and self.known.room > 2 * Memo.SLOT:
                    self.known.keep(words[k], x)
        return got

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids, B ids and where those of each text begin, and their number; none where the bytes differ."""
        column = pa.array(texts, pa.string())
        column = pc.if_else(pc.equal(pc.binary_length(column), 0), pa.scalar(None, pa.string()), column)
        whole = pc.fill_null(pc.match_substring_regex(column, _NO_WORDS), False) if self.vocab.by_words else column.is_valid()
        words = pc.split_pattern(pc.if_else(whole, pa.scalar(None, pa.string()), column), " ")
        coded = words.flatten().dictionary_encode()
        parts = self._of_words(coded.dictionary.to_pylist())
        odd = column.filter(whole).to_pylist()
        if odd:
            parts = parts + self._encoded(odd)
        # a text's parts are its words, or itself
        whole = whole.to_numpy(zero_copy_only=False)
        n = np.where(whole, 1, pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        at = np.append(0, np.cumsum(n))
        of_whole = np.zeros(at[-1], bool)
        of_whole[at[:-1][whole]] = True
        part = np.empty(at[-1], np.int64)
        part[of_whole] = len(coded.dictionary) + np.arange(len(odd))
        part[~of_whole] = coded.indices.to_numpy()
        differs = np.array([x is None for x in parts], bool)
        if differs.any():
            text = np.repeat(np.arange(len(n)), n)
            spoilt = np.zeros(len(n), bool)
            spoilt[text[differs[part]]] = True
            part[spoilt[text]] = len(parts)
        part, out = pa.array(part), []
        for side in (0, 1):
            ids = pa.array([*(x[side] if x else b"" for x in parts), b""], pa.large_binary()).take(part)
            out += [np.frombuffer(_data_of(ids), np.int32), _ends_of(ids)[at] // 4]
        a_ids, a_at, b_ids, b_at = out
        return a_ids, b_ids, a_at, b_at

    def align(self, texts: list[str | None]) -> Aligned:
        a_ids, b_ids, a_at, b_at = self.tokens(texts)
        return Aligned(a_ids, b_ids, a_at, b_at, *merge_lockstep(
            np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids]), a_at))


_KEPT: dict = {}


def kept_aligner(vocab: Vocabularies) -> Aligner:
    """The worker process's aligner, with what it remembers of words; the last one stays."""
    key = (hash(vocab.a_json), hash(vocab.b_model))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Aligner(vocab)
    return _KEPT[key]


def _ends_of(values: pa.Array) -> np.ndarray:
    """Where the values of a fresh large_binary array begin in its data, and their end."""
    return np.frombuffer(values.buffers()[1], np.int64)[:len(values) + 1] if len(values) else np.zeros(1, np.int64)


def _data_of(values: pa.Array) -> memoryview:
    """The values of a fresh large_binary array, one behind the other."""
    end, data = int(_ends_of(values)[-1]), values.buffers()[2]
    return memoryview(data)[:end] if end else memoryview(b"")


@cache
def _marked_numbers() -> pa.Array:
    """Each id's decimal digits with the mark behind them: a comma, ``|`` or ``;``."""
    return pa.array([f"{i}{mark}".encode() for i in range(10 ** 5) for mark in ",|;"], pa.large_binary())


def group_texts(found: Aligned) -> list[memoryview]:
    """``a1,a2|b1;a3|b2,b3`` of each document: the ids of its groups."""
    n_a, n_b = len(found.a_ids), len(found.b_ids)
    a_in, b_in = np.diff(found.cut_a, prepend=-1), np.diff(found.cut_b, prepend=-1)
    # A tokens come behind all B tokens of the groups before, B tokens behind the group's A
    a_place = np.arange(n_a) + np.repeat(found.cut_b - b_in + 1, a_in)
    b_place = np.arange(n_b) + np.repeat(found.cut_a + 1, b_in)
    marked = np.empty(n_a + n_b, np.int32)  # comma, | and ; are 0, 1 and 2 beyond 3 times the id
    marked[a_place], marked[b_place] = 3 * found.a_ids, 3 * found.b_ids
    marked[a_place[found.cut_a]] += 1
    marked[b_place[found.cut_b]] += 2
    texts = _marked_numbers().take(pa.array(marked))
    bounds, data = _ends_of(texts)[found.a_at + found.b_at].tolist(), _data_of(texts)
    return [data[lo:max(lo, hi - 1)] for lo, hi in zip(bounds, bounds[1:])]  # no mark at the end


def _prepared(df: DataFrame, id_col: str, text_col: str):
    spark = df.sparkSession
    ship_package(spark)
    vocab = vocabularies()
    return (df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
            spark.sparkContext.broadcast(vocab), len(vocab.b_bytes))  # as large as the vocabularies


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, a_ids, b_ids, the links (link_a, link_b: token numbers) and the
    last tokens of the groups (cut_a, cut_b)."""
    docs, shared, _ = _prepared(df, id_col, text_col)

    def lists(values, at, minus=None):
        values = values - np.repeat(minus, np.diff(at)) if minus is not None else values
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))

    def work(batches):
        aligner = kept_aligner(shared.value)
        for batch in batches:
            for lo, texts in text_runs(batch.column(1), BATCH_CHARS):
                f = aligner.align(texts)
                a0, b0 = f.a_at[:-1], f.b_at[:-1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(texts)), lists(f.a_ids, f.a_at), lists(f.b_ids, f.b_at),
                     lists(f.link_a, f.link_at, a0), lists(f.link_b, f.link_at, b0),
                     lists(f.cut_a, f.cut_at, a0), lists(f.cut_b, f.cut_at, b0)],
                    ["doc_id", "a_ids", "b_ids", "link_a", "link_b", "cut_a", "cut_b"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(work, f"doc_id {kind}, " + ", ".join(
        f"{c} array<int>" for c in ("a_ids", "b_ids", "link_a", "link_b", "cut_a", "cut_b")))


_COUNTED = ("n_a", "n_b", "n_groups", "n_links", "n_pairs")


class _Shard:
    """Documents of a task that share a list of distinct pairs."""

    def __init__(self, ids: pa.Array, found: Aligned, b_size: int):
        link_at = found.link_at
        key = found.a_ids[found.link_a].astype(np.int64) * b_size + found.b_ids[found.link_b]
        code, pairs = pd.factorize(key)
        order = np.argsort(pairs)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.pairs, number = pairs[order], rank[code]
        self.times = np.bincount(number, minlength=len(order))
        doc = np.repeat(np.arange(len(ids)), np.diff(link_at))
        own, self.own_times = np.unique(doc * np.int64(max(len(self.pairs), 1)) + number, return_counts=True)
        doc, self.number = np.divmod(own, max(len(self.pairs), 1))
        self.columns = [ids, *(pa.array(x, pa.int64()) for x in (
            np.diff(found.a_at), np.diff(found.b_at), np.diff(found.cut_at), np.diff(link_at),
            np.bincount(doc, minlength=len(ids)))),
            pa.array([hashlib.sha256(t).hexdigest() if len(t) else "" for t in group_texts(found)], pa.string())]

    def row(self, shard: int, schema: pa.Schema) -> pa.RecordBatch:
        one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in self.columns]
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), *lists, one(self.pairs, pa.int64()), one(self.times, pa.int64()),
             pa.array([self.number.astype(np.int32).tobytes()], pa.binary()),
             pa.array([self.own_times.astype(np.int32).tobytes()], pa.binary())], schema.names)


def _joined(parts: list[Aligned]) -> Aligned:
    """Consecutive batches as one."""
    if len(parts) == 1:
        return parts[0]
    a0, b0 = (np.cumsum([0] + [len(getattr(p, k)) for p in parts]) for k in ("a_ids", "b_ids"))
    def moved(k, by): return np.concatenate([getattr(p, k) + m for p, m in zip(parts, by)])
    def ends(k, by): return np.concatenate([[0], *(getattr(p, k)[1:] + m for p, m in zip(parts, by))])
    return Aligned(np.concatenate([p.a_ids for p in parts]), np.concatenate([p.b_ids for p in parts]),
                   ends("a_at", a0), ends("b_at", b0), moved("link_a", a0), moved("link_b", b0),
                   moved("cut_a", a0), moved("cut_b", b0))


def alignment_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     shard_links: int = SHARD_LINKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    docs, shared, b_size = _prepared(df, id_col, text_col)
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"shard long, doc_id array<{id_kind}>, " + ", ".join(f"{c} array<long>" for c in _COUNTED)
              + ", groups_sha256 array<string>, pairs array<long>, times array<long>, number binary, own_times binary")
    names = pa.schema([(c.split()[0], pa.null()) for c in schema.split(", ")])

    @giving_back
    def sharded(batches):
        aligner, shard = kept_aligner(shared.value), TaskContext.get().partitionId() << 32
        ids, parts, links = [], [], 0
        for batch in batches:
            for lo, texts in text_runs(batch.column(1), BATCH_CHARS):
                ids.append(batch.column(0).slice(lo, len(texts)))
                parts.append(aligner.align(texts))
                links += len(parts[-1].link_a)
                if links >= shard_links:
                    yield _Shard(pa.concat_arrays(ids), _joined(parts), b_size).row(shard, names)
                    shard, ids, parts, links = shard + 1, [], [], 0
        if parts:
            yield _Shard(pa.concat_arrays(ids), _joined(parts), b_size).row(shard, names)

    shards = staged(docs.mapInArrow(sharded, schema), "align-shards")
    listed = shards.select("shard", F.posexplode(F.arrays_zip("pairs", "times")).alias("pos", "x")).select(
        "shard", "pos", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = staged(listed.groupBy("pair").agg(F.sum("times").alias("count")), "align-counts")
    of_b = (F.col("pair") % b_size).alias("b_id")
    best = counts.groupBy(of_b).agg(F.max("count").alias("best"))  # a row per id of B at most
    judged = counts.join(F.broadcast(best), of_b == F.col("b_id")).select(
        "pair", "count", (F.col("count") == F.col("best")).alias("is_best"))
    told = staged(listed.select("shard", "pos", "pair").join(judged, "pair").groupBy("shard").agg(
        F.array_sort(F.collect_list(F.struct("pos", "count", "is_best"))).alias("told"))
        .select("shard", F.col("told.count").alias("count"), F.col("told.is_best").alias("is_best")), "align-told")

    def summed(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                n_pairs = row["n_pairs"].values.to_numpy()
                number, times = (np.frombuffer(row[c].as_py(), np.int32) for c in ("number", "own_times"))
                doc = np.repeat(np.arange(len(n_pairs)), n_pairs)
                count = row["count"].values.to_numpy()[number] if len(number) else np.zeros(0, np.int64)
                is_best = row["is_best"].values.to_numpy(zero_copy_only=False)[number] if len(number) else np.zeros(0, bool)
                # sums of whole numbers: numpy adds them at their places without rounding
                n_best, total = (np.zeros(len(n_pairs), np.int64) for _ in range(2))
                np.add.at(n_best, doc, times * is_best)
                np.add.at(total, doc, times * count)
                yield pa.RecordBatch.from_arrays(
                    [row["doc_id"].values, *(row[c].values for c in _COUNTED[:-1]), pa.array(n_best), pa.array(total),
                     row["groups_sha256"].values],
                    ["doc_id", *_COUNTED[:-1], "n_best", "count_sum", "groups_sha256"])

    rows = shards.drop("pairs", "times").join(told, "shard", "left")
    return rows.mapInArrow(summed, f"doc_id {id_kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                   "count_sum long, groups_sha256 string")
