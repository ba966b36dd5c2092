"""Helpers shared by the corpus operators: staged tables, text rules, UDF caches."""

from __future__ import annotations

from sys import getsizeof

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardline.session import drop_staged, staged  # noqa: F401  the operators take them from here

#: The white space and the letter case of the word and line rules.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_BREAK = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters untouched (``lower`` is the same on
    plain ASCII, and much faster)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often and however
    deep inside lambdas it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_key(text: Column) -> Column:
    """A hash that tells rows apart which share a doc_id but not their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def give_back() -> None:
    """Memory that Arrow no longer uses goes back to the system. Its pool keeps it
    otherwise: some hundred MB in each worker process, as long as that lives."""
    pa.default_memory_pool().release_unused()


def giving_back(made):
    """A function from batches to results that gives memory back behind each result
    and at its end."""
    def run(batches):
        for out in made(batches):
            yield out
            del out
            give_back()
        give_back()
    return run


class Memo(dict):
    """What short texts gave, up to ``limit`` bytes of keys and values; full, it takes
    no more."""

    SLOT, LONG = 104, 48  # bytes a dict keeps per entry; characters of the longest key

    def __init__(self, limit: int = 32 << 20):
        super().__init__()
        self.room = limit

    def keep(self, key: str, value) -> None:
        size = getsizeof(key) + getsizeof(value) + self.SLOT
        if isinstance(value, tuple):
            size += sum(map(getsizeof, value))
        if len(key) <= self.LONG and size <= self.room:
            self.room -= size
            self[key] = value

    def look_up(self, pieces: set[str], learn) -> dict:
        """The table itself if it knows all pieces, else one of these pieces alone."""
        fresh = {x for x in pieces if x not in self}
        if not fresh:
            return self
        new = learn(fresh)
        if self.room > 2 * self.SLOT:
            for x, value in new.items():
                self.keep(x, value)
        rest = pieces - fresh
        new.update(zip(rest, map(self.__getitem__, rest)))
        return new


#: Bits of a membership filter: 256 buckets of 32768, 1 MB, whatever it is made from.
FILTER_BITS = 1 << 23


def _slot(hashed: Column) -> tuple[Column, Column]:
    slot = (F.pmod(hashed, F.lit(FILTER_BITS).cast("long")) + 1).cast("long")
    return F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)


def may_contain(df: DataFrame, hashed: Column, wanted: DataFrame, wanted_hash: Column) -> DataFrame:
    """The rows of ``df`` whose hash may be among those of ``wanted``: all that are, and
    few others. The filter has a fixed size, so it is broadcast however large ``wanted``
    is; an exact join has to follow."""
    bucket, bit = _slot(wanted_hash)
    marks = wanted.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    bucket, bit = _slot(hashed)
    byte = F.conv(F.hex(F.substring("_bits", F.expr("cast(_bit div 8 + 1 as int)"), F.lit(1))), 16, 10)
    return (df.withColumns({"_bucket": bucket, "_bit": bit}).join(F.broadcast(marks), "_bucket")
            .filter(F.getbit(byte.cast("long"), F.pmod("_bit", F.lit(8)).cast("int")) == 1)
            .drop("_bucket", "_bit", "_bits"))
