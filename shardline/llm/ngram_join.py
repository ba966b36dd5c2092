"""Similarity self-join on word n-grams: T-occurrence search with DivideSkip.

A document is the set of its distinct five-word shingles; two documents link when
100 * intersection >= 80 * union. The join gives every document the smallest
doc_id it reaches by links; it never lists the pairs of a group.

1. Equal sets become one class, so exact copies cost nothing later on. Its key is a
   hash of the set, as classes may share a doc_id; its least doc_id, ``lead``, goes along.
2. A set of n shingles needs a partner with at least ceil(0.8 n) of them. Shingles
   whose hash lies in the lowest ``LOW`` of the range are counted over the whole
   corpus; a set of which more than n - ceil(0.8 n) occur in no other class can't have
   a partner and is out. That leaves the suspects, whose sets are read again and
   peeled the same way with all their shingles.
3. Shingles of the rest are ordered from rare to frequent. The first
   n - ceil(0.8 n) + 1 of a set are posted: two linked sets share a posted shingle
   (prefix filter).
4. First search: in the inverted list of each posted shingle, every class is paired
   with the list's least one, the pivot. For each pivot, a T-occurrence search over
   the classes paired with it finds the links; components of these links follow.
5. Second search: two classes of one list are classes of one pivot. Where these
   still form several components, they are searched in full, each against those of other
   components, in pairs of blocks.

A search builds the inverted lists of its block's sets. For a query set with
required overlap T, DivideSkip puts the L longest lists aside, merges the short ones by
counting, keeps classes found T - L times or more, and binary-probes the long lists for
these only (or merges them too, if that is less work); the exact overlap then decides. Counts and pivots are summed
up before they meet, and the joins with them read plain scans, so that a shingle of a
third of all documents can be split over tasks. Each step is staged, and its shuffle files
go when it is done.

Defined results: null or blank texts have an empty set and are their own component;
rows with a null doc_id have a null component and link with nothing; rows that
repeat a doc_id are documents of their own with that id; an empty table gives an
empty result.
"""

from __future__ import annotations

from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardline.llm.common import drop_staged, give_back, giving_back, may_contain, staged, text_key
from shardline.llm.components import connected
from shardline.session import ship_package, shuffles_dropped

WORDS, PERCENT = 5, 80
LOW = 0.3  # share of the hash range that is counted over the whole corpus
MARKS = 1 << 23  # bits of the filter that spares most texts the third reading
BLOCK, ROWS = 256, 128
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F], np.uint64)
_MU = 0.0085  # the weight of the DivideSkip paper's rule for the number of long lists
PROBE = 10  # a binary probe takes as long as merging so many entries of a list
STEP = 1 << 20  # entries or probes at once
GIVE = 1 << 20  # bytes of a group behind which unused memory goes back


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes of all runs of ``k`` words from the words' hashes."""
    mixed = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        mixed = (mixed ^ (h[j:len(h) - k + 1 + j] * _ODD[j % len(_ODD)])) * _ODD[(j + 1) % len(_ODD)]
        mixed ^= mixed >> np.uint64(29)
    return mixed


def shingle_sets(texts: list, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): per text the sorted distinct 64-bit hashes of its word n-grams,
    ``hashes[bounds[i]:bounds[i + 1]]``; with fewer words, of the whole sequence.
    ``bytes.lower`` and ``bytes.split`` are exactly the rule: A-Z and the six ASCII blanks."""
    found = [(t or b"").lower().split() for t in texts]
    n = np.array([len(x) for x in found], int)
    all_words = np.empty(n.sum(), object)
    all_words[:] = list(chain.from_iterable(found))
    h = pd.util.hash_array(all_words, categorize=False)
    first = np.cumsum(n) - n
    made = np.where(n < words, n > 0, n - words + 1)
    bounds = np.append(0, np.cumsum(made))
    # the runs that begin where a text has ``words`` words left; the others cross its end
    whole = np.repeat(first - bounds[:-1], made) + np.arange(bounds[-1])
    if len(h) >= words:
        out = _mixed(h, words)[np.minimum(whole, len(h) - words)]
    else:
        out = np.empty(len(whole), np.uint64)
    for i in np.flatnonzero((n > 0) & (n < words)):
        out[bounds[i]] = _mixed(h[first[i]:first[i] + n[i]], n[i])[0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[bounds[:-1][made > 0]] = True
    return out[new], np.append(0, np.cumsum(new))[bounds]


def _texts(column):
    """The values of an Arrow column, a few rows at a time."""
    for at in range(0, len(column), ROWS):
        yield column.slice(at, ROWS).to_pylist()


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set; 0 and 0 of an empty one."""
    one, two = np.zeros((2, len(bounds) - 1), np.uint64)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        one[some] = np.add.reduceat(hashes, bounds[some])
        two[some] = np.bitwise_xor.reduceat((hashes ^ (hashes >> np.uint64(31))) * _ODD[3], bounds[some])
    return one.astype(np.int64), two.astype(np.int64)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int64)))


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The values of a column of lists without nulls."""
    out = []
    for chunk in column.chunks:
        flat, bounds = chunk.values.to_numpy(), chunk.offsets.to_numpy().tolist()
        out += [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    return out


class BlockIndex:
    """Inverted lists over the sets of one block."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], int)
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.owner, tokens = owner[order], tokens[order]
        self.starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])[:len(tokens)])
        self.tokens = tokens[self.starts]
        self.lengths = np.diff(np.append(self.starts, len(tokens)))

    @cached_property
    def entries(self) -> np.ndarray:
        """The entries of all lists as one sorted array: list number and member."""
        return np.repeat(np.arange(len(self.tokens)) * len(self.sizes), self.lengths) + self.owner

    def _parts(self, lists: np.ndarray):
        """The lists, as many at a time as have STEP entries at most."""
        step = max(1, STEP // len(self.sizes))
        return (lists[at:at + step] for at in range(0, len(lists), step))

    def lists(self, query: np.ndarray) -> np.ndarray:
        """The numbers of the lists of the query's tokens, shortest list first."""
        at = np.searchsorted(self.tokens, query)
        inside = at < len(self.tokens)
        at = at[inside][self.tokens[at[inside]] == query[inside]]
        return at[np.argsort(self.lengths[at], kind="stable")]

    def merge(self, lists: np.ndarray) -> np.ndarray:
        """How many of the lists each member is in."""
        counts = np.zeros(len(self.sizes), int)
        for part in self._parts(lists):
            n = self.lengths[part]
            entry = np.repeat(self.starts[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            counts += np.bincount(self.owner[entry], minlength=len(counts))
        return counts

    def probe(self, lists: np.ndarray, member: np.ndarray) -> np.ndarray:
        """How many of the lists each of these members is in."""
        counts = np.zeros(len(member), int)
        for part in self._parts(lists):
            wanted = part[:, None] * len(self.sizes) + member
            at = np.minimum(np.searchsorted(self.entries, wanted), len(self.entries) - 1)
            counts += (self.entries[at] == wanted).sum(axis=0)
        return counts

    def search(self, query: np.ndarray, percent: int = PERCENT, wanted: np.ndarray | None = None) -> np.ndarray:
        """Members whose overlap with the query is enough; of those ``wanted``
        (boolean per member), if given."""
        need = (percent * len(query) + 99) // 100  # no partner does with less
        lists = self.lists(query)
        if not need or len(lists) < need:
            return np.empty(0, int)
        longest = self.lengths[lists[-1]]
        aside = min(need - 1, int(need / (_MU * np.log2(longest + 1) + 1)))
        short, long_lists = lists[:len(lists) - aside], lists[len(lists) - aside:]
        counts = self.merge(short)
        kept = counts >= need - aside
        member = np.flatnonzero(kept if wanted is None else kept & wanted)
        if not len(member):
            return member
        if PROBE * aside * len(member) < self.lengths[long_lists].sum():
            overlap = counts[member] + self.probe(long_lists, member)
        else:
            overlap = (counts + self.merge(long_lists))[member]
        union = len(query) + self.sizes[member] - overlap
        return member[100 * overlap >= percent * union]


def required(n: Column, percent: int) -> Column:
    """Shingles that a partner has to share at least."""
    return F.ceil(n * percent / 100).cast("long")


def _profiles(docs: DataFrame, id_kind: str, words: int) -> DataFrame:
    """One pass over the texts: (id, th, n, s1, s2, low) with the shingles of low hash."""
    bound = np.uint64(int(LOW * 2 ** 64))

    @giving_back
    def profile(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                found, bounds = shingle_sets(batch.column(1).slice(at, ROWS).to_pylist(), words)
                one, two = signatures(found, bounds)
                is_low = found < bound
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, ROWS), batch.column(2).slice(at, ROWS), pa.array(np.diff(bounds)),
                     pa.array(one), pa.array(two), _lists(found[is_low], np.append(0, np.cumsum(is_low))[bounds])],
                    ["id", "th", "n", "s1", "s2", "low"])

    return docs.mapInArrow(profile, f"id {id_kind}, th long, n long, s1 long, s2 long, low array<long>")


def _shared(postings: DataFrame, owner: str, name: str, keys: tuple = ("token",)) -> DataFrame:
    """(keys, df, pivot) of the tokens that two owners or more have, with their least
    owner; df is an upper bound where an owner posts a token twice."""
    return staged(postings.groupBy(*keys).agg(F.min(owner).alias("lo"), F.max(owner).alias("hi"),
                                              F.count("*").alias("df"))
                  .filter("lo <> hi").select(*keys, "df", F.col("lo").alias("pivot")), name)


def _key() -> Column:
    """The key of a class: doc_ids may repeat, sets don't."""
    return F.xxhash64("n", "s1", "s2").alias("rep")


def _suspects(profiles: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(rep, lead) of the classes that may have a partner by their low shingles."""
    low = profiles.filter("n > 0 AND id IS NOT NULL").select("s1", F.explode("low").alias("token"))
    shared = _shared(low, "s1", "join-low")
    found = (low.join(shared.select("token"), "token").distinct().groupBy("s1").agg(F.count("*").alias("k")))
    found = staged(found, "join-low-found")
    counted = classes.join(found, "s1", "left")
    out = staged(counted.filter(F.col("low_n") - F.coalesce("k", F.lit(0)) <= F.col("n") - required(F.col("n"), percent))
                 .select("rep", "lead"), "join-suspects")
    drop_staged(shared, found)
    return out


def _enough(sets: DataFrame, percent: int) -> DataFrame:
    """(rep) of the sets enough of whose shingles occur in other sets."""
    tokens = sets.select("rep", "n", F.explode("grams").alias("token"))
    shared = _shared(tokens, "rep", "join-shared")
    return (tokens.join(shared.select("token"), "token").groupBy("rep", "n").agg(F.count("*").alias("k"))
            .filter(F.col("k") >= required(F.col("n"), percent)).select("rep"))


def _peeled(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, n, found) of the sets enough of whose shingles occur in other sets;
    ``found`` has (df, token) of these."""
    tokens = sets.select("rep", "n", F.explode("grams").alias("token"))
    shared = _shared(tokens, "rep", "join-shared")
    return (tokens.join(shared, "token").groupBy("rep", "n")
            .agg(F.collect_list(F.struct("df", "token")).alias("found"))
            .filter(F.size("found") >= required(F.col("n"), percent)))


def _posted(peeled: DataFrame, percent: int) -> DataFrame:
    """(rep, token, band) of the posted shingles: of the n - required + 1 rarest ones
    those that another set has as well. Partners differ in size by 100 / percent at most,
    so sizes fall into bands of that ratio, and each set is posted in its own band and
    the next: partners meet in one of them, sets of other sizes don't."""
    alone = F.col("n") - F.size("found")
    size = (F.col("n") - required(F.col("n"), percent) + 1 - alone).cast("int")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    return (peeled.select("rep", band.alias("b"), F.explode(F.slice(F.array_sort("found"), F.lit(1), size)).alias("x"))
            .select("rep", F.col("x.token").alias("token"), F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("band")))


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, n, grams) for the classes in ``wanted`` (rep, lead). A filter
    of MARKS bits over the lead ids spares the other texts; the join is exact."""
    slot_of = lambda c: (F.pmod(F.xxhash64(c), F.lit(MARKS)) + 1).cast("long").alias("slot")
    marks = np.zeros(MARKS // 8, np.uint8)
    bits = (wanted.select(slot_of("lead"))
            .groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits")).collect())
    for r in bits:  # a bucket holds 32768 slots and counts from 1, as the slots do
        marks[(r.bucket - 1) * 4096:r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    @giving_back
    def build(batches):
        mark = shared.value
        for batch in batches:
            at = batch.column(2).to_numpy() - 1
            chosen = batch.filter(pa.array((mark[at // 8] >> (at % 8).astype(np.uint8)) & 1 > 0))
            at = 0
            for texts in _texts(chosen.column(1)):
                found, bounds = shingle_sets(texts, words)
                one, two = signatures(found, bounds)
                made = pa.RecordBatch.from_arrays(
                    [chosen.column(0).slice(at, len(texts)), pa.array(one), pa.array(two), _lists(found, bounds)],
                    ["lead", "s1", "s2", "grams"])
                yield made.filter(pa.array(bounds[1:] > bounds[:-1]))
                at += len(texts)

    kind = docs.schema["id"].dataType.simpleString()
    built = docs.filter("id IS NOT NULL").select("id", "text", slot_of("id")).mapInArrow(
        build, f"lead {kind}, s1 long, s2 long, grams array<long>").withColumn("n", F.size("grams").cast("long"))
    return (built.select(_key(), "lead", "n", "grams").join(wanted, ["rep", "lead"], "left_semi")
            .dropDuplicates(["rep"]).select("rep", "n", "grams"))


def _link_table(table: pa.Table, a=(), b=()) -> pa.Table:
    """Links from arrays of their ends, found in the group ``table``."""
    if table.nbytes > GIVE:
        give_back()
    none = [np.empty(0, np.int64)]
    return pa.table({"a": np.concatenate([*a, *none]), "b": np.concatenate([*b, *none])})


def _pivot_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between each pivot and the classes paired with it."""
    sizes = staged(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "join-pivots")
    member = (pairs.join(sizes, "pivot").join(sets, "rep")
              .select("pivot", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"),
                      F.lit(0).alias("is_query"), "rep", "grams"))
    query = (sizes.join(sets, F.col("pivot") == F.col("rep"))
             .select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                     F.lit(1).alias("is_query"), "rep", "grams"))

    def search(table: pa.Table) -> pa.Table:
        is_query, rep, grams = table["is_query"].to_numpy(), table["rep"].to_numpy(), _arrays(table["grams"])
        rest = np.flatnonzero(is_query == 0)
        index = BlockIndex([grams[k] for k in rest])
        found = {q: rep[rest[index.search(grams[q], percent)]] for q in np.flatnonzero(is_query)}
        return _link_table(table, *zip(*((np.full(len(x), rep[q]), x) for q, x in found.items())))

    out = member.unionByName(query).groupBy("pivot", "block").applyInArrow(search, "a long, b long")
    return staged(out, "join-links")


def _rest_links(pairs: DataFrame, sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Links between different components among the classes of one pivot, all of them
    up to connectivity: whatever two classes share a list share its pivot."""
    member = pairs.select("pivot", "rep").unionByName(
        pairs.select("pivot", F.col("pivot").alias("rep")).distinct())
    known = (member.join(comp, F.col("rep") == F.col("node"), "left")
             .select("pivot", "rep", F.coalesce("component", "rep").alias("comp")))
    open_groups = staged(
        known.groupBy("pivot").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        .filter("m > 2 AND lo <> hi").select("pivot", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")),
        "join-open")
    placed = (known.join(open_groups, "pivot")
              .withColumn("i", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
              .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .join(sets.select("rep", "grams"), "rep")
              .select("pivot", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "rep", "comp", "grams"))

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        group = np.unique(table["comp"].to_numpy(), return_inverse=True)[1]
        a, b = [], []
        if group.max(initial=0) > 0:
            grams, ids = _arrays(table["grams"]), table["rep"].to_numpy()
            index = BlockIndex(grams)
            # of two classes of different components, one isn't in the largest component
            for q in np.flatnonzero(group != np.bincount(group).argmax()):
                n = len(grams[q])
                wanted = (group != group[q]) & (100 * index.sizes >= percent * n) & (100 * n >= percent * index.sizes)
                for k in index.search(grams[q], percent, wanted) if wanted.any() else ():
                    a.append(ids[q]), b.append(ids[k])
                    group[group == group[q]] = group[k]
        return _link_table(table, [np.array(a, np.int64)], [np.array(b, np.int64)])

    return staged(placed.groupBy("pivot", "x", "y").applyInArrow(search, "a long, b long"), "join-more")


def _joined_groups(df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The staged profiles of the rows, and (cn, c1, c2, group, least) of the classes."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"),
                     text_key(F.col(text_col)).alias("th"))
    id_kind = docs.schema["id"].dataType.simpleString()
    profiles = staged(_profiles(docs, id_kind, words), "join-profiles")
    stored = staged(profiles.filter("n > 0 AND id IS NOT NULL").groupBy("n", "s1", "s2")
                    .agg(F.min("id").alias("lead"), F.max(F.size("low")).alias("low_n")), "join-classes")
    classes = stored.select("*", _key())
    wanted = _suspects(profiles, classes, percent)
    suspects = staged(_sets(docs, wanted, words), "join-suspect-sets")
    sets = staged(suspects.join(_enough(suspects, percent), "rep", "left_semi"), "join-sets")
    drop_staged(wanted, suspects)
    posted = staged(_posted(_peeled(sets, percent), percent), "join-posted")
    key = ("token", "band")
    pivots = _shared(posted, "rep", "join-list-pivots", key)
    pairs = staged(posted.join(pivots, [*key]).filter("rep <> pivot").select("rep", "pivot").distinct(), "join-pairs")

    first = _pivot_links(pairs, sets, percent)
    comp = staged(connected(first), "join-comp")
    more = _rest_links(pairs, sets, comp, percent)
    # the components found so far stand for the first links
    whole = connected(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    linked = staged(classes.join(whole, F.col("rep") == F.col("node")).select("node", "lead", "component"), "join-linked")
    least = staged(linked.groupBy("component").agg(F.min("lead").alias("least")), "join-least")
    named = linked.select("node", "component").join(least, "component")
    result = staged(
        classes.join(named, F.col("rep") == F.col("node"), "left")
        .select(F.col("n").alias("cn"), F.col("s1").alias("c1"), F.col("s2").alias("c2"),
                F.coalesce("component", "rep").alias("group"), F.coalesce("least", "lead").alias("least")), "join-result")
    drop_staged(stored, posted, pivots, pairs, sets, first, more, linked, least)
    return profiles, result


def similarity_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                      percent: int = PERCENT) -> DataFrame:
    """doc_id, th, n_shingles, component_id, group of every row: ``th`` tells texts of one
    doc_id apart, and ``group`` is the component's own key, as its least doc_id may be that
    of another one too. Null ids and blank texts have no group."""
    spark = df.sparkSession
    ship_package(spark)
    with shuffles_dropped(spark):
        profiles, result = _joined_groups(df, id_col, text_col, words, percent)
    # both sides are plain scans: the rows of one hot class can be split at run time
    return (profiles.drop("low").join(result, F.col("id").isNotNull() & (F.col("n") == F.col("cn"))
                                      & (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")), "left")
            .select(F.col("id").alias("doc_id"), "th", F.col("n").alias("n_shingles"),
                    F.coalesce("least", "id").alias("component_id"), "group"))


def similarity_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                       percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return similarity_groups(df, id_col, text_col, words, percent).select("doc_id", "n_shingles", "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group stays: that of the least doc_id, then text key, and of rows
    equal in both any one. Rows without a group stay."""
    grouped = staged(similarity_groups(df, id_col, text_col).filter("group IS NOT NULL"), "join-grouped")
    first = staged(grouped.groupBy("group").agg(F.min(F.struct("doc_id", "th")).alias("x")).select("x.*"), "join-first")
    gone = staged(grouped.join(first, ["doc_id", "th"], "left_anti").select("doc_id", "th").distinct(), "join-gone")
    again = staged(grouped.groupBy("doc_id", "th").agg(F.count("*").alias("k")).filter("k > 1")
                   .join(first, ["doc_id", "th"], "left_semi").select("doc_id", "th"), "join-again")
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("th"))
    once = (may_contain(rows, F.xxhash64("doc_id", "th"), again, F.xxhash64("doc_id", "th"))
            .join(again, ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"]))
    out = gone.unionByName(again)
    drop_staged(grouped, first)
    return (rows.join(out, ["doc_id", "th"], "left_anti").select("row")
            .unionByName(once.select("row")).select("row.*"))


#: The contract's columns by joining all shingles: for tables of some thousand documents.
ORACLE = r"""
  WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
  grams AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
    FROM words),
  sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
  shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b USING (g)
             WHERE a.doc_id < b.doc_id GROUP BY ALL),
  links AS (SELECT x, y FROM shared JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id
            WHERE 100 * c >= 80 * (a.n + b.n - c)),
  both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
  reached AS (SELECT doc_id AS x, doc_id AS y FROM documents
              UNION SELECT r.x, l.y FROM reached r JOIN both_ways l ON r.y = l.x)
  SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id
  FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reached r ON d.doc_id = r.x GROUP BY d.doc_id
"""
