"""Benchmark decontamination with SimHash over item-sized windows.

A document is contaminated by a benchmark item if a window of as many words as the
item has is at least 0.8 similar to it: shingles of five words (all words of a
shorter item), weighed by their number, sum of minima over sum of maxima.

1. Windows. Of the windows at every start, those are laid whose positions meet
   shingles of items of that size often enough to reach the similarity; a place counts
   at most once, so none that reaches it has fewer. A window that begins with a shingle of no
   item is no better than the next one, and one that ends so no better than the
   one before if that begins with an item's shingle; such windows are left out unless a shingle
   stands in place, as the best one stays. Order doesn't count: an item whose
   halves are swapped is found. Only the places where they meet leave the first scan; a
   second one lays and cuts the windows. Windows may reach over an end of a document.
2. Fingerprints. Equal windows are fingerprinted once: 64 bits, each the vote of the
   hashes of the shingles, the second occurrence of a shingle with a hash of its own and so
   on. The weighted similarity of two bags is then that of two sets: at 0.8 the angle is
   at most 27.3 degrees and 9.7 bits are expected to differ, with a deviation of 2.9; the
   default radius of 23 is 4.8 deviations above. The fingerprint is cut into ``radius + 1``
   blocks. Of two fingerprints that differ in at most ``radius`` bits one block is equal, and
   of n shingles of an item a window of similarity 0.8 has one of the n - ceil(0.8 n) + 1 that are
   rarest in the benchmark. The join on (size, rare shingle, block number, block bits)
   thus finds all within the radius, and a window meets the few items it shares a rare shingle with,
   not all of its size.
3. Verification. Candidates within the radius are judged by the exact weighted
   similarity.

Words are runs of letters and digits, lower-cased. Only Spark's own functions run.

Defined results: null and empty texts and items without words match nothing; items
shorter than five words match as one shingle; a benchmark or corpus without rows
gives no rows; rows that repeat a doc_id or item_id give one row per pair of ids,
the most similar window, of equal ones one with a shingle in place, and the first of those
laid; a null doc_id stays null, items with a
null item_id are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardline.llm.common import drop_staged, let, may_contain, staged, text_key

WORDS, PERCENT, RADIUS, BITS = 5, 80, 23, 64


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column, k: int) -> Column:
    """Hashes of the runs of k words, in order."""
    return let(words, lambda w: F.when(F.size(w) >= k, F.transform(
        F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(
        F.expr("array()").cast("array<bigint>")))


def simhash(hashes: Column) -> Column:
    """Bit b is set if it is set in more than half of the hashes; repeated shingles
    vote as often as they occur."""
    def vote(b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int"))
        return F.when(2 * ones > F.size(hashes), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"),
                       lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", vote(b), b)))


def occurrences(grams: Column) -> Column:
    """The shingles as a set: the second and later ones of a kind get hashes of their own."""
    def numbered(g: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(grams, 1, i), lambda x: x == g))
        return F.when(before == 0, g).otherwise(F.xxhash64(g, before))

    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), grams).otherwise(F.transform(grams, numbered))


def hamming_blocks(fingerprint: Column, radius: int) -> Column:
    """(block number, its bits) of radius + 1 blocks that cover all 64 bits."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*(F.struct(F.lit(i).alias("block"),
                              F.shiftrightunsigned(fingerprint, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("bits"))
                     for i, (lo, hi) in enumerate(zip(edges, edges[1:]))))


def overlap(a: Column, b: Column) -> Column:
    """Sum over the shingles of the lesser of their two numbers."""
    times = lambda arr, s: F.size(F.filter(arr, lambda x: x == s))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, s: n + F.least(times(a, s), times(b, s)))


def _items(benchmark: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(item, w words, k shingle size, grams)."""
    split = benchmark.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("words"))
    sized = split.select("item", "words", F.size("words").alias("w")).filter("w > 0")
    grams = F.when(F.col("w") >= words, shingle_hashes(F.col("words"), words)).otherwise(
        F.array(F.xxhash64("words")))
    sized = sized.filter(F.col("item").isNotNull())
    return sized.select("item", "w", F.least("w", F.lit(words)).alias("k"), grams.alias("grams"))


def _runs(ats: Column) -> Column:
    """(a, b) of the stretches of neighbouring places of a sorted list."""
    first = F.filter(ats, lambda x, i: (i == 0) | (F.get(ats, i - 1) != x - 1))
    last = F.filter(ats, lambda x, i: (i == F.size(ats) - 1) | (F.coalesce(F.get(ats, i + 1), x) != x + 1))
    return F.transform(F.arrays_zip(first.alias("a"), last.alias("b")), lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b")))


def _starts(hits: Column, m: Column, size: Column, percent: int) -> Column:
    """(start, placed) of the windows to lay for the ``hits`` (pos, runs): the places that
    meet, in order, and where in items, as stretches. ``size`` is the number of the document's
    shingles."""
    at = hits["pos"]  # the places alone
    run = lambda lo, n: F.slice(at, lo + 1, n)
    made = lambda start, out, lo: F.struct(start.cast("int").alias("start"), F.lit(out).alias("out"),
                                           F.greatest(lo, F.lit(0)).cast("int").alias("lo"))

    def in_place(h: Column, i: Column) -> Column:
        # where the place before meets the same stretch, all starts but one are laid already
        before = F.get(hits, F.greatest(i - 1, F.lit(0)))
        again = (i > 0) & (before["pos"] == h["pos"] - 1)
        return F.flatten(F.transform(h["runs"], lambda r: F.transform(
            F.sequence(r["a"], F.when(again & F.array_contains(before["runs"], r), r["a"]).otherwise(r["b"])),
            lambda x: made(h["pos"] - x, 0, i - x))))

    placed = F.flatten(F.transform(hits, in_place))
    cut_short = F.transform(F.filter(at, lambda p: p < m - 1), lambda p: made(p - m + 1, 1, F.lit(0)))

    def first(p: Column, i: Column) -> Column:
        follows = (i > 0) & (F.get(at, i - 1) == p - 1)
        ends = F.exists(run(i, m), lambda q: q == p + m - 1)
        return F.when(~F.coalesce(follows, F.lit(False)) | (p + m > size) | ends, made(p, 1, i))

    begun = F.filter(F.transform(at, first), lambda x: x.isNotNull())
    each = let(F.array_sort(F.concat(placed, cut_short, begun)), lambda all_: F.filter(
        all_, lambda x, j: (j == 0) | (F.get(all_, j - 1)["start"] != x["start"])))

    def enough(x: Column) -> Column:
        s = x["start"]
        met = F.size(F.filter(run(x["lo"], 2 * m), lambda p: (p >= s) & (p < s + m)))
        total = F.least(s + m, size) - F.greatest(s, F.lit(0))
        return (100 + percent) * met >= percent * (total + m)

    return F.filter(each, enough)


def candidates(marked: DataFrame, items: DataFrame, content: list[str], percent: int, radius: int) -> DataFrame:
    """(content, item) of the windows and items whose fingerprints are within the radius,
    among those that share a shingle which is rare in the benchmark."""
    sets = items.select("item", "w", occurrences(F.col("grams")).alias("set"))
    often = sets.select("w", F.explode("set").alias("gram")).groupBy("w", "gram").agg(F.count("*").alias("n"))
    told = sets.select("item", "w", simhash(F.col("set")).alias("item_mark"), F.size("set").alias("m"),
                       F.explode("set").alias("gram")).join(often, ["w", "gram"])
    # the first m - ceil(percent of m) + 1 by rarity: fewer than that can be missing
    least = F.col("m") - F.ceil(F.col("m") * F.lit(percent) / 100).cast("int") + 1
    rare = told.groupBy("item", "w", "item_mark", "m").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("n", "gram"))), F.lit(1), F.first(least)).alias("rare"))
    right = staged(rare.select("item", "w", "item_mark", F.explode("rare.gram").alias("gram")), "decon-rare")
    grams = marked.select(*content, "mark", F.explode("set").alias("gram"))
    grams = may_contain(grams, F.col("gram"), right, F.col("gram"))
    blocks = lambda df, mark: df.select("*", F.explode(hamming_blocks(F.col(mark), radius)).alias("b")).select(
        *df.columns, "b.*")
    near = (blocks(grams, "mark").join(blocks(right, "item_mark"), ["w", "gram", "block", "bits"])
            .filter(F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark"))) <= radius)
            .select(*content, "item").distinct())
    near = staged(near, "decon-near")
    drop_staged(right)
    return near


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text", words: int = WORDS, percent: int = PERCENT,
                 radius: int = RADIUS) -> DataFrame:
    """(id, th, item, start, n_words, similarity, placed): per document text and item
    the most similar window; start counts words from 0, and placed is 1 if a shingle of an
    item of that size stands in place."""
    items = staged(_items(benchmark, item_id, item_text, words), "decon-items")
    grams = staged(items.select("w", "k", F.posexplode("grams").alias("at", "gram"), F.size("grams").alias("m"))
                   .groupBy("w", "k", "m", "gram").agg(F.array_sort(F.collect_set("at")).alias("ats"))
                   .select("w", "k", "m", "gram", _runs(F.col("ats")).alias("runs")), "decon-grams")
    docs = df.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    windows = None
    for (k,) in sorted(items.select("k").distinct().collect()):  # sizes up to ``words``
        own = grams.filter(F.col("k") == k)
        said = docs.select("id", "th", F.posexplode(shingle_hashes(words_of(F.col("text")), k)).alias("pos", "gram"))
        met = (may_contain(said, F.col("gram"), own, F.col("gram")).join(own, "gram")
               .select("id", "th", "w", "k", "m", "pos", "runs"))
        windows = met if windows is None else windows.unionByName(met)
    if windows is None:
        kind = df.schema[id_col].dataType.simpleString()
        return df.sparkSession.createDataFrame(
            [], f"id {kind}, th long, item {items.schema['item'].dataType.simpleString()}, start int, n_words int, "
                "similarity double, placed int")
    places = staged(windows, "decon-places")
    met = (places.groupBy("id", "th", "k", "w", "m").agg(F.array_sort(F.collect_set(F.struct("pos", "runs"))).alias("hits"))
           .filter(100 * F.size("hits") >= percent * F.col("m")))
    per_doc = staged(met.groupBy("id", "th", "k").agg(F.collect_list(F.struct("w", "m", "hits")).alias("places"))
                     .select(F.col("id").alias("pid"), F.col("th").alias("pth"), "k", "places"), "decon-documents")

    def cut(hashes: Column) -> Column:
        def window(p: Column, x: Column) -> Column:
            lo = F.greatest(x["start"], F.lit(0))
            grams = F.slice(hashes, lo + 1, F.least(x["start"] + p["m"], F.size(hashes)) - lo)
            return F.struct(p["w"].alias("w"), x["start"].alias("start"), (1 - x["out"]).alias("placed"),
                            grams.alias("grams"))

        def new(p: Column, laid: Column) -> Column:
            # a window that loses and gains the same shingle equals the one before
            def same(x: Column, j: Column) -> Column:
                before = F.get(laid, F.greatest(j - 1, F.lit(0)))
                inside = (before["start"] >= 0) & (x["start"] + p["m"] <= F.size(hashes))
                return ((j > 0) & (before["start"] == x["start"] - 1) & (before["out"] <= x["out"]) & inside
                        & (F.get(hashes, F.greatest(before["start"], F.lit(0)))
                           == F.get(hashes, F.greatest(x["start"] + p["m"] - 1, F.lit(0)))))
            return F.filter(laid, lambda x, j: ~F.coalesce(same(x, j), F.lit(False)))

        return F.flatten(F.transform("places", lambda p: F.transform(
            let(_starts(p["hits"], p["m"], F.size(hashes), percent), lambda laid: new(p, laid)), lambda x: window(p, x))))

    windows = None
    for (k,) in sorted(items.select("k").distinct().collect()):
        own = per_doc.filter(F.col("k") == k)
        # only the texts of documents that have places go any further
        some = may_contain(docs, F.xxhash64("id", "th"), own, F.xxhash64("pid", "pth"))
        one = (some.join(own, F.col("id").eqNullSafe(F.col("pid")) & (F.col("th") == F.col("pth")))
               .select("id", "th", F.explode(let(shingle_hashes(words_of(F.col("text")), k), cut)).alias("x"))
               .select("id", "th", "x.*"))
        windows = one if windows is None else windows.unionByName(one)
    windows = staged(windows.select("id", "th", "w", "start", "placed", "grams", F.xxhash64("grams").alias("c1"),
                                    F.xxhash64(F.lit(1), "grams").alias("c2")), "decon-windows")
    content = ["w", "c1", "c2"]
    marked = staged(windows.groupBy(*content).agg(F.first("grams").alias("grams"))
                    .withColumn("set", occurrences(F.col("grams"))).withColumn("mark", simhash(F.col("set"))),
                    "decon-marked")
    near = candidates(marked, items, content, percent, radius)
    judged = (near.join(marked.select(*content, "grams"), content)
              .join(items.select("item", F.col("w").alias("iw"), F.col("grams").alias("item_grams")), "item"))
    both = overlap(F.col("item_grams"), F.col("grams"))
    scored = judged.filter(F.col("iw") == F.col("w")).select(
        *content, "item", both.alias("both"), (F.size("grams") + F.size("item_grams")).alias("sum"))
    good = staged(scored.filter(100 * F.col("both") >= percent * (F.col("sum") - F.col("both")))
                  .select(*content, "item", (F.col("both") / (F.col("sum") - F.col("both"))).alias("similarity")),
                  "decon-good")
    best = F.max(F.struct("similarity", "placed", (-F.col("start")).alias("back"), F.col("w").alias("n_words")))
    found = (windows.select("id", "th", "start", "placed", *content).join(good, content)
             .groupBy("id", "th", "item").agg(best.alias("best"))
             .select("id", "th", "item", (-F.col("best.back")).alias("start"), F.col("best.n_words").alias("n_words"),
                     F.col("best.similarity").alias("similarity"), F.col("best.placed").alias("placed")))
    found = staged(found, "decon-found")
    drop_staged(items, grams, places, per_doc, windows, marked, near, good)
    return found


def contamination_report(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity of each contaminated pair."""
    best = F.max(F.struct("similarity", "placed", (-F.col("start")).alias("back"), "n_words"))
    return (contaminated(df, benchmark).groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))
            .agg(best.alias("best"))
            .select("doc_id", "item_id", (-F.col("best.back")).cast("long").alias("start"),
                    F.col("best.n_words").cast("long").alias("n_words"), F.col("best.similarity").alias("similarity")))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text matches no benchmark item."""
    bad = contaminated(df, benchmark, id_col, text_col).select(
        F.col("id").alias("bad_id"), F.col("th").alias("bad_th")).distinct()
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("th"))
    kept = rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("th") == F.col("bad_th")), "left_anti")
    return kept.select("row.*")


#: {docs} has doc_id and text, {items} item_id and text. All windows that share a
#: shingle in place with an item, judged exactly: what the fingerprints must find.
LEAKS_SQL = r"""
  dc_items AS (
    SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k
    FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w
          FROM {items}) t WHERE len(w) > 0
  ),
  dc_docs AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w
    FROM {docs}
  ),
  dc_ishingles AS (
    SELECT item_id, n, k, i - 1 AS at, array_to_string(w[i:i + k - 1], ' ') AS s
    FROM dc_items, unnest(generate_series(1, n - k + 1)) AS u(i)
  ),
  dc_dshingles AS (
    SELECT doc_id, q.k, i - 1 AS pos, array_to_string(w[i:i + q.k - 1], ' ') AS s
    FROM dc_docs, (SELECT DISTINCT k FROM dc_items) q, unnest(generate_series(1, len(w) - q.k + 1)) AS u(i)
  ),
  dc_windows AS (
    SELECT DISTINCT d.doc_id, i.n, i.k, d.pos - i.at AS start
    FROM dc_dshingles d JOIN dc_ishingles i ON d.k = i.k AND d.s = i.s
  ),
  dc_wcounts AS (
    SELECT v.doc_id, v.n, v.k, v.start, d.s, count(*) AS c
    FROM dc_windows v JOIN dc_dshingles d
      ON d.doc_id = v.doc_id AND d.k = v.k AND d.pos >= v.start AND d.pos <= v.start + v.n - v.k
    GROUP BY ALL
  ),
  dc_icounts AS (SELECT item_id, n, k, s, count(*) AS c FROM dc_ishingles GROUP BY ALL),
  dc_totals AS (SELECT doc_id, n, k, start, sum(c) AS total FROM dc_wcounts GROUP BY ALL),
  dc_scored AS (
    SELECT w.doc_id, i.item_id, w.n, w.k, w.start, sum(least(w.c, i.c)) AS shared
    FROM dc_wcounts w JOIN dc_icounts i ON w.n = i.n AND w.s = i.s GROUP BY ALL
  ),
  dc_found AS (
    SELECT s.doc_id, s.item_id, s.start, s.n AS n_words,
           s.shared::DOUBLE / (t.total + s.n - s.k + 1 - s.shared)::DOUBLE AS similarity
    FROM dc_scored s JOIN dc_totals t USING (doc_id, n, k, start)
    WHERE 100 * s.shared >= 80 * (t.total + s.n - s.k + 1 - s.shared)
  )
"""

ORACLE = ("WITH " + LEAKS_SQL.format(docs="documents", items="benchmark") + """
  SELECT doc_id, item_id, start::BIGINT AS start, n_words::BIGINT AS n_words, similarity FROM dc_found
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
""")
