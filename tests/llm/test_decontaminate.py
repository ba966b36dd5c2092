import random
from collections import Counter

import pytest

from shardline.llm import decontaminate
from tests.conftest import SF_SMALL


def test_planted_passages(spark, edge):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (14, 30, 59, 4, 1)]
    text = lambda ws: " ".join(ws)
    filler = lambda: [word() for _ in range(rng.randrange(5, 80))]
    near = list(items[2])
    near[5] = word()  # one changed word breaks 5 of 55 shingles
    gap = items[1][:15] + items[1][16:]
    far = [w if i % 3 else word() for i, w in enumerate(items[2])]
    rows = [(1001, text(filler() + items[0] + filler())), (1002, text(items[1])),
            (1003, text(filler() + near + filler())), (1004, text(filler() + gap + filler())),
            (1005, text(filler() + far + filler())), (1006, text(filler() + items[2][:25] + filler())),
            (1007, text(filler()).upper()), (1008, "X, " + ", ".join(w.upper() for w in items[0]) + "!"),
            (1009, text(filler() + items[3] + filler())), (1010, text(items[4])),
            (1011, text(items[1] + items[0])), (1001, text(items[1]))]
    rows += [(r.doc_id, r.text) for r in edge.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, text(x), "c") for i, x in enumerate(items)]
                                  + [(7, None, "c"), (8, "", "c"), (None, "some words", "c")],
                                  "item_id long, text string, w string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contamination_report(df, bench).collect()}
    assert set(got) == {(1001, 0), (1001, 1), (1002, 1), (1003, 2), (1008, 0), (1009, 3), (1010, 4), (1011, 0), (1011, 1)}
    assert got[1003, 2].similarity == pytest.approx(50 / 60) and got[1002, 1].similarity == 1.0
    left = decontaminate.drop_contaminated(df, bench)
    assert left.columns == ["doc_id", "text"]
    assert {r.doc_id for r in left.collect()} == {1004, 1005, 1006, 1007} | {r.doc_id for r in edge.collect()}
    assert decontaminate.drop_contaminated(edge, bench).columns == edge.columns


def test_empty_tables(spark, small_docs):
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    assert decontaminate.contamination_report(small_docs.limit(0), bench).count() == 0
    assert decontaminate.contamination_report(small_docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(small_docs, bench.limit(0)).count() == small_docs.count()


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(50):
        a = rng.getrandbits(64) - (1 << 63)
        b = a
        for bit in rng.sample(range(63), decontaminate.RADIUS):
            b ^= 1 << bit
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a long, b long")
    from pyspark.sql import functions as F
    both = df.select(decontaminate.hamming_blocks(F.col("a"), decontaminate.RADIUS).alias("a"),
                     decontaminate.hamming_blocks(F.col("b"), decontaminate.RADIUS).alias("b"))
    assert both.filter(F.size(F.array_intersect("a", "b")) > 0).count() == len(rows)


def every_window(text, item):
    """The best similarity of all windows of the item's size, over the ends as well."""
    k = min(5, len(item))
    grams = lambda ws: [tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)]
    want, said = grams(item), grams(text)
    best = 0.0
    for s in range(1 - len(want), len(said)):
        window = said[max(s, 0):max(s + len(want), 0)]
        both = sum((Counter(window) & Counter(want)).values())
        best = max(best, both / (len(window) + len(want) - both))
    return best


def test_every_window_is_judged(spark):
    """Swapped halves are no shingle in place but similar all the same; edits, ends of
    documents and repeats against all windows."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    filler = lambda n: [word() for _ in range(n)]
    items = [filler(n) for n in (50, 80, 100, 80)]
    swap = lambda ws, at: ws[at:] + ws[:at]
    rows = [filler(30) + swap(x, len(x) // 2) + filler(30) for x in items]
    rows += [swap(x, len(x) // 3) for x in items] + [filler(3) + x[:-6] for x in items] + [x[7:] + filler(9) for x in items]
    rows += [x * 3 for x in items[:2]] + [filler(5) + x[:30] + filler(40) + x[30:] for x in items]
    rows += [x[40:60] + x[20:40] + x[:20] + x[60:] + filler(4) for x in items]
    for _ in range(30):
        own = list(rng.choice(items))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(own))
            own[at:at + rng.randrange(3)] = filler(rng.randrange(3))
        own = swap(own, rng.choice((0, 20, 35)))
        rows.append(filler(rng.randrange(20)) + own[rng.randrange(6):] + filler(rng.randrange(20)))
    df = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contamination_report(df, bench).collect()}
    best = {(i, j): every_window(ws, item) for i, ws in enumerate(rows) for j, item in enumerate(items)}
    assert got == pytest.approx({key: v for key, v in best.items() if v >= 0.8})
    assert all((j, j) in got for j in range(4))


def test_repeated_shingles(spark):
    """Choruses, counting and one word over and over: recall against all windows is 1."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    filler = lambda n: [word() for _ in range(n)]
    chorus = filler(9)
    items = [chorus * 4 + filler(10), ["la"] * 40, filler(6) + ["la"] * 30 + filler(6), (filler(2) * 3 + filler(4)) * 3]
    rows = [x + filler(5) for x in items] + [filler(7) + x[3:] for x in items] + [["la"] * n for n in (5, 20, 36, 41, 70)]
    rows += [chorus * n + items[0][36:] for n in (2, 3, 5)] + [chorus * 12]
    for _ in range(20):
        own = list(rng.choice(items))
        own[rng.randrange(len(own))] = word()
        rows.append(filler(rng.randrange(9)) + own + filler(rng.randrange(9)))
    df = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contamination_report(df, bench).collect()}
    best = {(i, j): every_window(ws, item) for i, ws in enumerate(rows) for j, item in enumerate(items)}
    want = {key: v for key, v in best.items() if v >= 0.8}
    assert len(want) > 12 and got == pytest.approx(want)


def test_very_long_repeats(spark):
    """20,000 equal words against an item of 400 equal words."""
    df = spark.createDataFrame([(1, "word " * 20_000), (2, "word " * 350), (3, "word " * 200)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "word " * 400)], "item_id long, text string")
    got = {r.doc_id: (r.similarity, r.start) for r in decontaminate.contamination_report(df, bench).collect()}
    assert got[1] == (1.0, 0) and got[2][0] == pytest.approx(346 / 396) and set(got) == {1, 2}
