import math

import numpy as np

from shardline.llm import embedding_dedup
from tests.conftest import SF_CHECK


def brute(rows):
    def ok(r):
        i, v, lab = r
        return (i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)
                and any(v))

    good = [k for k, r in enumerate(rows) if ok(r)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, k in enumerate(good):
        v = np.array(rows[k][1], float)
        for m in good[:a]:
            w = np.array(rows[m][1], float)
            if rows[k][2] == rows[m][2] and len(v) == len(w):
                if (v * w).sum() / (math.sqrt((v * v).sum()) * math.sqrt((w * w).sum())) >= 0.93:
                    links[k] += 1
                    links[m] += 1
                    root[find(k)] = find(m)
    least = {}
    for k in good:
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    ids = [least[find(k)] if k in set(good) else rows[k][0] for k in range(len(rows))]
    return sorted(((r[0], n, c, r[0] is not None and r[0] == c) for r, n, c in zip(rows, links, ids)), key=str)


def _got(df, **kw):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept)
                   for r in embedding_dedup.dedup_embeddings(df, **kw).collect()), key=str)


def test_recall_and_no_false_links(spark):
    """The table's own vectors and, for each, one at a cosine of 0.93 to 1."""
    rng = np.random.default_rng(4)
    own = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").collect()
    rows = [(r.vec_id, list(r.embedding), r.label) for r in own]
    for r in own:
        v = np.array(r.embedding, float)
        v /= np.linalg.norm(v)
        w = rng.standard_normal(len(v))
        w -= (w @ v) * v
        c = rng.uniform(0.9305, 1)
        rows.append((100_000 + r.vec_id, (c * v + np.sqrt(1 - c * c) * w / np.linalg.norm(w)).tolist(), r.label))
    got = _got(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    rows = [(i, np.array(v, np.float32).astype(float).tolist(), lab) for i, v, lab in rows]
    want = brute(rows)
    assert sum(x[1] for x in want) >= 2 * len(own)
    assert sum(x[1] for x in got) >= 0.9 * sum(x[1] for x in want)
    exact = {x[0]: x for x in want}
    assert all(x[1] <= exact[x[0]][1] and x[2] >= exact[x[0]][2] for x in got)


def test_edges_and_blocks(spark):
    """Tight groups are found whole; small blocks make many block pairs."""
    rng = np.random.default_rng(0)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.01 * rng.standard_normal(16)).tolist(), 1) for i in range(60)]
    rows += [(100 + i, centre.tolist(), 1) for i in range(40)] + [(150, centre.tolist(), 2), (151, (3 * centre).tolist(), 2)]
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 16, 1), (203, [float("nan")] * 16, 1), (204, centre.tolist(), None),
             (205, [None] + [1.0] * 15, 1), (206, [float("inf")] + [1.0] * 15, 1), (None, centre.tolist(), 1),
             (207, [1.0, 2.0], 1), (207, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows],
                               "vec_id long, embedding array<double>, label int, rep string, codes string")
    assert _got(df, block=16) == brute(rows)
    assert embedding_dedup.dedup_embeddings(df.limit(0)).count() == 0
