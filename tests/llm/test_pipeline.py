import corpus_pipeline
from shardline.llm.common import staged
from tests.conftest import SF_CHECK
from tests.llm.test_line_dedup import _key
from tests.llm.test_ngram_join import brute


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    columns, now = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, staged(stage(spark, now, SF_CHECK), "test-stage")
        seen[name] = (before, now)
        if name != "packing":
            assert now.columns == columns
            assert now.join(before, "doc_id", "left_anti").count() == 0
    before, after = seen["line dedup"]
    assert before.count() == after.count()
    lines = {}
    for r in after.collect():
        for k in map(_key, r.text.split("\n")):
            if len(k) >= 20:
                lines.setdefault(k, set()).add(r.doc_id)
        assert r.n_chars == len(r.text)
    whole = {}
    for r in before.collect():
        for k in map(_key, r.text.split("\n")):
            if len(k) >= 20:
                whole.setdefault(k, set()).add(r.doc_id)
    assert all(lines[k] == ({max(v)} if len(v) >= 3 else v) for k, v in whole.items())
    before, after = seen["n-gram Jaccard join"]
    keep = {d for d, _, c in brute([(r.doc_id, r.text) for r in before.collect()]) if d == c}
    assert {r.doc_id for r in after.collect()} == keep
    before, after = seen["benchmark decontamination"]
    assert 0 < after.count() <= before.count()
    before, packed = seen["packing"]
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}


def test_edge_rows(spark, edge):
    now = edge
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = staged(stage(spark, now, SF_CHECK), "test-stage")
        assert now.columns == edge.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF_CHECK).count() > 0


def test_unused_arrow_memory_goes_back(monkeypatch):
    """Arrow's pool gives its free memory back behind each result and at the end, once
    the function holds nothing any more."""
    import pyarrow as pa

    from shardline.llm import common

    seen = []

    class Pool:
        def release_unused(self):
            seen.append("back")

    monkeypatch.setattr(pa, "default_memory_pool", Pool)

    @common.giving_back
    def doubled(batches):
        for x in batches:
            yield 2 * x
        seen.append("over")

    for x in doubled([1, 2]):
        seen.append(x)
    assert seen == [2, "back", 4, "back", "over", "back"]
