import hashlib
from collections import defaultdict

from shardline.llm import line_dedup

BLANKS = " \t\n\x0b\f\r"


def _key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(_key(line)) >= 20:
                held[_key(line)].add(i)
    keeper = {k: max(x for x in v if x is not None) for k, v in held.items() if len(v - {None}) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if _key(x) not in keeper or keeper[_key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def _rows(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=str)


def test_matches_brute_force(small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.select("doc_id", "text").collect()]
    assert _rows(line_dedup.line_dedup_digest(small_docs)) == sorted(brute(rows), key=str)


def test_edges_and_shared_lines(spark, edge):
    line = "  A shared line of More than twenty characters\t"
    extra = [(20, f"{line}\nown {line}"), (21, line.strip().upper()), (22, f"x\n{line}\n{line}"), (None, line),
             (23, "nineteen characters"), (24, "nineteen characters"), (25, "nineteen characters")]
    rows = [(r.doc_id, r.text) for r in edge.collect()] + extra
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _rows(line_dedup.line_dedup_digest(df)) == sorted(brute(rows), key=str)
    assert line_dedup.dedup_lines(edge).count() == edge.count()


def test_empty(spark, small_docs):
    assert line_dedup.line_dedup_digest(small_docs.limit(0)).count() == 0
