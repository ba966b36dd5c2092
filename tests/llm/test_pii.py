import hashlib
import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from shardline.llm import pii

#: The contract's patterns as they stand there.
GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _ok(kind, s):
    digits = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in s.split(".")),
            "card": 12 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    spans = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(GIVEN.items())
             for m in re.finditer(p, text or "") if _ok(k, m.group())]
    return sorted(spans)


def _render(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def _check(df):
    rows = df.select("doc_id", "text").collect()
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.pii_digest(df).collect()), key=str)
    want = []
    for r in rows:
        spans = brute(r.text)
        want.append((r.doc_id, *(sum(s[3] == k for s in spans) for k in GIVEN),
                     hashlib.sha256(_render(spans).encode()).hexdigest()))
    assert got == sorted(want, key=str)


TRICKY = ["a@b.c+d@e.f x", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.0004", "4111-1111 1111 1111", "+49 (30) 1234-567",
          "a@b a@b..c a@b.c.d.", "é@ü.de mé.b@x-y.org", "+1+22222222222", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0",
          "x" * 50_000 + "@", "7" * 50_000, "a@" + "b." * 20_000 + "c", "1." * 20_000, "+" + "1 " * 20_000, "+1 " * 20_000]


def test_base_spans_equal_the_patterns(spark, docs, edge):
    _check(docs)
    _check(edge)
    _check(spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string"))
    assert pii.pii_digest(docs.limit(0)).count() == 0


@settings(max_examples=25, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("a1259.@+- ()é"), max_size=60), min_size=20, max_size=60))
def test_any_text(spark, texts):
    _check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def _word(i, letters="abcdefghij"):
    return "".join(letters[int(c)] for c in f"{i:06d}")


def _filler(i, n=24):
    """Words of its own for each text, so that no two texts share most of theirs."""
    return " ".join(_word(1000 * i + k) for k in range(n))


def _corpus(near=(), others=300):
    """Nicknames of an address, of a mail domain and of one that only has copies."""
    rows = [(i, f"Zorblax {_filler(i)} please write soon to zed@x.org") for i in range(4)]
    rows += [(10 + i, f"{_word(i, 'qrstuvwxyz')}{i}@team.example {_filler(10 + i)} Borogove please") for i in range(8)]
    rows += [(20, f"{_filler(20)} nobody but borogove"), (21, f"{_filler(21)} soon but zorblax")]
    rows += list(near)
    rows += [(10_000 + i, f"{_filler(1000 + i)} please write soon") for i in range(others)]
    return rows


def test_revealing_terms(spark):
    """A term is marked in every document, classes of entities count, common words don't."""
    rows = _corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = {r.doc_id: r.spans.split(",") for r in pii.pii_digest(df).collect()}
    texts = dict(rows)
    for i, term in [(k, "Zorblax") for k in range(4)] + [(10 + k, "Borogove") for k in range(8)] + [(20, "borogove"), (21, "zorblax")]:
        at = texts[i].index(term)
        assert f"term:{at}:{at + len(term)}" in spans[i], (i, term)
    assert all(len([x for x in s if x.startswith("term")]) == (i < 22) for i, s in spans.items())
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "orogove" not in clean[20] and "nobody but" in clean[20]
    assert "Zorblax" not in clean[1] and "<EMAIL>" in clean[1] and "please write soon" in clean[1]


def test_near_copies_tell_nothing(spark):
    """Texts that differ in a few words are one piece of evidence, however many there are and
    however large the corpus is."""
    own = " ".join(_word(500_000 + k) for k in range(20))
    for others in (100, 2000):
        near = [(100, f"{own} bob@two.example first"), (101, f"{own} bob@two.example second")]
        near += [(200 + i, f"{own.replace('f', 'k')} eve@three.example {_word(700_000 + i)}") for i in range(40)]
        df = spark.createDataFrame(_corpus(near, others), "doc_id long, text string").repartition(4)
        got = {r.doc_id: r for r in pii.pii_digest(df).filter("doc_id < 300").collect()}
        assert not [i for i in (100, 101, *range(200, 240)) if "term" in got[i].spans]
        assert all("term" in got[i].spans for i in (0, 1, 2, 3, 10, 17, 20, 21))
        clean = {r.doc_id: r.text for r in pii.sanitise(df).filter("doc_id = 100").collect()}
        assert clean[100] == f"{own} <EMAIL> first"


def test_estimates_equal_brute_force(spark):
    """n_e, n_t, n_et, the group left out, P(e|t) and disclosure of every pair within the bounds."""
    near = [(100 + i, f"{_filler(50)} ann@team.example Borogove {_word(900_000 + i)}") for i in range(5)]
    rows = _corpus(near, 60)
    df = spark.createDataFrame([(i, i, t) for i, t in rows], "id long, th long, text string")
    base = pii.base_of(df)
    got = {(r.entity, r.term): (r.n_e, r.n_t, r.n_et, r.top, round(r.given, 9), round(r.disclosure, 9))
           for r in pii.estimates(df, base, len(rows), 0.5, 3, 0.5).collect()}
    ents = {i: r.entities or [] for i, r in ((r.id, r) for r in base.collect())}
    words = {i: {w.lower() for w in re.findall(r"[^\W\d_]{4,}", re.sub(GIVEN["email"], " ", t))} for i, t in rows}
    group = {i: 100 if 100 <= i < 105 else i for i in words}  # the near copies; all others share few words
    want = {}
    for e in {x for v in ents.values() for x in v}:
        have = [i for i in ents if e in ents[i]]
        for t in {w for i in have for w in words[i]}:
            both = [i for i in have if t in words[i]]
            sizes = [sum(group[i] == g for i in both) for g in {group[i] for i in both}]
            n_t, p = sum(t in w for w in words.values()), len(have) / len(rows)
            given = (len(both) - max(sizes) + 0.5 * p) / (n_t - max(sizes) + 0.5)
            share = math.log(given / p) / -math.log(p)
            if len(sizes) >= 3 and given >= 0.5 and share >= 0.5:
                want[e, t] = (len(have), n_t, len(both), max(sizes), round(given, 9), round(share, 9))
    assert got == want and ("domain:team.example", "borogove") in want and ("email:zed@x.org", "zorblax") in want


def test_sanitise_edges(spark, edge):
    """Every row comes back once, with all its columns; only texts change."""
    got = pii.sanitise(edge)
    assert got.columns == edge.columns
    rows = {(r.doc_id, r.text) for r in got.collect()}
    assert got.count() == edge.count() and (1, None) in rows and (2, "") in rows
    assert (11, "<EMAIL> <IP> +49 30 1234567 4111 1111 1111 1111") in rows  # one run of too many digits
    assert pii.sanitise(edge.limit(0)).count() == 0
