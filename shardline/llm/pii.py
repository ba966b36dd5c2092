"""Personal data: base patterns, and information-theoretic sanitisation of the
terms that give a protected entity away.

Base spans are found by patterns: e-mail and IP addresses, card and phone numbers.
Each distinct match is a protected entity, and so are the classes that it belongs to:
mail domain, account stem (no tag, no digits at the end), network of an IP address,
issuer of a card, number range of a phone. A term is a word of four letters or more
outside the base spans. Over all N documents we count those with the entity, n_e, with
the term, n_t, and with both anywhere in them, n_et. How strongly the term reveals the
entity is the share of the entity's information that it carries:

    disclosure = PMI(entity; term) / IC(entity) = log(P(e|t) / p) / log(1 / p),  p = n_e / N

1 means that who sees the term knows the entity. P(e|t) is a deleted estimate, smoothed
with ``smoothing`` documents of the corpus at large: what the other documents say of a
term when the group of copies that has most documents, c, of those with both is left out,

    P(e|t) = (n_et - c + smoothing * p) / (n_t - c + smoothing)

Texts that share most of their words are one group of copies: those that agree in one of
``BANDS`` bands of ``ROWS`` minima of hashed words, and what these connect. So a text
tells nothing of its own words, however often it is copied or how its copies are varied. For
a rare entity the share of information alone would be near 1 for any pair, the more
so the larger the corpus; a pair counts only if it is in ``support`` groups or more and
the entity is more likely than not among the documents with the term, P(e|t) >= 1/2. Both
bounds are the same at every size.

Terms of a disclosure of ``remove_from`` or more for any entity are removed, those of
``generalise_from`` or more generalised, wherever they occur outside base spans, also in
documents without an entity. The method only adds spans, of kind ``term``; the base
spans stay.

Only Spark's own functions run. Counts are summed up by term or pair before they
meet, and joins read plain scans, so that an entity or term of a third of all
documents can be split over tasks. Pairs are formed of entities and terms of ``support``
texts or more only, and n_t is counted over the corpus for the terms only whose count among
the texts with entities leaves the bounds in reach.

Defined results: a null text counts as empty and has no spans; rows that repeat a
doc_id are documents of their own, told apart by their texts; an empty table gives an empty result. Offsets are code points, ends
exclusive. Only the id and text columns are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardline.llm.common import drop_staged, let, may_contain, staged, text_key
from shardline.llm.components import connected

#: The kinds in their order, and the contract's patterns. Runs that a
#: match can only take whole are possessive, and a start inside a run is skipped unless
#: the last match ended there (\G), so that very long runs cost linear time.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text can hold a match at all.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"\p{L}{4,}+"
SMOOTHING, GENERALISE_FROM, REMOVE_FROM, SUPPORT, LIKELY = 0.5, 0.8, 0.95, 3, 0.5
BANDS, ROWS = 8, 5
SPAN = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"


def located(text: Column, pattern: str | Column, kind: str = "", order: int = 0) -> Column:
    """All matches as spans, leftmost and not overlapping. Positions follow from the
    lengths of the pieces between the matches."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.transform(pieces, F.char_length).alias("gap"), hits.alias("hit"))
    begin = F.struct(F.lit(0).alias("at"), F.expr("array()").cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = (acc["at"] + x["0"]).cast("int")
        end = (start + F.char_length(x["1"])).cast("int")
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"),
                        F.lit(kind).alias("kind"), x["1"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).cast(SPAN).alias("out"))

    pairs = F.filter(F.transform(zipped, lambda z: F.struct(z["gap"].alias("0"), z["hit"].alias("1"))),
                     lambda z: z["1"].isNotNull())
    return F.aggregate(pairs, begin, step)["out"]


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (
            F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (
            F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = F.regexp_replace(value, r"[\x20-]", "")
        return F.char_length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans, by start and then kind."""
    none = F.expr("array()").cast(SPAN)

    def of_kind(i: int, k: str) -> Column:
        return F.filter(located(text, PATTERNS[k], kind=k, order=i), lambda s: _valid(k, s["value"]))

    found = [F.when(text.rlike(NEEDS[k]), of_kind(i, k)).otherwise(none) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*found))


def rendered(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of the spans, all other characters where they were."""
    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        blank = F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], acc["at"]), F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, blank).alias("out"))

    state = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    whole = let(state, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.lit(2 ** 31 - 1))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def words_in(text: Column) -> Column:
    """The distinct words of a masked text that can be terms, as they are written."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def entities_of(span: Column) -> Column:
    """The protected entity of a base span and the classes it belongs to."""
    digits, low = F.regexp_replace(span["value"], "[^0-9]", ""), F.lower(span["value"])
    named = lambda name, v: F.concat(F.lit(name + ":"), v)
    stem = F.regexp_replace(F.regexp_replace(F.substring_index(low, "@", 1), r"\+.*", ""), r"[0-9]+$", "")
    return (F.when(span["kind"] == "email", F.array(
                named("email", low), named("domain", F.substring_index(low, "@", -1)),
                named("stem", F.when(stem != "", stem).otherwise(low))))
            .when(span["kind"] == "ip", F.array(named("ip", low), named("network", F.substring_index(low, ".", 3))))
            .when(span["kind"] == "card", F.array(named("card", digits), named("issuer", F.left(digits, F.lit(6)))))
            .otherwise(F.array(named("phone", digits), named("range", F.left(digits, F.char_length(digits) - 4)))))


def copy_groups(texts: DataFrame) -> DataFrame:
    """(th, g): the least key of the texts that share most words with th, by ``terms``.
    Copies of shared words agree in all of a band's minima with probability J**ROWS."""
    least = lambda n: F.array_min(F.transform("hashes", lambda h: F.xxhash64(h, F.lit(n))))
    bands = F.array(*(F.xxhash64(F.lit(b), *(least(b * ROWS + r) for r in range(ROWS))) for b in range(BANDS)))
    hashed = texts.filter(F.size("terms") > 0).select("th", F.transform("terms", lambda t: F.xxhash64(t)).alias("hashes"))
    banded = staged(hashed.select("th", F.explode(bands).alias("band")), "pii-bands")
    first = banded.groupBy("band").agg(F.min("th").alias("m"), F.max("th").alias("x")).filter("m < x").select("band", "m")
    edges = staged(banded.join(first, "band").filter("th <> m").select(F.col("th").alias("a"), F.col("m").alias("b"))
                   .distinct(), "pii-copies")
    found = connected(edges)
    out = staged(texts.select("th").join(found, F.col("th") == F.col("node"), "left").select(
        "th", F.coalesce("component", "th").alias("g")), "pii-groups")
    drop_staged(banded, edges)
    return out


def estimates(docs: DataFrame, base: DataFrame, total: int, smoothing: float, support: int,
              least: float) -> DataFrame:
    """(entity, term, n_e, n_t, n_et, top, given, disclosure) of the pairs within the bounds."""
    texts = staged(base.filter("entities IS NOT NULL").groupBy("th").agg(
        F.sum("copies").alias("c"), F.any_value("entities").alias("entities"),
        F.array_distinct(F.transform(F.any_value("words"), F.lower)).alias("terms")), "pii-texts")
    named = texts.select("th", "c", F.explode("entities").alias("entity"))
    repeated = staged(named.groupBy("entity").agg(F.sum("c").alias("n_e"), F.count("*").alias("n_texts"))
                      .filter((F.col("n_texts") >= support) & (F.col("n_e") < total)).select("entity", "n_e"),
                      "pii-entities")
    said = texts.select("c", F.explode("terms").alias("term"))
    common = staged(said.groupBy("term").agg(F.sum("c").alias("m_t"), F.count("*").alias("n_texts"))
                    .filter(F.col("n_texts") >= support).select("term", "m_t"), "pii-common")
    found = staged(may_contain(named.select("th", "entity"), F.xxhash64("entity"), repeated, F.xxhash64("entity"))
                   .join(repeated, "entity"), "pii-named")
    ths = found.select("th").distinct()
    near = copy_groups(texts.join(ths, "th", "left_semi"))
    of_text = found.groupBy("th").agg(F.collect_list(F.struct("entity", "n_e")).alias("found"))
    told = (texts.select("th", "c", "terms").join(of_text, "th").join(near, "th")
            .select("g", "c", "found", F.explode("terms").alias("term")))
    told = may_contain(told, F.xxhash64("term"), common, F.xxhash64("term"))
    by_group = (told.select("g", "c", "term", F.explode("found").alias("e"))
                .groupBy("e.entity", "e.n_e", "term", "g").agg(F.sum("c").alias("c")))
    pairs = staged(by_group.groupBy("entity", "n_e", "term").agg(
        F.sum("c").alias("n_et"), F.max("c").alias("top"), F.count("*").alias("n_groups"))
        .filter(F.col("n_groups") >= support), "pii-pairs")
    p = F.col("n_e") / F.lit(float(total))
    given = lambda n: ((F.col("n_et") - F.col("top") + F.lit(float(smoothing)) * p)
                       / (n - F.col("top") + F.lit(float(smoothing))))
    # log(given / p) / -log(p) >= least means given >= p ** (1 - least)
    bound = F.greatest(F.lit(LIKELY), F.pow(p, F.lit(1.0 - least)))
    likely = staged(pairs.join(common, "term").filter(given(F.col("m_t")) >= bound * 0.999).drop("m_t"), "pii-likely")
    wanted = staged(likely.select("term").distinct(), "pii-wanted")
    everywhere = docs.select(F.explode(F.array_distinct(F.transform(let(base_spans(F.col("text")), lambda b: words_in(
        masked(F.col("text"), b))), F.lower))).alias("term"))
    counted = (may_contain(everywhere, F.xxhash64("term"), wanted, F.xxhash64("term")).groupBy("term")
               .agg(F.count("*").alias("n_t")).join(wanted, "term", "left_semi"))
    out = staged(likely.join(counted, "term").withColumn("given", given(F.col("n_t")))
                 .withColumn("disclosure", F.log(F.col("given") / p) / -F.log(p))
                 .filter((F.col("given") >= LIKELY) & (F.col("disclosure") >= least))
                 .select("entity", "term", "n_e", "n_t", "n_et", "top", "given", "disclosure"), "pii-estimates")
    drop_staged(texts, repeated, common, found, near, pairs, likely, wanted)
    return out


def _revealing(docs: DataFrame, base: DataFrame, total: int, smoothing: float, generalise_from: float,
               remove_from: float, support: int) -> DataFrame:
    """(term, action) of the terms that give a protected entity away."""
    found = estimates(docs, base, total, smoothing, support, generalise_from)
    out = staged(found.groupBy("term").agg(F.max("disclosure").alias("disclosure")).select(
        "term", F.when(F.col("disclosure") >= remove_from, "remove").otherwise("generalise").alias("action")),
        "pii-revealing")
    drop_staged(found)
    return out


def base_of(docs: DataFrame) -> DataFrame:
    """(id, th, copies, base, entities, words) of each distinct (id, th) of ``docs``; entities
    and words are null without a base span."""
    some = lambda b, value: F.when(F.size(b) > 0, value)
    found = let(base_spans(F.col("text")), lambda b: F.struct(
        b.alias("base"), some(b, F.array_distinct(F.flatten(F.transform(b, entities_of)))).alias("entities"),
        some(b, words_in(masked(F.col("text"), b))).alias("words")))
    return staged(docs.select("id", "th", found.alias("found")).groupBy("id", "th").agg(
        F.any_value("found").alias("found"), F.count("*").alias("copies")).select("id", "th", "copies", "found.*"),
        "pii-base")


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", smoothing: float = SMOOTHING,
             generalise_from: float = GENERALISE_FROM, remove_from: float = REMOVE_FROM,
             support: int = SUPPORT) -> DataFrame:
    """(id, th, base, terms): per distinct (id, text) the base spans and the added
    spans; a term's ``value`` is what becomes of it, ``remove`` or ``generalise``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("th"), text.alias("text"))
    base = base_of(docs)
    total = base.agg(F.sum("copies")).first()[0] or 0
    revealing = _revealing(docs, base, total, smoothing, generalise_from, remove_from, support)
    said = docs.select("id", "th", F.explode(let(base_spans(F.col("text")), lambda b: words_in(
        masked(F.col("text"), b)))).alias("word")).withColumn("term", F.lower("word"))
    held = staged(may_contain(said, F.xxhash64("term"), revealing, F.xxhash64("term")).join(revealing, "term")
                  .groupBy("id", "th").agg(F.map_from_entries(F.collect_set(F.struct("word", "action"))).alias("actions"))
                  .select(F.col("id").alias("hid"), F.col("th").alias("hth"), "actions"), "pii-held")
    some_docs = may_contain(docs, F.xxhash64("id", "th"), held, F.xxhash64("hid", "hth"))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.map_keys("actions"), "|"), F.lit(r")(?!\p{L})"))
    places = let(base_spans(F.col("text")), lambda b: located(masked(F.col("text"), b), pattern, "term", len(KINDS)))
    added = staged(some_docs.join(held, F.col("id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth")))
                   .select("id", "th", F.transform(places, lambda t: t.withField("value", F.col("actions")[t["value"]]))
                           .alias("terms")).dropDuplicates(["id", "th"])
                   .select(F.col("id").alias("aid"), F.col("th").alias("ath"), "terms"), "pii-added")
    out = (base.select("id", "th", "base")
           .join(added, F.col("id").eqNullSafe(F.col("aid")) & (F.col("th") == F.col("ath")), "left")
           .select("id", "th", "base", F.coalesce("terms", F.expr("array()").cast(SPAN)).alias("terms")))
    drop_staged(revealing, held)
    return out


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input rows with a ``text`` without personal data: base spans become
    <KIND>, generalised terms <TERM>, removed ones go. Of spans that overlap the
    first one is replaced, with all that the later ones add cut as well."""
    spans = find_pii(df, id_col, text_col, **options).select(
        F.col("id").alias("sid"), F.col("th").alias("sth"), F.array_sort(F.concat("base", "terms")).alias("spans"))
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("th"))
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["kind"] != "term", F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).when(
            s["value"] == "generalise", F.lit("<TERM>")).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.concat(acc["out"], gap, F.when(s["start"] >= acc["at"], mark).otherwise("")).alias("out"))

    state = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("sid")) & (F.col("th") == F.col("sth")), "left")
    clean = F.concat(state["out"], F.substring(text, state["at"] + 1, F.lit(2 ** 31 - 1)))
    return joined.select(*(F.col("row").getField(c).alias(c) if c != text_col else
                           F.when(F.col("row").getField(c).isNotNull(), clean).alias(c) for c in df.columns))


def pii_digest(df: DataFrame) -> DataFrame:
    """The contract's columns, one row per row of ``df``."""
    found = find_pii(df.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.array_sort(F.concat("base", "terms"))
    digest = found.select(F.col("id").alias("did"), F.col("th").alias("dth"), *(count(k) for k in KINDS),
                          F.sha2(F.encode(rendered(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
                          rendered(every).alias("spans"))
    rows = df.select("doc_id", text_key(F.col("text")).alias("th"))
    return (rows.join(digest, F.col("doc_id").eqNullSafe(F.col("did")) & (F.col("th") == F.col("dth")), "left")
            .select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"))
