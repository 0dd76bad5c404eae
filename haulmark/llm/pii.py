"""Personal data: patterns, and information-theoretic sanitisation of what is said around them.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Each found value is an entity to protect. Terms
(words of at least TERM_LETTERS letters within CONTEXT characters of a mention) are judged by how much they tell about
it, from document counts over the whole corpus: with p(e) the share of documents that mention the entity, p(t) that
hold the term and p(t, e) where it stands near the entity, a term discloses when the pointwise mutual information
reaches the share ALPHA of the entity's information, log(p(t, e) / (p(t) p(e))) >= -ALPHA log p(e). Only pairs seen in
SUPPORT different contexts are judged, so that copies of one text are no evidence. Disclosing terms are spans of their
own, kind ``term``, wherever they stand in a document that mentions the entity, outside base spans.

Only DataFrame functions are used.

Defined cases: a null text counts as empty and has no spans; repeated rows are separate documents; a null doc_id is a
document like any other; an empty table gives no rows. Spans count code points. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.llm._common import staged, text_or_empty

KINDS = ["email", "ip", "card", "phone", "term"]
ALPHA, SUPPORT, CONTEXT, TERM_LETTERS = 0.9, 3, 64, 3
#: Up to so many entities, terms or documents with terms are broadcast; beyond that the joins shuffle.
BROADCAST_ROWS = 50_000
#: Running results over an array are taken in stretches of so many elements.
BLOCK = 128
#: Possessive where the next class can't give back, and started only where a leftmost match can start, so that the
#: search is linear in the text. The matches are those of the plain patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(values: Column, use) -> Column:
    """Of each stretch of BLOCK elements, use(stretch)."""
    each = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
    return F.when(F.size(values) > 0, F.transform(each, lambda b: use(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))))


def _scan(values: Column, op) -> Column:
    """The running results of an associative op over array<int>: within stretches, then over the stretches' results, so that
    no array grows by more than a stretch's share of steps."""

    def grow(part: Column) -> Column:
        first = F.slice(part, F.lit(1), F.lit(1))
        return F.aggregate(F.slice(part, F.lit(2), F.size(part)), first, lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    def after(parts: Column) -> Column:
        return _let(
            grow(F.transform(parts, lambda p: F.element_at(p, -1))),
            lambda ends: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda x: op(F.get(ends, i - 1), x))))),
        )

    return F.when(F.size(values) > 0, _let(values, lambda v: _let(_blocks(v, grow), after))).otherwise(F.expr("cast(array() as array<int>)"))


def _pieces(text: Column, ranges: Column) -> Column:
    """The text's parts (from, to), which have rising ends: each is cut out of the stretch that its neighbours share, as a place
    in a text is found by counting from the front."""

    def cut(part: Column) -> Column:
        low, high = F.array_min(F.transform(part, lambda r: r["from"])), F.array_max(F.transform(part, lambda r: r["to"]))
        wide = F.struct(low.alias("at"), F.substring(text, low + 1, high - low).alias("text"))
        return _let(wide, lambda w: F.transform(part, lambda r: F.substring(w["text"], r["from"] - w["at"] + 1, r["to"] - r["from"])))

    return F.when(F.size(ranges) > 0, _let(ranges, lambda r: F.flatten(_blocks(r, cut)))).otherwise(F.expr("cast(array() as array<string>)"))


def found(text: Column, pattern: Column, ok=None) -> Column:
    """array<struct<start, end, value>> of the pattern's matches that are ok: the texts between matches give the places."""
    hits, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def placed(hits: Column) -> Column:
        ends = _scan(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h)), lambda a, x: a + x)
        return F.zip_with(ends, hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("value")))

    spans = _let(hits, lambda h: F.when(F.size(h) > 0, placed(h)).otherwise(empty))
    return F.filter(spans, lambda s: ok(s["value"])) if ok else spans


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets(value: Column) -> Column:
    short = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.coalesce(F.substring(short(p), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def _luhn(value: Column) -> Column:
    digits = _digits(value)

    def weigh(d: Column, i: Column) -> Column:
        twice = d.cast("int") * (1 + i % 2)
        return twice - F.when(twice > 9, 9).otherwise(0)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), lambda a, x: a + x)
    return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), total % 10 == 0).otherwise(False)


OK = {"email": None, "ip": _octets, "card": _luhn, "phone": lambda v: F.length(_digits(v)).between(10, 15)}


def spotted(docs: DataFrame) -> DataFrame:
    """(doc_id, rest, doc, tie, text, email, ip, card, phone): rest is a struct of the other columns, the last four are arrays
    of (start, end, value)."""
    rest = F.struct(F.lit(0).alias("_"), *(c for c in docs.columns if c not in ("doc_id", "text")))
    rows = docs.select(F.col("doc_id").cast("long"), rest.alias("rest"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", "rest", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("tie"), "text")
    need = {"email": "@", "ip": ".", "phone": "+"}
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    cols = {}
    for kind, pattern in PATTERNS.items():
        spans = found(F.col("text"), F.lit(pattern), OK[kind])
        cols[kind] = F.when(F.contains("text", F.lit(need[kind])), spans).otherwise(none) if kind in need else spans
    return rows.withColumns(cols)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def disclosing(found_: DataFrame) -> DataFrame:
    """spotted rows -> (doc, tie, terms): the terms to take out of each document that has any."""
    def entities_of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lower(s["value"]).alias("value")))

    def in_context(each: Column) -> Column:
        cut = lambda low, high: _pieces(F.col("text"), F.transform(each, lambda e: F.struct(low(e).alias("from"), high(e).alias("to"))))
        lefts = cut(lambda e: F.greatest(F.lit(0), e["start"] - CONTEXT), lambda e: e["start"])
        rights = cut(lambda e: e["end"], lambda e: e["end"] + CONTEXT)
        around = F.zip_with(lefts, rights, lambda x, y: F.struct(x.alias("left"), y.alias("right")))
        return F.zip_with(each, around, lambda e, c: F.struct(e.alias("e"), c["left"].alias("left"), c["right"].alias("right")))

    # each mention is found once and leaves with its context alone, not with the text
    every = F.array_sort(F.concat(*map(entities_of, PATTERNS)))
    own = found_.select("doc", "tie", F.length("text").alias("size"), F.explode(_let(every, in_context)).alias("m")).select("doc", "tie", "size", "m.*")
    # no parts of words: neither at the ends of the context nor where a mention starts or ends inside one
    left, right = F.col("left"), F.col("right")
    left = F.when(F.col("e.start") > CONTEXT, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    left = F.when(F.rlike("e.value", F.lit(r"^\p{L}")), F.regexp_replace(left, r"\p{L}+$", "")).otherwise(left)
    right = F.when(F.col("e.end") + CONTEXT < F.col("size"), F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
    right = F.when(F.rlike("e.value", F.lit(r"\p{L}$")), F.regexp_replace(right, r"^\p{L}+", "")).otherwise(right)
    near = F.concat(left, F.lit("\n"), right)
    mentions = staged(own.select("doc", "tie", F.concat_ws(":", "e.kind", "e.value").alias("entity"), F.lower(near).alias("near")), "mentions")
    contexts = mentions.select("entity", F.xxhash64("near").alias("context")).distinct().groupBy("entity").agg(F.count("*").alias("n"))
    entities = staged(contexts.where(F.col("n") >= SUPPORT).select("entity"), "entities")
    again = mentions.join(_small(entities), "entity", "left_semi")
    words = F.array_distinct(F.regexp_extract_all("near", F.lit(rf"(?<!\p{{L}})\p{{L}}{{{TERM_LETTERS},}}(?!\p{{L}})"), F.lit(0)))
    pairs = staged(again.select("doc", "tie", "entity", F.xxhash64("near").alias("context"), F.explode(words).alias("term")), "pairs")
    support = pairs.select("term", "entity", "context").distinct().groupBy("term", "entity").agg(F.count("*").alias("n"))
    together = pairs.select("term", "entity", "doc", "tie").distinct().groupBy("term", "entity").agg(F.count("*").alias("both"))
    together = support.where(F.col("n") >= SUPPORT).join(together, ["term", "entity"]).select("term", "entity", "both")
    with_entity = mentions.join(_small(entities), "entity", "left_semi").select("entity", "doc", "tie").distinct().groupBy("entity").agg(F.count("*").alias("with_entity"))
    judged = staged(together.join(with_entity, "entity"), "judged")
    documents = F.lit(float(max(1, found_.select("doc").count())))
    told = F.log(F.col("both") * documents / (F.col("with_term") * F.col("with_entity")))
    bad = told >= ALPHA * F.log(documents / F.col("with_entity"))
    # documents with the term near any mention are a lower bound of those that hold it: most terms are out by that alone
    somewhere = mentions.select("doc", "tie", F.explode(words).alias("term")).distinct().groupBy("term").agg(F.count("*").alias("with_term"))
    judged = staged(judged.join(somewhere, "term").where(bad).drop("with_term"), "open")
    terms = staged(judged.select("term").distinct(), "terms")
    own_words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{{TERM_LETTERS},}}"), F.lit(0)))
    with_term = found_.select(F.explode(own_words).alias("term")).join(_small(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("with_term"))
    bad = staged(judged.join(with_term, "term").where(bad).select("term", "entity"), "bad")
    return mentions.join(_small(bad), "entity").groupBy("doc", "tie").agg(F.collect_set("term").alias("terms"))


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, rest, text, spans): spans are array<struct<start, kind, end>> by start, then kind (its number in KINDS)."""
    rows = spotted(docs)
    terms = staged(disclosing(rows), "doc_terms")
    rows = rows.join(_small(terms), ["doc", "tie"], "left")
    number = lambda kind: F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))
    rows = rows.select("doc_id", "rest", "text", "terms", F.concat(*map(number, PATTERNS)).alias("base"))
    wanted = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    extra = F.transform(found(F.col("text"), wanted), lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("kind"), s["end"].alias("end")))
    spans = F.when(F.col("terms").isNotNull(), _let(F.array_sort(F.concat("base", extra)), _clear)).otherwise(F.array_sort("base"))
    return rows.select("doc_id", "rest", "text", spans.alias("spans"))


def _clear(spans: Column) -> Column:
    """Sorted spans without the terms that overlap a base span: one that starts no later, or one that starts later."""
    ends = _scan(F.transform(spans, lambda s: F.when(s["kind"] < 4, s["end"]).otherwise(0)), F.greatest)
    begins = F.transform(F.reverse(spans), lambda s: F.when(s["kind"] < 4, s["start"]).otherwise((1 << 31) - 1))
    begins = F.reverse(_scan(begins, F.least))
    told = F.zip_with(F.zip_with(ends, begins, lambda e, b: F.struct(e.alias("before"), b.alias("after"))), spans, lambda x, s: F.struct(x.alias("x"), s.alias("s")))
    apart = F.filter(told, lambda t: (t["s"]["kind"] < 4) | (t["x"]["before"] <= t["s"]["start"]) & (t["s"]["end"] <= t["x"]["after"]))
    return F.transform(apart, lambda t: t["s"])


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span generalised to its kind; overlapping spans become one, named by the first."""
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def done(ends: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
        ranges = F.zip_with(before, spans, lambda b, s: F.struct(b.alias("from"), F.greatest(b, s["start"]).alias("to")))
        apart = F.zip_with(before, spans, lambda b, s: F.when(s["start"] >= b, F.element_at(marks, s["kind"] + 1)).otherwise(""))
        parts = F.zip_with(_pieces(text, ranges), apart, lambda p, m: F.concat(p, m))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))

    ends = _scan(F.transform(spans, lambda s: s["end"]), F.greatest)
    return F.when(F.size(spans) > 0, _let(ends, done)).otherwise(text)


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with all spans generalised in text; n_chars, if there is one, follows."""
    rows = personal_spans(docs).withColumn("text", redacted(F.col("text"), F.col("spans")))
    of = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    out = rows.select(*(of.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
