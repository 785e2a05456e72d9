"""Personal data: fixed patterns, and terms that give protected entities away, with DataFrame functions only.

Base spans are the leftmost non-overlapping matches of four patterns, checked after the match. Beyond them, the corpus
itself tells which terms reveal an entity. The disclosure of a term t for e is PMI(e; t) / IC(e), with IC(e) = -log2 p(e)
and PMI(e; t) = log2(p(e | t) / p(e)), counted over the whole corpus: 1 if t never occurs without e. A term from REMOVE
on is removed, one from GENERALISE on is replaced by a more general one, its beginning. There are two sorts of e:

- One entity, that is one value. The term must stand within NEAR words of it in SUPPORT different surroundings, so that
  copies of one passage do not make all its rare words look telling. It is looked for in documents with that entity.
- A class of entities: any one, or one of a kind. p(e | t) is the lower end of a confidence interval (Wilson's, DEVIATIONS
  standard deviations), in which documents with one and the same entity, copies above all, are one piece of evidence
  and every document with the term but no entity of the class counts against it. It is looked for in all documents.

Counts are partial sums before a shuffle, an entity's terms are rows and not lists, so a frequent word or entity is not
one task's work. Up to FEW terms of classes are looked for by one pattern; more are joined with the documents' words.

Edge cases: a null text is an empty one; rows repeated with one id and text get the same spans; matches that fail their
check are dropped and not tried again; extra columns are kept by protect(), internal ones start with "_p_"; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

#: Patterns as fixed, each with a start that can't lie inside a longer run, which changes no match but saves retries.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: A cheap sign that a text may hold one.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Words on either side of an entity that are its surroundings.
NEAR = 8
SUPPORT = 3
#: Different entities of a class that a term must stand with in a document, and the width of the confidence interval.
CLASS_SUPPORT, DEVIATIONS = 5, 2.58
FEW = 1000
#: Matches that one step of a walk along a text takes.
STEP = 128
GENERALISE, REMOVE = 0.75, 0.9
TERM = r"[\p{L}\p{N}_]{3,}"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "removed": ""}
KEYS = ["_p_none", "_p_id", "_p_key"]
SPAN = "array<struct<start: int, end: int, value: string>>"
KINDED = "array<struct<kind: string, start: int, end: int, value: string>>"


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda m: _valid(kind, m["value"])


def _tag(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))


def none(kind: str = SPAN) -> Column:
    return F.expr(f"cast(array() as {kind})")


def matches(text: Column, pattern: Column | str) -> Column:
    """array<struct<start, end, value>> of all matches, in code points from 0.

    Splitting by the pattern gives what stands between the matches, so the positions are sums of lengths. The sums run in
    stretches of STEP matches, whose lists are joined at the end, so that a text of very many matches stays cheap.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("value")))
    return F.element_at(F.transform(F.array(steps), _placed), 1)  # as a lambda's variable, the steps are found once


def _placed(steps: Column) -> Column:
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / STEP).cast("int")), lambda k: F.slice(steps, k * STEP + 1, F.lit(STEP)))

    def walk(start: Column, stretch: Column) -> Column:
        return F.aggregate(
            stretch,
            F.struct(start.alias("at"), none().alias("out")),
            lambda a, s: F.struct(
                (a["at"] + s["gap"] + F.length(s["value"])).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + s["gap"]).alias("start"), (a["at"] + s["gap"] + F.length(s["value"])).alias("end"), s["value"].alias("value")))).alias("out"),
            ),
            lambda a: a["out"],
        )

    whole = F.aggregate(
        stretches,
        F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out")),
        lambda a, stretch: F.struct(
            F.aggregate(stretch, a["at"], lambda at, s: at + s["gap"] + F.length(s["value"])).alias("at"),
            F.concat(a["out"], F.array(walk(a["at"], stretch))).alias("out"),
        ),
        lambda a: F.flatten(a["out"]),
    )
    return F.when(F.size(steps) > 0, whole).otherwise(none())


def base_spans(text: Column) -> dict[str, Column]:
    """kind -> array<struct<start, end, value>> of the valid matches."""
    out = {}
    for kind, pattern in KINDS.items():
        out[kind] = F.when(text.rlike(SIGNS[kind]), F.filter(matches(text, pattern), _check(kind))).otherwise(none())
    return out


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def entities_of(found: DataFrame) -> DataFrame:
    return found.select(*KEYS, "_p_text", F.explode("_p_base").alias("_p_span")).withColumn("_p_entity", F.concat_ws(":", "_p_span.kind", "_p_span.value"))


def disclosure(share: Column, rate: Column) -> Column:
    """PMI / IC of a class with this rate, for a term with this share of its occurrences."""
    return F.log2(share / rate) / -F.log2(rate)


def lower_share(hits: Column, total: Column) -> Column:
    """The lower end of Wilson's interval for hits of total."""
    z = F.lit(DEVIATIONS)
    p = hits / total
    return (p + z * z / (2 * total) - z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total))) / (1 + z * z / total)


def telling_terms(found: DataFrame, held: DataFrame, total: int) -> DataFrame:
    """(_p_entity, _p_term, _p_disclosure) for the pairs of one entity and a term from GENERALISE on.

    found: a row for each document with an entity: KEYS, _p_text and the base spans. held: _p_term and _p_held, the
    number of documents with it.
    """
    entities = entities_of(found)
    before = F.reverse(F.slice(F.reverse(words_of(F.substring(F.col("_p_text"), F.greatest(F.col("_p_span.start") - 199, F.lit(1)), F.least(F.col("_p_span.start"), F.lit(200))))), 1, NEAR))
    after = F.slice(words_of(F.substring(F.col("_p_text"), F.col("_p_span.end") + 1, F.lit(200))), 1, NEAR)
    near = entities.withColumn("_p_near", F.array_except(F.concat(before, after), words_of(F.col("_p_span.value"))))
    near = near.select(*KEYS, "_p_entity", "_p_near", F.xxhash64("_p_near").alias("_p_around"))
    pairs = near.select(*KEYS, "_p_entity", "_p_around", F.explode("_p_near").alias("_p_term"))
    around = pairs.select("_p_entity", "_p_term", "_p_around").distinct().groupBy("_p_entity", "_p_term").agg(F.count("*").alias("_p_places")).where(F.col("_p_places") >= SUPPORT)
    together = pairs.select(*KEYS, "_p_entity", "_p_term").distinct().groupBy("_p_entity", "_p_term").agg(F.count("*").alias("_p_both"))
    with_entity = entities.select(*KEYS, "_p_entity").distinct().groupBy("_p_entity").agg(F.count("*").alias("_p_docs"))
    likely = cut(around.join(together, ["_p_entity", "_p_term"]).join(with_entity, "_p_entity"), narrow=True)
    if likely.isEmpty():
        return likely.select("_p_entity", "_p_term", F.lit(0.0).alias("_p_disclosure"))
    told = likely.join(held, "_p_term").withColumn("_p_disclosure", disclosure(F.col("_p_both") / F.col("_p_held"), F.col("_p_docs") / F.lit(float(total))))
    return told.where((F.col("_p_docs") < total) & (F.col("_p_disclosure") >= GENERALISE)).select("_p_entity", "_p_term", "_p_disclosure")


def telling_of_classes(found: DataFrame, held: DataFrame, total: int) -> DataFrame:
    """(_p_term, _p_disclosure) for the terms that tell a class of entities from GENERALISE on, the most for any class."""
    values = lambda kind: F.transform(F.filter("_p_base", lambda s: (s["kind"] == kind) if kind else F.lit(True)), lambda s: F.concat_ws(":", s["kind"], s["value"]))
    classes = F.array(*(F.struct(F.lit(kind or "any").alias("name"), F.array_min(values(kind)).alias("one")) for kind in (None, *KINDS)))
    inside = words_of(F.array_join(F.transform("_p_base", lambda s: s["value"]), " "))
    rows = found.select("_p_rows", F.filter(classes, lambda c: c["one"].isNotNull()).alias("_p_classes"), F.array_except(words_of(F.col("_p_text")), inside).alias("_p_words"))
    rates = rows.select("_p_rows", F.explode("_p_classes.name").alias("_p_class")).groupBy("_p_class").agg((F.sum("_p_rows") / F.lit(float(total))).alias("_p_rate"))  # a row a class
    pairs = rows.select("_p_rows", "_p_words", F.explode("_p_classes").alias("_p_c")).select("_p_rows", F.col("_p_c.name").alias("_p_class"), F.col("_p_c.one").alias("_p_one"), F.explode("_p_words").alias("_p_term"))
    pairs = pairs.groupBy("_p_class", "_p_term", "_p_one").agg(F.sum("_p_rows").alias("_p_docs")).groupBy("_p_class", "_p_term").agg(F.count("*").alias("_p_ones"), F.sum("_p_docs").alias("_p_docs"))
    likely = pairs.where(F.col("_p_ones") >= CLASS_SUPPORT).join(F.broadcast(rates), "_p_class").where(F.col("_p_rate") < 1)
    share = lower_share(F.col("_p_ones"), F.col("_p_ones") + F.greatest(F.col("_p_held") - F.col("_p_docs"), F.lit(0)))
    told = likely.join(held, "_p_term").withColumn("_p_disclosure", disclosure(share, F.col("_p_rate"))).where(F.col("_p_disclosure") >= GENERALISE)
    return told.groupBy("_p_term").agg(F.max("_p_disclosure").alias("_p_disclosure"))


def spans_of(text: Column, terms: Column, pattern: Column | str) -> Column:
    """Spans of kind removed or general where the text has one of the terms, a map to their disclosure, as whole words."""
    own = F.transform(matches(text, pattern), lambda m: F.struct(F.element_at(terms, F.lower(m["value"])).alias("d"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    own = F.filter(own, lambda m: m["d"].isNotNull())
    return F.transform(own, lambda m: F.struct(F.when(m["d"] >= REMOVE, "removed").otherwise("general").alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))


def whole_words(terms: Column) -> Column:
    """A pattern for any of the terms; a term is made of letters, digits and lines alone."""
    edge = r"[\p{L}\p{N}_]"
    return F.concat(F.lit(rf"(?iu)(?<!{edge})(?:"), F.array_join(F.array_sort(terms), "|"), F.lit(rf")(?!{edge})"))


def protect(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with _p_text, and _p_base and _p_more: arrays of struct<kind, start, end, value>, by kind and then start.

    The entities of a document, and with them the terms to look for, are keyed by its id and the hash of its text.
    """
    whole = text_of(text)
    spans = base_spans(F.col("_p_text"))
    tagged = F.concat(*(F.transform(s, _tag(k)) for k, s in spans.items()))
    keys = {"_p_none": F.col(doc_id).isNull(), "_p_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), "_p_key": F.xxhash64(whole)}
    keyed = docs.withColumns({"_p_text": whole, **keys})
    rows = keyed.withColumn("_p_base", tagged)
    found = cut(rows.where(F.size("_p_base") > 0).groupBy(*KEYS).agg(F.any_value("_p_text").alias("_p_text"), F.any_value("_p_base").alias("_p_base"), F.count("*").alias("_p_rows")))
    total = max(2, docs.count())
    held = cut(docs.select(F.explode(F.array_distinct(words_of(whole))).alias("_p_term")).groupBy("_p_term").agg(F.count("*").alias("_p_held")), narrow=True)
    told = cut(telling_terms(found, held, total), narrow=True)
    of_classes = cut(telling_of_classes(found, held, total), narrow=True)
    entities = entities_of(found).select(*KEYS, "_p_entity").distinct()
    terms = entities.join(told, "_p_entity").select(*KEYS, "_p_term", "_p_disclosure")
    # a term of both sorts tells as much as the sort that tells more, whichever way it is looked for
    both = of_classes.select("_p_term", F.col("_p_disclosure").alias("_p_class_disclosure"))
    terms = terms.join(both, "_p_term", "left").select(*KEYS, "_p_term", F.greatest("_p_disclosure", "_p_class_disclosure").alias("_p_disclosure"))
    few = of_classes.count() <= FEW
    if not few:
        words = keyed.select(*KEYS, F.explode(F.array_distinct(words_of(F.col("_p_text")))).alias("_p_term"))
        terms = terms.union(words.join(of_classes, "_p_term").select(*KEYS, "_p_term", "_p_disclosure"))
    terms = terms.groupBy(*KEYS, "_p_term").agg(F.max("_p_disclosure").alias("_p_disclosure"))
    terms = terms.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("_p_term", "_p_disclosure"))).alias("_p_terms"))  # at most the words of a text
    texts = found.select(*KEYS, "_p_text") if few else keyed.select(*KEYS, "_p_text").dropDuplicates(KEYS)
    extra = texts.join(terms, KEYS).select(*KEYS, spans_of(F.col("_p_text"), F.col("_p_terms"), whole_words(F.map_keys("_p_terms"))).alias("_p_own"))
    more = F.coalesce("_p_own", none(KINDED))
    listed = {r["_p_term"]: r["_p_disclosure"] for r in of_classes.collect()} if few else {}  # at most FEW
    if listed:
        literal = F.create_map(*(F.lit(x) for pair in sorted(listed.items()) for x in pair))
        common = spans_of(F.col("_p_text"), literal, whole_words(F.array(*map(F.lit, sorted(listed)))))
        rows = rows.withColumn("_p_common", common)
        more = F.concat(more, F.filter("_p_common", lambda c: ~F.exists(F.coalesce("_p_own", none(KINDED)), lambda o: o["start"] == c["start"])))
    inside = lambda m: F.exists("_p_base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    more = F.array_sort(F.filter(more, lambda m: ~inside(m)))
    return rows.join(extra, KEYS, "left").withColumn("_p_more", more)


def op3_rows(docs: DataFrame) -> DataFrame:
    found = protect(docs.select("doc_id", "text"))
    told = lambda c: F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    count = lambda k: F.size(F.filter("_p_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.array_join(told("_p_base"), ",")
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), F.array_join(told(F.concat("_p_base", "_p_more")), ",").alias("spans"), F.size("_p_more").cast("long").alias("n_terms")
    )


def sanitised(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the text sanitised: every span replaced by its label, of overlapping spans the first. A general term is
    its first half and a star.

    Pieces are cut from the text once a span, so a text is walked as often as it has spans.
    """
    found = protect(docs, text, doc_id)
    spans = F.array_sort(F.transform(F.concat("_p_base", "_p_more"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    label = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    half = lambda v: F.concat(F.substring(v, F.lit(1), F.floor(F.length(v) / 2).cast("int")), F.lit("*"))
    own = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(F.substring(F.col("_p_text"), a["at"] + 1, s["start"] - a["at"]), F.coalesce(F.element_at(label, s["kind"]), half(s["value"]))))).otherwise(a["out"]).alias("out"),
        ),
    )
    done = found.withColumn("_p_own", own).withColumn("_p_clean", F.concat(F.array_join("_p_own.out", ""), F.substring(F.col("_p_text"), F.col("_p_own.at") + 1, F.length("_p_text"))))
    return done.select(*(F.when(F.col(text).isNotNull(), F.col("_p_clean")).alias(text) if c == text else c for c in docs.columns))
