"""Personal data: patterns, and information-theoretic sanitisation of the terms around them, with DataFrame functions only.

Protected entities are the e-mail addresses, IP addresses, payment cards and phone numbers found by pattern in whole texts.
Terms of the documents that hold an entity are weighed by the corpus: their pointwise mutual information with the entity, against
the information content of the entity itself. A term that stands with an entity in several different documents and carries at
least 1/alpha of the entity's information reveals it, and is generalised or removed like the entity, all through these documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nubila.llm.arrays import let, pieces, running, sums_before
from nubila.llm.common import hot_keys, lookup, named, stored

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: A private-use character that splits texts at matches; where a text has it, another stands in for the search.
MARK, STAND_IN = "\ue000", "\ufffd"
LOCAL = "A-Za-z0-9._%+-"
# The same matches as the plain patterns: a search that failed at the start of a run of characters fails in all of that run, so
# it starts at runs only, or where the last match ended, and never gives characters back.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts that fail these have no match; they are cheap.
QUICK = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: A text that fails this has no match of any kind, so most texts are searched once.
ANY = "|".join(QUICK.values())
#: Between a word and what isn't one.
BOUNDARY = r"(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}])|(?<=[^\p{L}\p{N}])(?=[\p{L}\p{N}])"
#: Types whose values tell rows with equal texts apart.
SIMPLE = frozenset("bigint int smallint tinyint string double float date timestamp boolean binary".split())
SPANS = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.char_length(_digits(match))
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(match)).between(10, 15)
    return F.lit(True)


def placed(parts: Column) -> Column:
    """start, end (code points of the whole) and value of the parts of a split text."""

    def places(ps: Column) -> Column:
        starts = sums_before(F.transform(ps, lambda p: F.char_length(p).cast("long")))
        return F.zip_with(ps, starts, lambda p, at: F.struct(at.alias("start"), (at + F.char_length(p)).alias("end"), p.alias("value")))

    return let(parts, places)


def _spans_of(kind: str, text: Column) -> Column:
    marked = F.regexp_replace(text, PATTERNS[kind], f"{MARK}$0{MARK}")
    found = F.filter(placed(F.split(marked, MARK, -1)), lambda s, i: i % 2 == 1)
    held = F.filter(found, lambda s: _holds(kind, s["value"]))
    ranked = F.transform(held, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), s["value"].alias("value")))
    return F.when(text.rlike(QUICK[kind]), ranked).otherwise(F.array().cast(SPANS))


def find_base(docs: DataFrame) -> DataFrame:
    """docs with text (null: empty) and base: the pattern spans by start, then kind.

    Leftmost and non-overlapping for each kind; a match that fails its check is dropped without another try. Places are in code
    points, ends exclusive.
    """
    plain = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("text", plain)
    found = let(unmarked(F.col("text")), lambda seen: F.array_sort(F.concat(*[_spans_of(k, seen) for k in KINDS])))
    return rows.withColumn("base", F.when(F.col("text").rlike(ANY), found).otherwise(F.array().cast(SPANS)))


def unmarked(text: Column) -> Column:
    """The text with a stand-in for MARK; nearly all texts have none and pass as they are."""
    return F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, STAND_IN)).otherwise(text)


def term_words(text: Column) -> Column:
    """Distinct lower-cased terms of a text: runs of letters and digits with three characters or more; none that touch a MARK."""
    runs = F.filter(F.split(text, rf"[^\p{{L}}\p{{N}}{MARK}]+"), lambda w: (F.char_length(w) >= 3) & ~F.contains(w, F.lit(MARK)))
    return F.array_distinct(F.transform(runs, F.lower))


def entities_held(found: DataFrame) -> DataFrame:
    """A row for each text and entity in it: key (of the text), entity, context (key of the lower-cased text), copies."""
    entities = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["rank"].cast("string"), F.lower(s["value"]))))
    # Entities are stored before they are spread out: no text is copied into their rows, and spans are found once.
    texts = found.select(F.xxhash64("text").alias("__key"), F.xxhash64(F.lower("text")).alias("context"), entities.alias("entities"))
    rows = stored(texts, "pii-found").select("__key", "context", F.explode("entities").alias("entity"))
    return rows.groupBy("__key", "entity").agg(F.first("context").alias("context"), F.count("*").alias("copies"))


def terms_outside(text: Column, base: Column) -> Column:
    """Distinct terms of a text that don't overlap a base span."""
    edge = lambda s, at: F.when(s["value"].rlike(at), F.lit(MARK)).otherwise(F.lit(""))
    return term_words(sanitise(unmarked(text), base, lambda s: F.concat(edge(s, r"^[\p{L}\p{N}]"), F.lit(" "), edge(s, r"[\p{L}\p{N}]$"))))


def revealing_terms(plain: DataFrame, held: DataFrame, hot: dict, alpha: float, support: int) -> DataFrame:
    """(entity, term, disclosure) for the terms that reveal an entity; held has the entities in `support` contexts or more.

    A context is a whole document: a term counts with every entity of its document, at any distance. All counts are of documents
    and run over all of them; for the support, texts that are equal letter for letter, as copies are, count once. hot holds the
    texts with very many copies.
    """
    known = held.select("__key").distinct().withColumn("__there", F.lit(True))
    texts = lookup(plain.withColumn("__key", F.xxhash64("text")), "__key", known, hot, ["__row"]).where("__there")
    outside = find_base(texts.select("__key", "text")).select("__key", terms_outside(F.col("text"), F.col("base")).alias("terms"))
    terms = stored(outside, "pii-terms-outside").select("__key", F.explode("terms").alias("term")).distinct()
    pairs = held.join(terms, "__key").groupBy("entity", "term").agg(F.sum("copies").alias("together"), F.count_distinct("context").alias("contexts")).where(F.col("contexts") >= support)
    pairs = stored(pairs, "pii-pairs")
    entities = held.groupBy("entity").agg(F.sum("copies").alias("entity_documents"))
    counts = plain.select(F.explode(term_words(unmarked(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("term_documents"))
    documents = plain.count()
    joined = pairs.join(entities, "entity").join(counts, "term")
    information = F.log2(F.lit(float(max(documents, 2))) / F.col("entity_documents"))
    mutual = F.log2(F.col("together") * F.lit(float(documents)) / (F.col("entity_documents").cast("double") * F.col("term_documents")))
    return joined.withColumn("disclosure", mutual / F.greatest(information, F.lit(1e-9))).where(F.col("disclosure") >= 1 / alpha).select("entity", "term", "disclosure")


def _outermost(spans: Column) -> Column:
    """Those of the sorted spans that don't begin inside an earlier one, each with `at`: where all before it end."""
    both = lambda v: F.zip_with(v, running(F.transform(v, lambda s: s["end"]), 0, F.greatest), lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["rank"].alias("rank"), s["value"].alias("value")))
    return F.filter(let(spans, both), lambda s: s["start"] >= s["at"])


def _last(spans: Column) -> Column:
    """Where the last of the spans ends."""
    return F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0).cast("long"))


def term_spans(text: Column, base: Column, terms: Column) -> Column:
    """The spans of all occurrences of the terms in a text, apart from its base spans. text and terms are names.

    The text between base spans is read with one more character at each side, so a word that reaches into a span isn't taken.
    """
    gap = lambda a, b: F.struct(a.alias("low"), b.alias("high"), F.greatest(a - 1, F.lit(0)).alias("start"), F.least(b + 1, F.char_length(text)).alias("end"))
    between = F.transform(_outermost(base), lambda s: gap(s["at"], s["start"]))
    gaps = F.concat(between, F.array(gap(_last(base), F.char_length(text).cast("long"))))

    def found(part: Column, g: Column) -> Column:
        words = F.filter(placed(F.split(part, BOUNDARY)), lambda p: F.array_contains(terms, F.lower(p["value"])))
        spans = F.transform(words, lambda p: F.struct((p["start"] + g["start"]).alias("start"), F.lit(len(KINDS)).alias("rank"), (p["end"] + g["start"]).alias("end"), F.lower(p["value"]).alias("value")))
        return F.filter(spans, lambda s: (s["start"] >= g["low"]) & (s["end"] <= g["high"]))

    return let(gaps, lambda gs: F.flatten(F.zip_with(pieces(text, gs), gs, found)))


def sanitise(text: Column, spans: Column, instead=None) -> Column:
    """The text with spans replaced: entities by their kind, numbers by [NUMBER], other terms by [TERM]; overlaps once.

    instead(span): what replaces a span, if not these.
    """
    label = lambda s: F.get(F.array(*[F.lit(LABELS[k]) for k in KINDS]), s["rank"])
    general = lambda s: F.when(s["value"].rlike(r"^\p{N}+$"), F.lit("[NUMBER]")).otherwise(F.lit("[TERM]"))
    new = instead or (lambda s: F.coalesce(label(s), general(s)))

    def rebuilt(t: Column) -> Column:
        kept = lambda ks: F.zip_with(pieces(t, F.transform(ks, lambda s: F.struct(s["at"].alias("start"), s["start"].alias("end")))), ks, lambda p, s: F.concat(p, new(s)))
        return F.concat(F.array_join(let(_outermost(spans), kept), ""), F.substring(t, (_last(spans) + 1).cast("int"), F.char_length(t)))

    return F.when(F.size(spans) == 0, text).otherwise(let(text, rebuilt))


def sanitise_documents(docs: DataFrame, alpha: float = 1.5, support: int = 3) -> DataFrame:
    """docs with text (null: empty), base, spans (base and revealing terms, by start, then kind) and sanitised.

    A revealing term is replaced wherever it stands in a text that holds its entity. All columns of docs stay (those named base,
    spans or sanitised are replaced); no row is dropped. Equal rows have equal results; an empty table gives an empty result.
    """
    found = find_base(docs.drop("base", "spans", "sanitised"))
    others = [c for c in docs.columns if c not in ("text", "base", "spans", "sanitised")]
    row = F.xxhash64(*[named(c) for c in others if dict(docs.dtypes)[c] in SIMPLE], F.lit(3)).alias("__row")
    plain = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), row)
    # Only keys and entities are kept; texts are read again for the terms, the counts and the result.
    held = stored(entities_held(found.select("text", "base")), "pii-entities")
    # A term can't stand with an entity in more contexts than the entity has.
    often = held.groupBy("entity").agg(F.count_distinct("context").alias("contexts")).where(F.col("contexts") >= support)
    held = stored(held.join(often.select("entity"), "entity", "left_semi"), "pii-contexts")
    if held.isEmpty():
        whole = found.withColumn("spans", F.col("base"))
    else:
        hot = hot_keys(held.groupBy("__key").agg(F.max("copies").alias("copies")), "__key", "copies")
        revealing = revealing_terms(plain, held, hot, alpha, support).groupBy("entity").agg(F.collect_set("term").alias("terms"))
        terms = stored(held.join(revealing, "entity").groupBy("__key").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("__terms")), "pii-terms")
        joined = lookup(found.withColumn("__key", F.xxhash64("text")).withColumn("__row", row), "__key", terms, hot, ["__row"])
        more = F.when(F.col("__terms").isNull(), F.array().cast(SPANS)).otherwise(term_spans(F.col("text"), F.col("base"), F.col("__terms")))
        whole = joined.withColumn("spans", F.array_sort(F.concat("base", more))).drop("__key", "__row", "__terms")
    return whole.withColumn("sanitised", sanitise(F.col("text"), F.col("spans")))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")
