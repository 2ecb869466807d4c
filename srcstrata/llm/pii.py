"""Personal data and the terms that reveal it, in built-in functions only.

Four kinds of entities are found by pattern. An entity counts by its literal
value and by what it shares with others: the domain of an address, the network
of an ip, the prefix of a number, and its kind. Over the whole corpus, p(c),
p(t) and p(c, t) are the shares of documents with entity c, with term t, and
with both, wherever they stand. A term's disclosure is PMI(c; t) / IC(c): the
share of the entity's information content that the term gives away (Sanchez and
Batet 2016); 1 means that who reads the term knows the entity. In documents that
hold c, every occurrence of a term at ``GENERALISE`` or above is replaced by its
class, at ``REMOVE`` or above it goes. A pair counts from ``SUPPORT`` documents
on, as one document proves nothing; a shared key meets many terms by chance, so
the chance of its count, times the pairs tried, must not be above ``CHANCE``.
Words inside entities are no terms.

Defined cases: null text is empty and has no spans; documents without entities
are left as they are; repeated rows count as documents and get equal spans; rows
are told apart by (doc_id, text), null ids included; an empty table gives an
empty one. A document's spans are kept in one row, as its text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcstrata.llm.bloom import flagged, seen_once, seen_twice
from srcstrata.llm.common import plain_names
from srcstrata.session import stored

SUPPORT, GENERALISE, REMOVE, CHANCE = 3, 0.75, 0.95, 0.01

# The four kinds, in the order of the output. Possessive forms and the look-behind
# match what the plain patterns match, without trying a run of characters again
# from each of its positions; \G lets a match begin where the last one ended.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
_SPANS = "array<struct<start:int,end:int,value:string>>"
_BYTE = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def step(acc, c):
        d = c.cast("int") * (F.lit(1) + acc["i"] % 2)
        return F.struct((acc["i"] + 1).alias("i"), (acc["s"] + F.when(d > 9, d - 9).otherwise(d)).alias("s"))
    return F.aggregate(F.split(F.reverse(_digits(value)), ""), F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")),
                       step, lambda acc: acc["s"] % 10 == 0)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _guard(kind: str, text: Column) -> Column:
    """False where the kind surely does not occur; a cheap search before the patterns."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else "[0-9][\\x20-]?[0-9]")


def _found(kind: str, text: Column) -> Column:
    """Spans of one kind: gaps between matches and the matches themselves give the positions."""
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    pairs = F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        # Matches that fail are not appended: a long text of numbers has many, and an array is copied to grow.
        longer = F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), x["hit"].alias("value"))))
        return F.struct(end.alias("at"), F.when(_valid(kind, x["hit"]), longer).otherwise(acc["out"]).alias("out"))
    spans = F.aggregate(pairs, empty, step, lambda acc: acc["out"])
    return F.when(_guard(kind, text), spans).otherwise(F.array().cast(_SPANS))


def with_entities(docs: DataFrame, text: str) -> DataFrame:
    """Adds one column of spans per kind, and ``__all``: (start, end, kind, value) in order."""
    for kind in KINDS:
        docs = docs.withColumn(f"__{kind}", _found(kind, F.col(text)))
    return docs.withColumn("__all", F.array_sort(F.concat(*map(_named, KINDS))))


def _named(kind: str) -> Column:
    return F.transform(f"__{kind}", lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))


_WORD_END = r"(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}])"
_WORD = r"[\p{L}\p{N}]+$"
_BETWEEN = r"[^\p{L}\p{N}]+"
_LITERAL = "^[a-z]+:"


def _keys(entity: Column) -> Column:
    """The literal value, what it shares with others (domain, network, prefix of a number), and its kind."""
    value, digits = F.lower(entity["value"]), _digits(entity["value"])
    shared = (F.when(entity["kind"] == "email", F.substring_index(value, "@", -1))
              .when(entity["kind"] == "ip", F.substring_index(value, ".", 3))
              .when(entity["kind"] == "card", F.substring(digits, 1, 6))
              .otherwise(F.substring(digits, F.lit(1), F.length(digits) - 7)))
    return F.array(F.concat_ws(":", entity["kind"], value), F.concat_ws("/", entity["kind"], shared), entity["kind"])


def _outside(text: str) -> Column:
    """(at, said) of the pieces of a text between its entities."""
    kind = "array<struct<at:int,said:string>>"

    def piece(at, end):
        said = F.substring(F.col(text), at + 1, F.greatest(end - at, F.lit(0)))
        return F.array(F.struct(at.alias("at"), said.alias("said")))
    return F.aggregate(
        "__all", F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda acc, e: F.struct(F.greatest(acc["at"], e["end"]).alias("at"),
                                F.concat(acc["out"], piece(acc["at"], e["start"])).alias("out")),
        lambda acc: F.concat(acc["out"], piece(acc["at"], F.length(text))))


def _distinct_terms(said: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(F.split(said, _BETWEEN), F.lower)), lambda t: t != "")


def _terms(text: str) -> Column:
    """Distinct terms of a text that stand outside of its entities."""
    return _distinct_terms(F.array_join(F.transform(_outside(text), lambda p: p["said"]), " "))


def _occurrences(text: str, revealing: str) -> Column:
    """(start, end, disclosure) of every word outside of entities that the map ``revealing`` has."""
    kind = "array<struct<start:int,end:int,disclosure:double>>"

    def step(acc, piece):
        word, end = F.regexp_extract(piece, _WORD, 0), acc["at"] + F.length(piece)
        disclosure = F.try_element_at(F.col(revealing), F.lower(word))
        span = F.struct((end - F.length(word)).alias("start"), end.alias("end"), disclosure.alias("disclosure"))
        return F.struct(end.alias("at"), F.when(disclosure.isNotNull(), F.concat(acc["out"], F.array(span)))
                        .otherwise(acc["out"]).alias("out"))
    spans = F.flatten(F.transform(_outside(text), lambda p: F.aggregate(
        F.split(p["said"], _WORD_END), F.struct(p["at"].alias("at"), F.array().cast(kind).alias("out")), step,
        lambda acc: acc["out"])))
    return F.when(F.size(revealing) > 0, spans).otherwise(F.array().cast(kind))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce("text", F.lit("")).alias("__text")) \
        .withColumn("__hash", F.xxhash64("__text"))


def _mentions(held: DataFrame) -> DataFrame:
    """(__id, __hash, entity, term): every key of a document with every term of it."""
    keys = held.withColumn("entity", F.explode("__keys"))
    recurring = flagged(keys, "entity", seen_twice(keys.select("entity"), "entity"), "__maybe").filter("__maybe")
    return recurring.select("__id", "__hash", "entity", F.explode("__words").alias("term"))


def disclosive_terms(held: DataFrame, texts: DataFrame, n_docs: int) -> DataFrame:
    """(entity, term, disclosure) at or above ``GENERALISE``.

    ``held(__id, __hash, __keys, __words, __inner, __cut)`` has a row per document with
    entities, ``texts(__text)`` all documents. Pairs are counted first; a bounded
    filter of their terms then picks the words of the corpus that have to be counted.
    """
    pairs = (_mentions(held).groupBy("entity", "term").agg(F.count("*").alias("both"))
             .filter(F.col("both") >= SUPPORT))
    pairs = stored(pairs, "pii-pairs")
    # Stored before it is joined, so that the pairs of a key that most documents have can be split.
    entities = stored(held.select(F.explode("__keys").alias("entity")).groupBy("entity")
                      .agg(F.count("*").alias("n_entity")), "pii-counts")
    # A term counts in a document where it stands outside of entities, here as in the pairs: words cut by an entity's
    # border count as what is left of them.
    words = (texts.select(F.explode(_distinct_terms(F.col("__text"))).alias("term"), F.lit(1).alias("n"))
             .union(held.select(F.explode("__inner"), F.lit(-1))).union(held.select(F.explode("__cut"), F.lit(1))))
    known = flagged(words, "term", seen_once(pairs.select("term").distinct(), "term"), "__maybe")
    frequency = known.filter("__maybe").groupBy("term").agg(F.sum("n").alias("n_term"))
    n, both, n_term = F.lit(float(max(n_docs, 1))), F.col("both"), F.col("n_term")
    share, rate = F.col("n_entity") / n, F.least(both / n_term, F.lit(1.0))
    content = -F.log2(share)
    # Chernoff's bound of the chance that this many of the term's documents have the entity.
    rest = F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    chance = F.exp(-n_term * (rate * F.log(rate / share) + rest))
    sure = F.col("entity").rlike(_LITERAL) | (chance * F.lit(pairs.count()) <= CHANCE)
    return (pairs.join(entities, "entity").join(frequency, "term")
            .filter(content > 0).withColumn("disclosure", F.log2(rate / share) / content)
            .filter((F.col("disclosure") >= GENERALISE) & sure).select("entity", "term", "disclosure"))


def term_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row's entities, and per (doc_id, text hash) the terms that disclose one of its entities.

    The first frame has ``__id``, ``__hash``, a column of spans per kind, and ``__text`` where there are
    any; the second ``__id``, ``__hash`` and ``__revealing``, a map from terms to their disclosure.
    """
    keyed = _keyed(docs)
    base = stored(with_entities(keyed, "__text").withColumn("__text", F.when(F.size("__all") > 0, F.col("__text"))),
                  "pii-entities")
    held = base.filter(F.size("__all") > 0).select(
        "__id", "__hash", F.array_distinct(F.flatten(F.transform("__all", _keys))).alias("__keys"),
        _terms("__text").alias("__words"), _distinct_terms(F.col("__text")).alias("__every"))
    held = stored(held.withColumns({"__inner": F.array_except("__every", "__words"),
                                    "__cut": F.array_except("__words", "__every")}).drop("__every"), "pii-terms")
    terms = stored(disclosive_terms(held, keyed.select("__text"), docs.count()), "pii-disclosive")
    pair = F.xxhash64("entity", "term")
    wanted = seen_once(terms.select(pair.alias("__pair")), "__pair")
    hits = (flagged(_mentions(held).withColumn("__pair", pair), "__pair", wanted, "__hit").filter("__hit")
            .join(terms, ["entity", "term"])
            .groupBy("__id", "__hash", "term").agg(F.max("disclosure").alias("disclosure"))
            .groupBy("__id", "__hash").agg(F.map_from_entries(F.collect_list(
                F.struct("term", "disclosure"))).alias("__revealing")))
    return base, hits


def _joined(left: DataFrame, hits: DataFrame) -> DataFrame:
    """``left`` with ``__terms``: (start, end, disclosure) of the disclosive terms of its ``__text``, in order."""
    found = hits.withColumnsRenamed({"__id": "__i", "__hash": "__h"})
    on = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h"))
    return (left.join(found, on, "left").drop("__i", "__h")
            .withColumn("__revealing", F.coalesce("__revealing", F.create_map().cast("map<string,double>")))
            .withColumn("__terms", _occurrences("__text", "__revealing")).drop("__revealing"))


def _listed(kind: str, column: str) -> Column:
    return F.transform(column, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: counts per kind, hash of the pattern spans, all spans."""
    base, hits = term_spans(docs)
    patterns = F.concat(*[_listed(k, f"__{k}") for k in KINDS])
    return _joined(base, hits).select(
        F.col("__id").alias("doc_id"), *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(patterns, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(patterns, _listed("term", "__terms")), ",").alias("spans"))


def _rewritten(text: str) -> Column:
    """The text with all spans replaced. Overlapping spans are one after the other, with nothing of either left."""
    entities = F.transform("__all", lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("by")))

    def class_of(x):
        word = F.substring(F.col(text), x["start"] + 1, x["end"] - x["start"])
        return F.when(x["disclosure"] >= REMOVE, "").when(word.rlike("^[0-9]+$"), "[NUMBER]").otherwise("[WORD]")
    terms = F.transform("__terms", lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), class_of(x).alias("by")))
    kind = "array<struct<from:int,start:int,by:string>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc, x):
        piece = F.struct(acc["at"].alias("from"), x["start"].alias("start"),
                         F.when(x["start"] < acc["at"], "").otherwise(x["by"]).alias("by"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    def whole(acc):
        pieces = F.transform(acc["out"], lambda p: F.concat(F.substring(
            F.col(text), p["from"] + 1, F.greatest(p["start"] - p["from"], F.lit(0))), p["by"]))
        return F.concat(F.array_join(pieces, ""), F.substring(F.col(text), acc["at"] + 1, F.length(text)))
    return F.aggregate(F.array_sort(F.concat(entities, terms)), empty, step, whole)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data and disclosive terms replaced in ``text``; ``n_chars`` follows where there is one.

    Rows without entities pass straight through; only the others are joined with
    their terms and shuffled.
    """
    _, hits = term_spans(docs)
    plain, name = plain_names(docs)
    text = F.coalesce(F.col(name["text"]), F.lit(""))
    found = with_entities(plain.withColumns({
        "__id": F.col(name["doc_id"]).cast("long"), "__text": text, "__hash": F.xxhash64(text)}), "__text")
    clean = found.filter(F.size("__all") == 0).select(plain.columns)
    changed = _joined(found.filter(F.size("__all") > 0), hits).withColumn(name["text"], _rewritten("__text"))
    if "n_chars" in name:
        changed = changed.withColumn(name["n_chars"], F.length(name["text"]).cast(docs.schema["n_chars"].dataType))
    return clean.unionByName(changed.select(plain.columns)).toDF(*docs.columns)
