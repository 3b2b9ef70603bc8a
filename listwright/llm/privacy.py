"""Personal data and what reveals it, in DataFrame functions only.

Patterns find personal data (base spans). Then terms: for a word that occurs near an entity, the
corpus tells how strongly it reveals it, by the share of the word's documents that hold the entity
and by pointwise mutual information. Where single entities are too rare to tell, all of a kind count
together, at a higher share. Words above the thresholds are spans of kind `term`: with
`Disclosure.everywhere` in every document that uses them, else in those that have them near the entity.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.llm.shared import bind, staged, unused, whole_text

#: Kinds in report order. Possessive loops keep the patterns linear; `\G` lets a match begin where
#: the one before ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
_SPANS = "array<struct<start:int,rank:int,stop:int,kind:string,value:string>>"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Disclosure:
    """When a term counts as revealing an entity."""

    window_chars: int = 80
    min_term_chars: int = 4
    #: Different texts that must show the term near the entity; copies are no evidence.
    min_texts: int = 3
    #: Least share of the term's documents that have it near the entity.
    min_share: float = 0.5
    #: Least share of the term's documents that have it near any entity of one kind.
    min_kind_share: float = 0.8
    #: Least pointwise mutual information, in bits.
    min_bits: float = 3.0
    #: Whether a term is hidden in every document that uses it, or only where the entity is near.
    everywhere: bool = False


#: Parts of a frequent word's rows when all words meet the hidden terms.
SALTS = 32


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        double = digit * 2
        return total + F.when(i % 2 == 1, digit).when(double > 9, double - 9).otherwise(double)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return bind(_digits(value), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _matches(text: Column, pattern: Column, kind: str) -> Column:
    """All matches as spans: the text's pieces between them give their places, in code points."""
    rank = KINDS.index(kind)

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        stop = start + F.length(x["value"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"),
                        F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pieces = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, pattern, F.lit(0))
    zipped = F.zip_with(F.slice(pieces, F.lit(1), F.size(values)), values,
                        lambda p, v: F.struct(p.alias("piece"), v.alias("value")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
    return F.aggregate(zipped, begin, place, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """The valid matches of all patterns, by start, then kind."""
    present = {"email": text.contains("@"), "phone": text.contains("+"),
               "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]")}
    found = [F.when(present[kind], F.filter(_matches(text, F.lit(pattern), kind), _keeps(kind))
                    ).otherwise(F.array().cast(_SPANS)) for kind, pattern in PATTERNS.items()]
    return F.sort_array(F.concat(*found))


def _keeps(kind: str):
    return lambda span: _valid(kind, span["value"])


def _is(kind: str):
    return lambda span: span["kind"] == kind


def _entity(span: Column) -> Column:
    """One name for all spellings of an entity."""
    plain = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], plain)


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def _near(text: Column, span: Column, how: Disclosure) -> Column:
    """The whole words within the window before and after a span."""
    w = how.window_chars
    start, stop = span["start"], span["stop"]
    before = _words(F.substring(text, F.greatest(start - w, F.lit(0)) + 1, F.least(start, F.lit(w))))
    after = F.substring(text, stop + 1, F.lit(w))
    # A word that the window's edge cuts is left out.
    before = F.when(start > w, F.slice(before, F.lit(2), F.lit(w))).otherwise(before)
    after = bind(after, lambda a: bind(_words(a), lambda x: F.when(
        F.length(a) == w, F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0)))).otherwise(x)))
    return F.filter(F.array_distinct(F.concat(before, after)), lambda t: F.length(t) >= how.min_term_chars)


def _key(how: Disclosure) -> Column:
    """What a document's terms are joined by: with `everywhere` its id and text, so null and repeated ids do too."""
    return F.xxhash64("doc_id", whole_text()) if how.everywhere else F.col("doc_id")


def with_base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text (null where nothing was found) and base spans, one row per document."""
    found = docs.select("doc_id", whole_text().alias("text")).select(
        "doc_id", "text", bind(F.col("text"), base_spans).alias("base"))
    return found.select("doc_id", F.when(F.size("base") > 0, F.col("text")).alias("text"), "base")


def revealing_terms(docs: DataFrame, found: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """The `key` of a document and the sorted terms to hide in it, for documents that have any.

    `found` is with_base_spans(docs), written.
    """
    shown = found.where("text IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("digest"), "text", F.explode("base").alias("span")).select(
        "doc_id", "digest", F.array(_entity(F.col("span")), F.col("span.kind")).alias("entities"),
        F.explode(_near(F.col("text"), F.col("span"), how)).alias("term")).select(
        "doc_id", "digest", "term", F.explode("entities").alias("entity"))
    shown = staged(shown.distinct())
    together = shown.groupBy("entity", "term", "digest").agg(F.count("*").alias("docs")).groupBy("entity", "term").agg(
        F.sum("docs").alias("n_both"), F.count("*").alias("texts")).where(F.col("texts") >= how.min_texts)
    entities = shown.select("entity", "doc_id").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    together = staged(together)
    if together.isEmpty():
        return together.select(F.lit(None).cast("long").alias("key"), F.array("term").alias("terms"))
    words = docs.select(_key(how).alias("key"), F.explode(F.array_distinct(_words(whole_text()))).alias("term")).where(
        F.length("term") >= how.min_term_chars)
    used = words.groupBy("term").agg(F.count("*").alias("n_term"))
    total = found.count()
    bits = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    # Each entity that a term reveals counts, not only the one that it is found near most often.
    share = F.when(F.col("entity").isin(*PATTERNS), how.min_kind_share).otherwise(how.min_share)
    hidden = together.join(used, "term").where(F.col("n_both") >= share * F.col("n_term")).join(
        entities, "entity").where(bits >= how.min_bits).select("entity", "term")
    if how.everywhere:
        salted = staged(hidden.select("term").distinct()).select(
            "term", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        uses = words.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"])
    else:
        uses = shown.join(hidden, ["entity", "term"]).withColumnRenamed("doc_id", "key")
    return uses.groupBy("key").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def _term_spans(text: Column, base: Column, terms: Column) -> Column:
    """Every use of the terms as whole words outside the base spans."""
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(terms, "|"), F.lit(r")(?!\p{L})"))
    return F.filter(_matches(text, pattern, "term"), lambda s: ~F.exists(
        base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))


def _all_spans(text: Column, base: Column, terms: Column) -> Column:
    return F.when(terms.isNull(), base).otherwise(F.sort_array(F.concat(base, _term_spans(text, base, terms))))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def personal_data(docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, all spans.

    Null texts count as empty. With `everywhere` each row gets the terms that its own text uses. Without, a
    null doc_id keeps its base spans but gets no terms, and rows that repeat a doc_id share their terms. An
    empty table gives an empty one; only doc_id and text are read.
    """
    found = staged(with_base_spans(docs))
    terms = revealing_terms(docs, found, how)

    def row(spans: Column) -> list[Column]:
        counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in PATTERNS]
        return ["doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(spans).alias("spans")]

    if how.everywhere:
        marked = docs.select("doc_id", whole_text().alias("text"), _key(how).alias("key")).join(terms, "key", "left")
        marked = marked.withColumn("base", bind(F.col("text"), base_spans))
        return marked.select(*row(_all_spans(F.col("text"), F.col("base"), F.col("terms"))))
    # Only documents with an entity can have terms: the others need no join.
    clean = found.where("text IS NULL").select(*row(F.col("base")))
    named = found.where("text IS NOT NULL").join(terms.withColumnRenamed("key", "doc_id"), "doc_id", "left")
    return clean.unionByName(named.select(*row(_all_spans(F.col("text"), F.col("base"), F.col("terms")))))


def _hidden(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""

    def put(acc: Column, s: Column) -> Column:
        text_before = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        fresh = F.struct(s["stop"].alias("at"), F.concat(acc["out"], text_before, mark).alias("out"))
        inside = F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out"))
        return F.when((s["start"] >= acc["at"]), fresh).otherwise(inside)

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put,
                       lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitised(docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """The documents, with their own columns, and personal data and revealing terms replaced in text.

    Documents with nothing to hide are returned as they are; `n_chars`, where there is such a column,
    follows the text.
    """
    found = staged(with_base_spans(docs))
    id_, key, hidden, base = (unused(docs, name) for name in ("id", "key", "terms", "base"))
    terms = revealing_terms(docs, found, how).select(F.col("key").alias(id_), F.col("terms").alias(hidden))
    marked = docs.withColumn(key, _key(how))
    if how.everywhere:
        marked = marked.join(terms, marked[key] == terms[id_], "left").withColumn(base, bind(whole_text(), base_spans))
        nothing = (F.size(base) == 0) & F.col(hidden).isNull()
        clean, named = marked.where(nothing), marked.where(~nothing)
    else:
        marked = marked.withColumn(base, bind(whole_text(), base_spans))
        clean, named = marked.where(F.size(base) == 0), marked.where(F.size(base) > 0)
        named = named.join(terms, named[key] == terms[id_], "left")
    clean = clean.select(*[F.col(f"`{c}`") for c in docs.columns])
    named = named.withColumn("text", _hidden(F.col("text"), _all_spans(F.col("text"), F.col(base), F.col(hidden))))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        named = named.withColumn("n_chars", F.length("text").cast(kind))
    return clean.unionByName(named.select(*[F.col(f"`{c}`") for c in docs.columns]))
