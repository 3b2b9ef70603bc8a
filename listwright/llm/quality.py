"""Quality rules by distribution divergence, in DataFrame functions only.

A document's character classes and common words are compared with language references by
Jensen-Shannon distance (base 2, so between 0 and 1). The reference is that of the language most
of whose common words the document uses. Texts below the length guards are not judged by divergence.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.llm.shared import BLANKS, bind, whole_text

#: Shares of the classes below in each language's prose: blank, lower, upper, digit, mark, other.
_CLASSES = {
    "en": (0.168, 0.785, 0.020, 0.003, 0.023, 0.001),
    "fr": (0.166, 0.787, 0.019, 0.003, 0.024, 0.001),
    "de": (0.154, 0.797, 0.024, 0.003, 0.021, 0.001),
    "es": (0.163, 0.794, 0.017, 0.003, 0.022, 0.001),
}

#: Reference shares: rounded word frequencies of everyday prose, most frequent first.
_WORDS = {
    "en": "the 60 of 30 and 27 to 25 a 22 in 20 is 11 that 11 it 10 for 9 was 8 on 7 with 7 as 7 be 6 by 5 at 5 "
          "this 5 are 5 from 4",
    "fr": "de 55 la 30 le 25 et 22 les 20 des 18 en 15 un 13 du 12 une 11 est 10 que 10 pour 9 dans 8 qui 8 au 7 "
          "sur 6 par 6 pas 6 avec 4",
    "de": "der 45 die 40 und 28 in 20 den 14 von 13 zu 13 das 12 mit 10 sich 9 des 9 auf 8 für 8 ist 8 im 7 dem 7 "
          "nicht 7 ein 6 eine 6 als 6",
    "es": "de 60 la 38 que 30 el 28 en 25 y 24 los 15 se 12 del 11 las 10 un 10 por 10 con 9 no 9 una 8 para 7 "
          "su 6 al 6 es 6 lo 5",
}


@dataclass(frozen=True)
class Reference:
    """What a language's documents look like: class shares, and shares of its common words."""

    classes: tuple[float, ...]
    words: dict[str, float]


def default_references() -> dict[str, Reference]:
    found = {}
    for language, listed in _WORDS.items():
        parts = listed.split()
        found[language] = Reference(
            _CLASSES[language], {w: int(n) / 1000 for w, n in zip(parts[::2], parts[1::2], strict=True)})
    return found


@dataclass(frozen=True)
class QualityRules:
    references: dict[str, Reference] = field(default_factory=default_references)
    max_class_distance: float = 0.2
    #: A text without any common word lies at 0.39 to 0.43 and must fail; labelled clean rows lie below 0.3.
    max_word_distance: float = 0.32
    min_chars: int = 200
    min_words: int = 100
    base_min_words: int = 50
    base_max_repeat_percent: int = 50


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares of equal length."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(a * 2 / (a + b))).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _shares(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


#: Bits of a window's place inside its sort key; longer texts compare the windows themselves.
_PLACE_BITS = 24


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are sorted by a number made of hash bits and place, so that equal ones are neighbours.
    As many different windows as hashes among these prove that no two windows share a hash; else,
    and in texts too long for the number, the windows themselves are sorted.
    """
    n = F.size(words)

    def window(i: Column) -> Column:
        return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def windows(make) -> Column:
        return F.slice(F.transform(words, make), F.lit(1), F.greatest(n - 2, F.lit(0)))

    def beside(ordered: Column, key) -> Column:
        """The elements whose key equals that of a neighbour."""
        return F.filter(ordered, lambda x, j: F.coalesce(key(x) == key(F.get(ordered, j - 1)), F.lit(False))
                        | F.coalesce(key(x) == key(F.get(ordered, j + 1)), F.lit(False)))

    def covered(places: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.sequence(i, i + 2)))))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")

    def bits(x: Column) -> Column:
        return F.shiftright(x, _PLACE_BITS)

    def by_window() -> Column:
        keyed = windows(lambda w, i: F.struct(window(i).alias("k"), i.alias("i")))
        return bind(F.sort_array(keyed), lambda s: covered(
            F.transform(beside(s, lambda x: x["k"]), lambda x: x["i"])))

    def by_number(same: Column) -> Column:
        proven = F.size(F.array_distinct(F.transform(same, bits))) == F.size(
            F.array_distinct(F.transform(same, lambda x: window(place(x)))))
        return F.when(F.size(same) == 0, 0).when(proven, covered(F.transform(same, place))).otherwise(by_window())

    numbers = windows(lambda w, i: F.shiftleft(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
                                               _PLACE_BITS).bitwiseOR(i.cast("long")))
    quick = bind(F.sort_array(numbers), lambda s: bind(beside(s, bits), by_number))
    return F.when(n < 3, 0).when(n < 1 << _PLACE_BITS, quick).otherwise(by_window())


def _class_shares(text: Column, solid: Column, rest: Column) -> Column:
    """Shares of blank, lower, upper, digit, mark, other; `rest` is `solid` without lower case."""
    total = F.greatest(F.length(text), F.lit(1))

    def kinds(no_upper: Column) -> Column:
        def more(no_digit: Column) -> Column:
            other = F.length(F.regexp_replace(no_digit, r"""[.,;:!?'"()’«»-]+""", ""))
            return F.array(*[n / total for n in (
                F.length(text) - F.length(solid), F.length(solid) - F.length(rest), F.length(rest) - F.length(no_upper),
                F.length(no_upper) - F.length(no_digit), F.length(no_digit) - other, other)])

        return bind(F.regexp_replace(no_upper, r"\p{Nd}+", ""), more)

    return bind(F.regexp_replace(rest, r"[\p{Lu}\p{Lt}]+", ""), kinds)


def _verdict(rules: QualityRules) -> Column:
    """All figures of one document as a struct of the `text` column."""
    references = list(rules.references.values())
    listed = sorted({w for r in references for w in r.words})

    def literal(rows: list[list]) -> Column:
        return F.array(*[F.array(*[F.lit(v) for v in row]) for row in rows])

    def nearest(common: Column) -> Column:
        """The reference (from 1) that has most of the document's common words, the first of equals."""
        def of(r: Reference):
            return lambda w: w.isin(list(r.words))

        counts = F.array(*[F.size(F.filter(common, of(r))) for r in references])
        return bind(counts, lambda c: F.array_position(c, F.array_max(c)).cast("int"))

    def word_distance(common: Column, n: Column, at: Column) -> Column:
        words = F.element_at(literal([list(r.words) for r in references]), at)
        shares = F.transform(words, lambda w: (F.size(common) - F.size(F.array_remove(common, w))) / n)
        q = F.element_at(literal([[*r.words.values(), 1 - sum(r.words.values())] for r in references]), at)
        return bind(shares, lambda p: js_distance(
            F.concat(p, F.array(1 - F.aggregate(p, F.lit(0.0), lambda s, x: s + x))), q))

    def class_distance(text: Column, solid: Column, rest: Column, at: Column) -> Column:
        q = F.element_at(literal([list(r.classes) for r in references]), at)
        return js_distance(_class_shares(text, solid, rest), q)

    def figures(text: Column, words: Column, solid: Column, rest: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        common = F.transform(F.filter(words, lambda w: F.lower(w).isin(listed)), F.lower)
        distances = bind(common, lambda c: bind(nearest(c), lambda at: F.struct(
            class_distance(text, solid, rest, at).alias("class_js"),
            word_distance(c, F.greatest(F.size(words), F.lit(1)), at).alias("word_js"))))
        return F.struct(
            F.length(text).alias("n_chars"), F.size(words).cast("long").alias("n_words"),
            F.length(solid).cast("long").alias("word_chars"),
            (F.length(rest) - F.length(F.translate(rest, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"), distances.alias("js"))

    def judge(f: Column) -> Column:
        n_words, repeated = f["n_words"], f["n_repeat_words"]
        failed = (n_words < rules.base_min_words) | (repeated * 100 > n_words * rules.base_max_repeat_percent)
        class_ok = (f["n_chars"] < rules.min_chars) | (f["js"]["class_js"] <= rules.max_class_distance)
        word_ok = (n_words < rules.min_words) | (f["js"]["word_js"] <= rules.max_word_distance)
        return F.struct(
            n_words.alias("n_words"), f["word_chars"].alias("word_chars"), f["n_symbols"].alias("n_symbols"),
            f["n_dup_lines"].alias("n_dup_lines"), repeated.alias("n_repeat_words"),
            failed.alias("base_failed"), (~failed & class_ok & word_ok).alias("kept"),
            F.round(f["js"]["class_js"], 6).alias("class_js"), F.round(f["js"]["word_js"], 6).alias("word_js"))

    measured = bind(whole_text(), lambda text: bind(
        F.array_remove(F.split(text, BLANKS), ""), lambda words: bind(
            F.array_join(words, ""), lambda solid: bind(
                F.regexp_replace(solid, r"\p{Ll}+", ""), lambda rest: figures(text, words, solid, rest)))))
    return bind(measured, judge)


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: base counts, distances from the nearest language and the verdict.

    A null text counts as empty: no words, base_failed, distances as of an empty histogram. A null
    doc_id stays null; repeated rows are judged each; an empty table gives an empty one; only
    doc_id and text are read, so other columns may have any name.
    """
    return docs.select("doc_id", _verdict(rules).alias("v")).select("doc_id", "v.*")


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with their own columns only."""
    return docs.where(_verdict(rules)["kept"])
