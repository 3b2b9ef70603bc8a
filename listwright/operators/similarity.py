"""Exact similarity joins by prefix filtering on character bigrams.

For ratio t and total length s, two alike texts share at least 3*ceil(t*s/2) - s - 1 bigrams
(q-gram bound: Gravano et al., VLDB 2001). With all bigrams in one global order, rarest first,
alike texts therefore share a bigram within a short prefix of each (Chaudhuri et al., ICDE 2006),
so an equi-join on prefix bigrams loses no pair. Texts so short that alike ones may share no bigram
also carry prefix tokens of their characters, of which alike texts always share one.

Rows of the join are slim: ids, lengths and sketches. A sketch has a bit of its own for each frequent
numbered character and bigram, so the bits in which two sketches differ bound the edits between the
texts almost exactly. The few pairs that pass are made distinct, meet their texts and are checked
in an Arrow UDF, once each. Where a rule has several parts, the right side posts all of them and every
left row asks with the part whose tokens are rarest.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from listwright.functions.similarity import at_least
from listwright.operators.scratch import scratch_root, stage
from listwright.operators.skew import salted_join

GRAM_BUCKETS = 4096  # size of the rarity table, whatever the data
HEADS = (64, 1024, 16_384, None)  # members of a right-hand block met per round; None: all

_NO_ID = 2**63 - 1


@dataclass(frozen=True)
class Rule:
    """Texts are alike when every part reaches its ratio. Ratios must lie in 67..100."""

    parts: tuple = (("key", 85),)

    def __post_init__(self):
        if not all(67 <= r <= 100 for _, r in self.parts):
            raise ValueError("ratios below 67 or above 100 are not supported")

    @property
    def ratio(self) -> int:
        return min(r for _, r in self.parts)

    @property
    def columns(self) -> list[str]:
        return [c for c, _ in self.parts]

    @property
    def text(self) -> Column:
        """The parts joined by '|': alike in every part implies alike as a whole."""
        return F.concat_ws("|", *self.columns)


def _grams(text: Column) -> Column:
    n = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                        lambda i: F.xxhash64(text.substr(i, F.lit(2))))
    return F.when(n > 1, pairs).otherwise(F.array(F.xxhash64(text, F.lit(1))))


def _bucket(gram: Column) -> Column:
    return F.pmod(gram, F.lit(GRAM_BUCKETS)).cast("int")


@dataclass(frozen=True)
class Order:
    """A global order of tokens, per part of a rule: any fixed one is right, rarest first is fast.

    `ranks` and `chars` give the place of every gram and numbered-character bucket by frequency;
    `gram_counts` the frequency by place and `char_counts` by bucket. Plain lists, so it can be kept.
    """

    ranks: list[list[int]]
    gram_counts: list[list[int]]
    chars: list[list[int]]
    char_counts: list[list[int]]


def _literal(numbers: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _places(texts: DataFrame, tokens: Column) -> tuple[list[int], list[int], list[int]]:
    """Place per bucket, count per place and count per bucket; at most GRAM_BUCKETS rows are collected."""
    counts = (
        texts.select(F.explode_outer(tokens).alias("g"))
        .groupBy(_bucket(F.col("g")).alias("b")).agg(F.count("*").alias("n"))
        .where(F.col("b").isNotNull()).orderBy("n", "b").collect()
    )
    places, by_place, by_bucket = [0] * GRAM_BUCKETS, [0] * GRAM_BUCKETS, [0] * GRAM_BUCKETS
    for place, row in enumerate(counts, GRAM_BUCKETS - len(counts)):
        places[row["b"]], by_place[place], by_bucket[row["b"]] = place, row["n"], row["n"]
    return places, by_place, by_bucket


def gram_ranks(texts: DataFrame, rule: Rule) -> Order:
    """The order of the tokens of these texts."""
    found = []
    for c in rule.columns:
        grams, chars = _places(texts, _grams(_plain(c))), _places(texts, _numbered_chars(_plain(c)))
        found.append((grams[0], grams[1], chars[0], chars[2]))
    return Order(*map(list, zip(*found)))


def _plain(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _shared_grams(length: Column, ratio: int) -> Column:
    """Fewest bigrams a text of this length shares with any text alike to it."""
    least_total = length + F.ceil(length * ratio / (200 - ratio))
    return F.ceil(least_total * (3 * ratio - 200) / 200) - 1


def spread_out(texts: DataFrame) -> DataFrame:
    """Even out a small table whose rows are costly to prepare."""
    return texts.repartition(shuffle_width(texts))


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _bits(behind: str, words: int) -> list[Column]:
    """Places in a global order, the most frequent token's being 0, as a sketch of `words` 64-bit words.

    The most frequent ones have a bit each, all others share the last word. Texts differ in at least as
    many tokens as their sketches in bits.
    """
    own = 64 * (words - 1)

    def word(n: int) -> Column:
        # SQL text, as each of these is a dozen calls otherwise.
        mine, bit = (f"b >= {64 * n} AND b < {64 * n + 64}", f"b - {64 * n}") if n < words - 1 else (f"b >= {own}", "b % 64")
        return F.expr(f"aggregate(filter({behind}, b -> {mine}), 0L, (acc, b) -> acc | shiftleft(1L, cast({bit} AS int)))")

    return [word(n) for n in range(words)]


def _numbered_chars(text: Column) -> Column:
    """Hashes of each character with its running number."""
    def number(i):
        head, char = text.substr(F.lit(1), i), text.substr(i, F.lit(1))
        nth = F.length(head) - F.length(F.replace(head, char, F.lit("")))
        return F.xxhash64(char, nth)

    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), number)


def _char_tokens(numbered: Column, length: Column, places: Column, ratio: int) -> Column:
    """Numbered characters in the global order, as many as texts alike to this one must meet.

    Alike texts have a common subsequence, so at least as many numbered characters in common.
    """
    common = F.ceil((length + F.ceil(length * ratio / (200 - ratio))) * ratio / 200)
    keep = F.greatest(length - common + 1, F.lit(1)).cast("int")
    return F.slice(F.sort_array(F.transform(numbered, lambda c: _ordered(c, places))), F.lit(1), keep)


def _ordered(token: Column, places: Column) -> Column:
    """The token's hash behind its place, so that sorting puts rare tokens first."""
    return F.shiftleft(F.element_at(places, _bucket(token) + 1), 48).bitwiseOR(F.shiftrightunsigned(token, 16))


CHAR_WORDS, PAIR_WORDS = 3, 5
_SKETCH = tuple([f"c{i}" for i in range(CHAR_WORDS)] + [f"p{i}" for i in range(PAIR_WORDS)])


def with_tokens(texts: DataFrame, rule: Rule, order: Order) -> DataFrame:
    """Per part k add `tokens_k`, the rarest bigrams of the text in order, as many as the bound demands,
    `length_k`, the sketch words c0_k, p0_k, ... and `cost_k`, how often its tokens occur."""
    made = {}
    for k, c in enumerate(rule.columns):
        made |= {f"_grams_{k}": _grams(_plain(c)), f"_chars_{k}": _numbered_chars(_plain(c)),
                 f"length_{k}": F.length(_plain(c))}
    texts = texts.withColumns(made)
    places = {}
    for k, (_, ratio) in enumerate(rule.parts):
        ranks, chars = _literal(order.ranks[k]), _literal(order.chars[k])
        grams = F.sort_array(F.transform(f"_grams_{k}", lambda g: _ordered(g, ranks)))
        length = F.col(f"length_{k}")
        keep = F.when(length > 1, F.size(f"_grams_{k}") - _shared_grams(length, ratio) + 1).otherwise(1)
        none = F.array().cast("array<bigint>")
        # Where the bound says nothing, characters take over.
        short = F.when(_shared_grams(length, ratio) < 1, _char_tokens(F.col(f"_chars_{k}"), length, chars, ratio)).otherwise(none)
        places |= {
            f"_kept_{k}": F.slice(grams, F.lit(1), keep.cast("int")), f"_short_{k}": short,
            f"_behind_c_{k}": F.transform(f"_chars_{k}", lambda t: GRAM_BUCKETS - 1 - F.element_at(chars, _bucket(t) + 1)),
            f"_behind_p_{k}": F.transform(f"_grams_{k}", lambda t: GRAM_BUCKETS - 1 - F.element_at(ranks, _bucket(t) + 1)),
        }
    texts = texts.withColumns(places)
    out = {}
    for k in range(len(rule.parts)):
        out[f"tokens_{k}"] = F.concat(_tagged(f"_kept_{k}", 2 * k), _tagged(f"_short_{k}", 2 * k + 1))
        for kind, words in (("c", CHAR_WORDS), ("p", PAIR_WORDS)):
            out |= {f"{kind}{n}_{k}": w for n, w in enumerate(_bits(f"_behind_{kind}_{k}", words))}
        if len(rule.parts) > 1:
            counts, chars = _literal(order.gram_counts[k]), _literal(sorted(order.char_counts[k]))
            out[f"cost_{k}"] = sum(F.aggregate(c, F.lit(0).cast("bigint"), _adder(n)) for c, n in (
                (f"_kept_{k}", counts), (f"_short_{k}", chars)))
    return texts.withColumns(out).drop(*made.keys() - {f"length_{k}" for k in range(len(rule.parts))}, *places)


def _tagged(tokens: str, tag: int) -> Column:
    """Tokens of different kinds and parts never meet."""
    return F.transform(tokens, lambda t: F.xxhash64(t, F.lit(tag)))


def _adder(counts: Column):
    return lambda acc, t: acc + F.element_at(counts, F.shiftrightunsigned(t, 48).cast("int") + 1)


def _carried(rule: Rule) -> list[str]:
    return [f"{c}_{k}" for k in range(len(rule.parts)) for c in ("length", *_SKETCH)]


def postings(texts: DataFrame, id_col: str, rule: Rule, side: str,
             extra: tuple = ()) -> DataFrame:
    """One row per distinct prefix token, with the token's first position among all bigrams.

    The left side asks with the cheapest part only, the right side posts every part.
    """
    parts = range(len(rule.parts))
    named = [F.col(id_col).alias(f"{side}_id")]
    named += [F.col(c).alias(f"{side}_{c}") for c in (*_carried(rule), *rule.columns, *extra)]

    def tokens(k: int) -> Column:
        return F.transform(f"tokens_{k}", lambda t, at: F.struct(F.lit(k).alias("part"), at.alias("at"), t.alias("token")))

    if len(rule.parts) == 1:
        every = tokens(0)
    elif side == "l":
        costs = F.array(*[F.col(f"cost_{k}") for k in parts])
        cheapest = F.array_position(costs, F.array_min(costs)) - 1
        every = reduce(lambda c, k: c.when(cheapest == k, tokens(k)), parts[1:], F.when(cheapest == 0, tokens(0)))
    else:
        every = F.concat(*[tokens(k) for k in parts])
    exploded = texts.withColumn("_every", every).withColumn(
        "_distinct", F.size(F.array_distinct(F.transform("_every", lambda t: t["token"]))))
    rows = exploded.select(*named, F.col("_distinct").alias(f"{side}_needed"),
                           F.transform("_every", lambda t: t["token"]).alias("_tokens"), F.posexplode("_every").alias("_n", "_t"))
    first = F.col("_n") + 1 == F.array_position("_tokens", F.col("_t.token"))
    return rows.where(first).select(
        "*", F.col("_t.part").alias(f"{side}_part"), F.col("_t.at").alias(f"{side}_at"), F.col("_t.token").alias("token")
    ).drop("_n", "_t", "_tokens")


def block_heads(right: DataFrame, limit: int) -> DataFrame:
    """The first members of every token block by id; the limit applies before the shuffle too."""
    by_id = Window.partitionBy("token").orderBy("r_id")
    return right.withColumn("_rank", F.row_number().over(by_id)).where(
        F.col("_rank") <= limit).drop("_rank")


#: Pairs that meet their right-hand text are dealt into so many shares, for ids with very many pairs.
SHARES = 8


def alike(left: DataFrame, right: DataFrame, rule: Rule, only: Column | None = None) -> DataFrame:
    """The distinct pairs (l_id, r_id) of two posting tables that satisfy the rule.

    `only` restricts which pairs are looked at. Cheap bounds run first: an edit changes one
    character and at most three bigrams, and behind a pair's first common token there must be
    room for all the bigrams it has to share. Texts join only the pairs that pass.
    """
    slim = [df.drop(*[f"{x}_{c}" for c in rule.columns], f"{x}_needed") for df, x in ((left, "l"), (right, "r"))]
    pairs = salted_join(slim[0], slim[1].hint("merge"), "token", "inner", spread="l_id",
                        width=shuffle_width(left))
    if only is not None:
        pairs = pairs.where(only)
    for k, (_, ratio) in enumerate(rule.parts):
        pairs = pairs.where(_may_be_alike(k, ratio))
    found = pairs.select("l_id", "r_id").distinct()
    texts = [df.select(f"{x}_id", *[f"{x}_{c}" for c in rule.columns]).dropDuplicates([f"{x}_id"])
             for df, x in ((left, "l"), (right, "r"))]
    share = F.pmod(F.xxhash64("l_id"), F.lit(SHARES)).cast("int")
    copies = texts[1].withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    full = found.join(texts[0].hint("merge"), "l_id").withColumn("_share", share).join(
        copies.hint("merge"), ["r_id", "_share"])
    for c, ratio in rule.parts:
        full = full.where(at_least(F.col(f"l_{c}"), F.col(f"r_{c}"), ratio))
    return full.select("l_id", "r_id")


def _may_be_alike(k: int, ratio: int) -> Column:
    """Whether lengths, sketches and token positions allow part k to reach its ratio."""
    lengths = [F.col(f"{x}_length_{k}") for x in "lr"]
    total = lengths[0] + lengths[1]
    common = F.ceil(total * ratio / 200)
    shared = 3 * common - total - 1
    room = 1 + F.least(*[n - 2 - F.col(f"{x}_at") for n, x in zip(lengths, "lr")])

    def differing(kind: str) -> Column:
        return sum(F.bit_count(F.col(f"l_{w}_{k}").bitwiseXOR(F.col(f"r_{w}_{k}"))) for w in _SKETCH if w[0] == kind)

    return (
        (common <= F.least(*lengths))
        & (differing("c") * 100 <= total * (100 - ratio))
        & (differing("p") * 100 <= total * 3 * (100 - ratio))
        & ((F.col("l_part") != k) | (room >= shared) | (shared < 1))
    )


def first_alike(left: DataFrame, right: DataFrame, rule: Rule, need: str = "first") -> DataFrame:
    """For every left row the smallest right id alike to it: (l_id, r_id), matched rows only.

    Both sides have a unique `id` and the rule's columns. A left row first meets only the first
    few members of its right-hand blocks. It goes on to more members only while a smaller match
    is still possible, so rows with very many matches leave early and the result stays exact.
    need='any' is content with any match.
    """
    root = scratch_root(left.sparkSession)
    plain = stage(right, f"{root}/right-texts")
    order = gram_ranks(plain, rule)
    return first_alike_stored(left, stage(with_tokens(spread_out(plain), rule, order), f"{root}/right"), order, rule, need)


def first_alike_stored(left: DataFrame, right: DataFrame, order: Order, rule: Rule, need: str = "first") -> DataFrame:
    """`first_alike` where the right side has its tokens, made in `order`, already."""
    root = scratch_root(left.sparkSession)
    # Tokens are costly to derive and read several times, so they are written out.
    rest = stage(with_tokens(spread_out(left), rule, order), f"{root}/left").withColumn(
        "best", F.lit(_NO_ID))
    others = postings(right, "id", rule, "r")
    done = []
    for number, limit in enumerate(HEADS):
        path = f"{root}/round-{number}"
        heads = others if limit is None else stage(block_heads(others, limit), f"{path}/heads")
        mine = postings(rest, "id", rule, "l", ("best",))
        pairs = alike(mine, heads, rule, F.col("r_id") < F.col("l_best"))
        hits = pairs.groupBy(F.col("l_id").alias("id")).agg(F.min("r_id").alias("hit"))
        rest = stage(rest.join(hits, "id", "left").withColumn(
            "best", F.least("best", "hit")).drop("hit"), f"{path}/left")
        if limit is None:
            done.append(rest)
            break
        goes_on = _unsettled(rest, heads, rule, limit)
        if need == "any":
            goes_on = goes_on.join(rest.where(F.col("best") < _NO_ID), "id", "left_anti")
        goes_on = stage(goes_on, f"{path}/open")
        done.append(rest.join(goes_on, "id", "left_anti"))
        rest = stage(rest.join(goes_on, "id", "left_semi"), f"{path}/rest")
        if rest.isEmpty():
            break
    found = reduce(DataFrame.unionByName, [d.select("id", "best") for d in done])
    return found.where(F.col("best") < _NO_ID).select(
        F.col("id").alias("l_id"), F.col("best").alias("r_id"))


def _unsettled(rest: DataFrame, heads: DataFrame, rule: Rule, limit: int) -> DataFrame:
    """Ids with a block whose members beyond the heads may still hold a smaller match."""
    cut = heads.groupBy("token").agg(F.count("*").alias("n"), F.max("r_id").alias("last")).where(
        F.col("n") >= limit)
    mine = postings(rest, "id", rule, "l", ("best",)).select(
        F.col("l_id").alias("id"), F.col("l_best").alias("best"), "token")
    open_blocks = salted_join(mine, cut, "token", "inner", spread="id")
    return open_blocks.where(F.col("last") < F.col("best")).select("id").distinct()
