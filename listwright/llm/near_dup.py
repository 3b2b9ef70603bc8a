"""Near duplicates by b-bit MinHash: bands propose, low bits estimate, full sets confirm.

A document's set is its distinct word shingles. Documents with equal sets form one class with a number
of its own, and one of its texts stands for all. Representatives that agree on all minima of a band are
candidates; the packed low bits of many minima give a collision-corrected estimate of similarity
that removes hopeless ones, and the full sets of the rest are compared exactly.

Within a band's bucket not all pairs are met. Its members are first compared with its most popular
one, the centre of a group of copies, and alike ones join one component; then only members outside
the bucket's largest component meet the others. So a bucket of copies costs one comparison each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.llm.shared import staged, unused, whole_text


@dataclass(frozen=True)
class MinHash:
    """`percent` is the least similarity. The bands miss a pair of similarity s with chance
    (1 - s ** rows) ** bands: below 2e-7 at 0.85 and 4e-6 at 0.8."""

    words: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4
    #: Low bits kept of each of `minima` minima for the estimate.
    bits: int = 1
    minima: int = 2048
    #: The estimate may fall short of the true similarity by so many standard errors.
    slack: float = 4.5

    @property
    def words_packed(self) -> int:
        return -(-self.minima * self.bits // 64)

    @property
    def least_equal(self) -> int:
        """Equal low-bit fields below which a pair cannot reach `percent`, up to the slack."""
        s, chance, k = self.percent / 100, 2.0**-self.bits, self.minima
        match = s + (1 - s) * chance
        return int(np.floor(k * match - self.slack * np.sqrt(k * match * (1 - match))))


_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """word -> 64-bit hash of its bytes, of which a bounded number is kept."""

    def __init__(self, encode: Callable = bytes):
        super().__init__()
        self.encode = encode

    def __missing__(self, word) -> int:
        found = xxhash.xxh3_64_intdigest(self.encode(word))
        if len(self) > 500_000:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


def shingle_set(text: str, words: int, hashes: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a shorter text is one shingle as a whole."""
    found = text.encode().lower().split()  # on bytes: only A-Z change, only codes 9-13 and 32 split
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h
    n = len(h) - words + 1
    if n < 1:
        mixed = h[:1] ^ np.uint64(len(h))
        for x in h[1:]:
            mixed = (mixed * _MIX) ^ (mixed >> np.uint64(29)) ^ x
        return mixed * _MIX
    mixed = h[:n].copy()
    for k in range(1, words):
        mixed = (mixed * _MIX) ^ (mixed >> np.uint64(29)) ^ h[k:k + n]
    return np.unique(mixed * _MIX)


def _random(n: int, seed: int, kind: type) -> np.ndarray:
    """n odd numbers, one per row; the same ones everywhere."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, np.uint64).astype(kind)[:, None] | kind(1)


class Signer:
    """Minima of a set under random mixing rules, as band keys."""

    def __init__(self, how: MinHash):
        self.how, n = how, how.bands * how.rows
        self.a, self.b = _random(n, 20240917, np.uint64), _random(n, 20240918, np.uint64)

    def __call__(self, shingles: np.ndarray, block: int = 512) -> list[int]:
        low = np.full(len(self.a), 2**64 - 1, np.uint64)
        for at in range(0, len(shingles), block):
            x = shingles[None, at:at + block] * self.a + self.b
            x ^= x >> np.uint64(32)
            np.minimum(low, x.min(axis=1), out=low)
        mixed = np.zeros(self.how.bands, np.uint64)
        for column in low.reshape(self.how.bands, self.how.rows).T:
            mixed = (mixed * _MIX) ^ (mixed >> np.uint64(31)) ^ column
        return mixed.view(np.int64).tolist()


class Packer:
    """Low bits of many minima, packed into 64-bit words."""

    def __init__(self, how: MinHash):
        self.how = how
        self.a, self.b = _random(how.minima, 20240919, np.uint32), _random(how.minima, 20240920, np.uint32)

    def minima(self, shingles: np.ndarray, block: int = 256) -> np.ndarray:
        short = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
        low = np.full(self.how.minima, 2**32 - 1, np.uint32)
        for at in range(0, len(short), block):
            x = short[None, at:at + block] * self.a + self.b
            x ^= x >> np.uint32(15)
            np.minimum(low, x.min(axis=1), out=low)
        return low

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        bits, per = self.how.bits, 64 // self.how.bits
        fields = (self.minima(shingles) & np.uint32(2**bits - 1)).astype(np.uint64)
        fields = np.pad(fields, (0, -len(fields) % per)).reshape(-1, per)
        packed = (fields << (np.arange(per, dtype=np.uint64) * np.uint64(bits))).sum(axis=1, dtype=np.uint64)
        return packed.view(np.int64)


def signatures(docs: DataFrame, how: MinHash) -> DataFrame:
    """One row per document: doc_id, the text's hash, n_shingles, a 128-bit digest of the set, band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, hashes = Signer(how), WordHash()
        for batch in batches:
            n, d1, d2, bands = [], [], [], []
            for text in batch.column(2).to_pylist():
                shingles = shingle_set(text, how.words, hashes)
                n.append(len(shingles))
                digest = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), "<i8")
                d1.append(digest[0])
                d2.append(digest[1])
                bands.append(signer(shingles) if len(shingles) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()),
                 pa.array(d2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "d1", "d2", "bands"])

    return docs.select("doc_id", _text_hash().alias("text_hash"), whole_text().alias("text")).mapInArrow(
        sign, "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, bands array<long>")


def _text_hash() -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(whole_text())


def _equal_fields(a: list[Column], b: list[Column], how: MinHash) -> Column:
    """How many of the packed fields of two signatures are equal, by bit counts."""
    ones = sum(1 << (i * how.bits) for i in range(64 // how.bits))
    ones -= (ones >> 63 & 1) << 64

    def unequal(x: Column) -> Column:
        """Every field folded onto its lowest bit: set where any bit differs."""
        step = 1
        while step < how.bits:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step *= 2
        return F.bit_count(x.bitwiseAND(F.lit(ones).cast("long")))

    return how.minima - reduce(Column.__add__, [unequal(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)])


def _may_be_alike(how: MinHash) -> Column:
    """Whether the sizes and the estimate of rows l and r allow the similarity asked for."""
    def packed(side: str) -> list[Column]:
        return [F.col(f"{side}.s{i}") for i in range(how.words_packed)]

    smaller, larger = F.least("l.size", "r.size"), F.greatest("l.size", "r.size")
    return (smaller * 100 >= larger * how.percent) & (_equal_fields(packed("l"), packed("r"), how) >= how.least_equal)


def _sketches(docs: DataFrame, members: DataFrame, how: MinHash) -> DataFrame:
    """rep, the size and bytes of its sorted shingle hashes, and its packed low bits s0, s1, ...

    `members` has the doc_id and text_hash of the text that stands for each rep.
    """
    names = [f"s{i}" for i in range(how.words_packed)]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, packer = WordHash(), Packer(how)
        for batch in batches:
            sets = [shingle_set(t, how.words, hashes) for t in batch.column(1).to_pylist()]
            packed = np.array([packer(x) for x in sets], np.int64).reshape(len(sets), -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int64()),
                 pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary()),
                 *[pa.array(np.ascontiguousarray(packed[:, i])) for i in range(len(names))]],
                ["rep", "size", "set", *names])

    chosen = docs.select("doc_id", _text_hash().alias("text_hash"), whole_text().alias("text")).join(
        members, ["doc_id", "text_hash"]).select("rep", "text")
    columns = ", ".join(f"{n} long" for n in names)
    return chosen.mapInArrow(build, f"rep long, size long, set binary, {columns}").dropDuplicates(["rep"])


#: Members of one side that are compared with those of another side in one task at most, on average.
CELL = 256
#: Parts in which a large group's pairs meet the sizes of its grid.
SALTS = 32


def _cells(pairs: DataFrame) -> DataFrame:
    """The pairs with their group g and their cell (i, j) in it.

    Pairs around the same smallest partner go to one cell, large groups to a grid of cells. Each side
    of a grid follows the members on that side, so a star of N pairs lies in N / CELL cells.
    """
    around = pairs.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("m")).join(
        pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("n")), "a", "left").select(
        "a", F.coalesce(F.least("m", "n"), "m").alias("g"))
    # Only large groups have a grid, which their pairs meet in SALTS parts; the others lie in one cell.
    grouped = pairs.join(around, "a").withColumn("salt", F.pmod(F.xxhash64("b", "a"), F.lit(SALTS)))
    sides = grouped.groupBy("g").agg(*[
        (1 + F.floor(F.approx_count_distinct(side) / CELL)).alias(f"n_{side}") for side in ("a", "b")]).where(
        "n_a > 1 OR n_b > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return grouped.join(sides, ["g", "salt"], "left").select(
        "g", F.coalesce(F.pmod(F.xxhash64("a"), "n_a"), F.lit(0)).alias("i"),
        F.coalesce(F.pmod(F.xxhash64("b"), "n_b"), F.lit(0)).alias("j"), "a", "b")


def _confirmed(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose full sets are alike: 100 * intersection >= percent * union.

    A set travels once to each cell that needs it, not once per pair.
    """
    celled = staged(_cells(pairs))
    cell = ["g", "i", "j"]
    needed = celled.select(*cell, F.col("a").alias("rep")).unionByName(
        celled.select(*cell, F.col("b").alias("rep"))).distinct()
    sets = needed.join(sketches.select("rep", "set"), "rep").select(
        *cell, F.col("rep").alias("a"), F.lit(None).cast("long").alias("b"), "set")
    rows = sets.unionByName(celled.withColumn("set", F.lit(None).cast("binary")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sets = None, {}
        for batch in batches:
            found_a, found_b = [], []
            for *at, a, b, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != here:
                    here, sets = at, {}
                if b is None:
                    sets[a] = np.frombuffer(raw, "<u8")
                    continue
                x, y = sets[a], sets[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    # Within a cell the sets come before the pairs.
    dealt = rows.repartition(*cell).sortWithinPartitions(*cell, F.col("b").asc_nulls_first())
    return dealt.select(*cell, "a", "b", "set").mapInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over links (a, b), for every node of a link.

    Each round hooks every node to its smallest neighbour and contracts the links; the nodes that
    are no local minimum vanish, and so do the links after few rounds.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        # A node's parent is its smallest smaller neighbour; chains end at local minima.
        parent = staged(edges.groupBy("u").agg(F.min("v").alias("p")))
        while True:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = staged(parent.join(up, "p", "left").select(
                "u", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
            parent = jumped.select("u", "p")
            if jumped.where("moved").isEmpty():
                break
        hooks.append(parent)
        x = edges.join(parent, "u", "left").select(F.coalesce("p", "u").alias("u"), "v")
        x = x.join(parent.select(F.col("u").alias("v"), "p"), "v", "left").select("u", F.coalesce("p", "v").alias("v"))
        edges = staged(x.where("u <> v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if not hooks:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = hooks[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for hook in hooks[1:]:
        later = hook.select(F.col("u").alias("root"), F.col("p").alias("top"))
        moved = found.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        found = staged(moved.unionByName(hook.select(F.col("u").alias("node"), F.col("p").alias("root"))))
    roots = found.select(F.col("root").alias("node"), "root").distinct()
    return found.unionByName(roots).dropDuplicates(["node"])


#: Pairs left in the buckets, as a multiple of all rows, at which all of them are met at once.
PAIRS_PER_ROW = 1000


def _links(docs: DataFrame, reps: DataFrame, how: MinHash) -> DataFrame:
    """(node, root) of all representatives that are linked with another one.

    `reps` has rep, bands, and the doc_id and text_hash of the text that stands for it.
    """
    posted = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    crowded = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = staged(posted.join(crowded, "key"))
    # A member that shares buckets with many others is the centre of a group.
    fame = shared.groupBy("rep").agg(F.sum("n").alias("fame"))
    buckets = staged(shared.drop("n").join(fame, "rep"))
    texts = reps.join(fame.select("rep"), "rep", "left_semi").select("rep", "doc_id", "text_hash")
    sketches = staged(_sketches(docs, texts, how))
    light = sketches.drop("set")
    keys = light.join(reps.select("rep", *[F.col("bands")[i].alias(f"k{i}") for i in range(how.bands)]), "rep")
    rows = reps.count()

    def confirmed(pairs: DataFrame) -> DataFrame:
        return staged(_confirmed(pairs, sketches, how.percent))

    pivots = buckets.groupBy("key").agg(F.max_by("rep", F.struct("fame", -F.col("rep"))).alias("pivot"))
    pairs = buckets.join(pivots, "key").where("rep <> pivot").select(
        F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()
    first = pairs.join(light.alias("l"), F.col("a") == F.col("l.rep")).join(
        light.alias("r"), (F.col("b") == F.col("r.rep")) & _may_be_alike(how)).select("a", "b")
    links = confirmed(staged(first))
    found = staged(components(links))
    buckets = buckets.join(pivots.select("key", F.col("pivot").alias("rep")), ["key", "rep"], "left_anti")
    turn = 0
    while True:
        # Members with their component; buckets that lie within one component are settled.
        placed = staged(buckets.join(found.select(F.col("node").alias("rep"), "root"), "rep", "left").select(
            "key", "band", "rep", "fame", F.coalesce("root", "rep").alias("root")))
        sizes = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(
            F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("largest")).where("largest.n < n")
        open_rows = staged(placed.join(sizes.select("key", "n", F.col("largest.root").alias("main")), "key").select(
            "*", (F.col("root") != F.col("main")).alias("minor")))
        work = open_rows.agg(F.count("*").alias("rows"), F.sum(F.when(F.col("minor"), F.col("n"))).alias("pairs")).first()
        if not work["rows"]:
            return found
        full = staged(open_rows.join(keys, "rep"))
        met = full.where("minor")
        if not (last := work["pairs"] <= PAIRS_PER_ROW * rows):
            # Some pivots from the smaller components of each open bucket, more with each turn.
            slot = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(2**turn))
            met = staged(met.groupBy("key", slot.alias("slot")).agg(F.max_by(
                F.struct(*[F.col(c) for c in full.columns if c != "key"]), F.struct("fame", -F.col("rep"))).alias("p")
            ).select("key", "p.*"))
        # A pair counts in the first bucket that it shares, and once where both could lead it.
        earlier = [(F.col("l.band") <= i) | (F.col(f"l.k{i}") != F.col(f"r.k{i}")) for i in range(how.bands - 1)]
        fresh = reduce(Column.__and__, earlier) if last else F.lit(True)
        once = ~F.col("r.minor") | (F.col("l.rep") < F.col("r.rep")) if last else F.lit(True)
        pairs = met.alias("l").join(full.alias("r"), (F.col("l.key") == F.col("r.key")) & (
            F.col("l.root") != F.col("r.root")) & once & fresh & _may_be_alike(how)).select(
            F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b"))
        links = staged(links.unionByName(confirmed(staged(pairs.distinct()))))
        found = staged(components(links))
        if last:
            return found
        buckets = open_rows.select("key", "band", "rep", "fame").join(
            met.select("key", "rep"), ["key", "rep"], "left_anti")
        turn += 1


def _grouped(docs: DataFrame, how: MinHash) -> DataFrame:
    """near_duplicates with the text_hash of each row."""
    signed = staged(signatures(docs, how))
    worded = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    text = F.struct("doc_id", "text_hash")
    # Written with their numbers, so the numbers stay whatever is calculated again.
    classes = staged(worded.groupBy("d1", "d2").agg(F.min(text).alias("text"), F.first("bands").alias("bands")).select(
        "d1", "d2", "text.doc_id", "text.text_hash", "bands", F.monotonically_increasing_id().alias("rep")))
    found = _links(docs, classes.select("rep", "doc_id", "text_hash", "bands"), how)
    rooted = staged(classes.select("d1", "d2", "doc_id", "rep").join(
        found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "d1", "d2", "doc_id", F.coalesce("root", "rep").alias("root")))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1")
    ids = rooted.join(least.drop("n"), "root", "left").select(
        "d1", "d2", F.coalesce("component_id", "doc_id").alias("component_id"))
    return signed.select("doc_id", "text_hash", "n_shingles", "d1", "d2").join(ids, ["d1", "d2"], "left").select(
        "doc_id", "text_hash", "n_shingles",
        F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, how: MinHash = MinHash()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over
    links) and kept (doc_id = component_id).

    Texts without words, null ones included, have empty sets and are linked with nothing. A null
    doc_id cannot be linked: it stays null, with a null component, and is kept. Rows that repeat a
    doc_id are documents of their own: each has the component of its own text, so no link is lost.
    An empty table gives an empty one; only doc_id and text are read.
    """
    return _grouped(docs, how).drop("text_hash")


def keep_one(docs: DataFrame, how: MinHash = MinHash()) -> DataFrame:
    """The documents with every group of near duplicates reduced to its smallest doc_id.

    Null texts and null doc_ids stay. Rows that repeat a doc_id stay or go by their own text; those that
    repeat the text too stay or go together. Extra columns stay as they are; an empty table stays empty.
    """
    id_, text = unused(docs, "gone"), unused(docs, "gone_text")
    gone = _grouped(docs, how).where("NOT kept").select(
        F.col("doc_id").alias(id_), F.col("text_hash").alias(text)).distinct()
    return docs.join(gone, (docs["doc_id"] == gone[id_]) & (_text_hash() == gone[text]), "left_anti")
