"""Substring duplicates by content-defined chunks: a gear rolling hash cuts, digests are compared.

The hash of a place depends on the 32 bytes before it and a cut is where it is the largest around, so
an insertion moves cuts only around itself: equal passages are cut alike wherever they stand. Local
maxima, unlike a fixed threshold, keep chunks of even sizes, so short passages hold some too. Chunks are compared by 128-bit digests
of their bytes. Each distinct chunk keeps its first place (smallest doc_id, then place); all others are
copies, in the same document too. Rows that repeat a doc_id, null ones included, are documents of their
own if their texts differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.llm.shared import staged, unused, whole_text


@dataclass(frozen=True)
class Chunking:
    """Sizes in bytes. A cut's hash is the largest within `reach` on both sides, which makes chunks of
    about twice that; where none is, as in a run of one letter, max_bytes cuts."""

    reach: int = 24
    max_bytes: int = 512
    #: Shared neighbours that span fewer bytes are chance or idiom, not passages.
    min_run_bytes: int = 80


CHUNKS = "doc_id long, text_hash long, start int, stop int, d1 long, d2 long"


def gear_table() -> np.ndarray:
    """256 fixed 32-bit numbers, by a mixing rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: shift left and add, so 32 bytes count."""
    h = gear[data]
    for reach in (1, 2, 4, 8, 16):
        if len(h) > reach:
            h[reach:] += h[:-reach] << np.uint32(reach)
    return h


def largest_ahead(h: np.ndarray, n: int) -> np.ndarray:
    """The largest of each value and the n - 1 after it."""
    top, have = h.copy(), 1
    while have < n:
        step = min(have, n - have)
        if step < len(top):
            np.maximum(top[:-step], top[step:], out=top[:-step])
        have += step
    return top


def cuts(raw: bytes, sizes: Chunking, gear: np.ndarray) -> list[int]:
    """Where chunks end, the last one at the end of the text; never inside a character."""
    data = np.frombuffer(raw, np.uint8)
    h = gear_hashes(data, gear)
    h[:-1][(data[1:] & 0xC0) == 0x80] = 0  # no cut inside a character
    found = (h == largest_ahead(h, sizes.reach + 1)) & (h > 0)
    before = largest_ahead(h[::-1], sizes.reach)[::-1]
    found[1:] &= h[1:] > before[:-1]  # of equal ones the first
    ends, last = [], 0
    for end in [*(np.flatnonzero(found) + 1).tolist(), len(raw)]:
        while end - last > sizes.max_bytes:
            last += sizes.max_bytes
            while raw[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
        if end > last:
            ends.append(end)
            last = end
    return ends


def chunks(docs: DataFrame, sizes: Chunking = Chunking()) -> DataFrame:
    """One row per chunk: doc_id, its text's hash, its bytes [start, stop) and its digest in two numbers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = gear_table()
        for batch in batches:
            n, starts, stops, digests = [], [], [], []
            for text in batch.column(2).to_pylist():
                raw = text.encode()
                ends = cuts(raw, sizes, gear) if raw else []
                begins = [0, *ends[:-1]] if ends else []
                n.append(len(ends))
                starts += begins
                stops += ends
                digests += [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begins, ends, strict=True)]
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            rows = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()),
                 pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1]))],
                ["doc_id", "text_hash", "start", "stop", "d1", "d2"])

    return docs.select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), whole_text().alias("text")).mapInArrow(
        cut, CHUNKS)


def repeated_chunks(docs: DataFrame, sizes: Chunking = Chunking()) -> DataFrame:
    """Chunks that occur at more than one place: their rows with `across` (in several documents) and
    `first` (the place that is kept). Null texts have no chunks; an empty table gives an empty one."""
    cut = staged(chunks(docs, sizes))
    place = F.struct("doc_id", "text_hash", "start")
    # A row that is given twice has its chunks at the same places, which are no repeats.
    seen = cut.groupBy("d1", "d2").agg(F.min(place).alias("kept"), F.max(place).alias("last")).where("kept <> last")
    other = F.col("kept.text_hash") != F.col("last.text_hash")
    twice = seen.select("d1", "d2", "kept", (other | ~F.col("kept.doc_id").eqNullSafe(F.col("last.doc_id"))).alias("across"))
    return cut.join(twice, ["d1", "d2"]).select(
        "doc_id", "text_hash", "start", "stop", "across", place.eqNullSafe(F.col("kept")).alias("first"))


def _pieces(repeats: DataFrame) -> DataFrame:
    """Neighbouring repeated chunks: `run` numbers those without a gap, a row is a part of one that is
    all `across` documents or all not."""
    shared = repeats.distinct()
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start", "stop")
    gap = F.coalesce(F.lag("stop").over(order) < F.col("start"), F.lit(True))
    turns = gap | (F.lag("across").over(order) != F.col("across"))
    marked = shared.withColumn("gap", gap.cast("int")).withColumn("turns", turns.cast("int"))
    runs = marked.withColumn("run", F.sum("gap").over(order)).withColumn("part", F.sum("turns").over(order))
    return runs.groupBy("doc_id", "text_hash", "run", "part", "across").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"),
        F.sum(F.when(~F.col("first"), F.col("stop") - F.col("start")).otherwise(0)).alias("copied"))


def repeated_passages(docs: DataFrame, sizes: Chunking = Chunking()) -> DataFrame:
    """Runs of neighbouring chunks that occur in several documents: doc_id, text_hash, bytes
    [start, stop), and how many of these bytes stand elsewhere first.

    Null texts count as empty and hold no passage. Rows that repeat a doc_id, null included, are documents
    of their own where their texts differ; a row that is given twice counts once. An empty table gives an
    empty one; only doc_id and text are read.
    """
    return _pieces(repeated_chunks(docs, sizes)).where("across").where(
        F.col("stop") - F.col("start") >= sizes.min_run_bytes).drop("run", "part", "across")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")


def passage_report(docs: DataFrame, sizes: Chunking = Chunking()) -> DataFrame:
    """One row per document that holds a repeated passage.

    n_passages, shared_bytes, copied_bytes (those kept elsewhere) and spans (start:stop in bytes, by start)
    tell of passages that stand in several documents; n_repeats and repeat_spans of all that stand at several
    places, in the same document too. Edge cases are those of repeated_passages.
    """
    long = F.col("stop") - F.col("start") >= sizes.min_run_bytes
    passage = F.when(F.col("across") & long, F.struct("start", "stop", "copied"))
    runs = _pieces(repeated_chunks(docs, sizes)).groupBy("doc_id", "text_hash", "run").agg(
        F.collect_list(passage).alias("passages"), F.min("start").alias("start"), F.max("stop").alias("stop")).where(long)
    texts = runs.groupBy("doc_id", "text_hash").agg(
        F.flatten(F.collect_list("passages")).alias("found"), F.collect_list(F.struct("start", "stop")).alias("repeats"))

    def total(value) -> Column:
        return F.aggregate("found", F.lit(0).cast("long"), lambda acc, s: acc + value(s))

    return texts.select(
        "doc_id", F.size("found").cast("long").alias("n_passages"), total(lambda s: s["stop"] - s["start"]).alias("shared_bytes"),
        total(lambda s: s["copied"]).alias("copied_bytes"), _written(F.col("found")).alias("spans"),
        F.size("repeats").cast("long").alias("n_repeats"), _written(F.col("repeats")).alias("repeat_spans"))


def drop_repeats(docs: DataFrame, sizes: Chunking = Chunking()) -> DataFrame:
    """The documents with every later copy of a chunk inside a passage cut out of `text`.

    Other columns stay, null texts and ids too. A row that is given twice is cut alike both times.
    """
    repeats = staged(repeated_chunks(docs, sizes))
    inside = _pieces(repeats).groupBy(F.col("doc_id").alias("in_doc"), F.col("text_hash").alias("in_text"), "run").agg(
        F.min("start").alias("a"), F.max("stop").alias("b")).where(F.col("b") - F.col("a") >= sizes.min_run_bytes)
    copies = repeats.where("NOT first").select("doc_id", "text_hash", "start", "stop")
    here = F.col("doc_id").eqNullSafe(F.col("in_doc")) & (F.col("text_hash") == F.col("in_text"))
    id_, hash_, cut = unused(docs, "id"), unused(docs, "hash"), unused(docs, "cut")
    spans = copies.join(inside, here).where("start >= a AND stop <= b").groupBy(
        F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias(cut))
    text = F.encode(whole_text(), "UTF-8")
    pieces = F.aggregate(
        F.col(cut), F.struct(F.lit(0).alias("at"), F.lit(b"").alias("out")),
        lambda acc, s: F.struct(s["stop"].alias("at"), F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    names = [F.col(f"`{c}`") if c != "text" else F.when(F.col(cut).isNull(), F.col("text")).otherwise(
        F.decode(pieces, "UTF-8")).alias("text") for c in docs.columns]
    same = docs["doc_id"].eqNullSafe(spans[id_]) & (F.xxhash64(whole_text()) == spans[hash_])
    return docs.join(spans, same, "left").select(*names)
