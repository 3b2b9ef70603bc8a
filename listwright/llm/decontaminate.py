"""Benchmark decontamination by SimHash windows of item size.

Items and documents are compared as word sequences in lower case without punctuation. An item is
fingerprinted in windows of a size class not above its own length, at every start within one
stride of its beginning and of its end; documents in windows of each class at every stride-th word. So wherever an item occurs in
a document some pair of windows covers the same words. The fingerprints' Hamming index has
radius + 1 blocks: two fingerprints within the radius agree on a whole block, so the index finds
all of them. Candidates are verified exactly: the weight of the item's shingles found in the
document's stretch of that size against the weight of all. Items too short for a window at every
place are looked up whole, by the hash of their words, and marked as short.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.near_dup import WordHash
from listwright.llm.shared import unused, whole_text

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Decontamination:
    shingle_words: int = 5
    min_similarity: float = 0.8
    radius: int = 7
    stride: int = 4
    #: Words fingerprinted at once; longer stretches are handled piece by piece, overlapping.
    slab_words: int = 200_000
    #: Items per index; more items are handled in as many passes over the documents.
    block_items: int = 20_000
    #: Words by which a verified stretch may be longer than the item on either side.
    margin: int = 3

    @property
    def min_words(self) -> int:
        """Shorter items have no window at every place: they are looked up word for word."""
        return max(self.shingle_words, 2 * self.stride - 1)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def word_hashes(words: list[str], kept: WordHash) -> np.ndarray:
    return np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))


def bit_counts(hashes: np.ndarray, per: int) -> np.ndarray:
    """How often each of the 64 bits is set in every `per` hashes; a last short group is one too."""
    if short := -len(hashes) % per:
        hashes = np.concatenate([hashes, np.zeros(short, np.uint64)])
    bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, per, 64)
    return bits.sum(axis=1, dtype=np.uint16)


def sum_type(size: int) -> type:
    """Sums may wrap around, but a window's own counts must fit."""
    return np.uint16 if size < 1 << 16 else np.uint32


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for every `size` words in a row."""
    found = np.zeros(len(hashes) - size + 1, np.uint64)
    for i in range(size):
        found = found * np.uint64(0x9E3779B97F4A7C15) + hashes[i:len(hashes) - size + 1 + i]
    return found


def fingerprints(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """64-bit SimHashes: bits set in more than half of a window's words."""
    return np.packbits(counts > (words // 2).astype(counts.dtype)[:, None], axis=1).view("<u8")[:, 0]


def size_classes(lengths: list[int], stride: int) -> list[int]:
    """Multiples of the stride, each about 1.4 times the one before, from the shortest item's on."""
    low, high = min(lengths), max(lengths)
    size = max(stride, (low - stride + 1) // stride * stride)
    sizes = [size]
    while (size := max(size + stride, round(size * 1.4 / stride) * stride)) <= high - stride + 1:
        sizes.append(size)
    return sizes


class HammingIndex:
    """All stored fingerprints within `radius` bits of a query, by equal blocks."""

    def __init__(self, stored: np.ndarray, radius: int):
        self.stored, self.radius = stored, radius
        edges = np.linspace(0, 64, radius + 2).round().astype(int)
        self.blocks = []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            keys = self._key(stored, a, z)
            order = np.argsort(keys, kind="stable")
            counts = np.bincount(keys, minlength=1 << (z - a))
            self.blocks.append((a, z, order, np.concatenate([[0], np.cumsum(counts)])))

    @staticmethod
    def _key(values: np.ndarray, a: int, z: int) -> np.ndarray:
        return ((values >> np.uint64(a)) & np.uint64((1 << (z - a)) - 1)).astype(np.int64)

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, stored) places of all pairs within the radius, each once."""
        found = []
        for a, z, order, starts in self.blocks:
            keys = self._key(queries, a, z)
            n = starts[keys + 1] - starts[keys]
            hit = np.flatnonzero(n)
            n = n[hit]
            q = np.repeat(hit, n)
            within = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
            s = order[np.repeat(starts[keys[hit]], n) + within]
            ok = np.bitwise_count(queries[q] ^ self.stored[s]) <= self.radius
            found.append(np.stack([q[ok], s[ok]]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pairs[0], pairs[1]


class Benchmark:
    """A block of items: their windows' indexes by size class, weighted shingles, and the short items."""

    def __init__(self, items: list[tuple[int, str]], how: Decontamination):
        self.how, self.ids = how, [i for i, _ in items]
        words_by_item = [words_of(text or "") for _, text in items]
        self.words = [w if len(w) >= how.min_words else [] for w in words_by_item]
        self.hashes = WordHash(str.encode)
        #: By number of words: the sorted hashes of all short items, and the items of each word sequence.
        self.short: dict[int, tuple[np.ndarray, dict[tuple[str, ...], list[int]]]] = {}
        for n, words in enumerate(words_by_item):
            if 0 < len(words) < how.min_words:
                self.short.setdefault(len(words), (np.zeros(0, np.uint64), {}))[1].setdefault(tuple(words), []).append(n)
        for size, (_, known) in self.short.items():
            runs = [run_hashes(word_hashes(list(words), self.hashes), size) for words in known]
            self.short[size] = np.unique(np.concatenate(runs)), known
        self.indexes: list[tuple[int, HammingIndex, np.ndarray, np.ndarray]] = []
        k = how.shingle_words
        seen: dict[tuple, int] = {}
        for words in self.words:
            for shingle in {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}:
                seen[shingle] = seen.get(shingle, 0) + 1
        # A shingle that many items share says less about each.
        self.weights = [{s: 1.0 / seen[s] for s in (tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))}
                        for w in self.words]
        lengths = [len(w) for w in self.words if w]
        if not lengths:
            return
        sizes = size_classes(lengths, how.stride)
        by_size: dict[int, list[int]] = {}
        for n, words in enumerate(self.words):
            if words:
                fit = [s for s in sizes if s <= len(words) - how.stride + 1]
                by_size.setdefault(fit[-1] if fit else min(sizes), []).append(n)
        for size, members in sorted(by_size.items()):
            counts, item, offset = [], [], []
            for n in members:
                each = bit_counts(word_hashes(self.words[n], self.hashes), 1)
                kind = sum_type(size)
                total = np.concatenate([np.zeros((1, 64), kind), np.cumsum(each, 0, kind)])
                last = max(0, len(self.words[n]) - size)
                for o in sorted({*range(min(how.stride, last + 1)), *range(max(0, last - how.stride + 1), last + 1)}):
                    counts.append(total[min(o + size, len(total) - 1)] - total[o])
                    item.append(n)
                    offset.append(o)
            words = np.array([min(size, len(self.words[n])) for n in item])
            self.indexes.append((size, HammingIndex(fingerprints(np.array(counts), words), how.radius),
                                 np.array(item), np.array(offset)))

    def similarity(self, item: int, words: list[str], start: int) -> float:
        """Weighted containment of the item's shingles in the stretch of its size around `start`."""
        k, weights = self.how.shingle_words, self.weights[item]
        a = max(0, start - self.how.margin)
        z = start + len(self.words[item]) + self.how.margin
        stretch = words[a:z]
        there = {tuple(stretch[i:i + k]) for i in range(max(1, len(stretch) - k + 1))}
        return sum(w for s, w in weights.items() if s in there) / sum(weights.values())

    def matches(self, documents: list[list[str]]) -> Iterator[tuple[int, int, float, int]]:
        """(document, item, similarity, first word) of every verified pair, best stretch of each."""
        how = self.how
        slab: list[tuple[int, int, list[str]]] = []
        held = 0
        overlap = max([len(w) for w in self.words] + [how.min_words]) + how.stride
        overlap += -overlap % how.stride
        for d, words in enumerate(documents):
            for at in range(0, max(1, len(words)), how.slab_words):
                part = words[at:at + how.slab_words + overlap]
                slab.append((d, at, part))
                held += len(part)
                if held >= how.slab_words:
                    yield from self._slab(documents, slab)
                    slab, held = [], 0
        yield from self._slab(documents, slab)

    def _slab(self, documents: list[list[str]], slab: list[tuple[int, int, list[str]]]):
        stride = self.how.stride
        # Block k of a part covers its words from k * stride on; the last one may be short.
        firsts, sizes, flat, words = [], [], [], [np.zeros(1, np.int64)]
        total = 0
        for _, _, part in slab:
            n = -(-len(part) // stride)
            firsts.append(total)
            sizes.append(n)
            total += n
            hashes = word_hashes(part, self.hashes)
            if short := n * stride - len(part):
                hashes = np.concatenate([hashes, np.zeros(short, np.uint64)])
            flat.append(hashes)
            full = np.full(n, stride)
            full[-1:] -= n * stride - len(part)
            words.append(full)
        if not total:
            return
        part_of = np.repeat(np.arange(len(slab)), sizes)
        hashes = np.concatenate(flat)
        yield from self._short(slab, hashes, part_of, firsts)
        if not self.indexes:
            return
        kind = sum_type(max(size for size, *_ in self.indexes))
        sums = np.concatenate([np.zeros((1, 64), kind), bit_counts(hashes, stride).astype(kind)])
        # Counts wrap around, but their differences within a window do not.
        np.cumsum(sums, axis=0, dtype=kind, out=sums)
        n_words = np.cumsum(np.concatenate(words))
        best: dict[tuple[int, int], tuple[float, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        ends = np.repeat(np.array(firsts) + np.array(sizes), sizes)
        for size, index, item, offset in self.indexes:
            n = size // stride
            at = np.flatnonzero(np.arange(total) + n <= ends)
            prints = fingerprints(sums[n:] - sums[:-n], n_words[n:] - n_words[:-n])[at] if total >= n else at.astype("<u8")
            # A part shorter than the window is one window as a whole.
            small = np.array([f for f, s in zip(firsts, sizes, strict=True) if 0 < s < n], np.int64)
            stop = ends[small]
            prints = np.concatenate([prints, fingerprints(sums[stop] - sums[small], n_words[stop] - n_words[small])])
            at = np.concatenate([at, small])
            q, s = index.near(prints)
            for where, which in zip(at[q].tolist(), s.tolist(), strict=True):
                p = int(part_of[where])
                d, base, _ = slab[p]
                start = base + (where - firsts[p]) * stride - int(offset[which])
                key = (d, int(item[which]), start)
                if key in tried or best.get(key[:2], (0.0, 0))[0] == 1.0:
                    continue
                tried.add(key)
                found = self.similarity(key[1], documents[d], start)
                if found >= self.how.min_similarity and found > best.get(key[:2], (0.0, 0))[0]:
                    best[key[:2]] = found, max(0, start)
        for (d, n), (found, start) in best.items():
            yield d, n, found, start


    def _short(self, slab: list[tuple[int, int, list[str]]], hashes: np.ndarray, part_of: np.ndarray, firsts: list[int]):
        """The first place of every short item in each part; the words themselves decide."""
        stride = self.how.stride
        for size, (wanted, known) in self.short.items():
            if len(hashes) < size:
                continue
            met: set[tuple[int, int]] = set()
            for where in np.flatnonzero(np.isin(run_hashes(hashes, size), wanted)).tolist():
                p = int(part_of[where // stride])
                d, base, part = slab[p]
                start = where - firsts[p] * stride
                for n in known.get(tuple(part[start:start + size]), ()):
                    if (p, n) not in met:
                        met.add((p, n))
                        yield d, n, 1.0, base + start


def contamination(docs: DataFrame, items: DataFrame, how: Decontamination = Decontamination()) -> DataFrame:
    """One row per document and item that occurs in it: doc_id, item_id, similarity, first_word, short.

    `items` (item_id, text) is read in blocks of how.block_items, each small enough for a task; every
    block is matched against all documents. Null and empty texts match nothing, null doc_ids stay null,
    repeated rows are matched each, empty tables give an empty one; other columns are not read.
    Items of fewer than how.min_words words count where all their words stand in a row (similarity 1)
    and are marked `short`; items without words occur nowhere.
    """
    schema = "doc_id long, item_id long, similarity double, first_word long, short boolean"
    texts = docs.select("doc_id", whole_text().alias("text"))
    found = None
    for block in _blocks(items, how.block_items):
        def match(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            benchmark = Benchmark(block, how)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                documents = [words_of(t) for t in batch.column(1).to_pylist()]
                # A document's parts may lie in several slabs: the best of its stretches counts.
                best: dict[tuple[int, int], tuple[float, int]] = {}
                for d, n, similarity, start in benchmark.matches(documents):
                    best[d, n] = max(best.get((d, n), (0.0, 0)), (similarity, start))
                rows = [(ids[d], benchmark.ids[n], s, start, not benchmark.words[n])
                        for (d, n), (s, start) in sorted(best.items())]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                            pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()), strict=True)],
                        ["doc_id", "item_id", "similarity", "first_word", "short"])

        part = texts.mapInArrow(match, schema)
        found = part if found is None else found.unionByName(part)
    return texts.sparkSession.createDataFrame([], schema) if found is None else found


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    """The items with text in blocks of a bounded number, one block on the driver at a time."""
    wanted = items.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").distinct()
    last = None
    while True:
        rest = wanted if last is None else wanted.where(
            (F.col("item_id") > last[0]) | ((F.col("item_id") == last[0]) & (F.col("text") > last[1])))
        block = [(r["item_id"], r["text"]) for r in rest.orderBy("item_id", "text").limit(size).collect()]
        if block:
            yield block
        if len(block) < size:
            return
        last = block[-1]


def drop_contaminated(docs: DataFrame, items: DataFrame, how: Decontamination = Decontamination()) -> DataFrame:
    """The documents that no item occurs in; short items are too common to condemn a document.

    A null doc_id cannot be named by a match and stays.
    """
    name = unused(docs, "leak")
    leaks = contamination(docs, items, how).where("NOT short").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(leaks, docs["doc_id"] == leaks[name], "left_anti")
