"""Lexical retrieval packing: windows are filled with the seed's BM25 neighbours.

Every task keeps an inverted index of its share of the documents, a shard, over their token ids.
A window starts with a seed document; the index returns its unused neighbours, best first, and
they fill the window greedily. When none of them fits whole, the best is cut and its rest is
the next seed, so windows are full. A shard's last ids go to windows of powers of two, unpadded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from listwright.llm.shared import whole_text, worker_cache
from listwright.llm.tokens import IdEncoder


@dataclass(frozen=True)
class RetrievalPacking:
    window: int = 2048
    end_id: int = 1
    #: A shard is packed when it holds so many ids.
    shard_ids: int = 6_000_000
    #: Without effect: all neighbours are tried. Kept for callers that pass it.
    tried: int = 16
    k1: float = 1.2
    b: float = 0.75


#: Terms in at least one of so many documents of a shard are kept as rows over all its documents.
DENSE = 8


class Index:
    """BM25 postings of a shard's documents, and their terms as queries."""

    def __init__(self, documents: list[np.ndarray], how: RetrievalPacking):
        terms, counts, sizes = [], [], []
        for ids in documents:
            found, n = np.unique(ids, return_counts=True)
            terms.append(found)
            counts.append(n)
            sizes.append(len(found))
        owner = np.repeat(np.arange(len(documents), dtype=np.int32), sizes)
        term, tf = np.concatenate(terms), np.concatenate(counts).astype(np.float32)
        length = np.array([len(ids) for ids in documents], np.float32)
        df = np.bincount(term)
        idf = np.log1p((len(documents) - df + 0.5) / (df + 0.5)).astype(np.float32)
        norm = how.k1 * (1 - how.b + how.b * length / length.mean())
        weight = idf[term] * tf * (how.k1 + 1) / (tf + norm[owner])
        # Terms of one document only find nobody.
        useful = df[term] > 1
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.queries = []
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            self.queries.append(term[a:z][useful[a:z]])
        # Frequent terms have a whole row of weights, which sums without looking up owners.
        self.row = np.where(df * DENSE >= len(documents), np.cumsum(df * DENSE >= len(documents)) - 1, -1)
        dense = self.row[term] >= 0
        self.rows = np.zeros((self.row.max(initial=-1) + 1, len(documents)), np.float32)
        self.rows[self.row[term[dense]], owner[dense]] = weight[dense]
        term, owner, weight = term[~dense], owner[~dense], weight[~dense]
        order = np.argsort(term, kind="stable")
        # In the types that the sums take, so that no question converts them.
        self.owner, self.weight = owner[order].astype(np.intp), weight[order].astype(np.float64)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(df)))])
        self.n = len(documents)

    def scores(self, seed: int, used: np.ndarray) -> np.ndarray:
        """How well every document answers the seed; 0 for used ones and those that share no term."""
        terms = self.queries[seed]
        if not len(terms):
            return np.zeros(self.n)
        rows = self.row[terms]
        frequent = rows >= 0
        spans = list(zip(self.starts[terms[~frequent]].tolist(), self.starts[terms[~frequent] + 1].tolist(), strict=True))
        scores = np.add.reduce(self.rows[rows[frequent]], axis=0).astype(np.float64)
        if spans:
            owners = np.concatenate([self.owner[a:z] for a, z in spans])
            scores += np.bincount(owners, np.concatenate([self.weight[a:z] for a, z in spans]), self.n)
        scores[used] = 0
        return scores


def fill(documents: list[np.ndarray], how: RetrievalPacking) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length); every id lies in exactly one."""
    index, lengths = Index(documents, how), [len(ids) for ids in documents]
    sizes = np.array(lengths)
    used, fresh = np.zeros(len(documents), bool), iter(np.argsort(lengths, kind="stable")[::-1].tolist())
    windows: list[list[tuple[int, int, int]]] = []
    current: list[tuple[int, int, int]] = []
    room = how.window

    def place(document: int, start: int) -> int:
        """Put ids of the document from `start` on as far as they fit; where its rest starts."""
        nonlocal room, current
        n = min(room, lengths[document] - start)
        current.append((document, start, n))
        room -= n
        if not room:
            windows.append(current)
            current, room = [], how.window
        return start + n

    def next_fresh() -> int | None:
        return next((d for d in fresh if not used[d]), None)

    seed, start = next_fresh(), 0
    while seed is not None:
        used[seed] = True
        while start < lengths[seed]:
            start = place(seed, start)
        # The seed's end lies in the open window, or filled one: its neighbours go on from there.
        asked, seed, start = seed, None, 0
        if current:
            scores = index.scores(asked, used)
        while current:
            near = np.where(sizes <= room, scores, 0)
            best = int(near.argmax())
            if near[best] <= 0:
                # None fits whole: the best neighbour is cut and its rest opens the next window.
                best = int(scores.argmax())
                seed = best if scores[best] > 0 else None
                break
            used[best], scores[best] = True, 0
            place(best, 0)
        if seed is None:
            seed = next_fresh()
    # What is left over goes to windows of powers of two, largest first.
    left = sum(n for _, _, n in current)
    while current:
        size, taken = 1 << (left.bit_length() - 1), []
        left -= size
        while size:
            document, start, n = current.pop(0)
            part = min(n, size)
            taken.append((document, start, part))
            size -= part
            if part < n:
                current.insert(0, (document, start + part, n - part))
        windows.append(taken)
    return windows


def retrieval_pack(docs: DataFrame, how: RetrievalPacking = RetrievalPacking(), checksums: bool = False) -> DataFrame:
    """One row per piece: doc_id, start (its document's ids before it), length, ids (little-endian
    uint32; with `checksums` ids_crc32 in their place), doc_tokens, sequence_id and offset there.

    A document is its byte-level BPE ids and end_id; a null text counts as empty and is end_id
    alone. Null and repeated doc_ids are packed as they come. sequence_id is unique, not gapless. An empty
    table gives an empty one; only doc_id and text are read.
    """
    schema = ("doc_id long, start long, length long, " + ("ids_crc32 long" if checksums else "ids binary")
              + ", doc_tokens long, sequence_id long, offset long")
    names = [part.split()[0] for part in schema.split(", ")]

    def rows(ids: list, shard: list[np.ndarray], first: int) -> tuple[int, Iterator[pa.RecordBatch]]:
        windows = fill(shard, how)
        out: list[list] = [[] for _ in names]
        for w, pieces in enumerate(windows):
            offset = 0
            for d, start, n in pieces:
                raw = shard[d][start:start + n].tobytes()
                for column, value in zip(out, (ids[d], start, n, zlib.crc32(raw) if checksums else raw, len(shard[d]),
                                               first + w, offset), strict=True):
                    column.append(value)
                offset += n
        kinds = [pa.binary() if name == "ids" else pa.int64() for name in names]
        batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)
        return len(windows), (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = worker_cache("ids_byte_bpe", IdEncoder), np.uint32(how.end_id).tobytes()
        first = TaskContext.get().partitionId() << 33
        ids: list = []
        shard: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                shard.append(np.frombuffer(encode(text) + end, "<u4"))
                held += len(shard[-1])
                if held >= how.shard_ids:
                    n, found = rows(ids, shard, first)
                    yield from found
                    first += n
                    ids, shard, held = [], [], 0
        if shard:
            yield from rows(ids, shard, first)[1]

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(pack, schema)
