"""Best-fit-decreasing packing of token ids into fixed windows, and their binary form.

Overlong documents are split without loss: full windows first, the rest competes for space. Pieces
go, longest first, into the open window with the least sufficient room; a segment tree over room
sizes finds it in logarithmic time. Each task packs its own documents, as they come from the scan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from listwright.llm.shared import whole_text, worker_cache
from listwright.llm.tokens import IdEncoder

WINDOW = 2048
#: The id that ends a document and, as padding, fills a window.
END_ID = 1
#: Ids that a task holds before it packs them; the remaining room of such a share stays empty.
SHARE_IDS = 8_000_000


class RoomTree:
    """A segment tree over room sizes 0..capacity, each leaf a stack of open windows."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, room: int, by: int) -> None:
        node = self.size + room
        while node:
            self.counts[node] += by
            node >>= 1

    def add(self, room: int, window: int) -> None:
        self.stacks[room].append(window)
        self._change(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The window with the smallest room of at least `least`, taken out; None if there is none."""
        node = self.size + least
        if not self.counts[node]:
            # Climb until a right sibling holds windows, then go down to its smallest leaf.
            while node > 1 and (node & 1 or not self.counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                if not self.counts[node]:
                    node += 1
        room = node - self.size
        window = self.stacks[room].pop()
        self._change(room, -1)
        return room, window


def best_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(window, offset) of each piece by best fit decreasing; ties keep the given order."""
    places: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    tree, windows = RoomTree(capacity), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if not (found := tree.take(n)):
            found = capacity, windows
            windows += 1
        room, window = found
        places[i] = window, capacity - room
        if room > n:
            tree.add(room - n, window)
    return places


def pieces(n_ids: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then the rest."""
    return [(at, min(window, n_ids - at)) for at in range(0, n_ids, window)]


PACKED = ("sequence_id long, n_tokens long, n_segments long, ids binary, cu_seqlens array<int>, positions binary, "
          "doc_ids array<long>, starts array<long>, doc_tokens array<long>")


def packed_windows(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID,
                   share_ids: int = SHARE_IDS, checksums: bool = False) -> DataFrame:
    """One row per window: its ids (`window` little-endian uint32, padded by end_id), the cumulative
    segment lengths from 0, the position of every id within its segment (uint32, 0 in padding) and
    of each segment the doc_id, the ids of its document before it and the document's ids in all.

    Every document ends with end_id; a null text counts as empty and is that id alone. Null and
    repeated doc_ids are kept as they come; an empty table gives an empty one; only doc_id and text
    are read. sequence_id is unique, not gapless. `checksums` gives ids_crc32 and positions_crc32
    in place of the two binary columns.
    """
    binary = ((lambda value: zlib.crc32(value)), pa.int64()) if checksums else ((lambda value: value), pa.binary())
    schema = PACKED.replace("ids binary", "ids_crc32 long").replace(
        "positions binary", "positions_crc32 long") if checksums else PACKED
    names = [part.split()[0] for part in schema.split(", ")]

    def rows(share: list[tuple[object, bytes]], first: int) -> pa.RecordBatch:
        parts = [(d, start, n) for d, (_, ids) in enumerate(share) for start, n in pieces(len(ids) // 4, window)]
        filled: dict[int, list[tuple[int, int, int, int]]] = {}
        for (w, offset), (d, start, n) in zip(best_fit([n for _, _, n in parts], window), parts, strict=True):
            filled.setdefault(w, []).append((offset, d, start, n))
        pad = np.uint32(end_id).tobytes()
        out: list[list] = [[] for _ in range(9)]
        for w, segments in sorted(filled.items()):
            segments.sort()
            used = segments[-1][0] + segments[-1][3]
            ids = b"".join(share[d][1][4 * s:4 * (s + n)] for _, d, s, n in segments)
            positions = np.zeros(window, "<u4")
            for offset, _, _, n in segments:
                positions[offset:offset + n] = np.arange(n)
            for column, value in zip(out, (
                    first + w, used, len(segments), binary[0](ids + pad * (window - used)), [0, *(o + n for o, _, _, n in segments)],
                    binary[0](positions.tobytes()), [share[d][0] for _, d, _, _ in segments], [s for _, _, s, _ in segments],
                    [len(share[d][1]) // 4 for _, d, _, _ in segments]), strict=True):
                column.append(value)
        longs = pa.list_(pa.int64())
        kinds = [pa.int64()] * 3 + [binary[1], pa.list_(pa.int32()), binary[1], longs, longs, longs]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = worker_cache("ids_byte_bpe", IdEncoder), np.uint32(end_id).tobytes()
        first = TaskContext.get().partitionId() << 33
        share: list[tuple[object, bytes]] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                share.append((doc_id, encode(text) + end))
                held += len(share[-1][1]) // 4
                if held >= share_ids:
                    found = rows(share, first)
                    yield from sliced(found)
                    first += found.num_rows
                    share, held = [], 0
        if share:
            yield from sliced(rows(share, first))

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(pack, schema)


def sliced(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The rows in small batches, so that the JVM holds few windows at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def write_windows(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> None:
    """Write the windows as Parquet; `read_matrix` gives the id matrix of rows of it."""
    packed_windows(docs, window, end_id).write.parquet(path)


def read_matrix(ids: list[bytes], window: int = WINDOW) -> np.ndarray:
    """The id matrix (uint32, one row per window) of written rows."""
    return np.frombuffer(b"".join(ids), "<u4").reshape(-1, window)
