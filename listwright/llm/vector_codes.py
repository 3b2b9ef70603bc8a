"""Product codes of vectors, trained exactly with anchors-hierarchy metric trees.

Vectors are cut into parts, and each part position has a codebook that Lloyd rounds move. The parts
of a block of vectors lie in a metric tree (Moore, 2000), made middle-out: about sqrt(n) anchors
attract the points nearest to them, a new anchor stealing only where the triangle inequality
allows; large anchors are split again in the same way, and the anchors of each set are merged into
balls from below. A ball keeps its sum and count. A round hands the codebook entries down the tree:
a ball drops every entry whose bisector with the nearest one it does not reach, and a ball with one
entry left is wholly owned, so that its cached sum and count are added without a look at its points.

Trees are built once where the scan's tasks have the vectors and are written out; each round is one
pass over them that sends a sum per part, entry and task.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.shared import staged
from listwright.llm.vectors import attached, integer_vectors


@dataclass(frozen=True)
class ProductCodes:
    parts: int = 16
    #: The codebooks start from the parts of this many vectors with the smallest vec_ids.
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    #: Vectors that share their trees.
    block: int = 16_384
    #: Sets of more points are split into anchors, at most `anchors` of them at once.
    leaf: int = 32
    anchors: int = 16


class Tree:
    """Balls as arrays: centre, radius, sum, count, children (-1: a leaf) and a leaf's run of points."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        self.centre, self.radius, self.sums, self.counts = [], [], [], []
        self.children: list[np.ndarray] = []
        self.runs: list[np.ndarray] = []
        self.size = 0

    @classmethod
    def of(cls, fields: dict) -> Tree:
        tree = cls.__new__(cls)
        vars(tree).update(fields)
        return tree

    def add(self, centre, radius, sums, counts) -> np.ndarray:
        """New balls without children or points; their numbers."""
        made = np.arange(self.size, self.size + len(counts))
        self.size += len(counts)
        self.centre.append(centre)
        self.radius.append(radius * (1 + 1e-12))
        self.sums.append(sums)
        self.counts.append(counts)
        self.children.append(np.full((len(counts), 2), -1))
        self.runs.append(np.zeros((len(counts), 2), np.int64))
        return made

    def close(self) -> None:
        for name in ("centre", "radius", "sums", "counts", "children", "runs"):
            setattr(self, name, np.concatenate(getattr(self, name)))
        kind = next(k for k in (np.int16, np.int32, np.int64) if np.array_equal(self.points.astype(k), self.points))
        self.points, self.order = self.points.astype(kind), self.order.astype(np.int32)


def _spread(points: np.ndarray, starts: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of many sets at once: `points` sorted by set, set s from starts[s], many[s] anchors each.

    The next anchor of a set is its point farthest from its own anchor. Returns each point's anchor
    (numbered within the set), its squared distance, and the anchors' positions (sets x most).
    """
    sets = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(points)))
    at = np.zeros((len(starts), many.max()), np.int64)
    at[:, 0] = starts
    near = ((points - points[starts][sets]) ** 2).sum(axis=1)
    owner = np.zeros(len(points), np.int64)
    for step in range(1, many.max()):
        far = np.maximum.reduceat(near, starts)
        going = (many > step) & (far > 0)
        if not going.any():
            break
        hit = np.flatnonzero(near == far[sets])
        first = hit[np.unique(sets[hit], return_index=True)[1]]
        at[:, step] = first
        # A point closer to its anchor than half way to the new one cannot be stolen.
        apart = ((points[at[:, :step]] - points[first][:, None]) ** 2).sum(axis=2)
        maybe = np.flatnonzero(going[sets] & (near * 4 > apart[sets, owner]))
        new = ((points[maybe] - points[first][sets[maybe]]) ** 2).sum(axis=1)
        won = new < near[maybe]
        near[maybe[won]], owner[maybe[won]] = new[won], step
    return owner, near, at


def _merge(tree: Tree, balls: np.ndarray, parents: np.ndarray) -> None:
    """Join the balls of each set (sets x most, -1: none) two by two into the smallest ball around both.

    The last ball of a set takes the place of its parent, or is the root where the parent is -1.
    """
    here, width = np.arange(len(balls)), balls.shape[1]
    live = balls >= 0
    centre = np.concatenate(tree.centre)[balls]
    radius = np.concatenate(tree.radius)[balls]
    sums, counts = np.concatenate(tree.sums)[balls], np.concatenate(tree.counts)[balls]
    ids = balls.copy()

    def around(c, r):
        """Radius of the ball around two, for all pairs of (.., m) and (.., k) balls."""
        apart = np.sqrt(((c[0] - c[1]) ** 2).sum(axis=-1))
        return np.maximum((apart + r[0] + r[1]) / 2, np.maximum(r[0], r[1])), apart

    cost, _ = around((centre[:, :, None], centre[:, None]), (radius[:, :, None], radius[:, None]))
    cost[~(live[:, :, None] & live[:, None])] = np.inf
    cost[:, np.arange(width), np.arange(width)] = np.inf
    while (open_ := live.sum(axis=1) > 1).any():
        g = here[open_]
        i, j = np.divmod(cost[g].reshape(len(g), -1).argmin(axis=1), width)
        r, apart = around((centre[g, i], centre[g, j]), (radius[g, i], radius[g, j]))
        step = np.where(apart > 0, np.clip(r - radius[g, i], 0, apart) / np.where(apart > 0, apart, 1), 0)
        middle = centre[g, i] + (centre[g, j] - centre[g, i]) * step[:, None]
        made = tree.add(middle, r, sums[g, i] + sums[g, j], counts[g, i] + counts[g, j])
        tree.children[-1][:, 0], tree.children[-1][:, 1] = ids[g, i], ids[g, j]
        ids[g, i], centre[g, i], radius[g, i] = made, middle, tree.radius[-1]
        sums[g, i] += sums[g, j]
        counts[g, i] += counts[g, j]
        live[g, j] = False
        fresh, _ = around((middle[:, None], centre[g]), (radius[g, i][:, None], radius[g]))
        fresh[~live[g]] = np.inf
        fresh[np.arange(len(g)), i] = np.inf
        cost[g, i], cost[g, :, i] = fresh, fresh
        cost[g, j], cost[g, :, j] = np.inf, np.inf
    last = ids[here, live.argmax(axis=1)]
    if parents[0] < 0:
        tree.root = int(last[0])
        return
    # The set's own ball stays (its bound is tighter) and takes the children of the last merger.
    children, runs = np.concatenate(tree.children), np.concatenate(tree.runs)
    children[parents], runs[parents] = np.stack([last, np.full(len(last), -1)], axis=1), 0
    tree.children, tree.runs = [children], [runs]


def build_tree(points: np.ndarray, how: ProductCodes) -> Tree:
    """The metric tree of integer points (n x width, n at least 1)."""
    tree = Tree(points.astype(np.float64))
    starts, parents = np.array([0]), np.array([-1])
    ends = np.array([len(points)])
    while len(starts):
        # All sets of this level are split at once.
        sizes = ends - starts
        index = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)])
        local = np.cumsum(sizes) - sizes
        many = np.clip(np.ceil(np.sqrt(sizes)).astype(np.int64), 1, how.anchors)
        owner, near, at = _spread(tree.points[index], local, many)
        sets = np.repeat(np.arange(len(starts)), sizes)
        label = sets * many.max() + owner
        by_anchor = np.argsort(label, kind="stable")
        groups, first, counts = np.unique(label[by_anchor], return_index=True, return_counts=True)
        centres = tree.points[index][at.ravel()[groups]]
        radius = np.sqrt(np.maximum.reduceat(near[by_anchor], first))
        moved = index[by_anchor]
        tree.points[index], tree.order[index] = tree.points[moved], tree.order[moved]
        sums = np.add.reduceat(tree.points[index], first, axis=0)
        made = tree.add(centres, radius, sums, counts)
        # Positions of the anchors' runs: sets lie apart, so shift each by its set's place.
        begin = index[first]
        tree.runs[-1][:, 0], tree.runs[-1][:, 1] = begin, begin + counts
        balls = np.full((len(starts), many.max()), -1)
        balls.ravel()[groups] = made
        _merge(tree, balls, parents)
        again = (counts > how.leaf) & (radius > 0)
        starts, ends, parents = begin[again], (begin + counts)[again], made[again]
    tree.close()
    return tree


class Codebook:
    """Entries (k x width integers) of one part position, with what pruning needs."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.near = entries.astype(np.float64)
        self.apart = np.sqrt(((self.near[:, None] - self.near[None]) ** 2).sum(axis=2))

    def shrink(self, centre: np.ndarray, radius: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """The candidates (balls x k) of which a point inside the ball may be nearest."""
        d = ((centre[:, None] - self.near[None]) ** 2).sum(axis=2)
        best = np.where(open_, d, np.inf).argmin(axis=1)
        least = d[np.arange(len(d)), best][:, None]
        apart = self.apart[best]
        beyond = d - least > 2 * radius[:, None] * apart + 1e-9 * (d + least + 1)
        same = (apart == 0) & (np.arange(d.shape[1]) > best[:, None])
        return open_ & ~(beyond | same)

    def nearest(self, points: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each point's nearest candidate, the lowest index on ties; exact."""
        largest = max(int(np.abs(points).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        kind = np.int64 if 4 * largest**2 * points.shape[1] < 2**62 else object
        row, entry = np.nonzero(open_)
        away = points.astype(kind)[row] - self.entries.astype(kind)[entry]
        d = (away * away).sum(axis=1)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(d, first)
        hit = np.flatnonzero(d == np.repeat(least, np.diff(first, append=len(d))))
        best = hit[np.unique(row[hit], return_index=True)[1]]
        return entry[best], least


def descend(tree: Tree, book: Codebook) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Hand the entries down: ("owned", balls, entry of each), then ("open", leaves, candidates) per level."""
    balls = np.array([tree.root])
    open_ = np.ones((1, len(book.entries)), bool)
    while len(balls):
        open_ = book.shrink(tree.centre[balls], tree.radius[balls], open_)
        owned = open_.sum(axis=1) == 1
        yield "owned", balls[owned], open_[owned].argmax(axis=1)
        leaf = tree.children[balls, 0] < 0
        yield "open", balls[leaf & ~owned], open_[leaf & ~owned]
        inner = ~leaf & ~owned
        below, inherited = tree.children[balls[inner]], open_[inner]
        balls = np.concatenate([below[:, 0], below[below[:, 1] >= 0, 1]])
        open_ = np.concatenate([inherited, inherited[below[:, 1] >= 0]])


def _points_of(tree: Tree, balls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the leaves' points and which leaf each belongs to."""
    runs = tree.runs[balls]
    sizes = runs[:, 1] - runs[:, 0]
    which = np.repeat(np.arange(len(balls)), sizes)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + runs[which, 0], which


def entry_sums(tree: Tree, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of the points nearest to each entry."""
    sums, counts = np.zeros(book.entries.shape, np.int64), np.zeros(len(book.entries), np.int64)
    for kind, balls, found in descend(tree, book):
        if kind == "owned":
            np.add.at(sums, found, tree.sums[balls].astype(np.int64))
            np.add.at(counts, found, tree.counts[balls])
        elif len(balls):
            at, which = _points_of(tree, balls)
            entry, _ = book.nearest(tree.points[at], found[which])
            np.add.at(sums, entry, tree.points[at].astype(np.int64))
            np.add.at(counts, entry, 1)
    return sums, counts


def entry_labels(tree: Tree, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of every point, in the order in which the points came."""
    labels, errors = np.zeros(len(tree.points), np.int64), np.zeros(len(tree.points), np.int64)
    for kind, balls, found in descend(tree, book):
        if kind == "owned":
            # An owned ball passes its entry on to the leaves below it.
            entry = found
            while len(balls):
                leaf = tree.children[balls, 0] < 0
                at, which = _points_of(tree, balls[leaf])
                labels[tree.order[at]] = entry[leaf][which]
                away = tree.points[at].astype(np.int64) - book.entries[entry[leaf][which]]
                errors[tree.order[at]] = (away * away).sum(axis=1)
                below, entry = tree.children[balls[~leaf]], entry[~leaf]
                balls = np.concatenate([below[:, 0], below[below[:, 1] >= 0, 1]])
                entry = np.concatenate([entry, entry[below[:, 1] >= 0]])
        elif len(balls):
            at, which = _points_of(tree, balls)
            labels[tree.order[at]], errors[tree.order[at]] = book.nearest(tree.points[at], found[which])
    return labels, errors


def _forest(vectors: DataFrame, dimension: int, how: ProductCodes) -> DataFrame:
    """One row per block of vectors: their ids, labels and one tree per part position."""
    kinds = [vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def block(table: pa.Table) -> pa.RecordBatch:
            x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            cut = x.reshape(-1, how.parts, dimension // how.parts)
            # Plain arrays: executors need no copy of this module to read them.
            trees = pickle.dumps([vars(build_tree(cut[:, p], how)) for p in range(how.parts)], protocol=5)
            ids, labels = (pa.ListArray.from_arrays([0, len(table)], table.column(c).combine_chunks())
                           for c in ("vec_id", "label"))
            return pa.RecordBatch.from_arrays([ids, labels, pa.array([trees], pa.binary())], ["ids", "labels", "trees"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= how.block:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, how.block))
                held, rows = table.slice(how.block).to_batches(), rows - how.block
        if rows:
            yield block(pa.Table.from_batches(held))

    return vectors.select("vec_id", "label", "x").mapInArrow(
        grow, f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, trees binary")


def _trees(batch: pa.RecordBatch) -> Iterator[tuple[int, list[Tree]]]:
    for at, raw in enumerate(batch.column("trees")):
        yield at, [Tree.of(fields) for fields in pickle.loads(raw.as_buffer())]


def _round(forest: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one Lloyd round; parts x entries rows reach the driver."""
    width = books[0].shape[1]
    names = [f"s{i}" for i in range(width)]

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Codebook(b) for b in books]
        sums = np.zeros((len(books), *books[0].shape), np.int64)
        counts = np.zeros(sums.shape[:2], np.int64)
        for batch in batches:
            for _, trees in _trees(batch):
                for part, tree in enumerate(trees):
                    added, number = entry_sums(tree, ready[part])
                    sums[part] += added
                    counts[part] += number
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(counts[part, entry]),
             *[pa.array(sums[part, entry, i]) for i in range(width)]], ["part", "entry", "n", *names])

    shares = forest.select("trees").mapInArrow(
        share, ", ".join(["part long, entry long, n long", *[f"{c} long" for c in names]]))
    out = [b.copy() for b in books]
    for row in shares.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect():
        out[row["part"]][row["entry"]] = [row[c] // row["n"] for c in names]
    return out


def train_codebooks(vectors: DataFrame, forest: DataFrame, how: ProductCodes) -> list[np.ndarray]:
    """One codebook (entries x width) per part position.

    They start from the vectors with the smallest vec_ids, nulls last, ties by content; fewer vectors
    than entries give as many entries.
    """
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(how.entries).select("x").collect()
    start = np.array([row["x"] for row in first], np.int64).reshape(len(first), how.parts, -1)
    books = [np.ascontiguousarray(start[:, p]) for p in range(how.parts)]
    for _ in range(how.rounds):
        books = _round(forest, books)
    return books


def encode(forest: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code and error of every vector of the forest."""
    kinds = [forest.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")]

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Codebook(b) for b in books]
        for batch in batches:
            for at, trees in _trees(batch):
                found = [entry_labels(tree, book) for tree, book in zip(trees, ready, strict=True)]
                text = np.stack([labels for labels, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                step = 2 * len(books)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[at].values, batch.column("labels")[at].values,
                     pa.array([text[i:i + step] for i in range(0, len(text), step)]),
                     pa.array(sum(errors for _, errors in found))], ["vec_id", "label", "code", "error"])

    return forest.mapInArrow(codes, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long")


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def product_codes(embeddings: DataFrame, how: ProductCodes = ProductCodes()) -> DataFrame:
    """`embeddings` (vec_id, embedding, label) compressed: vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null, empty, hold null or non-finite entries or have another length than most
    go. Null vec_ids stay; repeated rows are rows of their own; null labels form one group. An empty
    table gives an empty one. Other columns are not read. Codes need at most 256 entries, and the
    dimension must be a multiple of `parts`. A hot label's total is broadcast, not shuffled to its rows.
    """
    if how.entries > 256:
        raise ValueError("codes of two hex digits name at most 256 entries")
    vectors, dimension = integer_vectors(embeddings, "embedding", how.scale, "vec_id", "label")
    if dimension % how.parts:
        raise ValueError(f"{dimension} dimensions do not make {how.parts} equal parts")
    vectors = vectors.where(F.size("x") > 0)
    forest = staged(_forest(vectors, dimension, how))
    books = train_codebooks(vectors, forest, how) if dimension else []
    coded = staged(encode(forest, books))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return attached(coded, staged(totals), ["label"], "n").select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
