"""Normalised indel similarity: 100 * 2 * LCS / (len a + len b), case-sensitive."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType

_BITS = 64
_CHUNK = 10_000
#: Bytes that the tables of a chunk may take, and what they take per character of its longest text.
_CHUNK_BYTES = 64 << 20
_BYTES_PER_CHAR = 48
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def lcs_lengths(left: pd.Series, right: pd.Series) -> pd.Series:
    """LCS length per pair, bit-parallel (Hyyro 2004) with all pairs of a chunk in step."""
    ids, texts = pd.factorize(pd.concat([left, right], ignore_index=True))
    texts = texts.tolist()
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    one, two = ids[:len(left)], ids[len(left):]
    longer = lengths[one] > lengths[two]
    short, long = np.where(longer, two, one), np.where(longer, one, two)
    pairs, back = np.unique(short * len(texts) + long, return_inverse=True)
    short, long = np.divmod(pairs, max(len(texts), 1))
    out = np.zeros(len(pairs), dtype=np.int64)
    order = np.argsort(lengths[long], kind="stable")
    at = 0
    while at < len(order):
        # Pairs come by length, so a chunk's tables are as wide as its last pair: fewer pairs where that is long.
        many = min(_CHUNK, len(order) - at)
        while many > 1 and many * int(lengths[long[order[at + many - 1]]]) * _BYTES_PER_CHAR > _CHUNK_BYTES:
            many = (many + 1) // 2
        part = order[at:at + many]
        out[part] = _lcs_chunk(texts, lengths, short[part], long[part])
        at += many
    return pd.Series(out[back])


def _lcs_chunk(texts, lengths, short, long) -> np.ndarray:
    rows, (short, long) = _renumber(short, long)
    sizes = lengths[rows]
    flat = np.frombuffer("".join(texts[r] for r in rows).encode("utf-32-le"), dtype=np.uint32)
    alphabet, letters = np.unique(flat, return_inverse=True)
    width = int(sizes.max(initial=0))
    inside = np.arange(width) < sizes[:, None]
    chars = np.full((len(rows), width), len(alphabet), dtype=np.int64)
    chars[inside] = letters
    masked, place = np.unique(short, return_inverse=True)
    words = int(sizes[masked].max(initial=0)) // _BITS + 1
    masks = np.zeros((len(masked), words, len(alphabet) + 1), dtype=np.uint64)
    row, at = np.nonzero(inside[masked])
    np.bitwise_or.at(masks, (row, at // _BITS, chars[masked][row, at]),
                     np.uint64(1) << (at % _BITS).astype(np.uint64))
    state = np.full((words, len(short)), _ONES, dtype=np.uint64)
    tables = [np.ascontiguousarray(masks[:, w]).ravel() for w in range(words)]
    cells = (place * (len(alphabet) + 1))[:, None] + chars[long]
    cells = np.ascontiguousarray(cells[:, :int(sizes[long].max(initial=0))].T)
    for cell in cells:
        carry = None
        for w, table in enumerate(tables):
            v = state[w]
            u = v & table.take(cell)
            total = v + u
            if words > 1:
                over = total < v
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over
            state[w] = total | (v - u)
    return (_BITS * words - np.bitwise_count(state).sum(axis=0)).astype(np.int64)


def _renumber(*columns):
    rows, back = np.unique(np.concatenate(columns), return_inverse=True)
    return rows, np.split(back, len(columns))


@F.pandas_udf(LongType())
def lcs_length(left: pd.Series, right: pd.Series) -> pd.Series:
    return lcs_lengths(left, right)


def indel_ratio(a: Column, b: Column) -> Column:
    """0..100; two empty texts are fully alike."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(lcs_length(a, b) * 200 / total)


def at_least(a: Column, b: Column, ratio: int) -> Column:
    """Exact integer form of `indel_ratio(a, b) >= ratio`."""
    return lcs_length(a, b) * 200 >= (F.length(a) + F.length(b)) * ratio
