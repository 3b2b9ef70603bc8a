"""Token counts of whole texts; huge texts by overlapping chunks that are spliced exactly.

A chunk and its successor share an overlap. The two encodings are spliced at a character where
both start a token and which follows a plain blank: the vocabulary drops blanks and cuts at
them, so what stands left of such a place cannot change the tokens right of it, and the reverse.
Where an overlap holds no such place it is widened until it does, at worst to the text's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from listwright.llm.shared import whole_text, worker_cache
from listwright.llm.tokens import WordCounter

#: Texts of more characters are encoded in chunks.
HUGE_CHARS = 32_768
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
LIMIT = 2048

_BLANK = frozenset(" \n")


def _starts(tokenizer, text: str, begin: int, end: int) -> list[int]:
    """Where the chunk's tokens start, in characters of the whole text."""
    coded = tokenizer.encode(text[begin:end], add_special_tokens=False)
    return [begin + offset[0] for offset in coded.offsets]


def splice_point(text: str, left: list[int], right: list[int], begin: int) -> int | None:
    """The last place behind `begin` where both start a token right after a blank."""
    common = set(left).intersection(right)
    return max((p for p in common if p > begin and text[p - 1] in _BLANK), default=None)


def count_spliced(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of a text of any length, holding one chunk's encoding at a time."""
    total, begin, end = 0, 0, min(len(text), chunk)
    left = _starts(tokenizer, text, begin, end)
    begin = 0  # tokens before this place are counted
    while end < len(text):
        width = overlap
        while True:
            back = max(begin, end - width)
            ahead = min(len(text), end + chunk)
            right = _starts(tokenizer, text, back, ahead)
            at = splice_point(text, [p for p in left if p >= begin], right, back)
            if at is not None:
                break
            if back == begin:
                # No common place in all that is open: encode more of the text at once.
                if ahead == len(text):
                    return total + len(_starts(tokenizer, text, begin, len(text)))
                chunk *= 2
            width *= 2
        total += sum(begin <= p < at for p in left)
        left, begin, end = right, at, ahead
    return total + sum(p >= begin for p in left)


def token_counts(docs: DataFrame, limit: int = LIMIT, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts are the library's without added special tokens. A null text counts as empty, a null
    doc_id stays null, repeated rows are counted each, an empty table gives an empty one; other
    columns of `docs` are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_cache(f"counter_{vocabulary}", lambda: WordCounter(vocabulary))
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                n_bytes.append(len(text.encode()))
                n_tokens.append(count_spliced(counter.tokenizer, text)
                                if len(text) > HUGE_CHARS else counter(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                 pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
