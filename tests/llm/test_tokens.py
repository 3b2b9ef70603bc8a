import random

import numpy as np
import pytest

from listwright.llm.token_counts import count_spliced, token_counts
from listwright.llm.tokens import IdEncoder, WordCounter, load

PARTS = ["a", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "İ", "Σ", "ß", "'s", "'", "12", "µ",
         "<|startoftext|>", "<|endoftext|>", "😀", "한", "​", " ", "　", "!?", "_", "x" * 70, "\r\n", "́"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(15))) for _ in range(600)]


def test_ids_equal_the_library(texts, given):
    encode, library = IdEncoder(), load("byte_bpe_50k.json")
    for text in [*texts, *(r["text"] for r in given("documents").limit(60).collect())]:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_word_counts_equal_the_library(texts):
    count, library = WordCounter(), load("word_bpe_49k.json")
    for text in texts:
        assert count(text) == len(library.encode(text, add_special_tokens=False)), text


def test_splicing_equals_whole_encoding(texts):
    library = load("word_bpe_49k.json")
    for text in texts[:200]:
        assert count_spliced(library, text * 3, 7, 2) == len(library.encode(text * 3, add_special_tokens=False))


def test_splicing_widens_where_nothing_aligns():
    library = load("word_bpe_49k.json")
    text = "x" * 40_000 + " end " + "y1" * 20_000
    assert count_spliced(library, text) == len(library.encode(text, add_special_tokens=False))


def test_counts_of_documents(odd, given, clashing):
    library = load("word_bpe_49k.json")
    docs = odd.unionByName(given("documents").select("doc_id", "text"))
    want = sorted(((r["doc_id"] or -1), len((r["text"] or "").encode()), n, n > 2048) for r in docs.collect()
                  for n in [len(library.encode(r["text"] or "", add_special_tokens=False))])
    assert sorted((r[0] or -1, *r[1:]) for r in token_counts(docs).collect()) == want
    assert token_counts(odd.limit(0)).count() == 0
    assert token_counts(clashing).count() == 2
