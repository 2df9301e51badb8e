import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helpers import ODD, no_docs, odd
from tessera.llm.token_counts import counter, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [*"ab'sΣσςİIıéÉé̀²½٣①Ⅷªʰ中日한ㄱ🙂‍\x1c\x1f\x85\xa0 ​\n\t  .,!?'rellvd<|>_-09AZ&ßẞﬁǅ",
            "<|startoftext|>", "<|endoftext|>", "'s", "'LL", "the", "ing"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_strings_count_as_the_library_counts(library):
    rng = random.Random(3)
    for _ in range(20_000):
        s = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 16)))
        assert counter(PATH).count(s) == len(library.encode(s, add_special_tokens=False)), repr(s)


def test_documents_count_as_the_library_counts(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in token_counts(docs, PATH).collect()}
    rows = docs.select("doc_id", "text").collect()
    want = library.encode_batch([r.text for r in rows], add_special_tokens=False)
    for r, w in zip(rows, want):
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes) == (len(w), len(r.text.encode()))
        assert got[r.doc_id].over_limit == (len(w) > 2048)


def test_odd_rows(spark, library):
    got = sorted((tuple(r) for r in token_counts(odd(spark), PATH).collect()), key=repr)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 2048) for i, t in ODD]
    assert got == sorted(want, key=repr)
    assert token_counts(no_docs(spark), PATH).collect() == []
