import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from helpers import LONG, ODD, no_docs, odd
from tessera.llm import byte_bpe as B
from tessera.llm.byte_bpe import RankQueue, byte_bpe, decode, encode
from tessera.llm.queries import REGISTRY

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PARTS = [*"ab'sΣIıéÉé̀²½٣①Ⅷ中日한🙂‍\x1c\x1f\x85\xa0 ​\n\t  .,!?'rellvd<|>_-09AZ&ßﬁ", " ", "  ", "\n\n", "\r\n", "the", "ing", " the",
         "'s", "'LL", "'ll", "<|endoftext|>", "　", " ", "\U00033000", "꟎", "՘", "\U00012550", "aaaa"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_queue_gives_ranks_in_order():
    rng = random.Random(1)
    for ranks in (1, 64, 65, 5000, 300_000):
        q = RankQueue(ranks)
        for _ in range(3):
            want = sorted((rng.randrange(ranks), rng.randrange(99)) for _ in range(500))
            for r, i in rng.sample(want, len(want)):
                q.bucket(r).append(i)
            got = []
            while (found := q.lowest()) is not None:
                q.drop(found[0])
                got += [(found[0], i) for i in sorted(found[1])]
            assert got == want


def test_every_code_point_as_the_library_has_it(library):
    bpe = byte_bpe(PATH, PATTERN)
    points = [chr(c) for c in [*range(0x40000), *range(0xE0000, 0xE0400)] if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 4096):
        block = points[start:start + 4096]
        for text in ("a ".join(block), "1".join(block)):
            assert ids(bpe.encode([text])[0]) == library.encode_ordinary(text)


def test_random_strings(library):
    rng, bpe = random.Random(4), byte_bpe(PATH, PATTERN)
    for _ in range(20_000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 24)))
        packed = bpe.encode([text])[0]
        assert ids(packed) == library.encode_ordinary(text), repr(text)
        assert bpe.decode(packed) == text.encode()


def test_merges_equal_a_plain_search_for_the_lowest_pair():
    rng, bpe = random.Random(6), byte_bpe(PATH, PATTERN)
    pieces, want = [], []
    for _ in range(1000):
        piece = bytes(rng.choice(b"abeinrst ") for _ in range(rng.randint(1, 60)))
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            low = min(range(len(parts) - 1), key=lambda i: (bpe.rank.get(parts[i] + parts[i + 1], 1 << 40), i))
            if parts[low] + parts[low + 1] not in bpe.rank:
                break
            parts[low:low + 2] = [parts[low] + parts[low + 1]]
        pieces.append(piece)
        want.append([bpe.rank[p] for p in parts])
    assert list(map(ids, bpe.merge(pieces))) == want
    assert [ids(bpe.merge([p], alone=True)[0]) for p in pieces] == want


def test_very_long_pre_tokens(library):
    rng, bpe = random.Random(8), byte_bpe(PATH, PATTERN)
    began = time.time()
    for text in ("a" * 300_000, "".join(rng.choice("abcdefghij") for _ in range(300_000)), " " * 100_000 + "x", "é" * 100_000):
        assert ids(bpe.encode([text])[0]) == library.encode_ordinary(text)
    assert time.time() - began < 60


def test_memo_of_bounded_size_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(B, "MEMO", 40)
    rng, bpe = random.Random(11), B.ByteBpe(PATH, PATTERN)
    for _ in range(200):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 4))]
        assert list(map(ids, bpe.encode(texts))) == list(map(library.encode_ordinary, texts))
    assert len(bpe.by_run) <= 40 and max(map(len, bpe.by_piece), default=0) <= B.MEMO_CHARS


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in REGISTRY["op13_byte_bpe"](spark, "/root/testdata/sf0.01").collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for r in rows:
        want, g = library.encode_ordinary(r.text or ""), got[r.doc_id]
        assert g.n_tokens == len(want)
        assert g.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_odd_rows(spark, library):
    got = decode(encode(odd(spark), PATH, PATTERN), PATH, PATTERN).collect()
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in ODD]
    assert sorted(((r.doc_id, ids(r.ids), bytes(r.decoded)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.n_tokens == len(ids(r.ids)) for r in got)
    assert any(bytes(r.decoded) == LONG.encode() for r in got)
    assert decode(encode(no_docs(spark), PATH, PATTERN), PATH, PATTERN).collect() == []
    null = encode(odd(spark), PATH, PATTERN).withColumn("ids", F.lit(None).cast("binary"))
    assert all(r.decoded is None for r in decode(null, PATH, PATTERN).collect())


def test_ids_outside_the_vocabulary_raise():
    with pytest.raises(ValueError, match="60000"):
        byte_bpe(PATH, PATTERN).decode(np.array([60_000], "<u4").tobytes())
