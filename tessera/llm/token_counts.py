"""Token counts: heap-and-linked-list byte-pair merging.

The number of tokens of a text under a BPE vocabulary, without building tokens or
ids: a piece of text starts as its byte symbols in a linked list; a heap holds the
adjacent pairs by merge rank, then position; the lowest is merged again and again.
The count is initial symbols minus merges. Pieces repeat, so their counts are
memoised per Python worker, in dictionaries of bounded size that only save time.

The vocabulary file (a ``tokenizers`` JSON of this kind: NFC, white space folded,
lower case, split by a pattern, byte-level symbols, word-end suffix) is a parameter
and is read on the executors.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm import textops as X
from tessera.llm.tables import type_of

#: entries of the younger half of a memo
MEMO = 300_000
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")  # white space to str.split, not to the vocabulary's \s


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 bytes stand
    for themselves, the others are numbered from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Memo(dict):
    """Remembers ``fn``; a full memo becomes the old half, of which what is still used returns."""

    def __init__(self, fn):
        super().__init__()
        self.fn, self.old = fn, {}

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        self[key] = value
        return value


class BpeCounter:
    """Counts tokens under the vocabulary file at ``path``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.symbols = byte_symbols()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.space = regex.compile(r"\p{White_Space}+")
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.first = min((s[:2] for s in specials), default=None)
        self.by_piece = Memo(self.merged)
        self.by_chunk = Memo(lambda chunk: sum(map(self.by_piece.__getitem__, self.pieces.findall(chunk))))

    def merged(self, piece: str) -> int:
        """Initial symbols minus merges of one piece."""
        sym = [self.symbols[b] for b in piece.encode("utf-8")]
        sym[-1] += self.suffix
        n, rank = len(sym), self.rank
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        count = n
        while heap:
            r, i, j = heapq.heappop(heap)
            if sym[i] is None or right[i] != j or sym[j] is None or rank.get((sym[i], sym[j])) != r:
                continue  # one of the two has been merged meanwhile
            sym[i] += sym[j]
            sym[j] = None
            right[i] = k = right[j]
            count -= 1
            if k < n:
                left[k] = i
                if (r := rank.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, k))
            if (h := left[i]) >= 0 and (r := rank.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h, i))
        return count

    def plain(self, text: str) -> int:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        odd = any(c in text for c in _ODD_SPACE)
        return sum(map(self.by_chunk.__getitem__, self.space.split(text) if odd else text.split()))

    def count(self, text: str) -> int:
        """Tokens of a text; a special token's string counts as one."""
        if self.special is None or self.first not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_COUNTERS: dict[str, BpeCounter] = {}


def counter(path: str) -> BpeCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = BpeCounter(path)
    return _COUNTERS[path]


def _count_fn(path: str, limit: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in X.pieces(batches):
            texts = batch.column("text").to_pylist()
            n = np.fromiter((count(t) if t else 0 for t in texts), np.int64, len(texts))
            size = np.fromiter((len(t.encode("utf-8")) if t else 0 for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """UTF-8 bytes and tokens of every text of ``docs(doc_id, text, ...)``, and whether
    the tokens exceed ``limit``. A null or empty text has none. One result row per
    input row, repeated rows and null ids included; other columns are ignored."""
    schema = f"doc_id {type_of(docs, 'doc_id')}, n_bytes BIGINT, n_tokens BIGINT, over_limit BOOLEAN"
    return docs.select("doc_id", "text").mapInArrow(_count_fn(vocabulary, limit), schema)
