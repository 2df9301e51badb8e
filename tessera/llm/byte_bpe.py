"""Byte-level BPE encoding and decoding: a hierarchical-bitmap rank queue.

A text is cut into pre-tokens by a pattern. A pre-token starts as its bytes in a linked
list. Every adjacent pair that the vocabulary can merge waits in the bucket of its merge
rank, as the position where it starts. Bitmaps over the ranks, 64 to a word, with a bitmap
over their words above, and so on, tell the lowest rank with a bucket by find-first-set on
one word a level; in a bucket the leftmost position goes first. A position whose pair has
another rank by now is stale and skipped. Every merge costs a few word operations whatever
the length of the pre-token, so one of a million bytes takes n log n steps, not n * n. What is
left in the list are the tokens.

Pre-tokens do not touch each other, so all new ones of a batch of texts lie in one linked list
and share one queue: a rank is looked for once for all of them. Only a merge that makes a
pair of lower rank than its own asks for the queue's order at once: such a pre-token is taken
out and merged alone, as are long ones.

Pre-tokens repeat, so short ones and their runs of white space and text are remembered per
Python worker, in dictionaries of bounded size that only save time.

The rank file (a line a token: base64 bytes, rank) is a parameter and is read on the
executors.
"""

from __future__ import annotations

import base64
import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm import textops as X
from tessera.llm.tables import type_of

#: longest run of white space and text that is remembered, and so many of each kind
MEMO_CHARS, MEMO = 48, 300_000
#: bytes of a pre-token that is merged alone
ALONE_BYTES = 512

# White space of the pattern's \s (Unicode White_Space).
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Letters, then numbers, that came to Unicode after version 16, which the
# vocabulary's library goes by; to it they are neither.
LATER_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E "
    "2CEA2-2CEAD 323B0-33479 3D000-3FC3F")
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


def _set_of(ranges: str) -> str:
    return "[" + "".join("-".join(f"\\U{int(end, 16):08X}" for end in r.split("-")) for r in ranges.split()) + "]"


def pre_tokens(pattern: str) -> regex.Pattern:
    """``pattern`` with letters and numbers as of Unicode 16."""
    pattern = pattern.replace(r"\p{L}", rf"[\p{{L}}--{_set_of(LATER_LETTERS)}]")
    return regex.compile(pattern.replace(r"\p{N}", rf"[\p{{N}}--{_set_of(LATER_NUMBERS)}]"), regex.V1)


class RankQueue:
    """Buckets of positions by rank; the lowest rank that has one is found by find-first-set."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.levels: list[list[int]] = []
        while not self.levels or len(self.levels[-1]) > 1:
            ranks = -(-ranks // 64) or 1
            self.levels.append([0] * ranks)

    def bucket(self, rank: int) -> list[int]:
        """The rank's bucket, made if there is none."""
        found = self.buckets.get(rank)
        if found is None:
            found = self.buckets[rank] = []
            for level in self.levels:
                at, bit = rank >> 6, 1 << (rank & 63)
                before = level[at]
                level[at] = before | bit
                if before:
                    break
                rank = at
        return found

    def lowest(self) -> tuple[int, list[int]] | None:
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            if not word:
                return None
            rank = rank << 6 | (word & -word).bit_length() - 1
        return rank, self.buckets[rank]

    def drop(self, rank: int) -> None:
        del self.buckets[rank]
        for level in self.levels:
            bit = 1 << (rank & 63)
            rank >>= 6
            level[rank] ^= bit
            if level[rank]:
                break


class Remembered(dict):
    """A dictionary of bounded size between batches: its older half is kept aside, and what is still asked for returns."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def lacks(self, keys) -> list:
        out = []
        for k in keys:
            if k not in self:
                value = self.old.get(k)
                if value is None:
                    out.append(k)
                else:
                    self[k] = value
        return out

    def trim(self, long: list) -> None:
        for k in long:
            del self[k]
        if len(self) > MEMO:
            self.old = dict(self)
            self.clear()


class ByteBpe:
    """Encodes and decodes under the rank file at ``path``, with pre-tokens by ``pattern``."""

    def __init__(self, path: str, pattern: str):
        self.rank: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.rank[base64.b64decode(token)] = int(rank)
        if not all(bytes([b]) in self.rank for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.bytes_of = {r: t for t, r in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.queue = RankQueue(max(self.bytes_of) + 1)
        self.single = np.array([self.rank[bytes([b])] for b in range(256)])
        self.double = np.array([self.rank.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        self.pattern = pre_tokens(pattern)
        # of ASCII text the same, in small sets
        self.plain = regex.compile(pattern.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"), regex.V1 | regex.ASCII)
        # a pre-token never goes on from text into white space, so these runs are cut on their own
        self.runs = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
        self.by_piece, self.by_run = Remembered(), Remembered()

    def merge(self, pieces: list[bytes], alone: bool = False) -> list[bytes]:
        """Packed ids of pre-tokens; ``alone`` for a single one, in the queue's strict order."""
        data, queue, rank, longest = b"".join(pieces), self.queue, self.rank.get, self.longest
        n = len(data)
        stops = np.cumsum([len(p) for p in pieces])
        starts = [0, *stops[:-1].tolist()]
        edge = bytearray(n + 1)                            # where pre-tokens begin and end
        for s in starts:
            edge[s] = 1
        edge[n] = 1
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        first = np.r_[self.double[raw[:-1] << 8 | raw[1:]], -1]
        first[stops - 1] = -1
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0):]
        for group in np.split(order, np.flatnonzero(np.diff(first[order])) + 1) if len(order) else ():
            queue.bucket(int(first[group[0]])).extend(group.tolist())
        after, before = list(range(1, n + 2)), list(range(-1, n))   # linked list of the tokens' starts
        pair, token = first.tolist(), self.single[raw].tolist()      # rank of the pair that starts here; id of the token
        out_of_turn = set()
        buckets, made, push = queue.buckets.get, queue.bucket, heapq.heappush if alone else list.append
        while (found := queue.lowest()) is not None:
            r, bucket = found
            if not alone:
                queue.drop(r)
                bucket.sort()
            turn = iter(bucket) if not alone else iter(lambda: heapq.heappop(bucket) if bucket else None, None)
            for i in turn:
                if pair[i] != r:
                    continue  # stale: one of the two has been merged meanwhile
                middle = after[i]
                end = after[i] = after[middle]
                pair[i] = pair[middle] = token[middle] = -1
                token[i] = r
                least = r
                if not edge[end]:
                    before[end] = i
                    if (stop := after[end]) - i <= longest and (q := rank(data[i:stop])) is not None:
                        pair[i] = q
                        push(buckets(q) or made(q), i)
                        least = q
                if not edge[i]:
                    h = before[i]
                    if end - h <= longest and (q := rank(data[h:end])) is not None:
                        pair[h] = q
                        push(buckets(q) or made(q), h)
                        if q < least:
                            least = q
                    else:
                        pair[h] = -1
                if least < r:
                    if alone:
                        break  # the queue's new lowest rank comes first; the bucket keeps the rest
                    which = bisect_right(starts, i) - 1
                    out_of_turn.add(which)
                    for x in range(starts[which], int(stops[which])):
                        pair[x] = -1
            if alone and not bucket:
                queue.drop(r)
        ids = np.array(token, np.int64)
        kept = ids >= 0
        packed = ids[kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept)[stops - 1]).tolist()
        out = [packed[a:b] for a, b in zip([0, *ends], ends)]
        for which in out_of_turn:
            out[which] = self.merge([pieces[which]], alone=True)[0]
        return out

    def merged(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of pre-tokens."""
        raw = [p.encode("utf-8") for p in pieces]
        out: list = [None] * len(raw)
        shared = []
        for i, p in enumerate(raw):
            whole = self.rank.get(p)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > ALONE_BYTES:
                out[i] = self.merge([p], alone=True)[0]
            else:
                shared.append(i)
        if shared:
            for i, ids in zip(shared, self.merge([raw[i] for i in shared])):
                out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        cut = [self.runs.findall(t) for t in texts]
        new = self.by_run.lacks({r for runs in cut for r in runs})
        plain, pattern = self.plain.findall, self.pattern.findall
        pieces = [plain(r) if r.isascii() else pattern(r) for r in new]
        fresh = self.by_piece.lacks({p for ps in pieces for p in ps})
        self.by_piece.update(zip(fresh, self.merged(fresh)))
        self.by_run.update((r, b"".join([self.by_piece[p] for p in ps])) for r, ps in zip(new, pieces))
        out = [b"".join([self.by_run[r] for r in runs]) for runs in cut]
        self.by_run.trim([r for r in new if len(r) > MEMO_CHARS])
        self.by_piece.trim([p for p in fresh if len(p) > MEMO_CHARS])
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids packed as ``encode`` packs them; ids outside the vocabulary raise."""
        try:
            return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        except KeyError as e:
            raise ValueError(f"id {e.args[0]} is not in the vocabulary") from None


_KNOWN: dict[tuple[str, str], ByteBpe] = {}


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _KNOWN:
        _KNOWN[path, pattern] = ByteBpe(path, pattern)
    return _KNOWN[path, pattern]


def _encode_fn(path: str, pattern: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path, pattern).encode
        for batch in X.pieces(batches):
            ids = encode([t or "" for t in batch.column("text").to_pylist()])
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
    return run


def _decode_fn(path: str, pattern: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        decode = byte_bpe(path, pattern).decode
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            got = [None if x is None else decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], [*batch.schema.names, "decoded"])
    return run


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens BIGINT, ids BINARY`` of every text of ``docs(doc_id, text, ...)``.

    ``ids`` holds the token ids as little-endian unsigned 32-bit integers
    (``numpy.frombuffer(ids, "<u4")``). Strings of special tokens are ordinary text. A null
    or empty text has no token. One result row per input row, repeated rows and null ids
    included; other columns are ignored."""
    schema = f"doc_id {type_of(docs, 'doc_id')}, n_tokens BIGINT, ids BINARY"
    return docs.select("doc_id", "text").mapInArrow(_encode_fn(ranks, pattern), schema)


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``encoded(doc_id, n_tokens, ids)`` with ``decoded BINARY``, the bytes of the ids; null ids stay null."""
    encoded = encoded.select("doc_id", "n_tokens", "ids")
    schema = f"doc_id {type_of(encoded, 'doc_id')}, n_tokens BIGINT, ids BINARY, decoded BINARY"
    return encoded.mapInArrow(_decode_fn(ranks, pattern), schema)
