"""Spelling variant grouping: a relational trie frontier.

Words one inserted, deleted or replaced code point apart are found by walking all words
through a trie at once, as a join of states (word, position, node, edits) with a table of
edges, level by level. Plan:

* words are counted in tasks; the counted words are a table.
* two tries, of the words and of the reversed words. Of two near words one half is the
  same: the first, or (reversed) the second. So a word starts at the depth of its half, with
  no edit, where nodes are many and have few edges, never at a root that all words share.
* nodes are the prefixes after which words go on differently, or end (a path-compressed
  trie): an edge carries a label of one or more code points, so a level costs one join
  however long the labels are. A node is known by a hash of its prefix, a sum of one hash
  a code point and position, which costs the same for words of any length.
* a word without an edit walks its own path: these states are listed from the nodes on
  it. A join with the edges takes the first edit at an edge with another code point: replace
  (the word's code point is skipped) or insert (it is kept); of each pair one side finds the
  other, so deletions need no state. States with an edit only match, and a state whose
  rest of the label is not what the word goes on with, or whose word ends or goes on as nothing
  below the child does, is dropped within the join.
* states with an edit at a word's end and at the end of another word are pairs; the others go
  to the next level, until none is left.

A node of a third of all words has a third of the states but no more edges than the
alphabet has letters, so the join's state side can be split.

All joins are of tables that grow with the vocabulary, and Spark sizes these by their
compressed files, or by what they were before an explode or a Python step, so each join is
a sort-merge join (``_merged``): none of them passes through the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textops as X
from tessera.llm.tables import written
from tessera.session import checkpoint

#: bytes of a word up to which checksums are computed for all words at once
CRC_BYTES = 64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LEAD = 0xC3       # first UTF-8 byte of U+00C0 to U+00FF, and of nothing else


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1)).astype(np.uint32)
    return t


CRC_TABLE = _crc_table()


def letter_runs(data: np.ndarray, offsets: np.ndarray):
    """Start, end and row of every maximal run of A-Z, a-z and U+00C0 to U+00FF."""
    lead = data == _LEAD
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    return X.words(np.where(inside, np.uint8(97), np.uint8(32)), offsets)


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of every span, going on from the crc32 values ``before``."""
    out = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -CRC_BYTES, side="left"))
    todo, at = order[long:], starts[order[long:]]
    left = size[todo]
    for j in range(int(left.max(initial=0))):
        n = int(np.searchsorted(-left, -j, side="left"))   # spans of more than j bytes come first
        c = out[todo[:n]]
        out[todo[:n]] = CRC_TABLE[(c ^ data[at[:n] + j]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes(), int(before[i]))
    return out


def _count_fn(least_chars: int, every: int):
    """mapInArrow body: the words of each slice of texts, with how often they occur in it."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in X.pieces(batches):
            prefix = np.array([zlib.crc32(f"{i or ''}:".encode()) for i in batch.column(0).to_pylist()], np.uint32)
            for a, b, data, offsets in X.text_slices(batch):
                data = X.LOWER[data]
                starts, ends, row = letter_runs(data, offsets)
                chars = X.code_points_before(data)
                length = chars[ends] - chars[starts]
                long = np.flatnonzero(length >= least_chars)
                starts, ends, length = starts[long], ends[long], length[long]
                h = checksums(data, starts, ends, prefix[a:b][row[long]])
                cut = h % np.uint32(every) == 0
                _, first, count = np.unique(X.span_hashes(data, starts, ends)[~cut], return_index=True, return_counts=True)
                raw = data.tobytes()
                whole = np.flatnonzero(~cut)[first]
                found = [raw[s:e].decode() for s, e in zip(starts[whole], ends[whole])]
                for i in np.flatnonzero(cut & (length > least_chars)):
                    word, at = raw[starts[i]:ends[i]].decode(), int(h[i]) % int(length[i])
                    found.append(word[:at] + word[at + 1:])
                n = np.ones(len(found), np.int64)
                n[:len(count)] = count
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(n)], ["word", "n"])
    return run


def word_counts(docs: DataFrame, least_chars: int = 7, least_n: int = 2, every: int = 31) -> DataFrame:
    """``word, n``: words of at least ``least_chars`` code points that occur at least ``least_n``
    times in ``docs(doc_id, text, ...)``.

    A run whose checksum with its document's id is divisible by ``every`` loses one code point
    (a null id reads as empty)."""
    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return (ids.mapInArrow(_count_fn(least_chars, every), "word STRING, n BIGINT")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n))


def _sums(code: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """Running sum of a hash of every code point and its place."""
    return np.r_[np.uint64(0), np.cumsum(X.mix(code.astype(np.uint64) * X._GOLD + X.mix(at.astype(np.uint64) + np.uint64(seed))))]


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all values from ``low`` through ``high`` of each row."""
    size = high - low + 1
    row = np.repeat(np.arange(len(low)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low[row]


def _prefix_fn(batches) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: ``w, back, depth, node, next`` of the prefixes of words and reversed words
    that a near word can share; ``next`` is the code point after it, -1 at the end."""
    for batch in X.pieces(batches, "word", 1 << 18):
        ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        end = np.cumsum(size)
        start = end - size
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        place = np.arange(len(code)) - np.repeat(start, size)
        ahead = _sums(code, place, 1)
        behind = _sums(code, np.repeat(size, size) - 1 - place, 1 << 40)
        for back in (False, True):
            # the words a word can reach are at most one code point longer, so theirs begin one earlier
            row, depth = _spread((size if back else size - 1) // 2, size)
            if back:
                node = behind[end[row]] - behind[end[row] - depth]
                at = end[row] - 1 - depth
            else:
                node = ahead[start[row] + depth] - ahead[start[row]]
                at = start[row] + depth
            last = depth == size[row]
            following = np.where(last, -1, code[np.where(last, 0, at)].astype(np.int64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row]), pa.array(np.full(len(row), back)), pa.array(depth.astype(np.int32)),
                 pa.array(X.mix(node + np.uint64(back)).view(np.int64)), pa.array(following)], ["w", "back", "depth", "node", "next"])


def _merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that is never broadcast, whatever size Spark takes its sides for."""
    return left.join(right.hint("merge"), on, how)


def _paths(vocabulary: DataFrame) -> DataFrame:
    """``word, steps``: every word with its nodes, ``struct(back, depth, node)`` in order."""
    known = vocabulary.select(F.xxhash64("word").alias("w"), "word")
    prefixes = known.mapInArrow(_prefix_fn, "w BIGINT, back BOOLEAN, depth INT, node BIGINT, next INT")
    forks = (prefixes.groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high"))
             .where("low <> high").select("node"))
    inner = _merged(prefixes.where("next >= 0"), forks, "node")
    step = F.struct("back", "depth", "node")
    rows = inner.select("w", step.alias("step")).union(prefixes.where("next < 0").select("w", step.alias("step")))
    steps = rows.groupBy("w").agg(F.sort_array(F.collect_list("step")).alias("steps"))
    return _merged(known, steps, "w").select("word", "steps")


def _trie(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges ``node, first, label, child, target`` (the word that ends at the child), ``letters`` (first ones
    of the child's own edges), and the states
    ``s, back, pos, node, edits`` of words on their own paths from their halves on."""
    s = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    pairs = paths.select("word", F.explode(F.expr("transform(sequence(1, size(steps) - 1), i -> struct(steps[i - 1] AS a, steps[i] AS b))")).alias("p"))
    pairs = pairs.where("p.a.back = p.b.back").select("word", F.col("p.a.back").alias("back"), "p.a", "p.b")
    edges = pairs.select(F.col("a.node").alias("node"), F.substring(s, F.col("a.depth") + 1, F.col("b.depth") - F.col("a.depth")).alias("label"),
                         F.col("b.node").alias("child")).distinct()
    nodes = paths.select("word", F.explode("steps").alias("p")).select("word", "p.*")
    size = F.char_length("word")
    ends = nodes.where(F.col("depth") == size).select(F.col("node").alias("child"), F.col("word").alias("target"))
    half = F.when(F.col("back"), F.ceil(size / 2)).otherwise(F.floor(size / 2))
    states = nodes.where(F.col("depth") >= half).select(s.alias("s"), "back", F.col("depth").alias("pos"), "node", F.lit(0).alias("edits"))
    letters = edges.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set(F.substring("label", 1, 1)), "").alias("letters"))
    edges = _merged(_merged(edges, ends, "child", "left"), letters, "child", "left")
    return edges.select("node", F.substring("label", 1, 1).alias("first"), "label", "child", "target",
                        F.coalesce("letters", F.lit("")).alias("letters")), states


def _level(states: DataFrame, edges: DataFrame, edits: int) -> DataFrame:
    """The states one edge further that have an edit; those at their word's end are at the end of ``target``.

    States with an edit meet the one edge that begins as their words go on, states without one all edges."""
    goes, pos = F.substring("s", F.col("pos") + 1, F.lit(1)), F.col("pos")
    step, first = F.char_length("label"), F.col("first")
    rest = F.substring("label", F.lit(2), step - 1)

    def on(label, at, to):
        """``to``, if ``label`` is what the word has at ``at`` and the child goes on as the word does there, or ends with it."""
        text = F.substring("s", at + 1, F.char_length(label))
        ahead = F.when(to < F.char_length("s"), F.col("letters").contains(F.substring("s", to + 1, F.lit(1)))).otherwise(F.col("target").isNotNull())
        return F.when((text == label) & ahead, to)

    if edits:
        rows = _merged(states.where(F.col("edits") == 1).withColumn("first", goes), edges, ["node", "first"])
        rows = rows.withColumn("pos", on(F.col("label"), pos, pos + step)).where("pos IS NOT NULL")
    else:
        rows = _merged(states.where(F.col("edits") == 0), edges, "node")
        insert = F.when(first != goes, on(rest, pos, pos + step - 1))
        replace = F.when((goes != "") & (first > goes), on(rest, pos + 1, pos + step))
        # most pairs of a state and an edge end here, within the join
        rows = rows.where(insert.isNotNull() | replace.isNotNull()).withColumn("pos", F.explode(F.array_compact(F.array(insert, replace))))
    return rows.select("s", "back", "pos", F.col("child").alias("node"), F.lit(1).alias("edits"), "target")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """``word, near`` of all words of ``vocabulary(word, ...)``, distinct and none null, that differ by exactly one
    inserted, deleted or replaced code point; both orders of each pair. Words of any length above 0."""
    paths = written(_paths(vocabulary), "paths")
    edges, states = _trie(paths)
    edges = written(edges, "edges")
    found = []
    while states is not None:
        level = written(_level(states, edges, len(found)), "level")
        at_end = F.col("pos") == F.char_length("s")
        found.append(level.where(at_end)
                     .select(F.when(F.col("back"), F.reverse("s")).otherwise(F.col("s")).alias("word"), F.col("target").alias("near")))
        states = level.where(~at_end).select("s", "back", "pos", "node", "edits")
        if states.isEmpty():
            states = None
    once = reduce(DataFrame.union, found)
    return once.union(once.select("near", "word")).distinct()


def variants(docs: DataFrame, least_chars: int = 7, least_n: int = 2, every: int = 31, times: int = 10) -> DataFrame:
    """``word, form, root STRING, n, n_near, form_n BIGINT`` for every word of ``docs(doc_id, text, ...)``.

    ``form`` is the near word of largest ``n`` (ties: the smallest) if that is at least
    ``times`` the word's, else null; ``root`` follows forms to the last. Null and empty texts
    hold no words; repeated rows count each; other columns are ignored."""
    words = written(word_counts(docs, least_chars, least_n, every), "words")
    near = _merged(near_pairs(words), words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    rows = _merged(words, best, "word", "left").withColumn("form_n", F.when(-F.col("top.less") >= times * F.col("n"), -F.col("top.less")))
    rows = written(rows.select("word", F.when(F.col("form_n").isNotNull(), F.col("top.near")).alias("form"), "n",
                               F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n"), "forms")
    # every form is ``times`` as frequent as its word, so paths end; each round doubles how far they are followed
    roots = checkpoint(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = checkpoint(_merged(roots, on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if roots.where("moved").isEmpty():
            break
        roots = roots.select("word", "root")
    return (_merged(rows, roots.select("word", "root"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
