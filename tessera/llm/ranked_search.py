"""Ranked lexical search: NRA over impact-sorted lists.

Every item of a query table ranks all documents by an integer BM25 score. Plan:

* queries: the distinct texts of the items, in blocks of bounded bytes (the sizes are
  counted); a block's terms go to the tasks.
* index, one scan of the documents a block: tasks write per document its length and the
  block's terms in it with their frequencies, as a table in the shared folder. Document
  frequencies, the number of documents and of terms are aggregates over it.
* search, one scan of the index: a task cuts its rows into shards of some thousand
  documents and turns each into lists of postings by descending impact. For a query, NRA
  reads its lists from the top, the same depth in all, doubling, and never looks a document
  up. What was read bounds a document's score from below; with the impact at which each list
  stands, for every list the document has not been seen in, from above. Reading goes on
  until no document that can be among the best has an open interval: then membership, ties
  and scores are settled. The k-th best score that the task has found so far prunes its next
  shards.
* the tasks' best are merged by window functions in two levels.

No document leaves its task but as one of the best, whatever share of them holds a term.
Terms are compared by 64-bit hashes; all arithmetic after a term's weight is in integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textops as X
from tessera.llm.tables import arrow_type_of, type_of, written

#: bytes of query texts that one scan of the documents serves (a longer text is a block of its own)
BLOCK_BYTES = 1 << 20
#: most documents of a shard, and most cells of its table of lists by documents
SHARD_DOCS = 8192
SHARD_CELLS = 1 << 23
#: postings of each list that the first round reads
FIRST_READ = 64
#: parts that a query's candidates are first merged in
MERGE_PARTS = 32

#: bytes at which terms end: ASCII but for digits and letters
TERM_END = np.zeros(256, bool)
TERM_END[:128] = True
TERM_END[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every term, A-Z in lower case."""
    starts, ends, row = X.words(data, offsets, TERM_END)
    return X.span_hashes(X.LOWER[data], starts, ends), row


def distinct_pairs(row: np.ndarray, value: np.ndarray, width: int):
    """Distinct (row, value) with counts, by row and value; values are below ``width``."""
    key, count = np.unique(row * width + value, return_counts=True)
    return key // width, key % width, count


@dataclass
class Queries:
    """Terms (sorted hashes) of a block of queries, and each query's terms with their repeats."""
    keys: list[str]
    hashes: np.ndarray
    bounds: np.ndarray     # query i has terms[bounds[i]:bounds[i + 1]]
    terms: np.ndarray
    repeats: np.ndarray

    @staticmethod
    def of(rows: list[tuple[str, str]]) -> Queries:
        data, offsets = X.buffers(pa.array([t for _, t in rows], pa.string()))
        h, row = term_hashes(data, offsets)
        hashes, term = np.unique(h, return_inverse=True)
        row, terms, repeats = distinct_pairs(row, term, max(1, len(hashes)))
        return Queries([k for k, _ in rows], hashes, np.searchsorted(row, np.arange(len(rows) + 1)), terms, repeats)


def _index_fn(hashes: np.ndarray):
    """mapInArrow body: ``doc_id, n, terms, tfs`` of every document with a term."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in X.pieces(batches):
            for a, b, data, offsets in X.text_slices(batch):
                h, row = term_hashes(data, offsets)
                n = np.bincount(row, minlength=b - a)
                at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
                hit = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
                r, t, tf = distinct_pairs(row[hit], at[hit], max(1, len(hashes)))
                some = np.flatnonzero(n)
                ends = pa.array(np.searchsorted(r, np.r_[some, b - a]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(some)), pa.array(n[some]),
                     pa.ListArray.from_arrays(ends, pa.array(t, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))],
                    ["doc_id", "n", "terms", "tfs"])
    return run


def nra(first: np.ndarray, count: np.ndarray, repeats: np.ndarray, docs: np.ndarray, impacts: np.ndarray,
        n: int, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` of documents ``0..n-1`` with their scores, equal scores by number.

    List ``i`` is ``docs[first[i]:first[i] + count[i]]`` with ``impacts`` in descending
    order, times ``repeats[i]``. Documents below the score ``floor``, or without a positive one,
    are left out.
    """
    lower = np.zeros(n, np.int64)
    seen = np.zeros((len(first), n), bool)
    depth, step = 0, FIRST_READ
    while True:
        size = np.clip(count - depth, 0, step)
        which = np.repeat(np.arange(len(first)), size)
        at = np.arange(len(which)) + np.repeat(first + depth - (np.cumsum(size) - size), size)
        np.add.at(lower, docs[at], impacts[at] * repeats[which])
        seen[which, docs[at]] = True
        depth, step = depth + step, step * 2
        open_ = np.flatnonzero(count > depth)
        heads = impacts[first[open_] + depth] * repeats[open_]
        upper = lower + heads.sum()
        for a in range(0, len(open_), 64):
            upper -= heads[a:a + 64] @ seen[open_[a:a + 64]]
        least = max(floor, 1, int(np.partition(lower, n - k)[n - k]) if n > k else 1)
        if not np.any((upper >= least) & (upper > lower)):
            best = np.flatnonzero(lower >= least)
            best = best[np.argsort(-lower[best], kind="stable")][:k]
            return best, lower[best]


class Shards:
    """Collects index rows and searches them shard by shard; keeps the best of all so far."""

    def __init__(self, queries: Queries, weights: np.ndarray, n: int, total: int, k: int):
        self.q, self.w, self.n, self.total, self.k = queries, weights, n, total, k
        most = int(np.diff(queries.bounds).max(initial=1))
        self.docs = max(64, min(SHARD_DOCS, SHARD_CELLS // max(1, most)))
        self.best: list[list] = [[] for _ in queries.keys]
        self.held: list[pa.RecordBatch] = []
        self.rows = 0

    def add(self, batch: pa.RecordBatch) -> None:
        while batch.num_rows:
            part = batch.slice(0, self.docs - self.rows)
            self.held.append(part)
            self.rows += part.num_rows
            batch = batch.slice(part.num_rows)
            if self.rows >= self.docs:
                self.search()

    def search(self) -> None:
        if not self.rows:
            return
        t = pa.Table.from_batches(self.held).combine_chunks()
        self.held, self.rows = [], 0
        t = t.take(pc.sort_indices(t.column("doc_id")))   # so that equal scores go by number; nulls last
        ids, terms = t.column("doc_id").to_pylist(), t.column("terms").combine_chunks()
        row = np.repeat(np.arange(len(ids)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        term = terms.flatten().to_numpy(zero_copy_only=False)
        tf = t.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        m = 100 - 25 + 25 * t.column("n").to_numpy() * self.n // self.total
        impact = self.w[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[row]))
        some = np.flatnonzero(impact > 0)
        some = some[np.lexsort((row[some], -impact[some], term[some]))]
        row, impact, term = row[some], impact[some], term[some]
        start = np.searchsorted(term, np.arange(len(self.w) + 1))
        for i, best in enumerate(self.best):
            a, b = self.q.bounds[i:i + 2]
            wanted = self.q.terms[a:b]
            first, count = start[wanted], start[wanted + 1] - start[wanted]
            use = count > 0
            if not use.any():
                continue
            floor = -best[-1][0] if len(best) == self.k else 0
            found, score = nra(first[use], count[use], self.q.repeats[a:b][use], row, impact, len(ids), self.k, floor)
            best.extend((-int(s), ids[d] is None, ids[d]) for d, s in zip(found, score))
            best.sort(key=lambda x: x if x[2] is not None else x[:2])
            del best[self.k:]


def _search_fn(queries: Queries, weights: np.ndarray, n: int, total: int, k: int, id_type: pa.DataType):
    def run(batches) -> Iterator[pa.RecordBatch]:
        shards = Shards(queries, weights, n, total, k)
        for batch in batches:
            shards.add(batch)
        shards.search()
        rows = [(key, x[2], -x[0]) for key, best in zip(queries.keys, shards.best) for x in best]
        key, doc, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(doc, id_type), pa.array(score, pa.int64())],
                                         ["_query", "doc_id", "score"])
    return run


def query_blocks(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[int]]:
    """``texts(_query, text)`` with a ``_block`` each, of at most ``block_bytes`` in sum unless one
    text alone is longer; and the blocks there are."""
    size = F.octet_length("text")
    whole = texts.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-whole // block_bytes))
    while True:
        dealt = texts.withColumn("_block", F.pmod(F.xxhash64("_query"), F.lit(blocks)).cast("int"))
        found = dealt.groupBy("_block").agg(F.sum(size).alias("size"), F.max(size).alias("longest"))
        full = found.where((F.col("size") > block_bytes) & (F.col("size") > F.col("longest"))).count()
        if not full or blocks > 64 * whole:
            return dealt, [r[0] for r in found.select("_block").sort("_block").collect()]
        blocks *= 2


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank INT, doc_id, score BIGINT``: the ``k`` best of ``docs(doc_id, text, ...)`` for
    each row of ``items(item_id, text, ...)``, ranks from 1, equal scores by ascending ``doc_id``.

    Null texts hold no term; an item without terms, or whose terms no document holds, has no
    rows. Only scores above 0 count. Repeated rows of ``docs`` are documents of their own, so
    that one ``doc_id`` may hold several ranks; repeated items get the same rows once each.
    Null ids of documents come last among equals. Other columns are ignored.
    """
    spark = docs.sparkSession
    doc_type, doc_arrow = type_of(docs, "doc_id"), arrow_type_of(docs, "doc_id")
    asked = items.select("item_id", "text").where("text IS NOT NULL").withColumn("_query", F.sha2("text", 256))
    texts, blocks = query_blocks(written(asked.select("_query", "text").distinct(), "queries"), block_bytes)
    found = None
    for block in blocks:
        rows = texts.where(F.col("_block") == block).select("_query", "text").collect()   # block_bytes or one text
        queries = Queries.of([(r[0], r[1]) for r in rows])
        index = written(docs.select("doc_id", "text").mapInArrow(
            _index_fn(queries.hashes), f"doc_id {doc_type}, n BIGINT, terms ARRAY<INT>, tfs ARRAY<BIGINT>"), "index")
        n, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(queries.hashes), np.int64)
        for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():   # the block's terms
            df[r[0]] = r[1]
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        part = index.where(F.size("terms") > 0).mapInArrow(
            _search_fn(queries, weights, n, total, k, doc_arrow), f"_query STRING, doc_id {doc_type}, score BIGINT")
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], f"_query STRING, doc_id {doc_type}, score BIGINT")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    found = found.withColumn("_part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGE_PARTS)))
    for keys in (["_query", "_part"], ["_query"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return asked.select("item_id", "_query").join(found, "_query").select("item_id", "rank", "doc_id", "score")
