"""Benchmark decontamination: BM25 over test items with block-max WAND.

Test items are indexed by word; every overlapping passage of every text is a query, and
all items whose BM25 score reaches a threshold are retrieved. Impacts are divided by
the item's score for its own words, so that a score is the share of the item's weight
that the passage holds. Two exact bounds keep the search short: a passage goes to the
index only if, for some item, the words of its essential lists (those without which no
passage reaches the threshold) weigh enough together; in the index, document-at-a-time
search skips by list maxima to a pivot and by block maxima past whole blocks. Retrieved
pairs are verified by the overlap of question and answer with the passage.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textops as X
from tessera.llm.tables import arrow_type_of, type_of

K1, B = 1.2, 0.75
#: share of an item's weight that a passage must hold; weight that lists outside the essential ones may have
LEAST_SCORE, UNESSENTIAL = 0.5, 0.25
#: postings of a block
BLOCK = 16
#: words of a shingle, and shares of question and answer that shingles must cover
SHINGLE, LEAST_QUESTION, LEAST_ANSWER = 5, 0.6, 0.5
#: bytes of item texts that one index holds; more are searched in several passes
INDEX_BYTES = 8 << 20

_KEEP = np.arange(256, dtype=np.uint8)  # ASCII other than letters and digits separates words
_KEEP[[b for b in range(128) if not chr(b).isalnum()]] = 32


def item_words(data: np.ndarray, offsets: np.ndarray):
    """(hash, row) of the words of all rows, which are in lower case."""
    data = _KEEP[data]
    s, e, row = X.words(data, offsets)
    return X.span_hashes(data, s, e), row


def hashes_of(text: str | None) -> np.ndarray:
    return item_words(*X.buffers(pc.utf8_lower(pa.array([text], pa.string()))))[0]


def parts_of(text: str) -> tuple[str, str]:
    """Question and answer of an item: its last line or sentence is the answer; an item of
    one sentence is all question."""
    body = text.strip()
    cut = max(body.rstrip(".!?").rfind(x) for x in ("\n", ". ", "? ", "! "))
    return (body[:cut + 1], body[cut + 1:]) if cut >= 0 else (body, "")


def grams(h: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Hashes of k-word shingles (fewer words: all as one), and their size."""
    k = max(1, min(k, len(h)))
    return (X.ngram_hashes(h, np.zeros(len(h), np.int64), k)[0], k) if len(h) else (h, k)


def covered(part: np.ndarray, passage: np.ndarray, k: int) -> float:
    """Share of a part's words in shingles that the passage has; a part without words is covered."""
    if not len(part):
        return 1.0
    g, k = grams(part, k)
    if len(passage) < k:
        return 0.0
    hit = np.isin(g, X.ngram_hashes(passage, np.zeros(len(passage), np.int64), k)[0])
    inside = np.zeros(len(part), bool)
    for j in range(k):
        inside[np.flatnonzero(hit) + j] = True
    return float(inside.mean())


@dataclass
class Item:
    id: object
    question: np.ndarray
    answer: np.ndarray


@dataclass
class Postings:
    """Items (ascending) and impacts of one word, and the largest impact of each block."""

    items: np.ndarray
    impacts: np.ndarray
    block_max: list[float] = field(default_factory=list)
    most: float = 0.0

    def __post_init__(self):
        self.block_max = [float(self.impacts[i:i + BLOCK].max()) for i in range(0, len(self.items), BLOCK)]
        self.most = max(self.block_max)
        self.items, self.impacts = self.items.tolist(), self.impacts.tolist()


class Index:
    """BM25 index of items with normalised impacts."""

    def __init__(self, items: list[Item], df: dict[int, int], total: int, mean_length: float, longest: int):
        self.items = items
        lists: dict[int, list[tuple[int, float]]] = {}
        essential: list[tuple[int, int, float]] = []
        for i, item in enumerate(items):
            words, tf = np.unique(np.r_[item.question, item.answer], return_counts=True)
            n = int(tf.sum())
            if not n:
                continue
            d = np.array([df[int(w)] for w in words], float)
            impact = np.log1p((total - d + 0.5) / (d + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean_length))
            impact /= impact.sum()
            order = np.argsort(impact, kind="stable")
            out = np.cumsum(impact[order]) <= UNESSENTIAL
            for w, x in zip(words.tolist(), impact.tolist()):
                lists.setdefault(w, []).append((i, x))
            essential += [(int(w), i, float(x)) for w, x in zip(words[order[~out]], impact[order[~out]])]
        self.window = max(64, 2 * longest)
        self.lists = {w: Postings(np.array([i for i, _ in p]), np.array([x for _, x in p])) for w, p in lists.items()}
        self.vocabulary = np.sort(np.array(list(lists), np.uint64))
        essential.sort()
        self.e_words, self.e_first = np.unique(np.array([e[0] for e in essential], np.uint64), return_index=True)
        self.e_count = np.diff(np.r_[self.e_first, len(essential)])
        self.e_item = np.array([e[1] for e in essential], np.int64)
        self.e_impact = np.array([e[2] for e in essential])

    def candidates(self, h: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Passages that may hold enough of some item, by the weight of its essential words.
        Passage p of a row covers ``window`` words from ``p * window / 2`` on; ``first`` numbers
        the passages of the rows."""
        if not len(self.e_words) or not len(h):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.e_words, h), len(self.e_words) - 1)
        hit = np.flatnonzero(self.e_words[at] == h)
        at = at[hit]
        count = self.e_count[at]
        entry = np.repeat(self.e_first[at] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        half = self.window // 2
        start = np.searchsorted(row, np.arange(len(first)))
        place = first[row[hit]] + (hit - start[row[hit]]) // half  # it lies in this passage and the one before
        place = np.repeat(place, count)
        begins = np.repeat((hit - start[row[hit]]) < half, count)
        n = len(self.items)
        item, weight = self.e_item[entry], self.e_impact[entry]
        key = np.concatenate([place * n + item, (place[~begins] - 1) * n + item[~begins]])
        weight = np.concatenate([weight, weight[~begins]])
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        if not len(key):
            return key
        run = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        enough = np.add.reduceat(weight, run) >= LEAST_SCORE - UNESSENTIAL - 1e-9
        return np.unique(key[run[enough]] // n)

    def search(self, words: np.ndarray, least: float = LEAST_SCORE) -> list[tuple[int, float]]:
        """All (item, score) with a score of ``least`` or more, by block-max WAND."""
        lists = [self.lists[w] for w in np.unique(words).tolist() if w in self.lists]
        cursors = [[p.items[0], 0, p] for p in lists]
        end, found, least = len(self.items), [], least - 1e-12
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[2].most
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # bound by the blocks that could hold the item, and how far they reach
            bound, reach = 0.0, end if pivot + 1 >= len(cursors) else cursors[pivot + 1][0]
            for c in cursors[:pivot + 1]:
                p, b = c[2], c[1] // BLOCK
                while b < len(p.block_max) and p.items[min(len(p.items), (b + 1) * BLOCK) - 1] < item:
                    b += 1
                if b < len(p.block_max):
                    bound += p.block_max[b]
                    reach = min(reach, p.items[min(len(p.items), (b + 1) * BLOCK) - 1] + 1)
            if bound < least:
                target = max(reach, item + 1)
                cursors = _moved(cursors, pivot + 1, target)
            elif cursors[0][0] == item:
                score = 0.0
                for c in cursors[:pivot + 1]:
                    score += c[2].impacts[c[1]]
                if score >= least:
                    found.append((item, score))
                cursors = _moved(cursors, pivot + 1, item + 1)
            else:
                cursors = _moved(cursors, pivot, item)
        return found

    def matches(self, h: np.ndarray, row: np.ndarray, rows: int) -> list[tuple[int, int, int, float, float, float]]:
        """(row, item, first word, score, question share, answer share) of all verified pairs: the
        passage with the largest shares, then score, then first."""
        start = np.searchsorted(row, np.arange(rows + 1))
        half = self.window // 2
        passages = np.maximum(1, -(-(start[1:] - start[:-1]) // half))
        first = np.cumsum(passages) - passages
        best: dict[tuple[int, int], tuple] = {}
        for p in self.candidates(h, row, first):
            r = int(np.searchsorted(first, p, side="right")) - 1
            at = int(p - first[r]) * half
            words = h[start[r] + at:min(start[r] + at + self.window, start[r + 1])]
            for i, score in self.search(words):
                q = covered(self.items[i].question, words, SHINGLE)
                a = covered(self.items[i].answer, words, 3)
                if q >= LEAST_QUESTION and a >= LEAST_ANSWER:
                    now = (q + a, score, -at, q, a)
                    if now > best.get((r, i), (-1.0,)):
                        best[r, i] = now
        return [(r, i, -v[2], v[1], v[3], v[4]) for (r, i), v in sorted(best.items())]


def _moved(cursors, upto: int, target: int):
    """The cursors, the first ``upto`` moved to the first item not below ``target``; ended ones go."""
    out = []
    for k, c in enumerate(cursors):
        if k < upto and c[0] < target:
            p, j = c[2], c[1]
            while j < len(p.items) and p.items[j] < target:
                j = (j // BLOCK + 1) * BLOCK if p.items[min(len(p.items), (j // BLOCK + 1) * BLOCK) - 1] < target else j + 1
            if j >= len(p.items):
                continue
            c = [p.items[j], j, p]
        out.append(c)
    return out


def _item_word_rows(batches):
    for batch in batches:
        h, row = item_words(*X.buffers(pc.utf8_lower(batch.column("text"))))
        key = np.unique(np.column_stack([row.astype(np.int64), h.view(np.int64)]), axis=0) if len(h) else np.zeros((0, 2), np.int64)
        per = np.bincount(row, minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[key[:, 1], np.zeros(batch.num_rows, np.int64)]),
                                          pa.array(np.r_[np.zeros(len(key), np.int64), per])], ["word", "length"])


def indexes(items: DataFrame) -> list[Index]:
    """Indexes of ``items(item_id, text, ...)``, each over INDEX_BYTES of text or so, with
    the statistics of all items. Null and empty texts and equal (item_id, text) rows add nothing."""
    items = items.where("text IS NOT NULL").select("item_id", "text").distinct()
    size, total = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = -(-(size or 0) // INDEX_BYTES)
    if not blocks:
        return []
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    words = items.select("text").mapInArrow(_item_word_rows, "word BIGINT, length BIGINT")
    length, longest = words.agg(F.sum("length"), F.max("length")).first()
    counts = words.where("length = 0").groupBy("word").count()
    out = []
    for b in range(blocks):
        mine = items.where(block == b)
        rows = sorted(mine.collect(), key=lambda r: (str(r["item_id"]), r["text"]))
        used = mine.select("text").mapInArrow(_item_word_rows, "word BIGINT, length BIGINT").select("word").distinct()
        df = {int(np.int64(r["word"]).astype(np.uint64)): r["count"] for r in counts.join(used, "word").collect()}
        parts = [Item(r["item_id"], *map(hashes_of, parts_of(r["text"]))) for r in rows]
        out.append(Index(parts, df, total, max((length or 0) / total, 1.0), longest or 0))
    return out


def _batch_matches(batch: pa.RecordBatch, index: Index):
    for a, b, data, offsets in X.text_slices(batch, fold=True):
        h, row = item_words(data, offsets)
        for r, *rest in index.matches(h, row, b - a):
            yield a + r, *rest


def _match_fn(index: Index):
    def run(batches):
        for batch in X.pieces(batches):
            found = list(_batch_matches(batch, index))
            ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([index.items[f[1]].id for f in found], index.id_type),
                 pa.array([f[2] for f in found], pa.int64()), *(pa.array([f[k] for f in found], pa.float64()) for k in (3, 4, 5))],
                ["doc_id", "item_id", "first_word", "score", "question_share", "answer_share"])
    return run


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Verified pairs of ``docs(doc_id, text, ...)`` and ``items(item_id, text, ...)``:
    (doc_id, item_id, first_word, score, question_share, answer_share), where ``first_word``
    is the place of the best passage in the text, counted in words.

    A text of any length is searched whole; null and empty texts match nothing, nor do
    empty items. Repeated rows give repeated pairs; other columns are ignored."""
    schema = (f"doc_id {type_of(docs, 'doc_id')}, item_id {type_of(items, 'item_id')}, first_word BIGINT, score DOUBLE, "
              "question_share DOUBLE, answer_share DOUBLE")
    out = None
    for index in indexes(items):
        index.id_type = arrow_type_of(items, "item_id")
        part = docs.select("doc_id", "text").mapInArrow(_match_fn(index), schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _clean_fn(index: Index):
    def run(batches):
        for batch in X.pieces(batches):
            keep = np.ones(batch.num_rows, bool)
            keep[[f[0] for f in _batch_matches(batch, index)]] = False
            yield batch.filter(pa.array(keep))
    return run


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that match no item, with all their columns."""
    for index in indexes(items):
        docs = docs.mapInArrow(_clean_fn(index), docs.schema)
    return docs
