"""Lines of texts as feature rows for the sequence models, and labelled samples of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import crf
from tessera.llm import textops as X

#: labelled texts (about) that a model is fitted on, and characters of the longest
SAMPLE_TEXTS, SAMPLE_CHARS = 3000, 20_000

_CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
            "mark": b"#*$%&<>", "bar": b"|", "shout": b"!?", "stop": b".,;:", "space": b" \t\r\x0b\x0c"}
_OF = np.full(256, len(_CLASSES), np.uint8)  # the rest; bytes of other letters come last
for _i, _chars in enumerate(_CLASSES.values()):
    _OF[list(_chars)] = _i
_OF[128:] = len(_CLASSES) + 1
_WIDTH = len(_CLASSES) + 2


class Lines:
    """The ``\\n``-split lines of a slice of texts: spans, row and word counts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        breaks = np.flatnonzero(data == 0x0A)
        row = np.searchsorted(offsets[1:], breaks, side="right")
        start = np.concatenate([offsets[:-1], breaks + 1])
        end = np.concatenate([breaks, offsets[1:]])
        self.row = np.sort(np.concatenate([np.arange(len(offsets) - 1), row]), kind="stable")
        self.start = start[np.lexsort((start, np.concatenate([np.arange(len(offsets) - 1), row])))]
        self.end = end[np.lexsort((end, np.concatenate([row, np.arange(len(offsets) - 1)])))]
        self.lengths = np.bincount(self.row, minlength=len(offsets) - 1)  # lines of each text
        self.word_start, self.word_end, self.word_row = X.words(data, offsets)
        self.word_line = np.searchsorted(self.start, self.word_start, side="right") - 1
        # a text without bytes shares its line's start with the next text's first line
        self.words = np.bincount(self.word_line, minlength=len(self.start))
        self.hash = X.span_hashes(data, self.start, self.end)

    def repeated(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        key = X.mix(self.hash + self.row.astype(np.uint64) * X._GOLD)
        first = np.zeros(len(key), bool)
        first[np.unique(key, return_index=True)[1]] = True
        return ~first & (self.words > 0)

    def features(self, neighbours: bool) -> np.ndarray:
        """One row a line; with ``neighbours`` also what the lines before and after show."""
        n = len(self.start)
        size = (self.end - self.start).astype(np.float32)
        kind = _OF[self.data]
        share = np.empty((n, _WIDTH), np.float32)
        for c in range(_WIDTH):
            total = np.zeros(len(kind) + 1, np.int32)
            np.cumsum(kind == c, out=total[1:])
            share[:, c] = total[self.end] - total[self.start]
        share /= np.maximum(size, 1)[:, None]
        words = self.words.astype(np.float32)
        names = list(_CLASSES)
        marks, bars, shout = (share[:, names.index(k)] for k in ("mark", "bar", "shout"))
        upper, letters = share[:, names.index("upper")], share[:, [0, 1, _WIDTH - 1]].sum(1)
        h = X.span_hashes(self.data, self.word_start, self.word_end)
        same = np.r_[False, (h[1:] == h[:-1]) & (self.word_line[1:] == self.word_line[:-1])] if len(h) else np.zeros(0, bool)
        again = np.bincount(self.word_line, weights=same, minlength=n) / np.maximum(words, 1)
        last = self.data[np.maximum(self.end - 1, 0)] if len(self.data) else np.zeros(n, np.uint8)
        own = np.column_stack([
            share, np.log1p(size) / 5, np.log1p(words) / 3, size / np.maximum(words, 1) / 20,
            words == 0, words < 4, (words >= 4) & (words < 15), marks > 0.02, marks > 0.1, bars > 0.02, bars > 0.08,
            shout > 0.02, shout > 0.1, upper > 0.3 * letters + 0.01, letters < 0.6, again > 0.05, again > 0.3,
            self.repeated(), (size > 0) & np.isin(last, list(b".!?:;")),
        ]).astype(np.float32)
        parts = [np.ones((n, 1), np.float32), own]
        if neighbours:
            begins = np.r_[True, self.row[1:] != self.row[:-1]] if n else np.zeros(0, bool)
            ends = np.r_[begins[1:], True] if n else begins
            before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
            before[begins], after[ends] = 0, 0
            parts += [before, after, begins[:, None].astype(np.float32), ends[:, None].astype(np.float32)]
        return np.hstack(parts)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, texts: int = SAMPLE_TEXTS) -> list[tuple[str, int]]:
    """About ``texts`` labelled texts, those whose id has the lowest hash; texts of more than
    SAMPLE_CHARS characters are left out. A repeated id counts once, with its lowest label."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min(label).alias("label"))
    n = rows.count()
    order = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    some = rows.where(order < min(1.0, texts / max(n, 1)) * float(1 << 30))
    found = (docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
             .join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")))
    return [(r["text"], int(r["label"])) for r in sorted(found.collect(), key=lambda r: r["doc_id"])]


def fitted(sample: list[tuple[str, int]], neighbours: bool, balanced: bool = True) -> crf.Model:
    """A model of the sample's lines. A line has its text's label; ``balanced``, both labels
    weigh alike, else lines without a mark of either go with the commoner one."""
    data, offsets = X.buffers(pa.array([t for t, _ in sample], pa.string()))
    lines = Lines(data, offsets)
    label = np.array([y for _, y in sample], np.int64)[lines.row] if sample else np.zeros(0, np.int64)
    weight = np.ones(len(label))
    for y in (0, 1) if balanced else ():
        if (label == y).any():
            weight[label == y] = len(label) / 2 / (label == y).sum()
    return crf.fit(lines.features(neighbours), label, lines.lengths, weight)
