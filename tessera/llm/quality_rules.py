"""Quality rules: counting rules, and line labels by a conditional random field.

A linear-chain conditional random field, fitted on a bounded sample of labelled texts,
marks each line as content or boilerplate by Viterbi decoding. A text is kept when it
passes the counting rules and content lines hold enough of its characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import crf
from tessera.llm import textops as X
from tessera.llm.lines import Lines, fitted, labelled_sample
from tessera.llm.tables import type_of

LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: share of characters that content lines must hold
LEAST_CONTENT = 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(lines: Lines, rows: int, k: int = WINDOW) -> np.ndarray:
    """Words of each text in k-word windows that occur twice or more in it."""
    h = X.span_hashes(lines.data, lines.word_start, lines.word_end)
    g, at = X.ngram_hashes(h, lines.word_row, k)
    if not len(g):
        return np.zeros(rows, np.int64)
    key = X.mix(g + lines.word_row[at].astype(np.uint64) * X._GOLD)
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    twice = at[order[np.r_[same, False] | np.r_[False, same]]]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + k, -1)
    inside = np.cumsum(cover[:-1]) > 0
    return np.bincount(lines.word_row[inside], minlength=rows)


def measures(lines: Lines) -> dict[str, np.ndarray]:
    """The counts of the base rules for every text of a slice."""
    data, offsets = lines.data, lines.offsets
    rows = len(offsets) - 1
    in_word = ~X.SEPARATOR[data] & ((data & 0xC0) != 0x80)
    repeated = np.bincount(lines.row[lines.repeated()], minlength=rows)
    return {"n_words": np.bincount(lines.word_row, minlength=rows), "word_chars": _per_text(in_word, offsets),
            "n_symbols": _per_text(_SYMBOL[data], offsets), "n_dup_lines": repeated,
            "n_repeat_words": repeated_words(lines, rows)}


def content_share(lines: Lines, model: crf.Model) -> np.ndarray:
    """The share of each text's characters (bytes of its lines) in content lines; 0 if it has none."""
    rows = len(lines.offsets) - 1
    label = model.viterbi(lines.features(False), lines.lengths)
    size = (lines.end - lines.start).astype(float)
    total = np.bincount(lines.row, weights=size, minlength=rows)
    return np.bincount(lines.row, weights=size * label, minlength=rows) / np.maximum(total, 1)


def _score_fn(model: crf.Model):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in X.text_slices(batch):
                lines = Lines(data, offsets)
                m = measures(lines)
                share = content_share(lines, model)
                failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(v.astype(np.int64)) for v in m.values()),
                     pa.array(failed), pa.array(~failed & (share >= LEAST_CONTENT)), pa.array(share)],
                    ["doc_id", *m, "base_failed", "kept", "content_share"])
    return run


def line_model(docs: DataFrame, labels: DataFrame) -> crf.Model:
    """Content (1) or boilerplate (0) lines, those of texts with ``labels.quality`` 1 or 0.
    Fitted on a bounded sample (``lines.SAMPLE_TEXTS``); without labels every line is
    content. A line's features are its own (its repetition in the text among them);
    the lines around it count by the labels' transitions."""
    return fitted(labelled_sample(docs, labels, "quality"), False, balanced=False)


def quality_rules(docs: DataFrame, model: crf.Model) -> DataFrame:
    """The base counts, ``base_failed``, ``kept`` and ``content_share`` of every text of
    ``docs(doc_id, text, ...)``. A null, empty or wordless text has zero counts and fails
    the base rules. One result row per input row, repeated rows and null ids included;
    other columns are ignored."""
    schema = (f"doc_id {type_of(docs, 'doc_id')}, n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, n_dup_lines BIGINT, "
              "n_repeat_words BIGINT, base_failed BOOLEAN, kept BOOLEAN, content_share DOUBLE")
    return docs.select("doc_id", "text").mapInArrow(_score_fn(model), schema)


def _keep_fn(model: crf.Model):
    score = _score_fn(model)

    def run(batches):
        for batch in X.pieces(batches):
            texts = pa.RecordBatch.from_arrays([batch.column("text")] * 2, ["doc_id", "text"])
            kept = pa.concat_arrays([b.column("kept") for b in score([texts])]) if batch.num_rows else pa.array([], pa.bool_())
            yield batch.filter(kept)
    return run


def keep(docs: DataFrame, model: crf.Model) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns."""
    return docs.mapInArrow(_keep_fn(model), docs.schema)
