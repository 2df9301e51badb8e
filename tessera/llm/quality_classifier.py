"""Quality classifier: line labels of a conditional random field, gathered to a score.

Every line is good or bad by a linear-chain conditional random field whose features
also describe the lines before and after. A text's score is the mean of the lines'
forward-backward marginals, weighted by their lengths.
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


def line_quality_model(docs: DataFrame, labels: DataFrame) -> crf.Model:
    """A model of good lines: those of texts with ``labels.quality`` 1, from a bounded
    sample (``lines.SAMPLE_TEXTS``). Without labels every score is one half."""
    return fitted(labelled_sample(docs, labels, "quality"), True)


def scores(lines: Lines, model: crf.Model) -> np.ndarray:
    """The length-weighted mean marginal of each text; an empty line weighs little, so
    that an empty text has its line's marginal."""
    rows = len(lines.offsets) - 1
    p = model.marginals(lines.features(True), lines.lengths)
    weight = (lines.end - lines.start) + 1e-6
    return np.bincount(lines.row, weights=p * weight, minlength=rows) / np.bincount(lines.row, weights=weight, minlength=rows)


def _score_fn(model: crf.Model, least: float):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in X.text_slices(batch):
                s = np.clip(scores(Lines(data, offsets), model), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(s),
                     pa.array((s >= least).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
    return run


def classify(docs: DataFrame, model: crf.Model, held_out, least: float = 0.3) -> DataFrame:
    """score (0 to 1) and predicted (1 from ``least`` on) of every text of
    ``docs(doc_id, text, ...)``; ``held_out`` is a boolean column of ``docs``.

    A null or empty text is one empty line. One result row per input row, repeated rows
    and null ids (not held out) included; other columns are ignored."""
    schema = f"doc_id {type_of(docs, 'doc_id')}, held_out BOOLEAN, score DOUBLE, predicted INT"
    return (docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
            .mapInArrow(_score_fn(model, least), schema))
