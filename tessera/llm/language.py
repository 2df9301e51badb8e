"""Language ID: compression classification.

Each language has a raw-content zstandard dictionary made of sample texts. A text
is compressed with every dictionary, in pieces small enough for the dictionary to
matter; the language with the smallest total is predicted. Equal totals (texts of a
few words) are told apart at a level that finds shorter matches, and then by which
language has more training rows. When the margin to the second is narrow the
prediction is not accepted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textops as X
from tessera.llm.tables import type_of

UNKNOWN = "und"
#: training texts a language (about), characters of each, and dictionary bytes
SAMPLE_TEXTS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 1500, 1 << 16
#: bytes that are compressed at once
PIECE = 2048
LEVEL, FINE_LEVEL = 9, 19
_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def folded(text: str) -> bytes:
    """Lower case, ASCII other than letters as single spaces."""
    return b" ".join(text.lower().encode("utf-8").translate(_FOLD).split())


def training_rows(docs: DataFrame, fold: int = 3, held: int = 1) -> DataFrame:
    """Rows with a language and a text whose crc32(doc_id) mod ``fold`` isn't ``held``."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() &
                      (F.crc32(F.col("doc_id").cast("string")) % fold != held))


def dictionaries(train: DataFrame) -> dict[str, bytes]:
    """A dictionary a language, those with more training rows first, from a bounded sample: about SAMPLE_TEXTS texts with the
    lowest hash of their id, SAMPLE_CHARS characters of each, DICTIONARY_BYTES in all."""
    n = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not n:
        return {}
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1.0, 1.2 * SAMPLE_TEXTS / v))])
    order = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    rows = (train.where(order < share[F.col("lang")] * float(1 << 30))
            .select("lang", order.alias("at"), F.substring("text", 1, SAMPLE_CHARS).alias("text")).collect())
    out: dict[str, bytes] = {k: b"" for k in sorted(n, key=lambda k: (-n[k], k))}
    for r in sorted(rows, key=lambda r: (r["at"], r["text"])):
        if len(out[r["lang"]]) < DICTIONARY_BYTES:
            out[r["lang"]] += folded(r["text"]) + b" "
    return {k: v[:DICTIONARY_BYTES] for k, v in out.items()}


def _compressors(content: list[bytes], level: int):
    out = []
    for c in content:
        d = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False,
                                            write_dict_id=False).compress)
    return out


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        self.langs = [k for k, v in content.items() if v]
        used = [content[k] for k in self.langs]
        self.usual, self.fine = _compressors(used, LEVEL), _compressors(used, FINE_LEVEL)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin (of the second size over the smallest)."""
        if not self.langs or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        raw = folded(text)
        pieces = [raw[i:i + PIECE] for i in range(0, len(raw), PIECE)]
        size = np.array([sum(len(c(p)) for p in pieces) for c in self.usual], float)
        tied = np.flatnonzero(size == size.min())
        if len(tied) > 1:
            again = [sum(len(self.fine[i](p)) for p in pieces) for i in tied]
            best = int(tied[int(np.argmin(again))])
        else:
            best = int(tied[0])
        score = 1.0 / np.exp((size[best] - size) / 4.0).sum()
        second = np.partition(size, 1)[1] if len(size) > 1 else 2 * size[best] + 1
        return self.langs[best], float(score), float((second - size[best]) / max(second, 1.0))


def _predict_fn(content: dict[str, bytes], narrow: float):
    def run(batches):
        model = Classifier(content)
        for batch in X.pieces(batches):
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            margin = [f[2] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array(margin, pa.float64()),
                 pa.array([m >= narrow for m in margin], pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "margin", "accepted"])
    return run


def identify(docs: DataFrame, train: DataFrame, held_out, narrow: float = 0.01) -> DataFrame:
    """The language of every text of ``docs(doc_id, text, ...)``, learned from
    ``train(doc_id, lang, text)``; ``held_out`` is a boolean column of ``docs``.

    Returns (doc_id, held_out, lang_pred, score, margin, accepted). ``lang_pred`` is the
    language with the smallest size; ``accepted`` is false
    when its margin is below ``narrow``. A null text or one without a letter is ``und``
    with score 0 and not accepted; so is every text if nothing could be learned. One
    result row per input row; other columns are ignored."""
    content = dictionaries(train)
    schema = (f"doc_id {type_of(docs, 'doc_id')}, held_out BOOLEAN, lang_pred STRING, score DOUBLE, "
              "margin DOUBLE, accepted BOOLEAN")
    return (docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
            .mapInArrow(_predict_fn(content, narrow), schema))
