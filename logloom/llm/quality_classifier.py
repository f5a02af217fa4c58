"""Quality by compression: which of two zstandard dictionaries explains a text better.

One dictionary is trained on good and one on bad labelled texts.  A text is cut into pieces of
``piece`` bytes, each compressed under both dictionaries; (bad - good) / (bad + good) over the
summed sizes is the normalised difference.  A text that repeats itself compresses well under
either, so the compressed share of its bytes is the second input of the calibration, a
logistic fit on labelled texts that the dictionaries have not seen, with each class weighted
by its true number.

The sample is bounded: ``per_class`` labelled documents of each label (2,000), three quarters
of them for the dictionaries, each with about ``text_pieces`` pieces (4) from all over it, so that no long
text fills a dictionary.  Scoring is one narrow pass over whole texts.

Defined results: a null or an empty text has difference 0 and share 1; repeated rows are scored
one by one; an id that the documents have with several texts counts with the largest of them; very
long texts are compressed whole; an empty table gives an empty result; columns besides the id, the text
and the label are not read, whatever their names; with labelled texts too few to train a dictionary
every score is 0.5, and a warning says so.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .calibration import Logistic, labelled_sample
from .tables import fold, table

THRESHOLD = 0.7


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


class Compressors:
    """Compressed sizes under two trained dictionaries; rebuilt from their bytes in each process."""

    def __init__(self, bad: bytes, good: bytes, piece: int, level: int):
        self.state = bad, good, piece, level
        self.piece, self.made = piece, []
        for raw in (bad, good):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=level)
            self.made.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __reduce__(self):
        return Compressors, self.state

    def features(self, text: str | None) -> tuple[float, float, float]:
        raw = _bytes(text)
        if not raw:
            return 0.0, 1.0, 0.0
        bad = good = 0
        for at in range(0, len(raw), self.piece):
            part = raw[at : at + self.piece]
            bad += len(self.made[0].compress(part))
            good += len(self.made[1].compress(part))
        share = min(1.0, good / len(raw))
        return (bad - good) / (bad + good), share, share * share


class QualityModel:
    def __init__(self, sample: list[tuple[int, str, int]], totals: dict[int, int], dict_bytes: int = 64 << 10, piece: int = 2048, level: int = 3, text_pieces: int = 4):
        train: dict[int, list[bytes]] = {0: [], 1: []}
        rest, turn = [], {0: 0, 1: 0}
        for _, text, y in sample:
            turn[y] += 1
            raw = _bytes(text)
            if turn[y] % 4 == 0:
                rest.append((text, y))
            else:
                every = list(range(0, max(len(raw), 1), piece))
                train[y] += [raw[a : a + piece] for a in every[:: max(1, -(-len(every) // text_pieces))]]
        self.compress = None
        try:
            bad, good = (zstandard.train_dictionary(dict_bytes, [p for p in train[y] if len(p) >= 16], k=64, d=8, level=level).as_bytes() for y in (0, 1))
        except (zstandard.ZstdError, ValueError) as short:
            warnings.warn(f"no dictionary from {len(train[0])} bad and {len(train[1])} good pieces: {short}", stacklevel=2)
            return
        self.compress = Compressors(bad, good, piece, level)
        labels = np.array([y for _, y in rest])
        weight = np.array([totals.get(int(y), 0) / max(1, int((labels == y).sum())) for y in labels])
        self.calibrate = Logistic(np.array([self.compress.features(t) for t, _ in rest]), labels, weight)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.compress is None or not texts:
            return np.full(len(texts), 0.5)
        return self.calibrate(np.array([self.compress.features(t) for t in texts]))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = 2000, dict_bytes: int = 64 << 10, parts: int = 4, held: int = 2, text_pieces: int = 4) -> QualityModel:
    return QualityModel(*labelled_sample(docs, labels, label_col, parts, held, per_class), dict_bytes, text_pieces=text_pieces)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (probability of label 1) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist()), pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
