"""Quality classifier: compression with good and bad dictionaries.

Two zstandard dictionaries are built, one from good and one from bad labelled
texts. A text is cut into blocks, every block is compressed with either
dictionary, and the difference of the summed sizes, divided by the text's
size, says which class the text resembles. That difference, with the plain
compressed share (texts that repeat themselves) and their product, becomes a
probability by logistic calibration on labelled texts that were not used for
the dictionaries.

Scale: fitting uses at most ``max_docs`` labelled documents of each class, and
at most ``max_bytes`` bytes of each (of a longer one a stretch from a place
that its id names; it is scored in full like all others); ids are broadcast
and texts come to the driver within that bound. Scoring is one pass without a shuffle, with a
constant amount of memory a row beyond the text.

Defined results: a null text is scored as an empty one; an empty text has
score 0.0, as nothing in it is of use; without labelled texts of both classes
the score is the share of good ones seen (0.5 without any). Several rows of
one doc_id are scored row by row, and labels that contradict each other both
count. Clashing columns ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provgraph.llm.common import table
from provgraph.llm.hashing import slices, utf8

BLOCK, LEVEL, DICTIONARY = 2048, 3, 64 * 1024
MAX_DOCS, MAX_BYTES = 1500, 16 * 1024
CUT = 0.7


@dataclass
class Model:
    """Dictionaries, and the calibration's mean, scale and weights."""

    good: bytes
    bad: bytes
    mean: list[float]
    scale: list[float]
    weights: list[float]
    prior: float


class Measure:
    """Features of texts under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        flat = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, window_log=17, **flat)
        make = lambda d: zstandard.ZstdCompressor(compression_params=params, **({"dict_data": zstandard.ZstdCompressionDict(d)} if d else {}))
        self.good, self.bad, self.plain = make(good), make(bad), make(b"")

    def __call__(self, text: memoryview | bytes) -> tuple[float, float, float]:
        n = len(text)
        good = bad = 0
        for at in range(0, n, BLOCK):
            block = text[at : at + BLOCK]
            good += len(self.good.compress(block))
            bad += len(self.bad.compress(block))
        # a constant in the denominators lets short texts say less
        difference, share = (bad - good) / (n + 64), len(self.plain.compress(text)) / (n + 32)
        return difference, share, difference * share


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary from blocks of the texts; their joined end if too few."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(good: list[bytes], bad: list[bytes]) -> Model:
    """Dictionaries from even places of either list, calibration from odd."""
    good, bad = [t for t in good if t], [t for t in bad if t]
    prior = len(good) / (len(good) + len(bad)) if good or bad else 0.5
    if len(good) < 4 or len(bad) < 4:
        return Model(b"", b"", [], [], [], prior)
    model = Model(_dictionary(good[::2]), _dictionary(bad[::2]), [], [], [], prior)
    measure = Measure(model.good, model.bad)
    x = np.array([measure(t) for t in good[1::2] + bad[1::2]])
    y = np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    model.mean, model.scale, model.weights = mean.tolist(), scale.tolist(), _logistic((x - mean) / scale, y).tolist()
    return model


def score_texts(model: Model, column: pa.Array) -> np.ndarray:
    """The score of each text of an Arrow column."""
    data, offsets = utf8(column)
    out = np.full(len(offsets) - 1, model.prior)
    full = np.flatnonzero(np.diff(offsets))
    if model.weights and len(full):
        measure, view = Measure(model.good, model.bad), memoryview(data)
        x = np.array([measure(view[offsets[i] : offsets[i + 1]]) for i in full])
        z = (x - model.mean) / model.scale @ np.array(model.weights[:-1]) + model.weights[-1]
        out[full] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    out[np.diff(offsets) == 0] = 0.0
    return out


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def training_rows(labels: DataFrame) -> DataFrame:
    """Labels that may be learnt from."""
    return labels.filter("doc_id is not null and quality in (0, 1)").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def _part(text: Column, doc_id: Column, max_bytes: int) -> Column:
    """A text, or of one of more than ``max_bytes`` bytes a stretch of a fourth
    as many characters, from a place that its id's hash names."""
    size = max_bytes // 4
    place = F.pmod(F.xxhash64(doc_id), F.greatest(F.length(text) - size, F.lit(0)) + 1).cast("int") + 1
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(F.substring(text, place, F.lit(size)))


def sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> tuple[list[bytes], list[bytes]]:
    """At most ``max_docs`` good and bad texts, those of least id hash."""
    known = training_rows(labels).select("doc_id", "quality").distinct()
    texts: dict[int, list[bytes]] = {1: [], 0: []}
    for quality in (1, 0):
        ids = known.filter(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
        rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(ids), "doc_id")
        rows = rows.select("doc_id", _part(F.col("text"), F.col("doc_id"), max_bytes).alias("text"))
        rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_docs)  # bounded even with repeated ids
        texts[quality] = [r.text.encode() for r in rows.select("text").collect()]
    return texts[1], texts[0]


def classify(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    rows = docs.select(*kept)
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)])
    at = kept.index("text")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, at):
                score = score_texts(model, batch.column(at))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= cut).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return rows.mapInArrow(run, schema)


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(*sample(docs, table(spark, sf_dir, "labels")))
    is_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    scored = classify(docs, model)
    return scored.select("doc_id", F.coalesce(is_out, F.lit(False)).alias("held_out"), "score", "predicted")
