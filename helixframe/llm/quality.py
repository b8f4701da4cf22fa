"""Quality scores from a byte-level convolutional network over overlapping chunks of the whole document.

Chunks of 512 bytes start every 384 bytes, so each byte but the first and last few lies in the inner part of some
chunk. The network gives each chunk a logit from its max-pooled filter responses; a document's logit is a learned
combination of the mean and the lowest of its chunks' logits, and its score the logistic of that. Training reads a
bounded sample of labelled rows (`sample_rows`, half of each label, chosen by a hash of the id): `chunks_per_row` chunks
of each for the network and `mixed_chunks` for the combination, evenly spread and cut out in the tasks.

Defined results: null and empty texts are scored as one empty chunk. With no labelled row, or labels of one kind
only, every score is the share of label 1 (0.5 without labels). Repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytecnn import ByteCNN, window_logits, window_starts, windows
from .common import held_out, labelled_sample, small_batches, spread, table, text_bytes

CHUNK, STRIDE = 512, 384
SAMPLE_ROWS = 1600
CHUNKS_PER_ROW, MIXED_CHUNKS = 4, 64


class QualityModel:
    def __init__(self, net: ByteCNN | None, prior: float, mix: np.ndarray | None):
        self.net, self.prior, self.mix = net, prior, mix

    def features(self, raw, offsets, tables) -> np.ndarray:
        """Per text: 1, mean and lowest logit of its chunks."""
        start, size, doc = window_starts(offsets, CHUNK, STRIDE)
        return self.chunk_features(raw, start, size, doc, len(offsets) - 1, tables)

    def chunk_features(self, raw, start, size, doc, n: int, tables) -> np.ndarray:
        z = window_logits(self.net, tables, raw, start, size, CHUNK).astype(np.float64)
        logit = z[:, 1] - z[:, 0]
        first = np.searchsorted(doc, np.arange(n))
        mean = np.add.reduceat(logit, first) / np.diff(np.append(first, len(doc)))
        return np.stack([np.ones(n), mean, np.minimum.reduceat(logit, first)], 1)

    def scores(self, raw: np.ndarray, offsets: np.ndarray, tables) -> np.ndarray:
        if self.net is None or len(offsets) < 2:
            return np.full(len(offsets) - 1, self.prior)
        return 1 / (1 + np.exp(-np.clip(self.features(raw, offsets, tables) @ self.mix, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, chunks_per_row: int = CHUNKS_PER_ROW, mixed_chunks: int = MIXED_CHUNKS, epochs: int = 6) -> QualityModel:
    """Train on at most `sample_rows` labelled rows with a small hash of their id, half of them of each label if there are enough."""

    def cut(batches):
        for b in batches:
            out = []
            for t in b.column(2).to_pylist():
                start, size, _ = window_starts(np.array([0, len(t)]), CHUNK, STRIDE)
                out.append([t[start[k] : start[k] + size[k]] for k in spread(len(start), mixed_chunks)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.binary()))], ["u", "y", "parts"])

    sample = labelled_sample(docs, labels, text_col, label_col, id_col, "quality", sample_rows).select("u", "y", F.col("t").cast("binary").alias("t"))
    rows = sorted(sample.mapInArrow(cut, "u bigint, y int, parts array<binary>").collect(), key=lambda r: (r.u, r.y, r.parts))
    if len({r.y for r in rows}) < 2:
        return QualityModel(None, float(np.mean([r.y for r in rows])) if rows else 0.5, None)
    size = np.array([len(x) for r in rows for x in r.parts])
    raw, start = np.frombuffer(b"".join(x for r in rows for x in r.parts), np.uint8), np.cumsum(size) - size
    count = np.array([len(r.parts) for r in rows])
    first = np.cumsum(count) - count
    pick = [first[i] + spread(n, chunks_per_row) for i, n in enumerate(count)]
    y = np.repeat([r.y for r in rows], [len(x) for x in pick])
    pick = np.concatenate(pick)
    weight = (len(y) / (2 * np.bincount(y, minlength=2)))[y].astype(np.float32)
    model = QualityModel(ByteCNN(2, (3, 5), 8).fit(windows(raw, start[pick], size[pick], CHUNK), y, weight, epochs), 0.5, None)
    f = model.chunk_features(raw, start, size, np.repeat(np.arange(len(rows)), count), len(rows), model.net.pairs())
    label = np.array([r.y for r in rows], float)
    scale = np.array([1.0, 4.0, 4.0])
    mix = np.array([0.0, 1.0, 1.0])
    for _ in range(400):  # plain gradient descent on three numbers
        p = 1 / (1 + np.exp(-np.clip(f / scale @ mix, -30, 30)))
        mix -= 0.5 * ((f / scale).T @ (p - label) / len(label) + 1e-3 * mix)
    model.mix = mix / scale
    return model


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row of docs."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        tables = model.net.pairs() if model.net else None
        for b in batches:
            raw, offsets = text_bytes(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(raw, offsets, tables), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out("doc_id", 3, 1)))
    out = score(docs, model)
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
