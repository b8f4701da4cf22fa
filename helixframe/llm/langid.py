"""Language identification with a byte convolutional network (multi-width filters, max pooling, softmax).

Every whole text is cut into fixed-length byte windows, which are scored in batches; the class probabilities of a
text are the mean over its windows, weighted by their bytes. Training reads a bounded sample of labelled rows
(`sample_rows`, chosen by a hash of the id, so the same rows come out at every partitioning) and runs in numpy on
`windows_per_row` windows of each, which are cut out in the tasks: the driver gets windows, never whole texts.

Defined results: a null text, or one without any letter, is `und` with score 0. A null id is allowed and kept. With
no labelled row at all every text is `und`. Repeated rows are scored each. Other columns play no part.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytecnn import ByteCNN, softmax, window_logits, window_starts, windows
from .common import hash_sample, held_out, small_batches, spread, table, text_bytes

WINDOW = 256
SAMPLE_ROWS = 1600
WINDOWS_PER_ROW = 4
LETTER = re.compile(r"[^\W\d_]")
#: A-Z are folded onto a-z before the filters see them.
FOLD = np.frombuffer(bytes(range(256)).lower(), np.uint8)
UNDETERMINED = "und"


class LanguageModel:
    """labels and the network; plain data, so that Spark can ship it to tasks."""

    def __init__(self, labels: list[str], net: ByteCNN | None):
        self.labels, self.net = labels, net

    def predict(self, texts: pa.Array, tables: list | None) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if self.net is None or not n:
            return [UNDETERMINED] * n, np.zeros(n)
        raw, offsets = text_bytes(texts)
        start, size, doc = window_starts(offsets, WINDOW, WINDOW)
        prob = softmax(window_logits(self.net, tables, raw, start, size, WINDOW)) * size[:, None]
        first = np.searchsorted(doc, np.arange(n))
        total = np.add.reduceat(prob, first, axis=0) / np.maximum(1, np.diff(offsets))[:, None]
        best, score = total.argmax(1), np.clip(total.max(1), 0, 1).astype(float)
        names = []
        for i, text in enumerate(texts):
            t = text.as_py()
            known = t is not None and LETTER.search(t) is not None
            names.append(self.labels[best[i]] if known else UNDETERMINED)
            if not known:
                score[i] = 0.0
        return names, score


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, windows_per_row: int = WINDOWS_PER_ROW, epochs: int = 6) -> LanguageModel:
    """Train on at most `sample_rows` rows with a label, those with the smallest hash of their id, and `windows_per_row` windows of each."""
    rows = labelled.select(F.col(id_col).alias("i"), F.col(label_col).alias("y"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).where(F.col("y").isNotNull())
    sample = hash_sample(rows, "i", "language", sample_rows).select("u", F.col("y").cast("string").alias("y"), F.col("t").cast("binary").alias("t"))

    def cut(batches):
        for b in batches:
            out = []
            for t in b.column(2).to_pylist():
                start, size, _ = window_starts(np.array([0, len(t)]), WINDOW, WINDOW)
                out.append([t[start[k] : start[k] + size[k]] for k in spread(len(start), windows_per_row)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.binary()))], ["u", "y", "parts"])

    rows = sorted(sample.mapInArrow(cut, "u bigint, y string, parts array<binary>").collect(), key=lambda r: (r.u, r.y, r.parts))
    labels = sorted({r.y for r in rows})
    if not labels:
        return LanguageModel([], None)
    xs, ys = [], []
    for r in rows:
        data = np.frombuffer(b"".join(r.parts), np.uint8)
        size = np.array([len(x) for x in r.parts])
        # Windows cut short teach the network what short texts look like.
        short = np.where(np.arange(len(size)) % 2 == 0, size, np.minimum(size, 24 + (r.u % 97)))
        xs.append(windows(data, np.cumsum(size) - size, short, WINDOW))
        ys += [labels.index(r.y)] * len(size)
    y = np.array(ys)
    count = np.bincount(y, minlength=len(labels))
    weight = (len(y) / (len(labels) * np.maximum(1, count)))[y].astype(np.float32)
    net = ByteCNN(len(labels), (2, 3, 4), 8, FOLD).fit(np.concatenate(xs), y, np.minimum(weight, 4), epochs)
    return LanguageModel(labels, net)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score) of every row of docs."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        tables = model.net.pairs() if model.net else None
        for b in batches:
            names, score = model.predict(b.column(1), tables)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without the rows whose language is undetermined or whose score is under min_score; all columns stay as they are."""
    small_batches(docs.sparkSession)
    schema = docs.schema

    def run(batches):
        tables = model.net.pairs() if model.net else None
        for b in batches:
            names, score = model.predict(b.column(b.schema.get_field_index(text_col)), tables)
            yield b.filter(pa.array([n != UNDETERMINED and s >= min_score for n, s in zip(names, score)], pa.bool_()))

    return docs.mapInArrow(run, schema)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id", 4, 2)))
    out = predict(docs, model)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
