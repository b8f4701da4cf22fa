"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import discard, fresh, materialize, partitions_for, shared_dir
from ..sources.tables import table

__all__ = ["discard", "fresh", "hash_sample", "held_out", "labelled_sample", "materialize", "partitions_for", "shared_dir", "small_batches", "spread", "table", "text_bytes"]

#: Rows in one Arrow batch. Texts may be long, so batches are kept short to bound a Python worker's memory.
ARROW_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short; a user's own lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(ARROW_ROWS))


def held_out(column: str, modulus: int, rest: int):
    """Whether crc32 of the id as text leaves `rest`; a null id is never held out and never learnt from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def hash_sample(rows: DataFrame, id_col: str, salt: str, size: int) -> DataFrame:
    """At most `size` rows, those whose id has the smallest hash (ties by a hash of all columns).

    One cheap count sets a share of the hashes that holds the sample, so that few rows are sorted; the rest is a top-k
    that each task cuts to `size`. The same rows come out at every partitioning. Adds column `u`, the hash; rows with a
    null id are left out.
    """
    rows = rows.where(F.col(id_col).isNotNull())
    share = min(1.0, 1.25 * size / max(1, rows.count()))
    u = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(salt)), F.lit(1 << 31))
    return rows.withColumn("u", u).where(F.col("u") < int(share * (1 << 31))).orderBy("u", F.xxhash64(*rows.columns)).limit(size)


def labelled_sample(docs: DataFrame, labels: DataFrame, text_col: str, label_col: str, id_col: str, salt: str, size: int) -> DataFrame:
    """(u, i, y, t): at most `size` labelled texts, half of them of each label 0 and 1 if there are enough; a text not null."""
    out = []
    for label in (0, 1):
        # A bounded sample of ids, which is why it may be broadcast to find their texts.
        ids = hash_sample(labels.where(F.col(label_col) == label).select(F.col(id_col).alias("i")).distinct(), "i", salt, size // 2)
        texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
        found = texts.join(F.broadcast(ids), "i").orderBy("u", "i", F.xxhash64("t")).limit(size // 2)
        out.append(found.select("u", "i", F.lit(label).alias("y"), "t"))
    return out[0].unionByName(out[1])


def spread(n: int, most: int) -> np.ndarray:
    """Numbers of at most `most` of n windows, evenly spread from the first to the last."""
    return np.unique(np.linspace(0, n - 1, min(n, most)).astype(int))
