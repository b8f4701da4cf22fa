"""SimHash near-duplicates through deletion-variant signatures.

Fingerprint: 64 bits; bit i is set if over half of the XXH64 values of a text's 4-word shingles have it set. Two
fingerprints link when they differ in at most 4 bits. Cut into three segments (22, 21 and 21 bits), such a pair has a
segment that differs in at most one bit, as three segments with two or more differing bits would make six. So each
distinct fingerprint is indexed under 64 keys, one per bit: the bit's segment with that bit left out. Two segments
differ in at most one bit exactly if they share such a key. Fingerprints that meet under a key are verified.

Skew: texts with equal fingerprints are collapsed before the join, so copies cost nothing. Under a key that many
fingerprints share (near copies), no pairs are emitted: a breadth-first search inside the sorted run finds its
linked parts and emits one edge per member, which loses no link of the graph's components. Keys are counted first: one
with more than BLOCK fingerprints is cut into blocks, and each pair of its blocks is searched by a task of its own, so
that no task holds more than two blocks. Components are then contracted by alternating large and small stars over
DataFrames, each round written to the shared folder; both sides of every join stand on shuffles of their own, which
adaptive execution may split where one node has most of the edges.

Defined results: a null text has no words, as an empty one; without words the fingerprint is zero and links like any
other. component_id is the smallest non-null id reachable (null if none has an id). Repeated rows are returned each.
keep_one_of_each keeps exactly one row of every class, whatever ids repeat or are missing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import discard, fresh, materialize, partitions_for, small_batches, table

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: First bit of each segment, and the end.
SEGMENTS = (0, 22, 43, 64)
#: Under a key that more fingerprints share, the search emits edges to one member instead of pairs.
FEW = 24
#: A key with more fingerprints is searched block by block; the answer is the same.
BLOCK = 1 << 14


def fingerprint(text: bytes) -> int:
    """The fingerprint of UTF-8 text as an unsigned integer."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_digest
    if n <= SHINGLE:
        return int.from_bytes(digest(line, SEED), "big")
    size = np.fromiter(map(len, words), np.int64, n)
    first = np.cumsum(size + 1) - size - 1
    last = first + size
    start, end = first[: n - SHINGLE + 1].tolist(), last[SHINGLE - 1 :].tolist()
    half, count = len(start) / 2, np.zeros(64, np.int64)
    for at in range(0, len(start), 1 << 16):
        h = b"".join([digest(line[a:b], SEED) for a, b in zip(start[at : at + (1 << 16)], end[at : at + (1 << 16)])])
        count += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(count > half).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp as a signed long) of every row, and the long columns named in `also`."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or b"") for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), *b.columns[2:]], ["doc_id", "fp", *also])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), *also)
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", "fp bigint", *(f"`{c}` bigint" for c in also)]))


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of signed longs (numpy counts the bits of a signed number's absolute value)."""
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64))


def parts(fp: np.ndarray) -> list[tuple[int, int]]:
    """Edges (root, member) of the linked parts among distinct fingerprints, by breadth-first search over what is left."""
    edges, left = [], fp
    while len(left) > 1:
        root, left, front = left[0], left[1:], left[:1]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for at in range(0, len(front), 64):
                rest = ~near
                near[rest] = (differing(front[at : at + 64, None], left[None, rest]) <= DISTANCE).any(0)
            front, left = left[near], left[~near]
            edges += [(root, x) for x in front]
    return edges


def links_in_runs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between fingerprints under equal keys (sorted by key)."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    small = np.repeat(size <= FEW, size)
    k, f = key[small], fp[small]
    a, b = [], []
    for lag in range(1, FEW):
        same = k[lag:] == k[:-lag]
        if not same.any():
            break
        near = same & (differing(f[lag:], f[:-lag]) <= DISTANCE)
        a.append(f[:-lag][near])
        b.append(f[lag:][near])
    for s, n in zip(start[size > FEW], size[size > FEW]):
        if e := parts(fp[s : s + n]):
            x, y = np.array(e, np.int64).T
            a.append(x)
            b.append(y)
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all links of at most DISTANCE bits; distinct: column fp without repeats."""
    small = F.col("fp")
    bit = F.col("bit")
    low = F.when(bit < SEGMENTS[1], SEGMENTS[0]).when(bit < SEGMENTS[2], SEGMENTS[1]).otherwise(SEGMENTS[2])
    width = F.when(bit < SEGMENTS[1], SEGMENTS[1]).otherwise(SEGMENTS[2] - SEGMENTS[1])
    keys = (
        distinct.select(small, F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
        .withColumn("low", low)
        .withColumn("width", width)
        .select(
            F.expr("cast(shiftleft(bit, 22) | (cast(shiftrightunsigned(fp, low) & (shiftleft(1L, width) - 1) as int) & ~shiftleft(1, bit - low)) as bigint)").alias("key"),
            "fp",
        )
    )

    def run(batches):
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        kept, size = [], 0
        for b in batches:
            kept.append(b)
            size += b.num_rows
            if size < 1 << 17:
                continue
            key = np.concatenate([held_key, *(x.column(0).to_numpy() for x in kept)])
            fp = np.concatenate([held_fp, *(x.column(1).to_numpy() for x in kept)])
            kept, size = [], 0
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            x, y = links_in_runs(key[:cut], fp[:cut])
            held_key, held_fp = key[cut:], fp[cut:]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
        key = np.concatenate([held_key, *(x.column(0).to_numpy() for x in kept)])
        fp = np.concatenate([held_fp, *(x.column(1).to_numpy() for x in kept)])
        if len(key):
            x, y = links_in_runs(key, fp)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    spark, n = distinct.sparkSession, distinct.count()
    hot = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
    parts = partitions_for(spark, 64 * 20 * n)
    cold = keys if hot.isEmpty() else keys.join(hot, "key", "left_anti")
    searched = [cold.repartition(parts, "key")]
    if not hot.isEmpty():
        # Each fingerprint of a hot key meets every block of the key once, in the task of its own block and that one.
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        mine = keys.join(hot, "key").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        mine = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
        searched.append(mine.select(pair.alias("key"), "fp").repartition(parts, "key"))
    edges = [x.sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint") for x in searched]
    out = materialize((edges[0] if len(edges) == 1 else edges[0].union(edges[1])).distinct())
    discard(hot)
    return out


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Alternates large and small stars until the edges stay as they are. A node's minimum is aggregated before the
    shuffle and written, so that the join with the node's many neighbours is one that Spark may split.
    """
    edges = materialize(edges.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct())
    seen = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = materialize(both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct())
        # Now every edge points from a smaller a to a larger b; each b hands all its a to the smallest of them.
        least = materialize(large.groupBy("b").agg(F.min("a").alias("m")))
        handed = large.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        after = materialize(handed.union(least.select(F.col("m").alias("a"), "b")).distinct())
        discard(edges, low, large, least)
        edges = after
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = state


def classes(fps: DataFrame) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of fps (doc_id, fp), written; root names the class."""
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(distinct.select("fp"))
    roots = stars(edges)
    whole = materialize(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    component = materialize(whole.groupBy("root").agg(F.min("least").alias("component_id")))
    out = materialize(whole.join(component, "root").select("fp", "root", "component_id"))
    discard(distinct, edges, whole, component)
    return out


def near_duplicate_classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    fps = materialize(fingerprints(docs, text_col, id_col))
    return fps.join(classes(fps).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without all but one row of each class: that with the smallest id, a null id being the largest.

    Of rows with that id, the one with the smallest hash of its columns stays; of rows that are alike throughout, any.
    All columns stay as they are. Columns that cannot be compared (maps) play no part in the choice.
    """
    row, key, kept_row, many = (fresh(docs.columns, c) for c in ("row_hash", "kept_id", "kept_row", "alike"))
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    marked = docs.withColumn(row, F.xxhash64(F.col(text_col), *(F.col(c) for c in plain)))
    fps = materialize(fingerprints(marked, text_col, id_col, (row,)))
    ids = classes(fps)
    rows = fps.groupBy("fp", "doc_id", row).agg(F.count("*").alias("n")).join(ids.select("fp", "root"), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row, "n"))
    chosen = materialize(rows.groupBy("root").agg(first.alias("s")).select(F.col("s.doc_id").alias(key), F.col(f"s.{row}").alias(kept_row), F.col("s.n").alias(many)))
    there = marked[id_col].eqNullSafe(F.col(key)) & (F.col(row) == F.col(kept_row))
    single = marked.join(chosen.where(F.col(many) == 1), there, "left_semi")
    # Rows that are alike throughout: one of them, picked before the shuffle, so that a large group costs no task much.
    again = marked.join(chosen.where(F.col(many) > 1), there, "left_semi").groupBy(id_col, row).agg(F.first(F.struct(*docs.columns)).alias(key)).select(f"{key}.*")
    discard(fps, ids)
    return single.select(*docs.columns).unionByName(again)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
