"""Token ids: encoding whole texts with a public tokenizer, and a Parquet layout for selective reads of ids.

File format, written and read by Spark's own Parquet source, in ascending order of doc_id:

    doc_id, ids array<int> (dictionary-encoded), n_tokens int, part int, part_start long

`part` numbers the range partition that wrote a row and `part_start` counts the ids before it in that partition, so a
document's global start is part_start plus the small prefix sum of the partitions' totals. Row groups and pages are
kept small and carry column and offset indexes (page statistics), so that a read of a few documents or of the
metadata columns touches few pages. ids are dictionary-encoded (a vocabulary fits a dictionary page); the ascending
long columns are delta-encoded.

Defined results: a null text is encoded as an empty one (only the end id). Null ids sort first. Rows with equal ids
are ordered by a hash of their text; exact repeats are written each. An empty table gives empty files.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, partitions_for, shared_dir, small_batches, table

END_ID = 2
#: Chunks whose encodings a worker remembers, just under the size at which a dict doubles (the memory is emptied beyond that), and the longest that is remembered.
REMEMBERED, LONGEST = 1_390_000, 64
#: Chunks of these characters only take the short way: NFC leaves them alone and lower() maps them one to one.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PLAIN_TEXT = re.compile(r"[ \n!-~À-ÖØ-öø-ÿ]*")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-`{-~]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The normalizer and the pre-tokenizer that WordEncoder's short way stands in for. Any other goes through the whole tokenizer.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def splits_words(path: str) -> bool:
    """Whether a tokenizer file splits texts in the way that WordEncoder's short way does."""
    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    added = [x["content"] for x in kind["added_tokens"]]
    return kind["normalizer"] == WORD_NORMALIZER and kind["pre_tokenizer"] == WORD_SPLITTER and kind["post_processor"] is None and all("<|" in x and " " not in x for x in added)


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself if printable, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Chunks(dict):
    """Ids of chunks, encoded where they are first asked for.

    A chunk of plain characters is split by the tokenizer's own pattern and each piece handed to its BPE model; any
    other chunk goes through the whole tokenizer.
    """

    def __init__(self, whole):
        self.whole, self.model, self.letters = whole, whole.model, byte_letters()
        self.ids = [i.to_bytes(4, "little") for i in range(1 + max(whole.get_vocab().values()))]

    def __missing__(self, chunk: str) -> bytes:
        if not PLAIN.fullmatch(chunk) or "<|" in chunk:
            got = b"".join([self.ids[i] for i in self.whole.encode(chunk, add_special_tokens=False).ids]) if chunk else b""
        elif (lower := chunk.lower()) != chunk:
            got = self[lower]
        elif not chunk.isalpha() and len(pieces := PIECE.findall(chunk)) > 1:
            got = b"".join(map(self.__getitem__, pieces))
        else:
            word = chunk if chunk.isascii() else "".join(map(self.letters.__getitem__, chunk.encode()))
            got = b"".join([self.ids[t.id] for t in self.model.tokenize(word)])
        if len(chunk) <= LONGEST:
            self[chunk] = got
        return got


class WordEncoder:
    """Encodes texts by their space-separated chunks, each distinct chunk once: the tokenizer never joins across white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.known = Chunks(Tokenizer.from_file(path))

    def encode(self, text: str) -> bytes:
        """The ids of text as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        # A plain text is put in lower case at once, so that fewer chunks differ.
        if PLAIN_TEXT.fullmatch(text) and "<|" not in text:
            text = text.lower()
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))


class WholeEncoder:
    """Encodes each text as a whole, with any tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)

    def encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, WordEncoder | WholeEncoder] = {}


def encoder(path: str) -> WordEncoder | WholeEncoder:
    """One per Python worker: what it remembers serves all of the worker's tasks. The file itself tells which kind is right."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path) if splits_words(path) else WholeEncoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, text_col: str = "text", id_col: str = "doc_id", row_group_bytes: int = 32 << 20, page_rows: int = 128) -> None:
    """Encode every text of docs and write the file format above to path."""
    spark, vocabulary = docs.sparkSession, vocabulary or tokenizer_path()
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, at, enc = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        for b in batches:
            out = [enc.encode(t.as_py() or "") + end for t in b.column(1)]
            n = np.fromiter(map(len, out), np.int64, len(out)) // 4
            offsets = np.concatenate([[0], np.cumsum(n)])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(out))])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(n, pa.int32()), pa.array(np.full(len(n), part), pa.int32()), pa.array(at + offsets[:-1], pa.int64())], ["doc_id", "ids", "n_tokens", "part", "part_start"])
            at += int(offsets[-1])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    parts = partitions_for(spark, rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)  # AQE may not split sorted ranges
    (
        rows.repartitionByRange(parts, "doc_id", tie)
        .sortWithinPartitions("doc_id", tie)
        .mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens int, part int, part_start bigint")
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#part_start", "false")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """What write_tokens wrote, with the global start; only the named columns are read, and filters on doc_id reach the page indexes."""
    files = spark.read.parquet(path)
    # One row per written partition: a small table whatever the number of documents.
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    from pyspark.sql import Window

    base = totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    # Written, so that Spark knows its bytes: the token lists are then not shuffled to meet it while it is small.
    return files.join(materialize(base), "part").withColumn("start", F.col("base") + F.col("part_start")).select(*columns)


def checksums(tokens: DataFrame) -> DataFrame:
    """tokens with ids replaced by the unsigned crc32 of their little-endian 32-bit form."""
    small_batches(tokens.sparkSession)
    names = [c for c in tokens.columns if c != "ids"]
    kinds = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for b in batches:
            ids = b.column(len(names))
            at, data = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
            crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(crc, pa.int64())], [*names, "ids_crc32"])

    return tokens.select(*names, "ids").mapInArrow(run, f"{kinds}, ids_crc32 bigint")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_tokens(table(spark, sf_dir, "documents"), path)
    out = checksums(read_tokens(spark, path))
    return out.select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")
