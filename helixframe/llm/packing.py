"""Vector bin packing of examples into fixed-length training sequences.

A sequence has three limits at once: tokens, segments (pieces of examples) and loss-bearing tokens. Each partition
packs its own stream with a bounded number of open sequences. An example goes to the open sequence with the largest
dot product of its demand and the sequence's free room (each as a share of its limit) among those it fits. Where none
fits, a new sequence is opened; once all are open, the fullest is filled up by cutting the example, and the rest
goes on as an example of its own. At a partition's end, what the open sequences hold is packed again end to end, and
the last remainder is cut at powers of two, where no padding is asked for. No shuffle is needed, memory stays bounded, and
a lost task packs the same rows in the same way again.

Sequence ids are unique, not dense: partition number times 2^32 plus a counter.

Defined results: a null text is an empty one (the end id only). Repeated rows and repeated ids are packed each. Null
ids are kept. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .tokens import END_ID, encoder, tokenizer_path

MAX_TOKENS, MAX_SEGMENTS, OPEN = 4096, 128, 24


class Piece:
    """Part of an example: length ids from start on; loss: running count of loss-bearing ids of the whole example, or None if all bear loss."""

    __slots__ = ("example", "start", "length", "loss")

    def __init__(self, example, start: int, length: int, loss: np.ndarray | None):
        self.example, self.start, self.length, self.loss = example, start, length, loss

    def cost(self, length: int) -> int:
        return length if self.loss is None else int(self.loss[self.start + length] - self.loss[self.start])

    def fits(self, tokens: int, loss: int) -> int:
        """The most ids from the front that stay within so many ids and loss-bearing ids."""
        n = min(self.length, tokens)
        if self.loss is None:
            return min(n, loss)
        return min(n, int(np.searchsorted(self.loss, self.loss[self.start] + loss, "right")) - 1 - self.start)

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return Piece(self.example, self.start, n, self.loss), Piece(self.example, self.start + n, self.length - n, self.loss)


class Packer:
    """Packs a stream; add() and finish() yield closed sequences as lists of pieces."""

    def __init__(self, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, open_sequences: int = OPEN):
        if min(max_tokens, max_segments, open_sequences) < 1 or max_loss is not None and max_loss < 1:
            raise ValueError("limits must be positive")
        self.most = (max_tokens, max_segments, max_loss or max_tokens)
        self.width, self.open = open_sequences, []  # each open sequence: [free ids, free segments, free loss, pieces]

    def fresh(self) -> list:
        return [*self.most, []]

    @staticmethod
    def put(seq: list, piece: Piece) -> None:
        seq[0] -= piece.length
        seq[1] -= 1
        seq[2] -= piece.cost(piece.length)
        seq[3].append(piece)

    def done(self, seq: list) -> bool:
        return seq[0] == 0

    def add(self, example, length: int, loss: np.ndarray | None = None):
        t, s, most_loss = self.most
        rest = Piece(example, 0, length, loss)
        while rest.length:
            if rest.length >= t and rest.fits(t, most_loss) == t:
                whole, rest = rest.cut(t)
                yield [whole]
                continue
            need = rest.cost(rest.length)
            d = (rest.length / t / t, 1 / s / s, need / most_loss / most_loss)
            best, value = None, -1.0
            for seq in self.open:
                if seq[0] >= rest.length and seq[1] > 0 and seq[2] >= need:
                    dot = d[0] * seq[0] + d[1] * seq[1] + d[2] * seq[2]
                    if dot > value:
                        best, value = seq, dot
            if best is None and len(self.open) < self.width:
                self.open.append(best := self.fresh())
            if best is None:  # cut it to fill the fullest sequence that still takes a segment
                best = min((q for q in self.open if q[1] > 0 and q[2] > 0), key=lambda q: q[0], default=None)
                if best is None:
                    yield from self.repack(self.open.pop(0)[3], last=False)
                    continue
            n = rest.fits(best[0], best[2])
            if n == 0:
                yield from self.repack(best[3], last=False)
                self.open = [q for q in self.open if q is not best]
                continue
            piece, rest = rest.cut(n)
            self.put(best, piece)
            if self.done(best):
                self.open = [q for q in self.open if q is not best]
                yield best[3]

    def repack(self, pieces: list[Piece], last: bool = True):
        """Pack pieces end to end with cuts, so that each sequence is full or has a power of two of ids."""
        queue = pieces[::-1]
        while queue:
            seq = self.fresh()
            while queue and seq[0] and seq[1] and seq[2]:
                piece = queue.pop()
                n = piece.fits(seq[0], seq[2])
                if n < piece.length:
                    if n == 0:
                        queue.append(piece)
                        break
                    piece, rest = piece.cut(n)
                    queue.append(rest)
                self.put(seq, piece)
            total = self.most[0] - seq[0]
            keep = total if total == self.most[0] else 1 << (total.bit_length() - 1)
            out = seq[3]
            while total > keep:
                piece = out.pop()
                back = min(piece.length, total - keep)
                if back < piece.length:
                    piece, tail = piece.cut(piece.length - back)
                    out.append(piece)
                else:
                    tail = piece
                queue.append(tail)
                total -= back
            yield out

    def finish(self):
        rest = [p for seq in self.open for p in seq[3]]
        self.open = []
        yield from self.repack(rest)


PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint"


def pack_streams(encoded, kind: pa.DataType, packer: Packer):
    """Record batches of pieces for a stream of (id, ids as bytes, running loss count or None) of one partition."""
    from pyspark import TaskContext

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    number, rows = TaskContext.get().partitionId() << 32, []

    def flush():
        cols = list(zip(*rows)) if rows else [()] * len(names)
        batch = pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names)
        rows.clear()
        return batch

    def take(sequences):
        nonlocal number
        for pieces in sequences:
            at = 0
            for p in pieces:
                i, ids = p.example
                rows.append((i, p.start, p.length, zlib.crc32(memoryview(ids)[4 * p.start : 4 * (p.start + p.length)]), len(ids) // 4, number, at))
                at += p.length
            number += 1

    for i, ids, loss in encoded:
        take(packer.add((i, ids), len(ids) // 4, loss))
        if len(rows) >= 4096:
            yield flush()
    take(packer.finish())
    yield flush()


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode every text, append the end id and pack: one row per piece. All ids of a document bear loss."""
    small_batches(docs.sparkSession)
    vocabulary, end = vocabulary or tokenizer_path(), np.array([end_id], "<u4").tobytes()

    def run(batches):
        kinds = []

        def encoded():
            enc = encoder(vocabulary)
            for b in batches:
                kinds.append(b.schema.field(0).type)
                for i, t in zip(b.column(0), b.column(1)):
                    yield i.as_py(), enc.encode(t.as_py() or "") + end, None

        stream = encoded()
        first = next(stream, None)
        if first is not None:
            yield from pack_streams((x for part in ([first], stream) for x in part), kinds[0], Packer(max_tokens, max_segments, max_loss))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {PIECES}")


def pack_examples(examples: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None) -> DataFrame:
    """Pack (doc_id, ids array<int>, loss array<boolean> or null: all) with a limit on loss-bearing ids, as for instruction data."""
    small_batches(examples.sparkSession)

    def run(batches):
        kinds = []

        def encoded():
            for b in batches:
                kinds.append(b.schema.field(0).type)
                for i, ids, loss in zip(b.column(0), b.column(1), b.column(2)):
                    mask = loss.as_py()
                    yield i.as_py(), np.array(ids.as_py() or [], "<u4").tobytes(), None if mask is None else np.concatenate([[0], np.cumsum(mask)])

        stream = encoded()
        first = next(stream, None)
        if first is not None:
            yield from pack_streams((x for part in ([first], stream) for x in part), kinds[0], Packer(max_tokens, max_segments, max_loss))

    kind = examples.schema["doc_id"].dataType.simpleString()
    return examples.select("doc_id", "ids", "loss").mapInArrow(run, f"doc_id {kind}, {PIECES}")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
