"""Alignment of two tokenizers' tokens over the same bytes, by products of sparse incidence matrices.

Row i of a token-byte matrix has an entry for each byte that token i covers. The product of A's matrix with B's
transposed one, row by row (Gustavson), has an entry for each pair of tokens whose byte ranges overlap, and in it the
bytes they share: the overlap links. Byte offsets where tokens of both end cut a text into groups; the product of the
token-group matrices has an entry for each pair in one group: the shared-group links.

Texts are cut where both tokenizers never join anything: before white space that follows other characters. Whether B's
pieces allow that is read from its vocabulary; texts with unusual white space are taken whole. Such chunks recur, so a
task aligns each distinct one once and adds up. Corpus-wide counts of id pairs take two passes: the first writes, for
every book of a bounded number of chunks, its texts as numbers of chunks and the links of each chunk; the pairs' counts
are summed over the books, joined back to them (a pair meets each book once, however frequent it is), and each book's
texts are then scored from its own table.

Defined results: a text that is null, empty, or not given back byte by byte by both tokenizers has no tokens: zeros and
an empty string. Repeated rows and ids are each reported, and each counts; an id may be null. An empty table gives no
rows. Other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, table
from .tokens import byte_letters, tokenizer_path

#: Texts are cut before white space of these kinds; any other kind makes a text one chunk.
WORDS = re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+$")
UNUSUAL = re.compile(r"[^\S \n\t]|▁")
#: References to chunks of one book, and chunks that a worker remembers from book to book: bounds of a task's memory.
BOOK_REFS, REMEMBERED = 1_000_000, 250_000
#: Entries that one block of rows of a product may expand to.
EXPANDED = 1 << 20


class Csr(NamedTuple):
    """A sparse matrix by rows: row i has entries at[i] to at[i + 1] of the columns `to` and the values."""

    at: np.ndarray
    to: np.ndarray
    value: np.ndarray
    width: int


def incidence(lengths: np.ndarray) -> Csr:
    """Tokens by bytes, token i covering lengths[i] bytes after those of the tokens before it."""
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    n = int(at[-1])
    return Csr(at, np.arange(n, dtype=np.int64), np.ones(n, np.int64), n)


def membership(ends: np.ndarray, groups: np.ndarray) -> Csr:
    """Tokens by groups, for the tokens' and the groups' ends."""
    n = len(ends)
    return Csr(np.arange(n + 1, dtype=np.int64), np.searchsorted(groups, ends), np.ones(n, np.int64), len(groups))


def transposed(m: Csr) -> Csr:
    rows = np.repeat(np.arange(len(m.at) - 1, dtype=np.int64), np.diff(m.at))
    order = np.argsort(m.to, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(m.to, minlength=m.width))]).astype(np.int64)
    return Csr(at, rows[order], m.value[order], len(m.at) - 1)


def product(a: Csr, b: Csr) -> Csr:
    """a times b, row by row: the rows of b that a row of a names are scaled, and what falls in one column is summed."""
    sizes = np.diff(b.at)[a.to]  # entries that each entry of a expands to
    before = np.concatenate([[0], np.cumsum(sizes)])
    rows, cut = len(a.at) - 1, [0]
    while cut[-1] < rows:  # blocks of rows of a bounded expansion, one row at least
        cut.append(max(cut[-1] + 1, int(np.searchsorted(before[a.at], before[a.at[cut[-1]]] + EXPANDED, side="right")) - 1))
    count, to, value = np.zeros(rows, np.int64), [], []
    for r0, r1 in zip(cut, cut[1:]):
        e0, e1 = int(a.at[r0]), int(a.at[r1])
        n = sizes[e0:e1]
        at = np.repeat(b.at[a.to[e0:e1]] - (before[e0:e1] - before[e0]), n) + np.arange(int(n.sum()))
        row = np.repeat(np.repeat(np.arange(r0, r1), np.diff(a.at[r0 : r1 + 1])), n)
        key, v = row * b.width + b.to[at], np.repeat(a.value[e0:e1], n) * b.value[at]
        order = np.argsort(key, kind="stable")
        key, v = key[order], v[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        key = key[first]
        count += np.bincount(key // b.width, minlength=rows) if len(key) else 0
        to.append(key % b.width)
        value.append(np.add.reduceat(v, first) if len(first) else v)
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return Csr(np.concatenate([[0], np.cumsum(count)]).astype(np.int64), joined(to), joined(value), b.width)


def rows_of(m: Csr) -> np.ndarray:
    return np.repeat(np.arange(len(m.at) - 1), np.diff(m.at))


def expansion(a: Csr, b: Csr) -> np.ndarray:
    """Entries of each row of a times b where no two fall in one column: the product's size without the product."""
    return np.add.reduceat(np.append(np.diff(b.at)[a.to], 0), a.at[:-1]) if len(a.at) > 1 else np.zeros(0, np.int64)


class Tokenizers:
    """A: byte-level BPE of the tokenizers library. B: a sentencepiece model."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte, vocabulary = {c: i for i, c in enumerate(byte_letters())}, self.a.get_vocab(True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64) for x in (self.bytes_a, self.bytes_b))
        # A cut is safe if no piece of B goes on over it.
        space = set("▁\n\t")
        inner = {xy for i, p in enumerate(pieces) if not self.b.is_byte(i) for xy in zip(p, p[1:])}
        self.cuts = not any((y in space and x not in space) or (x == "▁" and y in "\n\t") for x, y in inner)
        self.lead = self.b.encode("\n")[:1]  # the space that B puts before a text
        top = max(len(self.bytes_a), len(self.bytes_b))
        self.shown, self.top = [mark + str(i) for mark in ("", ";", ",", "|") for i in range(top)], top

    def chunks(self, text: str) -> list[str]:
        text = " " + text
        return WORDS.findall(text) if self.cuts and not UNUSUAL.search(text) else [text]

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B. B puts a space before what it reads: the chunk's own, or one that is taken off again."""
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        b = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        # Of an empty text B makes nothing, not the space alone.
        return a, [(x or self.lead) if c[0] == " " else x[1:] if x[:1] == self.lead else [] for c, x in zip(chunks, b)]


_tokenizers: dict[tuple[str, str], Tokenizers] = {}


def tokenizers_of(path_a: str, path_b: str) -> Tokenizers:
    """One per Python worker."""
    if (path_a, path_b) not in _tokenizers:
        _tokenizers[path_a, path_b] = Tokenizers(path_a, path_b)
    return _tokenizers[path_a, path_b]


class Block(NamedTuple):
    """Chunks aligned together. fine: whether both tokenizers give a chunk back (if not, it has no tokens here); a, b: ids;
    first_a, first_b: numbers of the chunks' first tokens; links: tokens of A by tokens of B, with the bytes shared;
    end_a, end_b: the groups' ends in tokens; shared: shared-group links of each token of A."""

    fine: np.ndarray
    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    links: Csr
    end_a: np.ndarray
    end_b: np.ndarray
    shared: np.ndarray


def starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def align(tok: Tokenizers, chunks: list[str]) -> Block:
    """All chunks in one pair of matrices: chunks end where tokens of both end, so that no link or group goes over an end."""
    lists_a, lists_b = tok.encode(chunks)
    raw = [c.encode() for c in chunks]
    n_a, n_b = (np.fromiter(map(len, x), np.int64) for x in (lists_a, lists_b))
    a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (lists_a, lists_b))
    of = lambda ids, n, size: np.diff(np.concatenate([[0], np.cumsum(size[ids])])[starts(n)])  # noqa: E731  # bytes of each chunk
    size = np.fromiter(map(len, raw), np.int64)
    fine = (of(a, n_a, tok.size_a) == size) & (of(b, n_b, tok.size_b) == size)
    if not fine.all() or not b"".join(map(tok.bytes_a.__getitem__, a.tolist())) == b"".join(raw) == b"".join(map(tok.bytes_b.__getitem__, b.tolist())):
        fine = np.array([b"".join(map(tok.bytes_a.__getitem__, x)) == r == b"".join(map(tok.bytes_b.__getitem__, y)) for x, y, r in zip(lists_a, lists_b, raw)], bool)
        a, b = a[np.repeat(fine, n_a)], b[np.repeat(fine, n_b)]
        n_a, n_b = n_a * fine, n_b * fine
    links = product(incidence(tok.size_a[a]), transposed(incidence(tok.size_b[b])))
    end_a, end_b = np.cumsum(tok.size_a[a]), np.cumsum(tok.size_b[b])
    ends = np.intersect1d(end_a, end_b)
    shared = expansion(membership(end_a, ends), transposed(membership(end_b, ends)))
    return Block(fine, a, b, starts(n_a), starts(n_b), links, np.searchsorted(end_a, ends) + 1, np.searchsorted(end_b, ends) + 1, shared)


def group_texts(tok: Tokenizers, x: Block) -> list[str]:
    """The groups of each chunk as a1,a2|b1;a3|b2,b3: every token is written with the mark before it, and stands behind the tokens of A or B that come first."""
    starts_a, starts_b = (np.concatenate([[0], e[:-1]]).astype(np.int64) if len(e) else e for e in (x.end_a, x.end_b))
    group_a, group_b = (np.repeat(np.arange(len(e)), e - s) for e, s in ((x.end_a, starts_a), (x.end_b, starts_b)))
    mark_a, mark_b = np.full(len(x.a), 2), np.full(len(x.b), 2)
    mark_a[starts_a], mark_b[starts_b] = 1, 3
    mark_a[x.first_a[:-1][np.diff(x.first_a) > 0]] = 0
    out = np.zeros(len(x.a) + len(x.b), np.int64)
    out[np.arange(len(x.a)) + starts_b[group_a]] = mark_a * tok.top + x.a
    out[np.arange(len(x.b)) + x.end_a[group_b]] = mark_b * tok.top + x.b
    words, at = list(map(tok.shown.__getitem__, out.tolist())), (x.first_a + x.first_b).tolist()
    return ["".join(words[i:j]) for i, j in zip(at, at[1:])]


def token_links(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, a_ids, b_ids, links, groups) of every text: links are (a, b, bytes) by numbers of tokens, groups (a_end, b_end)."""
    small_batches(docs.sparkSession)
    path_a, path_b = path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model")
    kind = docs.schema[id_col].dataType.simpleString()
    link_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())]))
    group_type = pa.list_(pa.struct([("a_end", pa.int32()), ("b_end", pa.int32())]))

    def run(batches):
        tok = tokenizers_of(path_a, path_b)
        for batch in batches:
            ids, links, groups = ([], []), [], []
            for t in batch.column(1).to_pylist():
                x = align(tok, [" " + t] if t else [])
                for out, i in zip(ids, (x.a, x.b)):
                    out.append(i)
                links.append([{"a": a, "b": b, "bytes": n} for a, b, n in zip(rows_of(x.links).tolist(), x.links.to.tolist(), x.links.value.tolist())])
                groups.append([{"a_end": a, "b_end": b} for a, b in zip(x.end_a.tolist(), x.end_b.tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(i, pa.list_(pa.int32())) for i in ids), pa.array(links, link_type), pa.array(groups, group_type)], ["id", "a_ids", "b_ids", "links", "groups"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, a_ids array<int>, b_ids array<int>, links array<struct<a:int,b:int,bytes:int>>, groups array<struct<a_end:int,b_end:int>>")


class Vocabulary:
    """Chunks that a worker has met, numbered: their counts, groups as text, pairs of ids (A's in the upper half), and uses."""

    def __init__(self, tok: Tokenizers):
        self.tok, self.number, self.texts = tok, {}, []
        self.table, self.fine, self.uses = np.zeros((0, 5), np.int32), np.zeros(0, bool), np.zeros(0, np.int64)
        self.at, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Number new chunks, some thousand letters at a time."""
        i = 0
        tables, fines, sizes, pairs = [self.table], [self.fine], [np.diff(self.at)], [self.pairs]
        while i < len(chunks):
            j, size = i, 0
            while j < len(chunks) and (j == i or size < 1 << 17):
                size += len(chunks[j])
                j += 1
            x = align(self.tok, chunks[i:j])
            self.texts += group_texts(self.tok, x)
            row, n_links = rows_of(x.links), np.diff(x.links.at[x.first_a])
            n_groups = np.diff(np.searchsorted(x.end_a, x.first_a, side="right"))
            n_shared = np.diff(np.concatenate([[0], np.cumsum(x.shared)])[x.first_a])
            tables.append(np.stack([np.diff(x.first_a), np.diff(x.first_b), n_groups, n_links, n_shared], axis=1).astype(np.int64))
            fines.append(x.fine)
            sizes.append(n_links)
            pairs.append(x.a[row] << 32 | x.b[x.links.to])
            i = j
        self.number |= zip(chunks, range(len(self.number), len(self.number) + len(chunks)))
        self.table, self.fine, self.pairs = np.concatenate(tables), np.concatenate(fines), np.concatenate(pairs)
        self.at = starts(np.concatenate(sizes))
        self.uses = np.concatenate([self.uses, np.zeros(len(chunks), np.int64)])

    def pairs_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pairs of the chunks one after the other, where each chunk's end)."""
        n = self.at[numbers + 1] - self.at[numbers]
        ends = np.cumsum(n)
        return self.pairs[np.repeat(self.at[numbers] - (ends - n), n) + np.arange(int(n.sum()))], ends

    def forget(self) -> None:
        """Beyond REMEMBERED chunks, keep the half of them used most."""
        if len(self.texts) <= REMEMBERED:
            return
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2])
        names = list(self.number)
        self.pairs, ends = self.pairs_of(kept)
        self.at = np.concatenate([[0], ends])
        self.number = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.texts = [self.texts[i] for i in kept.tolist()]
        self.table, self.fine, self.uses = self.table[kept], self.fine[kept], self.uses[kept]

    def read(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, list[str]]:
        """For each text the numbers of its chunks, its counts, and the digest of its groups."""
        chunks = [self.tok.chunks(t) if t else [] for t in texts]
        new: set[str] = set()
        for c in chunks:
            new.update(set(c).difference(self.number))
        if new:
            self.learn(sorted(new))
        refs, counts, digests = [], np.zeros((len(texts), 5), np.int64), []
        for k, c in enumerate(chunks):
            numbers = list(map(self.number.__getitem__, c))
            at = np.array(numbers, np.int32)
            if c and not self.fine[at].all():
                numbers, at = [], at[:0]
            refs.append(at)
            counts[k] = self.table[at].sum(axis=0)
            digests.append(hashlib.sha256(";".join(map(self.texts.__getitem__, numbers)).encode()).hexdigest() if numbers else "")
        return refs, counts, digests


_vocabularies: dict[tuple[str, str], Vocabulary] = {}


COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each number): seven bits to a byte, the lowest first, the upper bit set in all but a number's last byte."""
    size = 1 + sum((numbers >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    at = starts(size)[:-1]
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        some = size > k
        out[at[some] + k] = (numbers[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, size


def unpacked(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, where each ends in raw) of packed()."""
    ends = np.flatnonzero(raw < 128) + 1
    at, size = np.concatenate([[0], ends[:-1]]).astype(np.int64), np.diff(np.concatenate([[0], ends]))
    out = np.zeros(len(ends), np.int64)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[some] |= (raw[at[some] + k].astype(np.int64) & 127) << 7 * k
    return out, ends


def books(docs: DataFrame, path_a: str, path_b: str, text_col: str, id_col: str) -> DataFrame:
    """Rows of texts (book, id, COUNTS, groups_sha256, refs), and one row for each book: its chunks' pairs and where each chunk's end, its distinct pairs and how often they are linked.

    Chunks are numbered by falling use in their book, so that most references in refs, which are packed, take a byte or two.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    names = ["book", "id", *COUNTS, "groups_sha256", "refs", "chunk_pairs", "chunk_ends", "pairs", "sums"]

    def run(batches):
        from pyspark import TaskContext

        words = _vocabularies.setdefault((path_a, path_b), Vocabulary(tokenizers_of(path_a, path_b)))
        number, refs, ids, counts, digests = TaskContext.get().partitionId() << 24, [], [], [], []

        def closed() -> list[pa.RecordBatch]:
            """A book's texts and its own row."""
            flat = np.concatenate([*refs, np.zeros(0, np.int32)])
            chunks, place, uses = np.unique(flat, return_inverse=True, return_counts=True)
            order = np.argsort(-uses, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            raw, size = packed(rank[place])
            at = starts(size)[starts([len(x) for x in refs])]
            of_text = pa.Array.from_buffers(pa.binary(), len(refs), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])
            chunks, uses = chunks[order], uses[order]
            links, ends = words.pairs_of(chunks)
            pairs, inverse = np.unique(links, return_inverse=True)
            sums = np.bincount(inverse, weights=np.repeat(uses, np.diff(np.concatenate([[0], ends]))), minlength=len(pairs)).astype(np.int64)
            np.add.at(words.uses, chunks, uses)
            words.forget()
            n, all_counts, of_ids = len(refs), np.concatenate(counts), pa.concat_arrays(ids)
            texts = [pa.array(np.full(n, number), pa.int64()), of_ids, *(pa.array(all_counts[:, i]) for i in range(5)), pa.array(digests, pa.string()), of_text, *(pa.nulls(n, t) for t in (longs, ints, longs, longs))]
            one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t.value_type))
            book = [pa.array([number], pa.int64()), *(pa.nulls(1, t) for t in (of_ids.type, *[pa.int64()] * 5, pa.string(), pa.binary())), one(links, longs), one(ends, ints), one(pairs, longs), one(sums, longs)]
            return [pa.RecordBatch.from_arrays(x, names) for x in (texts, book)]

        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                # A few texts at a time, so that a book does not outgrow its bounds by a whole batch.
                to, letters = at, 0
                while to < len(texts) and (to == at or letters < 1 << 20):
                    letters += len(texts[to] or "")
                    to += 1
                read = words.read(texts[at:to])
                refs += read[0]
                counts.append(read[1])
                digests += read[2]
                ids.append(batch.column(0).slice(at, to - at))
                at = to
                if sum(map(len, refs)) > BOOK_REFS:
                    yield from closed()
                    number, refs, ids, counts, digests = number + 1, [], [], [], []
        if refs:
            yield from closed()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"{c} bigint" for c in COUNTS)
    return rows.mapInArrow(run, f"book bigint, id {kind}, {kinds}, groups_sha256 string, refs binary, chunk_pairs array<bigint>, chunk_ends array<int>, pairs array<bigint>, sums array<bigint>")


def pair_counts(written: DataFrame) -> DataFrame:
    """(book, pair, cnt, best): the corpus-wide links of every pair of ids of a book, and whether no pair with the same id of B has more."""
    each = written.where(F.col("pairs").isNotNull()).select("book", F.explode(F.arrays_zip("pairs", "sums")).alias("z")).select("book", F.col("z.pairs").alias("pair"), F.col("z.sums").alias("n"))
    total = materialize(each.groupBy("pair").agg(F.sum("n").alias("cnt")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    most = total.groupBy("b").agg(F.max("cnt").alias("most"))
    total = total.join(most, "b").select("pair", "cnt", (F.col("cnt") == F.col("most")).alias("best"))
    return each.select("book", "pair").join(total, "pair")


def alignment_counts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared) of every text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    written = materialize(books(docs, path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model"), text_col, id_col))
    shown = ["id", *COUNTS, "groups_sha256"]

    def score(texts: pa.Table, counted: pa.Table) -> pa.Table:
        _vocabularies.clear()  # a worker of the first pass needs it no more
        book = texts.filter(pa.compute.is_valid(texts["pairs"]))
        rows = texts.filter(pa.compute.is_valid(texts["refs"]))
        pair, cnt, best = (counted[c].to_numpy() for c in ("pair", "cnt", "best"))
        order = np.argsort(pair)
        flat = lambda c: np.concatenate([x.values.to_numpy(zero_copy_only=False)[x.offsets[0].as_py() : x.offsets[-1].as_py()] for x in c.chunks] or [np.zeros(0, np.int64)])
        links, ends = flat(book["chunk_pairs"]), flat(book["chunk_ends"])
        at = order[np.searchsorted(pair, links, sorter=order)] if len(links) else links
        raw = np.frombuffer(b"".join(rows["refs"].to_pylist()), np.uint8)
        refs, ref_ends = unpacked(raw)
        size = np.concatenate([[0], np.cumsum(pa.compute.binary_length(rows["refs"]).to_numpy())]).astype(np.int64)
        size = np.searchsorted(np.concatenate([[0], ref_ends]), size)  # from bytes to references
        out = {c: rows[c] for c in shown}
        for name, per_link in (("n_best", best[at].astype(np.int64)), ("count_sum", cnt[at])):
            of_chunk = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(per_link)])[ends]]))
            so_far = np.concatenate([[0], np.cumsum(of_chunk[refs])]) if len(refs) else np.zeros(1, np.int64)
            out[name] = pa.array(np.diff(so_far[size]), pa.int64())
        return pa.table(out)

    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    counted = materialize(pair_counts(written))
    scored = written.groupBy("book").cogroup(counted.groupBy("book")).applyInArrow(score, f"id {kind}, {counts}, groups_sha256 string, n_best bigint, count_sum bigint")
    out = materialize(scored)
    discard(written, counted)
    return out


def op11_crosstokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment_counts(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")
