"""Short strings met in texts where they lie: numpy inside Arrow tasks, so that no position of a text becomes a row.

Strings of one size are numbers of some bits a letter. A text's numbers of all sizes in use follow from each other; a
small table tells most positions apart at once, and the rest are looked up among the sorted numbers of the strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Letters (A, C, G, T) as two bits; with N and any other letter as three, where equal numbers must then be compared as bytes.
_BASES, _LETTERS = np.full(256, 255, np.uint8), np.full(256, 5, np.uint8)
_BASES[np.frombuffer(b"ACGT", np.uint8)] = range(4)
_LETTERS[np.frombuffer(b"ACGTN", np.uint8)] = range(5)
_LETTERS[ord("\n")] = 255  # stands behind every text
CODES = {2: _BASES, 3: _LETTERS}
#: Letters of text that are looked at together, and pairs of a place and a string: arrays of these sizes stay small.
UNIT, PAIRS = 1 << 17, 1 << 19
#: Bits of the tables that are asked first.
FIRST = 20


def texts(batches, name: str = "raw") -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(other columns, bytes, starts, sizes) of units of some rows: their texts with a line end behind each, and where each begins."""
    for b in batches:
        raw = b.column(b.schema.get_field_index(name)).to_pylist()
        rest = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns) if b.schema.names[i] != name]
        at = 0
        while at < len(raw):
            end, total = at, 0
            while end < len(raw) and (end == at or total + len(raw[end]) < UNIT):
                total += len(raw[end]) + 1
                end += 1
            sizes = np.array([len(x) for x in raw[at:end]])
            yield [c[at:end] for c in rest], np.frombuffer(b"\n".join(raw[at:end]) + b"\n", np.uint8), np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]), sizes
            at = end


class Strings:
    """Strings as (size, number), with the ids of their owners; the same may have several."""

    def __init__(self, sizes: np.ndarray, numbers: np.ndarray, bits: int = 2):
        """The owner of entry i is i."""
        self.bits, self.by = bits, {}
        for s in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == s)
            order = mine[np.argsort(numbers[mine], kind="stable")]
            distinct, first, n = np.unique(numbers[order], return_index=True, return_counts=True)
            self.by[s] = (distinct, order, first, n)
        self.tables: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return {**self.__dict__, "tables": {}}

    def numbered(self, raw: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each size in use, the places of a text where one of its strings begins, and which of the distinct ones it is."""
        code = CODES[self.bits][raw]
        n = len(raw)
        bad = np.where(code == 255, np.arange(n), n)
        room = np.minimum.accumulate(bad[::-1])[::-1] - np.arange(n)  # letters up to the next that is in no string
        code = np.where(code == 255, 0, code).astype(np.int64)
        number = np.zeros(n, np.int64)
        mask = (1 << FIRST) - 1
        for s in range(1, max(self.by, default=0) + 1):
            number <<= self.bits
            number[: n - s + 1] += code[s - 1 :]
            if s not in self.by:
                continue
            distinct = self.by[s][0]
            if s not in self.tables:
                self.tables[s] = np.zeros(1 << FIRST, bool)
                self.tables[s][distinct & mask] = True
            at = np.flatnonzero(self.tables[s][number & mask] & (room >= s))
            which = np.searchsorted(distinct, number[at])
            same = distinct[np.minimum(which, len(distinct) - 1)] == number[at]
            yield s, at[same], which[same]

    def pairs(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, owners) of all strings that begin in a text, some at a time."""
        for s, at, which in self.numbered(raw):
            _, order, first, n = self.by[s]
            total = np.cumsum(n[which])
            begin = 0
            while begin < len(at):
                done = total[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(total, done + PAIRS, "right")))
                some = which[begin:end]
                many = n[some]
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                yield np.repeat(at[begin:end], many), order[np.repeat(first[some], many) + place]
                begin = end


def counts(strings: Strings):
    """(size, number, n): how often each of the strings, which have one owner each, begins in the texts of a task."""

    def run(batches):
        found = {s: np.zeros(len(x[0]), np.int64) for s, x in strings.by.items()}
        for _, raw, _, _ in texts(batches):
            for s, _, which in strings.numbered(raw):
                found[s] += np.bincount(which, minlength=len(found[s]))
        for s, n in found.items():
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), s, np.int32)), pa.array(strings.by[s][0][there]), pa.array(n[there])], ["size", "number", "n"])

    return run


def numbers(strings: list[bytes], size: np.ndarray, bits: int) -> np.ndarray:
    """The first size[i] letters of each string as a number."""
    out = np.zeros(len(strings), np.int64)
    for i, (x, n) in enumerate(zip(strings, size.tolist())):
        value = 0
        for c in CODES[bits][np.frombuffer(x[:n], np.uint8)].tolist():
            value = value << bits | c
        out[i] = value
    return out
