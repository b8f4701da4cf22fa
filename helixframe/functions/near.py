"""Edit distances of many short queries to the best-fitting part of a window each, by bit vectors in numpy.

A column of the distance table is kept as the bits of its steps up and down, 64 query bases a word, and moves along the
window by a few word operations (Myers 1999; carries between words as in Hyyrö 2003). All pairs of a batch move at once.
"""

from __future__ import annotations

import numpy as np

from .dp import padded

ONE, TOP = np.uint64(1), np.uint64(63)
#: Pairs that share a table: their words stay in the cache.
TOGETHER = 4096


def equal_bits(code: np.ndarray, words: int) -> np.ndarray:
    """(5, words, n): for each letter the query places that hold it; the last is for letters that match nothing."""
    m, n = code.shape
    bits = np.zeros((5, 64 * words, n), np.uint8)
    for letter in range(4):
        bits[letter, :m] = code == letter
    packed = np.packbits(bits, axis=1, bitorder="little")  # (5, 8 * words, n)
    return np.ascontiguousarray(packed.reshape(5, words, 8, n).transpose(0, 1, 3, 2)).view("<u8")[..., 0]


def fit(bits: np.ndarray, which: np.ndarray, size: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The least number of edits between queries which[i], of size[i] bases, and any part of column i of the letters r (window, n). bits: equal_bits() of the queries."""
    n, words, queries = len(which), bits.shape[1], bits.shape[2]
    same = [np.ascontiguousarray(bits[:, w]).ravel() for w in range(words)]
    last_word, last_bit = np.maximum(size - 1, 0) // 64, (np.maximum(size - 1, 0) % 64).astype(np.uint64)
    up, down = np.full((words, n), np.iinfo(np.uint64).max, np.uint64), np.zeros((words, n), np.uint64)
    score = size.astype(np.int32)
    best = score.copy()
    for letters in r:
        rise = fall = np.zeros(n, np.uint64)  # the window may be entered anywhere: no step along its upper edge
        at = letters * np.int64(queries) + which
        for w in range(words):
            eq, pv, mv = same[w].take(at), up[w], down[w]
            xv = eq | mv
            eq = eq | fall
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            step = ((ph >> last_bit) & ONE).astype(np.int32) - ((mh >> last_bit) & ONE).astype(np.int32)
            score += step if words == 1 else np.where(last_word == w, step, 0)
            next_rise, next_fall = ph >> TOP, mh >> TOP
            ph, mh = (ph << ONE) | rise, (mh << ONE) | fall
            up[w], down[w] = mh | ~(xv | ph), ph & xv
            rise, fall = next_rise, next_fall
        np.minimum(best, score, out=best)
    return best


def together(queries: list[str], refs: list[str]) -> np.ndarray:
    q, size = padded(queries, 4)
    r, _ = padded(refs, 4)
    return fit(equal_bits(q, max(1, -(-len(q) // 64))), np.arange(len(queries)), size, r)


def distances(queries: list[str], refs: list[str]) -> np.ndarray:
    """The least number of edits between each query and any part of its window; N matches nothing."""
    out = np.zeros(len(queries), np.int32)
    order = sorted(range(len(queries)), key=lambda i: (len(queries[i]), len(refs[i])))
    for at in range(0, len(order), TOGETHER):
        ids = order[at : at + TOGETHER]
        out[ids] = together([queries[i] for i in ids], [refs[i] for i in ids])
    return out
