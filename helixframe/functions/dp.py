"""Affine-gap alignment of many pairs of short sequences at once, in numpy: the kernel that runs inside Arrow tasks.

Alignments are grown from their right end to the left: the first `end_len` columns from the right are matches, and the
score of every part from the right end on stays above 0. Tables therefore run over reversed sequences: row i stands for
the last i bases of the query, column j for the last j of the reference.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np


@dataclass(frozen=True)
class Scoring:
    match: int = 1
    mismatch: int = 3
    gap_open: int = 5
    gap_extend: int = 2
    min_score: int = 30

    def max_gap(self, length: int) -> int:
        """The bases that all gaps of an alignment of so many query bases can hold with a score of min_score or more."""
        return max(0, (length * self.match - self.min_score - self.gap_open) // self.gap_extend)


@lru_cache(maxsize=None)
def lost_mers(budget: int, q: int, sc: Scoring) -> int:
    """The most of a query's q-mers that edits which cost `budget` of its full score can change."""
    best = [0] * (max(0, budget) + 1)
    for c in range(1, budget + 1):
        best[c] = best[c - 1]
        if c >= sc.match + sc.mismatch:
            best[c] = max(best[c], best[c - sc.match - sc.mismatch] + q)
        if c >= sc.gap_open + sc.gap_extend:  # bases of the reference left out
            best[c] = max(best[c], best[c - sc.gap_open - sc.gap_extend] + q - 1)
        gap = 1
        while (cost := sc.gap_open + gap * (sc.gap_extend + sc.match)) <= c:  # bases of the query left out
            best[c] = max(best[c], best[c - cost] + q - 1 + gap)
            gap += 1
    return best[max(0, budget)]


#: Lengths of seeds to choose from: the longest that leaves two of them unchanged in any alignment that scores enough.
SEEDS = (12, 10, 8, 6, 5, 4)


@lru_cache(maxsize=None)
def seed_plan(length: int, sc: Scoring) -> tuple[int, int] | None:
    """(seed length, seeds): so many of a query's seeds at least are unchanged in every end-to-end alignment of min_score or more.

    None if no seed length of 4 or more is sure to leave one.
    """
    sure = {q: length - q + 1 - lost_mers(length * sc.match - sc.min_score, q, sc) for q in SEEDS if q <= length}
    return next(((q, t) for least in (2, 1) for q, t in sure.items() if t >= least), None)


def edits(length: int, q: int, sc: Scoring) -> int:
    """Stretches of q neighbouring q-mers that hold all that an end-to-end alignment of min_score or more changes; 0 if scores do not bound it so."""
    one, budget = sc.match + sc.mismatch, length * sc.match - sc.min_score
    if seed_plan(length, sc) is None or sc.gap_open + sc.gap_extend < one:
        return 0
    for gap in range(1, length + 1):  # a gap in the reference must cost as much as the stretches that it takes up
        if -(-(q - 1 + gap) // q) > (sc.gap_open + gap * (sc.gap_extend + sc.match)) // one:
            return 0
    return budget // one


NEVER = -15000
_CODE = np.full(256, 9, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def padded(seqs: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """(longest, n) codes of the reversed sequences and their lengths; N and padding match nothing."""
    size = np.array([len(s) for s in seqs])
    width = int(size.max(initial=0))
    code = _CODE[np.frombuffer("".join(s[::-1].ljust(width) for s in seqs).encode(), np.uint8)].reshape(len(seqs), width)
    return np.ascontiguousarray(np.where(code == 9, np.uint8(fill), code).T), size


def tables(queries: list[str], refs: list[str], sc: Scoring, local: bool, end_len: int, keep: bool):
    """(scores of the last row's diagonal ends (ref, n), best score of any cell (n), all rows of scores or None).

    A row's gaps in the query follow from a running maximum along the reference, so the loop is over query bases only.
    """
    q, qn = padded(queries, 20)
    r, _ = padded(refs, 30)
    m, width, n = len(q), len(r), len(queries)
    kind = np.int16 if (m + width + 8) * max(sc.match, sc.mismatch, sc.gap_extend) + sc.gap_open < 8000 else np.int32
    never, first, start = kind(NEVER), kind(sc.gap_open + sc.gap_extend), kind(end_len * sc.match)
    h, e = np.full((width + 1, n), never, kind), np.full((width + 1, n), never, kind)
    run = np.zeros((width + 1, n), np.int16 if m < 30000 else np.int32)
    ramp = (np.arange(width + 1) * sc.gap_extend).astype(kind)[:, None]
    ends, top = np.full((width, n), never, kind), np.full(n, NEVER, np.int32)
    rows = [h] if keep else None
    for i in range(1, m + 1):
        same = q[i - 1][None] == r
        run[1:] = np.where(same, run[:-1] + 1, 0)
        run[0] = 0
        e = np.maximum(h - first, e - kind(sc.gap_extend))
        np.putmask(e, e <= 0, never)
        diagonal = h[:-1] + np.where(same, kind(sc.match), kind(-sc.mismatch))
        np.putmask(diagonal, diagonal <= 0, never)
        if local:
            np.maximum(diagonal, np.where(run[1:] >= end_len, start, never), out=diagonal)
        elif i == end_len:
            np.maximum(diagonal, np.where(run[1:] == end_len, start, never), out=diagonal)
        row = e.copy()
        np.maximum(row[1:], diagonal, out=row[1:])
        gap, reach = row + ramp, 1
        while reach <= width:  # a running maximum in log steps, faster than accumulate over short integers
            gap[reach:] = np.maximum(gap[reach:], gap[:-reach])
            reach *= 2
        gap = gap[:-1] - ramp[1:] - kind(sc.gap_open)
        np.putmask(gap, gap <= 0, never)
        np.maximum(row[1:], gap, out=row[1:])
        h = row
        if keep:
            rows.append(h)
        last = i == qn
        if last.any():
            ends = np.where(last[None], diagonal, ends)
        if local:
            top = np.where(i <= qn, np.maximum(top, h.max(0)), top)
    return ends, top, rows


def trace(rows: list[np.ndarray], k: int, query: str, ref: str, i: int, j: int, sc: Scoring, local: bool, end_len: int) -> list[tuple[str, int]]:
    """Operations M, I, D from left to right of pair k's alignment that begins i bases before the query's end and j before the reference's.

    A base is aligned where that gives the score, from the right end on if it can; else the shortest gap in the
    reference is taken, and else the shortest in the query.
    """
    ops: list[tuple[str, int]] = []

    def put(op: str, n: int) -> None:
        if ops and ops[-1][0] == op:
            ops[-1] = (op, ops[-1][1] + n)
        else:
            ops.append((op, n))

    m, n, first = len(query), len(ref), True
    while True:
        now = int(rows[i][j, k])
        tail = query[m - i : m - i + end_len]
        if now == end_len * sc.match and i >= end_len and j >= end_len and (local or i == end_len) and tail == ref[n - j : n - j + end_len] and not set(tail) - set("ACGT"):
            put("M", end_len)
            return ops
        same = query[m - i] == ref[n - j] and query[m - i] in "ACGT" if j else False
        if j and int(rows[i - 1][j - 1, k]) > 0 and (first or int(rows[i - 1][j - 1, k]) + (sc.match if same else -sc.mismatch) == now):
            put("M", 1)
            i, j, first = i - 1, j - 1, False
            continue
        cost = lambda g: now + sc.gap_open + sc.gap_extend * g
        g = next((g for g in range(1, i) if int(rows[i - g][j, k]) == cost(g)), 0)
        if g:
            put("I", g)
            i -= g
            continue
        g = next(g for g in range(1, j) if int(rows[i][j - g, k]) == cost(g))
        put("D", g)
        j -= g


def described(query: str, ref: str, ops: list[tuple[str, int]]) -> tuple[str, str, int, int, int]:
    """(CIGAR, cs, matches, columns, edits) of aligned parts. cs names the query base first; N against N is printed as equal."""
    i = j = same = columns = edits = 0
    cs, run = [], 0

    def flush():
        nonlocal run
        if run:
            cs.append(f":{run}")
        run = 0

    for op, n in ops:
        columns += n
        if op == "M":
            for _ in range(n):
                if query[i] == ref[j]:
                    run, same = run + 1, same + 1
                else:
                    flush()
                    cs.append(f"*{query[i]}{ref[j]}".lower())
                    edits += 1
                i, j = i + 1, j + 1
        else:
            flush()
            edits += n
            if op == "I":
                cs.append("+" + query[i : i + n].lower())
                i += n
            else:
                cs.append("-" + ref[j : j + n].lower())
                j += n
    flush()
    return "".join(f"{n}{op}" for op, n in ops), "".join(cs), same, columns, edits


def local_scores(queries: list[str], refs: list[str], sc: Scoring, end_len: int) -> np.ndarray:
    """The best local score of each pair, under sc.min_score where there is none."""
    out = np.full(len(queries), NEVER, np.int64)
    order = sorted((i for i in range(len(queries)) if len(queries[i]) >= end_len and refs[i]), key=lambda i: (len(queries[i]), len(refs[i])))
    for at in range(0, len(order), 512):
        ids = order[at : at + 512]
        out[ids] = tables([queries[i] for i in ids], [refs[i] for i in ids], sc, True, end_len, False)[1]
    return out


def local_bounds(q: np.ndarray, r: np.ndarray, diagonals: int, sc: Scoring) -> np.ndarray:
    """What no local alignment on so many diagonals scores more than: q (length, n) against r (length + diagonals, n), codes from left to right.

    Between gaps an alignment runs along one diagonal. Stretches of diagonals are chained along the query as they score
    best, each but the first at the price of the shortest gap, wherever in the reference the next one lies.
    """
    gap, kind = sc.gap_open + sc.gap_extend, np.int8 if len(q) * sc.match + sc.gap_open + sc.gap_extend + sc.mismatch < 120 else np.int32
    inside, best = np.zeros((diagonals, q.shape[1]), kind), np.zeros(q.shape[1], kind)
    for i, letter in enumerate(q):
        step = (r[i : i + diagonals] == letter).astype(kind)
        step *= kind(sc.match + sc.mismatch)
        step -= kind(sc.mismatch)
        np.maximum(inside, np.maximum(best - kind(gap), 0), out=inside)
        inside += step
        np.maximum(best, inside.max(0), out=best)
    return best.astype(np.int64)


def align(queries: list[str], refs: list[str], cores: list[int], sc: Scoring, local: bool, end_len: int) -> list[list[tuple]]:
    """Per pair its alignments (score, qst, qen, rst, ren, cigar, cs, mlen, blen, ed) of min_score or more.

    End to end: the best one that begins at each of the first `core` bases of the reference, its first column an aligned
    base; local: all places where the best score is reached. Most candidates score too low: scores alone come first,
    and tables to trace back through only for the rest. Pairs of like lengths share a table.
    """
    out: list[list[tuple]] = [[] for _ in queries]
    order = sorted((i for i in range(len(queries)) if len(queries[i]) >= end_len and refs[i]), key=lambda i: (len(queries[i]), len(refs[i])))

    def starts(ends: np.ndarray, ids: list[int]) -> np.ndarray:
        """Scores (ref, n) of alignments that begin in the core; row j stands for the last j + 1 bases."""
        size, core = np.array([len(refs[i]) for i in ids]), np.array([cores[i] for i in ids])
        j = np.arange(1, len(ends) + 1)[:, None]
        return np.where((j <= size) & (j > size - core), ends, NEVER)

    good = []
    for at in range(0, len(order), 512):
        ids = order[at : at + 512]
        ends, top, _ = tables([queries[i] for i in ids], [refs[i] for i in ids], sc, local, end_len, False)
        top = top if local else starts(ends, ids).max(0, initial=NEVER)
        good += [i for i, x in zip(ids, top) if x >= sc.min_score]
    at = 0
    while at < len(good):
        m, width = len(queries[good[at]]), max(len(refs[good[at]]), 1)
        ids = good[at : at + max(1, min(2048, 8_000_000 // ((m + 1) * (width + 1))))]
        ids = [i for i in ids if len(queries[i]) <= m * 5 // 4 + 8]
        at += len(ids)
        ends, top, rows = tables([queries[i] for i in ids], [refs[i] for i in ids], sc, local, end_len, True)
        begin = starts(ends, ids)
        for k, i in enumerate(ids):
            q, r = queries[i], refs[i]
            if local:
                spots = [(a, int(b)) for a in range(1, len(q) + 1) for b in np.flatnonzero(rows[a][: len(r) + 1, k] == top[k])]
            else:
                spots = [(len(q), int(b) + 1) for b in np.flatnonzero(begin[:, k] >= sc.min_score)]
            for a, b in spots:
                score = int(top[k]) if local else int(begin[b - 1, k])
                if not local:  # the first column is an aligned base, whatever scores more there
                    kept, rows[a][b, k] = rows[a][b, k], score
                ops = trace(rows, k, q, r, a, b, sc, local, end_len)
                if not local:
                    rows[a][b, k] = kept
                qs, rs = len(q) - a, len(r) - b
                qe = qs + sum(n for op, n in ops if op != "D")
                re_ = rs + sum(n for op, n in ops if op != "I")
                out[i].append((score, qs, qe, rs, re_, *described(q[qs:qe], r[rs:re_], ops)))
    return out
