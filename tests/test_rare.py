import random

import numpy as np
import pytest
from sequence_samples import asked, sources
from test_align import plain

from helixframe.functions.dp import Scoring
from helixframe.functions.near import distances
from helixframe.operators import align as al
from helixframe.operators import rare
from helixframe.sources.sequences import both_strands


def edited(rng, q, n):
    q = list(q)
    for _ in range(n):
        i = rng.randrange(len(q) + 1)
        q[i : i + rng.choice([0, 1, 1, 1, 2])] = [rng.choice("ACGT")] * rng.choice([0, 1, 1, 1, 2])
    return "".join(q)


def test_distances_against_plain_table():
    rng = random.Random(1)
    queries, refs = [""], ["ACGT"]
    for m in (1, 5, 32, 63, 64, 65, 128, 129, 200) * 12:
        queries.append("".join(rng.choice("ACGTN") for _ in range(m)))
        refs.append(("ACGT" * 5)[: rng.randint(0, 20)] + edited(rng, queries[-1], rng.randint(0, 6))[: rng.randint(1, 210)] + "CA")
    got = distances(queries, refs)
    for q, r, d in zip(queries, refs, got):
        row = [0] * (len(r) + 1)
        for i, a in enumerate(q, 1):
            above, row = row, [i]
            for j, b in enumerate(r, 1):
                row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (not a == b != "N")))
        assert d == min(row)
    assert len(distances([], [])) == 0


def test_pieces_have_the_least_sum():
    from itertools import combinations

    rng = random.Random(3)
    for _ in range(40):
        m, n = rng.randint(8, 16), rng.randint(1, 3)
        parts = [(a, s) for a in range(m) for s in range(4, 7) if a + s <= m]
        if n * 4 > m:
            continue
        cost = {p: rng.randint(0, 9) for p in parts}
        st, size = (np.array([p[k] for p in parts]) for k in (0, 1))
        laid = rare.lay(m, n, st, size, np.array([cost[p] for p in parts]))
        apart = lambda c: all(a + s <= b for (a, s), (b, _) in zip(c, c[1:]))
        assert len(laid) == n and apart(laid)
        assert sum(cost[p] for p in laid) == min(sum(cost[p] for p in c) for c in combinations(sorted(parts), n) if apart(c))


def test_no_edits_touch_more_pieces_than_counted():
    """Random edits within the cost leave one of any pieces unchanged, and no more bases are edited than allowed."""
    rng = random.Random(8)
    for _ in range(3000):
        sc, m = Scoring(min_score=rng.choice([16, 24, 30])), rng.randint(30, 80)
        n = rare.pieces_needed(m, sc)
        left, changed, ed = m - sc.min_score, set(), 0
        while left >= 4:
            kind, g, i = rng.choice("XXID"), rng.randint(1, 12), rng.randrange(1, m - 12)
            cost = {"X": 4, "I": 5 + 3 * g, "D": 5 + 2 * g}[kind]
            if cost > left:
                left -= 1
                continue
            left -= cost
            ed += 1 if kind == "X" else g
            changed |= {i} if kind == "X" else set(range(i, i + g)) if kind == "I" else {i - 0.5}
        assert ed <= rare.edits_allowed(m, sc)
        cuts = sorted(rng.sample(range(m - n * rare.SHORTEST + 1), min(n, m - n * rare.SHORTEST + 1)))
        cuts = [c + rare.SHORTEST * k for k, c in enumerate(cuts)]
        pieces = [(a, b) for a, b in zip(cuts, cuts[1:] + [m])]
        if len(pieces) == n:
            assert any(not any(a <= c < b and not (c % 1 and c < a) for c in changed) for a, b in pieces)


@pytest.mark.parametrize("score, size", [(16, 32), (30, 70)])
def test_low_scores_and_whole_items_against_plain_recurrence(spark, score, size, monkeypatch):
    """Every begin of an alignment that scores enough, among repetitive letters, N, and sequences cut into several blocks."""
    monkeypatch.setattr(rare, "BLOCK", 64)
    rng, sc = random.Random(score), Scoring(min_score=score)
    bases = ["".join(rng.choice("AAACT" if i else "ACGT") for _ in range(size)) for i in range(2)]
    bases.append("CAT" * (size // 3))
    bases.append(bases[0][:20] + "N" + bases[0][21:])
    texts = [rng.choice(["", "GATTACA", "CATCATCAT" * 9]) + edited(rng, b, n) + "GGC" * rng.randint(0, 3) for b in bases for n in (0, 1, 3, 5, 8)]
    ref = both_strands(sources(spark, *texts, "", "N")).persist()
    seqs = al.by_sequence(asked(spark, **{f"q{i}": b for i, b in enumerate([*bases, "ACG", ""])}))[1]
    got = {(r.seq, r.sid, r.rst, r.score) for r in al.hits(seqs, ref, sc, None, False, 1).collect()}
    want = {(q, r.sid, b, s) for r in ref.collect() for q in bases for b, s in plain(q, r.seq, sc, False, 1)[0].items() if s >= score}
    assert got == want and len({q for q, *_ in want}) == 4 and len({s for *_, s in want}) > 5
