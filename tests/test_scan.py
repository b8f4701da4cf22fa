import random

import numpy as np
import pyarrow as pa
from sequence_samples import asked, sources
from test_align import plain

from helixframe.functions import scan
from helixframe.functions.dp import Scoring, local_bounds, local_scores, padded
from helixframe.operators import align as al
from helixframe.operators import exact, rare
from helixframe.plans.lineage import discard
from helixframe.sources.sequences import both_strands


def test_strings_are_found_where_they_lie(monkeypatch):
    monkeypatch.setattr(scan, "UNIT", 100)
    monkeypatch.setattr(scan, "PAIRS", 7)
    rng = random.Random(4)
    for bits, letters in ((2, "ACGT"), (3, "ACGTN")):
        rows = ["".join(rng.choice("AAT" if i % 2 else "ACGTN") for _ in range(rng.randint(0, 60))) for i in range(30)]
        strings = [(r[a : a + n]) for r in rows for a in range(0, len(r), 9) for n in (1, 4, 13, 20) if a + n <= len(r) and not set(r[a : a + n]) - set(letters)]
        size = np.array([len(x) for x in strings])
        held = scan.Strings(size, scan.numbers([x.encode() for x in strings], size, bits), bits)
        batch = pa.RecordBatch.from_arrays([pa.array([r.encode() for r in rows], pa.binary()), pa.array(range(len(rows)))], ["raw", "i"])
        got = []
        for (i,), raw, starts, _ in scan.texts([batch]):
            for at, who in held.pairs(raw):
                row = np.searchsorted(starts, at, "right") - 1
                got += zip(i[row].tolist(), (at - starts[row]).tolist(), who.tolist())
        assert sorted(got) == sorted((i, p, w) for i, r in enumerate(rows) for w, x in enumerate(strings) for p in range(len(r)) if r.startswith(x, p))


def test_local_bound_is_never_under_the_score():
    rng, sc = random.Random(6), Scoring(min_score=5)
    low = 0
    for _ in range(200):
        q = "".join(rng.choice("ACT") for _ in range(rng.randint(4, 40)))
        r = "".join(rng.choice("ACTN") for _ in range(5)) + q[: rng.randint(1, 20)] + rng.choice(["", "GG", "G"]) + q[rng.randint(5, 25) :] + "AC"
        codes, text = padded([q[::-1]], 5)[0], padded([("N" * len(q) + r + "N" * len(q))[::-1]], 4)[0]
        bound, score = local_bounds(codes, text, len(text) - len(q), sc)[0], local_scores([q], [r], sc, 2)[0]
        assert bound >= score
        low += bound < len(q)
    assert low > 50


def test_best_local_against_plain_recurrence(spark, monkeypatch):
    monkeypatch.setattr(rare, "BLOCK", 64)
    rng, sc = random.Random(9), Scoring(min_score=18)
    bases = ["".join(rng.choice("AACT") for _ in range(n)) for n in (30, 45, 60)] + ["CAT" * 12]
    texts = ["", "ACG", *("".join(rng.choice("AACTG") for _ in range(rng.randint(0, 90))) + b[a : a + 28] + rng.choice(["", "G"]) + b[a + 28 :] + "TTGA" * 20 for b in bases for a in (0, 5, 5, 12))]
    ref = both_strands(sources(spark, *texts)).persist()
    seqs = al.by_sequence(asked(spark, **{f"q{i}": b for i, b in enumerate([*bases, "ACGT", "GGCGCGGCCGCGCCGGCGGC"])}))[1]
    found = al.best_local(seqs, ref, sc, None, 11).collect()
    rows = ref.collect()
    best = {q: max(plain(q, r.seq, sc, True, 11)[1] for r in rows) for q in bases}
    assert {q: max(x.score for x in found if x.seq == q) for q in bases} == best
    by = {r.sid: r.seq for r in rows}
    assert all(by[x.sid][x.rst : x.ren] == x.rs for x in found)
    # The hits of one window search, where every window is aligned, lead to the same rows.
    want = al.hits(seqs, ref, sc, None, True, 11).collect()
    first = lambda rows: {q: min((-x.score, x.rs, x.qst, x.sid, x.rst) for x in rows if x.seq == q) for q in bases}
    assert first(found) == first(want)


def shuffled(spark) -> int:
    some = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(some.apply(i).totalShuffleWrite() for i in range(some.size()))


def test_no_position_of_the_reference_is_shuffled(spark):
    """Searches deal out the reference itself; a row for each position would be many times that."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("AACTTG") for _ in range(20_000)) for _ in range(20)]
    ref = both_strands(sources(spark, *texts)).persist()
    bases = sum(map(len, texts)) * 2
    queries = asked(spark, **{f"q{i}": texts[i % 20][i * 37 : i * 37 + 60] for i in range(30)})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seqs = al.by_sequence(queries)[1]
        for search in (lambda: al.hits(seqs, ref, Scoring(), None, False, 1), lambda: al.best_local(seqs, ref, Scoring(), None, 11), lambda: exact.occurrences(queries, ref)):
            before = shuffled(spark)
            assert search().count() >= 30
            assert shuffled(spark) - before < 5 * bases
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_append_leaves_no_scratch_tables(spark, tmp_path):
    """What stays in the shared folder after building, saving and adding is what was asked for, and small tables by block."""
    from pathlib import Path

    from helixframe.operators.index import Index
    from helixframe.operators.search import SearchIndex

    def shared() -> dict[str, set[str]]:
        return {str(p): set(spark.read.parquet(str(p)).columns) for p in (Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")) / "_shared").glob("helix-*") if list(p.glob("*.parquet"))}

    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGT") for _ in range(80)) for _ in range(12)]
    before = shared()
    index = Index.build(sources(spark, *texts[:8]))
    SearchIndex.save(index, str(tmp_path / "a"))
    discard(index.sa)
    out = SearchIndex.load(spark, str(tmp_path / "a")).append(sources(spark, *texts[8:]), str(tmp_path / "b"))
    left = [c for p, c in shared().items() if p not in before]
    assert not [c for c in left if {"sid", "pos"} & c]
    assert out.sa.count() == 81 * 24
