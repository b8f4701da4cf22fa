"""Goldens of small collections, and properties of the index on random ones."""

import random

import pytest
from sequence_samples import sources

from helixframe.operators.index import Index


def text(index):
    return "".join(r.sym for r in index.bwt().orderBy("rk").collect())


@pytest.mark.parametrize(
    "seqs, reverse, order, expected",
    [
        (("AGG", "AGC"), False, "io", "GC$$GGAA"),
        (("AGG", "AGC"), True, "io", "GTCT$$G$CGGA$ACC"),
        (("TGAACTCTACACAACATATTTTGTCACCAAG",), True, "io", "GACCACGCAGCTACAATGACTTTAACATAATA$ATTATTTGTATCGAATGC$GTGTTAGCTGTA"),
        (("ACNGT", "GATTN"), False, "io", "TN$GA$NGATTC"),
        (("ACNGT", "GATTN"), True, "io", "TTNCN$$AGTAA$NNGGAATT$CC"),
        (("GATT", "ACA", "CATT", "TTG"), False, "io", "TATGC$GCA$T$TTTAA$"),
        (("GATT", "ACA", "CATT", "TTG"), False, "rlo", "AGTTC$CGA$T$TTTAA$"),
        (("GATT", "ACA", "CATT", "TTG"), False, "rclo", "TTGAC$GCA$T$TTTAA$"),
    ],
)
def test_goldens(spark, seqs, reverse, order, expected):
    assert text(Index.build(sources(spark, *seqs), order, True, reverse)) == expected


def brute(seqs):
    """Rows (sid, pos, symbol before) in suffix order."""
    keyed = sorted((s[p:].replace("N", "Z") + "$", sid, p, s[p - 1] if p else "$") for sid, s in seqs.items() for p in range(len(s) + 1))
    return [(sid, p, c) for _, sid, p, c in keyed]


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 60))) for _ in range(12)] + ["A" * 150, "A" * 150, "", "NNNN", "ACGT" * 30]
    out = Index.build(sources(spark, *seqs))
    out.sa = out.sa.persist()
    return out


def test_order_against_brute_force(index):
    seqs = {r.sid: r.seq for r in index.sequences.collect()}
    assert [(r.sid, r.pos, r.sym) for r in index.sa.orderBy("rk").collect()] == brute(seqs)


def test_order_by_ranges(spark, index, monkeypatch):
    """The same order where every bucket and group counts as too large for a window, half of the table being equal sequences."""
    from helixframe.plans import suffix_order

    monkeypatch.setattr(suffix_order, "MOST", 0)
    seqs = ["ACGTTGCATGCCATAGCATTACGATCGATCGGATTAACGGTACGATTT"] * 12 + ["A" * 150, "AC" * 60, "", "NNNN"] + [r.seq for r in index.sequences.where("strand = 0 and sid < 16").collect()]
    out = Index.build(sources(spark, *seqs))
    assert [(r.sid, r.pos, r.sym) for r in out.sa.orderBy("rk").collect()] == brute({r.sid: r.seq for r in out.sequences.collect()})


def test_lf_runs_stat_rank(spark, index):
    rows = index.sa.orderBy("rk").collect()
    bwt = "".join(r.sym for r in rows)
    at = {(r.sid, r.pos): r.rk for r in rows}
    lf = {r.rk: r.to for r in index.lf().collect()}
    assert sorted(lf.values()) == list(range(len(rows)))
    assert all(lf[r.rk] == at[r.sid, r.pos - 1] for r in rows if r.pos)
    runs = index.runs().orderBy("start").collect()
    assert "".join(r.sym * r.len for r in runs) == bwt
    assert all(a.sym != b.sym for a, b in zip(runs, runs[1:])) and [r.run_id for r in runs] == list(range(len(runs)))
    stat = index.stat().first()
    assert (stat.symbols, stat.runs, stat.n_a, stat.sequences) == (len(bwt), len(runs), bwt.count("A"), bwt.count("$"))
    for r in index.rank(spark.range(len(bwt)).selectExpr("id AS k")).collect():
        assert [r[f"c_{i}"] for i in range(6)] == [bwt[: r.k].count(c) for c in "$ACGTN"] and r.sym == bwt[r.k]


def test_get_locate_sample(spark, index):
    seqs = {r.sid: r.seq for r in index.sequences.collect()}
    rows = index.sa.orderBy("rk").collect()
    got = {r.k: (r.row, r.seq) for r in index.get(spark.createDataFrame([(0,), (5,), (len(seqs) + 7,), (10**6,)], "k long")).collect()}
    first = {r.sid: r.rk for r in rows if r.pos == 0}
    assert got[0] == (first[0], seqs[0]) and got[5] == (first[5], seqs[5]) and 10**6 not in got
    r = rows[len(seqs) + 7]
    assert got[len(seqs) + 7] == (first[r.sid], seqs[r.sid][: r.pos])
    found = index.locate(spark.createDataFrame([(1, 3, 40), (2, 9, 9)], "id int, lo long, hi long"), 5).collect()
    assert sorted((x.sid, x.pos) for x in found) == sorted((r.sid, r.pos) for r in rows[3:40])[:5]
    m = len(seqs)
    assert {x.rk for x in index.sample(2).collect()} == {r.rk for r in rows if r.rk >= m and (r.rk - m) % 4 == 0}


def test_merge_append_save(spark, index, tmp_path):
    a, b = ("ACNGT", "GG", ""), ("GATTN", "ACNGT")
    whole = text(Index.build(sources(spark, *a, *b)))
    assert text(Index.merge(Index.build(sources(spark, *a)), Index.build(sources(spark, *b)))) == whole
    grown = Index.build(sources(spark, *a)).append(sources(spark, *b))
    assert text(grown) == whole
    grown.save(str(tmp_path / "index"))
    assert text(Index.load(spark, str(tmp_path / "index"))) == whole


def test_rejects(spark):
    one = Index.build(sources(spark, "AC"), reverse=False)
    with pytest.raises(ValueError):
        one.require_both_strands()
    with pytest.raises(ValueError):
        Index.build(sources(spark, "AC"), forward=False, reverse=False)
    with pytest.raises(ValueError):
        Index.build(sources(spark, "AC"), order="other")
    Index.build(sources(spark, "AC")).require_both_strands()
