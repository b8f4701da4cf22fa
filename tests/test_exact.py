import random

import pytest
from sequence_samples import asked, sources

from helixframe.operators import exact, kmers
from helixframe.sources.sequences import both_strands, read_fastx, read_lines, read_names

SUBJECT, QUERY = "TGAACTCTACACAACATATTTTGTCACCAAG", "ACTCTACACAAGATATTTTGTCA"


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_goldens(spark):
    ref, q = both_strands(sources(spark, SUBJECT)), asked(spark, q=QUERY)
    assert rows(exact.mem(q, ref, 10), "st", "en", "cnt") == rows(exact.mem(q, ref, 11), "st", "en", "cnt") == [(0, 11, 1), (12, 23, 1)]
    assert exact.mem(q, ref, 12).count() == 0
    assert rows(exact.mem(q, ref, 3), "st", "en", "cnt") == [(0, 11, 1), (8, 12, 1), (10, 13, 1), (12, 23, 1)]
    pos = exact.mem_positions(q, ref, 10).orderBy("st").collect()
    assert [[tuple(p) for p in r.pos] for r in pos] == [[("n0", "+", 3)], [("n0", "+", 15)]]
    assert rows(exact.mem_gaps(q, ref, 10), "st", "en", "qlen") == [(11, 12, 23)]
    assert rows(exact.mem_coverage(q, ref, 10), "qlen", "cov") == [(23, 22)]
    assert rows(exact.suffix(q, ref), "st", "qlen", "cnt") == [(12, 23, 1)]
    assert rows(kmers.kount([sources(spark, SUBJECT)], 3, 3), "kmer", "cnt_1") == [("ACA", 4), ("CAA", 3), ("TGT", 4), ("TTG", 3)]
    assert rows(kmers.kount([sources(spark, "AGG", "AGC")], 2, 2), "kmer", "cnt_1") == [("AG", 2), ("CT", 2), ("GC", 2)]


def test_windows(spark):
    assert rows(kmers.fa2kmer(sources(spark, "ACGTACGTACGTA", "ACG", ""), 5, 3), "header", "seq") == [("n0:1-5", "ACGTA"), ("n0:4-8", "TACGT"), ("n0:7-13", "GTACGTA"), ("n1:1-3", "ACG")]
    assert rows(kmers.fa2line(sources(spark, "ACN")), "strand", "line") == [(0, "ACX"), (1, "XGT")]


def occ(text, s):
    return sum(text[i : i + len(s)] == s for i in range(len(text) - len(s) + 1))


def smems(q, texts, low, c):
    total = lambda s: sum(occ(t, s) for t in texts)
    reach = {}
    for x in range(len(q)):
        ends = [e for e in range(x + low, len(q) + 1) if total(q[x:e]) >= c]
        if ends:
            reach[x] = max(ends)
    return sorted((x, e, total(q[x:e])) for x, e in reach.items() if reach.get(x - 1, -1) < e)


@pytest.mark.parametrize("c", [1, 2, 3])
def test_mem_against_brute_force(spark, c):
    rng = random.Random(c)
    base = "".join(rng.choice("ACGTN") for _ in range(60))
    seqs = [base, base[10:50], "".join(rng.choice("AC") for _ in range(40)), "", "NNN", "A" * 30]
    queries = {f"q{i}": (base[i : i + 15] + "".join(rng.choice("ACG") for _ in range(10)) + base[30 : 30 + i]) for i in range(6)} | {"empty": "", "a": "A" * 12}
    ref = both_strands(sources(spark, *seqs)).persist()
    texts = [r.seq for r in ref.collect()]
    got = exact.mem(asked(spark, **queries), ref, 4, c).collect()
    for name, q in queries.items():
        assert sorted((r.st, r.en, r.cnt) for r in got if r.name == name) == smems(q, texts, 4, c)


def test_counts_suffix_locate_against_brute_force(spark):
    rng = random.Random(9)
    seqs = ["".join(rng.choice("ACG") for _ in range(80)) for _ in range(3)] + ["A" * 40, "", "ACGT"]
    queries = {"a": seqs[0][5:30], "b": "T", "c": "AAAA", "d": "", "e": "N", "f": "TTTT" + seqs[1][:7], "g": seqs[2][-20:] + "CCCCCCCCCCCCCC", "h": "GGG" + seqs[0][20:50]}
    ref = both_strands(sources(spark, *seqs)).persist()
    texts = {r.sid: (r.name, r.strand, r.seq) for r in ref.collect()}
    q = asked(spark, **queries)
    count = {r.name: r.cnt for r in exact.count(q, ref).collect()}
    places = exact.locate(q, ref).collect()
    suffix = {r.name: (r.st, r.cnt) for r in exact.suffix(q, ref, 6).collect()}
    for name, s in queries.items():
        total = sum(occ(t, s) for _, _, t in texts.values()) if s else 0
        assert count[name] == total
        want = sorted((n, "+-"[d], i if not d else len(t) - i - len(s)) for n, d, t in texts.values() for i in range(len(t) - len(s) + 1) if s and t[i : i + len(s)] == s)
        assert sorted((r.ctg, r.strand, r.pos) for r in places if r.name == name) == want
        st = next((x for x in range(len(s)) if any(s[x:] in t for _, _, t in texts.values())), len(s))
        assert suffix[name] == (st, sum(occ(t, s[st:]) for _, _, t in texts.values()) if st < len(s) else 0)
    assert {r.name for r in exact.present(q, ref, 10).collect()} == {n for n, s in queries.items() if any(s[i : i + 10] in t for i in range(len(s) - 9) for _, _, t in texts.values())}


def test_sources(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one\nACGT\nNNac\n>y\n>z@2\nGG")
    (tmp_path / "b.fq").write_text("@q1 c\nACGT\n+\n>III\n@q2\nAC\n+q2\n@@\n")
    got = rows(read_fastx(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fq")]), "name", "comment", "seq")
    assert got == [("q1", "c", "ACGT"), ("q2", "", "AC"), ("x", "one", "ACGTNNAC"), ("y", "", ""), ("z@2", "", "GG")]
    (tmp_path / "bad.fq").write_text("@q1\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="quality of another length"):
        read_fastx(spark, str(tmp_path / "bad.fq")).collect()
    (tmp_path / "l.txt").write_text("acgt\n\nNN-\n")
    assert sorted(r.seq for r in read_lines(spark, str(tmp_path / "l.txt")).collect()) == ["", "ACGT", "NNN"]
    (tmp_path / "n.len").write_text("a\t10\nb\t0\nc\n")
    assert rows(read_names(spark, str(tmp_path / "n.len")), "name", "len") == [("a", 10)]
