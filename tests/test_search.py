"""Searches in a saved order against brute force, common prefixes, sources and sinks, and streams that restart."""

import random

import pytest
from sequence_samples import asked, sources

from helixframe.functions.dp import Scoring
from helixframe.operators import align as al
from helixframe.operators import exact, kmers, search
from helixframe.operators.index import Index
from helixframe.operators.search import SearchIndex
from helixframe.plans import common_prefix
from helixframe.plans.common_prefix import common_prefixes
from helixframe.sources.sequences import both_strands, read_bwt, read_fastx, write_bwt, write_fastx
from helixframe.streaming.search import commits, stream_append, stream_mem


def occ(text, s):
    return sum(text[i : i + len(s)] == s for i in range(len(text) - len(s) + 1))


def sample_sequences():
    rng = random.Random(8)
    base = "".join(rng.choice("ACGTN") for _ in range(90))
    other = "".join(rng.choice("ACGT") for _ in range(50))
    return [base, base[10:70], base[:40] + other, other + base[50:], base, "A" * 60, "A" * 60, "", "NNN", "ACGT" * 9, "".join(rng.choice("AC") for _ in range(60))]


@pytest.fixture(scope="module")
def built(spark):
    out = Index.build(sources(spark, *sample_sequences()))
    out.sa = out.sa.persist()
    return out


@pytest.fixture(scope="module")
def saved(spark, built, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("order") / "x")
    SearchIndex.save(built, path, (4, 9))
    return SearchIndex.load(spark, path, (4, 9))


@pytest.mark.parametrize("stretch", [1 << 16, 16])
def test_common_prefixes_against_brute_force(built, stretch, monkeypatch):
    monkeypatch.setattr(common_prefix, "STRETCH", stretch)
    texts = {r.sid: r.seq for r in built.sequences.collect()}
    rows = common_prefixes(built.sequences, built.sa).orderBy("rk").collect()
    before = ""
    assert [(r.rk, r.sid, r.pos, r.sym) for r in rows] == [(r.rk, r.sid, r.pos, r.sym) for r in built.sa.orderBy("rk").collect()]
    for r in rows:
        here = texts[r.sid][r.pos :]
        assert r.lcp == next((i for i, (a, b) in enumerate(zip(before, here)) if a != b), min(len(before), len(here)))
        before = here


def sample_queries():
    rng = random.Random(5)
    seqs = sample_sequences()
    out = {f"q{i}": seqs[0][i * 7 : i * 7 + 30] + "".join(rng.choice("ACG") for _ in range(i * 3)) + seqs[3][20:40] for i in range(7)}
    return out | {"empty": "", "a": "A" * 12, "long_a": "A" * 70, "t": "TTTT", "n": "NN", "one": "G", "none": "GGGGGGGGGGGGGGGGCCCCCCCCCCCCCCCC", "whole": seqs[0], "tail": "GGTCGGTC" + seqs[9][-3:], "twin": seqs[0], "z": "ACGTN"}


@pytest.mark.parametrize("small", [False, True])
def test_searches_against_brute_force(spark, built, saved, small, monkeypatch):
    if small:
        monkeypatch.setattr(search, "BLOCK", 32)
        monkeypatch.setattr(search, "RANGES", 3)
    texts = [r.seq for r in built.sequences.collect()]
    queries = sample_queries()
    q = asked(spark, **queries)
    total = lambda s: sum(occ(t, s) for t in texts) if s else 0
    assert {r.name: r.cnt for r in saved.count(q).collect()} == {n: total(s) for n, s in queries.items()}
    suffix = {r.name: (r.st, r.qlen, r.cnt) for r in saved.suffix(q).collect()}
    for n, s in queries.items():
        st = next((x for x in range(len(s)) if total(s[x:])), len(s))
        assert suffix[n] == (st, len(s), total(s[st:]))
    for least, c in ((4, 1), (6, 2), (12, 3), (3, 1)):
        got = sorted((r.name, r.st, r.en, r.cnt) for r in saved.mem(q, least, c).collect())
        want = []
        for n, s in queries.items():
            reach = {}
            for x in range(len(s)):
                e = next((e for e in range(len(s), x + least - 1, -1) if total(s[x:e]) >= c), None)
                if e:
                    reach[x] = e
            want += [(n, x, e, total(s[x:e])) for x, e in reach.items() if reach.get(x - 1, -1) < e]
        assert got == sorted(want)
    assert {r.name for r in saved.present(q, 10).collect()} == {n for n, s in queries.items() if any(total(s[i : i + 10]) for i in range(len(s) - 9))}


@pytest.mark.parametrize("k, least", [(3, 2), (9, 2), (37, 2), (50, 1)])
def test_kount_of_one_saved_order(spark, saved, k, least):
    got = sorted(map(tuple, search.kount([saved], k, least).collect()))
    assert got == sorted(map(tuple, kmers.kount([sources(spark, *sample_sequences())], k, least).collect())) and got


def test_kount_of_several_saved_orders(spark, saved, tmp_path):
    rows = sources(spark, "ACGT" * 4, sample_sequences()[0][5:60], "CC")
    SearchIndex.save(Index.build(rows), str(tmp_path / "b"), (4, 9))
    other = SearchIndex.load(spark, str(tmp_path / "b"), (4, 9))
    for k, least in ((3, 9), (12, 3), (34, 2)):
        want = kmers.kount([sources(spark, *sample_sequences()), rows], k, least)
        assert sorted(map(tuple, search.kount([saved, other], k, least).collect())) == sorted(map(tuple, want.collect()))


def test_positions_in_suffix_order(spark, built, saved):
    """Of the places of a match the first in the order, and all of them where there are no more."""
    texts = {r.sid: (r.name, r.strand, r.seq) for r in built.sequences.collect()}
    queries = sample_queries()
    got = saved.mem_positions(asked(spark, **queries), 6, 1, 3).collect()
    assert len(got) == saved.mem(asked(spark, **queries), 6, 1).count()
    for r in got:
        s = queries[r.name][r.st : r.en]
        places = [(seq[i:].replace("N", "Z") + "$", sid, name, strand, i if not strand else len(seq) - i - len(s)) for sid, (name, strand, seq) in texts.items() for i in range(len(seq) - len(s) + 1) if seq[i : i + len(s)] == s]
        assert r.cnt == len(places) and r.n_pos == min(3, len(places))
        assert [tuple(p) for p in r.pos] == [(n, "+-"[d], p) for _, _, n, d, p in sorted(places)[:3]]


@pytest.mark.parametrize("case", ["mixed", "copies", "first", "nothing", "far"])
def test_append_against_a_build(spark, built, saved, tmp_path, case, monkeypatch):
    seqs = sample_sequences()
    new = {
        "mixed": [seqs[0][3:50] + "ACGTAC", "", "NAN", seqs[3], "G", "A" * 61, "TTTTTTTTTTTTTT"],
        "copies": [seqs[0], seqs[0], seqs[5], seqs[8], ""],
        "first": ["A" * 200, "AAAA"],
        "nothing": [],
        "far": ["NNNNNNNN", "TTTTTTTT", "C"],
    }[case]
    monkeypatch.setattr(search, "BLOCK", 64)
    rows = spark.createDataFrame([(i, f"new{i}", s) for i, s in enumerate(new)], "src_id long, name string, seq string")
    grown = saved.append(rows, str(tmp_path / "g"))
    whole = Index.build(sources(spark, *seqs, *new))
    want = common_prefixes(whole.sequences, whole.sa.persist()).orderBy("rk").collect()
    got = grown.sa.orderBy("rk").collect()
    assert [(r.rk, r.sid, r.pos, r.sym, r.lcp) for r in got] == [(r.rk, r.sid, r.pos, r.sym, r.lcp) for r in want]
    texts = {r.sid: r.seq.replace("N", "Z") for r in whole.sequences.collect()}
    assert all(r.key == (texts[r.sid][r.pos : r.pos + 32] if r.lcp < 32 else None) for r in got)


def test_empty_order(spark, tmp_path):
    SearchIndex.save(Index.build(sources(spark)), str(tmp_path / "e"))
    index = SearchIndex.load(spark, str(tmp_path / "e"))
    q = asked(spark, a="ACGT" * 6, b="")
    assert index.mem(q).count() == 0 and index.present(q, 5).count() == 0
    assert sorted((r.name, r.cnt) for r in index.count(q).collect()) == [("a", 0), ("b", 0)]
    assert sorted(tuple(r) for r in index.suffix(q).collect()) == [("a", 24, 24, 0), ("b", 0, 0, 0)]
    assert search.kount([index], 5, 1).count() == 0


def test_index_search_reads_no_other_ranges(saved):
    """The rows of the order are asked for by ranges that the scan can hold against its statistics."""
    cut = saved.sa.where("rk = 3").selectExpr("rk div 4096 as block")
    assert "PushedFilters: [" in (plan := saved.rows_near(cut, ["sid"])._jdf.queryExecution().toString()) and "rk" in plan.split("PushedFilters: [")[1].split("]")[0]


# What the verdict of the round before found to differ


def test_occurrences_listed_up_to_the_cap(spark):
    """An allele with three places: all of them are counted as listed, also by the hit that crosses the cap."""
    core = "ACGTTGCATGCCATAGCATTACGATCGATCGGATTAACGG"
    snp = core[:20] + "C" + core[21:]
    ref = both_strands(sources(spark, "GG" + core, core + "T", "C" + core + "A", snp))
    for cap, want in ((None, (2, 4, 4)), (1, (2, 3, 4)), (4, (2, 4, 4))):
        head = al.all_e2e(asked(spark, q=core), ref, Scoring(min_score=34), max_total=cap)[0].first()
        assert (head.n_allele, head.n_out, head.total) == want


def test_haplotype_windows_are_all_k_long(spark):
    core = "ACGTTGCATGCCATAGCATTACGATCGATCGGATTAACGGTTTCACA"
    ref = both_strands(sources(spark, core))
    rows = al.hapdiv(asked(spark, q=core, short=core[:29]), ref, 30, 5, Scoring(min_score=26)).collect()
    assert [(r.name, r.st, r.en, r.n_al, r.h0) for r in rows] == [("q", 0, 45, 1, 1)]


def greedily(hits):
    """Hits (rs, score, cnt) one by one, each held against those kept before it."""
    kept = []
    for rs, score, cnt in sorted(hits, key=lambda h: (-h[1], h[0])):
        inside = lambda a, b: a.startswith(b) or a.endswith(b)
        if not any(inside(rs, k) or (cnt == n and inside(k, rs)) for k, _, n in kept):
            kept.append((rs, score, cnt))
    return kept


def test_containment_in_kept_hits_only(spark):
    rng = random.Random(1)
    cases = {0: [("ACGT", 10, 5), ("ACGTTT", 9, 2), ("GGACGTTT", 8, 1)], 1: [("ACGTA", 9, 2), ("ACGT", 8, 2), ("CGTA", 7, 3), ("TACGTA", 6, 1)], 2: [("A", 3, 9)]}
    for i in range(3, 60):
        strings = {"".join(rng.choice("AC") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))}
        cases[i] = [(s, rng.randint(1, 5), rng.randint(1, 3)) for s in strings]
    assert greedily(cases[0]) == [("ACGT", 10, 5), ("GGACGTTT", 8, 1)]
    one = spark.createDataFrame([(q, rs, s, n) for q, hits in cases.items() for rs, s, n in hits], "qid long, rs string, score long, cnt long")
    got = sorted((r.qid, r.rs) for r in al.greedy(one).collect())
    assert got == sorted((q, rs) for q, hits in cases.items() for rs, _, _ in greedily(hits))


# Sources


def test_records_over_several_lines(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@q1 c\r\nAC\nGT\n+\n@I\n>I\n\n@q2\nACGT\n+q2\n@+>I\n@q3\nA\n+\nI\n@q4 none\nACG\nT\n")
    (tmp_path / "b.fq").write_text("@r1\nACGT\n+\n>III\n@r2\nAC\n+q2\n@@\n\n")
    (tmp_path / "c.fa").write_text("\n>x one\nACGT\n\nNNac\n>y\n>z@2\nGG")
    (tmp_path / "d.fq").write_text("")
    rows = read_fastx(spark, [str(tmp_path / f) for f in ("a.fq", "b.fq", "c.fa", "d.fq")]).collect()
    got = sorted((r.file[-4:], r.record, r.name, r.comment, r.seq, r.qual) for r in rows)
    assert got == [
        ("a.fq", 0, "q1", "c", "ACGT", "@I>I"), ("a.fq", 1, "q2", "", "ACGT", "@+>I"), ("a.fq", 2, "q3", "", "A", "I"), ("a.fq", 3, "q4", "none", "ACGT", None),
        ("b.fq", 0, "r1", "", "ACGT", ">III"), ("b.fq", 1, "r2", "", "AC", "@@"), ("c.fa", 0, "x", "one", "ACGTNNAC", None), ("c.fa", 1, "y", "", "", None), ("c.fa", 2, "z@2", "", "GG", None),
    ]
    for bad in ("@q\nACGT\n+\nII\n", "@q\nAC\nGT\n+\nIII", "@q\nAC\n+\nIII\n"):
        (tmp_path / "bad.fq").write_text(bad)
        with pytest.raises(Exception, match="quality of another length"):
            read_fastx(spark, str(tmp_path / "bad.fq")).collect()


def test_records_split_and_zipped(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"s{i}", "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 200)))) for i in range(300)]
    frame = spark.createDataFrame(rows, "name string, seq string").coalesce(1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        for quality in (None, "@", "+"):
            path = str(tmp_path / f"x{quality}")
            write_fastx(frame, path, quality)
            got = read_fastx(spark, path)
            assert got.rdd.getNumPartitions() > 1 or quality
            assert sorted((r.name, r.seq, r.qual) for r in got.collect()) == sorted((n, s, quality and quality * len(s)) for n, s in rows)
            lines = spark.read.text(path)
            lines.coalesce(1).write.option("compression", "gzip").text(path + "z")
            assert sorted((r.name, r.seq) for r in read_fastx(spark, path + "z").collect()) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_bwt_text(spark, built, tmp_path):
    want = [r.sym for r in built.sa.orderBy("rk").collect()]
    write_bwt(built.bwt(), str(tmp_path / "t"))
    assert [r.sym for r in read_bwt(spark, str(tmp_path / "t")).orderBy("rk").collect()] == want
    (tmp_path / "a.txt").write_text("AC\n$gx$")
    (tmp_path / "b.txt").write_text("$TT")
    (tmp_path / "c.txt").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2")
    try:
        rows = read_bwt(spark, [str(tmp_path / x) for x in ("b.txt", "c.txt", "a.txt", "b.txt")]).orderBy("rk").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "".join(r.sym for r in rows) == "$TT" + "AC$$GN$" + "$TT" and [r.rk for r in rows] == list(range(13))


# Streams


def test_growing_index_restarts(spark, tmp_path):
    path, check = str(tmp_path / "index"), str(tmp_path / "checkpoint")
    schema = "name string, seq string"

    def arrives(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "q"))

    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "q"))
    text = lambda x: "".join(r.sym for r in x.bwt().orderBy("rk").collect())
    arrives(("a", "ACGT"), ("b", "GG"))
    first = text(stream_append(stream(), path, check))
    assert text(stream_append(stream(), path, check)) == first  # nothing new
    arrives(("c", "TTA"))
    second = text(stream_append(stream(), path, check))
    assert len(second) == len(first) + 8 and [c.version for c in commits(spark, path)] == [0, 1]
    # The stream loses its own commit of the last batch: the batch runs again and replaces its version.
    for f in (tmp_path / "checkpoint" / "commits").glob("*1*"):
        f.unlink()
    assert text(stream_append(stream(), path, check)) == second and [c.version for c in commits(spark, path)] == [0, 1]
    # Another checkpoint reads the stream from its beginning and goes on from the version that is there.
    third = stream_append(stream(), path, str(tmp_path / "other"))
    assert third.sequences.count() == 12 and [c.version for c in commits(spark, path)] == [0, 1, 2]


def test_streams_without_rows(spark, tmp_path):
    spark.createDataFrame([], "name string, seq string").write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema("name string, seq string").parquet(str(tmp_path / "q"))
    assert stream_append(stream, str(tmp_path / "i")).sa.count() == 0
    assert stream_mem(stream, both_strands(sources(spark, "ACGT" * 9))).count() == 0


def test_stream_against_a_saved_order(spark, saved, tmp_path):
    q = asked(spark, **sample_queries())
    q.repartition(2).write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema(q.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "q"))
    got = sorted(tuple(r) for r in stream_mem(stream, saved, 9).collect())
    assert got == sorted(tuple(r) for r in exact.mem(q, both_strands(sources(spark, *sample_sequences())), 9).collect())
