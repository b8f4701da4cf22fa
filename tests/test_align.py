import random

from sequence_samples import asked, sources

from helixframe.functions.alphabet import parse_size
from helixframe.functions.dp import Scoring, align, seed_plan
from helixframe.operators import align as al
from helixframe.operators import posthoc
from helixframe.sources import formats
from helixframe.sources.sequences import both_strands
from helixframe.streaming.search import stream_append, stream_mem


def plain(q, r, sc, local, end_len):
    """Scores by begin of all alignments that end with the query and begin with an aligned base, and the best of any; by the plain three-table recurrence from the right end."""
    q, r, no = q[::-1], r[::-1], -(10**6)
    m, n, o, e = len(q), len(r), sc.gap_open, sc.gap_extend
    h, v = ([[no] * (n + 1) for _ in range(m + 1)] for _ in range(2))
    ends, top = {}, no
    above = lambda x: x if x > 0 else no
    for i in range(1, m + 1):
        w = no
        for j in range(n + 1):
            v[i][j] = above(max(h[i - 1][j] - o - e, v[i - 1][j] - e))
            d = no
            if j:
                d = above(h[i - 1][j - 1] + (sc.match if q[i - 1] == r[j - 1] != "N" else -sc.mismatch))
                k = end_len
                if i >= k and j >= k and q[i - k : i] == r[j - k : j] and "N" not in q[i - k : i] and (local or i == k):
                    d = max(d, k * sc.match)
                if i == m:
                    ends[n - j] = d
            h[i][j] = max(v[i][j], d, w)
            w = above(max(h[i][j] - o - e, w - e))
            top = max(top, h[i][j])
    return ends, top


def rescored(x, q, r, sc):
    score, qs, qe, rs, re, cigar, cs, mlen, blen, ed = x
    import re as regex

    i, j, total = qs, rs, 0
    for n, op in regex.findall(r"(\d+)([MID])", cigar):
        n = int(n)
        if op == "M":
            total += sum(sc.match if q[i + k] == r[j + k] != "N" else -sc.mismatch for k in range(n))
            i, j = i + n, j + n
        else:
            total -= sc.gap_open + sc.gap_extend * n
            i, j = (i + n, j) if op == "I" else (i, j + n)
    return (i, j, total) == (qe, re, score)


def test_kernel_against_plain_recurrence():
    rng = random.Random(2)
    for t in range(150):
        letters = "ACGTN" if t % 3 else "AC"
        q = "".join(rng.choice(letters) for _ in range(rng.randint(1, 20)))
        r = "".join(rng.choice(letters[:4]) for _ in range(rng.randint(1, 25)))
        if t % 2:
            r = r[:5] + q[: len(q) // 2] + rng.choice(["", "AC"]) + q[len(q) // 2 :] + r[5:]
        for local, end_len in ((False, 1), (True, 3), (False, 2), (True, 1)):
            sc, core = Scoring(min_score=rng.choice([2, 5, 9])), rng.randint(1, len(r))
            got, (ends, top) = align([q], [r], [core], sc, local, end_len)[0], plain(q, r, sc, local, end_len)
            assert all(rescored(x, q, r, sc) for x in got)
            if local:
                assert {x[0] for x in got} == ({top} if top >= sc.min_score else set())
            else:
                assert {x[3]: x[0] for x in got} == {b: s for b, s in ends.items() if b < core and s >= sc.min_score}


def test_enough_seeds_are_left_by_any_edits():
    """Every alignment within the cost that a seed plan allows keeps the seeds that it promises."""
    rng = random.Random(6)
    for _ in range(400):
        m, sc = rng.randint(20, 60), Scoring(min_score=16)
        q = "".join(rng.choice("ACGT") for _ in range(m))
        size, need = seed_plan(m, sc) or (0, 0)
        if not size:
            continue
        left, i, kept, run = m - sc.min_score, 0, 0, 0
        while i < m:  # kept q-mers are runs of unchanged bases
            kind = rng.choice("=====X") if left >= 4 else "="
            if rng.random() < 0.05 and left >= 8:
                left, run, i = left - 8, 0, i + 1
            elif rng.random() < 0.05 and left >= 7:
                left, run = left - 7, 0
            elif kind == "X":
                left, run, i = left - 4, 0, i + 1
            else:
                run, i = run + 1, i + 1
                kept += run >= size
        assert kept >= need


def test_end_to_end_hits_against_plain_recurrence(spark):
    """Every begin of an alignment that scores enough is found, with edits spread evenly and in repeats."""
    rng = random.Random(12)
    base = "".join(rng.choice("ACGT") for _ in range(32))
    spread = "".join(("ACGT"[("ACGT".index(c) + 1) % 4] if i in (8, 17, 25) else c) for i, c in enumerate(base))
    seqs = ["GGAT" + base + "CCTA", "TTT" + spread + "GA", base[:15] + base[16:] + "T", base[:12] + "AC" + base[12:], "CAT" * 30, base[:20] + "G" * 14 + base[20:]]
    queries = [("q", base), ("rep", "CAT" * 11), (None, base), ("q", base[3:30]), ("n", "")]
    ref = both_strands(sources(spark, *seqs)).persist()
    sc = Scoring(min_score=18)
    want = {}
    texts = {r.sid: r.seq for r in ref.collect()}
    for _, q in queries:
        want[q] = sorted((sid, b, s) for sid, r in texts.items() for b, s in plain(q, r, sc, False, 1)[0].items() if s >= 18)
    seqs = al.by_sequence(spark.createDataFrame(queries, "name string, seq string"))[1]
    got = al.hits(seqs, ref, sc, None, False, 1).collect()
    for _, q in queries:
        assert sorted((r.sid, r.rst, r.score) for r in got if r.seq == q) == want[q]
    assert len(want[base]) >= 4 and len(want["CAT" * 11]) > 10
    heads, hits = al.all_e2e(spark.createDataFrame(queries, "name string, seq string"), ref, sc)
    assert sorted((str(r.qname), r.qlen) for r in heads.collect()) == sorted((str(n), len(q)) for n, q in queries)
    by = [(r.qname, r.cnt, r.score, r.cs) for r in hits.collect()]
    assert sorted(x[1:] for x in by if x[0] is None) == sorted(set(x[1:] for x in by if x[0] is None)) and any(x[0] is None for x in by)
    rep = {x[3]: x[1] for x in by if x[0] == "rep"}
    assert rep[":33"] == 20  # every place of the period


def test_alignments(spark):
    rng = random.Random(4)
    core = "".join(rng.choice("ACGT") for _ in range(40))
    snp = core[:20] + ("A" if core[20] != "A" else "C") + core[21:]
    seqs = ["GG" + core + "TT", "AA" + core + "CC", "TTT" + snp + "G", "ACGT" * 5]
    ref, q = both_strands(sources(spark, *seqs)), asked(spark, q=core, none="ACACAGAGATATCTCTGTGTACACGGGTTTCCC")
    local = al.sw(q, ref, unmapped=True).collect()
    hit = next(r for r in local if r.qname == "q")
    assert (hit.AS, hit.rh, hit.strand, hit.tst, hit.ten, hit.cs) == (40, 2, "+", 2, 42, ":40")
    assert any(r.qname == "none" and r.tname is None for r in local)
    assert (hit.qh, hit.ap) == (1, [])
    more = al.sw(q, ref, Scoring(min_score=34), end_to_end=True, max_pos=2).collect()
    assert sorted((r.AS, r.rh, r.ap) for r in more) == [(36, 1, []), (40, 2, ["n1,+,2"])]
    heads, hits = al.all_e2e(q, ref, Scoring(min_score=34), both=True)
    one = {(r.qname, r.strand): r for r in heads.collect()}
    assert (one["q", "+"].n_allele, one["q", "+"].total) == (2, 3) and (one["q", "-"].n_allele, one["none", "+"].total) == (2, 0)
    got = sorted((r.strand, r.cnt, r.score, r.ed) for r in hits.where("qname = 'q'").collect())
    assert got == [("+", 1, 36, 1), ("+", 2, 40, 0), ("-", 1, 36, 1), ("-", 2, 40, 0)]
    heads, hits = al.all_e2e(q, ref, Scoring(min_score=34), max_total=1)
    assert heads.where("qname = 'q'").first().n_out == 2
    div = al.hapdiv(q.where("name = 'q'"), ref, 30, 5, Scoring(min_score=20)).orderBy("st").collect()
    assert all(r.h0 + r.h1 == 3 for r in div) and div[0].st == 0 and div[-1].en == 40


W = "name string, st int, en int"
H = W + ", cnt long, score long, ed long, cs string"


def test_window_tools(spark):
    windows = spark.createDataFrame([("c", s, s + 10) for s in range(0, 50, 10)] + [("d", 0, 10)], W)
    hits = spark.createDataFrame([("c", 0, 10, 1, 10, 0, ":10"), ("c", 10, 20, 9, 10, 0, ":10"), ("c", 20, 30, 1, 10, 0, ":10"), ("c", 30, 40, 3, 9, 6, ":10"), ("c", 40, 50, 2, 9, 1, ":10")], H)
    got = sorted(tuple(r) for r in posthoc.mapflt(windows, hits, 2, 5, 12).collect())
    assert got == [("c", 10, 40, 10), ("d", 0, 10, 0)]
    got = sorted(tuple(r) for r in posthoc.mapflt2(windows, hits, hits, 4, 3, 7, 0).collect())
    assert got == [("c", 10, 20, 0), ("c", 30, 50, 0), ("d", 0, 10, 0)]
    assert sorted(r.name for r in posthoc.uniqmer(hits, 5, 2, 8).collect()) == ["c:1-10", "c:11-20", "c:21-30", "c:41-50"]


def test_call_and_snps(spark):
    windows = spark.createDataFrame([("c", 0, 20), ("c", 5, 25)], W)
    hits = spark.createDataFrame([("c", 0, 20, 3, 20, 0, ":20"), ("c", 0, 20, 2, 16, 1, ":10*ag:9"), ("c", 5, 25, 3, 20, 0, ":20"), ("c", 5, 25, 2, 16, 1, ":5*ag:14"), ("c", 5, 25, 1, 2, 2, ":5-ac:15")], H)
    vcf = posthoc.call(windows, hits, 5).orderBy("pos").collect()
    snp = next(r for r in vcf if r.ref == "A")
    assert (snp.chrom, snp.pos, snp.alt, snp.filter) == ("c", 11, "G", "PASS") and "AC=2;AN=5;" in snp.info and snp.info.endswith("SUPPORT=2")
    assert [r.snp for r in posthoc.getsnp(posthoc.call(windows, hits, 5)).collect()] == ["c-11-A-G"]
    rows = spark.createDataFrame([("chr1", 5, "AC", "GT,A"), ("x", 1, "A", "C")], "chrom string, pos long, ref string, alt string")
    assert sorted(r.snp for r in posthoc.getsnp(rows).collect()) == ["chr1-5-A-G", "chr1-5-C-T", "x-1-A-C"]
    assert sorted(r.snp for r in posthoc.getsnp(rows, True).collect()) == ["chr1-5-A-G", "chr1-5-C-T"]


def test_formats(spark, tmp_path):
    core = "ACGTTGCATGCCATAGCATTACGATCGATCGGATTAACGG"
    ref, q = both_strands(sources(spark, "GG" + core)), asked(spark, q=core)
    heads, hits = al.all_e2e(q, ref)
    formats.write_e2e(heads, hits, str(tmp_path / "e2e"))
    assert [tuple(r) for r in formats.read_e2e(spark, str(tmp_path / "e2e")).collect()] == [("q", "+", 1, 40, 0, ":40")]
    line = formats.paf_lines(al.sw(q, ref)).first().value.split("\t")
    assert line[:12] == ["q", "40", "0", "40", "+", "n0", "42", "2", "42", "40", "40", "0"] and line[12] == "AS:i:40"
    vcf = spark.createDataFrame([("c", 3, ".", "A", "G", 60, "PASS", "AC=1")], "chrom string, pos long, id string, ref string, alt string, qual int, filter string, info string")
    formats.write_vcf(vcf, str(tmp_path / "vcf"))
    assert formats.read_vcf(spark, str(tmp_path / "vcf")).collect() == vcf.collect()
    assert formats.bed_lines(spark.createDataFrame([("a", 1, 5)], "name string, st int, en int")).first().value == "a\t1\t5"


def test_streams(spark, tmp_path):
    from helixframe.operators import exact

    core = "ACGTTGCATGCCATAGCATTACGATCGATCGGATTAACGG"
    ref, q = both_strands(sources(spark, "GG" + core)), asked(spark, q=core, r=core[5:30])
    q.repartition(2).write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema(q.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "q"))
    got = sorted(tuple(r) for r in stream_mem(stream, ref, 12).collect())
    assert got == sorted(tuple(r) for r in exact.mem(q, ref, 12).collect()) and len(got) == 2
    index = stream_append(spark.readStream.schema(q.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "q")), str(tmp_path / "index"))
    assert {r.seq for r in index.sequences.where("strand = 0").collect()} == {core, core[5:30]} and index.sa.count() == 2 * (41 + 26)


def test_sizes():
    assert [parse_size(x) for x in ("7", "1.5k", "2m", "1G")] == [7, 1500, 2_000_000, 1_000_000_000]
