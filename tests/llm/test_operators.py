"""Every operator on small tables with edge cases, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from helixframe.llm import decontam, packing, queries, secretscan, simhash, substrings, tokens, toxicity
from helixframe.llm.bytecnn import ByteCNN

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
OPS = queries.queries()


def run(spark, name, path):
    return OPS[name](spark, path).collect()


@pytest.mark.parametrize("name", list(OPS))
def test_empty_table(spark, empty_dir, name):
    assert run(spark, name, empty_dir) == []


@pytest.mark.parametrize("name", [n for n in OPS if not n.startswith(("op1_", "op3_", "op7_", "op12_"))])
def test_extra_columns_change_nothing(spark, sf_dir, clash_dir, name):
    key = lambda r: [str(x) for x in r]
    a, b = run(spark, name, sf_dir), run(spark, name, clash_dir)
    if name.startswith("op9"):  # places depend on how rows are dealt to tasks
        a, b = ([r.doc_id for r in x if r.start == 0] for x in (a, b))
        assert Counter(a) == Counter(b)
    else:
        assert sorted(a, key=key) == sorted(b, key=key)


def crc(i, m, rest):
    return i is not None and zlib.crc32(str(i).encode()) % m == rest


@pytest.mark.parametrize("name, m, rest", [("op1_langid", 4, 2), ("op3_toxicity", 5, 0), ("op7_quality", 3, 1)])
def test_models_return_every_row(spark, sf_dir, clash_dir, corpus, name, m, rest):
    rows = corpus[0]
    for path in (sf_dir, clash_dir):
        got = run(spark, name, path)
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
        assert all(0 <= r.score <= 1 and r.held_out == crc(r.doc_id, m, rest) for r in got)
        if name == "op1_langid":
            by = {r.doc_id: r.lang_pred for r in got}
            assert {by[i] for i in (100, 101, 102, 105)} == {"und"} and by[104] in ("de", "en")
            assert np.mean([by[i] == ("de" if i % 3 == 0 else "en") for i in range(18)]) > 0.9
        else:
            assert all(r.predicted == int(r.score >= 0.5) for r in got)


def test_models_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    import duckdb

    docs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{path}/documents.parquet'").fetchall())
    got = [r for r in run(spark, "op1_langid", path) if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in got]) > 0.97
    labels = {i: (q, t) for i, q, t in duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{path}/labels.parquet'").fetchall()}
    quality = [(r.score, labels[r.doc_id][0]) for r in run(spark, "op7_quality", path) if r.held_out and r.doc_id in labels]
    assert np.mean([(s >= 0.5) == y for s, y in quality]) > 0.9
    path = "/root/testdata/sf0.1"  # the smaller table labels some forty texts as toxic, too few to learn from
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{path}/labels.parquet'").fetchall())
    toxic = [(r.score, labels[r.doc_id]) for r in run(spark, "op3_toxicity", path) if r.held_out and r.doc_id in labels]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in toxic if x for b, y in toxic if not y]
    assert np.mean(pairs) > 0.9


def test_op2_round_trip(spark, sf_dir, corpus):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.tokenizer_path())
    want = Counter()
    for i, t, *_ in corpus[0]:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    got = sorted(run(spark, "op2_tokens", sf_dir), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)


def test_op2_selective_read(spark, corpus, tmp_path):
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string, lang string, source string, n_chars long")
    tokens.write_tokens(docs, str(tmp_path / "t"), page_rows=4)
    plan = tokens.read_tokens(spark, str(tmp_path / "t"), ("doc_id", "n_tokens")).where("doc_id = 7")
    text = plan._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in text and "ids" not in text.split("Physical Plan")[1]
    assert plan.count() == 1


def test_op4_against_brute_force(spark, sf_dir, corpus, items):
    lower = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    wins = {}
    for i, t in items:
        w = lower(t)
        for k in range(max(1, len(w) - 9)) if w else []:
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = Counter()
    for i, t, *_ in corpus[0]:
        w, hit, found = lower(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[x]
        ids = sorted(str(x) for x in found if x is not None)
        want[i, len(w), len(hit), len(ids), SHA(",".join(ids)), bool(hit)] += 1
    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in run(spark, "op4_decontaminate", sf_dir))
    assert got == want and sum(k[-1] for k in want) >= 3


def test_op4_shuffled_path_is_the_same(spark, sf_dir, monkeypatch):
    few = run(spark, "op4_decontaminate", sf_dir)
    monkeypatch.setattr(decontam, "MAX_BROADCAST", 0)
    assert Counter(run(spark, "op4_decontaminate", sf_dir)) == Counter(few)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def plain_fingerprint(t):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, f in zip(ids, map(find, range(len(fps)))):
        if i is not None:
            least[f] = min(i, least.get(f, i))
    return [least.get(find(k)) for k in range(len(fps))]


def test_op5_against_brute_force(spark, sf_dir, corpus):
    ids, fps = [r[0] for r in corpus[0]], [plain_fingerprint(r[1]) for r in corpus[0]]
    want = Counter((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, plain_components(ids, fps)))
    assert Counter(tuple(r) for r in run(spark, "op5_simhash", sf_dir)) == want


def test_op5_dense_groups(spark, monkeypatch):
    """A ball of near fingerprints, chains of links, and far ones, against all pairs; with and without the search in runs."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    near = [int(base[0]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(300)]
    walk = [int(base[1])]
    for _ in range(40):
        walk.append(walk[-1] ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False)))
    fps = near + walk + [int(x) for x in rng.integers(0, 1 << 63, 200, dtype=np.uint64)]
    ids = list(range(len(fps)))
    want = plain_components(ids, fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(i, signed(f)) for i, f in zip(ids, fps)], "doc_id long, fp long")
    least = rows.groupBy("fp").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "least")
    for few in (2, 24):
        monkeypatch.setattr(simhash, "FEW", few)
        roots = {r.node: r.root for r in simhash.stars(simhash.links(least.select("fp"))).collect()}
        group = {}
        for i, f in zip(ids, fps):
            group.setdefault(roots.get(signed(f), signed(f)), []).append(i)
        got = {i: min(g) for g in group.values() for i in g}
        assert [got[i] for i in ids] == want


def test_op5_keeps_one_of_each(spark, sf_dir, corpus):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in corpus[0]]
    classes = dict(zip(ids, plain_components(ids, [plain_fingerprint(r[1]) for r in corpus[0]])))
    assert Counter(r.doc_id for r in kept.collect()) == Counter({c for i, c in classes.items()})


def test_op6_against_brute_force(spark, sf_dir, corpus):
    want = Counter()
    for i, t, *_ in corpus[0]:
        w, t = words_of(t), t or ""
        wins = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = {k + d for k in range(len(w) - 2) if wins[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if words_of(x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)] += 1
    got = run(spark, "op6_lines", sf_dir)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got) == want
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(18)) and not kept[21] and not kept[25] and not any(kept[100 + i] for i in range(7))
    assert not any(r.kept and r.base_failed for r in got)


def test_op8_against_brute_force(spark, sf_dir, corpus):
    pattern = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    want = Counter()
    for i, t, *_ in corpus[0]:
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(pattern, t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        n = Counter(k for _, k, _ in spans)
        want[i, n[0], n[1], n[2], SHA(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)))] += 1
    got = run(spark, "op8_secrets", sf_dir)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")) for r in got) == want
    text, spans = corpus[0][23][1], next(r.spans for r in got if r.doc_id == 23)
    kind, a, b = spans.split(":")
    assert kind == "novel" and text[int(a) : int(b)] == "Zx9k2LmQ8vT4bN7wRc3y"
    assert all("novel" not in r.spans for r in got if r.doc_id != 23)


def test_op8_novelty_and_redaction():
    spans = lambda t: [(secretscan.KINDS[k], t[a:b]) for a, k, b in secretscan.novel_spans(t, secretscan.base_spans(t))]
    assert spans("password getElementByIdquerySelector1 addEventListener2createElement") == []
    assert spans("bearer eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9 ok") == [("novel", "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9")]
    assert spans("nothing to see: eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9") == []
    assert secretscan.redact("abcdefgh", [(1, 0, 3), (2, 1, 5), (6, 2, 7)], "#") == "a#f#h"


def packed_checks(rows, docs, limit):
    """docs: id -> list of id arrays. Pieces tile documents, and sequences are gapless and full or a power of two."""
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in s])
        assert [r.offset for r in s] == [0, *ends[:-1]] and ends[-1] <= limit
        assert ends[-1] == limit or ends[-1] & (ends[-1] - 1) == 0
    want, got = Counter(), Counter()
    for i, all_ids in docs.items():
        for ids in all_ids:
            for k in (0, len(ids) - 1):
                want[i, k, len(ids)] += 1
    for r in rows:
        for k in {0, r.doc_tokens - 1} if r.doc_tokens > 1 else (0, 0):
            if r.start <= k < r.start + r.length:
                got[r.doc_id, k, r.doc_tokens] += 1
        assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in docs[r.doc_id])
    assert got == want
    assert sum(r.length for r in rows) == sum(len(x) for a in docs.values() for x in a)


def test_op9_round_trip(spark, sf_dir, corpus):
    from tokenizers import Tokenizer

    whole, docs = Tokenizer.from_file(tokens.tokenizer_path()), {}
    for i, t, *_ in corpus[0]:
        docs.setdefault(i, []).append(np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4"))
    packed_checks(run(spark, "op9_packing", sf_dir), docs, 4096)


def test_op9_limits(spark):
    rng = np.random.default_rng(1)
    docs, rows = {}, []
    for i in range(300):
        n = int(rng.integers(1, 90)) if i % 10 else int(rng.integers(90, 500))
        loss = [bool(x) for x in rng.random(n) < rng.random()] if i % 3 else None
        docs[i] = [np.arange(n, dtype="<u4") + 7 * i]
        rows.append((i, docs[i][0].tolist(), loss))
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, loss array<boolean>").repartition(3)
    got = packing.pack_examples(df, 64, 4, 40).collect()
    packed_checks(got, docs, 64)
    mask = {i: np.ones(len(ids), bool) if m is None else np.array(m) for i, ids, m in rows}
    for s in {r.sequence_id for r in got}:
        pieces = [r for r in got if r.sequence_id == s]
        assert len(pieces) <= 4 and sum(mask[r.doc_id][r.start : r.start + r.length].sum() for r in pieces) <= 40


def test_op10_finds_planted_passages(spark, sf_dir, corpus):
    rows, passage = corpus
    got = run(spark, "op10_substrings", sf_dir)
    links = {(r.doc_id, r.other_id) for r in got}
    group = {3, 9, 17}
    assert {x for p in links if set(p) <= group for x in p} == group
    assert (18, 4) in links and (107, 4) in links and (20, 6) in links
    text = {i: words_of((t or "").lower()) for i, t, *_ in rows}
    planted = words_of(passage.lower())
    for r in got:
        assert r.similarity >= 0.8 and r.doc_id > r.other_id
        a, b = text[r.doc_id][r.start : r.stop], text[r.other_id][r.other_start : r.other_stop]
        assert r.matched <= min(len(a), len(b)) and r.matched / max(len(a), len(b)) == pytest.approx(r.similarity)
        if {r.doc_id, r.other_id} <= group:
            assert len(a) >= len(planted) - 4
    # Of the prose, only the planted documents and copies show up.
    assert {i for p in links for i in p} <= {3, 9, 17, 18, 4, 107, 5, 19, 20, 6, 11, 200, 12, 7, 21, 8, 22, 10, 23, None, 25}


def test_op10_hot_groups_are_the_same(spark, sf_dir, monkeypatch):
    few = Counter(run(spark, "op10_substrings", sf_dir))
    monkeypatch.setattr(substrings, "HOT", 1)
    assert Counter(run(spark, "op10_substrings", sf_dir)) == few


def test_op10_chains_and_alignment():
    assert substrings.chain([(0, 10, 0, 10, 2), (12, 20, 13, 21, 2), (100, 110, 5, 15, 3)])[0] == (0, 20, 0, 21)
    a, b = b"a b c d e f".split(), b"a x c d f".split()
    assert substrings.common_words(a, b) == 4
    assert substrings.segments(b"p q a b c d e f g h i j k l m n o p r s", b"p q a b c d e f g h i j k l m n o p t u", 0, 0, [4], [4], [6], 0.8) == [(0, 18, 0, 18, 18)]


def test_op10_chains_over_unlike_text_are_split(spark):
    """Two passages with other words between, an insert on one side, and a short common line nearby."""
    fresh = iter(np.random.default_rng(8).permutation(20_000).tolist())
    some = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    docs, want = [], []
    for head, gap_a, gap_b, tail in ((60, 100, 100, 60), (60, 0, 100, 60), (60, 30, 30, 15), (60, 55, 55, 15), (60, 40, 42, 15)):
        p, q = some(head), some(tail)
        for gap in (gap_a, gap_b):
            docs.append((len(docs), " ".join(some(30) + p + some(gap) + q + some(30))))
        want += [(len(docs) - 1, 30, 30 + head)] + ([(len(docs) - 1, 30 + head + gap_b, 30 + head + gap_b + tail)] if tail >= 50 else [])
    got = substrings.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start, r.stop) for r in got) == want and all(r.other_id == r.doc_id - 1 for r in got)


@pytest.mark.parametrize("hot", [50_000, 1])
def test_op10_passages_of_frequent_lines(spark, monkeypatch, hot):
    """Two documents share a passage whose every two lines stand in other documents that come before both and between them."""
    monkeypatch.setattr(substrings, "HOT", hot)
    fresh = iter(np.random.default_rng(9).permutation(200_000).tolist())
    some = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    docs, want = {}, []
    for c in range(12):
        lines = [some(13) for _ in range(5)]
        for at in (100 * c, 100 * c + 51):
            for i in range(5):
                docs[at + i] = some(20) + lines[i] + some(20)
                docs[at + 10 + i] = some(20) + (lines[i] + lines[i + 1] if i < 4 else []) + some(20)
        passage = sum(lines, [])
        docs[100 * c + 50], docs[100 * c + 99] = (some(30) + passage + some(30) for _ in range(2))
        want.append((100 * c + 99, 30, 95, 100 * c + 50))
    got = substrings.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")).collect()
    assert set(want) <= {(r.doc_id, r.start, r.stop, r.other_id) for r in got}


def test_op10_long_stretches_of_periodic_text_are_thinned():
    text = " ".join(["cat"] * 500).encode()
    _, at, far = substrings.seeds(text)
    kept = at[far != 0]
    assert len(kept) < 40 and len({x for p in kept.tolist() for x in range(p, p + substrings.LONG)}) >= 490


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    net = toxicity.BiGRU()
    net.p = {k: (v + rng.normal(0, 0.1, v.shape)).astype(np.float64) for k, v in net.p.items()}
    local = toxicity.word_rows(["ab", "cde", "f,", "ghij"])
    at = np.array([[1, 2, 3, 4, 1], [4, 3, 0, 0, 0]])
    at = np.pad(at, ((0, 0), (0, toxicity.WINDOW - 5)))
    y, w = np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss():
        h = toxicity.HIDDEN
        x = np.concatenate([np.zeros((1, 6 * h)), net.inputs(*local) @ net.p["in"] + net.p["in_b"]])[at.T]
        mask = (at.T > 0)[:, :, None].astype(float)
        both = np.concatenate([net.states(x[:, :, : 3 * h], mask, "fw", True)[0], net.states(x[:, :, 3 * h :], mask, "bw", True)[0]], 2)
        z = net.pool(both.astype(np.float64), mask)[2]
        return float(((np.log1p(np.exp(z)) - y * z) * w).sum() / w.sum())

    g = net.gradients(*local, at, y, w)
    for name, where in (("fw", (2, 5)), ("bw", (1, 20)), ("att", (3,)), ("out", (9,)), ("out_b", (0,)), ("in", (4, 7)), ("in_b", (30,)), ("word", (local[0][1], 2)), ("char", (local[1][0], 3))):
        old, e = net.p[name][where], 1e-3
        net.p[name][where] = old + e
        up = loss()
        net.p[name][where] = old - e
        down = loss()
        net.p[name][where] = old
        assert g[name][where] == pytest.approx((up - down) / (2 * e), abs=2e-3)


def test_byte_network_table_forms_agree():
    rng = np.random.default_rng(3)
    net, x = ByteCNN(3, (2, 3, 4, 5), 8), rng.integers(0, 256, (5, 64)).astype(np.uint8)
    top, _ = net.pooled(x)
    plain = np.maximum(top, 0).reshape(5, -1) @ net.params[-2] + net.params[-1]
    assert np.allclose(plain, net.logits(x, net.pairs()), atol=1e-4)


@pytest.mark.parametrize("few", [32, 2])
def test_op10_every_pair_of_a_group_is_linked(spark, monkeypatch, few):
    """Seven documents share a passage, and two others a passage of frequent lines with edits, whose lines stand alone in documents before and between."""
    monkeypatch.setattr(substrings, "PAIRS", few)
    fresh = iter(np.random.default_rng(10).permutation(200_000).tolist())
    some = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    shared, lines = some(60), [some(15) for _ in range(4)]
    docs = {i: some(20 + i) + shared + some(20) for i in range(1, 8)}
    for i in range(20, 60):
        docs[i] = some(20) + lines[i % 4] + some(20)
    for i in (39, 60):
        edited = [list(x) for x in lines]
        for x in edited[:3]:
            x[14] = f"e{i}"  # every stretch of 41 words has an edit of its own
        docs[i] = some(30) + sum(edited, []) + some(30)
    got = substrings.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")).collect()
    pairs, classes = {(r.doc_id, r.other_id) for r in got}, {}
    for r in got:
        if r.class_id is not None:  # parts of a passage that adjoin it, here its lines, have none
            classes.setdefault((r.class_id, r.class_start), set()).update((r.doc_id, r.other_id))
    want = {(b, a) for b in range(1, 8) for a in range(1, b)} | {(60, 39)}
    assert (60, 39) in pairs and all(x in want or {39, 60} & set(x) for x in pairs) and classes.keys() == {(1, 21), (39, 30)}
    linked = {(b, a) for x in classes.values() for a in x for b in x if a < b}
    assert linked == want and (few < 7 or want <= pairs)
