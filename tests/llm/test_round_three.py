"""The operators on two tokenizers, embeddings and shards, against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from helixframe.llm import crosstokens, sharding, whitening
from helixframe.llm.tokens import byte_letters, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=()):
    from pyspark.sql import functions as F

    rows = [(i, t, None, None, None) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).select("*", *(F.lit("x").alias(c) for c in extra))


# Cross-tokenizer alignment


def test_products_against_dense_matrices(monkeypatch):
    rng = np.random.default_rng(3)
    for expanded in (1 << 20, 5):
        monkeypatch.setattr(crosstokens, "EXPANDED", expanded)
        for _ in range(40):
            n, m, k = rng.integers(0, 9, 3)
            dense = [rng.integers(0, 3, s) * (rng.random(s) < 0.4) for s in ((n, m), (m, k))]
            sparse = []
            for d in dense:
                r, c = np.nonzero(d)
                sparse.append(crosstokens.Csr(np.searchsorted(r, np.arange(d.shape[0] + 1)).astype(np.int64), c, d[r, c], d.shape[1]))
            got, out = crosstokens.product(*sparse), np.zeros((n, k), int)
            out[crosstokens.rows_of(got), got.to] = got.value
            assert (out == dense[0] @ dense[1]).all() and len(got.at) == n + 1
            flipped = crosstokens.transposed(sparse[0])
            back = np.zeros((m, n), int)
            back[crosstokens.rows_of(flipped), flipped.to] = flipped.value
            assert (back == dense[0].T).all()


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for top in (1, 200, 1 << 15, 1 << 22, 1 << 30):
        numbers = rng.integers(0, top, 500)
        raw, size = crosstokens.packed(numbers)
        back, ends = crosstokens.unpacked(raw)
        assert (back == numbers).all() and (ends == np.cumsum(size)).all()
    assert len(crosstokens.unpacked(crosstokens.packed(np.zeros(0, np.int64))[0])[0]) == 0


def plain_alignment(rows):
    """Whole texts through both tokenizers, links by walking over the bytes."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    a_tok.encode_special_tokens = True
    byte, every, docs = {c: i for i, c in enumerate(byte_letters())}, Counter(), []
    for i, t in rows:
        links, row = [], (i, 0, 0, 0, 0, "")
        if t:
            a, b, raw = a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t), (" " + t).encode()
            of_a = [bytes(byte[c] for c in a_tok.id_to_token(x)) for x in a]
            of_b = [bytes([int(b_tok.id_to_piece(x)[3:5], 16)]) if b_tok.is_byte(x) else b_tok.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if b"".join(of_a) == raw == b"".join(of_b):
                cover = [[k for k, x in enumerate(of) for _ in x] for of in (of_a, of_b)]
                links = [(a[x], b[y]) for x, y in dict.fromkeys(zip(*cover))]
                end_a, end_b = ({int(e): k + 1 for k, e in enumerate(np.cumsum([len(x) for x in of]))} for of in (of_a, of_b))
                groups, p, q = [], 0, 0
                for e in sorted(end_a.keys() & end_b.keys()):
                    groups.append(",".join(map(str, a[p : end_a[e]])) + "|" + ",".join(map(str, b[q : end_b[e]])))
                    p, q = end_a[e], end_b[e]
                row = (i, len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest())
        every.update(links)
        docs.append((row, links))
    best = {}
    for (_, b), n in every.items():
        best[b] = max(n, best.get(b, 0))
    return Counter((*r[:5], sum(every[x] == best[x[1]] for x in links), sum(every[x] for x in links), r[5]) for r, links in docs)


ODD = ["", None, " ", "  \n\t ", "a", "word", "<|endoftext|> and <s> </s> <0x0A>", "▁under▁lined", "tab\tand\nline\n\n  two  spaces ", "nbsp here\r\nand\x85there \x1c", "日本語 テキスト 🙂🙃 é", "\x00 nul", "''s don't x's", "%%%***...", "x" * 5000, " lead", "\n", "\nword", "\tword", "a b", "ﬁ ﬂ ½"]


def test_alignment_against_plain_python(spark, corpus, monkeypatch):
    monkeypatch.setattr(crosstokens, "BOOK_REFS", 300)
    monkeypatch.setattr(crosstokens, "REMEMBERED", 200)
    rng = random.Random(2)
    texts = [(i, t) for i, t, *_ in corpus[0]] + [(1000 + i, t) for i, t in enumerate(ODD)]
    texts += [(2000 + i, "".join(rng.choice(["a", " ", "  ", "\n", "é", ".", "'s", "der ", "The ", "12", "\t", "🙂"]) for _ in range(60))) for i in range(60)]
    docs = docs_of(spark, texts, ("book", "refs", "cnt", "pair"))
    got = crosstokens.alignment_counts(docs.repartition(3)).collect()
    names = ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r[c] for c in names) for r in got) == plain_alignment(texts)


def test_links_and_groups_of_tokens(spark):
    rows = crosstokens.token_links(docs_of(spark, [(1, "unbelievable tokens, naïve"), (2, None), (3, "a▁b")])).collect()
    one = next(r for r in rows if r.id == 1)
    tok = crosstokens.tokenizers_of(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    for side, sizes in (("a", tok.size_a[list(one.a_ids)]), ("b", tok.size_b[list(one.b_ids)])):
        shared = Counter()
        for x in one.links:
            shared[x[side]] += x.bytes
        assert [shared[i] for i in range(len(sizes))] == sizes.tolist()
    assert (one.groups[-1].a_end, one.groups[-1].b_end) == (len(one.a_ids), len(one.b_ids))
    assert all(not r.a_ids and not r.links for r in rows if r.id != 1)


def test_alignment_of_nothing(spark):
    assert crosstokens.alignment_counts(docs_of(spark, [])).count() == 0
    assert [tuple(r)[1:8] for r in crosstokens.alignment_counts(docs_of(spark, [(1, ""), (None, None)])).collect()] == [(0, 0, 0, 0, 0, "", 0)] * 2


# Whitening


def vectors_of(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", F.lit(1).alias("index"), F.lit(1).alias("x"))


@pytest.mark.parametrize("d", [6, 3])
def test_whitening_against_numpy(spark, tmp_path, d):
    rng = np.random.default_rng(d)
    mix = rng.normal(size=(d, d)) * np.arange(1, d + 1)
    vecs = [(mix @ rng.normal(size=d)).astype(np.float32).tolist() for _ in range(150)]
    rows = [(i, v, 0) for i, v in enumerate(vecs)] + [(500 + i, vecs[0], 1) for i in range(80)] + [(7, vecs[1], 1), (None, vecs[2], 1)]
    bad = [(900, None, 0), (901, [None] * d, 0), (902, [float("nan")] * d, 0), (903, [float("inf")] + [0.0] * (d - 1), 0), (904, [0.0, -float("inf")], 0)]
    short = [(950, vecs[3][:2], 0), (951, [], 0)]
    vectors_of(spark, rows + bad + short).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = whitening.op12_whitening(spark, str(tmp_path)).collect()
    x = [(i, np.floor(np.array(v + [0.0] * (d - len(v)), np.float32).astype(float) * 256).astype(int)) for i, v, _ in rows + short]
    fit = np.array(sorted({tuple(v) for _, v in x}))
    n, s = len(fit), fit.sum(axis=0)
    cov = (fit - s / n).T @ (fit - s / n) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1].T
    k = min(d, 4)
    assert len(got) == len(x) * k
    for c in range(k):
        want = sorted((str(i), int(((n * v - s) ** 2).sum()), (v - s / n) @ u[c] / np.sqrt(e[c])) for i, v in x)
        mine = [r for r in got if r.component == c + 1]
        sign = max((r.whitened for r in mine), key=abs) * max((w[2] for w in want), key=abs)
        mine = sorted((str(r.vec_id), r.deviation, r.whitened * np.sign(sign)) for r in mine)
        assert [w[:2] for w in want] == [m[:2] for m in mine]
        assert np.allclose([w[2] for w in want], [m[2] for m in mine], atol=1e-9)
    assert {r.n for r in got} == {n} and all(abs(r.explained - e[r.component - 1] / np.trace(cov)) < 1e-10 and r.identity_error < 1e-9 for r in got)


def test_whitening_blocks(spark, monkeypatch):
    """Many blocks give what one gives."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=5).tolist(), 0) for i in range(90)]
    one = sorted((r.id, r.y) for r in whitening.whiten(vectors_of(spark, rows))[1].collect())
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    many = sorted((r.id, r.y) for r in whitening.whiten(vectors_of(spark, rows).repartition(3))[1].collect())
    assert [i for i, _ in one] == [i for i, _ in many] and np.allclose([y for _, y in one], [y for _, y in many], atol=1e-9)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [0.5, 1.0], 0), (2, [0.5, 1.0], 0)], [(1, [], 0)]])
def test_whitening_without_variance(spark, tmp_path, rows):
    vectors_of(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = whitening.op12_whitening(spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


# Shards


def plain_shards(rows, shards=24):
    """Groups in order of their hash; the smallest capacity by trying; then cuts at even shares of what is left."""
    groups = {}
    for i, t in rows:
        raw = (t or "").encode()
        groups.setdefault(int(hashlib.sha256(raw).hexdigest()[:15], 16), []).append((i is not None, i or 0, i, len(raw) + 8, zlib.crc32(raw)))
    keys = sorted(groups)
    sizes = [sum(r[3] for r in groups[k]) for k in keys]
    ends = [0, *np.cumsum(sizes).tolist()]
    total = ends[-1]

    def fits(cap):
        n, room = 1, cap
        for s in sizes:
            if s > cap:
                return False
            if s > room:
                n, room = n + 1, cap
            room -= s
        return n <= shards

    low, high = 1, total
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    floor = [total] * (shards + 1)
    for s in range(shards - 1, -1, -1):
        floor[s] = min(e for e in ends if e >= floor[s + 1] - low)
    cuts = [0]
    for s in range(shards - 1):
        at = cuts[-1]
        to = max(e for e in ends if e <= at + -(-(total - at) // (shards - s)))
        if to <= at < total:
            to = min(e for e in ends if e > at)
        cuts.append(max(to, floor[s + 1]))
    out, slots = Counter(), Counter()
    for k, start in zip(keys, ends):
        shard = sum(c <= start for c in cuts[1:])
        for _, _, i, size, crc in sorted(groups[k], key=lambda r: r[:2]):
            out[i, size, crc, "bytes", shard, slots[shard], None] += 1
            slots[shard] += 1
    return out, low


@pytest.mark.parametrize("marks", [1 << 16, 40])
@pytest.mark.parametrize("case", ["corpus", "copies", "few", "one", "even"])
def test_shards_against_plain_python(spark, corpus, tmp_path, case, marks, monkeypatch):
    rng = random.Random(case)
    word = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    rows = {
        "corpus": [(i, t) for i, t, *_ in corpus[0]],
        "copies": [(i, "the same text again " * 3) for i in range(300)] + [(1000 + i, word(rng.randint(0, 90))) for i in range(500)],
        "few": [(1, "a"), (2, None), (3, ""), (None, "b"), (None, None)],
        "one": [(i, "x") for i in range(50)],
        "even": [(i, f"{i:05d}") for i in range(480)],
    }[case]
    monkeypatch.setattr(sharding, "MARKS", marks)
    monkeypatch.setattr(sharding, "FIRST_BITS", 14 if marks > 40 else 5)
    docs_of(spark, rows, ("key", "size", "shard", "part", "mid")).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(map(tuple, sharding.op13_sharding(spark, str(tmp_path)).collect()))
    want, capacity = plain_shards(rows)
    assert got == want
    held = Counter()
    for r, n in got.items():
        held[r[4]] += n * r[1]
    assert max(held.values()) <= capacity


def test_shards_sql_and_nothing(spark, sf_dir, empty_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet/*.parquet' WHERE length(text) < 5000 OR text IS NULL")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 5000 or text is null")
    got = Counter((r.id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.assign(docs).collect())
    want = Counter(r[:3] + r[4:6] for r in con.execute(sharding.ORACLE_SQL).fetchall())
    assert got == want
    assert sharding.op13_sharding(spark, empty_dir).count() == 0


def test_written_shards(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter(tuple(r[c] for c in docs.columns) for r in back.collect()) == Counter(map(tuple, docs.collect()))
    where = {}
    for r in back.collect():
        where.setdefault(r.text or "", set()).add(r.shard)
    assert all(len(x) == 1 for x in where.values())
