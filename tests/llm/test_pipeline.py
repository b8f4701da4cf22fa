"""The stages one after another against plain Python, ids that repeat or are missing, and column names that clash."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from test_operators import packed_checks, plain_components, plain_fingerprint

import corpus_pipeline
from helixframe.llm import decontam, langid, lineclean, quality, secretscan, simhash, substrings, tokens, toxicity
from helixframe.llm.common import held_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_language(model, text):
    """Every window of the text through the network, filter by filter."""
    net, data = model.net, text.encode().lower()
    total = np.zeros(len(model.labels))
    for a in range(0, max(1, len(data)), langid.WINDOW):
        win = data[a : a + langid.WINDOW]
        x = np.frombuffer(win.ljust(langid.WINDOW, b"\0"), np.uint8)
        top = []
        for w, t in zip(net.widths, net.params):
            top.append(sum(t[k][x[k : langid.WINDOW - w + 1 + k]] for k in range(w)).max(0))
        z = np.maximum(np.stack(top) + net.params[-3], 0).reshape(-1) @ net.params[-2] + net.params[-1]
        e = np.exp(z - z.max())
        total += e / e.sum() * len(win)
    total /= max(1, len(data))
    return model.labels[int(total.argmax())], float(total.max())


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_stages_against_plain_python(spark, sf_dir, corpus, items):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs, model = spark.createDataFrame(rows, DOCS), None
    model = langid.fit(docs.where("lang is not null"))
    known = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1]) and plain_language(model, r[1])[1] >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    got = {}
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame([tuple(r) for r in stage(spark, step, sf_dir).collect()], DOCS)
        got[name] = [tuple(r) for r in step.collect()]
    assert Counter(got["language_id"]) == Counter(known)
    # One row of each class: the least id, of rows with that id any.
    ids, fps = [r[0] for r in known], [plain_fingerprint(r[1]) for r in known]
    classes = Counter(plain_components(range(len(known)), fps))
    left = got["simhash_near_dedup"]
    assert len(left) == len(classes) and not Counter(left) - Counter(known)
    component = plain_components(range(len(known)), fps)
    for c in classes:
        group = [known[i] for i in range(len(known)) if component[i] == c]
        assert sum(r in left for r in set(group)) == 1
        least = min((r[0] is None, r[0]) for r in group)
        assert [r for r in left if r in group][0][0] == least[1]
    wins = {tuple(w[k : k + 10]) for _, t in items if (w := plain_words(t)) for k in range(max(1, len(w) - 9))}
    clean = [r for r in left if not any(tuple(w[k : k + n]) in wins for w in [plain_words(r[1])] for n in {len(x) for x in wins} for k in range(len(w) - n + 1))]
    assert Counter(got["benchmark_decontamination"]) == Counter(clean)
    want = Counter()
    for i, t, lang, source, n in clean:
        spans = (base := secretscan.base_spans(t)) + secretscan.novel_spans(t, base)
        new = secretscan.redact(t, spans, "[secret]")
        want[i, new, lang, source, n if new == t else len(new)] += 1
    assert Counter(got["secret_scan"]) == want
    from tokenizers import Tokenizer

    whole, by = Tokenizer.from_file(tokens.tokenizer_path()), {}
    for r in got["secret_scan"]:
        by.setdefault(r[0], []).append(np.array(whole.encode(r[1], add_special_tokens=False).ids + [2], "<u4"))
    packed_checks(corpus_pipeline.run(spark, sf_dir).collect(), by, 4096)


WORDS = [f"word{i}" for i in range(400)]


def texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.sample(WORDS, 60)) for _ in range(n)]


@pytest.mark.parametrize(
    "rows, kept",
    [
        ([(1, 0), (None, 0), (None, 1), (3, 2)], [(1, 0), (None, 1), (3, 2)]),
        ([(1, 0), (9, 0), (9, 1)], [(1, 0), (9, 1)]),
        ([(1, 0), (9, 0), (9, 1), (9, 1)], [(1, 0), (9, 1)]),
        ([(None, 0), (None, 0), (None, 1), (None, 1)], [(None, 0), (None, 1)]),
        ([(5, 0), (5, 1), (5, 2), (2, 2)], [(2, 2), (5, 0), (5, 1)]),
    ],
)
def test_one_row_of_each_class_whatever_the_ids(spark, rows, kept):
    t = texts(3)
    docs = spark.createDataFrame([(i, t[k], "en") for i, k in rows], "doc_id long, text string, lang string")
    key = lambda x: str(x)
    assert sorted(((r.doc_id, t.index(r.text)) for r in simhash.keep_one_of_each(docs).collect()), key=key) == sorted(kept, key=key)


def test_filters_with_clashing_names(spark):
    from pyspark.sql import functions as F

    t = texts(3)
    names = ("__keep", "__rank", "__row", "row_hash", "kept_id", "kept_row", "alike", "__i", "__k", "bad_id", "bad_hash", "i", "k", "h", "fp", "root", "n", "u", "verdict", "kept", "w")
    docs = spark.createDataFrame([(1, t[0], "en", "s", 5), (2, t[0], "en", "s", 5), (3, t[1] + "\npassword = hunter2secret", "en", "s", 5), (4, t[2], "en", "s", 5)], DOCS).select("*", *(F.lit("x").alias(c) for c in names))
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == [1, 3, 4]
    bench = spark.createDataFrame([(1, " ".join(t[2].split()[5:20]))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()) == [1, 2, 3]
    assert any("[secret]" in r.text for r in secretscan.redact_secrets(docs).collect())
    for out in (simhash.keep_one_of_each(docs), decontam.drop_contaminated(docs, bench), secretscan.redact_secrets(docs), lineclean.clean(docs)):
        assert out.columns == docs.columns


def test_cleaned_texts(spark):
    good = "\n".join(" ".join(f"{w}{i}" for w in ("The", "text", "says", "something", "new", "here", "line")) + "." for i in range(8))
    bad = ["Home | News | Sport | Contact", "Home › News › Today", "https://www.example.com/a/b", "Page 3 of 12", "© 2020 Someone", "*** 12 ***", "All rights reserved by the owner."]
    docs = spark.createDataFrame([(1, good + "\n" + "\n".join(bad), "en", "s", 1), (2, "\n".join(bad * 3), "en", "s", 1), (None, good, "en", "s", 1)], DOCS)
    got = {r.doc_id: r for r in lineclean.clean(docs).collect()}
    assert got[1].text == good and got[1].n_chars == len(good) and got[None].text == good and 2 not in got


def test_hot_keys_are_searched_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62)
    fps = {int(base) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 6), replace=False)) for _ in range(400)} | {int(x) for x in rng.integers(0, 1 << 62, 100)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    plain = {(r.node, r.root) for r in simhash.stars(simhash.links(df)).collect()}
    monkeypatch.setattr(simhash, "BLOCK", 20)
    assert {(r.node, r.root) for r in simhash.stars(simhash.links(df)).collect()} == plain and len(plain) > 300


def test_many_unlike_fingerprints_under_one_key_take_seconds():
    rng = np.random.default_rng(7)
    n = 2 * simhash.BLOCK
    began = time.time()
    simhash.links_in_runs(np.zeros(n, np.int64), np.sort(rng.integers(0, 1 << 62, n)))
    assert time.time() - began < 60


def test_long_texts_take_seconds():
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    began = time.time()
    one = "secret " + "".join(rng.choice(letters) for _ in range(2_000_000))
    secretscan.novel_spans(one, secretscan.base_spans(one))
    many = "token=" + "x1;token;" * 100_000
    secretscan.novel_spans(many, secretscan.base_spans(many))
    assert time.time() - began < 40
    began = time.time()
    a = [f"w{i}" for i in range(1_000_000)]
    b = [w if i % 50 else "other" for i, w in enumerate(a)]
    spots = [i for i in range(0, len(a) - 6, 10) if i % 50 and all((i + k) % 50 for k in range(6))]
    out = substrings.segments(" ".join(a).encode(), " ".join(b).encode(), 0, 0, spots, spots, [6] * len(spots), 0.8)
    assert time.time() - began < 60 and out[0][1] - out[0][0] > 999_000


def test_longest_parts_against_all_pairs():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 9)
        gains, between = [rng.choice([1.0, 2.0, 3.0]) for _ in range(n)], [-rng.choice([0.0, 2.0, 5.0, 9.0]) for _ in range(n - 1)]
        lengths, gaps = [rng.randint(5, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n - 1)]

        def split(lo, hi):
            best = None
            for i in range(lo, hi):
                for j in range(i, hi):
                    if sum(gains[i : j + 1]) + sum(between[i:j]) >= 0:
                        size = sum(lengths[i : j + 1]) + sum(gaps[i:j])
                        if best is None or size > best[0]:
                            best = (size, i, j)
            return (best[0], [(best[1], best[2])] + ([] if best[1] == lo else split(lo, best[1])[1]) + ([] if best[2] + 1 == hi else split(best[2] + 1, hi)[1]))

        got = substrings.longest(gains, between, lengths, gaps)
        assert max(sum(lengths[i : j + 1]) + sum(gaps[i:j]) for i, j in got) == split(0, n)[0]
        assert all(sum(gains[i : j + 1]) + sum(between[i:j]) >= -1e-6 for i, j in got) and sorted(x for i, j in got for x in range(i, j + 1)) == list(range(n))


def test_recall_against_all_pairs(spark):
    """Passages of 55 to 90 words, exact or with a few edits, planted in two to five documents among shared lines."""
    rng = random.Random(21)
    fresh = iter(range(10**6))
    some = lambda n: [f"t{next(fresh)}" for _ in range(n)]
    lines = [some(12) for _ in range(6)]
    docs = [some(rng.randint(20, 60)) for _ in range(120)]
    planted = []
    for p in range(60):
        core = some(rng.randint(55, 90))
        if p % 4 == 0:
            core[10:22] = rng.choice(lines)
        for d in rng.sample(range(120), rng.randint(2, 5)):
            copy = [w if p % 2 or rng.random() > 0.04 else f"e{next(fresh)}" for w in core]
            planted.append((d, p, len(docs[d]), len(docs[d]) + len(copy)))
            docs[d] += copy + some(rng.randint(5, 30)) + (rng.choice(lines) if rng.random() < 0.3 else [])
    got = substrings.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()
    hit = {}
    for r in got:
        for d, a, b in ((r.doc_id, r.start, r.stop), (r.other_id, r.other_start, r.other_stop)):
            hit.setdefault(d, set()).update(range(a, b))
    found = [len(hit.get(d, set()) & set(range(a, b))) >= 0.8 * (b - a) for d, _, a, b in planted]
    inside = {d: {x for e, _, a, b in planted if e == d for x in range(a - 3, b + 3)} for d in range(120)}
    line_words = {w for x in lines for w in x}
    wrong = sum(docs[d][x] not in line_words for d, xs in hit.items() for x in xs - inside[d])
    assert np.mean(found) >= 0.95 and wrong == 0


def test_texts_under_one_id_are_searched_each(spark):
    fresh = iter(range(10**6))
    some = lambda n: " ".join(f"t{next(fresh)}" for _ in range(n))
    p, q = some(60), some(60)
    docs = [(1, f"{some(30)} {p} {some(5)}"), (2, f"{some(10)} {p} {some(300)}"), (2, f"{some(10)} {q} {some(20)}"), (3, f"{q} {some(40)}"), (2, f"{some(10)} {q} {some(20)}"), (None, p)]
    docs[4] = docs[2]
    got = substrings.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.other_id, r.stop - r.start) for r in got) == [(2, 1, 60), (3, 2, 60)]


def test_token_files_and_other_tokenizers(spark, corpus, tmp_path):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(corpus[0], DOCS)
    tokens.write_tokens(docs, str(tmp_path / "t"), row_group_bytes=1 << 16, page_rows=4)
    kinds, groups = {}, 0
    for f in sorted((tmp_path / "t").glob("*.parquet")):
        meta = pq.ParquetFile(f).metadata
        groups = max(groups, meta.num_row_groups)
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                x = meta.row_group(g).column(c)
                kinds.setdefault(x.path_in_schema, set()).update(x.encodings)
                assert x.has_offset_index and (x.has_column_index or "ids" in x.path_in_schema) and x.compression == "ZSTD"
    assert "DELTA_BINARY_PACKED" in kinds["doc_id"] and "DELTA_BINARY_PACKED" in kinds["part_start"]
    assert any("DICTIONARY" in e for e in next(v for k, v in kinds.items() if k.startswith("ids"))) and groups >= 1
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens.write_tokens(docs, str(tmp_path / "b"), path)
    whole = Tokenizer.from_file(path)
    want = Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t, *_ in corpus[0])
    assert Counter((r.doc_id, tuple(r.ids)) for r in tokens.read_tokens(spark, str(tmp_path / "b")).collect()) == want


def test_word_encoder_against_the_whole_tokenizer():
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path()
    enc, whole, rng = tokens.WordEncoder(path), Tokenizer.from_file(path), random.Random(8)
    letters = "abcXYZ 's't 're'LL d09.,;:!?-_<|>endoftext\n\t\r\x0b\x85\xa0 éÉß×÷ÀÿĀİıſK日本½²٣𝔄éﬁ​ '"
    for _ in range(6000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 24)))
        assert enc.encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


@pytest.mark.parametrize("name", ["language", "quality", "toxicity"])
def test_scores_are_plain_forward_passes(spark, sf_dir, corpus, name):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    some = [r for r in corpus[0] if r[0] is not None and r[0] in (0, 1, 5, 24, 25, 100, 103, 105)]
    if name == "language":
        model = langid.fit(docs.where(~held_out("doc_id", 4, 2)))
        got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
        for i, t, *_ in some:
            if t and re.search(r"[^\W\d_]", t):
                lang, score = plain_language(model, t)
                assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-4)
    elif name == "quality":
        model = quality.fit(docs, labels.where(~held_out("doc_id", 3, 1)))
        got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
        net = model.net
        for i, t, *_ in some:
            data, logits = (t or "").encode(), []
            for a in range(0, max(1, len(data) - quality.CHUNK + quality.STRIDE), quality.STRIDE):
                x = np.frombuffer(data[a : a + quality.CHUNK].ljust(quality.CHUNK, b"\0"), np.uint8)
                top = [sum(p[k][x[k : quality.CHUNK - w + 1 + k]] for k in range(w)).max(0) for w, p in zip(net.widths, net.params)]
                z = np.maximum(np.stack(top) + net.params[-3], 0).reshape(-1) @ net.params[-2] + net.params[-1]
                logits.append(z[1] - z[0])
            f = np.array([1, np.mean(logits), np.min(logits)]) @ model.mix
            assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(f, -30, 30))), abs=1e-3)
    else:
        model = toxicity.fit(docs, labels.where(~held_out("doc_id", 5, 0)))
        got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
        p, h = model.net.p, toxicity.HIDDEN
        sig = lambda x: 1 / (1 + np.exp(-x))
        for i, t, *_ in some:
            logits = []
            for win in toxicity.text_windows(t or ""):
                x = [model.net.inputs(*toxicity.word_rows([w]))[0] @ p["in"] + p["in_b"] for w in win]
                states = {}
                for way, lo, order in (("fw", 0, range(len(x))), ("bw", 3 * h, range(len(x) - 1, -1, -1))):
                    s, out = np.zeros(h), [None] * len(x)
                    for k in order:
                        a, v = s @ p[way], x[k][lo : lo + 3 * h]
                        z, r = sig(v[:h] + a[:h]), sig(v[h : 2 * h] + a[h : 2 * h])
                        s = (1 - z) * np.tanh(v[2 * h :] + r * a[2 * h :]) + z * s
                        out[k] = s
                    states[way] = out
                both = [np.concatenate([f, b]) for f, b in zip(states["fw"], states["bw"])] or [np.zeros(2 * h)]
                e = np.array([b @ p["att"] for b in both])
                w = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
                logits.append(float(sum(a * b for a, b in zip(w, both)) @ p["out"] + p["out_b"][0]))
            f = np.array([1, max(logits), np.mean(logits)]) @ model.mix
            assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(f, -30, 30))), abs=1e-3)


