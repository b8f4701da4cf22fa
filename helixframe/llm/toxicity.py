"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's words are read in overlapping windows of 32 words that start every 24 words. The input of a step joins a
hashed word embedding with the mean of hashed character-trigram embeddings of the word, so that spellings never seen
in training still count. Attention pools a window's states into one logit. All windows are scored; a text's score is
the logistic of a learned combination of its highest and mean window logit. Only a bounded sample of labelled rows
(`sample_rows`, chosen by a hash of the id, half of each label) is used for training, by the window that speaks most
for the label, since a toxic text may be toxic in one place only. At most `windows_per_row` windows of a labelled text,
evenly spread, go to the driver (256 are 6,150 words: nearly every text has fewer); they are cut out in the tasks.

Defined results: null and empty texts are scored as one empty window. Without labels of both kinds every score is the
share of label 1 (0 without labels). Repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytecnn import window_starts
from .common import held_out, labelled_sample, small_batches, spread, table

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_SIZE, CHAR_SIZE, WORD_ROWS, CHAR_ROWS = 8, 8, 8, 1 << 14, 1 << 12
SAMPLE_ROWS = 2000
#: Windows of one labelled text that training looks at, at most.
WINDOWS_PER_ROW = 256
#: Texts of the sample that must hold a word for it to get an embedding of its own.
COMMON = 4
REMEMBERED = 250_000
EDGES = ".,;:!?\"'()[]{}<>|#*$%&-_=+~/\\"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def word_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct words: hashed word row, hashed trigram rows of all of them, and where each word's trigrams start."""
    forms = [w.lower().strip(EDGES) for w in words]
    row = np.array([xxhash.xxh32_intdigest(f.encode()) % WORD_ROWS for f in forms], np.int64)
    coded = [b"^" + f.encode() + b"$$" for f in forms]
    size = np.fromiter(map(len, coded), np.int64, len(coded)) - 2
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
    start = np.cumsum(size + 2) - size - 2
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    tri = ((data[at] * 65536 + data[at + 1] * 256 + data[at + 2]) * 2654435761 >> 7) % CHAR_ROWS
    return row, tri, np.cumsum(size) - size


class BiGRU:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        f = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        h = HIDDEN
        self.p = {
            "word": f(WORD_ROWS + 1, WORD_SIZE, scale=0.1), "char": f(CHAR_ROWS, CHAR_SIZE, scale=0.1),
            "in": f(WORD_SIZE + CHAR_SIZE, 6 * h, scale=0.3), "in_b": np.zeros(6 * h, np.float32),
            "fw": f(h, 3 * h, scale=0.3), "bw": f(h, 3 * h, scale=0.3),
            "att": f(2 * h, scale=0.3), "out": f(2 * h, scale=0.3), "out_b": np.zeros(1, np.float32),
        }
        #: Word rows that training met in several texts; the rest share the last row, so that no text is learnt by its own words.
        self.common = np.ones(WORD_ROWS, bool)

    def rows(self, row: np.ndarray) -> np.ndarray:
        return np.where(self.common[row], row, WORD_ROWS)

    def inputs(self, row, tri, start) -> np.ndarray:
        """Embeddings of words: (n, word and character part)."""
        count = np.diff(np.append(start, len(tri)))[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][self.rows(row)], np.add.reduceat(self.p["char"][tri], start, axis=0) / count], 1)

    def states(self, x: np.ndarray, mask: np.ndarray, name: str, keep: bool = False):
        """Hidden states of one direction for projected inputs x (steps, n, 3h); saved values for training if asked for."""
        h, u, (steps, n, _) = HIDDEN, self.p[name], x.shape
        state, out, saved = np.zeros((n, h), np.float32), np.empty((steps, n, h), np.float32), []
        for t in range(steps) if name == "fw" else range(steps - 1, -1, -1):
            a = state @ u
            gate = sigmoid(x[t, :, : 2 * h] + a[:, : 2 * h])
            z, r, q = gate[:, :h], gate[:, h:], a[:, 2 * h :]
            new = np.tanh(x[t, :, 2 * h :] + r * q)
            nxt = (new + z * (state - new)) * mask[t]
            if keep:
                saved.append((t, state, z, r, q, new))
            state = out[t] = nxt
        return out, saved

    def pool(self, both: np.ndarray, mask: np.ndarray):
        """Attention weights (steps, n, 1), context (n, 2h) and logit (n)."""
        e = (both @ self.p["att"])[:, :, None] + (mask - 1) * 1e9
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        ctx = (w * both).sum(0)
        return w, ctx, ctx @ self.p["out"] + self.p["out_b"][0]

    def logits(self, projected: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of windows: at (n, WINDOW) are rows of projected inputs, row 0 being no word."""
        out, h = np.empty(len(at), np.float32), 3 * HIDDEN
        for i in range(0, len(at), 1024):
            ids = at[i : i + 1024].T
            mask = (ids > 0)[:, :, None].astype(np.float32)
            x = projected.take(ids, axis=0, mode="clip")
            both = np.concatenate([self.states(x[:, :, :h], mask, "fw")[0], self.states(x[:, :, h:], mask, "bw")[0]], 2)
            out[i : i + 1024] = self.pool(both, mask)[2]
        return out

    def gradients(self, row, tri, start, at, target, weight):
        """Gradients of the weighted logistic loss of windows at (n, WINDOW), rows of the words given, 0 being no word."""
        h, p = HIDDEN, self.p
        e = self.inputs(row, tri, start)
        proj = np.concatenate([np.zeros((1, 6 * h), np.float32), e @ p["in"] + p["in_b"]])
        ids = at.T
        mask = (ids > 0)[:, :, None].astype(np.float32)
        x = proj[ids]
        fw, saved_f = self.states(x[:, :, : 3 * h], mask, "fw", True)
        bw, saved_b = self.states(x[:, :, 3 * h :], mask, "bw", True)
        both = np.concatenate([fw, bw], 2)
        w, ctx, z = self.pool(both, mask)
        dz = (sigmoid(z) - target) * weight / weight.sum()
        g = {"out": ctx.T @ dz, "out_b": dz.sum(keepdims=True)}
        dctx = dz[:, None] * p["out"]
        dw = (dctx[None] * both).sum(2, keepdims=True)
        de = w * (dw - (w * dw).sum(0))
        g["att"] = (de * both).sum((0, 1))
        dboth = w * dctx[None] + de * p["att"]
        dx = np.zeros_like(x)
        for name, saved, lo in (("fw", saved_f, 0), ("bw", saved_b, 1)):
            u, du, carry = p[name], np.zeros_like(p[name]), 0
            for t, prev, zt, r, q, new in reversed(saved):
                dh = (dboth[t, :, lo * h : lo * h + h] + carry) * mask[t]
                dn = dh * (1 - zt) * (1 - new * new)
                dzt, dr = dh * (prev - new) * zt * (1 - zt), dn * q * r * (1 - r)
                da = np.concatenate([dzt, dr, dn * r], 1)
                dx[t, :, 3 * h * lo : 3 * h * (lo + 1)] = np.concatenate([dzt, dr, dn], 1)
                du += prev.T @ da
                carry = dh * zt + da @ u.T
            g[name] = du
        dproj = np.zeros_like(proj)
        np.add.at(dproj, ids.ravel(), dx.reshape(-1, 6 * h))
        dproj = dproj[1:]
        g["in"], g["in_b"] = e.T @ dproj, dproj.sum(0)
        de = dproj @ p["in"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], self.rows(row), de[:, :WORD_SIZE])
        count = np.diff(np.append(start, len(tri)))
        g["char"] = np.zeros_like(p["char"])
        np.add.at(g["char"], tri, np.repeat(de[:, WORD_SIZE:] / count[:, None], count, axis=0))
        return g


class Reader:
    """Turns texts into windows of rows of projected inputs; remembers words, within a bound."""

    def __init__(self, net: BiGRU):
        self.net, self.known, self.table, self.n = net, {}, np.zeros((1 << 12, 6 * HIDDEN), np.float32), 1

    def rows(self, words: list[str]) -> list[int]:
        known = self.known
        try:
            return list(map(known.__getitem__, words))
        except KeyError:
            new = list(set(words).difference(known))
            if self.n + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(len(new), len(self.table)), 6 * HIDDEN), np.float32)])
            for at in range(0, len(new), 4096):
                some = new[at : at + 4096]
                self.table[self.n : self.n + len(some)] = self.net.inputs(*word_rows(some)) @ self.net.p["in"] + self.net.p["in_b"]
                known.update(zip(some, range(self.n, self.n + len(some))))
                self.n += len(some)
            return list(map(known.__getitem__, words))

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(n, WINDOW) rows of the table and the text of each window."""
        if self.n > REMEMBERED:
            self.known, self.n = {}, 1
        words = [t.split() for t in texts]
        flat = np.array(self.rows([w for x in words for w in x]), np.int64)
        return word_windows(flat, np.cumsum([0, *map(len, words)]))


def word_windows(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, WINDOW) values of flat, 0 beyond a text's end, and the text of each window."""
    start, size, doc = window_starts(offsets, WINDOW, STRIDE)
    if not len(flat):
        return np.zeros((len(start), WINDOW), np.int64), doc
    at = np.minimum(start[:, None] + np.arange(WINDOW), len(flat) - 1)
    return flat[at] * (np.arange(WINDOW) < size[:, None]), doc


def padded_windows(texts: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(n, WINDOW) values of the windows of all texts, 0 beyond a window's end, and the text of each window."""
    flat = [win for x in texts for win in x]
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    out = np.zeros((len(flat), WINDOW), np.int64)
    out[np.arange(WINDOW) < size[:, None]] = [v for win in flat for v in win]
    return out, np.repeat(np.arange(len(texts)), [len(x) for x in texts])


def text_features(logit: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per text: 1, highest and mean logit of its windows."""
    first = np.searchsorted(doc, np.arange(n))
    return np.stack([np.ones(n), np.maximum.reduceat(logit, first), np.add.reduceat(logit, first) / np.diff(np.append(first, len(doc)))], 1)


class ToxicityModel:
    def __init__(self, net: BiGRU | None, prior: float, mix: np.ndarray | None):
        self.net, self.prior, self.mix = net, prior, mix

    def scores(self, texts: list[str], reader: Reader | None) -> np.ndarray:
        if self.net is None or not texts:
            return np.full(len(texts), self.prior)
        at, doc = reader.windows(texts)
        f = text_features(self.net.logits(reader.table, at).astype(np.float64), doc, len(texts))
        return 1 / (1 + np.exp(-np.clip(f @ self.mix, -30, 30)))


def text_windows(text: str, most: int | None = None) -> list[list[str]]:
    """The words of a text's windows, or of `most` of them, evenly spread."""
    words = text.split()
    start, size, _ = window_starts(np.array([0, len(words)]), WINDOW, STRIDE)
    pick = spread(len(start), most) if most else range(len(start))
    return [words[start[k] : start[k] + size[k]] for k in pick]


def train(texts: list[list[list[str]]], labels: np.ndarray, steps: int = 500, docs_per_step: int = 24, rate: float = 0.01, seed: int = 5) -> ToxicityModel:
    """texts: the words of the windows of each text."""
    rng, net = np.random.default_rng(seed), BiGRU(seed)
    names = {w: i for i, w in enumerate(dict.fromkeys(w for x in texts for win in x for w in win))}
    if not names:
        return ToxicityModel(None, float(labels.mean()), None)
    row, tri, start = word_rows(list(names))
    size = np.diff(np.append(start, len(tri)))
    every, doc = padded_windows([[[names[w] + 1 for w in win] for win in x] for x in texts])
    of = np.split(np.arange(len(doc)), np.cumsum(np.bincount(doc, minlength=len(texts)))[:-1])
    texts_with = np.bincount(row[np.concatenate([(u := np.unique(every[x]))[u > 0] for x in of]) - 1], minlength=WORD_ROWS)
    net.common = texts_with >= COMMON
    kinds = [np.flatnonzero(labels == k) for k in (0, 1)]
    m, v = {k: np.zeros_like(a) for k, a in net.p.items()}, {k: np.zeros_like(a) for k, a in net.p.items()}
    for step in range(1, steps + 1):
        docs = np.concatenate([rng.choice(k, docs_per_step // 2) for k in kinds])
        wins = np.concatenate([of[d] for d in docs])
        owner = np.repeat(np.arange(len(docs)), [len(of[d]) for d in docs])
        used, inverse = np.unique(every[wins], return_inverse=True)
        inverse = inverse.reshape(-1, WINDOW) + (used[0] != 0)
        w = used[used > 0] - 1
        tri_at = np.repeat(start[w] - (np.cumsum(size[w]) - size[w]), size[w]) + np.arange(size[w].sum())
        local = (row[w], tri[tri_at], np.cumsum(size[w]) - size[w])
        if not len(w):
            continue
        proj = np.concatenate([np.zeros((1, 6 * HIDDEN), np.float32), net.inputs(*local) @ net.p["in"] + net.p["in_b"]])
        z = net.logits(proj, inverse)
        # The windows that speak most for toxicity stand for their text.
        rank = np.lexsort((-z, owner))
        first = np.searchsorted(owner[rank], np.arange(len(docs)))
        place = np.arange(len(rank)) - first[owner[rank]]
        pick = rank[place < (3 if step <= steps // 2 else 1)]
        target = labels[docs[owner[pick]]].astype(np.float32)
        g = net.gradients(*local, inverse[pick], target, np.ones(len(pick), np.float32))
        fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, q in net.p.items():
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.001 * (g[k] * g[k] - v[k])
            q -= rate * fix * m[k] / (np.sqrt(v[k]) + 1e-8)
    model = ToxicityModel(net, 0.5, np.array([0.0, 1.0, 0.0]))
    reader = Reader(net)
    f = []
    for at in range(0, len(texts), 64):
        some = texts[at : at + 64]
        ids, doc = padded_windows([[reader.rows(win) for win in x] for x in some])
        f.append(text_features(net.logits(reader.table, ids).astype(np.float64), doc, len(some)))
    f, scale = np.concatenate(f), np.array([1.0, 4.0, 4.0])
    mix = np.array([0.0, 1.0, 0.0])
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(f / scale @ mix, -30, 30)))
        mix -= 0.5 * ((f / scale).T @ (p - labels) / len(labels) + 1e-3 * mix)
    model.mix = mix / scale
    return model


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, windows_per_row: int = WINDOWS_PER_ROW) -> ToxicityModel:
    """Train on at most `sample_rows` labelled rows, half of each label, and `windows_per_row` windows of each."""

    def cut(batches):
        for b in batches:
            parts = [[" ".join(win) for win in text_windows(t, windows_per_row)] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(parts, pa.list_(pa.string()))], ["u", "y", "parts"])

    sample = labelled_sample(docs, labels, text_col, label_col, id_col, "toxicity", sample_rows).select("u", "y", "t")
    rows = sorted(sample.mapInArrow(cut, "u bigint, y int, parts array<string>").collect(), key=lambda r: (r.y, r.u, r.parts))
    y = np.array([r.y for r in rows])
    if len(set(y.tolist())) < 2:
        return ToxicityModel(None, float(y.mean()) if len(y) else 0.0, None)
    return train([[win.split() for win in r.parts] for r in rows], y)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row of docs."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        reader = Reader(model.net) if model.net else None
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(texts, reader), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, fit(docs, labels.where(~held_out("doc_id", 5, 0))))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
