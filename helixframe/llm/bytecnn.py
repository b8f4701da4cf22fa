"""A byte convolutional network in numpy, shared by language identification and quality scoring.

Filters of several widths slide over the raw bytes of fixed-length windows. A filter of width w is a table of
w x 256 weights (one per offset and byte value), so its response is a sum of w table look-ups. Responses are
max-pooled over a window, rectified and fed to a softmax layer. Max pooling sends each filter's gradient to one
position of a window, which keeps training to a few seconds.
"""

from __future__ import annotations

import numpy as np


class ByteCNN:
    def __init__(self, classes: int, widths: tuple[int, ...], filters: int, fold: np.ndarray | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.widths, self.filters, self.classes = widths, filters, classes
        self.fold = np.arange(256, dtype=np.uint8) if fold is None else fold
        self.params = [rng.normal(0, 0.3 / np.sqrt(w), (w, 256, filters)).astype(np.float32) for w in widths]
        self.params += [np.zeros((len(widths), filters), np.float32), rng.normal(0, 0.2, (len(widths) * filters, classes)).astype(np.float32), np.zeros(classes, np.float32)]

    def pooled(self, x: np.ndarray):
        """Max-pooled responses of windows x (n, length) of bytes, and the positions of the maxima."""
        n, length = x.shape
        tops, spots = [], []
        for w, t in zip(self.widths, self.params):
            m = length - w + 1
            r = t[0].take(x[:, :m], axis=0)
            for k in range(1, w):
                r += t[k].take(x[:, k : k + m], axis=0)
            r = np.ascontiguousarray(r.transpose(0, 2, 1))
            spots.append(r.argmax(2))
            tops.append(np.take_along_axis(r, spots[-1][:, :, None], 2)[:, :, 0])
        return np.stack(tops, 1) + self.params[-3], spots

    def pairs(self) -> list[list[np.ndarray]]:
        """Per width its look-up tables over byte pairs (and one over single bytes if the width is odd): half the look-ups."""
        out = []
        for w, t in zip(self.widths, self.params):
            out.append([(t[k][:, None] + t[k + 1][None]).reshape(65536, -1) if k + 1 < w else t[k] for k in range(0, w, 2)])
        return out

    def logits(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Of windows x (n, length); tables: what pairs() gave."""
        length = x.shape[1]
        one = x.astype(np.intp)
        two = (one[:, :-1] << 8) | one[:, 1:]
        tops = []
        for w, t in zip(self.widths, tables):
            m = length - w + 1
            r = t[0].take(two[:, :m], axis=0, mode="clip")
            for k in range(2, w, 2):
                r += t[k // 2].take((two if k + 1 < w else one)[:, k : k + m], axis=0, mode="clip")
            while (m := r.shape[1]) > 1:  # halving is far faster than numpy's max over a middle axis
                half = (m + 1) // 2
                r = np.maximum(r[:, :half], r[:, m - half :])
            tops.append(r[:, 0])
        top = np.stack(tops, 1) + self.params[-3]
        return np.maximum(top, 0).reshape(len(x), -1) @ self.params[-2] + self.params[-1]

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 7) -> "ByteCNN":
        """Adam on the weighted cross-entropy of windows x (n, length) and classes y."""
        rng = np.random.default_rng(seed)
        x = self.fold[x]
        m, v, step = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                i = order[at : at + batch]
                xb, yb, n = x[i], y[i], len(i)
                top, spots = self.pooled(xb)
                act = np.maximum(top, 0).reshape(n, -1)
                z = act @ self.params[-2] + self.params[-1]
                p = softmax(z)
                p[np.arange(n), yb] -= 1
                p *= (weight[i] / n)[:, None]
                back = (p @ self.params[-2].T).reshape(top.shape) * (top > 0)
                grads = [np.zeros_like(t) for t in self.params]
                grads[-1], grads[-2], grads[-3] = p.sum(0), act.T @ p, back.sum(0)
                rows, cols = np.arange(n)[:, None], np.arange(self.filters)[None, :]
                for j, w in enumerate(self.widths):
                    for k in range(w):
                        np.add.at(grads[j][k], (xb[rows, spots[j] + k], cols), back[:, j])
                step += 1
                fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for q, g, a, b in zip(self.params, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= rate * fix * a / (np.sqrt(b) + 1e-8)
        return self


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def window_starts(offsets: np.ndarray, length: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover every text: (first byte, length in bytes, text) of each; an empty text gets one empty window."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-np.maximum(size - length, 0) // stride) + 1)
    doc = np.repeat(np.arange(len(size)), count)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][doc] + first * stride
    return start, np.clip(offsets[1:][doc] - start, 0, length), doc


def windows(raw: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """The bytes of windows, zero-padded to `length`."""
    if not len(raw):
        return np.zeros((len(start), length), np.uint8)
    at = start[:, None] + np.arange(length)[None, :]
    x = raw[np.minimum(at, len(raw) - 1)]
    short = size < length
    if short.any():
        x[short] *= (np.arange(length)[None, :] < size[short, None]).astype(np.uint8)
    return x


def window_logits(net: ByteCNN, tables: list, raw: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Logits of many windows, a cache-sized block of windows at a time; tables: net.pairs()."""
    block = max(1, 16384 // length)
    out = np.empty((len(start), net.classes), np.float32)
    for at in range(0, len(start), block):
        out[at : at + block] = net.logits(net.fold[windows(raw, start[at : at + block], size[at : at + block], length)], tables)
    return out
