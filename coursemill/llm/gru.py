"""A gated recurrent network over word ids with a class-factored softmax, in numpy.

A word's probability is P(class | state) times P(word | class, state) for words of the head,
which are dealt to classes of equal size by frequency. Words beyond the head belong to classes
(bands of frequency, and one for rare words) whose words share the class by their counts; that
share is the caller's. Documents lie one after the other in parallel streams, the state is
carried from window to window and set to zero where a document begins.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    """Sizes: state, classes of the head, words of each, classes beyond the head, input rows beyond the head, and input vectors."""

    hidden: int = 16
    heads: int = 16
    words: int = 32
    tails: int = 10
    buckets: int = 64
    width: int = 8

    @property
    def head(self) -> int:
        return self.heads * self.words

    def parts(self) -> dict[str, tuple[int, ...]]:
        h = self.hidden
        return {"x": (self.head + self.buckets, self.width), "w": (self.width, 3 * h), "b": (3 * h,), "u": (h, 3 * h), "wc": (h, self.heads + self.tails), "bc": (self.heads + self.tails,), "wo": (self.heads, h, self.words), "bo": (self.heads, self.words)}

    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.parts().values())

    def view(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, s in self.parts().items():
            n = int(np.prod(s))
            out[k] = flat[at : at + n].reshape(s)
            at += n
        return out


def initial(shape: Shape, class_counts: np.ndarray, word_counts: np.ndarray, seed: int = 7) -> np.ndarray:
    """Parameters that start as the unigram model: small random weights, and biases from the counts of classes and of the head's words; those that don't occur get next to nothing."""
    flat = np.random.default_rng(seed).normal(0, 0.1, shape.size()).astype(np.float32)
    p = shape.view(flat)
    p["w"] *= 3
    p["u"] *= 3
    p["wc"][:] = 0
    p["wo"][:] = 0
    p["bc"][:] = np.where(class_counts > 0, np.log(np.maximum(class_counts, 1) / max(class_counts.sum(), 1)), -30)
    words = word_counts.reshape(p["bo"].shape)
    p["bo"][:] = np.where(words > 0, np.log(np.maximum(words, 1) / np.maximum(words.sum(1, keepdims=True), 1)), -30)
    return flat


def streams(lengths: np.ndarray, n: int) -> list[np.ndarray]:
    """Documents dealt to at most n streams of like length, the longest first; streams from the longest to the shortest."""
    n = max(1, min(n, len(lengths)))
    heap, held = [(0, i) for i in range(n)], [[] for _ in range(n)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        total, i = heapq.heappop(heap)
        held[i].append(d)
        heapq.heappush(heap, (total + int(lengths[d]), i))
    return [np.asarray(held[i]) for _, i in sorted(heap, key=lambda x: (-x[0], x[1]))]


def windows(inputs: np.ndarray, targets: np.ndarray, offsets: np.ndarray, n_streams: int, steps: int) -> Iterator[tuple]:
    """(inputs, targets, document, begins, active) of (steps, streams) each, with only the streams that still have tokens.

    Documents are [offsets[d], offsets[d + 1]) of the flat arrays; a token's input is the
    word before it, and `begins` marks a document's first token.
    """
    lengths = np.diff(offsets)
    dealt = streams(lengths, n_streams)
    order = np.concatenate(dealt)
    size = np.array([int(lengths[d].sum()) for d in dealt])
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    order = order[lengths[order] > 0]
    first = np.cumsum(lengths[order]) - lengths[order]
    flat = np.ones(int(size.sum()), np.int32)  # where each token is in the given arrays, as differences first
    flat[first] = offsets[order] - np.concatenate([[0], (offsets[order] + lengths[order] - 1)[:-1]])[: len(order)]
    np.cumsum(flat, out=flat)
    inputs, targets, doc = inputs[flat], targets[flat], np.repeat(order.astype(np.int32), lengths[order])
    begins = np.zeros(len(flat), bool)
    begins[first] = True
    del flat
    for t in range(0, int(size.max()) if len(size) else 0, steps):
        k = int(np.searchsorted(-size, -t, "left"))
        index = start[:k] + t + np.arange(min(steps, int(size[0]) - t))[:, None]
        active = index < (start + size)[:k]
        index = np.where(active, index, (start + size)[:k] - 1)
        yield inputs[index], targets[index], doc[index], begins[index], active


def forward(p: dict, x: np.ndarray, begins: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list]:
    """States after each step of a window, and what the way back needs: (state before, reset gate, update gate, recurrent candidate, candidate), each (steps, streams, hidden)."""
    n, keep = h.shape[1], (~begins).astype(np.float32)[:, :, None]
    into = (p["x"][x.ravel()] @ p["w"] + p["b"]).reshape(*x.shape, 3 * n)
    u, out = p["u"], np.empty((*x.shape, n), np.float32)
    before, gates, inner, cand = np.empty_like(out), np.empty((*x.shape, 2 * n), np.float32), np.empty_like(out), np.empty_like(out)
    for t in range(len(x)):
        h = np.multiply(h, keep[t], before[t])
        a = h @ u
        g = np.add(into[t, :, : 2 * n], a[:, : 2 * n], gates[t])
        g *= 0.5
        np.tanh(g, g)
        g *= 0.5
        g += 0.5
        inner[t] = a[:, 2 * n :]
        c = np.multiply(g[:, :n], inner[t], cand[t])
        c += into[t, :, 2 * n :]
        np.tanh(c, c)
        d = h - c
        d *= g[:, n:]
        h = np.add(c, d, out[t])
    return out, [before, gates[:, :, :n], gates[:, :, n:], inner, cand]


def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials, their sums) of rows. One shift for all rows does, as logits differ by far less than the exponent's range; the floor keeps a logarithm finite."""
    x -= x.max()
    e = np.exp(x)
    return e, e @ np.ones(e.shape[1], np.float32) + np.float32(1e-30)


def log_probs(p: dict, shape: Shape, states: np.ndarray, targets: np.ndarray, classes: np.ndarray, back: dict | None = None) -> np.ndarray:
    """Natural log of each target's class, times that of the word in its class for words of the head.

    targets: word numbers, those from shape.head on stand for no word of the head. With
    `back`, gradients of the summed negative logs are added to its parts and to back["states"].
    """
    n = np.arange(len(states))
    logits = states @ p["wc"]
    logits += p["bc"]
    e, total = _softmax(logits)
    out = logits[n, classes] - np.log(total)
    if back is not None:
        e /= total[:, None]
        e[n, classes] -= 1
        back["wc"] += states.T @ e
        back["bc"] += e.sum(0)
        back["states"] += e @ p["wc"].T
    order = np.argsort(classes, kind="stable")
    edges = np.searchsorted(classes[order], np.arange(shape.heads + 1))
    words = targets % shape.words
    for c in np.flatnonzero(np.diff(edges)).tolist():
        i = order[edges[c] : edges[c + 1]]
        s, w, k = states[i], words[i], np.arange(len(i))
        logits = s @ p["wo"][c]
        logits += p["bo"][c]
        e, total = _softmax(logits)
        out[i] += logits[k, w] - np.log(total)
        if back is not None:
            e /= total[:, None]
            e[k, w] -= 1
            back["wo"][c] += s.T @ e
            back["bo"][c] += e.sum(0)
            back["states"][i] += e @ p["wo"][c].T
    return out


def backward(p: dict, x: np.ndarray, begins: np.ndarray, kept: list, d_out: np.ndarray, back: dict) -> None:
    """Adds the gradients of the recurrent part; d_out: that of each step's state. What came before the window gets none."""
    h, r, z, s, c = kept
    n = d_out.shape[2]
    to_c, to_r, to_z = (1 - z) * (1 - c * c), s * r * (1 - r), (h - c) * z * (1 - z)
    keep, u_t = (~begins).astype(np.float32)[:, :, None], np.ascontiguousarray(p["u"].T)
    d_a, d_c, d_h = np.empty((*x.shape, 3 * n), np.float32), np.empty_like(d_out), np.zeros(d_out.shape[1:], np.float32)
    for t in range(len(x) - 1, -1, -1):
        d = d_out[t] + d_h
        a, g = d_a[t], np.multiply(d, to_c[t], d_c[t])
        np.multiply(g, to_r[t], a[:, :n])
        np.multiply(d, to_z[t], a[:, n : 2 * n])
        np.multiply(g, r[t], a[:, 2 * n :])
        d *= z[t]
        d += a @ u_t
        d_h = np.multiply(d, keep[t], d)
    back["u"] += h.reshape(-1, n).T @ d_a.reshape(-1, 3 * n)
    d_a[:, :, 2 * n :] = d_c
    d_into, ids = d_a.reshape(-1, 3 * n), x.ravel()
    back["w"] += p["x"][ids].T @ d_into
    back["b"] += d_into.sum(0)
    d_x = d_into @ p["w"].T
    rows, width = back["x"].shape
    back["x"] += np.bincount((ids[:, None] * width + np.arange(width)).ravel(), d_x.ravel(), rows * width).reshape(rows, width).astype(np.float32)


def classes_of(shape: Shape, targets: np.ndarray) -> np.ndarray:
    """Class of each target: of the head by its number, beyond it number - head + heads."""
    return np.where(targets < shape.head, targets // shape.words, targets - shape.head + shape.heads).astype(np.int16)


class Trainer:
    """Truncated backpropagation through windows, with step sizes that shrink by the gradients seen (Adagrad).

    flat and seen: parameters and sums of squared gradients, both as one vector.
    """

    def __init__(self, shape: Shape, flat: np.ndarray, seen: np.ndarray, n_streams: int = 480, steps: int = 16, rate: float = 0.1, clip: float = 1.0, segment: int = 256):
        self.shape, self.flat, self.seen = shape, flat.astype(np.float32).copy(), seen.astype(np.float32).copy()
        self.n_streams, self.steps, self.rate, self.clip, self.segment, self.tokens = n_streams, steps, rate, clip, segment, 0

    def gradient(self, x, targets, begins, active, h) -> tuple[float, np.ndarray, np.ndarray]:
        """(summed negative log probability, its gradient, the last states) of one window."""
        grad = np.zeros(self.shape.size(), np.float32)
        p, back = self.shape.view(self.flat), self.shape.view(grad)
        states, kept = forward(p, x, begins, h)
        on = np.flatnonzero(active.ravel())
        s, y = states.reshape(-1, self.shape.hidden)[on], targets.ravel()[on]
        back["states"] = np.zeros_like(s)
        loss = -float(log_probs(p, self.shape, s, y, classes_of(self.shape, y), back).sum(dtype=np.float64))
        d_out = np.zeros((states.shape[0] * states.shape[1], self.shape.hidden), np.float32)
        d_out[on] = back["states"]
        backward(p, x, begins, kept, d_out.reshape(states.shape), back)
        return loss, grad, states[-1]

    def learn(self, inputs: np.ndarray, targets: np.ndarray, offsets: np.ndarray) -> float:
        """One pass over documents; the summed negative log probability before each step.

        Of a document longer than `segment` tokens each segment begins with the state zero, so
        that streams are even. A window counts by its tokens, so the last ones, in which few
        streams are left, don't weigh more than others.
        """
        h, total, whole = None, 0.0, self.n_streams * self.steps
        offsets = np.unique(np.concatenate([offsets, *(np.arange(a, b, self.segment) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) if b - a > self.segment)]))
        for x, y, _, begins, active in windows(inputs, targets, offsets, self.n_streams, self.steps):
            h = np.zeros((x.shape[1], self.shape.hidden), np.float32) if h is None else h[: x.shape[1]]
            loss, grad, h = self.gradient(x, y, begins, active, h)
            n = int(active.sum())
            grad /= whole
            norm = float(np.sqrt(grad @ grad))
            if norm > self.clip:
                grad *= self.clip / norm
            self.seen += grad * grad
            self.flat -= self.rate * grad / (np.sqrt(self.seen) + 1e-6)
            total, self.tokens = total + loss, self.tokens + n
        return total


def score(shape: Shape, flat: np.ndarray, inputs: np.ndarray, targets: np.ndarray, offsets: np.ndarray, n_streams: int = 480, steps: int = 16) -> np.ndarray:
    """Summed natural log of each document's targets (the class alone beyond the head), over whole documents."""
    p, out, h = shape.view(flat), np.zeros(len(offsets) - 1), None
    for x, y, doc, begins, active in windows(inputs, targets, offsets, n_streams, steps):
        h = np.zeros((x.shape[1], shape.hidden), np.float32) if h is None else h[: x.shape[1]]
        states, _ = forward(p, x, begins, h)
        h = states[-1]
        on = active.ravel()
        s, t, d = states.reshape(-1, shape.hidden), y.ravel(), doc.ravel()
        if not on.all():
            s, t, d = s[on], t[on], d[on]
        out += np.bincount(d, log_probs(p, shape, s, t, classes_of(shape, t)), len(out))
    return out
