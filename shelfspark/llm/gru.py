"""A bidirectional gated recurrent network over bytes, in numpy.

Both directions read a text in segments of ``SEGMENT`` bytes, each from a zero
state. A step gates the state with z and r and proposes c:

    z, r = gate(W[x] + h U),  c = soft(W[x] + r * (h U)),  h += z * (c - h)

with soft(v) = v / (1 + |v|) and gate(v) = (1 + soft(v)) / 2. Every position gets
a softmax over the labels from both states. Training is backpropagation through
time over whole segments with Adam on the mean cross-entropy of all positions.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 128
HIDDEN = 8


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded segments of all texts, the valid bytes of each, and the text each belongs to."""
    size = np.array([len(t) for t in texts], np.int64)
    count = -(-size // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), count)
    out = np.zeros((int(count.sum()), SEGMENT), np.uint8)
    first = np.cumsum(count) - count
    flat = out.reshape(-1)
    for t, a in zip(texts, first.tolist()):
        flat[a * SEGMENT:a * SEGMENT + len(t)] = np.frombuffer(t, np.uint8)
    valid = np.minimum(SEGMENT, size[owner] - (np.arange(len(owner)) - first[owner]) * SEGMENT)
    return out, valid, owner


class ByteGru:
    """Parameters of both directions and of the output; ``labels`` names the classes."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        h, n = hidden, len(labels)
        self.p = {}
        for d in "fb":
            self.p["W" + d] = r.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.p["U" + d] = r.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
            self.p["W" + d][:, :h] -= 1.5  # states change slowly at first
        self.p["V"] = r.normal(0, 0.3, (2 * h, n)).astype(np.float32)
        self.p["o"] = np.zeros(n, np.float32)

    # -- training ---------------------------------------------------------

    def _forward(self, x: np.ndarray, d: str):
        """States after each step, and what the way back needs; x is (steps, rows) in reading order."""
        h, w, u = self.hidden, self.p["W" + d], self.p["U" + d]
        steps, rows = x.shape
        state = np.zeros((rows, h), np.float32)
        before = np.empty((steps, rows, h), np.float32)
        soft = np.empty((steps, rows, 3 * h), np.float32)  # soft(z), soft(r), c
        inner = np.empty((steps, rows, h), np.float32)     # h U for c, before r
        for t in range(steps):
            before[t] = state
            a, b = w[x[t]], state @ u
            zr = a[:, :2 * h] + b[:, :2 * h]
            zr /= 1 + np.abs(zr)
            inner[t] = b[:, 2 * h:]
            c = a[:, 2 * h:] + (0.5 + 0.5 * zr[:, h:]) * inner[t]
            c /= 1 + np.abs(c)
            soft[t, :, :2 * h], soft[t, :, 2 * h:] = zr, c
            state = state + (0.5 + 0.5 * zr[:, :h]) * (c - state)
        after = np.concatenate([before[1:], state[None]])
        return after, (before, soft, inner)

    def _backward(self, x, d, kept, upstream, grads):
        h, u = self.hidden, self.p["U" + d]
        before, soft, inner = kept
        delta = np.empty_like(soft)       # gradients of the pre-activations
        through = np.empty_like(soft)     # the same, of h U
        carry = np.zeros_like(before[0])
        for t in range(len(x) - 1, -1, -1):
            g = upstream[t] + carry
            z, r, c = 0.5 + 0.5 * soft[t, :, :h], 0.5 + 0.5 * soft[t, :, h:2 * h], soft[t, :, 2 * h:]
            dc = g * z * (1 - np.abs(c)) ** 2
            delta[t, :, :h] = 0.5 * g * (c - before[t]) * (1 - np.abs(soft[t, :, :h])) ** 2
            delta[t, :, h:2 * h] = 0.5 * dc * inner[t] * (1 - np.abs(soft[t, :, h:2 * h])) ** 2
            delta[t, :, 2 * h:] = dc
            through[t, :, :2 * h], through[t, :, 2 * h:] = delta[t, :, :2 * h], dc * r
            carry = g * (1 - z) + through[t] @ u.T
        grads["U" + d] = before.reshape(-1, h).T @ through.reshape(-1, 3 * h)
        flat, at = delta.reshape(-1, 3 * h), x.reshape(-1)
        grads["W" + d] = np.stack([np.bincount(at, flat[:, j], 256) for j in range(3 * h)], 1).astype(np.float32)

    def loss(self, x: np.ndarray, valid: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over the valid positions of segments x (rows, steps), and its gradients."""
        steps, h = x.shape[1], self.hidden
        forth = np.ascontiguousarray(x.T)
        back = forth[::-1]
        hf, kf = self._forward(forth, "f")
        hb, kb = self._forward(back, "b")
        both = np.concatenate([hf, hb[::-1]], 2)
        logits = both @ self.p["V"] + self.p["o"]
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        weight = (np.arange(steps)[:, None] < valid[None]).astype(np.float32)
        weight /= weight.sum()
        at = np.arange(len(y))
        value = float(-(np.log(p[:, at, y] + 1e-9) * weight).sum())
        p[:, at, y] -= 1
        p *= weight[:, :, None]
        grads = {"V": both.reshape(-1, 2 * h).T @ p.reshape(-1, p.shape[2]), "o": p.sum((0, 1))}
        up = p @ self.p["V"].T
        self._backward(forth, "f", kf, up[:, :, :h], grads)
        self._backward(back, "b", kb, up[::-1, :, h:], grads)
        return value, grads

    def fit(self, x: np.ndarray, valid: np.ndarray, y: np.ndarray, rounds: int = 240, batch: int = 192, rate: float = 0.02, seed: int = 11) -> ByteGru:
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, rounds + 1):
            rows = r.integers(0, len(x), min(batch, len(x)))
            _, grads = self.loss(x[rows], valid[rows], y[rows])
            norm = np.sqrt(sum(float((g ** 2).sum()) for g in grads.values()))
            now = rate * min(1, 2 * (1 - step / (rounds + 1)))
            for k, g in grads.items():
                g = g / max(1.0, norm)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.p[k] -= (now * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
        return self

    # -- prediction -------------------------------------------------------

    def _states(self, x: np.ndarray, d: str, out: np.ndarray) -> None:
        """States after each step of x (steps, rows) into out (steps, hidden, rows): features first, so that gates are contiguous."""
        h = self.hidden
        w, u = np.ascontiguousarray(self.p["W" + d].T), np.ascontiguousarray(self.p["U" + d].T)
        rows = x.shape[1]
        state = np.zeros((h, rows), np.float32)
        a, b = np.empty((3 * h, rows), np.float32), np.empty((3 * h, rows), np.float32)
        mid, one = np.empty((2 * h, rows), np.float32), np.empty((h, rows), np.float32)
        for t in range(len(x)):
            np.take(w, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, state, out=b)
            zr, c = a[:2 * h], a[2 * h:]
            zr += b[:2 * h]
            np.abs(zr, out=mid)
            mid += 1
            zr /= mid
            zr += 1
            zr *= 0.5
            np.multiply(zr[h:], b[2 * h:], out=one)
            c += one
            np.abs(c, out=one)
            one += 1
            c /= one
            c -= state
            c *= zr[:h]
            state = np.add(state, c, out=out[t])

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities of every position of segments x (rows, steps): (steps, labels, rows)."""
        rows, steps = x.shape
        forth = np.ascontiguousarray(x.T).astype(np.intp)
        both = np.empty((steps, 2 * self.hidden, rows), np.float32)
        self._states(forth, "f", both[:, :self.hidden])
        self._states(forth[::-1], "b", both[::-1, self.hidden:])
        p = np.matmul(np.ascontiguousarray(self.p["V"].T), both)
        p += self.p["o"][:, None]
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p

    def pooled(self, texts: list[bytes], rows: int = 1024) -> np.ndarray:
        """Per text the mean label probabilities over all its positions; empty texts get zeros."""
        x, valid, owner = cut(texts)
        total = np.zeros((len(texts), len(self.labels)))
        for a in range(0, len(x), rows):
            part = slice(a, a + rows)
            p = self.positions(x[part])
            short = np.flatnonzero(valid[part] < SEGMENT)
            if len(short):
                p[:, :, short] *= (np.arange(SEGMENT)[:, None] < valid[part][short])[:, None, :]
            np.add.at(total, owner[part], p.sum(0).T)
        return total / np.maximum(1, [len(t) for t in texts])[:, None]
