"""A character tagger in numpy: bidirectional LSTM under a CRF layer.

Tags are O and, per kind, B and I. Sequences of a batch have one length; shorter ones are padded
with a class of their own, whose tag is O.
"""

from __future__ import annotations

import numpy as np

#: Classes of characters: padding, the printable ASCII ones, and five groups of others.
PAD, OTHER = 0, 96
N_CLASSES = OTHER + 5
BLOCKED = np.float32(-1e4)


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    out = points - 31
    out[points == 10] = OTHER
    out[(points < 32) & (points != 10) | (points == 127)] = OTHER + 1
    high = points > 127
    if high.any():
        kind = [OTHER + 2 if c.isalpha() else OTHER + 3 if c.isspace() else OTHER + 4
                for c in map(chr, points[high])]
        out[high] = kind
    return out


def tag_names(kinds: tuple[str, ...]) -> list[tuple[str, int]]:
    """(kind, 0 at its first character else 1) by tag from 1 on."""
    return [(k, part) for k in kinds for part in (0, 1)]


def allowed(n_kinds: int) -> np.ndarray:
    """Scores that block an inner tag without one of its kind before it."""
    n = 1 + 2 * n_kinds
    out = np.zeros((n, n), np.float32)
    for k in range(n_kinds):
        inner = 2 + 2 * k
        out[:, inner] = BLOCKED
        out[[inner - 1, inner], inner] = 0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    def __init__(self, n_kinds: int, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden, self.n_tags = hidden, 1 + 2 * n_kinds
        self.blocked = allowed(n_kinds)
        p: dict[str, np.ndarray] = {"T": np.zeros((self.n_tags, self.n_tags))}
        for d in "fb":
            p["x" + d] = rng.normal(0, 0.3, (N_CLASSES, 4 * hidden))
            p["h" + d] = rng.normal(0, hidden ** -0.5, (hidden, 4 * hidden))
            p["x" + d][:, hidden:2 * hidden] += 1  # remember at first
        p["o"] = rng.normal(0, 0.3, (2 * hidden, self.n_tags))
        p["c"] = np.zeros(self.n_tags)
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def _run(self, x: np.ndarray, d: str, keep: bool = False):
        """Hidden states (time, row, unit) of one direction over classes (time, row)."""
        n, h4 = self.hidden, 4 * self.hidden
        wx, wh = self.p["x" + d], self.p["h" + d]
        rows = x.shape[1]
        h, c = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
        out = np.empty((len(x), rows, n), np.float32)
        steps = []
        for t in range(len(x)):
            z = wx[x[t]]
            z += h @ wh
            gates = _sigmoid(z[:, :3 * n])
            g = np.tanh(z[:, 3 * n:h4])
            before = c
            c = gates[:, n:2 * n] * c + gates[:, :n] * g
            tc = np.tanh(c)
            if keep:
                steps.append((gates, g, before, tc, h))
            h = gates[:, 2 * n:] * tc
            out[t] = h
        return out, steps

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Tag scores (row, time, tag) of classes (row, time)."""
        x = x.T
        f, _ = self._run(x, "f")
        b, _ = self._run(x[::-1], "b")
        both = np.concatenate([f, b[::-1]], 2)
        return (both @ self.p["o"] + self.p["c"]).transpose(1, 0, 2)

    def _grad_run(self, dh_all, x, d, steps, grads):
        n = self.hidden
        wh = self.p["h" + d]
        dh_next = np.zeros_like(dh_all[0])
        dc = np.zeros_like(dh_next)
        dwx, dwh = grads["x" + d], grads["h" + d]
        for t in range(len(x) - 1, -1, -1):
            gates, g, before, tc, h_before = steps[t]
            i, f, o = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:]
            dh = dh_all[t] + dh_next
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f),
                                 dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            np.add.at(dwx, x[t], dz)
            dwh += h_before.T @ dz
            dh_next = dz @ wh.T
            dc = dc * f

    def _crf(self, e: np.ndarray, tags: np.ndarray, grads) -> tuple[float, np.ndarray]:
        """Loss and its gradient over tag scores (time, row, tag)."""
        a = self.p["T"] + self.blocked
        steps, rows, n = e.shape
        start = self.blocked[0]
        alpha, beta = np.empty_like(e), np.zeros_like(e)

        def lse(v, axis):
            top = v.max(axis, keepdims=True)
            return (top + np.log(np.exp(v - top).sum(axis, keepdims=True))).squeeze(axis)

        alpha[0] = e[0] + start
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + a, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(a + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        for t in range(1, steps):
            pair = np.exp(alpha[t - 1][:, :, None] + a + (e[t] + beta[t])[:, None, :]
                          - z[:, None, None])
            grads["T"] += pair.sum(0)
        row = np.arange(rows)
        gold = e[0, row, tags[0]].sum()
        for t in range(steps):
            de[t, row, tags[t]] -= 1
            if t:
                np.add.at(grads["T"], (tags[t - 1], tags[t]), -1)
                gold += (e[t, row, tags[t]] + a[tags[t - 1], tags[t]]).sum()
        return float(z.sum() - gold) / rows, de

    def step(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        x, tags = x.T, tags.T
        rows = x.shape[1]
        f, fs = self._run(x, "f", True)
        b, bs = self._run(x[::-1], "b", True)
        both = np.concatenate([f, b[::-1]], 2)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss, de = self._crf(both @ self.p["o"] + self.p["c"], tags, grads)
        grads["o"] = np.einsum("tnh,tnk->hk", both, de)
        grads["c"] = de.sum((0, 1))
        dboth = de @ self.p["o"].T
        n = self.hidden
        self._grad_run(dboth[:, :, :n], x, "f", fs, grads)
        self._grad_run(dboth[::-1, :, n:], x[::-1], "b", bs, grads)
        return loss, {k: v / rows for k, v in grads.items()}

    def fit(self, x: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 64,
            rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam with a falling rate; the loss of every epoch."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        losses, k = [], 0
        total = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order, sums = rng.permutation(len(x)), []
            for at in range(0, len(x), batch):
                own = order[at:at + batch]
                loss, grads = self.step(x[own], tags[own])
                sums.append(loss)
                k += 1
                lr = rate * (1 - k / (total + 1))
                for name, g in grads.items():
                    g = np.clip(g, -5, 5)
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.99 * v[name] + 0.01 * g * g
                    self.p[name] -= (lr * (m[name] / (1 - 0.9 ** k))
                                     / (np.sqrt(v[name] / (1 - 0.99 ** k)) + 1e-6)).astype(np.float32)
            losses.append(float(np.mean(sums)))
        return losses

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best tags (row, time) of tag scores (row, time, tag)."""
        a = self.p["T"] + self.blocked
        rows, steps, n = e.shape
        score = e[:, 0] + self.blocked[0]
        back = np.empty((steps, rows, n), np.int8)
        for t in range(1, steps):
            ways = score[:, :, None] + a
            back[t] = ways.argmax(1)
            score = ways.max(1) + e[:, t]
        out = np.empty((rows, steps), np.int64)
        out[:, -1] = score.argmax(1)
        row = np.arange(rows)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[t][row, out[:, t]]
        return out
