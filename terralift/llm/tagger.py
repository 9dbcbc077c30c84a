"""Character-level bidirectional LSTM with a CRF on top, in numpy: training by Adam, decoding by Viterbi."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Symbols: 0 pads, 1 stands for white space but the blank, 2..96 are printable ASCII, then letters and all else.
N_SYMBOLS = 99


def symbols(text: str) -> np.ndarray:
    """One small number for each code point."""
    if not text:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    out = np.where((codes >= 32) & (codes < 127), codes - 30, 98)
    out[(codes >= 9) & (codes <= 13)] = 1
    out[(codes >= 0xC0) & (codes < 0x250)] = 97
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Tagger:
    """Weights by name; ``tags`` classes, ``size`` cells in each direction."""

    weights: dict[str, np.ndarray]
    tags: int
    size: int

    @classmethod
    def new(cls, tags: int, size: int = 20, embed: int = 12, seed: int = 5) -> Tagger:
        draw = np.random.default_rng(seed)
        w = {"e": draw.normal(0, 0.3, (N_SYMBOLS, embed)), "o": draw.normal(0, 0.2, (2 * size, tags)), "ob": np.zeros(tags), "t": np.zeros((tags, tags)), "s": np.zeros(tags)}
        for d in "fb":
            w[d + "x"] = draw.normal(0, embed**-0.5, (embed, 4 * size))
            w[d + "h"] = draw.normal(0, size**-0.5, (size, 4 * size))
            w[d + "b"] = np.repeat([0.0, 1.0, 0.0, 0.0], size)  # in, forget, out, new
        return cls({k: v.astype(np.float32) for k, v in w.items()}, tags, size)

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states over time of one direction; ``x`` is (time, batch) and already reversed for ``b``."""
        w, n = self.weights, self.size
        table = w["e"] @ w[d + "x"] + w[d + "b"]
        h = np.zeros((x.shape[1], n), np.float32)
        c = np.zeros_like(h)
        out = np.empty((len(x), x.shape[1], n), np.float32)
        for t in range(len(x)):
            z = table[x[t]] + h @ w[d + "h"]
            gates = sigmoid(z[:, : 3 * n])
            new = np.tanh(z[:, 3 * n :])
            before = c
            c = gates[:, n : 2 * n] * c + gates[:, :n] * new
            tc = np.tanh(c)
            if keep is not None:
                keep.append((h, before, gates, new, tc))
            h = gates[:, 2 * n :] * tc
            out[t] = h
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(time, batch, tags) scores of windows (time, batch) of symbols."""
        h = np.concatenate([self._run(x, "f"), self._run(x[::-1], "b")[::-1]], axis=2)
        return h @ self.weights["o"] + self.weights["ob"]

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tag sequences (time, batch) of scores (time, batch, tags); times beyond a length repeat tag 0's row."""
        t, s = self.weights["t"], self.weights["s"]
        n, batch, _ = scores.shape
        best = scores[0] + s
        back = np.zeros((n, batch, self.tags), np.int8)
        for i in range(1, n):
            options = best[:, :, None] + t
            back[i] = options.argmax(1)
            step = options.max(1) + scores[i]
            best = np.where((i < lengths)[:, None], step, best)
        out = np.zeros((n, batch), np.int64)
        rows = np.arange(batch)
        tag = best.argmax(1)
        for i in range(n - 1, -1, -1):
            inside = i < lengths
            out[i] = np.where(inside, tag, 0)
            if i:
                tag = np.where(inside, back[i, rows, tag], tag)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood a window, and its gradients; ``x``, ``y`` are (time, batch)."""
        w, n = self.weights, self.size
        steps, batch = x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        hf, hb = self._run(x, "f", kept["f"]), self._run(x[::-1], "b", kept["b"])[::-1]
        h = np.concatenate([hf, hb], axis=2)
        scores = h @ w["o"] + w["ob"]
        # forward and backward sums of the CRF
        a, b = np.empty_like(scores), np.zeros_like(scores)
        a[0] = scores[0] + w["s"]
        for i in range(1, steps):
            a[i] = _log_sum(a[i - 1][:, :, None] + w["t"], 1) + scores[i]
        for i in range(steps - 2, -1, -1):
            b[i] = _log_sum(w["t"] + (scores[i + 1] + b[i + 1])[:, None, :], 2)
        z = _log_sum(a[-1], 1)
        rows = np.arange(batch)
        gold = w["s"][y[0]] + scores[0][rows, y[0]]
        g = {k: np.zeros_like(v) for k, v in w.items()}
        ds = np.exp(a + b - z[None, :, None])
        for i in range(1, steps):
            gold = gold + w["t"][y[i - 1], y[i]] + scores[i][rows, y[i]]
            pair = np.exp(a[i - 1][:, :, None] + w["t"] + (scores[i] + b[i])[:, None, :] - z[:, None, None])
            g["t"] += pair.sum(0)
            np.add.at(g["t"], (y[i - 1], y[i]), -1)
        g["s"] += ds[0].sum(0)
        np.add.at(g["s"], y[0], -1)
        ds[np.arange(steps)[:, None], rows[None, :], y] -= 1
        g["o"] = np.einsum("tbh,tbk->hk", h, ds)
        g["ob"] = ds.sum((0, 1))
        dh = ds @ w["o"].T
        for d, part, xs in (("f", dh[:, :, :n], x), ("b", dh[::-1, :, n:], x[::-1])):
            next_h, next_c = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
            dz_all = np.empty((steps, batch, 4 * n), np.float32)
            for i in range(steps - 1, -1, -1):
                before_h, before_c, gates, new, tc = kept[d][i]
                inn, forget, out = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
                d_h = part[i] + next_h
                d_c = d_h * out * (1 - tc**2) + next_c
                dz = np.concatenate([d_c * new * inn * (1 - inn), d_c * before_c * forget * (1 - forget), d_h * tc * out * (1 - out), d_c * inn * (1 - new**2)], axis=1)
                dz_all[i] = dz
                g[d + "h"] += before_h.T @ dz
                next_h, next_c = dz @ w[d + "h"].T, d_c * forget
            flat, at = dz_all.reshape(-1, 4 * n), xs.reshape(-1)
            by_symbol = np.zeros((N_SYMBOLS, 4 * n), np.float32)
            np.add.at(by_symbol, at, flat)
            g[d + "b"] = flat.sum(0)
            g[d + "x"] = w["e"].T @ by_symbol
            g["e"] += by_symbol @ w[d + "x"].T
        return float((z - gold).mean()), {k: v / batch for k, v in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 64, rate: float = 0.01, seed: int = 7) -> float:
        """Adam over random batches of windows (windows, time); the last loss."""
        draw = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(w) for k, w in self.weights.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            pick = draw.integers(0, len(x), min(batch, len(x)))
            loss, g = self.gradients(x[pick].T, y[pick].T)
            norm = max(1.0, sum(float((u**2).sum()) for u in g.values()) ** 0.5 / 5)
            pace = rate * (1 - 0.9 * step / steps)
            for k, u in g.items():
                u = u / norm
                m[k] = 0.9 * m[k] + 0.1 * u
                v[k] = 0.99 * v[k] + 0.01 * u * u
                self.weights[k] = (self.weights[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))
