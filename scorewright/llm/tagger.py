"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy."""

from __future__ import annotations

import numpy as np

HIDDEN = 24

# Character classes: padding, digits, small and capital letters, letters beyond ASCII, line breaks, other white space, the rest, and each ASCII mark
PAD, DIGIT, LOWER, UPPER, LETTER, BREAK, BLANK, OTHER = range(8)
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLASSES = 8 + len(MARKS)
_ASCII = np.full(128, OTHER, np.int64)
_ASCII[48:58], _ASCII[97:123], _ASCII[65:91] = DIGIT, LOWER, UPPER
_ASCII[[10, 13]], _ASCII[[32, 9, 11, 12]] = BREAK, BLANK
_ASCII[[ord(c) for c in MARKS]] = 8 + np.arange(len(MARKS))


def classes(texts: list[str], size: int) -> np.ndarray:
    """Character classes of texts, padded to ``size``."""
    out = np.full((len(texts), size), PAD)
    for i, text in enumerate(texts):
        points = np.frombuffer(text[:size].encode("utf-32-le", "surrogatepass"), np.uint32)
        out[i, : len(points)] = np.where(points < 128, _ASCII[np.minimum(points, 127)], LETTER)
    return out


def tags(spans: list[tuple[int, int, int]], size: int) -> np.ndarray:
    """Tag of each character: 0 outside, 1 + 2k at the start of kind k and 2 + 2k inside it."""
    out = np.zeros(size, np.int64)
    for start, end, kind in spans:
        out[start:end] = 2 + 2 * kind
        out[start] = 1 + 2 * kind
    return out


class Tagger:
    """``params``: input rows per class, recurrent and output weights, transitions. The two directions are the first axis of the LSTM's."""

    def __init__(self, kinds: int, hidden: int = HIDDEN, seed: int = 1, dtype: type = np.float32):
        rng = np.random.Generator(np.random.PCG64(seed))
        n = 1 + 2 * kinds
        self.hidden, self.n_tags = hidden, n
        self.params = {
            "x": rng.normal(0, 0.3, (2, CLASSES, 4 * hidden)), "h": rng.normal(0, 0.5 / hidden**0.5, (2, hidden, 4 * hidden)),
            "o": rng.normal(0, 0.5 / hidden**0.5, (2 * hidden, n)), "b": np.zeros(n), "t": np.zeros((n, n))}
        self.params["x"][:, :, hidden : 2 * hidden] += 1.0  # gates start out remembering
        self.params = {k: v.astype(dtype) for k, v in self.params.items()}
        # inside a kind only after its start or itself
        self.barred = np.zeros((n, n), dtype)
        for k in range(kinds):
            inside = 2 + 2 * k
            self.barred[:, inside] = -1e4
            self.barred[[inside - 1, inside], inside] = 0
        self.first = np.zeros(n, dtype)
        self.first[2::2] = -1e4

    def emissions(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(time, text, tag) scores of class rows; with ``keep``, what the gradient needs is left there."""
        p, size = self.params, self.hidden
        both = np.stack([x.T, x.T[::-1]])
        h = np.zeros((2, len(x), size), p["h"].dtype)
        c = np.zeros_like(h)
        hs = np.empty((2, x.shape[1], len(x), size), h.dtype)
        for t in range(x.shape[1]):
            z = np.matmul(h, p["h"])
            z[0] += p["x"][0][both[0, t]]
            z[1] += p["x"][1][both[1, t]]
            gate = 1 / (1 + np.exp(-np.clip(z[..., : 3 * size], -30, 30)))
            new = np.tanh(z[..., 3 * size :])
            before = c
            c = gate[..., size : 2 * size] * c + gate[..., :size] * new
            out = np.tanh(c)
            if keep is not None:
                keep.append((h, before, gate, new, out))
            h = gate[..., 2 * size :] * out
            hs[:, t] = h
        joint = np.concatenate([hs[0], hs[1][::-1]], -1)
        if keep is not None:
            keep.append((both, joint))
        return joint @ p["o"] + p["b"]

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags ``y`` and its gradient."""
        p, size, n, times = self.params, self.hidden, len(x), x.shape[1]
        keep: list = []
        e = self.emissions(x, keep)
        both, joint = keep.pop()
        # forward and backward sums, scaled to one at each time
        move = p["t"] + self.barred
        high = e.max(-1, keepdims=True)
        own, pass_on = np.exp(e - high), np.exp(move)
        ahead, behind, scale = np.empty_like(e), np.ones_like(e), np.empty((times, n, 1), e.dtype)
        for t in range(times):
            ahead[t] = own[t] * (ahead[t - 1] @ pass_on if t else np.exp(self.first))
            scale[t] = ahead[t].sum(1, keepdims=True)
            ahead[t] /= scale[t]
        for t in range(times - 2, -1, -1):
            behind[t] = (own[t + 1] * behind[t + 1] / scale[t + 1]) @ pass_on.T
        total = (np.log(scale) + high).sum((0, 2))
        gold, rows, steps = y.T, np.arange(n), np.arange(times)[:, None]
        true = e[steps, rows, gold].sum(0) + self.first[gold[0]] + move[gold[:-1], gold[1:]].sum(0)
        de = ahead * behind
        de[steps, rows, gold] -= 1
        de /= n
        dt = pass_on * (ahead[:-1].reshape(-1, self.n_tags).T @ (own[1:] * behind[1:] / scale[1:]).reshape(-1, self.n_tags))
        np.subtract.at(dt, (gold[:-1], gold[1:]), 1)
        flat = joint.reshape(-1, 2 * size)
        grad = {"t": dt / n, "o": flat.T @ de.reshape(-1, self.n_tags), "b": de.sum((0, 1)), "x": np.zeros_like(p["x"]), "h": np.zeros_like(p["h"])}
        back = de @ p["o"].T
        dhs = np.stack([back[..., :size], back[::-1, :, size:]])
        dh, dc = np.zeros((2, n, size), e.dtype), np.zeros((2, n, size), e.dtype)
        for t in range(times - 1, -1, -1):
            h, before, gate, new, out = keep[t]
            dh = dh + dhs[:, t]
            i, f, o = gate[..., :size], gate[..., size : 2 * size], gate[..., 2 * size :]
            dc = dc + dh * o * (1 - out**2)
            dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * out * o * (1 - o), dc * i * (1 - new**2)], -1)
            grad["h"] += np.matmul(h.transpose(0, 2, 1), dz)
            for d in range(2):
                one = np.zeros((n, CLASSES), e.dtype)
                one[rows, both[d, t]] = 1
                grad["x"][d] += one.T @ dz[d]
            dh = np.matmul(dz, p["h"].transpose(0, 2, 1))
            dc = dc * f
        return float((total - true).mean()), grad

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 128, rate: float = 0.01, seed: int = 2) -> list[float]:
        """Adam over shuffled batches, the rate falling to nothing; returns the mean loss of each epoch."""
        rng = np.random.Generator(np.random.PCG64(seed))
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        v = {k: np.zeros_like(w) for k, w in self.params.items()}
        steps, at, losses = epochs * -(-len(x) // batch), 0, []
        for _ in range(epochs):
            order, seen = rng.permutation(len(x)), []
            for i in range(0, len(x), batch):
                part = order[i : i + batch]
                loss, grad = self.loss(x[part], y[part])
                seen.append(loss)
                norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grad.values())))
                scale = min(1.0, 5.0 / max(norm, 1e-9))
                at += 1
                pace = rate * (1 - at / (steps + 1)) * (1 - 0.999**at) ** 0.5 / (1 - 0.9**at)
                for k, g in grad.items():
                    g = g * scale
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.params[k] -= (pace * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(self.params[k].dtype)
            losses.append(float(np.mean(seen)))
        return losses

    def decode(self, x: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
        """(start, end, kind, margin) of the spans on the best path of each text; the margin is their score over that of no span there."""
        if not len(x):
            return []
        e = self.emissions(x)
        times, n = x.shape[1], len(x)
        move = self.params["t"] + self.barred
        came = np.zeros((times, n, self.n_tags), np.int8)
        best = e[0] + self.first
        for t in range(1, times):
            step = best[:, :, None] + move[None]
            came[t] = step.argmax(1)
            best = step.max(1) + e[t]
        path = np.empty((times, n), np.int64)
        path[-1] = best.argmax(1)
        rows = np.arange(n)
        for t in range(times - 1, 0, -1):
            path[t - 1] = came[t][rows, path[t]]
        found: list[list[tuple[int, int, int, float]]] = [[] for _ in range(n)]
        for t, i in zip(*np.nonzero(path % 2 == 1)):
            kind, end = int(path[t, i]) // 2, int(t) + 1
            while end < times and path[end, i] == 2 + 2 * kind:
                end += 1
            own = e[np.arange(t, end), i, path[t:end, i]].sum() - e[t:end, i, 0].sum()
            steps = [0 if t == 0 else path[t - 1, i], *path[t:end, i], *([path[end, i]] if end < times else [])]
            own += sum(float(move[a, b]) for a, b in zip(steps[:-1], steps[1:])) - (len(steps) - 1) * float(move[0, 0])
            found[i].append((int(t), end, kind, float(own)))
        return found
