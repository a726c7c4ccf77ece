"""A character tagger: bidirectional LSTM with CRF transitions, trained and run in numpy.

Tags are O and, for each type, begin and inside. Inputs are two small symbols per character (folded shape and case), so the first layer is a
table lookup; all gates of a step are one matrix product and one tanh.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

#: Symbols: 0 padding, 1 other; then letters, digits by one, blanks, line ends and the marks below.
MARKS = ".,;:!?@+-_/()[]{}<>\"'=#&*%|\\~^$`´’"
HIDDEN, SIZE = 48, 24


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point of the basic plane (others are 1): letters folded to their base, twice, by case."""
    table = np.ones(0x10000, np.int16)
    letters = {chr(97 + i): i for i in range(26)}
    for c in range(0x10000):
        ch = chr(c)
        if ch in "\n\r":
            table[c] = 2
        elif ch.isspace():
            table[c] = 3
        elif ch.isdigit():
            table[c] = 4
        elif ch in MARKS:
            table[c] = 60 + MARKS.index(ch)
        elif ch.isalpha():
            base = unicodedata.normalize("NFKD", ch)[0].lower()
            table[c] = (5 + letters[base] + 26 * ch.isupper()) if base in letters else 57 + ch.isupper()
    return table


SYMBOLS = 60 + len(MARKS)


def symbols_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x10000, symbol_table()[np.minimum(points, 0xFFFF)], 1).astype(np.int16)


class Tagger:
    """Parameters of the network; `tags` is 1 + 2 * number of types."""

    def __init__(self, tags: int, hidden: int = HIDDEN, size: int = SIZE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden, self.tags = hidden, tags
        normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"E": normal(SYMBOLS, size, scale=0.3), "O": normal(2 * hidden, tags, scale=0.2), "ob": np.zeros(tags, np.float32), "T": np.zeros((tags, tags), np.float32)}
        for d in "fb":
            self.p["X" + d], self.p["H" + d] = normal(size, 4 * hidden, scale=size**-0.5), normal(hidden, 4 * hidden, scale=hidden**-0.5)
            self.p["B" + d] = np.zeros(4 * hidden, np.float32)
            self.p["B" + d][hidden : 2 * hidden] = 1  # forget gates begin open

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (length, batch, tags) of x (length, batch). Each step's share is added at once, in buffers that are used again."""
        p, h = self.p, self.hidden
        length, batch = x.shape
        e = np.empty((length, batch, self.tags), np.float32)
        e[:] = p["ob"]
        # gates lie one after another, so that each operation runs over one piece of memory
        z, add, part = np.empty((4, batch, h), np.float32), np.empty((4, batch, h), np.float32), np.empty((batch, self.tags), np.float32)
        bent, cell, state = (np.empty((batch, h), np.float32) for _ in range(3))
        i, f, o, g = z
        for d, steps in (("f", range(length)), ("b", range(length - 1, -1, -1))):
            split = lambda w: np.ascontiguousarray(w.reshape(-1, 4, h).transpose(1, 0, 2).astype(np.float32))
            table, weights = split(p["E"] @ p["X" + d] + p["B" + d]), split(p["H" + d])
            out = np.ascontiguousarray(p["O"][:h] if d == "f" else p["O"][h:]) * np.float32(0.5)
            # a sigmoid is half of one plus the tanh of half its argument: the inner half goes into the weights, and cell and state are kept doubled
            table[:3] *= 0.5
            weights[:3] *= 0.5
            weights *= 0.5
            cell[:], state[:] = 0, 0
            for t in steps:
                np.take(table, x[t], axis=1, out=z, mode="clip")
                np.matmul(state, weights, out=add)
                z += add
                np.tanh(z, out=z)
                z[:3] += 1
                cell *= f
                cell *= 0.5
                i *= g
                cell += i
                np.multiply(cell, 0.5, out=bent)
                np.tanh(bent, out=bent)
                np.multiply(o, bent, out=state)
                np.matmul(state, out, out=part)
                e[t] += part
        return e

    # --- training ---------------------------------------------------------------------------------------------------------------------

    def _states(self, x: np.ndarray):
        """Both directions over x (length, batch) at once, the backward one on the reversed windows: gates (length, 2, batch, 4 hidden), cells, bent cells and outputs."""
        p, h = self.p, self.hidden
        length, batch = x.shape
        z = np.empty((length, 2, batch, 4 * h), np.float32)
        for d, name in enumerate("fb"):
            np.take(p["E"] @ p["X" + name] + p["B" + name], x if d == 0 else x[::-1], axis=0, out=z[:, d], mode="clip")
        weights = np.stack([p["Hf"], p["Hb"]])
        cells, bent, out = (np.empty((length + k, 2, batch, h), np.float32) for k in (1, 0, 1))
        cells[0], out[0] = 0, 0
        add = np.empty((2, batch, 4 * h), np.float32)
        for t in range(length):
            gates = z[t]
            np.matmul(out[t], weights, out=add)
            gates += add
            gates[..., : 3 * h] *= 0.5
            np.tanh(gates, out=gates)
            gates[..., : 3 * h] += 1
            gates[..., : 3 * h] *= 0.5
            np.multiply(gates[..., h : 2 * h], cells[t], out=cells[t + 1])
            cells[t + 1] += gates[..., :h] * gates[..., 3 * h :]
            np.tanh(cells[t + 1], out=bent[t])
            np.multiply(gates[..., 2 * h : 3 * h], bent[t], out=out[t + 1])
        return z, cells, bent, out

    def _likelihood(self, e: np.ndarray, y: np.ndarray, mask: np.ndarray):
        """Negative log likelihood of each window's tags under the CRF, with the forward and backward shares. Characters beyond a text leave them as they are."""
        length, batch = y.shape
        T = self.p["T"]
        most = e.max(2)
        near, X = np.exp(e - most[:, :, None]), np.exp(T)
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones((length, batch), np.float32)
        alpha[0] = near[0]
        for t in range(length):
            if t:
                on = mask[t][:, None] > 0
                alpha[t] = np.where(on, (alpha[t - 1] @ X) * near[t], alpha[t - 1])
            scale[t] = alpha[t].sum(1)
            alpha[t] /= scale[t][:, None]
        ahead = np.zeros_like(e)
        for t in range(length - 1, 0, -1):
            ahead[t] = near[t] * beta[t] / scale[t][:, None] * mask[t][:, None]
            beta[t - 1] = np.where(mask[t][:, None] > 0, ahead[t] @ X.T, beta[t])
        total = np.log(scale).sum(0) + (most * mask).sum(0)
        rows = np.arange(batch)
        gold = sum((e[t, rows, y[t]] + (T[y[t - 1], y[t]] if t else 0)) * mask[t] for t in range(length))
        return total - gold, alpha, beta, ahead, X

    def losses(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Negative log likelihood of each window of x and y (windows, length)."""
        return np.concatenate([self._likelihood(self.emissions(np.ascontiguousarray(part.T)), y[at : at + 1024].T.astype(np.int64), (part.T > 0).astype(np.float32))[0] for at in range(0, len(x), 1024) for part in [x[at : at + 1024]]])

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood of the tags y under the CRF, per character, and its gradients. mask: 1 where x is text (a prefix of each window)."""
        p, h = self.p, self.hidden
        length, batch = x.shape
        z, cells, bent, out = self._states(x)
        both = np.concatenate([out[1:, 0], out[:0:-1, 1]], axis=2)
        e = both @ p["O"] + p["ob"]
        n, rows = mask.sum(), np.arange(batch)
        loss, alpha, beta, ahead, X = self._likelihood(e, y, mask)
        de = alpha * beta * mask[:, :, None]
        np.subtract.at(de, (np.arange(length)[:, None], rows[None], y), mask)
        dT = X * (alpha[:-1].reshape(-1, self.tags).T @ ahead[1:].reshape(-1, self.tags))
        np.subtract.at(dT, (y[:-1].ravel(), y[1:].ravel()), mask[1:].ravel())
        de = (de / n).astype(np.float32)
        g = {"T": (dT / n).astype(np.float32), "O": both.reshape(-1, 2 * h).T @ de.reshape(-1, self.tags), "ob": de.sum((0, 1)), "E": np.zeros_like(p["E"])}
        dboth = de @ p["O"].T
        up = np.stack([dboth[:, :, :h], dboth[::-1, :, h:]], axis=1)  # (length, 2, batch, hidden)
        back = np.ascontiguousarray(np.stack([p["Hf"], p["Hb"]]).transpose(0, 2, 1))
        carry, dc = np.zeros((2, batch, h), np.float32), np.zeros((2, batch, h), np.float32)
        dz = np.empty_like(z)
        for t in range(length - 1, -1, -1):
            i, f, o, c = (z[t, ..., k * h : (k + 1) * h] for k in range(4))
            now = up[t] + carry
            dc += now * o * (1 - bent[t] * bent[t])
            d = dz[t]
            d[..., :h], d[..., h : 2 * h] = dc * c * i * (1 - i), dc * cells[t] * f * (1 - f)
            d[..., 2 * h : 3 * h], d[..., 3 * h :] = now * bent[t] * o * (1 - o), dc * i * (1 - c * c)
            dc *= f
            np.matmul(d, back, out=carry)
        for k, (name, xs) in enumerate((("f", x), ("b", x[::-1]))):
            flat = dz[:, k].reshape(-1, 4 * h)
            g["H" + name], g["B" + name] = out[:-1, k].reshape(-1, h).T @ flat, flat.sum(0)
            per_symbol = np.zeros((SYMBOLS, 4 * h), np.float32)
            order = np.argsort(xs.ravel(), kind="stable")
            values = xs.ravel()[order]
            first = np.flatnonzero(np.r_[True, np.diff(values) != 0])
            per_symbol[values[first]] = np.add.reduceat(flat[order], first, axis=0)
            g["X" + name] = p["E"].T @ per_symbol
            g["E"] += per_symbol @ p["X" + name].T
        return float(loss.sum() / n), g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, first: int = 0, total: int | None = None, batch: int = 128, rate: float = 0.012, seed: int = 7, weights: np.ndarray | None = None, moments: dict | None = None) -> dict:
        """Adam over `steps` batches of windows (windows, length), drawn by `weights`; steps `first` to `first + steps` of `total` on the schedule. Returns the moments, to go on with."""
        rng = np.random.default_rng(seed)
        total = total or steps
        state = moments or {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in self.p.items()}
        chance = None if weights is None else weights / weights.sum()
        for step in range(first + 1, first + steps + 1):
            some = rng.choice(len(x), min(batch, len(x)), replace=chance is not None, p=chance)
            inputs = np.ascontiguousarray(x[some].T)
            _, g = self.gradients(inputs, y[some].T.astype(np.int64), (inputs > 0).astype(np.float32))
            norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
            scale = min(1.0, 1.0 / (norm + 1e-9))
            now = rate * min(1.0, step / 20) * (0.05 + 0.95 * 0.5 * (1 + np.cos(np.pi * step / total)))
            for k, w in g.items():
                w = w * scale
                m, v = state[k]
                m *= 0.9
                m += 0.1 * w
                v *= 0.99
                v += 0.01 * w * w
                self.p[k] -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return state

    @staticmethod
    def mean(parts: list[tuple[dict, dict]]) -> tuple[dict, dict]:
        """Parameters and moments in the middle of those that several workers reached from one start."""
        p = {k: np.mean([w[k] for w, _ in parts], axis=0, dtype=np.float32) for k in parts[0][0]}
        return p, {k: tuple(np.mean([m[k][i] for _, m in parts], axis=0, dtype=np.float32) for i in (0, 1)) for k in p}

    # --- decoding ---------------------------------------------------------------------------------------------------------------------

    def decode(self, x: np.ndarray, bias: float = 0.0) -> np.ndarray:
        """The best tags (windows, length) of x (windows, length). bias is added to every tag but O.

        Windows in which no tag can outweigh O, whatever transitions it might gain, are O without a search; the result is the same.
        """
        e = self.emissions(np.ascontiguousarray(x.T))
        e[:, :, 1:] += bias
        e[:, :, 1:][np.broadcast_to((x.T == 0)[:, :, None], e[:, :, 1:].shape)] = -1e4
        T = self.p["T"]
        gain = float(T.max() - T[0, 0])
        lead = (e[:, :, 1:].max(2) - e[:, :, 0]).max(0)
        out = np.zeros(x.shape, np.int8)
        some = np.flatnonzero(lead > -2 * gain)
        if len(some):
            out[some] = self._viterbi(e[:, some]).T
        return out

    def _viterbi(self, e: np.ndarray) -> np.ndarray:
        length, batch, tags = e.shape
        T, score = self.p["T"], e[0].copy()
        back = np.zeros((length, batch, tags), np.int8)
        for t in range(1, length):
            best = score[:, :1] + T[0]
            who = back[t]
            for k in range(1, tags):
                other = score[:, k : k + 1] + T[k]
                better = other > best
                best[better] = other[better]
                who[better] = k
            score = best + e[t]
        path = np.empty((length, batch), np.int8)
        path[-1] = score.argmax(1)
        rows = np.arange(batch)
        for t in range(length - 1, 0, -1):
            path[t - 1] = back[t, rows, path[t]]
        return path
