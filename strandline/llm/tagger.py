"""A character tagger in numpy: bidirectional LSTM with conditional random field transitions."""

from __future__ import annotations

import numpy as np

CHARACTERS = 128  # ASCII; all beyond it share the last code
HIDDEN = 16


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Tagger:
    """Parameters by name; ``in``: input weights of each character, ``re``: recurrent, ``out``, ``move``: transitions."""

    def __init__(self, tags: int, seed: int = 7):
        make = np.random.default_rng(seed)
        small = lambda *shape: make.normal(0, 0.2, shape).astype(np.float32)
        self.tags = tags
        self.p = {"out": small(2 * HIDDEN, tags), "base": np.zeros(tags, np.float32), "move": np.zeros((tags, tags), np.float32), "first": np.zeros(tags, np.float32)}
        for way in ("f", "b"):
            self.p |= {f"in_{way}": small(CHARACTERS, 4 * HIDDEN), f"re_{way}": small(HIDDEN, 4 * HIDDEN)}
            self.p[f"in_{way}"][:, HIDDEN : 2 * HIDDEN] += 1  # remember, to begin with

    def _run(self, codes: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """Hidden states of all steps (time, batch, HIDDEN) and what the way back needs."""
        steps, batch = codes.shape
        inputs, again = self.p[f"in_{way}"], self.p[f"re_{way}"]
        hidden, cell = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        out, kept = np.empty((steps, batch, HIDDEN), np.float32), []
        for t in range(steps):
            gates = inputs[codes[t]] + hidden @ again
            three = _sigmoid(gates[:, : 3 * HIDDEN])
            enter, stay, leave = three[:, :HIDDEN], three[:, HIDDEN : 2 * HIDDEN], three[:, 2 * HIDDEN :]
            new = np.tanh(gates[:, 3 * HIDDEN :])
            before, cell = cell, stay * cell + enter * new
            kept.append((enter, stay, leave, new, before, np.tanh(cell), hidden))
            hidden = leave * kept[-1][5]
            out[t] = hidden
        return out, kept

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """Scores (batch, time, tags) of windows of character codes (batch, time)."""
        forth, _ = self._run(codes.T, "f")
        back, _ = self._run(codes.T[::-1], "b")
        return (np.concatenate([forth, back[::-1]], 2) @ self.p["out"] + self.p["base"]).transpose(1, 0, 2)

    def _back(self, codes: np.ndarray, way: str, kept: list, slope: np.ndarray, into: dict) -> None:
        again = self.p[f"re_{way}"]
        d_in, d_re = np.zeros_like(self.p[f"in_{way}"]), np.zeros_like(again)
        d_hidden, d_cell = np.zeros_like(kept[0][0]), np.zeros_like(kept[0][0])
        for t in range(len(codes) - 1, -1, -1):
            enter, stay, leave, new, before, shown, hidden = kept[t]
            d_hidden = d_hidden + slope[t]
            d_cell = d_cell + d_hidden * leave * (1 - shown**2)
            gates = np.concatenate(
                [d_cell * new * enter * (1 - enter), d_cell * before * stay * (1 - stay), d_hidden * shown * leave * (1 - leave), d_cell * enter * (1 - new**2)], 1
            )
            np.add.at(d_in, codes[t], gates)
            d_re += hidden.T @ gates
            d_hidden, d_cell = gates @ again.T, d_cell * stay
        into[f"in_{way}"], into[f"re_{way}"] = d_in, d_re

    def slopes(self, codes: np.ndarray, gold: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean negative log likelihood of the gold tags (batch, time)."""
        turned = codes.T
        forth, kept_f = self._run(turned, "f")
        back, kept_b = self._run(turned[::-1], "b")
        both = np.concatenate([forth, back[::-1]], 2)
        score = both @ self.p["out"] + self.p["base"]
        steps, batch, tags = score.shape
        move = self.p["move"]
        alpha, beta = np.empty_like(score), np.zeros_like(score)
        alpha[0] = score[0] + self.p["first"]
        for t in range(1, steps):
            alpha[t] = score[t] + _log_sum(alpha[t - 1][:, :, None] + move, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _log_sum(move + (score[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _log_sum(alpha[-1], 1)
        likely = np.exp(alpha + beta - total[:, None])
        d_score = likely.copy()
        rows = np.arange(batch)
        for t in range(steps):
            d_score[t, rows, gold[:, t]] -= 1
        d_move = np.zeros_like(move)
        for t in range(1, steps):
            pair = alpha[t - 1][:, :, None] + move + (score[t] + beta[t])[:, None, :] - total[:, None, None]
            d_move += np.exp(pair).sum(0)
            np.add.at(d_move, (gold[:, t - 1], gold[:, t]), -1)
        d_first = likely[0].sum(0)
        np.add.at(d_first, gold[:, 0], -1)
        flat, d_flat = both.reshape(-1, 2 * HIDDEN), d_score.reshape(-1, tags)
        into = {"out": flat.T @ d_flat, "base": d_flat.sum(0), "move": d_move, "first": d_first}
        d_both = d_score @ self.p["out"].T
        self._back(turned, "f", kept_f, d_both[:, :, :HIDDEN], into)
        self._back(turned[::-1], "b", kept_b, d_both[::-1, :, HIDDEN:], into)
        return {k: v / batch for k, v in into.items()}

    def train(self, codes: np.ndarray, gold: np.ndarray, steps: int = 240, batch: int = 48, rate: float = 0.02, seed: int = 3) -> None:
        """Adam over random batches."""
        if not len(codes):
            return
        pick = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            some = pick.integers(0, len(codes), batch)
            slow = rate * (1 - 0.9 * step / steps)
            for k, slope in self.slopes(codes[some], gold[some]).items():
                slope = np.clip(slope, -5, 5)
                mean[k] = 0.9 * mean[k] + 0.1 * slope
                square[k] = 0.99 * square[k] + 0.01 * slope**2
                self.p[k] = (self.p[k] - slow * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def best_path(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The likeliest tags (batch, time) for scores of given lengths; beyond a length they are 0."""
        batch, steps, tags = scores.shape
        now = scores[:, 0] + self.p["first"]
        come = np.tile(np.arange(tags, dtype=np.int8), (steps, batch, 1))
        for t in range(1, steps):
            ways = now[:, :, None] + self.p["move"]
            best = ways.argmax(1)
            going = t < lengths
            come[t, going] = best[going]
            now[going] = (ways.max(1) + scores[:, t])[going]
        path = np.zeros((batch, steps), np.int64)
        tag = now.argmax(1)
        for t in range(steps - 1, -1, -1):
            path[:, t] = np.where(t < lengths, tag, 0)
            tag = come[t, np.arange(batch), tag]
        return path
