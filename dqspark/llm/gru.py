"""A bidirectional gated recurrent network with attention pooling, forward and backward, in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np

WORDS, GRAMS = 2**15, 2**15    # rows of the two hashed embedding tables
WORD_DIM, GRAM_DIM = 8, 16
HIDDEN, ATTENTION = 8, 8
PUNCTUATION = "\"'()[]{}<>.,;:!?*#$%&|_~`^=+-/@\\"


class Features:
    """For words in a row: the place of each in the word table, and of all its character runs in the other."""

    def __init__(self, ids: np.ndarray, grams: np.ndarray, counts: np.ndarray):
        self.ids, self.grams, self.counts = ids, grams, counts
        self.starts = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)

    @classmethod
    def of(cls, words: Sequence[bytes]) -> "Features":
        """Hashes of the words and of their runs of three to five bytes, with a mark at both ends."""
        ids = np.array([zlib.crc32(w) % WORDS for w in words], dtype=np.int64)
        sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(b"<" + w + b">" for w in words) + bytes(5), np.uint8).astype(np.uint64)
        n = int(sizes.sum())
        ends = np.repeat(np.cumsum(sizes), sizes)
        left = ends - np.arange(n)
        code, grams, owners = np.zeros(n, np.uint64), [], []
        owner = np.repeat(np.arange(len(words)), sizes)
        for k in range(5):
            code = code | (raw[k:n + k] << np.uint64(8 * k))
            if k >= 2:
                whole = left > k
                h = (code[whole] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
                grams.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 15)).astype(np.int64))
                owners.append(owner[whole])
        owners = np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        return cls(ids, np.concatenate(grams)[order], np.bincount(owners, minlength=len(words)))

    def some(self, at: np.ndarray) -> "Features":
        counts = self.counts[at]
        first = np.repeat(self.starts[at] - np.r_[0, np.cumsum(counts)[:-1]], counts)
        return Features(self.ids[at], self.grams[first + np.arange(counts.sum())], counts)


def bare(word: str) -> bytes:
    """A word without case and the punctuation around it."""
    return (word.strip(PUNCTUATION) or word).lower().encode("utf-8", "surrogatepass")


def sums_at(places: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """A table of ``size`` rows with the sum of the rows that go to each place."""
    out = np.zeros((size, rows.shape[1]), np.float32)
    if len(places):
        order = np.argsort(places, kind="stable")
        own = places[order]
        at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[at]] = np.add.reduceat(rows[order], at, axis=0)
    return out


def sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def start(seed: int) -> dict[str, np.ndarray]:
    r, d, h = np.random.default_rng(seed), WORD_DIM + GRAM_DIM, HIDDEN
    p = {"Ew": r.normal(0, 0.1, (WORDS, WORD_DIM)), "Ec": r.normal(0, 0.3, (GRAMS, GRAM_DIM)),
         "A": r.normal(0, 0.3, (2 * h, ATTENTION)), "a": np.zeros(ATTENTION), "v": r.normal(0, 0.3, ATTENTION),
         "u": r.normal(0, 0.3, 2 * h), "c": np.zeros(1)}
    for side in "fb":
        p |= {f"W{side}": r.normal(0, 0.3, (d, 3 * h)), f"b{side}": np.zeros(3 * h), f"U{side}": r.normal(0, 0.3, (h, 3 * h))}
    return {k: x.astype(np.float32) for k, x in p.items()}


class Vocabulary:
    """Words met so far, each with a place; place 0 is padding."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.words: list[str] = [""]

    def places(self, words: Sequence[str]) -> list[int]:
        index, known, out = self.index, self.words, []
        for w in words:
            i = index.get(w)
            if i is None:
                i = index[w] = len(known)
                known.append(w)
            out.append(i)
        return out

    def features(self, first: int = 0) -> Features:
        return Features.of([bare(w) for w in self.words[first:]])


def inputs(p: dict, f: Features) -> np.ndarray:
    """Input vectors: the embedding of the word beside the mean of those of its character runs."""
    x = np.empty((len(f.ids), WORD_DIM + GRAM_DIM), np.float32)
    x[:, :WORD_DIM] = p["Ew"][f.ids]
    full = np.flatnonzero(f.counts)
    x[:, WORD_DIM:] = 0
    if len(full):
        x[full, WORD_DIM:] = np.add.reduceat(p["Ec"][f.grams], f.starts[full], axis=0) / f.counts[full, None]
    return x


def new_gates(p: dict, words: Vocabulary, first: int, at_once: int = 20_000) -> np.ndarray:
    """The gates of the words from ``first`` on."""
    return np.concatenate([project(p, inputs(p, Features.of([bare(w) for w in words.words[i:i + at_once]])))
                           for i in range(first, len(words.words), at_once)])


def project(p: dict, x: np.ndarray) -> np.ndarray:
    """What each word adds to the gates of both directions."""
    return np.concatenate([x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]], axis=1)


def forward(p: dict, gates: np.ndarray, windows: np.ndarray, trace: bool = False):
    """Log-odds of windows (rows of word places, 0 where there is none)."""
    n, length = windows.shape
    h = HIDDEN
    mask = (windows > 0)
    states = np.zeros((length, n, 2 * h), np.float32)
    steps = {"f": [None] * length, "b": [None] * length}
    for side, order in (("f", range(length)), ("b", range(length - 1, -1, -1))):
        off, u, s = (0 if side == "f" else 3 * h), p[f"U{side}"], np.zeros((n, h), np.float32)
        for t in order:
            g = gates[windows[:, t], off:off + 3 * h]
            hu = s @ u
            zr = sigmoid(g[:, :2 * h] + hu[:, :2 * h])
            z, r, hn = zr[:, :h], zr[:, h:], hu[:, 2 * h:]
            c = np.tanh(g[:, 2 * h:] + r * hn)
            new = np.where(mask[:, t, None], c + z * (s - c), s)
            if trace:
                steps[side][t] = (s, z, r, hn, c)
            s = new
            states[t, :, (0 if side == "f" else h):(h if side == "f" else 2 * h)] = s
    e = np.tanh(states @ p["A"] + p["a"])
    score = np.where(mask.T, e @ p["v"], -1e9)
    w = np.exp(score - score.max(axis=0)) * mask.T
    w /= np.maximum(w.sum(axis=0), 1e-9)
    pooled = np.einsum("tn,tnd->nd", w, states)
    logit = pooled @ p["u"] + p["c"][0]
    return (logit, (mask, states, steps, e, w, pooled)) if trace else logit


def backward(p: dict, gates: np.ndarray, windows: np.ndarray, traced: tuple, d: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters behind the gates, and of the gates of each word, from ``d`` at the log-odds."""
    mask, states, steps, e, w, pooled = traced
    n, length = windows.shape
    h = HIDDEN
    grad = {"u": pooled.T @ d, "c": np.array([d.sum()], np.float32)}
    dpooled = d[:, None] * p["u"]
    dstates = w[:, :, None] * dpooled
    dw = np.einsum("tnd,nd->tn", states, dpooled)
    dscore = w * (dw - (w * dw).sum(axis=0))
    de = dscore[:, :, None] * p["v"] * (1 - e * e)
    grad["v"] = np.einsum("tn,tnk->k", dscore, e)
    grad["A"], grad["a"] = np.einsum("tnd,tnk->dk", states, de), de.sum(axis=(0, 1))
    dstates += de @ p["A"].T
    each = np.zeros((length, n, 6 * h), np.float32)
    for side, order in (("f", range(length - 1, -1, -1)), ("b", range(length))):
        off, u = (0 if side == "f" else 3 * h), p[f"U{side}"]
        du, carry = np.zeros_like(u), np.zeros((n, h), np.float32)
        for t in order:
            s, z, r, hn, c = steps[side][t]
            ds = carry + dstates[t][:, (0 if side == "f" else h):(h if side == "f" else 2 * h)]
            on = mask[:, t, None]
            dnew = ds * on
            dz = dnew * (s - c) * z * (1 - z)
            dc = dnew * (1 - z) * (1 - c * c)
            dr = dc * hn * r * (1 - r)
            dhu = np.concatenate([dz, dr, dc * r], axis=1)
            each[t, :, off:off + 3 * h] = np.concatenate([dz, dr, dc], axis=1)
            du += s.T @ dhu
            carry = ds * ~on + dnew * z + dhu @ u.T
        grad[f"U{side}"] = du
    return grad, sums_at(windows.T.reshape(-1), each.reshape(-1, 6 * h), len(gates))


def word_gradients(p: dict, x: np.ndarray, words: Features, dgates: np.ndarray) -> dict:
    """Gradients of the input weights and embeddings from those of the words' gates."""
    h = HIDDEN
    f, b = dgates[:, :3 * h], dgates[:, 3 * h:]
    dx = f @ p["Wf"].T + b @ p["Wb"].T
    ew = sums_at(words.ids, dx[:, :WORD_DIM], WORDS)
    ec = sums_at(words.grams, np.repeat(dx[:, WORD_DIM:] / np.maximum(words.counts, 1)[:, None], words.counts, axis=0), GRAMS)
    return {"Wf": x.T @ f, "bf": f.sum(axis=0), "Wb": x.T @ b, "bb": b.sum(axis=0), "Ew": ew, "Ec": ec}


class Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(x) for k, x in p.items()}
        self.s = {k: np.zeros_like(x) for k, x in p.items()}

    def step(self, grad: dict) -> None:
        self.t += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        scale = np.float32(min(1.0, 5.0 / (size + 1e-9)))
        rate = np.float32(self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for k, g in grad.items():
            g = g.astype(np.float32) * scale
            self.m[k] += np.float32(0.1) * (g - self.m[k])
            self.s[k] += np.float32(0.001) * (g * g - self.s[k])
            self.p[k] -= rate * self.m[k] / (np.sqrt(self.s[k]) + np.float32(1e-7))
