"""A linear-chain conditional random field with two tags, in numpy.

Tag 1 marks a toxic token, tag 0 any other; before the first token stands tag 0.
Texts are cut into rows of at most ROW tokens that are worked on side by side:
the transfer matrix of a row links it to its neighbours, so marginals are exact
for texts of any length while each step is one array operation.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np

#: Tokens in a row.
ROW = 128
#: Hashed features; the weights take 1 MB.
DIMENSIONS = 1 << 18
EDGES = "\"'.,;:!?()[]{}<>*#%&$-_~`/\\|"


def features(word: str) -> list[int]:
    """Hashed features of a lower-cased token: the word without marks at its ends, its beginnings, its end."""
    core = word.strip(EDGES) or word
    names = [f"w={core}", *(f"p{k}={core[:k]}" for k in (3, 4, 5) if len(core) >= k), f"s={core[-3:]}"]
    return [zlib.crc32(x.encode()) % DIMENSIONS for x in names]


@dataclass
class Tagger:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIMENSIONS, np.float32))
    bias: float = 0.0
    #: log potentials of tag i followed by tag j
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: document score: logistic weights of its evidence, see `evidence`; unfitted, nothing is toxic
    link: np.ndarray = field(default_factory=lambda: np.array([-1.0, 0, 0, 0]))

    def emission(self, word: str) -> float:
        return float(self.weights[features(word)].sum()) + self.bias

    def score(self, found: np.ndarray) -> np.ndarray:
        """Scores of documents from rows of `evidence`."""
        return 1 / (1 + np.exp(-np.clip(found @ self.link[1:] + self.link[0], -30, 30)))


class Emissions(dict):
    """Emissions of the words met so far, as far as they fit."""

    def __init__(self, tagger: Tagger, most: int = 400_000):
        self.tagger, self.most = tagger, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = e = self.tagger.emission(word)
        return e


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray, expect_moves: bool = False):
    """Marginal of tag 1 for every token of texts laid end to end; with `expect_moves` also the expected moves (2 x 2).

    emissions: log potential of tag 1 less that of tag 0. lengths: tokens of each text, may be zero.
    """
    n = len(emissions)
    if n == 0:
        return (np.zeros(0), np.zeros((2, 2))) if expect_moves else np.zeros(0)
    t = np.exp(moves - moves.max())
    e1 = np.exp(np.clip(emissions, -30, 30))
    ends = np.cumsum(lengths)
    rows_of = -(-lengths // ROW)
    text = np.repeat(np.arange(len(lengths)), rows_of)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(rows_of) - rows_of, rows_of)
    start = (ends - lengths)[text] + nth * ROW
    size = np.minimum(ROW, ends[text] - start)
    order = np.argsort(-size, kind="stable")  # rows that go on at a step come first
    text, nth, start, size = text[order], nth[order], start[order], size[order]
    alive = np.searchsorted(-size, -np.arange(ROW), "left")
    rows = len(size)

    # transfer matrix of each row, scaled: p[i][j] from tag i before it to tag j at its end
    p = np.zeros((2, 2, rows))
    p[0, 0] = p[1, 1] = 1
    for k in range(size[0]):
        m = alive[k]
        x0, x1 = p[:, 0, :m], p[:, 1, :m]
        e = e1[start[:m] + k]
        y0 = x0 * t[0, 0] + x1 * t[1, 0]
        y1 = (x0 * t[0, 1] + x1 * t[1, 1]) * e
        scale = y0[0] + y1[0] + y0[1] + y1[1]
        p[:, 0, :m], p[:, 1, :m] = y0 / scale, y1 / scale

    # what comes into each row from the left, and what stands at its right end
    left = np.zeros((2, rows))
    left[0] = 1
    right = np.ones((2, rows))
    by_nth = np.lexsort((text, nth))
    cuts = np.searchsorted(nth[by_nth], np.arange(nth.max() + 2))
    row_at = np.full(len(lengths), -1)
    levels = [by_nth[cuts[k] : cuts[k + 1]] for k in range(nth.max() + 1)]
    for before, now in zip(levels, levels[1:]):
        row_at[text[before]] = before
        prev = row_at[text[now]]
        v = np.einsum("ir,ijr->jr", left[:, prev], p[:, :, prev])
        left[:, now] = v / v.sum(0)
    for before, now in zip(levels[-2::-1], levels[:0:-1]):
        row_at[text[before]] = before
        prev = row_at[text[now]]
        v = np.einsum("ijr,jr->ir", p[:, :, now], right[:, now])
        right[:, prev] = v / v.sum(0)

    a = np.empty((2, n))
    x = left.copy()
    for k in range(size[0]):
        m = alive[k]
        at = start[:m] + k
        y0 = x[0, :m] * t[0, 0] + x[1, :m] * t[1, 0]
        y1 = (x[0, :m] * t[0, 1] + x[1, :m] * t[1, 1]) * e1[at]
        s = y0 + y1
        a[0, at] = x[0, :m] = y0 / s
        a[1, at] = x[1, :m] = y1 / s
    marginal = np.empty(n)
    moved = np.zeros((2, 2))
    b = right
    for k in range(size[0] - 1, -1, -1):
        m = alive[k]
        at = start[:m] + k
        w0, w1 = a[0, at] * b[0, :m], a[1, at] * b[1, :m]
        marginal[at] = w1 / (w0 + w1)
        z0, z1 = b[0, :m].copy(), e1[at] * b[1, :m]
        if expect_moves:
            came = (left[:, :m] if k == 0 else a[:, at - 1])
            joint = np.stack([came[i] * t[i, j] * z for i in (0, 1) for j, z in ((0, z0), (1, z1))])
            moved += (joint / joint.sum(0)).sum(1).reshape(2, 2)
        c0, c1 = t[0, 0] * z0 + t[0, 1] * z1, t[1, 0] * z0 + t[1, 1] * z1
        s = c0 + c1
        b[0, :m], b[1, :m] = c0 / s, c1 / s
    return (marginal, moved) if expect_moves else marginal


def evidence(marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text: largest marginal, log(1 + sum of squared marginals), and that by the log of its length; zeros for no tokens."""
    out = np.zeros((len(lengths), 3))
    some = np.flatnonzero(lengths)
    if len(some):
        starts = (np.cumsum(lengths) - lengths)[some]
        out[some, 0] = np.maximum.reduceat(marginals, starts)
        out[some, 1] = np.log1p(np.add.reduceat(marginals**2, starts))
        out[some, 2] = out[some, 1] / np.log(2.0 + lengths[some])
    return out


def _adam(size: int):
    m, v = np.zeros(size), np.zeros(size)

    def step(k: int, g: np.ndarray, rate: float) -> np.ndarray:
        nonlocal m, v
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        return rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)

    return step


def fit(texts: list[list[str]], tags: list[np.ndarray], rounds: int = 80, ridge: float = 1e-3, rate: float = 0.3) -> Tagger:
    """Maximum conditional likelihood of the tags, with a ridge, by full-batch Adam."""
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    vocabulary: dict[str, int] = {}
    word = np.array([vocabulary.setdefault(w, len(vocabulary)) for x in texts for w in x], dtype=np.int64)
    y = np.concatenate([np.asarray(t, float) for t in tags]) if len(tags) else np.zeros(0)
    parts = [features(w) for w in vocabulary]
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    flat = np.array([f for x in parts for f in x], dtype=np.int64)
    used, flat = np.unique(flat, return_inverse=True)
    model = Tagger(bias=-3.0)
    weights, moves = np.zeros(len(used)), np.zeros((2, 2))
    first = np.zeros(len(y), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    came = np.where(first, 0.0, np.roll(y, 1))
    seen = np.array([[np.sum((came == i) & (y == j)) for j in (0, 1)] for i in (0, 1)], float)
    n = max(1, len(y))
    step, step_moves = _adam(len(used) + 1), _adam(4)
    for k in range(1, rounds + 1 if len(y) else 1):
        of_word = np.bincount(owner, weights[flat], len(parts)) + model.bias
        p, moved = forward_backward(of_word[word], lengths, moves, True)
        wrong = np.bincount(word, p - y, len(parts))
        g = np.bincount(flat, wrong[owner], len(used)) / n + ridge * weights / n
        d = step(k, np.append(g, wrong.sum() / n), rate)
        weights, model.bias = weights - d[:-1], model.bias - d[-1]
        moves = moves - step_moves(k, ((moved - seen) / n + ridge * moves / n).ravel(), rate).reshape(2, 2)
    model.weights[used] = weights
    model.moves = moves
    return model


def fit_link(model: Tagger, found: np.ndarray, labels: np.ndarray, rounds: int = 800) -> None:
    """Logistic weights that turn a document's evidence into its score."""
    x = np.column_stack([np.ones(len(found)), found])
    w, step = np.zeros(x.shape[1]), _adam(x.shape[1])
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - step(k, x.T @ ((p - labels) * share) + 1e-4 * w, 0.2)
    model.link = w
