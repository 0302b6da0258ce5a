"""Toxic phrases of harmless words: a gap-weighted subsequence kernel of words, with Nystrom landmarks.

A sentence is the sequence of its words (lowered, all but letters taken out); tokens without letters are skipped. Two
windows of ``SPAN`` words are compared by their common ordered pairs of words, each weighted by ``DECAY`` for every word
it spans, over the value of a window of different words with itself; so a word put between lowers a match a little.

The machine learns from toxic texts that the units of ``toxicity`` leave unexplained. Pairs of words that stand in
``LEAST`` of them or more, and there far more often than in clean texts (``SURE`` standard errors), name the windows
that become landmarks. A toxic text is a bag of windows of which the best is its witness, chosen again in every round;
the best windows of clean texts are negative. The landmarks' weighted sum is one weight a pair of words, so a whole
text's windows are judged by running sums.

Defined results: without enough unexplained toxic texts, or without a pair that marks them, there is no machine.
"""

from __future__ import annotations

import re

import numpy as np

SPAN, DECAY, ORDER = 6, 0.7, 2
#: Toxic texts that a pair of words must stand in, standard errors by which it marks them, pairs and landmarks kept.
LEAST, SURE, PAIRS, LANDMARKS, ROUNDS, COST = 8, 5.0, 1000, 32, 3, 1000.0
#: Best windows of a clean text that are negative in a round.
HARD = 3
SLOPE = 6.0
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Tokens whose number a worker keeps.
CACHE_TOKENS = 500_000
_AT = [(i, j) for i in range(SPAN) for j in range(i + 1, SPAN)]
_FULL = sum(DECAY ** (2 * (j - i + 1)) for i, j in _AT)


class Numbers(dict):
    """Number of a token's word: from 1, 0 for an unknown word, -1 for a token without letters."""

    def __init__(self, words: dict[str, int], grow: bool = False):
        super().__init__()
        self.words, self.grow = words, grow

    def __missing__(self, token: str) -> int:
        word = "".join(_LETTERS.findall(token))
        n = -1 if not word else self.words.setdefault(word, len(self.words) + 1) if self.grow else self.words.get(word, 0)
        if len(self) < CACHE_TOKENS and len(token) < 64:
            self[token] = n
        return n


def numbers(text: str, of: Numbers) -> list[int]:
    """Words of a text; after each sentence come zeros, so that no window holds words of two."""
    out: list[int] = []
    for sentence in _SENTENCE.split(text.lower()):
        out += [n for n in map(of.__getitem__, sentence.split()) if n >= 0]
        out += [0] * (SPAN - 1)
    return out


def _pairs(x: np.ndarray, size: int) -> np.ndarray:
    """Distinct ordered pairs of known words that a window holds, as one number each."""
    own = [x[:-d] * size + x[d:] for d in range(1, SPAN) if len(x) > d]
    both = [(x[:-d] > 0) & (x[d:] > 0) for d in range(1, SPAN) if len(x) > d]
    return np.unique(np.concatenate([o[b] for o, b in zip(own, both)])) if own else np.zeros(0, np.int64)


def _counted(texts: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs, and in how many texts each is; added up as texts come."""
    key, count, held, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def added():
        new, at = np.unique(np.concatenate([key, *held]), return_inverse=True)
        weight = np.concatenate([count, np.ones(len(at) - len(key), np.int64)])
        return new, np.bincount(at, weight, len(new)).astype(np.int64)

    for x in texts:
        held.append(_pairs(x, size))
        n += len(held[-1])
        if n > 2_000_000:
            (key, count), held, n = added(), [], 0
    return added()


def windows(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum over the ordered pairs of the window that starts at each place: the pair's weight times ``DECAY`` a word spanned."""
    total = np.zeros(len(x))
    for d in range(1, SPAN):
        if len(x) > d:
            sums = np.concatenate([[0.0], np.cumsum(DECAY ** (d + 1) * weight[x[:-d], x[d:]])])
            at = np.arange(len(x))
            total += sums[np.minimum(at + SPAN - d, len(sums) - 1)] - sums[np.minimum(at, len(sums) - 1)]
    return total


def kernel(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Kernel of every window of ``a`` with every one of ``b`` (rows of ``SPAN`` word numbers under ``size``)."""
    codes = {}
    for row in b:
        for i, j in _AT:
            if row[i] and row[j]:
                codes.setdefault(int(row[i]) * size + int(row[j]), len(codes) + 1)
    table = np.zeros((len(codes) + 1, len(b)))
    for n, row in enumerate(b):
        for i, j in _AT:
            if row[i] and row[j]:
                table[codes[int(row[i]) * size + int(row[j])], n] += DECAY ** (j - i + 1)
    known = np.array(sorted(codes), np.int64)
    place = np.array([codes[k] for k in known.tolist()], np.int64)
    out = np.zeros((len(a), len(b)))
    if len(known):
        for i, j in _AT:
            own = a[:, i].astype(np.int64) * size + a[:, j]
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            out += DECAY ** (j - i + 1) * table[np.where((known[at] == own) & (a[:, i] > 0) & (a[:, j] > 0), place[at], 0)]
    return out / _FULL


class Phrases:
    """Margin of a text: its best window's."""

    def __init__(self, words: dict[str, int], weight: np.ndarray, bias: float, shift: float):
        self.words, self.weight, self.bias, self.shift = words, weight, bias, shift
        self.of = Numbers(words)

    def __getstate__(self):
        return {**self.__dict__, "of": Numbers(self.words)}

    def margins(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if len(self.of) >= CACHE_TOKENS:
            self.of.clear()
        own = [numbers(t, self.of) for t in texts]
        start = np.cumsum([0, *map(len, own[:-1])])
        return np.maximum.reduceat(windows(np.array([n for x in own for n in x], np.int64), self.weight), start) + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(SLOPE * (self.margins(texts) - self.shift), -50, 50)))


def _best(texts: list[np.ndarray], weight: np.ndarray, most: int) -> tuple[list[list[tuple]], np.ndarray]:
    """The best windows of each text (at most ``most``, those that hold a pair), and its best value."""
    rows, value = [], np.zeros(len(texts))
    for n, x in enumerate(texts):
        v = windows(x, weight)
        at = np.argsort(-v, kind="stable")[:most]
        value[n] = v[at[0]]
        padded = np.concatenate([x, np.zeros(SPAN, np.int64)])
        rows.append([tuple(padded[i : i + SPAN].tolist()) for i in at.tolist() if v[i] != 0])
    return rows, value


def fit(toxic: list[str], clean: list[str], machine, of_all: int) -> Phrases | None:
    """Train on unexplained toxic texts (of ``of_all`` toxic ones) and clean ones; ``machine`` is the solver of the linear machine."""
    if len(toxic) < LEAST or not clean:
        return None
    words: dict[str, int] = {}
    grow, fixed = Numbers(words, grow=True), Numbers(words)
    pos = [np.array(numbers(t, grow), np.int64) for t in toxic]
    neg = [np.array(numbers(t, fixed), np.int64) for t in clean]
    size = len(words) + 1
    key, in_pos = _counted(pos, size)
    key, in_pos = key[in_pos >= LEAST], in_pos[in_pos >= LEAST]
    if not len(key):
        return None
    in_neg = np.zeros(len(key))
    for x in neg:
        own = _pairs(x, size)
        at = np.minimum(np.searchsorted(key, own), len(key) - 1)
        in_neg[at[key[at] == own]] += 1
    p, q = (in_pos + 0.5) / (len(pos) + 1), (in_neg + 0.5) / (len(neg) + 1)
    link = (p - q) / np.sqrt(p * (1 - p) / len(pos) + q * (1 - q) / len(neg))
    sure = np.argsort(-link, kind="stable")[:PAIRS]
    sure = sure[link[sure] >= SURE]
    if not len(sure):
        return None
    # From here on only words of such pairs have numbers.
    used = np.unique(np.concatenate([key[sure] // size, key[sure] % size]))
    new = np.zeros(size, np.int64)
    new[used] = np.arange(1, len(used) + 1)
    weight = np.zeros((len(used) + 1, len(used) + 1))
    weight[new[key[sure] // size], new[key[sure] % size]] = link[sure]
    pos, neg, size = [new[x] for x in pos], [new[x] for x in neg], len(used) + 1
    words = {w: int(new[n]) for w, n in words.items() if new[n]}

    witness, value = _best(pos, weight, 1)
    ranked = [witness[i][0] for i in np.argsort(-value, kind="stable").tolist() if witness[i]]
    pool = np.array(list(dict.fromkeys(ranked)), np.int64).reshape(-1, SPAN)[:2000]
    own = np.sqrt(np.diagonal(kernel(pool, pool, size))) if len(pool) else np.zeros(0)
    near, marks = np.zeros(len(pool)), []
    while len(marks) < LANDMARKS and (near < 0.8).any():
        marks.append(int((near < 0.8).argmax()))
        near = np.maximum(near, kernel(pool, pool[marks[-1:]], size)[:, 0] / np.maximum(own * own[marks[-1]], 1e-12))
    marked = pool[marks]
    values, vectors = np.linalg.eigh(kernel(marked, marked, size))
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    nothing, hard = (0,) * SPAN, {(0,) * SPAN}
    for _ in range(ROUNDS):
        found = [w[0] if w else nothing for w in _best(pos, weight, 1)[0]]
        hard.update(w for rows in _best(neg, weight, HARD)[0] for w in rows)
        x = kernel(np.array(found + sorted(hard), np.int64), marked, size) @ root
        y = np.r_[np.ones(len(found)), -np.ones(len(hard))]
        w, bias = machine(x, COST * np.r_[np.full(len(found), 1 / len(found)), np.full(len(hard), 1 / len(hard))], y)
        beta, weight = root @ w, np.zeros_like(weight)
        for b, row in zip(beta, marked):
            for i, j in _AT:
                if row[i] and row[j]:
                    weight[row[i], row[j]] += b * DECAY ** (j - i + 1) / _FULL
    high, low = np.sort(_best(pos, weight, 1)[1] + bias), np.sort(_best(neg, weight, 1)[1] + bias)
    each = np.unique(np.concatenate([high, low, [low.max() + 1]]))
    cost = np.searchsorted(high, each) / of_all + 3 * (len(low) - np.searchsorted(low, each)) / len(low)
    i = int(cost.argmin())
    if len(high) - np.searchsorted(high, each[i]) < LEAST:
        return None
    return Phrases(words, weight, bias, float((each[i] + (each[i - 1] if i else each[i] - 1)) / 2))
