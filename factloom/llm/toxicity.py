"""Toxicity: a support vector machine on a gap-weighted subsequence string kernel, with Nystrom landmarks.

A text is its sentences' units: each token with all but its letters taken out (so ``i.d-iot`` is ``idiot``), its
letter runs where it has several, and runs of single letters joined; a unit of over ``LONGEST`` letters is cut
into overlapping ones, so whole texts count. Two units are compared by the kernel of Lodhi et al.: the common
subsequences of ``ORDER`` letters, each weighted by ``DECAY`` for every letter it spans, normalised. Inserted and
missing letters thus lower a match a little instead of losing it. Landmarks map units to a finite feature space,
where a squared-hinge machine is trained on labelled sentences: those of toxic documents are bags of which the
best units are witnesses (chosen again in every round), all units of the others are negative, hard ones first.
A document scores the logistic of its best unit's margin, or that of its best phrase (``phrases``: the kernel over the
words of a sentence) where toxic texts that no unit explains teach one, whichever is higher.

Labels are learned from a sample of at most ``SAMPLE`` labelled rows a class (by hash of the id, texts of up to
``TRAIN_CHARS`` characters); that bounds what the driver holds. Every text is scored whole.

Defined results: null and empty texts score as one without any unit or phrase; repeated rows are scored one by one; several
labels of an id count as toxic if one does, null labels as none; without labels of both classes all scores are 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm import phrases
from factloom.llm._common import mix

ORDER, DECAY, LONGEST = 3, 0.6, 24
SAMPLE, TRAIN_CHARS, LANDMARKS, ROUNDS, COST = 1000, 20_000, 72, 4, 1000.0
#: Witnesses of a toxic bag besides its best unit, and the least z-score of those.
WITNESSES, SIGNIFICANT = 4, 3.0
#: Share of clean texts that units alone may flag where phrases help them.
STRICT = 0.002
#: Units whose margin a Python worker keeps.
CACHE_UNITS = 500_000
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def units(text: str) -> set[str]:
    """The distinct units of a text; those of a text are those of its sentences."""
    out, single = set(), []
    for token in set_or_list(text):
        if token.isalpha():
            whole = token
        else:
            runs = _LETTERS.findall(token)
            if not runs:
                continue
            if len(runs) > 1:
                out.update(r for r in runs if len(r) >= ORDER)
            whole = "".join(runs)
        if len(whole) == 1:
            single.append(whole)
            continue
        if len(single) >= ORDER:
            out.add("".join(single))
        single = []
        if len(whole) >= ORDER:
            out.add(whole)
    if len(single) >= ORDER:
        out.add("".join(single))
    long = [u for u in out if len(u) > LONGEST]
    for u in long:
        out.discard(u)
        out.update(u[i : i + LONGEST] for i in range(0, len(u) - LONGEST // 2, LONGEST // 2))
    return out


def set_or_list(text: str):
    """Tokens of the lowered text; where no token is a single letter their order is of no use, so each counts once."""
    tokens = text.lower().split()
    seen = dict.fromkeys(tokens)
    return tokens if sum(len(t) <= 2 for t in seen) >= ORDER and re.search(r"(?:^|\s)\S{1,2}\s+\S{1,2}\s+\S{1,2}(?:\s|$)", text) else seen


def _codes(words: list[str], pad: int) -> np.ndarray:
    """Code points, after a mark of the unit's start."""
    n = max(map(len, words)) + 1
    words = ["\1" + w for w in words]
    a = np.frombuffer("".join(w.ljust(n, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), n)
    return np.where(a == 0, pad, a).astype(np.int32)


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Subsequence kernel of every row of a (n, 1 or m, letters) with every row of b, broadcast; padding never matches."""
    lam, lam2 = np.float32(DECAY), np.float32(DECAY * DECAY)
    shape = np.broadcast_shapes(a.shape[:-1], b.shape[:-1])
    la, lb = a.shape[-1], b.shape[-1]
    state = [[np.zeros(shape, np.float32) for _ in range(lb + 1)] for _ in range(ORDER - 1)]
    total = np.zeros(shape, np.float32)
    for i in range(la):
        new = [[s[0]] for s in state]
        run = [np.zeros(shape, np.float32) for _ in range(ORDER - 1)]
        for j in range(lb):
            hit = (a[..., i] == b[..., j]).astype(np.float32) * lam2
            total += hit * state[ORDER - 2][j]
            for k in range(ORDER - 1):
                run[k] *= lam
                run[k] += hit if k == 0 else hit * state[k - 1][j]
                new[k].append(lam * state[k][j + 1] + run[k])
        state = new
    return total


def _norms(words: list[str]) -> np.ndarray:
    return np.sqrt(_kernel(_codes(words, -1)[:, :], _codes(words, -2)[:, :]))


def similarity(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of every word with every landmark."""
    out = np.empty((len(words), len(landmarks)), np.float32)
    by, own = _codes(landmarks, -2)[None], _norms(landmarks)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for s in range(0, len(order), 512):
        at = order[s : s + 512]
        part = [words[i] for i in at]
        out[at] = _kernel(_codes(part, -1)[:, None], by) / (_norms(part)[:, None] * own)
    return out


def _machine(x: np.ndarray, weight: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared-hinge machine by Newton's steps; rows count by weight."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, reg = np.zeros(x.shape[1]), np.eye(x.shape[1])
    reg[-1, -1] = 1e-6
    for _ in range(50):
        active = y * (x @ w) < 1
        a = x[active] * weight[active, None]
        new = np.linalg.solve(reg + a.T @ x[active], a.T @ y[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def _explicit(words: list[str]):
    """For each length: places of the words, every triple of their (marked) letters as three arrays, the triples' weights."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, at in by.items():
        i, j, k = np.array(list(combinations(range(n + 1), ORDER))).T
        weight = (DECAY ** (k - i + 1)).astype(np.float32)
        for s in range(0, len(at), max(1, (1 << 19) // len(i))):
            own = at[s : s + max(1, (1 << 19) // len(i))]
            codes = _codes([words[x] for x in own], 0)
            yield np.array(own), codes, (i, j, k), weight


class Model:
    """Margin of a unit: its kernel values with the landmarks, weighted.

    The kernel's feature space is explicit (weights of letter triples), so the landmarks' weighted sum is one vector
    there, and a unit's margin one product with it: the same value as from the kernel, at a small part of its cost.
    """

    def __init__(self, landmarks: list[str], beta: np.ndarray, bias: float, slope: float, shift: float):
        self.landmarks, self.beta, self.bias, self.slope, self.shift = landmarks, beta, bias, slope, shift
        self.phrases: phrases.Phrases | None = None
        letters = sorted({ord(c) for c in "\1" + "".join(landmarks)})
        self.letters = np.array(letters, np.int32)
        self.size = len(letters) + 1
        triples = np.zeros(self.size**3 if self.size <= 256 else 0, np.float64)
        if len(triples):
            scale = beta / _norms(landmarks)
            for at, codes, (i, j, k), weight in _explicit(landmarks):
                c = self._coded(codes)
                np.add.at(triples, (c[:, i] * self.size + c[:, j]) * self.size + c[:, k], weight * scale[at][:, None])
        self.triples = triples.astype(np.float32)

    def _coded(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of the letters from 1; 0 for one that no landmark has."""
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at + 1, 0)

    def margins(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        if not len(self.triples):
            return similarity(words, self.landmarks) @ self.beta + self.bias
        out = np.empty(len(words))
        for at, codes, (i, j, k), weight in _explicit(words):
            c = self._coded(codes)
            value = self.triples[(c[:, i] * self.size + c[:, j]) * self.size + c[:, k]] @ weight
            out[at] = value / np.sqrt(_kernel(codes, codes)) + self.bias
        return out

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin - self.shift), -50, 50)))


def _witnesses(score: np.ndarray, sure: np.ndarray, bag: np.ndarray) -> np.ndarray:
    """The best unit of a bag, and up to ``WITNESSES`` that the labels mark by themselves."""
    bag = bag[np.argsort(-score[bag], kind="stable")]
    return np.union1d(bag[:1], bag[sure[bag]][:WITNESSES])


def _without_copies(bags: list[tuple], toxic: list[int]) -> list[int]:
    """Places of bags, without near copies of earlier ones of their class (three of four min-hashes as in one of them): a copied text is one witness, not many, but a clean text and its copy with an insult both stay."""
    by: dict[tuple, list[int]] = {}
    kept = []
    for i, bag in enumerate(bags):
        h = mix(np.array([zlib.crc32(u.encode()) for u in bag], np.uint64)) if bag else np.zeros(1, np.uint64)
        marks = [(toxic[i], k, int(mix(h ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).min())) for k in range(4)]
        if max(Counter(j for m in marks for j in by.get(m, ())).values(), default=0) < 3:
            kept.append(i)
        for m in marks:
            by.setdefault(m, []).append(i)
    return kept


def fit(texts: list[str], toxic: list[int]) -> Model | None:
    """Train on labelled texts; None if a class has no text with units."""
    bags = [tuple(sorted(set().union(*(units(s) for s in _SENTENCE.split(t))))) for t in texts]
    kept = [i for i in _without_copies(bags, toxic) if bags[i]]
    texts, bags, toxic = [texts[i] for i in kept], [bags[i] for i in kept], [toxic[i] for i in kept]
    pos, neg = [b for b, y in zip(bags, toxic) if y], [b for b, y in zip(bags, toxic) if not y]
    if not pos or not neg:
        return None
    vocabulary = sorted(set().union(*map(set, bags)))
    at = {u: i for i, u in enumerate(vocabulary)}
    in_pos, in_neg = np.zeros(len(at)), np.zeros(len(at))
    for own, count in ((pos, in_pos), (neg, in_neg)):
        for b in own:
            count[[at[u] for u in b]] += 1
    p, q = (in_pos + 0.5) / (len(pos) + 1), (in_neg + 0.5) / (len(neg) + 1)
    link = (p - q) / np.sqrt(p * (1 - p) / len(pos) + q * (1 - q) / len(neg))
    marks: list[str] = []
    rng = np.random.default_rng(7)
    plain = np.flatnonzero(in_neg > 0)
    kernel = np.zeros((len(vocabulary), 0), np.float32)

    def add(ranked: np.ndarray, most: int, like: float) -> np.ndarray:
        """The kernel, with up to ``most`` more landmarks: the best of ``ranked`` that none taken before is ``like``."""
        pool = [vocabulary[i] for i in ranked[:3000]]
        near = similarity(pool, marks).max(1) if marks and pool else np.zeros(len(pool))
        new: list[str] = []
        while len(new) < most and (near < like).any():
            new.append(pool[int((near < like).argmax())])
            near = np.maximum(near, similarity(pool, new[-1:])[:, 0])
        marks.extend(new)
        return np.hstack([kernel, similarity(vocabulary, new)]) if new else kernel

    kernel = add(np.argsort(-link, kind="stable"), LANDMARKS // 2, 0.6)
    kernel = add(rng.permutation(plain), LANDMARKS // 6, 0.9)
    score, sure = link, link >= max(SIGNIFICANT, link.max() / 2)
    some = rng.choice(plain, min(len(plain), 20_000), replace=False)
    for turn in range(ROUNDS):
        value, vector = np.linalg.eigh(similarity(marks, marks).astype(float))
        root = vector[:, value > 1e-6] / np.sqrt(value[value > 1e-6])
        x = kernel @ root.astype(np.float32)
        witness = np.concatenate([_witnesses(score, sure, np.array([at[u] for u in b])) for b in pos])
        hard = plain[np.argsort(-score[plain], kind="stable")[:4000]]
        negative = np.union1d(some, hard)
        weight = COST * np.r_[np.full(len(witness), 1 / len(witness)), in_neg[negative] / len(neg)]
        w, bias = _machine(np.vstack([x[witness], x[negative]]).astype(float), weight, np.r_[np.ones(len(witness)), -np.ones(len(negative))])
        score = x @ w.astype(np.float32) + np.float32(bias)
        beta = root @ w
        if turn < ROUNDS - 1:
            kernel = add(plain[np.argsort(-score[plain], kind="stable")], LANDMARKS // 6, 0.9)
    best = lambda own: np.array([score[[at[u] for u in b]].max() for b in own])
    found, other = best(pos), best(neg)
    shift, cost = _cut(found, other)
    model = Model(list(marks), beta, bias, 6.0, shift)
    # Phrases learn from what units find at a strict cut only; they are kept where both together err less.
    strict = max(shift, float(np.quantile(other, 1 - STRICT)) + 1e-6)
    mine, theirs = [t for t, y in zip(texts, toxic) if y], [t for t, y in zip(texts, toxic) if not y]
    extra = phrases.fit([t for t, v in zip(mine, found) if v < strict], theirs, _machine, len(pos))
    if extra is not None:
        missed = (found < strict) & (extra.margins(mine) < extra.shift)
        wrong = (other >= strict) | (extra.margins(theirs) >= extra.shift)
        if missed.mean() + 3 * wrong.mean() < cost:
            model.phrases, model.shift = extra, strict
    return model


def _cut(high: np.ndarray, low: np.ndarray) -> tuple[float, float]:
    """The margin that loses the fewest of ``high``, a flagged one of ``low`` counted thrice; and its cost."""
    high, low = np.sort(high), np.sort(low)
    each = np.unique(np.concatenate([high, low, [low.max() + 1]]))
    cost = np.searchsorted(high, each) / len(high) + 3 * (len(low) - np.searchsorted(low, each)) / len(low)
    i = int(cost.argmin())
    return float((each[i] + (each[i - 1] if i else each[i] - 1)) / 2), float(cost[i])


def _margins(column: pa.Array, model: Model | None, cache: dict) -> np.ndarray:
    """Scores of texts."""
    out = []
    for at in range(0, len(column), 512):
        texts = [t or "" for t in column.slice(at, 512).to_pylist()]
        own = [units(t) for t in texts]
        if model is None:
            out += [0.0] * len(own)
            continue
        if len(cache) > CACHE_UNITS:
            cache.clear()
        new = list(set().union(*own) - cache.keys())
        cache.update(zip(new, model.margins(new).tolist()))
        score = np.array([float(model.score(np.float64(max(map(cache.__getitem__, u))))) if u else 0.0 for u in own])
        out += (score if model.phrases is None else np.maximum(score, model.phrases.scores(texts))).tolist()
    return np.array(out)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 5, held: int = 0) -> Model | None:
    """A model from labelled rows outside the held-out fold (crc32 of the id as text, modulo ``fold``)."""
    known = (
        labels.filter(F.col(label_col).isNotNull() & (F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(fold)) != held))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).alias("y"))
    )
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.length("text") <= TRAIN_CHARS)
    # Labels of texts that aren't there, or are too long, take no place in the sample; ids alone are shuffled for that.
    known, sample = known.join(text.select("id").distinct(), "id", "left_semi"), []
    for y in (0, 1):
        own = known.filter((F.col("y") > 0) == bool(y)).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
        sample += text.join(F.broadcast(own), "id").orderBy(F.xxhash64("id"), "id", "text").limit(SAMPLE).collect()
    return fit([r.text for r in sample], [int(r.y > 0) for r in sample])


def scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        cache: dict = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_margins(batch.column(1), sent.value, cache), pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with all its columns, without the rows that score ``threshold`` or more."""
    sent, where = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        cache: dict = {}
        for batch in batches:
            yield batch.filter(pa.array(_margins(batch.column(where), sent.value, cache) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole of ``documents``."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return scores(docs, learn(docs, labels)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
