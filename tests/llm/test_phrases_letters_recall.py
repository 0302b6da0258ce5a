"""Toxicity of harmless words, secrets of letters only, and the recall of the index of vectors."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import embeddings, phrases, secrets, toxicity

PHRASE = "go back where you came from".split()


def labelled(n, seed, words):
    """Texts of the same words, every second with the phrase, every sixth with one word put into it."""
    r, out = random.Random(seed), []
    for i in range(n):
        text = [r.choice(words) for _ in range(80)]
        if i % 2:
            own = list(PHRASE)
            if i % 3 == 0:
                own.insert(3, r.choice(words))
            at = r.randrange(80)
            text[at:at] = [".", *own, "."]
        out.append((i, " ".join(text), i % 2))
    return out


@pytest.fixture(scope="module")
def words():
    r = random.Random(3)
    return ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 8))) for _ in range(400)] + PHRASE


def test_phrases_of_harmless_words(spark, words):
    train, fresh = labelled(400, 1, words), labelled(400, 2, words)
    model = toxicity.fit([t for _, t, _ in train], [y for *_, y in train])
    assert model.phrases is not None
    odd = [(1000, None, 0), (1001, "", 0), (1002, " \n ", 0), (1003, "from came you where back go", 0), (1004, "go. back. where. you. came. from.", 0), (1005, "x " * 100_000 + " ".join(PHRASE), 1)]
    rows = fresh + odd + fresh[:2]
    d = spark.createDataFrame(rows, "doc_id long, text string, y int").withColumn("score", F.lit("other"))
    got = [(r.doc_id, r.score >= 0.5) for r in toxicity.scores(d, model).collect()]
    want = [(i, bool(y)) for i, _, y in rows]
    wrong = sum(a != b for a, b in zip(sorted(got), sorted(want)))
    assert len(got) == len(rows) and wrong <= 4 and set(want[400:406]) <= set(got)
    kept = toxicity.keep_clean(d, model)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i, y in got if not y)
    # Nothing to learn: too few unexplained texts, none clean, or no pair that marks them.
    assert phrases.fit([t for _, t, y in train if y][:5], [t for _, t, y in train if not y], toxicity._machine, 200) is None
    assert phrases.fit([t for _, t, y in train if y], [], toxicity._machine, 200) is None
    assert phrases.fit([t for _, t, y in train if not y][:100], [t for _, t, y in train if not y][100:], toxicity._machine, 100) is None


def test_phrase_kernel_is_its_definition(words):
    r = np.random.default_rng(5)
    a, b = r.integers(0, 8, (20, phrases.SPAN)), r.integers(0, 8, (9, phrases.SPAN))

    def pairs(row):
        for i, j in itertools.combinations(range(phrases.SPAN), phrases.ORDER):
            if row[i] and row[j]:
                yield (row[i], row[j]), phrases.DECAY ** (j - i + 1)

    full = sum(w * w for _, w in pairs(range(1, phrases.SPAN + 1)))
    want = np.array([[sum(u * v for p, u in pairs(x) for q, v in pairs(y) if p == q) / full for y in b] for x in a])
    assert np.allclose(phrases.kernel(a, b, 8), want)
    # Running sums over a text give the same windows.
    x, weight = r.integers(0, 8, 50), r.standard_normal((8, 8))
    weight[0] = weight[:, 0] = 0
    padded = np.concatenate([x, np.zeros(phrases.SPAN, int)])
    assert np.allclose(phrases.windows(x, weight), [sum(weight[p] * w for p, w in pairs(padded[i : i + phrases.SPAN])) for i in range(50)])


def test_letters_only_are_words_or_candidates(spark):
    secret = ["QwErTyUiOpAsDfGhJkLzXc", "xKqLmZpRtYbNvCwDsFgHjT"]
    plain = ["getHttpServerConnectionFactory", "AbstractSingletonProxyFactoryBean", "internationalization-framework_Support", "ABSTRACT_BASE_CLASS_NAME_LONG"]
    long = ["a_" * 100_000 + "b", "aB" * 60_000, "word_" * 40 + "1"]
    d = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(secret + plain + long)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in secrets.scan(d).select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()}
    assert [got[i] for i in range(len(secret))] == [f"entropy:4:{4 + len(t)}" for t in secret]
    assert all(got[i] == "" for i in range(len(secret), len(got)))


@pytest.mark.parametrize("length", [16, 64, 200])
def test_recall_of_pairs_at_the_threshold(spark, length):
    """Pairs just above 0.9, the hardest ones, among vectors that are like no other; and a group of a thousand like vectors."""
    r = np.random.default_rng(length)
    base = r.standard_normal((2400, length))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = r.standard_normal((600, length))
    side -= (side * base[:600]).sum(1)[:, None] * base[:600]
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = r.uniform(0.9001, 0.92, (600, 1))
    group = base[-1] + 0.1 / np.sqrt(length) * r.standard_normal((300, length))
    x = np.vstack([base, cos * base[:600] + np.sqrt(1 - cos**2) * side, group, group[:1].repeat(700, 0)])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    true = (unit @ unit.T >= 0.9).sum(1) - 1
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {v.vec_id: v for v in embeddings.dedup(d).collect()}
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= true).all()
    at = np.arange(2400, 3000)
    print(f"recall of pairs at {length} components: {links[at].sum() / true[at].sum():.3f}, of the group: {links[3000:].sum() / true[3000:].sum():.3f}")
    assert links[at].sum() >= 0.9 * true[at].sum() and links[3000:].sum() >= 0.99 * true[3000:].sum()
    assert {got[i].component_id for i in range(3000, 4000)} == {2399}
