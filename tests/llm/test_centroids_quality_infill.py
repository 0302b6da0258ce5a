"""Centroid clustering, quality rules and fill-in-middle against brute force, with nulls, empty, repeated and odd rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from factloom.llm import centroids, infill, quality_rules as quality, toxicity


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# Centroid clustering


def plain(q, c):
    d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in q]
    return [(min(range(len(c)), key=lambda j: (row[j], j)), min(row)) for row in d]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 9), st.integers(1, 20), st.integers(0, 10**6), st.sampled_from([3, 100, 1 << 20, 1 << 70]))
def test_nearest_against_all_distances(d, k, n, seed, size):
    r = random.Random(seed)
    make = lambda m: np.array([[r.randint(-size, size) for _ in range(d)] for _ in range(m)], np.int64 if size < 1 << 26 else object)
    q, c = make(n), make(k)
    near, dist, _ = centroids.nearest(q, c)
    assert list(zip(near.tolist(), map(int, dist), strict=True)) == plain(q, c)


def test_walk_stops_early():
    """Groups far apart: most centroids are never met."""
    r = np.random.default_rng(1)
    c = r.integers(-100_000, 100_000, (64, 1)) + r.integers(-50, 50, (64, 16))
    q = c[r.integers(0, 64, 500)] + r.integers(-20, 20, (500, 16))
    near, dist, met = centroids.nearest(q, c)
    assert list(zip(near.tolist(), dist.tolist(), strict=True)) == plain(q, c) and met < 500 * 64 / 8


@settings(max_examples=200, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_whole_is_exact(x):
    assert centroids.whole(np.array([[x]]), 1024).tolist() == [[(lambda a, b: a * 1024 // b)(*x.as_integer_ratio())]]


@given(st.integers(-(1 << 1100), 1 << 1100))
def test_limbs(x):
    assert sum(s << (48 * i) for i, s in centroids._limbs(x)) == x and all(-(1 << 63) <= s < 1 << 63 for _, s in centroids._limbs(x))


def clustered(rows, k, rounds, length, scale=1024):
    q = [(i, [(lambda a, b: a * scale // b)(*float(x).as_integer_ratio()) for x in v]) for i, v in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(q, key=lambda r: (sha(f"3:{'' if r[0] is None else r[0]}"), r[1]))[:k]]
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for (_, v), (j, _) in zip(q, plain([v for _, v in q], c), strict=True):
            own[j].append(v)
        c = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else v for j, v in enumerate(c)]
    at = plain([v for _, v in q], c)
    total = collections.Counter()
    for j, d in at:
        total[j] += d
    clip = lambda x: min(x, (1 << 63) - 1)
    return sorted((str(i), j, clip(d), clip(total[j]), clip(sum(total.values())), sha(",".join(map(str, c[j])))) for (i, _), (j, d) in zip(q, at, strict=True))


@pytest.mark.parametrize("wide", [False, True])
def test_clusters_against_brute_force(spark, wide):
    r = random.Random(5)
    rows = [(i, [r.choice([0.0, 0.25, -0.1, r.gauss(0, 1)]) for _ in range(4)]) for i in range(200)]
    rows += [(200, rows[0][1]), (0, rows[0][1]), (201, None), (202, []), (203, [1.0] * 3), (204, [1.0, None, 1.0, 1.0]), (205, [float("nan")] * 4), (206, [float("-inf")] * 4), (None, [0.5] * 4), (207, [-0.0] * 4)]
    if wide:
        rows += [(300, [1e300, -1e308, 1.7e308, 5e-324]), (301, [2.0**60, 1.0, 1.0, 1.0])]
    # Extra columns whose names clash with the result's.
    df = spark.createDataFrame([(i, v, 1.0, "x") for i, v in rows], "vec_id long, embedding array<double>, distance double, cluster string")
    got = centroids.cluster(df.repartition(3), k=5, rounds=4, length=4)
    assert sorted((str(x[0]), *x[1:]) for x in got.collect()) == clustered(rows, 5, 4, 4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], schema), length=2).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, None), (2, [1.0])], schema), length=2).count() == 0
    got = centroids.cluster(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (3, [5.0, 2.0])], schema), length=2).collect()
    assert {r.distance for r in got} == {0} and {r.inertia for r in got} == {0} and len(got) == 3


# Quality rules


def rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(g)
    hit = {i + j for i, x in enumerate(g) if n[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def buckets(t):
    w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())]
    h = lambda x: (lambda v: v - (1 << 64) if v >> 63 else v)(xxhash.xxh64(x.encode(), seed=42).intdigest()) % quality.BUCKETS
    return [h(x) for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def made():
    r = random.Random(3)
    good = lambda n: " ".join(r.choice("the of and a river stone light wind garden bridge quiet morning".split()) + ("\n" if r.random() < 0.1 else "") for _ in range(n))
    bad = lambda n: " ".join(r.choice("buy now click win prize$$$ free### offer*** |".split()) for _ in range(n))
    rows = [(i, good(r.randint(40, 120)) if i % 4 else bad(90)) for i in range(60)]
    once = " ".join(f"w{i}" for i in range(70))
    odd = ["", None, " \n\t ", "a", "a a a a", "a b c a b c", "x\ny\nx\n\nx\r\nx", once, once, once + " " + once, "é Ü ß 漢字 | <b>", "α" * 5000, "a\x0bb\x0cc\x85d\xa0e", "one two\n" * 40]
    return rows + list(enumerate(odd, 100)) + [(None, good(60)), (5, rows[5][1])]


def test_quality_against_brute_force(spark):
    rows, trusted = made(), [(i,) for i in range(30) if i % 4] + [(None,), (999,), (1,)]
    docs = spark.createDataFrame([(i, t, 1.0, False) for i, t in rows], "doc_id long, text string, score double, kept boolean")
    ids = {i for (i,) in trusted} - {None}
    n, m = [1] * quality.BUCKETS, [0] * quality.BUCKETS
    for i, t in rows:
        for g in buckets(t):
            n[g] += 1
            m[g] += i in ids
    want = [round(1_000_000 * math.log((b * sum(n) / a + 1000) / (sum(m) + 1000))) for a, b in zip(n, m, strict=True)]
    weights = quality.fit(docs, spark.createDataFrame(trusted, "doc_id long"))
    assert weights == want
    got = quality.judge(docs, weights).collect()
    expect = []
    for i, t in rows:
        base, b = rules(t), buckets(t)
        s = sum(weights[g] for g in b)
        expect.append((str(i), *base, round(s / max(len(b), 1) / 1e6, 9), not base[-1] and s >= -50_000 * len(b)))
    assert sorted((str(r[0]), *r[1:7], round(r.score, 9), r.kept) for r in got) == sorted(expect)
    kept = {r.doc_id for r in got if r.kept}
    assert kept >= {i for i, t in rows[:60] if i % 4 and not rules(t)[-1]} and not kept & {i for i in range(0, 60, 4)}


def test_quality_without_trusted_texts_or_rows(spark):
    docs = spark.createDataFrame(made(), "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert quality.fit(docs, none) == [0] * quality.BUCKETS
    got = quality.judge(docs, quality.fit(docs, none)).collect()
    assert all(r.kept != r.base_failed and r.score == 0 for r in got) and len(got) == len(made())
    assert quality.judge(docs.limit(0), quality.fit(docs.limit(0), none)).count() == 0


def test_many_trusted_ids_are_joined_by_shuffle(spark, monkeypatch):
    docs, ids = spark.createDataFrame(made(), "doc_id long, text string"), spark.range(40).withColumnRenamed("id", "doc_id")
    want = quality.fit(docs, ids)
    monkeypatch.setattr(quality, "SENT", 10)
    assert quality.fit(docs, ids) == want


def test_quality_stays_in_sql(spark):
    docs = spark.createDataFrame(made(), "doc_id long, text string")
    plan = quality.judge(docs, [1] * quality.BUCKETS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Fill-in-middle


def units(t, unit):
    return {"line": lambda: re.findall(r"[^\n]*\n|[^\n]+", t), "word": lambda: re.findall(r"[^ \t-\r]*[ \t-\r]|[^ \t-\r]+", t), "char": lambda: list(t)}[unit]()


def filled(i, t, unit="line"):
    t = t or ""
    h = [int(sha(f"7:{'' if i is None else i}")[8 * j : 8 * j + 8], 16) for j in range(4)]
    u = units(t, unit)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")):
        return str(i), len(u), "plain", None, None, t
    return (str(i), len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (str(i), len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


ODD = ["", None, "\n", "\n\n\n", "a", "a\n", "a\nb", "é\n漢字\n\U0001f600 x\r\ny\x85z ", "<P>x", "x\n<M>", "< P>\n<S", "line\n" * 3000 + "end", "x" * 100_000, "\U0001f600" * 999 + "\n"]


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_infill_against_brute_force(spark, unit):
    r = random.Random(2)
    rows = list(enumerate(ODD)) + [(100 + i, "".join(r.choice("ab \n\té漢\U0001f600") for _ in range(r.randint(0, 90)))) for i in range(300)] + [(None, "a\nb\nc\n"), (100, "again\n\n")]
    docs = spark.createDataFrame([(i, t, 1, "f") for i, t in rows], "doc_id long, text string, n int, form string")
    out = infill.transform(docs, unit=unit)
    got = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, ((str(x[0]), *x[1:6]) for x in got))) == sorted(map(repr, (filled(i, t, unit) for i, t in rows)))
    assert sorted((str(x.doc_id), x.back) for x in got) == sorted((str(i), t or "") for i, t in rows)
    assert infill.transform(docs.limit(0)).count() == 0
    assert {x.form for x in infill.transform(docs, rate=0).collect()} == {"plain"}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=300))
def test_wavelet_matrix(symbols):
    a = np.array(symbols, np.uint8)
    wm, places = infill.WaveletMatrix(a), np.arange(len(a) + 1)
    for s in range(6):
        assert wm.rank(s, places).tolist() == [symbols[:i].count(s) for i in places]
    for k in range(4):
        at = wm.locate((1, 2), np.array([k]), np.array([0]), np.array([len(a)]))[0]
        assert at == next((i for i in places if sum(x in (1, 2) for x in symbols[:i]) >= k), len(a))


# Toxicity: what its training set is made of


def insulted():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(800)]
    clean = [" ".join(r.choice(words) for _ in range(60)) for _ in range(100)]
    return clean, [t.replace(" ", " zqinsultzq ", 1) for t in clean]


def test_toxic_copies_of_clean_texts_are_learned_from():
    clean, bad = insulted()
    model = toxicity.fit(clean + bad, [0] * 100 + [1] * 100)
    assert model is not None
    score = lambda texts: toxicity._margins(pa.array(texts), model, {})
    assert (score(bad) >= 0.5).mean() > 0.95 and (score(clean) >= 0.5).mean() < 0.05


def test_labels_of_missing_texts_take_no_place(spark, monkeypatch):
    clean, bad = insulted()
    monkeypatch.setattr(toxicity, "SAMPLE", 60)
    docs = spark.createDataFrame(list(enumerate(clean + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in range(200)] + [(i, i % 2) for i in range(10_000, 14_000)] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert model is not None and (toxicity._margins(pa.array(bad), model, {}) >= 0.5).mean() > 0.9
