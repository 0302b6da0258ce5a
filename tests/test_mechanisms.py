"""Delimited texts, HTML, urls, numbers, name index, hierarchies, sinks, publishing, extracts and streams against brute force and golden cases."""

import collections
import csv
import io
import json
import os
import random
import re
from urllib.parse import urljoin

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import hierarchy as H, pipelines as P, publish, quality as Q, reshape as R, resolve as J, staging as S, tables as T
from factloom.sources import delimited, html, readers
from factloom.streaming import incremental

# SRC-1


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(['"', ",", "\n", "\r", "\r\n", '""', "a", "é", " ", "漢", "\U0001f600"]), max_size=40))
def test_records_are_those_of_csv(parts):
    t = "".join(parts)
    assert delimited.records(t.encode()).to_pylist() == list(csv.reader(io.StringIO(t, newline="")))


def test_records_of_written_rows():
    r = random.Random(4)
    cell = lambda: r.choice(["", "", "x", "01", 'say "hi"', "a,b", "two\nlines", '"', "\r\n", "ñ" * r.randint(0, 30)])
    rows = [[cell() for _ in range(r.randint(2, 9))] for _ in range(500)] + [["", "", ""], ["", "x", ""]]
    f = io.StringIO(newline="")
    csv.writer(f).writerows(rows)
    assert delimited.records(f.getvalue().encode()).to_pylist() == rows


def test_both_modes_of_census_files(spark, tmp_path):
    a = ',,,"Table 01 : Households, by floor"\r\n\r\n"a\r\nb",,\r\n,,\r\nnote\r\nprov, dist ,gapa,x\r\n,01,02,7\r\n1,,"",\r\n,,,"last ""one"""\r\n\r\n,"x,\r\ny",,'
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + a.encode())
    (tmp_path / "b.csv").write_bytes(b'prov,dist\n,5\n"",6,7\n3')
    (tmp_path / "c.csv").write_bytes(b"\nx,y\n")
    (tmp_path / "d.csv").write_bytes(b"")
    (tmp_path / "e.csv").write_bytes(b"a,b\n\xff\xfe,1\n")
    (tmp_path / "f.csv").write_bytes(b',,,"Table 2"\n1\n2\n')
    got = collections.defaultdict(list)
    for r in sorted(delimited.two_mode_csv(spark, str(tmp_path / "*.csv")).collect(), key=lambda r: r.row_idx):
        got[r.path[-5]].append((r.mode, r.cells, r.error))
    assert [x[1] for x in got["a"]] == [["prov", "dist", "gapa", "x"], ["", "01", "02", "7"], ["1", "", "", ""], ["", "", "", 'last "one"'], [""] * 4, ["", "x,\r\ny", "", ""]] and {x[0] for x in got["a"]} == {"A"}
    assert [x[1] for x in got["b"]] == [["prov", "dist"], ["", "5"], ["", "6", "7"], ["3", ""]] and {x[0] for x in got["b"]} == {"B"}
    assert got["c"] == got["d"] == [("B", [], "empty header")] and got["e"] == [("B", [], "not UTF-8")] and got["f"] == [("A", [], "empty header")]


def test_null_and_many_records(spark):
    text = "a,b\n" + ",1\n" * 25_000
    got = delimited.two_mode(spark.createDataFrame([(1, None), (2, text.encode())], "k int, c binary"), "k", "c")
    assert [(r.row_idx, r.error) for r in got.filter("k = 1").collect()] == [(0, "empty header")]
    two = got.filter("k = 2")
    assert two.count() == 25_001 and two.filter("row_idx > 0 and cells <> array('', '1')").count() == 0


# SRC-5, STR-12, STR-14, STR-15


def page(spark, text):
    return [(r.href, r.text, r.near, r.name) for r in html.anchors(spark.createDataFrame([(1, text), (2, None), (3, "")], "page_id int, html string"), "html").orderBy("pos").collect()]


def test_anchors(spark):
    assert page(spark, "<a href=x.pdf>X</a> <A HREF = 'y.pdf' >Y</A><a name=n>no</a><a href='  '>no</a>") == [("x.pdf", "X", "X", ""), ("y.pdf", "Y", "Y", "")]
    nested = "<ul><li>2024-01-01 <a href=a.pdf>A</a><ul><li>deep <a href=b.pdf>B</a></ul> tail<li><b>2023-02-02</b> <a href=c.pdf>C</a></ul>"
    assert page(spark, nested) == [("a.pdf", "A", "2024-01-01 A deep B tail", ""), ("b.pdf", "B", "deep B", ""), ("c.pdf", "C", "2023-02-02 C", "")]
    assert page(spark, "<h1> <i> </i></h1><div class='x page-title'>In <b>the <i>title</i></b> here</div><title>t</title><!-- <a href=no.pdf> --><p>one<p>two <a href='q.pdf?a=1&amp;b=2'>Q &lt;1&gt;</a>") == [("q.pdf?a=1&b=2", "Q <1>", "two Q <1>", "In the title here")]
    assert page(spark, "<table><tr><td>k<td><a href=t.pdf>T</a><tr><td>other</table>" + "<div>" * 3000 + "<a href=u.pdf>" + "w " * 300)[1][2] == ("w " * 300)[:200]
    assert page(spark, "<h1>Head <span>of <b>all</b></span></h1><p><a href=z.pdf>one<a href=w.pdf>two</p>") == [("z.pdf", "one", "one two", "Head of all"), ("w.pdf", "two", "one two", "Head of all")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_all_links_of_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    got = collections.Counter((r.page_id, r.url) for r in html.links(pages, "url", "html", lambda h: h != "").collect())
    want = set()
    for r in pages.collect():
        bare = re.sub(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", "", r.html or "")
        for tag in re.findall(r"(?is)<a\s[^>]*>", bare):
            if m := re.search(r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", tag):
                if ref := X_unescape(next(g for g in m.groups() if g is not None)).strip():
                    want.add((r.page_id, urljoin(r.url, ref)))
    assert set(got) == want and set(got.values()) <= {1} and len(want) > 50


def X_unescape(t):
    import html as h

    return h.unescape(t)


REFERENCES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s",
    "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/",
    "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g",
    "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y",
    "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http://a/b/c/g",
}


def test_references_of_the_standard(spark):
    """All examples of RFC 3986, section 5.4; the last one as older readers resolve it."""
    rows = spark.createDataFrame([(r,) for r in REFERENCES], "r string")
    assert {x.r: x.u for x in rows.select("r", X.absolute_url(F.lit("http://a/b/c/d;p?q"), F.col("r")).alias("u")).collect()} == REFERENCES
    more = [("http://a/b/", "../up.pdf"), ("http://a", "x/y"), ("http://a?q", "x"), ("https://h/p/q", "http://z/./a/../b"), ("HTTP://h/p/q", "http:r"), ("http://h/p", "//z/a/./b"), ("http://h/a/b/c", "../" * 50 + "d")]
    rows = spark.createDataFrame(more, "b string, r string")
    for x in rows.select("b", "r", X.absolute_url(F.col("b"), F.col("r")).alias("u")).collect():
        assert x.u.lower() == urljoin(x.b, x.r).lower(), x


# NUM-1, NUM-3, NUM-4


def test_shapes_of_numbers(spark):
    texts = ["5d", "3f", "5D", "1e5", "1e", ".5", "5.", ".", "+1", "--1", "1_000", "_1", "1__0", "१२", "१२.५", "inf", "-Infinity", "nan", "0x1f", "1,000", " 7 ", "", "12abc", "1e5f"]

    def python(t):
        try:
            return float(t)
        except ValueError:
            return None

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.census_number(F.col("t")).alias("c"), X.plain_number(F.col("t")).alias("p"), X.is_finite(F.col("t")).alias("f")).collect()
    for r in rows:
        v = python(r.t)
        assert repr(r.c) == repr(v), r
        assert r.p == (None if v != v else v), r
    assert {r.t for r in rows if r.f} == {"1e5", ".5", "5.", "+1", "0x1f", " 7 "}


# JN-4, JN-5


def test_name_index_equals_all_pairs(spark, monkeypatch):
    """10,000 names: the same best matches as by scoring all pairs, of which under 5 % are scored."""
    r = random.Random(9)
    part = ["pur", "gad", "hi", "ma", "la", "kot", "bar", "da", "su", "nag", "ri", "tar", "khu", "ju", "dha", "lek", "phe", "war", "sim", "oli"]
    name = lambda: "".join(r.choice(part) for _ in range(r.randint(3, 5))).capitalize() + r.choice([" Gaunpalika", " Nagarpalika", "", " Rural Municipality"])
    names = sorted({name() for _ in range(11_000)})[:10_000]
    r.shuffle(names)

    def typo(t):
        t = list(t)
        for _ in range(r.randint(1, 3)):
            i = r.randrange(len(t))
            t[i : i + 1] = r.choice([[], [r.choice("abcdeg")], [t[i], r.choice("xyz")]])
        return "".join(t)

    asked = [typo(r.choice(names)) for _ in range(15)] + names[:2] + ["Atlantis", "Zzz Qqq Municipality", "a", ""]
    dim = spark.createDataFrame(list(enumerate(names)), "dim_idx int, canonical string").withColumn("block", F.concat(F.lit("d"), F.col("dim_idx") % 3))
    q = spark.createDataFrame([(t, None if i % 2 else "D1") for i, t in enumerate(asked)], "query string, block string")
    scored, plain = [], J.candidates

    def counted(*args):
        out = plain(*args)
        scored.append(out.count())
        return out

    monkeypatch.setattr(J, "candidates", counted)
    got = {(x.query, x.b): (x.dim_idx, round(x.score, 6) if x.score else None) for x in J.fuzzy_best(q, dim, "block").collect()}
    every = q.select("query", F.lower("block").alias("b")).distinct().join(dim, (F.col("b") == F.col("block")) | F.col("b").isNull()).filter("length(query) > 0")
    every = every.withColumn("score", X.fuzzy_ratio(F.col("canonical"), F.col("query"))).filter("score >= 70").groupBy("query", "b").agg(F.max_by(F.struct("dim_idx", "score"), F.struct("score", -F.col("dim_idx"))).alias("m"))
    want = {(x.query, x.b): (x.m.dim_idx, round(x.m.score, 6)) for x in every.collect()}
    assert {k: v for k, v in got.items() if v[0] is not None} == want and len(got) == len(set(zip(asked, [None if i % 2 else "d1" for i in range(len(asked))], strict=True)))
    assert sum(scored) < 0.05 * len([t for t in asked if t]) * 10_000


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", min_size=1, max_size=12))
def test_bound_of_shared_pairs(a, b):
    """A common subsequence of L letters leaves 3 L - n - m + 1 pairs at least."""
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    grams = lambda t: collections.Counter(p + q for p, q in zip("<" + t, t + ">", strict=True))
    assert sum((grams(a) & grams(b)).values()) >= 3 * rows[-1][-1] - len(a) - len(b) + 1


def test_search_below_the_index(spark):
    dim = spark.createDataFrame([(0, "abcdef", "x"), (1, "zbzdzf", "x")], "dim_idx int, canonical string, block string")
    got = J.fuzzy_best(spark.createDataFrame([("ybydyf", "x"), ("qqq", "x")], "query string, block string"), dim, "block", 40.0).collect()
    assert {(r.query, r.dim_idx) for r in got} == {("ybydyf", 0), ("qqq", None)}


# JN-9, AGG-10


@pytest.mark.parametrize("seed", range(3))
def test_hierarchy_against_walking(spark, seed):
    r = random.Random(seed)
    up = {f"n{i}": (f"n{r.randrange(i)}" if i and r.random() > 0.05 else None) for i in range(60)}
    up |= {f"deep{i}": f"deep{i - 1}" if i else "n0" for i in range(21)}
    up |= {"a": "b", "b": "c", "c": "a", "below": "b", "self": "self", "orphan": "gone", "child": "orphan"}
    rows = [*up.items(), ("n1", "n0" if up["n1"] else None), (None, "n0")]
    closure, faults = H.hierarchy(spark.createDataFrame(rows, "id string, parent string"))
    want, endless = set(), {"a", "b", "c", "below", "self"}
    for k in up:
        at, depth = up[k], 1
        while k not in endless and at in up:
            want.add((k, at, depth))
            at, depth = up[at], depth + 1
    got = [tuple(x) for x in closure.collect()]
    assert set(got) == want and len(got) == len(want)
    assert sorted((x.id or "", x.fault) for x in faults.collect()) == sorted([*((k, "cycle") for k in endless), ("orphan", "lost parent"), ("n1", "repeated key"), ("", "no key")])
    values = {k: r.randint(1, 9) for k in up}
    total = collections.Counter(values)
    for k, a, _ in want:
        total[a] += values[k]
    rolled = H.rolled_up_tree(spark.createDataFrame(list(values.items()), "id string, value long"), closure)
    assert {x.id: x.total for x in rolled.collect()} == dict(total)


def test_hierarchy_without_links(spark):
    closure, faults = H.hierarchy(spark.createDataFrame([], "id long, parent long"))
    assert closure.count() == 0 and faults.count() == 0
    closure, faults = H.hierarchy(spark.createDataFrame([(1, None), (2, None)], "id long, parent long"))
    assert closure.count() == 0 and faults.count() == 0


# SNK-3, SNK-7, SNK-10


def test_null_keys_meet(spark):
    t = spark.createDataFrame([(None, "old", 1), (1, "a", 2), (2, "b", 3)], "k int, v string, kept int")
    b = spark.createDataFrame([(None, "new"), (2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(str, T.upsert(t, b, ["k"], ["v"]).collect())) == sorted(map(str, [r for r in spark.createDataFrame([(None, "new", 1), (1, "a", 2), (2, "c", 3), (3, "d", None)], t.schema).collect()]))
    keys = spark.createDataFrame([(None,), (1,), (9,)], "k int")
    assert [r.k for r in T.delete_keys(t, keys, ["k"]).collect()] == [2]
    assert {(r.k, r.result) for r in T.deleted(t, keys, ["k"]).collect()} == {(None, "deleted"), (1, "deleted"), (9, "NotFound")}


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    t = spark.createDataFrame([(p, k, f"{p}{k}", k) for p in ("a", "b", "c", None) for k in (1, 2, None)], "p string, k int, v string, kept int")
    t.write.partitionBy("p").parquet(path)
    stamps = lambda: {f.parent.name: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    before = stamps()
    batch = spark.createDataFrame([("a", 1, "new"), ("a", None, "null"), ("d", 5, "more")], "p string, k int, v string")
    T.merge_partitions(path, batch, ["p", "k"], ["v"], "p")
    after = stamps()
    assert before["p=b"] == after["p=b"] and before["p=c"] == after["p=c"] and before["p=__HIVE_DEFAULT_PARTITION__"] == after["p=__HIVE_DEFAULT_PARTITION__"] and before["p=a"] != after["p=a"]
    own = {(r.p, r.k): (r.v, r.kept) for r in spark.read.parquet(path).collect()}
    assert own["a", 1] == ("new", 1) and own["a", None] == ("null", None) and own["a", 2] == ("a2", 2) and own["d", 5] == ("more", None) and len(own) == 13
    gone = spark.createDataFrame([("b", 1), ("b", 2), ("b", None), (None, None), ("a", 2)], "p string, k int")
    T.merge_partitions(path, batch.limit(0), ["p", "k"], ["v"], "p", gone)
    own = {(r.p, r.k) for r in spark.read.parquet(path).collect()}
    assert own == {("a", 1), ("a", None), ("c", 1), ("c", 2), ("c", None), (None, 1), (None, 2), ("d", 5)} and stamps()["p=c"] == before["p=c"]


def test_uploads_of_one_batch(spark):
    b = spark.createDataFrame([("k1", "h1", 1), ("k1", "h2", 2), ("k1", "h1", 3), ("k2", "x", 4), ("k3", "y", 5), (None, "z", 6), (None, "w", 7)], "key string, hash string, at int")
    c = spark.createDataFrame([("k2", "x"), ("k3", "other")], "key string, hash string")
    assert [r.status for r in T.archive_status(b, c, order=["at"]).orderBy("at").collect()] == ["new", "conflict", "reuse", "reuse", "conflict", "new", "conflict"]


# SNK-6


def judged(spark, rows):
    return spark.createDataFrame(rows, "staging_id string, run_id string, value double, decision string, revision int").withColumn("outcomes", F.expr("cast(array() as array<struct<kind:string,flag_type:string,detail:string>>)"))


def test_a_run_is_published_whole_or_not_at_all(spark, tmp_path):
    base = str(tmp_path / "facts")
    j = judged(spark, [("a", "r1", 1.0, "promote", 0), ("b", "r1", 2.0, "block", None)])
    good = j.filter("decision <> 'block'").select("staging_id", "value")
    # The job dies after the first output, while the second is written.
    dies = j.select(F.raise_error(F.concat(F.lit("killed at "), "staging_id")).cast("string").alias("staging_id"))
    with pytest.raises(Exception, match="killed"):
        publish.publish({"approved": good, "staged": dies}, base, "r1")
    assert os.path.isdir(f"{base}/runs/r1/approved") and publish.published(spark, base, "approved") is None
    # The audit finds a fault: nothing is visible either.
    with pytest.raises(ValueError, match="unique"):
        publish.promote_run(j, ["staging_id", "value"], base, "r1", Q.violations(j.unionByName(j), ["staging_id"]))
    assert publish.published(spark, base, "approved") is None
    assert publish.promote_run(j, ["staging_id", "value"], base, "r1", Q.violations(j, ["staging_id"]))
    assert [(r.staging_id, r.run_id) for r in publish.published(spark, base, "approved").collect()] == [("a", "r1")] and [r.staging_id for r in publish.published(spark, base, "staged").collect()] == ["b"]
    # A replay changes nothing.
    stamp = os.stat(f"{base}/manifests/r1.json").st_mtime_ns
    assert not publish.promote_run(judged(spark, [("z", "r1", 9.0, "promote", 0)]), ["staging_id", "value"], base, "r1") and os.stat(f"{base}/manifests/r1.json").st_mtime_ns == stamp
    assert publish.promote_run(judged(spark, [("c", "r2", 3.0, "promote", 0)]), ["staging_id", "value"], base, "r2")
    assert {r.staging_id for r in publish.published(spark, base, "approved").collect()} == {"a", "c"} and publish.published(spark, base, "staged", latest=True).count() == 0
    assert {r.run_id for r in publish.manifests(spark, base).collect()} == {"r1", "r2"} and not [f for f in os.listdir(f"{base}/manifests") if f.endswith(".half")]


# PIPE-6, RSH-10


def test_error_classes_of_transfers(spark):
    head = ["S.N.", "District", "Local Level Name", "Equalization Grant (Minimum)", "Conditional Grant (Current)"]
    sheets = {
        "good": [["t"], head, ["1", "Kaski", "Pokhara", "1,000.50", "-"], ["2", "Kaski", "Nowhere at all", "5", "5"], ["3", "Kaski", "", "7", "7"], ["", "", "Total", "9", "9"]],
        "bare": [["a", "b"], ["c", "d"]],
        "nameless": [["District", "x", "y", "Equalization Grant (Minimum)", "Conditional Grant (Current)"], ["Kaski", "Pokhara", "1", "2", "3"]],
        "empty": [head, ["1", "Kaski", "Pokhara", "-", ""]],
        "late": [["x"]] * 25 + [head, ["1", "Kaski", "Pokhara", "1", "2"]],
    }
    cells = spark.createDataFrame([(d, i, j, v) for d, rows in sheets.items() for i, r in enumerate(rows) for j, v in enumerate(r)], "doc_id string, row_idx int, col_idx int, text string")
    dim = spark.createDataFrame([(0, "40402006", "Pokhara", "पोखरा", "metropolitan", "Kaski")], "dim_idx int, federal_code string, name_en string, name_ne string, local_level_type string, district_en string")
    out = P.transfers(cells, dim, 2082)
    assert [(r.doc_id, r.grant_type, str(r.amount_npr), r.unit) for r in out.rows.collect()] == [("good", "equalization_minimum", "1000.50", "NPR_thousand")]
    assert {(r.doc_id, r.row_idx, r.error_class) for r in out.errors.collect()} == {("good", 3, "RegexMismatch"), ("bare", None, "ColumnMissing"), ("nameless", None, "ColumnMissing"), ("late", None, "ColumnMissing"), ("empty", None, "Other")}
    assert {(r.doc_id, r.status, r.n_rows, r.n_errors) for r in out.runs.collect()} == {("good", "partial", 1, 1), *((d, "failure", 0, 1) for d in ("bare", "nameless", "late", "empty"))}


def test_an_extract_reads_its_table_once(spark, tmp_path):
    """The results of an extract don't repeat its work: their plans scan what was written, not the table."""
    cells = [("d", 0, j, t) for j, t in enumerate(["District", "Local Level Name", "Equalization Minimum", "Conditional Current"])] + [("d", 1, j, t) for j, t in enumerate(["Kaski", "Pokhara", "1", "2"])]
    spark.createDataFrame(cells, "doc_id string, row_idx int, col_idx int, text string").write.parquet(str(tmp_path / "cells"))
    dim = spark.createDataFrame([(0, "40402006", "Pokhara", "पोखरा", "metropolitan", "Kaski")], "dim_idx int, federal_code string, name_en string, name_ne string, local_level_type string, district_en string")
    out = P.transfers(spark.read.parquet(str(tmp_path / "cells")), dim, 2082)
    for df in (P.persisted(out), out.errors, out.runs):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "cells" not in plan and plan.count("Relation [") <= 3


def test_groups_of_signatures_are_rows(spark):
    c = spark.createDataFrame([(d, s, i, j) for d in range(50) for s, n in (("C5", 3), ("C6", 1 + (d == 7))) for i in range(n) for j in range(2)], "doc_id int, sheet string, row_idx int, col_idx int")
    m = R.signatures(c)
    assert m.count() == 50 and [tuple(r) for r in R.signature_groups(m).collect()] == [("C5:3x2|C6:1x2", 49, 0), ("C5:3x2|C6:2x2", 1, 7)]


def test_probe_groups_documents_by_signature(spark):
    c = spark.createDataFrame([(d, "C5", i, 0, "x") for d in range(5) for i in range(1 + (d == 0))], "doc_id int, sheet string, row_idx int, col_idx int, text string")
    groups, members, top = P.probed(c, more=[F.array_sort(F.collect_list("doc_id")).alias("docs")])
    assert [tuple(r) for r in groups.collect()] == [("C5:1x1", 4, 1, [1, 2, 3, 4]), ("C5:2x1", 1, 0, [0])]
    assert members.count() == 5 and top.count() == 6


def test_probe_query_lists_the_documents_of_each_group(spark, tmp_path):
    """Nations of one and of two suppliers, one without any name, and suppliers without a nation."""
    import __spark_entry__ as entry

    rows = [(1, "a", 10), (2, "b", 9), (3, None, 8), (4, "d", 7), (5, "e", 7), (6, "f", None), (7, "g", None)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    df = entry.queries()["pipe11_probe"](spark, str(tmp_path))
    assert df.columns == ["signature", "n", "docs"]
    assert sorted(tuple(r) for r in df.collect()) == [("C5:2x4|C6:1x1", 3, "n10,n8,n9"), ("C5:3x4|C6:1x1", 2, "n7")]


# SRT-3


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ranked_registry_numbers_each_row_once(spark, tmp_path, adaptive):
    """More rows than a sort samples, in partitions that are merged by their sizes; one key and one size are null."""
    import __spark_entry__ as entry

    n = 20_000
    rows = [(k, f"{k % 50}" * 20, k % 50 + 1) for k in range(n)] + [(None, "x", 5), (n, "y", None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").repartition(8, "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    conf = {"spark.sql.adaptive.enabled": adaptive, "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = [tuple(r) for r in entry.queries()["srt3_ranked_registry"](spark, str(tmp_path)).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    tier = lambda r: (r[2] or 0) % 4 or 4
    want = sorted(rows, key=lambda r: (tier(r), r[0] is None, r[0] or 0))
    assert sorted(got, key=lambda r: r[1]) == [(r[0], i, f"Tier {tier(r)}" if tier(r) < 4 else "Reference") for i, r in enumerate(want, 1)]


def test_numbers_of_no_rows(spark):
    none = spark.createDataFrame([], "tier int, source_id string")
    assert T.numbered(T.registry_index(none), "pos").collect() == []


# ANL-9


def test_small_shares_of_a_status_are_rounded_once(spark, tmp_path):
    """1.47 and 2.49 of a milliard are 1 and 2 of the last place, not 2 and 3 by way of a tenth place; unknown amounts give no share."""
    import __spark_entry__ as entry

    rows = [(1, "O", 1.47), (2, "O", 2.4), (2, "O", 0.09), (3, "O", 999_999_996.04), (1, "F", 5.0), (1, None, 1.0), (2, None, 3.0), (4, "O", None), (4, "P", None)]
    spark.createDataFrame(rows, "o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = {(r.o_custkey, r.o_orderstatus): (r.amount, r.n, r.share) for r in entry.queries()["anl9_donor_pipeline"](spark, str(tmp_path)).collect()}
    whole = {(1, "F"): (5.0, 1, 1.0), (1, None): (1.0, 1, 0.25), (2, None): (3.0, 1, 0.75), (4, "O"): (None, 1, None), (4, "P"): (None, 1, None)}
    assert got == whole | {(1, "O"): (1.47, 1, 1e-9), (2, "O"): (2.49, 2, 2e-9), (3, "O"): (999_999_996.04, 1, 0.999999996)}


# STM-2, STM-3


def test_late_events_are_counted_over_batches_and_restarts(spark, tmp_path):
    (tmp_path / "ev").mkdir()
    hours = [[1, 5], [9], [2, 10], [3, 11, 8], [12], [4, 13]]

    def write(n):
        (tmp_path / "ev" / f"{n}.json").write_text("\n".join(json.dumps({"event_type": "x" if h % 2 else "y", "occurred_at": f"2024-01-01T{h:02d}:10:00"}) for h in hours[n]))

    def run():
        e = spark.readStream.schema("event_type string, occurred_at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "ev"))
        incremental.count_late(e, str(tmp_path / "late"), str(tmp_path / "cp")).awaitTermination()

    # Closed when read: an hour's window whose end is two hours or more before the latest event of the batches before.
    want, seen = collections.Counter(), 0
    for own in hours:
        for h in own:
            want["x" if h % 2 else "y", "late" if seen and h + 1 <= seen + 1 / 6 - 2 else "on_time"] += 1
        seen = max(seen, *own)
    for first, last in ((0, 3), (3, 5), (5, 6)):
        for n in range(first, last):
            write(n)
            os.utime(tmp_path / "ev" / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
        run()
    got = {(r.event_type, k): r[k] for r in incremental.late_events(spark, str(tmp_path / "late")).collect() for k in ("on_time", "late") if r[k]}
    assert got == dict(want) and sum(v for (_, k), v in want.items() if k == "late") >= 3


def test_rows_of_a_run_are_each_judged_once(spark, tmp_path):
    """The second file of a run is judged, against what the first promoted; a row that is sent again isn't."""
    (tmp_path / "in").mkdir()
    schema = "run_id string, staging_id string, value double"

    def judge(rows, promoted):
        if promoted is None:
            return rows.withColumn("decision", F.lit("promote"))
        known = promoted.select("value", F.lit(True).alias("_known")).distinct()
        return rows.join(known, "value", "left").withColumn("decision", F.when(F.col("_known"), "block").otherwise("promote")).select(*rows.columns, "decision")

    for part, rows in enumerate(([("r1", "a", 1.0), ("r2", "b", 2.0)], [("r1", "c", 3.0), ("r1", "d", 2.0), ("r1", "a", 1.0), ("r3", "e", 5.0)], [("r1", "f", 3.0), ("r1", "d", 2.0)])):
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(json.dumps(dict(zip(("run_id", "staging_id", "value"), r, strict=True))) for r in rows))
        incremental.judge_runs(spark.readStream.schema(schema).json(str(tmp_path / "in")), judge, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.run_id, r.staging_id, r.decision) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("r1", "a", "promote"), ("r1", "c", "promote"), ("r1", "d", "block"), ("r1", "f", "block"), ("r2", "b", "promote"), ("r3", "e", "promote")]


# SRC-2, SRC-6, SRC-9, SRC-10, SNK-5, SNK-12, CHK-11


def test_other_scans_and_sinks(spark, tmp_path):
    (tmp_path / "x.csv").write_text('A.1,"Food, all",3\nB,,\n')
    assert [tuple(r) for r in readers.string_csv(spark, str(tmp_path / "x.csv"), 4).collect()] == [("A.1", "Food, all", "3", ""), ("B", "", "", "")]
    events = spark.createDataFrame([("archived", "u1", "7", "2024-01-01T00:00:00Z", {"a": "1"}, None)], readers.MANIFEST)
    for _ in range(2):
        S.append_events(events, str(tmp_path / "m"))
    (tmp_path / "m" / "more.json").write_text('\n{"event_type": "error", "url": "u2", "schema_version": "2"}\n\n')
    assert sorted((r.event_type, r.url, r.schema_version, r.payload) for r in readers.manifest(spark, str(tmp_path / "m")).collect()) == [("archived", "u1", "1", {"a": "1"})] * 2 + [("error", "u2", "2", None)]
    (tmp_path / "f").mkdir()
    for n, b in (("b.xlsx", b"two"), ("a.xlsx", b"one"), ("c.xlsx", b""), ("d.txt", b"no")):
        (tmp_path / "f" / n).write_bytes(b)
    found = readers.corpus(spark, str(tmp_path / "f"))
    assert [(r.path[-6:], r.length, r.error) for r in found.collect()] == [("a.xlsx", 3, None), ("b.xlsx", 3, None), ("c.xlsx", 0, "empty file")]
    assert readers.files(spark, str(tmp_path / "f")).count() == 4
    catalog = found.select("path", "sha256").unionByName(spark.createDataFrame([("gone.xlsx", "0")], "path string, sha256 string")).withColumn("sha256", F.when(F.col("path").endswith("b.xlsx"), "1").otherwise(F.col("sha256")))
    assert {r.path[-6:] for r in readers.tampered(catalog, found.select("path", "sha256")).collect()} == {"b.xlsx", "e.xlsx"}
    runs, rows = spark.createDataFrame([("r", "failure")], "run_id string, status string"), spark.createDataFrame([], "run_id string, value double")
    errors = spark.createDataFrame([("r", "Other")], "run_id string, error_class string")
    S.write_run(runs, rows, errors, str(tmp_path / "w"))
    assert sorted(os.listdir(tmp_path / "w")) == ["errors", "runs"] and spark.read.parquet(str(tmp_path / "w" / "errors")).count() == 1
