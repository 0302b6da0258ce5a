import datetime
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from factloom.functions.text import amount
from factloom.operators import pipelines as P, quality as Q, reshape as R, resolve as J, tables as T
from factloom.sources import delimited, html, readers
from factloom.streaming import incremental


def test_grants_sheet(spark):
    head = ["S.N.", "District", "Local Level Name", "Equalization Grant (Minimum)", "Conditional Grant (Current)"]
    rows = [["Title"], head, ["1", "Kathmandu", "Kathmandu", "1,000.00", "0"], ["2", "Kaski", "Pokhara", "-", "6"], ["", "", "Total", "9", "9"]]
    cells = spark.createDataFrame([("d", i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r)], "doc_id string, row_idx int, col_idx int, text string")
    got = {(r.name, r.grant_type, float(r.amount)) for r in R.grants(cells, amount).collect()}
    assert got == {("Kathmandu", "equalization_minimum", 1000.0), ("Kathmandu", "conditional_current", 0.0), ("Pokhara", "conditional_current", 6.0)}


def test_fuzzy_falls_back_to_the_whole_dimension(spark):
    dim = spark.createDataFrame([(0, "Phungling Municipality", "Taplejung"), (1, "Pokhara Metropolitan City", "Kaski")], "dim_idx int, canonical string, district string")
    q = spark.createDataFrame([("Phungling Municipalty", "TAPLEJUNG"), ("Pokhara Metropolitan City", "Nowhere"), ("Atlantis Megalopolis", "Kaski"), ("", "Kaski")], "query string, district string")
    got = {r.query: (r.canonical, r.tier) for r in J.fuzzy_best(q, dim, "district").collect()}
    assert got["Phungling Municipalty"] == ("Phungling Municipality", "high") and got["Pokhara Metropolitan City"] == ("Pokhara Metropolitan City", "high")
    assert got["Atlantis Megalopolis"][0] is None and got[""][0] is None


def test_sinks_are_idempotent(spark):
    a = spark.createDataFrame([(1, None, "x"), (1, None, "y"), (2, "b", "z")], "k int, n string, v string")
    new = T.insert_missing(a, a.limit(0), ["k", "n"], ["v"])
    assert sorted(r.v for r in new.collect()) == ["x", "z"]
    assert T.insert_missing(a, new, ["k", "n"], ["v"]).count() == 0
    up = T.upsert(new.drop("n"), spark.createDataFrame([(2, "w"), (3, "u")], "k int, v string"), ["k"], ["v"])
    assert {(r.k, r.v) for r in up.collect()} == {(1, "x"), (2, "w"), (3, "u")}


STAGED = "staging_id string, run_id string, document_id string, indicator string, period_type string, period_bs string, value double, unit string, ad_end date, inserted_at int, grade string"
APPROVED = "indicator string, period_type string, period_bs string, document_id string, value double, revision int, ad_end date"


def judged(spark, rows, approved=(), **more):
    known = spark.createDataFrame([("i",), ("k",)], "indicator string")
    docs = spark.createDataFrame([("s", "h"), ("t", "h"), ("bare", "")], "document_id string, hash string")
    j = Q.validate(spark.createDataFrame(rows, STAGED), spark.createDataFrame(list(approved), APPROVED), known, docs, **more)
    return {r.staging_id: (r.decision, [o.flag_type for o in r.outcomes], r.revision) for r in j.collect()}, j


def row(n, run="r", doc="s", indicator="i", kind="monthly", period="Shrawan 2082", value=1.0, unit="count", end=datetime.date(2024, 1, 1), at=None, grade="A"):
    return (n, run, doc, indicator, kind, period, value, unit, end, at if at is not None else ord(n[0]), grade)


def test_validation_routes_rows(spark):
    got, j = judged(spark, [row("a"), row("b"), row("c", period="Bhadra 2082", unit="parsecs"), row("d", indicator="j", period="Magh 2082")])
    assert got == {"a": ("promote", [], 0), "b": ("block", ["DuplicateOfApproved"], None), "c": ("block", ["UnitUnrecognized"], None), "d": ("block", ["IndicatorUnknown"], None)}
    s = Q.summary(j).first()
    assert (s.total, s.promoted, s.with_warnings, s.blocked) == (4, 1, 0, 3) and Q.blocking_flags(j).count() == 3


def test_every_check_can_block(spark):
    got, _ = judged(spark, [
        row("a", value=float("inf"), period="Bhadra 2082"), row("b", value=float("nan"), period="Magh 2082"), row("c", kind="bogus"), row("d", period=""), row("e", period="some time"), row("f", grade="Z", period="Kartik 2082"),
        row("g", doc="bare", period="Poush 2082"), row("h", doc="lost", period="Jestha 2082"), row("i", value=None, period="Asar 2082"),
    ])
    assert {k: (v[0], v[1]) for k, v in got.items()} == {
        "a": ("block", ["SchemaInvalid"]), "b": ("block", ["SchemaInvalid"]), "c": ("block", ["SchemaInvalid"]), "d": ("block", ["SchemaInvalid", "PeriodAmbiguous"]), "e": ("block", ["PeriodAmbiguous"]), "f": ("block", ["SchemaInvalid"]),
        "g": ("block", ["SourceHashCollision"]), "h": ("block", ["SourceHashCollision"]), "i": ("block", ["SchemaInvalid"]),
    }
    with pytest.raises(LookupError):
        judged(spark, [row("h", doc="lost")], strict=True)


def test_revisions_over_several_runs(spark):
    """A later run sees what an earlier one promoted: the same document is blocked, an equal value is no revision, another value is the next one."""
    old = [("k", "monthly", "Shrawan 2082", "o", 5.0, 3, datetime.date(2024, 1, 1)), ("k", "monthly", "Bhadra 2082", "o", 5.0, -1, datetime.date(2024, 1, 1))]
    got, _ = judged(spark, [
        row("a", "r1", "s"), row("b", "r2", "t"), row("c", "r2", "t", value=2.0), row("d", "r3", "s", value=2.0), row("e", "r3", "s", value=4.0),
        row("f", "r1", "s", "k", value=5.0), row("g", "r1", "s", "k", value=6.0), row("h", "r1", "s", "k", period="Bhadra 2082", value=6.0),
    ], old)
    assert {k: (v[0], v[2]) for k, v in got.items()} == {"a": ("promote", 0), "b": ("block", None), "c": ("promote", 1), "d": ("block", None), "e": ("promote", 2), "f": ("block", None), "g": ("promote", 4), "h": ("block", None)}
    assert got["h"][1] == ["RevisionMismatch"]


def test_trailing_values_of_the_same_run(spark):
    """Values promoted earlier in the run count for the plausibility of later ones; equal values have no deviation."""
    months = ("Shrawan", "Bhadra", "Ashwin", "Kartik", "Mangsir", "Poush")
    day = lambda i: datetime.date(2024, 1 + i, 1)
    rows = [row(f"{'abcdef'[i]}", period=f"{m} 2082", value=v, end=day(i)) for i, (m, v) in enumerate(zip(months, (1.0, 1.1, 0.9, 1.0, 1.05, 90.0)))]
    same = [row(f"{'uvwxyz'[i]}", indicator="k", period=f"{m} 2082", value=v, end=day(i)) for i, (m, v) in enumerate(zip(months, (0.1, 0.1, 0.1, 0.1, 0.1, 7.0)))]
    got, _ = judged(spark, rows + same)
    assert {k for k, v in got.items() if v[0] == "warn"} == {"f"} and got["f"][1] == ["ValueOutOfPlausibleRange"]
    # The same through brute force, with values that were approved before and a window that ends.
    rng = random.Random(5)
    approved = [("i", "annual", f"p{i}", "o", rng.random(), 0, datetime.date(2023, 1, 1) + datetime.timedelta(days=40 * i)) for i in range(9)]
    staged = spark.createDataFrame([row(f"{'abcdefghijkl'[i]}", period=f"x{i}", value=rng.random(), end=datetime.date(2023, 6, 1) + datetime.timedelta(days=rng.randrange(300)), at=i // 3) for i in range(12)], STAGED)
    promoted = staged.filter("staging_id not in ('c', 'g')")
    both = {r.staging_id: r for r in Q.both_stats(Q.trailing_stats(staged, spark.createDataFrame(approved, APPROVED), 100), Q.stats_in_run(staged, promoted, 100)).collect()}
    for s in staged.collect():
        since = s.ad_end - datetime.timedelta(days=100)
        v = [a[4] for a in approved if a[6] >= since] + [p.value for p in promoted.collect() if (p.inserted_at, p.staging_id) < (s.inserted_at, s.staging_id) and p.ad_end >= since]
        if v:
            r = both[s.staging_id]
            assert r.n == len(v) and abs(r["mean"] - statistics.fmean(v)) < 1e-9 and abs(r.sd - statistics.pstdev(v)) < 1e-7 and (r.low, r.high) == (min(v), max(v))
        else:
            assert s.staging_id not in both


def test_municipalities(spark):
    """Golden matches: exact in both scripts, misspelt, OCR errors, no match, blank, unknown district, an override."""
    dim = spark.createDataFrame([(0, "10101001", "Phungling Municipality", "फुङलिङ नगरपालिका", "municipality", "Taplejung"), (1, "40402006", "Pokhara Metropolitan City", "पोखरा महानगरपालिका", "metropolitan", "Kaski"), (2, "30305007", "Kathmandu Metropolitan City", "काठमाडौं महानगरपालिका", "metropolitan", "Kathmandu")], "dim_idx int, federal_code string, name_en string, name_ne string, local_level_type string, district_en string")
    cases = {"Phungling Municipality": (None, "10101001", 100.0), "पोखरा महानगरपालिका": (None, "40402006", 100.0), "पोखरा महानगरपाललका": ("Kaski", "40402006", 100.0), "Phungling Municipalty": ("TAPLEJUNG ", "10101001", 97.67), "Atlantis Megalopolis": (None, None, None), "  ": (None, None, None), "Kathmandu Metropolitan City": ("Nowhere", "30305007", 100.0), "old name": ("Kaski", "40402006", 100.0)}
    names = spark.createDataFrame([(n, d) for n, (d, *_) in cases.items()], "name string, district string")
    over = spark.createDataFrame([("old name", "Pokhara Metropolitan City")], "name string, canonical string")
    got = {r.name: (r.federal_code, r.score and round(r.score, 2)) for r in J.municipalities(names, dim, overrides=over).collect()}
    assert got == {n: (code, score) for n, (_, code, score) in cases.items()}


def test_transfer_sheet(spark):
    """The golden sheet: three places, eight grants, zeros kept, the total skipped."""
    kinds = ["Equalization Minimum", "Equalization Formula", "Equalization Performance", "Conditional Current", "Conditional Capital", "Special Current", "Special Capital", "Matching"]
    places = [("Kathmandu", "Kathmandu Metropolitan City", 100_000), ("Kaski", "Pokhara Metropolitan City", 0), ("Taplejung", "Phungling Municipality", 7)]
    rows = [["Budget of local levels"], ["S.N.", "District", "Local Level Name", *kinds], *([str(i), d, n, *(str(v + k) for k in range(8))] for i, (d, n, v) in enumerate(places)), ["", "", "Total", *(["9"] * 8)]]
    cells = spark.createDataFrame([("x", i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r)] + [("y", 0, 0, "no header")], "doc_id string, row_idx int, col_idx int, text string")
    dim = spark.createDataFrame([(i, f"{i:08d}", n, "नगर", "municipality", d) for i, (d, n, _) in enumerate(places)], "dim_idx int, federal_code string, name_en string, name_ne string, local_level_type string, district_en string")
    out = P.transfers(cells, dim, 2082)
    got = out.rows.collect()
    assert len(got) == 24 and {r.fiscal_year_bs for r in got} == {"2082/83"}
    assert {(r.name_en, int(r.amount_npr)) for r in got if r.grant_type == "equalization_minimum"} == {(n, v) for _, n, v in places}
    assert {(r.doc_id, r.status) for r in out.runs.collect()} == {("x", "success"), ("y", "failure")} and P.persisted(out).count() == 24
    assert [r.error_class for r in out.errors.collect()] == ["ColumnMissing"]


def test_banking_sheet(spark):
    value = {"system_total": 1000.5, "commercial": 700.5, "development": 200.5, "finance": 100.5}
    cells = [("d", "C5", 4 + i, j, t) for i, (label, _) in enumerate(P.BANK_LABELS) for j, t in [(2, f"  {label} "), *((c, str(value[k])) for k, c in P.BANK_CLASSES)]]
    out = P.banking(spark.createDataFrame(cells + [("e", "C6", 0, 0, "x")], "doc_id string, sheet string, row_idx int, col_idx int, text string"), 2082, 2, "Bhadra")
    got = out.rows.collect()
    assert len(got) == 36 and {(r.bank_class, r.value) for r in got if r.indicator.endswith("capital-fund")} == set(value.items()) and "bfi-c5-system-total-deposits-fixed" in {r.indicator for r in got}
    assert {(r.doc_id, r.error_class) for r in out.errors.collect()} == {("e", "PageLayoutChanged")}


def test_sinks_check_and_count(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    with pytest.raises(ValueError, match="unique"):
        T.checked_append(a, str(tmp_path / "t"), Q.violations(a, ["k"]))
    T.checked_append(a.filter("k = 2"), str(tmp_path / "t"), Q.violations(a.filter("k = 2"), ["k"], check=F.col("k") > 0))
    T.append(a.filter("k = 2"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    with pytest.raises(ValueError, match="refusing"):
        T.seeded(a, a, ["k"], ["v"], 753)


def test_two_mode_csv_and_links(spark, tmp_path):
    (tmp_path / "a.csv").write_text(',,,"Table 1"\n1\n2\n3\n4\nprov,dist,x\n1,2,"a,b"\n3\n')
    (tmp_path / "b.csv").write_bytes('\ufeffprov,dist\r\n1,2\r\n"a ""quoted"" one","two\r\nlines"\r\n"",x,"y,z"\r\n'.encode())
    rows = {(r.path[-5:], r.row_idx): (r.mode, r.cells) for r in delimited.two_mode_csv(spark, str(tmp_path / "*.csv")).collect()}
    assert rows["a.csv", 0] == ("A", ["prov", "dist", "x"]) and rows["a.csv", 1][1] == ["1", "2", "a,b"] and rows["a.csv", 2][1] == ["3", "", ""]
    assert [rows["b.csv", i] for i in range(4)] == [("B", ["prov", "dist"]), ("B", ["1", "2"]), ("B", ['a "quoted" one', "two\r\nlines"]), ("B", ["", "x", "y,z"])]
    html_ = '<a href="/x/1.pdf?v=1">One</a><a href="2.PDF"><b>Two</b> &amp; more</a><a href="/x/1.pdf?v=1">again</a><a href="/p.html">no</a>'
    got = [(r.url, r.text) for r in html.links(spark.createDataFrame([(1, "http://h.org/c/d?e", html_)], "page_id int, url string, html string"), "url", "html").orderBy("pos").collect()]
    item = spark.createDataFrame([("<ul><li>2024-10-12 <a href='a.pdf'>A</a></li><li>x <a href='b.pdf'>B</a></li></ul>", "b.pdf")], "h string, u string")
    assert item.select(readers.container_text(F.col("h"), F.col("u")).alias("x")).first().x == "x B"
    assert got == [("http://h.org/x/1.pdf?v=1", "One"), ("http://h.org/c/2.PDF", "Two & more")]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, t in (("a", "one"), ("b", "one"), ("c", "two")):
        (tmp_path / "in" / n).write_text(t)
    f = incremental.arriving_files(spark, str(tmp_path / "in"))
    for _ in range(2):
        incremental.archive_new(f, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev" / "1.json").write_text("\n".join(json.dumps({"event_type": t, "occurred_at": f"2024-01-01T0{h}:10:00"}) for t, h in (("archived", 1), ("archived", 1), ("error", 2))))
    e = spark.readStream.schema("event_type string, occurred_at timestamp").json(str(tmp_path / "ev"))
    q = incremental.event_counters(e).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.event_type, r.n) for r in spark.table("counted").collect()} == {("archived", 2), ("error", 1)}
