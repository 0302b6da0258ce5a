import datetime

import pytest
from pyspark.sql import functions as F

from factloom.functions import calendar as C, text as X
from factloom.operators.extract import extract


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize("a,b,score", [("Phungling Municipalty", "Phungling Municipality", 97.67), ("", "", 100.0), ("abc", "", 0.0), ("abc", "abc", 100.0)])
def test_fuzzy_ratio(spark, a, b, score):
    assert round(one(spark, X.fuzzy_ratio(F.col("a"), F.col("b")), a=a, b=b), 2) == score


@pytest.mark.parametrize("raw,text,arabic,deva", [("वडा १२", "वडा", "12", "१२"), ("Ward 7", "Ward", "7", "७"), ("no digits here", "no digits here", None, None)])
def test_both_numerals(spark, raw, text, arabic, deva):
    r = one(spark, X.both_numerals(F.col("a")), a=raw)
    assert (r.text, r.arabic, r.devanagari) == (text, arabic, deva)


def test_devanagari(spark):
    assert one(spark, X.normalize_devanagari(F.col("a")), a="नगरपाललका") == "नगरपालिका"
    assert one(spark, X.is_devanagari_dominant(F.col("a")), a="वडा १ x") is True
    assert one(spark, X.numeral_script(F.col("a")), a="1 २") == "mixed"


@pytest.mark.parametrize("v,shown", [("4.47", "4.47"), ("425000.5", "425,000.5"), ("3.125", "3.13"), ("0.125", "0.13"), ("1000", "1,000")])
def test_display_number(spark, v, shown):
    assert one(spark, X.display_number(F.col("a").cast("decimal(20,6)")), a=v) == shown


@pytest.mark.parametrize("raw,want", [("x 2024-10-12 y", datetime.date(2024, 10, 12)), ("2024-13-45 2024/1/2", None), ("2024/1/2", datetime.date(2024, 1, 2)), ("none", None)])
def test_listing_date(spark, raw, want):
    assert one(spark, X.listing_date(F.col("a")), a=raw) == want


@pytest.mark.parametrize(
    "label,kind,start,ordinal",
    [("Nine months 2082/83", "nine_months_cumulative", 2082, None), ("FY 2082/83 Q2", "quarterly", 2082, 2), ("Mid-Chait 2082", "monthly", 2082, 9), ("Baisakh 2083", "monthly", 2082, 10), ("FY 2082/83", "annual", 2082, None), ("2099/00", None, None, None), ("", None, None, None)],
)
def test_parse_period(spark, label, kind, start, ordinal):
    r = one(spark, C.parse_period(F.col("a")), a=label)
    assert (r.type, r.fy_start, r.ordinal) == (kind, start, ordinal)


def test_labels_and_placeholders(spark):
    assert one(spark, C.label_bs(F.col("a")), a=2082) == "2082/83" and one(spark, C.label_ad(F.col("a")), a=2082) == "2025/26" and one(spark, C.label_bs(F.col("a")), a=2099) == "2099/00"
    assert one(spark, C.nine_months(F.col("a")), a=2082).end == datetime.date(2026, 3, 15)


def test_day_dimension_is_contiguous(spark):
    months = spark.createDataFrame([(y, m, 30 + (m <= 5)) for y in (2080, 2081) for m in range(1, 13)], "bs_year int, cal_month int, days int")
    d = C.day_dimension(months, "2023-04-14")
    assert d.count() == 730 and d.select("ad_date").distinct().count() == 730
    assert C.month_faults(months).count() == 0
    first = d.orderBy("ad_date").first()
    assert (first.bs_year, first.fy_month, first.day, first.fy_start) == (2080, 10, 1, 2079)


def test_narrative(spark):
    """Golden figures of the seven phrases; noise between words, a misspelling, a mark of a provisional figure, a deficit, a phrase that is missing."""
    text = (
        "The y-o-y consumer price inflation in Nepal remained at 4.47 percent in mid-April. Remittance inflows increased 39.1 percent to Rs.1659.41 billion (7 P). The mercandise imports increased 13.8 percent to\nRs. 1490.50 billion. "
        "Total trade deficit increased 13.0 percent to Rs 1267.56 billion. Balance of Payments (BOP) remained at a deficit of Rs.731.16 billion. Gross foreign exchange reserves 9 P\nChart 3 (Mid-April) increased 30.5 percent to a level of Rs.3494.73 billion. "
        "It is sufficient for merchandise and services imports of 18.4 months."
    )
    rows = {r.slug: r for r in extract(spark.createDataFrame([(1, text), (2, None), (3, "nothing")], "doc_id int, text string")).collect() if r.doc_id == 1}
    want = {"cmefs-ncpi-yoy-overall": 4.47, "cmefs-remittance-inflow-ytd": 1659.41, "cmefs-merchandise-imports-ytd": 1490.5, "cmefs-trade-deficit-ytd": 1267.56, "cmefs-bop-surplus-ytd": 731.16, "cmefs-gross-forex-reserves": 3494.73, "cmefs-forex-reserves-months-of-import-cover": 18.4}
    assert {k: r.value for k, r in rows.items()} == want
    assert {k for k, r in rows.items() if r.grade == "B"} == {"cmefs-remittance-inflow-ytd"} and rows["cmefs-bop-surplus-ytd"].note == "BoP in deficit (negative)"
    lost = extract(spark.createDataFrame([(2, None), (3, "nothing")], "doc_id int, text string")).collect()
    assert len(lost) == 14 and {r.error for r in lost} == {"PageLayoutChanged"}


@pytest.mark.parametrize("a,b", [("abcbdab", "bdcaba"), ("नगरपालिका", "नगरपाललका"), ("x" * 62, "x" * 70), ("ab" * 40, "ba" * 45), ("a", "b"), ("same", "same")])
def test_lcs(spark, a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        last = 0
        for j, d in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if c == d else max(row[j], row[j + 1])
    assert one(spark, X.lcs_length(F.col("a"), F.col("b")), a=a, b=b) == row[-1] == one(spark, X.lcs_length(F.col("a"), F.col("b")), a=b, b=a)


def test_shapes(spark):
    assert [one(spark, X.is_source_id(F.col("a")), a=v) for v in ("nrb-bfi", "ab", "a_b_c", "-abc", "a1-")] == [True, False, False, False, True]
    assert [one(spark, X.is_iso_timestamp(F.col("a")), a=v) for v in ("2024-01-02T00:00:00Z", "2024-01-02", "2024/01/02T")] == [True, False, False]


@pytest.mark.parametrize(
    "kind,ordinal,label,axis,header",
    [("quarterly", 2, "Q2 FY 2082/83", "FY 2082/83", "FY 2082/83"), ("year_to_date", 8, "FY 2082/83 YTD Falgun", "FY 2082/83", "FY 2082/83"), ("nine_months_cumulative", None, "FY 2082/83 9M (Shrawan–Chait)", "FY 2082/83", "FY 2082/83"), ("monthly", 10, "Baisakh 2083", "Baisakh '83", "FY 2082/83 Baisakh"), ("annual", None, "FY 2082/83", "FY 2082/83", "FY 2082/83")],
)
def test_display(spark, kind, ordinal, label, axis, header):
    d = spark.range(1).select(F.lit(kind).alias("k"), F.lit(2082).alias("y"), F.lit(ordinal).cast("int").alias("o"))
    own = (F.col("k"), F.col("y"), F.col("o"))
    assert tuple(d.select(C.label_en(*own), C.chart_axis(*own), C.table_header(*own)).first()) == (label, axis, header)


def test_ledger_entry(spark):
    d = spark.range(1).select(F.lit(datetime.date(2026, 5, 8)).alias("p"), F.lit("nine_months_cumulative").alias("k"), F.lit(2082).alias("y"), F.lit(None).cast("int").alias("o"))
    got = d.select(C.ledger_entry(F.col("p"), F.lit(2083), F.lit(10), F.lit(25), F.col("k"), F.col("y"), F.col("o"))).first()[0]
    assert got == "Published: Baisakh 25, 2083 BS (May 8, 2026 AD). Period: FY 2082/83 9M (Shrawan–Chait)."


def test_claim_labels(spark):
    label = lambda kind, raw: one(spark, C.claim_label(F.lit(kind), F.col("a")), a=raw)
    assert label("monthly", "Chaitra 2082") == "Mid-Chait 2082" and label("monthly", "odd") == "Mid-odd" and label("annual", "odd") == "odd" and label("quarterly", "Q1 FY 2082/83") == "Q1 FY 2082/83"
