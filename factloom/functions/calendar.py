"""Fiscal years, reporting periods and the two calendars (CAL-*).

Month lengths of the Bikram Sambat calendar are irregular; they come as a parameter table (bs_year, cal_month, days),
checked by ``month_faults`` and never extrapolated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Months in fiscal order, Nepali names, aliases, Gregorian month of the middle of each.
MONTHS = ("Shrawan", "Bhadra", "Ashwin", "Kartik", "Mangsir", "Poush", "Magh", "Falgun", "Chait", "Baisakh", "Jestha", "Ashadh")
MONTHS_NE = ("साउन", "भदौ", "असोज", "कात्तिक", "मंसिर", "पुस", "माघ", "फागुन", "चैत", "बैशाख", "जेठ", "असार")
ALIASES = {
    "shrawan": "Shrawan", "saun": "Shrawan", "sawan": "Shrawan", "bhadra": "Bhadra", "bhadau": "Bhadra", "ashwin": "Ashwin", "asoj": "Ashwin", "aswin": "Ashwin",
    "kartik": "Kartik", "kartika": "Kartik", "mangsir": "Mangsir", "marg": "Mangsir", "poush": "Poush", "push": "Poush", "magh": "Magh",
    "falgun": "Falgun", "phagun": "Falgun", "fagun": "Falgun", "chait": "Chait", "chaitra": "Chait", "baisakh": "Baisakh", "vaishakha": "Baisakh", "baishakh": "Baisakh",
    "jestha": "Jestha", "jeth": "Jestha", "ashadh": "Ashadh", "asar": "Ashadh", "asadh": "Ashadh",
}
AD_MONTH = (7, 8, 9, 10, 11, 12, 1, 2, 3, 4, 5, 6)
OFFSET = 57


def fiscal_start(year: Column, fy_month: Column) -> Column:
    """CAL-3: months 1 to 9 of the fiscal order start in the year itself, 10 to 12 in the one before."""
    return F.when(fy_month <= 9, year).otherwise(year - 1)


def label_bs(start: Column) -> Column:
    """CAL-5: 2082/83."""
    return F.concat(start.cast("string"), F.lit("/"), F.lpad(F.pmod(start + 1, F.lit(100)).cast("string"), 2, "0"))


def label_ad(start: Column) -> Column:
    """CAL-5: the Gregorian label of a fiscal year."""
    return label_bs(start - OFFSET)


def month_name(raw: Column) -> Column:
    """CAL-8: canonical month of an alias, null if unknown."""
    key = F.regexp_replace(F.lower(F.trim(raw)), r"[.\s-]", "")
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv)), key)


def month_index(name: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, MONTHS)), name)
    return F.when(at > 0, at.cast("int"))


def mid_month(fy_month: Column, start_year: Column) -> Column:
    """CAL-9: the 15th of the Gregorian month around the middle; ``start_year`` is the year in which the fiscal year starts."""
    month = F.element_at(F.array(*map(F.lit, AD_MONTH)), fy_month)
    return F.make_date(F.when(month >= 7, start_year - OFFSET).otherwise(start_year - OFFSET + 1), month, F.lit(15))


def nine_months(start_year: Column) -> Column:
    """CAL-10: placeholder span of the first nine months."""
    return F.struct(mid_month(F.lit(1), start_year).alias("start"), mid_month(F.lit(9), start_year).alias("end"))


def fiscal_token(label: Column) -> Column:
    """Start year of the first ``2082/83`` or ``2082/2083`` in a label, if the years follow one another."""
    p = r"([0-9]{4})\s*/\s*([0-9]{2,4})"
    start, end = F.regexp_extract(label, p, 1).try_cast("int"), F.regexp_extract(label, p, 2)
    full = F.when(F.length(end) == 2, F.floor(start / 100) * 100 + end.try_cast("int")).otherwise(end.try_cast("int"))
    return F.when(full == start + 1, start)


def parse_period(label: Column) -> Column:
    """CAL-7: struct(type, fy_start, ordinal, reason); nine months, then quarter, month, fiscal year."""
    text = F.regexp_replace(F.trim(label), r"\s+", " ")
    low, fy = F.lower(text), fiscal_token(text)
    quarter = F.regexp_extract(low, r"\bq([1-4])\b", 1)
    month, year = F.regexp_extract(text, r"^(?:(?i:mid)-)?([A-Za-z]+) ([0-9]{4})$", 1), F.regexp_extract(text, r"([0-9]{4})$", 1).try_cast("int")
    idx = month_index(month_name(month))
    out = lambda kind, start, ordinal, reason: F.struct(kind.alias("type"), start.cast("int").alias("fy_start"), ordinal.cast("int").alias("ordinal"), reason.alias("reason"))
    none, text_none = F.lit(None).cast("int"), F.lit(None).cast("string")
    fail = lambda why: out(text_none, none, none, F.lit(why))
    ok = lambda kind, start, ordinal: out(F.lit(kind), start, ordinal, text_none)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", fail("empty input"))
        .when(low.rlike(r"^nine[\s-]?months?\b|\b9m\b"), F.when(fy.isNotNull(), ok("nine_months_cumulative", fy, none)).otherwise(fail("no FY token")))
        .when(quarter != "", F.when(fy.isNotNull(), ok("quarterly", fy, quarter.try_cast("int"))).otherwise(fail("no FY token")))
        .when((month != "") & idx.isNotNull(), ok("monthly", fiscal_start(year, idx), idx))
        .when((month != "") & low.startswith("mid-"), fail("unknown month or year"))
        .when(fy.isNotNull(), ok("annual", fy, none))
        .otherwise(fail("unrecognized reporting-period label"))
    )


def day_dimension(months: DataFrame, first_day) -> DataFrame:
    """CAL-1: every day (ad_date, bs_year, fy_month, day, fy_start) of a table of month lengths; ``first_day`` is the Gregorian date of its first."""
    w = Window.orderBy("bs_year", "cal_month").rowsBetween(Window.unboundedPreceding, -1)
    start = F.date_add(F.lit(first_day).cast("date"), F.coalesce(F.sum("days").over(w), F.lit(0)).cast("int"))
    fy_month = F.pmod(F.col("cal_month") + 8, F.lit(12)) + 1
    d = months.select("bs_year", "cal_month", "days", start.alias("start")).withColumn("day", F.explode(F.sequence(F.lit(1), F.col("days"))))
    return d.select(F.date_add("start", F.col("day") - 1).alias("ad_date"), "bs_year", fy_month.cast("int").alias("fy_month"), "day", fiscal_start(F.col("bs_year"), fy_month).alias("fy_start"))


def month_faults(months: DataFrame) -> DataFrame:
    """Years of a month table that can't be right: not twelve months, or not 365 or 366 days."""
    return months.groupBy("bs_year").agg(F.count(F.lit(1)).alias("months"), F.sum("days").alias("days")).filter("months <> 12 or days not in (365, 366)")


def bs_to_ad(months: DataFrame, dates: DataFrame, first_day) -> DataFrame:
    """CAL-1, CAL-2: ``dates`` (bs_year, fy_month, day) with ad_date, from a table of month lengths; null outside it or beyond a month's end."""
    starts = day_dimension(months, first_day).groupBy("bs_year", "fy_month").agg(F.min("ad_date").alias("_start"), F.max("day").alias("_days"))
    j = dates.join(F.broadcast(starts), ["bs_year", "fy_month"], "left")
    return j.withColumn("ad_date", F.when(F.col("day").between(1, F.col("_days")), F.date_add("_start", F.col("day") - 1))).drop("_start", "_days")


def ad_to_bs(days: DataFrame, dates: DataFrame, ad: str = "ad_date") -> DataFrame:
    """CAL-1, CAL-4: ``dates`` with bs_year, fy_month, day and the start of the fiscal year; null outside the day dimension."""
    d = days.select(F.col("ad_date").alias(ad), "bs_year", "fy_month", "day", "fy_start")
    return dates.join(F.broadcast(d), ad, "left")


def current_fiscal_year(days: DataFrame, now) -> DataFrame:
    """CAL-4: (fy_start, label) of the fiscal year of a given day; the clock is a parameter."""
    return days.filter(F.col("ad_date") == F.lit(now).cast("date")).select("fy_start", label_bs(F.col("fy_start")).alias("label"))


def ordinal_fault(kind: Column, ordinal: Column) -> Column:
    """CAL-6: why a period has no bounds, else null."""
    most = F.when(kind.isin("monthly", "year_to_date"), 12).when(kind == "quarterly", 4)
    return (
        F.when(kind.isin("daily", "seasonal"), F.concat(F.lit("type: "), kind, F.lit(" has no bounds by fiscal year")))
        .when(most.isNotNull() & ~F.coalesce(ordinal.between(1, most), F.lit(False)), F.concat(F.lit("ordinal: "), kind, F.lit(" requires 1.."), most.cast("string")))
        .when(~F.coalesce(kind.isin("monthly", "quarterly", "annual", "nine_months_cumulative", "year_to_date"), F.lit(False)), "type: unknown")
    )


def period_bounds(periods: DataFrame, days: DataFrame) -> DataFrame:
    """CAL-6: Gregorian start and end of periods (type, fy_start, ordinal), their label, or the reason why there are none."""
    t, o = F.col("type"), F.col("ordinal")
    fault = ordinal_fault(t, o)
    first = F.when(t == "monthly", o).when(t == "quarterly", o * 3 - 2).otherwise(1)
    last = F.when(t == "monthly", o).when(t == "quarterly", o * 3).when(t == "nine_months_cumulative", 9).when(t == "year_to_date", o).otherwise(12)
    spans = days.groupBy("fy_start", "fy_month").agg(F.min("ad_date").alias("a"), F.max("ad_date").alias("z"))
    p = periods.withColumn("reason", fault).withColumn("_first", F.when(fault.isNull(), first)).withColumn("_last", F.when(fault.isNull(), last))
    a = spans.select(F.col("fy_start"), F.col("fy_month").alias("_first"), F.col("a").alias("ad_start"))
    z = spans.select(F.col("fy_start"), F.col("fy_month").alias("_last"), F.col("z").alias("ad_end"))
    return p.join(F.broadcast(a), ["fy_start", "_first"], "left").join(F.broadcast(z), ["fy_start", "_last"], "left").withColumn("label", F.when(fault.isNull(), label_bs_period(t, F.col("fy_start"), o))).drop("_first", "_last")


def _month(names, ordinal: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, names)), F.coalesce(ordinal, F.lit(1)))


def _month_year(fy_start: Column, ordinal: Column) -> Column:
    return F.when(ordinal <= 9, fy_start).otherwise(fy_start + 1).cast("string")


def label_bs_period(kind: Column, fy_start: Column, ordinal: Column) -> Column:
    """CAL-6: the label of a period's bounds."""
    fy = F.concat(F.lit("FY "), label_bs(fy_start))
    return (
        F.when(kind == "monthly", F.concat(_month(MONTHS, ordinal), F.lit(" "), _month_year(fy_start, ordinal)))
        .when(kind == "quarterly", F.concat(F.lit("Q"), ordinal.cast("string"), F.lit(" "), fy))
        .when(kind == "nine_months_cumulative", F.concat(fy, F.lit(" 9M")))
        .when(kind == "year_to_date", F.concat(fy, F.lit(" YTD "), _month(MONTHS, ordinal)))
        .otherwise(fy)
    )


def label_en(kind: Column, fy_start: Column, ordinal: Column) -> Column:
    """CAL-11: English display label."""
    own = label_bs_period(kind, fy_start, ordinal)
    return F.when(kind == "nine_months_cumulative", F.concat(own, F.lit(" (Shrawan–Chait)"))).otherwise(own)


def label_ne(kind: Column, fy_start: Column, ordinal: Column) -> Column:
    """CAL-11: Nepali display label."""
    fy = F.concat(F.lit("आ.व. "), label_bs(fy_start))
    return F.when(kind == "nine_months_cumulative", F.concat(fy, F.lit(" ९M (साउन–चैत)"))).when(kind == "monthly", F.concat(_month(MONTHS_NE, ordinal), F.lit(" "), _month_year(fy_start, ordinal))).otherwise(fy)


def chart_axis(kind: Column, fy_start: Column, ordinal: Column) -> Column:
    """CAL-11: Chait '82 for a month, else the fiscal year."""
    return F.when(kind == "monthly", F.concat(_month(MONTHS, ordinal), F.lit(" '"), F.right(_month_year(fy_start, ordinal), F.lit(2)))).otherwise(F.concat(F.lit("FY "), label_bs(fy_start)))


def table_header(kind: Column, fy_start: Column, ordinal: Column) -> Column:
    """CAL-11: the fiscal year, with the name of a month."""
    return F.concat_ws(" ", F.lit("FY"), label_bs(fy_start), F.when(kind == "monthly", _month(MONTHS, ordinal)))


def ledger_line(kind: Column, fy_start: Column, ordinal: Column) -> Column:
    """CAL-11, LED-3."""
    return F.concat(F.lit("Period: "), label_en(kind, fy_start, ordinal), F.lit("."))


def ledger_entry(published: Column, bs_year: Column, fy_month: Column, day: Column, kind: Column, fy_start: Column, ordinal: Column) -> Column:
    """LED-3: when a value was published in both calendars, then its period."""
    when = F.concat(F.lit("Published: "), _month(MONTHS, fy_month), F.lit(" "), day.cast("string"), F.lit(", "), bs_year.cast("string"), F.lit(" BS ("), F.date_format(published, "MMM d, yyyy"), F.lit(" AD). "))
    return F.concat(when, ledger_line(kind, fy_start, ordinal))


def claim_label(kind: Column, label: Column) -> Column:
    """LED-1: the period as a claim names it; a label that can't be parsed stays as it is, a month is said by its middle."""
    p = parse_period(label)
    shown = F.when(kind == "monthly", label_bs_period(p["type"], p["fy_start"], p["ordinal"])).otherwise(label_en(p["type"], p["fy_start"], p["ordinal"]))
    shown = F.when(p["type"].isNotNull(), shown).otherwise(label)
    return F.when(kind == "monthly", F.concat(F.lit("Mid-"), shown)).otherwise(shown)
