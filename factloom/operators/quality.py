"""Checks of staged values against approved ones, promotion, and revisions (JN-1..3, WIN-*, CHK-*, AGG-1, AGG-4).

All checks are one join plan. Rows that share a period are judged in the order (inserted_at, id): a row that nothing
blocks is promoted, and those after it, of its run or a later one, are held against it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.functions.calendar import parse_period, period_bounds
from factloom.functions.text import is_finite
from factloom.operators.shared import written

# The unit vocabulary (case-sensitive), period types and grades.
UNITS = ("NPR_billion", "NPR_million", "NPR_crore", "NPR_lakh", "NPR", "USD_million", "USD", "percent", "percent_yoy", "index_points", "months_of_imports", "count", "kg_per_capita", "metric_tonnes", "megawatt_hours", "gigawatt_hours")
PERIOD_TYPES = ("daily", "monthly", "quarterly", "annual", "nine_months_cumulative", "year_to_date", "seasonal")
GRADES = ("A", "B", "C", "D")
KEY = ("indicator", "period_type", "period_bs")
TRAILING_DAYS, PERIOD_SECONDS, Z_LIMIT = 720, 172_800, 5.0


def outcome(when: Column, kind: str, flag: Column | str, detail: Column | str) -> Column:
    """struct(kind, flag_type, detail) where ``when`` holds, else null."""
    return F.when(when, F.struct(F.lit(kind).alias("kind"), (F.lit(flag) if isinstance(flag, str) else flag).alias("flag_type"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail")))


def latest_revision(approved: DataFrame, key=KEY) -> DataFrame:
    """WIN-1: the row of the highest revision of every key."""
    last = approved.groupBy(*key).agg(F.max_by(F.struct(*approved.columns), "revision").alias("r"))
    return last.select("r.*")


def next_revision(prior: Column) -> Column:
    """WIN-2."""
    return F.coalesce(prior + 1, F.lit(0))


def first_wins(df: DataFrame, key, order) -> DataFrame:
    """WIN-3, WIN-4: ``rn`` numbers the rows of a key in order; 1 is the one that stays."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def schema_outcome(strings, value: Column, dates, period_type: Column, grade: Column) -> Column:
    """CHK-1: the first field that fails, in field order."""
    bad = [outcome(F.coalesce(F.col(c).cast("string") == "", F.lit(True)), "block", "SchemaInvalid", f"{c}: missing or empty") for c in strings]
    bad.append(outcome(~is_finite(value), "block", "SchemaInvalid", "value: not a finite number"))
    bad += [outcome(F.col(c).isNull(), "block", "SchemaInvalid", f"{c}: invalid date") for c in dates]
    bad.append(outcome(~F.coalesce(period_type.isin(*PERIOD_TYPES), F.lit(False)), "block", "SchemaInvalid", "period_type: unknown"))
    bad.append(outcome(~F.coalesce(grade.isin(*GRADES), F.lit(False)), "block", "SchemaInvalid", "grade: unknown"))
    return F.coalesce(*bad)


def period_outcome(start: Column, end: Column, parsed_start: Column, parsed_end: Column) -> Column:
    """CHK-3: unparseable blocks; a bound over two days off warns."""
    off = lambda a, b: F.abs(F.unix_timestamp(a.cast("timestamp")) - F.unix_timestamp(b.cast("timestamp"))) > PERIOD_SECONDS
    return F.coalesce(outcome(parsed_start.isNull() | parsed_end.isNull(), "block", "PeriodAmbiguous", "period can't be parsed"), outcome(off(start, parsed_start) | off(end, parsed_end), "warn", "PeriodAmbiguous", "bounds differ"))


def trailing_stats(staging: DataFrame, approved: DataFrame, days: int = TRAILING_DAYS) -> DataFrame:
    """JN-3, AGG-4: per staged row the count, mean, population deviation and range of approved values of its indicator that end within ``days`` before it or later.

    Approved values are added up by indicator and day first; the range join then meets a row a day, and sums about the
    indicator's mean keep the variance from cancelling.
    """
    a = approved.select("indicator", F.to_date("ad_end").alias("d"), F.col("value").cast("double").alias("v")).filter(is_finite(F.col("v")))
    mid = a.groupBy("indicator").agg(F.avg("v").alias("mid"))
    x = F.col("v") - F.col("mid")
    day = a.join(mid, "indicator").groupBy("indicator", "mid", "d").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.min("v").alias("low"), F.max("v").alias("high"))
    tail = Window.partitionBy("indicator").orderBy(F.desc("d"))
    suffix = day.select("indicator", "mid", "d", *(f(c).over(tail).alias(c) for f, c in ((F.sum, "n"), (F.sum, "s"), (F.sum, "q"), (F.min, "low"), (F.max, "high"))), F.lead("d").over(tail).alias("before"))
    s = staging.select("staging_id", "indicator", F.date_sub(F.to_date("ad_end"), days).alias("since"))
    met = s.join(suffix, "indicator").filter((F.col("d") >= F.col("since")) & (F.col("before").isNull() | (F.col("before") < F.col("since"))))
    var = F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))
    return met.select("staging_id", "n", (F.col("mid") + F.col("s") / F.col("n")).alias("mean"), F.sqrt(var).alias("sd"), "low", "high")


def bounded_stats(approved: DataFrame, days: int = TRAILING_DAYS) -> DataFrame:
    """WIN-5: the bounded variant of JN-3: per approved row the figures of its indicator's values of the ``days`` up to it."""
    at = F.unix_date(F.to_date("ad_end"))
    w = Window.partitionBy("indicator").orderBy(at).rangeBetween(-days, Window.currentRow)
    v = F.col("value").cast("double")
    return approved.withColumn("n", F.count(v).over(w)).withColumn("mean", F.avg(v).over(w)).withColumn("sd", F.stddev_pop(v).over(w))


def stats_in_run(staging: DataFrame, promoted: DataFrame, days: int = TRAILING_DAYS) -> DataFrame:
    """WIN-8 for CHK-5: the same figures over values promoted before the row, in the order (inserted_at, staging_id).

    Days are numbers; a promoted value belongs to one block of 1, 2, 4 ... days at each of 17 levels, and all days since a
    given one are a few blocks. So each row reads running sums in a few ordered blocks, and no two rows are paired.
    """
    day = F.datediff(F.to_date("ad_end"), F.lit("1900-01-01").cast("date"))
    order = ("inserted_at", "staging_id")
    mid = promoted.groupBy("indicator").agg(F.avg("value").alias("mid"))
    add = promoted.select("indicator", *order, F.lit(1).alias("add"), F.col("value").cast("double").alias("v"), day.alias("d")).withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(16)))).withColumn("block", F.expr("shiftright(d, l)")).drop("d")
    ask = staging.select("indicator", *order, F.lit(0).alias("add"), F.lit(None).cast("double").alias("v"), F.greatest(day - days, F.lit(1)).alias("since"))
    ask = ask.withColumn("b", F.explode(F.expr("filter(transform(sequence(0, 16), l -> struct(l as l, shiftright(since + shiftleft(1, l) - 1, l) as block)), x -> x.block % 2 = 1)"))).select("indicator", *order, "add", "v", "b.l", "b.block")
    before = Window.partitionBy("indicator", "l", "block").orderBy(*order, "add").rowsBetween(Window.unboundedPreceding, -1)
    x = F.col("v") - F.col("mid")
    run = add.unionByName(ask).join(mid, "indicator").select("staging_id", "add", "mid", F.count("v").over(before).alias("n"), F.sum(x).over(before).alias("s"), F.sum(x * x).over(before).alias("q"), F.min("v").over(before).alias("low"), F.max("v").over(before).alias("high"))
    g = run.filter("add = 0 and n > 0").groupBy("staging_id", "mid").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q")), F.min("low").alias("low"), F.max("high").alias("high"))
    var = F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))
    return g.select("staging_id", "n", (F.col("mid") + F.col("s") / F.col("n")).alias("mean"), F.sqrt(var).alias("sd"), "low", "high")


def both_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """Count, mean, deviation and range of two disjoint sets of values by staging_id."""
    g = a.unionByName(b).groupBy("staging_id").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * (F.col("sd") * F.col("sd"))).alias("inner"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("outer"), F.max(F.abs("mean")).alias("far"), F.count(F.lit(1)).alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    between = F.when(F.col("parts") > 1, F.greatest(F.col("outer") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0))).otherwise(0.0)
    return g.select("staging_id", "n", "mean", F.sqrt(F.col("inner") / F.col("n") + between).alias("sd"), "low", "high")


def plausibility_outcome(value: Column, n: Column, mean: Column, sd: Column, low: Column, high: Column) -> Column:
    """CHK-5: fewer than three values, or values that are all the same, pass."""
    odd = (F.coalesce(n, F.lit(0)) >= 3) & (low < high) & ~F.isnan(value) & (F.abs(value - mean) > Z_LIMIT * sd)
    return outcome(odd, "warn", "ValueOutOfPlausibleRange", "over five deviations from the trailing mean")


#: What a staged row holds by kind; each is checked where the table has it.
TEXT_FIELDS = ("staging_id", "run_id", "document_id", "indicator", "unit", "period_bs", "publication_bs", "fiscal_year_bs", "fiscal_year_ad")
DATE_FIELDS = ("ad_start", "ad_end", "publication_ad")


def judged_in_order(rows: DataFrame, prior: DataFrame) -> DataFrame:
    """WIN-8, CHK-6, CHK-7: (staging_id, flag_type, detail, revision) of rows judged period by period in the order (inserted_at, staging_id).

    A row that nothing blocks becomes the prior value of those after it, within its run and in later ones. The rows of
    one period, which are the documents that publish it, are folded as one array.
    """
    row = F.struct("inserted_at", "staging_id", "document_id", F.col("value").cast("double").alias("value"), "stopped", "known")
    own = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(row)).alias("rows")).join(prior, list(KEY), "left")
    text = lambda c: F.lit(c).cast("string")
    none = F.expr("cast(array() as array<struct<staging_id:string,flag_type:string,detail:string,revision:int>>)")
    start = F.struct(F.col("p_doc").cast("string").alias("doc"), F.col("p_value").cast("double").alias("value"), F.col("p_rev").cast("int").alias("rev"), none.alias("out"))

    def step(acc, r):
        there = acc["doc"].isNotNull() & r["known"]
        same, equal, bad = there & (acc["doc"] == r["document_id"]), there & (acc["value"] == r["value"]), there & (acc["rev"] < 0)
        flag = F.when(same | equal, text("DuplicateOfApproved")).when(bad, text("RevisionMismatch"))
        detail = F.when(same, text("already approved from this document")).when(equal, text("value is unchanged")).when(bad, text("prior revision is negative"))
        good = ~r["stopped"] & flag.isNull()
        revision = F.when(good, next_revision(acc["rev"]).cast("int"))
        one = F.struct(r["staging_id"].cast("string").alias("staging_id"), flag.alias("flag_type"), detail.alias("detail"), revision.alias("revision"))
        now = lambda a, b: F.when(good, b).otherwise(a)
        return F.struct(now(acc["doc"], r["document_id"].cast("string")).alias("doc"), now(acc["value"], r["value"]).alias("value"), now(acc["rev"], revision).alias("rev"), F.array_append(acc["out"], one).alias("out"))

    return own.select(F.explode(F.aggregate("rows", start, step)["out"]).alias("o")).select("o.*")


def validate(staging: DataFrame, approved: DataFrame, indicators: DataFrame, documents: DataFrame, units=UNITS, days: int = TRAILING_DAYS, calendar: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """PIPE-2: every staged row with ``outcomes`` (of all eight checks, in their order), ``decision`` (block, warn or promote) and the ``revision`` it gets.

    staging: staging_id, run_id, document_id, indicator, period_type, period_bs, value, unit, ad_end, inserted_at, and any
    other of ``TEXT_FIELDS`` and ``DATE_FIELDS``, and grade. Several runs are judged in the order of their rows.
    ``calendar`` is the day dimension that parsed periods are compared with; without it a period has to parse only.
    A row whose document is missing is blocked; with ``strict`` it fails the whole job.
    """
    if strict and (lost := staging.join(documents, "document_id", "left_anti").select("document_id").first()):
        raise LookupError(f"source document {lost[0]} not found")
    prior = latest_revision(approved).select(*KEY, F.col("document_id").alias("p_doc"), F.col("value").alias("p_value"), F.col("revision").alias("p_rev"))
    known, docs = indicators.select("indicator", F.lit(True).alias("known")).distinct(), documents.select("document_id", F.col("hash").alias("doc_hash"))
    j = staging.join(known, "indicator", "left").join(docs, "document_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    j = j.withColumn("_p", parse_period(F.col("period_bs")))
    unclear = outcome(F.col("_p.reason").isNotNull(), "block", "PeriodAmbiguous", F.concat(F.lit("did not parse: "), F.col("_p.reason")))
    if calendar is not None:
        bounds = period_bounds(j.select("_p.type", "_p.fy_start", "_p.ordinal").distinct(), calendar).select(F.struct("type", "fy_start", "ordinal").alias("_q"), F.col("ad_start").alias("_from"), F.col("ad_end").alias("_to"))
        j = j.join(bounds, F.struct("_p.type", "_p.fy_start", "_p.ordinal").eqNullSafe(F.col("_q")), "left")
        unclear = F.coalesce(unclear, period_outcome(F.col("ad_start") if "ad_start" in staging.columns else F.col("_from"), F.col("ad_end"), F.col("_from"), F.col("_to")))
    has_field = lambda names: [c for c in names if c in staging.columns]
    v = F.col("value").try_cast("double")
    j = (
        j.withColumn("_schema", schema_outcome(has_field(TEXT_FIELDS), F.col("value"), has_field(DATE_FIELDS), F.col("period_type"), F.col("grade") if "grade" in staging.columns else F.lit(GRADES[0])))
        .withColumn("_indicator", outcome(~F.col("known"), "block", "IndicatorUnknown", "indicator isn't registered"))
        .withColumn("_period", unclear)
        .withColumn("_unit", outcome(~F.coalesce(F.col("unit").isin(*units), F.lit(False)), "block", "UnitUnrecognized", "unit isn't in the vocabulary"))
        .withColumn("_source", outcome(F.coalesce(F.col("doc_hash") == "", F.lit(True)), "block", "SourceHashCollision", "document or its hash is missing"))
    )
    blocks = lambda c: F.coalesce(F.col(c)["kind"] == "block", F.lit(False))
    j = j.withColumn("stopped", blocks("_schema") | blocks("_indicator") | blocks("_period") | blocks("_unit") | blocks("_source")).withColumn("value", v)
    j = written(j)
    done = judged_in_order(j, prior)
    j = j.join(done.select(F.col("staging_id"), F.col("flag_type").alias("_flag"), F.col("detail").alias("_detail"), "revision"), "staging_id", "left")
    gone = j.filter("revision is not null").select("staging_id", "indicator", "inserted_at", "ad_end", "value")
    j = j.join(both_stats(trailing_stats(j, approved, days), stats_in_run(staging, gone, days)), "staging_id", "left")
    odd = F.when(F.col("known"), plausibility_outcome(F.col("value"), F.col("n"), F.col("mean"), F.col("sd"), F.col("low"), F.col("high")))
    again = outcome(F.col("_flag").isNotNull(), "block", F.col("_flag"), F.col("_detail"))
    j = j.withColumn("outcomes", F.array_compact(F.array("_schema", "_indicator", "_period", "_unit", odd, again, "_source")))
    has = lambda k: F.exists("outcomes", lambda o: o["kind"] == k)
    return j.select(*staging.columns, "outcomes", F.when(has("block"), "block").when(has("warn"), "warn").otherwise("promote").alias("decision"), "revision")


def flags(judged: DataFrame) -> DataFrame:
    """SNK-14, SET-5: one row for each outcome."""
    return judged.select("staging_id", "run_id", F.explode("outcomes").alias("o")).select("staging_id", "run_id", "o.kind", "o.flag_type", "o.detail")


def summary(judged: DataFrame) -> DataFrame:
    """AGG-1."""
    return judged.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("decision") != "block").alias("promoted"), F.count_if(F.col("decision") == "warn").alias("with_warnings"), F.count_if(F.col("decision") == "block").alias("blocked"))


def blocking_flags(judged: DataFrame) -> DataFrame:
    """AGG-1: the blocking flags of the summary, one row each (a list in the summary's row would have no bound)."""
    return flags(judged).filter("kind = 'block'")


def capped_grade(proposed: Column, cap: Column) -> Column:
    """CHK-12: a grade is lowered, never raised (A is best)."""
    return F.greatest(proposed, cap)


def match_tier(score: Column) -> Column:
    """CHK-16."""
    return F.when(score >= 85, "high").when(score >= 70, "medium").otherwise("none")


def freshness(latest: Column, now: Column, preliminary: Column, disputed: Column) -> Column:
    """CHK-14."""
    return F.when(disputed, "Disputed").when(preliminary, "Preliminary").when(F.months_between(now, latest) > 3, "Lagged").otherwise("Fresh")


def violations(df: DataFrame, unique=(), not_null=(), check: Column | None = None, parent: DataFrame | None = None, foreign: str | None = None) -> DataFrame:
    """CHK-9: (violation, n) before a write."""
    out = []
    if unique:
        out.append(df.groupBy(*unique).count().filter("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unique").alias("violation"), "n"))
    if not_null:
        out.append(df.filter(" or ".join(f"{c} is null" for c in not_null)).agg(F.count(F.lit(1)).alias("n")).select(F.lit("not_null").alias("violation"), "n"))
    if check is not None:
        out.append(df.filter(~F.coalesce(check, F.lit(True))).agg(F.count(F.lit(1)).alias("n")).select(F.lit("check").alias("violation"), "n"))
    if parent is not None:
        out.append(df.filter(F.col(foreign).isNotNull()).join(parent, foreign, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("foreign_key").alias("violation"), "n"))
    first, *rest = out
    for o in rest:
        first = first.unionByName(o)
    return first


def reviewed(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """CHK-13: reviewers' actions (staging_id, action, new_value, reason) applied by a join; rejected rows go."""
    j = rows.join(actions, "staging_id", "left")
    return j.filter("action is null or action <> 'reject'").withColumn("value", F.when(F.col("action").isin("fix", "override"), F.coalesce("new_value", "value")).otherwise(F.col("value"))).drop("action", "new_value", "reason")
