"""Queries of validation and promotion over daily event totals, with their SQL."""

import datetime

from pyspark.sql import functions as F

from factloom.functions import calendar as C
from factloom.operators import quality as Q, tables as T
from factloom.operators.shared import written
from factloom.plans.registry import query

MONTH_NAMES = ",".join(C.MONTHS)
#: The k-th day of the events stands for the k-th month from Shrawan 2070; months here have 30 days, Chait 35. All periods have a parseable label and Gregorian bounds.
START = "DATE '2013-07-16'"
_BOUND = "CAST(FLOOR(k / 12.0) AS INT) * 365 + (k % 12) * 30 + CASE WHEN k % 12 > 8 THEN 5 ELSE 0 END"
#: Staged and approved rows from the events table; this text runs on Spark and in the oracle alike.
INPUT = f"""
days AS (SELECT event_type AS indicator, CAST(DAYOFYEAR(ts) AS INT) - 1 AS k, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM events GROUP BY event_type, CAST(DAYOFYEAR(ts) AS INT) - 1),
daily AS (SELECT indicator, k, v, concat(split_part('{MONTH_NAMES}', ',', k % 12 + 1), concat(' ', CAST(2070 + CAST(FLOOR(k / 12.0) AS INT) + CASE WHEN k % 12 > 8 THEN 1 ELSE 0 END AS VARCHAR(4)))) AS label, {START} + CAST({_BOUND} AS INT) AS ad_start,
  {START} + CAST({_BOUND} + CASE WHEN k % 12 = 8 THEN 34 ELSE 29 END AS INT) AS ad_end FROM days),
approved AS (SELECT indicator, 'monthly' AS period_type, label AS period_bs, concat('d', CAST(k AS VARCHAR(4))) AS document_id, v AS value, CASE WHEN k = 12 THEN -1 ELSE 0 END AS revision, ad_end
  FROM daily WHERE k < 20),
base AS (SELECT indicator, label AS period_bs, v, k, ad_start, ad_end FROM daily),
staging AS (
  SELECT concat('n', concat(indicator, CAST(k AS VARCHAR(4)))) AS staging_id, 'r1' AS run_id, 's1' AS document_id, indicator, CASE WHEN k = 26 THEN 'bogus' ELSE 'monthly' END AS period_type, CASE WHEN k = 21 THEN 'soon' ELSE period_bs END AS period_bs,
    CASE WHEN k = 22 THEN CAST('inf' AS DOUBLE) WHEN k = 24 THEN v * 10 ELSE v END AS value, CASE WHEN indicator = 'click' AND k > 27 THEN 'clicks' ELSE 'count' END AS unit, CASE WHEN k = 25 THEN ad_start + 3 ELSE ad_start END AS ad_start, ad_end, CASE WHEN k = 23 THEN 'Z' ELSE 'A' END AS grade, 1 AS inserted_at
  FROM base WHERE k >= 20
  UNION ALL SELECT concat('a', concat(indicator, CAST(k AS VARCHAR(4)))), 'r1', concat('d', CAST(k AS VARCHAR(4))), indicator, 'monthly', period_bs, v + 1, 'count', ad_start, ad_end, 'A', 2 FROM base WHERE k BETWEEN 9 AND 11
  UNION ALL SELECT concat('b', concat(indicator, CAST(k AS VARCHAR(4)))), 'r2', 's1', indicator, 'monthly', period_bs, CASE WHEN k = 12 THEN v + 2 ELSE v END, 'count', ad_start, ad_end, 'A', 3 FROM base WHERE k BETWEEN 12 AND 13
  UNION ALL SELECT concat('c', concat(indicator, CAST(k AS VARCHAR(4)))), 'r2', 's1', indicator, 'monthly', period_bs, v + 5, 'count', ad_start, ad_end, 'A', 4 FROM base WHERE k BETWEEN 14 AND 15
  UNION ALL SELECT concat('e', concat(indicator, CAST(k AS VARCHAR(4)))), 'r2', 's1', indicator, 'monthly', period_bs, v + 7, 'count', ad_start, ad_end, 'A', 5 FROM base WHERE k = 15
  UNION ALL SELECT concat('f', concat(indicator, CAST(k AS VARCHAR(4)))), 'r3', 's3', indicator, 'monthly', period_bs, CASE WHEN k = 14 THEN v + 5 ELSE v + 9 END, 'count', ad_start, ad_end, 'A', 6 FROM base WHERE k IN (14, 15, 27)
  UNION ALL SELECT concat('g', concat(indicator, CAST(k AS VARCHAR(4)))), 'r3', 's4', indicator, 'monthly', period_bs, v + 1, 'count', ad_start, ad_end, 'A', 7 FROM base WHERE k = 18),
indicators AS (SELECT DISTINCT indicator FROM daily WHERE indicator <> 'error'),
docs AS (SELECT DISTINCT document_id, CASE WHEN document_id = 's4' THEN '' ELSE 'h' END AS hash FROM (SELECT document_id FROM approved UNION ALL SELECT document_id FROM staging) x)
"""
DAYS = 150
#: Row by row, as the rules say: every check that doesn't depend on other rows, then the rows of a period in their order against the value approved last.
JUDGED = f"""WITH RECURSIVE {INPUT},
st AS (SELECT s.*, i.indicator IS NOT NULL AS known, NOT isfinite(s.value) OR s.period_type = 'bogus' OR s.grade = 'Z' AS bad_schema, s.period_bs = 'soon' AS bad_period, s.unit <> 'count' AS bad_unit, d.hash = '' AS bad_source,
    ABS(date_diff('day', CAST(b.ad_start AS DATE), CAST(s.ad_start AS DATE))) > 2 AS off
  FROM staging s LEFT JOIN indicators i ON i.indicator = s.indicator LEFT JOIN docs d ON d.document_id = s.document_id LEFT JOIN daily b ON b.indicator = s.indicator AND b.label = s.period_bs),
nu AS (SELECT *, NOT known OR bad_schema OR bad_period OR bad_unit OR bad_source AS stopped, ROW_NUMBER() OVER (PARTITION BY indicator, period_type, period_bs ORDER BY inserted_at, staging_id) AS rn FROM st),
fl AS (SELECT indicator, period_type, period_bs, rn, staging_id, flag, CASE WHEN NOT stopped AND flag IS NULL THEN COALESCE(p_rev + 1, 0) END AS revision,
    CASE WHEN NOT stopped AND flag IS NULL THEN document_id ELSE p_doc END AS doc, CASE WHEN NOT stopped AND flag IS NULL THEN value ELSE p_value END AS val, CASE WHEN NOT stopped AND flag IS NULL THEN COALESCE(p_rev + 1, 0) ELSE p_rev END AS rev
  FROM (SELECT nu.*, p.document_id AS p_doc, p.value AS p_value, p.revision AS p_rev, CASE WHEN NOT known OR p.document_id IS NULL THEN NULL WHEN p.document_id = nu.document_id OR p.value = nu.value THEN 'DuplicateOfApproved' WHEN p.revision < 0 THEN 'RevisionMismatch' END AS flag
    FROM nu LEFT JOIN approved p ON p.indicator = nu.indicator AND p.period_type = nu.period_type AND p.period_bs = nu.period_bs WHERE rn = 1) x
  UNION ALL
  SELECT indicator, period_type, period_bs, rn, staging_id, flag, CASE WHEN NOT stopped AND flag IS NULL THEN COALESCE(p_rev + 1, 0) END,
    CASE WHEN NOT stopped AND flag IS NULL THEN document_id ELSE p_doc END, CASE WHEN NOT stopped AND flag IS NULL THEN value ELSE p_value END, CASE WHEN NOT stopped AND flag IS NULL THEN COALESCE(p_rev + 1, 0) ELSE p_rev END
  FROM (SELECT nu.*, p.doc AS p_doc, p.val AS p_value, p.rev AS p_rev, CASE WHEN NOT known OR p.doc IS NULL THEN NULL WHEN p.doc = nu.document_id OR p.val = nu.value THEN 'DuplicateOfApproved' WHEN p.rev < 0 THEN 'RevisionMismatch' END AS flag
    FROM nu JOIN fl p ON p.indicator = nu.indicator AND p.period_type = nu.period_type AND p.period_bs = nu.period_bs AND p.rn = nu.rn - 1) x),
al AS (SELECT nu.*, fl.flag, fl.revision FROM nu JOIN fl USING (staging_id)),
seen AS (SELECT s.staging_id, a.value FROM al s JOIN approved a ON a.indicator = s.indicator AND a.ad_end >= s.ad_end - {DAYS}
  UNION ALL SELECT s.staging_id, a.value FROM al s JOIN al a ON a.indicator = s.indicator AND a.revision IS NOT NULL AND (a.inserted_at, a.staging_id) < (s.inserted_at, s.staging_id) AND a.ad_end >= s.ad_end - {DAYS}),
tr AS (SELECT staging_id, COUNT(*) AS n, AVG(value) AS mean, STDDEV_POP(value) AS sd FROM seen GROUP BY staging_id),
judged AS (SELECT al.*, stopped OR flag IS NOT NULL AS blocked, COALESCE(known AND n >= 3 AND sd > 0 AND (isinf(value) OR ABS(value - mean) > 5 * sd), FALSE) AS odd, COALESCE(off, FALSE) AS moved FROM al LEFT JOIN tr USING (staging_id))
"""


def inputs(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    # The totals by day are read by every branch below, so they are computed once.
    totals, rest = INPUT.split(",\napproved AS", 1)
    written(spark.sql(f"WITH {totals} SELECT * FROM daily")).createOrReplaceTempView("daily")
    return {n: spark.sql(f"WITH approved AS{rest} SELECT * FROM {n}") for n in ("staging", "approved", "indicators", "docs")}


def calendar(spark):
    months = spark.createDataFrame([(y, m, 35 if m == 12 else 30) for y in range(2070, 2075) for m in range(1, 13)], "bs_year int, cal_month int, days int")
    return C.day_dimension(months, datetime.date(2013, 7, 16) - datetime.timedelta(days=90))


def judged(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return Q.validate(i["staging"], i["approved"], i["indicators"], i["docs"], units=("count",), days=DAYS, calendar=calendar(spark))


@query("pipe2_validation_summary", JUDGED + "SELECT run_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE NOT blocked) AS promoted, COUNT(*) FILTER (WHERE NOT blocked AND (odd OR moved)) AS with_warnings, COUNT(*) FILTER (WHERE blocked) AS blocked FROM judged GROUP BY run_id")
def summary(spark, sf_dir):
    return Q.summary(judged(spark, sf_dir))


@query("chk10_win2_decisions", JUDGED + "SELECT staging_id, CASE WHEN blocked THEN 'block' WHEN odd OR moved THEN 'warn' ELSE 'promote' END AS decision, revision FROM judged")
def decisions(spark, sf_dir):
    return judged(spark, sf_dir).select("staging_id", "decision", "revision")


FLAGS = """SELECT staging_id, 'block' AS kind, 'SchemaInvalid' AS flag_type FROM judged WHERE bad_schema UNION ALL SELECT staging_id, 'block', 'IndicatorUnknown' FROM judged WHERE NOT known UNION ALL SELECT staging_id, 'block', 'PeriodAmbiguous' FROM judged WHERE bad_period
UNION ALL SELECT staging_id, 'warn', 'PeriodAmbiguous' FROM judged WHERE moved UNION ALL SELECT staging_id, 'block', 'UnitUnrecognized' FROM judged WHERE bad_unit UNION ALL SELECT staging_id, 'warn', 'ValueOutOfPlausibleRange' FROM judged WHERE odd
UNION ALL SELECT staging_id, 'block', flag FROM judged WHERE flag IS NOT NULL UNION ALL SELECT staging_id, 'block', 'SourceHashCollision' FROM judged WHERE bad_source"""


@query("agg1_blocking_flags", JUDGED + f"SELECT staging_id, flag_type FROM ({FLAGS}) x WHERE kind = 'block'")
def blocking(spark, sf_dir):
    return Q.blocking_flags(judged(spark, sf_dir)).select("staging_id", "flag_type")


@query("snk14_flags", JUDGED + FLAGS)
def flags(spark, sf_dir):
    return Q.flags(judged(spark, sf_dir)).select("staging_id", "kind", "flag_type")


@query("jn3_agg4_trailing_stats", f"WITH {INPUT} SELECT s.staging_id, COUNT(*) AS n, ROUND(AVG(a.value) + 0.00001, 2) AS mean, ROUND(STDDEV_POP(a.value) + 0.00001, 2) AS sd FROM staging s JOIN approved a ON a.indicator = s.indicator AND a.ad_end >= s.ad_end - {DAYS} GROUP BY s.staging_id")
def trailing(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return Q.trailing_stats(i["staging"], i["approved"], DAYS).select("staging_id", "n", F.round(F.col("mean") + 0.00001, 2).alias("mean"), F.round(F.col("sd") + 0.00001, 2).alias("sd"))


@query("snk6_promote", JUDGED + "SELECT staging_id, revision FROM judged WHERE NOT blocked")
def promoted(spark, sf_dir):
    return T.promote(judged(spark, sf_dir), ["staging_id"])[0]


@query("win1_jn2_latest_revision", "SELECT o_custkey, MAX(o_orderkey) AS revision, MAX_BY(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def latest(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.col("o_orderkey").alias("revision"), F.col("o_orderstatus").alias("status"))
    return Q.latest_revision(o, ["o_custkey"])


@query("chk1_schema", """SELECT o_orderkey, CASE WHEN o_orderstatus = '' OR o_orderstatus IS NULL THEN 'status: missing or empty' WHEN o_orderpriority LIKE '4%' THEN 'priority: missing or empty' WHEN o_orderstatus NOT IN ('monthly', 'annual') AND o_orderstatus <> 'F' THEN 'period_type: unknown' END AS detail FROM orders""")
def schema(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), F.when(~F.col("o_orderpriority").startswith("4"), F.col("o_orderpriority")).alias("priority"), "o_totalprice", "o_orderdate", F.when(F.col("o_orderstatus") == "F", "monthly").otherwise("x").alias("pt")
    )
    return o.select("o_orderkey", Q.schema_outcome(["status", "priority"], F.col("o_totalprice"), ["o_orderdate"], F.col("pt"), F.lit("A"))["detail"].alias("detail"))


@query("chk3_period", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'warn' WHEN 2 THEN 'warn' END AS kind, CASE WHEN o_orderkey % 5 < 3 THEN 'PeriodAmbiguous' END AS flag FROM orders""")
def period(spark, sf_dir):
    """Labels of months (the stand-in calendar's), with bounds that agree within two days or not, and labels that can't be parsed."""
    k = F.pmod("o_orderkey", F.lit(5))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.when(k == 0, "Smarch 2071").otherwise("Kartik 2071").alias("label"))
    p = o.select("o_orderkey", C.parse_period(F.col("label")).alias("p")).select("o_orderkey", "p.type", "p.fy_start", "p.ordinal")
    j = C.period_bounds(p, calendar(spark))
    first, last = F.lit(datetime.date(2014, 10, 14)), F.lit(datetime.date(2014, 11, 12))
    own = Q.period_outcome(F.date_add(first, F.when(F.pmod("o_orderkey", F.lit(5)) == 1, -3).otherwise(2)), F.date_add(last, F.when(F.pmod("o_orderkey", F.lit(5)) == 2, 3).otherwise(-2)), F.col("ad_start"), F.col("ad_end"))
    return j.select("o_orderkey", own["kind"].alias("kind"), own["flag_type"].alias("flag"))


@query("chk9_violations", """SELECT 'unique' AS violation, COUNT(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1) UNION ALL SELECT 'not_null', COUNT(*) FROM lineitem WHERE l_shipdate IS NULL
UNION ALL SELECT 'check', COUNT(*) FROM lineitem WHERE NOT (l_discount <= 0.05) UNION ALL SELECT 'foreign_key', COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)""")
def violations(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    even = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return Q.violations(l, ["l_orderkey", "l_linenumber"], ["l_shipdate"], F.col("l_discount") <= 0.05, even, "l_orderkey")


@query("chk12_chk16_grades", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'B' WHEN p_size % 3 = 1 THEN 'B' ELSE 'C' END AS grade, CASE WHEN p_size * 2 >= 85 THEN 'high' WHEN p_size * 2 >= 70 THEN 'medium' ELSE 'none' END AS tier FROM part")
def grades(spark, sf_dir):
    g = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.pmod("p_size", F.lit(3)) + 1)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", Q.capped_grade(g, F.lit("B")).alias("grade"), Q.match_tier(F.col("p_size") * 2).alias("tier"))


@query("chk13_reviewed", "SELECT o_orderkey AS staging_id, CASE WHEN o_orderkey % 5 = 1 THEN 0.0 ELSE o_totalprice END AS value FROM orders WHERE o_orderkey % 5 <> 0")
def reviewed(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("staging_id"), F.col("o_totalprice").alias("value"))
    k = F.pmod("staging_id", F.lit(5))
    acts = o.filter(k < 2).select("staging_id", F.when(k == 0, "reject").otherwise("override").alias("action"), F.lit(0.0).alias("new_value"), F.lit("checked").alias("reason"))
    return Q.reviewed(o, acts)


@query("chk14_freshness", "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'Disputed' WHEN c_custkey % 7 = 0 THEN 'Preliminary' WHEN MAX(o_orderdate) < TIMESTAMP '2001-01-01' THEN 'Lagged' ELSE 'Fresh' END AS label FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def fresh(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("latest"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").join(o, "c_custkey")
    return c.select("c_custkey", Q.freshness(F.to_date("latest"), F.lit("2001-04-01").cast("date"), F.col("c_custkey") % 7 == 0, F.col("c_custkey") % 11 == 0).alias("label"))
