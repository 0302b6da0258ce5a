"""Queries of whole jobs (PIPE-*) over sheets, bulletins and registries made from all rows of a table, with their SQL."""

from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import pipelines as P, tables as T
from factloom.plans.registry import query
from factloom.plans.scalars import table

NAME = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"


def cells(df, *places):
    """doc_id, row_idx, col_idx, text from a table with doc_id and row_idx: one cell for each (column, text), null texts give none."""
    own = F.array(*(F.struct(F.lit(i).alias("col_idx"), c.cast("string").alias("text")) for i, c in places))
    return df.select("doc_id", "row_idx", F.explode(own).alias("x")).select("doc_id", "row_idx", "x.*").filter("text is not null")


def price_cells(spark, sf_dir):
    """A price table for each nation: its heads, a row for the whole, one for each of its suppliers, and rows of no group. Documents of nation 3 lack a column head."""
    s = table(spark, sf_dir, "supplier").withColumn("doc_id", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    docs = s.select("doc_id", "s_nationkey").distinct()
    k = F.col("s_suppkey")
    head = cells(docs.withColumn("row_idx", F.lit(1)), (3, F.lit("3 over 1")), (6, F.lit(" 6 over 4 ")), (9, F.when(F.col("s_nationkey") != 3, "9 over 7")))
    whole = cells(docs.withColumn("row_idx", F.lit(2)), (0, F.lit("")), (1, F.lit("Overall Index")), (3, F.lit("4.47")), (6, F.lit("4.1")), (9, F.lit("5")))
    noise = cells(docs.withColumn("row_idx", F.lit(3)), (0, F.lit("C.1")), (1, F.lit("No group")), (3, F.lit("1")), (6, F.lit("1")), (9, F.lit("1")))
    code = F.concat(F.lit("A."), (k % 90 + 1).cast("string"))
    body = cells(s.withColumn("row_idx", (k + 10).cast("int")), (0, code), (1, F.col("s_name")), (3, k), (6, F.when(k % 5 == 0, "..").otherwise((k * 2).cast("string"))), (9, F.when(k % 7 != 0, k * 3)))
    return head.unionByName(whole).unionByName(noise).unionByName(body)


_STEM = "'ncpi-a-' || (s_suppkey % 90 + 1) || '-' || " + NAME.format("s_name")


@query("pipe3_price_index", f"""WITH s AS (SELECT * FROM supplier WHERE s_nationkey <> 3)
SELECT 'n' || s_nationkey AS doc_id, {_STEM} || '-overall-yoy' AS indicator, CAST(s_suppkey AS DOUBLE) AS value FROM s UNION ALL SELECT 'n' || s_nationkey, {_STEM} || '-rural-yoy', s_suppkey * 2 FROM s WHERE s_suppkey % 5 <> 0 UNION ALL SELECT 'n' || s_nationkey, {_STEM} || '-urban-yoy', s_suppkey * 3 FROM s WHERE s_suppkey % 7 <> 0
UNION ALL SELECT DISTINCT 'n' || s_nationkey, 'ncpi-overall-index-' || g || '-yoy', v FROM s CROSS JOIN (VALUES ('overall', 4.47), ('rural', 4.1), ('urban', 5.0)) x(g, v)""")
def price_index(spark, sf_dir):
    return P.price_index(price_cells(spark, sf_dir), 2082).rows.select("doc_id", "indicator", "value")


@query("pipe3_rsh3_agg5_price_errors", """WITH e AS (SELECT 'n' || s_nationkey AS doc_id, CASE WHEN s_nationkey = 3 THEN NULL WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS bad, CASE WHEN s_nationkey = 3 THEN NULL WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END AS gone FROM supplier)
SELECT doc_id, CASE WHEN doc_id = 'n3' THEN 'failure' WHEN SUM(bad) + SUM(gone) > 0 THEN 'partial' ELSE 'success' END AS status, CASE WHEN doc_id = 'n3' THEN 0 ELSE SUM(bad) END AS unparseable, CASE WHEN doc_id = 'n3' THEN 1 ELSE SUM(gone) END AS missing FROM e GROUP BY doc_id""")
def price_errors(spark, sf_dir):
    out = P.price_index(price_cells(spark, sf_dir), 2082)
    e = out.errors.groupBy("doc_id").agg(F.count_if(F.col("error_class") == "ValueUnparseable").alias("unparseable"), F.count_if(F.col("error_class") == "ColumnMissing").alias("missing"))
    return out.runs.join(e, "doc_id", "left").na.fill(0, ["unparseable", "missing"]).select("doc_id", "status", "unparseable", "missing")


@query("pipe4_narrative", """SELECT o_orderkey AS doc_id, 'cmefs-bop-surplus-ytd' AS indicator, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS value, 'FY 2082/83 9M' AS period_bs, DATE '2025-07-15' AS ad_start, DATE '2026-03-15' AS ad_end FROM orders WHERE o_orderkey % 3 > 0
UNION ALL SELECT o_orderkey, 'cmefs-forex-reserves-months-of-import-cover', 18.4, 'FY 2082/83 9M', DATE '2026-03-15', DATE '2026-03-15' FROM orders WHERE o_orderkey % 3 = 2""")
def narrative(spark, sf_dir):
    k, v = F.pmod("o_orderkey", F.lit(3)), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    t = F.when(k > 0, F.concat(F.lit("Balance of Payments (BOP) remained at a surplus of Rs."), v, F.lit(" billion. "), F.when(k == 2, "Cover of merchandise and services imports of 18.4 months.").otherwise(""))).otherwise("a page of charts")
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), t.alias("text"))
    return P.persisted(P.narrative(docs, 2082)).select("doc_id", "indicator", "value", "period_bs", "ad_start", "ad_end")


def dimension(spark, sf_dir):
    d = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return d.select(F.col("n_nationkey").alias("dim_idx"), X.federal_code(F.col("n_nationkey").cast("string")).alias("federal_code"), F.col("n_name").alias("name_en"), F.lit("नगर").alias("name_ne"), F.lit("municipality").alias("local_level_type"), F.col("r_name").alias("district_en"))


def census(spark, sf_dir):
    """A census table for each market segment, a row for each of its customers: places by their nation's name, some unknown, some values blank."""
    d = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    c, k = table(spark, sf_dir, "customer").join(d, F.col("c_nationkey") == F.col("n_nationkey")), F.col("c_custkey")
    t = c.select(
        F.col("c_mktsegment").alias("doc_id"), k.cast("int").alias("row_idx"), F.lit("1").alias("prov"), F.lit("2").alias("dist"), F.when(k % 10 == 0, "0").otherwise("3").alias("gapa"),
        F.concat(F.lit('"'), F.upper("r_name"), F.lit('"')).alias("dname"), F.when(k % 11 == 0, "Nowhere at all").otherwise(F.concat(F.lit(" "), "n_name")).alias("gapaname"), k.cast("string").alias("a_Mud"), F.when(k % 3 == 0, "..").otherwise("7").alias("rowtotal"),
    )
    return P.census(t, "Hhld05_Floor", "household", "count", ["a_Mud", "rowtotal"], dimension(spark, sf_dir))


_PLACES = "SELECT c_mktsegment AS doc_id, c_custkey AS k, lpad(CAST(c_nationkey AS VARCHAR), 8, '0') AS code FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 11 <> 0"


@query("pipe5_census", f"""WITH p AS ({_PLACES}) SELECT doc_id, code AS federal_code, 'hhld05-floor-a-mud' AS indicator, CAST(MIN(k) AS DOUBLE) AS value FROM p GROUP BY 1, 2 UNION ALL SELECT doc_id, code, 'hhld05-floor-rowtotal', 7 FROM p WHERE k % 3 <> 0 GROUP BY 1, 2""")
def census_rows(spark, sf_dir):
    return P.persisted(census(spark, sf_dir)).select("doc_id", "federal_code", "indicator", "value")


@query("pipe5_jn6_census_errors", f"""WITH p AS ({_PLACES}), g AS (SELECT doc_id, code, COUNT(*) AS n, COUNT(*) FILTER (WHERE k % 3 <> 0) AS m, COUNT(*) FILTER (WHERE k % 3 = 0) AS blank FROM p GROUP BY 1, 2)
SELECT doc_id, 'Other' AS error_class, SUM(n - 1 + GREATEST(m - 1, 0)) AS n FROM g GROUP BY doc_id HAVING SUM(n - 1 + GREATEST(m - 1, 0)) > 0 UNION ALL SELECT doc_id, 'ValueUnparseable', SUM(blank) FROM g GROUP BY doc_id HAVING SUM(blank) > 0
UNION ALL SELECT c_mktsegment, 'MunicipalityUnresolved', COUNT(*) FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 10 <> 0 GROUP BY 1""")
def census_errors(spark, sf_dir):
    return T.counts_by(census(spark, sf_dir).errors, "doc_id", "error_class")


def transfers(spark, sf_dir):
    """A sheet for each nation with a row for each of its suppliers, whose names are the dimension's; some names unknown, some amounts blank. Nation 4's sheet has no header."""
    s = table(spark, sf_dir, "supplier").withColumn("doc_id", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    k = F.col("s_suppkey")
    name = F.when(k % 10 == 9, "Grand Total").when(k % 10 == 8, "zzzz").otherwise(F.col("s_name"))
    body = cells(s.withColumn("row_idx", (k + 2).cast("int")), (0, k), (1, F.col("doc_id")), (2, name), (3, F.format_number("s_acctbal", 2)), (4, F.when(k % 3 == 0, "-").otherwise(k.cast("string"))))
    docs = s.select("doc_id").distinct()
    word = lambda w: F.when(F.col("doc_id") != "n4", w).otherwise("?")
    head = cells(docs.withColumn("row_idx", F.lit(1)), (0, F.lit("S.N.")), (1, word("District")), (2, word("Local Level Name")), (3, word("Equalization Grant (Minimum)")), (4, word("Conditional Recurrent")))
    d = s.select(F.col("s_suppkey").cast("int").alias("dim_idx"), X.federal_code(k.cast("string")).alias("federal_code"), F.col("s_name").alias("name_en"), F.lit("नगर").alias("name_ne"), F.when(k % 2 == 0, "municipality").otherwise("rural_municipality").alias("local_level_type"), F.upper("doc_id").alias("district_en"))
    return P.transfers(body.unionByName(head), d, 2082)


_GRANTS = """g AS (SELECT 'n' || s_nationkey AS doc_id, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS federal_code, s_suppkey, 'equalization_minimum' AS grant_type, CAST(ROUND(s_acctbal, 2) AS DOUBLE) AS amount FROM supplier WHERE s_suppkey % 10 < 8 AND s_nationkey <> 4
UNION ALL SELECT 'n' || s_nationkey, lpad(CAST(s_suppkey AS VARCHAR), 8, '0'), s_suppkey, 'conditional_current', s_suppkey FROM supplier WHERE s_suppkey % 10 < 8 AND s_suppkey % 3 <> 0 AND s_nationkey <> 4)"""


@query("pipe6_transfers", f"WITH {_GRANTS} SELECT doc_id, federal_code, grant_type, amount, '2082/83' AS fiscal_year_bs FROM g")
def transfer_rows(spark, sf_dir):
    return P.persisted(transfers(spark, sf_dir)).select("doc_id", "federal_code", "grant_type", F.col("amount_npr").cast("double").alias("amount"), "fiscal_year_bs")


@query("pipe6_chk15_transfer_status", """SELECT 'n' || s_nationkey AS doc_id, CASE WHEN s_nationkey = 4 OR COUNT(*) FILTER (WHERE s_suppkey % 10 < 8) = 0 THEN 'failure' WHEN COUNT(*) FILTER (WHERE s_suppkey % 10 = 8) > 0 THEN 'partial' ELSE 'success' END AS status, CASE WHEN s_nationkey = 4 OR COUNT(*) FILTER (WHERE s_suppkey % 10 <= 8) = 0 THEN 1 ELSE COUNT(*) FILTER (WHERE s_suppkey % 10 = 8) END AS n_errors FROM supplier GROUP BY s_nationkey""")
def transfer_status(spark, sf_dir):
    """A sheet without rows and errors has one error, that it has none."""
    return transfers(spark, sf_dir).runs.select("doc_id", "status", "n_errors")


@query("agg2_transfer_summary", f"""WITH {_GRANTS}, h AS (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN 'municipality' ELSE 'rural_municipality' END AS local_level_type FROM g)
SELECT grant_type, local_level_type, COUNT(*) AS n, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount, COUNT(DISTINCT federal_code) AS places FROM h GROUP BY GROUPING SETS ((grant_type), (local_level_type), ())""")
def transfer_summary(spark, sf_dir):
    return P.transfer_summary(transfers(spark, sf_dir).rows).withColumn("amount", F.col("amount").cast("double"))


@query("pipe6_jn7_snk2_ingested", f"""WITH {_GRANTS}, h AS (SELECT * FROM g WHERE s_suppkey % 4 <> 0) SELECT federal_code, grant_type, 'new' AS what FROM h WHERE NOT (grant_type = 'conditional_current' AND s_suppkey % 5 = 1) UNION ALL SELECT federal_code, grant_type, 'unknown' FROM g WHERE s_suppkey % 4 = 0""")
def transfers_ingested(spark, sf_dir):
    """Places whose number is divisible by four aren't seeded; some grants are there already."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(X.federal_code(k.cast("string")).alias("slug"), k, F.when(k % 4 != 0, "local_level").otherwise("other").alias("kind")).withColumn("entity_id", F.col("slug"))
    have = s.filter("s_suppkey % 5 = 1").select(F.col("slug").alias("federal_code"), F.lit("conditional_current").alias("grant_type"))
    new, unknown, _ = P.ingested(transfers(spark, sf_dir), s, have, ["federal_code", "grant_type"], kind="local_level")
    return new.select("federal_code", "grant_type", F.lit("new").alias("what")).unionByName(unknown.select("federal_code", "grant_type", F.lit("unknown").alias("what")))


@query("pipe7_banking", """WITH l AS (SELECT stem, i FROM (VALUES ('capital-fund', 0), ('paid-up-capital', 1), ('statutory-reserves', 2), ('borrowings-total', 3), ('deposits-total', 4), ('deposits-current', 5), ('deposits-savings', 6), ('deposits-fixed', 7), ('liquid-funds', 8)) x(stem, i)), c AS (SELECT * FROM (VALUES ('system_total', 7), ('commercial', 15), ('development', 23), ('finance', 31)) x(class, j))
SELECT o_custkey AS doc_id, class AS bank_class, 'bfi-c5-' || replace(class, '_', '-') || '-' || stem AS indicator, CAST(o_custkey * 1000 + i * 40 + j AS DOUBLE) AS value, 'Bhadra 2082' AS period_bs, DATE '2025-08-01' AS ad_start, DATE '2025-08-15' AS ad_end FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 6 <> 0) o CROSS JOIN l CROSS JOIN c WHERE NOT (o_custkey % 4 = 0 AND i = 3) AND NOT (o_custkey % 5 = 0 AND i = 8 AND j = 31)""")
def banking(spark, sf_dir):
    """A sheet for each ordering customer; some lack a label or a figure, some the sheet itself."""
    o, k = table(spark, sf_dir, "orders").select("o_custkey").distinct(), F.col("o_custkey")
    label = F.element_at(F.array(*(F.lit(x) for x, _ in P.BANK_LABELS)), F.col("i") + 1)
    rows = o.select(k, k.alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i")).withColumn("row_idx", F.col("i") + 4)
    sheet = rows.select("doc_id", "row_idx", F.when(k % 6 == 0, "C6").otherwise("C5").alias("sheet"), F.explode(F.array(F.struct(F.lit(2).alias("col_idx"), F.when((k % 4 == 0) & (F.col("i") == 3), "OTHER").otherwise(F.replace(label, F.lit(" "), F.lit("  "))).alias("text")), *(F.struct(F.lit(j).alias("col_idx"), F.when((k % 5 == 0) & (F.col("i") == 8) & F.lit(j == 31), "n.a.").otherwise((k * 1000 + F.col("i") * 40 + j).cast("string")).alias("text")) for _, j in P.BANK_CLASSES))).alias("x"))
    return P.persisted(P.banking(sheet.select("doc_id", "sheet", "row_idx", "x.*"), 2082, 2, "Bhadra")).select("doc_id", "bank_class", "indicator", "value", "period_bs", "ad_start", "ad_end")


@query("pipe8_crawl", """WITH f AS (SELECT o_custkey AS url, MIN(o_orderkey) AS k FROM orders GROUP BY 1), n AS (SELECT *, ROW_NUMBER() OVER (ORDER BY k // 1000, k, url) AS rn FROM f WHERE url % 3 <> 0) SELECT url, 'archived' AS event_type FROM n WHERE rn <= 40 UNION ALL SELECT url, 'skipped_duplicate' FROM f WHERE url % 3 = 0""")
def crawl(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 1000).alias("category"), F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("url"))
    return P.archived(o, o.filter("url % 3 = 0").select("url"), 40).select("url", "event_type")


@query("pipe8_agg7_crawl_counters", "SELECT o_orderkey // 1000 AS category, COUNT(*) AS discovered, COUNT(*) FILTER (WHERE o_orderkey % 5 = 0) AS archived, 0 AS skipped_duplicate, COUNT(*) FILTER (WHERE o_orderkey % 5 = 1) AS error FROM orders GROUP BY 1")
def crawl_counters(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 1000).alias("category"), (F.col("o_orderkey") % 5).alias("k"))
    return P.crawl_counters(o, o.filter("k < 2").withColumn("event_type", F.when(F.col("k") == 0, "archived").otherwise("error")))


@query("pipe9_seed", "SELECT lpad(CAST(n_nationkey AS VARCHAR), 8, '0') AS slug, n_name AS name_en, CASE WHEN n_nationkey < 5 THEN 'kept' END AS note FROM nation UNION ALL SELECT 'gone', 'Gone', 'kept'")
def seed(spark, sf_dir):
    d = dimension(spark, sf_dir)
    old = d.filter("dim_idx < 5").select(F.lit("local_level").alias("kind"), F.col("federal_code").alias("slug"), F.lit("old").alias("name_en"), "name_ne", "district_en", "local_level_type", F.lit("kept").alias("note"))
    gone = old.limit(1).withColumn("slug", F.lit("gone")).withColumn("name_en", F.lit("Gone"))
    return P.seed_local_levels(old.unionByName(gone), d, 25, {"municipality": 25}).select("slug", "name_en", "note")


@query("pipe10_registry_gate", "SELECT 'duplicate source_id' AS fault, 's' || s_suppkey AS subject FROM supplier WHERE s_suppkey % 10 = 1 UNION ALL SELECT 'missing profile', 's' || s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0 UNION ALL SELECT 'stale index', 's' || s_suppkey FROM supplier WHERE s_suppkey % 10 IN (1, 5)")
def registry_gate(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k, F.concat(F.lit("s"), k.cast("string")).alias("source_id"), (k % 4).alias("tier"), F.when(k % 3 == 0, "reference_only").otherwise("auto").alias("mode"))
    r = s.unionByName(s.filter("s_suppkey % 10 = 1"))
    stored = s.select(F.concat(F.lit("Tier "), "tier").alias("tier_label"), "source_id", F.when(k % 10 == 5, "old").otherwise(F.col("mode")).alias("mode"))
    return T.registry_gate(r, s.filter("s_suppkey % 2 = 1").select("source_id"), stored)


@query("pipe11_probe", "WITH x AS (SELECT 'n' || s_nationkey AS doc_id, 'C5:' || (COUNT(*) + 1) || 'x4|C6:1x1' AS signature FROM supplier GROUP BY s_nationkey) SELECT signature, COUNT(*) AS n, string_agg(doc_id, ',' ORDER BY doc_id) AS docs FROM x GROUP BY signature")
def probe(spark, sf_dir):
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier").withColumn("doc_id", F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).withColumn("row_idx", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")))
    # A supplier without a name has an empty cell, so that the sheet's width doesn't hang on names.
    c = cells(s, (0, F.lit("a")), (3, F.coalesce("s_name", F.lit("")))).withColumn("sheet", F.lit("C5"))
    more = s.select("doc_id").distinct().select("doc_id", F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("x").alias("text"), F.lit("C6").alias("sheet"))
    docs = F.expr("string_agg(doc_id, ',') WITHIN GROUP (ORDER BY doc_id)").alias("docs")
    return P.probed(c.unionByName(more), more=[docs])[0].select("signature", "n", "docs")


@query("pipe1_ingest", """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 3 THEN 'conflict' WHEN o_orderkey % 4 = 2 THEN 'reuse' ELSE 'new' END AS status, CASE WHEN o_orderkey % 4 < 3 AND o_orderkey % 3 > 0 THEN CASE WHEN o_orderkey % 3 = 2 THEN 'block' ELSE 'promote' END END AS decision FROM orders""")
def ingest(spark, sf_dir):
    """A bulletin for each order: some bytes known, some keys with other bytes, some without a figure, some with a unit that isn't known. Each has its own indicator's period."""
    k = F.col("o_orderkey")
    t = F.when(k % 3 == 1, F.concat(F.lit("Gross foreign exchange reserves increased 1.5 percent to Rs. "), (k % 1000).cast("string"), F.lit(".5 billion"))).when(k % 3 == 2, "merchandise and services imports of 18.4 months").otherwise("charts")
    f = table(spark, sf_dir, "orders").select(k.alias("doc_id"), k.cast("string").alias("key"), F.sha2(k.cast("string"), 256).alias("hash"), t.alias("text"))
    catalog = f.filter("doc_id % 4 > 1").withColumn("hash", F.when(F.col("doc_id") % 4 == 2, F.col("hash")).otherwise("other"))

    def read(docs):
        out = P.narrative(docs, 2082)
        # As many periods as documents, so that none repeats another.
        out.rows = out.rows.withColumn("indicator", F.concat("indicator", F.lit("-"), F.col("doc_id").cast("string"))).withColumn("period_bs", F.lit("FY 2082/83"))
        return out

    indicators = f.select(F.explode(F.array(*(F.concat(F.lit(s), F.lit("-"), F.col("doc_id").cast("string")) for s in ("cmefs-gross-forex-reserves", "cmefs-forex-reserves-months-of-import-cover")))).alias("indicator"))
    approved = spark.createDataFrame([], "indicator string, period_type string, period_bs string, document_id bigint, value double, revision int, ad_end date")
    out = P.ingest(f, catalog, read, approved, indicators, "r1", units=("npr_billion",))
    return out["status"].select("doc_id", "status").join(out["judged"].select(F.col("document_id").alias("doc_id"), "decision"), "doc_id", "left")
