"""Queries of reshaping, joins, sinks, sets, windows and analytics, with their SQL."""

from pyspark.sql import Window, functions as F

from factloom.functions import text as X
from factloom.operators import analytics as A, quality as Q, reshape as R, resolve as J, tables as T
from factloom.plans.registry import query
from factloom.plans.scalars import table

MONEY = "CAST(SUM(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


def money(c):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


@query("rsh1_unpivot", """SELECT l_orderkey, l_linenumber, indicator, value FROM (SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS indicator, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem) x""")
def unpivot(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return R.unpivot(l, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], lambda c: c.cast("double"))[0]


def grant_cells(spark, sf_dir):
    """A sheet for each nation: a header with the classes, a row for each of its suppliers, and a total row."""
    s = table(spark, sf_dir, "supplier").withColumn("row", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).cast("int") + 1)
    doc = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    cell = lambda i, c: F.struct(F.lit(i).alias("col_idx"), c.cast("string").alias("text"))
    body = s.select(doc.alias("doc_id"), F.col("row").alias("row_idx"), F.explode(F.array(cell(0, F.lit("D")), cell(1, F.when(F.col("s_suppkey") % 10 == 9, "Grand Total").otherwise(F.col("s_name"))), cell(2, F.format_number("s_acctbal", 2)), cell(3, F.when(F.col("s_suppkey") % 3 == 0, "-").otherwise(F.col("s_suppkey").cast("string"))))).alias("x"))
    head = s.select(doc.alias("doc_id")).distinct().select("doc_id", F.lit(1).alias("row_idx"), F.explode(F.array(cell(0, F.lit("District Name")), cell(1, F.lit("Local Level Name")), cell(2, F.lit("Equalization Grant (Minimum)")), cell(3, F.lit("Conditional Recurrent")))).alias("x"))
    title = s.select(doc.alias("doc_id")).distinct().select("doc_id", F.lit(0).alias("row_idx"), F.explode(F.array(cell(0, F.lit("Special current matters")))).alias("x"))
    return body.unionByName(head).unionByName(title).select("doc_id", "row_idx", "x.col_idx", "x.text")


@query("rsh2_rsh5_rsh6_rsh7_flt2_grants", """WITH x AS (SELECT 'n' || s_nationkey AS doc_id, s_name AS name, s_acctbal, s_suppkey FROM supplier WHERE s_suppkey % 10 <> 9)
SELECT doc_id, name, 'equalization_minimum' AS grant_type, CAST(CAST(s_acctbal AS DECIMAL(20,2)) AS DOUBLE) AS amount FROM x UNION ALL SELECT doc_id, name, 'conditional_current', CAST(s_suppkey AS DOUBLE) FROM x WHERE s_suppkey % 3 <> 0""")
def grants(spark, sf_dir):
    return R.grants(grant_cells(spark, sf_dir), X.amount).select("doc_id", "name", "grant_type", F.col("amount").cast("double").alias("amount"))


@query("rsh4_matrix", """WITH d AS (SELECT DISTINCT s_nationkey FROM supplier), r AS (SELECT s_nationkey, s_suppkey, ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier)
SELECT 'n' || d.s_nationkey AS doc_id, c.class, l.stem, CASE WHEN l.stem = 'second' AND r.rn IS NOT NULL AND c.class = 'b' AND s_suppkey % 3 <> 0 THEN CAST(r.s_suppkey AS DOUBLE) END AS value,
CASE WHEN l.stem = 'absent' OR r.rn IS NULL THEN 'missing_label' WHEN c.class = 'z' THEN 'missing_column' WHEN s_suppkey % 3 = 0 THEN 'bad_number' END AS error
FROM d CROSS JOIN (SELECT unnest(['second', 'absent']) AS stem) l CROSS JOIN (SELECT unnest(['b', 'z']) AS class) c LEFT JOIN r ON r.s_nationkey = d.s_nationkey AND r.rn = 1 AND l.stem = 'second'""")
def matrix(spark, sf_dir):
    cells = grant_cells(spark, sf_dir).withColumn("text", F.when((F.col("row_idx") == 2) & (F.col("col_idx") == 1), " CAPITAL   Fund").otherwise(F.col("text")))
    labels = spark.createDataFrame([("Capital Fund", "second"), ("Borrowings", "absent")], "label string, stem string")
    classes = spark.createDataFrame([("b", 3), ("z", 9)], "class string, col_idx int")
    return R.matrix(cells, labels, classes, 1, X.plain_number)


@query("rsh8_needles", "SELECT DISTINCT 'n' || s_nationkey AS doc_id, g.geo, g.row_idx, g.col_idx FROM supplier CROSS JOIN (SELECT 'overall' AS geo, 1 AS row_idx, 2 AS col_idx UNION ALL SELECT 'rural', 1, 3) g")
def needles(spark, sf_dir):
    n = spark.createDataFrame([("Equalization Grant (Minimum)", "overall"), ("Conditional Recurrent", "rural")], "needle string, geo string")
    return R.needle_columns(grant_cells(spark, sf_dir), n)


@query("rsh10_signatures", """WITH x AS (SELECT 'n' || s_nationkey AS doc_id, 'S:' || (COUNT(*) + 2) || 'x4' AS signature FROM supplier GROUP BY s_nationkey) SELECT doc_id, signature, COUNT(*) OVER (PARTITION BY signature) AS n, MIN(doc_id) OVER (PARTITION BY signature) AS first_doc FROM x""")
def signatures(spark, sf_dir):
    m = R.signatures(grant_cells(spark, sf_dir).withColumn("sheet", F.lit("S")))
    return m.join(R.signature_groups(m), "signature")


@query("rsh10_one_signature", "SELECT 'O:1x2' AS signature, COUNT(*) AS n, MIN(o_orderkey) AS first_doc FROM orders")
def one_signature(spark, sf_dir):
    """All orders are sheets of one shape: one group, whose members stay rows."""
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("O").alias("sheet"), F.lit(0).alias("row_idx"), F.posexplode(F.array(F.col("o_orderstatus"), F.col("o_orderpriority"))).alias("col_idx", "text"))
    return R.signature_groups(R.signatures(c))


@query("rsh11_excerpt", "SELECT DISTINCT 'n' || s_nationkey AS doc_id, 1 AS row_idx, 'District Name|Local Level Name|Equalization Grant (Minimum)' AS line FROM supplier")
def excerpt(spark, sf_dir):
    return R.excerpt(grant_cells(spark, sf_dir), 2, 3).filter("row_idx = 1")


@query("rsh9_set4_missing_columns", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'rowtotal' ELSE 'prov,rowtotal' END AS missing FROM nation")
def missing_columns(spark, sf_dir):
    h = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("prov"), F.lit("dist"))).otherwise(F.array(F.lit("dist")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(R.missing_columns(["prov", "dist", "rowtotal"], h), ",").alias("missing"))


@query("flt1_flt3_filters", "SELECT l_orderkey, l_linenumber, (l_linenumber <> 0 AND CAST(l_quantity AS INTEGER) % 2 <> 0) AS palika, (l_linenumber <= 2) AS index_row FROM lineitem")
def filters(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("a", F.col("l_linenumber").cast("string")).withColumn("b", F.when(F.col("l_quantity").cast("int") % 2 == 0, "0").otherwise("7"))
    code = F.when(F.col("l_linenumber") == 1, "A.12").when(F.col("l_linenumber") == 3, "C.1")
    return l.select("l_orderkey", "l_linenumber", R.palika_grain("a", "b").alias("palika"), R.index_row(code, F.when(F.col("l_linenumber") == 2, "Overall Index").otherwise("x")).alias("index_row"))


@query("agg5_agg6_run_status", """SELECT o_custkey AS doc_id, COUNT(*) FILTER (WHERE o_orderstatus <> 'F') AS n_rows, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n_errors,
CASE WHEN COUNT(*) FILTER (WHERE o_orderstatus <> 'F') = 0 THEN 'failure' WHEN COUNT(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN 'partial' ELSE 'success' END AS status,
CASE WHEN COUNT(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN COUNT(*) FILTER (WHERE o_orderstatus = 'F') || ' error(s); first: F: ' || MIN_BY(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus = 'F') END AS summary FROM orders GROUP BY o_custkey""")
def run_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "doc_id")
    bad = o.filter("o_orderstatus = 'F'")
    s = R.run_status(o.filter("o_orderstatus <> 'F'"), bad, o.select("doc_id").distinct())
    return s.join(R.error_summary(bad, "doc_id", "o_orderkey", "o_orderstatus", "o_orderpriority"), "doc_id", "left").select("doc_id", "n_rows", "n_errors", "status", "summary")


@query("jn4_jn5_jn6_fuzzy_resolve", """SELECT c_custkey, CASE WHEN c_custkey % 7 = 6 THEN NULL WHEN c_custkey % 7 = 5 THEN 'NATION_1' ELSE n_name END AS name_en, CASE WHEN c_custkey % 7 = 6 THEN NULL WHEN c_custkey % 7 = 5 THEN '00000001' ELSE lpad(CAST(n_nationkey AS VARCHAR), 8, '0') END AS code,
CASE WHEN c_custkey % 7 = 0 THEN ROUND(200.0 * length(n_name) / (2 * length(n_name) + 1), 4) WHEN c_custkey % 7 < 6 THEN 100.0 END AS score FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def fuzzy(spark, sf_dir):
    """Names with a typo, padded, without a district, with an unknown one, in the other script with an OCR error, by an override, and unknown ones."""
    d = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    deva = X.to_devanagari(F.concat(F.lit("राज्य नगर"), F.lit("{}"), F.lit(" "), F.col("n_nationkey").cast("string")))
    ne = lambda w: F.replace(deva, F.lit("{}"), F.lit(w))
    dim = d.select(F.col("n_nationkey").alias("dim_idx"), X.federal_code(F.col("n_nationkey").cast("string")).alias("federal_code"), F.col("n_name").alias("name_en"), ne("पालिका").alias("name_ne"), F.lit("municipality").alias("local_level_type"), F.col("r_name").alias("district_en"))
    c = table(spark, sf_dir, "customer").join(d, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.pmod("c_custkey", F.lit(7))
    name = F.when(k == 0, F.concat("n_name", F.lit("x"))).when(k == 1, F.concat(F.lit("  "), "n_name", F.lit(" "))).when(k == 4, ne("पाललका")).when(k == 5, "nobody").when(k == 6, "Atlantis Megalopolis").otherwise(F.col("n_name"))
    district = F.when(k == 2, F.lit(None).cast("string")).when(k == 3, "Nowhere").when(k == 5, "America").otherwise(F.concat(F.lower("r_name"), F.lit(" ")))
    names = c.select("c_custkey", name.alias("name"), district.alias("district"))
    found = J.municipalities(names, dim, 85.0, spark.createDataFrame([("nobody", "NATION_1")], "name string, canonical string"))
    return found.select("c_custkey", "name_en", F.col("federal_code").alias("code"), F.round("score", 4).alias("score"))


@query("jn7_set1_set2_resolved", "SELECT l_suppkey % 120 AS s_suppkey, COUNT(*) AS n, BOOL_OR(s.s_suppkey IS NOT NULL) AS known FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) s ON s.s_suppkey = l_suppkey % 120 GROUP BY 1")
def resolved(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 120).alias("s_suppkey"))
    e = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("entity_id"), F.when(F.col("s_suppkey") % 2 == 0, "local_level").otherwise("x").alias("kind"))
    yes, no = J.resolved(f, e, "s_suppkey", "local_level")
    return yes.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.lit(True).alias("known")).unionByName(no.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.lit(False).alias("known")))


@query("snk2_insert_missing", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 1")
def insert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return T.insert_missing(o.unionByName(o), o.filter("o_orderkey % 2 = 0"), ["o_orderkey"], ["o_totalprice"])


@query("snk3_snk4_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return T.upsert(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("new")), ["o_orderkey"], ["o_orderstatus"])


@query("snk7_snk8_delete_update", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'verified' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0")
def delete(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return T.set_where(T.delete_keys(o, o.filter("o_orderkey % 5 = 0"), ["o_orderkey"]), F.col("o_orderkey") % 3 == 0, {"o_orderstatus": F.lit("verified")})


@query("snk10_archive_status", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 3 = 1 THEN 'reuse' ELSE 'conflict' END AS status FROM documents")
def archive(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.sha2("text", 256).alias("hash"))
    c = d.filter("doc_id % 3 > 0").withColumn("hash", F.when(F.col("doc_id") % 3 == 1, F.col("hash")).otherwise("other"))
    again = c.filter("doc_id % 3 = 1").withColumn("hash", F.lit("older bytes"))
    return T.archive_status(d, c.unionByName(again)).select("doc_id", "status")


@query("snk2_counts", "SELECT 2 * COUNT(*) AS attempted, COUNT(*) FILTER (WHERE o_orderkey % 2 = 1) AS inserted, 2 * COUNT(*) - COUNT(*) FILTER (WHERE o_orderkey % 2 = 1) AS skipped FROM orders")
def insert_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    both = o.unionByName(o)
    return T.insert_counts(both, T.insert_missing(both, o.filter("o_orderkey % 2 = 0"), ["o_orderkey"], ["o_totalprice"]))


@query("snk7_deleted", "SELECT o_orderkey + 5 AS o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey = o.o_orderkey + 5) THEN 'deleted' ELSE 'NotFound' END AS result FROM orders o")
def deleted(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return T.deleted(o, o.select((F.col("o_orderkey") + 5).alias("o_orderkey")), ["o_orderkey"])


@query("snk11_content_dedup", "SELECT sha256(text) AS sha256, MIN(doc_id) AS doc_id FROM documents GROUP BY 1")
def content(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), "doc_id")
    return T.insert_missing(d, d.limit(0), ["sha256"], ["doc_id"])


@query("flt4_lookup", "SELECT c_custkey, MAX(o_custkey) IS NOT NULL AS found FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return T.lookup(table(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"])


@query("srt1_srt5_top_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) x WHERE rn <= 3")
def top(spark, sf_dir):
    return T.top_per(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("srt3_ranked_registry", "SELECT p_partkey, ROW_NUMBER() OVER (ORDER BY CASE WHEN p_size % 4 > 0 THEN p_size % 4 END ASC NULLS LAST, lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS pos, CASE WHEN p_size % 4 > 0 THEN 'Tier ' || (p_size % 4) ELSE 'Reference' END AS label FROM part")
def registry(spark, sf_dir):
    tier = F.when(F.col("p_size") % 4 > 0, F.col("p_size") % 4)
    p = T.registry_index(table(spark, sf_dir, "part").select("p_partkey", tier.alias("tier"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("source_id")))
    return T.numbered(p.select("p_partkey", F.col("tier_label").alias("label")), "pos").select("p_partkey", "pos", "label")


@query("srt4_agg3_groups_by_size", "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey")
def groups(spark, sf_dir):
    return T.groups_by_size(table(spark, sf_dir, "customer"), "c_nationkey")


@query("srt2_trailing_list", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
def trailing_list(spark, sf_dir):
    return T.trailing_list(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.lit("2000-01-01").cast("timestamp_ntz"), "o_orderdate")


@query("srt5_suppressed", "SELECT o_custkey, o_orderkey, GREATEST(n - 2, 0) AS suppressed FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM orders) x WHERE rn <= 2")
def suppressed(spark, sf_dir):
    return T.sampled_with_rest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], 2).select("o_custkey", "o_orderkey", "suppressed")


@query("agg8_duplicate_keys", "SELECT l_orderkey, l_linenumber, COUNT(*) AS count FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def duplicates(spark, sf_dir):
    return T.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("agg9_expected_count", "SELECT NULL AS part, COUNT(*) AS n, CAST(25 AS BIGINT) AS expected, COUNT(*) = 25 AS ok FROM nation UNION ALL SELECT 'r' || n_regionkey, COUNT(*), CASE WHEN n_regionkey = 2 THEN 6 ELSE 5 END, COUNT(*) = CASE WHEN n_regionkey = 2 THEN 6 ELSE 5 END FROM nation GROUP BY n_regionkey")
def expected(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("r", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    return T.expected_count(n, 25, {f"r{i}": 6 if i == 2 else 5 for i in range(5)}, "r")


@query("jn8_missing_profiles", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 1")
def profiles(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("mode", F.when(F.col("s_suppkey") % 3 == 0, "reference_only").when(F.col("s_suppkey") % 2 == 0, "automated"))
    return T.missing(s, s.filter("s_suppkey % 5 = 1"), ["s_suppkey"], "mode")


@query("set3_membership", "SELECT p_partkey, p_type IN ('ECONOMY', 'PROMO') AND p_size % 2 = 0 AS known FROM part")
def membership(spark, sf_dir):
    t = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).when(F.col("p_size") % 3 == 0, F.lower("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", T.member(t, ("ECONOMY", "PROMO")).alias("known"))


@query("set1_distinct_keys", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def distinct_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    return T.distinct_keys(o.unionByName(o.withColumn("o_custkey", F.lit(None).cast("bigint"))), "o_custkey", "o_orderstatus")


@query("set6_stale_index", "SELECT c_nationkey, COUNT(*) AS n, 'stored' AS side FROM customer WHERE c_nationkey = 3 GROUP BY 1 UNION ALL SELECT c_nationkey, COUNT(*) + 1, 'computed' FROM customer WHERE c_nationkey = 3 GROUP BY 1")
def stale(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return T.stale(g, g.withColumn("n", F.when(F.col("c_nationkey") == 3, F.col("n") + 1).otherwise(F.col("n"))))


@query("agg7_manifest_counters", "SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'click') AS click, COUNT(*) FILTER (WHERE event_type = 'error') AS error, 0 AS never FROM events GROUP BY user_id")
def counters(spark, sf_dir):
    return T.manifest_counters(table(spark, sf_dir, "events"), "user_id", ("click", "error", "never"))


@query("agg10_jn9_rollup", f"SELECT r_name, n_name, c_mktsegment, {MONEY.format('c_acctbal')} AS total, COUNT(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
def rollup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    return A.rolled_up(c.withColumn("b", F.col("c_acctbal").cast("decimal(18,2)")), ["r_name", "n_name", "c_mktsegment"], "b").select("r_name", "n_name", "c_mktsegment", F.col("total").cast("double").alias("total"), "n")


@query("jn10_reconciliation", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 3")
def reconciliation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("value_a"))
    b = o.select("o_orderkey", (F.col("value_a") + F.when(F.col("o_orderkey") % 10 == 3, 0.5).otherwise(0.001)).alias("value_b"))
    return A.unreconciled(o, b, ["o_orderkey"]).select("o_orderkey")


@query("jn12_registry_columns", """SELECT c_custkey AS source_id, COALESCE(n, 0) AS indicators, last_success, last_failure, grade FROM customer LEFT JOIN (SELECT o_custkey, COUNT(DISTINCT o_orderpriority) AS n, MAX(o_orderdate) FILTER (WHERE o_orderstatus <> 'F') AS last_success, MAX(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS last_failure, MAX(CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'C' END) AS grade FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def registry_columns(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "source_id")
    runs = o.select("source_id", F.when(F.col("o_orderstatus") == "F", "failure").otherwise("success").alias("status"), F.col("o_orderdate").alias("at"))
    facts = o.select("source_id", F.col("o_orderpriority").alias("indicator"), F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("C").alias("grade"))
    return T.registry_status(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "source_id"), runs, facts)


@query("agg10_reconciled", f"""WITH r AS (SELECT r_name, n_name, {MONEY.format('c_acctbal')} AS total FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name))
SELECT r_name, n_name, CASE WHEN r_name IS NULL THEN 0 WHEN n_name IS NULL THEN 1 ELSE 2 END AS level, CASE WHEN n_name IS NULL THEN CASE WHEN r_name = 'ASIA' THEN -2.5 ELSE 0.0 END END AS diff FROM r""")
def reconciled(spark, sf_dir):
    """Published totals of regions and the whole, one of them off."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    rolled = A.rolled_up(c.withColumn("b", F.col("c_acctbal").cast("decimal(18,2)")), ["r_name", "n_name"], "b").withColumn("total", F.col("total").cast("double"))
    published = rolled.filter("level < 2").select("r_name", "n_name", (F.col("total") + F.when(F.col("r_name") == "ASIA", 2.5).otherwise(0.0)).alias("published"))
    return A.reconciled(rolled, published, ["r_name", "n_name"]).select("r_name", "n_name", "level", F.round("diff", 4).alias("diff"))


@query("win6_revision_trail", "SELECT o_custkey, o_orderkey AS revision, ROUND(o_totalprice - LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS delta FROM orders")
def trail(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("revision"), F.col("o_totalprice").alias("value"))
    return A.revision_trail(o, ["o_custkey"]).select("o_custkey", "revision", F.round("delta", 2).alias("delta"))


@query("win5_bounded_stats", "SELECT o_orderkey, COUNT(*) OVER w AS n, ROUND(AVG(o_totalprice) OVER w, 6) AS mean FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders) x WINDOW w AS (PARTITION BY o_custkey ORDER BY d RANGE BETWEEN INTERVAL 720 DAYS PRECEDING AND CURRENT ROW)")
def bounded(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("indicator"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("ad_end"))
    return Q.bounded_stats(o).select("o_orderkey", "n", F.round("mean", 6).alias("mean"))


@query("win4_new_links", "SELECT crawl, o_custkey AS url, MIN(o_orderkey) AS page FROM (SELECT o_orderkey // 100 AS crawl, o_orderkey, o_custkey FROM orders) x GROUP BY 1, 2")
def new_links(spark, sf_dir):
    from factloom.sources.readers import new_links as first

    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 100).alias("crawl"), F.col("o_orderkey").alias("page"), F.lit(0).alias("pos"), F.col("o_custkey").alias("url"))
    return first(o, "crawl", "page", "pos").select("crawl", "url", "page")


@query("jn13_win6_win9_restated", """SELECT o_custkey, o_orderkey, before, ABS(o_totalprice / before - 1) > 0.03 AS material FROM (SELECT o_custkey, o_orderkey, o_totalprice, LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) x WHERE before IS NOT NULL AND before <> o_totalprice""")
def restated(spark, sf_dir):
    return A.restated(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey", "before", "material")


@query("win3_first_wins", "SELECT l_orderkey, l_suppkey, l_linenumber, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) > 1 AS is_error FROM lineitem")
def first_wins(spark, sf_dir):
    return Q.first_wins(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_suppkey", "l_linenumber", (F.col("rn") > 1).alias("is_error"))


PAGED = "WITH o AS (SELECT o_orderkey // 100 AS crawl, o_orderkey % 100 + 1 AS page, o_custkey FROM orders), f AS (SELECT crawl, o_custkey, MIN(page) AS page FROM o GROUP BY 1, 2), n AS (SELECT p.crawl, p.page, COUNT(f.page) AS new FROM (SELECT DISTINCT crawl, page FROM o) p LEFT JOIN f ON f.crawl = p.crawl AND f.page = p.page GROUP BY 1, 2), s AS (SELECT crawl, MIN(page) AS stop FROM n WHERE new = 0 GROUP BY 1) SELECT n.crawl, page, new FROM n LEFT JOIN s ON s.crawl = n.crawl WHERE page < COALESCE(stop, 51) AND page <= 50"


@query("win7_pagination_stop_all", PAGED)
@query("win7_pagination_stop", PAGED)
def pagination_all(spark, sf_dir):
    """All orders, dealt over crawls of up to 100 pages."""
    from factloom.sources.readers import pages_kept

    k = F.col("o_orderkey")
    return pages_kept(table(spark, sf_dir, "orders").select(F.floor(k / 100).alias("crawl"), (k % 100 + 1).alias("page"), F.col("o_custkey").alias("url")), "page", "url", 50, "crawl")


@query("win10_pulse", f"WITH m AS (SELECT event_type, CAST(ts AS DATE) AS d, {MONEY.format('value')} AS v FROM events GROUP BY 1, 2) SELECT event_type, d, v, LAG(v) OVER w AS previous, LAG(v, 12) OVER w AS year_before FROM m WINDOW w AS (PARTITION BY event_type ORDER BY d)")
def pulse(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(money("value").alias("v"))
    return A.pulse(m, ["event_type"], "d", "v")


@query("anl1_hhi", f"WITH s AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS y, l_suppkey, {MONEY.format('l_extendedprice')} AS v FROM lineitem GROUP BY 1, 2), t AS (SELECT *, v / SUM(v) OVER (PARTITION BY y) AS sh FROM s) SELECT y, ROUND(SUM(sh * sh), 8) AS hhi, COUNT(*) AS parties FROM t GROUP BY y")
def hhi(spark, sf_dir):
    return A.concentration(table(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate")), ["y"], "l_suppkey", "l_extendedprice").select("y", F.round("hhi", 8).alias("hhi"), "parties")


@query("anl4_anl6_shares", f"WITH s AS (SELECT l_returnflag, l_linestatus, {MONEY.format('l_extendedprice')} AS total FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, ROUND(total / SUM(total) OVER (PARTITION BY l_returnflag), 8) AS share FROM s")
def shares(spark, sf_dir):
    return A.shares(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_linestatus"], "l_extendedprice").select("l_returnflag", "l_linestatus", F.round("share", 8).alias("share"))


@query("anl2_anl3_ratios", f"SELECT c_nationkey, ROUND(CAST(SUM(CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(c_acctbal AS DECIMAL(18,2)) END) AS DOUBLE) / NULLIF(CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE), 0), 6) AS ratio FROM customer GROUP BY c_nationkey")
def ratios(spark, sf_dir):
    return A.ratio(table(spark, sf_dir, "customer"), ["c_nationkey"], F.col("c_mktsegment") == "BUILDING", F.lit(True), "c_acctbal").select("c_nationkey", F.round("ratio", 6).alias("ratio"))


@query("anl5_running", f"WITH m AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, {MONEY.format('o_totalprice')} AS v FROM orders GROUP BY 1, 2) SELECT o_custkey, y, ROUND(SUM(v) OVER (PARTITION BY o_custkey ORDER BY y ROWS UNBOUNDED PRECEDING), 2) AS cumulative FROM m")
def running(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(money("o_totalprice").alias("v"))
    return A.running(m, ["o_custkey"], "y", "v").select("o_custkey", "y", F.round("cumulative", 2).alias("cumulative"))


@query("anl7_top_bottom", f"WITH m AS (SELECT o_custkey, {MONEY.format('o_totalprice')} AS v FROM orders GROUP BY 1) (SELECT o_custkey, v, 'top' AS \"end\" FROM m ORDER BY v DESC, o_custkey LIMIT 10) UNION ALL (SELECT o_custkey, v, 'bottom' FROM m ORDER BY v, o_custkey LIMIT 10)")
def top_bottom(spark, sf_dir):
    return A.both_ends(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(money("o_totalprice").alias("v")), "v", "o_custkey")


@query("anl8_budget_gap", f"WITH b AS (SELECT l_suppkey AS k, COUNT(*) AS budget FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1), a AS (SELECT l_suppkey AS k, COUNT(DISTINCT l_orderkey) AS actual FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY 1) SELECT k, COALESCE(actual, 0) - COALESCE(budget, 0) AS gap FROM b FULL JOIN a USING (k)")
def budget_gap(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_suppkey"))
    return A.gap(l.filter("k % 3 <> 0").groupBy("k").agg(F.count(F.lit(1)).alias("budget")), l.filter("k % 4 <> 0").groupBy("k").agg(F.countDistinct("l_orderkey").alias("actual")), ["k"]).select("k", "gap")


@query("anl10_district_profile", f"SELECT n_nationkey, NULLIF(CAST(COUNT(DISTINCT c_custkey) AS BIGINT), 0) AS customers, (SELECT NULLIF(COUNT(*), 0) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, {MONEY.format('c_acctbal')} AS balance, CAST(NULL AS DOUBLE) AS nothing FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def profile(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), table(spark, sf_dir, "nation")
    one = F.lit(1).cast("bigint").alias("value")
    measures = {"customers": c.select("n_nationkey", one), "suppliers": table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), one), "balance": c.select("n_nationkey", F.col("c_acctbal").cast("decimal(18,2)").alias("value")), "nothing": c.limit(0).select("n_nationkey", F.col("c_acctbal").alias("value"))}
    return A.profile(n, "n_nationkey", measures).withColumn("balance", F.col("balance").cast("double"))


@query("anl2_trend", f"WITH m AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS y, l_returnflag, {MONEY.format('l_tax')} / {MONEY.format('l_quantity')} AS r FROM lineitem GROUP BY 1, 2) SELECT y, l_returnflag, ROUND(r - LAG(r) OVER (PARTITION BY l_returnflag ORDER BY y), 8) AS change FROM m")
def trend(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("y"), "l_returnflag").agg((money("l_tax") / money("l_quantity")).alias("r"))
    return A.trend(m, ["l_returnflag"], "y", "r").select("y", "l_returnflag", F.round("change", 8).alias("change"))


@query("anl3_bank_ratios", f"WITH i AS (SELECT l_suppkey AS k, {MONEY.format('l_tax')} AS profit, {MONEY.format('l_discount')} AS interest FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey AS k, {MONEY.format('l_extendedprice')} AS assets, {MONEY.format('l_quantity')} AS equity FROM lineitem GROUP BY 1) SELECT k, ROUND(profit / assets, 10) AS roa, ROUND(profit / NULLIF(equity, 0), 10) AS roe, ROUND(interest / assets, 10) AS nim, ROUND(equity / assets, 10) AS adequacy FROM i JOIN b USING (k)")
def bank_ratios(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "k")
    i = l.groupBy("k").agg(money("l_tax").alias("profit"), money("l_discount").alias("interest"))
    b = l.groupBy("k").agg(money("l_extendedprice").alias("assets"), money("l_quantity").alias("equity"), money("l_extendedprice").alias("weighted"))
    return A.bank_ratios(i, b, ["k"]).select("k", *(F.round(c, 10).alias(c) for c in ("roa", "roe", "nim", "adequacy")))


@query("anl5_dossier", "SELECT o_custkey, o_orderstatus, " + ", ".join(f"CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE year(o_orderdate) = {y}) AS DOUBLE) AS y{y}" for y in (1995, 1998, 2001)) + " FROM orders GROUP BY 1, 2")
def dossier(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.year("o_orderdate").alias("y"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    d = A.dossier(o, "o_custkey", "y", "o_orderstatus", "v", (1995, 1998, 2001))
    return d.select("o_custkey", "o_orderstatus", *(F.col(str(y)).cast("double").alias(f"y{y}") for y in (1995, 1998, 2001)))


@query("anl7_per_head", f"WITH t AS (SELECT c_nationkey AS k, {MONEY.format('c_acctbal')} AS v FROM customer GROUP BY 1), p AS (SELECT s_nationkey AS k, COUNT(*) AS population FROM supplier WHERE s_nationkey % 5 > 0 GROUP BY 1) SELECT k, ROUND(v / population, 6) AS per_head FROM t LEFT JOIN p USING (k)")
def per_head(spark, sf_dir):
    t = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(money("c_acctbal").alias("v"))
    p = table(spark, sf_dir, "supplier").filter("s_nationkey % 5 > 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("population"))
    return A.per_head(t, p, ["k"], "v").select("k", F.round("per_head", 6).alias("per_head"))


@query("anl9_donor_pipeline", f"WITH g AS (SELECT o_custkey, o_orderstatus, {MONEY.format('o_totalprice')} AS amount, COUNT(*) AS n FROM orders GROUP BY 1, 2) SELECT o_custkey, o_orderstatus, amount, n, ROUND(amount / SUM(amount) OVER (PARTITION BY o_orderstatus), 9) AS share FROM g")
def donor_pipeline(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("v", F.col("o_totalprice").cast("decimal(18,2)"))
    return A.pipeline_by_status(o, "o_custkey", "o_orderstatus", "v").select("o_custkey", "o_orderstatus", F.col("amount").cast("double").alias("amount"), "n", F.round("share", 9).alias("share"))


@query("win10_depreciation", f"WITH m AS (SELECT event_type, CAST(ts AS DATE) AS d, {MONEY.format('value')} AS v FROM events GROUP BY 1, 2) SELECT event_type, d, ROUND(AVG(v) OVER (PARTITION BY event_type ORDER BY d ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS rolling, ROUND((v - LAG(v, 12) OVER w) / LAG(v, 12) OVER w, 8) AS depreciation FROM m WINDOW w AS (PARTITION BY event_type ORDER BY d)")
def depreciation(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(money("value").alias("v"))
    return A.depreciation(m, ["event_type"], "d", "v").select("event_type", "d", F.round("rolling", 6).alias("rolling"), F.round("depreciation", 8).alias("depreciation"))


@query("anl11_money_flows", f"SELECT c_mktsegment AS src, o_orderpriority AS dst, COUNT(*) AS n, {MONEY.format('o_totalprice')} AS amount FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2")
def flows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).withColumn("m", F.col("o_totalprice").cast("decimal(18,2)"))
    return A.edges(o, "c_mktsegment", "o_orderpriority", "m").withColumn("amount", F.col("amount").cast("double"))


@query("anl12_basket", "WITH p AS (SELECT l_returnflag AS item, l_linestatus, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS m, AVG(l_quantity) AS price FROM lineitem GROUP BY 1, 2, 3), c AS (SELECT l_linestatus, m, SUM(price * CASE item WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 3 END) AS cost FROM p GROUP BY 1, 2) SELECT l_linestatus, m, ROUND(cost, 4) AS cost, ROUND((cost - LAG(cost, 12) OVER w) / LAG(cost, 12) OVER w, 4) AS change FROM c WINDOW w AS (PARTITION BY l_linestatus ORDER BY m)")
def basket(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy((F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("m"), "l_linestatus", F.col("l_returnflag").alias("item")).agg(F.avg("l_quantity").alias("price"))
    w = spark.createDataFrame([("A", 2.0), ("N", 1.0), ("R", 3.0)], "item string, weight double")
    return A.basket(p, w, "item", "m", ("l_linestatus",)).select("l_linestatus", "m", F.round("cost", 4).alias("cost"), F.round("change", 4).alias("change"))


_SHOWN = "regexp_replace(regexp_replace(format('{:,.2f}', CAST(round(CAST(o_totalprice AS DECIMAL(22,2)), 2) AS DOUBLE)), '0+$', ''), '\\.$', '')"
_LABEL = "CASE o_orderkey % 4 WHEN 0 THEN 'FY 2082/83' WHEN 1 THEN 'Mid-Chait 2082' WHEN 2 THEN 'FY 2082/83 9M (Shrawan–Chait)' ELSE 'sometime' END"


@query("led1_led2_claims", f"""SELECT o_orderkey, 'orders-2082-83-' || CASE o_orderkey % 4 WHEN 1 THEN 'monthly' WHEN 2 THEN 'nine-months-cumulative' ELSE 'annual' END AS slug, CASE WHEN o_orderkey % 9 = 0 THEN 'verified_by: must not be empty' END AS error,
CASE WHEN o_orderkey % 9 <> 0 THEN 'Orders for ' || {_LABEL} || ': ' || {_SHOWN} || ' NPR.' || CASE WHEN o_orderkey % 2 = 0 THEN ' (provisional)' ELSE '' END END AS text_en,
CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 3 <> 0 THEN 'अर्डर ' || {_LABEL} || ': ' || {_SHOWN} || ' NPR।' END AS text_ne,
CASE WHEN o_orderkey % 9 = 0 THEN 'text_en' WHEN o_orderkey % 5 = 0 THEN 'indicator_id' WHEN o_orderkey % 7 = 0 THEN 'publication_ad' END AS fault FROM orders""")
def claims(spark, sf_dir):
    k = F.pmod("o_orderkey", F.lit(4))
    v = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit("orders").alias("indicator_slug"), F.lit("Orders").alias("name_en"), F.when(F.col("o_orderkey") % 3 != 0, "अर्डर").alias("name_ne"), F.lit("NPR").alias("unit"), F.when(F.col("o_orderkey") % 2 == 0, "Preliminary desk").otherwise("Desk").alias("agency"),
        F.col("o_totalprice").cast("string").alias("value"), F.lit("C").alias("grade"), F.lit("2082/83").alias("fiscal_year_bs"), F.when(k == 1, "monthly").when(k == 2, "nine_months_cumulative").otherwise("annual").alias("period_type"),
        F.when(k == 0, "fy 2082/83").when(k == 1, "Chaitra 2082").when(k == 2, "Nine months 2082/83").otherwise("sometime").alias("period_bs"), F.when(F.col("o_orderkey") % 9 == 0, " ").otherwise("me").alias("verified_by"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("publication_ad"), F.lit("2083 Baisakh 28").alias("publication_bs"),
        F.lit("0f8fad5b-d9cb-469f-a165-70867728950e").alias("value_id"), F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise("0f8fad5b-d9cb-469f-a165-70867728950e").alias("indicator_id"), F.lit("0f8fad5b-d9cb-469f-a165-70867728950e").alias("document_id"),
    )
    return A.claims(v).select("o_orderkey", "slug", "error", "text_en", "text_ne", A.claim_fault().alias("fault"))


@query("led3_ledger_entries", """WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS t FROM orders), y AS (SELECT *, 2049 + t // 365 AS bs, t % 365 AS doy FROM x), z AS (SELECT *, LEAST(doy // 30, 11) AS m FROM y)
SELECT o_orderkey, 'Published: ' || ['Baisakh','Jestha','Ashadh','Shrawan','Bhadra','Ashwin','Kartik','Mangsir','Poush','Magh','Falgun','Chait'][m + 1] || ' ' || (doy - m * 30 + 1) || ', ' || bs || ' BS (' || strftime(d, '%b %-d, %Y') || ' AD). Period: Q2 FY 2082/83.' AS entry FROM z""")
def ledger(spark, sf_dir):
    """Days of publication in both calendars; the month table is a stand-in whose years have 365 days."""
    from factloom.functions import calendar as C

    months = spark.createDataFrame([(y, m, 35 if m == 12 else 30) for y in range(2049, 2080) for m in range(1, 13)], "bs_year int, cal_month int, days int")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("ad_date"))
    d = C.ad_to_bs(C.day_dimension(months, "1992-01-01"), o)
    return d.select("o_orderkey", C.ledger_entry(F.col("ad_date"), F.col("bs_year"), F.col("fy_month"), F.col("day"), F.lit("quarterly"), F.lit(2082), F.lit(2)).alias("entry"))


@query("led4_challenges", "SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1, 2")
def challenges(spark, sf_dir):
    return A.challenges(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderstatus")


@query("cal6_cal11_bounds", """WITH x AS (SELECT o_orderkey, o_orderkey % 9 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN DATE '2013-09-14' WHEN 1 THEN DATE '2013-10-14' WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE DATE '2013-07-16' END AS ad_start, CASE k WHEN 0 THEN DATE '2013-10-13' WHEN 1 THEN DATE '2014-01-11' WHEN 2 THEN DATE '2014-04-16' WHEN 3 THEN DATE '2014-03-12' WHEN 8 THEN DATE '2014-07-15' END AS ad_end,
CASE k WHEN 0 THEN 'Ashwin 2070' WHEN 1 THEN 'Q2 FY 2070/71' WHEN 2 THEN 'FY 2070/71 9M' WHEN 3 THEN 'FY 2070/71 YTD Falgun' WHEN 8 THEN 'FY 2070/71' END AS label,
CASE k WHEN 4 THEN 'type: daily has no bounds by fiscal year' WHEN 5 THEN 'type: seasonal has no bounds by fiscal year' WHEN 6 THEN 'ordinal: quarterly requires 1..4' WHEN 7 THEN 'ordinal: monthly requires 1..12' END AS reason,
CASE k WHEN 0 THEN 'Ashwin ''70' ELSE 'FY 2070/71' END AS axis, CASE k WHEN 0 THEN 'FY 2070/71 Ashwin' ELSE 'FY 2070/71' END AS header, CASE k WHEN 0 THEN 'असोज 2070' WHEN 2 THEN 'आ.व. 2070/71 ९M (साउन–चैत)' ELSE 'आ.व. 2070/71' END AS ne FROM x WHERE k <> 7""")
def bounds(spark, sf_dir):
    from factloom.functions import calendar as C
    from factloom.plans.validation import calendar

    k = F.pmod("o_orderkey", F.lit(9))
    kind = F.element_at(F.array(*map(F.lit, ("monthly", "quarterly", "nine_months_cumulative", "year_to_date", "daily", "seasonal", "quarterly", "monthly", "annual"))), k.cast("int") + 1)
    ordinal = F.when(k == 0, 3).when(k == 1, 2).when(k == 3, 8).when(k == 6, 5).when(k == 7, 13)
    p = table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("type"), F.lit(2070).alias("fy_start"), ordinal.alias("ordinal"), k.alias("k"))
    b = C.period_bounds(p, calendar(spark)).filter("k <> 7 and (reason is null or reason not like 'ordinal: monthly%')")
    own = (F.col("type"), F.col("fy_start"), F.col("ordinal"))
    return b.select("o_orderkey", "ad_start", "ad_end", "label", "reason", C.chart_axis(*own).alias("axis"), C.table_header(*own).alias("header"), C.label_ne(*own).alias("ne"))


@query("cal2_cal4_bs_dates", "WITH x AS (SELECT o_orderkey, o_orderkey % 36 AS d FROM orders) SELECT o_orderkey, CASE WHEN d BETWEEN 1 AND 35 THEN DATE '2014-03-13' + CAST(d - 1 AS INTEGER) END AS ad_date, '2071/72' AS current_year FROM x")
def bs_dates(spark, sf_dir):
    from factloom.functions import calendar as C
    from factloom.plans.validation import calendar

    months = spark.createDataFrame([(y, m, 35 if m == 12 else 30) for y in range(2070, 2075) for m in range(1, 13)], "bs_year int, cal_month int, days int")
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(2070).alias("bs_year"), F.lit(9).alias("fy_month"), F.pmod("o_orderkey", F.lit(36)).cast("int").alias("day"))
    now = C.current_fiscal_year(calendar(spark), "2014-07-16").select(F.col("label").alias("current_year"))
    return C.bs_to_ad(months, d, "2013-04-17").select("o_orderkey", "ad_date").join(F.broadcast(now))


@query("ocr4_cell_texts", "SELECT p_partkey, 'नगरपालिका ' || p_size AS normalized, CAST(p_size AS VARCHAR) AS arabic, translate(CAST(p_size AS VARCHAR), '0123456789', '०१२३४५६७८९') AS devanagari FROM part")
def cell_texts(spark, sf_dir):
    c = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("नगरपाललका "), F.col("p_size").cast("string")).alias("text"))
    return A.cell_texts(c).select("p_partkey", "normalized", "arabic", "devanagari")


@query("led4_retired", "SELECT o_custkey, o_orderkey, LEAD(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS retired_at FROM orders")
def retired(spark, sf_dir):
    return A.retired(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


ALL_BOXES = "SELECT l_orderkey * 10 + l_linenumber AS cell_id, CAST(FLOOR(l_orderkey / 30) AS BIGINT) AS page, l_suppkey % 2 AS tile_id, (l_partkey * 7) % 500 AS page_x, (l_partkey * 13) % 300 AS page_y, 20 + l_linenumber AS w, 10 + l_linenumber AS h, l_discount * 4 AS confidence FROM lineitem"


OVERLAPS = f"WITH b AS ({ALL_BOXES}), j AS (SELECT l.page, l.cell_id AS left_id, r.cell_id AS right_id, least(l.page_x + l.w, r.page_x + r.w) - greatest(l.page_x, r.page_x) AS ww, least(l.page_y + l.h, r.page_y + r.h) - greatest(l.page_y, r.page_y) AS hh, l.w * l.h + r.w * r.h AS area, l.confidence - r.confidence AS d FROM b l JOIN b r ON l.page = r.page AND l.cell_id < r.cell_id AND l.tile_id <> r.tile_id) SELECT page, left_id, right_id, ROUND(CAST(ww * hh AS DOUBLE) / (area - ww * hh), 6) AS iou, CASE WHEN d >= 0.1 THEN 'left' WHEN -d >= 0.1 THEN 'right' ELSE 'review' END AS resolution FROM j WHERE ww > 0 AND hh > 0 AND CAST(ww * hh AS DOUBLE) / (area - ww * hh) >= 0.2"


@query("ocr3_jn11_overlaps_all", OVERLAPS)
@query("ocr3_jn11_overlaps", OVERLAPS)
def overlaps_all(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return A.overlaps(spark.sql(ALL_BOXES), least=0.2).withColumn("iou", F.round("iou", 6))


@query("ocr1_ocr2_page_boxes", "SELECT l_orderkey, l_linenumber, l_linenumber * 5 + l_suppkey AS page_x, LEAST(l_linenumber * 5, l_linenumber * 3, 100 - l_linenumber * 5 - 8, 80 - l_linenumber * 3 - 6) AS seam FROM lineitem")
def boxes(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("tile_id"), (F.col("l_linenumber") * 5).alias("x"), (F.col("l_linenumber") * 3).alias("y"), F.lit(8).alias("w"), F.lit(6).alias("h"))
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tile_id"), F.col("s_suppkey").alias("offset_x"), F.lit(0).alias("offset_y"), F.lit(100).alias("width"), F.lit(80).alias("height"))
    return A.page_boxes(c, t).select("l_orderkey", "l_linenumber", "page_x", "seam")


@query("src4_document_text", "SELECT conv_id, regexp_replace(string_agg(COALESCE(text, ''), chr(10) ORDER BY turn, text), '-\\s*\\n\\s*', '', 'g') AS text FROM conversations GROUP BY conv_id")
def document_text(spark, sf_dir):
    from factloom.sources.readers import document_text as read

    return read(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "text")


@query("src5_flt7_links", """SELECT page_id, 0 AS pos, 'https://h' || page_id || '.org/x/1.pdf?v=1' AS url, 'One & more' AS text FROM pages UNION ALL SELECT page_id, 1, 'https://h' || page_id || '.org/c/2.PDF', 'Two' FROM pages""")
def links(spark, sf_dir):
    """A page for each id: two documents, one of them again, and links that aren't documents."""
    from factloom.sources.html import links as scan

    i = F.col("page_id").cast("string")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://h"), i, F.lit(".org/c/d?e")).alias("url"), F.lit('<a href="/x/1.pdf?v=1">One &amp;  more</a><p><a class=k href=\'2.PDF\'><b>Two</b></a> <a href="/p.html">no</a><a href="/x/1.pdf?v=1">again</a>').alias("html"))
    return scan(p, "url", "html")


@query("src5_all_links")
def all_links(spark, sf_dir):
    """All links of the pages given, whatever they lead to; a test holds them against another parser."""
    from factloom.sources.html import links as scan

    return scan(table(spark, sf_dir, "pages"), "url", "html", lambda h: h != "")


@query("src3_sheets", "SELECT 'n' || s_nationkey AS doc_id, CASE WHEN s_nationkey % 4 = 0 THEN 'expected sheet C5 not present' END AS error, CASE WHEN s_nationkey % 4 <> 0 THEN 4 * COUNT(*) + 5 END AS cells FROM supplier GROUP BY s_nationkey")
def sheets(spark, sf_dir):
    from factloom.sources.readers import sheet_of

    c = grant_cells(spark, sf_dir).withColumn("sheet", F.when(F.substring("doc_id", 2, 9).cast("int") % 4 == 0, "C6").otherwise("C5"))
    own, lost = sheet_of(c, "C5")
    return own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cells")).withColumn("error", F.lit(None).cast("string")).unionByName(lost.withColumn("cells", F.lit(None).cast("bigint"))).select("doc_id", "error", "cells")


@query("src7_rules", "SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'shape' WHEN 2 THEN 'shape' WHEN 3 THEN 'not_json' END AS error FROM events")
def decode_rules(spark, sf_dir):
    from factloom.sources.readers import decoded

    k = F.pmod("event_id", F.lit(4))
    p = F.when(k == 0, '{"code": "00000012", "grade": "A", "name": "abc"}').when(k == 1, '{"code": "12", "grade": "A", "name": "abc"}').when(k == 2, '{"code": "00000012", "grade": "E", "name": "abc"}').otherwise("[")
    rules = {"code": lambda v: v.rlike("^[0-9]{8}$"), "grade": lambda v: v.isin("A", "B", "C"), "name": lambda v: F.length(v) >= 3}
    return table(spark, sf_dir, "events").select("event_id", decoded(p, "code string, grade string, name string", ["code"], rules)["error"].alias("error"))


@query("src11_registry_faults", "SELECT 's' || s_suppkey || CASE WHEN s_suppkey % 5 = 0 THEN '_' ELSE '-x' END AS source_id, unnest(list_filter([CASE WHEN s_suppkey % 5 = 0 THEN 'source_id: bad shape' END, CASE WHEN s_suppkey % 7 = 0 THEN 'tier: below 1' END, CASE WHEN s_suppkey % 2 = 0 THEN 'agency: missing' END], lambda x: x IS NOT NULL)) AS fault FROM supplier")
def registry_faults(spark, sf_dir):
    from factloom.sources.readers import registry_faults as faults

    k = F.col("s_suppkey")
    r = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string"), F.when(k % 5 == 0, "_").otherwise("-x")).alias("source_id"), F.when(k % 7 == 0, 0).when(k % 3 == 0, 2).alias("tier"), F.lit("auto").alias("mode"), F.when(k % 2 == 0, " ").otherwise("NRB").alias("agency"), F.lit("d").alias("dataset"), F.lit("monthly").alias("frequency"))
    return faults(r)


@query("src7_json_decode", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CASE WHEN event_id % 5 = 0 THEN 'not_json' WHEN event_id % 5 = 1 THEN 'shape' END AS error FROM (SELECT event_id, CASE WHEN event_id % 5 > 1 THEN props END AS props FROM events) x")
def decode(spark, sf_dir):
    from factloom.sources.readers import decoded

    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "{oops").when(F.col("event_id") % 5 == 1, '{"z": 1}').otherwise(F.col("props")).alias("p"))
    return e.select("event_id", decoded(F.col("p"), "k int", ["k"]).alias("d")).select("event_id", "d.value.k", "d.error")


@query("src8_canonical_dimension", "SELECT lpad(CAST(s_suppkey + 100 AS VARCHAR), 8, '0') AS federal_code, s_name AS name_en, CASE WHEN s_suppkey % 2 = 0 THEN 'municipality' ELSE 'rural_municipality' END AS local_level_type FROM supplier WHERE s_suppkey % 3 <> 0")
def dimension(spark, sf_dir):
    from factloom.sources.readers import canonical_dimension

    k = F.col("s_suppkey")
    raw = table(spark, sf_dir, "supplier").select(F.when(k % 6 == 0, "x").otherwise((k + 100).cast("string")).alias("code"), F.concat(F.lit(" "), "s_name").alias("name_en"), F.lit("नाम").alias("name_ne"), F.lit("D").alias("district"), F.when(k % 6 == 3, "Ward").when(k % 2 == 0, "Municipality").otherwise("Rural Municipality").alias("type"))
    return canonical_dimension(raw).select("federal_code", "name_en", "local_level_type")


@query("jsn1_agg11_payload", """SELECT o_custkey, COUNT(*) AS n, right('{"status":"success","rows":' || COUNT(*) || ',"tail":"' || repeat('x', CAST(COUNT(*) * 3 AS INTEGER)) || '"}', 60) AS payload, '{"o_custkey":' || o_custkey || ',"n":' || COUNT(*) || ',"at":"2026-05-08T00:00:00+00:00","note":null}' AS draft FROM orders GROUP BY o_custkey""")
def payload(spark, sf_dir):
    import datetime

    from factloom.operators.staging import drafts_json

    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    at = F.lit(datetime.datetime(2026, 5, 8, tzinfo=datetime.UTC))
    d = drafts_json(g.select("o_custkey", "n", at.alias("at"), F.lit(None).cast("string").alias("note")))
    d = d.withColumn("o_custkey", F.get_json_object("draft", "$.o_custkey").cast("bigint"))
    crumb = T.breadcrumb(60, status=F.lit("success"), rows=F.col("n"), tail=F.repeat(F.lit("x"), (F.col("n") * 3).cast("int")))
    return g.select("o_custkey", "n", crumb.alias("payload")).join(d, "o_custkey")


@query("cal1_cal6_day_dimension", """WITH x AS (SELECT date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS t FROM orders), y AS (SELECT 2049 + t // 365 AS bs, LEAST((t % 365) // 30, 11) AS m FROM x), z AS (SELECT CAST(CASE WHEN m >= 3 THEN bs ELSE bs - 1 END AS INTEGER) AS fy_start, CAST((m + 9) % 12 + 1 AS INTEGER) AS ordinal, bs, m FROM y)
SELECT fy_start, ordinal, COUNT(*) AS n, DATE '1992-01-01' + CAST((MIN(bs) - 2049) * 365 + MIN(m) * 30 AS INTEGER) AS ad_start, DATE '1992-01-01' + CAST((MIN(bs) - 2049) * 365 + MIN(m) * 30 + CASE WHEN MIN(m) = 11 THEN 34 ELSE 29 END AS INTEGER) AS ad_end FROM z GROUP BY 1, 2""")
def days(spark, sf_dir):
    """Orders by fiscal year and month through a day dimension, and the bounds of each month; the month table is a stand-in whose years have 365 days."""
    from factloom.functions.calendar import day_dimension, period_bounds

    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("ad_date"))
    months = spark.createDataFrame([(y, m, 35 if m == 12 else 30) for y in range(2049, 2080) for m in range(1, 13)], "bs_year int, cal_month int, days int")
    d = day_dimension(months, "1992-01-01")
    p = o.join(F.broadcast(d), "ad_date").groupBy("fy_start", "fy_month").agg(F.count(F.lit(1)).alias("n")).select("fy_start", F.lit("monthly").alias("type"), F.col("fy_month").alias("ordinal"), "n")
    return period_bounds(p, d).select("fy_start", "ordinal", "n", "ad_start", "ad_end")


@query("prj1_prj2_prj3_projections", "SELECT o_orderkey, CAST(o_orderkey * 2 AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS notes, 'd1' AS document_id, 'B' AS grade, 0 AS revision, 'NPR' AS unit FROM orders")
def projections(spark, sf_dir):
    from factloom.operators import staging as S

    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 2).alias("value"), F.lit("B").alias("grade_proposed"))
    return S.stamped(S.approved(S.staged(o, "r1", "d1"), F.lit(0)), unit="NPR")


@query("flt5_flt6_srt6_listings", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '5-LOW' AND NOT (o_orderstatus = 'F') AND o_orderkey % 3 <> 0 ORDER BY o_orderkey LIMIT 50")
def listings(spark, sf_dir):
    from factloom.operators import staging as S

    o = table(spark, sf_dir, "orders")
    f = S.unresolved(S.matching(o, o_orderpriority="5-LOW", o_orderstatus=None).withColumn("resolved_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))))
    return S.capped(f, o.filter("o_orderkey % 3 = 0"), ["o_orderkey"], ["o_orderkey"], 50).select("o_orderkey", "o_custkey")


@query("snk13_jsn2_arr1_records", """SELECT c_custkey, '{"name":"' || c_name || '","kind":"' || c_mktsegment || '"}' AS meta, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS n_modes, '{"discovered":{"c_custkey":' || c_custkey || '},"archived":{"c_custkey":' || c_custkey || ',"c_nationkey":' || c_nationkey || '}}' AS record FROM customer""")
def records(spark, sf_dir):
    from factloom.operators import staging as S

    c = table(spark, sf_dir, "customer")
    modes = S.array_or_empty(F.when(F.col("c_custkey") % 2 == 0, F.array("c_name")))
    side = S.sidecar(c.select("c_custkey"), c.select("c_custkey", "c_nationkey"), "c_custkey")
    return c.select("c_custkey", S.metadata(name=F.col("c_name"), kind=F.col("c_mktsegment")).alias("meta"), F.size(modes).alias("n_modes")).join(side, "c_custkey")
