"""Queries of string, number and calendar functions, with their SQL."""

from pyspark.sql import functions as F

from factloom.functions import calendar as C, text as X
from factloom.plans.registry import query


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("str3_str4_str5_numerals", """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'वडा ' || o_orderkey WHEN 1 THEN translate('Ward ' || o_orderkey, '0123456789', '०१२३४५६७८९') WHEN 2 THEN 'x' ELSE o_orderkey || ' १' END AS s FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(s, '[०-९]') AND regexp_matches(s, '[0-9]') THEN 'mixed' WHEN regexp_matches(s, '[०-९]') THEN 'devanagari' WHEN regexp_matches(s, '[0-9]') THEN 'arabic' ELSE 'none' END AS script,
translate(s, '०१२३४५६७८९', '0123456789') AS arabic, translate(s, '0123456789', '०१२३४५६७८९') AS devanagari, NULLIF(translate(regexp_replace(s, '[^0-9०-९]', '', 'g'), '०१२३४५६७८९', '0123456789'), '') AS digits FROM x""")
def numerals(spark, sf_dir):
    k, s = F.pmod("o_orderkey", F.lit(4)), F.col("o_orderkey").cast("string")
    t = F.when(k == 0, F.concat(F.lit("वडा "), s)).when(k == 1, X.to_devanagari(F.concat(F.lit("Ward "), s))).when(k == 2, "x").otherwise(F.concat(s, F.lit(" १")))
    d = table(spark, sf_dir, "orders").select("o_orderkey", t.alias("s"))
    return d.select("o_orderkey", X.numeral_script(F.col("s")).alias("script"), X.to_arabic(F.col("s")).alias("arabic"), X.to_devanagari(F.col("s")).alias("devanagari"), X.both_numerals(F.col("s"))["arabic"].alias("digits"))


WRONG = ",".join(wrong for wrong, right in X.OCR_SUBSTITUTIONS)
_FIXED = "concat(split_part('" + WRONG + "', ',', CAST(p_partkey % " + str(len(X.OCR_SUBSTITUTIONS)) + " + 1 AS INTEGER)), ' वडा')"
_ORDERED = _FIXED
for _wrong, _right in X.OCR_SUBSTITUTIONS:
    _ORDERED = f"replace({_ORDERED}, '{_wrong}', '{_right}')"


@query("str1_str2_devanagari", f"""WITH x AS (SELECT p_partkey, {_ORDERED} AS fixed, CASE p_size % 3 WHEN 0 THEN 'नगर१२३ ab' WHEN 1 THEN 'गाउँ abcd' ELSE p_name END AS s FROM part)
SELECT p_partkey, fixed, length(regexp_replace(s, '[^ऀ-॥॰-ॿ]', '', 'g')) * 2 > length(regexp_replace(s, '\\s', '', 'g')) AS dominant FROM x""")
def devanagari(spark, sf_dir):
    """Every substitution's wrong text through the ordered list, and texts of two scripts around the half."""
    k = F.pmod("p_size", F.lit(3))
    wrong = F.split_part(F.lit(WRONG), F.lit(","), (F.pmod("p_partkey", F.lit(len(X.OCR_SUBSTITUTIONS))) + 1).cast("int"))
    d = table(spark, sf_dir, "part").select("p_partkey", F.concat(wrong, F.lit(" वडा")).alias("w"), F.when(k == 0, "नगर१२३ ab").when(k == 1, "गाउँ abcd").otherwise(F.col("p_name")).alias("s"))
    return d.select("p_partkey", X.normalize_devanagari(F.col("w")).alias("fixed"), X.is_devanagari_dominant(F.col("s")).alias("dominant"))


@query("str6_str7_str8_str9_slugs", """SELECT p_partkey, trim(regexp_replace(lower(p_brand || '-' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, lower(replace(p_type, ' ', '_') || '-2082-83-' || replace('nine_months', '_', '-')) AS claim,
trim(regexp_replace('  ' || p_name || '   x ', '\\s+', ' ', 'g')) AS squashed, regexp_replace(p_brand || ' ' || p_name, '[^A-Za-z0-9._-]', '_', 'g') AS file FROM part""")
def slugs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        X.slugify(F.col("p_brand"), F.col("p_name")).alias("slug"),
        X.claim_slug(F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("2082/83"), F.lit("nine_months")).alias("claim"),
        X.squash(F.concat(F.lit("  "), "p_name", F.lit("   x "))).alias("squashed"),
        X.file_name(F.concat_ws(" ", "p_brand", "p_name")).alias("file"),
    )


@query("str10_shapes", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN FALSE WHEN 3 THEN FALSE ELSE regexp_matches(o_orderpriority, '^[a-z0-9][a-z0-9-]{2,}$') END AS id_ok,
CASE o_orderkey % 3 WHEN 0 THEN TRUE ELSE FALSE END AS time_ok FROM orders""")
def shapes(spark, sf_dir):
    k, t = F.pmod("o_orderkey", F.lit(5)), F.pmod("o_orderkey", F.lit(3))
    name = F.when(k == 0, "nrb-bfi").when(k == 1, "ab").when(k == 2, "a_b_c").when(k == 3, "-abc").otherwise(F.col("o_orderpriority"))
    at = F.when(t == 0, "2024-01-02T00:00:00Z").when(t == 1, "2024-01-02").otherwise("2024/01/02T00")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.is_source_id(name).alias("id_ok"), X.is_iso_timestamp(at).alias("time_ok"))


@query("str11_page_urls", "SELECT page_id, n, CASE WHEN n = 1 THEN url WHEN contains(url, '?') THEN url || '&page=' || n ELSE url || '?page=' || n END AS page_url FROM pages, (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS n) r")
def page_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(X.page_urls(F.col("url"), 3)).alias("n", "page_url")).select("page_id", (F.col("n") + 1).alias("n"), "page_url")


@query("str12_str13_urls", """SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/a/b.pdf' AS rooted, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(.*/)[^/]*$', 1) || 'b.pdf' AS relative, 'http://a/' || CASE page_id % 4 WHEN 0 THEN 'b/c/g' WHEN 1 THEN 'b/g?y=./x' WHEN 2 THEN 'g/' ELSE 'b/c/' || page_id || '/h#s/../x' END AS dotted, regexp_extract(url || '/category/' || page_id || '/x', '/category/([0-9]+)', 1) AS category FROM pages""")
def urls(spark, sf_dir):
    u, k = F.col("url"), F.pmod("page_id", F.lit(4))
    dotted = F.when(k == 0, "./g").when(k == 1, "../g?y=./x").when(k == 2, "../../../g/x/..").otherwise(F.concat(F.lit("x/.././"), F.col("page_id").cast("string"), F.lit("/./h#s/../x")))
    return table(spark, sf_dir, "pages").select("page_id", X.absolute_url(F.lit("http://a/b/c/d;p?q"), dotted).alias("dotted"), X.absolute_url(u, F.lit("/a/b.pdf")).alias("rooted"), X.absolute_url(u, F.lit("b.pdf")).alias("relative"), X.category_id(F.concat(u, F.lit("/category/"), F.col("page_id").cast("string"), F.lit("/x"))).alias("category"))


@query("str14_titles", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Head ' || page_id || ' & more' WHEN 1 THEN 'Class ' || page_id WHEN 2 THEN 'Title ' || page_id ELSE '' END AS name, 'item ' || page_id || CASE WHEN page_id % 4 = 1 THEN ' Doc' ELSE '' END AS near FROM pages""")
def titles(spark, sf_dir):
    """STR-14 and STR-15 over made-up pages of all ids: names in three places and none, and the text around a link."""
    from factloom.sources.readers import container_text

    k, i = F.pmod("page_id", F.lit(4)), F.col("page_id").cast("string")
    head = F.when(k == 0, F.concat(F.lit("<h1 id='x'>Head <b>"), i, F.lit("</b> &amp; more</h1><title>no</title>"))).when(k == 1, F.concat(F.lit('<h1> </h1><div class="a page-title b">Class '), i, F.lit("</div>"))).when(k == 2, F.concat(F.lit("<title>\n Title  "), i, F.lit("</title>"))).otherwise("<p>none</p>")
    body = F.concat(F.lit("<ul><li>other <a href='o.pdf'>o</a></li><li>item "), i, F.lit(" <a href='d.pdf'>"), F.when(k == 1, "Doc").otherwise(""), F.lit("</a></li></ul>"))
    return table(spark, sf_dir, "pages").select("page_id", X.category_name(head).alias("name"), container_text(body, F.lit("d.pdf")).alias("near"))


@query("str16_sha256", "SELECT doc_id, sha256(text) AS hash FROM documents")
def hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("str17_provisional", "SELECT p_partkey, regexp_matches(CASE WHEN p_size % 2 = 0 THEN 'Bureau (Preliminary)' ELSE p_name END, '(?i)preliminary|provisional') AS provisional FROM part")
def provisional(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.is_provisional(F.when(F.col("p_size") % 2 == 0, "Bureau (Preliminary)").otherwise(F.col("p_name"))).alias("provisional"))


@query("num1_num2_num3_num4_numbers", """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN '..' WHEN 1 THEN 'N/A' WHEN 2 THEN '1,234.50' WHEN 3 THEN ' ' || o_orderkey || ' ' WHEN 4 THEN o_orderkey || 'd' WHEN 5 THEN o_orderkey || 'f' WHEN 6 THEN translate('' || o_orderkey, '0123456789', '०१२३४५६७८९') WHEN 7 THEN '-.5e3' ELSE 'abc' END AS s FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 6 THEN CAST(o_orderkey AS DOUBLE) WHEN trim(s) NOT IN ('', '..', '...', '-', 'NA', 'N/A') THEN TRY_CAST(trim(s) AS DOUBLE) END AS census, CAST(CASE WHEN o_orderkey % 9 = 6 THEN o_orderkey WHEN trim(replace(s, ',', '')) NOT IN ('', '-', '—', 'N/A', 'n/a') THEN TRY_CAST(trim(replace(s, ',', '')) AS DECIMAL(20,2)) END AS DOUBLE) AS amount,
CASE WHEN o_orderkey % 9 = 6 THEN CAST(o_orderkey AS DOUBLE) ELSE TRY_CAST(trim(s) AS DOUBLE) END AS plain, TRY_CAST(trim(s) AS DOUBLE) IS NOT NULL AS finite FROM x""")
def numbers(spark, sf_dir):
    k, o = F.pmod("o_orderkey", F.lit(9)), F.col("o_orderkey").cast("string")
    s = F.when(k == 0, "..").when(k == 1, "N/A").when(k == 2, "1,234.50").when(k == 3, F.concat(F.lit(" "), o, F.lit(" "))).when(k == 4, F.concat(o, F.lit("d"))).when(k == 5, F.concat(o, F.lit("f"))).when(k == 6, X.to_devanagari(o)).when(k == 7, "-.5e3").otherwise("abc")
    d = table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s"))
    c = F.col("s")
    return d.select("o_orderkey", X.census_number(c).alias("census"), X.amount(c).cast("double").alias("amount"), X.plain_number(c).alias("plain"), X.is_finite(F.trim(c)).alias("finite"))


@query("num5_display_numbers", "SELECT o_orderkey, regexp_replace(regexp_replace(format('{:,.2f}', CAST(round(CAST(o_totalprice AS DECIMAL(22,2)), 2) AS DOUBLE)), '0+$', ''), '\\.$', '') AS shown FROM orders")
def display(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.display_number(F.col("o_totalprice")).alias("shown"))


@query("num6_federal_code", "SELECT c_custkey, lpad(CAST(c_custkey * 37 AS VARCHAR), 8, '0') AS code FROM customer")
def codes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.federal_code((F.col("c_custkey") * 37).cast("string")).alias("code"))


@query("dt1_listing_dates", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 3 = 1 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders""")
def listing(spark, sf_dir):
    k, d = F.pmod("o_orderkey", F.lit(3)), F.to_date("o_orderdate")
    s = F.when(k == 0, F.concat(F.lit("Report "), F.date_format(d, "yyyy-MM-dd"), F.lit(" final"))).when(k == 1, "2024-13-45 or 2024/1/2").otherwise(F.date_format(d, "yyyy/M/d"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.listing_date(s).alias("d"))


@query("cal3_cal5_fiscal_years", """WITH x AS (SELECT o_orderkey, CAST(year(o_orderdate) + 57 AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m FROM orders), z AS (SELECT *, CASE WHEN m <= 9 THEN y ELSE y - 1 END AS s FROM x)
SELECT o_orderkey, s AS fy_start, s || '/' || lpad(CAST((s + 1) % 100 AS VARCHAR), 2, '0') AS bs, (s - 57) || '/' || lpad(CAST((s - 56) % 100 AS VARCHAR), 2, '0') AS ad FROM z""")
def fiscal(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", (F.year("o_orderdate") + 57).alias("y"), F.month("o_orderdate").alias("m"))
    s = C.fiscal_start(F.col("y"), F.col("m"))
    return d.select("o_orderkey", s.alias("fy_start"), C.label_bs(s).alias("bs"), C.label_ad(s).alias("ad"))


@query("cal8_cal9_cal10_months", """WITH x AS (SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(year(o_orderdate) + 57 AS INTEGER) AS y FROM orders), g AS (SELECT *, CAST((m + 5) % 12 + 1 AS INTEGER) AS ad FROM x)
SELECT o_orderkey, m AS idx, make_date(CASE WHEN ad >= 7 THEN y - 57 ELSE y - 56 END, ad, 15) AS mid, make_date(y - 57, 7, 15) AS nine_start, make_date(y - 56, 3, 15) AS nine_end FROM g""")
def months(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ("Saun", "bhadau", "Asoj", "KARTIK", "marg.", "Push", "magh", "phagun", "Chaitra", "vaishakha", "jeth", "Asar"))), F.month("o_orderdate"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", C.month_index(C.month_name(raw)).alias("idx"), (F.year("o_orderdate") + 57).alias("y"))
    nine = C.nine_months(F.col("y"))
    return d.select("o_orderkey", "idx", C.mid_month(F.col("idx"), F.col("y")).alias("mid"), nine["start"].alias("nine_start"), nine["end"].alias("nine_end"))


@query("cal7_cal11_periods", """WITH x AS (SELECT o_orderkey, o_orderkey % 6 AS k, CAST(year(o_orderdate) + 57 AS INTEGER) AS y, CAST((o_orderkey % 4) + 1 AS INTEGER) AS q FROM orders), f AS (SELECT *, y || '/' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS fy FROM x)
SELECT o_orderkey, CASE k WHEN 0 THEN 'nine_months_cumulative' WHEN 1 THEN 'quarterly' WHEN 2 THEN 'monthly' WHEN 3 THEN 'annual' END AS type, CASE k WHEN 2 THEN y - 1 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE y END AS fy_start, CASE k WHEN 1 THEN q WHEN 2 THEN 10 END AS ordinal,
CASE k WHEN 4 THEN 'unrecognized reporting-period label' WHEN 5 THEN 'no FY token' END AS reason, CASE k WHEN 0 THEN 'Period: FY ' || fy || ' 9M (Shrawan–Chait).' WHEN 1 THEN 'Period: Q' || q || ' FY ' || fy || '.' WHEN 2 THEN 'Period: Baisakh ' || y || '.' WHEN 3 THEN 'Period: FY ' || fy || '.' END AS line FROM f""")
def periods(spark, sf_dir):
    k, y = F.pmod("o_orderkey", F.lit(6)), F.year("o_orderdate") + 57
    fy = C.label_bs(y)
    label = (
        F.when(k == 0, F.concat(F.lit("Nine months "), fy)).when(k == 1, F.concat(F.lit("Q"), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("string"), F.lit(" FY "), fy))
        .when(k == 2, F.concat(F.lit("Mid-Baisakh  "), y.cast("string"))).when(k == 3, F.concat(F.lit("FY "), fy)).when(k == 4, "soon").otherwise("Q2")
    )
    d = table(spark, sf_dir, "orders").select("o_orderkey", C.parse_period(label).alias("p")).select("o_orderkey", "p.*")
    return d.withColumn("line", F.when(F.col("type").isNotNull(), C.ledger_line(F.col("type"), F.col("fy_start"), F.col("ordinal"))))


NARRATIVE = """WITH x AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS v, o_orderkey % 8 AS k, o_orderkey % 3 AS p FROM orders), s(i, slug) AS (VALUES (0, 'cmefs-ncpi-yoy-overall'), (1, 'cmefs-remittance-inflow-ytd'), (2, 'cmefs-merchandise-imports-ytd'), (3, 'cmefs-trade-deficit-ytd'), (4, 'cmefs-bop-surplus-ytd'), (5, 'cmefs-gross-forex-reserves'), (6, 'cmefs-forex-reserves-months-of-import-cover'))
SELECT o_orderkey, slug, CASE WHEN k = i THEN CAST(v AS DOUBLE) END AS value, CASE WHEN k = i AND p = 1 THEN 'B' WHEN k = i THEN 'A' END AS grade, CASE WHEN k = i AND i = 4 AND p = 1 THEN 'value carries inline ''P'' provisional marker; downgraded A→B; BoP in deficit (negative)' WHEN k = i AND i = 4 THEN 'BoP in deficit (negative)' WHEN k = i AND p = 1 THEN 'value carries inline ''P'' provisional marker; downgraded A→B' END AS note,
i IN (0, 5, 6) AS end_of_period, CASE WHEN k <> i THEN 'PageLayoutChanged' END AS error FROM x CROSS JOIN s"""


@query("rgx1_rgx2_rgx3_narrative", NARRATIVE)
@query("rgx1_rgx2_rgx3_narrative_all", NARRATIVE)
def narrative(spark, sf_dir):
    """Every phrase over all orders, each of which has the text of one phrase or of none; marks of provisional figures right after the figure, or too far from it."""
    from factloom.operators.extract import extract

    k, p, v = F.pmod("o_orderkey", F.lit(8)), F.pmod("o_orderkey", F.lit(3)), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    texts = (
        ("The y-o-y consumer price\ninflation in Nepal remained at ", " percent"), ("Remittance inflows increased 1.5 percent to Rs. ", " billion"), ("mercandise imports decreased 1.5 percent to Rs.", " billion"), ("Total trade deficit increased 1.5 percent to Rs ", " billion"),
        ("Balance of Payments (BOP) remained at a deficit of Rs. ", " billion"), ("Gross foreign exchange reserves 9 P Chart 3\n increased 2.5 percent to about Rs. ", " billion"), ("enough for merchandise and services imports of ", " months"),
    )
    after = F.when(p == 1, " (7 P) and").when(p == 2, " and so on as it was in the year before that 7 P").otherwise(" 7 Percent")
    t = F.lit("nothing here")
    for i, (before, unit) in enumerate(texts):
        t = F.when(k == i, F.concat(F.lit(before), v, F.lit(unit), after)).otherwise(t)
    return extract(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), t.alias("text"))).select(F.col("doc_id").alias("o_orderkey"), "slug", "value", "grade", "note", "end_of_period", "error")
