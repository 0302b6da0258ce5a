"""Queries of hierarchies, delimited texts, containers of links, null-safe sinks and conflicting uploads, with their SQL."""

from pyspark.sql import functions as F

from factloom.operators import hierarchy as H, tables as T
from factloom.plans.registry import query
from factloom.plans.scalars import table


def entities(spark, sf_dir):
    """World, regions, nations, market segments of nations, customers (suppliers stand right below their nation); every 97th customer is one of a pair that are each other's parents, with an order below it; every 89th has a parent that isn't there."""
    s = lambda c: F.col(c).cast("string")
    k = F.col("c_custkey")
    segment = F.concat(F.lit("s"), s("c_nationkey"), F.lit("-"), "c_mktsegment")
    parent = F.when(k % 97 == 0, F.concat(F.lit("pair"), s("c_custkey"))).when(k % 89 == 0, F.lit("nowhere")).otherwise(segment)
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    parts = (
        spark.createDataFrame([("world", None)], "id string, parent string"),
        table(spark, sf_dir, "region").select(F.concat(F.lit("r"), s("r_regionkey")), F.lit("world")),
        table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), s("n_nationkey")), F.concat(F.lit("r"), s("n_regionkey"))),
        c.select(segment, F.concat(F.lit("n"), s("c_nationkey"))).distinct(),
        c.select(F.concat(F.lit("c"), s("c_custkey")), parent),
        c.filter("c_custkey % 97 = 0").select(F.concat(F.lit("pair"), s("c_custkey")), F.concat(F.lit("c"), s("c_custkey"))),
        table(spark, sf_dir, "supplier").select(F.concat(F.lit("u"), s("s_suppkey")), F.concat(F.lit("n"), s("s_nationkey"))),
        o.filter("o_custkey % 97 = 0").select(F.concat(F.lit("o"), s("o_orderkey")), F.concat(F.lit("c"), s("o_custkey"))),
    )
    out, *rest = parts
    for p in rest:
        out = out.union(p)
    return out


_NODES = """e AS (SELECT 'world' AS id, NULL AS parent UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT DISTINCT 's' || c_nationkey || '-' || c_mktsegment, 'n' || c_nationkey FROM customer
UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 97 = 0 THEN 'pair' || c_custkey WHEN c_custkey % 89 = 0 THEN 'nowhere' ELSE 's' || c_nationkey || '-' || c_mktsegment END FROM customer UNION ALL SELECT 'pair' || c_custkey, 'c' || c_custkey FROM customer WHERE c_custkey % 97 = 0
UNION ALL SELECT 'u' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders WHERE o_custkey % 97 = 0),
w(id, ancestor, depth) AS (SELECT e.id, e.parent, 1 FROM e JOIN e p ON p.id = e.parent UNION ALL SELECT w.id, e.parent, w.depth + 1 FROM w JOIN e ON e.id = w.ancestor JOIN e p ON p.id = e.parent WHERE w.depth < 12),
bad AS (SELECT DISTINCT id FROM w WHERE depth = 12)"""


@query("jn9_ancestors", f"WITH RECURSIVE {_NODES} SELECT id, ancestor, depth FROM w WHERE id NOT IN (SELECT id FROM bad)")
def ancestors(spark, sf_dir):
    return H.hierarchy(entities(spark, sf_dir))[0]


@query("jn9_broken_nodes", f"WITH RECURSIVE {_NODES} SELECT id, 'cycle' AS fault FROM bad UNION ALL SELECT id, 'lost parent' FROM e WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM e)")
def broken(spark, sf_dir):
    return H.hierarchy(entities(spark, sf_dir))[1]


@query("agg10_tree_rollup", f"""WITH RECURSIVE {_NODES}, v AS (SELECT 'c' || c_custkey AS id, CAST(c_acctbal AS DECIMAL(18,2)) AS value FROM customer UNION ALL SELECT 'u' || s_suppkey, CAST(s_acctbal AS DECIMAL(18,2)) FROM supplier),
t AS (SELECT id, value FROM v UNION ALL SELECT w.ancestor, value FROM v JOIN w USING (id) WHERE id NOT IN (SELECT id FROM bad))
SELECT id, CAST(SUM(value) AS DOUBLE) AS total, COUNT(*) AS n FROM t GROUP BY id""")
def tree_rollup(spark, sf_dir):
    own = lambda t, k, m, v: table(spark, sf_dir, t).select(F.concat(F.lit(m), F.col(k).cast("string")).alias("id"), F.col(v).cast("decimal(18,2)").alias("value"))
    v = own("customer", "c_custkey", "c", "c_acctbal").unionByName(own("supplier", "s_suppkey", "u", "s_acctbal"))
    return H.rolled_up_tree(v, H.hierarchy(entities(spark, sf_dir))[0]).withColumn("total", F.col("total").cast("double"))


@query("src1_two_mode", """WITH c AS (SELECT c_custkey, c_custkey % 2 = 0 AS a, c_custkey % 3 AS k, c_name, c_mktsegment FROM customer)
SELECT c_custkey, CASE WHEN a THEN 'A' ELSE 'B' END AS mode, 0 AS row_idx, 'code|name|phone|note' AS cells, NULL AS error FROM c UNION ALL
SELECT c_custkey, CASE WHEN a THEN 'A' ELSE 'B' END, 1, CASE k WHEN 0 THEN '|' || c_name || ', Ltd|' || c_mktsegment || '|' WHEN 1 THEN '|say "' || c_name || '"||' || c_mktsegment ELSE c_name || '|||two' || chr(10) || 'lines' END, NULL FROM c""")
def two_mode(spark, sf_dir):
    """A file for each customer, of either mode: a row with an empty first cell, doubled quotes, or a line end in its last cell."""
    from factloom.sources.delimited import two_mode as scan

    k, name, phone = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    row = F.when(k % 3 == 0, F.concat(F.lit(',"'), name, F.lit(', Ltd",'), phone)).when(k % 3 == 1, F.concat(F.lit(',"say ""'), name, F.lit('""","",'), phone)).otherwise(F.concat(name, F.lit(',,,"two\nlines"')))
    prelude = F.when(k % 2 == 0, ',,,"Table 1"\r\n,\r\na,b\r\n"x\ny",\r\n\r\n').otherwise("﻿")
    text = F.concat(prelude, F.lit("code, name ,phone,note\r\n"), row, F.when(k % 5 > 0, "\r\n").otherwise(""))
    files = table(spark, sf_dir, "customer").select("c_custkey", F.encode(text, "UTF-8").alias("content"))
    return scan(files, "c_custkey", "content").withColumn("cells", F.array_join("cells", "|"))


@query("str15_containers", """SELECT page_id, 0 AS pos, 'a.pdf' AS href, 'A' AS text, 'outer ' || page_id || ' A inner B' AS near, 'Page ' || page_id AS name FROM pages UNION ALL SELECT page_id, 1, 'b.pdf?x=1&y=2', 'B', 'inner B', 'Page ' || page_id FROM pages
UNION ALL SELECT page_id, 2, 'c.pdf', 'C & more', 'next C & more', 'Page ' || page_id FROM pages UNION ALL SELECT page_id, 3, 'd.pdf', '', 'cell 2024-10-12', 'Page ' || page_id FROM pages""")
def containers(spark, sf_dir):
    """Nested lists, items without an end, an attribute without quotes, a link in a comment, an empty link in a table's row, a heading in a heading."""
    from factloom.sources.html import anchors

    i = F.col("page_id").cast("string")
    html = F.concat(
        F.lit("<h1><span> Page <b>"), i, F.lit("</b></span></h1><ul><li>outer "), i, F.lit(" <a class=k href=a.pdf>A</a><ul><li>inner <a href='b.pdf?x=1&amp;y=2'>B</a></ul><li>next <!-- <a href=\"no.pdf\">no</a> --><a href=\"c.pdf\">C &amp; more</a></ul>"),
        F.lit("<script>var x = '<a href=\"js.pdf\">';</script><table><tr><td>cell<td>2024-10-12 <a HREF = d.pdf></a></table>"),
    )
    return anchors(table(spark, sf_dir, "pages").select("page_id", html.alias("html")), "html")


@query("snk3_snk7_null_keys", """WITH o AS (SELECT CASE WHEN o_orderkey % 10 < 9 THEN o_orderkey END AS k, o_orderkey % 10 AS m, o_orderstatus AS v FROM orders WHERE o_orderkey % 10 < 9 OR o_orderkey = (SELECT MIN(o_orderkey) FROM orders WHERE o_orderkey % 10 = 9))
SELECT k, CASE WHEN k IS NULL OR m = 3 THEN 'new' ELSE v END AS v FROM o WHERE COALESCE(m <> 4, TRUE) UNION ALL SELECT -k, 'new' FROM o WHERE m = 3""")
def null_keys(spark, sf_dir):
    """The row whose key is null is updated once by a batch that has a null key, and not doubled; another is deleted by key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 10).alias("m"), F.col("o_orderstatus").alias("v"))
    least = o.filter("m = 9").agg(F.min("o_orderkey").alias("o_orderkey"))
    t = o.filter("m < 9").unionByName(o.join(least, "o_orderkey")).select(F.when(F.col("m") < 9, F.col("o_orderkey")).alias("k"), "m", "v")
    three = t.filter("m = 3")
    batch = three.select("k").unionByName(three.select((-F.col("k")).alias("k"))).unionByName(spark.createDataFrame([(None,)], "k long")).withColumn("v", F.lit("new"))
    gone = t.filter("m = 4").select("k").unionByName(spark.createDataFrame([(-1,)], "k long"))
    return T.delete_keys(T.upsert(t.select("k", "v"), batch, ["k"], ["v"]), gone, ["k"])


@query("snk10_batch_conflicts", """SELECT o_orderkey, CASE WHEN o_orderkey = MIN(o_orderkey) OVER (PARTITION BY o_custkey) THEN CASE WHEN o_custkey % 4 = 0 THEN 'conflict' ELSE 'new' END WHEN o_custkey % 4 = 0 THEN 'conflict' WHEN o_orderstatus = FIRST_VALUE(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) THEN 'reuse' ELSE 'conflict' END AS status FROM orders""")
def batch_conflicts(spark, sf_dir):
    """Uploads of a customer's key one after the other, their status as content; the catalog has other bytes for every fourth key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("hash"))
    catalog = o.filter("key % 4 = 0").select("key", F.lit("other").alias("hash"))
    return T.archive_status(o, catalog, order=["o_orderkey"]).select("o_orderkey", "status")
