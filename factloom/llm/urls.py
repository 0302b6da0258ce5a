"""URL filters: base rules, and a path-template tree judged by smoothed labelled purity. SQL functions only.

A url's host is what stands between its first ``://`` and the next ``/``, ``?``, ``#`` or its end, A-Z lowered; its
path goes on to ``?``, ``#`` or the end. A rule fits its host and all subdomains where the path starts with the
rule's; the longest rule wins. Labels to learn from are the verdicts of rules with a path (a rule for a whole host has
judged its pages already), and block where the host or the path has a seed word.

A host's tree has all its path segments. Segments with a digit, and very long ones, are wildcards at once; a place
whose children are many and rare becomes one too. Labelled children whose rates can't be told from their parent's are
one branch; a child without labels is a branch that says nothing.

A page's purity is the blocked share of labels, smoothed at each step by ``ALPHA`` pages of the step before. It starts
from the share of seed words among the pages that no rule fits (a half at most, so that nothing goes without evidence).
Then come the same template on other hosts, a vote each, so that no large host speaks for all; the labels of the whole
host; and each branch from the first segment down, the page's own label taken out, so that no word in a path rejects a
page by itself. A label that a path has earned says nothing about its host's other paths, and a host's nothing about
paths of other hosts. Where a vote or a branch, or one above it, has labels, a page without one counts as ``FAINT``
allowed ones. A page is rejected where its purity reaches ``PURITY``: one without any such word where labels reject
its like, and one with a word not where its branch is clean.

All steps work on counts by (host, segments), so a host with most pages is one group only of what its partial counts
leave; no step loops over depths.

Defined results: a null url, or one without ``://``, has an empty host and path and no purity, fits no rule and is allowed;
a very long path has as many segments as it has, each of them judged;
repeated rows are judged one by one; rules of one length are taken in the order given; an empty table gives no row.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm._common import written

COUNTS = ("n", "host_blocked", "path_blocked", "path_allowed", "unruled", "unruled_blocked")
#: The base rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words in a host or path that mark it as unwanted, as labels to learn from.
SEEDS = ("casino", "bets", "adult", "porn", "spam", "xxx", "gambl", "viagra", "warez")
MIN_CHILDREN, PAGES_A_CHILD, ALPHA, FAINT, PURITY, Z = 10, 3.0, 0.5, 0.5, 0.7, 1.0


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; both null if none does."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _prefixes(t: DataFrame, segments: str) -> DataFrame:
    """A row for each prefix of ``segments``, from the empty one: i (its length) and node (its text); ``parent`` is the one before."""
    join = lambda k: F.array_join(F.slice(segments, 1, k), "/")
    t = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.size(segments))))
    return t.withColumn("node", F.when(F.col("i") == 0, "").otherwise(F.concat(F.lit("/"), join(F.col("i"))))).withColumn("parent", F.when(F.col("i") == 1, "").when(F.col("i") > 1, F.concat(F.lit("/"), join(F.col("i") - 1))))


def _sums(*names: str):
    return [F.sum(c).alias(c) for c in names]


def _weight(blocked: Column, allowed: Column, n: Column) -> Column:
    """Labels, and the faint ones of pages without."""
    return blocked + allowed + FAINT * (n - blocked - allowed)


def _evidence(counts: DataFrame) -> DataFrame:
    """(host, segments, prior, host_blocked, way) from ``COUNTS`` by (host, segments); way: (i, n, b, a) of each branch."""
    # Places whose children are many and rare are wildcards.
    steps = _prefixes(counts, "segments").filter("i > 0")
    children = steps.groupBy("host", "parent", F.col("node")).agg(F.sum("n").alias("n"))
    wild = children.groupBy("host", "parent").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).filter((F.col("k") >= MIN_CHILDREN) & (F.col("n") / F.col("k") < PAGES_A_CHILD))
    marks = steps.select("host", "segments", "i", "parent").join(wild.select("host", "parent", F.lit(True).alias("wild")), ["host", "parent"], "left")
    marks = marks.groupBy("host", "segments").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("wild", F.lit(False)).alias("wild")))).alias("marks"))
    template = F.zip_with("segments", "marks", lambda s, m: F.when(m["wild"], "*").otherwise(s))
    t = counts.join(marks, ["host", "segments"], "left").withColumn("template", F.coalesce(template, F.col("segments")))
    t = written(t.select("host", "segments", "template", *COUNTS))

    leaves = t.groupBy("host", "template").agg(*_sums(*COUNTS))
    nodes = _prefixes(leaves, "template").groupBy("host", "i", "node", "parent").agg(*_sums("n", "path_blocked", "path_allowed"))
    # Branches: labelled children that can't be told from their parent are taken together.
    labelled = F.col("path_blocked") + F.col("path_allowed")
    above = nodes.select("host", F.col("node").alias("parent"), (F.col("path_blocked") / F.greatest(labelled, F.lit(1))).alias("rate"))
    own = nodes.filter("i > 0").join(above, ["host", "parent"])
    rate = F.col("rate")
    alike = (labelled > 0) & (F.abs(F.col("path_blocked") / F.greatest(labelled, F.lit(1)) - rate) <= Z * F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.05)) / F.greatest(labelled, F.lit(1))))
    own = own.withColumn("branch", F.when(alike, "*").otherwise(F.col("node")))
    branch = own.groupBy("host", "parent", "branch").agg(*_sums("n", "path_blocked", "path_allowed"))
    nodes = own.select("host", "i", "node", "parent", "branch").join(branch, ["host", "parent", "branch"])
    way = _prefixes(leaves.select("host", "template"), "template").filter("i > 0").select("host", "template", "node").join(nodes, ["host", "node"])
    way = way.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("i", "n", F.col("path_blocked").alias("b"), F.col("path_allowed").alias("a")))).alias("way"))

    # Like templates of other hosts have a vote each.
    votes = leaves.withColumn("vote", F.when(labelled > 0, F.col("path_blocked") / _weight(F.col("path_blocked"), F.col("path_allowed"), F.col("n"))).otherwise(0.0)).withColumn("votes", (labelled > 0).cast("long"))
    like = votes.groupBy("template").agg(F.sum("vote").alias("bad"), F.sum("votes").alias("all"))
    # A sum of doubles differs by its order; what is left of a host's own vote is taken as none.
    share = counts.agg(F.least(F.lit(0.5), F.sum("unruled_blocked") / F.greatest(F.sum("unruled"), F.lit(1))).alias("share"))
    host = counts.groupBy("host").agg(*_sums("host_blocked"))
    prior = (F.greatest(F.round(F.col("bad") - F.col("vote"), 9), F.lit(0.0)) + ALPHA * F.coalesce("share", F.lit(0.0))) / (F.col("all") - F.col("votes") + ALPHA)
    j = votes.join(like, "template").join(F.broadcast(share)).select("host", "template", prior.alias("prior"))
    j = j.join(way, ["host", "template"], "left").join(host, "host")
    return t.select("host", "segments", "template").join(j, ["host", "template"]).drop("template")


def _purity() -> Column:
    """The page's purity from its template's evidence; its own label is taken out of its branches."""
    own = lambda verdict: F.coalesce((F.col("by_path") == verdict).cast("int"), F.lit(0))
    step = lambda acc, b, m: (b + ALPHA * acc) / (m + ALPHA)
    start = step(F.col("prior"), F.col("host_blocked"), F.col("host_blocked")).cast("double")

    def down(acc, x):
        b, a, n = x["b"] - own("block"), x["a"] - own("allow"), x["n"] - F.col("by_path").isNotNull().cast("int")
        met = acc["met"] | (a + b > 0)
        return F.struct(step(acc["p"], b, F.when(met, _weight(b, a, n)).otherwise(0.0)).alias("p"), met.alias("met"))

    way = F.coalesce("way", F.expr("cast(array() as array<struct<i:int,n:bigint,b:bigint,a:bigint>>)"))
    return F.aggregate(way, F.struct(start.alias("p"), F.lit(False).alias("met")), down)["p"]


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, seeds=SEEDS, learn: Column | None = None) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule, verdict, purity. Labels are learned from rows where ``learn`` holds, by default from all."""
    url = F.col(url_col).cast("string")
    p = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(F.lit(True) if learn is None else learn, F.lit(False)).alias("_learn"))
    p = p.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    general = lambda s: F.when(s.rlike("[0-9]") | (F.length(s) > 24), F.lit("*")).otherwise(s)
    p = p.withColumn("segments", F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), general))
    word = "|".join(seeds)
    seeded = lambda c: F.when(F.col(c).rlike(word), F.lit("block")) if seeds else F.lit(None).cast("string")
    whole = (F.regexp_count("_rule.rule", F.lit("/")) == 1) & F.col("_rule.rule").endswith("/")
    p = p.withColumn("by_host", F.when(F.col("_learn"), seeded("host"))).withColumn("by_path", F.when(F.col("_learn"), F.coalesce(F.when(~whole, F.col("_rule.verdict")), seeded("path"))))
    rule = F.col("_rule.verdict")
    free = rule.isNull()
    one = {
        "n": F.lit(True), "host_blocked": F.col("by_host") == "block", "path_blocked": F.col("by_path") == "block", "path_allowed": F.col("by_path") == "allow",
        "unruled": free, "unruled_blocked": free & (F.coalesce("by_host", "by_path") == "block"),
    }
    counts = p.groupBy("host", "segments").agg(*(F.count_if(one[c]).alias(c) for c in COUNTS))
    out = p.join(_evidence(written(counts)), ["host", "segments"], "left").withColumn("purity", F.when(F.col("host") != "", _purity()))
    verdict = F.coalesce(rule, F.when(F.col("purity") >= PURITY, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "purity")


def op10(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole of ``pages``."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
