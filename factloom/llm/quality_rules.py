"""Quality rules: hashed n-gram log-likelihood ratio of trusted texts against the corpus, with plain rules. SQL functions only.

Words and pairs of words, lowered, are hashed to ``BUCKETS`` buckets. Two multinomials over the buckets are counted: one
over all texts (each count plus one), one over those that ``trusted`` names, with ``PRIOR`` n-grams more that are dealt
like the corpus's. A bucket weighs ln(p(trusted) / p(corpus)), rounded to millionths, so that sums are integers and don't
depend on any order. A text's weights, added up and divided by the number of its n-grams, are its score; every text whose
score reaches ``THRESHOLD`` is kept. Texts of n-grams that trusted texts have less of score below 0, trusted ones a little
above; few trusted texts leave all weights near 0.

Only the counts of the buckets leave the executors, 2 x ``BUCKETS`` numbers whatever the number of rows, and no text is
shuffled while the trusted ids are ``SENT`` at most; more are joined by shuffle, with the same result.

Defined results: null text is empty and without words; texts under ``LEAST`` words, or whose words mostly stand in windows
of three that the text repeats, fail whatever their score; repeated rows are judged and counted one by one; ids that are
null are not trusted; without trusted texts all scores are 0 and reject nothing; an empty table gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS, PRIOR, THRESHOLD, UNIT = 1 << 14, 1000, -0.05, 1_000_000
LEAST, REPEATED = 50, 50
#: Trusted ids that are sent to every task.
SENT = 1_000_000
WORD, SYMBOLS = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def buckets(w: str) -> Column:
    """Buckets of the words and the pairs of neighbouring words of the array column ``w``."""
    bucket = lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")
    pair = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: bucket(F.concat_ws(" ", a, b)))
    return F.concat(F.transform(w, bucket), pair)


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Weights of the buckets, in millionths; ``trusted`` has the ids of trusted texts."""
    ids = trusted.select(F.col(id_col).alias("id"), F.lit(1).alias("own")).filter("id is not null").distinct()
    ids = F.broadcast(ids) if ids.limit(SENT + 1).count() <= SENT else ids
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(ids, "id", "left")
    counted = t.select("own", words(F.lower("text")).alias("w")).select("own", F.explode(buckets("w")).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count("own").alias("m"))
    n, m = [1] * BUCKETS, [0] * BUCKETS
    for r in counted.collect():  # the buckets
        n[r.g], m[r.g] = n[r.g] + r.n, m[r.g] + r.m
    total, own = sum(n), sum(m)
    return [round(UNIT * math.log((b * total / a + PRIOR) / (own + PRIOR))) for a, b in zip(n, m, strict=True)]


def repeated_words(w: str) -> Column:
    """How many words of the array column ``w`` stand in a window of three that occurs twice or more."""
    at = lambda i: F.get(w, i)
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", at(i), at(i + 1), at(i + 2)).alias("t"), i.alias("i")))
    return F.when(F.size(w) >= 3, F.sort_array(windows))


def _covered(s: str) -> Column:
    """Words in windows of the sorted array column ``s`` that have an equal neighbour."""
    same = lambda x, i: F.coalesce(F.get(s, i)["t"] == x["t"], F.lit(False))
    places = F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
    none = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    total = F.aggregate(places, none, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(p - acc["last"], F.lit(3))).alias("n")))
    return F.coalesce(total["n"], F.lit(0)).cast("long")


def judge(docs: DataFrame, weights: list[int], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    t = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    c = F.col("_t")
    lines = F.filter(F.split(c, "\n", -1), lambda x: x.rlike(WORD))
    t = t.withColumn("_w", words(c)).withColumn("_v", words(F.lower(c))).withColumn("_lines", lines)
    t = t.select(
        "_id", "_v", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), F.regexp_count(c, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), repeated_words("_w").alias("_s"),
    ).withColumn("n_repeat_words", _covered("_s")).drop("_s")
    t = t.withColumn("base_failed", (F.col("n_words") < LEAST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words")))
    # One constant for all rows: the optimizer folds it into a literal.
    table = F.from_json(F.lit(str(weights)), "array<bigint>")
    total = F.aggregate("_b", F.lit(0).cast("long"), lambda acc, g: acc + F.get(table, g))
    many = 2 * F.col("n_words") - 1
    t = t.withColumn("_b", buckets("_v")).withColumn("_sum", F.when(F.size("_b") > 0, total).otherwise(F.lit(0).cast("long")))
    good = F.col("_sum") >= round(threshold * UNIT) * many
    return t.select(F.col("_id").alias(id_col), *t.columns[2:-2], (F.col("_sum") / F.greatest(many, F.lit(1)) / UNIT).alias("score"), (~F.col("base_failed") & good).alias("kept"))


def op12(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole of ``documents``; trusted are those whose label says that their quality is good."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, fit(docs, labels.filter("quality = 1")))
