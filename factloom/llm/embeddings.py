"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact rerank.

Equal vectors are one class. On a sample of ``SAMPLE`` classes at most (by hash) principal directions are found and
rotations learned that bring the projections next to the corners of the cube (Gong and Lazebnik), from several random
starts; signs give balanced codes. Every class is indexed, in ``tables`` tables, by its substrings of ``bits`` bits,
``bits`` growing with the logarithm of the number of classes so that lists stay short. Classes that share a substring
and whose first codes differ in no more bits than pairs at the threshold do (plus four standard deviations) are
reranked by their original vectors' cosine in double precision. There is no cap on lists.

A pair at the threshold shares a substring with probability ``RECALL`` at least; closer pairs do more often.

Vectors are scaled by their largest component before anything is multiplied. Lengths (numbers of components) are taken
one after the other; vectors of different lengths have no cosine and don't link.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; equal
rows are linked with one another; a component is named by its smallest vec_id, null ids last; an empty table gives no
row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm._common import written
from factloom.llm.components import components

SAMPLE, RECALL, TURNS, SEED, LONG = 20_000, 0.93, 40, 11, 2048


def rotations(x: np.ndarray, many: int) -> np.ndarray:
    """Projections (many, length, bits). Vectors aren't centred: the threshold is on the angle at the origin, which signs keep."""
    x, rng, out = x / np.linalg.norm(x, axis=1)[:, None], np.random.default_rng(SEED), []
    # Very long vectors are projected at random first: their principal directions would need a matrix of their length squared.
    p = np.linalg.qr(rng.standard_normal((x.shape[1], 64)))[0] if x.shape[1] > LONG else np.linalg.eigh(x.T @ x)[1][:, ::-1][:, : min(64, x.shape[1])]
    v = x @ p
    for _ in range(many):
        r = np.linalg.qr(rng.standard_normal((p.shape[1], p.shape[1])))[0]
        for _ in range(TURNS):
            a, _, b = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (a @ b).T
        out.append(p @ r)
    return np.stack(out)


def _vectors(column: pa.Array, n: int) -> np.ndarray:
    """Rows of ``n`` components, scaled so that products neither overflow nor vanish; the angle stays."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, n)
    return x / np.abs(x).max(1, keepdims=True)


def links(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9):
    """(rows with their class, class links): (id, class), (class, size, rep), (a, b) with cosine >= threshold."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.coalesce((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(fine, F.col("v"))).withColumn("class", F.when(fine, F.xxhash64("v")))
    known = written(rows.filter("class is not null").groupBy("class").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("size"), F.min("id").alias("rep")))
    found = spark.createDataFrame([], "a long, b long")
    narrow = "array<float>" if docs.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    for r in known.groupBy(F.size("v").alias("n")).count().filter("count > 1").orderBy("n").collect():  # the lengths, usually one
        found = found.unionByName(_links(known.filter(F.size("v") == r["n"]), r["n"], r["count"], narrow, threshold))
    return rows.select("id", "class"), known.select("class", "size", "rep"), found


def _links(known: DataFrame, n: int, total: int, narrow: str, threshold: float) -> DataFrame:
    """Pairs (a, b) of classes (class, v) of ``n`` components with cosine >= threshold."""
    spark = known.sparkSession
    differ = math.acos(threshold) / math.pi
    code = min(64, n)
    bits = min(code, max(8, round(math.log2(total))))
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - differ) ** bits))
    per = max(1, code // bits)
    sample = known.orderBy(F.xxhash64("class"), "class").limit(SAMPLE).select("v").toPandas()
    x = np.stack(sample["v"].to_numpy())
    planes = rotations(x / np.abs(x).max(1, keepdims=True), math.ceil(tables / per))
    sent = spark.sparkContext.broadcast(planes)
    first = min(3, len(planes))
    most = int(first * code * differ + 4 * math.sqrt(first * code * differ * (1 - differ)))

    def run(batches):
        planes = sent.value
        for batch in batches:
            x = _vectors(batch.column(1), n)
            sign = np.concatenate([x @ p > 0 for p in planes], 1)
            words = [np.packbits(np.pad(sign[:, i * code : (i + 1) * code], ((0, 0), (0, 64 - code))), axis=1, bitorder="little").view(np.int64)[:, 0] if i < first else np.zeros(len(x), np.int64) for i in range(3)]
            for t in range(tables):
                at = (t // per) * code + (t % per) * bits
                own = sign[:, at : min(at + bits, (t // per + 1) * code)]
                key = (np.int64(t) << 40) + own @ (1 << np.arange(own.shape[1], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), *map(pa.array, words)], ["key", "class", "w0", "w1", "w2"])

    keys = known.select("class", "v").mapInArrow(run, "key long, class long, w0 long, w1 long, w2 long")
    left, right = keys.selectExpr("key", "class a", "w0 a0", "w1 a1", "w2 a2"), keys.selectExpr("key", "class b", "w0 b0", "w1 b1", "w2 b2")
    near = left.join(right, "key").filter(f"a < b and bit_count(a0 ^ b0) + bit_count(a1 ^ b1) + bit_count(a2 ^ b2) <= {most}").select("a", "b").distinct()

    def rerank(batches):
        for batch in batches:
            x, y = _vectors(batch.column(2), n), _vectors(batch.column(3), n)
            cos = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
            keep = pa.array(cos >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    v = known.select("class", F.col("v").cast(narrow).alias("v"))
    pairs = near.join(v.selectExpr("class a", "v va"), "a").join(v.selectExpr("class b", "v vb"), "b").select("a", "b", "va", "vb")
    return written(pairs.mapInArrow(rerank, "a long, b long"))


def dedup(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row for each row of ``docs``: id, n_links, component_id, kept."""
    ids, known, pairs = links(docs, id_col, vector_col, threshold)
    both = pairs.unionByName(pairs.selectExpr("b a", "a b"))
    degree = both.join(known.selectExpr("class b", "size"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("size").alias("more"))
    comp = components(pairs).withColumnRenamed("v", "class")
    named = known.join(comp, "class")
    least = named.groupBy("comp").agg(F.min("rep").alias("least"))
    known = known.join(named.select("class", "comp").join(least, "comp").select("class", "least"), "class", "left").join(degree, "class", "left")
    known = known.select("class", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("least"))
    out = ids.join(known, "class", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op6(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole of ``embeddings``."""
    return dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
