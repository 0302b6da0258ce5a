"""Keyed writes as joins (SNK-*), set computations (SET-*), lookups (FLT-4), registries (JN-8, JN-12, SRT-3, AGG-7), limits and orders (SRT-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def null_safe(left: DataFrame, right: DataFrame, key) -> Column:
    out = None
    for k in key:
        one = left[k].eqNullSafe(right[k])
        out = one if out is None else out & one
    return out


def insert_missing(batch: DataFrame, target: DataFrame, key, order=None) -> DataFrame:
    """SNK-2, SNK-9, SNK-11: rows of the batch to append: the first of each key that the target hasn't; null keys equal one another."""
    rows = batch.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*(order or key)))).filter("_rn = 1").drop("_rn")
    have = target.select(*key).distinct()
    return rows.join(have, null_safe(rows, have, key), "left_anti")


def insert_counts(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """SNK-2: (attempted, inserted, skipped) of ``insert_missing``."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(batch, "attempted").join(n(inserted, "inserted")).withColumn("skipped", F.col("attempted") - F.col("inserted"))


def append(batch: DataFrame, path: str) -> None:
    """SNK-1: rows are only ever added; the same batch again adds new rows."""
    batch.write.mode("append").parquet(path)


def checked_append(batch: DataFrame, path: str, faults: DataFrame) -> None:
    """SNK-15: append unless the constraint table (violation, n) of the batch counts a fault, which fails the job."""
    if bad := faults.filter("n > 0").first():
        raise ValueError(f"constraint {bad.violation}: {bad.n} rows")
    append(batch, path)


def upsert(target: DataFrame, batch: DataFrame, key, columns, order=None) -> DataFrame:
    """SNK-3, SNK-4: target with the batch's ``columns`` where keys meet (last of a key wins), plus new keys; other columns stay; null keys equal one another."""
    rows = batch.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*(order or [F.desc(c) for c in columns])))).filter("_rn = 1")
    new = rows.select(*(F.col(k).alias(f"_key_{k}") for k in key), *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_hit"))
    same = F.lit(True)
    for k in key:
        same = same & target[k].eqNullSafe(new[f"_key_{k}"])
    j = target.withColumn("_old", F.lit(True)).join(new, same, "full_outer")
    own = {k: F.when(F.col("_old"), F.col(k)).otherwise(F.col(f"_key_{k}")) for k in key} | {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    return j.select(*(own.get(c, F.col(c)).alias(c) for c in target.columns))


def delete_keys(target: DataFrame, keys: DataFrame, key) -> DataFrame:
    """SNK-7; null keys equal one another."""
    gone = keys.select(*key).distinct()
    return target.join(gone, null_safe(target, gone, key), "left_anti")


def deleted(target: DataFrame, keys: DataFrame, key) -> DataFrame:
    """SNK-7: every key asked for and what became of it: deleted, or NotFound; null keys equal one another."""
    asked, have = keys.select(*key).distinct(), target.select(*(F.col(k).alias(f"_key_{k}") for k in key), F.lit(True).alias("_hit")).distinct()
    same = F.lit(True)
    for k in key:
        same = same & asked[k].eqNullSafe(have[f"_key_{k}"])
    return asked.join(have, same, "left").select(*key, F.when(F.col("_hit"), "deleted").otherwise("NotFound").alias("result"))


def merge_partitions(path: str, batch: DataFrame, key, columns, part: str, remove: DataFrame | None = None) -> None:
    """SNK-3, SNK-7 on a table at ``path`` that is partitioned by ``part``, one of the ``key`` columns: upsert ``batch``, then delete the keys of ``remove``.

    Only partitions that either touches are read and written; the files of the others stay as they are. What is to be
    written is computed and stored before any partition is replaced, so a lost executor can't leave a half-read one.
    """
    from factloom.operators.shared import written

    spark = batch.sparkSession
    table = spark.read.parquet(path).select(*batch.columns, part) if part not in batch.columns else spark.read.parquet(path)
    touched = batch.select(part)
    touched = written((touched.unionByName(remove.select(part)) if remove is not None else touched).distinct())
    old = table.join(touched, null_safe(table, touched, [part]), "left_semi")
    new = upsert(old, batch, key, columns)
    new = written(delete_keys(new, remove, key) if remove is not None else new)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    if remove is not None:
        # A partition of which nothing is left has no rows to be replaced by.
        left = new.select(part).distinct()
        fs_path = spark._jvm.org.apache.hadoop.fs.Path
        for r in touched.join(left, null_safe(touched, left, [part]), "left_anti").collect():  # partitions that became empty
            where = fs_path(f"{path}/{part}={'__HIVE_DEFAULT_PARTITION__' if r[0] is None else r[0]}")
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def set_where(target: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """SNK-8."""
    return target.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def promote(judged: DataFrame, columns) -> tuple[DataFrame, DataFrame]:
    """SNK-6: (rows to approve, rows that stay staged); ``publish.promote_run`` writes both together."""
    done = judged.filter("decision <> 'block'")
    return done.select(*columns, "revision"), judged.filter("decision = 'block'")


def archive_status(batch: DataFrame, catalog: DataFrame, key: str = "key", digest: str = "hash", order=None) -> DataFrame:
    """SNK-10: reuse, conflict or new for every object by key and content hash; a key that has the hash in any entry is reused.

    Objects of a batch are uploaded in ``order`` (by hash, if none is given): the first of a new key is new, the same
    bytes again are a reuse, other bytes under its key a conflict. Null keys equal one another.
    """
    keys = catalog.select(F.col(key).alias("_k"), F.lit(True).alias("_key")).distinct()
    same = catalog.select(F.col(key).alias("_k"), F.col(digest).alias("_h"), F.lit(True).alias("_same")).distinct()
    w = Window.partitionBy(key).orderBy(*(order or [digest]))
    first = batch.withColumn("_first", F.first(digest).over(w)).withColumn("_rn", F.row_number().over(w))
    j = first.join(keys, first[key].eqNullSafe(keys["_k"]), "left").drop("_k")
    j = j.join(same, j[key].eqNullSafe(same["_k"]) & j[digest].eqNullSafe(same["_h"]), "left")
    fresh = F.when(~F.col(digest).eqNullSafe(F.col("_first")), "conflict").when(F.col("_rn") > 1, "reuse").otherwise("new")
    return j.withColumn("status", F.when(F.col("_same"), "reuse").when(F.col("_key"), "conflict").otherwise(fresh)).select(*batch.columns, "status")


def lookup(keys: DataFrame, table: DataFrame, key) -> DataFrame:
    """FLT-4: keys with the table's columns and ``found``."""
    return keys.join(table.withColumn("found", F.lit(True)), list(key), "left").withColumn("found", F.coalesce("found", F.lit(False)))


def top_per(df: DataFrame, group, order, n: int) -> DataFrame:
    """SRT-1, SRT-5."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def duplicate_keys(df: DataFrame, key) -> DataFrame:
    """AGG-8."""
    return df.groupBy(*key).count().filter("count > 1")


def counts_by(df: DataFrame, *group: str) -> DataFrame:
    """AGG-3."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))


def sampled_with_rest(df: DataFrame, group, order, n: int) -> DataFrame:
    """SRT-5: the first ``n`` rows of each group, with the number of rows left out."""
    total = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_total"))
    return top_per(df, group, order, n).join(total, list(group)).withColumn("suppressed", F.greatest(F.col("_total") - n, F.lit(0))).drop("_total")


def trailing_list(approved: DataFrame, since: Column, day: str = "ad_end") -> DataFrame:
    """SRT-2: approved values that end on a day or later, latest first."""
    return approved.filter(F.col(day) >= since).orderBy(F.desc(day))


def groups_by_size(df: DataFrame, group: str) -> DataFrame:
    """SRT-4: groups, largest first, then by name."""
    return counts_by(df, group).orderBy(F.desc("n"), group)


def member(value: Column, vocabulary) -> Column:
    """SET-3: whether a value is a word of a vocabulary, case and all; null is none."""
    return F.coalesce(value.isin(*vocabulary), F.lit(False))


def distinct_keys(df: DataFrame, *key: str) -> DataFrame:
    """SET-1: the keys to look up, each once."""
    return df.select(*key).filter(" and ".join(f"{k} is not null" for k in key)).distinct()


def missing(wanted: DataFrame, have: DataFrame, key, mode: str | None = None) -> DataFrame:
    """SET-2, JN-8: keys that ``have`` lacks; rows whose ``mode`` column is reference_only need none."""
    need = wanted.filter(F.coalesce(F.col(mode) != "reference_only", F.lit(True))) if mode else wanted
    return need.select(*key).distinct().join(have.select(*key), list(key), "left_anti")


def registry_index(registry: DataFrame) -> DataFrame:
    """SRT-3: sources by tier (those without one last, as Reference), then id."""
    label = F.coalesce(F.concat(F.lit("Tier "), F.col("tier").cast("string")), F.lit("Reference"))
    return registry.withColumn("tier_label", label).orderBy(F.asc_nulls_last("tier"), F.asc_nulls_last("source_id"))


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """SRT-3: a sorted table with each row's place in it, from 1.

    Places within a partition are added to the sizes of the partitions before it, so that no window holds all rows. The
    sorted rows are written before they are counted: a sort that runs once more cuts its partitions elsewhere.
    """
    from factloom.operators.shared import written

    p = written(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    size = p.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = size.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33) + F.col("_before") + 1
    return p.join(F.broadcast(before), "_part").select(*ordered.columns, place.alias(name))


def registry_gate(registry: DataFrame, profiles: DataFrame, stored: DataFrame) -> DataFrame:
    """PIPE-10: (fault, subject) of a registry: repeated ids, sources without a profile, an index that isn't current."""
    index = registry_index(registry).select(stored.columns)
    twice = duplicate_keys(registry, ["source_id"]).select(F.lit("duplicate source_id").alias("fault"), F.col("source_id").alias("subject"))
    lost = missing(registry, profiles, ["source_id"], "mode").select(F.lit("missing profile").alias("fault"), F.col("source_id").alias("subject"))
    old = stale(stored, index).select(F.lit("stale index").alias("fault"), F.col("source_id").alias("subject")).distinct()
    return twice.unionByName(lost).unionByName(old)


def registry_status(registry: DataFrame, runs: DataFrame, facts: DataFrame) -> DataFrame:
    """JN-12: registered sources with the last successful and failed run, the number of indicators and the lowest grade seen."""
    r = runs.groupBy("source_id").agg(F.max(F.when(F.col("status") != "failure", F.col("at"))).alias("last_success"), F.max(F.when(F.col("status") == "failure", F.col("at"))).alias("last_failure"))
    f = facts.groupBy("source_id").agg(F.countDistinct("indicator").alias("indicators"), F.max("grade").alias("grade"))
    return registry.select("source_id").join(r, "source_id", "left").join(f, "source_id", "left").na.fill(0, ["indicators"])


def manifest_counters(events: DataFrame, group: str, kinds) -> DataFrame:
    """AGG-7: events by group, a column a kind, 0 where there is none."""
    kinds = list(kinds)
    return events.groupBy(group).agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))


def breadcrumb(most: int = 2048, **fields: Column) -> Column:
    """AGG-11: the fields as JSON, of which the last ``most`` characters stay."""
    return F.right(F.to_json(F.struct(*(c.alias(k) for k, c in fields.items()))), F.lit(most))


def stale(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """SET-6: rows of either side only; none means that the stored index is current."""
    return stored.exceptAll(computed).withColumn("side", F.lit("stored")).unionByName(computed.exceptAll(stored).withColumn("side", F.lit("computed")))


def expected_count(df: DataFrame, n: int, split: dict[str, int] | None = None, by: str | None = None) -> DataFrame:
    """AGG-9: (part, n, expected, ok) of the whole (part null) and, with a ``split`` by a column, of each part."""
    whole = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("part"), "n", F.lit(n).cast("long").alias("expected"))
    if split:
        want = df.sparkSession.createDataFrame(list(split.items()), "part string, expected long")
        own = df.groupBy(F.col(by).alias("part")).agg(F.count(F.lit(1)).alias("n"))
        whole = whole.unionByName(want.join(own, "part", "full_outer").na.fill(0, ["n", "expected"]).select("part", "n", "expected"))
    return whole.withColumn("ok", F.col("n") == F.col("expected"))


def seeded(target: DataFrame, batch: DataFrame, key, columns, n: int, split: dict[str, int] | None = None, by: str | None = None) -> DataFrame:
    """SNK-4, PIPE-9: ``upsert`` of a seed, refused unless it has exactly the expected rows."""
    if bad := expected_count(batch, n, split, by).filter("not ok").first():
        raise ValueError(f"expected {bad.expected} rows of {bad.part or 'the seed'}, got {bad.n}: refusing to seed")
    return upsert(target, batch, key, columns)
