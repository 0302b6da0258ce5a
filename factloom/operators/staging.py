"""Staging rows, lineage records and small listings (PRJ-1..3, SNK-5, SNK-12, SNK-13, FLT-5, FLT-6, SRT-6, ARR-1, JSN-1, JSN-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def staged(drafts: DataFrame, run_id: str, document_id: str) -> DataFrame:
    """PRJ-1: drafts with their lineage, the value as a string, notes null where absent."""
    notes = F.col("notes") if "notes" in drafts.columns else F.lit(None).cast("string")
    return drafts.withColumn("value", F.col("value").cast("string")).withColumn("notes", notes).withColumn("run_id", F.lit(run_id)).withColumn("document_id", F.lit(document_id))


def approved(staging: DataFrame, revision: Column) -> DataFrame:
    """PRJ-2: the proposed grade is taken over, the run is left behind."""
    return staging.withColumn("grade", F.col("grade_proposed")).withColumn("revision", revision).drop("run_id", "grade_proposed")


def stamped(df: DataFrame, **constants) -> DataFrame:
    """PRJ-3."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def write_run(runs: DataFrame, rows: DataFrame, errors: DataFrame, base: str) -> None:
    """SNK-5: the run first, so that it survives a later failure, then its rows and errors; empty inputs write nothing."""
    for name, df in (("runs", runs), ("staging", rows), ("errors", errors)):
        if not df.isEmpty():
            df.write.mode("append").parquet(f"{base}/{name}")


def append_events(events: DataFrame, path: str) -> None:
    """SNK-12: manifest events as JSON lines."""
    events.write.mode("append").json(path)


def sidecar(discovered: DataFrame, archived: DataFrame, key: str = "url") -> DataFrame:
    """SNK-13: one JSON record for each archived document with what was discovered of it."""
    d = discovered.select(key, F.struct(*discovered.columns).alias("discovered"))
    a = archived.select(key, F.struct(*archived.columns).alias("archived"))
    return d.join(a, key).select(key, F.to_json(F.struct("discovered", "archived")).alias("record"))


def matching(df: DataFrame, **values) -> DataFrame:
    """FLT-5: equality on each column given; None leaves a column out."""
    for k, v in values.items():
        if v is not None:
            df = df.filter(F.col(k) == v)
    return df


def unresolved(flags: DataFrame, resolved_at: str = "resolved_at") -> DataFrame:
    """FLT-6."""
    return flags.filter(F.col(resolved_at).isNull())


def capped(found: DataFrame, have: DataFrame, key, order, cap: int) -> DataFrame:
    """SRT-6: the first ``cap`` in order of those not archived yet."""
    return found.join(have.select(*key), list(key), "left_anti").orderBy(*order).limit(cap)


def drafts_json(drafts: DataFrame) -> DataFrame:
    """JSN-1: each draft as a JSON object, times in ISO 8601 with their zone, null fields kept."""
    own = F.struct(*drafts.columns)
    return drafts.select(F.to_json(own, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssxxx", "dateFormat": "yyyy-MM-dd", "ignoreNullFields": "false"}).alias("draft"))


def metadata(**fields: Column) -> Column:
    """JSN-2: an object of the fields; null ones are left out."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


def array_or_empty(c: Column) -> Column:
    """ARR-1."""
    return F.coalesce(c, F.array().cast("array<string>"))
