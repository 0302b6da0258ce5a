"""Write, audit, publish (SNK-6): several outputs of a run become visible together, or not at all.

A run writes its outputs to a folder of its own. Once all are there and the audit has found nothing, one manifest, put in
place by a single rename, makes them visible. Readers take only what manifests name: a job that dies before leaves files
that nobody reads and that the next try overwrites, and a run that is published is not written again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F


class _Store:
    """Small files below ``base``, by the file system that Spark uses for it."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm, self.base = spark._jvm, base
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def put(self, name: str, text: str) -> bool:
        """Write a file that wasn't there, as a whole; False if it is there."""
        half = f"{name}.{self.jvm.java.util.UUID.randomUUID()}.half"
        out = self.fs.create(self._path(half), True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.exists(name) or not self.fs.rename(self._path(half), self._path(name)):
            self.fs.delete(self._path(half), False)
            return False
        return True


def publish(outputs: dict[str, DataFrame], base: str, run_id: str, audit: DataFrame | None = None) -> bool:
    """Publish ``outputs`` by name as ``run_id``; False, without effect, if the run is published already.

    ``audit`` is a table of (violation, n), as ``violations`` gives; a count above 0 fails the job before anything is
    visible. One job publishes a run at a time.
    """
    spark = next(iter(outputs.values())).sparkSession
    store, mark = _Store(spark, base), f"manifests/{run_id}.json"
    if store.exists(mark):
        return False
    paths = {}
    for name, df in outputs.items():
        paths[name] = f"runs/{run_id}/{name}"
        df.write.mode("overwrite").parquet(f"{base}/{paths[name]}")
    if audit is not None and (bad := audit.filter("n > 0").first()):
        raise ValueError(f"run {run_id} isn't published: {bad.violation}: {bad.n} rows")
    return store.put(mark, json.dumps({"run_id": run_id, "paths": paths, "at": int(store.jvm.java.lang.System.currentTimeMillis())}))


def manifests(spark: SparkSession, base: str) -> DataFrame:
    """(run_id, at, paths) of the published runs."""
    schema = "run_id string, at long, paths map<string,string>"
    if not _Store(spark, base).exists("manifests"):
        return spark.createDataFrame([], schema)
    return spark.read.option("pathGlobFilter", "*.json").schema(schema).json(f"{base}/manifests")


def published(spark: SparkSession, base: str, name: str, latest: bool = False) -> DataFrame | None:
    """What published runs have under ``name``, with ``run_id`` where they lack it: all together, or with ``latest`` the last run's alone; None if there is none."""
    runs = manifests(spark, base).filter(F.col("paths")[name].isNotNull()).orderBy(F.desc("at"), F.desc("run_id"))
    runs = (runs.limit(1) if latest else runs).select("run_id", F.col("paths")[name].alias("path")).collect()  # a row for each run
    if not runs:
        return None
    df = spark.read.parquet(*(f"{base}/{r.path}" for r in runs))
    return df if "run_id" in df.columns else df.withColumn("run_id", F.regexp_extract(F.input_file_name(), "/runs/([^/]+)/", 1))


def promote_run(judged: DataFrame, columns, base: str, run_id: str, audit: DataFrame | None = None) -> bool:
    """SNK-6, SNK-14: the approved rows of a judged run, its rows that stay staged and its flags, published together."""
    from factloom.operators.quality import flags
    from factloom.operators.tables import promote

    approved, staged = promote(judged, columns)
    return publish({"approved": approved, "staged": staged, "flags": flags(judged)}, base, run_id, audit)
