"""Helpers shared by the corpus operators: Arrow text batches, vectorised word hashing, shared folders.

Everything here runs inside Spark tasks on bounded slices of an Arrow batch; nothing is collected.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one vectorised step works on; a longer single text is a step of its own.
STEP_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``; only where that is unset, one below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{uuid.uuid4().hex}"


def written(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = spark or df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables in the shared folder that are deleted once the work that reads them is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame) -> DataFrame:
        self.paths.append(shared_dir(self.spark))
        df.write.option("compression", "zstd").parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def apart(self, df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
        """Rows of ``kind`` 0, which stay, and of ``kind`` 1, which are deleted with the rest."""
        path = shared_dir(self.spark)
        df.write.partitionBy(kind).option("compression", "zstd").parquet(path)
        self.paths.append(f"{path}/{kind}=1")
        out = []
        for k in (0, 1):
            schema = df.drop(kind).schema
            out.append(self.spark.read.schema(schema).parquet(f"{path}/{kind}={k}") if self._there(f"{path}/{kind}={k}") else self.spark.createDataFrame([], schema))
        return out[0], out[1]

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def drop(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for p in map(jvm.org.apache.hadoop.fs.Path, self.paths):
            p.getFileSystem(conf).delete(p, True)
        self.paths.clear()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place where possible."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, STEP_BYTES + 1)
        for key, base in (("p", _P), ("i", _P_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POW[key] = np.multiply.accumulate(a)
    out = _POW["p"][:n], _POW["i"][:n]
    if len(_POW["p"]) > 64 * STEP_BYTES:
        _POW.clear()
    return out


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = the sum over i <= k < j of (data[k] + 1) * P**k, modulo 2**64."""
    p, _ = _powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) from ``prefix_hash``; equal spans have equal hashes wherever they stand."""
    _, inv = _powers(len(c))
    h = (c[end] - c[start]) * inv[start]
    return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def rolling(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of every run of n consecutive entries of h (len(h) - n + 1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(m, np.uint64(seed + n), np.uint64)
    for j in range(n):
        acc = acc * np.uint64(0xA0761D6478BD642F) + h[j : j + m]
    return mix(acc)


def text_array(column: pa.Array) -> pa.Array:
    """The column as strings, null as empty."""
    return pc.fill_null(column.cast(pa.string()) if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)) else column, "")


def text_steps(column: pa.Array, most: int = STEP_BYTES):
    """(first row, last row + 1, bytes, byte offsets) for runs of rows of at most ``most`` bytes, or one longer row; null is empty."""
    a = text_array(column)
    off = np.frombuffer(a.buffers()[1], np.int64 if pa.types.is_large_string(a.type) else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(a):
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(max(j, i + 1), len(a))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


#: Bytes in UTF-8 of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z is lowered: digits, letters and all that isn't ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Bytes of the class [^\x20\x09-\x0D].
NOT_SPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def word_spans(low: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of words in lowered bytes, and per document the index of its first word; words don't cross documents."""
    w = is_word[low]
    before = np.zeros(len(w), bool)
    before[1:] = w[:-1]
    cut = off[:-1][off[:-1] < len(w)]
    before[cut] = False
    start = np.flatnonzero(w & ~before)
    after = np.zeros(len(w), bool)
    after[:-1] = w[1:]
    last = off[1:][off[1:] > 0] - 1
    after[last] = False
    end = np.flatnonzero(w & ~after) + 1
    return start, end, np.searchsorted(start, off)
