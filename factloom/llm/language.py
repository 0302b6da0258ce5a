"""Language identification by rank-order profiles: out-of-place distance of a text's most frequent n-grams.

Words are runs of letters of the lowered text, set between single spaces; n-grams of one to three characters are
counted over the whole text. A profile is the ``PROFILE`` most frequent n-grams in order (ties by the n-gram). The
distance of a text from a language adds, over the text's own profile, how far each n-gram's rank is from its rank in
the language, and ``PROFILE`` where the language has it not; it is divided by the largest sum possible. The language
with the least distance is predicted (ties by name); the score is its share of exp(-SHARP * distance).

Languages are learned from all rows outside the held-out fold whose language is known; counts are added in the
tasks, then by language and n-gram.

Defined results: null texts and those without a letter are ``und`` with score 0, as is everything where nothing was
learned; repeated rows are judged one by one; an empty table gives no row.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

PROFILE, SHARP = 400, 20.0
UNKNOWN = "und"
_LUT: dict = {}


def _letters() -> np.ndarray:
    if "a" not in _LUT:
        _LUT["a"] = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _LUT["a"]


#: Characters of a text that are counted at once.
SLICE = 1 << 20


def grams(text: str) -> np.ndarray:
    """All n-grams of one to three characters of a text of usual length, as code points packed in 21 bits each; none if the text has no letter."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where(_letters()[c], c, 32)
    gap = c == 32
    c = c[np.concatenate([[True], ~(gap[1:] & gap[:-1])])]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    two = c[:-1] << 21 | c[1:]
    return np.concatenate([c[c != 32], two, two[:-1] << 21 | c[2:]])


def counted(texts) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of texts and how often each occurs; long texts are cut between words, or within one of over ``SLICE`` characters."""
    g, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, size = [], 0

    def add():
        nonlocal g, n, held, size
        own, k = np.unique(np.concatenate([*held, np.zeros(0, np.int64)]), return_counts=True)
        all_, at = np.unique(np.concatenate([g, own]), return_inverse=True)
        g, n, held, size = all_, np.bincount(at, np.concatenate([n, k]), len(all_)).astype(np.int64), [], 0

    for text in texts:
        at = 0
        while at < len(text) or at == 0:
            end = len(text) if len(text) - at <= SLICE else max(text.rfind(" ", at, at + SLICE), at + 1) if " " in text[at + 1 : at + SLICE] else at + SLICE
            held.append(grams(text[at:end]))
            size, at = size + end - at, max(end, at + 1)
            if size >= SLICE:
                add()
    add()
    return g, n


def profile(text: str) -> np.ndarray:
    """The most frequent n-grams of a text, in order."""
    g, n = np.unique(grams(text), return_counts=True) if len(text) <= SLICE else counted([text])
    return g[np.lexsort((g, -n))[:PROFILE]]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, rank) of every language in ``docs``."""

    def run(batches):
        total: dict[str, list] = {}
        for batch in batches:
            by: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                own = [*total.get(lang, []), counted(texts)]
                g, at = np.unique(np.concatenate([x[0] for x in own]), return_inverse=True)
                total[lang] = [(g, np.bincount(at, np.concatenate([x[1] for x in own]), len(g)).astype(np.int64))]
        for lang, [(g, n)] in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], ["lang", "gram", "n"])

    counts = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = counts.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= PROFILE).select("lang", "gram", "rank")


class Profiles:
    """Ranks of all languages' n-grams, missing ones at ``PROFILE``."""

    def __init__(self, rows):
        self.langs = sorted({r.lang for r in rows})
        self.grams = np.unique(np.array([r.gram for r in rows], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        for r in rows:
            self.ranks[np.searchsorted(self.grams, r.gram), self.langs.index(r.lang)] = r.rank - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        own = profile(text) if text and self.langs else ()
        if not len(own):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = self.ranks[np.where(self.grams[at] == own, at, len(self.grams))]
        out = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(own))[:, None])).sum(0) / (PROFILE * len(own))
        i = int(out.argmin())
        return self.langs[i], float(1 / np.exp(-SHARP * (out - out[i])).sum())


def predict(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, lang_pred, score. Profiles are at most ``PROFILE`` rows a language."""
    sent = docs.sparkSession.sparkContext.broadcast(Profiles(profiles.collect()))

    def run(batches):
        for batch in batches:
            out = [sent.value.predict(t) for at in range(0, batch.num_rows, 512) for t in batch.column(1).slice(at, 512).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op2(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return predict(docs, learn(docs.filter(~held))).select("doc_id", held.alias("held_out"), "lang_pred", "score")
