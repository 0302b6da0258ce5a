"""Benchmark decontamination: a hash set of normalised test n-grams, scanned over training token windows.

Words are maximal runs of ASCII letters and digits and of all characters beyond ASCII, after A-Z is lowered.
A window is ``n`` consecutive words of a benchmark item; an item with fewer words, but at least one, is one
window of all its words. Hits of the 64-bit window hashes are verified against the words themselves.

The set of one pass has a bound; a larger benchmark is scanned in as many passes as it needs, one block of windows after
the other, each written before the next, so that no task and no driver holds more than a block.

Defined results: null text has no words; null or empty benchmark texts give no window; repeated rows are judged
one by one; items that repeat a text all count; items with a null id never appear in the id list; an empty
benchmark or corpus gives no hit and no row.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from factloom.llm._common import ALNUM, LOWER, prefix_hash, rolling, span_hash, text_steps, word_spans, written

#: Windows that are sent to every task at once: with their words some 400 bytes each, 100 MB at most.
MAX_SET = 250_000


def _windows(texts, n: int):
    """(hash, length, words as bytes, item) of every window of the items given, one at a time."""
    for item, text in texts:
        low = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        s, e, _ = word_spans(low, np.array([0, len(low)]), ALNUM)
        if len(s):
            k = min(n, len(s))
            raw = low.tobytes()
            words = [raw[a:b] for a, b in zip(s, e)]
            for i, h in enumerate(rolling(span_hash(prefix_hash(low), s, e), k)):
                yield int(h), k, b" ".join(words[i : i + k]), item


class _Set:
    """Windows by length, with a bit table that settles most lookups."""

    def __init__(self, rows):
        self.items: dict[bytes, list] = {}
        by: dict[int, set] = {}
        for h, k, words, item in rows:
            self.items.setdefault(words, []).append(item)
            by.setdefault(k, set()).add(h)
        bits = max(16, min(26, 4 + max([1, *map(len, by.values())]).bit_length()))
        self.shift, self.by = np.uint64(64 - bits), {}
        for k, hs in by.items():
            a, table = np.array(sorted(hs), np.uint64), np.zeros(1 << bits, bool)
            table[a >> self.shift] = True
            self.by[k] = a, table

    def hits(self, h: np.ndarray, k: int) -> np.ndarray:
        """Places of h that are in the set."""
        a, table = self.by[k]
        at = np.flatnonzero(table[h >> self.shift])
        pos = np.minimum(np.searchsorted(a, h[at]), len(a) - 1)
        return at[a[pos] == h[at]]


def _scan(column: pa.Array, windows: _Set, n: int):
    """Per text: its number of words, runs of hit words as (first word, last + 1, first byte, last + 1), items."""
    for _, _, data, off in text_steps(column):
        low = LOWER[data]
        s, e, first = word_spans(low, off, ALNUM)
        h = span_hash(prefix_hash(low), s, e)
        hit = np.zeros(len(s) + 1, np.int64)
        items: dict[int, set] = {}
        for k in windows.by:
            at = windows.hits(rolling(h, k), k)
            doc = np.searchsorted(first, at, "right") - 1
            ok = at + k <= first[doc + 1]
            for i, d in zip(at[ok], doc[ok]):
                words = b" ".join(low[a:b].tobytes() for a, b in zip(s[i : i + k], e[i : i + k]))
                if words in windows.items:
                    hit[i] += 1
                    hit[i + k] -= 1
                    items.setdefault(int(d), set()).update(windows.items[words])
        flags = np.cumsum(hit[:-1]) > 0
        for d in range(len(off) - 1):
            i, j = first[d], first[d + 1]
            if d not in items:
                yield j - i, [], set()
                continue
            edge = np.diff(np.concatenate([[0], flags[i:j].astype(np.int8), [0]]))
            yield j - i, [(int(x), int(y), int(s[i + x] - off[d]), int(e[i + y - 1] - off[d])) for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))], items[d]


def _united(each: tuple) -> tuple[int, list, set]:
    """What the blocks of the benchmark found in one text: words, runs of hit words as (first word, last + 1, first byte, last + 1), items."""
    if len(each) == 1:
        return each[0]
    runs: list[list] = []
    for x in sorted(r for e in each for r in e[1]):
        if runs and x[0] <= runs[-1][1]:
            if x[1] > runs[-1][1]:
                runs[-1][1], runs[-1][3] = x[1], x[3]
        else:
            runs.append(list(x))
    return each[0][0], [tuple(r) for r in runs], set().union(*(e[2] for e in each))


def _blocks(benchmark: DataFrame, n: int, item_col: str, text_col: str):
    """Sets of ``MAX_SET`` windows at most, one for any usual benchmark; the items come to the driver one after the other, a long one may lie in several sets."""
    b = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).filter("length(t) > 0")
    rows, any_ = _windows(((r.i, r.t) for r in b.toLocalIterator()), n), False
    while (block := list(islice(rows, MAX_SET))) or not any_:
        any_ = True
        yield _Set(block)
        if len(block) < MAX_SET:
            return


_HIT = pa.struct([("words", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("a", "z", "first", "last")]))), ("items", pa.list_(pa.string()))])
_HIT_SQL = "struct<words: long, runs: array<struct<a: long, z: long, first: long, last: long>>, items: array<string>>"


def _marked(docs: DataFrame, benchmark: DataFrame, n: int, text_col: str, item_col: str, item_text: str) -> tuple[DataFrame, str]:
    """``docs`` with one more column, whose name comes too: words, runs of hit words (first word, last + 1, first byte, last + 1), items found."""
    spark, where, many = docs.sparkSession, docs.columns.index(text_col), len(docs.columns)
    name = "_hit"
    while name in docs.columns:
        name = f"_{name}"
    schema = StructType([*docs.schema.fields, *spark.createDataFrame([], f"`{name}` {_HIT_SQL}").schema.fields])

    def scanned(sent, again: bool):
        def run(batches):
            for batch in batches:
                found = _scan(batch.column(where), sent.value, n)
                if again:
                    before = [(x["words"], [(r["a"], r["z"], r["first"], r["last"]) for r in x["runs"]], set(x["items"])) for x in batch.column(many).to_pylist()]
                    found = map(_united, zip(before, found))
                rows = [{"words": int(w), "runs": [dict(zip(("a", "z", "first", "last"), r)) for r in runs], "items": sorted(items, key=lambda i: (i is None, i))} for w, runs, items in found]
                yield pa.RecordBatch.from_arrays([*batch.columns[:many], pa.array(rows, _HIT)], [*batch.schema.names[:many], name])

        return run

    out = None
    for block in _blocks(benchmark, n, item_col, item_text):
        out = (docs if out is None else written(out)).mapInArrow(scanned(spark.sparkContext.broadcast(block), out is not None), schema)
    return out, name


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_hit, item_ids (sorted strings), spans of the hit byte runs."""
    found, hit = _marked(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), benchmark, n, "text", item_col, item_text)
    runs, items = F.col(f"{hit}.runs"), F.col(f"{hit}.items")
    return found.select(
        F.col("id").alias(id_col), F.col(f"{hit}.words").alias("n_words"), _hits(runs).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.filter(items, lambda i: i.isNotNull()).alias("item_ids"),
        F.transform(runs, lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"))).alias("spans"),
    )


def _hits(runs):
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["z"] - r["a"])


def contaminated(n_hit, n_words):
    """The rule: at least one hit word, and hits make a twentieth of the words or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 13, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", remove: str = "documents") -> DataFrame:
    """``docs`` with its columns, without contaminated documents; ``remove="spans"`` instead cuts the hit words out of every text."""
    found, hit = _marked(docs, benchmark, n, text_col, item_col, item_text)
    if remove == "documents":
        return found.filter(~contaminated(_hits(F.col(f"{hit}.runs")), F.col(f"{hit}.words"))).select(*(F.col(f"`{c}`") for c in docs.columns))
    where, many = docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for batch in batches:
            texts = []
            for text, x in zip(batch.column(where).to_pylist(), batch.column(many).to_pylist()):
                if x["runs"]:
                    b, out, at = text.encode(), [], 0
                    for r in x["runs"]:
                        out.append(b[at : r["first"]])
                        at = r["last"]
                    text = b"".join([*out, b[at:]]).decode()
                texts.append(text)
            columns = list(batch.columns[:many])
            columns[where] = pa.array(texts, columns[where].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:many])

    return found.mapInArrow(run, docs.schema)


def items_digest(ids: list[str]) -> str:
    """Lowercase hex of the sorted ids, comma-joined."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def op7(spark, sf_dir: str) -> DataFrame:
    """The contract's digest columns for the whole of ``documents``."""
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return scan(docs, bench).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")
    )
