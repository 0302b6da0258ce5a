"""Fill-in-middle transformation: a wavelet matrix over character classes counts units and locates both cuts.

Bytes of UTF-8 are put in six classes (later bytes of a character, line ends, other white space, letters and digits, other
ASCII, first bytes of the rest), three bits each. The wavelet matrix has a level of bits for each of the three; a class's
rank before any place takes one bit rank a level. Units are pieces that end with a byte of some classes (lines, words), or
single characters; ranks of these classes, added up, count the units before a place, and bisection on that count finds
where a given number of units ends. Characters of the prefix and the middle are ranks as well. A matrix covers a step of
many whole texts (or one long text), whose queries are answered together.

A text is cut after the smaller and the larger of two hashed numbers of units. The parts are put in the order prefix,
suffix, middle (psm) or suffix, prefix, middle (spm), each behind its mark; ``restored`` puts them back.

Defined results: null text is empty; texts that are empty or hold a mark stay plain; a null id is hashed as an empty one;
repeated rows are cut alike; an empty table gives no row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from factloom.llm._common import text_steps

SEED, RATE, SPM = "7", 100, 50
P, S, M = "<P>", "<S>", "<M>"
LATER, LINE, SPACE, ALNUM, ASCII, WIDE = range(6)
BITS = 3
CLASS = np.full(256, ASCII, np.uint8)
CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = ALNUM
CLASS[[9, 11, 12, 13, 32]], CLASS[10] = SPACE, LINE
CLASS[128:192], CLASS[192:] = LATER, WIDE
#: Classes whose bytes end a unit; a character begins with any class but LATER.
ENDS = {"line": (LINE,), "word": (LINE, SPACE)}
FIRST = (LINE, SPACE, ALNUM, ASCII, WIDE)


class WaveletMatrix:
    """Ranks of small symbols: ``levels`` holds, from the highest bit down, packed bits, ones before each word, and the zeros."""

    def __init__(self, symbols: np.ndarray, bits: int = BITS):
        self.levels = []
        for b in reversed(range(bits)):
            bit = (symbols >> b & 1).astype(bool)
            words = np.zeros(len(symbols) // 64 + 1, np.uint64)
            packed = np.packbits(bit, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=ones[1:])
            self.levels.append((b, words, ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    @staticmethod
    def _ones(words: np.ndarray, ones: np.ndarray, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return ones[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, symbol: int, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each place ``i``."""
        low, high = np.zeros(1, np.int64), np.asarray(i, np.int64)
        for b, words, ones, zeros in self.levels:
            low1, high1 = self._ones(words, ones, low), self._ones(words, ones, high)
            low, high = (zeros + low1, zeros + high1) if symbol >> b & 1 else (low - low1, high - high1)
        return high - low

    def count(self, symbols, i: np.ndarray) -> np.ndarray:
        """How many of ``symbols`` stand before each place ``i``."""
        return sum(self.rank(s, i) for s in symbols)

    def locate(self, symbols, k: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least place in [low, high] before which ``k`` of ``symbols`` stand, by bisection; ``high`` where there is none."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            enough = self.count(symbols, mid) >= k
            high = np.where(open_ & enough, mid, high)
            low = np.where(open_ & ~enough, mid + 1, low)
        return low


def cuts(data: np.ndarray, off: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str = "line"):
    """Of texts data[off[i]:off[i + 1]]: units, ends of prefix and middle, characters of both."""
    wm, start, end = WaveletMatrix(CLASS[data]), off[:-1], off[1:]
    if unit == "char":
        before = wm.count(FIRST, start)
        n = wm.count(FIRST, end) - before
        # The place of a character is the last one before which it doesn't stand.
        place = lambda m: np.where(m < n, wm.locate(FIRST, before + m + 1, start, end) - 1, end)
    else:
        before = wm.count(ENDS[unit], start)
        n = wm.count(ENDS[unit], end) - before
        rest = (end > start) & ~np.isin(CLASS[data[np.maximum(end - 1, 0)]] if len(data) else start, ENDS[unit])
        n = n + rest
        place = lambda m: np.where(m < n, wm.locate(ENDS[unit], before + m, start, end), end)
    a, b = h1 % (n + 1), h2 % (n + 1)
    one, two = place(np.minimum(a, b)), place(np.maximum(a, b))
    chars = [wm.count(FIRST, at) for at in (start, one, two)]
    return n, one, two, chars[1] - chars[0], chars[2] - chars[1]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", rate: int = RATE, spm: int = SPM, seed: str = SEED) -> DataFrame:
    """One row for each row of ``docs``: id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output.

    ``unit``: line, word (ends with white space) or char. ``rate`` of 100 texts are changed, ``spm`` of 100 of those to spm.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = (text == "") | F.contains(text, F.lit(P)) | F.contains(text, F.lit(S)) | F.contains(text, F.lit(M)) | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), h[0].alias("h1"), h[1].alias("h2"), form.alias("form"))
    kinds = [(id_col, docs.schema[id_col].dataType), ("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    out = T.StructType([T.StructField(*x) for x in kinds])
    p, s, m = P.encode(), S.encode(), M.encode()

    def run(batches):
        for batch in batches:
            forms, h1, h2 = batch.column(4).to_pylist(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for i, j, data, off in text_steps(batch.column(1)):
                n, one, two, first, middle = cuts(data, off, h1[i:j], h2[i:j], unit)
                raw, texts = data.tobytes(), []
                for form, a, b, c, d in zip(forms[i:j], off[:-1].tolist(), one.tolist(), two.tolist(), off[1:].tolist(), strict=True):
                    if form == "plain":
                        texts.append(raw[a:d])
                    elif form == "psm":
                        texts.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
                    else:
                        texts.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
                off_ = np.array([f == "plain" for f in forms[i:j]])
                cols = [batch.column(0).slice(i, j - i), pa.array(n), batch.column(4).slice(i, j - i), pa.array(first, mask=off_), pa.array(middle, mask=off_), pa.array(texts, pa.large_binary()).view(pa.large_string())]
                yield pa.RecordBatch.from_arrays(cols, out.names)

    return rows.mapInArrow(run, out)


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given, from its output and form alone."""
    part = F.split(output, "|".join(map(re.escape, (P, S, M))), -1)
    return F.when(form == "psm", F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))).when(form == "spm", F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))).otherwise(output)


def op13(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole of ``documents``."""
    out = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
l AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h FROM d),
c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
