"""CSV texts by a character-level state machine (SRC-1), as vectorised scans of whole files.

A character maps each of four states (start of a field, plain, quoted, behind a quote within quotes) to the next. Such maps
are composed, which is associative: a file is laid out as a square, all its rows are composed side by side, and the rows'
results are chained. From the states follow what is content and what ends a field or a record; no regex and no loop over
characters is involved, and every cell keeps its column.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.sources.readers import files

OTHER, QUOTE, COMMA, LINE = range(4)
START, PLAIN, QUOTED, BEHIND = range(4)
#: NEXT[state][class]. A quote is special at the start of a field and within quotes only.
NEXT = ((PLAIN, QUOTED, START, START), (PLAIN, PLAIN, START, START), (QUOTED, BEHIND, QUOTED, QUOTED), (PLAIN, QUOTED, START, START))
CLASS = np.zeros(256, np.uint8)
CLASS[[34, 44, 10, 13]] = QUOTE, COMMA, LINE, LINE
#: A map of states as a byte, two bits for the image of each state; THEN[a, b] is a followed by b.
_code = lambda images: sum(x << 2 * s for s, x in enumerate(images))
STEP = np.array([_code([NEXT[s][c] for s in range(4)]) for c in range(4)], np.uint8)
SAME = np.uint8(_code(range(4)))
THEN = np.array([[_code([b >> 2 * (a >> 2 * s & 3) & 3 for s in range(4)]) for b in range(256)] for a in range(256)], np.uint8)
PRELUDE, ROWS = 5, 10_000


def states(data: np.ndarray) -> np.ndarray:
    """The state before each byte."""
    n = len(data)
    width = max(1, int(np.sqrt(n)))
    grid = np.full(-(-n // width) * width, SAME, np.uint8)
    grid[:n] = STEP[CLASS[data]]
    grid = grid.reshape(-1, width)
    for j in range(1, width):
        grid[:, j] = THEN[grid[:, j - 1], grid[:, j]]
    first, s = np.zeros(len(grid), np.uint8), START
    for i, last in enumerate(grid[:, -1].tolist()):
        first[i], s = s, last >> 2 * s & 3
    after = (grid >> (2 * first)[:, None] & 3).reshape(-1)[:n]
    return np.concatenate([np.full(min(n, 1), START, np.uint8), after[:-1]])


def records(content: bytes) -> pa.ListArray:
    """The records of a CSV text, each a list of its fields; an empty line is an empty record."""
    data = np.frombuffer(content, np.uint8)
    kind, before = CLASS[data], states(data)
    open_ = before != QUOTED
    feed = (data == 10) & open_
    feed[1:] &= (data[:-1] == 13) & open_[:-1]
    feed[:1] = False  # a line feed right behind the return that ended the record
    ends = (kind >= COMMA) & open_ & ~feed
    keep = ~ends & ~feed & ~((kind == QUOTE) & ((before == START) | (before == QUOTED)))
    at = np.flatnonzero(ends)
    line = kind[at] == LINE
    if len(data) and not (ends | feed)[-1] or len(at) and not line[-1]:
        at, line = np.append(at, len(data)), np.append(line, True)
    # A field begins behind the separator (and line feed) before it.
    begin = np.concatenate([[0], at[:-1] + 1])
    begin = begin + feed[np.minimum(begin, max(len(data) - 1, 0))] * (begin < len(data)) if len(data) else begin[:0]
    new = np.concatenate([[True], line[:-1]]) if len(at) else line
    blank = new & line & (begin == at)
    before_ = np.concatenate([[0], np.cumsum(keep)])
    offsets = np.concatenate([[0], before_[at[~blank]]]).astype(np.int64)
    fields = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[keep])))
    sizes = np.cumsum(~blank)[line]
    return pa.ListArray.from_arrays(np.concatenate([[0], sizes]).astype(np.int32), fields.cast(pa.string()))


def mode_of(content: bytes) -> str:
    """A: the first line starts with three commas and names a table, and five records stand before the header. B: all others."""
    first = content.replace(b"\r", b"\n", 1).split(b"\n", 1)[0]
    return "A" if first.startswith(b",,,") and b'"Table ' in first else "B"


def two_mode(texts: DataFrame, key: str, content: str) -> DataFrame:
    """SRC-1: (key, mode, row_idx, cells, error) of CSV files, a row a record, the header first with its cells trimmed.

    A byte order mark goes; records are padded to the header. A file whose header is missing or an empty line, that is
    null, or that isn't UTF-8 gives its row 0 only, without cells and with an error.
    """

    def run(batches):
        schema = pa.schema([("mode", pa.string()), ("row_idx", pa.int32()), ("width", pa.int32()), ("cells", pa.list_(pa.string())), ("error", pa.string())])
        for batch in batches:
            for i in range(len(batch)):
                own, raw = batch.column(0).slice(i, 1), (batch.column(1)[i].as_py() or b"").removeprefix(b"\xef\xbb\xbf")
                mode, error, cells = mode_of(raw), None, pa.array([[]], pa.list_(pa.string()))
                try:
                    raw.decode()
                    found = records(raw)[PRELUDE if mode == "A" else 0 :]
                    error = None if len(found) and len(found[0]) else "empty header"
                    cells = cells if error else found
                except UnicodeDecodeError:
                    error = "not UTF-8"
                width = len(cells[0])
                for a in range(0, len(cells), ROWS):
                    n = min(ROWS, len(cells) - a)
                    rest = [pa.array([mode] * n), pa.array(range(a, a + n), pa.int32()), pa.array([width] * n, pa.int32()), cells.slice(a, n), pa.array([error] * n, pa.string())]
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([own] * n), *rest], ["key", *schema.names])

    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(F.col(key).alias("key"), F.col(content).cast("binary")).mapInArrow(run, f"key {kind}, mode string, row_idx int, width int, cells array<string>, error string")
    trimmed = F.transform("cells", lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.col("width") - F.size("cells"), F.lit(0))))
    return rows.select(F.col("key").alias(key), "mode", "row_idx", F.when(F.col("row_idx") == 0, trimmed).otherwise(padded).alias("cells"), "error")


def two_mode_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: ``two_mode`` of the files at ``path``: (path, mode, row_idx, cells, error)."""
    return two_mode(files(spark, path), "path", "content")
