"""Packing by lexical retrieval: a sharded BM25 index returns unused neighbours of each seed, which fill its window.

Every document is its token ids and one id 0. Whole windows of it are sequences of their own; what is left (its
tail, under one window) is packed with lexically similar tails. Tails are dealt by range over a min-hash of their
token pairs, then by id, so that like tails meet, a hot group of copies is split, and partitions have like sizes.
A partition cuts its tails into shards of ``shard`` pieces; each shard has an inverted index with BM25 weights
whose document frequencies and mean length come from all tails of the corpus. A seed takes its unused neighbours
by falling score while they fit; the best neighbour that doesn't fit is cut to fill the window, and the rest of
it stays in the pool (with the postings of the whole tail). An unfilled last window goes on to the next shard;
one window a partition at most is padded.

Defined results: null text is empty and has one id; a special token's string is that token, wherever it stands; repeated rows are documents of their own, so each id lies in
exactly one piece per row; ties go to the smaller (signature, doc_id, row checksum); an empty table gives no row.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from factloom.llm._common import mix, rolling, written

WINDOW = 1024
#: Pieces of one BM25 shard.
SHARD = 256
#: Words whose ids a Python worker keeps.
CACHE_WORDS = 400_000
K1, B = 1.2, 0.75
_TAIL = 1 << 61
_STATE: dict = {}


class Encoder:
    """Ids of texts as bytes of unsigned 16-bit integers. Strings of the vocabulary's added tokens are those tokens.

    Ids of a text are those of its pieces between spaces: before a space that follows another character a token
    always ends. Only runs of white space need more care; such texts are cut where one space stands alone.
    """

    _alone = re.compile(r"(?<=\S) (?=\S)")
    _run = re.compile(r" \s")

    def __init__(self, path: str, added: dict[str, int] | None = None):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if len(ranks) > 1 << 16:
            raise ValueError("ids are kept as 16-bit numbers; this vocabulary is larger")
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        outer = self

        class Cache(dict):
            def __missing__(self, word):
                ids = np.array(outer.encode(" " + word), np.uint16).tobytes()
                if len(self) < CACHE_WORDS and len(word) < 64:
                    self[word] = ids
                return ids

        self.cache = Cache()
        self.added = {k: np.array([v], np.uint16).tobytes() for k, v in (added or {}).items()}
        self.mark = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def __call__(self, text: str) -> np.ndarray:
        parts = self.mark.split(text) if self.mark and self.mark.search(text) else [text]
        return np.frombuffer(b"".join(self.added[p] if i % 2 else self._plain(p) for i, p in enumerate(parts)) + b"\0\0", np.uint16)

    def _plain(self, text: str) -> bytes:
        words = self._alone.split(text) if self._run.search(text) else text.split(" ")
        get = self.cache.__getitem__
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        return np.array(self.encode(words[0]), np.uint16).tobytes() + b"".join(map(get, words[1:]))


def _encoder(path: str) -> Encoder:
    if path not in _STATE:
        _STATE[path] = Encoder(path, added_tokens())
    return _STATE[path]


def vocabulary_path() -> str:
    """The byte-level BPE of 50,257 ids as ranks: the vocabulary of ``byte_bpe_50k.json``, whose ids it gives."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens() -> dict[str, int]:
    """Strings that the vocabulary keeps as tokens of their own, by ``byte_bpe_50k.json``."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(docs: DataFrame, path: str | None, window: int) -> DataFrame:
    """Pieces: whole windows with their sequence, tails with their ids and signature."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        encode, base, n = _encoder(path or vocabulary_path()), TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                own = batch.slice(at, 512)
                rows, which = [], []
                for i, text in enumerate(own.column(1).to_pylist()):
                    ids = encode(text or "")
                    for s in range(0, len(ids), window):
                        part = ids[s : s + window]
                        which.append(i)
                        if len(part) == window:
                            rows.append((s, window, crc(part), len(ids), base + n, 0, None, 0))
                            n += 1
                        else:
                            pairs = rolling(part.astype(np.uint64), 2)
                            rows.append((s, len(part), 0, len(ids), None, None, part.tobytes(), int(pairs.min() >> np.uint64(1)) if len(pairs) else int(mix(part[:1])[0] >> np.uint64(1))))
                kinds = (pa.int64(),) * 6 + (pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds))], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "signature"])

    return docs.mapInArrow(run, f"id {kind}, {_PIECE}, ids binary, signature long")


def _frequencies(tails: DataFrame) -> tuple[np.ndarray, int, float]:
    """In how many tails each id is (65,536 counts at most, whatever the input), the number of tails, their mean length."""

    def run(batches):
        seen = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column(0):
                seen[np.unique(np.frombuffer(x.as_buffer(), np.uint16))] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["token", "n"])

    df = np.zeros(1 << 16, np.int64)
    for r in tails.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        df[r.token] = r.n
    total = tails.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    return df, total.n, total.mean or 1.0


class _Index:
    """Inverted BM25 index of one shard."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean: float):
        n = np.array([len(p) for p in pieces])
        key = np.repeat(np.arange(len(pieces), dtype=np.int64) << 16, n) | np.concatenate(pieces)
        key, tf = np.unique(key, return_counts=True)
        self.doc, self.token = key >> 16, key & 0xFFFF
        weight = idf[self.token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[self.doc] / mean))
        order = np.argsort(self.token, kind="stable")
        self.posting, self.weight = self.doc[order], weight[order]
        first = np.searchsorted(self.token[order], np.arange((1 << 16) + 1))
        self.first, self.count = first[:-1], np.diff(first)
        self.of = np.searchsorted(self.doc, np.arange(len(pieces) + 1))
        self.size = len(pieces)

    def scores(self, i: int) -> np.ndarray:
        t = self.token[self.of[i] : self.of[i + 1]]
        n = self.count[t]
        at = np.repeat(self.first[t] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.posting[at], self.weight[at], self.size)


def _fill(rows: list[list], idf: np.ndarray, mean: float, window: int):
    """Windows of one shard, each a list of [row, first id, last id + 1]; the last may be unfilled."""
    index, left = _Index([r[2] for r in rows], idf, mean), np.array([len(r[2]) for r in rows])
    at = np.zeros(len(rows), np.int64)
    for seed in range(len(rows)):
        while left[seed]:  # a seed that was cut earlier starts its own window with what is left
            own, room = [[seed, int(at[seed]), len(rows[seed][2])]], window - int(left[seed])
            left[seed] = 0
            if room:
                score = index.scores(seed)
                order = np.flatnonzero(left)
                order = order[np.argsort(-score[order], kind="stable")]
                for j in order.tolist():
                    if left[j] <= room:
                        own.append([j, int(at[j]), len(rows[j][2])])
                        room -= int(left[j])
                        left[j] = 0
                        if not room:
                            break
                if room and left.any():
                    j = next(j for j in order.tolist() if left[j])
                    own.append([j, int(at[j]), int(at[j]) + room])
                    at[j] += room
                    left[j] -= room
                    room = 0
            yield own, room


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard: int = SHARD, path: str | None = None) -> DataFrame:
    """Pieces of all documents: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = written(_cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), path, window))
    tails = cut.filter("ids is not null")
    df, total, mean = _frequencies(tails)
    idf = docs.sparkSession.sparkContext.broadcast(np.log(1 + (total - df + 0.5) / (df + 0.5)))

    def run(batches):
        base, n, rows, arrow = _TAIL | TaskContext.get().partitionId() << 40, 0, [], None

        def out(done):
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], arrow), *(pa.array([d[i] for d in done], pa.int64()) for i in range(1, 7))], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def flush(last):
            nonlocal n, rows
            done, kept = [], []
            for own, room in _fill(rows, idf.value, mean, window):
                if room and not last:
                    kept += [[rows[j][0], rows[j][1] + a, rows[j][2][a:z], rows[j][3]] for j, a, z in own]
                    continue
                offset = 0
                for j, a, z in own:
                    done.append((rows[j][0], rows[j][1] + a, z - a, crc(rows[j][2][a:z]), rows[j][3], base + n, offset))
                    offset += z - a
                n += 1
            rows = kept
            return out(done)

        for batch in batches:
            arrow = batch.column(0).type
            for i, start, ids, size in zip(*(batch.column(k).to_pylist() for k in range(4))):
                rows.append([i, start, np.frombuffer(ids, np.uint16), size])
                if len(rows) >= shard:
                    yield flush(False)
        if rows:
            yield flush(True)

    parts = max(1, -(-total // (16 * shard)))
    kind = cut.schema["id"].dataType.simpleString()
    tails = tails.withColumn("sum", F.crc32("ids")).repartitionByRange(parts, "signature", "id", "sum").sortWithinPartitions("signature", "id", "sum").select("id", "start", "ids", "doc_tokens")
    packed = tails.mapInArrow(run, f"id {kind}, {_PIECE}")
    return cut.filter("ids is null").select(packed.columns).unionByName(packed).withColumnRenamed("id", id_col)


def op1(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole of ``documents``."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
