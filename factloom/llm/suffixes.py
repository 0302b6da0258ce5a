"""Removal of byte strings that also start earlier, by merging shard Burrows-Wheeler transforms.

Every ``length``-byte string is owned by its anchor, the leftmost least hash among its ``GRAM``-byte grams, so equal
strings have equal anchors. Consecutive starts with one anchor make a window. Windows are shuffled by anchor as hashes
only: anchors that occur once hold nothing repeated; of equal windows all but the earliest repeat whole. What is left
are anchors with several different windows (the edges of repeats); only their texts are fetched. In each shuffle group
these are cut into shards, each shard's transform is built by prefix doubling, and the transforms are merged all at
once by iterative interleave refinement: a round reads the interleave in order, moves back along the shards'
last-to-first mappings and deals the rows out stably, without sorting suffixes again; a block of rows then has a
common prefix that is longer by the step. Steps double, as the mappings are composed with themselves. At ``length``
symbols a block is an interval of suffixes with a common prefix of that length: a repeated string, of which the
earliest stays.

A chunk of windows is counted in its task before it is shuffled: of equal ones the earliest goes on, and an anchor with
over ``HOT`` different windows in a chunk sends a mark in their place, upon which all its windows are spread by the
hashes of their strings, as they must not meet in one task. Strings never cross documents. Order is by id (null last),
then a hash of the text, then place. Hashes of 96 bits, the anchor's and the window's, stand for window texts.

Defined results: null texts are empty; texts under ``length`` bytes keep all; rows that repeat an id and a text are
one document and get one result each, rows that repeat an id only are documents in the order of their texts' hashes;
an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm._common import Scratch, mix, prefix_hash, span_hash, text_steps, written

LENGTH, GRAM = 100, 40
#: Windows of a chunk and of a shuffle group, bytes of a shard, a merge (whole anchors, so more for a large one) and a group of merges, different windows of a chunk that make an anchor hot.
CHUNK, GROUP, SHARD, MERGE, MERGES, HOT = 1 << 17, 250_000, 1 << 15, 1 << 17, 1 << 21, 64
_NULL_ID = (1 << 63) - 1
_LOW = np.uint64((1 << 48) - 1)
#: d is the document's place in its chunk, n the number of starts; a record without starts marks a hot anchor.
_WINDOW = np.dtype([("a", "<u8"), ("w", "<u8"), ("d", "<u2"), ("s", "<u4"), ("n", "u1")])
_WIDTHS = (("a", 6), ("w", 6), ("d", 2), ("s", 4), ("n", 1))
_SPANS = "kind int, anchor long, doc long, tag long, spans binary"


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with n, a number in the order of the ids; ids that aren't whole numbers are numbered by a sort."""
    if docs.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        return docs.withColumn("n", F.col("id").cast("long"))
    ids = docs.select("id").filter("id is not null").distinct()
    ids = written(ids.repartitionByRange("id").sortWithinPartitions("id").withColumn("n", F.monotonically_increasing_id()))
    return docs.join(ids, "id", "left")


def _keys(docs: DataFrame) -> DataFrame:
    """doc (a number that is never null), tag (the text's hash), text."""
    return docs.select(F.coalesce("n", F.lit(_NULL_ID)).alias("doc"), F.xxhash64("text").alias("tag"), "text")


def _windows(data: np.ndarray, off: np.ndarray, length: int):
    """Of the texts in a step: document's place, start in it, number of starts, anchor's hash, window's hash."""
    n = len(data) - length + 1
    if n <= 0:
        return None
    c = prefix_hash(data)
    grams = len(data) - GRAM + 1
    h = span_hash(c, np.arange(grams), np.arange(grams) + GRAM)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    width, wide = length - GRAM + 1, 1
    while wide * 2 <= width:
        key = np.minimum(key[: len(key) - wide], key[wide:])
        wide *= 2
    if width > wide:
        key = np.minimum(key[: len(key) - (width - wide)], key[width - wide :])
    anchor = (key[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    at = np.flatnonzero(np.arange(n) + length <= off[doc + 1])
    if not len(at):
        return None
    cut = np.flatnonzero(np.concatenate([[True], (anchor[at][1:] != anchor[at][:-1]) | (at[1:] != at[:-1] + 1) | (doc[at][1:] != doc[at][:-1])]))
    s, many = at[cut], np.diff(np.concatenate([cut, [len(at)]]))
    a = anchor[s]
    w = mix(span_hash(c, s, s + many + length - 1) + (a - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    # Anchors are least hashes, so they are mixed again before they are dealt by their leading bits.
    return doc[s], s - off[doc[s]], many, mix(h[a]), w


def _news(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _blob(x: np.ndarray, docs: np.ndarray) -> bytes:
    """Records with the documents (number, tag) that they name, column by column."""
    own, d = np.unique(x["d"], return_inverse=True)
    x = x.copy()
    x["d"] = d
    planes = [np.ascontiguousarray(x[c]).view(np.uint8).reshape(len(x), -1)[:, :k].tobytes() for c, k in _WIDTHS]
    return np.array([len(own), len(x)], "<u4").tobytes() + docs[own].tobytes() + b"".join(planes)


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    own, n = np.frombuffer(blob, "<u4", 2)
    docs, at, x = np.frombuffer(blob, "<i8", 2 * own, 8).reshape(-1, 2), 8 + 16 * int(own), np.zeros(n, _WINDOW)
    for c, k in _WIDTHS:
        wide = np.zeros((n, x[c].dtype.itemsize), np.uint8)
        wide[:, :k] = np.frombuffer(blob, np.uint8, k * int(n), at).reshape(n, k)
        x[c] = wide.reshape(-1).view(x[c].dtype)
        at += k * int(n)
    return x, docs[x["d"]]


def _packed(docs: DataFrame, parts: int, length: int) -> DataFrame:
    """Windows packed by shuffle group (kind 1). Of equal windows in a chunk the earliest only; the others (kind 0) and those of its hot anchors (kind 2) are packed without a need to meet."""

    def flush(held, docs):
        x, docs = np.concatenate(held), np.array(docs, "<i8").reshape(-1, 2)
        key = docs[x["d"]]
        order = np.lexsort((x["s"], key[:, 1], key[:, 0], x["w"], x["a"]))
        x, key = x[order], key[order]
        x = x[_news(x["a"], x["w"], key[:, 0], key[:, 1], x["s"])]  # rows that repeat an id and a text are one document
        first = _news(x["a"], x["w"])
        own, rest = x[first], x[~first]
        new = np.flatnonzero(_news(own["a"]))
        hot = np.diff(np.append(new, len(own))) > HOT
        many = np.repeat(hot, np.diff(np.append(new, len(own))))
        marks = own[new[hot]]
        marks["n"] = 0
        send = np.concatenate([own[~many], marks])
        send = send[np.lexsort((send["s"], send["d"]))]
        part = ((send["a"] >> np.uint64(48)) * np.uint64(parts)) >> np.uint64(16)
        order = np.argsort(part.astype(np.uint16), kind="stable")
        p, start = np.unique(part[order], return_index=True)
        rows = [(1, int(k), _blob(b, docs)) for k, b in zip(p, np.split(send[order], start[1:])) if len(b)]
        rows += [(kind, 0, _blob(b, docs)) for kind, b in ((0, rest), (2, own[many])) if len(b)]
        c = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary())], ["kind", "part", "blob"])

    def run(batches):
        held, names, size = [], [], 0
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, data, off in text_steps(batch.column(2)):
                found = _windows(data, off, length)
                if found is None:
                    continue
                if held and len(names) + j - i > 0xFFFF:
                    yield flush(held, names)
                    held, names, size = [], [], 0
                doc, s, many, a, w = found
                # A step of very many short texts is cut where its documents' places would not fit.
                for lo in range(0, j - i, 0xFFFF):
                    part = (doc >= lo) & (doc < lo + 0xFFFF)
                    if lo and held:
                        yield flush(held, names)
                        held, names, size = [], [], 0
                    x = np.zeros(int(part.sum()), _WINDOW)
                    x["a"], x["w"], x["d"], x["s"], x["n"] = a[part], w[part], len(names) + doc[part] - lo, s[part], many[part]
                    held.append(x)
                    names += zip(ids[i + lo : min(j, i + lo + 0xFFFF)].tolist(), tags[i + lo : min(j, i + lo + 0xFFFF)].tolist())
                    size += len(x)
                if size > CHUNK:
                    yield flush(held, names)
                    held, names, size = [], [], 0
        if held and size:
            yield flush(held, names)

    return docs.mapInArrow(run, "kind int, part int, blob binary")


def _spans(kind: int, x: np.ndarray, docs: np.ndarray, length: int, anchor: np.ndarray | None = None) -> pa.RecordBatch:
    """Windows as spans (start, stop): without anchors one row for each document, all its spans in it."""
    pairs = np.stack([x["s"].astype("<i8"), x["s"].astype("<i8") + x["n"] + length - 1], 1)
    if anchor is None:
        order = np.lexsort((x["s"], docs[:, 1], docs[:, 0]))
        docs, pairs = docs[order], pairs[order]
        start = np.flatnonzero(_news(docs[:, 0], docs[:, 1]))
        blobs, docs, anchor = [b.tobytes() for b in np.split(pairs, start[1:])] if len(start) else [], docs[start], np.zeros(len(start), np.int64)
    else:
        blobs = [b.tobytes() for b in pairs]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(blobs), kind, np.int32)), pa.array(anchor.astype(np.int64)), pa.array(docs[:, 0]), pa.array(docs[:, 1]), pa.array(blobs, pa.binary())], ["kind", "anchor", "doc", "tag", "spans"])


def _met(packed: DataFrame, length: int) -> DataFrame:
    """kind 0: spans that repeat whole; 1: windows whose texts must be compared; 2: those of hot anchors."""

    def group(key, table):
        x, docs = map(np.concatenate, zip(*(_unblob(b) for b in table.column("blob").to_pylist())))
        order = np.lexsort((x["s"], docs[:, 1], docs[:, 0], x["w"], x["a"]))
        x, docs = x[order], docs[order]
        once = _news(x["a"], x["w"], docs[:, 0], docs[:, 1], x["s"], x["n"])
        x, docs = x[once], docs[once]
        new = _news(x["a"])
        at = np.flatnonzero(new)
        marked = np.repeat(np.maximum.reduceat((x["n"] == 0).astype(np.int8), at) > 0, np.diff(np.append(at, len(x))))
        real = x["n"] > 0
        x, docs, marked = x[real], docs[real], marked[real]
        first = _news(x["a"], x["w"])
        own, own_docs, hot = x[first], docs[first], marked[first]
        at = np.flatnonzero(_news(own["a"]))
        several = np.repeat(np.diff(np.append(at, len(own))), np.diff(np.append(at, len(own)))) > 1
        pick = several & ~hot
        anchor = ((own["a"] & _LOW) | np.uint64(key[0].as_py() << 48)).view(np.int64)
        return pa.Table.from_batches([_spans(0, x[~first], docs[~first], length), _spans(1, own[pick], own_docs[pick], length, anchor[pick]), _spans(2, own[hot], own_docs[hot], length)])

    def alone(batches):
        for batch in batches:
            for kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, docs = _unblob(blob)
                yield _spans(kind, x, docs, length)

    return packed.filter("kind = 1").groupBy("part").applyInArrow(group, _SPANS).unionByName(packed.filter("kind <> 1").select("kind", "blob").mapInArrow(alone, _SPANS))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of wanted spans."""
    spans = wanted.groupBy("doc", "tag").agg(F.collect_list(F.struct("kind", "anchor", "spans")).alias("wanted"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                out = []
                for doc, tag, text, wanted in zip(*(own.column(i).to_pylist() for i in range(4))):
                    raw = text.encode()
                    out += [(x["kind"], x["anchor"], doc, tag, a, raw[a:z]) for x in wanted for a, z in np.frombuffer(x["spans"], "<i8").reshape(-1, 2).tolist()]
                c = list(zip(*out)) or [()] * 6
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(c, kinds)], ["kind", "anchor", "doc", "tag", "start", "raw"])

    return docs.join(spans, ["doc", "tag"]).select("doc", "tag", "text", "wanted").mapInArrow(run, "kind int, anchor long, doc long, tag long, start long, raw binary")


def _numbers(doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Documents numbered in their order."""
    order = np.lexsort((tag, doc))
    out = np.empty(len(doc), np.int32)
    out[order] = np.cumsum(_news(doc[order], tag[order]))
    return out


def _stable(key: np.ndarray) -> np.ndarray:
    """The stable order of numbers below 2**32, by two counting passes."""
    order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    high = key >> 16
    return order[np.argsort(high[order].astype(np.uint16), kind="stable")] if len(key) and high.any() else order


def _transform(text: np.ndarray, before: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform, last-to-first mapping and suffix places of a shard: its cyclic strings' rotations, sorted by ``length`` symbols by prefix doubling."""
    order, _ = refine(np.arange(len(text), dtype=np.int32), text, before, length)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return text[before[order]], place[before[order]], order


def refine(row: np.ndarray, symbols: np.ndarray, back: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their ``length`` symbols, and the block, of rows with a common prefix, of each.

    ``symbols`` is a row's first symbol and ``back`` the row of the string that starts one symbol earlier. A round reads
    the rows in the order known so far, moves each back by as many symbols as are known, and deals them out stably by
    their own blocks, so that they are ordered by twice as many.
    """
    block = np.empty(len(row), np.int32)
    order = _stable(symbols.astype(np.int32))
    row = row[order]
    first = symbols[row]
    block[row] = np.cumsum(_news(first)) - 1
    done, powers = 1, [back.astype(np.int32)]
    while done < length:
        step = min(done, length - done)
        if step == done:
            jump = powers[-1]
            powers.append(jump[jump])
        else:
            jump, left = None, step
            for p in powers:
                if left & 1:
                    jump = p if jump is None else p[jump]
                left >>= 1
        tail = block[row]  # what follows the symbols known, in order
        to = jump[row]
        own = block[to]
        order = _stable(own)
        row, own, tail = to[order], own[order], tail[order]
        block[row] = np.cumsum(_news(own, tail)) - 1
        done += step
    return row, block[row]


def merge(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all shards in merged order (by ``length`` symbols) and the block, of rows with a common prefix, of each.

    ``shards``: transform, last-to-first mapping and suffix places of each.
    """
    base = np.cumsum([0, *(len(s[0]) for s in shards)])
    back = np.concatenate([s[1] + b for s, b in zip(shards, base)]).astype(np.int32)
    # A row's first symbol is the transform's symbol of the row that its mapping comes from.
    symbols = np.empty(base[-1], shards[0][0].dtype)
    symbols[back] = np.concatenate([s[0] for s in shards])
    return refine(np.arange(base[-1], dtype=np.int32), symbols, back, length)


def _repeated(raws: list[bytes], doc: np.ndarray, tag: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """(window, offset) pairs of strings that another window of the list has earlier."""
    size = np.array([len(r) for r in raws])
    shards, string, offset, at = [], [], [], 0
    while at < len(raws):
        z = at + 1
        while z < len(raws) and size[at : z + 1].sum() + z - at < SHARD:
            z += 1
        # Byte 0 ends each string; UTF-8 texts may hold it, so all other bytes move up by one symbol.
        text = np.zeros(int((size[at:z] + 1).sum()), np.uint16)
        first = np.cumsum([0, *(size[at:z] + 1)])
        ends = np.ones(len(text), bool)
        ends[first[1:] - 1] = False
        text[ends] = np.frombuffer(b"".join(raws[at:z]), np.uint8).astype(np.uint16) + 1
        before = np.arange(-1, len(text) - 1)
        before[first[:-1]] = first[1:] - 1
        bwt, back, order = _transform(text, before, length)
        shards.append((bwt, back, order))
        own = np.repeat(np.arange(at, z), size[at:z] + 1)
        string.append(own[order])
        offset.append((np.arange(len(text)) - np.repeat(first[:-1], size[at:z] + 1))[order])
        at = z
    row, block = merge(shards, length)
    string, offset = np.concatenate(string)[row], np.concatenate(offset)[row]
    whole = offset + length <= size[string]
    string, offset, block = string[whole], offset[whole], block[whole]
    # Blocks of one row hold nothing repeated.
    alone = _news(block) & np.append(_news(block)[1:], True)
    string, offset, block = string[~alone], offset[~alone], block[~alone]
    owner = _numbers(doc, tag)
    order = np.lexsort((start[string] + offset, owner[string], block))
    later = ~_news(block[order])
    return np.stack([string[order][later], offset[order][later]], 1)


def _joined(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Table:
    """One row for each document with its spans."""
    order = np.lexsort((start, tag, doc))
    doc, tag, pairs = doc[order], tag[order], np.stack([start[order], stop[order]], 1).astype("<i8")
    at = np.flatnonzero(_news(doc, tag))
    return pa.table({"doc": pa.array(doc[at], pa.int64()), "tag": pa.array(tag[at], pa.int64()), "spans": pa.array([b.tobytes() for b in np.split(pairs, at[1:])] if len(at) else [], pa.binary())})


def _compared(texts: DataFrame, parts: int, length: int) -> DataFrame:
    """Spans of strings that repeat, from the windows of usual anchors."""

    def run(key, table):
        table = table.sort_by([("anchor", "ascending"), ("doc", "ascending"), ("tag", "ascending"), ("start", "ascending")])
        anchor, doc, tag, start = (table.column(c).to_numpy() for c in ("anchor", "doc", "tag", "start"))
        once = _news(anchor, doc, tag, start)  # rows that repeat an id and a text are one document
        anchor, doc, tag, start = anchor[once], doc[once], tag[once], start[once]
        raws = [r for r, ok in zip(table.column("raw").to_pylist(), once) if ok]
        size = np.cumsum([0, *(len(r) for r in raws)])
        new = np.flatnonzero(_news(anchor))
        out, a = [], 0
        while a < len(raws):  # whole anchors, about MERGE bytes at a time
            z = int(np.searchsorted(new, np.searchsorted(size, size[a] + MERGE)))
            z = int(new[z]) if z < len(new) else len(raws)
            if z <= a:
                nxt = new[new > a]
                z = int(nxt[0]) if len(nxt) else len(raws)
            out.append(_repeated(raws[a:z], doc[a:z], tag[a:z], start[a:z], length) + [a, 0])
            a = z
        hit = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        w, o = hit[:, 0], hit[:, 1]
        order = np.lexsort((o, w))
        w, o = w[order], o[order]
        cut = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (o[1:] != o[:-1] + 1)])) if len(w) else np.zeros(0, int)
        last = np.concatenate([cut[1:], [len(w)]]) - 1 if len(w) else cut
        return _joined(doc[w[cut]], tag[w[cut]], start[w[cut]] + o[cut], start[w[cut]] + o[last] + length)

    return texts.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(run, "doc long, tag long, spans binary")


def _spread(texts: DataFrame, length: int) -> DataFrame:
    """The same for hot anchors: all strings of their windows by hash, the least place of each added up before the shuffle."""

    def run(batches):
        for batch in batches:
            for doc, tag, start, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                c = prefix_hash(np.frombuffer(raw, np.uint8))
                at = np.arange(len(raw) - length + 1)
                yield pa.RecordBatch.from_arrays([pa.array(span_hash(c, at, at + length).view(np.int64)), pa.array(np.full(len(at), doc)), pa.array(np.full(len(at), tag)), pa.array(start + at)], ["h", "doc", "tag", "start"])

    def pack(batches):
        for batch in batches:
            doc, tag, start = (batch.column(i).to_numpy() for i in range(3))
            yield from _joined(doc, tag, start, start + length).to_batches()

    s = texts.select("doc", "tag", "start", "raw").mapInArrow(run, "h long, doc long, tag long, start long")
    least = s.groupBy("h").agg(F.min(F.struct("doc", "tag", "start")).alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "m")
    return s.join(least, "h").filter(F.struct("doc", "tag", "start") > F.col("m")).select("doc", "tag", "start").mapInArrow(pack, "doc long, tag long, spans binary")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each row of ``docs``: id, kept (the remaining bytes), n_bytes, n_removed, n_spans."""
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    try:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        docs = _numbered(docs)
        keyed = _keys(docs)
        long = keyed.filter(F.octet_length("text") >= length)
        parts = min(1 << 16, max(1, total * 2 // (length - GRAM) // GROUP))
        met = scratch.written(_met(_packed(long, parts, length), length))
        texts = scratch.written(_texts(long, met.filter("kind > 0").select("kind", "doc", "tag", "anchor", "spans")))
        size = texts.filter("kind = 1").agg(F.sum(F.length("raw"))).first()[0] or 0
        cuts = met.filter("kind = 0").select("doc", "tag", "spans").unionByName(_compared(texts.filter("kind = 1"), max(1, int(size) // MERGES), length)).unionByName(_spread(texts.filter("kind = 2"), length))
        cuts = written(cuts)
    finally:
        scratch.drop()
    spans = cuts.groupBy("doc", "tag").agg(F.collect_list("spans").alias("spans"))
    j = docs.select("id", "text", F.coalesce("n", F.lit(_NULL_ID)).alias("doc"), F.xxhash64("text").alias("tag")).join(spans, ["doc", "tag"], "left")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                out = []
                for text, spans in zip(own.column(1).to_pylist(), own.column(2).to_pylist()):
                    raw, kept, gone, many, last = text.encode(), [], 0, 0, 0
                    pairs = np.frombuffer(b"".join(spans or ()), "<i8").reshape(-1, 2)
                    for s, e in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
                        if s > last or many == 0:
                            kept.append(raw[last:s])
                            many += 1
                            gone += e - s
                        else:
                            gone += max(0, e - last)
                        last = max(last, e)
                    kept.append(raw[last:])
                    out.append((b"".join(kept), len(raw), gone, many))
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(c[0], pa.binary()), *(pa.array(c[i], pa.int64()) for i in (1, 2, 3))], ["id", "kept", "n_bytes", "n_removed", "n_spans"])

    return j.select("id", "text", "spans").mapInArrow(run, f"id {kind}, kept binary, n_bytes long, n_removed long, n_spans long").withColumnRenamed("id", id_col)


def op8(spark, sf_dir: str) -> DataFrame:
    """The contract's digest columns for the whole of ``documents``."""
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
