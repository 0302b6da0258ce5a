"""Exact n-gram Jaccard join by universe partitions and the pigeonhole principle.

A text's words are maximal runs of characters other than space, tab and line ends, A-Z lowered; its set is the
distinct 64-bit hashes of ``n`` consecutive words (of all its words, if fewer). Texts of one set are one class.
Two classes link when 100 * intersection >= 80 * union, so their symmetric difference is at most
floor((|R| + |S|) / 9), and a quarter of either set.

A shingle that no other class holds differs from every partner. Such own shingles are counted twice. First over half
of the hash universe, by 24 bits of every hash and without naming classes (both can only lower a count): sets with
over a quarter of own shingles link with nothing, which settles most texts at the cost of one number a shingle. Then
exactly, among the classes that are left. From there on only the shared shingles of a class matter, and its own ones
are charged to the bound: a pair with u and v own ones may differ in floor((|R| + |S|) / 9) - u - v shared shingles.
So texts that were each changed on their own and just miss the threshold are ruled out by two numbers, and others that
meet in a list by the parities of their shared shingles in buckets, which bound the difference from below.

Sizes fall into bands. A band cuts the hash universe into segments, more than the difference allowed, so linked sets
agree in some segments. The larger set R probes its own band and those below that can hold its partners; S is indexed
in its own band by the content of every segment that is not empty. In bands of small sets segments are fewer and
larger, and the one-deletion neighbourhood of each is indexed and probed as well, so that an agreement within one
element counts twice. Costs are allocated by R: in the other bands it may skip as many segments as it has beyond the
pigeonhole's need, and skips those whose index lists are the longest. A set whose segments are too few for the bound
is also found by the prefix filter: it and all sets that could be its partners list some shared shingles, as many as
no linked pair can all differ in. So no link is lost.

Classes meet the member of their lists with the fewest own shingles first; verified links make components, and then
every remaining candidate pair between different components is verified on the whole sets, so no link between
components is lost and a group of near copies costs no pair of its members. Hashes of 64 bits stand for shingles.

Defined results: null, empty and wordless texts have size 0 and link with nothing; repeated rows are one class
and one row each; a component is named by the smallest doc_id that reaches it (null ids never do, unless alone);
an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from factloom.llm._common import LOWER, NOT_SPACE, Scratch, mix, prefix_hash, rolling, span_hash, text_steps, word_spans, written
from factloom.llm.components import components

#: Sets of fewer elements link only when equal.
LEAST = 4
#: Bands whose sizes stay below this use one-deletion neighbourhoods.
SMALL = 48
#: Shingles of a shuffle group, and of a chunk of sets that is counted together before it is shuffled.
GROUP, CHUNK = 500_000, 1 << 19
#: Index lists longer than this are skipped where the bound leaves room.
LONG_LIST = 24
#: Ids whose texts are read again that are broadcast at most; beyond, the join is by shuffle.
MAX_BROADCAST = 500_000
#: Pairs that one block of a verified set meets.
BLOCK = 512
#: Rounds in which classes meet central members of their lists.
ROUNDS = 3
_U = np.uint64


def _bands(most: int) -> list[int]:
    """Lower ends of the size bands up to a size, and one end beyond."""
    b = [LEAST]
    while b[-1] <= most:
        b.append(b[-1] * 5 // 4 + 1)
    return [*b, b[-1] * 5 // 4 + 1]


_EDGES = np.array(_bands(1 << 31))


def _segments(band: int) -> int:
    end = int(_EDGES[band + 1]) - 1
    h = (end + end * 5 // 4) // 9
    return (h + 2) // 2 + (h > 1) if end < SMALL else h + 3 + h * 6 // 100


def _levels(size: int):
    """Bands that a set of this size probes: its own, and those below that hold sizes of four fifths of it or more."""
    own = int(np.searchsorted(_EDGES, size, "right")) - 1
    low = -(-size * 4 // 5)
    return [k for k in range(own, -1, -1) if _EDGES[k + 1] - 1 >= low]


def _signatures(x: np.ndarray, band: int):
    """Of a sorted set: (signature, is a deletion) arrays, the elements of each segment that is not empty."""
    if not len(x):
        return x, np.zeros(0, bool), np.zeros(0, np.int64)
    m = _segments(band)
    seg = ((x >> _U(32)) * _U(m)) >> _U(32)
    start = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    h = mix(x ^ _U(0x5851F42D4C957F2D))
    total, n = np.add.reduceat(h, start), np.diff(np.concatenate([start, [len(x)]]))
    salt = (_U(band) << _U(40)) + seg[start]
    sig, gone = mix(total + salt * _U(0x9E3779B97F4A7C15)), np.zeros(len(start), bool)
    if _EDGES[band + 1] - 1 < SMALL:
        at = np.repeat(np.arange(len(start)), n)
        ok = n[at] > 1
        less = mix(total[at][ok] - h[ok] + salt[at][ok] * _U(0x9E3779B97F4A7C15))
        sig, gone = np.concatenate([sig, less]), np.concatenate([gone, np.ones(len(less), bool)])
    return sig, gone, n


def _weight(n: np.ndarray, band: int) -> int:
    """What a set's segments of these sizes count in a band."""
    return int(np.minimum(n, 2).sum()) if _EDGES[band + 1] - 1 < SMALL else len(n)


def _parity(x: np.ndarray, band: int) -> list[int]:
    """Parities of the number of elements in buckets, 64 in a word: sets differ in at least as many elements as these differ in bits."""
    end = int(_EDGES[band + 1]) - 1
    bits = 64 * -(-8 * ((end + end * 5 // 4) // 9 + 1) // 64)
    at = ((x & _U(0xFFFFFFFF)) * _U(bits)) >> _U(32)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1, bitorder="little").view(np.int64).tolist()


def _slack(n: np.ndarray, size: int, band: int, own: int = 0) -> int:
    """Weight beyond the pigeonhole's need that a set with ``own`` shingles of its own has in a band; below 0 it is not covered."""
    partner = min(size, int(_EDGES[band + 1]) - 1)
    return _weight(n, band) - ((size + partner) // 9 + 1 - own)


def _sets(column: pa.Array, n: int):
    """The sorted distinct shingle hashes of every text."""
    for _, _, data, off in text_steps(column):
        low = LOWER[data]
        s, e, first = word_spans(low, off, NOT_SPACE)
        h = span_hash(prefix_hash(low), s, e)
        all_ = rolling(h, n)
        for d in range(len(off) - 1):
            i, j = first[d], first[d + 1]
            yield np.unique(all_[i : j - n + 1]) if j - i >= n else rolling(h[i:j], int(j - i)) if j > i else np.zeros(0, np.uint64)


def _class_id(x: np.ndarray) -> int:
    return int(mix(np.array([mix(x + _U(1)).sum() ^ _U(len(x))], np.uint64))[0] >> _U(1)) if len(x) else -1


def _class_id(x: np.ndarray) -> int:
    return int(mix(np.array([mix(x + _U(1)).sum() ^ _U(len(x))], np.uint64))[0] >> _U(1)) if len(x) else -1


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return (((h >> _U(48)) * _U(parts)) >> _U(16)).astype(np.int64)


def _split(part: np.ndarray, *columns: np.ndarray):
    """(part, slices of the columns) for runs of a sorted ``part``."""
    start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, int)
    for i, j in zip(start, np.append(start[1:], len(part))):
        yield int(part[i]), [c[i:j] for c in columns]


def _chunked(rows, most: int = CHUNK):
    """Lists of (head, set) of about ``most`` elements in all."""
    held, size = [], 0
    for head, x in rows:
        held.append((head, x))
        size += len(x)
        if size >= most or len(held) == 0xFFFF:
            yield held
            held, size = [], 0
    if held:
        yield held


_ONCE = "chunk long, part int, blob binary"


def _sized(docs: DataFrame, n: int, parts: int) -> DataFrame:
    """Two kinds of rows: kind 0 has id, set size and class of every row; kind 1 what a chunk of new classes of a task holds.

    The latter are blobs by shuffle group of half of the hash universe: 24 bits of every hash, in order of the group,
    and the place in the chunk of the one class that has it (the highest number for a hash that several have, which
    is sent once a chunk however many they are); the blob of group -1 has the chunk's classes and their sizes.
    """
    kind = docs.schema["id"].dataType
    arrow = [("id", None), ("n_shingles", pa.int64()), ("class", pa.int64()), ("chunk", pa.int64()), ("part", pa.int32()), ("blob", pa.binary()), ("kind", pa.int32())]

    def packed(held, chunk):
        x = np.concatenate([x for _, x in held])
        at = np.repeat(np.arange(len(held), dtype=np.uint16), [len(x) for _, x in held])
        half = x & _U(1) == 0
        x, at = x[half], at[half]
        order = np.argsort(x, kind="stable")
        x, at = x[order], at[order]
        new = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)
        many = new & ~np.append(new[1:], True) if len(x) else new
        x, at = x[new], np.where(many[new], np.uint16(0xFFFF), at[new])
        out = [(-1, np.array([(c, len(s)) for c, s in held], "<i8").tobytes())]
        low = (x >> _U(16)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        for p, (own, who) in _split(_part(x, parts), low, at):
            out.append((p, who.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes() + own.tobytes()))
        p, blobs = zip(*out)
        return [None, None, None, pa.array([chunk] * len(p), pa.int64()), pa.array(p, pa.int32()), pa.array(blobs, pa.binary()), pa.array([1] * len(p), pa.int32())]

    def run(batches):
        first, seen, chunk = None, set(), TaskContext.get().partitionId() << 32

        def whole(columns):
            size = len(next(c for c in columns if c is not None))
            return pa.RecordBatch.from_arrays([pa.nulls(size, t or first) if c is None else c for c, (_, t) in zip(columns, arrow)], [k for k, _ in arrow])

        held, size = [], 0
        for batch in batches:
            first, rows = batch.column(0).type, []
            for x in _sets(batch.column(1), n):
                c = _class_id(x)
                rows.append((len(x), c))
                if len(x) >= LEAST and c not in seen:
                    seen.add(c)
                    held.append((c, x))
                    size += len(x)
                    if size >= CHUNK or len(held) == 0xFFFF:
                        yield whole(packed(held, chunk))
                        held, size, chunk = [], 0, chunk + 1
            a, b = zip(*rows) if rows else ((), ())
            yield whole([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), None, None, None, pa.array([0] * len(rows), pa.int32())])
        if held:
            yield whole(packed(held, chunk))

    schema = StructType([StructField("id", kind), *(StructField(k, t) for k, t in (("n_shingles", LongType()), ("class", LongType()), ("chunk", LongType()), ("part", IntegerType()), ("blob", BinaryType()), ("kind", IntegerType())))])
    return docs.mapInArrow(run, schema)


def _survivors(blobs: DataFrame) -> DataFrame:
    """Classes (class, n) of which a quarter at most is known to be their own."""

    def count(key, table):
        """Of a group: by chunk, how many hashes of each place no other chunk or class has, 4 bytes each."""
        chunks, blobs = table.column("chunk").to_pylist(), table.column("blob").to_pylist()
        size = [len(b) // 5 for b in blobs]
        who = np.concatenate([np.frombuffer(b, np.uint8, 2 * k).reshape(2, k).T.copy().view("<u2")[:, 0] for b, k in zip(blobs, size)])
        low = np.zeros((len(who), 4), np.uint8)
        low[:, :3] = np.concatenate([np.frombuffer(b, np.uint8, 3 * k, 2 * k).reshape(k, 3) for b, k in zip(blobs, size)])
        _, inverse, times = np.unique(low.view("<u4")[:, 0], return_inverse=True, return_counts=True)
        lone = (times[inverse] == 1) & (who != 0xFFFF)
        at, out = np.cumsum([0, *size]), []
        for a, z in zip(at, at[1:]):
            place, k = np.unique(who[a:z][lone[a:z]], return_counts=True)
            out.append(np.stack([place.astype("<u2"), np.minimum(k, 0xFFFF).astype("<u2")]).tobytes())
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "part": pa.array([key[0].as_py()] * len(out), pa.int32()), "blob": pa.array(out, pa.binary())})

    def judge(key, table):
        head, *counts = [b for _, b in sorted(zip(table.column("part").to_pylist(), table.column("blob").to_pylist()))]
        classes, n = np.frombuffer(head, "<i8").reshape(-1, 2).T
        own = np.zeros(len(n), np.int64)
        for b in counts:
            place, k = np.frombuffer(b, "<u2").reshape(2, -1)
            own[place] += k
        keep = 4 * own <= n
        return pa.table({"class": pa.array(classes[keep]), "n": pa.array(n[keep])})

    counts = blobs.filter("part >= 0").groupBy("part").applyInArrow(count, _ONCE)
    return blobs.filter("part < 0").select("chunk", "part", "blob").unionByName(counts).groupBy("chunk").applyInArrow(judge, "class long, n long").distinct()


def _texts_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(class, n, x: the set's sorted hashes) of wanted classes (class, rep), from the texts of the rows that they name; null ids are all looked at."""
    ids = wanted.select("rep").distinct()
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids
    rows = docs.join(ids, docs["id"].eqNullSafe(ids["rep"]), "left_semi").select("text")

    def run(batches):
        for batch in batches:
            for held in _chunked((None, x) for x in _sets(batch.column(0), n)):
                yield pa.RecordBatch.from_arrays([pa.array([_class_id(x) for _, x in held], pa.int64()), pa.array([len(x) for _, x in held], pa.int64()), pa.array([x.tobytes() for _, x in held], pa.binary())], ["class", "n", "x"])

    return rows.mapInArrow(run, "class long, n long, x binary").join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"])


def _shared(sets: DataFrame, parts: int, scratch: Scratch) -> DataFrame:
    """(class, n, u: its own shingles, x: the shared ones, weight of its segments, slack and parities by level) of sets (class, n, x)."""

    def gather(batches):
        chunk = TaskContext.get().partitionId() << 32
        rows = (((c, k), np.frombuffer(x, np.uint64)) for b in batches for c, k, x in zip(*(b.column(i).to_pylist() for i in range(3))))
        for held in _chunked(rows):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([np.array([h for h, _ in held], "<i8").tobytes()], pa.binary()), pa.array([np.concatenate([x for _, x in held]).tobytes()], pa.binary())], ["chunk", "heads", "x"])
            chunk += 1

    chunks = scratch.written(sets.select("class", "n", "x").mapInArrow(gather, "chunk long, heads binary, x binary"))

    def send(batches):
        """Each hash of a chunk once, with a mark where several of its classes have it."""
        for batch in batches:
            for chunk, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                h, k = np.unique(np.frombuffer(x.as_buffer(), np.uint64), return_counts=True)
                p, blobs = zip(*((p, own.tobytes() + np.packbits(many).tobytes()) for p, (own, many) in _split(_part(h, parts), h, k > 1)))
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(p), pa.int64()), pa.array(p, pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "part", "blob"])

    def meet(key, table):
        """For each chunk a bit for each hash that it sent: whether several classes have it."""
        blobs = table.column("blob").to_pylist()
        size = [len(b) * 8 // 65 for b in blobs]
        h = np.concatenate([np.frombuffer(b, np.uint64, k) for b, k in zip(blobs, size)])
        many = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8, -1, 8 * k), count=k) for b, k in zip(blobs, size)]) > 0
        _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
        many |= times[inverse] > 1
        at = np.cumsum([0, *size])
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "blob": pa.array([np.packbits(many[a:z]).tobytes() for a, z in zip(at, at[1:])], pa.binary())})

    bits = chunks.select("chunk", "x").mapInArrow(send, _ONCE).groupBy("part").applyInArrow(meet, _ONCE)
    bits = bits.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "blob"))).alias("bits"))

    def keep(batches):
        for batch in batches:
            for heads, x, bits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                classes, n = np.frombuffer(heads, "<i8").reshape(-1, 2).T
                x = np.frombuffer(x.as_buffer(), np.uint64)
                h, inverse = np.unique(x, return_inverse=True)
                _, size = np.unique(_part(h, parts), return_counts=True)
                many = np.concatenate([np.unpackbits(np.frombuffer(b["blob"], np.uint8), count=k) for b, k in zip(bits, size)])[inverse] > 0
                rows = []
                for own, k, m in zip(np.split(x, np.cumsum(n)[:-1]), n.tolist(), np.split(many, np.cumsum(n)[:-1])):
                    rest = own[m]
                    u, levels = k - len(rest), _levels(k)
                    seg = [_signatures(rest, b)[2] for b in levels]
                    rows.append((u, rest.tobytes(), [_weight(s, b) for s, b in zip(seg, levels)], [_slack(s, k, b, u) for s, b in zip(seg, levels)], [_parity(rest, b) for b in levels]))
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array(n), pa.array(c[0], pa.int64()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.list_(pa.int32())), pa.array(c[3], pa.list_(pa.int32())), pa.array(c[4], pa.list_(pa.list_(pa.int64())))], ["class", "n", "u", "x", "weight", "slack", "parity"])

    out = chunks.join(bits, "chunk").select("heads", "x", "bits").mapInArrow(keep, "class long, n long, u long, x binary, weight array<int>, slack array<int>, parity array<array<long>>")
    return out.filter("4 * u <= n")


def _uncovered(shared: DataFrame) -> set[int]:
    """Bands (some tens at most) that hold partners of sets that their segments don't cover."""
    out: set[int] = set()
    size = shared.filter(F.exists("slack", lambda s: s < 0)).groupBy(F.floor(F.log("n") * 64).alias("b")).agg(F.min("n").alias("n0"), F.max("n").alias("n1"))
    for r in size.collect():
        out |= {*_levels(r.n0), *_levels(r.n1)}
    return out


def _prefix(x: np.ndarray, size: int) -> np.ndarray:
    """Signatures of some shared shingles of a set, as many as linked sets can't all differ in."""
    keep = x[: max(0, len(x) - -(-size * 4 // 5) + 1)]
    return mix(keep ^ _U(0x2545F4914F6CDD1D))


def _signed(shared: DataFrame, uncovered: set[int]) -> DataFrame:
    """Signatures of every class: sig, class, level, gone (a deletion). Level 255 has the prefix signatures."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                for c, n, x in zip(*(batch.column(i).slice(at, 512).to_pylist() for i in range(3))):
                    x, bands = np.frombuffer(x, np.uint64), _levels(n)
                    for level, k in enumerate(bands):
                        sig, gone, _ = _signatures(x, k)
                        out.append((c, level, sig, gone))
                    if any(k in uncovered for k in bands):
                        sig = _prefix(x, n)
                        out.append((c, 255, sig, np.zeros(len(sig), bool)))
                if out:
                    size = [len(o[2]) for o in out]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[2] for o in out]).view(np.int64)), pa.array(np.repeat(np.array([o[0] for o in out], np.int64), size)), pa.array(np.repeat(np.array([o[1] for o in out], np.int32), size)), pa.array(np.concatenate([o[3] for o in out]).astype(np.int32))], ["sig", "class", "level", "gone"])

    return shared.select("class", "n", "x").mapInArrow(run, "sig long, class long, level int, gone int")


def _mixed(lists: DataFrame) -> DataFrame:
    """Rows of lists (with f and comp) that may link with a row of another component, and ``other``: (f, class) of the most central one.

    f is nine times the number of own shingles less the size; classes with f + f' above 0 can't link.
    """
    least = lists.groupBy("sig").agg(F.min(F.struct("f", "class", "comp")).alias("m1"), F.count_if(F.col("level").isin(0, 255)).alias("cost"), F.count_if(F.col("gone") == 0).alias("whole"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    least = least.filter("c0 < c1 and cost > 0 and whole > 0").select("sig", "m1", "cost")
    met = lists.join(least, "sig").filter("comp = m1.comp or f + m1.f <= 0")
    other = met.filter("comp <> m1.comp").groupBy("sig").agg(F.min(F.struct("f", "class")).alias("m2"))
    met = met.join(other, "sig").withColumn("other", F.when(F.col("comp") == F.col("m1.comp"), F.col("m2")).otherwise(F.struct("m1.f", "m1.class")))
    return met.filter("f + other.f <= 0").drop("m1", "m2")


def _candidates(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of different components that may link, a the larger set.

    lists: sig, class, level, gone, comp, cost (length of the index list), n, u, f, weight, slack and parity of the level, open (not covered).
    a skips the longest lists that it can spare. Of a's segments' weight a linked pair shares all but the number of
    shared shingles that it may differ in, less the lists skipped.
    """
    ends = F.array(*(F.lit(int(e)) for e in _EDGES))
    end_of = lambda size, level: F.try_element_at(ends, (F.size(F.filter(ends, lambda e: e <= size)) + 1 - level).cast("int")) - 1
    # Where the probed band has deletions, slack is a weight of up to two a segment and a skipped list could cost both: nothing is skipped.
    plain = F.when(F.col("level") < 255, end_of(F.col("n"), F.col("level")) >= SMALL)
    long_ = F.when(F.col("cost") > LONG_LIST, F.row_number().over(Window.partitionBy("class", "level").orderBy(F.desc("cost"), "sig")))
    probe = lists.withColumn("r", F.when(plain, long_)).withColumn("skip", F.coalesce(F.col("r") <= F.col("slack"), F.lit(False)))
    spared = F.sum(F.col("skip").cast("int")).over(Window.partitionBy("class", "level"))
    # Prefix lists are for sets that their segments don't cover; covered ones find the same partners by their segments.
    probe = probe.withColumn("spared", spared).filter("not skip and (level < 255 or open)")
    probe = probe.select("sig", "level", F.col("class").alias("a"), F.col("n").alias("na"), F.col("u").alias("ua"), F.col("gone").alias("ga"), F.col("comp").alias("ca"), "weight", "spared", F.col("parity").alias("pa"))
    index = lists.filter("level in (0, 255)").select("sig", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("u").alias("ub"), F.col("gone").alias("gb"), F.col("comp").alias("cb"), F.col("parity").alias("pb"))
    differ = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    pairs = (
        probe.join(index, "sig")
        .filter("ca <> cb and ga + gb < 2 and (nb < na or (nb = na and b < a)) and 5 * nb >= 4 * na and 9 * (ua + ub) <= na + nb")
        .filter(F.col("pa").isNull() | (9 * (F.col("ua") + F.col("ub") + differ) <= F.col("na") + F.col("nb")))
        .groupBy("a", "b", "level")
        .agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("ga") + F.col("gb") == 0).alias("k2"), *(F.first(c).alias(c) for c in ("na", "nb", "ua", "ub", "weight", "spared")))
    )
    least = F.col("weight") - F.col("spared") - (F.floor((F.col("na") + F.col("nb")) / 9) - F.col("ua") - F.col("ub"))
    agreed = F.when(end_of(F.col("nb"), F.lit(0)) < SMALL, F.col("k") + F.col("k2")).otherwise(F.col("k"))
    return pairs.filter((F.col("level") == 255) | (agreed >= least)).select("a", "b").distinct()


def _verified(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b) of classes, those that link.

    Every pair brings the shared shingles of a to those of b, in blocks of b: one with very many partners has several.
    """
    many = pairs.groupBy("b").agg((F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).filter("blocks > 0")
    pairs = pairs.join(many, "b", "left").withColumn("block", F.pmod(F.xxhash64("a"), F.coalesce("blocks", F.lit(0)) + 1))
    heads = pairs.select("b", "block").distinct().join(shared.select(F.col("class").alias("b"), "n", "x"), "b").select("b", "block", F.lit(None).cast("long").alias("a"), "n", "x")
    parts = pairs.join(shared.select(F.col("class").alias("a"), "n", "x"), "a").select("b", "block", "a", "n", "x")
    blocks = heads.unionByName(parts).repartition("b", "block").sortWithinPartitions("b", "block", F.col("a").asc_nulls_first())

    def run(batches):
        head, size = None, 0
        for batch in batches:
            out = []
            for b, a, n, x in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                x = np.frombuffer(x, np.uint64)
                if a is None:
                    head, size = x, n
                    continue
                both = len(np.intersect1d(head, x, assume_unique=True))
                if 100 * both >= 80 * (size + n - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


def _components(docs: DataFrame, n: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Sized rows of ``docs`` (id, n_shingles, class), and every class that isn't empty: class, rep (its least id), comp (its component's least class), component_id."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    try:
        letters = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = min(1 << 16, max(1, -(-letters // 14 // GROUP)))  # a word and its space are seven letters, half of the universe is sent
        sized, blobs = scratch.apart(_sized(docs, n, parts), "kind")
        reps = written(sized.filter("n_shingles > 0").groupBy("class").agg(F.min("id").alias("rep")))
        left = scratch.written(_survivors(blobs))
        sets = scratch.written(_texts_of(docs, left.join(reps, "class"), n))
        shingles = sets.agg(F.sum("n")).first()[0] or 0
        shared = scratch.written(_shared(sets, min(1 << 16, max(1, -(-shingles // GROUP))), scratch))
        info = shared.select("class", "n", "u", (9 * F.col("u") - F.col("n")).alias("f"), "weight", "slack", "parity", F.exists("slack", lambda s: s < 0).alias("open"))
        signed = _signed(shared, _uncovered(shared)).join(info.select("class", "f"), "class").withColumn("comp", F.col("class"))
        lists, links, tried, comp = scratch.written(_mixed(signed)), None, None, None

        # Each class meets one member of its lists: of those with the fewest own shingles, the one that it shares most lists with.
        for turn in range(ROUNDS):
            best = lists.groupBy("class", F.col("other.class").alias("hub")).agg(F.count(F.lit(1)).alias("k")).groupBy("class").agg(F.max_by("hub", F.struct("k", -F.col("hub"))).alias("hub"))
            best = best.select(F.greatest("class", "hub").alias("a"), F.least("class", "hub").alias("b")).distinct()
            best = scratch.written(best if tried is None else best.join(tried, ["a", "b"], "left_anti"))
            if best.isEmpty():
                break
            tried = best if tried is None else tried.unionByName(best)
            found = scratch.written(_verified(best, shared))
            links = found if links is None else links.unionByName(found)
            comp = scratch.written(components(links))
            named = lists.drop("comp", "cost", "other").join(comp.withColumnRenamed("v", "class"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
            lists = scratch.written(_mixed(named))

        # Then every candidate that is left between components is verified.
        if comp is not None:
            level = F.col("level") + 1
            full = lists.drop("other", "f").join(info, "class").withColumns({c: F.try_element_at(c, level) for c in ("weight", "slack", "parity")})
            more = _candidates(full).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
            more = scratch.written(more.join(tried, ["a", "b"], "left_anti"))
            if not more.isEmpty():
                comp = components(links.unionByName(scratch.written(_verified(more, shared))))
        else:
            comp = spark.createDataFrame([], "v long, comp long")

        named = reps.join(comp.withColumnRenamed("v", "class"), "class")
        least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
        linked = written(named.select("class", "comp").join(least, "comp").select("class", "comp", "component_id", F.lit(True).alias("linked")))
    finally:
        scratch.drop()
    own = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("rep"))
    return sized, reps.join(linked, "class", "left").select("class", "rep", F.coalesce("comp", "class").alias("comp"), own.alias("component_id"))


def join(docs: DataFrame, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, class (a text's set), component_id."""
    sized, by_class = _components(docs, n, id_col, text_col)
    by_class = by_class.select("class", "component_id")
    empty = sized.filter("n_shingles = 0").select("id", "n_shingles", "class", F.col("id").alias("component_id"))
    return sized.filter("n_shingles > 0").join(by_class, "class").select("id", "n_shingles", "class", "component_id").unionByName(empty).withColumnRenamed("id", id_col)


def _with_class(docs: DataFrame, n: int, text_col: str) -> DataFrame:
    """``docs`` with the class of each row's text."""
    where = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            own = pa.array([_class_id(x) for x in _sets(batch.column(where), n)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], [*batch.schema.names, "_class"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_class", LongType())]))


def first_of_each(docs: DataFrame, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, one row of each component: that with the smallest id (null last), of its class.

    Rows without words link with nothing: of those that repeat an id one is kept, and all that have none. Ids that are
    null or stand in several rows don't tell which row is meant; the classes of these rows are computed again.
    """
    sized, by_class = _components(docs, n, id_col, text_col)
    kept = by_class.groupBy("comp").agg(F.min_by(F.struct("class", "rep"), F.struct(F.col("rep").isNull(), "rep", "class")).alias("k")).select("k.*")
    kept = written(kept.unionByName(sized.filter("n_shingles = 0").select("class", F.col("id").alias("rep")).distinct()))
    vague = written(sized.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 or id is null").select("id"))
    sure = kept.filter("rep is not null").join(vague, kept["rep"] == vague["id"], "left_anti").select("rep")
    out = docs.join(sure, docs[id_col] == sure["rep"], "left_semi")
    if vague.isEmpty():
        return out
    rows = docs.filter(F.col(id_col).isNull()).unionByName(docs.join(vague, docs[id_col] == vague["id"], "left_semi"))
    rows = _with_class(rows, n, text_col)
    rows = rows.join(kept, (rows["_class"] == kept["class"]) & rows[id_col].eqNullSafe(kept["rep"]), "left_semi")
    # One row of each (class, id); which of several is told by all columns that can be hashed.
    order = F.struct(F.col(text_col), F.xxhash64(*(f.name for f in docs.schema if "map<" not in f.dataType.simpleString())))
    nameless = F.col(id_col).isNull() & (F.col("_class") < 0)
    one = rows.filter(~nameless).groupBy(F.col("_class").alias("c"), F.col(id_col).alias("i")).agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return out.unionByName(one).unionByName(rows.filter(nameless).select(docs.columns))


def op4(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole of ``documents``."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
