"""Secret scans: three base patterns, and a sliding-window Shannon entropy over candidate strings. SQL functions only.

Matches get their places by marking them with a private-use character, which the text itself can't hold after that
character is put out of the way (the place of no other character moves), and adding up the lengths between marks.

The entropy step takes tokens of ``MIN_TOKEN`` characters or more, of one of two character classes (hexadecimal, or
letters, digits and ``+/=_-``), and slides a window of ``WINDOW`` characters over each. The sum of c * log2(c) over the
window's character counts is kept as the window moves: only the counts of the character that enters and of the one
that leaves change it. A token whose best window reaches its class's threshold is a span of kind ``entropy``, unless
the allow-list knows it or it overlaps a base span.

Defined results: null text is empty; an empty text has no span and the digest of the empty string; repeated rows are
judged one by one; spans that start at one place are in the order assign, access, hex, entropy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_KEY = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of 24 and more; shorter runs are dropped anyway, and runs are maximal.
HEX = r"[0-9a-f]{24,}"
MIN_TOKEN, WINDOW = 20, 20
CANDIDATE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}"
#: Bits a character; a window of 20 random characters of the class has about 3.3 and 4.1.
HEX_BITS, MIXED_BITS = 3.0, 3.8
#: A word: capitals only, or small letters after at most one capital, then parts of capitals and two small letters or more.
_WORD = "(?:[A-Z]?[a-z]+(?:[A-Z]+[a-z]{2,})*+[A-Z]*|[A-Z]+)"
#: Strings that look random but are known not to be secret: UUIDs, one repeated or counted run, placeholders, words joined by -, / or _, paths.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
    r"|(?i:example|sample|placeholder|your[_-]|dummy|test[_-]|xxxx|0000|1234567|abcdefg)"
    rf"|^{_WORD}(?:[_/-]{_WORD})*+$"
    r"|^/?(?:[A-Za-z0-9_-]{1,12}/){2,}[A-Za-z0-9_-]{0,12}$"
)
_MARK, _OTHER = "\ue000", "\ue001"
_NONE = "cast(array() as array<struct<start:int,stop:int,s:string>>)"


def _matches(text: str, pattern: str) -> Column:
    """(start, stop, string) of the leftmost matches that don't overlap, in order; ``text`` is a column without marks."""
    pieces = F.split(F.regexp_replace(F.col(text), pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.expr(_NONE).alias("out"))

    def step(acc, p):
        end = acc["at"] + F.length(p)
        one = F.array(F.struct(acc["at"].alias("start"), end.alias("stop"), p.alias("s")))
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), F.when(acc["hit"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, start, step)["out"]


def _gated(gate: Column, found: Column) -> Column:
    return F.when(gate, found).otherwise(F.expr(_NONE))


def _term(count: Column) -> Column:
    """c * log2(c), 0 at 0."""
    c = count.cast("double")
    return F.when(count > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def window_entropy(token: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits a character) of any ``window`` consecutive characters; 0 for a shorter token.

    w is the window, sum its sum of c * log2(c), kept by the counts of the character that leaves and the one that enters.
    """
    count = lambda w, ch: F.length(w) - F.length(F.replace(w, ch, F.lit("")))

    def step(acc, ch):
        full = F.length(acc["w"]) == window
        gone = F.substring(acc["w"], 1, 1)
        n = count(acc["w"], gone)
        w0 = F.when(full, acc["w"].substr(F.lit(2), F.lit(window))).otherwise(acc["w"])
        s0 = F.when(full, acc["sum"] + _term(n - 1) - _term(n)).otherwise(acc["sum"])
        return F.struct(w0.alias("w"), s0.alias("sum"), acc["best"].alias("best"), ch.alias("in"))

    def enter(acc):
        n = count(acc["w"], acc["in"])
        w, s = F.concat(acc["w"], acc["in"]), acc["sum"] + _term(n + 1) - _term(n)
        h = F.lit(float(window)).cast("double")
        best = F.when(F.length(w) == window, F.greatest(acc["best"], F.log2(h) - s / h)).otherwise(acc["best"])
        return F.struct(w.alias("w"), s.alias("sum"), best.alias("best"))

    first = F.struct(F.lit("").alias("w"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    both = lambda acc, ch: F.element_at(F.transform(F.array(step(acc, ch)), enter), 1)
    return F.aggregate(F.split(token, ""), first, both)["best"]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: str = ALLOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """id (and the columns ``keep``), spans: array of (start, kind, stop), kind by its place in ``KINDS``, in order."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    t = docs.select(F.col(id_col).alias("_id"), *(F.col(c).alias(f"_keep_{c}") for c in keep), F.when(F.contains(raw, F.lit(_MARK)), F.translate(raw, _MARK, _OTHER)).otherwise(raw).alias("_t"))
    c = F.col("_t")
    t = t.select(
        "*",
        F.filter(_gated((F.contains(c, F.lit(":")) | F.contains(c, F.lit("="))) & c.rlike(ASSIGN), _matches("_t", ASSIGN)), lambda m: F.length(F.regexp_replace(m["s"], ASSIGN_KEY, "")) >= 6).alias("_assign"),
        F.filter(_gated(F.contains(c, F.lit("AKIA")), _matches("_t", ACCESS)), lambda m: F.length(m["s"]) >= 20).alias("_access"),
        _gated(c.rlike(HEX), _matches("_t", HEX)).alias("_hex"),
        F.filter(_gated(c.rlike(CANDIDATE), _matches("_t", CANDIDATE)), lambda m: ~m["s"].rlike(allow)).alias("_candidate"),
    )
    of = lambda col, kind: F.transform(F.col(col), lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["stop"].alias("stop")))
    t = t.withColumn("_base", F.sort_array(F.concat(of("_assign", 0), of("_access", 1), of("_hex", 2))))
    apart = F.filter("_candidate", lambda m: ~F.exists("_base", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])))
    bits = lambda m: F.when(m["s"].rlike("^[0-9a-fA-F]+$"), HEX_BITS).when(m["s"].rlike("[A-Za-z]"), MIXED_BITS).otherwise(99.0)
    added = F.transform(F.filter(apart, lambda m: window_entropy(m["s"]) >= bits(m)), lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["stop"].alias("stop")))
    return t.select(F.col("_id").alias(id_col), *(F.col(f"_keep_{k}").alias(k) for k in keep), F.sort_array(F.concat("_base", F.when(F.size("_candidate") > 0, added).otherwise(F.expr("cast(array() as array<struct<start:int,kind:int,stop:int>>)")))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with its columns, whatever their names, every span replaced by ``mask``; overlapping spans are one. n_chars, where present, follows the text."""
    found = scan(docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text")), "row", "text", keep=("text",))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        out = F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), out.alias("out"))

    done = F.aggregate("spans", start, step)
    hit = F.size("spans") > 0
    found = found.withColumn("done", F.when(hit, F.concat(done["out"], F.col("text").substr(done["at"] + 1, F.length("text")))).otherwise(F.col("text")))
    own = {c: F.col("row").getField(c) for c in docs.columns}
    own[text_col] = F.col("done")
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(hit, F.length("done").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return found.select(*(v.alias(c) for c, v in own.items()))


def op9(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole of ``documents``."""
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
