"""Names to a canonical dimension: override, blocking, fuzzy best match (JN-4..7, CHK-16, STR-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.text import fuzzy_ratio, is_devanagari_dominant, normalize_devanagari
from factloom.operators.quality import match_tier
from factloom.operators.shared import written

#: Similarities that are searched one after the other, down to the caller's; a name that has a match is done.
LEVELS = (90.0, 80.0)
#: Below this similarity two names need not share a pair of letters, and a block is searched whole.
LEAST_INDEXED = 67.0


def overridden(names: DataFrame, overrides: DataFrame, name: str = "name") -> DataFrame:
    """JN-6: names replaced by an exact map (name, canonical) before any fuzzy match."""
    o = overrides.select(F.col("name").alias(name), "canonical")
    return names.join(o, name, "left").withColumn("query", F.coalesce("canonical", name)).drop("canonical")


def letter_pairs(name: Column) -> Column:
    """The pairs of neighbouring letters of a name with an edge on both sides, those that occur again numbered: n + 1 different tokens of n letters."""
    edged = F.concat(F.lit("\u0002"), name, F.lit("\u0003"))
    pairs = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(name) + 1), lambda i: F.substring(edged, i, 2)))
    once = F.array(F.struct(pairs.alias("p")))
    return F.flatten(F.transform(once, lambda o: F.transform(o["p"], lambda x, i: F.concat(x, (i + 1 - F.array_position(o["p"], x)).cast("string")))))


def shared_pairs(n: Column, m: Column, least: float) -> Column:
    """How many of their letter pairs names of n and m letters share at least, if their similarity is ``least``.

    A common subsequence of L letters keeps L + 1 neighbours (edges included), of which each of the n - L and m - L other
    letters parts one at most; so 3 L - n - m + 1 stay.
    """
    common = F.ceil((n + m) * least / 200 - 1e-9)
    return 3 * common - n - m + 1


def candidates(q: DataFrame, d: DataFrame, least: float) -> DataFrame:
    """(query, at, s, dim_idx, canonical): pairs of one block and script that may reach ``least``; no pair that does is left out.

    q: query, at, s, pairs; d: dim_idx, canonical, at, s, pairs; pairs are ordered alike, rare ones first. Names that share k
    of their pairs share one of the first |pairs| - k + 1 of either side: only those are joined. What meets is held against
    the bounds of lengths and of shared pairs.
    """
    n, m = F.length("query"), F.length("canonical")
    long_enough = F.least(n, m) * 200 >= least * (n + m)
    if least < LEAST_INDEXED:
        return q.join(d.withColumnRenamed("pairs", "_pairs"), ["at", "s"]).filter(long_enough).select("query", "at", "s", "dim_idx", "canonical")

    def prefix(df: DataFrame, name: str) -> DataFrame:
        # The fewest shared pairs are those with the shortest partner.
        size = F.length(name)
        fewest = F.greatest(F.ceil((1.5 * least / 100 - 1) * (size + size * least / (200 - least)) + 1 - 1e-9), F.lit(1))
        return df.withColumn("pair", F.explode(F.slice("pairs", 1, (F.size("pairs") - fewest + 1).cast("int"))))

    left, right = prefix(q, "query").select("query", "at", "s", "pair"), prefix(d, "canonical").select("dim_idx", "canonical", "at", "s", "pair")
    met = left.join(right, ["at", "s", "pair"]).filter(long_enough).select("query", "at", "s", "dim_idx", "canonical").distinct()
    met = met.join(q, ["query", "at", "s"]).join(d.select("dim_idx", "at", "s", F.col("pairs").alias("_pairs")).distinct(), ["dim_idx", "at", "s"])
    return met.filter(F.size(F.array_intersect("pairs", "_pairs")) >= shared_pairs(n, m, least)).select("query", "at", "s", "dim_idx", "canonical")


def fuzzy_best(queries: DataFrame, dimension: DataFrame, block: str, least: float = 70.0, script: str | None = None) -> DataFrame:
    """JN-4, JN-5: each distinct (query, block) with the best canonical row (dim_idx, canonical) of its block, case of the block aside.

    A query without a block, or with one that the dimension hasn't, is held against all rows; ``script`` is a column of
    both sides that has to agree in any case. The score is the normalised Indel similarity; the first best by dim_idx
    wins; below ``least`` there is no match.

    Equal names are found by an equi-join. The others are searched for through an index of letter pairs, at ``LEVELS`` and
    then at ``least``: whoever finds a match at a level finds all that are as good, and is done.
    """
    kind = F.col(script) if script else F.lit("")
    q = queries.select("query", F.nullif(F.lower(F.trim(block)), F.lit("")).alias("b"), kind.alias("s")).distinct()
    d = dimension.select("dim_idx", "canonical", F.lower(F.trim(block)).alias("b"), kind.alias("s"))
    # Every row of the dimension is in its own block and in the block of all, which has an empty name.
    own = F.array_compact(F.array(F.nullif("b", F.lit("")), F.lit("")))
    d = d.filter("length(canonical) > 0").withColumn("at", F.explode(own)).drop("b")
    known = d.select("at", F.lit(True).alias("there")).distinct()
    q = written(q.join(known, q["b"] == known["at"], "left").withColumn("at", F.when(F.col("there"), F.col("b")).otherwise("")).drop("there"))
    ask = q.filter("length(query) > 0").select("query", "at", "s").distinct()
    equal = ask.join(d, (ask["query"] == d["canonical"]) & (ask["at"] == d["at"]) & (ask["s"] == d["s"])).groupBy(ask["query"], ask["at"], ask["s"]).agg(F.min("dim_idx").alias("dim_idx"))
    best = [equal.select("query", "at", "s", F.col("query").alias("canonical"), "dim_idx", F.lit(100.0).alias("score"))]
    names = d.select("canonical").distinct().withColumn("pair", F.explode(letter_pairs(F.col("canonical"))))
    often = names.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    rare_first = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pair"))), lambda x: x["pair"])
    ordered = lambda df, name, key: df.withColumn("pair", F.explode(letter_pairs(F.col(name)))).join(often, "pair", "left").groupBy(*key).agg(rare_first.alias("pairs"))
    rest = written(ordered(ask.join(equal, ["query", "at", "s"], "left_anti"), "query", ["query", "at", "s"]))
    if not rest.isEmpty():
        d = written(ordered(d, "canonical", ["dim_idx", "canonical", "at", "s"]))
        for level in [*(x for x in LEVELS if x > least), least]:
            scored = candidates(rest, d, level).withColumn("score", fuzzy_ratio(F.col("canonical"), F.col("query"))).filter(F.col("score") >= level)
            found = scored.groupBy("query", "at", "s").agg(F.max_by(F.struct("canonical", "dim_idx", "score"), F.struct("score", -F.col("dim_idx"))).alias("m"))
            done = written(rest.join(found, ["query", "at", "s"], "left"))
            best.append(done.filter("m is not null").select("query", "at", "s", "m.*"))
            rest = done.filter("m is null").drop("m")
            if rest.isEmpty():
                break
    all_, *more = best
    for x in more:
        all_ = all_.unionByName(x)
    out = q.join(all_, ["query", "at", "s"], "left").select("query", "b", "s", "canonical", "dim_idx", "score")
    return out.withColumn("tier", match_tier(F.col("score"))).drop(*([] if script else ["s"]))


def municipalities(names: DataFrame, dimension: DataFrame, least: float = 70.0, overrides: DataFrame | None = None, name: str = "name", district: str = "district") -> DataFrame:
    """JN-4..6, STR-1, STR-19: ``names`` with federal_code, name_en, name_ne, local_level_type, district_en and score; nulls where none reaches ``least``.

    Names are trimmed and normalised; one that is mostly Devanagari is held against the normalised Nepali names, any
    other against the English ones, of its district or, if that is unknown or absent, of all. ``overrides``
    (name, canonical) are applied first. dimension: dim_idx, federal_code, name_en, name_ne, local_level_type, district_en.
    """
    n = overridden(names, overrides, name) if overrides is not None else names.withColumn("query", F.col(name))
    n = n.withColumn("query", normalize_devanagari(F.trim("query")))
    n = n.withColumn("_script", F.when(is_devanagari_dominant(F.col("query")), "ne").otherwise("en")).withColumn("_block", F.nullif(F.lower(F.trim(F.col(district))), F.lit("")))
    either = F.explode(F.array(F.struct(F.lit("en").alias("_script"), F.col("name_en").alias("canonical")), F.struct(F.lit("ne").alias("_script"), normalize_devanagari(F.col("name_ne")).alias("canonical"))))
    d = dimension.select("dim_idx", F.col("district_en").alias("_block"), either.alias("e")).select("dim_idx", "_block", "e.*")
    best = fuzzy_best(n.select("query", "_block", "_script"), d, "_block", least, "_script").select(F.col("query").alias("_q"), F.col("b").alias("_b"), F.col("s").alias("_s"), "dim_idx", "score")
    j = n.join(best, (n["query"] == best["_q"]) & n["_block"].eqNullSafe(best["_b"]) & (n["_script"] == best["_s"]), "left").drop("_q", "_b", "_s", "_script", "_block", "query")
    return j.join(dimension.select("dim_idx", "federal_code", "name_en", "name_ne", "local_level_type", "district_en"), "dim_idx", "left").drop("dim_idx")


def resolved(facts: DataFrame, entities: DataFrame, key: str, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """JN-7: (facts with entity_id, facts whose key is unknown); ``kind`` restricts the entities, None takes any."""
    e = (entities.filter(F.col("kind") == kind) if kind else entities).select(key, "entity_id").dropDuplicates([key])
    return facts.join(e, key), facts.join(e, key, "left_anti")
