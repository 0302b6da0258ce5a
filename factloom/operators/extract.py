"""Figures from narrative text (RGX-1..3): one row for each document and phrase; a miss is an error row.

A phrase is written as the bulletin words it. ``expression`` makes a regex of it: words may be parted by any white
space and differ in case, ``a|b`` are spellings of one word, and marks in braces stand for what varies.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

# Slug, unit, whether the figure stands for the end of the period, the bulletin's words around the figure.
PHRASES = (
    ("cmefs-ncpi-yoy-overall", "percent_yoy", True, "y-o-y consumer price inflation in Nepal remained at {figure} percent"),
    ("cmefs-remittance-inflow-ytd", "npr_billion", False, "Remittance inflows {moved} {number} percent to Rs {figure} billion"),
    ("cmefs-merchandise-imports-ytd", "npr_billion", False, "merchandise|mercandise|merhandise|merandise imports {moved} {number} percent to Rs {figure} billion"),
    ("cmefs-trade-deficit-ytd", "npr_billion", False, "Total trade deficit {moved} {number} percent to Rs {figure} billion"),
    ("cmefs-bop-surplus-ytd", "npr_billion", False, "Balance of Payments (BOP) remained at a surplus|deficit of Rs {figure} billion"),
    ("cmefs-gross-forex-reserves", "npr_billion", True, "Gross foreign exchange reserves {up to 250} {moved} {number} percent to {up to 80} Rs {figure} billion"),
    ("cmefs-forex-reserves-months-of-import-cover", "months", True, "merchandise and services imports of {figure} months"),
)
# The notes of a provisional figure and of a deficit.
PROVISIONAL_NOTE = "value carries inline 'P' provisional marker; downgraded A→B"
DEFICIT_NOTE = "BoP in deficit (negative)"
#: Characters before and after a figure in which its mark is looked for.
BEFORE, AFTER = 4, 28
_NUMBER = "[0-9]+[.][0-9]+"


def expression(phrase: str) -> str:
    """A regex whose groups are what stands before the figure, the figure, and what stands after it."""
    marks = [m for m in re.split(r"(\{[^}]*\})|\s+", phrase) if m]
    out, free = [], True  # free: what follows needs no white space before it
    for mark in marks:
        if gap := re.fullmatch(r"\{up to (\d+)\}", mark):
            out.append(r"\b[\s\S]{0,%s}?" % gap[1])
            free = True
            continue
        tight = mark == "{figure}" and out[-1].endswith(r"Rs\.?") or mark == "percent"
        own = {"{figure}": f")({_NUMBER})(", "{number}": _NUMBER, "{moved}": "(?:increased|decreased)", "Rs": r"Rs\.?"}.get(mark) or "(?:" + "|".join(map(re.escape, mark.split("|"))) + ")"
        after_figure = bool(out) and out[-1].endswith(")(")
        space = "" if free else r"\s*" if tight or after_figure and mark == "billion" else r"\s+"
        out.append(own if not space else space + own)
        free = False
    return "(?i)(" + "".join(out) + ")"


def extract(docs: DataFrame, phrases=PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, slug, unit, end_of_period, value, grade, note, error) for each document and phrase.

    A figure with a single letter P after a number within ``BEFORE`` characters before it and ``AFTER`` after it is
    provisional and gets grade B; a deficit keeps its magnitude and is noted. No match is PageLayoutChanged, a figure
    that is no number ValueUnparseable.
    """
    docs = docs.select(id_col, F.col(text_col).alias("_text"))
    # One search over the text for each phrase; the groups are taken from what it found.
    for k, (*_, phrase) in enumerate(phrases):
        docs = docs.withColumn(f"_p{k}", F.split("_text", expression(phrase), 2))
    for k in range(len(phrases)):
        before, after = F.length(F.get(f"_p{k}", F.lit(0))), F.length(F.get(f"_p{k}", F.lit(1)))
        docs = docs.withColumn(f"_m{k}", F.when(F.size(f"_p{k}") == 2, F.struct((before + 1).alias("at"), F.col("_text").substr(before + 1, F.length("_text") - before - after).alias("s"))))
    text, one = F.col("_text"), []
    for k, (slug, unit, ending, phrase) in enumerate(phrases):
        pattern, match = expression(phrase), F.col(f"_m{k}")
        part = lambda i, p=pattern, m=match: F.regexp_extract(m["s"], p, i)
        figure = part(2)
        first = match["at"] + F.length(part(1))  # place of the figure, from 1
        near = F.substring(text, F.greatest(first - BEFORE, F.lit(1)), F.length(figure) + AFTER + F.least(first - 1, F.lit(BEFORE)))
        provisional = near.rlike(r"[0-9]\s*[Pp]\b")
        deficit = F.contains(F.lower(part(1)), F.lit("deficit")) if "surplus|deficit" in phrase else F.lit(False)
        found, value = match.isNotNull(), figure.try_cast("double")
        note = F.nullif(F.concat_ws("; ", F.when(provisional, PROVISIONAL_NOTE), F.when(deficit, DEFICIT_NOTE)), F.lit(""))
        one.append(
            F.struct(
                F.lit(slug).alias("slug"), F.lit(unit).alias("unit"), F.lit(ending).alias("end_of_period"), F.when(found, value).alias("value"), F.when(found, F.when(provisional, "B").otherwise("A")).alias("grade"),
                F.when(found, note).alias("note"), F.when(~found, "PageLayoutChanged").when(value.isNull(), "ValueUnparseable").alias("error"),
            )
        )
    return docs.select(id_col, F.explode(F.array(*one)).alias("x")).select(id_col, "x.*")
