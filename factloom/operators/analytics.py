"""Derived analytics, revisions, roll-ups, claims and page geometry (ANL-*, AGG-2, AGG-10, JN-9..13, WIN-6, 9, 10, LED-*, OCR-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.functions.calendar import claim_label
from factloom.functions.text import both_numerals, claim_slug, display_number, is_finite, is_provisional, normalize_devanagari


def concentration(df: DataFrame, period, party: str, value: str) -> DataFrame:
    """ANL-1, ANL-9: Herfindahl index of each period: the sum of squared shares."""
    own = df.groupBy(*period, party).agg(F.sum(value).alias("_v"))
    share = own.withColumn("_s", F.try_divide(F.col("_v"), F.sum("_v").over(Window.partitionBy(*period))))
    return share.groupBy(*period).agg(F.sum(F.col("_s") * F.col("_s")).alias("hhi"), F.count(F.lit(1)).alias("parties"))


def shares(df: DataFrame, period, part, value: str) -> DataFrame:
    """ANL-4, ANL-6: each part's share of its period."""
    own = df.groupBy(*period, *part).agg(F.sum(value).alias("total"))
    return own.withColumn("share", F.try_divide(F.col("total"), F.sum("total").over(Window.partitionBy(*period))))


def ratio(df: DataFrame, keys, numerator: Column, denominator: Column, value: str) -> DataFrame:
    """ANL-2, ANL-3: conditional sums and their ratio."""
    g = df.groupBy(*keys).agg(F.sum(F.when(numerator, F.col(value))).alias("numerator"), F.sum(F.when(denominator, F.col(value))).alias("denominator"))
    return g.withColumn("ratio", F.try_divide("numerator", "denominator"))


def trend(df: DataFrame, keys, order: str, value: str) -> DataFrame:
    """ANL-2: a series with its change on the period before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("change", F.col(value) - before)


def bank_ratios(income: DataFrame, balance: DataFrame, key) -> DataFrame:
    """ANL-3: returns on assets and equity, margin and capital adequacy, from income (profit, interest) joined with balance (assets, equity, weighted)."""
    j = income.join(balance, list(key))
    r = lambda a, b: F.try_divide(a, b)
    return j.select(*key, r("profit", "assets").alias("roa"), r("profit", "equity").alias("roe"), r("interest", "assets").alias("nim"), r("equity", "weighted").alias("adequacy"))


def dossier(df: DataFrame, key: str, year: str, measure: str, value: str, years) -> DataFrame:
    """ANL-5: an enterprise's measures, a column a fiscal year."""
    return df.groupBy(key, measure).pivot(year, list(years)).agg(F.sum(value))


def burden(subsidies: DataFrame, revenue: DataFrame, key) -> DataFrame:
    """ANL-5: subsidies to revenue."""
    return subsidies.join(revenue, list(key), "left").withColumn("burden", F.try_divide("subsidy", "revenue"))


def per_head(facts: DataFrame, people: DataFrame, key, value: str) -> DataFrame:
    """ANL-7: a value by place over its population; null where no population is known or it is 0."""
    return facts.join(people.select(*key, "population"), list(key), "left").withColumn("per_head", F.try_divide(value, "population"))


def by_year(df: DataFrame, part: str, year: str, value: str, years) -> DataFrame:
    """ANL-8: a part's total in each of the years."""
    return df.groupBy(part).pivot(year, list(years)).agg(F.sum(value))


def pipeline_by_status(df: DataFrame, party: str, status: str, value: str) -> DataFrame:
    """ANL-9: a donor's amounts by status, and their share of all of that status, a double: a quotient of decimals has too few places for small shares."""
    g = df.groupBy(party, status).agg(F.sum(value).alias("amount"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.try_divide(F.col("amount").cast("double"), F.sum("amount").over(Window.partitionBy(status)).cast("double")))


def profile(places: DataFrame, key: str, measures: dict[str, DataFrame]) -> DataFrame:
    """ANL-10: one row a place with each measure (a table of ``key`` and ``value``), null where it has none."""
    out = places.select(key).distinct()
    for name, m in measures.items():
        out = out.join(m.groupBy(key).agg(F.sum("value").alias(name)), key, "left")
    return out


def running(df: DataFrame, keys, order: str, value: str) -> DataFrame:
    """ANL-5: cumulative sums."""
    return df.withColumn("cumulative", F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def both_ends(df: DataFrame, measure: str, key: str, n: int = 10) -> DataFrame:
    """ANL-7: the n highest and n lowest."""
    top = df.orderBy(F.desc(measure), key).limit(n).withColumn("end", F.lit("top"))
    low = df.orderBy(F.asc(measure), key).limit(n).withColumn("end", F.lit("bottom"))
    return top.unionByName(low)


def gap(budget: DataFrame, actual: DataFrame, key) -> DataFrame:
    """ANL-8: budget against actual, either may be absent."""
    j = budget.join(actual, list(key), "full_outer").na.fill(0, ["budget", "actual"])
    return j.withColumn("gap", F.col("actual") - F.col("budget"))


def edges(df: DataFrame, source: str, target: str, value: str) -> DataFrame:
    """ANL-11: money flows as weighted edges."""
    return df.groupBy(F.col(source).alias("src"), F.col(target).alias("dst")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("amount"))


def basket(prices: DataFrame, weights: DataFrame, item: str, period: str, by=(), lag: int = 12) -> DataFrame:
    """ANL-12: weighted cost of a basket per period (and per ``by``) and its change on ``lag`` periods before."""
    c = prices.join(F.broadcast(weights), item).groupBy(*by, period).agg(F.sum(F.col("price") * F.col("weight")).alias("cost"))
    before = F.lag("cost", lag).over(Window.partitionBy(*by).orderBy(period))
    return c.withColumn("change", F.try_divide(F.col("cost") - before, before))


def rolled_up(df: DataFrame, levels, value: str) -> DataFrame:
    """AGG-10, JN-9: totals at every level of a hierarchy; level 0 is the whole."""
    g = df.rollup(*levels).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    level = F.lit(len(levels)) - F.log2(F.col("_g") + 1).cast("int")
    return g.withColumn("level", level).drop("_g")


def reconciled(rolled: DataFrame, published: DataFrame, key) -> DataFrame:
    """AGG-10: roll-up totals (of every level, ``key`` null where rolled up) against published ones, and their difference."""
    p = published.select(*(F.col(k).alias(f"_{k}") for k in key), "published")
    on = F.lit(True)
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rolled.join(p, on, "left").drop(*(f"_{k}" for k in key)).withColumn("diff", F.col("total") - F.col("published"))


def unreconciled(a: DataFrame, b: DataFrame, key, tolerance: float = 0.01) -> DataFrame:
    """JN-10: pairs of two feeds that differ by more than the tolerance."""
    return a.join(b, list(key)).withColumn("diff", F.abs(F.col("value_a") - F.col("value_b"))).filter(F.col("diff") > tolerance)


def restated(values: DataFrame, key, snapshot: str, value: str) -> DataFrame:
    """JN-13, WIN-6, WIN-9: values that a later snapshot changed, the change, and whether it is over 3 %."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(snapshot))
    out = values.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col("before") != F.col(value)))
    return out.withColumn("material", F.abs(F.try_divide(F.col(value), F.col("before")) - 1) > 0.03)


def revision_trail(values: DataFrame, key) -> DataFrame:
    """WIN-6: each revision of a period with the value before it and the change."""
    w = Window.partitionBy(*key).orderBy("revision")
    return values.withColumn("before", F.lag("value").over(w)).withColumn("delta", F.col("value") - F.col("before"))


def depreciation(series: DataFrame, key, order: str, value: str, year: int = 12) -> DataFrame:
    """WIN-10: relative change of a rate on a year before, and the mean of its last year."""
    w = Window.partitionBy(*key).orderBy(order)
    before = F.lag(value, year).over(w)
    return series.withColumn("rolling", F.avg(value).over(w.rowsBetween(1 - year, 0))).withColumn("depreciation", F.try_divide(F.col(value) - before, before))


def pulse(series: DataFrame, key, order: str, value: str, year: int = 12) -> DataFrame:
    """WIN-10: current, previous period and the one a year before."""
    w = Window.partitionBy(*key).orderBy(order)
    return series.withColumn("previous", F.lag(value).over(w)).withColumn("year_before", F.lag(value, year).over(w))


def claims(values: DataFrame) -> DataFrame:
    """LED-1: slug, period label, texts in two languages and the error of rows that give no claim.

    values: indicator_slug, name_en, name_ne, unit, agency, value, grade, fiscal_year_bs, period_type, period_bs, verified_by.
    """
    error = F.when(F.coalesce(F.trim("verified_by") == "", F.lit(True)), "verified_by: must not be empty").when(~is_finite(F.col("value")), "value: not a finite number")
    number = display_number(F.col("value").try_cast("decimal(30,10)"))
    suffix = F.when((F.col("grade") == "C") & is_provisional(F.col("agency")), " (provisional)").otherwise("")
    figure = F.concat(F.lit(" "), "period_label", F.lit(": "), number, F.lit(" "), "unit")
    return (
        values.withColumn("period_label", claim_label(F.col("period_type"), F.col("period_bs")))
        .withColumn("slug", claim_slug(F.col("indicator_slug"), F.col("fiscal_year_bs"), F.col("period_type")))
        .withColumn("error", error)
        .withColumn("text_en", F.when(error.isNull(), F.concat("name_en", F.lit(" for"), figure, F.lit("."), suffix)))
        .withColumn("text_ne", F.when(error.isNull(), F.concat("name_ne", figure, F.lit("।"))))
    )


def claim_fault(claim: dict[str, Column] | None = None) -> Column:
    """LED-2: the first field of a claim that breaks its contract, else null; texts are there, ids are uuids, grades A to C.

    ``claim`` gives other columns for fields than those of their name.
    """
    c = lambda name: (claim or {}).get(name, F.col(name))
    uuid = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    empty = lambda name: F.coalesce(c(name) == "", F.lit(True))
    bad = {
        "slug": empty("slug"), "text_en": empty("text_en"), "text_ne": c("text_ne") == "", "value_id": ~F.coalesce(c("value_id").rlike(uuid), F.lit(False)),
        "indicator_id": ~F.coalesce(c("indicator_id").rlike(uuid), F.lit(False)), "document_id": ~F.coalesce(c("document_id").rlike(uuid), F.lit(False)), "grade": ~F.coalesce(c("grade").isin("A", "B", "C"), F.lit(False)),
        "verified_by": empty("verified_by"), "period_label": empty("period_label"), "publication_ad": c("publication_ad").isNull(), "publication_bs": empty("publication_bs"),
    }
    return F.coalesce(*(F.when(v, k) for k, v in bad.items()))


def challenges(df: DataFrame, at: str, status: str) -> DataFrame:
    """LED-4: challenges to claims by quarter and status."""
    return df.groupBy(F.date_trunc("quarter", at).cast("date").alias("quarter"), status).agg(F.count(F.lit(1)).alias("n"))


def retired(claims_: DataFrame, slug: str, minted: str) -> DataFrame:
    """LED-4: each claim with the time at which the next of its slug replaced it."""
    return claims_.withColumn("retired_at", F.lead(minted).over(Window.partitionBy(slug).orderBy(minted)))


def page_boxes(cells: DataFrame, tiles: DataFrame) -> DataFrame:
    """OCR-1, OCR-2: page boxes and the distance to the nearest edge of the tile."""
    j = cells.join(tiles, "tile_id")
    seam = F.least(F.col("x"), F.col("y"), F.col("width") - F.col("x") - F.col("w"), F.col("height") - F.col("y") - F.col("h"))
    return j.withColumn("page_x", F.col("offset_x") + F.col("x")).withColumn("page_y", F.col("offset_y") + F.col("y")).withColumn("seam", seam)


def cell_texts(cells: DataFrame, text: str = "text") -> DataFrame:
    """OCR-4: normalised text of cells, and their numerals in both scripts."""
    n = both_numerals(F.col(text))
    return cells.withColumn("normalized", normalize_devanagari(F.col(text))).withColumn("arabic", n["arabic"]).withColumn("devanagari", n["devanagari"])


def overlaps(boxes: DataFrame, grid: int = 64, least: float = 0.5, clear: float = 0.1) -> DataFrame:
    """JN-11, OCR-3: pairs of boxes of different tiles of a page with an IoU of ``least``, and how each is resolved.

    Boxes meet in the grid squares that they touch; a pair is taken in the square of its overlap's corner only.
    """
    squares = lambda a, n: F.sequence(F.floor(F.col(a) / grid), F.floor((F.col(a) + F.col(n) - 1) / grid))
    b = boxes.select("page", "cell_id", "tile_id", "page_x", "page_y", "w", "h", "confidence").withColumn("gx", F.explode(squares("page_x", "w"))).withColumn("gy", F.explode(squares("page_y", "h")))
    l, r = b.alias("l"), b.alias("r")
    x0, y0 = F.greatest("l.page_x", "r.page_x"), F.greatest("l.page_y", "r.page_y")
    wide = F.least(F.col("l.page_x") + F.col("l.w"), F.col("r.page_x") + F.col("r.w")) - x0
    high = F.least(F.col("l.page_y") + F.col("l.h"), F.col("r.page_y") + F.col("r.h")) - y0
    j = l.join(r, (F.col("l.page") == F.col("r.page")) & (F.col("l.gx") == F.col("r.gx")) & (F.col("l.gy") == F.col("r.gy")) & (F.col("l.cell_id") < F.col("r.cell_id")) & (F.col("l.tile_id") != F.col("r.tile_id")))
    j = j.filter((wide > 0) & (high > 0) & (F.col("l.gx") == F.floor(x0 / grid)) & (F.col("l.gy") == F.floor(y0 / grid)))
    both = wide * high
    iou = both / (F.col("l.w") * F.col("l.h") + F.col("r.w") * F.col("r.h") - both)
    d = F.col("l.confidence") - F.col("r.confidence")
    out = j.select(F.col("l.page").alias("page"), F.col("l.cell_id").alias("left_id"), F.col("r.cell_id").alias("right_id"), iou.alias("iou"), F.when(d >= clear, "left").when(-d >= clear, "right").otherwise("review").alias("resolution"))
    return out.filter(F.col("iou") >= least)
