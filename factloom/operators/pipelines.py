"""Whole jobs over documents, composed of the operators (PIPE-1, PIPE-3 to PIPE-11, CHK-15, AGG-2, RSH-3).

An extract takes a table that holds many documents and returns (rows, errors, runs): long rows, what could not be read,
and the status of each document (failure without rows, partial with errors too, else success). Nothing of a document
whose extract failed is written (CHK-15).

An extract reads its table in one pass, in which every record gives arrays of rows and errors. These are tagged with
their kind and written once, in a folder for each kind; rows, errors and runs are read from there, so that none of them
repeats the work of another. A document without rows or errors has one error more, of class Other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.functions.calendar import label_bs, mid_month, nine_months
from factloom.functions.text import amount, census_number, plain_number, slugify, squash
from factloom.operators import quality as Q, reshape as R, staging as S, tables as T
from factloom.operators.extract import PHRASES, extract
from factloom.operators.resolve import municipalities, resolved
from factloom.operators.shared import written

# Needles of the price table and the geography of each; labels and columns of the banking sheet; the jobs' units and grades.
PRICE_NEEDLES = (("overall", "3 over 1"), ("rural", "6 over 4"), ("urban", "9 over 7"))
BANK_SHEET, BANK_LABEL_COLUMN = "C5", 2
BANK_CLASSES = (("system_total", 7), ("commercial", 15), ("development", 23), ("finance", 31))
BANK_LABELS = (
    ("CAPITAL FUND", "capital-fund"), ("a. Paid-up Capital", "paid-up-capital"), ("b. Statutory Reserves", "statutory-reserves"), ("BORROWINGS", "borrowings-total"), ("DEPOSITS", "deposits-total"),
    ("a. Current", "deposits-current"), ("b. Savings", "deposits-savings"), ("c. Fixed", "deposits-fixed"), ("LIQUID FUNDS", "liquid-funds"),
)
LOCAL_LEVELS = {"metropolitan": 6, "sub_metropolitan": 11, "municipality": 276, "rural_municipality": 460}
CENSUS_GEO = ("prov", "dist", "gapa", "dname", "gapaname")
MANIFEST_KINDS = ("discovered", "archived", "skipped_duplicate", "error")


@dataclass
class Extract:
    rows: DataFrame
    errors: DataFrame
    runs: DataFrame


_ERRORS = "array<struct<row_idx:int,error_class:string,error_detail:string>>"


def _error(when: Column, klass: Column | str, detail: Column | str, row: str | None = None) -> Column:
    """An error's struct where ``when`` holds, else null."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(when, F.struct((F.col(row) if row else F.lit(None)).cast("int").alias("row_idx"), lit(klass).alias("error_class"), lit(detail).alias("error_detail")))


def _errors(*one: Column) -> Column:
    return F.array_compact(F.array(*one)).cast(_ERRORS) if one else F.array().cast(_ERRORS)


def _done(docs: DataFrame, items: DataFrame | None) -> Extract:
    """The extract of all documents (doc_id, errors) and what was read of them (doc_id, rows, errors), where there is any; rows and errors are arrays."""
    kind = items.schema["rows"].dataType.elementType.simpleString() if items is not None else "struct<indicator:string,value:double>"
    tag = lambda k, r, e: F.struct(F.lit(k).alias("kind"), r.cast(kind).alias("r"), e.cast(_ERRORS[6:-1]).alias("e"))
    null = F.lit(None)
    failed = F.transform("errors", lambda e: tag("error", null, e))
    each = docs.select("doc_id", F.explode(F.concat(F.array(tag("doc", null, null)), failed)).alias("x"))
    if items is not None:
        each = each.unionByName(items.select("doc_id", F.explode(F.concat(F.transform("rows", lambda r: tag("row", r, null)), failed)).alias("x")))
    t = written(each.select("doc_id", "x.*"), "kind")
    counts = t.groupBy("doc_id").agg(F.count_if(F.col("kind") == "row").alias("n_rows"), F.count_if(F.col("kind") == "error").alias("n_errors"))
    silent = (F.col("n_rows") == 0) & (F.col("n_errors") == 0)
    other = counts.filter(silent).select("doc_id", _error(F.lit(True), "Other", "no rows found").alias("e"))
    runs = counts.withColumn("n_errors", F.when(silent, F.lit(1).cast("long")).otherwise(F.col("n_errors")))
    status = F.when(F.col("n_rows") == 0, "failure").when(F.col("n_errors") > 0, "partial").otherwise("success")
    errors = t.filter("kind = 'error'").select("doc_id", "e").unionByName(other).select("doc_id", "e.*")
    return Extract(t.filter("kind = 'row'").select("doc_id", "r.*"), errors, runs.withColumn("status", status))


def persisted(extract_: Extract) -> DataFrame:
    """CHK-15: rows of documents whose extract did not fail."""
    return extract_.rows.join(extract_.runs.filter("status <> 'failure'").select("doc_id"), "doc_id", "left_semi")


def price_index(cells: DataFrame, fy_start: int, docs: DataFrame | None = None) -> Extract:
    """PIPE-3: yearly change of each group and geography of header-less price tables (cells: doc_id, row_idx, col_idx, text)."""
    docs = (docs if docs is not None else cells).select("doc_id").distinct()
    needles = cells.sparkSession.createDataFrame(list(PRICE_NEEDLES), "geo string, needle string")
    columns = R.needle_columns(cells, needles).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("geo", "col_idx"))).alias("wanted"))
    own = cells.join(columns, "doc_id").withColumn("geo", F.get(F.filter("wanted", lambda w: w["col_idx"] == F.col("col_idx")), F.lit(0))["geo"]).filter("col_idx < 2 or geo is not null")
    text = lambda i: F.max(F.when(F.col("col_idx") == i, F.trim("text")))
    line = own.groupBy("doc_id", "row_idx").agg(text(0).alias("code"), text(1).alias("label"), F.first("wanted").alias("wanted"), F.collect_list(F.when(F.col("geo").isNotNull(), F.struct("geo", "text"))).alias("found"))
    line = line.filter(R.index_row(F.col("code"), F.col("label")) & (F.coalesce("label", F.lit("")) != "")).withColumn("stem", slugify(F.nullif("code", F.lit("")), F.col("label")))
    # RSH-3: one value for each group and geography.
    cell = lambda w: F.get(F.filter("found", lambda f: f["geo"] == w["geo"]), F.lit(0))["text"]
    line = line.withColumn("each", F.transform("wanted", lambda w: F.struct(w["geo"].alias("geo"), cell(w).alias("text"), plain_number(cell(w)).alias("value"))))
    span = F.struct(mid_month(F.lit(1), F.lit(fy_start)).alias("start"), mid_month(F.lit(9), F.lit(fy_start)).alias("end"))
    row = lambda x: F.struct(
        F.concat(F.lit("ncpi-"), "stem", F.lit("-"), x["geo"], F.lit("-yoy")).alias("indicator"), x["value"].alias("value"), F.lit("percent_yoy").alias("unit"), F.lit("nine_months_cumulative").alias("period_type"),
        F.concat(F.lit("FY "), label_bs(F.lit(fy_start)), F.lit(" 9M")).alias("period_bs"), span["start"].alias("ad_start"), span["end"].alias("ad_end"), F.lit("A").alias("grade"),
    )
    rows = F.transform(F.filter("each", lambda x: x["value"].isNotNull()), row)
    bad = F.transform(F.filter("each", lambda x: x["value"].isNull()), lambda x: _error(F.lit(True), F.when(x["text"].isNull(), "ColumnMissing").otherwise("ValueUnparseable"), F.concat("stem", F.lit("/"), x["geo"]), "row_idx"))
    lost = docs.join(columns, "doc_id", "left").select("doc_id", _errors(_error(F.col("wanted").isNull(), "ColumnMissing", "columns of change not found")).alias("errors"))
    return _done(lost, line.select("doc_id", rows.alias("rows"), bad.alias("errors")))


def narrative(docs: DataFrame, fy_start: int, phrases=PHRASES) -> Extract:
    """PIPE-4: figures of bulletins (doc_id, text); figures of the end of a period stand for its last day."""
    span = nine_months(F.lit(fy_start))
    row = F.struct(
        F.col("slug").alias("indicator"), "value", "unit", F.lit("nine_months_cumulative").alias("period_type"), F.concat(F.lit("FY "), label_bs(F.lit(fy_start)), F.lit(" 9M")).alias("period_bs"),
        F.when(F.col("end_of_period"), span["end"]).otherwise(span["start"]).alias("ad_start"), span["end"].alias("ad_end"), "grade", F.col("note").alias("notes"),
    )
    good = F.col("error").isNull()
    found = extract(docs, phrases).select("doc_id", F.array_compact(F.array(F.when(good, row))).alias("rows"), _errors(_error(~good, F.col("error"), F.col("slug"))).alias("errors"))
    return _done(docs.select("doc_id").distinct().withColumn("errors", _errors()), found)


def census(table: DataFrame, stem: str, family: str, unit: str, columns, dimension: DataFrame, overrides: DataFrame | None = None, gate: float = 85.0) -> Extract:
    """PIPE-5: long facts of a wide census table (doc_id, row_idx, the geography columns and the value ``columns``, all strings).

    Rows of places only count; a place is found by an override or a match of ``gate`` or better; a fact that an earlier
    row of its document has is an error.
    """
    docs, lost = table.select("doc_id").distinct(), [c for c in (*CENSUS_GEO, *columns) if c not in table.columns]
    if lost:
        return _done(docs.withColumn("errors", _errors(_error(F.lit(True), "ColumnMissing", f"missing required columns: {', '.join(lost)}"))), None)
    bare = lambda c: F.trim(F.translate(F.trim(c), '"', ""))
    places = table.filter(R.palika_grain("prov", "dist", "gapa")).select("doc_id", "row_idx", bare("gapaname").alias("name"), bare("dname").alias("district"), *(F.struct(F.col(c).alias("raw"), census_number(F.col(c)).alias("v")).alias(f"_{i}") for i, c in enumerate(columns)))
    found = municipalities(written(places), dimension, gate, overrides)
    # How many values of a column the rows before have for the same place; rows without a place have none.
    earlier = Window.partitionBy("doc_id", "federal_code").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    known = F.col("federal_code").isNotNull()
    found = found.withColumns({f"_n{i}": F.when(known, F.count(F.col(f"_{i}.v")).over(earlier)) for i in range(len(columns))})
    slugs = [slugify(F.lit(stem), F.lit(c)) for c in columns]
    fact = lambda i: F.when(
        known & F.col(f"_{i}.v").isNotNull() & (F.col(f"_n{i}") == 0),
        F.struct("federal_code", slugs[i].alias("indicator"), F.col(f"_{i}.v").alias("value"), F.lit(family).alias("indicator_family"), F.lit(stem).alias("source_table_id"), F.lit(unit).alias("unit")),
    )
    bad = lambda i: F.coalesce(_error(known & F.col(f"_{i}.v").isNull(), "ValueUnparseable", columns[i], "row_idx"), _error(known & (F.col(f"_n{i}") > 0), "Other", F.concat(F.lit("duplicate "), "federal_code", F.lit("/"), slugs[i]), "row_idx"))
    unknown = _error(~known, "MunicipalityUnresolved", F.concat("name", F.lit("/"), "district"), "row_idx")
    many = range(len(columns))
    return _done(docs.withColumn("errors", _errors()), found.select("doc_id", F.array_compact(F.array(*map(fact, many))).alias("rows"), _errors(unknown, *map(bad, many)).alias("errors")))


def transfers(cells: DataFrame, dimension: DataFrame, fy_start: int, least: float = 70.0) -> Extract:
    """PIPE-6: grants by place of irregular sheets (cells: doc_id, row_idx, col_idx, text); layout and names are found by their words.

    No header and no column of names are ColumnMissing, a name that matches no place is RegexMismatch; blank names are
    separators and skipped.
    """
    found = written(R.layout(cells))
    named = municipalities(written(R.sheet_rows(cells, found, amount)), dimension, least)
    grant = lambda g: F.struct(
        "federal_code", "name_en", "name_ne", "local_level_type", "district_en", label_bs(F.lit(fy_start)).alias("fiscal_year_bs"), g["grant_type"].alias("grant_type"), g["amount"].alias("amount_npr"),
        F.lit("NPR_thousand").alias("unit"), F.lit("A").alias("confidence_grade"),
    )
    known = F.col("federal_code").isNotNull()
    rows = F.transform(F.filter("grants", lambda _: known), grant)
    lost = F.coalesce(_error(F.col("header_row").isNull(), "ColumnMissing", "no header row found"), _error(F.col("name_col").isNull(), "ColumnMissing", "no column of names found"))
    unknown = _error(~known, "RegexMismatch", F.concat_ws("/", "name", "district"), "row_idx")
    return _done(found.select("doc_id", _errors(lost).alias("errors")), named.select("doc_id", rows.alias("rows"), _errors(unknown).alias("errors")))


def transfer_summary(rows: DataFrame) -> DataFrame:
    """AGG-2: rows, amount and places by grant type, by type of place, and in all (both null)."""
    n = (F.count(F.lit(1)).alias("n"), F.sum("amount_npr").alias("amount"), F.countDistinct("federal_code").alias("places"))
    none = F.lit(None).cast("string")
    by_grant = rows.groupBy("grant_type").agg(*n).withColumn("local_level_type", none)
    by_kind = rows.groupBy("local_level_type").agg(*n).withColumn("grant_type", none)
    return by_grant.unionByName(by_kind).unionByName(rows.agg(*n).withColumn("grant_type", none).withColumn("local_level_type", none)).select("grant_type", "local_level_type", "n", "amount", "places")


def banking(cells: DataFrame, fy_start: int, fy_month: int, month: str, docs: DataFrame | None = None) -> Extract:
    """PIPE-7: monthly balance-sheet figures by class of bank of sheets (cells: doc_id, sheet, row_idx, col_idx, text); a document without the sheet fails.

    The first row of each label counts; a label that is missing is one error, not one for each class.
    """
    norm = lambda c: F.lower(squash(c))
    stems = F.create_map(*(x for label, stem in BANK_LABELS for x in (norm(F.lit(label)), F.lit(stem))))
    classes = F.create_map(*(F.lit(x) for name, i in BANK_CLASSES for x in (i, name)))
    own = cells.filter(F.col("sheet") == BANK_SHEET).withColumn("class", F.try_element_at(classes, F.col("col_idx"))).withColumn("value", plain_number(squash(F.col("text"))))
    line = own.groupBy("doc_id", "row_idx").agg(
        F.try_element_at(stems, norm(F.max(F.when(F.col("col_idx") == BANK_LABEL_COLUMN, F.col("text"))))).alias("stem"), F.collect_list(F.when(F.col("class").isNotNull() & F.col("text").isNotNull(), F.struct("class", "value"))).alias("values")
    )
    # The first row of each label; rows without one are kept together, as they tell that the sheet is there.
    first = written(line.groupBy("doc_id", "stem").agg(F.min_by("values", "row_idx").alias("values")))
    mid = mid_month(F.lit(fy_month), F.lit(fy_start))
    row = lambda x: F.struct(
        x["class"].alias("bank_class"), F.concat(F.lit("bfi-c5-"), F.replace(x["class"], F.lit("_"), F.lit("-")), F.lit("-"), "stem").alias("indicator"), x["value"].alias("value"), F.lit("npr_million").alias("unit"), F.lit("monthly").alias("period_type"),
        F.lit(f"{month} {fy_start if fy_month <= 9 else fy_start + 1}").alias("period_bs"), F.trunc(mid, "month").alias("ad_start"), mid.alias("ad_end"), label_bs(F.lit(fy_start)).alias("fiscal_year_bs"), F.lit("A").alias("grade"),
    )
    error = lambda name, klass: _error(F.lit(True), klass, F.concat("stem", F.lit("/"), name))
    bad = F.transform(F.filter("values", lambda x: x["value"].isNull()), lambda x: error(x["class"], "ValueUnparseable"))
    gone = F.transform(F.array_except(F.array(*(F.lit(name) for name, _ in BANK_CLASSES)), F.col("values.class")), lambda name: error(name, "ColumnMissing"))
    items = first.filter("stem is not null").select("doc_id", F.transform(F.filter("values", lambda x: x["value"].isNotNull()), row).alias("rows"), F.concat(bad, gone).cast(_ERRORS).alias("errors"))
    sheet = first.groupBy("doc_id").agg(F.collect_set("stem").alias("stems"))
    every = (docs if docs is not None else cells).select("doc_id").distinct().join(sheet, "doc_id", "left")
    absent = _errors(_error(F.col("stems").isNull(), "PageLayoutChanged", f"expected sheet {BANK_SHEET} not present"))
    lost = F.transform(F.array_except(F.array(*(F.lit(stem) for _, stem in BANK_LABELS)), F.col("stems")), lambda stem: _error(F.lit(True), "RegexMismatch", stem))
    return _done(every.select("doc_id", F.coalesce(lost.cast(_ERRORS), absent).alias("errors")), items)


def ingested(extract_: Extract, entities: DataFrame, target: DataFrame, key, entity: str = "federal_code", kind: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """PIPE-5, PIPE-6: (rows to append, rows whose entity is unknown, counts): lookup of entities, then insert of what the target lacks.

    Documents whose extract failed give nothing. counts: attempted, inserted, skipped.
    """
    known, unknown = resolved(persisted(extract_), entities.withColumnRenamed("slug", entity), entity, kind)
    new = T.insert_missing(known, target, key)
    return new, unknown, T.insert_counts(known, new)


def archived(found: DataFrame, have: DataFrame, cap: int, key: str = "url") -> DataFrame:
    """PIPE-8: what a crawl does with each link found (category, url, order ``pos``): archived, skipped_duplicate, or nothing beyond ``cap``.

    The first of each url counts; those that the archive has are skipped; of the others the first ``cap`` are taken.
    """
    first = Q.first_wins(found, [key], ["category", "pos"]).filter("rn = 1").drop("rn")
    old = first.join(have.select(key).distinct(), key, "left_semi").withColumn("event_type", F.lit("skipped_duplicate"))
    new = S.capped(first, have, [key], ["category", "pos", key], cap).withColumn("event_type", F.lit("archived"))
    return old.unionByName(new)


def crawl_counters(found: DataFrame, events: DataFrame) -> DataFrame:
    """PIPE-8, AGG-7: discovered, archived, skipped and errors of each category."""
    all_ = found.select("category", F.lit("discovered").alias("event_type")).unionByName(events.select("category", "event_type"))
    return T.manifest_counters(all_, "category", MANIFEST_KINDS)


def seed_local_levels(entities: DataFrame, dimension: DataFrame, n: int = 753, split: dict[str, int] | None = None) -> DataFrame:
    """PIPE-9: entities (kind, slug, name_en, name_ne, district_en, local_level_type) with the local levels of a canonical dimension.

    Refused unless it has ``n`` rows, split by type as expected.
    """
    batch = dimension.select(F.lit("local_level").alias("kind"), F.col("federal_code").alias("slug"), "name_en", "name_ne", "district_en", "local_level_type")
    return T.seeded(entities, batch, ["kind", "slug"], ["name_en", "name_ne", "district_en", "local_level_type"], n, LOCAL_LEVELS if split is None else split, "local_level_type")


def probed(cells: DataFrame, rows: int = 6, columns: int = 16, more: Sequence[Column] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """PIPE-11: (groups of documents by their sheets' dimensions, largest first, with aggregates ``more``; each document with its signature; excerpt of each sheet's top)."""
    members = R.signatures(cells)
    return R.signature_groups(members, *more), members, R.excerpt(cells.withColumn("doc_id", F.concat_ws("/", "doc_id", "sheet")), rows, columns)


def ingest(files: DataFrame, catalog: DataFrame, read: Callable[[DataFrame], Extract], approved: DataFrame, indicators: DataFrame, run_id: str, **checks) -> dict[str, DataFrame]:
    """PIPE-1: archive status, document rows, staged rows, errors, run status and judged rows of new files.

    files: key, hash (SNK-10 decides by them), doc_id, and what ``read`` takes. Every file is a new document row, also one
    whose bytes the archive has; a file whose key holds other bytes is a conflict and goes no further.
    """
    status = T.archive_status(files, catalog)
    documents = status.filter("status <> 'conflict'").select("doc_id", "key", "hash", "status")
    out = read(files.join(documents.select("doc_id"), "doc_id", "left_semi"))
    rows = persisted(out)
    rows = rows.withColumn("staging_id", F.concat_ws("-", F.lit(run_id), "doc_id", "indicator")).withColumn("run_id", F.lit(run_id)).withColumn("document_id", F.col("doc_id")).withColumn("inserted_at", F.lit(1)).drop("doc_id")
    judged = Q.validate(rows, approved, indicators, documents.select(F.col("doc_id").alias("document_id"), "hash"), **checks)
    return {"status": status, "documents": documents, "staging": rows, "errors": out.errors, "runs": out.runs, "judged": judged, "summary": Q.summary(judged)}
