"""Wide sheets to long facts, and layout detection on a cells table (RSH-*, FLT-1..3, AGG-5, AGG-6).

Cells: doc_id, row_idx, col_idx, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Header rules, most specific first; words of aggregate rows; name and district keywords.
GRANT_RULES = (
    (("equalization", "minimum"), "equalization_minimum"),
    (("equalization", "formula"), "equalization_formula"),
    (("equalization", "performance"), "equalization_performance"),
    (("conditional", "current"), "conditional_current"),
    (("conditional", "recurrent"), "conditional_current"),
    (("conditional", "capital"), "conditional_capital"),
    (("special", "current"), "special_current"),
    (("special", "recurrent"), "special_current"),
    (("special", "capital"), "special_capital"),
    (("complementary",), "complementary_capital"),
    (("matching",), "complementary_capital"),
)
TOTAL_WORDS = ("total", "जम्मा", "कुल")
NAME_WORDS = ("local level", "municipality", "name", "स्थानीय")
DISTRICT_WORDS = ("district", "जिल्ला")


def unpivot(df: DataFrame, ids, columns, parse, name: str = "indicator", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """RSH-1: (long values, errors): a cell that ``parse`` can't read is an error row, not a value."""
    long = df.unpivot(list(ids), list(columns), name, "raw").withColumn(value, parse(F.col("raw")))
    return long.filter(F.col(value).isNotNull()).drop("raw"), long.filter(F.col(value).isNull()).drop(value)


def keyword_class(text: Column, rules=GRANT_RULES) -> Column:
    """RSH-7: class of the first rule whose words all occur; null if none does."""
    low, out = F.lower(text), None
    for words, name in rules:
        all_ = None
        for w in words:
            hit = F.contains(low, F.lit(w))
            all_ = hit if all_ is None else all_ & hit
        out = F.when(all_, name) if out is None else out.when(all_, name)
    return out


def any_word(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(text), F.lit(w))
    return out


def layout(cells: DataFrame, top: int = 20, least: int = 2) -> DataFrame:
    """RSH-5, RSH-6, RSH-7 in one pass: for every document header_row, district_col, name_col and grants (array of col_idx, grant_type).

    header_row is the first of the top rows with ``least`` distinct classes, null if there is none; of its cells the
    leftmost of districts and names count, and the column taken as district isn't the name. Rows below the top only tell
    that the document is there.
    """
    upper = F.col("row_idx") < top
    kind, at = F.when(upper, keyword_class(F.col("text"))), F.when(upper, F.col("col_idx"))
    row = cells.groupBy("doc_id", F.when(upper, F.col("row_idx")).otherwise(top).alias("r")).agg(
        F.countDistinct(kind).alias("n"), F.min(F.when(any_word(F.col("text"), DISTRICT_WORDS), at)).alias("district_col"), F.collect_list(F.when(any_word(F.col("text"), NAME_WORDS), at)).alias("names"),
        F.collect_list(F.when(kind.isNotNull(), F.struct("col_idx", kind.alias("grant_type")))).alias("grants"),
    )
    first = row.groupBy("doc_id").agg(F.min_by(F.struct(F.col("r").alias("header_row"), "district_col", "names", "grants"), F.when(F.col("n") >= least, F.col("r"))).alias("h"))
    name = F.array_min(F.filter("h.names", lambda c: ~c.eqNullSafe(F.col("h.district_col"))))
    return first.select("doc_id", "h.header_row", "h.district_col", name.alias("name_col"), "h.grants")


def header_row(cells: DataFrame, top: int = 20, least: int = 2) -> DataFrame:
    """RSH-5: (doc_id, header_row) of the documents that have one."""
    return layout(cells, top, least).select("doc_id", "header_row").filter("header_row is not null")


def name_columns(cells: DataFrame, top: int = 20, least: int = 2) -> DataFrame:
    """RSH-6: (doc_id, district_col, name_col) of the documents that have a header."""
    return layout(cells, top, least).filter("header_row is not null").select("doc_id", "district_col", "name_col")


def is_total(name: Column) -> Column:
    """FLT-2: blank names and names of aggregates."""
    return F.coalesce((F.length(F.trim(name)) == 0) | any_word(name, TOTAL_WORDS), F.lit(True))


def sheet_rows(cells: DataFrame, found: DataFrame, amount) -> DataFrame:
    """RSH-2: (doc_id, row_idx, name, district, grants) of the named rows below each header of ``layout``; grants is an array of (grant_type, amount), blank cells left out."""
    j = cells.join(found.filter("name_col is not null"), "doc_id").filter("row_idx > header_row")
    kind = F.get(F.filter("grants", lambda g: g["col_idx"] == F.col("col_idx")), F.lit(0))["grant_type"]
    text, value = F.trim("text"), amount(F.col("text"))
    j = j.withColumn("kind", kind).withColumn("value", value).filter("kind is not null or col_idx = name_col or col_idx = district_col")
    rows = j.groupBy("doc_id", "row_idx").agg(
        F.max(F.when(F.col("col_idx") == F.col("name_col"), text)).alias("name"), F.max(F.when(F.col("col_idx") == F.col("district_col"), text)).alias("district"),
        F.collect_list(F.when(F.col("kind").isNotNull() & F.col("value").isNotNull(), F.struct(F.col("kind").alias("grant_type"), F.col("value").alias("amount")))).alias("grants"),
    )
    return rows.filter(~is_total(F.col("name")))


def grants(cells: DataFrame, amount) -> DataFrame:
    """RSH-2: long rows (doc_id, row_idx, name, grant_type, amount) below the header; blank cells are skipped."""
    return sheet_rows(cells, layout(cells), amount).select("doc_id", "row_idx", "name", F.explode("grants").alias("g")).select("doc_id", "row_idx", "name", "g.*")


def needle_columns(cells: DataFrame, needles: DataFrame) -> DataFrame:
    """RSH-8: (doc_id, geo, row_idx, col_idx) of each needle's earliest cell; documents that lack one give none. ``needles`` is a job's short list."""
    hit = cells.join(F.broadcast(needles), F.trim(cells["text"]) == needles["needle"]).groupBy("doc_id", "geo").agg(F.min(F.struct("row_idx", "col_idx")).alias("at"))
    total = needles.select("geo").distinct().count()
    full = hit.groupBy("doc_id").agg(F.collect_list(F.struct("geo", "at")).alias("hits")).filter(F.size("hits") == total)
    return full.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.geo", "h.at.row_idx", "h.at.col_idx")


def matrix(cells: DataFrame, labels: DataFrame, classes: DataFrame, label_col: int, parse) -> DataFrame:
    """RSH-4: for every document, label (label, stem) and class (class, col_idx): value, or the error missing_label, missing_column or bad_number."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    first = cells.filter(F.col("col_idx") == label_col).groupBy("doc_id", norm(F.col("text")).alias("l")).agg(F.min("row_idx").alias("row_idx"))
    want = cells.select("doc_id").distinct().join(F.broadcast(labels.withColumn("l", norm(F.col("label"))).crossJoin(classes)))
    j = want.join(first, ["doc_id", "l"], "left").join(cells.select("doc_id", "row_idx", "col_idx", F.col("text").alias("raw")), ["doc_id", "row_idx", "col_idx"], "left")
    value = parse(F.col("raw"))
    error = F.when(F.col("row_idx").isNull(), "missing_label").when(F.col("raw").isNull(), "missing_column").when(value.isNull(), "bad_number")
    return j.select("doc_id", "class", "stem", value.alias("value"), error.alias("error"))


def missing_columns(required, header: Column) -> Column:
    """RSH-9, SET-4."""
    return F.array_except(F.array(*map(F.lit, required)), header)


def signatures(cells: DataFrame) -> DataFrame:
    """RSH-10: (doc_id, signature): each document with its sheets and their dimensions."""
    dims = cells.groupBy("doc_id", "sheet").agg((F.max("row_idx") + 1).alias("r"), (F.max("col_idx") + 1).alias("c"))
    return dims.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "sheet", F.concat_ws("x", "r", "c")))), "|").alias("signature"))


def signature_groups(members: DataFrame, *more: Column) -> DataFrame:
    """RSH-10: (signature, n, first_doc) of ``signatures``, largest group first, then aggregates ``more`` of each group.

    Who is in a group is told by ``members``, not by a list in one row, unless ``more`` asks for one.
    """
    return members.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), *more).orderBy(F.desc("n"), "signature")


def excerpt(cells: DataFrame, rows: int = 6, columns: int = 16) -> DataFrame:
    """RSH-11: (doc_id, row_idx, line): the top cells joined by bars, trailing blanks cut."""
    top = cells.filter((F.col("row_idx") < rows) & (F.col("col_idx") < columns))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "|")
    return top.groupBy("doc_id", "row_idx").agg(F.regexp_replace(line, r"[|\s]+$", "").alias("line"))


def palika_grain(*codes: str) -> Column:
    """FLT-1: all codes are whole numbers other than 0."""
    out = F.lit(True)
    for c in codes:
        out = out & F.coalesce(F.col(c).try_cast("int") != 0, F.lit(False))
    return out


def index_row(code: Column, label: Column) -> Column:
    """FLT-3."""
    return F.coalesce(code, F.lit("")).rlike(r"^[AB](\.\d{1,2})?$") | ((F.coalesce(code, F.lit("")) == "") & (label == "Overall Index"))


def run_status(rows: DataFrame, errors: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """AGG-5: failure without rows, partial with errors too, else success."""
    r, e = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")), errors.groupBy(key).agg(F.count(F.lit(1)).alias("n_errors"))
    j = docs.select(key).join(r, key, "left").join(e, key, "left").na.fill(0, ["n_rows", "n_errors"])
    return j.withColumn("status", F.when(F.col("n_rows") == 0, "failure").when(F.col("n_errors") > 0, "partial").otherwise("success"))


def error_summary(errors: DataFrame, key: str, ordinal: str, klass: str, detail: str) -> DataFrame:
    """AGG-6."""
    g = errors.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(F.col(klass).alias("k"), F.col(detail).alias("d")), ordinal).alias("f"))
    return g.select(key, F.concat(F.col("n").cast("string"), F.lit(" error(s); first: "), F.col("f.k"), F.lit(": "), F.col("f.d")).alias("summary"))
