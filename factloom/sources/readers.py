"""Scans of files and documents (SRC-2 to SRC-4, SRC-6 to SRC-11; ``delimited`` has SRC-1, ``html`` SRC-5), link discovery (WIN-4, WIN-7), archive catalogs (SNK-11..13, AGG-7, CHK-11)."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from factloom.functions.text import inner_text

MANIFEST = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("event_type", "url", "category_id", "occurred_at")] + [T.StructField("payload", T.MapType(T.StringType(), T.StringType())), T.StructField("schema_version", T.StringType())]
)


def string_csv(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """SRC-2: a CSV without header, every cell a string, blanks empty strings."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(columns)])
    return spark.read.csv(path, schema=schema, header=False, enforceSchema=True).na.fill("")


def cells_of(rows: DataFrame, doc: str, row: str, array: str) -> DataFrame:
    """SRC-3: a cells table from rows with an array of cells."""
    return rows.select(F.col(doc).alias("doc_id"), F.col(row).alias("row_idx"), F.posexplode(array).alias("col_idx", "text"))


def sheet_of(cells: DataFrame, sheet: str) -> tuple[DataFrame, DataFrame]:
    """SRC-3: (cells of a named sheet, documents without it as doc_id and error)."""
    own = cells.filter(F.col("sheet") == sheet)
    lost = cells.select("doc_id").distinct().join(own.select("doc_id").distinct(), "doc_id", "left_anti")
    return own, lost.withColumn("error", F.lit(f"expected sheet {sheet} not present"))


def document_text(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """SRC-4: (doc, text, error): pages in order, joined by line ends, soft hyphens closed up; empty text is an error."""
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page), F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    out = pages.groupBy(doc).agg(F.regexp_replace(own, r"-\s*\n\s*", "").alias("text"))
    return out.withColumn("error", F.when(F.trim("text") == "", "empty text"))


def new_links(found: DataFrame, crawl: str, page: str, pos: str, url: str = "url") -> DataFrame:
    """WIN-4: the first occurrence of each url of a crawl, by page and place."""
    w = Window.partitionBy(crawl, url).orderBy(page, pos)
    return found.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def container_text(html: Column, href: Column, most: int = 200) -> Column:
    """STR-15 as an expression: text of the list item or table row around a link, by splitting at container tags; ``html.anchors`` has the exact form."""
    parts = F.split(html, r"(?i)<(?:li|tr|div|p)\b[^>]*>")
    own = F.get(F.filter(parts, lambda x: F.contains(x, href)), F.lit(0))
    return F.substring(inner_text(own), 1, most)


def pages_kept(found: DataFrame, page: str, url: str, cap: int = 20, crawl: str | None = None) -> DataFrame:
    """WIN-7: (page, new): pages before the first that adds no new url, ``cap`` at most; ``found`` has a row for each page and url.

    With a ``crawl`` column each crawl stops by itself, and the column comes first.
    """
    by = [crawl] if crawl else []
    first = found.groupBy(*by, url).agg(F.min(page).alias(page))
    new = found.select(*by, page).distinct().join(first.groupBy(*by, page).agg(F.count(F.lit(1)).alias("new")), [*by, page], "left").na.fill(0, ["new"])
    stop = new.filter("new = 0").groupBy(*by).agg(F.coalesce(F.min(page), F.lit(cap + 1)).alias("stop"))
    met = new.join(stop, by, "left") if by else new.crossJoin(F.broadcast(stop))
    return met.filter((F.col(page) < F.coalesce("stop", F.lit(cap + 1))) & (F.col(page) <= cap)).select(*by, page, "new")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: manifest events; blank lines are ignored, the version defaults to 1."""
    return spark.read.schema(MANIFEST).json(path).na.fill("1", ["schema_version"]).filter("event_type is not null")


def decoded(payload: Column, schema: str, required, rules=None) -> Column:
    """SRC-7: struct(value, error): not_json and shape are different errors.

    ``rules``: for a field what its value has to hold, e.g. ``lambda v: v.rlike("^[0-9]{8}$")``, ``lambda v: F.length(v) >= 3``, ``lambda v: v.isin("A", "B")``.
    """
    v = F.from_json(payload, schema)
    lacking = F.lit(False)
    for c in required:
        lacking = lacking | v[c].isNull()
    for c, rule in (rules or {}).items():
        lacking = lacking | (v[c].isNotNull() & ~F.coalesce(rule(v[c]), F.lit(False)))
    is_json = F.get_json_object(payload, "$").isNotNull()
    return F.struct(F.when(is_json & ~lacking, v).alias("value"), F.when(~F.coalesce(is_json, F.lit(False)), "not_json").when(lacking, "shape").alias("error"))


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SRC-9, SRC-10: (path, length, content, sha256, error) of files; empty ones are errors.

    Spark's scans leave files without bytes out; its listing, which the driver holds anyway, tells which those are.
    """
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    every = spark.createDataFrame([(unquote(p).replace(":///", ":/"),) for p in f.inputFiles()], "path string")
    bare = every.join(f.select(F.replace("path", F.lit(":///"), F.lit(":/")).alias("path")), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    f = f.select("path", "length", "content").unionByName(bare)
    return f.select("path", "length", "content", F.sha2("content", 256).alias("sha256"), F.when(F.col("length") == 0, "empty file").alias("error"))


def corpus(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """SRC-10: the files of a folder that match, by path."""
    return files(spark, path, glob).orderBy("path")


def registry_faults(registry: DataFrame) -> DataFrame:
    """SRC-11: (source_id, fault) of a user's registry (source_id, tier, mode, agency, dataset, frequency): bad ids, modes and blanks."""
    from factloom.functions.text import is_source_id

    blank = lambda c: F.when(F.coalesce(F.trim(c) == "", F.lit(True)), F.lit(f"{c}: missing"))
    faults = F.array_compact(F.array(F.when(~F.coalesce(is_source_id(F.col("source_id")), F.lit(False)), F.lit("source_id: bad shape")), F.when(F.col("tier") < 1, F.lit("tier: below 1")), *map(blank, ("mode", "agency", "dataset", "frequency"))))
    return registry.select("source_id", F.explode(faults).alias("fault"))


def tampered(catalog: DataFrame, now: DataFrame) -> DataFrame:
    """CHK-11: catalog entries (path, sha256) whose file is gone or has other content."""
    return catalog.join(now.select("path", F.col("sha256").alias("found")), "path", "left").filter(~F.col("sha256").eqNullSafe(F.col("found")))


def canonical_dimension(raw: DataFrame) -> DataFrame:
    """SRC-8: rows of the four types with code, district and names; codes as eight digits, names trimmed, types as slugs."""
    from factloom.functions.text import federal_code

    kinds = {"Metropolitan City": "metropolitan", "Sub-Metropolitan City": "sub_metropolitan", "Municipality": "municipality", "Rural Municipality": "rural_municipality"}
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.trim("type"))
    out = raw.select(federal_code(F.col("code")).alias("federal_code"), F.trim("name_en").alias("name_en"), F.trim("name_ne").alias("name_ne"), F.trim("district").alias("district_en"), kind.alias("local_level_type"))
    return out.filter("federal_code is not null and local_level_type is not null and name_en <> '' and name_ne <> '' and district_en <> ''")
