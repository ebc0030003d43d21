"""Titled, headerless report files: discovery, reading, typing, routing and output."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.lexicon import REPORT_TYPES
from ..functions.months import month_from_path
from ..functions.numbers import effective_value
from ..functions.text import parse_currency, parse_numeric, parse_paren_costs, strip
from ..operators.digests import ordered_digest
from ..session import root_depth, written
from . import digest_source
from .month_store import read_months, store_months

QUOTED_OR_PLAIN_FIELD = r',("(?:[^"]|"")*"|[^,]*)'


def discover_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Matching files below a folder, with their type (file stem) and month.

    A table stored as a folder of part files is one entry, by the folder's name and the size of
    its parts. Only file metadata is read: the content column is pruned from the scan.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", F.col("length").alias("size_bytes"))
    )
    whole = files.select(_table_path(F.col("path"), root_depth(spark, folder), pattern).alias("path"), "size_bytes")
    return with_file_names(whole.groupBy("path").agg(F.sum("size_bytes").alias("size_bytes")))


def _table_path(path: Column, depth: int, pattern: str) -> Column:
    """The outermost folder, below ``depth`` components, that is a table stored in parts, else the path.

    Such a folder is named like a matching file and has the extension of the part.
    """
    parts = F.split(path, "/")

    def extension(name: Column) -> Column:
        return F.regexp_extract(name, r"(\.[^.]+)$", 1)

    own = extension(F.element_at(parts, -1))
    places = F.filter(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: (i > depth) & F.element_at(parts, i).rlike("^" + fnmatch.translate(pattern))
        & (own != "") & (extension(F.element_at(parts, i)) == own),
    )
    return F.coalesce(F.array_join(F.slice(parts, F.lit(1), F.get(places, 0)), "/"), path)


def with_file_names(files: DataFrame) -> DataFrame:
    """Add file name, dataset type and month, all taken from ``path``."""
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    return files.withColumns(
        {
            "file_name": name,
            "dataset_type": F.regexp_replace(name, r"\.[^.]+$", ""),
            "report_month": month_from_path(F.col("path")),
        }
    )


def read_text_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """One row per file: path and whole content (report files are small)."""
    return (
        spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


def csv_fields(line: Column) -> Column:
    """Fields of one CSV line, quotes removed; lines may have any number of fields.

    A leading comma is added so that every match consumes at least one character.
    """
    raw = F.regexp_extract_all(
        F.concat(F.lit(","), line), F.lit(QUOTED_OR_PLAIN_FIELD), F.lit(1)
    )

    def unquoted(field: Column) -> Column:
        inner = F.substring(field, F.lit(2), F.length(field) - 2)
        return F.when(
            field.startswith('"') & field.endswith('"') & (F.length(field) >= 2),
            F.replace(inner, F.lit('""'), F.lit('"')),
        ).otherwise(field)

    return F.transform(raw, unquoted)


def read_titled_csv(files: DataFrame, refuse_numeric_title: bool = False) -> DataFrame:
    """Rows of titled files: path, type, month, title, row number and string fields.

    Blank lines are skipped. The first line is the title when it has a single field;
    with ``refuse_numeric_title`` a numeric-looking line is data. Everything happens
    inside the file's row, so no shuffle is needed.
    """
    text = F.regexp_replace(F.col("content"), "^﻿", "")
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: strip(x) != "")
    first = F.get(F.col("lines"), 0)
    fields = csv_fields(strip(first))
    is_title = F.size(fields) == 1
    if refuse_numeric_title:
        bare = F.regexp_replace(F.get(fields, 0), r"[.\- ]", "")
        is_title = is_title & ~bare.rlike(r"^\d+$")
    start = F.when(F.col("is_title"), 2).otherwise(1)
    body = F.slice(F.col("lines"), start, F.size("lines"))
    return (
        with_file_names(files)
        .withColumn("lines", lines)
        .where(F.size("lines") > 0)
        .withColumns({"is_title": is_title, "title": F.when(is_title, F.get(fields, 0))})
        .select(
            "path", "file_name", "dataset_type", "report_month", "title",
            F.posexplode(body).alias("row_number", "line"),
        )
        .select(
            "path", "file_name", "dataset_type", "report_month", "title", "row_number",
            csv_fields(F.col("line")).alias("fields"),
        )
    )


def _provenance() -> list[Column]:
    return [F.col("file_name").alias("source_file"), F.lit("aggregate_csv").alias("source_type")]


def cost_overview(rows: DataFrame) -> DataFrame:
    """National cost rows: three currency amounts from rows with at least four fields."""
    return rows.where(F.size("fields") >= 4).select(
        "report_month",
        parse_currency(F.col("fields")[1]).alias("original_cost_crores"),
        parse_currency(F.col("fields")[2]).alias("revised_cost_crores"),
        parse_currency(F.col("fields")[3]).alias("expenditure_crores"),
        *_provenance(),
    )


def keyed_totals(rows: DataFrame, key: str) -> DataFrame:
    """Rows keyed by a progress range, sector or state: count, costs and expenditure."""
    costs = parse_paren_costs(F.col("fields")[3])
    return rows.where(F.size("fields") >= 5).select(
        "report_month",
        strip(F.col("fields")[1]).alias(key),
        parse_numeric(F.col("fields")[2]).alias("project_count"),
        costs["original"].alias("original_cost_crores"),
        costs["revised"].alias("revised_cost_crores"),
        parse_numeric(F.col("fields")[4]).alias("expenditure_crores"),
        *_provenance(),
    )


def _of_type(rows: DataFrame, dataset_type: str) -> DataFrame:
    return rows.where((F.col("dataset_type") == dataset_type) & F.col("report_month").isNotNull())


def process_reports(files: DataFrame) -> dict[str, DataFrame]:
    """Every known report type as one table over all its months."""
    rows = read_titled_csv(files)
    tables = {}
    for dataset_type, (name, key) in REPORT_TYPES.items():
        typed = _of_type(rows, dataset_type)
        tables[name] = cost_overview(typed) if key is None else keyed_totals(typed, key)
    return tables


def routing(files: DataFrame) -> DataFrame:
    """Output table of each file, or why it is skipped."""
    known = F.lit(None).cast("string")
    for dataset_type, (name, _) in REPORT_TYPES.items():
        known = F.when(F.col("dataset_type") == dataset_type, name).otherwise(known)
    return with_file_names(files).select(
        "path", "dataset_type", "report_month", known.alias("output_table"),
        F.when(known.isNull(), "SKIPPED_UNKNOWN_TYPE")
        .when(F.col("report_month").isNull(), "SKIPPED_NO_MONTH")
        .otherwise("PROCESSED")
        .alias("routing"),
    )


def routing_counts(files: DataFrame) -> DataFrame:
    """Files per routing outcome."""
    return routing(files).groupBy("routing").agg(F.count("*").alias("files"))


def write_reports(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Bring the stored CSV tables up to a delivery, month by month; see ``store_months``.

    Returns the change of each delivered month, by table.
    """
    return {name: store_months(table, f"{folder}/{name}", fmt="csv", header="true") for name, table in tables.items()}


def read_reports(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The stored tables, typed like ``tables``."""
    return {name: read_months(spark, f"{folder}/{name}", table.schema, "csv", header="true") for name, table in tables.items()}


def with_period(panel: DataFrame, layout: Column) -> DataFrame:
    """The rows with their ``period``, monthly or quarterly."""
    return panel.withColumn("period", F.when(layout == "QUARTERLY", "quarterly").when(layout.isNotNull(), "monthly"))


def split_periods(panel: DataFrame, layout: Column) -> tuple[DataFrame, DataFrame]:
    """Monthly rows and quarterly rows, which are never mixed."""
    quarterly = layout == "QUARTERLY"
    return panel.where(~quarterly), panel.where(quarterly)


def write_periods(panel: DataFrame, layout: Column, folder: str) -> dict[str, DataFrame]:
    """Bring stored monthly rows, and quarterly rows apart from them, up to a delivery.

    A delivered month replaces itself in the part that it belongs to; see ``store_months``.
    """
    monthly, quarterly = split_periods(panel, layout)
    return {
        name: store_months(rows, f"{folder}/{name}", ("sl_no",))
        for name, rows in (("project_monthly", monthly), ("project_quarterly", quarterly))
    }


def fixed_precision(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns as text with a fixed number of decimals; other columns as they are."""
    floats = [f.name for f in frame.schema.fields if f.dataType.typeName() in ("double", "float")]
    return frame.withColumns(
        {c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c))) for c in floats}
    )


def write_fixed_csv(frame: DataFrame, path: str, digits: int = 6) -> None:
    """CSV sink with fixed-precision numbers."""
    fixed_precision(frame, digits).write.mode("overwrite").csv(path, header=True)


def write_report_text(lines: DataFrame, path: str) -> None:
    """Text sink of a scoped report, header first, body in code order."""
    lines.repartitionByRange("section", "sort_key").sortWithinPartitions("section", "sort_key").select(
        "line"
    ).write.mode("overwrite").text(path)


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*", **options) -> DataFrame:
    """Name, size and SHA-256 of every matching file, of any size.

    Tasks stream their own files in constant memory (``digest_source``). In a store that only
    Spark itself can reach, whole files are read instead, of at most 2 GB each.
    """
    if digest_source.reachable(folder):
        digest_source.register(spark)
        files = spark.read.format(digest_source.NAME).options(pattern=pattern, **options).load(folder)
        return files.select("file_name", "size_bytes", "sha256")
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select(
            F.element_at(F.split(F.col("path"), "/"), -1).alias("file_name"),
            F.col("length").alias("size_bytes"),
            F.sha2(F.col("content"), 256).alias("sha256"),
        )
    )


def manifest_summary(manifest: DataFrame, expected_files: int | None = None) -> DataFrame:
    """File count, total bytes, a digest of the entries in order of name, and the count check."""
    entry = F.concat_ws(":", "file_name", F.col("size_bytes").cast("string"), "sha256")
    intact = F.lit(True) if expected_files is None else F.count("*") == expected_files
    stored = written(manifest, "manifest")
    counted = stored.agg(
        F.count("*").alias("file_count"), F.sum("size_bytes").alias("total_bytes"), intact.alias("intact"), F.lit(1).alias("k")
    )
    digest = ordered_digest(stored.withColumn("k", F.lit(1)), ["k"], [F.col("file_name")], entry)
    return counted.join(digest, "k", "left").select(
        "file_count", "total_bytes", F.col("digest").alias("aggregate_sha256"), "intact"
    )


# --- report files derived from a panel -------------------------------------------------


def _amount(value: Column) -> Column:
    return value.cast("decimal(18,2)").cast("string")


def _quoted(*parts: Column) -> Column:
    return F.concat_ws(",", *[F.concat(F.lit('"'), p, F.lit('"')) for p in parts])


def _rupees(value: Column) -> Column:
    """Whole amount with a currency sign and one thousands separator."""
    whole = F.floor(value.cast("double")).cast("long")
    thousands = F.floor(whole / 1000).cast("long")
    rest = F.lpad((whole - thousands * 1000).cast("string"), 3, "0")
    return F.concat(F.lit("₹ "), thousands.cast("string"), F.lit(","), rest)


def progress_range(progress: Column) -> Column:
    """'0-10' up to '90-100', and '100'."""
    low = (F.floor(progress / 10) * 10).cast("int")
    return F.when(progress >= 100, "100").otherwise(
        F.concat(low.cast("string"), F.lit("-"), (low + 10).cast("string"))
    )


def report_files_from_panel(panel: DataFrame) -> DataFrame:
    """Aggregate report files (path, content) of every month of a panel.

    A file holds one line per state, sector or progress range, so the lines gathered for
    one file do not grow with the panel. Some files have an unknown type or no month.
    """
    effective = effective_value(F.col("revised_cost"), F.col("original_cost"))
    kinds = F.array(
        *[
            F.struct(
                F.lit(dataset_type).alias("dataset_type"), F.lit(title).alias("title"), key.alias("key")
            )
            for dataset_type, title, key in (
                ("State-Wise-Report", "State Wise Details", F.col("state")),
                ("Sector-Wise-Report", "Sector Wise Details", F.col("sector")),
                (
                    "Physical-Progress-Report", "Physical Progress",
                    progress_range(F.col("physical_progress")),
                ),
                ("Cost-Wise-Report", "Cost Wise Details", F.lit("")),
            )
        ]
    )
    totals = (
        panel.withColumn("kind", F.explode(F.filter(kinds, lambda k: k["key"].isNotNull())))
        .groupBy("report_month", "kind.dataset_type", "kind.title", "kind.key")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.col("original_cost").cast("decimal(18,2)")).alias("original"),
            F.sum(effective.cast("decimal(18,2)")).alias("revised"),
            F.sum(F.col("expenditure").cast("decimal(18,2)")).alias("spent"),
        )
    )
    national = _quoted(
        F.lit(""), _rupees(F.col("original")), _rupees(F.col("revised")), _rupees(F.abs(F.col("spent")))
    )
    keyed = _quoted(
        F.col("n").cast("string"), F.col("key"), F.col("n").cast("string"),
        F.concat(_amount(F.col("original")), F.lit(" ("), _amount(F.col("revised")), F.lit(")")),
        _amount(F.col("spent")),
    )
    lines = totals.withColumn("line", F.when(F.col("key") == "", national).otherwise(keyed))
    content = F.concat_ws(
        "\n",
        F.concat(F.lit('"'), F.col("title"), F.lit('"')), F.lit(""),
        F.array_join(F.transform(F.array_sort("body"), lambda b: b["line"]), "\n"),
    )
    files = (
        lines.groupBy("report_month", "dataset_type", "title")
        .agg(F.collect_list(F.struct("key", "line")).alias("body"))
        .select("report_month", "dataset_type", content.alias("content"))
    )
    month = F.substring("report_month", 6, 2).cast("int")
    kind = (
        F.when((F.col("dataset_type") == "Sector-Wise-Report") & (month == 6), "Agency-Wise-Report")
        .otherwise(F.col("dataset_type"))
    )
    place = F.when(
        (F.col("dataset_type") == "State-Wise-Report") & (month == 12),
        F.concat(F.lit("undated"), F.substring("report_month", 3, 2)),
    ).otherwise(F.col("report_month"))
    return files.select(
        F.concat_ws("/", F.lit("raw"), place, F.concat(kind, F.lit(".csv"))).alias("path"), "content"
    )
