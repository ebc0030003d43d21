"""The entity-by-month panel: typed load, and adapters that derive one from order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..functions.lexicon import SECTORS
from ..functions.months import month_label, month_number, month_number_of, month_text, parse_month_date
from ..functions.numbers import cents, effective_value

PANEL_COLUMNS = (
    "report_month", "sl_no", "project_code", "legacy_ocms_code",
    "identifier_status", "project_name", "agency", "ministry", "sector",
    "state", "date_of_approval", "start_date", "original_doc", "revised_doc",
    "original_cost", "revised_cost", "expenditure", "physical_progress",
    "source_file", "source_page", "source_section", "extraction_status",
)
ENRICHED_COLUMNS = PANEL_COLUMNS + ("identity_key", "identifier_classification", "quality_flags")
MEASURES = ("original_cost", "revised_cost", "expenditure", "physical_progress")
DATE_FIELDS = ("date_of_approval", "start_date", "original_doc", "revised_doc")

MONTH_SHIFT = 300  # order dates are moved 25 years on, into the reporting years
ENTITIES_PER_PAGE = 20


def read_panel(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read a stored panel with every column as text (identifiers stay strings)."""
    schema = ", ".join(f"{c} STRING" for c in ENRICHED_COLUMNS)
    if fmt == "csv":
        return spark.read.schema(schema).csv(path, header=True)
    frame = spark.read.format(fmt).load(path)
    return frame.select([F.col(c).cast("string").alias(c) for c in frame.columns])


def typed_panel(panel: DataFrame) -> DataFrame:
    """Add month integers, effective end and cost, and the traceable flag."""
    numeric = {c: F.col(c).try_cast("double") for c in MEASURES}
    return (
        panel.withColumns(numeric)
        .withColumns(
            {
                "month_number": month_number(F.col("report_month")),
                "original_end": parse_month_date(F.col("original_doc")),
                "revised_end": parse_month_date(F.col("revised_doc")),
            }
        )
        .withColumns(
            {
                "effective_end": effective_value(F.col("revised_end"), F.col("original_end")),
                "effective_cost": effective_value(F.col("revised_cost"), F.col("original_cost")),
                "traceable": F.coalesce(
                    F.col("identity_key").startswith("P:") | F.col("identity_key").startswith("L:"),
                    F.lit(False),
                ),
            }
        )
    )


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given parquet tables; its schema is inferred on the first read only."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _places(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("nationkey"),
        F.col("n_name").alias("state"),
        F.col("r_name").alias("ministry"),
    )


def supplier_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier-by-month totals of the line items (dense panel)."""
    part = table(spark, folder, "part").select(
        "p_partkey", "p_size",
        F.regexp_extract("p_brand", r"(\d+)$", 1).try_cast("int").alias("brand_number"),
    )
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("entity"),
        (month_number_of(F.col("l_shipdate")) + MONTH_SHIFT).alias("month_number"),
        "l_partkey", "l_quantity", "l_returnflag", "l_linestatus",
        cents(F.col("l_extendedprice")).alias("price"),
    )
    signed = F.when(F.col("l_returnflag") == "R", -F.col("price")).otherwise(F.col("price"))
    closed = F.sum(F.when(F.col("l_linestatus") == "F", 1).otherwise(0))
    return (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .groupBy("entity", "month_number")
        .agg(
            F.sum("price").alias("amount"),
            F.sum(signed).alias("signed_amount"),
            F.floor(F.sum("l_quantity") / 10).cast("int").alias("units"),
            F.when(F.count("*") > 1, F.round(closed * 100 / F.count("*"), 2)).alias("progress"),
            # Numbers, not texts, are aggregated: a text maximum would need a sort.
            F.max("p_size").alias("largest_size"),
            F.max("brand_number").alias("largest_brand"),
        )
        .withColumns(
            {
                "sector": F.element_at(
                    F.array(*[F.lit(x) for x in SECTORS]), F.col("largest_size") % len(SECTORS) + 1
                ),
                "agency": F.concat(F.lit("Brand#"), F.col("largest_brand").cast("string")),
            }
        )
    )


def customer_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Customer-by-month totals of the orders (sparse panel)."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("entity"),
        (month_number_of(F.col("o_orderdate")) + MONTH_SHIFT).alias("month_number"),
        "o_orderstatus", "o_orderpriority",
        cents(F.col("o_totalprice")).alias("price"),
    )
    signed = F.when(F.col("o_orderstatus") == "P", -F.col("price")).otherwise(F.col("price"))
    closed = F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    return orders.groupBy("entity", "month_number").agg(
        F.sum("price").alias("amount"),
        F.sum(signed).alias("signed_amount"),
        F.floor(F.sum("price") / 1000000).cast("int").alias("units"),
        F.round(closed * 100 / F.count("*"), 2).alias("progress"),
        F.max(F.substring("o_orderpriority", 1, 1).try_cast("int")).alias("priority"),
    ).withColumn("agency", F.concat(F.lit("Priority-"), F.col("priority").cast("string")))


def _panel_from_facts(facts: DataFrame, places: DataFrame, file_prefix: str) -> DataFrame:
    """Derive the 22 panel columns; each entity has at most one row per month.

    All windows share one partitioning and one sort, and a window partition never
    holds more rows than there are calendar months.
    """
    entity = F.col("entity")
    by_entity = Window.partitionBy("entity").orderBy("month_number")
    so_far = by_entity.rowsBetween(Window.unboundedPreceding, 0)
    windowed = facts.withColumns(
        {
            "first_month": F.first("month_number").over(so_far),
            "first_amount": F.first("amount").over(so_far),
            "peak_amount": F.max("amount").over(so_far),
            "spent": F.sum("signed_amount").over(so_far),
            "peak_units": F.max("units").over(so_far),
        }
    )
    month = F.col("month_number")
    first = F.col("first_month")
    code = F.when(entity % 10 != 0, (entity + 100000).cast("string"))
    legacy = F.when(
        entity % 20 == 0, F.concat(F.lit("N"), F.lpad(entity.cast("string"), 8, "0"))
    )
    token = F.when(
        entity % 100 == 70, F.concat(F.lit(" ("), (entity + 600000).cast("string"), F.lit(")"))
    ).otherwise("")
    status = (
        F.when(entity % 10 != 0, "PRIMARY_IDENTIFIER")
        .when(entity % 20 == 0, "ALTERNATE_IDENTIFIER")
        .when(entity % 40 == 10, "SOURCE_MISSING_ID")
        .otherwise("UNKNOWN")
    )
    label = month_label(month)
    return windowed.join(places, "entity").select(
        label.alias("report_month"),
        entity.cast("long").alias("sl_no"),
        code.alias("project_code"),
        legacy.alias("legacy_ocms_code"),
        status.alias("identifier_status"),
        F.concat(F.col("entity_name"), token).alias("project_name"),
        "agency",
        "ministry",
        "sector",
        "state",
        F.when(entity % 13 == 5, "N.A.").otherwise(month_text(first - 12)).alias("date_of_approval"),
        F.when(entity % 3 != 0, month_text(first - 6)).alias("start_date"),
        month_text(first + 36).alias("original_doc"),
        F.when(F.col("peak_units") > 36, month_text(first + F.col("peak_units"))).alias("revised_doc"),
        (F.col("first_amount") / 100).alias("original_cost"),
        F.when(F.col("peak_amount") > F.col("first_amount"), F.col("peak_amount") / 100).alias(
            "revised_cost"
        ),
        (F.col("spent") / 100).alias("expenditure"),
        F.col("progress").cast("double").alias("physical_progress"),
        F.concat(F.lit(file_prefix), label, F.lit(".txt")).alias("source_file"),
        (F.floor(entity / ENTITIES_PER_PAGE) + 1).cast("int").alias("source_page"),
        F.concat(F.lit("Table "), (entity % 3 + 5).cast("string")).alias("source_section"),
        F.when((entity % 10 != 0) & (entity % 17 != 0), "SUCCESS")
        .otherwise("PARTIAL")
        .alias("extraction_status"),
    )


def supplier_month(spark: SparkSession, folder: str) -> DataFrame:
    """Dense panel: one row per supplier and shipping month."""
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("entity"), F.col("s_name").alias("entity_name"),
        F.col("s_nationkey").alias("nationkey"),
    )
    places = suppliers.join(_places(spark, folder), "nationkey").drop("nationkey")
    return _panel_from_facts(supplier_facts(spark, folder), places, "supplier_")


def customer_month(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse panel: one row per customer and ordering month."""
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("entity"), F.col("c_name").alias("entity_name"),
        F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("sector"),
    )
    places = customers.join(_places(spark, folder), "nationkey").drop("nationkey")
    return _panel_from_facts(customer_facts(spark, folder), places, "customer_")


def traceable(panel: DataFrame) -> DataFrame:
    """Rows whose identity comes from a primary or an alternate source identifier."""
    return panel.where("traceable")


def checked_unique(panel: DataFrame) -> DataFrame:
    """Refuse duplicate entity-months while rows flow, without a second pass.

    The check is a window count over the same partitioning and order the later
    feature and label windows use, so it adds no shuffle. It guards ``report_month``,
    which every feature and label row carries as its key.
    """
    same_month = (
        Window.partitionBy("identity_key").orderBy("month_number").rangeBetween(0, 0)
    )
    message = F.concat_ws(
        " ", F.lit("duplicate entity-month:"), F.col("identity_key"), F.col("report_month")
    )
    guarded = F.when(F.count(F.lit(1)).over(same_month) == 1, F.col("report_month"))
    return panel.withColumn(
        "report_month", guarded.otherwise(F.raise_error(message).cast("string"))
    )
