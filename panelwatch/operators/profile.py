"""Profiles and audits of raw tables, in long form (file, column, statistic)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lexicon import SEMANTIC_FAMILIES
from ..functions.numbers import NUMBER
from ..functions.text import strip
from ..session import written

FILE_KEYS = ("path", "dataset_type", "report_month", "title")
SAMPLES = 5  # fixed value
SEMANTIC_SAMPLE = 50  # fixed value
TAG_EXAMPLES = 10  # fixed value
PAREN_NUMBER = r"^[\d,]+\.?\d*\s*\([\d,]+\.?\d*\)$"
NUMBER_RANGE = r"^\d+-\d+$"


def cells(rows: DataFrame, keys: tuple[str, ...] = FILE_KEYS) -> DataFrame:
    """(keys, row_number, column_index, value) of the non-blank cells of titled rows."""
    return (
        rows.select(*keys, "row_number", F.posexplode("fields").alias("column_index", "value"))
        .where(strip(F.col("value")) != "")
    )


def unpivoted(table: DataFrame, key: str) -> DataFrame:
    """(row_number, column_name, value) of any table's non-blank cells, as text."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
            for c in table.columns
        ]
    )
    return (
        table.select(F.col(key).alias("row_number"), F.explode(pairs).alias("p"))
        .select("row_number", "p.column_name", "p.value")
        .where(strip(F.coalesce(F.col("value"), F.lit(""))) != "")
    )


def value_class(value: Column) -> Column:
    """currency, paren, range, number or other; each value has one class."""
    text = strip(value)
    bare = F.regexp_replace(text, "[, ]", "")
    return (
        F.when(F.contains(text, F.lit("₹")), "currency")
        .when(text.rlike(PAREN_NUMBER), "paren")
        .when(text.rlike(NUMBER_RANGE), "range")
        .when(bare.rlike(NUMBER), "number")
        .otherwise("other")
    )


def file_shape(rows: DataFrame, keys: tuple[str, ...] = FILE_KEYS) -> DataFrame:
    """Row count, widest row and duplicate rows per file."""
    per_row = rows.groupBy(*keys, F.to_json("fields").alias("content")).agg(
        F.count("*").alias("n"), F.max(F.size("fields")).alias("width")
    )
    return per_row.groupBy(*keys).agg(
        F.sum("n").alias("row_count"),
        F.max("width").alias("column_count"),
        (F.sum("n") - F.count("*")).alias("duplicate_rows"),
    )


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys of which some may be null."""
    renamed = right.select(
        *[F.col(k).alias(f"r__{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"r__{k}"))
    return left.join(renamed, condition, how).drop(*[f"r__{k}" for k in keys])


def _value_counts(long: DataFrame, column_keys: list[str]) -> DataFrame:
    """Distinct values per column with their counts and first row."""
    return long.groupBy(*column_keys, "value").agg(
        F.count("*").alias("n"), F.min("row_number").alias("first_row")
    )


def dtype_of(n: Column, counts: dict[str, Column]) -> Column:
    """Type of a column from the number of values in each class."""
    return (
        F.when(n == 0, "unknown")
        .when(counts["currency"] > n * 0.5, "currency")
        .when(counts["paren"] > n * 0.5, "numeric_parenthetical")
        .when(counts["range"] > n * 0.3, "progress_range")
        .when(counts["number"] + counts["paren"] > n * 0.7, "numeric")
        .when((counts["number"] == 0) & (counts["paren"] == 0), "text")
        .otherwise("mixed")
    )


def column_profile(long: DataFrame, column_keys: list[str]) -> DataFrame:
    """Non-null and distinct counts, inferred type and first five distinct samples.

    Values are counted once per column; the samples come from a bounded row number, so a
    column's values are never gathered.
    """
    counted = _value_counts(long, column_keys).withColumn("class", value_class(F.col("value")))
    counts = {k: F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(0)) for k in ("currency", "paren", "range", "number")}
    stats = counted.groupBy(*column_keys).agg(
        F.sum("n").alias("non_null_count"),
        F.count("*").alias("unique_count"),
        dtype_of(F.sum("n"), counts).alias("inferred_dtype"),
    )
    return _null_safe(stats, _samples(counted, column_keys), column_keys)


#: A whole number in the one way of writing it, so that equal texts are equal numbers.
WHOLE_NUMBER = r"^(0|-?[1-9][0-9]{0,17})$"
#: Bits and bytes of one bitmap of Spark, and bytes that a value of its own costs in a shuffle at least.
BITMAP_VALUES, BITMAP_BYTES, VALUE_BYTES = 32768, 4096, 16
#: Rows at the top of a column in which the samples are looked for first.
SAMPLE_ROWS = 1000


def _few_samples(long: DataFrame, column_keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(samples of the columns whose first rows show enough distinct values, keys of the other columns)."""
    order = Window.partitionBy(*column_keys).orderBy("row_number", "value")
    top = long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE_ROWS)
    first = written(_value_counts(top, column_keys), "top-values")
    enough = first.groupBy(*column_keys).agg(F.count("*").alias("distinct"))
    kept = first.join(enough.where(F.col("distinct") >= SAMPLES), column_keys, "left_semi")
    return _samples(kept, column_keys), enough.where(F.col("distinct") < SAMPLES).select(*column_keys)


def _samples(counted: DataFrame, column_keys: list[str]) -> DataFrame:
    """The first distinct values of each column, joined."""
    order = Window.partitionBy(*column_keys).orderBy("first_row", "value")
    return (
        counted.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= SAMPLES)
        .groupBy(*column_keys)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("s"))
        .select(*column_keys, F.array_join(F.transform("s", lambda x: x["value"]), " | ").alias("samples"))
    )


def table_profile(long: DataFrame, column_keys: list[str]) -> DataFrame:
    """``column_profile`` of long tables: whole numbers of dense columns are counted in bitmaps.

    A column of whole numbers that fill their range is one bitmap per 32,768 numbers of the
    range and task, instead of one row per distinct number, so an id column costs an eighth of
    a byte a number in the shuffle. Which columns are dense is seen from count, least and
    greatest number of each; all other values, and columns that are not dense, are counted one
    by one. The result does not depend on the way. Keys must not be null.
    """
    whole = F.when(F.col("value").rlike(WHOLE_NUMBER), F.col("value").try_cast("long"))
    rows = long.withColumn("whole", whole)
    spread = rows.groupBy(*column_keys).agg(F.count("whole").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high"))
    buckets = F.floor(F.col("high") / BITMAP_VALUES) - F.floor(F.col("low") / BITMAP_VALUES) + 2
    # One row per column of the table.
    dense = written(spread.where((F.col("n") > 0) & (buckets * BITMAP_BYTES <= F.col("n") * VALUE_BYTES)).select(*column_keys), "dense-columns")
    marked = rows.join(F.broadcast(dense.withColumn("dense", F.lit(True))), column_keys, "left")
    by_bit = F.col("dense").isNotNull() & F.col("whole").isNotNull()
    bitmaps = (
        marked.where(by_bit)
        .groupBy(*column_keys, F.bitmap_bucket_number("whole").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("whole")).alias("bits"), F.count("*").alias("n"))
        .select(*column_keys, F.lit("number").alias("class"), "n", F.bitmap_count("bits").alias("distinct"))
    )
    counted = _value_counts(marked.where(~by_bit), column_keys).select(
        *column_keys, value_class(F.col("value")).alias("class"), "n", F.lit(1).cast("long").alias("distinct")
    )
    every = bitmaps.unionByName(counted)
    counts = {k: F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(0)) for k in ("currency", "paren", "range", "number")}
    stats = every.groupBy(*column_keys).agg(
        F.sum("n").alias("non_null_count"), F.sum("distinct").alias("unique_count"), dtype_of(F.sum("n"), counts).alias("inferred_dtype")
    )
    early, late = _few_samples(long, column_keys)
    samples = early.unionByName(_samples(_value_counts(long.join(late, column_keys, "left_semi"), column_keys), column_keys))
    return stats.join(samples, column_keys, "left")


COLUMN_KEYS = [*FILE_KEYS, "column_index"]


def file_columns(rows: DataFrame) -> DataFrame:
    """Column profile of titled files, with null counts (blank and short rows count)."""
    shape = file_shape(rows).select(*FILE_KEYS, "row_count")
    positions = rows.select(*FILE_KEYS, F.explode(F.sequence(F.lit(0), F.size("fields") - 1)).alias("column_index")).distinct()
    profile = _null_safe(positions, column_profile(cells(rows), COLUMN_KEYS), COLUMN_KEYS)
    full = _null_safe(profile, shape, list(FILE_KEYS))
    zero = F.lit(0)
    return full.withColumns(
        {
            "non_null_count": F.coalesce("non_null_count", zero),
            "unique_count": F.coalesce("unique_count", zero),
            "inferred_dtype": F.coalesce("inferred_dtype", F.lit("unknown")),
            "samples": F.coalesce("samples", F.lit("")),
        }
    ).withColumn("null_count", F.col("row_count") - F.col("non_null_count")).drop("row_count")


def value_tags(long: DataFrame, column_keys: list[str]) -> DataFrame:
    """Semantic families found in the first 50 non-empty values of each column."""
    order = Window.partitionBy(*column_keys).orderBy("row_number")
    first = long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SEMANTIC_SAMPLE)
    joined = (
        first.groupBy(*column_keys)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("s"))
        .withColumn("sample", F.array_join(F.transform("s", lambda x: x["value"]), " "))
    )
    found = F.filter(
        F.array(
            *[
                F.when(F.col("sample").rlike("(?i)" + pattern), F.lit(tag))
                for tag, pattern in SEMANTIC_FAMILIES.items()
            ]
        ),
        lambda t: t.isNotNull(),
    )
    return joined.select(*column_keys, found.alias("value_tags"))


def positional_tags(title: Column, dataset: Column, position: Column, dtype: Column) -> Column:
    """Tags implied by the report name, the column position and the type."""
    names = F.lower(F.concat_ws(" ", dataset, F.coalesce(title, F.lit(""))))
    dataset_name = F.lower(dataset)

    def named(word: str) -> Column:
        return F.contains(names, F.lit(word))

    tags = F.array(
        F.when(named("state") & (position == 1) & (dtype == "text"), "state"),
        F.when(named("sector") & (position == 1) & (dtype == "text"), "sector"),
        F.when(named("cost") & dtype.isin("currency", "numeric", "numeric_parenthetical"), "cost"),
        F.when(
            (F.contains(dataset_name, F.lit("physical")) | named("progress")) & (dtype == "progress_range"),
            "physical_progress",
        ),
        F.when((position == 2) & (dtype == "numeric"), "project_count"),
        F.when((position == 3) & (dtype == "numeric_parenthetical"), "cost"),
        F.when((position == 3) & (dtype == "numeric_parenthetical"), "original_and_revised_cost"),
        F.when((position == 4) & (dtype == "numeric"), "expenditure"),
    )
    return F.filter(tags, lambda t: t.isNotNull())


def tagged_columns(rows: DataFrame) -> DataFrame:
    """Column profile with all semantic tags as one sorted array."""
    profile = file_columns(rows)
    both = _null_safe(profile, value_tags(cells(rows), COLUMN_KEYS), COLUMN_KEYS)
    by_position = positional_tags(
        F.col("title"), F.col("dataset_type"), F.col("column_index"), F.col("inferred_dtype")
    )
    empty = F.array().cast("array<string>")
    return both.withColumn(
        "semantic_tags",
        F.array_sort(F.array_distinct(F.concat(F.coalesce("value_tags", empty), by_position))),
    ).drop("value_tags")


def id_candidates(tagged: DataFrame) -> DataFrame:
    """Columns tagged as a possible project identifier."""
    return tagged.where(F.array_contains("semantic_tags", "project_id")).select(
        "path", "dataset_type", "report_month", "column_index"
    )


def granularity(rows: DataFrame) -> DataFrame:
    """Aggregate or project-level, with the reason, per file."""
    ranges = (
        column_profile(cells(rows), COLUMN_KEYS)
        .groupBy(*FILE_KEYS)
        .agg(F.max((F.col("inferred_dtype") == "progress_range").cast("int")).alias("has_ranges"))
    )
    shape = _null_safe(file_shape(rows), ranges, list(FILE_KEYS))
    dataset, title = F.lower("dataset_type"), F.lower(F.coalesce("title", F.lit("")))
    n = F.col("row_count")

    def either(word: str) -> Column:
        return F.contains(dataset, F.lit(word)) | F.contains(title, F.lit(word))

    physical = F.contains(dataset, F.lit("physical")) | F.contains(title, F.lit("progress"))
    # The reasons.
    rules = [
        (either("state"), True, F.lit("State-wise aggregation (rows represent states, not individual projects)")),
        (either("sector"), True, F.lit("Sector-wise aggregation (rows represent sectors, not individual projects)")),
        (
            F.contains(dataset, F.lit("cost")) & (n <= 3), True,
            F.lit("Cost-wise summary with very few rows — likely national-level aggregate"),
        ),
        (
            physical & (F.col("has_ranges") == 1), True,
            F.lit("Physical-progress report with progress-range buckets (aggregate histogram)"),
        ),
        (
            (n < 50) & (F.col("column_count") >= 3), True,
            F.concat(F.lit("Low row count ("), n.cast("string"), F.lit(") with structured columns suggests aggregation")),
        ),
        (n > 500, False, F.concat(F.lit("High row count ("), n.cast("string"), F.lit(") suggests project-level data"))),
    ]
    verdict, reason = F.lit(None).cast("boolean"), F.lit("Could not confidently determine granularity")
    for test, value, text in reversed(rules):
        hit = F.coalesce(test, F.lit(False))
        verdict = F.when(hit, F.lit(value)).otherwise(verdict)
        reason = F.when(hit, text).otherwise(reason)
    return shape.select(*FILE_KEYS, "row_count", "column_count", verdict.alias("is_aggregate"), reason.alias("reason"))


def schema_comparison(rows: DataFrame) -> DataFrame:
    """Column-count, type and row-count variation of each dataset over its months."""
    shape = file_shape(rows)
    per_type = shape.groupBy("dataset_type").agg(
        F.countDistinct(F.coalesce("report_month", F.lit("unknown"))).alias("months"),
        F.countDistinct("column_count").alias("column_counts"),
        F.min("row_count").alias("min_rows"),
        F.max("row_count").alias("max_rows"),
    )
    varying = (
        file_columns(rows)
        .groupBy("dataset_type", "column_index")
        .agg(F.countDistinct("inferred_dtype").alias("dtypes"))
        .groupBy("dataset_type")
        .agg(F.count_if(F.col("dtypes") > 1).alias("columns_with_varying_dtype"))
    )
    swing = (F.col("max_rows") - F.col("min_rows")) / F.nullif("max_rows", F.lit(0))
    return per_type.join(varying, "dataset_type").select(
        "dataset_type", "months",
        (F.col("column_counts") > 1).alias("column_count_varies"),
        "columns_with_varying_dtype",
        ((F.col("column_counts") <= 1) & (F.col("columns_with_varying_dtype") == 0)).alias("consistent_columns"),
        "min_rows", "max_rows",
        F.coalesce(swing > 0.3, F.lit(False)).alias("row_count_swings"),
    )


def tag_locations(tagged: DataFrame) -> DataFrame:
    """Up to ten example locations per semantic tag and how many more there are.

    Locations are distinct by dataset and column; the earliest month stands for each.
    """
    found = tagged.select(
        F.explode("semantic_tags").alias("tag"), "dataset_type", "column_index", "report_month"
    )
    places = found.groupBy("tag", "dataset_type", "column_index").agg(
        F.count("*").alias("occurrences"), F.min("report_month").alias("first_month")
    )
    order = Window.partitionBy("tag").orderBy("dataset_type", "column_index")
    ranked = places.withColumn("rank", F.row_number().over(order))
    location = F.concat(
        F.col("dataset_type"), F.lit("["), F.coalesce("first_month", F.lit("None")), F.lit("].col_"),
        F.col("column_index").cast("string"),
    )
    shown = F.col("rank") <= TAG_EXAMPLES
    examples = F.array_sort(F.collect_list(F.when(shown, F.struct("rank", location.alias("at")))))
    return ranked.groupBy("tag").agg(
        F.sum("occurrences").alias("occurrences"),
        F.array_join(F.transform(examples, lambda e: e["at"]), "; ").alias("examples"),
        (F.sum("occurrences") - F.count_if(shown)).alias("more_occurrences"),
    )


def numeric_summary(table: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, maximum, mean, nulls and null % per numeric column, in one pass."""
    row = table.agg(
        F.count("*").alias("n__all"),
        *[
            a
            for c in columns
            for a in (
                F.min(c).cast("double").alias(f"{c}__min"),
                F.max(c).cast("double").alias(f"{c}__max"),
                (F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.nullif(F.count(c), F.lit(0))).alias(f"{c}__mean"),
                F.count(c).alias(f"{c}__known"),
            )
        ],
    )
    nulls = {c: F.col("n__all") - F.col(f"{c}__known") for c in columns}
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.round(f"{c}__min", 2).alias("min_value"),
                F.round(f"{c}__max", 2).alias("max_value"),
                F.round(f"{c}__mean", 4).alias("mean_value"),
                nulls[c].alias("nulls"),
                F.round(nulls[c] * 100 / F.nullif("n__all", F.lit(0)), 6).alias("null_pct"),
            )
            for c in columns
        ]
    )
    return row.select(F.explode(rows).alias("r")).select("r.*")


def duplicate_rows(table: DataFrame, ignore: tuple[str, ...] = ("source_file", "source_type")) -> DataFrame:
    """Rows repeating an earlier row when provenance columns are left out."""
    keys = [c for c in table.columns if c not in ignore]
    return (
        table.groupBy(*keys).agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    )


def dataset_summary(table: DataFrame, month: str) -> DataFrame:
    """Rows and duplicate rows per month, with the column count."""
    counted = table.groupBy(*table.columns).agg(F.count("*").alias("n__rows"))
    return counted.groupBy(month).agg(
        F.sum("n__rows").alias("rows"),
        F.sum(F.col("n__rows") - 1).alias("duplicate_rows"),
        F.lit(len(table.columns)).alias("column_count"),
    )
