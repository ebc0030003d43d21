"""Latest-period portfolio view, signals, filters, rankings and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.months import month_text
from ..functions.numbers import js_round, js_round_to
from ..functions.text import search_text
from ..sources.panel import traceable

LEVELS = ("Low", "Medium", "High", "Critical")  # fixed values, in rank order
SEARCH_FIELDS = ("name", "code", "agency", "ministry", "sector", "state")

SNAPSHOT_COLUMNS = (
    "project_id", "name", "code", "ministry", "agency", "sector", "state", "month_number", "month",
    "physical_progress", "expenditure", "original_cost", "revised_cost",
    "original_completion", "revised_completion", "delay_months", "risk_score", "risk_level", "risk_signal",
)


def risk_level(score: Column) -> Column:
    """Level of a 0-100 risk score."""
    return (
        F.when(score >= 85, "Critical").when(score >= 65, "High").when(score >= 40, "Medium").otherwise("Low")
    )


def level_rank(level: Column) -> Column:
    """0 for Low up to 3 for Critical."""
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level).cast("int") - 1


def snapshots_from_panel(panel: DataFrame) -> DataFrame:
    """Monthly snapshot series of a typed panel.

    The risk score is a bounded sum of unfinished progress, cost growth and delay; the
    signal names its largest part. Rows need a reported progress.
    """
    delay = F.greatest(F.col("effective_end") - F.col("original_end"), F.lit(0))
    growth = F.when(
        F.col("original_cost") > 0, F.col("effective_cost") / F.col("original_cost") - 1
    ).otherwise(F.lit(0.0))
    unfinished = (100 - F.col("physical_progress")) * 0.35
    cost_points = F.least(growth * 40, F.lit(40.0))
    delay_points = F.least(delay * 2.5, F.lit(40.0))
    score = F.least(js_round(unfinished + cost_points + delay_points), F.lit(100)).cast("int")
    signal = (
        F.when((cost_points >= unfinished) & (cost_points >= delay_points), "Cost escalation")
        .when(delay_points >= unfinished, "Schedule delay")
        .when(F.col("sl_no") % 3 == 0, "Land acquisition pending")
        .otherwise("Slow physical progress")
    )
    return (
        traceable(panel)
        .where(F.col("physical_progress").isNotNull())
        .withColumns({"delay_months": delay.cast("int"), "risk_score": score})
        .select(
            F.col("identity_key").alias("project_id"),
            F.col("project_name").alias("name"),
            F.coalesce("project_code", "legacy_ocms_code").alias("code"),
            "ministry", "agency", "sector", "state", "month_number",
            F.col("report_month").alias("month"),
            "physical_progress", "expenditure", "original_cost",
            F.col("effective_cost").alias("revised_cost"),
            month_text(F.col("original_end")).alias("original_completion"),
            month_text(F.col("effective_end")).alias("revised_completion"),
            "delay_months", "risk_score",
            risk_level(F.col("risk_score")).alias("risk_level"),
            signal.alias("risk_signal"),
        )
    )


PAIRED = (
    "physical_progress", "revised_cost", "delay_months", "revised_completion", "risk_score", "risk_level",
)


def latest_pairs(snapshots: DataFrame) -> DataFrame:
    """Each entity's latest snapshot with its previous one as ``previous_*`` columns.

    The two newest rows per entity are picked by a bounded row number, which Spark cuts
    per task before the shuffle.
    """
    newest = Window.partitionBy("project_id").orderBy(F.desc("month_number"))
    two = snapshots.withColumn("newest", F.row_number().over(newest)).where(F.col("newest") <= 2)
    return (
        two.withColumns({f"previous_{c}": F.lead(c).over(newest) for c in PAIRED})
        .where(F.col("newest") == 1)
        .drop("newest")
    )


def trend_of(change: Column) -> Column:
    """up, down or stable from a risk change in points."""
    return F.when(change > 2, "up").when(change < -2, "down").otherwise("stable")


def latest_view(snapshots: DataFrame) -> DataFrame:
    """One row per entity: the latest values, risk change and trend."""
    change = F.coalesce(F.col("risk_score") - F.col("previous_risk_score"), F.lit(0))
    return latest_pairs(snapshots).withColumns({"risk_change": change, "trend": trend_of(change)}).select(
        "project_id", "name", "code", "ministry", "agency", "sector", "state",
        F.col("physical_progress").alias("progress"), "expenditure", "original_cost", "revised_cost",
        "delay_months", F.col("risk_level").alias("risk"), "risk_score", "risk_change",
        F.col("risk_signal").alias("primary_signal"), "trend", F.col("month").alias("last_updated"),
    )


def cost_growth() -> Column:
    """Revised over original cost, minus one."""
    return F.when(F.col("original_cost") > 0, F.col("revised_cost") / F.col("original_cost") - 1)


def cost_signal() -> Column:
    """escalated above 15%, watch above 5%, else within."""
    growth = cost_growth()
    return F.when(growth > 0.15, "escalated").when(growth > 0.05, "watch").otherwise("within")


def schedule_signal() -> Column:
    """delayed above 6 months, watch above 2, else on_plan."""
    delay = F.col("delay_months")
    return F.when(delay > 6, "delayed").when(delay > 2, "watch").otherwise("on_plan")


def cost_signal_label() -> Column:
    """'+n%' above 10%, else 'Within plan'."""
    pct = js_round(cost_growth() * 100)
    return F.when(pct > 10, F.concat(F.lit("+"), pct.cast("string"), F.lit("%"))).otherwise("Within plan")


def schedule_signal_label() -> Column:
    """'n mo.', or 'On plan' without delay."""
    delay = F.col("delay_months")
    return F.when(delay != 0, F.concat(delay.cast("string"), F.lit(" mo."))).otherwise("On plan")


def attention_priority() -> Column:
    """Weighted attention score of the latest view."""
    growth = F.greatest(cost_growth(), F.lit(0.0))
    cost = F.when(growth > 0.15, 18).when(growth > 0.05, 8).otherwise(0)
    schedule = F.least(F.col("delay_months") * 1.8, F.lit(22.0))
    change = F.greatest(F.col("risk_change"), F.lit(0)) * 1.6
    progress = F.greatest((55 - F.col("progress")) * 0.25, F.lit(0.0))
    level = (
        F.when(F.col("risk") == "Critical", 28).when(F.col("risk") == "High", 18)
        .when(F.col("risk") == "Medium", 8).otherwise(0)
    )
    return js_round(F.col("risk_score") * 0.35 + change + cost + schedule + progress + level)


def primary_signal_kind() -> Column:
    """Kind of the primary signal by keyword."""
    text = F.lower("primary_signal")

    def mentions(*words: str) -> Column:
        test = F.lit(False)
        for word in words:
            test = test | F.contains(text, F.lit(word))
        return test

    return (
        F.when(mentions("cost"), "Cost")
        .when(mentions("schedule", "delay"), "Schedule")
        .when(mentions("progress"), "Progress")
        .when(mentions("land", "contractor", "utility"), "Delivery")
        .otherwise("Baseline")
    )


def with_signals(view: DataFrame) -> DataFrame:
    """Add signals, labels, signal kind and attention priority."""
    return view.withColumns(
        {
            "cost_signal": cost_signal(),
            "schedule_signal": schedule_signal(),
            "cost_signal_label": cost_signal_label(),
            "schedule_signal_label": schedule_signal_label(),
            "attention_priority": attention_priority(),
            "primary_signal_kind": primary_signal_kind(),
        }
    )


def ranked_by_attention(view: DataFrame, top: int) -> DataFrame:
    """Entities with the highest attention priority (top-k)."""
    return (
        view.withColumn("attention_priority", attention_priority())
        .orderBy(F.desc("attention_priority"), "project_id")
        .limit(top)
    )


def search(view: DataFrame, query: str) -> DataFrame:
    """Entities whose searchable text contains the query; a blank query keeps all."""
    wanted = query.strip().lower()
    if not wanted:
        return view
    return view.where(F.contains(search_text(*[F.col(c) for c in SEARCH_FIELDS]), F.lit(wanted)))


def search_top(view: DataFrame, query: str, top: int = 8) -> DataFrame:
    """First matches in code order (top-k)."""
    return search(view, query).orderBy("code", "project_id").limit(top)


def portfolio_filter(
    view: DataFrame,
    *,
    query: str = "",
    state: str | None = None,
    risk: str | None = None,
    ministry: str | None = None,
    sector: str | None = None,
    progress: str | None = None,
    cost: str | None = None,
    schedule: str | None = None,
    trend: str | None = None,
) -> DataFrame:
    """Entities meeting every given condition; None leaves a condition out.

    ``progress`` is '<40%', '40–70%' or '>70%'; ``cost`` and ``schedule`` are signal names.
    """
    rows = search(view, query)
    for column, wanted in (("state", state), ("risk", risk), ("ministry", ministry), ("sector", sector), ("trend", trend)):
        if wanted is not None:
            rows = rows.where(F.col(column) == wanted)
    done = F.col("progress")
    bands = {"<40%": done < 40, "40–70%": done.between(40, 70), ">70%": done > 70}
    if progress is not None:
        rows = rows.where(bands[progress])
    if cost is not None:
        rows = rows.where(cost_signal() == cost)
    if schedule is not None:
        rows = rows.where(schedule_signal() == schedule)
    return rows


def by_code(view: DataFrame, code: str) -> DataFrame:
    """Lookup by exact code, or by the code with '/' written as '-'."""
    return view.where((F.col("code") == code) | (F.replace(F.col("code"), F.lit("/"), F.lit("-")) == code))


def attention_projects(view: DataFrame) -> DataFrame:
    """Entities at High or Critical risk."""
    return view.where(F.col("risk").isin("High", "Critical"))


def watchlist(view: DataFrame, watched: DataFrame) -> DataFrame:
    """Entities on a watchlist of project ids."""
    return view.join(watched.select("project_id"), "project_id", "left_semi")


def cross_filter(view: DataFrame, chosen: DataFrame) -> DataFrame:
    """Entities of a chosen anomaly or sector, by project id."""
    return view.join(chosen.select("project_id"), "project_id", "left_semi")


def risk_counts(view: DataFrame) -> DataFrame:
    """Count and share of each risk level, levels without entities included."""
    total = F.count("*")
    wide = view.agg(total.alias("n"), *[F.count_if(F.col("risk") == x).alias(x) for x in LEVELS])
    rows = F.array(
        *[
            F.struct(
                F.lit(x).alias("risk"), F.col(x).alias("projects"),
                F.when(F.col("n") > 0, js_round(F.col(x) / F.col("n") * 100)).alias("share_pct"),
            )
            for x in LEVELS
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def state_risk(view: DataFrame) -> DataFrame:
    """Worst level, counts and rounded means per state."""
    worst = F.max(level_rank(F.col("risk")))
    levels = F.array(*[F.lit(x) for x in LEVELS])
    return view.groupBy("state").agg(
        F.element_at(levels, worst + 1).alias("level"),
        F.count("*").alias("projects"),
        F.count_if(F.col("risk").isin("High", "Critical")).alias("high_risk"),
        js_round(F.avg("risk_score")).alias("risk_index"),
        js_round(F.avg("risk_change")).alias("change_vs_previous"),
        js_round(F.avg("progress")).alias("average_progress"),
    )


def risk_landscape(view: DataFrame, labelled_states: list[str]) -> DataFrame:
    """State points (risk, change, size) with a label flag."""
    return state_risk(view).select(
        "state", "level",
        F.col("risk_index").alias("x"), F.col("change_vs_previous").alias("y"), F.col("projects").alias("z"),
        F.col("state").isin(*labelled_states).alias("labeled"),
    )


def national_trend(snapshots: DataFrame, months: int = 6) -> DataFrame:
    """Cost escalation and delayed entities of the latest months (top-k months)."""
    monthly = snapshots.groupBy("month").agg(
        F.sum(F.col("revised_cost").cast("decimal(18,2)")).cast("double").alias("revised"),
        F.sum(F.col("original_cost").cast("decimal(18,2)")).cast("double").alias("original"),
        F.count_if(F.col("delay_months") > 2).alias("delay"),
    )
    escalation = F.when(
        F.col("original") != 0, js_round_to((F.col("revised") / F.col("original") - 1) * 100, 1)
    ).otherwise(F.lit(0.0))
    return (
        monthly.select("month", escalation.alias("escalation"), "delay")
        .orderBy(F.desc("month"))
        .limit(months)
    )


def sector_performance(view: DataFrame) -> DataFrame:
    """Rounded mean progress, risk, delay and health per sector."""
    means = view.groupBy(F.col("sector").alias("name")).agg(
        js_round(F.avg("progress")).alias("progress"),
        js_round(F.avg("risk_score")).alias("risk"),
        js_round_to(F.avg("delay_months"), 1).alias("delay"),
    )
    return means.withColumn("health", js_round((F.col("progress") + (100 - F.col("risk"))) / 2))


def risk_concentration(view: DataFrame) -> DataFrame:
    """Sectors by mean risk, highest first."""
    return sector_performance(view).select("name", F.col("risk").alias("value")).orderBy(
        F.desc("value"), "name"
    )


# Histogram labels and upper bounds (exclusive).
COST_BUCKETS = (("0–5%", 5), ("5–10%", 10), ("10–20%", 20), ("20–40%", 40), ("40%+", None))
DELAY_BUCKETS = (
    ("On schedule", 0), ("< 3 months", 3), ("3–6 months", 6), ("6–12 months", 12), ("12+ months", None),
)


def _histogram(view: DataFrame, bucket: Column, labels: list[str]) -> DataFrame:
    wide = view.select(bucket.alias("bucket")).agg(
        *[F.count_if(F.col("bucket") == i).alias(f"b{i}") for i in range(len(labels))]
    )
    rows = F.array(
        *[
            F.struct(F.lit(i + 1).alias("position"), F.lit(x).alias("label"), F.col(f"b{i}").alias("projects"))
            for i, x in enumerate(labels)
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def cost_histogram(view: DataFrame) -> DataFrame:
    """Entities per cost-growth bucket, empty buckets included."""
    pct = cost_growth() * 100
    bucket = F.when(pct < 5, 0).when(pct < 10, 1).when(pct < 20, 2).when(pct < 40, 3).otherwise(4)
    return _histogram(view, bucket, [x for x, _ in COST_BUCKETS])


def delay_histogram(view: DataFrame) -> DataFrame:
    """Entities per delay bucket, empty buckets included."""
    delay = F.col("delay_months")
    bucket = F.when(delay <= 0, 0).when(delay < 3, 1).when(delay < 6, 2).when(delay < 12, 3).otherwise(4)
    return _histogram(view, bucket, [x for x, _ in DELAY_BUCKETS])


def spend_share() -> Column:
    """Expenditure as a share of the revised cost."""
    return F.when(F.col("revised_cost") != 0, F.col("expenditure") / F.col("revised_cost"))


def health_components(view: DataFrame) -> DataFrame:
    """Schedule, cost and progress health and expenditure efficiency, one row."""
    n = F.nullif(F.count("*"), F.lit(0))
    efficiency = F.least(
        F.lit(100.0), F.col("progress") / F.greatest(F.lit(1.0), spend_share() * 100) * 100
    )
    return view.agg(
        js_round(F.count_if(schedule_signal() == "on_plan") / n * 100).alias("schedule_health"),
        js_round(F.count_if(cost_signal() == "within") / n * 100).alias("cost_health"),
        js_round(F.avg("progress")).alias("progress_health"),
        F.least(F.lit(100), js_round(F.avg(efficiency))).alias("expenditure_efficiency"),
    )


def matrix_points(view: DataFrame) -> DataFrame:
    """Scatter coordinates per entity: spend, progress, cost growth, delay and risk change."""
    return view.select(
        "project_id", "sector",
        js_round(spend_share() * 100).alias("spend"),
        F.col("progress"),
        js_round(cost_growth() * 100).alias("cost_escalation"),
        F.col("delay_months").alias("delay"),
        F.col("risk_score"), F.col("risk_change").alias("change"),
    )


def quadrant_counts(view: DataFrame) -> DataFrame:
    """Entities with high spend and low progress, and the opposite, one row."""
    points = matrix_points(view)
    spend, progress = F.col("spend"), F.col("progress")
    return points.agg(
        F.count_if((spend > 65) & (progress < 60)).alias("high_spend_low_progress"),
        F.count_if((spend <= 65) & (progress >= 60)).alias("low_spend_high_progress"),
    )


def report_lines(
    view: DataFrame, title: str, period: str, *, high_risk_only: bool = False, **scope: str
) -> DataFrame:
    """A scoped report: header lines, then one tab-separated line per entity.

    ``scope`` may name state, ministry, sector and risk. Lines carry their position, so
    the text sink can keep header and body apart.
    """
    rows = view
    for column, wanted in scope.items():
        if not (high_risk_only and column == "risk"):
            rows = rows.where(F.col(column) == wanted)
    if high_risk_only:
        rows = attention_projects(rows)
    wanted = " · ".join(scope.get(c, "All") for c in ("state", "ministry", "sector", "risk"))
    body = rows.select(
        F.lit(1).alias("section"), F.col("code").alias("sort_key"),
        F.concat_ws(
            "\t", "code", "name", "state", "risk", F.col("risk_score").cast("string"), "primary_signal"
        ).alias("line"),
    )
    count = F.concat(F.lit("Records: "), F.count("*").cast("string"))
    header = rows.agg(
        F.array(
            F.lit(title), F.lit(f"Period: {period}"), F.lit(f"Scope: {wanted}"), count, F.lit("")
        ).alias("lines")
    ).select(
        F.lit(0).alias("section"), F.posexplode("lines").alias("position", "line")
    ).select("section", F.col("position").cast("string").alias("sort_key"), "line")
    return header.unionByName(body)
