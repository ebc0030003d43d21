"""Mixing sources to target weights by entropy balancing.

Every source has a number of words to take. Among all document rates r between 0 and ``CAP``
that meet it, the one closest to "each document once" in relative entropy, with the document's
words as its covariate, is r = min(CAP, exp(lambda * words / mean words)), one lambda per
source. The convex dual is solved by Newton steps for all sources at once; each step is one
aggregate over the table of (source, size, documents), and a bracket turns a step that does not
help into a bisection. Sums are decimal, so they do not depend on the order of the rows, and
reruns agree to the last digit.

Rates become copies by one running remainder per source over sizes, largest first, so the words
taken miss the target by half the largest document at most; a last correction changes one copy
in at most one size of each power of two, where that lowers the miss. Inside a size, the
documents that get the extra copy are the first by hash, ranked in nested blocks, so a group
of copies of any size is not ranked in one task.

Defined cases: a null or empty text has size 0, rate 1, takes 0 words. A null source is a source
of its own, last in order. Rows that repeat an id, a text and a source are treated alike. With
no words at all every target is 0. Only id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.prefix import running_totals
from ..session import discard, written
from .common import same, text_key, words

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
TOLERANCE = 1e-9
#: A bracketed step halves the error or the bracket; doubles are exhausted long before this.
STEPS = 400


def _source_key(source: Column) -> Column:
    """Sources in code point order, null last, without nulls."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc, row_key, source, size, rows): the distinct rows with their sizes in words."""
    rows = docs.select(
        F.col(id_col).alias("doc"),
        text_key(F.col(text_col)).alias("row_key"),
        _source_key(F.col(source_col)).alias("source"),
        F.size(words(F.col(text_col))).cast("long").alias("size"),
    )
    return rows.groupBy("doc", "row_key", "source", "size").agg(F.count("*").alias("rows"))


def targets(
    per_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """Add ``target``: words shared by weight, none above ``cap`` times its source.

    ``per_source`` has (source, source_size). What a full source cannot take goes to the others
    by weight until none is above.
    """
    ranked = running_totals(
        per_source.withColumns(
            {"one": F.lit(1), "b1": F.substring("source", 1, 2), "b2": F.substring("source", 1, 6)}
        ),
        [], ["b1", "b2"], ["source"], ["one"],
    )
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("one_before") % len(weights) + 1).cast("int")
    )
    sources = written(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    full = F.col("source_size") * F.lit(float(cap))
    level, seen = None, -1
    while True:
        is_full = F.lit(False) if level is None else full < F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(is_full, F.col("source_size"))).alias("full"),
            F.count(F.when(is_full, 1)).alias("n"),
            F.sum(F.when(~is_full, F.col("weight"))).alias("weight"),
        ).first()
        if row["n"] == seen or not row["weight"]:
            break
        level = (share * (row["all"] or 0) - cap * (row["full"] or 0)) / row["weight"]
        seen = row["n"]
    return sources.select(
        "source", "source_size", F.least(full, F.col("weight") * F.lit(float(level or 0.0))).alias("target")
    )


def _rate(cap: float) -> Column:
    return F.when(F.col("full"), F.lit(cap)).otherwise(F.least(F.lit(cap), F.exp(F.col("lam") * F.col("z"))))


def solve(histogram: DataFrame, goals: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, lam, mean, full, target): the tilt of every source.

    ``histogram`` has (source, size, n) of documents with words, ``goals`` (source, target).
    """
    per_source = histogram.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("total"), F.sum("n").alias("docs"), F.min("size").alias("least")
    )
    mean = F.col("total") / F.col("docs")
    ratio = F.log(F.greatest(F.col("target"), F.lit(1e-300)) / F.col("total"))
    smallest = F.col("least") / F.col("mean")
    begin = (
        per_source.join(goals.select("source", "target"), "source")
        .withColumn("mean", mean)
        .withColumns(
            {
                "full": F.col("target") >= F.col("total") * F.lit(cap * (1 - 1e-12)),
                "lo": F.when(ratio < 0, ratio / smallest).otherwise(0.0),
                "hi": F.when(ratio < 0, 0.0).otherwise(F.log(F.lit(cap)) / smallest),
            }
        )
        .withColumns(
            {
                "lam": F.least(F.greatest(ratio, "lo"), "hi"),
                "miss": F.lit(None).cast("double"),
                "done": F.col("full"),
            }
        )
        .select("source", "target", "mean", "full", "lo", "hi", "lam", "miss", "done")
    )
    state = written(begin, "tilts")
    exact = "decimal(38,6)"
    for _ in range(STEPS):
        if not state.where(~F.col("done")).take(1):
            return state.select("source", "lam", "mean", "full", "target")
        tilted = (
            histogram.join(state, "source")
            .withColumn("z", F.col("size") / F.col("mean"))
            .withColumn("r", _rate(cap))
            .withColumn("w", F.col("size") * F.col("n") * F.col("r"))
        )
        sums = tilted.groupBy("source").agg(
            F.sum(F.col("w").cast(exact)).cast("double").alias("taken"),
            F.sum(F.when(F.col("r") < cap, F.col("w") * F.col("z")).otherwise(0.0).cast(exact)).cast("double").alias("slope"),
        )
        f = F.col("taken") - F.col("target")
        newton = F.col("lam") - f / F.col("slope")
        helped = F.col("miss").isNull() | (F.abs(f) <= F.col("miss") / 2)
        inside = (F.col("slope") > 0) & (newton > F.col("lo2")) & (newton < F.col("hi2")) & helped
        closed = (F.abs(f) <= F.col("target") * TOLERANCE) | (
            F.col("hi2") - F.col("lo2") <= F.lit(1e-15) * F.greatest(F.lit(1.0), F.abs("lam"))
        )
        step = (
            state.join(sums, "source")
            .withColumns(
                {
                    "lo2": F.when(f <= 0, F.col("lam")).otherwise(F.col("lo")),
                    "hi2": F.when(f > 0, F.col("lam")).otherwise(F.col("hi")),
                }
            )
            .withColumn("stop", F.col("done") | closed)
            .select(
                "source", "target", "mean", "full",
                F.col("lo2").alias("lo"),
                F.col("hi2").alias("hi"),
                F.when(F.col("stop"), F.col("lam"))
                .when(inside, newton)
                .otherwise((F.col("lo2") + F.col("hi2")) / 2)
                .alias("lam"),
                F.abs(f).alias("miss"),
                F.col("stop").alias("done"),
            )
        )
        following = written(step, "tilts")
        discard(state)
        state = following
    raise RuntimeError("the tilts of some sources did not settle")


def rounded(histogram: DataFrame, tilts: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, size, base, extra): ``base`` copies each, and one more for ``extra`` documents."""
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    cells = (
        histogram.join(tilts, "source")
        .withColumn("z", F.col("size") / F.col("mean"))
        .withColumn("r", _rate(cap))
        .withColumn("base", F.floor("r").cast("long"))
        .withColumn("upto", F.sum((F.col("r") - F.col("base")) * F.col("n")).over(down))
        .withColumn("here", F.floor(F.col("upto") + 0.5))
        .withColumn("extra", F.col("here") - F.coalesce(F.lag("here").over(down), F.lit(0)))
        .withColumn("extra", F.least(F.greatest("extra", F.lit(0)), "n"))
        .select("source", "size", "n", "base", "extra", "target")
    )
    missing = cells.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("size") * (F.col("base") * F.col("n") + F.col("extra")))).alias("missing")
    )
    # At most one size for each power of two and direction may change, so the list is short.
    band = F.floor(F.log2("size"))
    listed = (
        cells.groupBy("source", band.alias("band"))
        .agg(
            F.max(F.when((F.col("extra") < F.col("n")) & (F.col("base") < cap), F.col("size"))).alias("more"),
            F.max(F.when(F.col("extra") > 0, F.col("size"))).alias("fewer"),
        )
        .groupBy("source")
        .agg(
            F.sort_array(F.collect_list("more"), asc=False).alias("more"),
            F.sort_array(F.collect_list("fewer"), asc=False).alias("fewer"),
        )
        .join(missing, "source")
    )

    def greedy(sizes: Column, amount: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.aggregate(
            sizes,
            F.struct(amount.cast("double").alias("left"), none.alias("picked")),
            lambda a, x: F.when(
                F.abs(a["left"] - x) < a["left"],
                F.struct((a["left"] - x).cast("double").alias("left"), F.concat(a["picked"], F.array(x)).alias("picked")),
            ).otherwise(a),
            lambda a: a["picked"],
        )

    short = F.col("missing") > 0
    changes = listed.select(
        "source",
        F.when(short, 1).otherwise(-1).cast("long").alias("change"),
        F.explode(
            F.when(short, greedy(F.col("more"), F.col("missing"))).otherwise(greedy(F.col("fewer"), -F.col("missing")))
        ).alias("size"),
    )
    return cells.join(changes, ["source", "size"], "left").select(
        "source", "size", "base", (F.col("extra") + F.coalesce("change", F.lit(0))).alias("extra")
    )


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(doc, row_key, source, size, rows, source_size, target, copies) per distinct row."""
    rows = written(sized(docs, id_col, text_col, source_col), "sizes")
    histogram = written(
        rows.groupBy("source", "size").agg(F.sum("rows").alias("n")), "size-counts"
    )
    goals = written(
        targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "targets"
    )
    with_words = histogram.where("size > 0")
    cells = written(rounded(with_words, solve(with_words, goals)), "cells")
    hashed = rows.join(cells, ["source", "size"], "left").withColumn("mix", F.xxhash64("doc", "row_key", "source"))
    split = (F.col("extra") > 0) & (F.col("size") > 0)
    ranked = running_totals(
        hashed.where(split).withColumns(
            {"b1": F.shiftright("mix", 58), "b2": F.shiftright("mix", 52)}
        ),
        ["source", "size"], ["b1", "b2"], ["mix", "doc", "row_key"], ["rows"],
    )
    columns = ["doc", "row_key", "source", "size", "rows"]
    with_rank = ranked.select(
        *columns, (F.col("base") + (F.col("rows_before") < F.col("extra")).cast("long")).alias("copies")
    )
    plain = hashed.where(~F.coalesce(split, F.lit(False))).select(*columns, F.coalesce("base", F.lit(1)).alias("copies"))
    return with_rank.unionByName(plain).join(goals, "source")


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document row: size, size and target of its source, words taken, copies."""
    return mixed(docs, id_col, text_col, source_col).select(
        F.col("doc").alias(id_col),
        "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
        F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_row"),
    ).drop("_row")


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes, with all their columns and how often it takes them.

    Adds size, source_size, target, taken and copies; a column of the documents by one of these
    names is replaced.
    """
    added = ["size", "source_size", "target", "taken", "copies"]
    mix = mixed(docs, id_col, text_col, source_col).where("copies > 0").select(
        "doc", "row_key", F.col("source").alias("source_key"),
        F.struct("size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies").alias("_mix"),
    )
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    rows = docs.select(
        F.struct(*kept).alias("_row"),
        F.col(id_col).alias("_id"),
        text_key(F.col(text_col)).alias("_key"),
        _source_key(F.col(source_col)).alias("_source"),
    )
    met = same(F.col("_id"), F.col("doc")) & (F.col("_key") == F.col("row_key")) & (F.col("_source") == F.col("source_key"))
    return rows.join(mix, met).select("_row.*", "_mix.*")
