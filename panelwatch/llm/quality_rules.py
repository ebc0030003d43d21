"""Quality rules: a table of thresholds compiled into one projection.

Everything is computed inside the row, so nothing is shuffled and a document never meets
another one. Only built-in expressions are used.

Defined cases: a null text has no words and no lines with words, so its base check fails;
an empty text likewise. Repeated rows are judged one by one. A text of one very long line
is a text of one line. Extra columns of the input are not read by ``judged`` and pass
through ``kept_documents`` untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this",
    "to", "was", "with",
    "als", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "ist", "mit", "nicht", "sich", "und",
    "von", "zu",
    "al", "con", "de", "del", "el", "la", "las", "los", "no", "para", "por", "que", "se", "su", "un", "una", "y",
    "au", "ce", "dans", "du", "en", "est", "et", "il", "la", "le", "les", "ne", "par", "pas", "pour", "qui", "sur", "une",
)


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high`` for documents of at least ``from_words`` words."""

    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = MIN_WORDS


#: The thresholds. A bound that is None does not apply.
RULES = (
    Rule("mean_word_length", low=2.0, high=20.0),
    Rule("symbols_per_word", high=0.25),
    Rule("shouts_per_word", high=0.5),
    Rule("stop_word_ratio", low=0.02, from_words=50),
    Rule("dup_line_ratio", high=0.4),
    Rule("bullet_line_ratio", high=0.9, from_words=50),
    Rule("ellipsis_line_ratio", high=0.5, from_words=50),
)


def _window_hashes(hashes: Column) -> Column:
    """Hash of every window of ``WINDOW`` words, from the hashes of its words."""
    starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
    return F.when(
        F.size(hashes) >= WINDOW,
        F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: sort them, join the stretches."""
    ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        def equal(k: Column, e: Column) -> Column:
            return F.coalesce(F.get(s, k)["x"] == e["x"], F.lit(False))

        marked = F.transform(
            s, lambda e, k: F.struct(e["i"].alias("i"), (equal(k - 1, e) | equal(k + 1, e)).alias("again"))
        )
        return F.sort_array(F.transform(F.filter(marked, lambda e: e["again"]), lambda e: e["i"]))

    def length(starts: Column) -> Column:
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, i: F.struct(
                (i + WINDOW).cast("int").alias("end"),
                (a["n"] + i + WINDOW - F.greatest(a["end"], i)).cast("int").alias("n"),
            ),
            lambda a: a["n"],
        )

    return let(let(ordered, repeated), length)


def _with_counts(frame: DataFrame) -> DataFrame:
    """Add ``_c``, all counts of ``_text`` as one struct, step by step.

    Each step is a projection of its own whose columns are used more than once, so that the
    words are split and hashed once.
    """
    whole = F.col("_text")
    has_word = r"[^\x20\x09-\x0D]"

    def symbols(pattern: str) -> Column:
        return F.length(whole) - F.length(F.regexp_replace(whole, pattern, ""))

    def some(rows: Column, pattern: str) -> Column:
        return F.size(F.filter(rows, lambda x: x.rlike(pattern)))

    return (
        frame.withColumn("_text", F.coalesce("_text", F.lit("")))
        .withColumns(
            {
                "_words": words(whole),
                "_lines": F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(has_word)),
            }
        )
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_windows", _window_hashes(F.col("_hashes")))
        .withColumn(
            "_repeats",
            F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), 0).otherwise(
                _covered(F.col("_windows"))
            ),
        )
        .withColumn(
            "_c",
            F.struct(
                F.size("_words").cast("long").alias("n_words"),
                F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
                symbols(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
                (F.length(whole) - F.length(F.replace(whole, F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
                F.size("_lines").cast("long").alias("n_lines"),
                (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                F.col("_repeats").cast("long").alias("n_repeat_words"),
                F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
                some(F.col("_lines"), r"^ *[-*•·]").cast("long").alias("n_bullets"),
                some(F.col("_lines"), r"(\.\.\.|…) *$").cast("long").alias("n_ellipses"),
            ),
        )
    )


#: metric -> (numerator, denominator) among the counts
RATIOS = {
    "mean_word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "shouts_per_word": ("n_shouts", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "bullet_line_ratio": ("n_bullets", "n_lines"),
    "ellipsis_line_ratio": ("n_ellipses", "n_lines"),
}


def _passes(counts: Column, rules: tuple[Rule, ...]) -> Column:
    """The table as one condition, without division: low * denominator <= numerator."""
    verdict = F.lit(True)
    for rule in rules:
        top, bottom = (counts[name] for name in RATIOS[rule.metric])
        within = F.lit(True)
        if rule.low is not None:
            within = within & (top >= bottom * F.lit(float(rule.low)))
        if rule.high is not None:
            within = within & (top <= bottom * F.lit(float(rule.high)))
        verdict = verdict & (within | (counts["n_words"] < rule.from_words))
    return verdict


def _judged(frame: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to a frame that has ``_text``."""
    counted = _with_counts(frame)
    c = F.col("_c")
    failed = (c["n_words"] < MIN_WORDS) | (c["n_repeat_words"] * 100 > c["n_words"] * MAX_REPEAT_PERCENT)
    return counted.withColumn("_failed", failed).withColumn("_kept", ~F.col("_failed") & _passes(c, rules))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its id, the counts, ``base_failed`` and ``kept``.

    The row leaves as an array of one struct, so that a caller's filter on ``kept`` stays above
    the projections instead of being unfolded into them.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    frame = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    row = F.struct(
        F.col("_id").alias(id_col),
        *[F.col("_c")[name].alias(name) for name in names],
        F.col("_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
    )
    return _judged(frame, rules).select(F.inline(F.array(row)))


def kept_documents(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass every rule, with all their columns.

    A filter on the verdict would be moved below the projections, with the words split anew for
    each mention; a row that fails is an empty array instead.
    """
    frame = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))
    row = F.array("_row")
    return _judged(frame, rules).select(F.inline(F.when(F.col("_kept"), row).otherwise(F.slice(row, 1, 0))))
