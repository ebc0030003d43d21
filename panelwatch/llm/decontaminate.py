"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of 13 words (a shorter item is one window). A document holds a
window only if it holds every word of it, so one word is a sufficient prefix: the one that is
rarest over all documents. Document words are joined with these prefix words; a candidate must
leave room for the window before and behind (positional and length bounds), and the words of
the document at that place are then verified against the window by the SHA-256 that names it.
The words of a document are matched where it is scanned, so texts are not shuffled; windows are
broadcast in blocks of ``BLOCK`` rows at most, of a hash, a digest and two numbers each, so that
the size of a block does not depend on how long words are.

Defined cases: null and empty texts have no words, hit nothing and match nothing; they are
never contaminated. Items without words have no windows. A null item id causes hits but is not
listed. Rows that repeat an item id are one item. Rows that repeat a document id are judged
one by one, by their own text. Only id and text columns are read.
"""

from __future__ import annotations

import string
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written
from .common import same, text_key

WINDOW = 13
#: Contaminated when hit words are at least one in so many.
SHARE = 20
#: Rows in one broadcast: 200,000 take some 40 MB, however long the words are.
BLOCK = 200_000

#: Fixed value: ASCII characters that are not part of a word, once A-Z are lower case.
SEPARATORS = "".join(
    chr(c) for c in (*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)) if not chr(c).isupper()
)


def item_words(text: Column) -> Column:
    """Lower-cased words of letters, digits and all characters outside ASCII."""
    spaced = F.translate(
        F.coalesce(text, F.lit("")),
        string.ascii_uppercase + SEPARATORS,
        string.ascii_lowercase + " " * len(SEPARATORS),
    )
    return F.array_remove(F.split(spaced, " "), "")


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(item_id, window_id, window): the windows of every item."""
    words = items.select(
        F.col(id_col).cast("string").alias("item_id"), item_words(F.col(text_col)).alias("words")
    ).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))
    cut = words.select("item_id", "words", F.explode(starts).alias("start"))
    return cut.select("item_id", F.slice("words", F.col("start"), F.lit(width)).alias("window")).select(
        "item_id", _window_id(F.col("window")).alias("window_id"), "window"
    ).distinct()


def _tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc"), text_key(F.col(text_col)).alias("row_key"), item_words(F.col(text_col)).alias("words")
    )


def _key(word: Column) -> Column:
    """Hash that stands for a word in joins; what shares it by chance fails the verification."""
    return F.when(word.isNotNull(), F.xxhash64(word))


def _window_id(words: Column) -> Column:
    return F.sha2(F.array_join(words, " "), 256)


def _rarity(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How often each of the given words occurs in all documents."""
    found = tokens.select(F.explode_outer("words").alias("word")).select(_key(F.col("word")).alias("key")).join(vocabulary, "key")
    return found.groupBy("key").agg(F.count("*").alias("n"))


def _anchored(cut: DataFrame, tokens: DataFrame) -> DataFrame:
    """(key, before, window_id, width): each window under its rarest word, ``before`` words in."""
    spread = cut.select("window_id", F.size("window").alias("width"), F.posexplode("window").alias("before", "word")).select(
        "window_id", "width", "before", _key(F.col("word")).alias("key")
    )
    vocabulary = written(spread.select("key").distinct(), "benchmark-words")
    blocks = max(1, ceil(vocabulary.count() / BLOCK))
    counts = None
    for block in range(blocks):
        part = vocabulary.where(F.pmod("key", F.lit(blocks)) == block)
        counted = _rarity(tokens, F.broadcast(part))
        counts = counted if counts is None else counts.unionByName(counted)
    # Written before they are joined, so that the join may split a word that most windows have.
    ranked = spread.join(written(counts, "word-counts"), "key", "left").select(
        "window_id", "width", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "before").alias("rank")
    )
    return ranked.groupBy("window_id", "width").agg(F.min("rank").alias("rank")).select(
        "rank.key", "rank.before", "window_id", "width"
    )


def _covered(spans: Column) -> Column:
    """Words inside any of the spans (start, end)."""
    return F.aggregate(
        F.sort_array(spans),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )


def judged(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
) -> DataFrame:
    """One row per document row: words, hit words, items, and the verdict; ``row_key`` names the text."""
    tokens = _tokens(docs, id_col, text_col)
    cut = written(windows(items, item_col, item_text_col, width), "windows")
    of_item = cut.select("window_id", "item_id")
    distinct = cut.select("window_id", "window").dropDuplicates(["window_id"])
    anchors = written(_anchored(distinct, tokens), "anchors")
    blocks = max(1, ceil(anchors.count() / BLOCK))

    # A null in front of the words matches no window: it stands for the document itself.
    spread = tokens.select(
        "doc", "row_key", "words",
        F.posexplode_outer(F.concat(F.array(F.lit(None).cast("string")), "words")).alias("pos", "token"),
    ).select("doc", "row_key", "words", "pos", _key(F.col("token")).alias("token_key"))
    start = F.col("pos") - F.lit(1) - F.col("before")
    fits = (start >= 0) & (start + F.col("width") <= F.size("words"))
    equal = _window_id(F.slice("words", start + 1, F.col("width"))) == F.col("window_id")
    found = None
    for block in range(blocks):
        part = anchors.where(F.pmod(F.xxhash64("window_id"), F.lit(blocks)) == block)
        met = spread.join(F.broadcast(part), (F.col("token_key") == F.col("key")) & fits & equal, "left").where(
            F.col("window_id").isNotNull() | ((F.col("pos") == 0) if block == 0 else F.lit(False))
        ).select(
            "doc", "row_key", "window_id",
            F.when(F.col("pos") == 0, F.size("words")).alias("n_words"),
            F.when(
                F.col("window_id").isNotNull(),
                F.struct(start.alias("start"), (start + F.col("width")).alias("end")),
            ).alias("span"),
        )
        found = met if found is None else found.unionByName(met)
    per_doc = written(
        found.groupBy("doc", "row_key").agg(
            F.max("n_words").alias("n_words"),
            F.count("n_words").alias("rows"),
            F.collect_set("span").alias("spans"),
            F.collect_set("window_id").alias("window_ids"),
        ),
        "hits",
    )
    listed = (
        per_doc.select("doc", "row_key", F.explode("window_ids").alias("window_id"))
        .join(of_item, "window_id")
        .groupBy("doc", "row_key")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
        .select(F.col("doc").alias("doc2"), F.col("row_key").alias("key2"), "items")
    )
    n_hit = _covered(F.col("spans")).cast("long")
    named = per_doc.join(
        listed, same(F.col("doc"), F.col("doc2")) & (F.col("row_key") == F.col("key2")), "left"
    ).withColumn("hit", n_hit)
    return named.select(
        F.col("doc").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        F.col("hit").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((F.col("hit") > 0) & (F.col("hit") * SHARE >= F.col("n_words"))).alias("contaminated"),
        "row_key",
        F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_copy"),
    ).drop("_copy")


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = (
        judged(docs, items, id_col, text_col)
        .where("contaminated")
        .select(F.col(id_col).alias("_bad"), F.col("row_key").alias("_bad_key"))
        .distinct()
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(id_col).alias("_id"),
        text_key(F.col(text_col)).alias("_key"),
    )
    clean = rows.join(bad, same(F.col("_id"), F.col("_bad")) & (F.col("_key") == F.col("_bad_key")), "left_anti")
    return clean.select("_row.*")
