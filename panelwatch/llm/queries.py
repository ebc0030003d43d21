"""The corpus queries by name, and their equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversation_trie, cross_tokenizer, decontaminate, line_dedup, link_trust, mixing, quality_classifier, quality_rules, sentence_spans, simhash, sqltext, suffix_dedup, token_counts, toxicity
from .common import read_table


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines before, lines dropped and the hash of the kept text of every document."""
    docs = read_table(spark, folder, "documents")
    return line_dedup.digests(docs, line_dedup.keep_bitmaps(docs))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Size, target of its source and words taken of every document."""
    return mixing.taken(read_table(spark, folder, "documents"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality_rules.judged(read_table(spark, folder, "documents"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities of the label chain and the toxicity verdict of every document."""
    docs, labels = (read_table(spark, folder, name) for name in ("documents", "labels"))
    return toxicity.scores(docs, labels)


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.classes(read_table(spark, folder, "documents"))


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Hit words, items and verdict of every document against all benchmark items."""
    docs, items = (read_table(spark, folder, name) for name in ("documents", "benchmark"))
    return decontaminate.judged(docs, items).drop("row_key")


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return link_trust.judged(read_table(spark, folder, "pages"))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes removed from every document and the hash of what stays."""
    docs = read_table(spark, folder, "documents")
    return suffix_dedup.digests(docs, suffix_dedup.repeated_windows(docs))


def op9_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document, those under repeated spans, and the hash of the rest."""
    return sentence_spans.deduplicated(read_table(spark, folder, "documents")).drop("kept")


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score and verdict of every document."""
    docs, labels = (read_table(spark, folder, name) for name in ("documents", "labels"))
    return quality_classifier.scores(docs, labels)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the package is installed wherever tasks run."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op11_cross_tokenizer(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens, groups and links of two tokenizers, and how frequent the linked pairs are, of every document."""
    docs = read_table(spark, folder, "documents")
    return cross_tokenizer.digests(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(read_table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations, with its subtree's sums."""
    return conversation_trie.trie(read_table(spark, folder, "conversations"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_decontaminate": op6_decontaminate,
    "op7_url_filter": op7_url_filter,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_sentence_spans": op9_sentence_spans,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_cross_tokenizer": op11_cross_tokenizer,
    "op12_token_counts": op12_token_counts,
    "op13_conversation_trie": op13_conversation_trie,
}
ORACLES = {
    "op1_line_dedup": sqltext.LINE_DEDUP,
    "op3_quality_rules": sqltext.QUALITY_RULES,
    "op6_decontaminate": sqltext.DECONTAMINATE,
    "op8_suffix_dedup": sqltext.SUFFIX_DEDUP,
    "op13_conversation_trie": sqltext.CONVERSATION_TRIE,
}
