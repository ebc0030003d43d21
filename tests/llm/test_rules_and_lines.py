import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from panelwatch.llm import line_dedup, quality_rules
from tests.llm.helpers import ALL_IDS, LONG, ROWS, ids, odd_documents

SPACE = " \t\n\x0b\f\r"


def brute_rules(text):
    text = text or ""
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {p for places in seen.values() if len(places) > 1 for i in places for p in range(i, i + 5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    )


def test_rules_against_brute_force(spark, data):
    rng = random.Random(3)
    made = [" ".join(rng.choice(["a", "bb", "c#", "d\n", "e e"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    given = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(80).collect()]
    texts = [None, "", "\n\n", "x " * 500, LONG, *made, *given]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.judged(docs).collect():
        want = brute_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_rules_on_odd_rows(spark):
    docs = odd_documents(spark)
    assert ids(quality_rules.judged(docs).collect()) == ALL_IDS
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and kept.collect() == []
    assert quality_rules.judged(docs.limit(0)).collect() == []
    # a filter of the caller must not unfold the projections
    assert quality_rules.judged(docs).where("not kept").count() == len(ROWS)


def test_kept_documents_are_those_of_the_verdict(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = {r.doc_id for r in quality_rules.judged(docs).where("kept").collect()}
    assert {r.doc_id for r in quality_rules.kept_documents(docs).select("doc_id").collect()} == want
    assert 0 < len(want) < docs.count()


def brute_lines(rows, min_chars, min_docs):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))

    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc)
    order = lambda d: (d is not None, d)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [
            x for x in lines
            if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or doc == max(holders[key(x)], key=order)
        ]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs", [2, 3, 5])
def test_lines_against_brute_force(spark, min_docs):
    rng = random.Random(min_docs)
    pool = [f"Line number {i} with words" for i in range(12)] + ["  LINE number 3 WITH words\t", "short", "", "É" * 20, "é" * 20]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(120)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, None), (500, "")]
    rows += [(1000 + i, "One line that all of these hold\nown line of document number %d" % i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.digests(docs, line_dedup.keep_bitmaps(docs, min_docs=min_docs))
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute_lines(rows, 20, min_docs)


def test_lines_on_odd_rows(spark):
    docs = odd_documents(spark)
    bitmaps = line_dedup.keep_bitmaps(docs)
    assert ids(line_dedup.digests(docs, bitmaps).collect()) == ALL_IDS
    out = line_dedup.without_repeated_lines(docs, bitmaps)
    assert out.columns == docs.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    none = docs.limit(0)
    assert line_dedup.digests(none, line_dedup.keep_bitmaps(none)).collect() == []


def test_kept_text_is_what_the_digest_says(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bitmaps = line_dedup.keep_bitmaps(docs)
    texts = line_dedup.without_repeated_lines(docs, bitmaps).select("doc_id", F.sha2("text", 256).alias("h"))
    digests = {r.doc_id: r.kept_sha256 for r in line_dedup.digests(docs, bitmaps).collect()}
    assert {r.doc_id: r.h for r in texts.collect()} == digests


def test_ids_of_any_type(spark):
    line = "a line that is long enough to count"
    rows = [(1, line), (2, f"{line}\nshort"), (3, line), (4, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((str(r.doc_id), r.n_dropped) for r in line_dedup.digests(plain, line_dedup.keep_bitmaps(plain)).collect())
    assert want == [("1", 1), ("2", 1), ("3", 0), ("4", 0)]
    for kind in ("decimal(20,0)", "string", "int", "date"):
        docs = plain.withColumn("doc_id", plain.doc_id.cast(kind) if kind != "date" else F.date_add(F.lit("2020-01-01"), plain.doc_id.cast("int")))
        got = line_dedup.digests(docs, line_dedup.keep_bitmaps(docs)).collect()
        assert [r.n_dropped for r in sorted(got, key=lambda r: r.doc_id)] == [1, 1, 0, 0]
