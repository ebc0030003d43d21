import zlib

import numpy as np

import corpus_pipeline
from panelwatch.llm import decontaminate, hashed_text, line_dedup, mixing, quality_classifier, quality_rules, simhash, toxicity
from tests.llm.helpers import ALL_IDS, ids, odd_documents

MORE = "/root/testdata/sf0.01"


def test_quality_scores_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{MORE}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality_classifier.scores(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    truth = {r.doc_id: r.quality for r in labels.collect()}
    tested = [(rows[d].score, y) for d, y in truth.items() if rows[d].held_out]
    ones, zeros = ([s for s, y in tested if y == label] for label in (1, 0))
    pairs = [a > b for a in ones for b in zeros]
    assert np.mean(pairs) > 0.97
    again = {r.doc_id: r.score for r in quality_classifier.scores(docs.repartition(5), labels).collect()}
    assert again == {d: r.score for d, r in rows.items()}


def test_toxic_documents_are_found(spark):
    docs, labels = (spark.read.parquet(f"{MORE}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in toxicity.scores(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(rows[d].predicted for d, y in truth.items() if y == 0) <= 0.02 * len(truth)
    assert sum(rows[d].predicted for d, y in truth.items() if y == 1) >= 0.7 * sum(truth.values())


def test_models_on_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for scores in (quality_classifier.scores, toxicity.scores):
        assert ids(scores(docs, labels).collect()) == ALL_IDS
        assert scores(docs.limit(0), labels).collect() == []
        assert ids(scores(docs, labels.limit(0)).collect()) == ALL_IDS


def test_features_of_a_very_long_text_are_those_of_its_parts():
    part = "Some words and others, again and again!\n"
    text = part * (3 * hashed_text.PIECE // len(part))
    places = hashed_text.table_places()
    assert set(places(part * 50)) == set(places(text))
    assert set(hashed_text.word_hashes(part * 50)) == set(hashed_text.word_hashes(text))


def test_pipeline_stages_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    frame, kept_ids = docs, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, frame = frame, stage(spark, frame, data)
        if number < 4:
            assert frame.columns == docs.columns
            frame = spark.createDataFrame(frame.collect(), docs.schema)
        rows = {r.doc_id: r for r in frame.collect()}
        old = {r.doc_id: r for r in before.collect()}
        assert len(rows) == frame.count() and set(rows) <= set(old)
        if number == 0:
            assert set(rows) == {r.doc_id for r in quality_rules.judged(before).where("kept").collect()}
        if number == 1:
            assert set(rows) == set(old)
            dropped = {r.doc_id for r in line_dedup.keep_bitmaps(before).select("doc").withColumnRenamed("doc", "doc_id").collect()}
            assert {d for d in rows if rows[d].text != old[d].text} == dropped and dropped
        if number == 2:
            assert set(rows) == {r.component_id for r in simhash.classes(before).collect()}
            assert len(rows) < len(old)
        if number == 3:
            bad = {r.doc_id for r in decontaminate.judged(before, bench).where("contaminated").collect()}
            assert set(rows) == set(old) - bad and bad
        if number == 4:
            taken = {r.doc_id: r.taken for r in mixing.taken(before).collect()}
            assert {d: r.taken for d, r in rows.items()} == {d: t for d, t in taken.items() if t}
        kept_ids.append(set(rows))
    whole = corpus_pipeline.run(spark, data)
    assert {r.doc_id for r in whole.collect()} == kept_ids[-1]
    assert whole.columns[: len(docs.columns)] == docs.columns


def test_pipeline_takes_odd_rows_and_an_empty_table(spark, data, tmp_path):
    docs = odd_documents(spark)
    prose = "the river runs past the old mill and the stones of the bridge keep their cold colour in the evening light"
    more = spark.createDataFrame([(70 + i, f"{prose} number {i} of many", "d", i) for i in range(3)], "doc_id long, text string, source string, extra int")
    for name in docs.columns[len(more.columns) :]:
        more = more.withColumn(name, more["extra"])
    whole = docs.unionByName(more)
    for name, table in (("odd", whole), ("none", whole.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    kept = rows.collect()
    judged = {r.doc_id for r in quality_rules.judged(whole).where("kept").collect()}
    added = ["size", "source_size", "target", "taken", "copies"]
    assert rows.columns == [c for c in whole.columns if c not in added] + added
    assert {r.doc_id for r in kept} <= judged and judged & {70, 71, 72}
    assert {r.doc_id for r in kept} & {70, 71, 72} and all(r.kept == r.extra for r in kept)
    empty = corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert empty.columns == rows.columns and empty.collect() == []
