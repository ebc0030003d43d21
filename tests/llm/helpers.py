"""Rows that operators must take without crashing."""

LONG = "alpha beta gamma delta. " * 8_000

ROWS = [
    (1, None, "a", 1), (2, "", "a", 2), (3, " \t\n\x0b\f\r ", None, 3), (None, "one two three four five six", "b", 4),
    (4, LONG, "a", 5), (4, LONG, "a", 5), (5, LONG, None, 6), (6, "word", "c", 7), (6, "another text under one id", "c", 8),
    (7, "Zeile\n\nZeile\nÄÖÜ ñ 漢字 \U0001f600", "c", 9),
]
#: Names that operators use inside, as extra columns of the input.
CLASHING = ("kept", "words", "doc", "row_key", "_text", "_row", "size", "taken", "fp", "h1", "n_words", "html")


def odd_documents(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, source string, extra int")
    for name in CLASHING:
        frame = frame.withColumn(name, frame["extra"])
    return frame


def ids(rows, name="doc_id"):
    return sorted((r[name] for r in rows), key=lambda x: (x is not None, x))


ALL_IDS = sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))
