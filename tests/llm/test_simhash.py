import random

import pytest
import xxhash
from pyspark.sql import functions as F

from panelwatch.llm import simhash
from panelwatch.llm.components import components


def brute_print(text):
    words = []
    for raw in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" "):
        if raw:
            words.append("".join(c.lower() if "A" <= c <= "Z" else c for c in raw))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def brute_components(prints):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = sorted(prints)
    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return {p: root(p) for p in prints}


TEXTS = [None, "", " \t\n", "One", "one two", "One two three four", "ONE TWO three  four", "Été ÉTÉ été é x y z", "a\x0bb c\xa0d e f g " * 30]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_of_single_texts(text):
    assert simhash.fingerprint_of(text) & (1 << 64) - 1 == brute_print(text)


def test_hash_is_that_of_the_engine(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("été xyz abc")).alias("h")).first()
    assert row.h & (1 << 64) - 1 == xxhash.xxh64_intdigest("été xyz abc".encode(), seed=42)


@pytest.mark.parametrize("paired", [1, 4, 48])
def test_links_connect_what_brute_force_connects(spark, paired):
    rng = random.Random(paired)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(6):
        centre = rng.getrandbits(64)
        prints.add(centre)
        for _ in range(30):
            x = centre
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            prints.add(x)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    frame = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    found = simhash.links(frame, paired)
    got = {r.node: r.component for r in components(found).collect()}
    want = brute_components(prints)
    groups = {}
    for p, root in want.items():
        groups.setdefault(root, set()).add(signed[p])
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)] + [(1001, 1001)]
    rows = [(a, b) if (a * 7) % 2 else (b, a) for a, b in path + star + path[:5]]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}}


def test_query_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    roots = brute_components(set(rows.values()))
    smallest = {}
    for doc, p in rows.items():
        smallest[roots[p]] = min(doc, smallest.get(roots[p], doc))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.classes(docs).collect()}
    assert got == {d: (f"{p:016x}", smallest[roots[p]]) for d, p in rows.items()}


def test_odd_rows_have_a_defined_result(spark):
    long = "word after word " * 50_000
    rows = [(None, "", "x"), (3, None, "x"), (2, "", None), (2, "", None), (5, long, "y"), (6, long, "y"), (None, "a b c d e f g h", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.classes(docs).collect()), key=repr)
    assert got == sorted([(None, 2), (3, 2), (2, 2), (2, 2), (5, 5), (6, 5), (None, None)], key=repr)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted([(r.doc_id, r.fp) for r in kept.collect()], key=repr) == sorted([(2, None), (5, "y"), (None, "z")], key=repr)
    assert simhash.classes(docs.limit(0)).collect() == [] and simhash.one_of_each(docs.limit(0)).collect() == []
