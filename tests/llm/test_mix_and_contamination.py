import hashlib
import math
import random
import re

import pytest

from panelwatch.llm import decontaminate, mixing
from tests.llm.helpers import ALL_IDS, ids, odd_documents


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        if not open_ or not total:
            break
        level = (total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= above
    return {s: 2.0 * sizes[s] for s in names}


def test_targets_and_taken_words(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = mixing.taken(docs).collect()
    assert len(rows) == len(source)
    sizes, taken, largest, target = {}, {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        assert r["size"] == len([w for w in re.split("[ \t\n\x0b\f\r]+", text[r.doc_id] or "") if w])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r["size"])
        target[s] = r.target
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = sorted(map(repr, mixing.taken(docs.repartition(7)).collect()))
    assert again == sorted(map(repr, rows))


@pytest.mark.parametrize("share", [0.05, 0.4, 0.999, 1.0, 1.3, 1.9, 2.0])
def test_tilts_meet_their_constraint(spark, share):
    rng = random.Random(5)
    sizes = [rng.choice([1, 3, 10, 400, 20_000]) for _ in range(300)]
    total = sum(sizes)
    histogram = spark.createDataFrame([("0a", s, sizes.count(s)) for s in set(sizes)], "source string, size long, n long")
    goals = spark.createDataFrame([("0a", float(share * total))], "source string, target double")
    row = mixing.solve(histogram, goals).first()
    rate = [2.0 if row.full else min(2.0, math.exp(row.lam * s / row.mean)) for s in sizes]
    assert sum(s * r for s, r in zip(sizes, rate)) == pytest.approx(share * total, rel=1e-6)


def test_mix_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = mixing.taken(docs).collect()
    assert ids(rows) == ALL_IDS
    assert all(r.taken <= 2 * r["size"] for r in rows)
    out = mixing.with_copies(docs)
    assert [c for c in docs.columns if c not in ("size", "taken")] == out.columns[:-5]
    assert all(r["taken"] == r["copies"] * r["size"] and r["copies"] > 0 for r in out.collect())
    assert mixing.taken(docs.limit(0)).collect() == []
    empty = docs.where("doc_id <= 3")
    assert [(r.taken, r.target) for r in mixing.taken(empty).collect()] == [(0, 0.0)] * 3


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(docs, items):
    out = []
    for doc, text in docs:
        ws, hit, listed = tokens(text), set(), set()
        for item, passage in items:
            bs = tokens(passage)
            n = min(13, len(bs))
            if not n:
                continue
            wanted = {tuple(bs[i : i + n]) for i in range(len(bs) - n + 1)}
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in wanted:
                    hit.update(range(i, i + n))
                    if item is not None:
                        listed.add(str(item))
        digest = hashlib.sha256(",".join(sorted(listed)).encode()).hexdigest()
        out.append((doc, len(ws), len(hit), len(listed), digest, bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=repr)


def test_contamination_against_brute_force(spark):
    rng = random.Random(9)
    words = ["the", "of", "été", "Xx", "rare1", "rare2", "7", "a-b", "Ñ"]
    passages = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 5, 13, 14, 30, 30)]
    items = [*enumerate(passages), (3, passages[5]), (None, passages[4]), (50, None), (51, "!!"), (100, passages[2])]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(200 + i, f"before {p.upper()}, after " + "filler " * rng.choice([0, 100, 700])) for i, p in enumerate(passages)]
    docs += [(1, docs[1][1]), (1, passages[3]), (None, passages[4]), (None, None), (300, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.judged(frame, bench).drop("row_key").collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute_contamination(docs, items)
    clean = sorted(map(repr, (tuple(r) for r in decontaminate.clean_documents(frame, bench).collect())))
    verdicts = {}
    for d in docs:
        verdicts[repr(d)] = brute_contamination([d], items)[0][-1]
    assert clean == sorted(repr(d) for d in docs if not verdicts[repr(d)])


def test_contamination_of_odd_rows(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "alpha beta gamma delta " * 5)], "item_id long, text string")
    assert ids(decontaminate.judged(docs, items).collect()) == ALL_IDS
    clean = decontaminate.clean_documents(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 3
    assert decontaminate.judged(docs.limit(0), items).collect() == []
    assert decontaminate.clean_documents(docs, items.limit(0)).count() == docs.count()
