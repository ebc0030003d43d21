"""The prefix trie against a plain loop over prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from panelwatch.llm import conversation_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    turns = {c: [x[2] for x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = turns.get(c - c % 5, [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(sums[q][0] for q in children[p]) if children[p] else 1
        last = len(p[-1][1].encode()) if p else 0
        sums[p] = (leaves, (len(members[p]) - 1) * last + sum(sums[q][1] for q in children[p]))
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        out.append(
            (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *sums[p], hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def got(frame):
    return sorted(
        (
            (r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
            for r in frame.collect()
        ),
        key=str,
    )


def branching(seed, n=150, turns=12):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(n * 2), n):
        for t in range(rnd.randrange(turns)):
            rows.append((c, rnd.choice([None, t, t, t, t // 2]), rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bé", "", None, "long text"])))
    return rows


@pytest.mark.parametrize("limit", [conversation_trie.LIMIT, 20])
def test_trie_against_brute_force(spark, limit):
    rows = branching(limit, 70, 9) + [(None, 1, "user", "no conversation")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(conversation_trie.trie(frame, limit=limit)) == brute_trie(rows)


def test_hot_first_turn_long_conversation_and_copies(spark):
    rows = []
    for c in range(100, 220):  # a third of all share their beginning, half of these all of it
        rows += [(c, 1, "user", "hello"), (c, 2, "assistant", "hi"), (c, 3, "user", "same" if c % 2 else f"own {c}")]
    rows += [(500, t, "user", f"turn {t}") for t in range(150)]
    rows += [(501, t, "user", f"turn {t}") for t in range(120)]
    rows += [(700, 5, "user", "repeated")] * 90
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(conversation_trie.trie(frame, limit=150)) == brute_trie(rows)


def test_pieces_of_ids_are_hashed_as_one_list(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 3)
    rows = [(c, 1, "user", "same") for c in range(0, 400, 5)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(conversation_trie.trie(frame)) == brute_trie(rows)


def test_given_conversations(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op13_conversation_trie(spark, data)) == brute_trie(rows)


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_trie.trie(empty).count() == 0
    rows = branching(9, 30)
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("depth", "conv", "k1", "size", "part", "digest", "total"):
        frame = frame.withColumn(name, frame["turn"])
    assert got(conversation_trie.trie(frame)) == brute_trie(rows)


def test_running_totals_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 3)
    rows = branching(4, 30)
    assert got(conversation_trie.trie(spark.createDataFrame(rows, SCHEMA))) == brute_trie(rows)


def test_array_rollup_on_random_forests():
    rng = np.random.default_rng(5)
    for shape in ("bushy", "chain", "mixed"):
        n = 300
        parent = np.full(n, -1)
        for i in range(1, n):
            low = {"bushy": 0, "chain": i - 1, "mixed": max(0, i - 4)}[shape]
            parent[i] = -1 if i % 97 == 0 else rng.integers(low, i)
        depth = np.zeros(n, dtype=np.int64)
        own, value = rng.integers(1, 5, n), rng.integers(-3, 9, n)
        weight, total = own.copy(), value.copy()
        for i in range(n):
            depth[i] = 0 if parent[i] < 0 else depth[parent[i]] + 1
        for i in range(n - 1, 0, -1):
            if parent[i] >= 0:
                weight[parent[i]] += weight[i]
                total[parent[i]] += total[i]
        order = rng.permutation(n)
        back = np.argsort(order)
        moved = np.where(parent[order] >= 0, back[parent[order]], -1)
        found = conversation_trie.array_rollup(moved, depth[order], weight[order], [value[order]])[0]
        assert (found == total[order]).all()
