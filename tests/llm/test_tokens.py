"""Token counts and cross-tokenizer alignment against the tokenizer libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from panelwatch.llm import byte_bpe, cross_tokenizer, queries, token_counts

from .helpers import ALL_IDS, LONG, ROWS, ids, odd_documents

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")

A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
PARTS = [
    *"ab'stmdrevlS 19\n\t\r ", "\x85", "　", "é", "漢", "😀", "▁", "́", "ⅷ", "١", "\x00", "\x1c", "  ", "\n\n", "'re", "'ll",
    "'s", "the ", " and", "<|endoftext|>", "<s>", "<0x0A>", "<unk>", "!.", "-_", "aaaa", "12345", "Straße ", "naïve",
]


def mixed_texts(n=1500, seed=3):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choices(PARTS, k=rnd.randrange(30))) for _ in range(n)]
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(rnd.choices(points, k=40)) for _ in range(n // 3)]
    texts += [None, "", " ", "\n", "a" * 3000, "ab" * 2500, " " * 999, LONG, "x y " * 9000, "x y " * 9000]
    return texts


@pytest.fixture(scope="module")
def library():
    plain = tokenizers.Tokenizer.from_file(A)
    literal = tokenizers.Tokenizer.from_file(A)
    literal.encode_special_tokens = True
    return plain, literal, sentencepiece.SentencePieceProcessor(model_file=B)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


def test_counts_are_those_of_the_library(spark, library):
    texts = mixed_texts()
    want = [len(e.ids) for e in library[0].encode_batch([t or "" for t in texts], add_special_tokens=False)]
    literal = [len(e.ids) for e in library[1].encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert want != literal
    for special, expected in ((True, want), (False, literal)):
        rows = token_counts.token_counts(frame(spark, texts), A, special=special).collect()
        assert {r.doc_id: r.n_tokens for r in rows} == dict(enumerate(expected))
        assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 512) for r in rows)


def test_code_points_are_classed_as_the_library_does(library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(points[i : i + 64]) for i in range(0, len(points), 64)]
    import pyarrow as pa

    _, got = token_counts.counts(byte_bpe.load(A), pa.array(texts))
    assert got.tolist() == [len(e.ids) for e in library[0].encode_batch(texts, add_special_tokens=False)]


def test_parts_of_long_texts_give_the_tokens_of_the_whole(library):
    import pyarrow as pa

    texts = [t for t in mixed_texts(150) if t and len(t) < 400]
    column = pa.array([" ".join(texts), "no cut" + "x" * 500, *texts])
    data, offsets = byte_bpe.as_bytes(column)
    model = byte_bpe.load(A)
    whole = token_counts.counts(model, column)[1]
    for size in (1, 50, 700):
        total = [0] * len(column)
        n_pieces = 0
        for bounds, rows in byte_bpe.pieces(data, offsets, size):
            n_pieces += 1
            found = token_counts._piece_counts(model, data[bounds[0] : bounds[-1]], bounds - bounds[0], True)
            for row, n in zip(rows, found):
                total[row] += int(n)
        assert total == whole.tolist() and n_pieces > 20


def test_odd_rows_are_counted(spark):
    rows = token_counts.token_counts(odd_documents(spark), A).collect()
    assert ids(rows) == ALL_IDS
    assert all(r.n_tokens == 0 for r in rows if r.doc_id in (1, 2))
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), A).count() == 0


def brute_alignment(library, texts):
    """The contract, token by token."""
    _, literal, pieces = library
    back = {s: b for b, s in enumerate(byte_bpe.byte_symbols())}
    found, pairs = [], Counter()
    for text in texts:
        row = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "links": []}
        found.append(row)
        if not text:
            continue
        whole = (" " + text).encode()
        a = literal.encode(" " + text, add_special_tokens=False)
        a_bytes = [bytes(back[c] for c in t) for t in a.tokens]
        b_ids = pieces.encode(text)
        b_bytes = [
            bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, pieces.id_to_piece(i)) for i in b_ids)
        ]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            continue

        def ends(tokens, names):
            out, at = {}, 0
            for t, name in zip(tokens, names):
                at += len(t)
                out[at] = name
            return out

        ends_a, ends_b = ends(a_bytes, a.ids), ends(b_bytes, b_ids)
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = []
        lists = [([], sorted(e.items())[::-1]) for e in (ends_a, ends_b)]
        for high in cuts:
            for mine, left in lists:
                mine.clear()
                while left and left[-1][0] <= high:
                    mine.append(str(left.pop()[1]))
            groups.append("|".join(",".join(mine) for mine, _ in lists))
        row |= {
            "n_a": len(a.ids), "n_b": len(b_ids), "n_groups": len(cuts), "n_links": len(cuts),
            "groups_sha256": hashlib.sha256(";".join(groups).encode()).hexdigest(),
            "links": [(ends_a[c], ends_b[c]) for c in cuts],
        }
        pairs.update(row["links"])
    top = defaultdict(int)
    for (_, b), n in pairs.items():
        top[b] = max(top[b], n)
    docs = defaultdict(set)
    for k, row in enumerate(found):
        links = row.pop("links")
        row["n_best"] = sum(pairs[x] == top[x[1]] for x in links)
        row["count_sum"] = sum(pairs[x] for x in links)
        for x in links:
            docs[x].add(k)
    return found, pairs, top, docs


@pytest.mark.parametrize("block", [cross_tokenizer.BLOCK, 2000])
def test_alignment_against_brute_force(spark, library, block):
    texts = mixed_texts(300) + ["the cat sat on the mat"] * 200
    want, pairs, top, docs = brute_alignment(library, texts)
    rows = cross_tokenizer.digests(frame(spark, texts), A, B, block=block).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = r.asDict()
        assert got == {"doc_id": r.doc_id, **want[r.doc_id]}, texts[r.doc_id]
    assert sum(r.n_a > 0 for r in rows) > 300 and any(r.n_a == 0 and texts[r.doc_id] for r in rows)

    table = cross_tokenizer.aligned(frame(spark, texts), A, B, block=block)
    counted = {(r.a, r.b): (r.n_links, r.n_docs, r.best) for r in cross_tokenizer.pair_counts(table).collect()}
    assert counted == {x: (n, len(docs[x]), n == top[x[1]]) for x, n in pairs.items()}


def test_alignment_of_given_documents(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = brute_alignment(library, [r.text for r in docs])[0]
    got = {r.doc_id: r.asDict() for r in queries.op11_cross_tokenizer(spark, data).collect()}
    assert got == {r.doc_id: {"doc_id": r.doc_id, **w} for r, w in zip(docs, want)}


def test_alignment_takes_odd_rows(spark):
    rows = cross_tokenizer.digests(odd_documents(spark), A, B).collect()
    assert ids(rows) == ALL_IDS
    assert {r.groups_sha256 for r in rows if r.doc_id in (1, 2)} == {""}
    same = [r.asDict() for r in rows if r.doc_id in (4,)]
    assert same[0] == same[1]
    assert len(ROWS) == len(rows)
    assert cross_tokenizer.digests(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
