import hashlib
import random
import re

import numpy as np
import pytest

from panelwatch.llm import link_trust, sentence_spans, suffix_dedup
from tests.llm.helpers import ALL_IDS, LONG, ids, odd_documents

L = suffix_dedup.LENGTH


def brute_bytes(texts):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - L + 1):
            seen[d[i : i + L]] = seen.get(d[i : i + L], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, dtype=bool)
        for i in range(len(d) - L + 1):
            if seen[d[i : i + L]] > 1:
                gone[i : i + L] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(d) else 0
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def made_texts(seed):
    rng = random.Random(seed)

    def prose(n):
        return "".join(rng.choice("abcdefgh éñ\n") for _ in range(n))

    shared = [prose(n) for n in (300, 399, 400, 401, 700, 1500)]
    texts = [None, "", "x" * 399, "x" * 400, "y" * 900, "ab" * 700, prose(3000)]
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            passage = rng.choice(shared)
            cut = rng.randint(0, len(passage) // 2)
            parts += [prose(rng.randint(0, 400)), rng.choice([passage, passage[cut:], passage[: len(passage) - cut]])]
        texts.append("".join(parts))
    return [*texts, texts[8], texts[8], texts[9] + "tail"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_bytes_against_brute_force(spark, seed):
    texts = made_texts(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(docs, suffix_dedup.repeated_windows(docs)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_bytes(texts)


def test_anchors_do_not_depend_on_pieces():
    data = LONG.encode() + random.Random(4).randbytes(2 * suffix_dedup.PIECE)
    whole = set(suffix_dedup.anchors_of(data[200_000:]).tolist())
    assert {p - 200_000 for p in suffix_dedup.anchors_of(data).tolist() if p >= 200_000 + L} <= whole


def test_bytes_of_odd_rows(spark):
    docs = odd_documents(spark)
    repeated = suffix_dedup.repeated_windows(docs)
    rows = suffix_dedup.digests(docs, repeated).collect()
    assert ids(rows) == ALL_IDS
    assert {r.doc_id: r.n_removed for r in rows}[5] == len(LONG)
    assert all(bytes(r.kept) == b"" for r in suffix_dedup.kept_bytes(docs, repeated).where("doc_id in (4, 5)").collect())
    none = docs.limit(0)
    assert suffix_dedup.digests(none, suffix_dedup.repeated_windows(none)).collect() == []


def test_sentence_spans_keep_the_first_place(spark):
    rng = random.Random(6)
    words = ["wo%d" % i for i in range(3000)]

    def prose(n):
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", ", ", "\n"]) for _ in range(n))

    passage = " ".join(rng.choice(words) for _ in range(60))
    marked = prose(80)
    rows = [(i, prose(200)) for i in range(20)]
    rows += [(100 + i, prose(37 + i) + passage.upper() + ". " + prose(20)) for i in range(4)]
    rows += [(200 + i, prose(11 * i) + marked + prose(9)) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sentence_spans.deduplicated(docs).collect()}
    assert all(got[i].n_removed == 0 and got[i].kept == dict(rows)[i] for i in [*range(20), 100, 200])
    for i in (101, 102, 103):
        assert got[i].n_removed > len(passage) * 0.6
    for i in (201, 202, 203):
        assert got[i].n_removed > len(marked.encode()) * 0.7
    for r in got.values():
        assert r.n_bytes - r.n_removed == len(r.kept.encode())
        assert r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest()


def brute_spans(rows):
    """The rule said again over lists of words and cuts, without sums or joins."""
    seen, out = {}, {}
    for doc, text in sorted(rows):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        starts, hashes, first = sentence_spans._cut(data)
        bounds, places = [*first.tolist(), len(hashes)], [*starts.tolist(), len(data)]
        gone = set()
        for i in range(len(bounds) - 1):
            j = i + sentence_spans.SENTENCES
            while j < len(bounds) and bounds[j] - bounds[i] < sentence_spans.WORDS:
                j += 1
            if j < len(bounds):
                key = tuple(hashes[bounds[i] : bounds[j]].tolist())
                if seen.setdefault(key, (doc, i)) != (doc, i):
                    gone.update(range(places[bounds[i]], places[bounds[j]]))
        out[doc] = (len(data), len(gone))
    return out


def test_sentence_spans_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in sentence_spans.deduplicated(docs).collect()}
    assert got == brute_spans(rows)
    assert any(n for _, n in got.values())


def test_a_very_long_text_is_cut_like_a_short_one():
    part = "some words, of a text. And others that follow it closely by the way\n"
    text = part * (3 * sentence_spans.PIECE // len(part))
    h1, h2, begin, end = sentence_spans.spans(text)
    short = sentence_spans.spans(part * 40)
    assert set(zip(h1.tolist(), h2.tolist())) == set(zip(short[0].tolist(), short[1].tolist()))
    # the last span ends with the text or with the sentence before its last one
    assert len(text.encode()) - len(part) < end.max() <= len(text.encode()) and (np.diff(begin) > 0).all()
    unbroken = sentence_spans.spans("x" * (3 * sentence_spans.PIECE))
    assert len(unbroken[0]) == 0


def own_spans(text):
    """Spans as (words, first byte, last byte), by the definition and without the operator's functions."""

    def order(word):
        x, m = sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(word)) % (1 << 64), (1 << 64) - 1
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & m
        x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & m
        return x ^ (x >> 32)

    data, near = text.lower().encode(), sentence_spans.NEAR
    found = list(re.finditer(rb"[0-9a-z\x80-\xff]+", data))
    words, starts = [m.group() for m in found], [m.start() for m in found] + [len(data)]
    marked = [bool(re.search(rb"[.!?\n]", data[a.end() : b.start()])) for a, b in zip(found, found[1:])] + [False]
    ranks = [0 if m else order(w) for w, m in zip(words, marked)]
    cut = {i for i, m in enumerate(marked) if m}
    for i in range(len(words) - near + 1):
        cut |= {j for j in range(i, i + near) if ranks[j] == min(ranks[i : i + near])}
    bounds = sorted({0, len(words)} | {i + 1 for i in cut})
    out = []
    for k, a in enumerate(bounds):
        ends = [b for n, b in enumerate(bounds) if n >= k + 2 and b >= a + 12]
        if ends:
            out.append((tuple(words[a : ends[0]]), starts[a], starts[ends[0]]))
    return out


@pytest.mark.parametrize("size, vocabulary", [(42, 5000), (51, 5000), (51, 300), (51, 12)])
def test_every_unmarked_passage_is_found_wherever_it_stands(spark, size, vocabulary):
    rng = random.Random(size * vocabulary)
    words, other = ["w%d" % i for i in range(vocabulary)], ["v%d" % i for i in range(5000)]

    def prose(n, names=other):
        return " ".join(rng.choice(names) for _ in range(n))

    passages = [prose(size, words) for _ in range(150)]
    texts = [" ".join([prose(rng.randint(0, 90)), p, prose(rng.randint(0, 90))]) for p in passages + passages]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in sentence_spans.deduplicated(docs).collect()}
    seen, want = {}, {}
    for i, text in enumerate(texts):
        gone = set()
        for key, a, b in own_spans(text):
            if seen.setdefault(key, (i, a)) != (i, a):
                gone.update(range(a, b))
        want[i] = len(gone)
    assert {i: r.n_removed for i, r in got.items()} == want
    assert all(len(texts[i].split()) - len(got[i].kept.split()) >= 12 for i in range(150, 300))


def test_equal_words_in_a_row_are_cut_after_each():
    assert sentence_spans.spans("again " * 40)[2].tolist() == [6 * i for i in range(29)]


def test_spans_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice(["so", "wörd", "other", "x%d" % rng.randint(0, 900)]) + rng.choice([" "] * 9 + [". "]) for _ in range(3000))
    whole = [x.tolist() for x in sentence_spans.spans(text)]
    assert list(zip(*whole[2:])) == [(a, b) for _, a, b in own_spans(text)]
    for piece in (150, 997, 4096):
        monkeypatch.setattr(sentence_spans, "PIECE", piece)
        assert [x.tolist() for x in sentence_spans.spans(text)] == whole


@pytest.mark.parametrize("first, last, marks", [(0x4E00, 0x9FA5, ""), (0x4E00, 0x9FA5, "。！？"), (0x3041, 0x30FA, "、"), (0x20000, 0x2A6D0, "")])
def test_passages_without_spaces_are_found(spark, monkeypatch, first, last, marks):
    rng = random.Random(first + len(marks))

    def prose(n):
        return "".join(chr(rng.randint(first, last)) + (rng.choice(marks) if marks and rng.random() < 0.1 else "") for _ in range(n))

    passages = [prose(60) for _ in range(20)]
    texts = [prose(rng.randint(0, 50)) + p + prose(rng.randint(0, 50)) for p in passages * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in sentence_spans.deduplicated(docs).collect()}
    for i in range(20):
        assert got[i].kept == texts[i]
        assert 12 <= len(texts[20 + i]) - len(got[20 + i].kept) and not set(got[20 + i].kept) - set(texts[20 + i])
    long = "some words " + prose(2000) + " and other"
    whole = [x.tolist() for x in sentence_spans.spans(long)]
    for piece in (151, 998, 2000):
        monkeypatch.setattr(sentence_spans, "PIECE", piece)
        assert [x.tolist() for x in sentence_spans.spans(long)] == whole


def test_full_width_marks_end_sentences():
    words = sentence_spans._cut(np.frombuffer("一二。三四！五 six？seven 八".encode(), dtype=np.uint8))
    assert len(words[1]) == 8 and words[2].tolist() == [0, 2, 4, 6]


def test_sentences_of_odd_rows(spark):
    docs = odd_documents(spark)
    assert ids(sentence_spans.deduplicated(docs).collect()) == ALL_IDS
    assert sentence_spans.deduplicated(docs.limit(0)).collect() == []


URLS = [
    (1, "http://A.Example.org/es/x", "org/"), (2, "https://b.org", None), (3, "http://example.org/es/1", "example.org/es/"),
    (4, "http://m.example.org/en/12?q#f", "example.org/en/1"), (5, "http://x.com/fr/a", "com/fr/"), (6, "ftp://x.com/de/", "com/de/"),
    (7, "http://x.com/de", None), (8, "http://notorg/", None), (9, None, None), (10, "no scheme/org/", None), (11, "http://", None),
    (12, "http://org/", "org/"), (13, "http://h.net?x=/a#b", None), (14, "http://a.org/x://b.com/fr/", "org/"),
]


def test_rules_of_urls(spark):
    urls = [(i, u, None) for i, u, _ in URLS]
    got = {r.page_id: r for r in link_trust.judged(spark.createDataFrame(urls, "page_id long, url string, html string")).collect()}
    want = {i: rule for i, _, rule in URLS}
    want[1] = "example.org/es/"
    assert {i: r.rule for i, r in got.items()} == want
    assert (got[1].host, got[1].path) == ("a.example.org", "/es/x")
    assert (got[4].host, got[4].path) == ("m.example.org", "/en/12")
    assert (got[9].host, got[9].path, got[9].verdict) == ("", "", "allow")
    assert (got[13].host, got[13].path) == ("h.net", "")
    assert got[3].verdict == "block" and got[5].verdict == "allow" and got[6].verdict == "block"


def brute_rank(edges, seeds, damping=0.85):
    """The linear system of the ranks, solved at once."""
    hosts = sorted({h for e in edges for h in e[:2]} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    move = np.zeros((len(hosts), len(hosts)))
    for a, b, n in edges:
        move[at[b], at[a]] += n
    out = move.sum(axis=0)
    move[:, out > 0] /= out[out > 0]
    start = np.array([seeds.get(h, 0.0) for h in hosts])
    return dict(zip(hosts, np.linalg.solve(np.eye(len(hosts)) - damping * move, start)))


def test_ranks_against_power_iteration(spark):
    rng = random.Random(8)
    hosts = [f"h{i}.net" for i in range(15)]
    edges = list({(a, b): (a, b, rng.randint(1, 5)) for a, b in (rng.sample(hosts, 2) for _ in range(40))}.values())
    seeds = {"h0.net": 3.0, "h3.net": 1.0, "alone.net": 2.0}
    got = link_trust.personalised_rank(
        spark.createDataFrame(edges, "src string, dst string, links long"),
        spark.createDataFrame(list(seeds.items()), "host string, weight double"),
        damping=0.5,
    )
    want = brute_rank(edges, seeds, damping=0.5)
    found = {r.host: float(r["rank"]) for r in got.collect()}
    for host, value in want.items():
        assert found.get(host, 0.0) == pytest.approx(value, abs=1e-4)


def test_trust_goes_along_links_and_distrust_against_them(spark):
    def page(n, url, *links):
        return n, url, "".join(f"<a HREF='{x}'>x</a>" for x in links)

    pages = [
        page(1, "http://good.org/a", "http://friend.net/", "/local"), page(2, "http://friend.net/b"),
        page(3, "http://farm.net/c", "//bad.com/x", "https://other.net/"), page(4, "http://bad.com/de/1"),
        page(5, "http://other.net/d"), (6, "http://alone.net/", None),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in link_trust.judged(frame).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "allow"}


def test_a_tie_is_allowed_whatever_other_hosts_there_are(spark):
    for others in (181, 182):
        rows = [(k, f"http://a.com/{'fr' if k < 3 else 'de'}/{k}", None) for k in range(9)] + [(9, "http://a.com/x", None)]
        rows += [(100 + k, f"http://other.com/de/{k}", None) for k in range(others)]
        got = {r.page_id: r.verdict for r in link_trust.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got[9] == "allow"
        rows.append((10, "http://a.com/de/more", None))
        got = {r.page_id: r.verdict for r in link_trust.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got[9] == "block"


def linked_pages(seed, n=120):
    """Links lead to later hosts only, so that the ranks settle after a few steps."""
    rng = random.Random(seed)
    hosts = [f"h{i}.com" for i in range(14)] + ["g.org", "k.net", "m.net"]
    pages = []
    for k in range(n):
        host = rng.choice(hosts)
        path = rng.choices(["/fr/x", "/de/y", "/plain", "/fr", ""], [1, 8, 6, 1, 2])[0]
        later = [h for h in hosts[hosts.index(host) + 1 :] if hosts.index(h) // 4 == hosts.index(host) // 4 + 1]
        links = "".join(f'<a href="http://{rng.choice(later)}/p">l</a>' for _ in range(rng.randrange(3)) if later)
        pages.append((k, f"http://{host}{path}", links))
    return pages


def brute_judged(pages):
    """Every rule, link and rank by a plain loop."""
    found, seeds, links = [], {"allow": {}, "block": {}}, {}
    for k, url, html in pages:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0].lower()
        path = re.match("[^?#]*", rest[len(host):]).group()
        best = None
        for verdict, rule in link_trust.RULES:
            domain, _, tail = rule.partition("/")
            if (host == domain or host.endswith("." + domain)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
                best = (verdict, rule)
        found.append((k, host, path, best))
        if best:
            seeds[best[0]][host] = seeds[best[0]].get(host, 0) + 1
        for target in re.findall('href="http://([^/"]+)', html):
            if target != host:
                links[host, target] = links.get((host, target), 0) + 1
    trust = brute_rank([(a, b, n) for (a, b), n in links.items()], seeds["allow"])
    distrust = brute_rank([(b, a, n) for (a, b), n in links.items()], seeds["block"])
    return [
        (k, host, path, best and best[1], best[0] if best else "block" if distrust.get(host, 0) - 2 * trust.get(host, 0) > 1e-3 else "allow")
        for k, host, path, best in found
    ]


@pytest.mark.parametrize("seed", [1])
def test_whole_judgement_against_brute_force_under_any_partitioning(spark, seed):
    pages = linked_pages(seed)
    want = brute_judged(pages)
    assert {"allow", "block"} <= {w[4] for w in want if w[3] is None}
    scores = []
    for parts in (1, 6):
        frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(parts)
        got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in link_trust.judged(frame).collect())
        assert got == want
        scores.append(sorted(link_trust.host_scores(frame).collect()))
    assert scores[0] == scores[1] and scores[0]


def test_links_of_odd_rows(spark):
    docs = odd_documents(spark).withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "url").drop("html")
    docs = docs.withColumn("html", docs["url"])
    assert ids(link_trust.judged(docs).collect(), "page_id") == ALL_IDS
    assert link_trust.judged(docs.limit(0)).collect() == []
