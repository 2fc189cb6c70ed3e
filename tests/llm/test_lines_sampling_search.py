"""Line dedup, importance resampling and ranked search against brute force, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from skysift.llm import linededup, queries, resample, search

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n_lines long, _drops string, score double, rank string, i string, h string, item string"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
ROW = "A line that is long enough to be counted, number "


def low(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(t):
    return WORD.findall(low(t).encode())


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def bench(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a long text, ties, repeated rows and columns with clashing names."""
    shared = [ROW + str(k) for k in range(3)]
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "\n".join(shared)), (4, "\n".join(shared)), (5, shared[0].upper() + " \n" + shared[1]), (None, shared[0]), (None, "other\n" + shared[0] + "\r\n"), (6, (shared[2] + "\n") * 20000 + "end"), (7, "É" * 50 + "\n" + shared[0]), (8, "one\n\n" + shared[0] + "\nÉ" + shared[1]), (9, "\x0b" + shared[1] + "\n" + shared[2] + "\nx"), (10, shared[1]), (11, "word " * 25), (12, "word " * 25)]
    return spark.createDataFrame([(i, t, "en", -1, "d", 0.5, "r", "i", "h", "x") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 11: lines


def kept_lines(rows, least=40, documents=5):
    """(n_lines, n_dropped, text) of each row."""
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(i)
    top = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in held.items() if len(v) >= documents}
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        some = [x for x in every if top.get(key(x), i) == i]
        out.append((i, len(every), len(every) - len(some), "\n".join(some)))
    return sorted(out, key=str)


def test_line_dedup_query_equals_brute_force(spark, docs):
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in kept_lines(docs)]
    got = sorted(map(tuple, queries.op11_line_dedup(spark, SF).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)
    assert got == want


@pytest.mark.parametrize("most", [500_000, 2, 1])
@pytest.mark.parametrize("documents", [1, 3, 5])
def test_line_dedup_odd_rows(spark, odd, most, documents):
    """Also where shared hashes are too many to be broadcast."""
    found = linededup.deduplicated(odd, documents=documents, most=most)
    assert set(odd.columns) < set(found.columns) and "_n_lines" in found.columns
    got = sorted([(r.doc_id, r["_n_lines"], r.n_dropped, r.text) for r in found.collect()], key=str)
    assert got == kept_lines([(r.doc_id, r.text) for r in odd.collect()], documents=documents)
    assert {(r["n_lines"], r["_drops"]) for r in found.collect()} == {(-1, "d")}


def test_line_dedup_of_nothing(none):
    assert linededup.deduplicated(none).count() == 0


# 12: resampling


def features(t, most=2):
    w = words(t)
    return [zlib.crc32(b" ".join(w[j : j + k])) % 10_000 for k in range(1, most + 1) for j in range(len(w) - k + 1)], len(w)


def sampled(rows, target, share=25, least=20, seed=7, most=2):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(features(x, most)[0])
    for x in target:
        t.update(features(x, most)[0])
    a, b = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (a + 10000) / ((s[k] + 1) * (b + 10000)))) for k in range(10_000)]
    out = []
    for i, x in rows:
        f, n = features(x, most)
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    good = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, good[: share * len(good) // 100]


def test_resampling_query_equals_brute_force(spark, docs, bench):
    every, drawn = sampled(docs, [t for _, t in bench])
    place = {r[0]: k for k, r in enumerate(drawn, 1)}
    got = {tuple(r) for r in queries.op12_importance_resampling(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()}
    assert got == {(*r[:4], place.get(r[0])) for r in every} and place


@pytest.mark.parametrize("most", [1, 3])
def test_resampling_odd_rows(spark, odd, none, monkeypatch, most):
    monkeypatch.setattr(resample, "RANGE", 2)  # several ranges of the order
    target = ["word word A line that", None, ""]
    found = resample.resampled(odd, spark.createDataFrame([(t,) for t in target], "text string"), share=60, most=most)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    every, drawn = sampled(rows, target, share=60, most=most)
    got = found.select("doc_id", "n_features", "weight", "_score", "n_words", "_rank").collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(every, key=str)
    ranked = sorted((r["_rank"], r.doc_id) for r in got if r["_rank"] is not None)
    assert [r for r, _ in ranked] == list(range(1, len(drawn) + 1)) and [i for _, i in ranked] == [r[0] for r in drawn]
    assert {r["rank"] for r in found.collect()} == {"r"}
    assert resample.resampled(none, none).count() == 0
    assert resample.resampled(odd, none).count() == odd.count()


def test_tuples_are_hashed_as_their_bytes(monkeypatch):
    monkeypatch.setattr(resample, "WORDS", 3)  # the dictionary starts afresh
    seen = resample.Dictionary()
    texts = ["Eins zwei DREI eins zwei", "", "É é 世界 a1 b-c " + "x" * 300 + " y", None, "w"]
    for _ in range(2):
        at, of, n = resample.features(texts, seen, 4, 10_000)
        want = Counter((i, b) for i, t in enumerate(texts) for b in features(t, 4)[0])
        assert Counter(zip(of.tolist(), at.tolist(), strict=True)) == want and n.tolist() == [len(words(t)) for t in texts]


# 13: search


def best(rows, items, top=10):
    terms = [Counter(words(t)) for _, t in rows]
    n = [sum(c.values()) for c in terms]
    docs_, total = sum(x > 0 for x in n), sum(n)
    holding = Counter(w for c in terms for w in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(words(t))
    out = set()
    for i, ws in asked.items():
        scores = []
        for (d, _), c, size in zip(rows, terms, n, strict=True):
            m = 100 - 90 + (90 * size * docs_) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * docs_ + 2) / (2 * holding[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w in ws if c[w])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out |= {(i, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1)}
    return out


def test_search_query_equals_brute_force(spark, docs, bench):
    got = {tuple(r) for r in queries.op13_ranked_search(spark, SF).select("item_id", "rank", "doc_id", "score").collect()}
    assert got == best(docs, bench)


@pytest.mark.parametrize("terms", [500_000, 4])
def test_search_odd_rows_in_blocks(spark, odd, none, monkeypatch, terms):
    monkeypatch.setattr(search, "DOCS", 3)  # several blocks of documents
    items = [(1, "one LINE that is"), (1, "word"), (2, "É line; counted\nnumber 1"), (3, None), (4, ""), (5, "absent"), (None, "end other"), (6, "word line one")]
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = {tuple(r) for r in search.ranked(odd, asked, top=4, terms=terms).select("item_id", "rank", "doc_id", "score").collect()}
    assert got == best(rows, items, top=4) and None in {g[2] for g in got} | {None}
    assert search.ranked(none, asked).count() == 0 and search.ranked(odd, asked.limit(0)).count() == 0


def test_search_keeps_the_best_of_many_ties(spark, monkeypatch):
    monkeypatch.setattr(search, "DOCS", 7)
    rng = random.Random(5)
    rows = [(i, rng.choice(["same text here", "same text", "nothing"])) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = [(0, "same"), (1, "text here"), (2, "nothing same")]
    got = {tuple(r) for r in search.ranked(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == best(rows, items)
