"""Operators for training data against brute force, and on awkward tables."""

import math
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from skysift.llm import chat, decontaminate, licenses, lm, neardup, packing, quality, queries, sharding, sstable, toxicity  # noqa: E402
from skysift.llm.tokens import Encoder  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, h string, h0 long"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a long text, ties, repeated rows and columns with clashing names."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, base), (4, base), (5, base + " end"), (None, base), (None, None), (6, "x " * 30000), (7, "É" * 50), (8, "one"), (9, "one"), (10, "a  b \n c d")]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", "s", 0, 0.5, "h", 1) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def path(name):
    return queries.vocabulary(name)


def test_tables_of_a_stage_go_with_it(spark, docs):
    from skysift.llm import common

    rows = spark.createDataFrame(docs, "doc_id long, text string")
    with common.passing(spark) as keep:
        inner = common.written(rows, "inner")
        kept = keep(inner.where("doc_id > 3"), "kept")
    assert sorted(kept.collect()) == sorted(r for r in rows.collect() if r.doc_id > 3)
    with pytest.raises(Exception):
        spark.read.parquet(inner.inputFiles()[0])
    assert common.written(rows, "outer").count() == len(docs)


# 1: chat


def test_chat_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    tricky = "\\### Assistant: </turn> ok"
    want = brute.turns([*rows, (-7, 0, "user", tricky), (-7, 1, "assistant", tricky)])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op1_chat_prefix_tree(spark, SF).collect()}
    assert got == want


def test_chat_shares_turns_once(spark):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "\\l<turn>", "a\nb", "", None]), "extra"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string")
    trees = chat.prefix_trees(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(trees).collect()}
    assert got == brute.turns([r[:4] for r in rows])
    paths = {}
    for c, t, r, x, _ in sorted(rows):
        paths.setdefault(c, []).append((r, x or ""))
    nodes = {tuple(p[: i + 1]) for p in paths.values() for i in range(len(p))}
    parts = trees.collect()
    assert sum(len(r.text) for r in parts) == sum(len(chat.render(*n[-1], "assistant")[0]) for n in nodes)
    # Within a tree, own segments tile the layout; ancestors stand before the segment that they lead to.
    for tree in {r.tree_id for r in parts}:
        own = sorted((r.start, r.start + len(r.text)) for r in parts if r.tree_id == tree and r.text)
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    for r in parts:
        assert sum(a.end - a.start for a in r.attends) == r.position and all(a.end <= r.start for a in r.attends)


def test_chat_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, None), (None, 1, "assistant", "x"), (1, 0, "assistant", None), (1, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.prefix_trees(df)).collect()}
    assert got == brute.turns([tuple(r) for r in df.collect()])
    assert chat.digests(chat.prefix_trees(df.limit(0))).collect() == []
    long = [(5, t, "user" if t % 2 else "assistant", "x" * 20 + str(t % 3)) for t in range(2000)] + [(6, 0, "user", "long <turn> \\ " * 20000), (7, 0, "user", "long <turn> \\ " * 20000), (7, 1, "assistant", None)]
    wide = spark.createDataFrame([(*r, "p", 1, "s", 2) for r in long], "conv_id long, turn long, role string, text string, path string, part long, tree_id string, start long")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.prefix_trees(wide)).collect()}
    assert got == brute.turns(long)


def test_chat_escapes_are_reversible():
    for text in ["", "\\", "<", "</turn>\n", "\\l", "a\\\\<b", "\n"]:
        assert chat.unescape(chat.escape(text, True)) == text
        assert chat.parse(chat.render("r\n<", text, "r")[0]) == [("r\n<", text)]


# 2: decontamination


def test_decontamination_equals_brute_force(spark, docs):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(map(tuple, queries.op2_decontamination(spark, SF).collect())) == sorted(brute.contamination(docs, bench))


@pytest.mark.parametrize("bound", [0, 1000])
def test_decontamination_short_items_and_ties(spark, odd, bound, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", bound)
    items = [(1, "one"), (2, "alpha beta"), (2, "x x"), (3, "gamma delta epsilon zeta eta theta iota kappa lambda mu nu"), (None, "rho sigma tau"), (4, ""), (5, None), (1, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.hits(odd, bench)
    want = brute.contamination([(r.doc_id, r.text) for r in odd.collect()], items)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got.collect()), key=key) == sorted((w[:4] for w in want), key=key)
    assert decontaminate.clean(odd, got).where("text = 'one'").count() == 0


@pytest.mark.parametrize("window", [4, 7, 10, 13, 20])
def test_decontamination_of_any_window(spark, window):
    """Texts that hold an item whole, without its middle words, with other ones there, and in part."""
    rng = random.Random(window)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 30)))) for i in range(30)]
    docs = []
    for i, t in items:
        w = t.split()
        m = len(w) // 2
        for k, x in enumerate([w, w[: m - 1] + [word(), word()] + w[m + 1 :], w[:m] + w[m + 1 :], w[: m + 3], w[1:] + w]):
            docs.append((10 * i + k, " ".join([word(), word(), *x, word()])))
    got = decontaminate.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=window)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got.collect()) == sorted(w[:4] for w in brute.contamination(docs, items, window))


def test_decontamination_empty_tables(spark, odd, none):
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert decontaminate.hits(none, bench).count() == 0
    assert decontaminate.hits(odd, bench.limit(0)).where("n_hit > 0").count() == 0 and decontaminate.hits(odd, bench.limit(0)).count() == odd.count()


# 3: token shards


def test_token_shards_equal_direct_encoding(spark, docs):
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(path("word_bpe_49k.json")), 0
    got = {r.doc_id: tuple(r)[1:] for r in queries.op3_token_shards(spark, SF).collect()}
    for i, t in sorted(docs):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_shards_look_up(spark, odd, none, tmp_path):
    manifest = sstable.write_shards(odd, f"file://{tmp_path}", path("word_bpe_49k.json"), 2, shards=3).collect()
    assert sum(r.docs for r in manifest) == odd.count() and not list(tmp_path.glob(".part*"))
    shards = [sstable.open_shard(r.path) for r in manifest]
    find = lambda i: [ids for s in shards for ids in s.get(sstable.key_of(i))]
    assert len(find(4)) == 2 and len(find(None)) == 2 and len(find(8)) == 1 and find(99) == []
    keys = [k for s in shards for k, _, _ in s]
    assert keys == sorted(keys) and sstable.id_of(sstable.key_of(-5)) == -5
    assert sstable.write_shards(none, f"file://{tmp_path}/e", path("word_bpe_49k.json"), 2).count() == 0


def test_shard_blocks_and_damage(tmp_path):
    import pyarrow.fs as pafs

    with open(tmp_path / "s", "wb") as f:
        w = sstable.ShardWriter(f, block_bytes=64)
        for i in range(500):
            w.add(sstable.key_of(i * 3), np.arange(i % 7, dtype="<u4").tobytes())
        with pytest.raises(ValueError):
            w.add(sstable.key_of(0), b"")
        with pytest.raises(ValueError):
            w.add(sstable.key_of(9999), np.array([1 << 16], "<u4").tobytes())
        w.close()
    shard = sstable.Shard(pafs.LocalFileSystem().open_input_file(str(tmp_path / "s")))
    assert len(shard.blocks) > 10 and all(len(shard.get(sstable.key_of(i))) == (i % 3 == 0) for i in range(1500))
    raw = bytearray((tmp_path / "s").read_bytes())
    raw[-sstable.FOOTER.size - 3] ^= 1
    (tmp_path / "t").write_bytes(raw)
    with pytest.raises(ValueError):
        sstable.Shard(pafs.LocalFileSystem().open_input_file(str(tmp_path / "t")))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_encoding_is_exact(name):
    e, rng = Encoder(path(name)), random.Random(5)
    parts = [" ", "  ", "\n", "\t", "a", "B.", "'s", "é", "É", "日本", " ", "\x1c", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "12", "it's", "dont'T", "Ünïcö", "word", "ÀÿÖ", "Σ", "é", "ab", "ſ", "İ", ""]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path(name))
    direct = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert e.encode([*texts, None]) == [*direct, b""] == e.encode([*texts, None])
    control = e.encode(["a<|endoftext|>b"])[0]
    assert np.frombuffer(control, "<u4")[1] == tok.token_to_id("<|endoftext|>")
    plain = Encoder(path(name), ordinary=True)
    assert tok.token_to_id("<|endoftext|>") not in np.frombuffer(plain.encode(["a<|endoftext|>b"])[0], "<u4") and plain.encode(texts) == [*map(plain.whole, texts)]


# 4: near-duplicates


def test_word_hashes_tell_words_apart(docs):
    from skysift.llm.hashing import hashed

    texts = [t for _, t in docs[:80]] + [None, "", " \t\n", "A a Ä ä", "\x1cx\x00", "x" * 70000 + " " + "x" * 70001, "a b\x0bc\x0cd\re"]
    h, sizes = hashed(texts)
    words = [brute.RUN.findall(brute.low(t)) for t in texts]
    assert sizes.tolist() == [len(w) for w in words] and len(h) == sum(sizes)
    by = {}
    for w, x in zip([x for w in words for x in w], h.tolist()):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(spark, docs, k):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(spark.createDataFrame(docs, "doc_id long, text string"), k).collect()}
    assert got == brute.near(docs, k)


def test_near_duplicates_in_a_crowd(spark):
    """One large group of near copies, exact copies, and a passage that unrelated documents share."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, shared, out = [word() for _ in range(120)], [word() for _ in range(60)], []
    for i in range(150):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(120)] = word()
        out.append((i, " ".join(w)))
    out += [(200 + i, " ".join(shared + [word() for _ in range(60)])) for i in range(100)]
    out += [(400 + i, " ".join(base)) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(spark.createDataFrame(out, "doc_id long, text string"), 5).collect()}
    assert got == brute.near(out, 5)


@pytest.mark.parametrize("links", [20, 1_000_000])
def test_near_duplicates_among_many_that_are_nearly_linked(spark, links, monkeypatch):
    """2,000 texts with a common core, 0.767 alike, of which 200 have a partner at 0.805; and copies with more and more edits."""
    monkeypatch.setattr(neardup, "LINKS", links)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    core, out = [word() for _ in range(300)], []
    for i in range(2000):
        out.append((i, " ".join(core + [word() for _ in range(45)])))
    for i in range(200):
        w = out[i][1].split()
        out.append((3000 + i, " ".join(w[:309] + [word() for _ in range(36)])))
    base = [word() for _ in range(120)]
    for i in range(400):
        w = list(base)
        for _ in range(i % 9):
            w[rng.randrange(120)] = word()
        out.append((5000 + i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(spark.createDataFrame(out, "doc_id long, text string"), 5).collect()}
    want = brute.near_dense(out, 5)
    assert sum(c < 2000 <= i < 4000 for i, (_, c) in want.items()) == 200
    assert got == want


def test_helper_named_columns_stay(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(1, text, "x", 5, 6), (2, text, "y", 7, 8), (3, "other words", "z", 9, 1)], "doc_id long, text string, _id string, _hash long, node long")
    assert sorted(map(tuple, neardup.deduplicated(df).collect())) == [(1, text, "x", 5, 6), (3, "other words", "z", 9, 1)]


def test_near_duplicates_odd_rows(spark, odd, none):
    got = neardup.groups(odd, 4).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == odd.count() and by[4][0].component_id == 4 and by[5][0].component_id == 4
    assert by[1][0].component_id == 1 and by[2][0].n_shingles == 0 and by[9][0].component_id == 8
    assert sorted(str(r.component_id) for r in by[None]) == ["4", "None"]
    left = [(r.doc_id, r.text) for r in neardup.deduplicated(odd, 4).collect()]
    assert sorted(str(i) for i, _ in left) == ["1", "10", "2", "3", "4", "6", "7", "8", "None"]
    assert neardup.groups(none, 4).count() == 0 and neardup.deduplicated(none, 4).count() == 0


# 5: toxicity


def test_toxicity_learns_and_keeps_to_the_text(spark, odd, none):
    rng = random.Random(1)
    word = lambda: "w%d" % rng.randrange(300)
    rows = []
    for i in range(700):
        w = [word() for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            w[rng.randrange(40)] = rng.choice(["vile", "vilest", "grim"])
        rows.append((i, " ".join(w), "en" if i % 3 else None, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, y int")
    labels = df.select("doc_id", df.y.alias("toxic"))
    model = toxicity.train(df, labels)
    got = toxicity.scored(df, model).collect()
    held = [(r.score >= 0.5) == bool(r.y) for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and sum(held) / len(held) > 0.95
    scores = toxicity.scored(odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    one = [r.score for r in scores if r.text == "one"]
    assert math.isclose(*one) and toxicity.scored(none, model).count() == 0
    assert toxicity.scored(odd, toxicity.train(odd, labels.limit(0))).where("toxic").count() == 0


@pytest.mark.parametrize("text", ["", None, "one", "a b c d e f", "word " * 40])
def test_toxicity_scores_equal_a_plain_convolution(text):
    """Scores from tables against sums of embeddings, window by window."""
    rng = np.random.default_rng(2)
    known = rng.random(toxicity.BUCKETS) < 0.7
    known[toxicity.RARE] = False
    m = toxicity.Model(known)
    m.p["out"] += 1
    m.ready()
    words = [w for w in licenses.words_of(text)]
    rows = [[toxicity._buckets.rows[toxicity._buckets[w]].tolist()] for w in words]
    e = [sum(m.p["e"][b] for b in r[0] if known[b]) + 0 * m.p["e"][0] for r in rows] + [0 * m.p["e"][0]] * 3
    z = float(m.p["bias"][0])
    for n, w in enumerate(toxicity.WIDTHS):
        tops = [max(max(sum(e[i + j] @ m.p[f"w{w}"][j][:, f] for j in range(w)) for i in range(len(e) - w + 1)) + m.p[f"b{w}"][f], 0) for f in range(toxicity.FILTERS)]
        z += float(np.dot(tops, m.p["out"][n * toxicity.FILTERS : (n + 1) * toxicity.FILTERS]))
    assert math.isclose(m.score([text, "other text"])[0], 1 / (1 + math.exp(-z)), rel_tol=1e-4)


def test_toxicity_sample_passes_over_a_text_without_room(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 4000)
    rows = [(i, "x" * (5000 if i % 3 == 0 else 50), "en") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    got = toxicity.sample(df, labels, 5)
    for t in (0, 1):
        mine = [r for r in got if r["_toxic"] == t]
        want = [i for i, x, _ in rows if i % 2 == t and len(x) == 50 and zlib.crc32(str(i).encode()) % 5]
        assert len(mine) == min(len(want), 40) and all(len(r.text) == 50 for r in mine)


def test_toxicity_query(spark):
    got = queries.op5_toxicity(spark, SF)
    assert got.count() == 200 and got.where("predicted <> int(score >= 0.5)").count() == 0


# 6: quality


def test_quality_measures_equal_brute_force(spark, docs, odd):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in queries.op6_quality_rules(spark, SF).collect()}
    assert got == {i: brute.measures(t) for i, t in docs}
    for r in odd.collect():
        assert quality.measures_of(r.text)[:5] == brute.measures(r.text)


def test_quality_cutoffs_hold_their_risk():
    assert math.isclose(quality.tail(0, 100, 0.05), 0.95**100) and quality.tail(5, 5, 0.1) == 1
    rows = {"symbols": [(48, 3000, 0), (20, 2, 50), (0, 0, 40)], "capitals": [(48, 3000, 60), (10, 2, 30)]}
    path = quality.path_of(rows)
    assert path[0] == ("symbols", 0) and {r for r, _ in path} == set(rows) and [i for r, i in path if r == "symbols"] == [0, 20]
    assert quality.choose([(0, 40), (2, 30), (2, 50)], 3000, 0.005, 0.05) == 3
    assert quality.choose([(0, 40), (2, 30), (50, 50)], 3000, 0.005, 0.05) == 2
    assert quality.choose([(0, 40)], 30, 0.005, 0.05) == 0  # too few good documents to vouch for any step


def test_quality_verdicts_equal_brute_force(spark):
    """Cutoffs and verdicts from scratch, on documents where two rules tell good from bad."""
    rng = random.Random(8)
    rows = []
    for i in range(8000):
        good = int(rng.random() < 0.8)
        w = ["word"[: 1 + (k * 7 + i) % 4] + str(k * i % 97) for k in range(60)]
        for k in range(0 if good and rng.random() < 0.999 else rng.randint(0, 25)):
            w[k] = rng.choice(["#$%&", "LOUD"])
        rows.append((i, " ".join(w), "en" if i % 2 else None, good))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    got = {r.doc_id: (r.kept, r.reasons) for r in quality.verdicts(df.drop("quality"), df.select("doc_id", "quality")).collect()}
    measures, value = {i: dict(zip([n for n, _ in quality._MEASURES], quality.measures_of(t))) for i, t, _, _ in rows}, {}
    for i, m in measures.items():
        n = max(1, m["n_words"])
        value[i] = {"symbols": m["n_symbols"] / n, "repeats": m["n_repeat_words"] / n, "duplicate_lines": m["n_dup_lines"] / max(1, m["n_lines"]), "capitals": m["n_upper_words"] / n, "single_letters": m["n_bare_words"] / n}
    passing = {i for i, m in measures.items() if m["n_words"] >= 50 and 100 * m["n_repeat_words"] <= 50 * m["n_words"]}
    binom = lambda k, n, p: sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
    cuts = {}
    for lang in ("en", None):
        own = [(i, g) for i, _, l, g in rows if l == lang and i in passing]
        half = {h: [(i, g) for i, g in own if zlib.crc32(str(i).encode()) % 2 == h] for h in (0, 1)}
        counts = {r: [(sum(value[i][r] <= c for c in quality.CUTOFFS), g, 1 - g) for i, g in half[0]] for r in quality.RULES}
        path, best, cut, total = quality.path_of(counts), 0, {}, sum(g for _, g in half[1])
        for at in range(1, len(path) + 1):
            now = {r: quality.CUTOFFS[c] for r, c in path[:at]}
            out = [g for i, g in half[1] if any(value[i][r] > c for r, c in now.items())]
            if binom(sum(out), total, 0.005) > 0.05 / 2:
                break
            if (gain := len(out) - sum(out) - quality.GOOD_WEIGHT * sum(out)) > best:
                best, cut = gain, now
        cuts[lang] = cut
    assert cuts["en"] and cuts[None]
    for i, _, lang, _ in rows:
        reasons = sorted(r for r, c in cuts[lang].items() if value[i][r] > c)
        assert got[i] == (i in passing and not reasons, reasons)


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1)], "doc_id long, quality int")
    got = quality.verdicts(odd, labels)
    want = sorted((str(r.doc_id), *brute.measures(r.text)) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect()) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in got.collect())
    assert quality.verdicts(none, labels).count() == 0 and quality.verdicts(odd, labels.limit(0)).count() == odd.count()


def test_quality_bounds_count_a_repeated_document_once(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=60)) + (" #$% " * 12 if i % 8 == 0 else ""), "en", int(i % 8 != 0)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    labels = df.select("doc_id", "quality")
    once, twice = (quality.calibrate(quality.measure(x, ["lang"]), labels, "lang", 0.005, 0.05) for x in (df, df.unionByName(df).unionByName(df)))
    assert once and once == twice
    few = df.where("doc_id < 1200")
    assert quality.calibrate(quality.measure(few.unionByName(few).unionByName(few).unionByName(few), ["lang"]), labels, "lang", 0.005, 0.05) == quality.calibrate(quality.measure(few, ["lang"]), labels, "lang", 0.005, 0.05)


# 7: language model


@pytest.mark.parametrize("top", [5, 2_000_000])
def test_base_scores_equal_brute_force(spark, docs, top, monkeypatch):
    monkeypatch.setattr(lm, "TOP", top)
    tokens = {i: [*brute.RUN.findall(brute.low(t)), None] for i, t in docs}
    c = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(c.values()), len(c)
    got = queries.op7_lm_score(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 1.3 * sum(r.base_score for r in held)


def test_filter_reads_levels_back():
    counts = np.array([1, 2, 3, 10, 1000])
    levels = lm.levels(counts, 1)
    assert levels[0] == 1 and (np.diff(levels) > 0).all()
    back = lm.count_of(levels, 1)
    assert (np.abs(np.log(back / counts)) < math.log(lm.BASE)).all() and lm.count_of(np.array([0]), 1)[0] == 0
    keys = lm.unigram_keys(np.arange(5, dtype=np.uint64))
    bits = np.zeros(1 << 12, np.uint8)
    f = lm.Filter(bits, 1)
    for k, top in zip(keys, levels):
        for level in range(1, top + 1):
            for at in lm.Filter.places(np.array([k]), level, f.size):
                bits[int(at[0]) >> 3] |= 1 << (int(at[0]) & 7)
    assert (f.levels(keys) >= levels).all() and (f.levels(keys) == levels).sum() >= 4


def test_toxicity_thresholds_come_from_all_labelled_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 60)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["good", "day", "tea", "walk"], k=6) + rng.choices(["foul", "day"], [4, 1] if i % 5 == 0 else [1, 40])), "ab"[i % 2], int(i % 5 == 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert set(model.thresholds) == {None, "a", "b"}
    found = toxicity.counted(df.drop("toxic"), df.select("doc_id", "toxic"), 5, model.trial, model.seen)
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    assert sum(r.unseen for r in found) == len(kept) - len(model.seen) and len(model.seen) < 60
    assert {(r.lang, r.toxic): r.n for r in found} == Counter((lang, t) for _, _, lang, t in kept)


def test_lm_scores_do_not_change_with_the_filter_that_is_broadcast(spark, docs, monkeypatch):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = {r.doc_id: tuple(r) for r in lm.score(df).collect()}
    monkeypatch.setattr(lm, "FILTER_BITS", 1 << 12)
    monkeypatch.setattr(lm, "HELD", 1 << 14)
    monkeypatch.setattr(lm, "ASKED", 100_000)
    got = {r.doc_id: tuple(r) for r in lm.score(df).collect()}
    assert got.keys() == want.keys()
    assert all(a[:6] == b[:6] and math.isclose(a[6], b[6], rel_tol=1e-9) for a, b in ((got[i], want[i]) for i in want))


def test_lm_knows_bigrams_that_occur_once(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choices(["a", "b", "c", f"w{i}", f"v{i}"], k=5))) for i in range(60)]
    train = [t.split() for i, t in texts if zlib.crc32(str(i).encode()) % 10]
    uni = Counter(w for t in train for w in [*t, ""])
    bi = Counter(p for t in train for p in zip(["", *t], [*t, ""]))
    mass = Counter()
    for (h, _), n in bi.items():
        mass[h] += n - lm.DISCOUNT
    total, kinds = sum(uni.values()), len(uni)
    for r in lm.score(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        t = dict(texts)[r.doc_id].split()
        want = 0.0
        for h, w in zip(["", *t], [*t, ""]):
            p = (uni[w] + 0.1) / (total + 0.1 * (kinds + 1))
            want += math.log10(max(bi[h, w] - lm.DISCOUNT, 0) / uni[h] + (1 - mass[h] / uni[h]) * p if uni[h] else p)
        assert abs(r.score - want) < 0.12 * r.n_tokens


def test_lm_scores_on_documents_equal_exact_counts(spark, docs):
    """Counts are read back in steps of a quarter, so a token's probability is right within a few hundredths."""
    tokens = {i: [w.lower() if w.isascii() else w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in brute.RUN.findall(t or "")] for i, t in docs}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10]
    uni = Counter(w for t in train for w in [*t, ""])
    bi = Counter(p for t in train for p in zip(["", *t], [*t, ""], strict=True))
    mass = Counter()
    for (h, _), n in bi.items():
        mass[h] += n - lm.DISCOUNT
    total, kinds = sum(uni.values()), len(uni)
    off, wants, gots = [], [], []
    for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        t, want = tokens[r.doc_id], 0.0
        for h, w in zip(["", *t], [*t, ""], strict=True):
            p = (uni[w] + 0.1) / (total + 0.1 * (kinds + 1))
            want += math.log10(max(bi[h, w] - lm.DISCOUNT, 0) / uni[h] + (1 - mass[h] / uni[h]) * p if uni[h] else p)
        off.append(abs(r.score - want) / r.n_tokens)
        wants.append(want / r.n_tokens)
        gots.append(r.score / r.n_tokens)
    assert np.mean(off) < 0.04 and max(off) < 0.15 and np.corrcoef(wants, gots)[0, 1] > 0.99


@pytest.mark.parametrize("top", [lm.TOP, 50])
def test_lm_base_scores_need_no_model(spark, docs, monkeypatch, top):
    """The same rows as with it, whether all words are frequent or some are joined; no bigram is counted."""
    monkeypatch.setattr(lm, "TOP", top)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = {r.doc_id: tuple(r)[:6] for r in lm.score(df).collect()}
    monkeypatch.setattr(lm, "bigram_keys", None)
    got = {r.doc_id: tuple(r) for r in lm.base_scores(df).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][:5] == want[i][:5] and math.isclose(got[i][5], want[i][5], rel_tol=1e-12) for i in want)


def test_lm_odd_rows(spark, odd, none):
    got = lm.score(odd).collect()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(brute.RUN.findall(t or "")) + 1) for i, t in texts)
    assert all(r.score < 0 and r.base_score < 0 and r.n_known <= r.n_tokens for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1 and [r.doc_id for r in got].count(4) == 2  # a row each, scored alike
    assert lm.score(none).count() == 0


# 8: licenses


def test_phrases_equal_brute_force(spark, docs):
    for r in queries.op8_license_scan(spark, SF).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.phrases(dict(docs)[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_automaton_finds_the_longest_matches():
    rng = random.Random(2)
    templates = [[rng.randrange(4) for _ in range(rng.randint(3, 25))] for _ in range(5)]
    a = licenses.Automaton(templates)
    inside = lambda s: any(t[i : i + len(s)] == s for t in templates for i in range(len(t) - len(s) + 1))
    for _ in range(40):
        text = [rng.randrange(5) for _ in range(40)]
        lengths = [max(n for n in range(i + 2) if inside(text[i + 1 - n : i + 1])) for i in range(40)]
        want = [(i, lengths[i]) for i in range(40) if lengths[i] >= 2 and (i == 39 or lengths[i + 1] <= lengths[i])]
        got = a.matches(text, 2)
        assert [(i, n) for i, n, _ in got] == want
        for i, n, state in got:
            for t, places in a.ends[state].items():
                assert all(templates[t][p - n + 1 : p + 1] == text[i - n + 1 : i + 1] for p in places)


def test_license_text_with_gaps_and_none(spark, odd, none):
    mit = licenses.TEMPLATES[0][1]
    words = mit.split()
    broken = " ".join([*words[:30], "inserted", "words", *words[30:]])
    s = licenses.Scanner()
    assert "mit-text" in s.scan(mit)[5] and "mit-text" in s.scan(broken)[5] and s.scan("the software is nice and of a kind")[5] == ""
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0 and s.scan(None)[:4] == (0, 0, None, None)


# 9: sharding


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.arange(20000) * 2654435761
    for n in (1, 2, 7, 16):
        a, b = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        assert a.max() < n and set(b[a != b]) <= {n}
        assert abs((a != b).mean() - 1 / (n + 1)) < 0.02 and np.bincount(a, minlength=n).min() > 0.8 * len(keys) / n


def test_jump_hash_equals_the_published_loop():
    def one(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    rng = random.Random(1)
    keys = np.array([rng.randrange(-(1 << 63), 1 << 63) for _ in range(500)] + [0, -1, 1, -(1 << 63)], np.int64)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [one(int(k) & (1 << 64) - 1, n) for k in keys]


def test_sharded_files_and_helper_names(spark, docs, tmp_path):
    df = spark.createDataFrame([(i, t, i * 2) for i, t in docs[:50]], "doc_id long, text string, _row long")
    got = sharding.assign(df, 4, keep=["_row"]).collect()
    assert all(r["_row"] == 2 * r.doc_id for r in got) and len(got) == 50
    sharding.write_sharded(df, f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in got}


def test_sharding_query(spark, docs, odd, none):
    got = queries.op9_sharding(spark, SF).collect()
    text = dict(docs)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw)) and r.grown_shard in (r.shard, 16) and r.law == "key"
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    rows = sharding.assign(odd, 4).collect()
    assert len(rows) == odd.count() and len({r.shard for r in rows if r.doc_id == 4}) == 1 and len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert sharding.assign(none).count() == 0


# 10: packing


def test_fullest_equals_brute_force():
    from itertools import product

    rng = random.Random(4)
    for _ in range(60):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(0, 25)
        best = max(s for ks in product(*[range(c + 1) for c in counts.values()]) if (s := sum(n * k for n, k in zip(counts, ks))) <= room)
        used = packing.fullest(room, counts, sorted(counts, reverse=True))
        assert sum(n * k for n, k in used.items()) == best and all(k <= counts[n] for n, k in used.items())


def check_packed(rows, ids_of, capacity):
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for b in bins.values():
        b.sort()
        assert all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and b[0][0] == 0 and sum(n for _, n in b) <= capacity
    for i, ps in pieces.items():
        ps.sort()
        ids = ids_of(i)
        assert sum(p[2] for p in ps) == len(ids) and [p[0] for p in ps] == list(range(len(ps)))
        assert all(zlib.crc32(ids[p[1] : p[1] + p[2]].tobytes()) == p[3] for p in ps) and all(p[2] == capacity for p in ps[1:])
    return len(bins)


def test_packing_query(spark, docs):
    from tokenizers import Tokenizer

    tok, text = Tokenizer.from_file(path("byte_bpe_50k.json")), dict(docs)
    ids_of = lambda i: np.array([*tok.encode(text[i] or "", add_special_tokens=False).ids, 0], "<u4")
    rows = queries.op10_packing(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(text)
    n = check_packed(rows, ids_of, 2048)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_odd_rows(spark, odd, none):
    rows = packing.pack(odd, path("byte_bpe_50k.json"), 0, 64).collect()
    assert sum(r.doc_id == 4 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 2
    used = Counter((r.sequence_id, o) for r in rows for o in range(r.offset, r.offset + r.length))
    assert max(used.values()) == 1 and packing.pack(none, path("byte_bpe_50k.json"), 0).count() == 0


# The pipeline


def test_pipeline_stages_equal_brute_force(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*p.COLUMNS)
    for name, stage in p.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == p.COLUMNS
            docs = spark.createDataFrame(out.collect(), out.schema)
            left = {r.doc_id: r.text for r in docs.collect()}
            assert all(before[i] == t for i, t in left.items())
        gone = set(before) - set(left)
        if name == "quality":
            m = {i: brute.measures(t) for i, t in before.items()}
            assert {i for i, x in m.items() if x[0] < 50 or 100 * x[4] > 50 * x[0]} <= gone
        elif name == "near_duplicates":
            assert gone == {i for i, (_, c) in brute.near(list(before.items()), 5).items() if c != i}
        elif name == "decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert gone == {r[0] for r in brute.contamination(list(before.items()), bench) if r[5]}
        elif name == "packing":
            assert {r.doc_id for r in out.collect()} == set(before)


def test_pipeline_stages_on_odd_rows(spark, odd, none, docs):
    """Nulls, repeats, empties and columns named like the stages' own; then empty tables."""
    import corpus_pipeline as p
    from pyspark.sql import functions as F

    more = spark.createDataFrame([(100 + i, t) for i, t in docs[:40]], "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "null source", "0L n_chars", "0D score", "'h' h", "1L h0")
    table = odd.union(more).union(more.where("doc_id < 103"))
    for x in ("_id", "_hash", "_row", "toxic", "kept", "node"):
        table = table.withColumn(x, F.lit(1))
    for start in (table, none):
        now = start
        for name, stage in p.STAGES:
            # Each stage meets the odd rows themselves, not only what the one before kept.
            out = stage(spark, start, SF)
            assert name == "packing" or out.columns == p.COLUMNS
            n = out.count()
            assert n <= start.count() or name == "packing"
            assert (n == 0) == (start is none) or name == "quality"
            now = stage(spark, now, SF)
            if name != "packing":
                now = spark.createDataFrame(now.collect(), now.schema)
