"""Toxicity, quality, Jaccard join, substring deduplication, token files, decontamination and the pipeline."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolake.llm import boosting, common, decontamination, graph, jaccard_join, quality, registry, substring_dedup, textops, token_files, toxicity
from tests.llm.conftest import AWKWARD, words

LARGE = "/root/testdata/sf0.1"


# Classifiers.


@pytest.mark.parametrize(("name", "label", "least"), [("op1_toxicity", "toxic", 0.97), ("op7_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    rows = registry.QUERIES[name](spark, LARGE).join(common.labels(spark, LARGE), "doc_id").where("held_out").select("predicted", label, "score").collect()
    assert len(rows) > 500 and sum(r["predicted"] == r[label] for r in rows) / len(rows) >= least
    good = [r for r in rows if r[label] == (0 if label == "toxic" else 1)]
    assert sum(r["predicted"] == r[label] for r in good) / len(good) >= 0.99  # clean documents stay


def test_held_out_rows_are_never_learned_from(spark):
    labels = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    from chronolake.llm.training import labelled_sample

    got = labelled_sample(labels, "toxic", 1000).collect()
    assert {r["doc_id"] for r in got} == {k for k in range(100) if zlib.crc32(str(k).encode()) % 5}
    assert labelled_sample(labels, "toxic", 7).count() == 7


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_awkward(spark, awkward, nothing, module, label):
    kinds = f"doc_id long, {label} int"
    for given in ([], [(1, 1)], [(1, 1), (2, 0), (3, 1), (4, None), (None, 1), (6, 0), (7, 0)]):
        model = module.fit(awkward, spark.createDataFrame(given, kinds))
        rows = module.score(awkward, model).collect()
        assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
        assert module.score(nothing, model).count() == 0
        assert sorted(module.score(awkward, model).columns) == sorted(awkward.columns)


def toxic_features(text, terms):
    """The features by their definitions, one word and one character at a time."""
    raw = text.encode()
    w = re.findall(r"[^\W_]+(?:[@$*!0-9]+[^\W\d_]+)*", text.lower())
    n = len(w) or 1
    odds = lambda x: max([terms.get(x, 0.0)] + [terms.get(x[:k] + "-", 0.0) for k in range(3, 9) if k <= len(x)])
    plain = lambda x: "".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}.get(c, c) for c in x).replace("*", "")
    fixed = [i for i, x in enumerate(w) if x in toxicity.INSULTS]
    known = [i for i, x in enumerate(w) if odds(x)]
    hidden = [i for i, x in enumerate(w) if not odds(x) and not x.isalpha() and plain(x) != x and (plain(x) in toxicity.INSULTS or odds(plain(x)))]
    at = sorted({*fixed, *known, *hidden})
    persons = [i for i, x in enumerate(w) if x in toxicity.SECOND_PERSON and x not in toxicity.INSULTS]
    near = sum(any(abs(p - i) <= toxicity.NEAR for p in persons) for i in at)
    upper, lower = sum(c in string.ascii_uppercase for c in text), sum(c in string.ascii_lowercase for c in text)
    marks = sum(c in string.punctuation and c not in "{|}~" for c in text)
    odd = len(re.findall(r"[^\W\d_][@$*0-9]+[^\W\d_]|([^\W\d_])\1\1", text))
    return [
        100 * len(fixed) / n, 100 * len(known) / n, 100 * len(hidden) / n, math.log1p(len(fixed)), math.log1p(len(known)), 100 * sum(odds(w[i]) for i in known) / n,
        max([odds(w[i]) for i in known], default=0.0), math.log1p(len(at)), 100 * near / n, near / len(at) if at else 0.0, 100 * len(persons) / n, upper / (upper + lower or 1),
        marks / len(raw), 100 * text.count("!") / len(raw), 100 * odd / n, len(set(w)) / n, math.log1p(len(w)), len(raw) / n,
    ]


def test_toxicity_features_by_definition(documents):
    terms = {"blurgh": 3.0, "snar-": 2.5, "vile": 4.0, "abcdefgh-": 2.9}
    lexicon, rng = toxicity.Lexicon(terms), random.Random(4)
    some = ["you", "idiot", "1d10t", "st*pid", "snarfle", "snar", "blurgh", "bl*rgh", "vile", "VILE", "du", "dumm", "haaate", "a@b", "fine", "words", "é", "abcdefghij", "l0ser", "!!", "-"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randint(1, 60))) + rng.choice(["", "!!!", " {|}~^`"]) for _ in range(300)]
    for text in texts + [r["text"] for r in documents.limit(100).collect() if r["text"]]:
        assert toxicity.features(text, lexicon) == pytest.approx(toxic_features(text, terms))
    assert toxicity.features("", lexicon) == toxicity.features(None, lexicon) == [0.0] * toxicity.FEATURES


def test_trees_split_where_the_gain_is_largest():
    # One level against every threshold of every feature.
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = ((x[:, 1] > 6) ^ (rng.random(300) < 0.1)).astype(float)
    trees = boosting.Trees(rounds=1, depth=1, bins=64).fit(x, y)
    p = np.full(300, y.mean())
    grad, curve = p - y, p * (1 - p)

    def gain(f, t):
        left = x[:, f] <= t
        part = lambda own: grad[own].sum() ** 2 / (curve[own].sum() + 1)
        return part(left) + part(~left) - part(np.ones(300, bool)) if left.any() and not left.all() else -1

    best = max((gain(f, t), f, t) for f in range(3) for t in np.unique(x[:, f]))
    (feature, limit, value), = trees.trees
    assert feature[0] == best[1] and gain(feature[0], limit[0]) == pytest.approx(best[0])
    left = x[:, feature[0]] <= limit[0]
    assert value[1:3] == pytest.approx([-0.15 * grad[own].sum() / (curve[own].sum() + 1) for own in (left, ~left)])


def convolved(net, text):
    """The network's features by definition: every window of the text's bytes, filled up with zeros to whole chunks."""
    raw = (text or "").encode()
    n = max(1, -(-len(raw) // quality.CHUNK))
    raw += bytes(n * quality.CHUNK + quality.WIDTH - 1 - len(raw))
    best = np.zeros((n, quality.FILTERS))
    for k in range(n * quality.CHUNK):
        value = sum(net.tables[j, raw[k + j]].astype(float) for j in range(quality.WIDTH))
        best[k // quality.CHUNK] = np.maximum(best[k // quality.CHUNK], value)
    return np.concatenate([best.max(0), best.mean(0)])


@pytest.mark.parametrize("length", [0, 1, 127, 128, 129, 133, 5000, 128 * 300 + 1])
def test_quality_reads_every_window(length):
    rng, net = random.Random(length), quality.ByteNet(seed=3)
    text = "".join(chr(rng.randrange(32, 127)) for _ in range(length))
    assert net.features(quality.chunks(text)) == pytest.approx(convolved(net, text), abs=1e-4)
    if length > 200:  # wherever a telling window stands, it is seen
        net.tables[:, 1] = 50
        for at in (0, length // 2, length - 6):
            assert net.features(quality.chunks(text[:at] + "\1" * 6 + text[at + 6 :]))[0] == pytest.approx(300, rel=1e-3)


def test_quality_gradients():
    rng, net = random.Random(1), quality.ByteNet(seed=2)
    texts = ["".join(chr(rng.randrange(97, 110)) for _ in range(n)) for n in (40, 700, 300, 0)] + ["ab " * 200]
    parts, y = [quality.chunks(t) for t in texts], np.array([1, 0, 1, 0, 1], np.float32)

    def loss():
        p = net._head(np.stack([net.features(c) for c in parts]).astype(float))[1]
        return -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    found = net.gradients(parts, y)
    for w, g in zip(net.weights, found):
        own = np.argsort(-np.abs(g).ravel())[:12]
        for k in own.tolist():
            at, step = np.unravel_index(k, w.shape), 2e-3
            before = w[at]
            w[at] = before + step
            up = loss()
            w[at] = before - step
            down = loss()
            w[at] = before
            assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.1, abs=2e-3)


def test_quality_learns_from_a_bounded_sample(spark):
    rows = [(k, "x" * (10 if k % 2 else 4000)) for k in range(40)] + [(1, "x" * 10), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    seen = []
    fit = quality.ByteNet.fit
    try:
        quality.ByteNet.fit = lambda self, c, y, epochs: seen.append((c, y)) or fit(self, c, y, 1)
        quality.fit(docs, labels, most_bytes=9000)
    finally:
        quality.ByteNet.fit = fit
    (chunks, y), held = seen[0], {k for k in range(40) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum(y) == sum(k % 2 for k in range(40) if k not in held) + (3 not in held) and sum(len(c) > 1 for c in chunks) == 2


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(float)
    trees = boosting.Trees().fit(x[:1500], y[:1500])
    assert ((trees.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.97
    curve = boosting.Isotonic().fit(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert list(curve(np.array([0.0, 2.5, 9]))) == [0, 0.5, 1]
    assert (np.diff(curve(np.linspace(0, 5, 50))) >= 0).all()


# Jaccard join.


def brute_components(rows, size=5, percent=75):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for d, t in rows:
        w = words((t or "").translate(low))
        sets.append((d, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    forest = graph.Forest()
    for a, s in sets:
        for b, t in sets:
            if a is not None and b is not None and a < b and s and t and 100 * len(s & t) >= percent * len(s | t):
                forest.join(a, b)
    return Counter((d, len(s), None if d is None else forest.root(d)) for d, s in sets)


def found_components(docs):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect())


def near_copies(seed, groups, copies, length):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [rng.choice("abcdefgh") + str(rng.randint(0, 400)) for _ in range(length)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, length // 25))):
                w[rng.randrange(len(w))] = f"z{rng.randint(0, 9999)}"
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_jaccard_against_brute_force(spark, documents, monkeypatch):
    rows = near_copies(1, 12, 14, 70) + [(1000 + k, "same passage of ten words that all of these hold " * 2 + f"own{k} " * 9) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert found_components(docs) == want
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)  # large groups are joined block by block
    assert found_components(docs) == want
    monkeypatch.setattr(jaccard_join, "HOT", 1)  # frequent shingles need no meeting
    monkeypatch.setattr(jaccard_join, "HOT_MEANS", 0)
    assert found_components(docs) == want
    assert found_components(documents.repartition(3)) == brute_components([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_jaccard_deals_a_large_group_linearly(spark, monkeypatch):
    # Near copies of one text: each is held against one set, and what links with it is not dealt to pairs of blocks.
    rng = random.Random(2)
    base = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join(w if rng.random() > 0.004 else f"x{rng.randint(0, 10**6)}" for w in base)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "BLOCK", 20)
    dealt, deal = [], jaccard_join._dealt
    monkeypatch.setattr(jaccard_join, "_dealt", lambda sets, core: dealt.append((sets, deal(sets, core))) or dealt[-1][1])
    assert found_components(docs) == brute_components(rows)
    (sets, copies), = dealt
    assert sets.count() > 100 and copies.count() <= 3 * sets.count()


def test_jaccard_with_one_shingle_in_every_prefix(spark, monkeypatch):
    # Few other shingles are rarer, so that the common one stands in every prefix; nothing links, and lengths differ.
    rng = random.Random(3)
    phrase = "one phrase that all hold"
    rows = [(k, phrase + "".join(f" {rng.choice('abc')}{rng.randint(0, 10**6)}" for _ in range(rng.choice([3, 6, 12, 24, 48])))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counted = np.zeros(1 << jaccard_join.LEAST_BITS, np.uint32)
    monkeypatch.setattr(jaccard_join, "_frequencies", lambda summaries, bits: counted)
    groups, find = [], jaccard_join._groups
    monkeypatch.setattr(jaccard_join, "_groups", lambda *a: groups.append(find(*a)) or groups[-1])
    assert found_components(docs) == brute_components(rows)
    # Only sets so short that one common shingle may make a link are compared with each other, lengths apart.
    assert groups[0].count() <= 2 * len(rows)


@pytest.mark.parametrize("percent", [50, 75, 90, 100])
def test_jaccard_at_other_thresholds(spark, percent):
    rows = near_copies(percent, 8, 9, 45)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, percent=percent).collect())
    assert got == brute_components(rows, percent=percent)


def test_jaccard_many_equal_and_empty_texts(spark):
    rows = [(k, "the same text that very many documents hold in full") for k in range(3000)] + [(5000 + k, None) for k in range(2000)] + [(9000, "another text of its own for once")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {k: 0 if k < 3000 else k for k, _ in rows}


def test_jaccard_in_a_group():
    rng = random.Random(4)
    base = rng.sample(range(10**6), 60)
    sets = []
    for _ in range(150):
        own = set(base)
        for _ in range(rng.randint(0, 14)):
            own.discard(rng.choice(base))
            own.add(rng.randint(0, 10**9))
        sets.append(np.array(sorted(own), np.uint64))
    want = graph.Forest()
    for a in range(150):
        for b in range(a):
            i = len(np.intersect1d(sets[a], sets[b]))
            if 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                want.join(a, b)
    got = jaccard_join.join_group(list(range(150)), sets)
    assert [got.root(k) for k in range(150)] == [want.root(k) for k in range(150)]


def test_jaccard_awkward(spark, awkward, nothing):
    rows = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_join.jaccard_components(awkward).collect()}
    assert rows[5, 2] == 1 and rows[1, 2] == 1 and rows[2, 0] == 2 and rows[3, 0] == 3 and rows[6, 1] == 6
    assert [c for (d, _), c in rows.items() if d is None] == [None]
    assert jaccard_join.jaccard_components(nothing).count() == 0


def test_jaccard_links_each_text_of_an_id(spark):
    rng = random.Random(8)
    a, b = ([f"{rng.choice('abcdefgh')}{rng.randint(0, 999)}" for _ in range(60)] for _ in range(2))
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(2, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (5, " ".join(b)), (9, near(b)), (12, "a text of its own that nothing links with")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_components(docs) == brute_components(rows)
    assert {d: c for d, _, c in found_components(docs)} == {2: 2, 5: 2, 9: 2, 12: 12}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)]
    want = graph.Forest()
    for a, b in edges:
        want.join(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {k: want.root(k) for k in want.parent if want.root(k) != k}
    assert graph.components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


# Substring deduplication.


def brute_removed(rows, window):
    first = {}
    for d, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if d is not None and first[tuple(w[k : k + window])] < d:
                keep[k : k + window] = [False] * window
        kept = [x for x, y in zip(w, keep) if y]
        out.append((d, len(w), len(w) - len(kept), " ".join(kept)))
    return Counter(out)


def test_substring_against_brute_force(spark, documents, monkeypatch):
    rng = random.Random(8)
    passages = [[f"p{rng.randint(0, 60)}" for _ in range(rng.randint(8, 60))] for _ in range(12)]
    rows = []
    for d in range(160):
        w = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 1)
            w += [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 9))] + p[a : a + rng.randint(5, 60)] * rng.choice([1, 1, 3])
        rows.append((d, " ".join(w)))
    rows += [(7, rows[3][1]), (None, rows[4][1]), (500, None), (501, "x y " * 60), (502, "x y " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1 << 22, 300):
        monkeypatch.setattr(substring_dedup, "SHARD_BYTES", size)
        monkeypatch.setattr(substring_dedup, "LOAD_BYTES", 2 * size)  # several loads for a shard
        for window in (10, 21):
            got = substring_dedup.substring_dedup(docs, window=window).collect()
            assert Counter(tuple(r) for r in got) == brute_removed(rows, window)
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", 0)  # the way of large inputs
    monkeypatch.setattr(common, "HEAVY", 4)
    got = registry.QUERIES["op3_substring_dedup"](spark, "/root/testdata/sf0.001").collect()
    want = brute_removed([(r["doc_id"], r["text"]) for r in documents.collect()], 50)
    assert Counter(tuple(r) for r in got) == Counter({(d, n, k, hashlib.sha256(t.encode()).hexdigest()): c for (d, n, k, t), c in want.items()})


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    keys = substring_dedup.window_keys
    monkeypatch.setattr(substring_dedup, "window_keys", lambda words, window: (keys(words, window)[0] & np.uint64(3), keys(words, window)[1]))
    rng = np.random.default_rng(1)
    words = textops.mix(rng.integers(0, 2**63, 400).astype(np.uint64))
    automaton = substring_dedup.Automaton(10)
    automaton.add(5, words[:200])
    automaton.add(3, words[150:260])
    text = np.concatenate([words[350:], words[20:60], words[300:310], words[195:230], words[100:109]])
    want = np.r_[np.zeros(50, bool), np.ones(40, bool), np.zeros(10, bool), np.ones(35, bool), np.zeros(9, bool)]
    assert (automaton.removed(9, text) == want).all()
    want[50:90] = False
    assert (automaton.removed(4, text) == want).all()
    assert not automaton.removed(3, text).any()


def test_substring_awkward(awkward, nothing):
    rows = substring_dedup.substring_dedup(awkward, window=4).collect()
    assert {(r["doc_id"], r["n_removed"]) for r in rows if r["n_removed"]} == {(5, 5)}
    assert len(rows) == 10 and substring_dedup.substring_dedup(nothing).count() == 0


# Token files.


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return path, made


def test_token_files_round_trip(spark, root, awkward, nothing):
    path, plain = tokenizer()
    token_files.write(awkward, f"{root}/t", path, shard_ids=2000, parts=3)
    rows = sorted(token_files.read(spark, f"{root}/t").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    at = 0
    for r, (_, t, _) in zip(rows, sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0]))):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    token_files.write(nothing, f"{root}/n", path, parts=2)
    assert token_files.read(spark, f"{root}/n").count() == 0


@pytest.mark.parametrize("remembered", [1_000_000, 40])
def test_encoder_equals_the_library(monkeypatch, remembered):
    monkeypatch.setattr(token_files, "REMEMBERED", remembered)
    monkeypatch.setattr(token_files.textops, "steps", lambda texts, step, all_steps=token_files.textops.steps: all_steps(texts, step=200 if remembered < 100 else step))
    path, plain = tokenizer()
    encoder = token_files.Encoder(path, 2)
    texts = ["", " ", "\n", "a\n\nb", "a \nb", "a  b", "\ta", " a b ", "a\x85b c", "a b", "x　 y", "don't\nwon't", "a\rb", "a\x1cb c", "​ a", "<|endoftext|> x", "a\0b c", "it's 12,5% – ok\nnext line", "", "plain words"]
    rng = random.Random(1)
    texts += ["".join(rng.choice(" \n\taé1'.　") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += [rng.choice(" \n").join(rng.choice(["a", "é1", "don't", "1.5", "–", "x\u200b"]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    want = [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    for _ in range(2):  # the second time from memory
        flat, lengths = zip(*encoder.encode(pa.array(texts)))
        assert np.concatenate(lengths).tolist() == [len(x) for x in want]
        assert np.concatenate(flat).tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1001, 60_000])
def test_grammar_round_trip_and_random_access(n):
    rng = np.random.default_rng(n)
    for ids in (rng.zipf(1.3, n).clip(0, 90).astype(np.uint32), np.full(n, 7, np.uint32)):
        shard = token_files.Shard(token_files.pack([5], np.array([n]), ids))
        assert (shard.ids() == ids).all() and shard.doc_ids == [5]
        for _ in range(25):
            a, b = sorted(rng.integers(0, n + 1, 2))
            assert (shard.ids(int(a), int(b)) == ids[a:b]).all()
    if n == 60_000:
        assert len(shard.seq) + len(shard.rules) < 130
    with pytest.raises(ValueError):
        token_files.Shard(b"nonsense")


@pytest.mark.parametrize("narrow", [True, False])
def test_grammar_leaves_no_frequent_pair(narrow):
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 50_000, 1000)
    ids = np.concatenate([np.tile(passage, 200), rng.zipf(1.5, 50_000).clip(0, 5000)] + ([] if narrow else [np.arange(70_000)])).astype(np.uint32)
    terminals, rules, seq = token_files.repair(ids)
    assert (len(terminals) < 1 << 16) == narrow and len(rules) < 1004 + 50_000 / 4
    pairs, counts, last = Counter(), Counter(), None
    for k, pair in enumerate(zip(seq.tolist(), seq[1:].tolist())):
        if pair != last:  # a run of one symbol counts every other pair
            counts[pair] += 1
            last = pair if pair[0] == pair[1] else None
        else:
            last = None
    assert max(counts.values()) < token_files.LEAST
    assert (rules < len(terminals) + np.arange(len(rules))[:, None]).all()
    assert (token_files.Shard(token_files.pack([1], np.array([len(ids)]), ids)).ids() == ids).all()
    assert len(token_files.repair(np.tile(passage, 200).astype(np.uint32))[2]) < 130


def test_a_file_is_smaller_than_plain_ids(documents):
    path, _ = tokenizer()
    flat = np.concatenate([f for f, _ in token_files.Encoder(path, 2).encode(pa.array([r["text"] for r in documents.collect()]))])
    assert len(token_files.pack([1], np.array([len(flat)]), flat)) < 1.6 * len(flat)


@pytest.mark.parametrize("width", [1, 3, 8, 17, 32, 33, 64])
def test_packed_bits(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, 100):
        values = rng.integers(0, 2**width, n, np.uint64) if width < 64 else rng.integers(0, 2**64 - 1, n, np.uint64)
        raw = token_files.pack_bits(values, width)
        assert len(raw) == -(-n * width // 8) and (token_files.unpack_bits(memoryview(raw), n, width) == values).all()


@pytest.mark.parametrize("clash", ["few hashes", "lines stay together"])
def test_encoder_where_words_cannot_be_told_apart(monkeypatch, clash):
    path, plain = tokenizer()
    encoder = token_files.Encoder(path, 2)
    if clash == "few hashes":
        monkeypatch.setattr(token_files.textops, "mix", lambda x: x & np.uint64(63))
    else:
        encoder.break_id = -1  # an id that no text has
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.choice([1, 3, 9, 17, 30])))
    texts = [" ".join(word() for _ in range(rng.randint(0, 6))) for _ in range(300)] + ["a" * 17 + "b" + "a" * 17, "a" * 18 + "b" + "a" * 16]
    for part in (texts[:100], texts[100:], texts):
        flat = np.concatenate([f for f, _ in encoder.encode(pa.array(part))])
        assert flat.tolist() == [i for t in part for i in [*plain.encode(t, add_special_tokens=False).ids, 2]]


# Decontamination.


def distance(p, t):
    """Edit distance of p to the nearest part of t."""
    prev = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        cur = [i]
        for j, b in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a != b)))
        prev = cur
    return min(prev)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    items = [(k, "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(4, 90)))) for k in range(12)] + [(90, None), (91, "  "), (92, items_text := "short one")]
    rows = []
    for d in range(90):
        p = list(rng.choice(items[:12])[1])
        for _ in range(rng.randint(0, 9)):
            k = rng.randrange(len(p))
            p[k : k + 1] = rng.choice([[], ["q"], [p[k], "z"]])
        rows.append((d, "".join(rng.choice("klmnop ") for _ in range(40)) + "".join(p).upper().replace(" ", " \n ") + "kk"))
    rows += [(100, None), (101, ""), (None, f"a {items_text}, it is"), (102, f"a{items_text}"), (103, items_text)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    given = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for d, t in rows:
        for i, p in items:
            if not t or not p or not decontamination.normal(p):
                continue
            n, q = decontamination.normal(t), decontamination.normal(p)
            if (e := distance(q, n)) <= int(decontamination.RATE * len(q) + 1e-9):
                want[d, i, e] += 1
    for block in (8_000_000, 300):
        got = decontamination.matches(docs, given, block_chars=block).collect()
        assert Counter((r["doc_id"], r["item_id"], r["distance"]) for r in got) == want
        kept = decontamination.clean(docs, given, block_chars=block)
        assert kept.columns == docs.columns and kept.count() == len(rows) - len({d for d, *_ in want})
    assert decontamination.matches(docs.where("false"), given).count() == 0
    assert decontamination.matches(docs, given.where("false")).count() == 0


def test_items_without_an_id_are_met(spark):
    passage = "the quick brown fox jumps over the lazy dog near the old mill"
    items = spark.createDataFrame([(None, passage), (None, "short one"), (7, passage), (None, None), (None, " ")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, "a short one."), (3, "nothing of it")], "doc_id long, text string")
    for block in (8_000_000, 50):
        got = decontamination.matches(docs, items, block_chars=block).collect()
        assert Counter((r["doc_id"], r["item_id"], r["distance"]) for r in got) == Counter([(1, None, 0), (1, 7, 0), (2, None, 0)])
        kept = decontamination.clean(docs, items.where("item_id is null"), block_chars=block)
        assert [r["doc_id"] for r in kept.collect()] == [3]


def test_short_items_need_their_words(spark):
    items = spark.createDataFrame([(1, "ask"), (2, "What is it?"), (3, "the old mill")], "item_id long, text string")
    texts = ["a mask", "Ask!", "what-is it", "whatisit", "the cold mill", "the oldd mill", "bathe old millers", None, "?!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontamination.matches(docs, items).collect())
    # " the old mill " has 14 characters, so that one edit is free
    assert got == [(1, 1, 0), (2, 2, 0), (4, 3, 1), (5, 3, 1)]


def test_myers_finds_part_and_distance():
    rng = random.Random(3)
    for _ in range(200):
        p = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 70)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 90)))
        d, a, b = decontamination.Pattern(1, p, 0.1).best(t)
        assert d == distance(p, t) and distance(p, t[a:b]) == d


# The pipeline.


def test_pipeline_stage_by_stage(spark, root):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.01"
    docs = common.documents(spark, sf)
    kept, columns = {}, docs.columns
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{root}/{name}")
        after = spark.read.parquet(f"{root}/{name}")
        kept[name] = before, now = Counter(r["doc_id"] for r in docs.collect()), Counter(r["doc_id"] for r in after.collect())
        assert set(now) <= set(before)
        if name != "sharding":
            assert sorted(after.columns) == sorted(columns)
        if name == "n-gram Jaccard join":
            wanted = brute_components_of(docs)
            assert set(now) == wanted
        if name == "benchmark decontamination":
            items = [(r["item_id"], decontamination.normal(r["text"])) for r in common.benchmark(spark, sf).collect()]
            texts = {r["doc_id"]: decontamination.normal(r["text"] or "") for r in docs.collect()}
            exact = {d for d, t in texts.items() if any(p in t for _, p in items)}
            assert not exact & set(now) and len(set(before) - set(now) - exact) <= 3
        if name == "mixing sources":
            assert max(now.values()) <= 3 and sum(len(words(r["text"])) for r in after.collect()) == pytest.approx(sum(len(words(r["text"])) for r in docs.collect()), rel=0.1)
        if name == "sharding":
            assert before == now
            slots = defaultdict(list)
            for r in after.collect():
                slots[r["shard"]].append(r["slot"])
            assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        docs = after
    labels = {r["doc_id"]: r["toxic"] for r in common.labels(spark, sf).collect()}
    before, now = kept["toxicity"]
    clean = [d for d in before if labels.get(d) == 0]
    assert sum(d in now for d in clean) >= 0.99 * len(clean)
    assert sum(labels.get(d) == 1 for d in now) <= 0.25 * sum(labels.get(d) == 1 for d in before)
    assert sorted(pipeline.run(spark, sf).columns) == sorted([*columns, "shard", "slot"])


def tables(spark, root, docs):
    docs.write.parquet(f"{root}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{root}/{name}.parquet")
    return root


def test_pipeline_on_awkward_tables(spark, root, awkward):
    import corpus_pipeline as pipeline

    docs = awkward.drop("score", "digest", "size")
    for name in ("toxicity", "toxicity_", "mix", "nth", "gone", "shard", "block", "doc", "slot"):
        docs = docs.withColumn(name, F.lit("x"))
    found = pipeline.run(spark, tables(spark, f"{root}/a", docs))
    rows = found.collect()
    assert found.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert all(r["toxicity"] == r["mix"] == r["doc"] == "x" for r in rows)
    ids = Counter(r["doc_id"] for r in rows)
    assert 5 not in ids and ids[1] % 2 == 0 and {1, 6, 7} & set(ids)  # 5 is a copy of 1, whose two rows go the same way
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pipeline_on_empty_tables(spark, root, nothing):
    import corpus_pipeline as pipeline

    assert pipeline.run(spark, tables(spark, f"{root}/n", nothing.select("doc_id", "text", "source"))).count() == 0


def test_pipeline_deletes_what_its_stages_needed(spark, root, awkward):
    import os

    import corpus_pipeline as pipeline

    before, begun = set(os.listdir(common.shared_dir(spark).removeprefix("file:"))), common.mark()
    found = pipeline.run(spark, tables(spark, f"{root}/b", awkward.select("doc_id", "text", "source")))
    n = found.count()
    left = set(os.listdir(common.shared_dir(spark).removeprefix("file:"))) - before
    assert {x.rsplit("-", 1)[0] for x in left} <= {"mixing-sources", "shards"} and found.count() == n
    common.sweep(spark, since=begun)
    assert not set(os.listdir(common.shared_dir(spark).removeprefix("file:"))) - before


def brute_components_of(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, lists, forest = {}, defaultdict(list), graph.Forest()
    for d, t in sorted(rows):
        w = words((t or "").translate(low))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        shared = Counter(e for s in sets[d] for e in lists[s])
        for e, n in shared.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[e]) - n):
                forest.join(d, e)
        for s in sets[d]:
            lists[s].append(d)
    return {d for d, _ in rows if forest.root(d) == d}
