"""Exact deduplication, mixing, license scans and sharding."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from chronolake.llm import exact_dedup, license_scan, mixing, registry, sharding

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    want = c.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    a = sorted((tuple(r[k] for k in order) for r in got.collect()), key=str)
    b = sorted((tuple(r[want.columns.index(k)] for k in order) for r in want.fetchall()), key=str)
    assert a == b


def test_exact_dedup_awkward(awkward, nothing):
    rows = exact_dedup.exact_dedup(awkward).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["text_sha256"]].append(r)
    blank = by[hashlib.sha256(b"").hexdigest()]
    assert sorted(r["doc_id"] for r in blank) == [2, 3, 4, 8] and {r["keep_id"] for r in blank} == {4}  # three code points
    alpha = by[hashlib.sha256(b"alphabetagammadeltaepsilonzeta").hexdigest()]
    assert [r["kept"] for r in alpha] == [True, True] and {r["group_size"] for r in alpha} == {2}
    assert len(rows) == 10 and [r["kept"] for r in rows if r["doc_id"] is None] == [True]
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_dedup_heavy_group_and_ties(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("a  b")).otherwise(F.concat(F.lit("t"), F.col("id") % 1500)).alias("text"))
    rows = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs, counters=16).collect()}
    assert rows[9]["keep_id"] == 0 and rows[9]["group_size"] == 1000 and not rows[9]["kept"] and rows[0]["kept"]
    assert rows[1501]["keep_id"] == 1 and rows[1501]["group_size"] == 2
    heavy = exact_dedup.heavy_hitters(exact_dedup.digests(docs), 16).collect()
    assert [(r["keep_id"], r["group_size"]) for r in heavy] == [(0, 1000)]


def test_exact_dedup_at_the_ends_of_ids(spark):
    least, most = -(2**63), 2**63 - 1
    rows = [(least, "a b"), (most, "ab "), (0, "ab"), (None, "a  b"), (most, "c"), (least, "c")] + [(k, "hot") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for counters in (4, 4096):
        got = {(r["doc_id"], r["group_size"]): r["keep_id"] for r in exact_dedup.exact_dedup(docs, counters=counters).collect()}
        assert got[0, 4] == None and got[least, 2] == least and got[7, 50] == 0  # noqa: E711


def test_names_of_columns_do_not_clash(spark):
    docs = spark.createDataFrame([(k, f"some words {k}", f"s{k % 3}", *["x"] * 6) for k in range(30)], "doc_id long, text string, source string, mix string, nth string, of string, place string, size string, missing string")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and all(r["mix"] == r["nth"] == r["of"] == "x" for r in mixed.collect())
    assert exact_dedup.exact_dedup(docs).count() == license_scan.license_scan(docs).count() == 30


def test_mixing_meets_targets(spark):
    random.seed(2)
    rows = [(k, " ".join("w" * random.randint(1, 40)), random.choice(["a", "a", "a", "b", None, "c"])) for k in range(900)] + [(9000, "only one", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_counts(docs).collect()
    assert out == mixing.mix_counts(docs.repartition(5)).orderBy("doc_id").collect() or sorted(out) == sorted(mixing.mix_counts(docs.repartition(5)).collect())
    total = sum(r["size"] for r in out)
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in out:
        key = round(r["target"], 6), r["source_size"]
        by[key][0] += r["taken"]
        by[key][2] = max(by[key][2], r["size"])
        assert r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-9
    assert abs(sum(t for t, _ in by) - total) < 1e-6 * total
    for (target, _), (taken, _, largest) in by.items():
        assert abs(taken - target) <= largest / 2 + 1e-6
    # weights by code point, null last: a 1, b 2, c 3, d 1 (capped), null 2
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["reps"] for r in out if r["reps"]})


def test_mixing_awkward(awkward, nothing):
    rows = mixing.mix_counts(awkward).collect()
    assert len(rows) == 10 and sum(r["taken"] for r in rows if not r["size"]) == 0
    assert sorted(mixing.mix(awkward).columns) == sorted(awkward.columns)
    assert mixing.mix_counts(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def brute_licenses(text, known):
    """All blocks against all notices."""
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    more, best = set(), 0.0
    for stride in {x.stride for x in known}:
        for k in range(0, max(1, len(w)), stride):
            block, met = set(w[k : k + 2 * stride]), {}
            for x in known:
                share = len(block & x.tokens) / len(x.tokens)
                if x.stride == stride and share >= license_scan.CONTAINMENT - 1e-9:
                    if len(block & x.telling) >= min(len(x.telling), max(1, int(license_scan.CONTAINMENT * len(x.telling) + 1e-9))):
                        met[x.n] = share, len(block & x.tokens), x
            for size, count, x in met.values():
                if not any(b in met and met[b][:2] > (size, count) for b in x.covered_by):
                    more.add(x.label)
                    best = max(best, size)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if starts else best


def test_license_scan_against_brute_force(spark, documents):
    more = [
        (10**6, "x " * 40 + license_scan.NOTICES[12][0].replace("noninfringement", "title").upper() + " y" * 90),
        (10**6 + 1, "GNU General Public License; MIT license. CC-BY, Apache LICENSE\nThis Source Code Form is subject to the terms of the Mozilla Public License"),
        (10**6 + 2, "Permission is granted to any person"),
        (10**6 + 2, None),
        (None, "mit license"),
        (10**6 + 3, ""),
        (10**6 + 4, "Knu general public license gnu General public LICENSE"),
    ]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    texts = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    got = sorted((tuple(r) for r in license_scan.license_scan(docs).collect()), key=str)
    known = license_scan.prepared(license_scan.NOTICES, license_scan.CONTAINMENT)
    want = sorted(((d, *brute_licenses(t, known)) for d, t in texts), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:-1] == b[:-1] and abs(a[-1] - b[-1]) < 1e-9, (a, b)
    assert any(r[6] == "mit" and not r[5] for r in got)


def test_license_scan_of_a_notice_longer_than_a_block(spark):
    notice = " ".join(f"w{k}" for k in range(200))
    rows = [(k, f"{'x ' * lead}{notice} {'y ' * 50}") for k, lead in enumerate((0, 47, 150))] + [(9, " ".join(notice.split()[:150]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.license_scan(docs, notices=[(notice, "long")]).collect()}
    assert got == {0: ("long", 1.0), 1: ("long", 1.0), 2: ("long", 1.0), 9: ("", 0.0)}


def method_labels(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    return [set(rows[k]["labels"].split(",")) - {""} for k in range(len(texts))]


def test_no_license_is_taken_for_another(spark):
    rng = random.Random(5)
    texts, wanted = [], []
    for text, label in license_scan.NOTICES:
        w = text.split()
        for lead in (0, 3, 100):
            texts.append("lorem " * lead + text + " ipsum" * 30)
            wanted.append(label)
        if len(w) > 30:  # with some words lost or changed
            drop = set(rng.sample(range(len(w)), len(w) // 20))
            texts.append(" ".join("zzz" if k in drop else x for k, x in enumerate(w)))
            wanted.append(label)
    for got, label, text in zip(method_labels(spark, texts), wanted, texts):
        own = {label} | {base for phrase, base in license_scan.PHRASES if f" {phrase} " in f" {text} "}
        assert got == own, (label, got, text)


def test_text_about_licenses_gets_no_label(spark):
    texts = [
        "it was released under the old license",
        "licensed under the license version three",
        "this work is licensed under the old general public license of the town",
        "permission is granted to any person to use the hall free of charge subject to the following conditions",
        "this work is licensed under a creative agreement of international attribution",
    ]
    assert method_labels(spark, texts) == [set()] * len(texts)


def test_license_scan_awkward(awkward, nothing):
    assert license_scan.license_scan(awkward).count() == 10
    assert license_scan.license_scan(nothing).count() == 0


def test_flow_moves_the_least():
    rng = random.Random(5)
    for _ in range(40):
        n, m = rng.randint(1, 6), rng.randint(1, 6)
        old = [rng.randint(0, 50) for _ in range(n)]
        capacity = sharding.even(sum(old), m)
        flow = sharding.min_cost_flow(old, capacity, [[int(i != j) for j in range(m)] for i in range(n)])
        assert [sum(r) for r in flow] == old and [sum(flow[i][j] for i in range(n)) for j in range(m)] == capacity
        kept = sum(flow[i][i] for i in range(min(n, m)))
        assert kept == sum(min(a, b) for a, b in zip(old, capacity))
    # a general cost: 0 to 1 is dear
    assert sharding.min_cost_flow([5, 5], [5, 5], [[9, 1], [1, 9]]) == [[0, 5], [5, 0]]
    with pytest.raises(ValueError):
        sharding.min_cost_flow([5], [4], [[0]])


def placed_by_brute_force(rows, moves, n_old):
    """doc -> new shard of rows (shard, block, doc, size) in the order of shards, blocks and places: where a document's midpoint lies."""
    out, at = {}, Counter()
    for shard, doc, size in rows:
        edge, to = 0, None
        for j in sorted(range(len(moves[shard])), key=lambda j: (j != shard, j)):
            edge += moves[shard][j]
            if moves[shard][j] and (to is None or 2 * at[shard] + size >= 2 * begin):
                to = j
            begin = edge
        out[doc] = to
        at[shard] += size
    return out


@pytest.mark.parametrize(("n_old", "n_new"), [(12, 16), (5, 3), (1, 4), (4, 4)])
def test_resharding_against_brute_force(spark, root, monkeypatch, n_old, n_new):
    monkeypatch.setattr(sharding, "LEAST_BYTES", 300)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), F.when(F.col("id") % 97 == 0, 900).otherwise(F.col("id") % 25).cast("int")).alias("text"))
    layout = sharding.Layout.write(docs, f"{root}/s", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % n_old), n_old)
    before = layout._files().select("shard", "block", "nth", F.col("doc.doc_id").alias("d"), "size").orderBy("shard", "block", "nth").collect()
    assert len(before) == 3000 and all(r["size"] == 1 + 2 * (900 if r["d"] % 97 == 0 else r["d"] % 25) for r in before)
    plan = sharding.Resharding(layout, n_new)
    want = placed_by_brute_force([(r["shard"], r["d"], r["size"]) for r in before], plan.moves, n_old)
    untouched = {f"{root}/s/blocks/shard={b.shard}/block={b.block}" for b in plan.stay}
    stamps = {p: sorted((f, os.path.getmtime(f"{p}/{f}")) for f in os.listdir(p)) for p in untouched}
    after = plan.rewrite()
    rows = after.read().select(F.col("doc.doc_id").alias("d"), "shard", "slot", "size", "crc", "doc.text").collect()
    assert {r["d"]: r["shard"] for r in rows} == want and len(rows) == 3000
    assert all(r["crc"] == zlib.crc32(r["text"].encode()) and r["size"] == len(r["text"].encode()) + 1 for r in rows)
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and [sizes[k] for k in range(n_new)] == after.sizes
    assert max(abs(sizes[k] - c) for k, c in enumerate(plan.capacity)) <= 1801 * n_old
    # Blocks that stay were not written again, and all others are gone.
    assert stamps == {p: sorted((f, os.path.getmtime(f"{p}/{f}")) for f in os.listdir(p)) for p in untouched}
    assert {(int(s[6:]), int(b[6:])) for s in os.listdir(f"{root}/s/blocks") if s.startswith("shard") for b in os.listdir(f"{root}/s/blocks/{s}")} == {b[:2] for b in after.blocks}
    opened = sharding.Layout.open(spark, f"{root}/s")
    assert opened.blocks == after.blocks and opened.n_shards == n_new and opened.read().schema == after.read().schema
    # Resharding to what stands there moves nothing.
    assert sharding.Resharding(opened, n_new, capacity=opened.sizes).affected == []


def test_resharding_touches_two_shards_only(spark, root):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    layout = sharding.Layout.write(docs, f"{root}/s", F.col("doc_id") % 8, 8)
    plan = sharding.Resharding(layout, 8, capacity=[s + (k == 2) * 330 - (k == 5) * 330 for k, s in enumerate(layout.sizes)])
    assert plan.moved_bytes == 330 and {b.shard for b in plan.affected} == {5} and plan.stay
    before = {r["d"]: r["shard"] for r in layout.read().select(F.col("doc.doc_id").alias("d"), "shard").collect()}
    moved = [r for r in plan.rewrite().read().select(F.col("doc.doc_id").alias("d"), "shard").collect() if r["shard"] != before[r["d"]]]
    assert len(moved) == 30 and all(before[r["d"]] == 5 and r["shard"] == 2 for r in moved)


@pytest.mark.parametrize("step", ["moved blocks", "manifest", "deletion"])
def test_resharding_that_dies_leaves_one_layout(spark, root, monkeypatch, step):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    layout = sharding.Layout.write(docs, f"{root}/s", F.col("doc_id") % 3, 3)

    def die(*_, **__):
        raise RuntimeError(step)

    with monkeypatch.context() as m:
        if step == "manifest":
            m.setattr(sharding.Layout, "_save", die)
        elif step == "deletion":
            m.setattr(sharding.Files, "delete", die)
        else:
            m.setattr(sharding.Resharding, "_inside", staticmethod(die))
        with pytest.raises(RuntimeError):
            sharding.Resharding(layout, 4).rewrite()
    found = sharding.Layout.open(spark, f"{root}/s")
    assert found.n_shards == (4 if step == "deletion" else 3)
    assert sorted(r["d"] for r in found.read().select("doc.doc_id").toDF("d").collect()) == list(range(500))
    if step != "deletion":  # tried again
        again = sharding.Resharding(found, 4).rewrite().read()
        assert sorted(r["d"] for r in again.select("doc.doc_id").toDF("d").collect()) == list(range(500))


def test_resharding_awkward(spark, awkward, nothing, root):
    for name in ("shard", "block", "slot", "nth", "at", "doc", "crc", "id", "part", "_old"):
        awkward = awkward.withColumn(name, F.lit(name))
    rows = sharding.resharded(awkward, f"{root}/a", 3, 4).collect()
    assert len(rows) == 10 and {r["doc"]["doc_id"]: r["size"] for r in rows}[2] == 1
    assert all(r["doc"]["at"] == "at" and r["doc"]["shard"] == "shard" for r in rows)
    empty = sharding.resharded(awkward.where("false"), f"{root}/n", 3, 4)
    assert empty.count() == 0 and empty.schema["doc"].dataType.names == awkward.columns
    assert sharding.Layout.open(spark, f"{root}/n").n_shards == 4
