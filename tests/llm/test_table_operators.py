"""Quality rules, embeddings, sharding and the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netlens.llm import embeddings, quality, sharding, simhash
from netlens.llm.common import materialise
from netlens.llm.queries import QUERIES

DOC = "doc_id long, text string, lang string, source string"


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    grams = Counter(tuple(words[i:i + 8]) for i in range(n - 7))
    covered = {j for i in range(n - 7) if grams[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics(rows):
    rng = random.Random(1)
    texts = [None, "", " \n", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 40, "é# *\n\né# *\n b\x0bc d", "a\na\nb\n a"]
    texts += [" ".join(rng.choice(["a", "b", "c", "d\n", "#e"]) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    data = [(i, t, "en", "s") for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in quality.verdicts(rows(data, DOC)).collect()}
    for i, t in enumerate(texts):
        r, want = out[i], brute_statistics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def prose(rng, n=80):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_outliers(rows):
    rng = random.Random(2)
    data = [(i, prose(rng), "en", "s1") for i in range(200)] + [(200 + i, prose(rng), None, None) for i in range(80)]
    junk = [(900 + i, " ".join(w + "$$#" for w in prose(rng).split()), "en", "s1") for i in range(40)]
    out = {r.doc_id: r.kept for r in quality.verdicts(rows(data + junk, DOC)).collect()}
    assert all(out[d] for d, *_ in data) and not any(out[d] for d, *_ in junk)
    df = rows(data + junk, DOC).withColumns({"q": F.lit(1), "g": F.lit(2), "x0": F.lit(3)})
    kept = quality.filtered(df)
    assert kept.columns == df.columns and kept.count() == len(data)


def test_robust_estimate_against_numpy(rows):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (400, 4)), rng.normal(30, 1, (100, 4))])
    df = rows([("g", *map(float, r)) for r in x], "g string, x0 double, x1 double, x2 double, x3 double")
    p = quality.fit(df, None).first()
    assert all(abs(p[f"m{i}"]) < 0.3 for i in range(4))
    w = np.array([[p[f"w{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
    m = np.array([p[f"m{i}"] for i in range(4)])
    d = (((x - m) @ w.T) ** 2).sum(axis=1)
    assert (d[400:] > p["cutoff"]).all() and (d[:400] <= p["cutoff"]).mean() > 0.99


def test_every_large_group_has_an_estimate(spark):
    n = 4200
    df = spark.range(n * quality.GROUP_ROWS).select(F.lit("en").alias("lang"), (F.col("id") % n).cast("string").alias("source"))
    assert quality._levels(df, ["lang", "source"]).count() == n + 2


def test_many_groups_are_judged_as_few(rows, monkeypatch):
    rng = random.Random(5)
    data = [(k, prose(rng, 30) + " $$#" * (k % 7), None if k % 5 == 4 else f"l{k % 2}", None if k % 3 == 2 else f"s{k % 3}") for k in range(700)]
    judge = lambda: {r.doc_id: (r.kept, None if r.distance is None else round(r.distance, 6)) for r in quality.verdicts(rows(data, DOC)).collect()}
    few = judge()
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 1)
    assert judge() == few and len(few) == len(data)


def test_quality_odd_rows(rows):
    assert quality.verdicts(rows([], DOC)).count() == 0
    out = quality.verdicts(rows([(None, None, None, None), (1, "x", "en", None), (1, "x", "en", None)], DOC)).collect()
    assert len(out) == 3 and all(r.base_failed and not r.kept for r in out)


def vectors(seed, n=400, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(n // 2, n):
        x[i] = x[rng.integers(0, n // 2)] + rng.normal(size=dim) * rng.uniform(0.02, 0.12)
    x[5] = x[6] = x[7]
    label = rng.integers(0, 3, n)
    label[5:8] = 1
    return x.astype(np.float32), label


def brute_links(x, label, threshold=0.93):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return (u @ u.T >= threshold) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)


@pytest.mark.parametrize("small_cells", [False, True])
def test_embeddings(rows, monkeypatch, small_cells):
    if small_cells:  # many lists, and crowded ones cut into blocks
        monkeypatch.setattr(embeddings, "LIST_ROWS", 40)
        monkeypatch.setattr(embeddings, "CELL_MEMBERS", 7)
        monkeypatch.setattr(embeddings, "CELL_QUERIES", 11)
    x, label = vectors(4)
    data = [(i, x[i].tolist(), int(label[i])) for i in range(len(x))]
    data += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, x[5].tolist(), None), (904, [None] + [1.0] * 15, 1), (905, x[5][:8].tolist(), 1), (905, x[5][:8].tolist(), 1)]
    out = {}
    for r in embeddings.near_duplicates(rows(data, "vec_id long, embedding array<float>, label int").withColumn("uid", F.lit(1))).collect():
        out.setdefault(r.vec_id, r)
    link = brute_links(x, label)
    found = sum(out[i].n_links for i in range(len(x)))
    assert 0.9 * link.sum() <= found <= link.sum()
    assert all(out[i].n_links <= link[i].sum() for i in range(len(x)))
    assert out[5].n_links >= 2 and out[5].component_id == out[6].component_id == out[7].component_id
    assert all(out[i].n_links == 0 and out[i].component_id == i and out[i].kept for i in (900, 901, 902, 903, 904))
    assert out[905].n_links == 1
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.values())


def test_embedding_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    p = df.orderBy("vec_id").toPandas()
    link = brute_links(np.array(p.embedding.tolist()), p.label.to_numpy())
    got = embeddings.near_duplicates(df).agg(F.sum("n_links")).first()[0]
    assert 0.9 * link.sum() <= got <= link.sum()


def test_embeddings_empty(rows):
    assert embeddings.near_duplicates(rows([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_sharding(rows):
    rng = random.Random(5)
    data = [(i, "t" * rng.randint(0, 20)) for i in range(3000)] + [(None, None), (7, "again é"), (7, "again é")]
    out = sharding.assign(rows(data, "doc_id long, text string").withColumns({"shard": F.lit("x"), "part": F.lit(1)})).collect()
    assert len(out) == len(data)
    assert all(r.grown_shard in (r.shard, 40) for r in out) and any(r.grown_shard == 40 for r in out)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(40)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = [r for r in out if r.doc_id == 7]
    assert len({r.shard for r in again}) == 1
    assert sum((r.size, r.text_crc32) == (16 + len("again é".encode()), zlib.crc32("again é".encode())) for r in again) == 2
    assert next(r for r in out if r.doc_id is None).size == 16
    assert sharding.assign(rows([], "doc_id long, text string")).count() == 0


def test_changed_weights_stay_in_their_subtree(rows):
    df = rows([(i,) for i in range(4000)], "doc_id long")
    a, b = sharding.tree(40), sharding.tree(40)
    b.children[0].children[1].children[2].weight = 0.25
    moved = sharding.place(sharding.place(df, "doc_id", a, "a"), "doc_id", b, "b").where("a <> b").collect()
    heavier = [r for r in moved if r.b == 7]
    assert moved and not heavier
    counts = Counter(r.b for r in sharding.place(df, "doc_id", b, "b").collect())
    assert counts[7] < 0.6 * 100
    three = [sharding.place(df, "doc_id", sharding.tree(n), "s").select("doc_id", "s") for n in (41, 42)]
    both = three[0].withColumnRenamed("s", "a").join(three[1], "doc_id").where("a <> s").collect()
    assert both and all(r.s == 41 for r in both)


def test_pipeline(spark, small):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "personal_data", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(materialise(stage(spark, steps[-1], small), "step"))
    quality_out, line_out, near_out, pii_out, packed = steps[1:]
    assert all(x.columns == docs.columns for x in steps[1:5])
    kept = {r.doc_id for r in quality.verdicts(docs).where("kept").collect()}
    assert {r.doc_id for r in quality_out.collect()} == kept
    from test_text_operators import brute_removed

    gone = brute_removed([(r.doc_id, r.text) for r in quality_out.collect()])
    want = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if (r.doc_id, i) not in gone) for r in quality_out.collect()}
    assert {r.doc_id: r.text for r in line_out.collect()} == want
    assert all(r.n_chars == len(r.text) for r in line_out.collect())
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(line_out).collect()}
    assert {r.doc_id for r in near_out.collect()} == set(groups.values())
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in pii_out.collect()} == set(groups.values())
    assert corpus_pipeline.run(spark, small).count() == packed.count()


def test_one_query_for_each_operator():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 14))


def test_embeddings_of_many_lengths(rows):
    """Seventy lengths of two linked vectors each: all are found, and none across lengths."""
    rng = np.random.default_rng(5)
    data = []
    for k in range(70):
        v = rng.normal(size=3 + k)
        data += [(2 * k, v.tolist(), "a"), (2 * k + 1, (v * 1.5 + 1e-3 * rng.normal(size=3 + k)).tolist(), "a")]
    out = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(rows(data, "vec_id long, embedding array<double>, label string")).collect()}
    assert out == {d: (1, d // 2 * 2) for d, _, _ in data}


@pytest.mark.parametrize("narrow", [False, True])
def test_embeddings_by_length_class(rows, monkeypatch, narrow):
    """Two lengths with quantisers of their own, one that is compared exactly, and two vectors of 30,000 components."""
    monkeypatch.setattr(embeddings, "LIST_ROWS", 40)
    if narrow:  # many small blocks
        monkeypatch.setattr(embeddings, "WIDE", 4)
        monkeypatch.setattr(embeddings, "CELL_MEMBERS", 64)
    data, want, top = [], {}, 0
    for seed, (n, dim) in enumerate([(300, 16), (240, 20), (50, 33)]):
        x, label = vectors(seed, n, dim)
        link = brute_links(x, label)
        for i in range(n):
            data.append((top + i, x[i].tolist(), int(label[i])))
            want[top + i] = int(link[i].sum())
        top += n
    data += [(top, [1.0] * 30_000, 1), (top + 1, [1.0] * 29_000 + [1.5] * 1000, 1)]
    want |= {top: 1, top + 1: 1}
    out = {r.vec_id: r.n_links for r in embeddings.near_duplicates(rows(data, "vec_id long, embedding array<float>, label int")).collect()}
    assert set(out) == set(want) and all(out[k] <= want[k] for k in want)
    assert all(out[k] == want[k] for k in range(540, top + 2)) and sum(out.values()) >= 0.9 * sum(want.values())
