"""Vector codes, centroids and BPE against brute force and the tokenizer's library."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netlens.llm import bpe, centroids, vector_codes
from netlens.llm.queries import tokenizer_path

VEC = "vec_id long, embedding array<float>, label int"


def integers(v):
    return [math.floor(Fraction(float(x)) * 256) for x in v]


def brute_nearest(x, entries):
    """(entry, squared distance) with Python integers, ties to the lower entry."""
    return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(entries))[::-1]


def brute_rounds(points, entries, rounds):
    for _ in range(rounds):
        met = {}
        for p in points:
            met.setdefault(brute_nearest(p, entries)[0], []).append(p)
        entries = [[sum(c) // len(met[k]) for c in zip(*met[k], strict=True)] if k in met else e for k, e in enumerate(entries)]
    return entries


def odd_vectors(seed, n, dim):
    """Clusters, exact copies, equal distances; and rows that have no code."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dim)) * rng.choice([0.02, 1, 3], size=(n, 1)), 2).astype(np.float32)
    x[n // 2:n // 2 + 20] = x[3]
    x[-5:] = 0
    good = [(int(i), [float(c) for c in v], None if i % 5 == 0 else int(i % 3)) for i, v in enumerate(x)]
    good += [good[7], (9, good[10][1], 1), (None, good[11][1], None)]
    bad = [(9000, None, 1), (9001, [float("nan")] * dim, 1), (9002, [float("inf")] + [1.0] * (dim - 1), 2), (9003, [None] + [1.0] * (dim - 1), 2)]
    return good, bad


def brute_codes(good, parts=16, entries=64, rounds=2):
    rows = sorted(((i, integers(v), label) for i, v, label in good), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [brute_rounds([cut(v, p) for _, v, _ in rows], [cut(v, p) for _, v, _ in rows[:entries]], rounds) for p in range(parts)]
    out, sums = [], {}
    for i, v, label in rows:
        got = [brute_nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for _, d in got)
        sums[label] = sums.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for k, _ in got), error, label))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, code, e, sums[label], sha) for i, code, e, label in out), key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_gnat_against_all_entries(seed):
    rng = np.random.default_rng(seed)
    for n, dim, most in [(1, 4, 3), (64, 4, 2), (64, 4, 40), (200, 2, 6), (64, 1, 1), (300, 8, 500)]:
        entries, x = rng.integers(-most, most + 1, (n, dim)), rng.integers(-most, most + 1, (500, dim))
        entry, squared = vector_codes.Gnat.build(entries, np.arange(n)).nearest(x)
        d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (entry == d.argmin(axis=1)).all() and (squared == d.min(axis=1)).all()


def test_gnat_skips_subtrees(monkeypatch):
    rng = np.random.default_rng(3)
    entries = np.concatenate([rng.integers(-9, 10, (16, 4)) + c for c in (0, 5_000, 90_000, -70_000)])
    tree, looked = vector_codes.Gnat.build(entries, np.arange(64)), []
    search = vector_codes.Gnat._search
    monkeypatch.setattr(vector_codes.Gnat, "_search", lambda self, x, rows, *more: (looked.append(len(rows) * len(self.points)), search(self, x, rows, *more)))
    tree.nearest(entries.repeat(10, axis=0))
    assert sum(looked) < 640 * 64 / 2


def test_vector_codes(rows):
    good, bad = odd_vectors(4, 260, 32)
    out = vector_codes.compress(rows(good + bad, VEC).withColumns({"v": F.lit(1), "dim": F.lit("x"), "code": F.lit(2), "_v": F.lit(3)}))
    assert collected(out) == brute_codes(good)


def test_vector_codes_few_vectors_many_lengths_and_none(rows):
    few, other = odd_vectors(5, 30, 16)[0], odd_vectors(6, 150, 20)[0]
    filled = [(i, v + [0.0] * 12, label) for i, v, label in other]  # 20 components are filled up to 32
    out = collected(vector_codes.compress(rows(few + other, VEC)))
    alone = brute_codes(few) + brute_codes(filled)
    assert sorted((r[:3] + r[4:] for r in out), key=str) == sorted((r[:3] + r[4:] for r in alone), key=str)
    by_label = {}
    for i, code, error, total, _ in out:
        by_label.setdefault(total, []).append(error)
    assert all(sum(v) == k for k, v in by_label.items()) and len(by_label) == 4  # labels 0, 1, 2 and null, over all lengths
    assert vector_codes.compress(rows([], VEC)).count() == 0
    assert vector_codes.compress(rows([(1, None, 1)], VEC)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compress(rows([(1, [1e6] * 16, 1)], VEC)).collect()


def test_walsh_hadamard():
    rng = np.random.default_rng(7)
    a, b = rng.integers(-900, 900, (20, 64)), rng.integers(-900, 900, (20, 64))
    x, y = centroids.walsh_hadamard(a), centroids.walsh_hadamard(b)
    assert (((x - y) ** 2).sum(axis=1) == 64 * ((a - b) ** 2).sum(axis=1)).all()
    matrix = centroids.walsh_hadamard(np.eye(64, dtype=np.int64)).T
    assert (np.abs(matrix) == 1).all() and (matrix @ matrix.T == 64 * np.eye(64)).all()
    assert ((matrix[:, 1:] != matrix[:, :-1]).sum(axis=1) == np.arange(64)).all()  # coarse to fine


@pytest.mark.parametrize("most", [1, 3, 200, 1 << 24])
def test_search_against_all_centroids(most):
    rng = np.random.default_rng(most)
    c = rng.integers(-most, most + 1, (40, 64))
    c[7], c[33] = c[20], c[2]
    x = np.concatenate([rng.integers(-most, most + 1, (300, 64)), c, (c[:20] + c[20:]) // 2])
    which, squared = centroids.Search(c).nearest(x)
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (which == d.argmin(axis=1)).all() and (squared == d.min(axis=1)).all()


def brute_clusters(good, clusters=40, rounds=5):
    rows = [(i, integers(v)) for i, v, _ in good]
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    final = brute_rounds([v for _, v in rows], [v for _, v in order[:clusters]], rounds)
    got = [(i, *brute_nearest(v, final)) for i, v in rows]
    sums = {}
    for _, k, d in got:
        sums[k] = sums.get(k, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final]
    return sorted(((i, k, d, sums[k], sum(sums.values()), sha[k]) for i, k, d in got), key=str)


@pytest.mark.parametrize("n", [150, 25])
def test_centroids(rows, n):
    good, bad = odd_vectors(8, n, 64)
    if n == 25:
        good = good[:20]
    bad += [(9100, [1.0] * 63, 1), (9101, [1.0] * 65, 1), (9102, [], 1)]
    out = centroids.cluster(rows(good + bad, VEC).withColumns({"v": F.lit(1), "cluster": F.lit(2), "_v": F.lit(3)}))
    assert collected(out) == brute_clusters(good)
    assert centroids.cluster(rows([], VEC)).count() == 0


LETTERS = [*"abcdefghij thein's'rellOÉé́ßΣσΟ1½２ \n\t\x0b\x1c\x85\xa0 !?.,<|>日本한ᄒ\U0001f600‍", "<|endoftext|>", "<|startoftext|>", "'ll", "İ", "  ", " the "]
CODECS = {}


def codec(name):
    import tokenizers

    if name not in CODECS:
        CODECS[name] = (bpe.Codec.load(tokenizer_path(name)), tokenizers.Tokenizer.from_file(tokenizer_path(name)))
    return CODECS[name]


def as_library(name, texts):
    own, lib = codec(name)
    ids, edges = own.encode_all(pa.array(texts, pa.string()))
    decoded = own.decode_all(ids, edges)
    for k, t in enumerate(texts):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert ids[edges[k]:edges[k + 1]].tolist() == want == own.encode(t or "").tolist()
        assert decoded[k].decode() == lib.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(LETTERS), max_size=40).map("".join) | st.text(max_size=30) | st.none(), max_size=12))
def test_bpe_as_the_library(name, texts):
    as_library(name, texts)


def test_bpe_long_words_and_texts():
    rng = random.Random(9)
    as_library("word_bpe_49k.json", ["lorem" * 20_000, "".join(rng.choice("abcdeé") for _ in range(60_000)), "", "a " * 100_000, None, "<|endoftext|>" * 3, " \n\t"])
    assert codec("word_bpe_49k.json")[0].by_word and not codec("byte_bpe_50k.json")[0].by_word


def test_bpe_forgets_words(monkeypatch):
    own = bpe.Codec.load(tokenizer_path())
    monkeypatch.setattr(bpe, "CACHE", 3)
    assert own.encode_all(pa.array(["a b c d e f a"]))[0].tolist() == codec("word_bpe_49k.json")[1].encode("a b c d e f a", add_special_tokens=False).ids
    assert len(own.known) <= 3


def test_bpe_tables(rows):
    texts = [None, "", "The cat's 12 hats", "The cat's 12 hats", "x" * 5000, "<|startoftext|>Ä b"]
    docs = rows([(None if i == 2 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"ids": F.lit("x"), "n_tokens": F.lit(1)})
    lib = codec("word_bpe_49k.json")[1]
    out = bpe.digests(docs, tokenizer_path()).collect()
    assert len(out) == len(texts) and sum(r.doc_id is None for r in out) == 1
    for r in out:
        t = texts[2 if r.doc_id is None else r.doc_id] or ""
        ids = lib.encode(t, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    coded = bpe.encode(docs, tokenizer_path())
    back = {r.doc_id: r.text for r in bpe.decode(coded, tokenizer_path()).collect()}
    assert back[0] is None and back[1] == "" and back[3] == "the</w> cat</w> 's</w> 1</w> 2</w> hats</w>"
    loose = rows([(1, [320, None, 99_999_999, 320]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(loose, tokenizer_path()).collect()}
    assert got == {1: lib.decode([320, 320]), 2: None, 3: ""}
    assert bpe.digests(docs.limit(0), tokenizer_path()).count() == 0
