"""Near-duplicates, packing, lines, pieces, passages, personal data and language, on small tables against brute force."""

import random
import re
import time
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from netlens.llm import common, langid, lines, packing, pii, simhash, substring
from netlens.llm.common import components
from netlens.llm.pieces import Pieces, decode, digests, encode
from netlens.llm.queries import tokenizer_path
from netlens.llm.tokens import tokens

DOC = "doc_id long, text string"
ODD = [(None, "a b c d e"), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "x " * 5000), (6, "Ünï cödé   words"), (7, "a b c d e")]
WORDS = [f"w{i}" for i in range(400)]


def odd(rows):
    """Nulls, empty, blank, repeated and long texts, and columns whose names clash with the operators' own."""
    data = [(d, t, "s", 1, "k", 5) for d, t in ODD]
    return rows(data, "doc_id long, text string, source string, key int, v string, fp long")


def root_of(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def texts(n, seed, length=60):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(5, length))) for _ in range(n)]


def test_scratch_tables_leave_no_shuffle_files(spark, rows):
    """What a scratch table was shuffled through goes when it is written, so a job's disk is that of one step, and a repeated job's, too."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {x for x in (f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles())) if x.startswith("shuffle_")}
    before = held()
    table = common.materialise(rows([(i,) for i in range(1000)], "a long").repartition(4, "a").groupBy((F.col("a") % 7).alias("g")).count())
    end = time.time() + 3  # the driver's garbage may be collected later
    while held() - before and time.time() < end:
        time.sleep(0.2)
    assert not held() - before
    assert sum(r["count"] for r in table.collect()) == 1000


@pytest.mark.parametrize("fold", [1 << 18, 0])
def test_components(rows, monkeypatch, fold):
    """By star rounds alone, and folded in one task."""
    monkeypatch.setattr(common, "FOLD", fold)
    rng = random.Random(2)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(999, i) for i in range(300, 340)]
    want = root_of(edges, {x for e in edges for x in e})
    got = {r.node: r.root for r in components(rows(edges, "u long, v long")).collect()}
    assert {k: got.get(k, k) for k in want} == want
    assert components(rows([], "u long, v long")).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [t for _, t in ODD] + texts(20, 3))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_simhash_groups(rows):
    rng, base = random.Random(4), texts(30, 5, 200)
    data = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = "changed"
        data.append((100 + i, " ".join(words)))
    data += [(200, base[0]), (201, base[0])]
    fps = {d: brute_fingerprint(t) for d, t in data}
    want = root_of([(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3], fps)
    got = {r.doc_id: (r.component_id, r.fingerprint) for r in simhash.near_duplicates(rows(data, DOC)).collect()}
    assert got == {d: (want[d], f"{fps[d]:016x}") for d in fps}


def test_bk_trees_of_crowded_shards(rows, monkeypatch):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    values = list({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = root_of([(a, b) for a, b in combinations(range(len(values)), 2) if (values[a] ^ values[b]).bit_count() <= 3], range(len(values)))
    for crowd in (4096, 20):
        monkeypatch.setattr(simhash, "SHARD_ROWS", crowd)
        links = [(signed.index(r.u), signed.index(r.v)) for r in simhash.near_links(rows([(v,) for v in signed], "fp long")).collect()]
        assert root_of(links, range(len(values))) == want


def test_simhash_odd_rows(rows):
    out = simhash.near_duplicates(odd(rows)).collect()
    assert len(out) == len(ODD)
    zero = [r for r in out if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {1, 2, 3} and {r.component_id for r in zero} == {1}
    assert {r.component_id for r in out if r.doc_id is None} == {7}
    kept = simhash.one_of_each(odd(rows))
    assert kept.columns == odd(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7]
    assert simhash.near_duplicates(rows([], DOC)).count() == 0


def check_packing(data, pieces, length):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    todo = {}
    for d, t in data:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        todo.setdefault(d, []).append(ids)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for d, copies in todo.items():
        assert sum(p.length for p in by_doc[d]) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for p in sorted(by_doc[d], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(copies[0])
                assert p.ids_crc32 == zlib.crc32(np.array(copies[0][at:at + p.length], dtype="<u4").tobytes())
                at += p.length
    seqs = {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append(p)
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    return seqs


def test_packing(spark, rows):
    data = [(i, t) for i, t in enumerate(texts(120, 6, 120))] + [(d, t) for d, t in ((1001, None), (1002, ""), (1003, "x " * 900), (1004, "<|endoftext|> don't É́ ﬁ 東京, a...b 3rd"))]
    df = rows(data, DOC).repartition(40)
    pieces = packing.pack(df, tokenizer_path(), length=256, open_windows=4, fan_in=3).collect()
    seqs = check_packing(data, pieces, 256)
    total = sum(p.length for p in pieces)
    assert len(seqs) <= total / 256 * 1.15 + 4
    assert all(p.start == 0 for p in pieces if p.doc_tokens <= 256)


def test_packed_sequences(rows):
    data = [(i, t) for i, t in enumerate(texts(20, 7, 100))]
    df = rows(data, DOC)
    pieces = packing.pack(df, tokenizer_path(), length=256)
    out = packing.sequences(df, pieces, tokenizer_path(), length=256).collect()
    assert all(len(r.ids) == 256 or len(r.ids) & (len(r.ids) - 1) == 0 for r in out)
    first = min(pieces.collect(), key=lambda p: (p.sequence_id, p.offset))
    ids = next(r.ids for r in out if r.sequence_id == first.sequence_id)
    assert zlib.crc32(np.array(ids[:first.length], dtype="<u4").tobytes()) == first.ids_crc32


@pytest.mark.parametrize("bits", [20, 4])
def test_encoder_equals_library(bits):
    """Ids equal the library's on odd words, special tokens in any case, long words, and with a table that is always too small."""
    encoder = packing.Encoder(tokenizer_path(), bits=bits)
    rng = random.Random(4)
    odd_words = ["<|ENDOFTEXT|>", "<|endoftext|>,", "<|endoftext|>x", "U.S.A.", "it's", "IT'S;", "I.", "9.", "é,", "a\x00b", "\x00", "x" * 70, "x" * 70 + ".", "\u0301", "e\u0301", "ΑΣ", "ΑΣ.", "İ", "\xa0", "a\xa0b", "…", "?!", "字漢", "</w>", "don't", "A" * 300]
    some = [rng.choice(" \t\n\r").join(rng.choice([*odd_words, *WORDS, *(w.upper() + rng.choice(packing.CLOSING) for w in WORDS[:50])]) for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", "  \n"]
    for _ in range(2):
        ids, edges = encoder(pa.array(some, pa.string()), 1)
        for k, text in enumerate(some):
            assert ids[edges[k]:edges[k + 1]].tolist() == [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    encoder.by_word = False
    assert np.array_equal(encoder(pa.array(some, pa.string()), 1)[0], ids)


def test_packing_odd_rows(rows):
    pieces = packing.pack(odd(rows), tokenizer_path()).collect()
    check_packing(ODD, pieces, 2048)
    assert packing.pack(rows([], DOC), tokenizer_path()).count() == 0


def brute_removed(data):
    seen, out = [], set()
    for d, t in sorted(data, key=lambda x: x[0]):
        for i, line in enumerate((t or "").split("\n")):
            w = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))
            if w:
                if any(180 * len(w & x) >= 80 * (len(w) + len(x)) for x in seen):
                    out.add((d, i))
                seen.append(w)
    return out


def mutated_lines(seed, n):
    rng = random.Random(seed)
    base = [[rng.choice(WORDS[:120]) for _ in range(rng.choice([1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 20, 40, 90]))] for _ in range(50)]
    data = []
    for d in range(n):
        text = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, max(1, len(w) // 8))):
                k = rng.randrange(len(w))
                w[k:k + 1] = rng.choice([[], [rng.choice(WORDS)], [w[k], rng.choice(WORDS)]])
                if not w:
                    break
            text.append(" ".join(w))
        data.append((d, "\n".join(text)))
    return data


@pytest.mark.parametrize("crowd", [2000, 3])
def test_lines_against_brute_force(rows, monkeypatch, crowd):
    monkeypatch.setattr(lines, "CROWD", crowd)
    data = mutated_lines(11 + crowd, 120)
    out = lines.line_dedup(rows(data, DOC)).collect()
    got = {(r.doc_id, x.line_no) for r in out if r.removed for x in r.removed}
    assert got == brute_removed(data)
    assert len(out) == len(data)


def late_order(seed):
    """Chains Z~Y~X of ten-word lines, not Z~X, with X after Y in one document: whichever set key is less, some X stand before Y by it.
    Rows are shuffled, and some documents come again with a greater id, so that a task reads a later place first."""
    rng = random.Random(seed)
    data = []
    for f in range(60):
        w = [f"r{f}x{k}" for k in range(7)] + [f"c{k}" for k in range(3)]
        y, z, x = w, [*w[:9], "c4"], [*w[:7], "c0", "c5", "c2"]
        data += [(3 * f, " ".join(z)), (3 * f + 1, "\n".join(map(" ".join, (y, x)))), (3 * f + 2, "\n".join(map(" ".join, rng.sample([x, y, z], 3))))]
    rng.shuffle(data)
    return data


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_are_earlier_by_their_first_places(rows, monkeypatch, seed):
    monkeypatch.setattr(lines, "CROWD", 50)
    data = late_order(seed)
    got = {(r.doc_id, x.line_no) for r in lines.line_dedup(rows(data, DOC)).collect() if r.removed for x in r.removed}
    assert got == brute_removed(data)


def brute_lines(data):
    """(n_links, class_id, removed lines) of each document."""
    lines_of = [(d, i, frozenset(w)) for d, t in sorted(data) for i, line in enumerate((t or "").split("\n")) if (w := re.findall(r"[^\x20\x09-\x0D]+", line))]
    pairs = [(a, b) for a, b in combinations(range(len(lines_of)), 2) if 180 * len(lines_of[a][2] & lines_of[b][2]) >= 80 * (len(lines_of[a][2]) + len(lines_of[b][2]))]
    root = root_of(pairs, range(len(lines_of)))
    out = {d: [0, d, set()] for d, _ in data}
    for a, b in pairs:
        out[lines_of[a][0]][0] += 1
        out[lines_of[b][0]][0] += 1
        out[lines_of[b][0]][2].add(lines_of[b][1])
    for k, (d, _, _) in enumerate(lines_of):
        out[d][1] = min(out[d][1], lines_of[root[k]][0])
    return {d: (n, c, r) for d, (n, c, r) in out.items()}


@pytest.mark.parametrize(("crowd", "cell", "bucket"), [(2000, 512, 200_000), (5, 4, 20), (40, 16, 3)])
def test_lines_links_and_classes(rows, monkeypatch, crowd, cell, bucket):
    """All links are found, however groups and buckets are cut: with small cells, hot buckets and crowds as without."""
    for k, v in (("CROWD", crowd), ("CELL", cell), ("BUCKET", bucket), ("HOT", 1)):
        monkeypatch.setattr(lines, k, v)
    data = mutated_lines(5, 150) + [(1000 + k, " ".join(f"h{j}" for j in range(40) if j != k % 37) + f" t{k}") for k in range(90)]
    got = {r.doc_id: (r.n_links, r.class_id, {x.line_no for x in r.removed or []}) for r in lines.line_dedup(rows(data, DOC).repartition(5)).collect()}
    assert got == brute_lines(data)


def test_lines_long_lines(rows):
    """Sizes and places past 65535 words: a shared word at 65534 and 65536, and a line that is too short to match."""
    long = [f"q{k}" for k in range(70_000)]
    data = [(1, " ".join(long)), (2, " ".join([*long[5:], "z1", "z2"])), (3, " ".join(long[:50_000]))]
    got = {r.doc_id: (r.n_links, r.n_removed) for r in lines.line_dedup(rows(data, DOC)).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (0, 0)}


def test_lines_odd_rows(rows):
    out = lines.line_dedup(odd(rows)).collect()
    assert len(out) == len(ODD)
    lost = {r.doc_id: r.n_removed for r in out}
    assert lost[7] == 1 and lost[None] == 0 and lost[4] == 0 and lost[1] == 0
    kept = lines.deduplicated(odd(rows))
    assert kept.columns == odd(rows).columns and kept.count() == len(ODD)
    assert {r.doc_id: r.text for r in kept.collect()}[7] == ""
    assert lines.line_dedup(rows([], DOC)).count() == 0


def test_tokens():
    data = ["a bb\n c", None, "", "\n\nx", "y"]
    t = tokens(pa.array(data))
    assert t.rows.tolist() == [0, 0, 0, 3, 4] and t.lines.tolist() == [0, 0, 1, 2, 0]
    assert len(set(t.hashes.tolist())) == 5
    assert tokens(pa.array(["Ab É", "ab É"]), lower=True).hashes[[0, 1]].tolist() == tokens(pa.array(["ab É"])).hashes.tolist()
    assert len(tokens(pa.array([None, ""], pa.string())).hashes) == 0


def test_pieces_against_the_library():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model, library, rng = Pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(12)
    for k in range(3000):
        text = "".join(rng.choice("ab  ▁\n\tthe ing éß中😀.,") for _ in range(rng.randint(0, 30)))
        if k % 3 == 0:
            text = " " * rng.randint(0, 20) + text
        ids = np.frombuffer(model.encode(text), dtype="<u4")
        assert ids.tolist() == library.encode(text)
        assert model.decode(ids) == text.replace("▁", " ")


def test_unigram_pass_is_the_best_sum():
    pieces, scores = ["<unk>", "▁", "a", "b", "▁a", "ab", "ba", "aba"], [0, -2.0, -3.0, -3.1, -3.5, -4.0, -4.2, -5.5]
    model = Pieces(pieces, scores, {0}, {}, 0, kind="unigram")

    def best(text):
        if not text:
            return 0.0
        return max((scores[i] + best(text[len(p):]) for i, p in enumerate(pieces) if i and text.startswith(p)), default=-1e9)

    rng = random.Random(13)
    for _ in range(200):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        ids = np.frombuffer(model.encode(word), dtype="<u4").tolist()
        assert "".join(pieces[i] for i in ids) == "▁" + word and abs(sum(scores[i] for i in ids) - best("▁" + word)) < 1e-9


def test_pieces_round_trip(rows):
    path = tokenizer_path("piece_bpe_32k.model")
    df = odd(rows)
    back = decode(encode(df, path), path)
    assert sorted(map(str, [(r.doc_id, r.text) for r in back.collect()])) == sorted(map(str, ODD))
    out = digests(df, path).collect()
    assert len(out) == len(ODD) and all(r.round_trip for r in out)
    assert digests(rows([], DOC), path).count() == 0


def test_compact_windows():
    rng = np.random.default_rng(14)
    v = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    got = set(zip(*[x.tolist() for x in substring.compact_windows(v, np.array([0]), np.array([200]), 9)], strict=True))
    for i in range(200):
        for j in range(i + 8, 200):
            c = i + int(v[i:j + 1].argmin())
            assert any(x <= i and y == c and j <= z for x, y, z in got)


def test_equal_runs():
    e = np.ones(120, dtype=bool)
    e[60:65] = False
    assert substring.equal_runs(e) == [(0, 120)]
    e[60:90] = False
    assert substring.equal_runs(e) == [(0, 60)]
    assert substring.equal_runs(np.ones(45, dtype=bool)) == []


def test_shared_passages(rows):
    rng = random.Random(15)
    fresh = lambda n: [f"{rng.choice(WORDS)}{rng.randint(0, 10**6)}" for _ in range(n)]
    passage, phrase = fresh(70), fresh(20)
    near = list(passage)
    near[35] = "edited"
    data = [(0, fresh(100)), (1, fresh(40) + passage + fresh(30)), (2, fresh(10) + passage + fresh(90)), (3, fresh(60) + near + fresh(5)), (4, fresh(50) + phrase + fresh(50)), (5, fresh(30) + phrase + fresh(60)), (6, fresh(45)), (7, None)]
    data = [(d, None if w is None else " ".join(w)) for d, w in data]
    data += [(10 + i, data[0][1]) for i in range(3)]
    out = {r.doc_id: r for r in substring.substring_dedup(rows(data, DOC)).collect()}
    assert {d: out[d].class_id for d in out} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 10: 0, 11: 0, 12: 0}
    assert (10, 80) in {(s.start, s.end) for s in out[2].spans}
    assert out[4].n_links == 0 and out[5].n_repeated == 0 and out[1].n_repeated == 0
    clean = {r.doc_id: r.text for r in substring.without_repeats(rows(data, DOC)).collect()}
    assert clean[1] == data[1][1] and len(clean[2].split()) == 100


def passage_corpus(seed, families=40):
    """Documents with planted passages, and which passage each has: copied as they are, with words replaced, inserted or left out, next to
    lines that stand in many documents and once more inside some passages; and documents with nothing in common."""
    rng = random.Random(seed)
    fresh = lambda n: [f"{rng.choice(WORDS)}{rng.randint(0, 10**6)}" for _ in range(n)]
    line, data, family = fresh(20), [], {}
    for f in range(families):
        passage = fresh(rng.randint(55, 140))
        if f % 4 == 0:
            passage = line + passage  # a line that comes before the passage as well
        for _ in range(rng.randint(2, 5)):
            w = list(passage)
            kind, n = rng.choice(["same", "same", "replaced", "inserted", "left out"]), max(1, len(w) // 70)
            for _ in range(n if kind != "same" else 0):
                k = rng.randrange(len(w))
                w[k:k + 1] = {"replaced": fresh(1), "inserted": [w[k], *fresh(1)], "left out": []}[kind]
            text = fresh(rng.randint(0, 80)) + (line if rng.random() < 0.5 else []) + fresh(5) + w + fresh(rng.randint(0, 80))
            data.append((len(data), " ".join(text)))
            family[len(data) - 1] = f
    for _ in range(40):
        data.append((len(data), " ".join(fresh(60) + line + fresh(60))))
    return data, family


def brute_passages(data):
    """Pairs of documents with 50 equal words in a row."""
    at, out = {}, set()
    for d, t in data:
        w = t.split()
        for i in range(len(w) - 49):
            at.setdefault(" ".join(w[i:i + 50]), set()).add(d)
    for docs in at.values():
        out |= set(combinations(sorted(docs), 2))
    return out


def test_passages_against_brute_force(rows):
    """Every pair with an equal passage is of one class but for a few, near passages nearly as often, and clean documents stay alone; the
    number of partitions makes no difference."""
    data, family = passage_corpus(21)
    data += [(1000 + k, data[k][1]) for k in range(0, 60, 3)]
    results = [sorted(map(repr, substring.substring_dedup(rows(data, DOC).repartition(n)).collect())) for n in (1, 7, 50)]
    assert results[0] == results[1] == results[2]
    class_of = {r.doc_id: r.class_id for r in substring.substring_dedup(rows(data, DOC)).collect()}
    pairs = brute_passages(data)
    assert sum(class_of[a] == class_of[b] for a, b in pairs) >= 0.97 * len(pairs)
    near = [(a, b) for a, b in combinations(family, 2) if family[a] == family[b]]
    assert sum(class_of[a] == class_of[b] for a, b in near) >= 0.9 * len(near)
    assert not any(class_of[a] == class_of[b] for a, b in combinations(family, 2) if family[a] != family[b])
    assert all(class_of[d] == d for d in range(len(family), len(family) + 40))


def test_passages_of_one_word_over_and_over(rows):
    """Texts that repeat one word, or a few, have shallow trees and few pairs."""
    data = [(k, "x " * (3000 + k)) for k in range(4)] + [(10 + k, "a b c " * (900 + k)) for k in range(3)]
    out = {r.doc_id: r.class_id for r in substring.substring_dedup(rows(data, DOC)).collect()}
    assert out == {0: 0, 1: 0, 2: 0, 3: 0, 10: 10, 11: 10, 12: 10}


def test_passages_odd_rows(rows):
    out = substring.substring_dedup(odd(rows)).collect()
    assert len(out) == len(ODD) and all(r.class_id == r.doc_id for r in out)
    assert substring.substring_dedup(rows([], DOC)).count() == 0


BASE = [re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")) or kind == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_against_plain_patterns():
    rng = random.Random(16)
    for k in range(20000):
        text = "".join(rng.choice("aZ1209.@-+ ()_é\n" if k % 2 else "0123456789..-+ 4") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute_spans(text)


@pytest.mark.parametrize("text, kind, hidden", [
    ("write to john.doe at mail dot example dot com now", 0, "john.doe at mail dot example dot com"), ("mail j０hn＠еxample.com x", 0, "j０hn＠еxample.com"), ("jane[at]foo.org", 0, "jane[at]foo.org"), ("it is at noon. Then he came.", None, ""),
    ("call plus four four two zero seven nine four six oh nine five eight today", 3, "plus four four two zero seven nine four six oh nine five eight"), ("one nine two dot one six eight dot one dot two five", 1, "one nine two dot one six eight dot one dot two five"),
    ("the look at the house", None, ""), ("one or two or three or four", None, ""), ("é at é dot é", None, "")])
def test_disguises(text, kind, hidden):
    base, added = pii.scan(text)
    assert not base
    assert [(k, text[s:e]) for s, k, e in added] == ([] if kind is None else [(kind, hidden)])


@pytest.mark.parametrize("kind, hidden", [
    (1, "192 dot 168 dot 10 dot 25"), (1, "192[.]168[.]10[.]25"), (1, "192 (dot) 168 (dot) 10 (dot) 25"), (1, "192.168.one.25"), (0, "john.doe at example.com"),
    (3, "+1 four one five 555 01 99"), (3, "plus double four double two triple seven double one double nine"),
    (0, "a dot b dot c dot d dot e dot f at mail dot example dot com"), (0, " dot ".join(["abcdefgh"] * 12) + " (at) example.org")])
def test_disguises_of_every_form(kind, hidden):
    text = f"so {hidden} it is"
    base, added = pii.scan(text)
    assert [(k, text[s:e]) for s, k, e in added if k == kind] == [(kind, hidden)]
    assert hidden not in pii.mask(text)


@pytest.mark.parametrize("text", ["we look at example.com and one of 3 two point 5 tables", "version 1 point 2, one. two. +1 or three"])
def test_prose_is_no_disguise(text):
    assert pii.scan(text) == ([], [])


def test_pii_odd_rows(rows):
    out = pii.find_pii(odd(rows)).collect()
    assert len(out) == len(ODD) and all(r.spans == "" for r in out)
    data = rows([(1, "mail a@b.co or +1 (017) 555-7713", 9)], "doc_id long, text string, spans int")
    r = pii.find_pii(data).first()
    assert (r.n_email, r.n_phone, r.spans) == (1, 1, "email:5:11,phone:15:32")
    assert pii.masked(data).first().text == "mail [EMAIL] or [PHONE]"
    assert pii.masked(odd(rows)).columns == odd(rows).columns
    assert pii.find_pii(rows([], DOC)).count() == 0


def test_langid(spark, rows):
    rng = random.Random(17)
    words = {"aa": ["the", "and", "ing", "tion", "er"], "bb": ["und", "sch", "ich", "ei", "en"], "cc": ["que", "la", "os", "ción", "ra"]}
    data = [(i, " ".join("".join(rng.choice(words[x]) for _ in range(2)) for _ in range(30)), x) for i in range(300) for x in [rng.choice(list(words))]]
    data += [(900, None, "aa"), (901, "123 ...", "aa"), (902, "", None), (None, "und schich", None)]
    df = rows(data, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.identify(df).collect()}
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[None].lang_pred == "bb" and not out[None].held_out
    held = [(out[d].lang_pred, x) for d, _, x in data[:300] if out[d].held_out]
    assert len(held) > 60 and all(a == b for a, b in held)
    assert all(0 <= r.score <= 1 for r in out.values())
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(300))
    assert langid.identify(rows([], "doc_id long, text string, lang string")).count() == 0
    unlabelled = rows([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(unlabelled).first().lang_pred == "und"


def test_grams_of_long_texts_in_blocks(monkeypatch):
    """Blocks give the same n-grams as the whole text, wherever they are cut."""
    rng = random.Random(3)
    text = "".join(rng.choice("abcÄé  .,9\n ") for _ in range(5000))
    whole = np.sort(langid.grams(text))
    for block in (1, 7, 64, 1000):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert np.array_equal(np.sort(langid.grams(text)), whole)


def test_many_languages(rows):
    """Three hundred languages, each with words of its own."""
    said = lambda k: " ".join(f"{chr(0x4E00 + 7 * k)}{chr(0x4E01 + 7 * k)}" for _ in range(12))
    model = langid.train(rows([(f"l{k:03}", said(k)) for k in range(300)], "lang string, text string"))
    assert len(model.languages) == 300
    assert [langid.Model.predict(model, said(k))[0] for k in (0, 150, 299)] == ["l000", "l150", "l299"]


@pytest.mark.parametrize("size, words, changed", [(40, 60, 1), (20, 80, 1)])
def test_families_of_near_copies(rows, size, words, changed):
    """Passages of a family differ by a word at different places, so only some pairs share a passage: links, classes and repeats against all
    pairs, in 1 and 5 partitions."""
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    made = []
    for family in range(4):
        passage = [word() for _ in range(words)]
        for _ in range(size):
            copy = list(passage)
            for _ in range(changed):
                copy[rng.randrange(words)] = word()
            made.append((family, copy, " ".join([word() for _ in range(rng.randint(5, 60))] + copy + [word() for _ in range(rng.randint(5, 60))])))
    rng.shuffle(made)
    n, link = len(made), {i: set() for i in range(len(made))}
    for i in range(n):
        for j in range(i):
            (f, a, _), (g, b, _) = made[i], made[j]
            if f == g and substring.equal_runs(np.array([a[k:k + 5] == b[k:k + 5] for k in range(words - 4)])):
                link[i].add(j)
                link[j].add(i)
    root = list(range(n))
    for i in range(n):
        for j in link[i]:
            old, new = sorted((root[i], root[j]), reverse=True)
            root = [new if r == old else r for r in root]
    df = rows([(i, t) for i, (_, _, t) in enumerate(made)], "doc_id long, text string")
    out = [{r.doc_id: r for r in substring.substring_dedup(df.repartition(k)).collect()} for k in (1, 5)]
    assert out[0] == out[1]
    got = out[0]
    assert sum(got[i].class_id != root[i] for i in range(n)) <= n // 50
    assert all(got[i].n_links <= len(link[i]) for i in range(n)) and sum(got[i].n_links for i in range(n)) >= 0.8 * sum(map(len, link.values()))
    repeats = [i for i in range(n) if any(j < i for j in link[i])]
    assert sum(got[i].n_repeated == 0 for i in repeats) <= len(repeats) // 50
    assert all(got[i].n_repeated == 0 for i in range(n) if not link[i])
