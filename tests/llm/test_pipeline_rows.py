"""The pipeline's stages on odd rows: nulls, empties, repeated rows, very long texts, names that clash, an empty table."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netlens.llm import sharding
from netlens.llm.common import materialise

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that stages use inside, and those of their results.
CLASHING = ["kept", "n_words", "component_id", "fingerprint", "start", "length", "doc_tokens", "sequence_id", "offset", "spans", "line", "root", "u", "v", "x0", "q", "shard", "_t", "rep", "uid"]


def odd_documents():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    one = "\n".join(prose(12) for _ in range(6))
    rows = [(i, "\n".join(prose(rng.randint(8, 14)) for _ in range(8)), "en", "s") for i in range(60)]
    rows += [(100, None, "en", "s"), (101, "", None, "s"), (102, " \n\t ", "en", None), (None, one, None, None), (None, None, None, None), (103, one + " tail", "en", "s"), (104, one, "de", "s"), (104, one, "de", "s")]
    rows += [(105, prose(120_000), "en", "s"), (106, "x" * 300_000, "en", "s"), (107, (prose(9) + " write to anna@example.org or +49 30 1234567 \n") * 3 + prose(60), "en", "s"), (108, "\n" * 5000, "en", "s"), (109, "é日本\U0001f600 " * 40, None, "s")]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_documents(), DOCS)
    return df.withColumns({n: F.lit(i).cast("string") if i % 2 else F.lit(i) for i, n in enumerate(CLASHING)})


def test_every_stage_alone_on_odd_rows(spark, odd, small):
    """Each stage on the whole odd table, not only on what the stages before let through."""
    ids = sorted((r.doc_id for r in odd.select("doc_id").collect()), key=str)
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, odd, small), f"odd-{name}", scoped=False)
        got = out.collect()
        if name == "packing":
            assert {r.doc_id for r in got} == set(ids)
            continue
        assert out.columns == odd.columns and out.schema["text"].dataType == odd.schema["text"].dataType
        assert all(r[n] == (str(i) if i % 2 else i) for r in got for i, n in enumerate(CLASHING))
        texts = {}
        for r in got:
            texts.setdefault(r.doc_id, []).append(r.text)
        if name in ("line_dedup", "personal_data"):
            assert sorted((r.doc_id for r in got), key=str) == ids and None in texts[100] and texts[101] == [""] and len(texts[104]) == 2
        if name == "personal_data":
            assert "anna@" not in texts[107][0] and "1234567" not in texts[107][0] and len(texts[106][0]) == 300_000
        if name == "quality_rules":
            assert not {100, 101, 102, 106, 108} & set(texts) and set(range(60)) <= set(texts)
        if name == "near_duplicates":
            assert len(got) < len(ids) and sum(r.text is None or not r.text.strip() for r in got) == 1 and set(range(60)) <= set(texts)


@pytest.mark.parametrize("empty", [False, True])
def test_all_stages_one_after_the_other(spark, odd, small, empty):
    docs = odd.limit(0) if empty else odd
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, small), f"all-{name}", scoped=False)
    got = {r.doc_id for r in docs.collect()}
    assert not got if empty else set(range(60)) <= got and not {100, 101, 102, 106, 108} & got


def test_few_shards_grow_into_themselves(rows):
    df = rows([(i, "t") for i in range(3000)], "doc_id long, text string")
    ten, eleven = (sharding.assign(df, n, base=10).select("doc_id", "shard", "grown_shard").collect() for n in (10, 11))
    assert all(r.grown_shard in (r.shard, 10) for r in ten) and any(r.grown_shard == 10 for r in ten)
    assert {r.doc_id: r.grown_shard for r in ten} == {r.doc_id: r.shard for r in eleven}
    assert all(r.grown_shard in (r.shard, 5) for r in sharding.assign(df, 5).collect())
