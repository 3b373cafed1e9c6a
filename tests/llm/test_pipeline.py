"""Each stage against a plain version on its own input."""

import hashlib

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from spindrift.llm import quality
from spindrift.llm.common import held_out

from .test_dedup import brute_minhash
from .test_text import brute_decontam, brute_secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, bench = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]

    def step(name, df):
        rows = [tuple(r) for r in stages[name](spark, df, SF).collect()]
        schema = stages[name](spark, df.limit(0), SF).schema if name == "tokens" else df.schema
        return spark.createDataFrame(rows, schema), {r[0]: r for r in rows}

    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~held_out(5, 0))
    want = {r.doc_id for r in quality.predict(docs, model).where("predicted = 1").collect()}
    a, got = step("quality", docs)
    assert a.columns == columns and set(got) == want and len(want) < docs.count()

    before = {r.doc_id: r.text for r in a.collect()}
    b, got = step("near_duplicates", a)
    assert set(got) == {k for k, (_, c) in brute_minhash(list(before.items()), 5, 80, 100).items() if k == c}

    before = {r.doc_id: r.text for r in b.collect()}
    c, got = step("decontamination", b)
    assert set(got) == {k for k, v in brute_decontam(before.items(), bench).items() if not v[4]}

    before = {r.doc_id: r.text for r in c.collect()}
    e, got = step("secrets", c)
    assert set(got) == set(before)
    for k, t in before.items():
        text = got[k][columns.index("text")]
        assert (text == t) == (not brute_secrets(t)) and not brute_secrets(text) and got[k][columns.index("n_chars")] == len(text)

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in stages["tokens"](spark, e, SF).collect():
        ids = t.encode(got[r.doc_id][columns.index("text")], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, got)) == sorted(map(tuple, docs.collect()))


def test_stages_on_odd_rows(spark):
    """Null and repeated keys and rows, empty and long texts, and columns of clashing names."""
    import random

    from . import data

    long = data.prose(random.Random(5), 90_000)
    texts = [(1, long), (1, long), (2, long), (None, long[:300]), (None, long[:300]), (3, None), (3, ""), (4, "token=abcdefgh9 and more"), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), 1, "x", 2) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long, node int, key string, `__spans` int")
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        none = stage(spark, docs.limit(0), sf)
        assert none.columns == out.columns and none.count() == 0, name
        if name == "tokens":
            assert out.count() == len(texts)
            continue
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        if name == "near_duplicates":
            assert sorted((r.doc_id or 0) for r in rows) == [0, 0, 0, 1, 1, 3, 3, 4]
        elif name == "decontamination":
            assert len(rows) == len(texts)
        elif name == "secrets":
            assert len(rows) == len(texts) and "[REDACTED] and more" in {r.text for r in rows} and sum(r.text is None for r in rows) == 2
            assert all(r.n_chars is None or r.n_chars == len(r.text or "") for r in rows)
        else:
            assert len({(r.doc_id, r.text) for r in rows}) <= len(set(texts))
