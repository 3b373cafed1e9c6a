"""Odd rows through every operator: null and repeated keys, repeated rows, ties, empty and very long texts, columns of clashing names."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from spindrift.llm import bpe, ctw, decontam, langid, minhash, quality, secrets, suffixdedup, tokcount
from spindrift.llm.common import held_out

from . import data
from .test_text import brute_decontam, brute_secrets

RNG = random.Random(11)
LONG = data.prose(RNG, 400_000)  # above what one numpy pass takes
TEXTS = [("a", LONG), ("a", LONG), (None, LONG[:500]), (None, LONG[:500]), (1, ""), (1, None), (1, ""), (2, " \n"), (2, "password=abcdefgh1 " * 3), (3, "ÀÉ ß 東京 " * 30), (4, "x" * 5000), (None, None)]
SCHEMA = "doc_id string, text string, k long, t string, h long, node int, doc long, body string, word boolean, block int, span long, lang string, key string"
BENCHMARK = [("i1", " ".join(LONG.split()[1000:1040])), ("i1", "no such words here at all"), (None, " ".join(LONG.split()[5:40])), ("i2", ""), ("i3", None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if k is None else str(k), t, 1, "t", 2, 3, 4, "b", True, 5, 6, "en" if i % 2 else "de", "key") for i, (k, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def texts_of(spark, docs):
    return sorted((r.doc_id or "", r.text or "") for r in docs.collect())


def by_row(rows, *columns):
    return sorted((r.doc_id or "", *(r[c] for c in columns)) for r in rows)


def expected(f):
    return sorted((str(k or ""), *f(t)) for k, t in TEXTS)


def test_language_id(spark, docs):
    model = langid.fit([LONG[i : i + 200] for i in range(0, 8000, 200)] + ["äöü ßéà " * 20] * 20, ["en"] * 40 + ["de"] * 20)
    rows = langid.predict(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert by_row(rows, "lang_pred", "score") == expected(lambda t: _language(model, t))


def _language(model, t):
    b = np.frombuffer((t or "").encode(), np.uint8)
    off = np.array([0, len(b)])
    if not langid._has_letter(b, off)[0]:
        return "und", 0.0
    p = model.probabilities(b, off)[0]
    return model.languages[int(p.argmax())], float(p.max())


def test_decontamination(spark, docs):
    bench = spark.createDataFrame(BENCHMARK, "item_id string, text string")
    rows = decontam.digest(docs, bench).collect()
    want = brute_decontam(list(enumerate(t for _, t in TEXTS)), [("null" if i is None else i, t) for i, t in BENCHMARK])
    assert sorted((r.doc_id or "", r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows) == sorted((str(k or ""), want[i][0], want[i][1], want[i][2], want[i][4]) for i, (k, _) in enumerate(TEXTS))
    assert decontam.remove(docs, bench).columns == docs.columns


def test_minhash(spark, docs):
    rows = minhash.digest(docs, k=3, similarity=(85, 100)).collect()
    assert len(rows) == len(TEXTS)
    got = by_row([r for r in rows if r.doc_id is not None], "component_id")
    assert got == [("1", "1")] * 3 + [("2", "2")] * 2 + [("3", "3"), ("4", "4"), ("a", "a"), ("a", "a")]
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert minhash.keep_one(docs).columns == docs.columns


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()

    def want(t):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))

    assert by_row(bpe.digest(docs, path).collect(), "n_tokens", "ids_sha256", "decoded_sha256") == expected(want)


def test_scores(spark, docs):
    rows = ctw.score(docs, ~held_out(10, 0)).collect()
    assert len(rows) == len(TEXTS) and all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert by_row(rows, "n_tokens") == expected(lambda t: (len((t or "").split()) + 1,))
    scores = {}
    for r in rows:
        scores.setdefault((r.doc_id, r.n_tokens, r.n_bytes), set()).add(r.score)
    assert all(len(s) == 1 for s in scores.values())


def test_quality(spark, docs):
    x = quality._texts_figures([LONG[i : i + 300] for i in range(0, 30_000, 300)])
    y = quality._texts_figures(["!!! $$$ ###"] * 50)
    model = quality.fit(x, np.concatenate([x, y]), None)
    rows = quality.predict(docs, model).collect()
    want = {t: float(quality._scored(__import__("pyarrow").array([t], "string"), model)[0]) for _, t in TEXTS}
    assert by_row(rows, "score") == expected(lambda t: (want[t],))
    assert quality.accept(docs, model).columns == docs.columns


def test_token_counts(spark, docs):
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = tokcount.trees(docs, ranks, pattern).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.n_tokens)
    assert len(rows) == len(TEXTS) and len(set(got["a"])) == 1 and got["a"][0] > 100_000 and sorted(got["1"]) == [0, 0, 0]


def test_secrets(spark, docs):
    rows = secrets.digest(secrets.scan(docs)).collect()
    assert by_row(rows, "spans") == expected(lambda t: (",".join(f"{k}:{s}:{e}" for s, _, e, k in brute_secrets(t)),))
    assert secrets.redact(docs).columns == docs.columns and secrets.redact(docs).count() == len(TEXTS)


def test_suffix_dedup(spark, docs):
    rows = suffixdedup.digest(docs).collect()
    # rows of one key and text are one document; the nulls come first and hold the start of the long text
    assert len(rows) == len(TEXTS) and by_row(rows, "n_bytes") == expected(lambda t: (len((t or "").encode()),))
    for r in rows:
        if r.doc_id == "a":
            assert r.n_removed >= 500 and r.kept_sha256 != hashlib.sha256(LONG.encode()).hexdigest()
        if r.doc_id in (None, "1", "2"):
            assert r.n_removed == 0
    assert suffixdedup.remove(docs).columns == docs.columns
