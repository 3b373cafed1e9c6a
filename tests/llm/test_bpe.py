import hashlib
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from spindrift.llm import bpe

FILE = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(FILE)
    t.no_padding()
    t.no_truncation()
    return t


def ids_of(texts):
    out = []
    for ids, n in bpe.encode_texts(texts, *bpe.encoder(bpe.read_vocabulary(FILE))):
        at = 0
        for k in n.tolist():
            out.append(ids[at : at + k].tolist())
            at += k
    return out


def odd_texts():
    rng = random.Random(5)
    some = ["", "it's we'LL I'd 'S", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "Été ẞ ΣΑΣ İx ﬁ", "éé", "中文 123 ٣٤ ½", "\u0085x y z\x1cq", "\U0001f600\U0001f469‍\U0001f4bb!!", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "!?" * 300, "\x00\x01\x7f"]
    some += ["".join(rng.choice("abcdehinorst'") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    some += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 900), rng.randint(0x4E00, 0x4F00)])) for _ in range(30)) for _ in range(300)]
    return some


def test_ids_equal_the_library(reference):
    texts = odd_texts()
    want = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(texts) == want


def test_digest_and_round_trip(spark, reference):
    texts = [None, *odd_texts()[:200]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, k string")
    got = {r.doc_id: r for r in bpe.digest(docs, FILE).collect()}
    decoded = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, FILE), FILE).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = reference.encode(t or "", add_special_tokens=False).ids
        back = reference.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest() and decoded[i] == back


def test_empty_table(spark):
    assert bpe.digest(spark.createDataFrame([], "doc_id long, text string"), FILE).collect() == []
