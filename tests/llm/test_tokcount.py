import random

import public_tokenizers as P
import pytest

from spindrift.llm import tokcount

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def counter():
    return tokcount.Counter(tokcount.read_vocabulary(RANKS), P.PATTERN)


def some_text(rng, n):
    return "".join(rng.choice(["the", " a", "'s", "'", "ll", " ", "  ", "\n", "\n\n", "!", "?!", "12", "é", "中", "x", "Re", "\t", " of the"]) for _ in range(n))


def test_edits_equal_counting_anew(counter):
    rng = random.Random(3)
    for case in range(400):
        text = some_text(rng, rng.choice([0, 1, 5, 60, 400]))
        tree = tokcount.Tree.build(text, counter)
        assert tree.n_tokens == len(counter.encoding.encode_ordinary(text))
        for _ in range(rng.randint(1, 8)):
            at, deleted, inserted = rng.randint(0, len(text) + 2), rng.choice([0, 1, 3, 50, 5000]), some_text(rng, rng.choice([0, 1, 3, 90]))
            tree.edit(at, deleted, inserted, counter)
            at = min(at, len(text))
            text = text[:at] + inserted + text[at + deleted :]
            assert tree.text == text
            assert [n for c in tree.chars for n in c] == [len(p) for p in counter.pattern.findall(text)], case
            assert tree.n_tokens == len(counter.encoding.encode_ordinary(text)), case
            assert tree.char_sum[1] == len(text)


def test_an_edit_touches_little(counter):
    tree = tokcount.Tree.build("the cat sat on the mat. " * 500, counter)
    tree.edit(6000, 1, "dog", counter)
    assert tree.encoded <= 6


def test_rows(spark, counter):
    docs = spark.createDataFrame([(1, "Hello there, it's me"), (2, None), (2, ""), (3, "x")], "doc_id long, text string")
    made = tokcount.trees(docs, RANKS, P.PATTERN)
    got = tokcount.apply_edits(made, tokcount.standard_edits(), RANKS, P.PATTERN).collect()
    assert len(got) == 4
    for r in got:
        assert r.n_tokens == len(counter.encoding.encode_ordinary(r.text))
    assert sorted(r.n_tokens for r in made.collect())[:2] == [0, 0]
    assert tokcount.trees(docs.limit(0), RANKS, P.PATTERN).collect() == []
