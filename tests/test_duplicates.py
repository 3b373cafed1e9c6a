"""Near and fuzzy duplicates against brute force."""

import difflib
import random

import numpy as np
import pytest

from spindrift import queries
from spindrift.operators import duplicates


def crowd(n=300):
    """Rows that share a long passage: most are unlike, a quarter are near copies of an earlier one."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(120)]
    rows = []
    for i in range(n):
        if i % 4 == 3:
            w = rows[rng.randrange(len(rows))][1].split()
            for at in rng.sample(range(len(w)), rng.randint(5, 9)):
                w[at] = f"z{i}"
        else:
            w = passage + [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(35, 45))]
        rows.append((i * 1000, " ".join(w)))
    return rows + [(n * 1000 + i, rows[7][1]) for i in range(3)]


def brute_near(rows, similarity=0.7, size=64, window=None):
    bands, depth = duplicates.bands_for(similarity, size)
    import pandas as pd

    sigs = [np.frombuffer(x, np.int64) for x in duplicates._signature(size, 3).func(pd.Series([t for _, t in rows]))]
    out = {}
    for j in range(len(rows)):
        best = None
        for i in range(j):
            if window is not None and j - i > window:
                continue
            eq = sigs[i] == sigs[j]
            if any(eq[b * depth : (b + 1) * depth].all() for b in range(bands)):
                e = eq.sum() / size
                if e >= similarity and (best is None or e > best[1]):
                    best = (rows[i][0], e)
        if best:
            out[rows[j][0]] = best
    return out


@pytest.mark.parametrize("block", [2048, 20])
def test_near_pairs_verify_every_row_of_a_bucket(spark, monkeypatch, block):
    monkeypatch.setattr(duplicates, "BLOCK", block)
    rows = crowd()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.b: (r.a, r.estimate) for r in duplicates.near_pairs(df, "doc_id", "text", window=None).collect()}
    assert got == brute_near(rows)
    assert len(got) > 40


def test_near_pairs_of_distant_keys(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (90_000_000, text), (180_000_000, text + " end")], "doc_id long, text string")
    assert {(r.a, r.b) for r in duplicates.near_pairs(df, "doc_id", "text").collect()} == {(1, 90_000_000), (1, 180_000_000)}
    assert duplicates.near_pairs(df, "doc_id", "text", window=50_000).collect() == []


def difflib_ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


@pytest.mark.parametrize("small,matches", [(0, 0), (0, 300), (2500, 1_000_000)])
def test_likeness_equals_difflib(monkeypatch, small, matches):
    monkeypatch.setattr(duplicates, "_SMALL", small)
    monkeypatch.setattr(duplicates, "_MATCHES", matches)
    rng = random.Random(9)
    for _ in range(60):
        letters = rng.choice(["ab", "abc def", "é😀xyz ab"])
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))
        a = (a[:7] * 40)[:300] if rng.random() < 0.3 else a
        c = list(a)
        for _ in range(rng.randint(0, 20)):
            i = rng.randrange(len(c) + 1)
            c[i : i + rng.randint(0, 5)] = rng.choice(letters) * rng.randint(0, 3)
        b, want = "".join(c), difflib_ratio(a, "".join(c))
        assert duplicates.likeness(a, b) == want
        assert duplicates.likeness(a, b, 0.9) == (want if want >= 0.9 else -1)


def test_dup_fuzzy_confirms_near_copies_of_documents(spark, tmp_path):
    rows = [(i, " ".join(t.split()[:150])) for i, t in crowd(80)]
    rng = random.Random(3)
    long = [f"v{rng.randrange(3000)}" for _ in range(20_000)]
    rows += [(10**6, " ".join(long)), (10**6 + 1, " ".join(w if i % 97 else "changed" for i, w in enumerate(long)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    text = dict(rows)
    want = {}
    for b, (a, e) in brute_near(rows).items():
        r = difflib_ratio(text[a], text[b]) if b < 10**6 else duplicates.likeness(text[a], text[b])
        if r >= 0.9:
            want[b] = (a, e, r)
    got = {r.b: (r.a, r.estimate, r.ratio) for r in queries.dup_fuzzy(spark, str(tmp_path)).collect()}
    assert got == want
    assert 10**6 + 1 in got and sum(text[a] != text[b] for b, (a, _, _) in got.items()) > 5
