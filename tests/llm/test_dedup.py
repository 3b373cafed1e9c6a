import hashlib
import random
import re

import numpy as np
import pytest

from spindrift.llm import embdedup, minhash, suffixdedup
from spindrift.llm.components import components as spark_components
from spindrift.llm.common import Scratch

from . import data


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", data.ascii_lower(t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_minhash(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                links.append((i, j))
    comp = data.components(len(rows), links)
    least = {}
    for (key, _), c in zip(rows, comp):
        least[c] = min(least.get(c, key), key)
    return {key: (len(s), least[c]) for (key, _), s, c in zip(rows, sets, comp)}


@pytest.mark.parametrize("k,sim", [(3, (85, 100)), (5, (80, 100))])
def test_minhash_equals_brute_force(spark, k, sim):
    docs = data.documents(spark)
    want = brute_minhash(list(enumerate(data.texts())), k, *sim)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.digest(docs, k=k, similarity=sim).collect()}
    assert got == want
    kept = {r.doc_id for r in minhash.keep_one(docs, k=k, similarity=sim).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_minhash_large_region_in_tiny_batches(spark):
    """A hot group of near copies that no batch or partition holds whole."""
    rng = random.Random(4)
    base = data.prose(rng, 150).split()
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(150)] = f"q{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.digest(spark.createDataFrame(rows, "doc_id long, text string"), k=3, similarity=(85, 100)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_minhash(rows, 3, 85, 100)


def test_minhash_large_families(spark, monkeypatch):
    """Near copies and texts that share boilerplate, in blocks and cut into regions."""
    monkeypatch.setattr(minhash, "BLOCK", 12)
    rng = random.Random(8)
    common = data.prose(rng, 60)
    rows = []
    for _ in range(25):
        w = (common + " " + data.prose(rng, 40)).split()
        for _ in range(6):
            v = list(w)
            for _ in range(rng.randint(0, 6)):
                v[rng.randrange(len(v))] = f"q{rng.randrange(999)}"
            rows.append((len(rows), " ".join(v)))
    used = []
    real = minhash._regions
    monkeypatch.setattr(minhash, "_regions", lambda depth: used.append(depth) or real(depth))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.digest(spark.createDataFrame(rows, "doc_id long, text string"), k=3, similarity=(85, 100)).collect()}
    assert got == brute_minhash(rows, 3, 85, 100) and used


def test_depth_of_regions():
    """Regions never go deeper than the depth; sparse neighbours meet at their longest common prefix."""
    lcp = np.array([8, 7, 6, 2, 5, 5, 1, 7, 7, 7, 7, 6])
    assert minhash.joined(lcp, 7).tolist() == [True, True, True, False, True, False, False, True, True, True, True, False]
    k1 = np.array([0x0001000200030004, 0x0001000200030005, 0x0001000200030005], np.int64)
    assert minhash.common(k1, np.array([1, 1, 1 << 40], np.int64)).tolist() == [3, 5]


def test_minhash_repeated_rows_and_empty(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, None), (2, None), (3, "z")]
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.component_id) for r in minhash.digest(spark.createDataFrame(rows, "doc_id long, text string"), k=3).collect())
    assert got == [((False, 1), 1), ((False, 1), 1), ((False, 2), 2), ((False, 2), 2), ((False, 3), 3), ((True, 0), 1)]
    assert minhash.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_path_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (2001, 2000)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(8)
    got = {r.node: r.root for r in spark_components(df, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(50)}, 2000: 2000, 2001: 2000}


def brute_suffix(rows):
    seen, out = set(), {}
    for key, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[key] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot,batch", [(20_000, "10000"), (3, "10000"), (20_000, "6")])
def test_suffix_dedup_equals_brute_force(spark, hot, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.digest(data.documents(spark), hot=hot).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_suffix(enumerate(data.texts()))


def test_difference_cover():
    """Any two offsets are taken into the cover by one shift below the period."""
    cover, v = set(suffixdedup.COVER), suffixdedup.PERIOD
    assert all(any((i + d) % v in cover and (j + d) % v in cover for d in range(v)) for i in range(v) for j in range(v))
    assert suffixdedup.GRAM + v - 1 <= suffixdedup.LENGTH
    off = np.array([0, 99, 250, 250, 350])
    want = [a + p for a, b in ((99, 250), (250, 350)) for p in range(b - a - suffixdedup.GRAM + 1) if p % v in cover]
    assert suffixdedup.samples(off).tolist() == want


@pytest.mark.parametrize("shift", [0, 1, 19, 56, 57, 100])
def test_suffix_dedup_at_every_alignment(spark, shift):
    """Passages that stand at offsets of unlike residues, once or many times, with their edges a byte apart."""
    rng = random.Random(shift)
    passage = data.prose(rng, 80)
    rows = [(i, data.prose(rng, 10)[: 7 * i + shift] + passage[i % 5 : len(passage) - i % 3] + data.prose(rng, rng.randint(0, 30))) for i in range(24)]
    rows += [(90, passage[:99]), (91, passage[1:100]), (92, passage[:100]), (93, "é" * 60 + passage[:160] * 3), (94, "é" * 75)]
    df = spark.createDataFrame([(k, t, 1, 2, "h") for k, t in rows], "doc_id long, text string, __s_doc int, doc int, body string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.digest(df).collect()}
    assert got == brute_suffix(rows)


def test_suffix_dedup_odd_keys(spark):
    t = "abcdefghij" * 5 + "klmnopqrstuvwxyz" * 6
    rows = [(2, t), (2, t), (None, "z" + t), (1, None), (5, "")]
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_bytes, r.n_removed) for r in suffixdedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [g[2] for g in got] == [0, 0, len(t), len(t), 0]
    kept = suffixdedup.remove(data.documents(spark)).collect()
    assert len(kept) == len(data.texts()) and {r.doc_id for r in kept if r.text is None} == {0}
    assert suffixdedup.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:30] + 0.05 * rng.standard_normal((30, 16)), np.repeat(base[:1], 40, 0) + 0.02 * rng.standard_normal((40, 16)), base[:5]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16, [1.0, 2.0]]
    rows += [(n + i, v) for i, v in enumerate(odd)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(n, dtype=bool)
    comp = data.components(len(rows), list(zip(*np.nonzero(near))))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()}
    want = {i: (int(near[i].sum()) if i < n else 0, comp[i]) for i in range(len(rows))}
    assert got == want
    assert embdedup.digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_embedding_blocks(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "BLOCK", 10)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((2, 8)), 45, 0) + 0.03 * rng.standard_normal((90, 8))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embdedup.digest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert got == {i: int(c) for i, c in enumerate(near)}


def test_embeddings_of_odd_sizes_and_repeats(spark):
    """Huge, tiny and scaled vectors, repeated rows, null keys and columns of clashing names."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal(8)
    rows = [(0, v), (1, v * 1e200), (2, v * 1e-200), (2, v * 1e-200), (None, v * 2), (3, -v * 1e300), (4, np.full(8, 5e-324)), (5, np.full(8, 1e308)), (6, rng.standard_normal(8))]
    df = spark.createDataFrame([(k, x.tolist(), 1, 2.0, "c", [3]) for k, x in rows], "vec_id long, embedding array<double>, node int, copies double, code string, bucket array<int>")
    got = sorted(((r.vec_id is not None, r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in embdedup.digest(df).collect())
    five = lambda k: ((True, k), 4, 0, k == 0)
    assert got == [((False, 0), 4, 0, False), five(0), five(1), five(2), five(2), ((True, 3), 0, 3, True), ((True, 4), 1, 4, True), ((True, 5), 1, 4, False), ((True, 6), 0, 6, True)]


def test_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 64))
    y, signs, factor = embdedup.encode(x, 256)
    e, err = embdedup.estimates(y, signs, factor)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    off = ~np.eye(300, dtype=bool)
    gap = (e - u @ u.T)[off]
    assert abs(gap.mean()) < 0.003 and abs(gap).max() < 6 * err.max()
