import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.llm import ctw, decontam, langid, quality, secrets
from spindrift.llm.common import held_out

from . import data


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", data.ascii_lower(t or ""))


def brute_decontam(docs, items):
    windows = {}
    for key, t in items:
        w = alnum(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add("null" if key is None else str(key))
    sizes = {len(w) for w in windows}
    out = {}
    for key, t in docs:
        w = alnum(t)
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    names |= got
        out[key] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def benchmark_rows():
    t = data.texts()
    return [(1, t[50]), (2, None), (3, ""), (4, "the of and"), (5, t[9][100:900]), (5, t[60]), (None, t[10].upper()), (20, t[10]), (7, "password hunter2hunter2")]


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 200])
def test_decontamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    bench = spark.createDataFrame(benchmark_rows(), "item_id long, text string")
    docs = data.documents(spark)
    want = brute_decontam(enumerate(data.texts()), benchmark_rows())
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.digest(docs, bench).collect()}
    assert got == want
    kept = decontam.remove(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, v in want.items() if not v[4]}


def test_decontamination_with_more_words_than_sixteen_bits(spark):
    """One item, or items of one block by spaces, with more than 65,535 different words."""
    lists = [[f"n{(i * 7919) % 90_001}" for i in range(80_000)], [f"a{i}" for i in range(40_000)], [f"b{i}" for i in range(40_000)]]
    items = [(1, ",".join(lists[0])), (2, ".".join(lists[1])), (3, "/".join(lists[2]))]
    docs = []
    for k, w in enumerate(lists):
        docs += [" ".join(["x", *w[at : at + 13 + at % 5], *w[at + 500 : at + 510]]) for at in range(k, len(w) - 600, 401)]
    got = decontam.digest(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()}
    assert got == brute_decontam(enumerate(docs), items)


def test_decontamination_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = data.documents(spark)
    assert decontam.remove(docs, bench).count() == docs.count()
    assert decontam.digest(docs.limit(0), bench).collect() == []


def test_longest_matches(spark):
    long = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "x y " + long + " z"), (2, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "a " + long + " b")], "item_id long, text string")
    assert [tuple(r) for r in decontam.matches(docs, bench).collect()] == [(1, "9", 2, 1, 40)]


def test_longest_matches_at_all_places(spark):
    long, short = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("w", 40), ("v", 14)))
    docs = spark.createDataFrame([(1, f"x {long} y {long} z {short} u {short} t"), (2, f"c {short} d {short}")], "doc_id long, text string")
    bench = spark.createDataFrame([(8, "c " + short), (9, "a " + long + " b")], "item_id long, text string")
    assert sorted(tuple(r) for r in decontam.matches(docs, bench).collect()) == [(1, "8", 83, 1, 14), (1, "8", 98, 1, 14), (1, "9", 1, 1, 40), (1, "9", 42, 1, 40), (2, "8", 0, 0, 15), (2, "8", 16, 1, 14)]


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(t):
    t = t or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m.group(2)) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
    return sorted(spans)


def test_secrets_equal_brute_force(spark):
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(data.documents(spark))).collect()}
    assert len(got) == len(data.texts())
    for i, t in enumerate(data.texts()):
        want = brute_secrets(t)
        listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        count = Counter(k for _, _, _, k in want)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (count["assign"], count["access"], count["hex"])
        assert got[i].spans == listed and got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    docs = data.documents(spark)
    different = len({t or "" for t in data.texts()})
    secrets.scan(docs, secrets.BASE_RULES, ledger).collect()
    assert ledger.read().count() == different
    more = docs.union(spark.createDataFrame([(999, "token=newsecret99", None, None, None, *["k", 1, 0.5, 3, "x", 4, "h", "b"])], data.SCHEMA))
    got = secrets.scan(more, secrets.BASE_RULES, ledger)
    assert ledger.read().count() == different + 1 and got.count() == docs.count() + 1
    secrets.scan(more, secrets.RULES, ledger).collect()
    added = ledger.read().where("array_contains(rules, 'pem@1')")
    assert added.count() == different + 1 and added.where("array_contains(rules, 'hex@1')").count() == 0
    assert {r.doc_id: r.spans for r in secrets.digest(secrets.scan(more, secrets.RULES, ledger)).collect()}[999] == "assign:0:17"


def test_redaction(spark):
    docs = data.documents(spark)
    got = secrets.redact(docs)
    assert got.columns == docs.columns
    text = {r.doc_id: r.text for r in got.collect()}
    for i, t in enumerate(data.texts()):
        want, runs = t, []
        for s, _, e, _ in brute_secrets(t):
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(e, runs[-1][1])
            else:
                runs.append([s, e])
        for s, e in reversed(runs):
            want = want[:s] + "[REDACTED]" + want[e:]
        assert text[i] == want


def plain_ctw(train, texts, depth):
    """log10 probabilities of texts by one context tree for each of the eight choices of a byte, node by node."""
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

    def symbols(t):
        return [*(t or "").encode().translate(lower), 0xFF]

    def choices(t):
        past = (0xFE,) * depth
        for byte in symbols(t):
            for i in range(8):
                yield past, ((1 << i) | (byte >> (8 - i))), (byte >> (7 - i)) & 1
            past = (*past[1:], byte)

    count = {}
    for t in train:
        for past, sofar, bit in choices(t):
            for d in range(depth + 1):
                count.setdefault((past[depth - d :], sofar), [0, 0])[bit] += 1
    children = {}
    for past, sofar in count:
        if past:
            children.setdefault((past[1:], sofar), []).append((past, sofar))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    log_pw = {}
    for node in sorted(count, key=lambda x: -len(x[0])):
        own = kt(*count[node])
        log_pw[node] = own if len(node[0]) == depth else float(np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(log_pw[c] for c in children[node])))

    def chance(past, sofar, bit):
        p = 0.5
        for d in range(depth, -1, -1):
            node = (past[depth - d :], sofar)
            if node not in count:
                p = 0.5
                continue
            c = count[node]
            w = 1.0 if d == depth else math.exp(math.log(0.5) + kt(*c) - log_pw[node])
            p = w * (c[bit] + 0.5) / (c[0] + c[1] + 1) + (1 - w) * p
        return p

    return [sum(math.log10(chance(*x)) for x in choices(t)) for t in texts]


def test_context_trees_equal_plain_ones(spark):
    texts = [t if t is None else t[:400] for t in data.texts()[:70]] + ["Aß aab abab", "the of and", None, "", "zzzz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in ctw.score(docs, ~held_out(10, 0), block_bytes=3000).collect()}
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    want = plain_ctw(train, texts, ctw.DEPTH)
    assert all(abs(got[i] - x) < 1e-9 * max(1, abs(x)) for i, x in enumerate(want))


def test_context_trees_of_few_keys_at_once(spark, monkeypatch):
    """Groups larger than what a task takes at once, odd keys and repeated rows."""
    monkeypatch.setattr(ctw, "GROUP_KEYS", 3)
    texts = [(None, "one two"), (None, "one two"), (1, "one"), (1, "one"), (2, None), (None, "three " * 50), (7, "x" * 70_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = ctw.score(docs, ~held_out(10, 0)).collect()
    want = dict(zip([t for _, t in texts], plain_ctw([t for _, t in texts], [t for _, t in texts], ctw.DEPTH)))
    assert len(got) == len(texts) and sorted(r.score for r in got) == pytest.approx(sorted(want[t] for _, t in texts), rel=1e-9)


def test_context_trees_are_distributions():
    key, _ = ctw.keys_of(np.frombuffer(b"abracadabra" * 5 + b"xyz", np.uint8), np.array([0, 20, 20, 58]))
    kinds, n = np.unique(key, return_counts=True)
    top = ctw.Trees(kinds, n).levels[-1]
    up = lambda level, d: ctw.Level(ctw._at(level.code >> 8, d) | (level.code & 0xFF), level.zeros, level.ones, level.log_pw)
    two = up(top, 2)
    one = up(two, 1)
    below = [(c, a, b, np.bincount(np.searchsorted(one.code, ctw._at(two.code >> 8, 1) | (two.code & 0xFF)), weights=two.log_pw)[i]) for i, (c, a, b) in enumerate(zip(one.code, one.zeros, one.ones))]
    upper = ctw.Upper(below)
    sums = np.bincount(np.searchsorted(two.code, ctw._at(top.code >> 8, 2) | (top.code & 0xFF)), weights=top.log_pw)
    lines = next(ctw._lines(upper)(iter([pa.RecordBatch.from_arrays([pa.array(x) for x in (two.code, two.zeros, two.ones, sums)], names=list("abcd"))])))
    above = ctw.Above(lines.column(0).to_numpy(), *(lines.column(i).to_numpy().view(float) for i in (1, 2, 3)), upper)
    for context in (*{int(k) >> 8 for k in kinds}, 0x123456789A):
        asked = (context << 8) | np.arange(256)
        p = 10 ** ctw.Trees(kinds, n).probability(asked, above)
        assert abs(p.sum() - 1) < 1e-9


def test_lgamma():
    x = np.array([0.5, 1.0, 1.5, 7.0, 1000.5])
    assert np.allclose(ctw.lgamma(x), [math.lgamma(v) for v in x], atol=1e-11)


def test_scores(spark):
    got = {r.doc_id: r for r in ctw.score(data.documents(spark), ~held_out(10, 0), block_bytes=4000).collect()}
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", data.ascii_lower(t or "")), None] for t in data.texts()]
    train = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(tokens))]
    c = Counter(w for t, x in zip(tokens, train) if x for w in t)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(tokens)
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (train[i], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) < 1e-6 and r.score < 0
    # blocks don't matter
    again = {r.doc_id: r.score for r in ctw.score(data.documents(spark), ~held_out(10, 0)).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-6 for i in got)
    assert ctw.score(data.documents(spark).limit(0), ~held_out(10, 0)).collect() == []


def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_language_id_learns_every_language(spark):
    rows = [(3 * i + j, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3} {chr(97 + i // 26) * 2}", f"l{i:03}") for i in range(403) for j in range(3)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.languages == sorted({r[2] for r in rows})


def test_language(spark):
    docs, _ = labelled(spark)
    model = langid.train(docs, ~held_out(4, 2))
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(4, 2)).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.98
    odd = {r.doc_id: r for r in langid.predict(data.documents(spark), model).collect()}
    assert len(odd) == len(data.texts())
    for i, t in enumerate(data.texts()):
        if not any(c.isalpha() for c in t or ""):
            assert (odd[i].lang_pred, odd[i].score) == ("und", 0.0)
        else:
            assert odd[i].lang_pred in model.languages and 0 < odd[i].score <= 1
    none = langid.train(docs.limit(0), ~held_out(4, 2))
    assert none is None and {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


def test_quality(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels, ~held_out(5, 0))
    got = quality.predict(docs, model).join(labels, "doc_id").where(held_out(5, 0)).collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9
    odd = quality.predict(data.documents(spark), model).collect()
    assert len(odd) == len(data.texts()) and all(0 <= r.score <= 1 for r in odd)
    kept = quality.accept(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality.predict(docs, model).where("predicted = 1").count()
    none = quality.train(docs, labels.limit(0), ~held_out(5, 0))
    assert none is None and {r.score for r in quality.predict(docs, none).collect()} == {0.5}


def test_prior_from_scores_alone():
    rng = np.random.default_rng(1)
    pos = rng.normal(3, 1, (3000, 2))
    unl = np.concatenate([rng.normal(3, 1, (2100, 2)), rng.normal(-3, 1, (900, 2))])
    assert abs(quality.fit(pos, unl, None).prior - 0.7) < 0.08


def test_secrets_in_a_text_of_very_many(spark):
    """Spans are found in far less than quadratic time, alike in order and place."""
    t = "token=abcdefgh1 - " * 30_000 + "f" * 40 + " password: x " * 5
    got = secrets.digest(secrets.scan(spark.createDataFrame([(1, t), (1, t), (None, t[:400])], "doc_id long, text string"))).collect()
    want = [",".join(f"{k}:{s}:{e}" for s, _, e, k in brute_secrets(x)) for x in (t[:400], t, t)]
    assert [r.spans for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0))] == want
    clean = secrets.redact(spark.createDataFrame([(1, t)], "doc_id long, text string")).first().text
    assert clean == "[REDACTED] - " * 30_000 + "[REDACTED]" + " password: x " * 5
