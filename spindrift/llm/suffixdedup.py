"""Removal of repeated substrings of LENGTH bytes or more by a difference cover, one suffix bucket at a time.

A byte goes if it lies in a LENGTH-byte string that also starts earlier (smaller key, or
same document and smaller offset). COVER is a difference cover modulo PERIOD: any two
offsets i and j have a shift below PERIOD that takes both into the cover. So two equal
LENGTH-byte strings hold, at equal places, two cover samples (offsets whose residue is in
COVER) that begin with the same GRAM bytes, and it is enough to sort the samples.

1. A sample has a bucket (by its gram), a rank (a 64-bit name of its gram) and a context
   (the bytes of all LENGTH-byte strings around it). Repeats inside a task are settled
   before anything moves.
2. The BUCKETS are taken one after another: only one bucket's samples are on their way or
   on disk at a time, so memory and disk hold one part of the suffixes. A bucket is sorted
   by rank, context and place, streaming, with the state of one row. A context seen before
   covers all its bytes; ranks of one context are done.
3. Ties in rank with unlike contexts are long ties: the first sample of each context hands
   in its at most 2 * LENGTH bytes, and its strings are compared under that rank, by their
   place against the sample, with those of earlier samples. A rank with more than HOT
   contexts is dealt by string instead, with combined minima; results are the same.
4. Intervals meet their documents, and what they cover is cut.

Ranks are names, which tell equal from unequal: no order of suffixes is needed to find
repeats. Grams, contexts and strings are compared by 64-bit hashes. Defined results: null
is empty; texts shorter than LENGTH keep all, a text may have up to 2**31 - 1 bytes; rows
of one key with one text are one document and get one result each; texts of one key count
as documents ordered by a hash of the text; a null key comes first; an empty table gives
an empty result; other columns, of any name, pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, mix, partitions, prefix_hash, span_hash, text_buffer

LENGTH = 100
#: A perfect difference set: every residue modulo PERIOD is a difference of two of these in one way.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
GRAM = LENGTH - PERIOD + 1  # whole in a string, wherever in the first PERIOD bytes of it a sample stands
BUCKETS = 4
HOT = 20_000
_REACH = LENGTH - GRAM  # a sample is at most so far behind its string's start
_LOW = np.uint64((1 << 31) - 1)
_RESIDUES = np.zeros(PERIOD, bool)
_RESIDUES[list(COVER)] = True
#: Rows of contexts that are compared in one go, at least.
_ROWS = 4096


def samples(off: np.ndarray) -> np.ndarray:
    """Offsets of the cover samples of each text that has LENGTH bytes: those whose distance from the text's start has a residue in COVER, with a whole gram behind them."""
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= LENGTH:
            n = b - a - GRAM + 1
            out.append(a + np.flatnonzero(np.resize(_RESIDUES, n)))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _pack(s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """An interval as a negative long; samples are their offsets, from 0 up."""
    return -((s.astype(np.int64) << 31) | e) - 1


def _unpack(span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = -(span + 1)
    return x >> 31, x & int(_LOW)


def _merged(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the intervals of each document."""
    if not len(doc):
        return doc, s, e
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order], e[order]
    # ends as running maxima within the document: documents are kept apart by an offset
    _, no = np.unique(doc, return_inverse=True)
    far = np.maximum.accumulate(e + no * (1 << 32)) - no * (1 << 32)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s[1:] > far[:-1])
    first = np.flatnonzero(new)
    return doc[first], s[first], far[np.append(first[1:], len(doc)) - 1]


def _rows(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols.values()], names=list(cols))


def _sample(bucket: int, buckets: int):
    """(h, c, doc, span): samples of one bucket with rank and context, and intervals that a task can tell by itself."""

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = batch.column(0).to_numpy()
        buf, off, _ = text_buffer(batch.column(1))
        parts = []
        for i, j in chunks(off):
            b, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
            prefix = prefix_hash(b)
            at = samples(o)
            h = span_hash(prefix, at, at + GRAM)
            mine = h % np.uint64(buckets) == np.uint64(bucket)
            at, h = at[mine], h[mine]
            if not len(at):
                continue
            of = np.searchsorted(o, at, "right") - 1
            lo, hi = np.maximum(o[of], at - _REACH), np.minimum(o[of + 1], at + LENGTH)
            with np.errstate(over="ignore"):
                c = mix(span_hash(prefix, lo, hi) + (at - lo).astype(np.uint64))
            parts.append(np.stack([h.view(np.int64), c.view(np.int64), ids[i:j][of], at - o[of], lo - o[of], hi - o[of]]))
        if not parts:
            return None
        a = np.concatenate(parts, axis=1)
        with np.errstate(over="ignore"):
            a = a[:, np.argsort(mix(a[0].view(np.uint64) + mix(a[1].view(np.uint64))))]
        new = np.ones(a.shape[1], bool)
        new[1:] = (a[:2, 1:] != a[:2, :-1]).any(0)
        # the earliest of each context first; most have one sample
        group, more = np.cumsum(new) - 1, ~new
        more[:-1] |= ~new[1:]
        i = np.flatnonzero(more)
        a[:, i] = a[:, i[np.lexsort((a[3, i], a[2, i], group[i]))]]
        first = np.flatnonzero(new)[group]
        later = ~new & ((a[2] != a[2, first]) | (a[3] != a[3, first]))
        doc, s, e = _merged(a[2][later], a[4][later], a[5][later])
        one, none = a[:, new], np.zeros(len(doc), np.int64)
        reach = (one[3] - one[4]) << 8 | (one[5] - one[3])
        return _rows(h=np.concatenate([one[0], mix(doc.view(np.uint64)).view(np.int64)]), c=np.concatenate([one[1], none]), doc=np.concatenate([one[2], doc]), span=np.concatenate([one[3], _pack(s, e)]), reach=np.concatenate([reach, none]).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (out := of_batch(batch)) is not None:
                yield out

    return run


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (h, c, doc, span): intervals (span < 0), and samples that must hand in their contexts."""
    head: np.ndarray | None = None  # first row of the open (h, c)
    told = False
    for batch in batches:
        if not batch.num_rows:
            continue
        a = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)])
        ready = a[3] < 0
        out_doc, out_h, out_span = [a[2][ready]], [a[0][ready]], [a[3][ready]]
        a = a[:, ~ready]
        if a.shape[1]:
            before = head is not None
            if before:
                a = np.concatenate([head[:, None], a], axis=1)
            new = np.ones(a.shape[1], bool)
            new[1:] = (a[:2, 1:] != a[:2, :-1]).any(0)
            run = np.flatnonzero(new)
            first = run[np.cumsum(new) - 1]
            later = ~new & ((a[2] != a[2, first]) | (a[3] != a[3, first]))
            s, e = a[3] - (a[4] >> 8), a[3] + (a[4] & 255)
            out_doc.append(a[2][later])
            out_h.append(a[0][later])
            out_span.append(_pack(s[later], e[later]))
            # contexts of each bucket in this batch; the open bucket may have had some before
            b = a[:, run]
            new_h = np.ones(len(run), bool)
            new_h[1:] = b[0, 1:] != b[0, :-1]
            at = np.flatnonzero(new_h)
            size = np.diff(np.append(at, len(run)))
            many = size > 1
            known = np.zeros(len(run), bool)
            if before and told:
                many[0] = True
                known[0] = True
            ask = many[np.cumsum(new_h) - 1] & ~known
            out_doc.append(b[2][ask])
            out_h.append(b[0][ask])
            out_span.append(b[3][ask])
            head, told = a[:, run[-1]], bool(many[-1])
        doc, h, span = (np.concatenate(x) for x in (out_doc, out_h, out_span))
        yield _rows(h=h, doc=doc, span=span)


def _context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, doc, at, back, ctx) of each sample that a document is asked for."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        buf, off, _ = text_buffer(batch.column(1))
        asked = batch.column(2)
        count = asked.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = asked.flatten()
        at, h = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(ids)), count)
        lo, hi = np.maximum(off[of], off[of] + at - _REACH), np.minimum(off[of + 1], off[of] + at + LENGTH)
        raw = buf.tobytes()
        for i in range(0, len(of), 100_000):
            ctx = [raw[x:y] for x, y in zip(lo[i : i + 100_000].tolist(), hi[i : i + 100_000].tolist(), strict=True)]
            o = of[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000]), pa.array(ids[o]), pa.array(at[i : i + 100_000]), pa.array(off[o] + at[i : i + 100_000] - lo[i : i + 100_000]), pa.array(ctx, pa.binary())], names=["h", "doc", "at", "back", "ctx"])


def _strings(h: np.ndarray, back: np.ndarray, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, row, start against the sample) of each LENGTH-byte string that holds a row's sample."""
    n = len(h)
    m = np.diff(off) - LENGTH + 1
    row = np.repeat(np.arange(n), m)
    start = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
    prefix = prefix_hash(buf)
    s = off[row] + start
    with np.errstate(over="ignore"):
        name = mix(span_hash(prefix, s, s + LENGTH) + h.view(np.uint64)[row] + (back[row] - start).astype(np.uint64))
    return name.view(np.int64), row, start - back[row]


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over contexts sorted by (h, doc, at): intervals of strings that an earlier sample of the bucket has."""

    def work(t: pa.Table) -> pa.RecordBatch:
        h, doc, at, back = (t.column(k).to_numpy() for k in ("h", "doc", "at", "back"))
        buf, off, _ = text_buffer(t.column("ctx"))
        name, row, start = _strings(h, back, buf, off)
        order = np.argsort(name, kind="stable")
        name, row, start = name[order], row[order], start[order]
        new = np.ones(len(name), bool)
        new[1:] = name[1:] != name[:-1]
        first = row[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = (doc[row] != doc[first]) | (at[row] != at[first])
        d, s = doc[row[later]], at[row[later]] + start[later]
        d, s, e = _merged(d, s, s + LENGTH)
        return _rows(doc=d, span=_pack(s, e))

    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size >= _ROWS:
            t = pa.concat_tables(held)
            h = t.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last bucket may go on
            if cut:
                yield work(t.slice(0, cut))
            held, size = [t.slice(cut)], t.num_rows - cut
    if size:
        yield work(pa.concat_tables(held))


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            t = batch.slice(i, _ROWS)
            h, doc, at, back = (t.column(k).to_numpy() for k in range(4))
            buf, off, _ = text_buffer(t.column(4))
            name, row, start = _strings(h, back, buf, off)
            yield _rows(name=name, doc=doc[row], s=at[row] + start)


def _own(docs: DataFrame) -> str:
    """A prefix that no column of docs has."""
    name = "__s"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    return name


def _numbered(docs: DataFrame, key: str, text: str, scratch: Scratch) -> tuple[DataFrame, bool]:
    """(docs with a long that orders documents and a non-null text, whether a document may have several rows). The two come last.

    Unique long keys serve as they are. Others are sorted by range with their text's hash and
    numbered by partition and row there, which keeps the order without a count of rows."""
    own = _own(docs)
    rows = docs.withColumn(f"{own}_body", F.coalesce(F.col(text), F.lit("")))
    kind = dict(docs.dtypes)[key]
    if kind in ("bigint", "int", "smallint", "tinyint"):
        odd = docs.groupBy(key).agg(F.count("*").alias(f"{own}_n")).where((F.col(f"{own}_n") > 1) | F.col(key).isNull()).limit(1).count()
        if not odd:
            return rows.select(*docs.columns, F.col(key).cast("long").alias(f"{own}_doc"), f"{own}_body"), False
    rows = rows.withColumn(f"{own}_hash", F.xxhash64(f"{own}_body"))
    pairs = rows.select(F.col(key).alias("k"), F.col(f"{own}_hash").alias("h")).distinct()
    order = [F.asc_nulls_first("k"), F.asc("h")]
    numbers = pairs.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn("doc", F.monotonically_increasing_id())
    numbers = scratch.save(numbers).select(F.col("k").alias(f"{own}_k"), F.col("h").alias(f"{own}_h"), F.col("doc").alias(f"{own}_doc"))
    met = rows.join(numbers, F.col(key).eqNullSafe(F.col(f"{own}_k")) & (F.col(f"{own}_hash") == F.col(f"{own}_h")))
    return met.select(*docs.columns, f"{own}_doc", f"{own}_body"), True


def intervals(body: DataFrame, scratch: Scratch, hot: int = HOT, buckets: int = BUCKETS) -> DataFrame:
    """(doc, span) intervals, not yet merged, of what repeats in (doc, body); a document has one row."""
    out = None
    for b in range(buckets):
        told = _of_bucket(body, scratch, hot, b, buckets)
        out = told if out is None else out.union(told)
    return out


def _of_bucket(body: DataFrame, scratch: Scratch, hot: int, bucket: int, buckets: int) -> DataFrame:
    """What the samples of one bucket tell, as a table."""
    parts = partitions(body.sparkSession)
    sampled = body.mapInArrow(_sample(bucket, buckets), "h long, c long, doc long, span long, reach int")
    order = ["h", "c", "doc", "span"]
    found = scratch.save(sampled.repartition(parts, "h").sortWithinPartitions(*order).mapInArrow(_bucket, "h long, doc long, span long"))
    asked = found.where("span >= 0").distinct().groupBy(F.col("doc").alias("d")).agg(F.collect_list(F.struct("span", "h")).alias("asked"))
    contexts = body.join(asked, body["doc"] == asked["d"]).select("doc", "body", "asked").mapInArrow(_context, "h long, doc long, at long, back long, ctx binary")
    contexts = scratch.save(contexts)
    crowded = scratch.save(contexts.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("h"))
    some = not crowded.isEmpty()
    calm = contexts.join(crowded, "h", "left_anti") if some else contexts
    out = calm.repartition(parts, "h").sortWithinPartitions("h", "doc", "at").mapInArrow(_resolve, "doc long, span long")
    if some:
        strings = scratch.save(contexts.join(crowded, "h", "left_semi").mapInArrow(_explode, "name long, doc long, s long"))
        least = strings.groupBy("name").agg(F.min(F.struct("doc", "s")).alias("m"))
        later = strings.join(least, "name").where(F.struct("doc", "s") > F.col("m")).select("doc", (-(F.shiftleft("s", 31) + F.col("s") + LENGTH) - 1).alias("span")).distinct()
        out = out.union(later)
    done = scratch.save(found.where("span < 0").select("doc", "span").union(out).mapInArrow(_merge, "doc long, span long"))
    for t in (found, contexts, crowded, *([strings] if some else ())):
        scratch.drop(t)
    return done


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer intervals that cover the same."""
    for batch in batches:
        doc, (s, e) = batch.column(0).to_numpy(), _unpack(batch.column(1).to_numpy())
        doc, s, e = _merged(doc, s, e)
        yield _rows(doc=doc, span=_pack(s, e))


def _cut(place: int, text: int | None, digest_only: bool):
    """Cuts what the intervals cover. place: the column of (doc, body, spans) begins there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off, _ = text_buffer(batch.column(place))
            spans = batch.column(place + 1)
            count = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = spans.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(count)
            n = batch.num_rows
            size, removed, runs, sha, kept = np.diff(off), np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
            raw = memoryview(buf)
            for i in range(n):
                data = raw[off[i] : off[i + 1]]
                if count[i]:
                    s, e = _unpack(flat[ends[i] - count[i] : ends[i]])
                    _, s, e = _merged(np.zeros(len(s), np.int64), s, e)
                    runs[i], removed[i] = len(s), int((e - s).sum())
                    left = b"".join(bytes(data[a:b]) for a, b in zip([0, *e.tolist()], [*s.tolist(), int(size[i])], strict=True))
                else:
                    left = data
                if digest_only:
                    sha.append(hashlib.sha256(left).hexdigest())
                else:
                    kept.append(bytes(left).decode("utf-8", "ignore"))
            if digest_only:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int64)), pa.array(removed), pa.array(runs), pa.array(sha, pa.string())], names=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            else:
                valid = batch.column(text).is_valid().to_numpy(zero_copy_only=False)
                cols = [batch.column(c) for c in range(place)]
                cols[text] = pa.array([k if v else None for k, v in zip(kept, valid.tolist(), strict=True)], cols[text].type)
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:place])

    return run


def _with_spans(docs: DataFrame, key: str, text: str, hot: int, buckets: int) -> DataFrame:
    """docs with their body and intervals as the last two columns."""
    scratch = Scratch(docs.sparkSession, "suffix")
    rows, several = _numbered(docs, key, text, scratch)
    doc, body = rows.columns[-2:]
    bodies = rows.select(F.col(doc).alias("doc"), F.col(body).alias("body"))
    if several:
        bodies = scratch.save(bodies.dropDuplicates(["doc"]))
    own = _own(rows)
    spans = intervals(bodies, scratch, hot, buckets).groupBy(F.col("doc").alias(f"{own}_of")).agg(F.collect_list("span").alias(f"{own}_spans"))
    return rows.join(spans, F.col(doc) == F.col(f"{own}_of"), "left").select(*docs.columns, body, f"{own}_spans")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    rows = _with_spans(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "k", "t", hot, buckets)
    rows = rows.select("k", *rows.columns[-2:])
    kind = dict(rows.dtypes)["k"]
    return rows.mapInArrow(_cut(1, None, True), f"k {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("k", key)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT, buckets: int = BUCKETS) -> DataFrame:
    """docs without what repeats; a character that a cut parts is dropped whole."""
    rows = _with_spans(docs, key, text, hot, buckets)
    return rows.mapInArrow(_cut(len(docs.columns), docs.columns.index(text), False), docs.schema)
