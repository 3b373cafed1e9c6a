"""Offline providers behind the model and media generators, in Arrow batches: a mock
language model with a retry ladder and a cache, procedural images and speech, plain PDFs."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that the mock model speaks.
MOCK_WORDS = "request account update device report access service order review status team change issue customer schedule support detail system follow confirm".split()


@F.pandas_udf(T.StringType())
def _mock(prompt: pd.Series, context: pd.Series, seed: pd.Series, most: pd.Series) -> pd.Series:
    def one(p: str, c: str, s: int, n: int) -> str:
        out, x = [], s & 0xFFFFFFFF
        for _ in range(min(n, 12)):
            x = (1103515245 * x + 12345) & 0x7FFFFFFF
            out.append(MOCK_WORDS[(x >> 8) % len(MOCK_WORDS)])
        return (out[0].capitalize() + " " + " ".join(out[1:]) + (f" ({c})" if c else "") + ".") if out else ""

    return pd.Series([one(*r) for r in zip(prompt, context.fillna(""), seed, most)])


def mock_text(prompt: Column, context: Column, seed: Column, most: int) -> Column:
    return _mock(prompt, context, seed, F.lit(most))


@F.pandas_udf(T.BinaryType())
def procedural_image(seed: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """A small PNG of bands whose colours follow from the seed."""
    import struct
    import zlib

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def one(s: int, w: int, h: int) -> bytes:
        rows = b"".join(b"\0" + bytes(((s >> (8 * (c + y // 8) % 56)) + x) & 255 for x in range(w) for c in range(3)) for y in range(h))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    return pd.Series([one(int(a), int(b), int(c)) for a, b, c in zip(seed, width, height)])


@F.pandas_udf(T.BinaryType())
def procedural_speech(text: pd.Series, rate: pd.Series) -> pd.Series:
    """A WAV of one short tone for each word."""
    import struct

    import numpy as np

    def one(t: str, r: int) -> bytes:
        tones = [220 + 20 * (sum(map(ord, w)) % 24) for w in (t or "").split()[:40]]
        at = np.arange(r // 10) / r
        wave = np.concatenate([np.sin(2 * np.pi * f * at) for f in tones]) if tones else np.zeros(0)
        data = (wave * 12000).astype("<i2").tobytes()
        return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, r, 2 * r, 2, 16) + b"data" + struct.pack("<I", len(data)) + data

    return pd.Series([one(t, int(r)) for t, r in zip(text, rate)])


@F.pandas_udf(T.BinaryType())
def simple_pdf(title: pd.Series, body: pd.Series) -> pd.Series:
    """A one-page PDF of plain lines."""

    def one(t: str, b: str) -> bytes:
        safe = lambda s: s.encode("latin-1", "replace").decode("latin-1").replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
        lines = [t or "", *(b or "").splitlines()][:60]
        page = "BT /F1 11 Tf 50 790 Td 14 TL " + " ".join(f"({safe(x)}) Tj T*" for x in lines) + " ET"
        objects = ["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", "<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", f"<< /Length {len(page.encode('latin-1'))} >>\nstream\n{page}\nendstream", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
        out, places = b"%PDF-1.4\n", []
        for i, o in enumerate(objects, 1):
            places.append(len(out))
            out += f"{i} 0 obj\n{o}\nendobj\n".encode("latin-1")
        table = "".join(f"{p:010d} 00000 n \n" for p in places)
        return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF".encode("latin-1")

    return pd.Series([one(a, b) for a, b in zip(title, body)])


# ---------------------------------------------------------------- structured answers
def extract_json(answer: str):
    """The first JSON value in an answer, with fences, prose and small slips around it forgiven; None if there is none."""
    body = re.sub(r"^```\w*|```$", "", (answer or "").strip(), flags=re.M)
    begin = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if begin < 0:
        return None
    end = max(body.rfind("}"), body.rfind("]"))
    for attempt in (body[begin : end + 1], re.sub(r",\s*([}\]])", r"\1", body[begin : end + 1]), re.sub(r",\s*([}\]])", r"\1", body[begin : end + 1]).replace("'", '"')):
        try:
            return json.loads(attempt)
        except ValueError:
            continue
    return None


def enrich(df: DataFrame, key: str, prompt: str, fields: dict[str, str], ask: Callable[[list[str], int], list[str]], batch: int = 16, attempts: int = 3, cache: DataFrame | None = None) -> DataFrame:
    """df with the fields that a provider answers as JSON for each prompt.

    Prompts go in batches; short batches and answers without the fields are asked again,
    up to `attempts` times, then are null. Prompts in `cache` (hash, answer) aren't asked."""
    hashed = df.withColumn("__h", F.sha2(F.col(prompt), 256))
    known = hashed.join(cache.select(F.col("hash").alias("__h"), "answer"), "__h", "left") if cache is not None else hashed.withColumn("answer", F.lit(None).cast("string"))

    def run(parts):
        for pdf in parts:
            answers = pdf["answer"].tolist()
            todo = [i for i, a in enumerate(answers) if not isinstance(a, str)]
            for attempt in range(attempts):
                left = []
                for at in range(0, len(todo), batch):
                    rows = todo[at : at + batch]
                    got = ask([pdf[prompt].iloc[i] for i in rows], attempt)
                    for n, i in enumerate(rows):
                        a = extract_json(got[n]) if n < len(got) else None
                        if isinstance(a, dict) and set(fields) <= set(a):
                            answers[i] = json.dumps(a)
                        else:
                            left.append(i)
                todo = left
                if not todo:
                    break
            yield pdf.assign(answer=[a if isinstance(a, str) else None for a in answers])

    schema = known.schema
    out = known.mapInPandas(run, schema)
    return out.select(*df.columns, F.from_json("answer", ", ".join(f"`{k}` {v}" for k, v in fields.items())).alias("__a"), "__h").select(*df.columns, *[F.col(f"__a.`{k}`") for k in fields])


def judge(df: DataFrame, key: str, text: str, verdict: Callable[[list], list], every: int = 97, most: int = 25) -> DataFrame:
    """(key, ok): a provider's verdict on a systematic sample, which is bounded because a judge is slow."""
    picked = df.where(F.col(key) % every == 0).orderBy(key).limit(most).select(F.col(key), F.col(text).alias("t"))

    def run(parts):
        for pdf in parts:
            yield pd.DataFrame({key: pdf[key], "ok": verdict(pdf["t"].tolist())})

    return picked.mapInPandas(run, f"`{key}` {dict(picked.dtypes)[key]}, ok boolean")


def model_benchmark(runs: DataFrame) -> DataFrame:
    """Scores by model of (model, valid, usable, tokens, millis), best first."""
    out = runs.groupBy("model").agg(F.avg(F.col("valid").cast("double")).alias("valid"), F.avg(F.col("usable").cast("double")).alias("usable"), (F.sum("tokens") / (F.sum("millis") / 1000)).alias("tokens_per_s"), F.avg("millis").alias("millis"))
    return out.orderBy(F.desc("usable"), F.desc("valid"), F.desc("tokens_per_s"), "model")


#: Models, images and speech by provider, as columns of what they are asked with.
LANGUAGE_MODELS: dict[str, Callable] = {"mock": mock_text}
IMAGES: dict[str, Callable] = {"procedural": procedural_image}
SPEECH: dict[str, Callable] = {"procedural": procedural_speech}

