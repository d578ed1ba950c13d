"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are character 1- to 3-grams of lower-cased text, letters only (runs of other
characters are spaces), hashed to ``FEATURES`` columns and weighed by TF-IDF; document
frequencies are counted over all training documents. Weights are trained by
follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties, on a sample of
at most about ``per_language`` documents a language, drawn by hash over the whole
table; a fifth of the sample sets the temperature that calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, staged, with_text_columns

FEATURES = 1 << 14
#: Documents of a language in the training sample, passes over it.
PER_LANGUAGE, EPOCHS = 1000, 4
#: FTRL-proximal: learning rate and its smoothing; elastic net: L1 and L2 strength.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.002
#: Languages that one model may tell apart (weights are broadcast: 64 KB a language).
MOST_LANGUAGES = 2000
#: Characters hashed at a time.
CHUNK = 1 << 20


@cache
def letters() -> np.ndarray:
    """By code point: itself in lower case where it is a letter, else a space."""
    low = np.full(0x110000, 32, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low[i] = ord(x) if len(x := c.lower()) == 1 else i
    return low


def counts(text: str) -> np.ndarray | None:
    """Feature counts of a whole text; none without a letter."""
    points = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    if not (points != 32).any():
        return None
    space = points == 32
    points = points[~(space & np.concatenate([[False], space[:-1]]))]  # runs of others: one space
    out = np.zeros(FEATURES, dtype=np.int64)
    for i in range(0, len(points), CHUNK):
        p = points[i : i + CHUNK + 2]
        one = p * np.uint32(2654435761) + np.uint32(97)
        two = (one[:-1] ^ (p[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        three = (two[:-1] ^ (p[2:] * np.uint32(668265263))) * np.uint32(374761393)
        own = min(CHUNK, len(points) - i)  # grams that begin in this chunk
        for h in (one[:own], two[:own], three[:own]):
            out += np.bincount((h ^ h >> np.uint32(15)) >> np.uint32(3) & np.uint32(FEATURES - 1), minlength=FEATURES)
    return out


def vector(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values, of length 1, of the features ``at``."""
    v = np.log1p(count) * idf[at]
    return v / max(np.linalg.norm(v), 1e-12)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each feature's documents in this partition, and one for each sampled document."""
    seen = np.zeros(FEATURES, dtype=np.int64)
    for whole in batches:
        for batch in slices(whole, "text"):
            idx, val, lang = [], [], []
            for text, name, drawn in zip(batch.column("text"), batch.column("lang"), batch.column("drawn"), strict=True):
                c = counts(text.as_py()) if text.is_valid else None
                if c is None:
                    continue
                seen += c > 0
                if drawn.as_py():
                    at = np.flatnonzero(c)
                    idx.append(at.astype("<u2").tobytes())
                    val.append(c[at].astype("<u4").tobytes())
                    lang.append(name.as_py())
            if lang:
                n = len(lang)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(lang, pa.string()), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["feature", "df", "lang", "idx", "val"])
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at]), pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.binary())], names=["feature", "df", "lang", "idx", "val"])


class Model:
    """Languages, IDF weights, coefficients (features x languages), temperature."""

    def __init__(self, names: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.names, self.idf, self.weights, self.bias, self.temperature = names, idf, weights, bias, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        c = counts(text) if text is not None else None
        if c is None or not self.names:
            return "und", 0.0
        at = np.flatnonzero(c)
        p = softmax((vector(at, c[at], self.idf) @ self.weights[at] + self.bias) / self.temperature)
        return self.names[int(p.argmax())], float(p.max())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias; rows: (features, values, class). The bias isn't penalised."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= L1, 0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, FEATURES), np.append(x, 1.0)
            w = weights(at)
            w[-1] = -z[FEATURES] / ((BETA + np.sqrt(n[FEATURES])) / ALPHA)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(0, FEATURES)), -z[FEATURES] / ((BETA + np.sqrt(n[FEATURES])) / ALPHA)


def fitted(names: list[str], idf: np.ndarray, sample: list[tuple[str, bytes, bytes]]) -> Model:
    rows = []
    for name, idx, val in sample:
        at = np.frombuffer(idx, "<u2").astype(np.int64)
        rows.append((at, vector(at, np.frombuffer(val, "<u4"), idf), names.index(name)))
    held, own = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    own, held = (own, held) if len(own) > len(names) else (rows, rows)
    weights, bias = ftrl(own, len(names))
    logits = np.stack([v @ weights[at] + bias for at, v, _ in held])
    truth = np.array([y for _, _, y in held])
    best = min(np.geomspace(0.05, 20, 121), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).sum())
    return Model(names, idf, weights, bias, float(best))


def train(df: DataFrame, text_col: str, lang_col: str, draw_col: str, per_language: int = PER_LANGUAGE) -> Model:
    """A model of all rows of ``df`` with a language; ``draw_col`` decides by hash who is in the sample.

    To the driver go a row a language, ``FEATURES`` document counts, and the features of
    about ``per_language`` sampled documents a language.
    """
    rows = df.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(draw_col), F.lit(1 << 30)).alias("draw"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = sorted(sizes)
    if not names:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    limit = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, int((1 << 30) * min(1.0, per_language / n)))])
    rows = rows.select("text", "lang", (F.col("draw") < limit[F.col("lang")]).alias("drawn"))
    got = staged(rows.mapInArrow(_gather, "feature int, df long, lang string, idx binary, val binary"), "language")
    df_of = got.where("feature is not null").groupBy("feature").agg(F.sum("df").alias("df")).collect()
    total = sum(sizes.values())
    idf = np.full(FEATURES, np.log(1 + total))
    for r in df_of:
        idf[r["feature"]] = np.log((1 + total) / (1 + r["df"])) + 1
    sample = sorted((r["lang"], bytes(r["idx"]), bytes(r["val"])) for r in got.where("lang is not null").select("lang", "idx", "val").collect())
    if not sample:
        return Model([], idf, np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    order = np.random.default_rng(5).permutation(len(sample))
    return fitted(names, idf, [sample[i] for i in order])


def predicted(df: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred and score; `und` and 0 for texts that are null or have no letter."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def setup():
        own = shared.value

        def columns(texts: pa.Array) -> list[pa.Array]:
            found = [own.predict(x.as_py()) for x in texts]
            return [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]

        return columns

    return with_text_columns(df, text_col, keep, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], setup)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 by 3; a null id is not held out, and never trained on."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(id, held_out, lang_pred, score), one row a row, and the columns ``keep``.

    Trained on rows with a language that aren't held out; without any, all is `und`.
    """
    model = train(df.where(F.col(id_col).isNotNull() & ~held_out(id_col)), text_col, lang_col, id_col, per_language)
    marked = df.withColumn("held_out", held_out(id_col))
    return predicted(marked, model, [*(keep or [id_col]), "held_out"], text_col)
