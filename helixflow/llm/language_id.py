"""Language ID by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed byte n-grams tells the languages whose bit
is 1 from the others. Its weights are log ratios of smoothed n-gram shares, fitted from n-gram counts that Spark sums
over all training documents. Decoding takes the codeword with the least loss, each bit weighted by how well its
classifier parts the languages, and flags texts whose two best codewords lie close together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_bucket, table, texts_as_bytes

SLOTS = 4096
_LOW = np.arange(256, dtype=np.uint32)
_LOW[65:91] += 32
_LOW[[9, 10, 11, 12, 13]] = 32
_LOW[48:58] = 48  # all digits alike


def ngram_slots(text: bytes) -> np.ndarray:
    """Hashed slots of all 2- and 3-grams of bytes, ASCII lower-cased, of the text between spaces."""
    b = np.empty(len(text) + 2, np.uint32)
    b[0] = b[-1] = 32
    b[1:-1] = _LOW[np.frombuffer(text, np.uint8)]
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - (SLOTS.bit_length() - 1))
    return np.concatenate([two >> shift, three >> shift])


def codewords(n: int) -> np.ndarray:
    """n rows of bits. Up to 7 languages: the exhaustive code (all 2^(n-1)-1 splits); more: seeded random columns."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        width = 2 ** (n - 1) - 1
        rows = [np.ones(width, np.int8)]
        for i in range(1, n):
            run = 2 ** (n - 1 - i)
            rows.append(np.array([(k // run) % 2 for k in range(width)], np.int8))
        return np.array(rows)
    rng = np.random.default_rng(7)
    columns: list[np.ndarray] = []
    while len(columns) < 10 * int(np.ceil(np.log2(n))):
        c = rng.integers(0, 2, n).astype(np.int8)
        if 0 < c.sum() < n:
            columns.append(c)
    return np.array(columns).T


class LanguageModel:
    """languages, codewords, one weight column and one bit weight for each bit."""

    def __init__(self, languages: list[str], counts: np.ndarray, smooth: float = 0.5):
        self.languages, self.code = languages, codewords(len(languages))
        share = (counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * SLOTS)
        columns, weights, scales = [], [], []
        for bit in self.code.T:
            ones, zeros = share[bit == 1], share[bit == 0]
            if not len(ones) or not len(zeros):
                columns.append(np.zeros(SLOTS)), weights.append(1.0), scales.append(1.0)
                continue
            w = np.log(ones.mean(axis=0)) - np.log(zeros.mean(axis=0))
            margins = share @ w  # the mean margin of each language
            side = np.where(bit == 1, margins, -margins)
            columns.append(w)
            scales.append(1 / max(np.abs(margins).mean(), 1e-9))
            weights.append(float(np.clip(side.min() * scales[-1], 0.05, None)))
        self.w, self.bit_weight = np.array(columns).T.astype(np.float32), np.array(weights)
        self.scale = np.array(scales)

    def decode(self, features: np.ndarray, sharp: float = 6.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of all (0 to 1) and the gap to the next, for rows of n-gram counts."""
        n = np.maximum(features.sum(axis=1, keepdims=True), 1)
        margin = (features @ self.w) / n * self.scale
        signs = 2.0 * self.code - 1
        loss = (np.logaddexp(0, -2 * margin[:, None, :] * signs[None]) * self.bit_weight).sum(axis=2) / self.bit_weight.sum()
        z = np.exp(-sharp * (loss - loss.min(axis=1, keepdims=True)))
        p = z / z.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        top = p[np.arange(len(p)), best]
        rest = np.sort(p, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return best, top, top - rest


def train_language(docs: DataFrame) -> LanguageModel:
    """Counts of every n-gram slot in every document with a lang. Sums have languages x SLOTS rows at most, whatever
    the input; they alone reach the driver."""
    import pyarrow as pa

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(1).to_pylist(), texts_as_bytes(batch.column(0)), strict=True):
                if text:
                    if lang not in sums:
                        sums[lang] = np.zeros(SLOTS, np.int64)
                    sums[lang] += np.bincount(ngram_slots(text), minlength=SLOTS)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at])], names=["lang", "slot", "n"])

    schema = T.StructType().add("lang", "string").add("slot", "integer").add("n", "long")
    rows = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(count, schema).groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = rows.groupBy("lang").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("ns")).orderBy("lang").collect()
    counts = np.zeros((len(found), SLOTS))
    for k, r in enumerate(found):
        counts[k, r["slots"]] = r["ns"]
    return LanguageModel([r["lang"] for r in found], counts)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", least_gap: float = 0.1, block: int = 256) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous (the two best codewords are closer than ``least_gap``).

    A text that is null or has no letter, or a model without languages, gives ``und`` with score 0. Columns of docs
    with one of these names are replaced; rows are judged one by one, so repeated rows agree.
    """
    import pyarrow as pa

    own = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    schema = docs.select(*own).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def run(batches):
        for batch in batches:
            texts = texts_as_bytes(batch.column(batch.schema.get_field_index(text)))
            names, scores, flags = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            able = [i for i, t in enumerate(texts) if t and model.languages and any(map(str.isalpha, t.decode()))]
            for k in range(0, len(able), block):
                part = able[k : k + block]
                features = np.zeros((len(part), SLOTS), np.float32)
                for j, i in enumerate(part):
                    features[j] = np.bincount(ngram_slots(texts[i]), minlength=SLOTS)
                best, top, gap = model.decode(features)
                for j, i in enumerate(part):
                    names[i], scores[i], flags[i] = model.languages[best[j]], top[j], gap[j] < least_gap
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), pa.array(names, pa.string()), pa.array(scores), pa.array(flags)], names=schema.names)

    return docs.mapInArrow(run, schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_bucket(F.col("doc_id"), 4) == 2)
    model = train_language(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
