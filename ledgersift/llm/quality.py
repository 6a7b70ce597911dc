"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal.

Features of a text are the 1-grams and 2-grams of its words, and those of the shapes
of its words (letters, capitals and digits as classes, runs collapsed; a 2-gram of shapes
also says whether both words are the same), hashed to ``2**bits`` slots; a slot's value is
its count, over the length of the text's vector of counts. The model is a
weight vector of a fixed size, so what is broadcast does not grow with the data.

Fitting uses at most ``max_rows`` labelled rows (those of the smallest seeded hash of
the id). Scoring is one pass over all rows: whole texts, no shuffle.

Null and empty texts have no n-grams: they get the score of the bias alone. Rows with a
null label are never learnt from; without any labelled row every score is 0.5. Repeated
rows are scored alike, extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED, arrow_batches, hash_runs, mix, slices, word_spans

_KIND = np.arange(256, dtype=np.uint8)
_KIND[0x41:0x5B] = ord("A")
_KIND[0x61:0x7B] = ord("a")
_KIND[0x30:0x3A] = ord("0")
_KIND[0x80:] = ord("a")


@dataclass(frozen=True)
class Ftrl:
    bits: int = 18
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-3
    epochs: int = 6
    seed: int = 17


def ngrams(data: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every n-gram of every text."""
    begin, end, row, w = word_spans(data, offs, SPACED)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept, lengths = data[w], end - begin
    words = hash_runs(kept, lengths)
    kind = _KIND[kept]
    change = np.ones(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    heads = np.cumsum(lengths) - lengths
    change[heads] = True
    shapes = hash_runs(kind[change], np.add.reduceat(change.astype(np.int64), heads))
    same = row[1:] == row[:-1]
    with np.errstate(over="ignore"):
        pair = lambda h, salt: mix(h[:-1] * np.uint64(3) + h[1:] + np.uint64(salt))[same]
        grams = [words, pair(words, 11), mix(shapes + np.uint64(5)), np.where((words[1:] == words[:-1])[same], mix(pair(shapes, 7)), pair(shapes, 7))]
    rows = [row, row[:-1][same]] * 2
    return np.concatenate(rows), (np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64)


def _featurise(bits: int):
    def run(batches):
        for part, data, offs in slices(batches, "text"):
            row, slot = ngrams(data, offs, bits)
            key, count = np.unique((row << bits) | slot, return_counts=True)
            cut = np.searchsorted(key, np.arange(part.num_rows + 1) << bits)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("label"),
                    pa.array([(key[i:j] & ((1 << bits) - 1)).astype("<i4").tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
                    pa.array([count[i:j].astype("<i4").tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
                ],
                ["label", "slots", "counts"],
            )

    return run


def fit(docs: DataFrame, labels: DataFrame, use: Column, label: str = "quality", max_rows: int = 5000, ftrl: Ftrl = Ftrl()) -> tuple[np.ndarray, float]:
    """Weights and bias. ``use`` says which rows may be learnt from; at most ``max_rows`` are."""
    arrow_batches(docs.sparkSession, 500)
    marked = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label")).where(use)
    picked = marked.orderBy(F.xxhash64("doc_id", F.lit(ftrl.seed)), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("label", F.coalesce("text", F.lit("")).alias("text"))
    got = rows.mapInArrow(_featurise(ftrl.bits), "label int, slots binary, counts binary").collect()
    w, bias = _ftrl([(r.label, np.frombuffer(r.slots, "<i4"), np.frombuffer(r.counts, "<i4")) for r in got], ftrl)
    return w, bias


def _ftrl(rows, p: Ftrl) -> tuple[np.ndarray, float]:
    """FTRL-proximal with per-coordinate rates. The last slot is the bias."""
    size = (1 << p.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    rows = [(y, np.append(s, size - 1), np.append(c / np.sqrt(np.square(c, dtype=np.float64).sum() or 1.0), 1.0)) for y, s, c in sorted(rows, key=lambda r: (r[1].tobytes(), r[2].tobytes(), r[0]))]
    rng = np.random.default_rng(p.seed)

    def weights(s):
        zs = z[s]
        return np.where(np.abs(zs) <= p.l1, 0.0, -(zs - np.sign(zs) * p.l1) / ((p.beta + np.sqrt(n[s])) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for i in rng.permutation(len(rows)):
            y, s, x = rows[i]
            w = weights(s)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(n[s] + g * g) - np.sqrt(n[s])) / p.alpha
            z[s] += g - sigma * w
            n[s] += g * g
    w = weights(np.arange(size))
    return w[:-1].astype(np.float32), float(w[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, float], ftrl: Ftrl = Ftrl()) -> DataFrame:
    """docs (doc_id, text, held_out) -> doc_id, held_out, score: the probability of label 1."""
    spark = docs.sparkSession
    arrow_batches(spark)
    held = spark.sparkContext.broadcast(model)
    bits = ftrl.bits

    def run(batches):
        weights, bias = held.value
        for part, data, offs in slices(batches, "text"):
            row, slot = ngrams(data, offs, bits)
            key, count = np.unique((row << bits) | slot, return_counts=True)
            at = key >> bits
            count = count.astype(np.float64)
            dot = np.bincount(at, weights[key & ((1 << bits) - 1)] * count, part.num_rows)
            norm = np.sqrt(np.bincount(at, count * count, part.num_rows))
            logit = dot / np.maximum(norm, 1.0) + bias
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))))], ["doc_id", "held_out", "score"]
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
