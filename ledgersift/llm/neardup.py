"""Near-duplicate documents by SuperMinHash.

1. Sketch: A-Z lower-cased, a text's set is its distinct word shingles (64-bit hashes).
   Each element ranks all slots by a random permutation of its own, so that ranks are
   correlated and signatures vary less than independent hashes; an element stops as soon
   as its next rank cannot lower any slot. Texts with equal sets become one class.
2. Banding: classes that share a band of the signature share a bucket.
3. Verification (``common.linked_groups``): all pairs that share a bucket are in one component
   already or are decided, on the full sets of both texts; nothing is estimated. A group of
   like texts becomes one component by a comparison each, however large it is; only what is
   then outside of it is held against its other members, inside a join that lets only links
   through.
4. Union-find over the links (``common.components``), on class ids.

With 40 bands of 6 rows a pair with similarity 0.8 is missed with a chance of 5e-6 at most, and
one with 0.85 with 6e-9. Long bands matter: texts that share a frequent line or two, as a third
of all may, hardly ever share one.

Null, empty and blank texts have empty sets and are linked with nothing. A text with fewer
words than a shingle has its whole sequence as the one element. Rows with a null id are
returned with a null component, and are kept. Rows that share an id are one node. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, Scratch, arrow_batches, hash_words, linked_groups, mix, slices, star_ids, stars, unpacked, whole_row


@dataclass(frozen=True)
class Shape:
    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, element) of all distinct elements, by row and then element."""
    n = len(offs) - 1
    h, row = hash_words(data, offs, SPACED)
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    size = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    which = np.repeat(np.arange(n), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[which]
    length = np.minimum(count, words)[which]
    with np.errstate(over="ignore"):
        e = length.astype(np.uint64)
        for k in range(words):
            on = length > k
            e[on] = mix(e[on] * np.uint64(0x9E3779B97F4A7C15) + h[at[on] + k])
    order = np.lexsort((e, which))
    e, which = e[order], which[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (which[1:] != which[:-1])
    return which[new], e[new]


def _draw(e: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each element at step j: a fraction in [0, 1) and a place in [j, m)."""
    with np.errstate(over="ignore"):
        x = mix(e + np.uint64((j + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
    place = ((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64) + j
    return (x >> np.uint64(32)).astype(np.float64) / 2.0**32, place


def super_minhash(row: np.ndarray, e: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n, m). At step j each element offers rank j plus a fraction to the next slot of its permutation."""
    sig = np.full((n, m), np.inf)
    value, place = _draw(e, 0, m)
    np.minimum.at(sig, (row, place), value)
    open_ = sig.max(axis=1) > 1
    open_ &= np.bincount(row, minlength=n) > 0
    on = open_[row]
    row, e, place = row[on], e[on], place[on]
    order = np.tile(np.arange(m, dtype=np.uint8), (len(e), 1))
    each = np.arange(len(e))
    order[each, 0], order[each, place] = order[each, place], 0
    for j in range(1, m):
        # early stopping: no later offer is below j
        open_ = sig.max(axis=1) > j
        on = open_[row]
        if not on.all():
            row, e, order = row[on], e[on], order[on]
        if not len(row):
            break
        value, place = _draw(e, j, m)
        each = np.arange(len(e))
        slot = order[each, place]
        order[each, place] = order[:, j]
        order[:, j] = slot
        np.minimum.at(sig, (row, slot), value + j)
    return sig


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB), bits.shape[:2]).copy()
        for k in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, k])
    return h


def sketch(docs: DataFrame, p: Shape) -> DataFrame:
    """doc_id, n (set size), d1, d2 (digest of the set), bands."""

    def run(batches):
        for part, data, offs in slices(batches, "text"):
            n = part.num_rows
            row, e = shingle_sets(data, offs, p.words)
            size = np.bincount(row, minlength=n)
            d1, d2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            full = np.flatnonzero(size)
            if len(full):
                heads = (np.cumsum(size) - size)[full]
                with np.errstate(over="ignore"):
                    d1[full], d2[full] = np.add.reduceat(mix(e), heads), np.bitwise_xor.reduceat(mix(e + np.uint64(7)), heads)
            sig = super_minhash(row, e, n, p.bands * p.rows)
            h = band_hashes(sig, p.bands, p.rows).astype(np.int64, casting="unsafe")
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.ListArray.from_arrays(np.arange(0, n * p.bands + 1, p.bands, dtype=np.int32), h.ravel())],
                ["doc_id", "n", "d1", "d2", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame, p: Shape) -> DataFrame:
    """id, n, x: the full sets of these documents."""

    def run(batches):
        for part, data, offs in slices(batches, "text"):
            row, e = shingle_sets(data, offs, p.words)
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(cut).astype(np.int64)), pa.ListArray.from_arrays(cut.astype(np.int32), e.view(np.int64))], ["id", "n", "x"])

    # by id on both sides at any size: what is shuffled grows as the input does
    held = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids.hint("merge"), "id", "left_semi")
    return held.mapInArrow(run, "id long, n long, x array<long>")


def link(docs: DataFrame, p: Shape = Shape()) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(sketches, classes, components): see ``near_duplicates``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    arrow_batches(spark)
    ids = docs.where(F.col("doc_id").isNotNull())
    marks = scratch.put(sketch(ids, p), "sketches")
    scratch.sweep()
    classes = marks.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("id"))
    # equal sets have equal bands: any row of the class with its id has them
    reps = marks.where("n > 0").select(F.col("doc_id").alias("id"), "n", "d1", "d2", "bands").join(classes, ["n", "d1", "d2", "id"], "left_semi").dropDuplicates(["n", "d1", "d2"])
    classes = scratch.put(reps, "classes")
    scratch.sweep()
    pairs = stars(scratch, classes.select("id", F.explode("bands").alias("bucket")))
    arrow_batches(spark, 200)
    sets = scratch.put(_sets(docs, star_ids(pairs), p), "sets")
    arrow_batches(spark)
    scratch.sweep()
    roots = linked_groups(scratch, pairs, sets, lambda x: x, p.percent)
    scratch.drop(pairs, sets)
    return marks, classes, roots


def near_duplicates(docs: DataFrame, p: Shape = Shape()) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept. A component's id is its smallest doc_id."""
    marks, classes, roots = link(docs, p)
    classes = classes.select("n", "d1", "d2", "id")
    if roots is not None:
        classes = classes.join(roots, "id", "left").select("n", "d1", "d2", F.coalesce("root", "id").alias("component_id"))
    else:
        classes = classes.withColumnRenamed("id", "component_id")
    whole = marks.select("doc_id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"], "left")
    component = F.coalesce("component_id", "doc_id")
    out = whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    lost = docs.where(F.col("doc_id").isNull())
    lost = sketch(lost, p).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(lost)


def dedup(docs: DataFrame, p: Shape = Shape()) -> DataFrame:
    """The documents, with all their columns, one of each component: that of the smallest doc_id.

    Rows that share an id stay or go together. Rows with a null id stay.
    """
    gone = near_duplicates(docs, p).where("NOT kept").select("doc_id").distinct()
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    return unpacked(rows.join(gone, "doc_id", "left_anti"), docs)
