"""Fuzzy line dedup with DataFrame functions only: no Python runs on the executors.

1. Texts are cut at ``\\n``, white space at a line's ends is ignored. Equal lines become one
   by their text, so that each distinct line is worked on once, however many documents hold it.
2. A line has as its set the distinct character shingles, as 64-bit hashes; a shorter line is
   its own shingle.
3. Signature: MinHash by one permutation. ``bands`` points lie evenly on the circle of hashes,
   and a band is made of the ``rows`` hashes that come next after its point (points count, and
   nothing follows the last hash). Lines that share a band share a bucket (``common.stars``).
4. ``common.linked_groups`` decides all pairs of a bucket, with the exact Jaccard similarity
   of both whole sets, and joins what is linked by union-find. Of each component the first
   line stays, by doc_id and then line number; the others are cut from their documents.

Two long lines of similarity 0.8 are missed with a chance of about 2e-4, at 0.85 of 4e-6. One
replaced inner character changes 8 shingles: lines under 79 characters that differ in one are
under 0.8, and both stay.

Blank lines and null texts stay as they are. Rows with a null id take no part and stay
whole. Of rows that share an id and a line number, an equal line stays in all or none. A
document that loses all lines but blank ones is dropped by ``dedup``, one that had none
before is not. An empty table gives no rows. Extra columns are kept as they are, whatever
their names; ``n_chars`` is renewed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, linked_groups, of_ids, sketches, star_ids, stars, unpacked, whole_row


@dataclass(frozen=True)
class Shape:
    chars: int = 8
    percent: int = 80
    bands: int = 16
    rows: int = 4
    #: Parts in which bands are dealt out.
    passes: int = 2


#: Points have no bits below this one; a hash that has none is as good as impossible, and only adds a band.
POINT_BITS = 48


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, where it stands in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles(line: Column, chars: int) -> Column:
    """Hashes of all runs of ``chars`` characters; a shorter line is its own run."""

    def narrow(wide: Column) -> Column:
        last = F.octet_length(wide) - (2 * chars - 1)
        many = F.transform(F.sequence(F.lit(1), last, F.lit(2)), lambda i: F.xxhash64(F.substring(wide, i, F.lit(2 * chars))))
        few = F.array(F.xxhash64(wide))
        return F.when(F.octet_length(wide) != 2 * F.length(line), once(F.encode(line, "UTF-32"), broad)).when(last > 1, many).otherwise(few)

    def broad(wide: Column) -> Column:
        """Where some characters take four bytes in UTF-16: cut by code points, hashed as the others are."""
        last = F.octet_length(wide) - (4 * chars - 1)
        many = F.transform(F.sequence(F.lit(1), last, F.lit(4)), lambda i: F.xxhash64(F.encode(F.decode(F.substring(wide, i, F.lit(4 * chars)), "UTF-32"), "UTF-16BE")))
        return F.when(last > 1, many).otherwise(F.array(F.xxhash64(F.encode(line, "UTF-16BE"))))

    # two bytes a character: a shingle is found without counting from the start
    return once(F.encode(line, "UTF-16BE"), narrow)


def runs(rows: DataFrame, chars: int) -> DataFrame:
    """id, n, h: of rows (id, n, x), the hash of each shingle of x as a row; compiled, but for lines with characters outside the BMP."""
    plain = rows.where(F.octet_length(F.encode("x", "UTF-16BE")) == 2 * F.length("x")).select("id", "n", F.encode("x", "UTF-16BE").alias("wide"))
    at = F.sequence(F.lit(1), F.greatest(F.octet_length("wide") - (2 * chars - 1), F.lit(1)), F.lit(2))
    plain = plain.select("id", "n", "wide", F.explode(at).alias("i")).select("id", "n", F.xxhash64(F.substring(F.col("wide"), F.col("i"), F.lit(2 * chars))).alias("h"))
    other = rows.where(F.octet_length(F.encode("x", "UTF-16BE")) != 2 * F.length("x"))
    return plain.union(other.select("id", "n", F.explode(shingles(F.col("x"), chars)).alias("h")))


def buckets(rows: DataFrame, p: Shape) -> DataFrame:
    """id, bucket: of rows (id, hashes), a row for each band; null where only points follow.

    Each step is a projection whose columns the next one uses more than once, so that none
    is put into another: one large method would not be compiled.
    """
    points = F.array(*[F.lit(k * (1 << 64) // p.bands - (1 << 63) >> POINT_BITS << POINT_BITS).cast("long") for k in range(p.bands)])
    marked = rows.select("id", F.sort_array(F.concat("hashes", points)).alias("marked"))
    low = F.lit((1 << POINT_BITS) - 1)
    # of all that is marked the points stay; outer, as Spark would ask for the size before, and sort twice
    each = marked.select("id", "marked", F.posexplode_outer("marked").alias("place", "point")).where(F.col("point").bitwiseAND(low) == 0)
    each = each.select("id", "marked", "point", (F.col("place") + 2).alias("at"))
    each = each.select("id", "marked", "point", "at", F.slice("marked", F.col("at"), p.rows).alias("next"))
    # copies of a hash stand together, and count once; few lines have any
    copies = F.lit(False)
    for j in range(1, p.rows):
        copies = copies | F.coalesce(F.get("next", F.lit(j - 1)) == F.get("next", F.lit(j)), F.lit(False))
    apart = F.slice(F.array_distinct(F.slice("marked", F.col("at"), F.size("marked"))), 1, p.rows)
    each = each.select("id", "point", F.when(copies, apart).otherwise(F.col("next")).alias("band"))
    some = F.lit(False)
    for j in range(p.rows):
        some = some | (F.coalesce(F.get("band", F.lit(j)), F.lit(0)).bitwiseAND(low) != 0)
    return each.select("id", F.when(some, F.xxhash64("point", "band")).alias("bucket"))


def stripped(line: Column) -> Column:
    # btrim walks through the whole line, and few have anything to cut
    ends = F.lit(False)
    for c in " \t\r\f\x0b":
        ends = ends | F.startswith(line, F.lit(c)) | F.endswith(line, F.lit(c))
    return F.when(ends, F.btrim(line, F.lit(" \t\r\f\x0b"))).otherwise(line)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, twin (tells apart texts that share an id), pos, line: those that aren't blank."""
    cut = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("twin"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return cut.select("doc_id", "twin", "pos", stripped(F.col("raw")).alias("line")).where("line <> ''")


def _key(line: str = "line") -> list[Column]:
    """A line by 128 bits."""
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(7), line).alias("k2")]


def removals(docs: DataFrame, p: Shape = Shape()) -> DataFrame:
    """doc_id, twin, gone: for each line number up to the last that goes, ``1`` if it goes, else ``0``."""
    scratch = Scratch(docs.sparkSession)
    every = lines(docs)
    known = every.groupBy("line").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
    known = scratch.put(known.select(F.monotonically_increasing_id().alias("id"), *_key(), "first_doc", "copies", "line"), "lines")
    scratch.sweep()
    marks = scratch.put(buckets(known.select("id", shingles(F.col("line"), p.chars).alias("hashes")), p), "bands")
    pairs = stars(scratch, marks, p.passes)
    scratch.drop(marks)
    # the texts are not shuffled for it
    held = of_ids(scratch, known.select("id", "line"), star_ids(pairs))
    held = scratch.put(held.select("id", F.size(F.array_distinct(shingles(F.col("line"), p.chars))).alias("n"), F.col("line").alias("x")), "held")
    # the texts have been read for the last time
    texts, known = known, scratch.put(known.drop("line"), "first")
    scratch.drop(texts)
    scratch.sweep()
    sketch = scratch.put(sketches(runs(held, p.chars)), "sketches")
    roots = linked_groups(scratch, pairs, held, lambda x: shingles(x, p.chars), p.percent, sketch=sketch)
    scratch.drop(pairs, held, sketch)

    first = known
    # the first place of each line: the smallest document, and there the smallest number
    if roots is None:
        first = first.withColumn("root", F.col("id"))
    else:
        first = first.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    group = first.groupBy("root").agg(F.sum("copies").alias("all"), F.min("first_doc").alias("first")).where(F.col("all") > 1)
    group = scratch.put(first.select("k1", "k2", "root").join(group, "root").select("k1", "k2", "root", "first"), "groups")
    scratch.sweep()
    places = scratch.put(every.select("doc_id", "twin", "pos", *_key()).join(group, ["k1", "k2"]).select("doc_id", "twin", "pos", "root", "first"), "places")
    scratch.drop(known, group)
    scratch.sweep()
    number = places.where("doc_id = first").groupBy("root").agg(F.min("pos").alias("first_pos"))
    out = places.join(number, "root").where("doc_id <> first or pos <> first_pos")
    # dealt by document first: lists of lines are longer than the lines' numbers, and none is complete before
    out = out.select("doc_id", "twin", "pos").repartition("doc_id", "twin").groupBy("doc_id", "twin").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    run = F.transform("at", lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.coalesce(F.get("at", i - 1), F.lit(-1)) - 1), F.lit("1")))
    gone = Scratch(docs.sparkSession).put(out.select("doc_id", "twin", F.array_join(run, "").cast("binary").alias("gone")), "gone")
    scratch.clear()
    return gone


def with_kept_lines(docs: DataFrame, p: Shape = Shape()) -> DataFrame:
    """``row``, ``gone``, and two arrays: ``lines`` of all lines, ``kept`` of those that stay."""
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id"), F.xxhash64("text").alias("twin"))
    out = rows.join(removals(docs, p), ["doc_id", "twin"], "left").select("row", "gone", F.split("row.text", "\n").alias("lines"))
    kept = F.filter("lines", lambda x, i: F.substring(F.col("gone"), i + 1, F.lit(1)) != F.lit(b"1"))
    return out.withColumn("kept", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept))


def dedup(docs: DataFrame, p: Shape = Shape()) -> DataFrame:
    """The documents, with all their columns, without repeated lines."""
    out = with_kept_lines(docs, p)
    out = out.where(F.col("gone").isNull() | F.exists("kept", lambda x: stripped(x) != ""))
    whole = F.col("gone").isNull()
    text = F.when(whole, F.col("row.text")).otherwise(F.array_join("kept", "\n"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length(text))
    return unpacked(out, docs, **new)


def report(docs: DataFrame, p: Shape = Shape()) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of what stays; null for a null text)."""
    out = with_kept_lines(docs.select("doc_id", "text"), p)
    whole, text = F.col("gone").isNull(), F.col("row.text")
    return out.select(
        "row.doc_id",
        F.when(text.isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(whole, 0).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.sha2(F.when(whole, text).otherwise(F.array_join("kept", "\n")), 256).alias("kept_sha256"),
    )
