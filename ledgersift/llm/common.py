"""Shared pieces: scratch tables, text buffers, word hashing and components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches small: texts may be long, and workers have little memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


#: Spark deletes the shuffle files of a table that is written as soon as it is.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the cluster's shared folder, in place of cached blocks.

    The folder is ``spark.checkpoint.dir``. Only where that is unset, and all of Spark runs
    in this process, a temporary folder of this machine is used. What is written stays until
    Spark ends, as the plans that are returned read it; ``drop`` deletes what none reads.
    """

    def __init__(self, spark: SparkSession) -> None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="scratch-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.root = spark, f"{root.rstrip('/')}/{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write, and read again: cuts the lineage, survives lost executors."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        # else they stay until the driver's garbage is collected and nothing, listeners included, holds the plan
        before = self.spark.conf.get(SHUFFLES_GO, None)
        self.spark.conf.set(SHUFFLES_GO, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(SHUFFLES_GO, before) if before else self.spark.conf.unset(SHUFFLES_GO)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for df in dfs:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Delete all tables of this folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.sweep()

    def sweep(self) -> None:
        """Let Spark delete the shuffle files of plans that are gone."""
        gc.collect()
        self.spark._jvm.System.gc()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, back to back, and where each row begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
        column = column.cast(pa.large_binary())
    elif not pa.types.is_large_binary(column.type):
        column = column.cast(pa.string()).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, count=len(column) + 1, offset=column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batches, column: str, max_bytes: int = 1 << 21):
    """(batch part, bytes, offsets) with a bounded number of bytes, but whole texts."""
    for batch in batches:
        data, offs = text_buffers(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + max_bytes, side="right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def _byte_table(spec: str) -> np.ndarray:
    table = np.zeros(256, bool)
    for i in range(256):
        if spec == "space":
            table[i] = not (i == 0x20 or 0x09 <= i <= 0x0D)
        else:
            table[i] = 0x30 <= i <= 0x39 or 0x41 <= i <= 0x5A or 0x61 <= i <= 0x7A or i >= 0x80
    return table


#: Bytes of words ``[^\x20\x09-\x0D]+``.
SPACED = _byte_table("space")
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, before A-Z are lower-cased.
ALNUM = _byte_table("alnum")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        m = max(n, 64)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m, _STEP, np.uint64)]), dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (that of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_runs(data: np.ndarray, lengths: np.ndarray, part: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each run of bytes; the runs lie back to back. Works on a part at a time, as it needs 30 times its bytes."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    end = np.cumsum(lengths)
    power = _power(int(lengths.max()) + 1)
    out = np.empty(len(lengths), np.uint64)
    at = done = 0
    with np.errstate(over="ignore"):
        while at < len(lengths):
            to = max(at + 1, int(np.searchsorted(end, done + part, side="right")))
            size = lengths[at:to]
            begin = end[at:to] - size - done
            some = data[done : end[to - 1]]
            place = np.arange(len(some)) - np.repeat(begin, size)
            out[at:to] = np.add.reduceat(_BYTE_VALUE[some] * power[place], begin)
            at, done = to, int(end[to - 1])
        return mix(out + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offs: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end byte of each word, its row, and which bytes are in words. Words don't cross rows."""
    w = in_word[data]
    n = len(data)
    first = np.zeros(n, bool)
    if n:
        first[0] = True
        first[offs[1:-1][offs[1:-1] < n]] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = w[:-1]
        after[-1] = False
        after[:-1] = w[1:] & ~first[1:]
        before &= ~first
    begin = np.flatnonzero(w & ~before)
    end = np.flatnonzero(w & ~after) + 1
    return begin, end, np.searchsorted(offs, begin, side="right") - 1, w


def hash_words(data: np.ndarray, offs: np.ndarray, in_word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in order, and the row of each."""
    begin, end, row, w = word_spans(data, offs, in_word)
    kept = data[w]
    return hash_runs(LOWER[kept] if lower else kept, end - begin), row


def text_hash(words) -> np.ndarray:
    """The same hashes, of words given as bytes."""
    words = list(words)
    return hash_runs(np.frombuffer(b"".join(words), np.uint8), np.array([len(x) for x in words], np.int64)) if words else np.zeros(0, np.uint64)


def components(spark: SparkSession, scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Distributed union-find by alternating large-star and small-star steps, until nothing changes.

    edges: (a, b) longs. Returns (id, root): the smallest id that can be reached, for
    every id that has an edge. Each step is a grouped minimum, which Spark sums up before
    the shuffle, and a join on the node; the edges of a hub may be in many tasks there, as
    Spark can split such a join.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.put(e, "cc")
    state = None
    while True:
        old, state = state, e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not state[0] or state == old:
            break
        # large star: neighbours that are larger than a node go to its smallest neighbour
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("m"))
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: smaller neighbours and the node itself go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = scratch.put(small, "cc")
        scratch.drop(e)
        e = new
    roots = e.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.union(e.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()


#: Rows of (bucket, smallest id) that are broadcast at most, 16 bytes each; more are shuffled.
FEW_BUCKETS = 200_000


def stars(scratch: Scratch, marks: DataFrame, passes: int = 1) -> DataFrame:
    """(a, p): each id with the smallest id of each bucket that it is in, without pairs of equals.

    marks: (id, bucket). Any two ids of a bucket have a pair with the same p. There are at
    most as many pairs as members of buckets, however large a bucket is. The buckets are
    dealt in ``passes`` parts, one after another, so that their shuffles don't lie on disk
    together.
    """
    found = None
    for k in range(passes):
        rows = marks.where(F.pmod("bucket", F.lit(passes)) == k)
        sums = rows.groupBy("bucket").agg(F.min("id").alias("p"), F.max("id").alias("hi"), F.count("*").alias("n")).where("p <> hi")
        sums = scratch.put(sums, "buckets")
        scratch.sweep()
        # most shared buckets have two members, and are a pair already
        more = sums.where("n > 2").select("bucket", "p")
        more = F.broadcast(more) if more.count() <= FEW_BUCKETS else more
        pairs = sums.where("n = 2").select(F.col("hi").alias("a"), "p").union(rows.join(more, "bucket").where("id <> p").select(F.col("id").alias("a"), "p"))
        part = scratch.put(pairs.distinct(), "stars")
        scratch.drop(sums)
        found = part if found is None else found.union(part)
        scratch.sweep()
    return found if passes == 1 else scratch.put(found.distinct(), "stars")


def star_ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("p")).distinct()


#: Rows of 64 ids that are broadcast at most, 16 bytes each: those of some 120 million ids.
FEW_MASKS = 2_000_000


def of_ids(scratch: Scratch, rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, ...) whose id is one of ids. Ids are numbered on, as ``monotonically_increasing_id`` does.

    They are broadcast as one bit each, so that rows stay where they are; more than
    ``FEW_MASKS`` rows of bits are not, and then both sides are shuffled.
    """
    bit = "cast(id & 63 AS int)"
    masks = ids.groupBy(F.shiftright("id", 6).alias("high")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("mask"))
    masks = scratch.put(masks, "masks")
    if masks.count() > FEW_MASKS:
        return rows.join(ids.hint("merge"), "id", "left_semi")
    found = rows.join(F.broadcast(masks), F.shiftright("id", 6) == F.col("high")).where(f"bit_get(mask, {bit}) = 1")
    return found.select(*rows.columns)


#: Words of 64 bits in a sketch.
WORDS = 16


def sketches(runs: DataFrame) -> DataFrame:
    """id, n, w0, ...: of rows (id, n, h), a row for each element of a set, or more; an element sets one bit."""
    bit, word = F.expr("shiftleft(1L, cast(h & 63 AS int))"), F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(WORDS - 1))
    return runs.groupBy("id", "n").agg(*[F.bit_or(F.when(word == j, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{j}") for j in range(WORDS)])


def shared_at_most(a: str, b: str) -> Column:
    """Elements that two sets share at most, by columns n, w0, ... with these prefixes: a bit that one lacks is an element that only the other has."""

    def only(x: str, y: str) -> Column:
        bits = [F.bit_count(F.col(f"{x}w{j}").bitwiseAND(F.bitwise_not(F.col(f"{y}w{j}")))) for j in range(WORDS)]
        return sum(bits[1:], bits[0])

    return F.least(F.col(f"{a}n") - only(a, b), F.col(f"{b}n") - only(b, a))


#: Members of a family that a task holds against one another at once.
BLOCK = 1024

#: Families of fewer members are not worth a round of pivots.
CROWD = 1024


def linked_groups(scratch: Scratch, pairs: DataFrame, data: DataFrame, as_set, percent: int, rounds: int = 1, pivots: int = 4, sketch: DataFrame | None = None) -> DataFrame | None:
    """Components (id, root) of the links among members of one family; None if there is no link.

    pairs: (a, p) as of ``stars``: the family of p is p and all its a. data: (id, n, x), n
    being the number of distinct elements of the array that ``as_set`` makes of x. All pairs
    of a family are decided on their full sets, or are in one component already:

    1. Each member is compared with p. That joins a group of like members at once.
    2. In ``rounds``, members of a family of ``CROWD`` or more outside its largest component
       are compared with a few of those inside, ``pivots`` a round.
    3. What still is outside is held against the whole family, in blocks, inside a join
       that lets only pairs through which share enough by their fingerprints. A pair is tested
       in the first family that it shares.

    sketch: as of ``sketches``. With it, pairs that have too many bits apart to be a link are
    left out before their sets are read.
    """
    spark = data.sparkSession
    own = Scratch(spark)  # what is written on the way goes after each step
    def side(k: str) -> DataFrame:
        return data.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("x").alias(f"x{k}"))

    def verified(pairs: DataFrame) -> DataFrame:
        # pivots, on the side of p, may be in many pairs: Spark can split that join, as no order is asked of it
        shared = F.size(F.array_intersect(as_set(F.col("xa")), as_set(F.col("xp"))))
        like = (F.least("na", "np") * 100 >= F.greatest("na", "np") * percent) & (shared * (100 + percent) >= (F.col("na") + F.col("np")) * percent)
        if sketch is not None:
            bits = lambda k: sketch.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in sketch.columns[1:]])
            n, m = F.col("a_n"), F.col("p_n")
            near = (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (shared_at_most("a_", "p_") * (100 + percent) >= (n + m) * percent)
            pairs = own.put(pairs.join(bits("a"), "a").join(bits("p"), "p").where(near).select("a", "p"), "near")
        both = pairs.join(side("a"), "a").join(side("p"), "p").where(like)
        return own.put(both.select("a", F.col("p").alias("b")), "links")

    links = verified(pairs)
    roots = scratch.put(components(spark, own, links), "roots")
    # pairs with p are decided by now, and so are families of two: what is left are pairs of its other members
    families = pairs.select("p", F.col("a").alias("id"))
    for k in range(rounds + 1):
        own.clear()
        at = families.join(roots, "id", "left").select("p", "id", F.coalesce("root", "id").alias("root"))
        parts = at.groupBy("p", "root").agg(F.count("*").alias("n"))
        top = parts.groupBy("p").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("roots")).where(F.col("roots") > 1)
        top = top.select("p", F.col("top.root").alias("main"), F.col("all").cast("long").alias("members"), (F.col("all") - F.col("top.n")).cast("long").alias("others"))
        top = own.put(top.where(F.col("members") >= CROWD) if k < rounds else top, "open")
        if top.isEmpty():
            continue
        at = own.put(at.join(top, "p"), "members")
        if k < rounds:
            salt = F.pmod(F.xxhash64("id", F.lit(k)), F.lit(pivots)).alias("salt")
            inside = at.where("root = main").groupBy("p", salt).agg(F.min("id").alias("pivot")).select("p", "pivot")
            new = at.where("root <> main").select("p", F.col("id").alias("a")).join(inside, "p").select("a", F.col("pivot").alias("p"))
            new = verified(new.distinct())
        else:
            # sets are made of those that are compared only
            few = of_ids(own, data, at.select("id"))
            new = verified(_rest(own, at, few.select("id", "n", as_set(F.col("x")).alias("x")), percent, sketch))
        if not new.isEmpty():
            edges = roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(new)
            old, roots = roots, scratch.put(components(spark, own, edges), "roots")
            scratch.drop(old)
    own.clear()
    return None if roots.isEmpty() else roots


def _rest(scratch: Scratch, at: DataFrame, sets: DataFrame, percent: int, sketch: DataFrame | None = None) -> DataFrame:
    """Pairs (a, p) of members (p, id, root, main, members, others) outside the main component with any other of the family.

    A pair comes out if it can be a link by its members' fingerprints, of two bytes an element
    where a set takes eight. Two sets share at most as many elements as their fingerprints, and
    besides those that the fingerprint of either has lost: no link is left out, and in sets of
    some hundred elements hardly any other pair comes out.
    """
    mine = at.groupBy("id").agg(F.collect_list("p").alias("mine"))
    # drawn up where the sets are: these are not shuffled
    prints = sets.select("id", "n", F.array_distinct(F.transform("x", lambda h: F.shiftright(h, 48).cast("short"))).alias("prints"))
    prints = scratch.put(prints.join(mine, "id"), "prints")
    rows = at.join(prints, "id")
    keep = ["id", "root", "n", "mine", "prints"]
    if sketch is not None:
        rows, keep = rows.join(sketch.drop("n"), "id"), keep + [f"w{j}" for j in range(WORDS)]
    deal = lambda c, by: F.pmod(F.xxhash64("id", F.lit(by)), F.ceil(F.col(c) / BLOCK)).alias(by)
    every = lambda c, by: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(c) / BLOCK) - 1)).alias(by)
    a = rows.select("p", deal("members", "part"), every("others", "turn"), (F.col("root") == F.col("main")).alias("inside"), *[F.col(c).alias(f"a_{c}") for c in keep])
    b = rows.where("root <> main").select("p", every("members", "part"), deal("others", "turn"), *[F.col(c).alias(f"b_{c}") for c in keep])
    n, m = F.col("a_n"), F.col("b_n")
    lost = F.least(n - F.size("a_prints"), m - F.size("b_prints"))
    shared = F.size(F.array_intersect("a_prints", "b_prints")) + lost
    first = F.array_min(F.array_intersect("a_mine", "b_mine")) == F.col("p")
    # two that are both outside meet twice
    test = (F.col("a_root") != F.col("b_root")) & (F.col("inside") | (F.col("a_id") < F.col("b_id"))) & (F.least(n, m) * 100 >= F.greatest(n, m) * percent)
    if sketch is not None:
        test = test & (shared_at_most("a_", "b_") * (100 + percent) >= (n + m) * percent)
    test = test & first & (shared * (100 + percent) >= (n + m) * percent)
    both = a.join(b, ["p", "part", "turn"]).where(test)
    return scratch.put(both.select(F.greatest("a_id", "b_id").alias("a"), F.least("a_id", "b_id").alias("p")).distinct(), "maybe")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(docs: DataFrame) -> Column:
    """All columns as one, so that no name of theirs can clash with another."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns])


def unpacked(rows: DataFrame, docs: DataFrame, row: str = "row", **new: Column) -> DataFrame:
    """The columns of docs out of ``row``, some of them renewed."""
    return rows.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"{row}.{quoted(c)}")).alias(c) for c in docs.columns])
