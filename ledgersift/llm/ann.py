"""Approximate nearest neighbours by cosine, over balanced posting lists.

1. Identical vectors become one, with its ``k + 1`` smallest ids: more can never be among
   the ``k`` nearest of anything, as ties go to the smaller id. So a vector that a third of
   all rows share is one row here.
2. Centroids are fitted on at most ``sample`` vectors by k-means with a penalty on size;
   their number follows the square root of the rows, up to ``max_lists``. They are searched
   by best-first steps on a graph of neighbours, held in memory by each worker.
3. Every vector goes to the list of its nearest centroid, and to further lists whose
   centroids are nearly as near (``replicate``). A query reads the lists whose centroids
   are within ``prune`` times its nearest distance, and more until they hold enough rows.
4. A list is cut into blocks of at most ``block`` vectors and its queries too, so no task
   depends on the length of a list; a block gives each query its best few, which are merged.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do
those with a null id; vectors of different lengths are never compared. Repeated ids count
once per distinct vector. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches


@dataclass(frozen=True)
class Lists:
    sample: int = 20_000
    max_lists: int = 4096
    replicate: float = 1.12
    copies: int = 4
    prune: float = 1.35
    probes: int = 48
    least: int = 256
    block: int = 4096
    degree: int = 12
    seed: int = 9


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that no square overflows or vanishes: a cosine stays as it is, to the bit."""
    most = np.abs(x).max(axis=1, initial=0, keepdims=True)
    return np.ldexp(x, -np.frexp(most)[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def stacked(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def balanced_kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; a list that is too long looks farther away, more so each round."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    heavy = np.zeros(k)
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T - heavy).argmax(1) for i in range(0, len(x), 4096)])
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        empty = size == 0
        total[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = unit(total)
        heavy += 0.02 * (size / size.mean() - 1)
        heavy = np.clip(heavy, -0.2, 0.2)
    return c


class CentroidGraph:
    """Each centroid knows its nearest ones; searched best-first, many queries at a time."""

    def __init__(self, centroids: np.ndarray, degree: int) -> None:
        self.c = centroids.astype(np.float32)
        k = len(centroids)
        degree = min(degree, k - 1)
        near = np.concatenate([np.argsort(-(self.c[i : i + 512] @ self.c.T), axis=1)[:, 1 : degree + 1] for i in range(0, k, 512)]) if degree else np.zeros((k, 0), np.int64)
        back = [[] for _ in range(k)]
        for a in range(k):
            for b in near[a]:
                back[b].append(a)
        width = 2 * degree
        self.links = np.full((k, width), -1, np.int64)
        for a in range(k):
            both = list(dict.fromkeys([*near[a], *back[a]]))[:width]
            self.links[a, : len(both)] = both
        # entries far from one another, so that every region of the graph can be reached
        entries, far = [0], self.c @ self.c[0]
        for _ in range(min(k, max(8, int(np.sqrt(k)))) - 1):
            entries.append(int(far.argmin()))
            far = np.maximum(far, self.c @ self.c[entries[-1]])
        self.entries = np.unique(entries)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, cosines) of the nearest found, nearest first; -1 after the last."""
        n, k = len(q), len(self.c)
        width = min(width, k)
        seen = np.zeros((n, k), bool)
        seen[:, self.entries] = True
        ids = np.tile(self.entries, (n, 1))
        cos = q @ self.c[self.entries].T
        done = np.zeros(ids.shape, bool)
        at = np.arange(n)[:, None]

        def best(ids, cos, done):
            order = np.argsort(-cos, axis=1, kind="stable")[:, :width]
            return ids[at, order], cos[at, order], done[at, order]

        ids, cos, done = best(ids, cos, done)
        while True:
            left = np.where(done | (ids < 0), -np.inf, cos)
            pick = np.argsort(-left, axis=1, kind="stable")[:, :4]
            live = np.isfinite(left[at, pick])
            if not live.any():
                return ids, cos
            done[at, pick] = True
            new = np.where(live[..., None], self.links[ids[at, pick]], -1).reshape(n, -1)
            ok = (new >= 0) & ~seen[at, np.maximum(new, 0)]
            seen[np.broadcast_to(at, new.shape)[ok], new[ok]] = True
            row, col = np.nonzero(ok)
            c = np.full(new.shape, -np.inf, np.float32)
            c[row, col] = np.einsum("ij,ij->i", q[row], self.c[new[row, col]])
            # a centroid reached twice in one step counts once
            order = np.argsort(np.where(ok, new, k + np.arange(new.shape[1])), axis=1, kind="stable")
            sorted_ = np.take_along_axis(np.where(ok, new, -1), order, 1)
            twice = np.zeros_like(ok)
            twice[:, 1:] = (sorted_[:, 1:] == sorted_[:, :-1]) & (sorted_[:, 1:] >= 0)
            np.put_along_axis(c, order, np.where(twice, -np.inf, np.take_along_axis(c, order, 1)), 1)
            new = np.where(np.isfinite(c), new, -1)
            ids, cos, done = best(np.concatenate([ids, new], 1), np.concatenate([cos, c], 1), np.concatenate([done, np.zeros(new.shape, bool)], 1))


def distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cos, 0))


def _usable(vectors: DataFrame, id_col: str, column: str) -> DataFrame:
    v = F.col(column).cast("array<double>")
    ok = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull()).where(ok)


def _distinct(rows: DataFrame, keep: int) -> DataFrame:
    """One row for each distinct vector: v, its smallest ids, and those that are queries."""
    part = rows.select("v", F.col("vec_id"))
    schema = "v array<double>, vec_id long"

    def run(batches):
        """Of a partition's rows, the smallest ids of each vector."""
        held: dict[bytes, list] = {}
        for batch in batches:
            for v, i in zip(batch.column("v").to_pylist(), batch.column("vec_id").to_pylist()):
                ids = held.setdefault(np.array(v).tobytes(), [])
                ids.append(i)
                if len(ids) > 8 * keep:
                    held[np.array(v).tobytes()] = sorted(set(ids))[:keep]
        out = [(k, i) for k, ids in held.items() for i in sorted(set(ids))[:keep]]
        for at in range(0, len(out), 4096):
            some = out[at : at + 4096]
            yield pa.RecordBatch.from_pydict({"v": [np.frombuffer(k).tolist() for k, _ in some], "vec_id": [i for _, i in some]}, pa.schema([("v", pa.list_(pa.float64())), ("vec_id", pa.int64())]))

    few = part.mapInArrow(run, schema)
    return few.groupBy("v").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, keep).alias("ids")).select(F.element_at("ids", 1).alias("cid"), "v", "ids")


def search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", column: str = "embedding", p: Lists = Lists()) -> DataFrame:
    """The k nearest of each row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    arrow_batches(spark, 4096)
    rows = scratch.put(_usable(vectors, id_col, column), "vectors")
    dims = [r[0] for r in rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]
    out = None
    for d in dims:
        part = _search_one(spark, scratch, rows.where(F.size("v") == d), every, k, p)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search_one(spark, scratch: Scratch, rows: DataFrame, every: int, k: int, p: Lists) -> DataFrame:
    base = scratch.put(_distinct(rows, k + 1), "distinct")
    n = base.count()
    x = unit(stacked(base.select("v").orderBy(F.xxhash64("cid", F.lit(p.seed)), "cid").limit(p.sample).toArrow().column("v")))
    lists = int(min(p.max_lists, max(1, round(np.sqrt(n) * 1.5)), max(1, len(x) // 8)))
    graph = CentroidGraph(balanced_kmeans(x, lists, p.seed), p.degree)
    held = spark.sparkContext.broadcast(graph)

    def post(batches):
        g = held.value
        for batch in batches:
            v = stacked(batch.column("v"))
            if not len(v):
                continue
            ids, cos = g.search(unit(v).astype(np.float32), max(16, p.copies))
            d = distance(cos[:, : p.copies])
            use = (ids[:, : p.copies] >= 0) & (d <= p.replicate * d[:, :1] + 1e-7)
            row, col = np.nonzero(use)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row, col]), batch.column("cid").take(pa.array(row)), batch.column("v").take(pa.array(row))], ["list", "cid", "v"])

    postings = scratch.put(base.select("cid", "v").mapInArrow(post, "list long, cid long, v array<double>"), "postings")
    sizes = np.zeros(lists, np.int64)
    for r in postings.groupBy("list").count().collect():
        sizes[r[0]] = r[1]
    sized = spark.sparkContext.broadcast(sizes)
    asking = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    # queries with one vector are asked once
    asked = asking.select("v").distinct().join(base.select("v", F.col("cid").alias("qid")), "v")

    def probe(batches):
        g, sizes = held.value, sized.value
        for batch in batches:
            v = stacked(batch.column("v"))
            if not len(v):
                continue
            ids, cos = g.search(unit(v).astype(np.float32), p.probes)
            d = distance(cos)
            have = np.where(ids >= 0, sizes[np.maximum(ids, 0)], 0)
            before = np.cumsum(have, axis=1) - have
            use = (ids >= 0) & ((d <= p.prune * d[:, :1] + 1e-7) | (before < p.least))
            row, col = np.nonzero(use)
            which = ids[row, col]
            short = np.flatnonzero(np.where(use, have, 0).sum(1) < min(p.least, sizes.sum()))
            if len(short):  # the graph's nearest hold too little: read all lists
                keep = ~np.isin(row, short)
                row = np.concatenate([row[keep], np.repeat(short, len(sizes))])
                which = np.concatenate([which[keep], np.tile(np.arange(len(sizes)), len(short))])
            yield pa.RecordBatch.from_arrays([pa.array(which), batch.column("qid").take(pa.array(row)), batch.column("v").take(pa.array(row))], ["list", "qid", "v"])

    probes = scratch.put(asked.select("qid", "v").mapInArrow(probe, "list long, qid long, v array<double>"), "probes")
    q_sizes = {r[0]: r[1] for r in probes.groupBy("list").count().collect()}
    cuts = spark.createDataFrame([(i, int(-(-max(int(s), 1) // p.block)), int(-(-q_sizes.get(i, 1) // p.block))) for i, s in enumerate(sizes.tolist())], "list long, parts int, qparts int")
    cuts = F.broadcast(cuts)  # a row for each list, of which there are at most max_lists
    left = postings.join(cuts, "list").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts").cast("long"))).withColumn("qpart", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qparts").cast("long") - 1)))
    right = probes.join(cuts, "list").withColumn("qpart", F.pmod(F.xxhash64("qid"), F.col("qparts").cast("long"))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    most = k + 1

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"qid": [], "cid": [], "score": []})
        x, q = scaled(np.stack(a["v"].to_numpy())), scaled(np.stack(b["v"].to_numpy()))
        cid, qid = a["cid"].to_numpy(), b["qid"].to_numpy()
        ux, out = unit(x), []
        nx = np.linalg.norm(x, axis=1)
        for at in range(0, len(q), 512):
            some = q[at : at + 512]
            near = unit(some) @ ux.T
            top = min(most, near.shape[1])
            least = -np.partition(-near, top - 1, axis=1)[:, top - 1]
            # all that tie with the last but for rounding are sorted
            row, pick = np.nonzero(near >= least[:, None] - 1e-9)
            dots = [np.einsum("id,id->i", some[row[i : i + 8192]], x[pick[i : i + 8192]]) for i in range(0, len(row), 8192)]
            score = np.concatenate(dots) / (np.linalg.norm(some, axis=1)[row] * nx[pick])
            order = np.lexsort((cid[pick], -score, row))
            row, pick, score = row[order], pick[order], score[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < most
            out.append(pd.DataFrame({"qid": qid[at : at + 512][row[keep]], "cid": cid[pick[keep]], "score": score[keep]}))
        return pd.concat(out)

    keys = ["list", "part", "qpart"]
    near = left.select(*keys, "cid", "v").groupBy(*keys).cogroup(right.select(*keys, "qid", "v").groupBy(*keys)).applyInPandas(compare, "qid long, cid long, score double")
    near = near.groupBy("qid", "cid").agg(F.max("score").alias("score"))
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    near = near.withColumn("r", F.row_number().over(by)).where(F.col("r") <= most)
    ids = near.join(base.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("r", F.row_number().over(by)).where(F.col("r") <= most).select("qid", "score", "vec_id")
    whole = asking.select(F.col("vec_id").alias("query_id"), "v").distinct().join(base.select("v", F.col("cid").alias("qid")), "v").select("query_id", "qid")
    by = Window.partitionBy("query_id", "qid").orderBy(F.desc("score"), "vec_id")
    found = whole.join(ids, "qid").where("vec_id <> query_id").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
