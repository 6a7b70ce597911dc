"""Language-model scoring with a hidden Markov model.

Tokens are lower-cased words, then one end token a text. A state emits a word class (a
hash of the word's first two and last three bytes), and the class emits the word with
its add-one share of the class's training tokens; one more share is that of unknown
words. All distributions sum to one, so a text's likelihood is exact; it is computed by
the scaled forward recursion. The number of states and classes is fixed, so parameters
do not grow with the corpus; word counts do, and never leave the executors.

Steps:

1. Texts become blocks of coded tokens, written once: each block has its own dictionary.
2. Baum-Welch, every pass over every training text: expected counts are summed across
   partitions by a grouped sum. The start is the class counts of all training texts, each
   dealt to a state by a hash of its classes. Passes end when the mean log-likelihood of a
   token grows by less than ``settled`` of itself, or with the last of ``passes``.
3. Dictionaries are dealt out by word hash, as packed pieces; each bucket adds up the
   counts of its words and replies to every block that asked, block by block.
4. Each block with its replies is scored.

Null texts are empty: one token, the end. Rows with a null id count as training rows.
Repeated rows count each. Without any training row every word is unknown.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACED, Scratch, arrow_batches, hash_runs, mix, text_buffers, word_spans

#: Texts of a block go through the recursions side by side: the more there are, the less a long one costs.
BLOCK_BYTES = 10 << 20
BUCKET_BYTES = 16 << 20
END = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Hmm:
    states: int = 6
    classes: int = 4096
    passes: int = 20
    settled: float = 1e-3
    seed: int = 3


def _gathered(batches, max_bytes: int):
    """Batches put together until they hold so many bytes of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= max_bytes:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def encode_block(data: np.ndarray, offs: np.ndarray, train: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    """Codes of all tokens (into the block's dictionary, sorted by hash; its last is the end token)."""
    n = len(offs) - 1
    begin, end, row, w = word_spans(data, offs, SPACED)
    low = LOWER[data]
    hashes = np.minimum(hash_runs(low[w], end - begin), END - np.uint64(1))
    words, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    b, e = begin[first], end[first]
    key = np.zeros(len(words), np.uint64)
    for part in (b, np.minimum(b + 1, e - 1), np.maximum(e - 3, b), np.maximum(e - 2, b), e - 1):
        key = (key << np.uint64(8)) | low[part].astype(np.uint64)
    kind = (mix(key) % np.uint64(classes - 1) + np.uint64(1)).astype(np.uint16)
    sizes = np.bincount(row, minlength=n) + 1
    codes = np.full(sizes.sum(), len(words), np.int32)
    codes[np.arange(len(back)) + row] = back  # an end after each text
    counts = np.bincount(back, train[row], len(words)).astype(np.int64)
    return {
        "sizes": sizes.astype(np.int32),
        "codes": codes,
        "hashes": np.append(words, END),
        "counts": np.append(counts, int(train.sum())).astype(np.int64),
        "kinds": np.append(kind, 0).astype(np.uint16),
    }


def _encode(classes: int):
    def run(batches):
        pid = TaskContext.get().partitionId()
        for k, part in enumerate(_gathered(batches, BLOCK_BYTES)):
            data, offs = text_buffers(part.column("text"))
            held = np.asarray(part.column("held_out").to_pylist(), bool)
            x = encode_block(data, offs, (~held).astype(np.float64), classes)
            yield pa.RecordBatch.from_pydict(
                {"block": [(pid << 32) + k], "ids": [part.column("doc_id").to_pylist()], "held": [held.tolist()]} | {c: [v.tobytes()] for c, v in x.items()}, _BLOCK
            )

    return run


_BLOCK = pa.schema(
    [("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_()))] + [(c, pa.binary()) for c in ("sizes", "codes", "hashes", "counts", "kinds")]
)
_BLOCK_DDL = "block long, ids array<long>, held array<boolean>, sizes binary, codes binary, hashes binary, counts binary, kinds binary"


class Sequences:
    """Texts of a block, laid out by time: at each step come the texts that are that long."""

    def __init__(self, kinds: np.ndarray, sizes: np.ndarray) -> None:
        order = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(sizes), np.int64)
        rank[order] = np.arange(len(sizes))
        longest = int(sizes.max()) if len(sizes) else 0
        self.active = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(longest), side="right")
        self.base = np.concatenate([[0], np.cumsum(self.active)])
        text = np.repeat(np.arange(len(sizes)), sizes)
        step = np.arange(len(kinds)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = self.base[step] + rank[text]
        self.kinds = np.empty(len(kinds), np.int64)
        self.kinds[at] = kinds
        self.text = np.empty(len(kinds), np.int64)
        self.text[at] = text
        self.n = len(sizes)


def forward(m: dict, q: Sequences, kind: type = np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Scaled state distributions, and the scale (the token's likelihood given those before); in single precision to train, in double to score."""
    alpha = np.empty((len(q.kinds), len(m["start"])), kind)
    scale = np.empty(len(q.kinds), kind)
    emit = np.ascontiguousarray(m["emit"].T, kind)
    move, start = m["move"].astype(kind), m["start"].astype(kind)
    for t in range(len(q.active)):
        a, n = q.base[t], q.active[t]
        b = emit[q.kinds[a : a + n]]
        b *= start if t == 0 else alpha[q.base[t - 1] : q.base[t - 1] + n] @ move
        c = b.sum(axis=1)
        scale[a : a + n] = c
        b /= c[:, None]
        alpha[a : a + n] = b
    return alpha, scale


def expected(m: dict, q: Sequences) -> dict[str, np.ndarray]:
    """Expected counts of the Baum-Welch step, over all texts of the block."""
    alpha, scale = forward(m, q)
    states, classes = m["emit"].shape
    emit = np.ascontiguousarray(m["emit"].T, np.float32)
    move = m["move"].astype(np.float32)
    moved = np.zeros((states, states))
    after = None
    for t in reversed(range(len(q.active))):
        a, n = q.base[t], q.active[t]
        beta = np.ones((n, states), np.float32)
        if after is not None:
            k = len(after)
            beta[:k] = after @ move.T
            moved += alpha[a : a + k].T @ after
        after = emit[q.kinds[a : a + n]] * beta / scale[a : a + n, None]
        alpha[a : a + n] *= beta  # from here on: the posterior of the states
    start = alpha[: q.active[0]].sum(axis=0, dtype=np.float64) if len(q.active) else np.zeros(states)
    return {
        "start": start,
        "move": moved * m["move"],
        "emit": np.stack([np.bincount(q.kinds, alpha[:, s], classes) for s in range(states)]),
        "likely": np.array([np.log(scale.astype(np.float64)).sum(), len(scale)]),
    }


def dealt(q: Sequences, p: Hmm) -> dict[str, np.ndarray]:
    """Class counts of a state's texts: a text is dealt to one by a hash of its classes."""
    # sums of hashes: the same wherever the text is stored
    sums = np.zeros(q.n, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(sums, q.text, mix(q.kinds.astype(np.uint64) + np.uint64(p.seed)))
    owner = (mix(sums) % np.uint64(p.states)).astype(np.int64)[q.text]
    return {"start": np.zeros(p.states), "move": np.zeros((p.states, p.states)), "emit": np.stack([np.bincount(q.kinds, owner == s, p.classes) for s in range(p.states)]), "likely": np.zeros(2)}


def maximise(counts: dict, p: Hmm) -> dict[str, np.ndarray]:
    """Parameters from expected counts, smoothed: no probability is zero."""
    emit = counts["emit"]
    share = (emit.sum(axis=0) + 0.5) / (emit.sum() + 0.5 * emit.shape[1])
    emit = emit + 20.0 * share
    move = counts["move"] + 1.0
    start = counts["start"] + 1.0
    return {"start": start / start.sum(), "move": move / move.sum(axis=1, keepdims=True), "emit": emit / emit.sum(axis=1, keepdims=True)}


def _training(row: dict, only_training: bool = True) -> Sequences:
    sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
    kinds = np.frombuffer(row["kinds"], np.uint16)[np.frombuffer(row["codes"], np.int32)].astype(np.int64)
    if only_training:
        use = ~np.asarray(row["held"], bool)
        kinds, sizes = kinds[np.repeat(use, sizes)], sizes[use]
    return Sequences(kinds, sizes)


def _begin(emit: np.ndarray, p: Hmm) -> dict[str, np.ndarray]:
    """Where Baum-Welch starts. Without any training text that is all there is."""
    rng = np.random.default_rng(p.seed)
    spread = rng.gamma(1.0, 1.0, emit.shape)
    # states drift towards kinds of text
    flat = {"start": np.ones(p.states), "move": np.eye(p.states) * 50 + 1, "emit": emit * (0.5 + rng.random(emit.shape)) if emit.any() else spread}
    return maximise(flat, p)


def _summed(blocks: DataFrame, counts, p: Hmm) -> dict[str, np.ndarray]:
    """Sums over the training texts of all blocks."""
    sizes = {"start": p.states, "move": p.states**2, "emit": p.states * p.classes, "likely": 2}

    def run(batches):
        total = np.zeros(sum(sizes.values()))
        for batch in batches:
            for row in batch.to_pylist():
                q = _training(row)
                if q.n:
                    got = counts(q)
                    total += np.concatenate([got[k].ravel() for k in sizes])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    rows = blocks.select("held", "sizes", "codes", "kinds").mapInArrow(run, "slot long, n double").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(sum(sizes.values()))
    for r in rows:
        total[r.slot] = r.n
    cut = np.cumsum([0, *sizes.values()])
    out = {k: total[a:b] for k, a, b in zip(sizes, cut, cut[1:])}
    return out | {"move": out["move"].reshape(p.states, -1), "emit": out["emit"].reshape(p.states, -1)}


def train(blocks: DataFrame, p: Hmm) -> dict[str, np.ndarray]:
    """Baum-Welch over every training text of all blocks, until the likelihood settles."""
    spark = blocks.sparkSession
    arrow_batches(spark, 1)
    emit = _summed(blocks, lambda q: dealt(q, p), p)["emit"]
    m, before = _begin(emit, p), None
    for _ in range(p.passes if emit.any() else 0):
        held = spark.sparkContext.broadcast(m)
        counts = _summed(blocks, lambda q, held=held: expected(held.value, q), p)
        m = maximise(counts, p)
        mean = counts["likely"][0] / counts["likely"][1]
        if before is not None and mean - before < p.settled * abs(before):
            break
        before = mean
    arrow_batches(spark)
    return m


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pieces(buckets: int):
    """A block's dictionary, cut by bucket."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                hashes, counts, kinds = (np.frombuffer(row[c], t) for c, t in (("hashes", np.uint64), ("counts", np.int64), ("kinds", np.uint16)))
                # hashes are in order, and so are their buckets
                full, cut = np.unique(_bucket_of(hashes, buckets), return_index=True)
                cut = np.append(cut, len(hashes))
                for at in range(0, len(full), 256):
                    some = range(at, min(at + 256, len(full)))
                    yield pa.RecordBatch.from_pydict(
                        {"bucket": full[some.start : some.stop], "block": np.full(len(some), row["block"])} | {c: [v[cut[k] : cut[k + 1]].tobytes() for k in some] for c, v in (("hashes", hashes), ("counts", counts), ("kinds", kinds))},
                        pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()), ("kinds", pa.binary())]),
                    )

    return run


def _add_up(classes: int):
    """A bucket: all counts of its words; a reply to each block, and sums by class."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["hashes"].str.len().to_numpy() // 8
        hashes, counts, kinds = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("hashes", np.uint64), ("counts", np.int64), ("kinds", np.uint16)))
        order = np.argsort(hashes, kind="stable")
        new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
        total = np.add.reduceat(counts[order], np.flatnonzero(new))
        reply = np.empty(len(hashes), np.int64)
        reply[order] = total[np.cumsum(new) - 1]
        kind = kinds[order][new]
        tokens = np.bincount(kind, total, classes).astype(np.int64)
        words = np.bincount(kind, total > 0, classes).astype(np.int64)
        cut = np.cumsum([0, *sizes])
        at = np.flatnonzero(words)
        out = pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "counts": [reply[a:b].tobytes() for a, b in zip(cut, cut[1:])], "kinds": None, "tokens": None, "words": None})
        sums = pd.DataFrame({"block": [-1], "bucket": [pdf["bucket"].iloc[0]], "counts": [b""], "kinds": [at.tolist()], "tokens": [tokens[at].tolist()], "words": [words[at].tolist()]})
        return pd.concat([out, sums], ignore_index=True)

    return run


def score(docs: DataFrame, p: Hmm = Hmm()) -> DataFrame:
    """docs (doc_id, text, held_out) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    arrow_batches(spark)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
    blocks = scratch.put(rows.mapInArrow(_encode(p.classes), _BLOCK_DDL), "blocks")
    buckets = int(size // BUCKET_BYTES + 1)
    arrow_batches(spark, 1)
    pieces = blocks.select("block", "hashes", "counts", "kinds").mapInArrow(_pieces(buckets), "bucket long, block long, hashes binary, counts binary, kinds binary")
    replies = scratch.put(
        pieces.groupBy("bucket").applyInPandas(_add_up(p.classes), "block long, bucket long, counts binary, kinds array<long>, tokens array<long>, words array<long>"), "replies"
    )
    m = train(blocks, p)
    scratch.sweep()
    by_kind = replies.where("block = -1").select(F.explode(F.arrays_zip("kinds", "tokens", "words")).alias("x")).groupBy("x.kinds").agg(F.sum("x.tokens").alias("tokens"), F.sum("x.words").alias("words")).collect()
    tokens, words = np.zeros(p.classes), np.zeros(p.classes)
    for r in by_kind:
        tokens[r.kinds], words[r.kinds] = r.tokens, r.words
    held = spark.sparkContext.broadcast((m, tokens, words))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        m, tokens, words = held.value
        parts = []
        for row in left.to_dict("records"):
            counts = np.frombuffer(b"".join(right.sort_values("bucket")["counts"]), np.int64)
            codes = np.frombuffer(row["codes"], np.int32)
            sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
            kinds = np.frombuffer(row["kinds"], np.uint16).astype(np.int64)
            text = np.repeat(np.arange(len(sizes)), sizes)
            base = np.log10((counts + 1) / (tokens.sum() + words.sum() + 1))
            given = np.log10((counts + 1) / (tokens[kinds] + words[kinds] + 1))
            q = Sequences(kinds[codes], sizes)
            _, scale = forward(m, q, np.float64)
            total = np.bincount(text, given[codes], len(sizes)) + np.bincount(q.text, np.log10(scale), len(sizes))
            parts.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.array(list(row["ids"]), "Int64"),
                        "held_out": np.asarray(row["held"], bool),
                        "n_tokens": sizes,
                        "n_known": np.bincount(text, counts[codes] > 0, len(sizes)).astype(np.int64),
                        "train_tokens": int(tokens.sum()),
                        "base_score": np.bincount(text, base[codes], len(sizes)),
                        "score": total,
                    }
                )
            )
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    asked = replies.where("block >= 0").select("block", "bucket", "counts")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(run, schema)
