"""Benchmark decontamination with an FM-index per shard of the training texts.

A shard is a few MB of whole texts inside a task. Its words become symbols: the words of
the benchmark are numbered, others cannot take part in a match. What is indexed are the
runs of numbered words that are long enough to hold a window, with separators between
them. The index has the Burrows-Wheeler transform as a wavelet matrix (bit vectors with
sampled counts) and every ``SAMPLE``-th suffix position; all windows of the benchmark are
searched backwards together, occurrences are located by walking to sampled positions, and
the spans are merged.

Documents are read and indexed once. The benchmark goes to the executors in blocks of about
``BLOCK_BYTES`` of text, of which a worker holds one at a time; all blocks are searched in
the one index of a shard. Beside them a worker holds 8 bytes for each distinct word of the
benchmark. How the benchmark is cut into blocks changes no result.

Null texts have no words. Items without words have no windows and match nothing. Items with
a null id count as one item, which is not named. Repeated rows and ids, and rows with a null
id, are scanned each for itself; extra columns are ignored. Empty tables give no rows, an
empty benchmark no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, arrow_batches, hash_runs, slices, text_buffers, word_spans

BLOCK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
SAMPLE = 16
WINDOW = 10


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 2, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, width: int) -> None:
        self.width, self.levels, self.zeros = width, [], []
        at = symbols
        for k in reversed(range(width)):
            bit = (at >> k) & 1
            self.levels.append(Bits(bit.astype(bool)))
            self.zeros.append(int(len(bit) - bit.sum()))
            at = np.concatenate([at[bit == 0], at[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first i."""
        lo, hi = np.zeros_like(i), i
        for k, bits, zeros in zip(reversed(range(self.width)), self.levels, self.zeros):
            one = ((symbol >> k) & 1).astype(bool)
            a, b = bits.rank(lo), bits.rank(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling. Separators (0) are ordered by position, so that no comparison crosses one."""
    rank = text.astype(np.int64)
    gaps = np.flatnonzero(text == 0)
    rank += len(gaps)
    rank[gaps] = np.arange(len(gaps))
    n, k = len(text), 1
    order = np.argsort(rank, kind="stable")
    while True:
        key = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        if not n or new[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[:-k] = new[k:] + 1
        rank = new * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        k *= 2


class FmIndex:
    """Of runs of symbols >= 1, with a 0 after each run."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        sa = suffix_array(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        previous = np.where(sa > 0, text[sa - 1], 0)
        self.bwt = previous
        self.tree = WaveletMatrix(previous, max(1, int(symbols).bit_length()))
        sampled = (sa % SAMPLE == 0) | (previous == 0)  # starts of runs too: no walk crosses a separator
        self.sampled, self.places = Bits(sampled), sa[sampled]
        self.is_sampled = sampled

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each window; windows are right-aligned."""
        lo = np.zeros(len(windows), np.int64)
        hi = np.full(len(windows), len(self.bwt))
        for back in range(windows.shape[1]):
            on = np.flatnonzero((lengths > back) & (lo < hi))
            if not len(on):
                break
            c = windows[on, -1 - back]
            lo[on] = self.first[c] + self.tree.rank(c, lo[on])
            hi[on] = self.first[c] + self.tree.rank(c, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of these rows of the suffix array."""
        out, steps, rows = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), rows.copy()
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.is_sampled[rows[open_]]
            hit = open_[done]
            out[hit] = self.places[self.sampled.rank(rows[hit])] + steps[hit]
            open_ = open_[~done]
            c = self.bwt[rows[open_]]
            rows[open_] = self.first[c] + self.tree.rank(c, rows[open_])
            steps[open_] += 1
        return out


class Phrases:
    """The distinct windows of some benchmark items, as symbols, and the items of each."""

    def __init__(self, names: list[str | None], symbol: np.ndarray, row: np.ndarray, size: int = WINDOW) -> None:
        cut = np.searchsorted(row, np.arange(len(names) + 1))
        count = np.diff(cut)
        item = np.repeat(np.arange(len(names)), np.where(count >= size, count - size + 1, np.minimum(count, 1)))
        start = np.arange(len(item)) - np.searchsorted(item, item) + cut[item]
        length = np.minimum(count, size)[item]
        windows = np.zeros((len(item), size), np.int32)  # right-aligned
        for k in range(size):
            on = length > k
            windows[on, size - 1 - k] = symbol[(start + length - 1)[on] - k]
        _, first, back = np.unique(windows.view(f"V{4 * size}").ravel(), return_index=True, return_inverse=True)
        self.windows, self.lengths = windows[first], length[first]
        self.names = sorted(set(names), key=lambda x: (x is not None, x))
        place = {x: k for k, x in enumerate(self.names)}
        both = np.unique(back * max(len(names), 1) + np.array([place[x] for x in names], np.int64)[item])
        self.owners = both % max(len(names), 1)
        self.owned = np.searchsorted(both // max(len(names), 1), np.arange(len(first) + 1))


def words_of(data: np.ndarray, offs: np.ndarray):
    begin, end, row, w = word_spans(data, offs, ALNUM)
    return hash_runs(LOWER[data[w]], end - begin), row, begin, end


def ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of all ranges, and the range of each."""
    size = end - begin
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[which], which


class Held:
    """The benchmark on the executors: its words, and blocks of phrases of which a worker holds one at a time."""

    def __init__(self, vocab, shortest: int, blocks: list) -> None:
        self.vocab, self.shortest, self.blocks = vocab, shortest, blocks

    def phrases(self):
        for block in self.blocks:
            yield block.value
            if len(self.blocks) > 1:
                vars(block).pop("_value", None)  # it is read again from the worker's own copy


def scan_shard(held: Held, data: np.ndarray, offs: np.ndarray):
    """(words of each row, row and first and last byte of each merged span with its number of words, the items of each row)."""
    n = len(offs) - 1
    hashes, row, begin, end = words_of(data, offs)
    n_words = np.bincount(row, minlength=n)
    none = np.zeros(0, np.int64)
    items: dict[int, set] = {}
    nothing = n_words, (none, none, none, none), items
    vocab = held.vocab.value
    if not len(hashes) or not len(vocab):
        return nothing
    at = np.minimum(np.searchsorted(vocab, hashes), len(vocab) - 1)
    symbol = np.where(vocab[at] == hashes, at + 1, 0)
    # runs of numbered words in one row that are as long as the shortest window
    start = np.concatenate([[True], (row[1:] != row[:-1]) | ((symbol[1:] > 0) != (symbol[:-1] > 0))])
    heads = np.flatnonzero(start)
    tails = np.append(heads[1:], len(symbol))
    use = (symbol[heads] > 0) & (tails - heads >= held.shortest)
    if not use.any():
        return nothing
    word, run = ranges(heads[use], tails[use])
    place = np.arange(len(word)) + run  # a separator after each run
    text = np.zeros(len(word) + run[-1] + 1, np.int64)
    text[place] = symbol[word]
    origin = np.full(len(text), -1)
    origin[place] = word
    index = FmIndex(text, len(vocab))
    cover = np.zeros(len(symbol) + 1, np.int64)
    for p in held.phrases():
        lo, hi = index.search(p.windows, p.lengths)
        rows, which = ranges(lo, hi)
        if not len(rows):
            continue
        first = origin[index.locate(rows)]
        np.add.at(cover, first, 1)
        np.add.at(cover, first + p.lengths[which], -1)
        pair = np.unique(row[first] * len(p.lengths) + which)
        item, owner = ranges(p.owned[pair % len(p.lengths)], p.owned[pair % len(p.lengths) + 1])
        both = np.unique((pair // len(p.lengths))[owner] * len(p.names) + p.owners[item])
        for r, k in zip((both // len(p.names)).tolist(), (both % len(p.names)).tolist()):
            items.setdefault(r, set()).add(p.names[k])
    hit = np.cumsum(cover)[:-1] > 0
    edge = np.concatenate([[True], (hit[1:] != hit[:-1]) | (row[1:] != row[:-1])])
    a = np.flatnonzero(edge)
    b = np.append(a[1:], len(hit))
    keep = hit[a]
    a, b = a[keep], b[keep]
    return n_words, (row[a], begin[a], end[b - 1], b - a), items


def hold(benchmark: DataFrame) -> Held:
    """Read the benchmark, a block of bounded size at a time, and send its words and windows out."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(-(-size // BLOCK_BYTES)) or 1
    found = []
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("name", F.lit(3)), F.lit(n)) == k).toArrow()
        hashes, row, *_ = words_of(*text_buffers(part.column("text")))
        found.append((part.column("name").to_pylist(), hashes, row))
    vocab = np.unique(np.concatenate([h for _, h, _ in found]))
    shortest = WINDOW
    blocks = []
    for k, (names, hashes, row) in enumerate(found):
        p = Phrases(names, np.searchsorted(vocab, hashes).astype(np.int32) + 1, row)
        found[k] = None
        if len(p.lengths):
            shortest = min(shortest, int(p.lengths.min()))
            blocks.append(spark.sparkContext.broadcast(p))
    return Held(spark.sparkContext.broadcast(vocab), shortest, blocks)


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_hit, spans (words and bytes), items (sorted, null first)."""
    arrow_batches(docs.sparkSession)
    held = hold(benchmark)

    def run(batches):
        for part, data, offs in slices(batches, "text", SHARD_BYTES):
            n = part.num_rows
            n_words, (row, begin, end, size), items = scan_shard(held, data, offs)
            cut = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            names = [sorted(items.get(k, ()), key=lambda x: (x is not None, x)) for k in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    pa.array(n_words.astype(np.int64)),
                    pa.array(np.bincount(row, size, n).astype(np.int64)),
                    pa.ListArray.from_arrays(cut, (begin - offs[row]).astype(np.int64)),
                    pa.ListArray.from_arrays(cut, (end - offs[row]).astype(np.int64)),
                    pa.array(names, pa.list_(pa.string())),
                ],
                ["doc_id", "n_words", "n_hit", "begins", "ends", "items"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_hit long, begins array<long>, ends array<long>, items array<string>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without the merged spans; one that has no other words is dropped.

    What is left is searched again until no window occurs, as a cut can bring the two
    ends of another occurrence together. All columns are kept; ``n_chars`` is renewed.
    """
    arrow_batches(docs.sparkSession)
    held = hold(benchmark)
    # columns by their place: any names will do
    place = {c: k for k, c in enumerate(docs.columns)}
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    text = f"c{place['text']}"

    def run(batches):
        for part, data, offs in slices(batches, text, SHARD_BYTES):
            _, (row, begin, end, _), _ = scan_shard(held, data, offs)
            if not len(row):
                yield part
                continue
            texts, keep = part.column(text).to_pylist(), np.ones(part.num_rows, bool)
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            for k in np.unique(row).tolist():
                mine = slice(cut[k], cut[k + 1])
                left = cut_out(data[offs[k] : offs[k + 1]].tobytes(), begin[mine] - offs[k], end[mine] - offs[k])
                while True:
                    words, (again, b, e, _), _ = scan_shard(held, np.frombuffer(left, np.uint8), np.array([0, len(left)]))
                    if not len(again):
                        break
                    left = cut_out(left, b, e)
                texts[k], keep[k] = left.decode(), bool(words[0])
            columns = dict(zip(part.schema.names, part.columns))
            columns[text] = pa.array(texts, part.schema.field(text).type)
            if "n_chars" in place:
                chars = f"c{place['n_chars']}"
                old = columns[chars].to_pylist()
                for k in np.unique(row).tolist():
                    old[k] = len(texts[k])
                columns[chars] = pa.array(old, part.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns)).filter(pa.array(keep))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def cut_out(text: bytes, begin: np.ndarray, end: np.ndarray) -> bytes:
    at, parts = 0, []
    for a, b in zip(begin.tolist(), end.tolist()):
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])
