"""Substring dedup: bytes covered by a string of ``length`` bytes that starts in an earlier document too.

Windows are the strings of ``length`` bytes of a text. Equal windows have equal anchors:
the leftmost of the smallest ``GRAM``-byte hashes in them. That makes the work local:

1. Texts become blocks of about ``BLOCK_BYTES``, packed and written once; a row is known by
   its block and its place there. A block deals out its distinct anchors, four bytes each,
   with a bit that says whether several of its rows have it. A bucket of anchors replies with
   a bit for each: is it elsewhere too? All other windows are unique to a row.
2. Blocks give each shared anchor with its context, the bytes of all windows around it.
   Contexts that are the same within a block are dealt out once, for the smallest document;
   the others are duplicates already.
3. A bucket is a sparse suffix array over its contexts, sorted deep-shallow: multikey
   quicksort, eight bytes at a time, to a depth of ``SHALLOW``; what still shares a prefix
   is put in order by blind tries. Equal neighbours are copies. Where an anchor has
   different contexts, the suffixes at all of their windows are sorted in the same way.
   Of equal windows the smallest document's stays.
4. Spans go back to their blocks and are merged.

Buckets grow in number with the input, not in size, but for what nearly all blocks hold: a
string reaches its bucket once for each block at most, however many documents have it. What
decides is bytes: hashes only say what is looked at.

Null texts are empty; rows with a null id take no part and lose nothing; rows that share
an id don't take from one another. Texts shorter than ``length`` lose nothing. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE_VALUE, _STEP, Scratch, arrow_batches, mix, slices

LENGTH = 50
GRAM = 20
SHALLOW = 24
#: Windows that are looked at together.
PART = 1 << 19
BLOCK_BYTES = 4 << 20
#: Bytes of text for each bucket of anchors, and of contexts.
ANCHOR_BYTES = 48 << 20
CONTEXT_BYTES = 6 << 20


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` bytes at each place."""
    with np.errstate(over="ignore"):
        power, have, h = np.uint64(_STEP), 1, _BYTE_VALUE[data]
        parts, left, at = [], size, 0
        while left:
            if left & 1:
                parts.append((at, have, h, power))
                at += have
            left >>= 1
            if left:
                h = h[:-have] * power + h[have:]
                power, have = power * power, have * 2
        n = len(data) - size + 1
        out = np.zeros(max(n, 0), np.uint64)
        for at, _, h, power in parts:
            out *= power
            out += h[at : at + n]
        return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """Runs of windows with one anchor: row, first window, number of windows, anchor's place, its hash."""
    out = []
    low = np.uint64((1 << 20) - 1)
    size = len(data)
    ends = offs[1:]
    for at in range(0, max(size - length + 1, 0), PART):
        some = data[at : min(size, at + PART + length - 1)]
        h = gram_hashes(some, gram)
        place = np.arange(len(h), dtype=np.uint64)
        best = (sliding_min((h & ~low) | place, length - gram + 1) & low).astype(np.int64)
        row = np.searchsorted(ends, at + np.arange(len(best)), side="right")
        good = ends[row] - (at + np.arange(len(best))) >= length
        edge = np.ones(len(best), bool)
        edge[1:] = (best[1:] != best[:-1]) | (row[1:] != row[:-1]) | ~good[:-1]
        first = np.flatnonzero(edge & good)
        if not len(first):
            continue
        stop = np.append(np.flatnonzero(edge | ~good), len(best))
        n = stop[np.searchsorted(stop, first, side="right")] - first
        out.append((row[first], first + at, n, best[first] + at, h[best[first]]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def codes(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and key of each anchor: the key is in the low half."""
    h = mix(h ^ np.uint64(0x2545F4914F6CDD1D))  # anchors are small, being minima
    bucket = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return bucket << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


class BlindTrie:
    """Suffixes in order; inner nodes know only where their children differ, so a descent compares one byte a node."""

    def __init__(self, text: bytes, depth: int, limit: int) -> None:
        self.text, self.depth, self.limit, self.root = text, depth, limit, None

    def add(self, start: int, member: int) -> None:
        text = self.text
        x = self.root
        if x is None:
            self.root = (-1, start, [member])
            return
        path = []
        while x[0] >= 0:
            path.append(x)
            kids = x[1]
            y = kids.get(text[start + x[0]])
            x = y if y is not None else next(iter(kids.values()))
        a, b = text[start + self.depth : start + self.limit], text[x[1] + self.depth : x[1] + self.limit]
        if a == b:
            x[2].append(member)
            return
        other = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
        place = self.limit - (other.bit_length() + 7) // 8
        mine, its = text[start + place], text[x[1] + place]
        leaf = (-1, start, [member])
        above = None
        for node in path:
            if node[0] >= place:
                x = node
                break
            above = node
        if x[0] == place:
            x[1][mine] = leaf
            return
        new = [place, {its: x, mine: leaf}]
        if above is None:
            self.root = new
        else:
            above[1][text[start + above[0]]] = new

    def leaves(self) -> list[list[int]]:
        """Members of each distinct suffix, in order."""
        out, stack = [], [self.root]
        while stack:
            x = stack.pop()
            if x[0] < 0:
                out.append(x[2])
            else:
                stack.extend(x[1][c] for c in sorted(x[1], reverse=True))
        return out


def deep_shallow(text: bytes, starts: np.ndarray, group: np.ndarray, size: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes within groups, and a class for each suffix: equal ones of a group have the same.

    ``group`` numbers sets of suffixes whose ``size`` (bytes that count) is the same.
    ``text`` must go on for ``shallow`` bytes after the last start.
    """
    n = len(starts)
    raw = np.frombuffer(text, np.uint8)
    at8 = np.ndarray((max(len(raw) - 7, 0),), ">u8", raw, 0, (1,))
    order = np.argsort(group, kind="stable")
    new = np.ones(n, bool)
    g = group[order]
    new[1:] = g[1:] != g[:-1]
    for depth in range(0, shallow, 8):
        # only parts of more than one suffix go on
        head = np.flatnonzero(new)
        length = np.diff(np.append(head, n))
        open_ = np.repeat(length > 1, length)
        place = np.flatnonzero(open_)
        if not len(place):
            break
        el = order[place]
        key = at8[starts[el] + depth].astype(np.uint64)
        over = depth + 8 - size[el]
        cut = over > 0
        key[cut] &= ~((np.uint64(1) << (8 * np.minimum(over[cut], 7)).astype(np.uint64)) - np.uint64(1))
        key[over >= 8] = 0
        part = np.cumsum(new)[place]
        o = np.lexsort((key, part))
        order[place] = el[o]
        key = key[o]
        same = np.zeros(len(place), bool)
        same[1:] = (key[1:] == key[:-1]) & (part[o][1:] == part[o][:-1])
        new[place] = ~same
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, n))
    deep = np.flatnonzero((length > 1) & (size[order[head]] > shallow))
    where = starts.tolist() if len(deep) else []
    for k in deep.tolist():
        a, m = int(head[k]), int(length[k])
        members = order[a : a + m].tolist()
        trie = BlindTrie(text, shallow, int(size[members[0]]))
        for i in members:
            trie.add(where[i], i)
        for leaf in trie.leaves():
            order[a : a + len(leaf)] = leaf
            new[a + 1 : a + len(leaf)] = False
            new[a] = True
            a += len(leaf)
    classes = np.empty(n, np.int64)
    classes[order] = np.cumsum(new) - 1
    return order, classes


def repeated_windows(text: bytes, start, n, off, key, doc, length: int) -> np.ndarray:
    """Of contexts (with distinct documents or places), which windows start in a smaller document too.

    A flag for each window, context by context. ``off``: of the anchor in the context.
    """
    size = n + length - 1
    group = _numbered(key, n, off)
    _, same = deep_shallow(text, start, group, size)
    # copies of a whole context: those of larger documents go, one stands for those of the smallest
    least = np.full(same.max() + 1 if len(same) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, same, doc)
    later = doc > least[same]
    first = np.full(len(least), len(doc))
    stays = np.flatnonzero(~later)
    np.minimum.at(first, same[stays], stays)
    first = first[first < len(doc)]
    # anchors with different contexts: their windows one by one
    anchor = _numbered(key[first])
    mixed = first[np.bincount(anchor)[anchor] > 1] if len(first) else first
    begin = np.cumsum(n) - n
    out = np.repeat(later, n)
    if len(mixed):
        window = ranges(start[mixed], n[mixed])
        which = np.repeat(mixed, n[mixed])
        rel = off[which] - (window - start[which])
        _, cls = deep_shallow(text, window, _numbered(key[which], rel), np.full(len(window), length))
        least = np.full(cls.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, cls, doc[which])
        flag = doc[which] > least[cls]
        out[ranges(begin[mixed], n[mixed])] = flag
        # other places of the same context in the same document
        twin = stays[~np.isin(stays, mixed)]
        rep = np.full(same.max() + 1, -1)
        rep[same[mixed]] = mixed
        twin = twin[rep[same[twin]] >= 0]
        if len(twin):
            out[ranges(begin[twin], n[twin])] = out[ranges(begin[rep[same[twin]]], n[twin])]
    return out


def _numbered(*keys: np.ndarray) -> np.ndarray:
    """Equal tuples get equal numbers."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def runs(flags: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first window, end byte) of the runs of flagged windows, both from the context's start."""
    begin = np.cumsum(n) - n
    which = np.repeat(np.arange(len(n)), n)
    edge = np.ones(len(flags), bool)
    edge[1:] = (flags[1:] != flags[:-1]) | (which[1:] != which[:-1])
    a = np.flatnonzero(edge)
    b = np.append(a[1:], len(flags))
    on = flags[a]
    a, b = a[on], b[on]
    return which[a], a - begin[which[a]], b - 1 - begin[which[a]] + length


_BLOCK = "block long, ids array<long>, sizes binary, text binary, raw long"
_PIECE = "bucket long, block long, keys binary, many binary"
_REPLY = "block long, bucket long, bits binary"
_CONTEXT = "bucket long, block long, rows binary, docs binary, row binary, first binary, n binary, off binary, bytes binary"
_SPANS = "block long, spans binary"
_OUT = "doc_id long, n_bytes long, begins array<long>, ends array<long>, kept binary"


def _batch(rows: list[dict], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])
    return pa.RecordBatch.from_pylist(rows, schema)


def merged(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of rows, without overlaps, in order."""
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order], end[order]
    if not len(row):
        return row, begin, end
    head = np.ones(len(row), bool)
    head[1:] = row[1:] != row[:-1]
    # ends so far, within a row: rows are set apart by a shift
    shift = np.cumsum(head) * (np.int64(1) << 40)
    reach = np.maximum.accumulate(end + shift)
    new = head.copy()
    new[1:] |= begin[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], begin[first], (reach - shift)[last]


def _packed(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    return np.stack([row, begin, end], axis=1).astype("<i4").tobytes()


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text), packed: their ids, their sizes, and their bytes back to back."""

    def run(batches):
        task, count = TaskContext.get().partitionId(), 0
        ids, parts, size = [], [], 0

        def packed():
            data, sizes = b"".join(x.tobytes() for x, _ in parts), np.concatenate([n for _, n in parts])
            return _batch([{"block": (task << 32) + count, "ids": ids, "sizes": sizes.astype("<i4").tobytes(), "text": pa.compress(data, codec="zstd", asbytes=True), "raw": len(data)}], _BLOCK)

        for part, data, offs in slices(batches, "text", BLOCK_BYTES):
            ids += part.column("doc_id").to_pylist()
            parts.append((data, np.diff(offs)))
            size += len(data)
            if size >= BLOCK_BYTES:
                yield packed()
                ids, parts, size, count = [], [], 0, count + 1
        if ids:
            yield packed()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _BLOCK)


class Block:
    def __init__(self, row: dict) -> None:
        self.number, self.sizes = row["block"], np.frombuffer(row["sizes"], "<i4").astype(np.int64)
        self.data = np.frombuffer(pa.decompress(row["text"], row["raw"], codec="zstd", asbytes=True), np.uint8)
        self.offs = np.concatenate([[0], np.cumsum(self.sizes)])
        self.live = np.array([x is not None for x in row["ids"]], bool)
        self.docs = np.array([x if x is not None else 0 for x in row["ids"]], np.int64)

    def anchors(self, length: int, gram: int):
        """Runs of windows of rows that take part."""
        found = anchors(self.data, self.offs, length, gram)
        on = self.live[found[0]]
        return found if on.all() else tuple(x[on] for x in found)


def _rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def removals(held: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Blocks -> block, spans: packed (row, begin, end) of bytes to remove; blocks repeat."""
    total = held.agg(F.coalesce(F.sum("raw"), F.lit(0))).first()[0]
    buckets, spread = int(total // ANCHOR_BYTES + 1), int(total // CONTEXT_BYTES + 1)

    def deal(batches):
        for x in map(Block, _rows(batches)):
            row, _, _, _, h = x.anchors(length, gram)
            if not len(h):
                continue
            code, first, back = np.unique(codes(h, buckets), return_index=True, return_inverse=True)
            many = np.zeros(len(code), bool)
            many[back[row != row[first][back]]] = True
            where = (code >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]])).tolist()
            keys = code.astype("<u4")
            out = [{"bucket": int(where[a]), "block": x.number, "keys": keys[a:b].tobytes(), "many": np.packbits(many[a:b]).tobytes()} for a, b in zip(cut, cut[1:])]
            for at in range(0, len(out), 1024):
                yield _batch(out[at : at + 1024], _PIECE)

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        """Which anchors other rows have too."""
        size = pdf["keys"].str.len().to_numpy() // 4
        keys = np.frombuffer(b"".join(pdf["keys"]), "<u4")
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(pdf["many"], size.tolist())]).astype(bool)
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        group = np.empty(len(keys), np.int64)
        group[order] = np.cumsum(new) - 1
        often = np.bincount(group) > 1
        often[group[many]] = True
        hit, cut = often[group], np.concatenate([[0], np.cumsum(size)]).tolist()
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "bits": [np.packbits(hit[a:b]).tobytes() for a, b in zip(cut, cut[1:])]})

    pieces = held.select("block", "ids", "sizes", "text", "raw").mapInArrow(deal, _PIECE)
    replies = scratch.put(pieces.groupBy("bucket").applyInPandas(shared, _REPLY), "replies")
    scratch.sweep()
    replies = replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("replies"))

    def contexts(batches):
        """Contexts of shared anchors, and (negative buckets) the spans of copies within the block."""
        for r in _rows(batches):
            x = Block(r)
            row, first, n, place, h = x.anchors(length, gram)
            code, back = np.unique(codes(h, buckets), return_inverse=True)
            count = np.unique(code >> np.uint64(32), return_counts=True)[1]
            bits = [np.unpackbits(np.frombuffer(y["bits"], np.uint8), count=k) for y, k in zip(sorted(r["replies"], key=lambda y: y["bucket"]), count.tolist())]
            use = np.concatenate(bits).astype(bool)[back]
            row, first, n, place, h = row[use], first[use], n[use], place[use], h[use]
            if not len(h):
                continue
            # equal contexts of this block: only those of the smallest document are dealt out
            text = x.data.tobytes() + bytes(SHALLOW)
            _, same = deep_shallow(text, first, _numbered(h, n, place - first), n + length - 1)
            least = np.full(same.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, same, x.docs[row])
            later = x.docs[row] > least[same]
            if later.any():
                spans = merged(row[later], (first - x.offs[row])[later], (first + n + length - 1 - x.offs[row])[later])
                yield _batch([{"bucket": -1 - x.number % spread, "block": x.number, "rows": _packed(*spans)}], _CONTEXT)
            row, first, n, place, h = (y[~later] for y in (row, first, n, place, h))
            where = (codes(h, spread) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            row, first, n, place, where = (y[order] for y in (row, first, n, place, where))
            cut = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]])).tolist() if len(where) else []
            out = []
            for a, b in zip(cut, cut[1:]):
                used, mine = np.unique(row[a:b], return_inverse=True)
                out.append(
                    {
                        "bucket": int(where[a]),
                        "block": x.number,
                        "rows": used.astype("<i4").tobytes(),
                        "docs": x.docs[used].tobytes(),
                        "row": mine.astype("<i4").tobytes(),
                        "first": (first[a:b] - x.offs[row[a:b]]).astype("<i4").tobytes(),
                        "n": n[a:b].astype("u1").tobytes(),
                        "off": (place[a:b] - first[a:b]).astype("u1").tobytes(),
                        "bytes": pa.compress(x.data[ranges(first[a:b], n[a:b] + length - 1)].tobytes(), codec="zstd", asbytes=True),
                    }
                )
            for at in range(0, len(out), 64):
                yield _batch(out[at : at + 64], _CONTEXT)

    def repeats(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].iloc[0] < 0:
            return pd.DataFrame({"block": pdf["block"], "spans": pdf["rows"]})
        used = pdf["rows"].str.len().to_numpy() // 4
        size = pdf["row"].str.len().to_numpy() // 4
        place, doc = np.frombuffer(b"".join(pdf["rows"]), "<i4").astype(np.int64), np.frombuffer(b"".join(pdf["docs"]), np.int64)
        block = np.repeat(pdf["block"].to_numpy(), used)
        row = np.frombuffer(b"".join(pdf["row"]), "<i4").astype(np.int64) + np.repeat(np.cumsum(used) - used, size)
        first = np.frombuffer(b"".join(pdf["first"]), "<i4").astype(np.int64)
        n, off = (np.frombuffer(b"".join(pdf[c]), "u1").astype(np.int64) for c in ("n", "off"))
        size = n + length - 1
        text = b"".join(pa.decompress(b, sum(k) + len(k) * (length - 1), codec="zstd", asbytes=True) for b, k in zip(pdf["bytes"], pdf["n"])) + bytes(SHALLOW)
        start = np.cumsum(size) - size
        keys = gram_hashes(np.frombuffer(text, np.uint8), gram)[start + off]
        flags = repeated_windows(text, start, n, off, keys, doc[row], length)
        which, a, b = runs(flags, n, length)
        # rows are in order of their blocks
        row, begin, end = merged(row[which], first[which] + a, first[which] + b)
        cut = np.flatnonzero(np.concatenate([[True], block[row][1:] != block[row][:-1], [True]])).tolist() if len(row) else []
        return pd.DataFrame([{"block": int(block[row[i]]), "spans": _packed(place[row[i:j]], begin[i:j], end[i:j])} for i, j in zip(cut, cut[1:])], columns=["block", "spans"])

    return held.join(replies, "block").mapInArrow(contexts, _CONTEXT).groupBy("bucket").applyInPandas(repeats, _SPANS)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, begins, ends (of the bytes that go), kept (the other bytes)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    arrow_batches(spark, 500)
    held = scratch.put(blocks(docs), "blocks")
    arrow_batches(spark, 1)  # a block at a time
    spans = scratch.put(removals(held, scratch, length, gram).groupBy("block").agg(F.collect_list("spans").alias("spans")), "spans")
    scratch.sweep()

    def run(batches):
        for r in _rows(batches):
            x = Block(r)
            spans = np.frombuffer(b"".join(r["spans"] or ()), "<i4").reshape(-1, 3).astype(np.int64)
            row, begin, end = merged(*spans.T)
            cut = np.searchsorted(row, np.arange(len(x.docs) + 1))
            cover = np.zeros(len(x.data) + 1, np.int8)
            np.add.at(cover, begin + x.offs[row], 1)
            np.add.at(cover, end + x.offs[row], -1)
            stays = np.cumsum(cover[:-1], dtype=np.int8) == 0
            left = np.concatenate([[0], np.cumsum(stays)])[x.offs].astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), len(x.docs), [None, pa.py_buffer(left.tobytes()), pa.py_buffer(x.data[stays].tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["ids"], pa.int64()), pa.array(x.sizes), pa.ListArray.from_arrays(cut.astype(np.int32), begin), pa.ListArray.from_arrays(cut.astype(np.int32), end), kept],
                ["doc_id", "n_bytes", "begins", "ends", "kept"],
            )

    return held.join(spans, "block", "left").mapInArrow(run, _OUT)


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return dedup(docs, length).select("doc_id", "n_bytes", (total("ends") - total("begins")).alias("n_removed"), F.size("begins").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
