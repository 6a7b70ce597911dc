"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a segment (a run of up to 32 bytes without white space) in both
directions and labels every byte with a distribution over the languages; a text's
distribution is the mean of those of all its bytes. States start anew with each
segment, so a segment's labels depend on its bytes alone: a worker computes each
distinct segment once and keeps the sums in a table of bounded size.

Training is by backpropagation through time in numpy, on at most ``rows_per_language``
texts of each language. Prediction is one pass over all whole texts, without shuffle.

Null texts, and texts without a letter, are ``und`` with score 0. Rows whose language is
null are never learnt from. Without any training row every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import SPACED, arrow_batches, hash_runs, quoted, slices, word_spans

SEGMENT = 32
#: Distinct segments that a worker keeps; then it begins anew.
KEEP = 1_000_000


@dataclass(frozen=True)
class Training:
    rows_per_language: int = 300
    segments: int = 24_000
    hidden: int = 8
    embed: int = 8
    steps: int = 350
    batch: int = 192
    rate: float = 0.01
    seed: int = 5


def segments(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and row of each segment."""
    begin, end, row, _ = word_spans(data, offs, SPACED)
    length = end - begin
    if len(length) and length.max() > SEGMENT:
        parts = -(-length // SEGMENT)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, end, row = np.repeat(begin, parts) + nth * SEGMENT, np.repeat(end, parts), np.repeat(row, parts)
        length = np.minimum(end - begin, SEGMENT)
    return begin, length, row


def gather(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of the runs, back to back."""
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return data[np.repeat(begin, length) + place]


def padded(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A row of bytes for each run, with 0 after its end."""
    out = np.zeros((len(begin), int(length.max()) if len(length) else 0), np.uint8)
    out[np.arange(out.shape[1]) < length[:, None]] = gather(data, begin, length)
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def new_model(hidden: int, embed: int, languages: int, rng) -> dict[str, np.ndarray]:
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    model = {"E": rng.normal(0, 0.5, (256, embed)).astype(np.float32), "O": draw(2 * hidden, languages), "o": np.zeros(languages, np.float32)}
    for d in "fb":
        model |= {f"{d}W": draw(embed, 3 * hidden), f"{d}U": draw(hidden, 3 * hidden), f"{d}c": np.zeros(3 * hidden, np.float32)}
    return model


def _direction(m, d, inputs, mask, order, keep):
    """States at all steps. ``keep``: what backpropagation needs."""
    n, steps = mask.shape
    hid = m[f"{d}U"].shape[0]
    u = m[f"{d}U"]
    h = np.zeros((n, hid), np.float32)
    out = np.zeros((steps, n, hid), np.float32)
    for t in order:
        x = inputs[:, t]
        g = _sigmoid(x[:, : 2 * hid] + h @ u[:, : 2 * hid])
        z, r = g[:, :hid], g[:, hid:]
        c = np.tanh(x[:, 2 * hid :] + (r * h) @ u[:, 2 * hid :])
        new = h + mask[:, t, None] * z * (c - h)
        if keep is not None:
            keep.append((t, h, z, r, c))
        h = out[t] = new
    return out


def forward(m, chars, length, keep=None):
    """Distribution over languages at each byte: (segments, bytes, languages)."""
    mask = (np.arange(chars.shape[1]) < length[:, None]).astype(np.float32)
    steps = range(chars.shape[1])
    kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
    states = []
    for d, order in (("f", steps), ("b", reversed(steps))):
        table = m["E"] @ m[f"{d}W"] + m[f"{d}c"]  # a byte's input to the gates
        states.append(_direction(m, d, table[chars], mask, order, kept[d]))
    both = np.concatenate(states, axis=2).transpose(1, 0, 2)
    logits = both @ m["O"] + m["o"]
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    if keep is not None:
        keep |= {"mask": mask, "both": both, "kept": kept}
    return p, mask


def gradients(m, chars, length, target, weight):
    """Backpropagation through time. Loss: mean cross-entropy over all bytes."""
    keep: dict = {}
    p, mask = forward(m, chars, length, keep)
    share = (mask * weight[:, None] / (mask * weight[:, None]).sum()).astype(np.float32)
    loss = -(np.log(np.maximum(np.take_along_axis(p, target[:, None, None], 2)[..., 0], 1e-9)) * share).sum()
    d = p.copy()
    d[np.arange(len(d)), :, target] -= 1
    d *= share[..., None]
    hid = m["fU"].shape[0]
    grad = {"O": np.einsum("nth,ntl->hl", keep["both"], d), "o": d.sum((0, 1)), "E": np.zeros_like(m["E"])}
    dstate = d @ m["O"].T
    for k, name in enumerate("fb"):
        u, w = m[f"{name}U"], m[f"{name}W"]
        du, dgate = np.zeros_like(u), np.zeros((*chars.shape, 3 * hid), np.float32)
        dh = np.zeros((len(chars), hid), np.float32)
        for t, h, z, r, c in reversed(keep["kept"][name]):
            dh = dh + dstate[:, t, k * hid : (k + 1) * hid]
            on = mask[:, t, None]
            dz, dc = dh * on * (c - h) * z * (1 - z), dh * on * z * (1 - c * c)
            drh = dc @ u[:, 2 * hid :].T
            dr = drh * h * r * (1 - r)
            du[:, :hid] += h.T @ dz
            du[:, hid : 2 * hid] += h.T @ dr
            du[:, 2 * hid :] += (r * h).T @ dc
            dgate[:, t] = np.concatenate([dz, dr, dc], axis=1)
            dh = dh * (1 - on * z) + drh * r + dz @ u[:, :hid].T + dr @ u[:, hid : 2 * hid].T
        flat = np.zeros((256, 3 * hid), np.float32)
        np.add.at(flat, chars.ravel(), dgate.reshape(-1, 3 * hid))
        grad |= {f"{name}U": du, f"{name}W": m["E"].T @ flat, f"{name}c": flat.sum(0)}
        grad["E"] += flat @ w.T
    return float(loss), grad


def train(texts: list[tuple[bytes, str]], p: Training = Training()) -> tuple[list[str], dict]:
    """Languages and model, of (text, language) rows."""
    languages = sorted({lang for _, lang in texts})
    rng = np.random.default_rng(p.seed)
    if not languages:
        return [], {}
    data = np.frombuffer(b"".join(t for t, _ in texts), np.uint8)
    offs = np.cumsum([0, *(len(t) for t, _ in texts)])
    begin, length, row = segments(data, offs)
    target = np.array([languages.index(lang) for _, lang in texts])[row] if len(row) else np.zeros(0, np.int64)
    m = new_model(p.hidden, p.embed, len(languages), rng)
    if not len(begin):
        return languages, m
    # each language has as many draws, whatever its share of the rows
    pick = [rng.choice(np.flatnonzero(target == k), p.segments // len(languages)) for k in range(len(languages)) if (target == k).any()]
    pick = np.concatenate(pick)
    mean, var = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    for step in range(1, p.steps + 1):
        rows = pick[rng.integers(0, len(pick), p.batch)]
        chars = padded(data, begin[rows], length[rows])
        _, grad = gradients(m, chars, length[rows], target[rows], np.ones(len(rows), np.float32))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = p.rate * min(1.0, 4 * (1 - step / (p.steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 5 / max(norm, 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * g
            var[k] = 0.999 * var[k] + 0.001 * g * g
            m[k] = (m[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return languages, m


def _steps(table, u, chars):
    """The states of one direction over segments of one length: (bytes, segments, hidden)."""
    n, steps = chars.shape
    hid = u.shape[0]
    gates, cand = np.ascontiguousarray(u[:, : 2 * hid]) * np.float32(0.5), np.ascontiguousarray(u[:, 2 * hid :])
    near = np.concatenate([table[:, : 2 * hid] * np.float32(0.5), table[:, 2 * hid :]], axis=1)
    out = np.zeros((steps + 1, n, hid), np.float32)
    for t in range(steps):
        h, x = out[t], near[chars[:, t]]
        g = h @ gates
        g += x[:, : 2 * hid]
        np.tanh(g, out=g)  # a sigmoid is a tanh of half its argument
        g += 1
        g *= np.float32(0.5)
        c = (g[:, hid:] * h) @ cand
        c += x[:, 2 * hid :]
        np.tanh(c, out=c)
        c -= h
        c *= g[:, :hid]
        np.add(h, c, out=out[t + 1])
    return out[1:]


def segment_sums(m, data, begin, length) -> np.ndarray:
    """Sum of the distributions over each segment's bytes; segments of one length go together."""
    out = np.zeros((len(begin), len(m["o"])), np.float32)
    hid = m["fU"].shape[0]
    tables = [m["E"] @ m[f"{d}W"] + m[f"{d}c"] for d in "fb"]
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for group in np.split(order, cuts):
        for at in range(0, len(group), 2048):
            rows = group[at : at + 2048]
            if not len(rows):
                continue
            size = int(length[rows[0]])
            chars = data[begin[rows][:, None] + np.arange(size)]
            logits = _steps(tables[0], m["fU"], chars).reshape(-1, hid) @ m["O"][:hid]
            logits = logits.reshape(size, len(rows), -1)
            logits += (_steps(tables[1], m["bU"], chars[:, ::-1])[::-1].reshape(-1, hid) @ m["O"][hid:]).reshape(logits.shape)
            logits += m["o"]
            logits -= logits.max(axis=2, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(axis=2, keepdims=True)
            out[rows] = logits.sum(0)
    return out


def fit(docs: DataFrame, use: Column, p: Training = Training()) -> tuple[list[str], dict]:
    """Train on at most ``rows_per_language`` rows of each non-null language for which ``use`` holds."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(use)
    counts = rows.groupBy("lang").count()
    # an expected number of rows for each language, chosen by a seeded hash of the id
    chance = counts.select("lang", (F.lit(float(p.rows_per_language << 24)) / F.col("count")).alias("below"))
    picked = rows.join(chance, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(p.seed)), F.lit(1 << 24)) < F.col("below"))
    got = picked.select("doc_id", "lang", "text").collect()
    return train([(r.text.encode(), r.lang) for r in sorted(got, key=lambda r: (r.doc_id, r.text))], p)


_cache: dict = {}


def _known(model_id: str, m, data, begin, length, hashes) -> np.ndarray:
    """Sums for segments by hash; new ones are computed, and kept."""
    if model_id not in _cache:
        _cache.clear()
        _cache[model_id] = (np.zeros(0, np.uint64), np.zeros((0, len(m["o"])), np.float32))
    keys, sums = _cache[model_id]
    at = np.searchsorted(keys, hashes)
    hit = at < len(keys)
    hit[hit] = keys[at[hit]] == hashes[hit]
    new = np.flatnonzero(~hit)
    got = np.empty((len(hashes), len(m["o"])), np.float32)
    got[hit] = sums[at[hit]]
    if len(new):
        got[new] = segment_sums(m, data, begin[new], length[new])
        if len(keys) + len(new) > KEEP:
            keys, sums = keys[:0], sums[:0]
            at = np.zeros(len(at), np.int64)
        _cache[model_id] = (np.insert(keys, at[new], hashes[new]), np.insert(sums, at[new], got[new], axis=0))
    return got


def _has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which texts have a letter."""
    low = data | 32
    total = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122) & (data < 128))])
    found = total[offs[1:]] > total[offs[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(ch.isalpha() for ch in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def predict(docs: DataFrame, model: tuple[list[str], dict], *keep: str) -> DataFrame:
    """docs (doc_id, text, and the columns ``keep``) -> doc_id, keep..., lang_pred, score."""
    return predict_with(docs, model, [*keep, "text"]).drop("text")


def predict_with(docs: DataFrame, model: tuple[list[str], dict], keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs (doc_id, and the columns ``keep``, among them text) -> and two more columns, called ``names``, at the end."""
    spark = docs.sparkSession
    arrow_batches(spark)
    languages, m = model
    held = spark.sparkContext.broadcast(m)
    labels = np.array([*languages, "und"])
    model_id = str(hash(tuple(float(v.sum()) for v in m.values())))
    columns = ["doc_id", *keep]
    text = f"c{columns.index('text')}"

    def run(batches):
        m = held.value
        for part, data, offs in slices(batches, text):
            n = part.num_rows
            best, score = np.full(n, len(labels) - 1), np.zeros(n)
            begin, length, row = segments(data, offs)
            if len(begin) and len(labels) > 1:
                hashes, first, back = np.unique(hash_runs(gather(data, begin, length), length), return_index=True, return_inverse=True)
                sums = _known(model_id, m, data, begin[first], length[first], hashes)[back]
                pooled = np.stack([np.bincount(row, sums[:, k], n) for k in range(sums.shape[1])], axis=1)
                pooled /= np.maximum(pooled.sum(1, keepdims=True), 1e-12)
                found = _has_letter(data, offs) & (pooled.sum(1) > 0)
                best[found] = pooled.argmax(1)[found]
                score[found] = np.clip(pooled.max(1)[found], 0, 1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(labels[best]), pa.array(score)], [*part.schema.names, "lang", "score"])

    # by place inside: any names will do
    rows = docs.select(*[F.col(quoted(c)) for c in columns]).toDF(*[f"c{k}" for k in range(len(columns))])
    schema = StructType([*rows.schema.fields, StructField("lang", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema).toDF(*columns, *names)
