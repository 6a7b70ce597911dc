"""Classifiers, language model, neighbours, pages: small tables, against brute force."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgersift.llm import ann, common, hmm, langid, quality, wrapper

DOCS = "doc_id long, text string, lang string, source string, score double, held_out boolean"


def words(n, vocab, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(vocab, n))


EN = ["the", "of", "and", "that", "with", "this", "which", "have"]
DE = ["der", "die", "und", "nicht", "mit", "auch", "eine", "über"]


def corpus():
    rows = [(i, words(30, EN if i % 2 else DE, i), "en" if i % 2 else "de", "s", 1.0, i % 5 == 0) for i in range(120)]
    odd = [(200, None, "en", "s", None, True), (201, "", None, None, 1.0, False), (202, "123 ... 456", "de", "s", 1.0, True), (203, "x" * 70_000 + " the", "en", "s", 1.0, True), (1, rows[1][1], "en", "s", 1.0, False), (None, "the of and", None, None, None, None)]
    return rows + odd


def test_hashes_match_bytes():
    texts = [b"A bc\tA", b"", b"bc", "é x".encode()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    h, row = common.hash_words(data, offs, common.SPACED)
    assert row.tolist() == [0, 0, 0, 2, 3, 3]
    assert (h == common.text_hash([b"a", b"bc", b"a", b"bc", "é".encode(), b"x"])).all()


def test_components(spark):
    import random

    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 201 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = common.components(spark, common.Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()
    alone = {a for a, b in edges if a == b and find(a) == a and sum(a in e for e in edges) == 1}
    assert {r.id: r.root for r in got} == {x: find(x) for x in parent if x not in alone}


def test_no_scratch_folder_of_one_machine_on_a_cluster():
    from types import SimpleNamespace as Fake

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.Scratch(Fake(conf=Fake(get=lambda *_: None), sparkContext=Fake(master=master)))


def test_language_id(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    p = langid.Training(rows_per_language=40, segments=4000, steps=80)
    model = langid.fit(docs, ~F.col("held_out"), p)
    assert model[0] == ["de", "en"]
    got = langid.predict(docs, model, "held_out", "lang").collect()
    assert len(got) == len(corpus())
    clean = [r for r in got if r.doc_id is not None and r.doc_id < 120]
    assert np.mean([r.lang == r.lang_pred for r in clean]) > 0.97
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (200, 201, 202)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    none = langid.predict(docs, langid.fit(docs.where("false"), F.lit(True)), "lang").collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_network_gradients():
    """Backpropagation through time against finite differences."""
    rng = np.random.default_rng(0)
    m = {k: v.astype(np.float64) for k, v in langid.new_model(3, 4, 2, rng).items()}
    chars, length, target = rng.integers(97, 100, (4, 5)).astype(np.uint8), np.array([5, 3, 1, 4]), np.array([0, 1, 1, 0])
    _, grad = langid.gradients(m, chars, length, target, np.ones(4))
    for name in ("fU", "bW", "O", "bc"):
        at = tuple(rng.integers(0, s) for s in m[name].shape)
        eps, old, loss = 1e-3, m[name][at], []
        for d in (eps, -eps):
            m[name][at] = old + d
            loss.append(langid.gradients(m, chars, length, target, np.ones(4))[0])
        m[name][at] = old
        assert grad[name][at] == pytest.approx((loss[0] - loss[1]) / (2 * eps), abs=2e-4)


def test_segment_sums_are_those_of_the_network():
    """The fast path over segments of one length, against the plain network."""
    rng = np.random.default_rng(1)
    m = langid.new_model(5, 4, 3, rng)
    data = rng.integers(32, 127, 400).astype(np.uint8)
    begin, length, _ = langid.segments(data, np.array([0, 150, 150, 400]))
    p, mask = langid.forward(m, langid.padded(data, begin, length), length)
    assert langid.segment_sums(m, data, begin, length) == pytest.approx((p * mask[..., None]).sum(axis=1), abs=1e-4)


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(2)), np.sort(rng.choice(16, 4, replace=False)).astype("<i4"), rng.integers(1, 4, 4).astype("<i4")) for _ in range(30)]
    p = quality.Ftrl(bits=4, epochs=3, l1=0.01)
    w, bias = quality._ftrl(rows, p)
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= p.l1:
            return 0.0
        return -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    order = sorted(rows, key=lambda r: (r[1].tobytes(), r[2].tobytes(), r[0]))
    draw = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for k in draw.permutation(len(order)):
            y, slots, counts = order[k]
            norm = math.sqrt(sum(int(c) ** 2 for c in counts))
            x = {int(s): int(c) / norm for s, c in zip(slots, counts)} | {16: 1.0}
            error = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items()))) - y
            for i, v in x.items():
                g, old = error * v, weight(i)
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha * old
                n[i] += g * g
    assert w == pytest.approx([weight(i) for i in range(16)], abs=1e-5) and bias == pytest.approx(weight(16))


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(none, quality.fit(none, labels, F.lit(True))).count() == 0
    assert langid.predict(none, langid.fit(none, F.lit(True)), "held_out").count() == 0
    assert wrapper.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality(spark):
    rows = [(i, words(20, EN, i) if i % 3 else words(20, EN, i).upper() + "!!", "en", "s", 1.0, i % 5 == 0) for i in range(150)]
    docs = spark.createDataFrame(rows + corpus()[-6:], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)] + [(500, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, common.crc_mod(F.col("doc_id"), 5) != 0)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [i for i in range(150) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.3) == (i % 3 > 0) for i in held) and all(0 <= s <= 1 for s in got.values())
    assert got[200] == got[201]
    flat = quality.score(docs, quality.fit(docs, labels.where("false"), F.lit(True))).select("score").distinct().collect()
    assert [r.score for r in flat] == [0.5]


def test_hmm_against_counts(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    got = hmm.score(docs, hmm.Hmm(states=2, classes=64)).collect()
    assert len(got) == len(rows)
    low = lambda t: [w.lower() if w.isascii() else w for w in (t or "").encode().decode().split()] + [None]
    count = Counter(w for r in rows if not r[5] for w in low(r[1]))
    n, v = sum(count.values()), len(count)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        tokens = low(text[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens))
    clean = [r for r in got if r.held_out and r.doc_id < 120]
    assert sum(r.score for r in clean) > sum(r.base_score for r in clean)
    assert hmm.score(docs.where("false")).count() == 0


def test_hmm_score_against_all_paths(spark):
    """The score is the sum over all paths of states, each word emitted by its class."""
    rows = [(i, t, None, None, None, held) for i, (t, held) in enumerate([("the of", False), ("and THE the", False), ("of of that", False), ("the new of", True), ("", True), ("and", False)])]
    docs = spark.createDataFrame(rows, DOCS)
    p = hmm.Hmm(states=2, classes=8)
    got = {r.doc_id: r.score for r in hmm.score(docs, p).collect()}
    source = docs.select("doc_id", "text", "held_out")
    m = hmm.train(common.Scratch(spark).put(source.mapInArrow(hmm._encode(p.classes), hmm._BLOCK_DDL), "blocks"), p)

    def kinds(text):
        x = hmm.encode_block(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), np.ones(1), p.classes)
        return x["kinds"][x["codes"]].tolist()

    count, kind = Counter(), {}
    for _, t, _, _, _, held in rows:
        for w, k in zip([*t.lower().split(), None], kinds(t)):
            kind[w] = k
            count[w] += not held
    tokens, words = Counter(), Counter()
    for w, c in count.items():
        tokens[kind[w]] += c
        words[kind[w]] += c > 0
    for i, t, *_ in rows:
        seq = kinds(t)
        paths = sum(
            math.prod([m["start"][s[0]], *(m["move"][a, b] for a, b in zip(s, s[1:])), *(m["emit"][x, k] for x, k in zip(s, seq))]) for s in itertools.product(range(2), repeat=len(seq))
        )
        given = math.prod((count[w] + 1) / (tokens[kind[w]] + words[kind[w]] + 1) for w in [*t.lower().split(), None])
        assert got[i] == pytest.approx(math.log10(paths * given), abs=1e-9)


def test_hmm_learns_from_all_blocks(spark):
    """A first block of held-out rows only: the states are those of the training texts of all blocks."""
    rows = [(i, words(40, EN if i % 2 else DE, i), None, None, 1.0, i < 100 or i % 5 == 0) for i in range(400)]
    got = [r for r in hmm.score(spark.createDataFrame(rows, DOCS)).collect() if r.held_out]
    # a text's language is a state: a word is one of 8 in its language, and one of 16 in both
    assert sum(r.score for r in got) / sum(r.n_tokens for r in got) > -0.98


def test_forward_is_exact():
    """Scaled forward recursion against the sum over all paths; probabilities of all sequences sum to one."""
    import itertools

    rng = np.random.default_rng(1)
    m = hmm.maximise({"start": rng.random(2) * 9, "move": rng.random((2, 2)) * 9, "emit": rng.random((2, 3)) * 50}, hmm.Hmm())
    total = 0
    for seq in itertools.product(range(3), repeat=4):
        path = sum(m["start"][s[0]] * np.prod([m["emit"][s[t], seq[t]] for t in range(4)]) * np.prod([m["move"][s[t], s[t + 1]] for t in range(3)]) for s in itertools.product(range(2), repeat=4))
        _, scale = hmm.forward(m, hmm.Sequences(np.array(seq), np.array([4])))
        assert np.prod(scale.astype(float)) == pytest.approx(path, rel=1e-4)
        total += path
    assert total == pytest.approx(1)


def test_baum_welch_climbs():
    rng = np.random.default_rng(2)
    q = hmm.Sequences(rng.integers(0, 8, 400) // (1 + np.arange(400) // 200), np.full(20, 20))
    p = hmm.Hmm(states=3, classes=8)
    m = hmm.maximise({"start": rng.random(3), "move": rng.random((3, 3)), "emit": rng.random((3, 8)) * 30}, p)
    likely = []
    for _ in range(8):
        likely.append(np.log(hmm.forward(m, q)[1]).sum())
        m = hmm.maximise(hmm.expected(m, q), p)
    assert likely[-1] > likely[0]


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)).astype(float)
    x[300:420] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [0.0] * 8), (1100, [float("nan")] + [1.0] * 7), (1150, [None] + [1.0] * 7), (1200, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 600, 50):
        s = u @ u[q]
        want = [i for i in np.lexsort((np.arange(600), -np.round(s, 12))) if i != q][:5]
        assert len(got[q]) == 5
        hit += len({i for i, _ in got[q]} & set(want))
    assert hit >= 0.9 * 60 and set(got) == set(range(0, 600, 50))
    assert [i for i, _ in got[300]] == [5, 301, 302, 303, 304]
    assert ann.search(df.where("false")).count() == 0
    few = ann.search(df.where("vec_id < 3")).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]


def test_nearest_ties_of_different_vectors(spark):
    """More different vectors tie than a block's list holds: the smallest ids win."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=8)
    scale = rng.permutation(40)
    rows = [(i, (v * 2.0 ** int(scale[i])).tolist()) for i in range(40)] + [(i, rng.normal(size=8).tolist()) for i in range(40, 60)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5]


def test_nearest_of_huge_and_tiny_vectors(spark):
    """Squares of finite components may overflow or vanish: the cosine doesn't."""
    rows = [(0, [1e200, 1e200, 1.0]), (1, [1e200, 1e200, 2.0]), (2, [1e-200, 1e-200, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [-1e300, -1e300, 0.0]), (5, [float("inf"), 0.0, 0.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 2), (0, 3), (0, 4)]
    assert [r.score for r in got] == pytest.approx([1, 1, math.sqrt(0.5), -1])


PAGE = '<html><head><title>t</title></head><body><nav><a href=/>m{0}</a></nav><div class="ad">buy {0}</div><div id=main><div class=post><h1>Title {0}</h1><p>Body &amp; text {0} of some length here, more<br>words<p>second {0} which goes on for a while, as paragraphs of articles do, with {0} in it<div class=share>Share</div><p>{1}</div><div class="comments"><p>nice {0} comment that goes on</div></div><footer>f {0}</footer><scr'


def test_pages(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i, "Read our newsletter every week")) for i in range(9)] + [(20, None, None), (21, "x", ""), (22, "http://lone/", "<article><p>a&lt;b</article>"), (23, "http://deep/", "<div>" * 3000 + "end")]
    got = {r.page_id: r for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(9):
        assert got[i].text == f"Title {i}\nBody & text {i} of some length here, more words\nsecond {i} which goes on for a while, as paragraphs of articles do, with {i} in it"
        assert got[i].n_chars == len(got[i].text)
    assert [got[i].text for i in (20, 21, 22, 23)] == ["", "", "a<b", "end"]


def test_template_is_learnt_from_all_pages(spark):
    """Second layouts, large pages, pages without the node, small hosts and short articles: boilerplate goes, text stays."""
    own = lambda k, n=1: [f"own sentence {k} {j} of the page" for j in range(n)]
    show = lambda kind, texts, more: f"<body><div class={kind}>" + "".join(f"<p>{t}" for t in texts) + f"<p>{more}</div>"
    long = "boilerplate that is longer than any article of this host " * 9
    rows, want = [], {}
    for k in range(40):
        texts = own(k, 2000 if k < 12 else 1)
        rows.append((k, "http://a/", show("one" if k % 4 else "two", texts, ("" if k == 7 else long) if k % 4 else "second layout, same line")))
        want[k] = texts
    rows += [(100 + k, "http://small/", show("x", own(k), "the line of the host")) for k in range(3)] + [(110, "http://small/", show("x", own(9), "another line"))]
    want |= {100 + k: own(k) for k in range(3)} | {110: [*own(9), "another line"]}
    copies = [(200 + k, "http://copies/", show("x", own(k // 5), "same")) for k in range(10)]
    want |= {200 + k: [*own(k // 5), "same"] for k in range(10)}
    got = wrapper.main_text(spark.createDataFrame(rows + copies, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text.split("\n") for r in got} == want


def test_article_in_sibling_containers(spark):
    """No part of an article is dropped for being the smaller one."""
    part = lambda k, n, name: f"<div class={name}>" + "".join(f"<p>{name} {k} {j} says something" for j in range(n)) + "</div>"
    rows = [(k, f"http://h{k % 2}/", "<body>" + (part(k, 65, "body") + part(k, 35, "more") if k % 2 else part(k, 15, "lead") + part(k, 85, "body"))) for k in range(10)] + [(20, "http://lone/", "<body>" + part(0, 65, "body") + part(0, 35, "more"))]
    got = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: len(r.text.split("\n")) for r in got} == {r[0]: 100 for r in rows}


def test_tree_matching():
    leaf = lambda t: [t, t, 1, []]
    a = ["r", "", 0, [leaf("a"), leaf("b"), leaf("c")]]
    b = ["r", "", 0, [leaf("b"), leaf("x"), leaf("c")]]
    assert wrapper.match(a, b)[0] == 3 and wrapper.match(a, leaf("a"))[0] == 0
