"""Brute-force versions, planted cases and edge cases of the training-data operators."""

import math
import os
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecforge.llm import decontaminate, hnsw, html, langid, linededup, mixing, pii, pseudo_lm, secrets

SF = "/root/testdata/sf0.01"


def test_html_attributes_and_names():
    page = lambda x: f"<html><body><nav><a href=/>Home</a></nav><article>{x}</article><footer>f</footer></body></html>"
    assert html.main_text(page('<p title="the hidden cost">Keep me</p><p hidden>Not</p><p aria-hidden=true>Nor</p><p style="x; display : none">No</p>')) == "Keep me"
    assert html.main_text(page('<h2 id="related-work">Related work</h2><p class="search">Search</p><section class="alerts-and-warnings"><p>Mind</p></section>')) == "Related work\nSearch\nMind"
    assert html.main_text(page('<p title="5" tall">a</p><p title="foo>b</p>')) == "a\nb"
    assert html.main_text(page("<p title='a>b'>c</p><div class=share><p>S</p></div>")) == "c"
    story = "A long story about many things that goes on and on. " * 4
    assert html.main_text(f"<body><article><p>Teaser</p></article><div class=story><p>{story}</p></div></body>") == f"Teaser\n{story.strip()}"
    assert html.main_text("<div><p>one</p><div><a href=x>a title that is a link</a></div><p>two</p></div>") == "one\na title that is a link\ntwo"
    assert html.main_text("<div><p>one</p><ul><li><a>x</a><li><a>y</a></ul></div>") == "one"
    t = time.time()
    assert html.main_text("<div>" * 20_000 + "x" + "</span>" * 20_000 + "</div>" * 20_000 + "<b>" * 20_000 + "<p>y" * 2000).startswith("x\ny")
    assert time.time() - t < 5


def brute_tree(pages):
    """Importance of each (host, path) by the definition, page by page."""
    per = defaultdict(dict)
    for site, page in pages:
        found, nodes = html.parsed(page)
        key = "\n".join(html._flat(b) for b in found if b.node.main) or "\n".join(map(html._flat, found))
        per[site].setdefault(key, []).append((found, nodes))
    out = {}
    for site, articles in per.items():
        where, texts, kids, below = defaultdict(set), defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set)), defaultdict(set)
        for key, copies in articles.items():
            for found, nodes in copies:
                for b in found:
                    p = b.node.path
                    where[p].add(key)
                    texts[p][html._flat(b)].add(key)
                    for a in b.node.line():
                        below[a].add(p)
                for n in nodes:
                    where[n.path].add(key)
                    kids[n.path][tuple(n.kids)].add(key)
        content = {}
        for p, features in texts.items():
            m = max(2, len(where[p]))
            n = [len(v) for v in features.values()]
            content[p] = (sum(n), 1 - sum(x * math.log(x) / math.log(m) for x in n) / sum(n))
        for a, leaves in below.items():
            m, k = len(where[a]), [(len(v), len(c)) for c, v in kids[a].items()]
            total = sum(n for n, _ in k)
            inner = sum(content[p][0] * content[p][1] for p in leaves) / sum(content[p][0] for p in leaves)
            pres = sum(-n / total * math.log(n / total) for n, _ in k) / math.log(max(2, m)) if total else 0
            share = html.DAMPING ** (sum(n * c for n, c in k) / total if total else 0)
            out[site, a] = (1 - share) * min(1, pres) + share * inner if m > 1 else 1.0
    return out


def test_style_tree_is_the_definition(spark):
    r = random.Random(3)
    def page(i):
        extra = "".join(f"<p>{r.random()}</p>" for _ in range(r.randint(1, 4)))
        club = "<p class=join-us>Join our club today</p>"
        return f"<html><body><div class=top><p>Our shop</p></div><article><h1>Story {i}</h1><p>Its own text number {i}</p>{extra}{club}</article><div class=b{r.randint(0, 2)}><p>{r.choice(['x', 'y'])}</p></div></body></html>"
    rows = [(i, f"http://{'ab'[i % 2]}.org/{i}", page(i)) for i in range(16)]
    rows += [(100, rows[0][1], rows[0][2]), (101, None, "<p>alone</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(x["host"], x["path"]): x["importance"] for x in html.style_tree(df).collect()}
    want = brute_tree([((u or "").split("/")[2] if u else "", h) for _, u, h in rows])
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    text = {x["page_id"]: x["text"] for x in html.extract(df.withColumn("low", F.lit(1)).withColumn("host", F.lit(2))).collect()}
    assert "Join our club" not in text[3] and text[3].startswith("Story 3\nIts own text number 3\n") and "Our shop" not in text[3]
    assert len(text) == 18 and text[101] == "alone" and "Join our club" in html.main_text(rows[3][2])


def test_mixing_against_plain_descent(spark):
    r = np.random.default_rng(4)
    p = r.dirichlet([2, 1, 0.5], 400)
    t = r.integers(1, 60, 400)
    goal, w = np.array(mixing.TARGETS), 1 / (np.array(mixing.TARGETS) + 0.1)
    flat = spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(t, p)], "n_tokens long, p0 double, p1 double, p2 double").repartition(3)
    moves, reached = mixing.fit(flat)
    rate = mixing.rates(p, moves)
    assert (rate >= 0).all() and np.allclose((t * rate) @ p / t.sum(), reached)
    x = np.ones(400)
    for _ in range(3000):
        x = np.maximum(0, x - 0.3 * p @ (w * ((t * x) @ p / t.sum() - goal)) / w.max())
    cost = lambda s: float((w * (s - goal) ** 2).sum())
    assert np.abs(reached - goal).max() <= mixing.TOLERANCE or cost(reached) <= 1.1 * cost((t * x) @ p / t.sum())


def test_posteriors_by_hand():
    model = mixing.Classifier.fit([(*mixing._features(x)[:2], y) for x, y in [("calm sea", 0), ("buy now", 1), ("vile rot", 2)] * 20])
    got, n = model.posterior("calm calm sea")
    z = model.w[mixing.DIM].astype(float).copy()
    at, v, _ = mixing._features("calm calm sea")
    for i, x in zip(at, v):
        z += x * model.w[i]
    assert n == 3 and np.allclose(got, np.exp(z) / np.exp(z).sum(), atol=1e-5) and got.argmax() == 0


def test_pseudo_likelihood_is_the_definition_and_ignores_layout(spark):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(1500)]
    rows = [(i, " ".join(r.choice(vocab[: 30 * (1 + i % 40)]) for _ in range(r.randint(0, 120)))) for i in range(200)] + [(500, None), (501, "w1"), (501, "w1"), (None, "w2 w3")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    a, b = ({x["doc_id"]: x for x in pseudo_lm.score(df.repartition(n)).collect()} for n in (1, 9))
    assert all(abs(a[k]["log_prob"] - b[k]["log_prob"]) < 1e-3 * (1 + abs(a[k]["log_prob"])) for k in a) and a[500]["per_token"] is None
    codes, share, total = pseudo_lm.vocabulary(df)
    assert total == sum(len((t or "").split()) for _, t in rows)
    words = Counter(w for _, t in rows for w in (t or "").split())
    for c in range(pseudo_lm.OPEN):  # the probabilities of a class's words sum to 1
        own = [w for w in words if w.encode() not in codes and __import__("zlib").crc32(w.encode()) % pseudo_lm.OPEN == c]
        if own:
            assert abs(sum(math.exp(share[__import__("zlib").crc32(w.encode()) % pseudo_lm.COUNTERS]) for w in own) - 1) < 1e-4
    net = pseudo_lm.Network(1)
    import pyarrow as pa

    texts = [rows[3][1], "", rows[7][1]]
    flat, starts = pseudo_lm._joined(pa.array([pseudo_lm.tokens(t, codes) for t in texts], pa.list_(pa.int32())))
    got = np.add.reduceat(net.positions(flat, share, net.tables()), starts)
    for t, s in zip(texts, got):
        tok = [1024, 1024, *pseudo_lm.tokens(t, codes), 1024, 1024]
        c = [int(x) for x in pseudo_lm.code_of(np.array(tok))]
        want = 0.0
        for i in range(2, len(c) - 2):
            h = np.tanh(sum(net.p["E"][c[i + d]] @ net.p["W"][j] for j, d in enumerate((-2, -1, 1, 2))) + net.p["b"])
            za, zb = h @ net.p["A"] + net.p["a"], h @ net.p["B"] + net.p["D"][c[i] // 32]
            want += math.log(np.exp(za)[c[i] // 32] / np.exp(za).sum()) + math.log(np.exp(zb)[c[i] % 32] / np.exp(zb).sum()) + (share[tok[i] - 1025] if tok[i] > 1024 else 0)
        assert abs(s - want) < 1e-3 * (1 + abs(want))


def test_language_positions_by_hand(spark):
    net = langid.BiGRU(["a", "b", "c"], hidden=4)
    x = np.frombuffer(b"hello", np.uint8)[:, None]
    got, p = net.positions(x)[:, :, 0], net.p
    sig = lambda v: 1 / (1 + np.exp(-v))
    hs = np.zeros((2, 5, 4))
    for d in range(2):
        h = np.zeros(4)
        for t in range(5) if d == 0 else range(4, -1, -1):
            g, u = p["E"][d][:, x[t, 0]], p["U"][d]
            z, r = sig(g[:4] + u[:4] @ h), sig(g[4:8] + u[4:8] @ h)
            cand = np.tanh(g[8:] + r * (u[8:] @ h + p["c"][d][:, 0]))
            h = (1 - z) * cand + z * h
            hs[d, t] = h
    y = np.stack([p["O"][0] @ hs[0, t] + p["O"][1] @ hs[1, t] + p["o"][:, 0] for t in range(5)], 1)
    assert np.allclose(got, np.exp(y) / np.exp(y).sum(axis=0), atol=1e-5)
    df = spark.createDataFrame([(1, "Some text", None, "x"), (2, None, None, "y"), (3, "12", None, "z")], "doc_id long, text string, lang string, Lang_Pred string")
    assert {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.predict(df, None).collect()} == {1: ("und", 0), 2: ("und", 0), 3: ("und", 0)}
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and [x["doc_id"] for x in kept.collect()] == [1]
    many = spark.createDataFrame([(i, "".join(chr(0x4E00 + 40 * (i % 70) + random.Random(i * 7 + j).randint(0, 39)) for j in range(30)), f"l{i % 70:02}") for i in range(700)], "doc_id long, text string, lang string")
    assert len(langid.train(many, steps=2).labels) == 70
    copies = many.limit(5).union(spark.createDataFrame([(9, "the same text again", "l00")], "doc_id long, text string, lang string").crossJoin(spark.range(3000)).drop("id"))
    assert len(langid.train(copies, steps=2).labels) == copies.select("lang").distinct().count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_planted_tokens_are_found(spark):
    r = random.Random(5)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    alphabet = {"base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "base36": "abcdefghijklmnopqrstuvwxyz0123456789", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"}
    planted = [(10_000_000 + i, "the " + "".join(r.choice(alphabet[k]) for _ in range(n)) + " of it") for i, (k, n) in enumerate([("base64", 24), ("base64", 32), ("base64", 40), ("base64", 28), ("base36", 40), ("base32", 40)])]
    got = {x["doc_id"]: x["spans"] for x in secrets.digest(secrets.scan(docs.union(spark.createDataFrame(planted, docs.schema))), secrets.KINDS, 3).collect()}
    assert sum("random:4:" in got[i] for i, _ in planted) >= 5
    assert sum("random" in s for i, s in got.items() if i < 10_000_000) <= 2


def test_battery_p_values_are_even_under_the_null():
    r = np.random.default_rng(1)
    text = " ".join("".join(r.choice(["the", "an", "re", "ti", "on", "es", "st"]) for _ in range(r.integers(2, 6))) for _ in range(3000))
    code = secrets._CODE[-1, np.frombuffer(text.encode(), np.uint8)].astype(int)
    both = (code[1:] >= 0) & (code[:-1] >= 0)
    law = secrets.Law(np.bincount((code[:-1] * 64 + code[1:])[both], minlength=4096), 3, 20)
    other = secrets.Law(np.bincount((code[:-1] * 64 + code[1:])[both], minlength=4096), 3, 20)
    assert (law.mean, law.scale) == (other.mean, other.scale)
    tokens = ["".join(r.choice(["the", "an", "re", "ti", "on", "es", "st"]) for _ in range(12))[:20] for _ in range(400)]
    p = [law.p(*secrets.battery(secrets._CODE[3, np.frombuffer(t.encode(), np.uint8)][None].astype(int), 36)[0]) for t in tokens]
    assert 0.2 < np.mean(np.array(p) < 0.5) < 0.8 and np.mean(np.array(p) < 0.01) < 0.04
    rand = ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz0123456789")) for _ in range(20)) for _ in range(100)]
    q = [law.p(*secrets.battery(secrets._CODE[3, np.frombuffer(t.encode(), np.uint8)][None].astype(int), 36)[0]) for t in rand]
    assert np.median(q) < 0.01


def test_terms_are_removed(spark):
    rows = [(i, f"page {i}: Quillfeather answers at quill@example.org, day {i}") for i in range(6)] + [(100 + i, f"nothing of note {i}") for i in range(300)]
    got = {x["doc_id"]: x for x in pii.report(spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("b", F.lit(2))).collect()}
    assert all(got[i]["sanitised"] == f"page {i}: [term] [term] at [email], day {i}" or "Quillfeather" not in got[i]["sanitised"] and "quill" not in got[i]["sanitised"] for i in range(6))
    assert all(got[i]["sanitised"] == t for i, t in rows[6:])


def test_hnsw_edges(spark):
    kind = "vec_id long, embedding array<float>, label int, shards int"
    assert hnsw.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, [1.0, 0.0], 1, 0), (1, [1.0, 0.0], 1, 0), (1, [1.0, 0.001], 1, 0), (2, [1.0, 0.0], 1, 0), (3, [0.0, 1.0], 1, 0), (4, [1.0, 0.0], 2, 0)]
    got = sorted(((x["vec_id"], x["n_links"], x["component_id"], x["kept"], x["audit_recall"]) for x in hnsw.near_duplicates(spark.createDataFrame(rows, kind)).collect()), key=str)
    assert got == sorted([(None, 0, None, True, 1.0), (1, 2, 1, True, 1.0), (1, 2, 1, True, 1.0), (2, 2, 1, False, 1.0), (3, 0, 3, True, 1.0), (4, 0, 4, True, 1.0)], key=str)


def test_hnsw_audit_sees_rare_links():
    import pandas as pd

    r = np.random.default_rng(8)
    x = r.normal(size=(3000, 16))
    x[2000:2020] = x[:20] + 0.01 * r.normal(size=(20, 16))
    out = hnsw.shard_links(pd.DataFrame({"vec_id": np.arange(3000), "embedding": list(x), "copies": 1}), None, 0.98)
    assert out["seen"].sum() == 40 and out["found"].sum() >= 40 * hnsw.RECALL and out["n_links"].sum() == 40


def test_line_edges(spark):
    long_ = " ".join(f"word{i}" for i in range(20_000))
    rows = [(1, f"{long_}\nshort one"), (2, long_.replace("word7 ", "x ")), (3, "first row of three\nonly here"), (3, "second row of three\nonly here too, not there"), (3, "first row of three\nonly here"), (4, "first row of three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_th", F.lit(1)).withColumn("line", F.lit("x"))
    got = [(x["doc_id"], x["n_removed"]) for x in linededup.dedup(df).collect()]
    assert sorted(got) == [(1, 0), (2, 1), (3, 0), (3, 0), (3, 0), (4, 1)]
    assert linededup.remove_lines(df).columns == df.columns


def test_line_leaders_are_for_large_groups(spark):
    r = np.random.default_rng(3)
    words = lambda k: [f"w{x}" for x in r.integers(0, 10**9, k)]
    base = words(30)
    one = [(i, " ".join(words(30))) for i in range(200)]
    few = one + [(200 + i, one[i][1] + " more") for i in range(5)]
    many = one + [(200 + i, " ".join([*base, f"x{i}"])) for i in range(60)]
    for rows, led in ((few, False), (many, True)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        assert bool(linededup._led(df, linededup._lines(df, linededup.rarity(df)))) == led
        want = [200 + i for i in range(5)] if rows is few else [200 + i for i in range(1, 60)]
        assert sorted(x["doc_id"] for x in linededup.repeated_lines(df).collect()) == want


def test_line_parities_bound_the_difference(spark):
    r = np.random.default_rng(4)
    rows = []
    for i in range(300):
        x = r.integers(-(2**62), 2**62, r.integers(4, 250))
        y = np.concatenate([x[: len(x) - len(x) // 10], r.integers(-(2**62), 2**62, len(x) // 10)])
        rows.append((i, x.tolist(), y.tolist(), r.integers(-(2**62), 2**62, len(x)).tolist()))
    df = spark.createDataFrame(rows, "i long, x array<long>, y array<long>, z array<long>")
    side = lambda c: F.struct(F.size(c).alias("n"), *[linededup._parity(F.col(c), bool(k)).alias(p) for k, p in enumerate(linededup._PARITY)]).alias(c)
    got = df.select(F.size("x").alias("n"), side("x"), side("y"), side("z")).select("n", F.expr(linededup._near("x", "y")).alias("near"), F.expr(linededup._near("x", "z")).alias("far")).collect()
    assert len(linededup._PARITY) == 2
    assert all(x["near"] for x in got) and sum(x["far"] for x in got) <= 3


def test_mixing_features_are_not_copied():
    import pyarrow as pa

    kind = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("at", pa.list_(pa.int32())), ("v", pa.list_(pa.float64()))])
    parts = [[[7, 2], [1, 0], [[4, 5], []], [[0.6, 0.8], []]], [[1, 9], [2, 1], [[3], [8, 9]], [[1.0], [0.8, 0.6]]]]
    rows = mixing._rows(pa.Table.from_batches([pa.record_batch(x, schema=kind) for x in parts]))
    assert [(a.tolist(), v.tolist(), k) for a, v, k in rows] == [([3], [1.0], 2), ([], [], 0), ([4, 5], [0.6, 0.8], 1), ([8, 9], [0.8, 0.6], 1)]
    assert not any(a.flags.owndata or v.flags.owndata for a, v, _ in rows)


def test_decontamination_edges(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(1, "a " * 50_000 + item + " b" * 50_000, "k"), (1, item, "k"), (2, "yes, so it is", "k"), (3, "yesterday", "k"), (4, None, "k"), (5, "", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_ids string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, "YES"), (9, item.upper()), (10, None), (None, item), (11, "")], "item_id long, text string")
    out = decontaminate.match(df, bench)
    assert sorted((x["doc_id"], x["item_ids"]) for x in out.collect()) == [(1, [7, 9]), (1, [7, 9]), (2, [8]), (3, []), (4, []), (5, [])]
    assert sorted(x["doc_id"] for x in decontaminate.clean(df.drop("item_ids").withColumn("_h1", F.lit(1)), bench).collect()) == [3, 4, 5]
    old = decontaminate.BLOCK_CHARS
    decontaminate.BLOCK_CHARS = 60
    try:
        assert sorted((x["doc_id"], x["item_ids"]) for x in decontaminate.match(df, bench).collect())[0] == (1, [7, 9])
    finally:
        decontaminate.BLOCK_CHARS = old


def test_lines_that_share_words_by_chance_have_no_leader(spark):
    """Ends are shared by near copies, not by lines that only have some words of a small vocabulary in common."""
    r = np.random.default_rng(6)
    chance = [" ".join(f"w{x}" for x in r.choice(300, 20, replace=False)) for _ in range(1500)]
    df = spark.createDataFrame([*enumerate(chance), *((2000 + i, f"{chance[0]} x{i}") for i in range(40))], "doc_id long, text string")
    lines = linededup._lines(df, linededup.rarity(df))
    shared = lambda rows: rows.select(F.explode("ends").alias("end")).groupBy("end").count().agg(F.sum(F.col("count") - 1)).first()[0]
    assert shared(lines.where("doc_id < 2000")) < 150 and shared(lines.where("doc_id >= 2000")) >= 40


def test_lines_of_any_id_and_size(spark):
    """Ids too far apart for a number of 64 bits, and sets to both sides of the size from which there is a second parity."""
    words = [f"w{i}" for i in range(70)]
    lines = [" ".join(words[:k]) for k in (60, 64, 65, 70)]
    rows = [(-(2**63), lines[1]), (-5, "a b\nb a"), (2**62, lines[2]), (2**63 - 1, "\n".join([lines[0], lines[3], "b  a", "A a b"]))]
    got = {x["doc_id"]: x["nos"] for x in linededup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {-5: [1], 2**62: [0], 2**63 - 1: [0, 1, 2, 3]}
