"""Near-duplicate operators against all pairs, HTML extraction, and the pipeline."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecforge.llm import hnsw, html, minhash
from vecforge.llm.common import components


def grouped(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 560)]
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = grouped(600, edges)
    assert got == {i: want[i] for i in got} and {i for a, b in edges if a != b for i in (a, b)} == set(got)


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("k", [2, 5])
def test_minhash_is_whole(spark, k):
    r = random.Random(k)
    vocab = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.randint(1, 90))] for _ in range(25)]
    texts = []
    for _ in range(220):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 5, 12])):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(r.choice([" ", "\t", "  "]).join(w).replace("w1", "W1"))
    texts += [None, "", " \n", "One", "one", "a b", "A B", "long " * 30_000]
    sets = [shingle_set(t, k) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = grouped(len(texts), links)
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string").withColumn("bands", F.lit("clash")).withColumn("rep", F.lit(1))
    got = minhash.near_duplicates(df, k).collect()
    assert len(got) == len(texts) + 1
    for x in got:
        i = x["doc_id"]
        if i is None:
            assert x["component_id"] is None and x["kept"]
        else:
            assert (x["n_shingles"], x["component_id"], x["kept"]) == (len(sets[i]), want[i], want[i] == i), texts[i]
    assert minhash.near_duplicates(df.limit(0), k).count() == 0
    if k == 5:
        assert sorted(x["doc_id"] for x in minhash.keep_one(df.where("doc_id is not null")).collect()) == sorted(set(want))


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], r.integers(0, 2**63, 200, dtype=np.uint64)])
    s = minhash.sketch([a, b, a[:3]], 512)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.08 and (s != 0).all()


def cosines(rows):
    ok = [i for i, (_, e, lab) in enumerate(rows) if e and lab is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    return [(i, j) for i in ok for j in ok if j < i and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and np.dot(rows[i][1], rows[j][1]) / (np.linalg.norm(rows[i][1]) * np.linalg.norm(rows[j][1])) >= 0.98]


@pytest.mark.parametrize("shard_rows", [8192, 60])
def test_hnsw_links(spark, shard_rows):
    r = np.random.default_rng(3)
    rows = []
    for i in range(400):
        x = r.normal(size=8) if i % 4 == 0 or not rows else np.asarray(rows[r.integers(len(rows))][1]) + r.normal(size=8) * 0.1
        rows.append((i, [float(np.float32(v)) for v in x], int(r.integers(0, 2))))
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [1.0] * 7 + [None], 1), (403, [float("nan")] * 8, 1), (404, rows[0][1], None), (405, rows[1][1], rows[1][2]), (406, [2 * v for v in rows[1][1]], rows[1][2]), (407, [], 0)]
    links = cosines(rows)
    want = grouped(len(rows), links)
    n = np.bincount([i for p in links for i in p], minlength=len(rows))
    got = {x["vec_id"]: x for x in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("copies", F.lit(1)), shard_rows=shard_rows).collect()}
    assert len(got) == len(rows)
    wrong = [i for i in got if (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) != (n[i], want[i], want[i] == i)]
    assert len(wrong) <= 0.02 * len(rows), wrong
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (400, 401, 402, 403, 404, 407))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav><div class="cookie-notice">We use <b>cookies</b></div>
{main}<aside>Also</aside><form><p>Name <input></form><section id="comments"><p>First!</p></section><footer>&copy; x</footer></body></html>"""
ARTICLE = "<h1>A &amp; B</h1><p>One\n two<br>three <i>four</i>&nbsp;five<p>Next &lt;b&gt;<ul><li>x<li>y</ul><!-- no --><script>z</script><div class='ad'>Buy</div><div class=share>Share</div><p>Last"
WANT = "A & B\nOne two three four five\nNext <b>\nx\ny\nLast"


def test_html():
    assert html.main_text(PAGE.replace("{main}", f"<article>{ARTICLE}</article>")) == WANT
    assert html.main_text(PAGE.replace("{main}", f"<div class=post>{ARTICLE}</div>")) == WANT
    cut = PAGE.replace("{main}", f"<article>{ARTICLE}")
    assert html.main_text(cut[: cut.index("Last") + 4]) == WANT
    assert html.main_text("") == html.main_text(None) == html.main_text("<p>") == ""
    assert html.main_text("plain < text &am") == "plain < text &am"
    assert html.main_text("<article>" + "<div>" * 3000 + "deep") == "deep"


def test_style_tree_removes_repeated_branches(spark):
    page = lambda i: f"<html><body><div class=top><p>Our shop sells all</p></div><div class=b><p>Story {i} of its own</p><p>More {i * 7}</p></div><div class=top><p>Call us today</p></div></body></html>"
    rows = [(i, "http://a.org/x", page(i)) for i in range(8)] + [(100, "http://b.org/", page(1)), (101, None, None), (102, "http://c.org", "")]
    got = {x["page_id"]: x["text"] for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and got[3] == "Story 3 of its own\nMore 21"
    assert got[100].startswith("Our shop") and got[101] == got[102] == ""
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    word = lambda: "".join(r.choice(["the", "an", "er", "on", "in", "re"]) for _ in range(r.randint(1, 3)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    item = sentence(30)
    rows = [(i, "\n".join(sentence(25) for _ in range(3)), "en", "s", 0) for i in range(60)]
    copy = rows[0][1]
    rows += [(100, copy, "en", "s", 0), (101, f"{sentence(30)} {item} {sentence(20)}", "en", "s", 0), (102, "123 456", "en", "s", 0), (103, None, None, None, None), (104, rows[1][1] + "\n" + sentence(30), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 9 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(60)) <= set(out) and not {100, 101, 102, 103} & set(out)
    assert out[104]["text"].count("\n") == 0 and out[104]["n_chars"] == len(out[104]["text"])
    assert all(x["rate"] >= 0 for x in out.values())


def test_beam_measures_only_new_points(monkeypatch):
    """Points met before and unused places are not measured again; what is found stays that of a full scan."""
    x = np.random.default_rng(4).normal(size=(600, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g, measured, einsum = hnsw.Graph(x), [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, *b, **k: (measured.append(int(np.prod(a.shape[:-1]))), einsum(how, a, *b, **k))[1])
    ids, sims = g.search(x[:100], 48)
    assert sum(measured) <= 100 * (len(x) + 4 * len(g.layers) * 48)
    assert (ids[:, 0] == np.arange(100)).mean() >= 0.99 and (np.diff(sims, axis=1) <= 0).all()
