"""Fixed patterns against plain regular expressions, and edge cases of every text operator."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from vecforge.llm import decontaminate, langid, linededup, mixing, pii, pseudo_lm, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, None, "en", "a", 0), (2, "", None, "a", 0), (3, "  \n\t ", "en", None, 4), (4, "x" * 50_000, "en", "a", 1), (5, "12 34 !!", "en", "a", 8), (6, "The cat sat on the mat today.", "en", "a", 29), (6, "The cat sat on the mat today.", "en", "a", 29), (None, "The dog sat on the mat today.", "en", "a", 29), (7, "é" * 40 + "퟿😀 token= abcdef123", "fr", "b", 60)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


def noise(n, seed):
    r = random.Random(seed)
    pieces = ["token: ", "password=", "API_KEY = '", "apikey:\"", "AKIA", "ABCDEFGH01234567", "deadbeef0123456789abcdef", "a@b.co", "x.y+z@mail.example.org", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "+4930 123456789", " ", "\n", "é", "😀", "word ", "..", "-", "secret", "0000000000000", "@", "12 "]
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, 25))) for _ in range(n)]


def luhn(d):
    return sum((x * 2 - 9 if x * 2 > 9 else x * 2) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def spans_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def spans_secrets(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.A | re.I) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


@pytest.mark.parametrize(("scan", "brute", "kinds", "base"), [(pii.scan, spans_pii, pii.KINDS, 4), (secrets.scan, spans_secrets, secrets.KINDS, 3)])
def test_base_spans(spark, scan, brute, kinds, base):
    texts = [*noise(400, 1), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.digest(scan(df), kinds, base).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t or "")
        joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in want)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (t, joined)
        for k in range(base):
            assert got[i][f"n_{kinds[k]}"] == sum(x[1] == k for x in want)
        assert set(joined.split(",")) - {""} <= set(got[i]["spans"].split(","))


def test_random_tokens_are_found_and_words_are_not(spark):
    r = random.Random(3)
    token = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    words = ["incomprehensibilities", "internationalization", "counterrevolutionary", "uncharacteristically", "electroencephalograph"]
    texts = [" ".join(r.choice(words) for _ in range(60)) for _ in range(20)] + [f"see {token} here"]
    got = secrets.digest(secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), secrets.KINDS, 3).collect()
    spans = {x["doc_id"]: x["spans"] for x in got}
    assert spans.pop(20) == "random:4:44"
    assert set(spans.values()) == {""}


def test_every_long_token_is_tested(spark):
    r = random.Random(12)
    value = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    lower = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40))
    words = ["incomprehensibilities", "internationalization", "counterrevolutionary", "uncharacteristically", "electroencephalograph"]
    texts = [" ".join(r.choice(words) for _ in range(60)) for _ in range(60)] + [f"set AUTH={value}== now", f"see {lower} here"]
    got = secrets.digest(secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), secrets.KINDS, 3).collect()
    spans = {x["doc_id"]: x["spans"] for x in got}
    assert spans.pop(60) == "random:9:51" and spans.pop(61) == "random:4:44"
    assert set(spans.values()) == {""}


def test_disclosing_terms(spark):
    rows = [(i, f"note {i} about {w} kind Zubrowski writes from zub@example.org about {w} things") for i, w in enumerate("alpha bravo carol delta echos foxes golfs hotel".split())]
    rows += [(100 + i, "nothing about anyone here at all kind things note writes from") for i in range(200)]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    t = rows[0][1]
    at = t.index("Zubrowski")
    assert f"term:{at}:{at + 9}" in got[0].split(",") and "email" in got[0]
    assert all(v == "" for k, v in got.items() if k >= 100)
    df = spark.createDataFrame([(1, "call a@b.co now")], "doc_id long, text string")
    red = pii.scan(df).join(df, "doc_id").select(pii.redact(F.col("text"), F.col("spans")).alias("t")).first()[0]
    assert red == "call [email] now"


def test_disclosing_terms_count_different_texts(spark):
    copied = [(10 * i + j, f"page {i} Quillfeather answers at quill@example.org") for i in range(5) for j in range(3)]
    far = [(100 + i, f"page {i} {'so it is ' * 20} Marblestone {'so it is ' * 20} mail to marble@example.net") for i in range(5)]
    rows = [*copied, *far, *((200 + i, f"nothing of note {i}") for i in range(300))]
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows[:20]:
        for w in ("Quillfeather", "Marblestone"):
            assert (f"term:{t.find(w)}:{t.find(w) + len(w)}" in got[i]) == (w in t), (i, w)
    assert all(got[i] == [""] for i, _ in rows[20:])


def test_edges(spark, edge):
    for out in (secrets.scan(edge), pii.scan(edge), pseudo_lm.score(edge), langid.identify(edge)):
        assert out.count() == len(EDGE)
    empty = edge.limit(0)
    for out in (secrets.scan(empty), pii.scan(empty), pseudo_lm.score(empty), langid.identify(empty), linededup.dedup(empty), decontaminate.match(empty, empty.select(F.col("doc_id").alias("item_id"), "text")), mixing.mix(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))):
        assert out.count() == 0


def edits(a, b):
    """Least edits between a and any substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_is_exact(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    items = [" ".join(word() for _ in range(n)) for n in (12, 20, 25, 60)]
    docs = []
    for k in range(120):
        body = [word() for _ in range(r.randint(0, 40))]
        if k % 2:
            it = list(r.choice(items))
            for _ in range(r.randint(0, 14)):
                it[r.randrange(len(it))] = r.choice(["x", "", "yy", "A"])
            body.insert(r.randint(0, len(body)), "".join(it))
        docs.append((k, " ".join(body)))
    docs += [(1000, None), (1001, "")]
    got = {x["doc_id"]: x["item_ids"] for x in decontaminate.match(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")).collect()}
    segs = decontaminate.segments(list(enumerate(items)))
    for i, t in docs:
        n = decontaminate.normal(t)
        want = sorted({item for item, c in segs if edits(c.tolist(), n.tolist()) <= decontaminate._budget(len(c))})
        assert got[i] == want, i
    assert any(got.values())


def test_line_dedup_is_exact(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 60
    base = [[r.choice(vocab) for _ in range(r.randint(3, 40))] for _ in range(40)]
    docs = []
    for d in range(80):
        lines = []
        for _ in range(r.randint(0, 6)):
            w = list(r.choice(base))
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(vocab)
            lines.append(" ".join(w).replace("w", "W" if r.random() < 0.3 else "w"))
        docs.append((d, "\n".join(lines)))
    docs += [(90, None), (91, ""), (92, "\n\n"), (None, docs[5][1])]
    want, seen = {}, []
    for d, t in docs:
        if d is None or t is None:
            continue
        for i, line in enumerate(t.split("\n")):
            s = set(line.lower().split())
            if not s:
                continue
            if any(10 * len(s & o) >= 8 * len(s | o) for o in seen):
                want.setdefault(d, []).append(i)
            seen.append(s)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x["doc_id"]: x["nos"] for x in linededup.repeated_lines(df).collect()} == want
    out = {x["doc_id"]: x for x in linededup.dedup(df.withColumn("nos", F.lit("clash"))).collect()}
    assert len(out) == len(docs) and out[90]["text"] is None and out[91]["text"] == ""
    for d, t in docs:
        if d is not None and t is not None:
            assert out[d]["text"] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want.get(d, []))


def test_short_lines_are_matched(spark):
    docs = [(1, "Read more\none two three four\n\nalone"), (2, "read  MORE\none two three four five\n\n\tRead"), (3, "more read read\none two three\nfour three two one\n ")]
    got = {x["doc_id"]: x["nos"] for x in linededup.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {2: [0, 1], 3: [0, 2]}


def test_language_held_out(spark):
    r = random.Random(2)
    words = {"en": "the of and house water from with under ship".split(), "de": "der die und haus wasser von mit unter schiff über".split(), "fr": "le la et maison eau de avec sous navire été".split()}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(r.randint(5, 60))), k) for i in range(600) for k in [r.choice(list(words))]]
    got = {x["doc_id"]: x for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(got[i]["lang_pred"], k) for i, _, k in rows if got[i]["held_out"]]
    assert 100 < len(held) < 200 and sum(a == b for a, b in held) > 0.95 * len(held)


def test_gradients():
    import numpy as np

    net = langid.BiGRU(["a", "b"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.random.default_rng(0).integers(0, 256, (5, 4))
    mask, gold = np.ones((5, 4)), np.array([0, 1, 1, 0])
    _, grad = net.step(x, mask, gold)
    for k, at in (("U", (1, 4, 2)), ("E", (0, 3, int(x[2, 1]))), ("c", (0, 1, 0)), ("O", (1, 0, 2))):
        e, old = 1e-3, net.p[k][at]
        net.p[k][at] = old + e
        up = net.step(x, mask, gold)[0]
        net.p[k][at] = old - e
        down = net.step(x, mask, gold)[0]
        net.p[k][at] = old
        assert abs((up - down) / (2 * e) - grad[k][at]) < 2e-3 * max(1, abs(grad[k][at])), k


def test_mixing_reaches_targets(spark):
    r = random.Random(1)
    kinds = [("good", "calm clear true fine"), ("poor", "buy now cheap click"), ("toxic", "hate vile rot scum")]
    rows, labels = [], []
    for i in range(300):
        k = r.choices([0, 1, 2], [6, 3, 1])[0]
        rows.append((i, " ".join(r.choice(kinds[k][1].split()) for _ in range(r.randint(5, 50)))))
        if i % 2:
            labels.append((i, int(k == 0), int(k == 2)))
    rows += [(900, None), (901, ""), (None, "calm")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string").withColumn("rate", F.lit("clash")), spark.createDataFrame([*labels, (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) and all(x["rate"] >= 0 for x in out)
    total = sum(x["n_tokens"] for x in out)
    got = [sum(x["n_tokens"] * x["posterior"][k] * x["rate"] for x in out) / total for k in range(3)]
    assert all(abs(a - b) < 0.02 for a, b in zip(got, mixing.TARGETS, strict=True))


def test_pseudo_likelihood_prefers_the_corpus(spark):
    r = random.Random(6)
    rows = [(i, " ".join(w for _ in range(60) for w in ("the", r.choice(["red", "blue"]), r.choice(["cat", "dog"]), "sat"))) for i in range(150)]
    rows.append((999, " ".join(r.sample(rows[0][1].split(), 200))))
    got = {x["doc_id"]: x for x in pseudo_lm.score(spark.createDataFrame([*rows, (1000, None)], "doc_id long, text string")).collect()}
    mean = sum(got[i]["per_token"] for i in range(150)) / 150
    assert got[999]["per_token"] < mean - 0.3 and mean > -2.5 and got[1000]["n_tokens"] == 0 and got[1000]["per_token"] is None
