"""The reference's own checks: codebook shape, rotation, recall thresholds, round trips, store, streams, config, sources."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecforge.functions import sql
from vecforge.functions import text as T
from vecforge.functions import vector as V
from vecforge.operators import engine as E
from vecforge.operators import graph, polar, quantize, store, transforms
from vecforge.operators import models as M
from vecforge.operators import search as S
from vecforge.operators.config import Config
from vecforge.sources import vecs
from vecforge.streaming import ingest


@pytest.fixture(scope="module")
def data(spark):
    v = vecs.clustered(spark, 600, 32, 12, 0.1, 42)
    q = vecs.noisy_queries(v, 20, 0.05, 123).cache()
    v = v.select("vec_id", V.doubles("embedding").alias("x")).cache()
    return v, q


def one(df):
    return df.first()[0]


def test_rotation_and_codebook():
    r = M.rotation(24)
    assert r.shape == (32, 24) and np.allclose(r.T @ r, np.eye(24))
    assert M.signs(1, 1, 8) == M.signs(1, 1, 8)
    c, b = M.codebook(4, 64)
    assert len(c) == 16 and len(b) == 15 and (np.diff(c) > 0).all()
    assert np.allclose(c[8:], [0.015638, 0.047266, 0.080007, 0.114782, 0.152953, 0.196805, 0.250957, 0.329132], atol=2e-5)
    assert V.next_power_of_2(48) == 64 and V.next_power_of_2(64) == 64


def test_recall(data):
    v, q = data
    truth = S.exact(v, q, 10).cache()
    got = lambda r: S.recall(r, truth, 10).first()["recall"]
    assert got(E.search(E.build(v, "SQ8Flat", 32), q)) > 0.9
    assert got(E.search(E.build(v, "SignFlat", 32), q)) > 0.85
    assert got(E.search(E.build(v, "BookFlat", 32), q, refine=0)) > 0.5
    assert got(E.search(E.build(v, "BookFlat", 32), q)) > 0.9
    assert got(E.search(E.build(v, "BookFlat", 32, 6), q, refine=0)) > 0.8
    cents = np.array(M.kmeans(v, 8, 3).first()["ms"])
    for kind in ("RawIVF", "SignIVF", "BookIVF"):
        assert got(E.search(E.build(v, kind, 32, centroids=cents), q, 10, 8)) > 0.85
    assert 0.5 < got(E.build(v, "RawIVF", 32, centroids=cents).search(q, nprobe=1)) <= 1
    with pytest.raises(ValueError, match="kind"):
        E.build(v, "Tree", 32)
    with pytest.raises(ValueError, match="at least"):
        E.build(v, "RawFlat", 32).search(q, 0)


def test_block_form_agrees(data):
    v, q = data
    key = lambda df: sorted((r["qid"], r["rank"], r["vec_id"], round(r["dist"], 9)) for r in df.collect())
    assert key(E.build(v, "RawFlat", 32).search(q, 7)) == key(S.exact(v, q, 7))
    assert key(E.build(v, "RawIVF", 32, nlist=6, rounds=2).search(q, 7, nprobe=6)) == key(S.exact(v, q, 7))
    few = E.build(v.where("vec_id < 3"), "RawFlat", 32).search(q, 7)
    assert few.count() == 3 * q.count()
    assert E.build(v.limit(0), "RawFlat", 32).search(q, 7).count() == 0


def test_transform_passes():
    r = np.random.default_rng(2)
    x = r.normal(size=(7, 24))
    h = np.array([[(-1) ** bin(i & j).count("1") for j in range(32)] for i in range(32)])
    assert np.allclose(M.fwht(np.eye(32)), h) and M.fwht(np.array([[1, 0, 0, 0]])).tolist() == [[1, 1, 1, 1]]
    assert np.allclose(M.rotate(x), x @ M.rotation(24).T) and np.allclose(M.unrotate(M.rotate(x), 24), x)
    f = transforms.random_rotation(4, 6, 1)
    assert f.shape == (6, 4) and np.allclose(f.T @ f, 1.5 * np.eye(4))


def test_learned_front(spark, data, tmp_path):
    v, q = data
    truth = S.exact(v, q, 10).cache()
    index = E.build_opq(v, 32, 4, 8, 2, nlist=4, rounds=2)
    index.save(f"{tmp_path}/opq")
    for x in (index, E.load(spark, f"{tmp_path}/opq")):
        assert S.recall(x.search(q, 10, 4), truth, 10).first()["recall"] > 0.85
    a, _ = transforms.pca(v, 32, 8, bins=4, rotate=3)
    assert transforms.is_orthonormal(a, 1e-6)


def test_product_lists(spark, data, tmp_path):
    v, q = data
    truth = S.exact(v, q, 10).cache()
    index = E.build(v, "PQIVF", 32, 4, nlist=4, rounds=2, parts=8)
    index.save(f"{tmp_path}/pq")
    for x in (index, E.load(spark, f"{tmp_path}/pq", "PQIVF")):
        assert S.recall(x.search(q, 10, 4), truth, 10).first()["recall"] > 0.85
    assert S.recall(index.search(q, 10, 4, refine=0), truth, 10).first()["recall"] > 0.3
    with pytest.raises(ValueError, match="divide"):
        E.build(v, "PQIVF", 32, parts=5)


def test_layout_and_cache(spark, data):
    v, _ = data
    edges = spark.createDataFrame([(a, b, 1.0) for g in (0, 10) for a in range(g, g + 6) for b in range(g, g + 6) if a != b], "src long, dst long, weight double")
    pos = {r["id"]: np.array(r["pos"]) for r in graph.layout(edges, rounds=200).collect()}
    near = np.mean([np.linalg.norm(pos[a] - pos[b]) for g in (0, 10) for a in range(g, g + 6) for b in range(g, g + 6)])
    far = np.mean([np.linalg.norm(pos[a] - pos[b]) for a in range(6) for b in range(10, 16)])
    assert near < far and graph.layout(edges.limit(0)).count() == 0
    codec = polar.Polar(32, 8, 8)
    keys = v.where("vec_id < 40")
    codes = polar.compress(keys, codec)
    values = keys.select("vec_id", F.array(F.col("vec_id").cast("double")).alias("value"))
    q = spark.createDataFrame([(0, [0.3] * 32)], "qid long, qv array<double>")
    exact = graph.attention(keys.join(values, "vec_id").select(F.col("vec_id").alias("pos"), F.col("x").alias("key"), "value"), q, 32).first()["value"][0]
    assert abs(graph.compressed_attention(codes, values, q, codec).first()["value"][0] - exact) < 0.5
    assert tuple(graph.cache_bytes(codes, codec).first()) == (40, 40 * 32, 40 * 128)


def test_command_line(spark, data, tmp_path, capsys):
    from vecforge import cli

    v, q = data
    at = lambda x: f"{tmp_path}/{x}"
    v.select("vec_id", F.col("x").cast("array<float>").alias("embedding")).write.parquet(at("v"))
    v.where("vec_id < 5").select("vec_id").write.parquet(at("gone"))
    q.write.parquet(at("q"))
    (tmp_path / "c.toml").write_text("[index]\nd = 32\nnlist = 4\nniter = 2\n[query]\nk = 3\n")
    run = lambda *a: cli.main(["--config", at("c.toml"), "--events", at("events"), *a], spark)
    assert run("build", at("i"), at("v"), "--kind", "BookFlat") == 0
    assert run("delete", at("i"), at("gone"), "--to", at("i2")) == 0 and run("insert", at("i2"), at("v"), "--to", at("i3")) == 0
    assert run("search", at("i2"), at("q"), at("out")) == 0 and run("stats", at("i3")) == 0 and run("config") == 0
    out = spark.read.parquet(at("out"))
    assert out.count() == 3 * q.count() and not out.where("vec_id < 5").count()
    assert "600" in capsys.readouterr().out
    assert [r[0] for r in spark.read.parquet(at("events")).orderBy("at").collect()] == ["IndexBuilt", "IndexPersisted", "IndexPersisted", "IndexPersisted"]


def test_polar_store(spark, tmp_path):
    codec = polar.Polar(8, 8, 6)
    polar.save(spark, f"{tmp_path}/codec", codec)
    back = polar.load(spark, f"{tmp_path}/codec")
    r = np.random.default_rng(3)
    w = r.normal(size=(5, 20))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(w)], "row long, w array<double>")
    got = {x["row"]: np.array(x["w"]) for x in polar.weight_restore(polar.weight_blocks(df, codec), back).collect()}
    cos = [got[i] @ w[i] / np.linalg.norm(got[i]) / np.linalg.norm(w[i]) for i in range(5)]
    assert all(len(got[i]) == 20 for i in range(5)) and min(cos) > 0.8


def test_pack():
    r = np.random.default_rng(1)
    for bits in (1, 3, 4, 6, 8):
        c = r.integers(0, 1 << bits, (5, 13))
        assert (E.unpack_bits(E.pack_bits(c, bits), bits, 13) == c).all()
    assert E.pack_bits(np.array([[10, 11, 12, 13]]), 4).tobytes() == b"\xab\xcd"


def test_insert_and_delete(spark, data):
    v, q = data
    part = E.build(v.where("vec_id >= 100"), "SignIVF", 32, nlist=6, rounds=2)
    more = part.insert(v.where("vec_id < 120"))
    assert more.live().count() == 600 and more.live().select("vec_id").distinct().count() == 600
    gone = more.delete(v.where("vec_id % 2 = 0"))
    assert gone.stats().first()["ntotal"] == 300 and all(r["vec_id"] % 2 for r in gone.search(q).collect())
    assert gone.insert(v.where("vec_id = 0")).code(v.where("vec_id < 2")).count() == 2
    x = {r["vec_id"]: np.array(r["x"]) for r in v.collect()}
    err = [float(((np.array(r["x"]) - x[r["vec_id"]]) ** 2).sum()) for r in more.reconstructed().collect()]
    assert np.mean(err) < 1e-3


def test_report(data):
    v, q = data
    truth = S.exact(v, q, 10)
    rows = E.sweep(v, q, truth, 32, 10, ["SignIVF", "BookIVF"], [4], [2, 4, 8])
    assert len(rows) == 4 and all(r["recall"] > 0.5 and r["score"] > 0 and r["bytes"] > 32 for r in rows)


def test_kmeans_edges(spark):
    few = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(3)], "vec_id long, x array<double>")
    model = M.kmeans(few, 16, 2)
    assert len(one(model.select("ms"))) == 3
    assert M.assign(few, model).select("cluster_id").distinct().count() == 3


def test_sign_codes_guard(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0], [3.0, 5.0])], "x array<double>, c array<double>, q array<double>").withColumn("s", V.sign_encode(F.col("x"), F.col("c")))
    assert abs(one(df.select(V.sign_distance(F.col("s"), F.col("q"), F.col("c"), 2))) - 13) < 1e-4


def test_multibit_improves(data):
    v, q = data
    pair = S.pairs(v.crossJoin(F.broadcast(M.mean(v))), q)
    errs = [one(pair.withColumn("m", quantize.multibit_encode(F.col("x"), F.col("c"), b)).agg(F.avg(F.abs(quantize.multibit_distance(F.col("m"), F.col("qv"), F.col("c"), b) - V.l2sq(F.col("x"), F.col("qv")))))) for b in (2, 4, 6)]
    assert errs[0] > errs[1] > errs[2]


def test_scalar_ranges(data):
    v, _ = data
    e = v.select(F.explode("x").alias("e")).cache()
    lo, w = quantize.range_minmax(e)
    mse = {}
    for bits in (2, 4, 6):
        d = quantize.uniform_decode(quantize.uniform_encode(F.col("x"), lo, w, bits), lo, w, bits)
        mse[bits] = one(v.agg(F.avg(V.l2sq(F.col("x"), d))))
    assert mse[2] > mse[4] > mse[6]
    for f in (quantize.range_meanstd, quantize.range_quantiles):
        assert f(e)[1] > 0
    every = sorted(r[0] for r in e.collect())
    old, quantize.MOST_SORTED = quantize.MOST_SORTED, 50
    try:
        assert [quantize.nth(e, r, len(every)) for r in (0, 7, 9000, len(every) - 1)] == [every[r] for r in (0, 7, 9000, len(every) - 1)]
        assert quantize.nth(e.select(F.lit(2.0).alias("e")), 11, len(every)) == 2.0
    finally:
        quantize.MOST_SORTED = old
    assert quantize.range_optimum(e, 16, rounds=4)[1] > 0
    assert quantize.bf16(np.float32(1.00390625))[()] == 1.0 and quantize.fp16([0.1])[0] == pytest.approx(0.1, abs=1e-4)
    q = v.select(quantize.query_quantize(F.col("x"), 4).alias("q")).first()[0]
    assert max(q["q"]) == 15 and min(q["q"]) == 0


def test_polar_round_trip(spark, data):
    v, _ = data
    codec = polar.Polar(32, 8, 6)
    x = np.stack([r["x"] for r in v.collect()])
    y = codec.decode(*codec.encode(x)[:2])
    cos = (x * y).sum(axis=1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
    assert cos.mean() > 0.6
    assert np.allclose(polar.from_polar(*polar.to_polar(x)), x)
    back = polar.decompress(polar.compress(v, codec), codec)
    assert back.count() == 600 and codec.ratio() > 4


def test_transforms(data):
    v, _ = data
    r = transforms.random_rotation(32, 32, 1)
    assert transforms.is_orthonormal(r)
    a, mean = transforms.pca(v, 32, 4)
    assert transforms.is_orthonormal(a) and len(mean) == 32
    assert one(transforms.apply(v, r).agg(F.max(F.abs(V.norm(F.col("x")) - V.norm(F.col("y")))))) < 1e-9
    assert transforms.is_orthonormal(transforms.itq(v, 32, 2), 1e-6)
    rot, books = transforms.opq(v, 32, 4, 8, 2)
    y = transforms.apply(v, rot)
    err = one(transforms.pq_decode(transforms.pq_encode(y, books, "y"), books).agg(F.avg(V.l2sq(F.col("y"), F.col("decoded")))))
    assert err < 1 and transforms.is_orthonormal(rot, 1e-6)
    assert one(v.select(transforms.remap("x", [1, -1]))) [1] == 0
    assert abs(sum(one(M.mean(transforms.center(v).drop("c"))))) < 1e-9


def test_graph(data):
    v, _ = data
    q = v.where("vec_id < 30").select(F.col("vec_id").alias("qid"), F.col("x").alias("qv"))
    e = S.exact(v, q, 8).select(F.col("qid").alias("src"), F.col("vec_id").alias("dst"), F.sqrt("dist").alias("dist")).cache()
    s = graph.smooth_knn(e, 8)
    w = graph.membership(e, s, symmetric=False).groupBy("src").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r["w"] - math.log2(8)) < 0.05 for r in w)
    assert one(graph.membership(e, s).agg(F.max("weight"))) <= 1 + 1e-9
    kept = graph.select_tokens(e.select(F.col("src").alias("key"), F.row_number().over(__import__("pyspark").sql.Window.partitionBy("src").orderBy("dst")).alias("pos"), F.col("dist").alias("score")), 4, 2)
    assert kept.count() == 4 * 30


def test_attention(spark):
    cache = spark.createDataFrame([(0, [1.0, 0.0], [1.0]), (1, [0.0, 1.0], [3.0])], "pos int, key array<double>, value array<double>")
    q = spark.createDataFrame([(0, [0.0, 0.0])], "qid long, qv array<double>")
    assert graph.attention(cache, q, 2).first()["value"] == [2.0]


def test_store(spark, data, tmp_path):
    v, q = data
    index = E.build(v, "SignIVF", 32, nlist=8, rounds=2)
    path = f"{tmp_path}/index"
    index.save(path)
    got = E.load(spark, path, "SignIVF")
    assert store.load_meta(spark, path) == store.IndexMeta("SignIVF", 32, 600, 1, nlist=8)
    a, b = S.final(index.search(q, 10, 4)).collect(), S.final(got.search(q, 10, 4)).collect()
    assert sorted(a) == sorted(b)
    with pytest.raises(ValueError, match="SignFlat"):
        E.load(spark, path, "SignFlat")
    with pytest.raises(ValueError, match="index_type"):
        store.IndexMeta("Tree", 2, 1)
    plan = got.search(q.limit(1), 10, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cluster_id" in plan or "PartitionFilters: [cluster_id" in plan
    assert got.stats().first()["sq8_count"] == 600
    for kind in ("BookIVF", "BookFlat", "SQ8Flat"):
        one_ = E.build(v, kind, 32, nlist=4, rounds=2)
        one_.save(f"{tmp_path}/{kind}")
        assert sorted(S.final(one_.search(q)).collect()) == sorted(S.final(E.load(spark, f"{tmp_path}/{kind}").search(q)).collect())


def test_vector_files(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    (tmp_path / "s_base.fvecs").write_bytes(vecs.encode(x))
    (tmp_path / "s_query.fvecs").write_bytes(vecs.encode(x[:1]))
    (tmp_path / "s_groundtruth.ivecs").write_bytes(vecs.encode(np.array([[0, 1]])))
    d = vecs.dataset(spark, str(tmp_path), "s")
    assert [r["v"] for r in d["base"].orderBy("id").collect()] == x.tolist()
    assert d["groundtruth"].first()["v"] == [0, 1]
    (tmp_path / "bad.fvecs").write_bytes(b"\x00" * 8)
    with pytest.raises(Exception, match="not a vector file"):
        vecs.read_fvecs(spark, f"{tmp_path}/bad.fvecs").count()
    bad = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [float("nan"), 1.0]), (4, None)], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in vecs.checked(bad, 2).collect()] == [1]


def test_stream(spark, tmp_path):
    rows = [(i, [float(i), 1.0], i % 3, "insert", None) for i in range(8)]
    for n, part in enumerate((rows[:4], rows[4:], [(1, [1.0, 1.0], 0, "insert", 4), (1, None, None, "delete", 5), (2, None, None, "delete", 6), (2, [9.0, 9.0], 7, "insert", 7), (99, [1.0], 0, "insert", 8), (None, [1.0, 1.0], 0, "insert", 9)])):
        spark.createDataFrame(part, ingest.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.ingest(ingest.read_commands(spark, f"{tmp_path}/in", 100), f"{tmp_path}/table", f"{tmp_path}/cp", 2).awaitTermination()
        q = spark.createDataFrame([(0, [0.0, 1.0])], "qid long, qv array<double>")
        if n < 2:
            ingest.running_top_k(ingest.read_commands(spark, f"{tmp_path}/in", 100), q, str(tmp_path), f"{tmp_path}/cp2", 3).awaitTermination()
    got = {r["vec_id"]: r for r in ingest.current(spark, f"{tmp_path}/table").collect()}
    assert sorted(got) == [0, 2, 3, 4, 5, 6, 7] and got[2]["label"] == 7
    assert [r["vec_id"] for r in spark.read.parquet(f"{tmp_path}/top/batch=1").orderBy("rank").collect()] == [0, 1, 2]
    t = spark.range(300).select(F.lit(1).alias("key"), F.col("id").alias("pos"))
    assert ingest.windows(t).where("grp is null").count() == 300 - 256


def test_config(tmp_path):
    c = Config.parse("[index]\nd = 64\nuse_sq8 = no\n[query]\nk = 5\n", "ini")
    assert (c.index.d, c.index.use_sq8, c.index.nlist, c.query.k) == (64, False, 256, 5)
    for kind in ("ini", "toml"):
        assert Config.parse(c.dump(kind), kind) == c
    (tmp_path / "a.toml").write_text(c.dump("toml"))
    assert Config.load(f"{tmp_path}/a.toml") == c
    with pytest.raises(ValueError, match="nbits"):
        Config.parse("[index]\nnbits = 9\n", "ini")
    with pytest.raises(ValueError, match="truth value"):
        Config.parse("[index]\nuse_sq8 = maybe\n", "ini")


def test_sql_functions(spark):
    names = sql.register(spark)
    assert spark.sql("SELECT vec_l2sq(array(1D, 2D), array(3D, 5D))").first()[0] == 13
    assert spark.sql("SELECT vec_sq8_decode(vec_sq8_encode(array(1D), array(0D), array(2D)), array(0D), array(2D))").first()[0] == [127 * 2 / 255]
    assert len(names) == len(sql.FUNCTIONS)


def test_text_metrics(spark):
    df = spark.createDataFrame([("The cat, sat on a mat!", "cat on the mat", "3 4 3", "3", "段落3", "a b c d", "b d e")], "p string, t string, n string, k string, z string, x string, y string")
    r = df.select(
        T.normalize_answer(F.col("p")), T.qa_f1_score(F.col("p"), F.col("t")), T.count_score(F.col("n"), F.col("k")), T.retrieval_zh_score(F.col("n"), F.col("z")),
        T.rouge_l(F.col("x"), F.col("y")), T.normalize_zh_answer(F.lit("你好，World !")), T.code_sim_score(F.lit("# c\nx = 1"), F.lit("x = 1")), T.extract_answer(F.lit("so the answer is: 42\nend")),
        T.classification_score(F.lit("red and blue"), F.lit("red"), F.array(F.lit("red"), F.lit("blue"))), T.rouge_zh(F.lit("你好"), F.lit("好")), T.qa_f1_zh_score(F.lit("你好"), F.lit("好")),
    ).first()
    assert list(r) == ["cat sat on mat", pytest.approx(6 / 7), pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(4 / 7), "你好world", 1.0, "42", 0.5, pytest.approx(2 / 3), pytest.approx(2 / 3)]
