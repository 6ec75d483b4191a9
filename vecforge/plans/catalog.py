"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecforge.functions import text as T
from vecforge.functions import vector as V
from vecforge.operators import engine as E
from vecforge.operators import models as M
from vecforge.operators import search as S
from vecforge.operators import store

D, K, NLIST, NPROBE, ROUNDS, REFINE, EVERY = 64, 10, 16, 8, 4, 10, 20
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", V.doubles("embedding").alias("x"), "label")


def probe_set(v: DataFrame, every: int = EVERY) -> DataFrame:
    """The stated query set: every row whose id is divisible by `every`."""
    return v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("qid"), F.col("x").alias("qv"))


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, sf_dir)
    return v, probe_set(v)


# --- pieces of SQL ------------------------------------------------------------------------------------------------


def _zip(a: str, b: str, e: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda p: {e})"


def _l2(a: str, b: str) -> str:
    return f"list_sum({_zip(a, b, '(p[1] - p[2]) * (p[1] - p[2])')})"


def _dot(a: str, b: str) -> str:
    return f"list_sum({_zip(a, b, 'p[1] * p[2]')})"


def _sq(a: str) -> str:
    return f"list_sum(list_transform({a}, lambda e: e * e))"


def _unit(a: str) -> str:
    return f"CASE WHEN sqrt({_sq(a)}) > 1e-10 THEN list_transform({a}, lambda e: e / sqrt({_sq(a)})) ELSE {a} END"


BASE = f"v AS (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings), q AS (SELECT vec_id AS qid, x AS qv FROM v WHERE vec_id % {EVERY} = 0)"


def _top(src: str, k: int = K, order: str = "d") -> str:
    return f"(SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY {order}, vec_id) AS INTEGER) AS rank FROM {src} QUALIFY rank <= {k})"


def _knn(ctes: str, src: str, k: int = K, order: str = "d") -> str:
    return f"WITH {ctes} SELECT qid, rank, vec_id, round(d, 6) AS dist FROM {_top(src, k, order)}"


RANGES = "mm AS (SELECT i, min(x[i]) AS lo, max(x[i]) AS hi FROM v, range(1, 65) t(i) GROUP BY i), sq AS (SELECT list(lo ORDER BY i) AS lo, list(CASE WHEN hi - lo < 1e-6 THEN lo + 1e-6 ELSE hi END ORDER BY i) AS hi FROM mm)"


def _enc(x: str = "x", lo: str = "lo", hi: str = "hi") -> str:
    return f"list_transform(range(1, 65), lambda i: CAST(floor(greatest(0.0, least(1.0, ({x}[i] - {lo}[i]) / ({hi}[i] - {lo}[i]))) * 255) AS INTEGER))"


def _dec(code: str = "code", lo: str = "lo", hi: str = "hi") -> str:
    return f"list_transform(range(1, 65), lambda i: {lo}[i] + {code}[i] * (({hi}[i] - {lo}[i]) / 255))"


CODES = f"{RANGES}, coded AS (SELECT vec_id, x, {_enc()} AS code, lo, hi FROM v, sq)"
MEAN = "mean AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x[i]) AS m FROM v, range(1, 65) t(i) GROUP BY i))"
SIGNS = f"s0 AS (SELECT *, {_zip('x', 'c', 'p[1] - p[2]')} AS r FROM {{src}}), s AS (SELECT *, list_transform(r, lambda e: CASE WHEN e > 0 THEN 1 ELSE 0 END) AS signs, {_sq('r')} AS n2, {_sq('x')} AS o2, list_sum(list_transform(r, lambda e: abs(e))) AS l1 FROM s0)"
FLAT_SIGNS = f"{MEAN}, vc AS (SELECT vec_id, x, c FROM v, mean), {SIGNS.format(src='vc')}"
_ND = f"(l1 * (CASE WHEN n2 < 1e-10 THEN 1.0 ELSE 1 / sqrt(n2) END) / {D**0.5})"
DP = f"((CASE WHEN abs({_ND}) < 1e-10 THEN 1.0 ELSE 1 / {_ND} END) * sqrt(n2))"


def _est(c: str = "c") -> str:
    fd = f"list_sum(list_transform(list_zip(signs, qv, {c}), lambda p: CASE WHEN p[1] = 1 THEN p[2] - p[3] ELSE -(p[2] - p[3]) END)) / {D**0.5}"
    return f"greatest(0.0, n2 + {_l2('qv', c)} - 2 * {DP} * ({fd}))"


def _err() -> str:
    ratio = f"((n2 * {D} / 4) / ((l1 / 2) * (l1 / 2)))"
    return f"2 * (CASE WHEN {ratio} > 1 THEN sqrt(n2) * 1.9 * sqrt(({ratio} - 1) / {D - 1}) ELSE 0.0 END) * sqrt({_l2('qv', 'c')})"


def _lit(values) -> str:
    return "[" + ", ".join(repr(float(x)) for x in values) + "]::DOUBLE[]"


def _rot_sql() -> str:
    """The rotation, built in SQL: signs by md5, Hadamard by parities, as exact integers over 512."""
    return (
        "sg AS (SELECT r, i, CASE WHEN instr('02468ace', substr(md5('12345:' || r || ':' || i), 1, 1)) > 0 THEN 1 ELSE -1 END AS s FROM range(1, 4) a(r), range(0, 64) b(i)), "
        "hd AS (SELECT i, j, CASE WHEN bit_count((i & j)::BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS h FROM range(0, 64) a(i), range(0, 64) b(j)), "
        "r1 AS (SELECT hd.i, hd.j, h * s AS m FROM hd JOIN sg ON r = 1 AND sg.i = hd.j), "
        "r2 AS (SELECT hd.i, r1.j, sum(h * s * m) AS m FROM hd JOIN sg ON r = 2 AND sg.i = hd.j JOIN r1 ON r1.i = hd.j GROUP BY ALL), "
        "r3 AS (SELECT hd.i, r2.j, sum(h * s * m) AS m FROM hd JOIN sg ON r = 3 AND sg.i = hd.j JOIN r2 ON r2.i = hd.j GROUP BY ALL), "
        "rr AS (SELECT i, list(m::DOUBLE / 512 ORDER BY j) AS row FROM r3 GROUP BY i), rot AS (SELECT list(row ORDER BY i) AS rot FROM rr)"
    )


ROTZ = f"z AS MATERIALIZED (SELECT vec_id, x, list_transform(rot, lambda row: {_dot('row', 'u')}) AS z FROM (SELECT vec_id, x, {_unit('x')} AS u FROM v), rot)"
ROTQ = f"qz AS MATERIALIZED (SELECT qid, qv, list_transform(rot, lambda row: {_dot('row', 'u')}) AS qz FROM (SELECT qid, qv, {_unit('qv')} AS u FROM q), rot)"


def _book(bits: int) -> tuple[str, str]:
    c, b = M.codebook(bits, D)
    return _lit(c), _lit(b)


def _tq(bits: int) -> str:
    c, b = _book(bits)
    return f"bk AS (SELECT {c} AS cents, {b} AS bounds), t AS MATERIALIZED (SELECT vec_id, x, z, cents, list_transform(z, lambda e: len(list_filter(bounds, lambda w: w < e))) AS tq FROM z, bk)"


def _bookd(c: str = "cents") -> str:
    return f"list_sum({_zip('tq', 'qz', f'({c}[p[1] + 1] - p[2]) * ({c}[p[1] + 1] - p[2])')})"


def _assign(name: str, cents: str, src: str = "v") -> str:
    return f"{name} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, arg_min(cid, {{'d': {_l2('x', 'c')}, 'i': cid}}) AS cluster_id FROM {src}, {cents} GROUP BY vec_id)"


def _kmeans(rounds: int = ROUNDS) -> str:
    out = [f"k0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1 AS INTEGER) AS cid, x AS c FROM v QUALIFY cid < {NLIST})"]
    for i in range(rounds):
        out.append(_assign(f"a{i}", f"k{i}"))
        out.append(f"g{i} AS (SELECT cluster_id, list(m ORDER BY i) AS c FROM (SELECT cluster_id, i, avg(x[i]) AS m FROM a{i}, range(1, 65) t(i) GROUP BY ALL) GROUP BY ALL)")
        out.append(f"k{i + 1} AS MATERIALIZED (SELECT cid, coalesce(g{i}.c, k{i}.c) AS c FROM k{i} LEFT JOIN g{i} ON cluster_id = cid)")
    return ", ".join([*out, _assign("al", f"k{rounds}"), f"kk AS (SELECT * FROM k{rounds})"])


PROBES = f"pr AS (SELECT * FROM (SELECT qid, qv, cid, c AS pc, {_l2('c', 'qv')} AS d, row_number() OVER (PARTITION BY qid ORDER BY {_l2('c', 'qv')}, cid) AS rank FROM q, kk) WHERE rank <= {NPROBE})"
OWN_RANGES = f"mm AS (SELECT cluster_id, i, min(x[i]) AS lo, max(x[i]) AS hi FROM al, range(1, 65) t(i) GROUP BY ALL), sq AS (SELECT cluster_id, list(lo ORDER BY i) AS lo, list(CASE WHEN hi - lo < 1e-6 THEN lo + 1e-6 ELSE hi END ORDER BY i) AS hi FROM mm GROUP BY ALL), own AS (SELECT al.*, lo, hi, {_enc()} AS code FROM al JOIN sq USING (cluster_id))"
IVF_SIGNS = f"vc AS (SELECT vec_id, x, cluster_id, c FROM al JOIN kk ON cid = cluster_id), {SIGNS.format(src='vc')}, e AS (SELECT qid, qv, s.vec_id, s.cluster_id, {_est('pc')} AS d FROM s JOIN pr ON cid = s.cluster_id)"


def _refined(src: str, codes: str) -> str:
    return f"rf AS (SELECT e.qid, e.vec_id, {_l2(_dec(), 'e.qv')} AS d FROM {_top(src, K * REFINE)} e JOIN {codes} USING (vec_id))"


def _flat(spark, sf, kind, refine, metric="l2", where=None):
    v, q = _both(spark, sf)
    index = E.build(v if where is None else v.where(where), kind, D, sq8=refine > 0, metric=metric)
    return S.final(index.search(q, K, refine=refine))


def _inverted(spark, sf, kind, sq8=True, metric="l2"):
    v, q = _both(spark, sf)
    return E.build(v, kind, D, sq8=sq8, nlist=NLIST, rounds=ROUNDS, metric=metric), q


# --- scalar functions ---------------------------------------------------------------------------------------------


@query(_knn(f"{BASE}, e AS (SELECT qid, vec_id, {_l2('x', 'qv')} AS d FROM v, q)", "e"))
def exact_knn(spark, sf):
    return _flat(spark, sf, "RawFlat", 0)


def _pairwise(spark, sf, scores, name):
    v, q = _both(spark, sf)
    rows, q = v.select("vec_id", F.col("x").alias("a")), q.select("qid", F.col("qv").alias("b"))
    if scores is S.COSINE:
        rows, q = rows.withColumn("u", V.norm(F.col("a"))), q.withColumn("w", V.norm(F.col("b")))
    return S.scored(rows, q, scores, name, D)


@query(f"WITH {BASE} SELECT qid, vec_id, round({_l2('x', 'qv')}, 6) AS l2 FROM v, q")
def l2_distance(spark, sf):
    return _pairwise(spark, sf, S.L2, "l2")


@query(f"WITH {BASE} SELECT qid, vec_id, round({_dot('x', 'qv')}, 6) AS dot FROM v, q")
def dot_product(spark, sf):
    return _pairwise(spark, sf, S.DOT, "dot")


@query(f"WITH {BASE} SELECT qid, vec_id, round({_dot('x', 'qv')} / (sqrt({_sq('x')}) * sqrt({_sq('qv')})), 6) AS cosine FROM v, q")
def cosine(spark, sf):
    return _pairwise(spark, sf, S.COSINE, "cosine")


@query(f"WITH {BASE} SELECT vec_id, round({_sq('x')}, 6) AS norm_sq, round(sqrt({_sq('x')}), 6) AS norm FROM v")
def l2_norm(spark, sf):
    return vectors(spark, sf).select("vec_id", F.round(V.norm_sq(F.col("x")), 6).alias("norm_sq"), F.round(V.norm(F.col("x")), 6).alias("norm"))


@query(f"WITH {BASE}, w AS (SELECT vec_id, list_transform(x, lambda e: e * (1 + vec_id % 5)) AS x FROM v), u AS (SELECT vec_id, {_unit('x')} AS u FROM w) SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round(u[i], 6) AS value FROM u, range(1, 65) t(i)")
def l2_normalize(spark, sf):
    w = vectors(spark, sf).select("vec_id", V.normalize(F.transform("x", lambda e: e * (1 + F.col("vec_id") % 5))).alias("u"))
    return w.select("vec_id", F.posexplode("u").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("SELECT CAST(i - 1 AS INTEGER) AS dim, round(avg(embedding[i]::DOUBLE), 9) AS value FROM embeddings, range(1, 65) t(i) GROUP BY i")
def centroid(spark, sf):
    return M.mean(vectors(spark, sf)).select(F.posexplode("c").alias("dim", "value")).withColumn("value", F.round("value", 9))


# --- 8-bit codes --------------------------------------------------------------------------------------------------


@query(f"WITH {BASE}, {RANGES} SELECT CAST(i - 1 AS INTEGER) AS dim, round(lo[i], 9) AS vmin, round(hi[i], 9) AS vmax, round((hi[i] - lo[i]) / 255, 12) AS scale FROM sq, range(1, 65) t(i)")
def sq8_train(spark, sf):
    r = M.ranges(vectors(spark, sf)).select(F.posexplode(F.arrays_zip("lo", "hi")).alias("dim", "p"))
    return r.select("dim", F.round("p.lo", 9).alias("vmin"), F.round("p.hi", 9).alias("vmax"), F.round((F.col("p.hi") - F.col("p.lo")) / 255, 12).alias("scale"))


def _codes(spark, sf):
    v = vectors(spark, sf)
    return S.sq8_codes(v, M.ranges(v))


@query(f"WITH {BASE}, {CODES} SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, code[i] AS code FROM coded, range(1, 65) t(i)")
def sq8_encode(spark, sf):
    return _codes(spark, sf).select("vec_id", F.posexplode("code").alias("dim", "code"))


@query(f"WITH {BASE}, {CODES} SELECT vec_id, round({_l2(_dec(), 'x')} / 64, 12) AS mse FROM coded")
def sq8_decode_error(spark, sf):
    return _codes(spark, sf).select("vec_id", F.round(V.l2sq(V.sq8_decode(F.col("code"), F.col("lo"), F.col("hi")), F.col("x")) / D, 12).alias("mse"))


@query(_knn(f"{BASE}, {CODES}, e AS (SELECT qid, vec_id, {_l2(_dec(), 'qv')} AS d FROM coded, q)", "e"))
def sq8_knn(spark, sf):
    return _flat(spark, sf, "SQ8Flat", 0)


@query(f"WITH {BASE}, {CODES}, w AS (SELECT list_sum(list_transform(range(1, 65), lambda i: ((hi[i] - lo[i]) / 255) ** 2)) / 64 AS w FROM sq) SELECT qid, vec_id, round(w * list_sum(list_transform(range(1, 65), lambda i: (code[i] - (qv[i] - lo[i]) / ((hi[i] - lo[i]) / 255)) ** 2)), 6) AS dist FROM coded, q, w")
def sq8_query_distance(spark, sf):
    """Distances in code units to a query that is brought to them once."""
    lo, hi = F.col("lo"), F.col("hi")
    r = M.ranges(vectors(spark, sf))
    q = probe_set(vectors(spark, sf)).crossJoin(F.broadcast(r)).select("qid", V.sq8_query(F.col("qv"), lo, hi).alias("b"))
    steps = F.zip_with(hi, lo, lambda a, b: ((a - b) / 255) * ((a - b) / 255))
    rows = _codes(spark, sf).select("vec_id", V.doubles("code").alias("a"), V.total(steps).alias("u"), F.size(steps).cast("double").alias("m"))
    return S.scored(rows, q, S.SQ8_QUERY, "dist", D)


# --- sign codes ---------------------------------------------------------------------------------------------------


def _signed(spark, sf):
    v = vectors(spark, sf)
    return v.crossJoin(F.broadcast(M.mean(v))).withColumn("s", V.sign_encode(F.col("x"), F.col("c")))


@query(f"WITH {BASE}, {FLAT_SIGNS} SELECT vec_id, array_to_string(signs, '') AS code FROM s")
def rabitq_encode(spark, sf):
    return _signed(spark, sf).select("vec_id", F.array_join(F.col("s.signs").cast("array<string>"), "").alias("code"))


@query(f"WITH {BASE}, {FLAT_SIGNS} SELECT vec_id, round(n2, 6) AS or_minus_c_l2sqr, round({DP}, 6) AS dp_multiplier FROM s")
def rabitq_factors(spark, sf):
    return _signed(spark, sf).select("vec_id", F.round("s.n2", 6).alias("or_minus_c_l2sqr"), F.round(V.sign_dp(F.col("s"), D), 6).alias("dp_multiplier"))


@query(f"WITH {BASE}, {FLAT_SIGNS} SELECT qid, vec_id, round({_est()}, 6) AS dist FROM s, q")
def rabitq_distance(spark, sf):
    return S.scored(*S.sign_sides(*_both(spark, sf), D), S.signs(D), "dist", D)


@query(_knn(f"{BASE}, {FLAT_SIGNS}, e AS (SELECT qid, vec_id, {_est()} AS d FROM s, q)", "e"))
def rabitq_flat_knn(spark, sf):
    return _flat(spark, sf, "SignFlat", 0)


@query(_knn(f"{BASE}, {FLAT_SIGNS}, {CODES}, e AS (SELECT qid, qv, vec_id, {_est()} AS d FROM s, q), {_refined('e', 'coded')}", "rf"))
def rabitq_flat_sq8_knn(spark, sf):
    return _flat(spark, sf, "SignFlat", REFINE)


@query(f"WITH {BASE}, {FLAT_SIGNS}, b AS (SELECT qid, vec_id, {_est()} AS d, {_err()} AS err FROM s, q), k AS (SELECT qid, max(d) AS kth FROM {_top('b')} GROUP BY qid) SELECT qid, vec_id FROM b JOIN k USING (qid) WHERE greatest(0.0, d - err) < kth")
def error_bound_filter(spark, sf):
    return S.error_filter(*_both(spark, sf), D, K)


@query(f"WITH {BASE}, {FLAT_SIGNS} SELECT vec_id, round({_l2(_zip('signs', 'c', f'(p[1] - 0.5) * m + p[2]'), 'x')}, 6) AS err FROM (SELECT *, {DP} * 2 / {D**0.5} AS m FROM s)")
def rabitq_decode_error(spark, sf):
    m = V.sign_dp(F.col("s"), D) * 2 / D**0.5
    s = _signed(spark, sf).withColumn("m", m)
    return s.select("vec_id", F.round(V.l2sq(F.zip_with("s.signs", "c", lambda b, c: (b - 0.5) * F.col("m") + c), F.col("x")), 6).alias("err"))


_MULTI = f"{MEAN}, mr AS (SELECT vec_id, c, {_zip('x', 'c', 'p[1] - p[2]')} AS r FROM v, mean), mu AS (SELECT vec_id, c, r, list_transform(r, lambda e: greatest(0, least(15, floor(e / greatest(list_max(list_transform(r, lambda a: abs(a))), 1e-12) * 8 + 8))) - 7.5) AS y FROM mr), mf AS (SELECT vec_id, c, y, {_sq('r')} AS n2, {_dot('r', 'y')} AS ry FROM mu)"


@query(f"WITH {BASE}, {_MULTI} SELECT qid, vec_id, round(greatest(0.0, {_l2('qv', 'c')} + n2 + (CASE WHEN abs(ry) > 1e-12 THEN -2 * n2 / ry ELSE 0.0 END) * list_sum(list_transform(list_zip(qv, c, y), lambda p: (p[1] - p[2]) * p[3]))), 6) AS dist FROM mf, q")
def multibit_distance(spark, sf):
    """Sign codes of four bits about the mean."""
    from vecforge.operators import quantize

    v, q = _both(spark, sf)
    c = F.broadcast(M.mean(v))
    coded = v.crossJoin(c).select("vec_id", quantize.multibit_encode(F.col("x"), F.col("c"), 4).alias("e"))
    rows = coded.select("vec_id", F.transform("e.u", lambda e: e - 7.5).alias("a"), F.col("e.f_add").alias("u"), F.col("e.f_rescale").alias("m"))
    q = q.crossJoin(c).select("qid", V.minus(F.col("qv"), F.col("c")).alias("b"))
    return S.scored(rows, q.withColumn("w", V.norm_sq(F.col("b"))), S.MULTIBIT, "dist", D)


# --- rotation and codebooks ---------------------------------------------------------------------------------------


def _z(spark, sf):
    return S.rotated(vectors(spark, sf), "x", "z", M.rotation(D).tolist())


@query(f"WITH {BASE}, {_rot_sql()}, {ROTZ} SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round(z[i], 6) AS value FROM z, range(1, 65) t(i)")
def hadamard_rotate(spark, sf):
    return _z(spark, sf).select("vec_id", F.posexplode("z").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(f"WITH {BASE}, {_rot_sql()}, {ROTZ} SELECT vec_id, round({_sq('z')}, 6) AS rotated, round({_sq(_unit('x'))}, 6) AS unit FROM z")
def rotation_norm_check(spark, sf):
    return _z(spark, sf).select("vec_id", F.round(V.norm_sq(F.col("z")), 6).alias("rotated"), F.round(V.norm_sq(V.normalize(F.col("x"))), 6).alias("unit"))


@query(f"WITH {BASE} SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round(u[i], 6) AS value FROM (SELECT vec_id, {_unit('x')} AS u FROM v), range(1, 65) t(i)")
def inverse_rotation(spark, sf):
    """Rotated and rotated back: the unit vectors."""
    return M.unrotated(_z(spark, sf).select("vec_id", "z"), D).select("vec_id", F.posexplode("x").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(f"WITH {BASE}, hd AS (SELECT i, list(CASE WHEN bit_count((i & j)::BIGINT) % 2 = 0 THEN 0.125 ELSE -0.125 END::DOUBLE ORDER BY j) AS row FROM range(0, 64) a(i), range(0, 64) b(j) GROUP BY i) SELECT vec_id, CAST(i AS INTEGER) AS dim, round({_dot('row', 'x')}, 6) AS value FROM v, hd")
def hadamard_single(spark, sf):
    """One unsigned transform, scaled."""
    return M.hadamard(vectors(spark, sf)).select("vec_id", F.posexplode("y").alias("dim", "value")).withColumn("value", F.round("value", 6))


#: The Lloyd-Max rounds themselves, over prefix sums of the density on the same grid.
_LLOYD = """WITH RECURSIVE g AS (SELECT j, -1 + 2 * (j + 0.5) / 32768 AS x, pow(1 - x * x, 30.5) AS w FROM range(32768) t(j)),
cum AS (SELECT list_prepend(0.0::DOUBLE, list(cw ORDER BY j)) AS cw, list_prepend(0.0::DOUBLE, list(cx ORDER BY j)) AS cx FROM (SELECT j, sum(w) OVER (ORDER BY j) AS cw, sum(w * x) OVER (ORDER BY j) AS cx FROM g)),
cuts AS (SELECT b AS nbits, list_transform(range(0, (1 << b) + 1), lambda i: CASE WHEN i = 0 THEN 0 WHEN i = 1 << b THEN 32768 ELSE len(list_filter(cw, lambda v: v < cw[32769] * i / (1 << b) * (1 - 1e-12))) END) AS ct FROM cum, range(1, 5) t(b)),
it AS (SELECT CAST(nbits AS INTEGER) AS nbits, 0 AS n, list_transform(range(1, (1 << nbits) + 1), lambda i: (cx[ct[i + 1] + 1] - cx[ct[i] + 1]) / (cw[ct[i + 1] + 1] - cw[ct[i] + 1])) AS c FROM cuts, cum
UNION ALL SELECT nbits, n + 1, list_transform(e, lambda q: greatest(q.lo, least(q.hi, (cx[q.h + 1] - cx[q.l + 1]) / (cw[q.h + 1] - cw[q.l + 1])))) FROM (
SELECT nbits, n, list_transform(range(1, len(c) + 1), lambda i: {'lo': CASE WHEN i = 1 THEN -1.0 ELSE (c[i - 1] + c[i]) / 2 END, 'hi': CASE WHEN i = len(c) THEN 1.0 ELSE (c[i] + c[i + 1]) / 2 END, 'l': CASE WHEN i = 1 THEN 0 ELSE CAST(ceil(((c[i - 1] + c[i]) / 2 + 1) * 16384 - 0.5) AS BIGINT) END, 'h': CASE WHEN i = len(c) THEN 32768 ELSE CAST(ceil(((c[i] + c[i + 1]) / 2 + 1) * 16384 - 0.5) AS BIGINT) END}) AS e FROM it WHERE n < 100) s, cum)
SELECT nbits, CAST(i - 1 AS INTEGER) AS cell, round(c[i]::FLOAT::DOUBLE, 6) AS centroid FROM it, range(1, 17) t(i) WHERE n = 100 AND i <= len(c)"""


@query(_LLOYD)
def lloydmax_codebook(spark, sf):
    rows = [(b, i, round(float(c), 6)) for b in (1, 2, 3, 4) for i, c in enumerate(M.codebook(b, D)[0])]
    return spark.createDataFrame(rows, "nbits int, cell int, centroid double")


def _tqcodes(spark, sf, bits):
    c, b = M.codebook(bits, D)
    return S.book_codes(vectors(spark, sf), M.rotation(D).tolist(), c.tolist(), b.tolist())


@query(f"WITH {BASE}, {_rot_sql()}, {ROTZ}, {_tq(4)} SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, CAST(tq[i] AS INTEGER) AS code FROM t, range(1, 65) r(i)")
def tq4_encode(spark, sf):
    return _tqcodes(spark, sf, 4).select("vec_id", F.posexplode("tq").alias("dim", "code"))


_TQE = f"e AS (SELECT qid, qv, vec_id, {_bookd()} AS d FROM t, qz)"


@query(f"WITH {BASE}, {_rot_sql()}, {ROTZ}, {ROTQ}, {_tq(4)}, {_TQE} SELECT qid, vec_id, round(d, 6) AS dist FROM e")
def tq4_distance(spark, sf):
    rows = _tqcodes(spark, sf, 4).select("vec_id", V.book_decode(F.col("tq"), F.col("cents")).alias("a"))
    q = S.rotated(probe_set(vectors(spark, sf)), "qv", "b", M.rotation(D).tolist())
    return S.scored(rows, q.select("qid", "b"), S.L2, "dist", D)


@query(f"WITH {BASE}, {_rot_sql()}, {ROTZ}, {ROTQ}, {_tq(4)}, {_TQE} SELECT qid, vec_id, round(d, 6) AS dist FROM e")
def tq4_table_distance(spark, sf):
    """The same distances by tables that are made once a query."""
    q = S.rotated(probe_set(vectors(spark, sf)), "qv", "b", M.rotation(D).tolist())
    rows = _tqcodes(spark, sf, 4).select("vec_id", V.doubles("tq").alias("a"))
    return S.scored(rows, q.select("qid", "b"), S.Tables(M.codebook(4, D)[0]), "dist", D)


@query(_knn(f"{BASE}, {_rot_sql()}, {ROTZ}, {ROTQ}, {_tq(4)}, {_TQE}", "e"))
def tq4_flat_knn(spark, sf):
    return _flat(spark, sf, "BookFlat", 0)


@query(_knn(f"{BASE}, {_rot_sql()}, {ROTZ}, {ROTQ}, {_tq(4)}, {_TQE}, {CODES}, {_refined('e', 'coded')}", "rf"))
def tq4_sq8_knn(spark, sf):
    return _flat(spark, sf, "BookFlat", REFINE)


_BITS = (1, 2, 3, 4, 6, 8)


@query(f"WITH {BASE}, {_rot_sql()}, {ROTZ} " + " UNION ALL ".join(
    f"SELECT {b} AS nbits, round(avg(list_sum(list_transform(z, lambda e: (e - cents[len(list_filter(bounds, lambda w: w < e)) + 1]) ** 2))), 9) AS mse FROM z, (SELECT {_book(b)[0]} AS cents, {_book(b)[1]} AS bounds)" for b in _BITS))
def tq_bits_mse(spark, sf):
    z = _z(spark, sf)
    out = None
    for b in _BITS:
        c, w = M.codebook(b, D)
        one = z.crossJoin(M.row(spark, cents=c.tolist(), bounds=w.tolist())).agg(F.lit(b).alias("nbits"), F.round(F.avg(V.l2sq(F.col("z"), V.book_decode(V.book_encode(F.col("z"), F.col("bounds")), F.col("cents")))), 9).alias("mse"))
        out = one if out is None else out.unionAll(one)
    return out


# --- clustering ---------------------------------------------------------------------------------------------------


@query(f"WITH {BASE}, {_kmeans(0)} SELECT vec_id, cluster_id FROM al")
def kmeans_assign(spark, sf):
    v = vectors(spark, sf)
    return M.assign(v, M.row(spark, ms=M.seeds(v, NLIST))).select("vec_id", "cluster_id")


@query(f"WITH {BASE}, {_kmeans(1)} SELECT cid AS cluster_id, CAST(i - 1 AS INTEGER) AS dim, round(c[i], 6) AS value FROM kk, range(1, 65) t(i)")
def kmeans_step(spark, sf):
    return _centroids(M.kmeans(vectors(spark, sf), NLIST, 1))


def _centroids(model):
    return model.select(F.posexplode("ms").alias("cluster_id", "c")).select("cluster_id", F.posexplode("c").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(f"WITH {BASE}, {_kmeans()} SELECT cid AS cluster_id, CAST(i - 1 AS INTEGER) AS dim, round(c[i], 6) AS value FROM kk, range(1, 65) t(i)")
def kmeans_fit(spark, sf):
    return _centroids(M.kmeans(vectors(spark, sf), NLIST, ROUNDS))


def _lists(spark, sf):
    v = vectors(spark, sf)
    model = M.kmeans(v, NLIST, ROUNDS)
    return M.assign(v, model), probe_set(v), model


@query(f"WITH {BASE}, {_kmeans()} SELECT cluster_id, count(*) AS size FROM al GROUP BY ALL")
def cluster_sizes(spark, sf):
    return _lists(spark, sf)[0].groupBy("cluster_id").agg(F.count("*").alias("size"))


@query(f"WITH {BASE}, {_kmeans()}, n AS (SELECT cluster_id, count(*) AS size FROM al GROUP BY ALL) SELECT cluster_id, size, CAST(coalesce(sum(size) OVER (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM n")
def cluster_offsets(spark, sf):
    return store.cluster_offsets(_lists(spark, sf)[0])


@query(f"WITH {BASE}, {_kmeans()} SELECT vec_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY vec_id) - 1 AS pos FROM al")
def cluster_positions(spark, sf):
    return _lists(spark, sf)[0].select("vec_id", "cluster_id", (F.row_number().over(W.partitionBy("cluster_id").orderBy("vec_id")) - 1).cast("long").alias("pos"))


@query(f"WITH {BASE}, {_kmeans()}, {PROBES} SELECT qid, CAST(rank AS INTEGER) AS rank, cid AS cluster_id, round(d, 6) AS dist FROM pr")
def probe_clusters(spark, sf):
    _, q, model = _lists(spark, sf)
    return S.probes(q, model, NPROBE).select("qid", "rank", "cluster_id", F.round("dist", 6).alias("dist"))


def _ivf(spark, sf, kind, refine, metric="l2"):
    index, q = _inverted(spark, sf, kind, refine > 0, metric)
    return S.final(index.search(q, K, NPROBE, refine))


@query(_knn(f"{BASE}, {_kmeans()}, {PROBES}, e AS (SELECT qid, vec_id, {_l2('x', 'qv')} AS d FROM al JOIN pr ON cid = cluster_id)", "e"))
def ivf_flat_knn(spark, sf):
    return _ivf(spark, sf, "RawIVF", 0)


@query(_knn(f"{BASE}, {_kmeans()}, {PROBES}, {IVF_SIGNS}", "e"))
def rabitq_ivf_knn(spark, sf):
    return _ivf(spark, sf, "SignIVF", 0)


@query(_knn(f"{BASE}, {_kmeans()}, {PROBES}, {IVF_SIGNS}, {OWN_RANGES}, {_refined('e', 'own')}", "rf"))
def rabitq_ivf_sq8_knn(spark, sf):
    return _ivf(spark, sf, "SignIVF", REFINE)


_IVF_BOOK = f"{BASE}, {_kmeans()}, {PROBES}, {_rot_sql()}, {ROTZ}, {ROTQ}, {_tq(4)}, e AS (SELECT pr.qid, pr.qv, t.vec_id, {_bookd()} AS d FROM t JOIN al USING (vec_id) JOIN pr ON cid = cluster_id JOIN qz ON qz.qid = pr.qid), {OWN_RANGES}, {_refined('e', 'own')}"


@query(_knn(_IVF_BOOK, "rf"))
def tq_ivf_sq8_knn(spark, sf):
    return _ivf(spark, sf, "BookIVF", REFINE)


# --- search variants ----------------------------------------------------------------------------------------------


@query(f"WITH {BASE} SELECT qid, vec_id, round({_l2('x', 'qv')}, 6) AS dist FROM v, q WHERE {_l2('x', 'qv')} < 1.2")
def range_search(spark, sf):
    v, q = _both(spark, sf)
    return E.build(v, "RawFlat", D).within(q, 1.2).withColumn("dist", F.round("dist", 6))


@query(_knn(f"{BASE}, e AS (SELECT qid, vec_id, {_l2('x', 'qv')} AS d FROM v, q WHERE label = 3)", "e"))
def filtered_knn(spark, sf):
    return _flat(spark, sf, "RawFlat", 0, where="label = 3")


@query(_knn(f"{BASE}, e AS (SELECT qid, vec_id, {_dot('x', 'qv')} AS d FROM v, q)", "e", order="d DESC"))
def ip_knn(spark, sf):
    return _flat(spark, sf, "RawFlat", 0, metric="ip")


@query(f"WITH {BASE}, w AS (SELECT a.vec_id AS qid, b.vec_id, {_l2('a.x', 'b.x')} AS d FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT qid AS src, vec_id AS dst, rank, round(d, 6) AS weight FROM {_top('w', 5)}")
def knn_graph(spark, sf):
    """Edges from every row whose id is divisible by 20 to its 5 nearest others."""
    v = vectors(spark, sf).where(S.whole(F.col("x"), D) & F.col("vec_id").isNotNull())
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("x").alias("qv"))
    # a row of the query's own id takes a place in each search that a row of this id asks for
    again = q.groupBy("qid").count().agg(F.max("count")).first()[0] or 1
    e = E.build(v, "RawFlat", D).search(q, 5 + again * again).where("vec_id <> qid").select("qid", "vec_id", "dist")
    return S.best(e, 5).select(F.col("qid").alias("src"), F.col("vec_id").alias("dst"), "rank", F.round("dist", 6).alias("weight"))


_IP = f"(-0.5 * (n2 + {_l2('qv', '{c}')} - 2 * {DP} * (list_sum(list_transform(list_zip(signs, qv, {{c}}), lambda p: CASE WHEN p[1] = 1 THEN p[2] - p[3] ELSE -(p[2] - p[3]) END)) / {D**0.5}) - {_sq('qv')} - o2))"


@query(_knn(f"{BASE}, {FLAT_SIGNS}, e AS (SELECT qid, vec_id, {_IP.replace('{c}', 'c')} AS d FROM s, q)", "e", order="d DESC"))
def rabitq_ip_knn(spark, sf):
    return _flat(spark, sf, "SignFlat", 0, metric="ip")


@query(_knn(f"{BASE}, {_kmeans()}, {PROBES}, vc AS (SELECT vec_id, x, cluster_id, c FROM al JOIN kk ON cid = cluster_id), {SIGNS.format(src='vc')}, e AS (SELECT qid, s.vec_id, {_IP.replace('{c}', 'pc')} AS d FROM s JOIN pr ON cid = s.cluster_id)", "e", order="d DESC"))
def rabitq_ivf_ip_knn(spark, sf):
    return _ivf(spark, sf, "SignIVF", 0, metric="ip")


def _recall_sql(method: str, src: str) -> str:
    return f"SELECT '{method}' AS method, {K} AS k, (SELECT count(*) FROM q) AS nq, round(count(*) / ({K} * (SELECT count(*) FROM q)), 6) AS recall FROM best_{src} WHERE qid * 1000000 + vec_id IN (SELECT qid * 1000000 + vec_id FROM best_g)"


@query(f"WITH {BASE}, {CODES}, {FLAT_SIGNS}, g AS (SELECT qid, vec_id, {_l2('x', 'qv')} AS d FROM v, q), r1 AS (SELECT qid, vec_id, {_l2(_dec(), 'qv')} AS d FROM coded, q), r2 AS (SELECT qid, vec_id, {_est()} AS d FROM s, q), best_g AS MATERIALIZED {_top('g')}, best_r1 AS MATERIALIZED {_top('r1')}, best_r2 AS MATERIALIZED {_top('r2')} {_recall_sql('sq8', 'r1')} UNION ALL {_recall_sql('sign', 'r2')}")
def recall_at_k(spark, sf):
    v, q = _both(spark, sf)
    truth = E.build(v, "RawFlat", D).search(q, K)
    one = lambda name, kind: S.recall(E.build(v, kind, D, sq8=False).search(q, K, refine=0), truth, K).select(F.lit(name).alias("method"), F.lit(K).alias("k"), "nq", F.round("recall", 6).alias("recall"))
    return one("sq8", "SQ8Flat").unionAll(one("sign", "SignFlat"))


@query("SELECT event_type, count(*) AS n, round(list_sort(list(value))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1], 6) AS p50, round(list_sort(list(value))[least(count(*) - 1, CAST(floor(count(*) * 0.99) AS BIGINT)) + 1], 6) AS p99 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_percentiles(spark, sf):
    """Element floor(n p) of the sorted values. A sketch brackets each percentile; only the values within the bracket are
    ranked, and those below it counted, so the result is exact and no group is sorted whole."""
    e = spark.read.parquet(f"{sf}/events.parquet").where("value is not null").select("event_type", "value")
    at = {"p50": 0.5, "p99": 0.99}
    ends = [F.percentile_approx("value", F.lit(max(0.0, min(1.0, p + s))), F.lit(10_000)).alias(f"{c}_{side}") for c, p in at.items() for side, s in (("lo", -0.002), ("hi", 0.002))]
    bounds = e.groupBy("event_type").agg(F.count("*").alias("n"), *ends)
    j = e.join(F.broadcast(bounds), "event_type")
    out = j.groupBy("event_type").agg(F.max("n").alias("n"), *[F.sum((F.col("value") < F.col(f"{c}_lo")).cast("long")).alias(f"{c}_below") for c in at])
    for c, p in at.items():
        within = j.where(F.col("value").between(F.col(f"{c}_lo"), F.col(f"{c}_hi"))).select("event_type", "value")
        ranked = within.withColumn("i", F.row_number().over(W.partitionBy("event_type").orderBy("value")) - 1).join(F.broadcast(out.select("event_type", "n", f"{c}_below")), "event_type")
        hit = ranked.where(F.col("i") + F.col(f"{c}_below") == F.least(F.col("n") - 1, F.floor(F.col("n") * p))).select("event_type", F.round("value", 6).alias(c))
        out = out.join(hit, "event_type")
    return out.select("event_type", "n", "p50", "p99")


_METHODS = (("sq8", "SQ8Flat", 4, False), ("rabitq", "SignFlat", 1, False), ("rabitq_sq8", "SignFlat", 1, True), ("tq4", "BookFlat", 4, False), ("tq4_sq8", "BookFlat", 4, True), ("tq6", "BookFlat", 6, False))


@query("WITH n AS (SELECT count(*) AS n FROM embeddings), m(method, code_bytes) AS (VALUES ('sq8', 64), ('rabitq', 24), ('rabitq_sq8', 88), ('tq4', 32), ('tq4_sq8', 96), ('tq6', 48)) SELECT method, n * code_bytes AS total_bytes, round(256.0 / code_bytes, 6)::DOUBLE AS ratio FROM m, n")
def storage_report(spark, sf):
    """Bytes of codes, factors (two doubles) and 8-bit codes as they are stored."""
    v, out = vectors(spark, sf), None
    for name, kind, bits, sq8 in _METHODS:
        st = E.build(v, kind, D, bits, sq8).stats()
        total = F.col("code_bytes") + F.col("factor_bytes") + F.col("sq8_bytes")
        one = st.select(F.lit(name).alias("method"), total.cast("long").alias("total_bytes"), F.round(F.col("ntotal") * 4.0 * D / total, 6).alias("ratio"))
        out = one if out is None else out.unionAll(one)
    return out


# --- store --------------------------------------------------------------------------------------------------------


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (1, 5, 7, 42)")
def point_lookup(spark, sf):
    return store.lookup(spark.read.parquet(f"{sf}/embeddings.parquet"), [1, 5, 7, 42]).select("vec_id", "label")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 10 <> 1")
def delete_antijoin(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label")
    return store.without(e, e.where("vec_id % 10 = 1"))


@query("SELECT 'BookFlat' AS index_type, 64 AS d, count(*) AS ntotal, count(*) AS sq8_count, count(*) * 32 AS code_bytes, count(*) * 0 AS factor_bytes, count(*) * 64 AS sq8_bytes FROM embeddings")
def store_stats(spark, sf):
    return E.build(vectors(spark, sf), "BookFlat", D).stats()


_HEX = "list_transform(range(0, 16), lambda i: substr('0123456789ABCDEF', CAST(1 + 8 * signs[4 * i + 1] + 4 * signs[4 * i + 2] + 2 * signs[4 * i + 3] + signs[4 * i + 4] AS BIGINT), 1))"
_BOOK_HEX = "list_transform(tq, lambda t: substr('0123456789ABCDEF', CAST(t + 1 AS BIGINT), 1))"


@query(f"WITH {BASE}, {MEAN}, vc AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN list_transform(x, lambda e: -e) ELSE x END AS x, c FROM v, mean), {SIGNS.format(src='vc')} SELECT vec_id, array_to_string({_HEX}, '') AS code, CASE WHEN vec_id % 10 = 0 THEN 1 ELSE 0 END AS seq FROM s")
def upsert_latest(spark, sf):
    """Codes appended as versions: the last of each id counts."""
    v = vectors(spark, sf)
    index = E.build(v, "SignFlat", D, sq8=False)
    new = E.encoded(v.where("vec_id % 10 = 0").withColumn("x", F.transform("x", lambda e: -e)), "SignFlat", 1, index.models)
    both = index.rows.withColumn("seq", F.lit(0)).unionByName(new.withColumn("seq", F.lit(1)))
    return store.latest(both).select("vec_id", F.hex("code").alias("code"), "seq")


@query(f"WITH {BASE}, {FLAT_SIGNS}, {_rot_sql()}, {ROTZ}, {_tq(4)} SELECT v.vec_id, CASE WHEN v.vec_id % 2 = 0 THEN array_to_string({_HEX}, '') WHEN v.vec_id % 3 = 0 THEN array_to_string({_BOOK_HEX}, '') END AS code FROM v JOIN s USING (vec_id) JOIN t USING (vec_id)")
def code_fallback(spark, sf):
    """The code of each id from the index of sign codes (even ids), else from that of codebook codes (multiples of 3)."""
    v = vectors(spark, sf)
    sign = E.build(v, "SignFlat", D, sq8=False).delete(v.where("vec_id % 2 <> 0"))
    book = E.build(v, "BookFlat", D, sq8=False).delete(v.where("vec_id % 3 <> 0"))
    both = [x.live().select("vec_id", F.hex("code").alias("code")) for x in (sign, book)]
    return store.first_code(v.select("vec_id"), *both)


@query(f"WITH {BASE}, {CODES} SELECT vec_id, array_to_string(list_transform(code, lambda c: lpad(lower(to_hex(c)), 2, '0')), '') AS sq8 FROM coded WHERE vec_id IN (1, 5, 7, 42)")
def sq8_lookup(spark, sf):
    v = vectors(spark, sf)
    return E.build(v, "SignFlat", D).code(spark.createDataFrame([(1,), (5,), (7,), (42,)], "vec_id long")).select("vec_id", F.lower(F.hex("sq8")).alias("sq8"))


_INSERTED = f"WITH {BASE}, {_kmeans()}, vc AS (SELECT vec_id, x, cluster_id, c FROM al JOIN kk ON cid = cluster_id), {SIGNS.format(src='vc')} SELECT vec_id, cluster_id, array_to_string({_HEX}, '') AS code, round(n2, 6) AS n2 FROM s WHERE vec_id % 7 <> 3"


@query(_INSERTED)
def incremental_insert(spark, sf):
    """Lists trained on all vectors; nine tenths built, the rest inserted one index on (assigned, encoded, appended), some replaced, some deleted."""
    v = vectors(spark, sf)
    cents = E.np.array(M.kmeans(v, NLIST, ROUNDS).first()["ms"])
    index = E.build(v.where("vec_id % 10 <> 0"), "SignIVF", D, sq8=False, centroids=cents).insert(v.where("vec_id % 10 = 0 or vec_id % 10 = 1"))
    return index.delete(v.where("vec_id % 7 = 3")).live().select("vec_id", "cluster_id", F.hex("code").alias("code"), F.round("n2", 6).alias("n2"))


@query(f"WITH {BASE}, {_rot_sql()}, {ROTZ}, {_tq(4)} SELECT vec_id, array_to_string({_BOOK_HEX}, '') AS code FROM t")
def tq4_packed(spark, sf):
    """Codebook codes as stored: four bits each, the first in the high half of the first byte."""
    return E.build(vectors(spark, sf), "BookFlat", D, sq8=False).rows.select("vec_id", F.hex("code").alias("code"))


@query(f"WITH {BASE}, {_kmeans()} SELECT cluster_id, count(*) AS count, CAST(sum(vec_id % 4) AS BIGINT) AS start FROM al GROUP BY cluster_id")
def merge_counts(spark, sf):
    """Deltas of four batches of assigned vectors, merged: sizes, and batch numbers times sizes."""
    lists, _, _ = _lists(spark, sf)
    deltas = lists.groupBy("cluster_id", (F.col("vec_id") % 4).alias("batch")).agg(F.count("*").alias("count")).select("cluster_id", "count", (F.col("batch") * F.col("count")).alias("start"))
    return store.merged_counts(deltas)


@query(f"WITH {BASE}, {_kmeans()}, n AS (SELECT cluster_id, count(*) AS size FROM al GROUP BY ALL), o AS (SELECT cluster_id, size, coalesce(sum(size) OVER (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM n) SELECT vec_id AS id, cluster_id FROM v JOIN o ON vec_id >= lo AND vec_id < lo + size")
def id_to_cluster(spark, sf):
    lists, _, _ = _lists(spark, sf)
    o = store.cluster_offsets(lists)
    ids = vectors(spark, sf).select(F.col("vec_id").alias("id"))
    return ids.join(F.broadcast(o), (F.col("id") >= F.col("offset")) & (F.col("id") < F.col("offset") + F.col("size"))).select("id", "cluster_id")


# --- encoders of the study modules --------------------------------------------------------------------------------


@query(f"WITH {BASE}, f AS (SELECT min(e) AS lo, max(e) AS hi FROM (SELECT unnest(x) AS e FROM v)), c AS (SELECT x, list_transform(x, lambda e: floor(greatest(0.0, least(1.0, (e - lo) / (hi - lo))) * 15)) AS q, lo, hi FROM v, f) SELECT round(avg(list_sum(list_transform(list_zip(x, q), lambda p: (p[1] - (lo + (p[2] + 0.5) * (hi - lo) / 15)) ** 2))), 6) AS mse FROM c")
def scalar_quant_uniform(spark, sf):
    """One range for all dimensions, 4 bits, cells decoded to their middles."""
    v = vectors(spark, sf)
    f = v.select(F.array_min("x").alias("a"), F.array_max("x").alias("b")).agg(F.min("a").alias("lo"), F.max("b").alias("hi"))
    w = F.col("hi") - F.col("lo")
    q = F.transform("x", lambda e: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (e - F.col("lo")) / w)) * 15))
    err = F.zip_with("x", q, lambda e, c: e - (F.col("lo") + (c + 0.5) * w / 15))
    return v.crossJoin(F.broadcast(f)).agg(F.round(F.avg(V.norm_sq(err)), 6).alias("mse"))


_POLAR = "pl AS (SELECT vec_id, vec_id // 128 AS grp, i - 1 AS chan, sqrt(x[i] * x[i] + x[i + 32] * x[i + 32]) AS rho, CASE WHEN atan2(x[i + 32], x[i]) < 0 THEN atan2(x[i + 32], x[i]) + 2 * pi() ELSE atan2(x[i + 32], x[i]) END AS phi FROM v, range(1, 33) t(i)), pm AS (SELECT grp, chan, min(rho) AS rmn, (max(rho) - min(rho)) / 16 AS rs, min(phi) AS tmn, (max(phi) - min(phi)) / 16 AS ts FROM pl GROUP BY ALL)"


@query(f"WITH {BASE}, {_POLAR} SELECT vec_id, CAST(chan AS INTEGER) AS chan, CAST(greatest(0, least(15, coalesce(floor((rho - rmn) / nullif(rs, 0)), 0))) * 16 + greatest(0, least(15, coalesce(floor((phi - tmn) / nullif(ts, 0)), 0))) AS INTEGER) AS code FROM pl JOIN pm USING (grp, chan)")
def polar2d_group_quant(spark, sf):
    """Channel pairs (j, j + 32) in polar form, 4 + 4 bits by the ranges of each group of 128 rows and channel."""
    v = vectors(spark, sf)
    p = v.select("vec_id", F.floor(F.col("vec_id") / 128).alias("grp"), F.posexplode(F.zip_with(F.slice("x", 1, 32), F.slice("x", 33, 32), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("chan", "p"))
    phi = F.atan2("p.b", "p.a")
    p = p.select("vec_id", "grp", "chan", F.sqrt(F.col("p.a") * F.col("p.a") + F.col("p.b") * F.col("p.b")).alias("rho"), F.when(phi < 0, phi + 2 * F.pi()).otherwise(phi).alias("phi"))
    m = p.groupBy("grp", "chan").agg(F.min("rho").alias("rmn"), ((F.max("rho") - F.min("rho")) / 16).alias("rs"), F.min("phi").alias("tmn"), ((F.max("phi") - F.min("phi")) / 16).alias("ts"))
    cell = lambda x, lo, s: F.greatest(F.lit(0), F.least(F.lit(15), F.coalesce(F.floor((F.col(x) - F.col(lo)) / F.nullif(F.col(s), F.lit(0.0))), F.lit(0))))
    return p.join(m, ["grp", "chan"]).select("vec_id", "chan", (cell("rho", "rmn", "rs") * 16 + cell("phi", "tmn", "ts")).cast("int").alias("code"))


_SM = "sm AS (SELECT user_id, event_id, value, exp(value - max(value) OVER w) / sum(exp(value)) OVER w * exp(max(value) OVER w) AS p FROM (SELECT user_id, event_id, value / 100 AS value FROM events WHERE value IS NOT NULL) WINDOW w AS (PARTITION BY user_id))"


def _softmax(spark, sf):
    w = W.partitionBy("user_id")
    e = spark.read.parquet(f"{sf}/events.parquet").where("value is not null").select("user_id", "event_id", (F.col("value") / 100).alias("value"))
    x = e.withColumn("x", F.exp(F.col("value") - F.max("value").over(w)))
    return x.withColumn("p", F.col("x") / F.sum("x").over(w)).drop("x")


@query(f"WITH {_SM} SELECT user_id, event_id, round(p, 6) AS p FROM sm")
def softmax(spark, sf):
    return _softmax(spark, sf).select("user_id", "event_id", F.round("p", 6).alias("p"))


@query(f"WITH {_SM} SELECT user_id, event_id FROM (SELECT *, coalesce(sum(round(p, 9)) OVER (PARTITION BY user_id ORDER BY p DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sm) WHERE before < 0.9")
def topp_filter(spark, sf):
    """The fewest, most probable rows of each user that hold 0.9 of the probability."""
    w = W.partitionBy("user_id").orderBy(F.col("p").desc(), "event_id").rowsBetween(W.unboundedPreceding, -1)
    return _softmax(spark, sf).withColumn("before", F.coalesce(F.sum(F.round("p", 9)).over(w), F.lit(0.0))).where("before < 0.9").select("user_id", "event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events WHERE value IS NOT NULL) WHERE r <= 5")
def topk_filter(spark, sf):
    """The five greatest logits of each user; the limit is pushed below the exchange."""
    r = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return spark.read.parquet(f"{sf}/events.parquet").where("value is not null").withColumn("r", r).where("r <= 5").select("user_id", "event_id")


@query(f"WITH {_SM}, c AS (SELECT user_id, event_id, sum(round(p, 9)) OVER (PARTITION BY user_id ORDER BY event_id) AS upto, round(p, 9) AS p FROM sm), u AS (SELECT user_id, max(upto) * ('0x' || substr(md5('7:' || user_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM c GROUP BY user_id) SELECT c.user_id, min(event_id) AS event_id FROM c JOIN u ON c.user_id = u.user_id AND upto > u GROUP BY c.user_id")
def sample_row(spark, sf):
    """One row of each user, drawn by its probability: the first whose cumulated probability passes a number that md5 gives the user."""
    upto = F.sum(F.round("p", 9)).over(W.partitionBy("user_id").orderBy("event_id"))
    c = _softmax(spark, sf).withColumn("upto", upto)
    u = F.conv(F.substring(F.md5(F.concat(F.lit("7:"), F.col("user_id").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    c = c.withColumn("u", F.max("upto").over(W.partitionBy("user_id")) * u)
    return c.where("upto > u").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("SELECT event_type, arg_max(event_id, {'v': value, 'i': -event_id}) AS event_id, max(value) AS value FROM events WHERE value IS NOT NULL GROUP BY event_type")
def best_rows(spark, sf):
    """The row of the greatest value of each type (ties to the lowest id)."""
    e = spark.read.parquet(f"{sf}/events.parquet").where("value is not null")
    return e.groupBy("event_type").agg(F.max_by("event_id", F.struct(F.col("value"), -F.col("event_id"))).alias("event_id"), F.max("value").alias("value"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS pooled FROM events WHERE value IS NOT NULL")
def avg_pool(spark, sf):
    """Centred average of 5 with zero padding."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 2)
    return spark.read.parquet(f"{sf}/events.parquet").where("value is not null").select("event_id", F.round(F.sum("value").over(w) / 5, 6).alias("pooled"))


@query(f"WITH {BASE}, {CODES}, d AS (SELECT vec_id, x, {_dec()} AS y FROM coded), m AS (SELECT {_l2('x', 'y')} / 64 AS mse, {_dot('x', 'y')} / (sqrt({_sq('x')}) * sqrt({_sq('y')})) AS cos, sqrt({_l2('x', 'y')} / {_sq('x')}) AS rel FROM d) SELECT round(avg(mse), 12) AS mse, round(avg(sqrt(mse)), 9) AS rmse, round(avg(cos), 9) AS avg_cosine, round(min(cos), 9) AS min_cosine, round(avg(rel), 9) AS relative FROM m")
def reconstruction_error(spark, sf):
    y = V.sq8_decode(F.col("code"), F.col("lo"), F.col("hi"))
    d = _codes(spark, sf).select("x", y.alias("y")).select((V.l2sq(F.col("x"), F.col("y")) / D).alias("mse"), V.cosine(F.col("x"), F.col("y")).alias("cos"), F.when(V.norm(F.col("x")) > 1e-10, F.sqrt(V.l2sq(F.col("x"), F.col("y")) / V.norm_sq(F.col("x")))).otherwise(0.0).alias("rel"))
    return d.agg(F.round(F.avg("mse"), 12).alias("mse"), F.round(F.avg(F.sqrt("mse")), 9).alias("rmse"), F.round(F.avg("cos"), 9).alias("avg_cosine"), F.round(F.min("cos"), 9).alias("min_cosine"), F.round(F.avg("rel"), 9).alias("relative"))


@query(f"WITH {BASE}, {CODES}, y AS (SELECT vec_id, x, {_dec()} AS y FROM coded) SELECT round(corr({_dot('x', 'qv')}, {_dot('y', 'qv')}), 9) AS pearson FROM y, q")
def attention_correlation(spark, sf):
    """Scores of keys and of the same keys after 8-bit codes, over all queries."""
    y = _codes(spark, sf).select("vec_id", "x", V.sq8_decode(F.col("code"), F.col("lo"), F.col("hi")).alias("y"))
    return spark.createDataFrame([(S.score_correlation(y, probe_set(vectors(spark, sf)), D),)], "pearson double").select(F.round("pearson", 9).alias("pearson"))


@query(f"WITH {BASE}, f AS (SELECT i, j, avg(x[i] * x[j]) - avg(x[i]) * avg(x[j]) AS cov FROM v, range(1, 65) a(i), range(1, 65) b(j) GROUP BY ALL) SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(cov, 9) AS cov FROM f")
def covariance(spark, sf):
    """The Gram aggregate behind the learned rotations."""
    from vecforge.operators import transforms

    return transforms.covariance(vectors(spark, sf), D)


# --- text metrics -------------------------------------------------------------------------------------------------

_NORM = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[!\"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '\s+'), lambda t: t NOT IN ('', 'a', 'an', 'the')), ' ')"
_TURNS = "p AS (SELECT a.conv_id, a.turn, a.text AS prediction, b.text AS truth FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL)"


def _turns(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("text is not null")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("truth"))
    return c.select("conv_id", "turn", F.col("text").alias("prediction")).join(b, ["conv_id", "turn"])


@query(f"SELECT conv_id, turn, {_NORM.format('text')} AS answer FROM conversations")
def normalize_answer(spark, sf):
    return spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", T.normalize_answer(F.col("text")).alias("answer"))


@query(f"WITH {_TURNS}, w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array({_NORM.format('prediction')}, '\\s+'), lambda t: t <> '') AS a, list_filter(regexp_split_to_array({_NORM.format('truth')}, '\\s+'), lambda t: t <> '') AS b FROM p), c AS (SELECT conv_id, turn, a, b, coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda s: s = t)), len(list_filter(b, lambda s: s = t))))), 0) AS common FROM w) SELECT conv_id, turn, round(CASE WHEN common > 0 THEN 2 * common / (len(a) + len(b)) ELSE 0.0 END, 6)::DOUBLE AS f1 FROM c")
def token_f1(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.round(T.qa_f1_score(F.col("prediction"), F.col("truth")), 6).alias("f1"))


@query("SELECT event_id, CASE WHEN len(regexp_extract_all(props, '\\d+')) > 0 THEN round(len(list_filter(regexp_extract_all(props, '\\d+'), lambda n: n = CAST(user_id % 10 AS VARCHAR))) / len(regexp_extract_all(props, '\\d+')), 6) ELSE 0.0 END::DOUBLE AS score FROM events")
def count_score(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.round(T.count_score(F.col("props"), (F.col("user_id") % 10).cast("string")), 6).alias("score"))


@query("SELECT event_id, CASE WHEN len(regexp_extract_all(props, '\\d+')) > 0 THEN round(len(list_filter(regexp_extract_all(props, '\\d+'), lambda n: n = CAST(user_id % 10 AS VARCHAR))) / len(regexp_extract_all(props, '\\d+')), 6) ELSE 0.0 END::DOUBLE AS score FROM events")
def retrieval_score(spark, sf):
    """Share of a text's numbers that name the paragraph."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", F.round(T.retrieval_score(F.col("props"), F.concat(F.lit("Paragraph "), (F.col("user_id") % 10).cast("string"))), 6).alias("score"))


@query("WITH h AS (SELECT event_id, event_type, list_filter(['click', 'view', 'purchase', 'error', 'signup'], lambda c: contains(props || ' ' || event_type, c) AND NOT (contains(event_type, c) AND c <> event_type)) AS hit FROM events) SELECT event_id, CASE WHEN list_contains(hit, event_type) THEN round(1.0 / len(hit), 6) ELSE 0.0 END::DOUBLE AS score FROM h")
def classification_score(spark, sf):
    classes = F.array(*[F.lit(c) for c in ("click", "view", "purchase", "error", "signup")])
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.coalesce(F.round(T.classification_score(F.concat("props", F.lit(" "), "event_type"), F.col("event_type"), classes), 6), F.lit(0.0)).alias("score"))


def _persisted(spark, sf, kind):
    """Built, written partitioned by list, read again and searched; the folder is deleted when the session's Python ends."""
    index, q = _inverted(spark, sf, kind)
    path = store.scratch(spark, "index")
    index.save(path)
    return S.final(E.load(spark, path, kind).search(q, K, NPROBE, REFINE))


@query(_SQL["rabitq_ivf_sq8_knn"])
def persisted_ivf_knn(spark, sf):
    return _persisted(spark, sf, "SignIVF")


@query(_SQL["tq_ivf_sq8_knn"])
def persisted_tq_ivf_knn(spark, sf):
    return _persisted(spark, sf, "BookIVF")


@query(_SQL["tq4_sq8_knn"])
def persisted_tq_flat_knn(spark, sf):
    v, q = _both(spark, sf)
    path = store.scratch(spark, "index")
    E.build(v, "BookFlat", D).save(path)
    return S.final(E.load(spark, path, "BookFlat").search(q, K, refine=REFINE))
