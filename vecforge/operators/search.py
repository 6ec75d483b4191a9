"""Search: candidates with an estimated distance, the best of each query, refined by 8-bit codes."""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecforge.functions import vector as V

from . import engine as E
from . import models as M


#: Queries of some hundred dimensions that are broadcast at most.
MOST_QUERIES = 16_000


def best(df: DataFrame, k: int, dist: str = "dist", ascending: bool = True) -> DataFrame:
    """(qid, rank, vec_id, dist) of the k best rows of each query, ties by vec_id. The limit is pushed below the exchange."""
    order = F.col(dist) if ascending else F.col(dist).desc()
    return df.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(order, "vec_id"))).where(F.col("rank") <= k)


def final(df: DataFrame, dist: str = "dist") -> DataFrame:
    return df.select("qid", "rank", "vec_id", F.round(dist, 6).alias("dist"))


def pairs(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Every vector with every query of a stated set, which is broadcast only if its counted size allows that."""
    return vectors.crossJoin(F.broadcast(queries) if queries.count() <= MOST_QUERIES else queries)


#: Rows and queries of a pair of blocks whose every pair is a row of the result.
PAIR_ROWS, PAIR_QUERIES = 1024, 512


def whole(a: Column, d: int) -> Column:
    """Whether a has d components, all finite."""
    return F.coalesce((F.size(a) == d) & F.forall(a, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))


def rounded(v: np.ndarray, places: int = 6) -> np.ndarray:
    """v as F.round rounds it: half up by the shortest decimal form."""
    w = v * 10.0**places
    r = np.rint(w)
    out = r / 10.0**places + 0.0
    for i in np.flatnonzero((np.abs(np.abs(w - r) - 0.5) < 1e-9 + np.abs(w) * 1e-15) | ~(np.abs(w) < 2.0**50)):
        if np.isfinite(v[i]):
            out[i] = float(decimal.Decimal(repr(float(v[i]))).quantize(decimal.Decimal(1).scaleb(-places), decimal.ROUND_HALF_UP, _DIGITS)) + 0.0
        else:
            out[i] = v[i]
    return out


#: Wide enough for any double.
_DIGITS = decimal.Context(prec=400)


class Scores:
    """How a score follows from a sum over dimensions: s is the sum of a * b, or of (a - b)^2 where differences is set; u and m are numbers of
    the row, w of the query. joined(s, u, m, w) is the score in numpy, in the order of the Column expression slow(a, b, u, m, w);
    slope(u, m, w) bounds its derivative by s. Where the score is times(u, m) * (sum of a * b) + u + w, or with differences the sum itself,
    the matrix product gives it at once; least is what a score is at least."""

    def __init__(self, slow, joined=None, slope=None, differences: bool = False, times=None, least: float | None = None):
        self.slow, self.joined, self.slope, self.differences = slow, joined or (lambda s, u, m, w: s), slope or (lambda u, m, w: 1.0), differences
        self.times, self.least, self.bare = times, least, joined is None

    def sums(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return E.ordered((a - b) ** 2 if self.differences else a * b)

    def off(self, v: dict, q: dict) -> np.ndarray:
        """For each query how far any rough score may be off."""
        if "most" not in v:
            v["most"] = (v["a"] * v["a"]).sum(axis=1).max()
        b2 = (q["b"] * q["b"]).sum(axis=1)
        size = v["most"] + b2 if self.differences else np.sqrt(v["most"] * b2)
        with np.errstate(all="ignore"):
            steep = self.slope(v["u"][None], v["m"][None], q["w"][:, None])
            steep = np.abs(steep).max(axis=1) if np.ndim(steep) else steep
            off = 8 * v["a"].shape[1] * np.finfo(float).eps * (steep * size + np.abs(v["u"]).max() + np.abs(q["w"]))
        return np.where(np.isfinite(off), off, np.inf)

    def linear(self, v: dict, q: dict) -> tuple[np.ndarray, np.ndarray]:
        """Matrices (queries, d + 2) and (d + 2, rows) whose product is the score, without its least; the one of the rows is kept with them."""
        if "linear" not in v:
            times, u = (-2.0, (v["a"] * v["a"]).sum(axis=1)) if self.differences else (self.times(v["u"], v["m"]), v["u"])
            v["linear"] = np.concatenate([(v["a"] * np.broadcast_to(times, len(u))[:, None]).T, u[None], np.ones((1, len(u)))])
        w = (q["b"] * q["b"]).sum(axis=1) if self.differences else q["w"]
        return np.concatenate([q["b"], np.ones((len(w), 1)), w[:, None]], axis=1), v["linear"]

    def rough(self, v: dict, q: dict) -> np.ndarray:
        """Scores (queries, rows) by a matrix product."""
        with np.errstate(all="ignore"):
            if self.times or self.bare and self.differences:
                b, a = self.linear(v, q)
                s = b @ a
                return s if self.least is None else np.maximum(s, self.least, out=s)
            s = q["b"] @ v["a"].T
            if self.differences:
                s *= -2
                s += (v["a"] * v["a"]).sum(axis=1)[None]
                s += (q["b"] * q["b"]).sum(axis=1)[:, None]
            return self.joined(s, v["u"][None], v["m"][None], q["w"][:, None])


def _packed(df: DataFrame, columns: dict[str, str], size: int) -> DataFrame:
    return E._blocks(df.withColumn("cluster_id", F.lit(0)), "cluster_id", size, columns, sort=False).drop("cluster_id")


def _block_pairs(rows: DataFrame, queries: DataFrame, most: int | None = None) -> DataFrame:
    """Blocks of rows (vec_id, a, and numbers) with blocks of queries (qid, b, and numbers; at most so many, if known), dealt evenly to the cores."""
    r = _packed(rows, {"vec_id": "int64", "a": "vector"} | {c: "float64" for c in rows.columns if c not in ("vec_id", "a")}, PAIR_ROWS)
    q = _packed(queries, {"qid": "int64", "b": "vector"} | {c: "float64" for c in queries.columns if c not in ("qid", "b")}, PAIR_QUERIES).withColumnRenamed("n", "nq")
    r = r.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
    return r.crossJoin(F.broadcast(q) if (queries.count() if most is None else most) <= MOST_QUERIES else q)


def _parts(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[dict, dict]]:
    """The arrays of a block of rows and of a block of queries, by name, for all pairs of blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            rows = {k: np.frombuffer(row[k], np.int64 if k == "vec_id" else "<f8") for k in list(row)[: list(row).index("qid")] if k not in ("n", "nq")}
            asked = {k: np.frombuffer(row[k], np.int64 if k == "qid" else "<f8") for k in row if k not in rows and k not in ("n", "nq")}
            rows["a"] = rows["a"].reshape(-1, d)
            asked["b"] = asked["b"].reshape(-1, d)
            yield rows, asked


def _some(asked: dict) -> Iterator[tuple[int, dict]]:
    """64 queries at a time, whose scores stay in a core's cache."""
    for at in range(0, len(asked["qid"]), 64):
        yield at, {k: v[at : at + 64] for k, v in asked.items()}


def _measured(scores: Scores, rows: dict, asked: dict, r: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scores of queries r with rows at, summed in index order."""
    out = np.empty(len(r))
    for k in range(0, len(r), E.MEASURED):
        p, q = r[k : k + E.MEASURED], at[k : k + E.MEASURED]
        with np.errstate(all="ignore"):
            out[k : k + E.MEASURED] = scores.joined(scores.sums(rows["a"][q], asked["b"][p]), rows["u"][q], rows["m"][q], asked["w"][p])
    return out


def scored(rows: DataFrame, queries: DataFrame, scores: Scores, name: str, d: int) -> DataFrame:
    """(qid, vec_id, name): the score, rounded to six places, of every row (vec_id, a, and numbers u and m) with every query (qid, b, and a number w).

    Blocks of both are scored by a matrix product; a score that this might round to another sixth place is summed again in index order.
    Rows and queries without d finite components, or without finite numbers, go by the Column expression.
    """
    for c in "um":
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(0.0))
    queries = queries if "w" in queries.columns else queries.withColumn("w", F.lit(0.0))
    rows, queries = rows.select("vec_id", "a", "u", "m"), queries.select("qid", "b", "w")
    plain = whole(F.col("a"), d) & whole(F.array("u", "m"), 2) & F.col("vec_id").isNotNull()
    asked = whole(F.col("b"), d) & whole(F.array("w"), 1) & F.col("qid").isNotNull()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, asked in _parts(batches, d):
            out = np.empty((len(asked["qid"]), len(v["vec_id"])))
            for i, q in _some(asked):
                e, own, off = scores.rough(v, q), out[i : i + 64], scores.off(v, q)
                with np.errstate(all="ignore"):
                    e *= 1e6
                    np.rint(e, out=own)
                    top = np.maximum(own.max(axis=1), -own.min(axis=1)) + 1
                    e -= own
                    np.abs(e, out=e)
                    sure = 0.5 - 1e-9 - 1e6 * off - 1e-15 * top
                    sure[~(top < 2.0**50)] = -1
                    own /= 1e6
                    own += 0.0
                doubt = np.flatnonzero(~(e.max(axis=1) < sure))
                if len(doubt):
                    r, at = np.nonzero(~(e[doubt] < sure[doubt, None]))
                    r = doubt[r]
                    own[r, at] = rounded(_measured(scores, v, q, r, at))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked["qid"], len(v["vec_id"]))), pa.array(np.tile(v["vec_id"], len(out))), pa.array(out.ravel())], ["qid", "vec_id", name])

    fast = _block_pairs(rows.where(plain), queries.where(asked)).mapInArrow(run, f"qid long not null, vec_id long not null, {name} double not null")
    if not (rows.where(~plain).isEmpty() and queries.where(~asked).isEmpty()):
        odd = pairs(rows.where(~plain), queries).unionAll(pairs(rows.where(plain), queries.where(~asked)))
        fast = fast.unionAll(odd.select("qid", "vec_id", F.round(scores.slow(*(F.col(c) for c in "abumw")), 6).alias(name)))
    return fast


L2 = Scores(lambda a, b, u, m, w: V.l2sq(a, b), differences=True)
DOT = Scores(lambda a, b, u, m, w: V.dot(a, b))
#: u and w are norms.
COSINE = Scores(
    lambda a, b, u, m, w: V.cosine(a, b),
    lambda s, u, m, w: np.where(u * w > 1e-20, s / (u * w), 0.0),
    lambda u, m, w: 1 / (u * w),
)
#: Codes and queries in units of them; u is the sum of squared steps, m their number.
SQ8_QUERY = Scores(lambda a, b, u, m, w: V.l2sq(a, b) * u / m, lambda s, u, m, w: s * u / m, lambda u, m, w: u / m, differences=True)
class Tables(Scores):
    """a holds codes, b a query; for each query the squared distances to all centroids are computed once, and looked up in index order."""

    def __init__(self, centroids: np.ndarray):
        values = [float(c) for c in centroids]
        super().__init__(lambda a, b, u, m, w: V.table_distance(V.split_tables(b, F.array(*(F.lit(c) for c in values))), a.cast("array<int>")))
        self.centroids = np.array(values)

    def sums(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return E.ordered((self.centroids[a.astype(int)] - b) ** 2)

    def off(self, v: dict, q: dict) -> np.ndarray:
        return np.zeros(len(q["b"]))

    def rough(self, v: dict, q: dict) -> np.ndarray:
        tables, codes = (self.centroids - q["b"][:, :, None]) ** 2, v["a"].astype(np.intp)
        out = np.zeros((len(tables), len(codes)))
        for i in range(codes.shape[1]):
            out += np.take(tables[:, i], codes[:, i], axis=1)
        return out


def signs(d: int) -> Scores:
    """a holds signs, b the query's residual; u is the row's n2, m its multiplier, w the residual's squared norm."""
    return Scores(
        lambda a, b, u, m, w: F.greatest(F.lit(0.0), u + w - 2 * m * (V.dot(a, b) / d**0.5)),
        lambda s, u, m, w: np.maximum(u + w - 2 * m * (s / d**0.5), 0.0),
        lambda u, m, w: 2 * m / d**0.5,
        times=lambda u, m: -2 * m / d**0.5,
        least=0.0,
    )


#: a holds levels, b the query's residual; u and m are the row's factors, w the residual's squared norm.
MULTIBIT = Scores(lambda a, b, u, m, w: F.greatest(F.lit(0.0), w + u + m * V.dot(a, b)), lambda s, u, m, w: np.maximum(w + u + m * s, 0.0), lambda u, m, w: m, times=lambda u, m: m, least=0.0)


def exact(vectors: DataFrame, queries: DataFrame, k: int = 10, where: Column | None = None) -> DataFrame:
    v = vectors if where is None else vectors.where(where)
    return best(pairs(v, queries).select("qid", "vec_id", V.l2sq(F.col("x"), F.col("qv")).alias("dist")), k)


def sq8_codes(vectors: DataFrame, model: DataFrame) -> DataFrame:
    return vectors.crossJoin(F.broadcast(model)).withColumn("code", V.sq8_encode(F.col("x"), F.col("lo"), F.col("hi")))


def rotated(df: DataFrame, x: str, out: str, matrix: list[list[float]]) -> DataFrame:
    """df with out = matrix x / |x|."""
    return df.crossJoin(M.row(df.sparkSession, rot=matrix)).withColumn(out, V.let(V.normalize(F.col(x)), lambda u: V.matvec(F.col("rot"), u))).drop("rot")


def book_codes(vectors: DataFrame, matrix: list[list[float]], centroids: list[float], boundaries: list[float]) -> DataFrame:
    z = rotated(vectors, "x", "z", matrix).crossJoin(M.row(vectors.sparkSession, cents=centroids, bounds=boundaries))
    return z.withColumn("tq", V.book_encode(F.col("z"), F.col("bounds"))).drop("bounds")


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(qid, qv, cluster_id, rank, dist, c): the nearest clusters of each query."""
    each = queries.crossJoin(F.broadcast(centroids)).select("qid", "qv", F.posexplode("ms").alias("cluster_id", "c")).withColumn("dist", V.l2sq(F.col("c"), F.col("qv")))
    return each.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("dist", "cluster_id"))).where(F.col("rank") <= nprobe)


def recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Share of the true neighbours found."""
    n = truth.select("qid").distinct().count()
    return results.join(truth.select("qid", "vec_id"), ["qid", "vec_id"], "left_semi").agg((F.count("*") / (n * k)).alias("recall"), F.lit(n).cast("long").alias("nq"))


def sign_sides(vectors: DataFrame, queries: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
    """Sign codes about the mean and residuals of queries, as scored() takes them; half: the error bound at a query one from the mean."""
    c = M.row(vectors.sparkSession, c=list(M.mean(vectors).first()["c"] or [0.0] * d))
    coded = vectors.crossJoin(c).select("vec_id", V.sign_encode(F.col("x"), F.col("c")).alias("s"))
    half = V.sign_error(F.col("s"), F.array(F.lit(1.0)), F.array(F.lit(0.0)), d)
    rows = coded.select("vec_id", F.transform("s.signs", lambda s: F.when(s == 1, 1.0).otherwise(-1.0)).alias("a"), F.col("s.n2").alias("u"), V.sign_dp(F.col("s"), d).alias("m"), half.alias("half"))
    q = queries.crossJoin(c).select("qid", V.minus(F.col("qv"), F.col("c")).alias("b"))
    return rows, q.withColumn("w", V.norm_sq(F.col("b")))


#: Queries whose best scores a task holds at most.
HELD = 100_000


def _best_scores(rows: DataFrame, queries: DataFrame, scores: Scores, k: int, d: int, most: int | None = None) -> DataFrame:
    """(qid, dist): of the rows of each task the k least scores of each query."""

    full = HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for qid, best in held.values():
                r, at = np.nonzero(~np.isposinf(best))
                yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(best[r, at])], ["qid", "dist"])

        for v, asked in _parts(batches, d):
            key = asked["qid"].tobytes()
            if key not in held:
                if sum(len(qid) for qid, _ in held.values()) >= full:
                    yield from told()
                    held.clear()
                held[key] = asked["qid"], np.full((len(asked["qid"]), k), np.inf)
            for i, q in _some(asked):
                e, best = scores.rough(v, q), held[key][1][i : i + 64]
                n, groups = e.shape[1], 2 * k
                # k rows of different groups are at most the k-th least of the groups' least
                limit = best[:, -1]
                if n >= groups:
                    least = np.minimum.reduceat(e, np.arange(groups) * n // groups, axis=1)
                    limit = np.fmin(limit, np.partition(least, k - 1, axis=1)[:, k - 1])
                r, at = np.nonzero(~(e > (limit + 2 * scores.off(v, q))[:, None]))
                if not len(r):
                    continue
                own = _measured(scores, v, q, r, at)
                some = np.unique(r)
                every = np.concatenate([r, np.repeat(some, k)])
                own = np.concatenate([own, best[some].ravel()])
                o = np.lexsort((own, every))
                rank = np.arange(len(o)) - np.searchsorted(every[o], every[o])
                best[some] = own[o[rank < k]].reshape(-1, k)
        yield from told()

    return _block_pairs(rows, queries, most).mapInArrow(run, "qid long, dist double")


def error_filter(vectors: DataFrame, queries: DataFrame, d: int, k: int = 10) -> DataFrame:
    """Survivors (qid, vec_id) whose lower bound of the estimate is under the k-th best estimate: those a full pass must look at."""
    rows, q = sign_sides(vectors, queries, d)
    estimate, asked = signs(d), q.count()
    least = _best_scores(rows.drop("half"), q, estimate, k, d, asked)
    kth = least.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("dist"))).where(F.col("rank") <= k).groupBy("qid").agg(F.max("dist").alias("kth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, block in _parts(batches, d):
            for _, q in _some(block):
                b, a = estimate.linear(v, q)
                if "low" not in v:
                    v["low"] = np.concatenate([a, -v["half"][None]])
                # the estimate less its width and the limit; an estimate or bound under 0 counts as 0, which is under any limit but 0
                b[:, -1] -= q["kth"]
                away = np.sqrt(q["w"])
                low = np.concatenate([b, away[:, None]], axis=1) @ v["low"]
                slack = 2 * estimate.off(v, q) + 1e-13 * (v["half"].max() * away + q["kth"])
                under, maybe = low < -slack[:, None], ~(low > slack[:, None])
                if np.count_nonzero(under) != np.count_nonzero(maybe):
                    r, at = np.nonzero(maybe & ~under)
                    under[r, at] = np.maximum(_measured(estimate, v, q, r, at) - v["half"][at] * away[r], 0.0) < q["kth"][r]
                under[~(q["kth"] > 0)] = False
                r, at = np.nonzero(under)
                yield pa.RecordBatch.from_arrays([pa.array(q["qid"][r]), pa.array(v["vec_id"][at])], ["qid", "vec_id"])

    # counting the joined queries would find the limits once more
    return _block_pairs(rows, q.join(kth, "qid"), asked).mapInArrow(run, "qid long, vec_id long")


def _spread(df: DataFrame, *columns: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, mean of the columns' joined vectors, and their centred Gram matrix, from one row of sums a partition."""

    def summed(f) -> tuple[int, np.ndarray]:
        def run(batches: Iterator) -> Iterator:
            n, total = 0, None
            for b in batches:
                if len(b):
                    s = f(np.concatenate([M.matrix(b[c]) for c in columns], axis=1))
                    n, total = n + len(b), s if total is None else total + s
            if n:
                yield pd.DataFrame({"n": [n], "s": [total.ravel()]})

        sums = df.select(*columns).mapInPandas(run, "n long, s array<double>").select("n", F.posexplode("s").alias("i", "e"))
        got = sorted(sums.groupBy("i").agg(F.sum("n"), F.sum("e")).collect())
        return (got[0][1] if got else 0), np.array([r[2] for r in got])

    n, total = summed(lambda x: x.sum(axis=0))
    mean = total / max(1, n)
    _, gram = summed(lambda x: (x - mean).T @ (x - mean))
    return n, mean, gram.reshape(len(mean), len(mean))


def score_correlation(keys: DataFrame, queries: DataFrame, d: int) -> float | None:
    """The correlation of <x, qv> and <y, qv> over every key (x, y) with every query (qv), null where either doesn't vary.

    With x = mean + dx and qv = mean + dq the score's deviation is <mean x, dq> + <dx, mean q> + <dx, dq>, whose products sum
    over all pairs to products of means and Gram matrices: no pair is made.
    """
    n, mean, gram = _spread(keys, "x", "y")
    nq, at, around = _spread(queries, "qv")
    if not n or not nq:
        return None

    def product(i: int, j: int) -> float:
        g = gram[i * d : (i + 1) * d, j * d : (j + 1) * d]
        return n * mean[i * d : (i + 1) * d] @ around @ mean[j * d : (j + 1) * d] + nq * at @ g @ at + (g * around).sum()

    size = (product(0, 0) * product(1, 1)) ** 0.5
    return float(product(0, 1) / size) if size > 0 else None
