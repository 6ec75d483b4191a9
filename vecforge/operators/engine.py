"""Indexes with packed codes: build, search, insert, delete, save and load, for flat and inverted-list forms of all quantisers.

Raw kinds keep vectors in single precision, as they come. Rows of an index are (vec_id, cluster_id, code BINARY, n2, l1, o2 DOUBLE, sq8 BINARY); its models are small arrays whose size
depends on parameters alone. A search packs rows and queries into blocks and scores each pair of blocks by one matrix product:
a pair of blocks is a row of a join, so neither side is ever held whole, and the window that ranks sees a few candidates a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import models as M
from . import store

KINDS = ("RawFlat", "SQ8Flat", "SignFlat", "BookFlat", "RawIVF", "SignIVF", "BookIVF", "PQIVF")
METRICS = ("l2", "ip")
#: Rows in a block of the index and of queries.
ROWS, QUERIES = 4096, 512
#: Pairs that a search measures again at once.
MEASURED = 65_536
#: A side of a join is broadcast only under so many bytes, counted.
BROADCAST_BYTES = 16 << 20
_ROW = "vec_id long, cluster_id int, code binary, n2 double, l1 double, o2 double, sq8 binary"


def pack_bits(codes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of codes of `bits` bits each as bytes, the first code in the highest bits; the last byte is filled with zeros."""
    wide = (codes[:, :, None].astype(np.uint16) >> np.arange(bits - 1, -1, -1, dtype=np.uint16)) & 1
    return np.packbits(wide.reshape(len(codes), -1).astype(np.uint8), axis=1)


def unpack_bits(packed: np.ndarray, bits: int, d: int) -> np.ndarray:
    wide = np.unpackbits(packed, axis=1)[:, : d * bits].reshape(len(packed), d, bits)
    return (wide.astype(np.int64) << np.arange(bits - 1, -1, -1)).sum(axis=2)


def ordered(a: np.ndarray) -> np.ndarray:
    """Sums of the rows of a in index order: the same bits for equal rows, and those of V.total."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i]
    return out


@dataclass(frozen=True)
class Models:
    """What a quantiser has learned: centroids (one row: the mean, for flat sign codes), 8-bit ranges of each, rotation and
    codebook, a linear transform that all vectors and queries go through before, and a product quantiser's centroids (parts, k,
    d / parts) for what a vector differs from its list's centroid."""

    centroids: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None
    rotation: np.ndarray | None = None
    cents: np.ndarray | None = None
    bounds: np.ndarray | None = None
    before: np.ndarray | None = None
    books: np.ndarray | None = None

    def rotated(self, x: np.ndarray) -> np.ndarray:
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return (x / np.where(n > 1e-10, n, 1)) @ self.rotation.T


_matrix, nearest = M.matrix, M.nearest


def encode(kind: str, bits: int, models: Models, x: np.ndarray, cluster: np.ndarray) -> dict[str, np.ndarray | list]:
    """Columns of an index's rows for vectors x of the given clusters. Sums run in index order: a copy's estimate is a difference of
    equal numbers, so whether it is 0 or just above, and with it the order of near copies, hangs on the last bit."""
    r = x - models.centroids[cluster] if kind.startswith("Sign") else np.zeros_like(x)
    if kind.startswith("Sign"):
        code = [c.tobytes() for c in np.packbits(r > 0, axis=1)]
    elif kind.startswith("Book"):
        code = [c.tobytes() for c in pack_bits(np.searchsorted(models.bounds, models.rotated(x), side="left"), bits)]
    elif kind.startswith("PQ"):
        own, w = x - models.centroids[cluster], models.books.shape[2]
        code = [c.tobytes() for c in np.stack([nearest(own[:, p * w : (p + 1) * w], b) for p, b in enumerate(models.books)], axis=1).astype(np.uint8)]
    elif kind.startswith("Raw"):
        code = [v.tobytes() for v in np.ascontiguousarray(x, "<f4")]
    else:
        code = [None] * len(x)
    sq8 = [None] * len(x)
    if models.lo is not None:
        lo, hi = models.lo[cluster], models.hi[cluster]
        sq8 = [c.tobytes() for c in np.floor(np.clip((x - lo) / (hi - lo), 0, 1) * 255).astype(np.uint8)]
    return {"code": code, "n2": ordered(r * r), "l1": ordered(np.abs(r)), "o2": ordered(x * x), "sq8": sq8}


def transformed(df: DataFrame, a: np.ndarray | None, *columns: str) -> DataFrame:
    """df (a long and a vector column) with the vectors multiplied by a."""
    if a is None:
        return df

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({columns[0]: b[columns[0]], columns[1]: list(_matrix(b[columns[1]]) @ a.T)})

    return df.select(*columns).mapInPandas(run, f"{columns[0]} long, {columns[1]} array<double>")


def encoded(vectors: DataFrame, kind: str, bits: int, models: Models) -> DataFrame:
    """Index rows of vectors (vec_id, x), in one pass without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _matrix(b["x"])
                cluster = nearest(x, models.centroids) if kind.endswith("IVF") else np.zeros(len(x), np.int32)
                yield pd.DataFrame({"vec_id": b["vec_id"].to_numpy(), "cluster_id": cluster, **encode(kind, bits, models, x, cluster)})

    return vectors.select("vec_id", "x").mapInPandas(run, _ROW)


def _ranges(vectors: DataFrame, centroids: np.ndarray | None, k: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each cluster and dimension, from one row a partition and cluster; ranges under 1e-6 are widened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lo, hi = np.full((k, d), np.inf), np.full((k, d), -np.inf)
        for b in batches:
            if len(b):
                x = _matrix(b["x"])
                c = nearest(x, centroids) if centroids is not None else np.zeros(len(x), int)
                np.minimum.at(lo, c, x)
                np.maximum.at(hi, c, x)
        at = np.flatnonzero(np.isfinite(lo[:, 0]))
        if len(at):
            yield pd.DataFrame({"c": at.astype("int32"), "lo": list(lo[at]), "hi": list(hi[at])})

    got = vectors.select("x").mapInPandas(run, "c int, lo array<double>, hi array<double>")
    got = got.select("c", F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "p")).groupBy("c", "i").agg(F.min("p.lo").alias("lo"), F.max("p.hi").alias("hi")).collect()
    lo, hi = np.zeros((k, d)), np.full((k, d), 1e-6)
    for c, i, a, b in got:
        lo[c, i], hi[c, i] = a, b if b - a >= 1e-6 else a + 1e-6
    return lo, hi


def _blocks(df: DataFrame, key: str, size: int, columns: dict[str, str], sort: bool) -> DataFrame:
    """Rows packed into blocks of at most `size` rows with equal key: (key, n, one binary for each column), without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def packed(part: pd.DataFrame) -> pd.DataFrame:
            out = {key: [part[key].iloc[0]], "n": [len(part)]}
            for c, kind in columns.items():
                v = part[c]
                out[c] = [None if v.iloc[0] is None else b"".join(v) if kind == "bytes" else np.stack(v.to_numpy()).astype("<f8").tobytes() if kind == "vector" else np.ascontiguousarray(v.to_numpy(), kind).tobytes()]
            return pd.DataFrame(out)

        for b in batches:
            for k, part in b.groupby(key, sort=False):
                if held and held[0][key].iloc[0] != k:
                    yield packed(pd.concat(held))
                    held = []
                held.append(part)
                while sum(map(len, held)) >= size:
                    whole = pd.concat(held)
                    yield packed(whole.iloc[:size])
                    held = [whole.iloc[size:]] if len(whole) > size else []
        if held:
            yield packed(pd.concat(held))

    rows = df.select(key, *columns)
    if sort:
        rows = rows.sortWithinPartitions(key)
    return rows.mapInPandas(run, f"{key} int, n int, " + ", ".join(f"{c} binary" for c in columns))


@dataclass(frozen=True)
class Index:
    """An index over rows; kind, d and metric as in its metadata."""

    kind: str
    d: int
    rows: DataFrame
    models: Models
    bits: int = 4
    metric: str = "l2"
    tombstones: DataFrame | None = None

    def _scorer(self, k: int, refine: int, radius: float | None):
        kind, d, bits, m, metric = self.kind, self.d, self.bits, self.models, self.metric
        sign = -1.0 if metric == "ip" else 1.0

        def decoded(code: bytes, n: int, c: int) -> np.ndarray:
            if kind.startswith("PQ"):
                at = np.frombuffer(code, np.uint8).reshape(n, -1)
                return m.centroids[c] + np.concatenate([b[at[:, p]] for p, b in enumerate(m.books)], axis=1)
            if kind.startswith("Raw"):
                return np.frombuffer(code, "<f4").reshape(n, d).astype(np.float64)
            p = len(m.rotation)
            return m.cents[unpack_bits(np.frombuffer(code, np.uint8).reshape(n, -1), bits, p)]

        def restored(sq8: bytes, n: int, c: int) -> np.ndarray:
            return m.lo[c] + np.frombuffer(sq8, np.uint8).reshape(n, d) * ((m.hi[c] - m.lo[c]) / 255)

        def true(x: np.ndarray, q: np.ndarray) -> np.ndarray:
            return ordered(x * q if metric == "ip" else (x - q) ** 2)

        def one(row) -> pd.DataFrame:
            n, nq, c = row.n, row.nq, row.cluster_id
            ids, qids = np.frombuffer(row.vec_id, np.int64), np.frombuffer(row.qid, np.int64)
            q = np.frombuffer(row.qv, "<f8").reshape(nq, d)
            if kind.startswith("Sign"):
                p = q - m.centroids[c]
                s = np.unpackbits(np.frombuffer(row.code, np.uint8).reshape(n, -1), axis=1)[:, :d].astype(np.float64) * 2 - 1
                n2, l1, o2 = (np.frombuffer(v) for v in (row.n2, row.l1, row.o2))
                nd = l1 * np.where(n2 < 1e-10, 1.0, 1 / np.sqrt(np.maximum(n2, 1e-300))) / d**0.5
                dp = np.where(np.abs(nd) < 1e-10, 1.0, 1 / np.where(nd == 0, 1, nd)) * np.sqrt(n2)
                p2, q2 = ordered(p * p), ordered(q * q)

                def joined(dot: np.ndarray, r, at) -> np.ndarray:
                    e = n2[at] + p2[r] - 2 * dp[at] * (dot / d**0.5)
                    # the inner product follows from the distance and both norms
                    return -0.5 * (e - q2[r] - o2[at]) if metric == "ip" else np.maximum(e, 0)

                dist = joined(p @ s.T, (slice(None), None), (None, slice(None)))
                scale = n2.max() + p2 + 2 * dp.max() * np.sqrt(p2) + (q2 + o2.max() if metric == "ip" else 0)
            else:
                x = restored(row.sq8, n, c) if kind.startswith("SQ8") else decoded(row.code, n, c)
                z = m.rotated(q) if kind.startswith("Book") else q
                dist = z @ x.T
                x2, z2 = (x * x).sum(axis=1), (z * z).sum(axis=1)
                scale = x2.max() + z2
                if metric == "l2":
                    dist = x2[None] + z2[:, None] - 2 * dist
            if radius is not None:
                r, at = np.nonzero(sign * dist < sign * radius + 1e-9)
                exact = true(x[at], z[r]) if not kind.startswith("Sign") else joined(ordered(s[at] * p[r]), r, at)
                ok = sign * exact < sign * radius
                return pd.DataFrame({"qid": qids[r[ok]], "vec_id": ids[at[ok]], "dist": exact[ok], "fine": exact[ok]})
            most = min(n, k * refine if refine else k)
            # the matrix product rounds otherwise, and equal rows not equally: all that may be among the best are measured again, in index order
            least = np.partition(sign * dist, most - 1, axis=1)[:, most - 1] + 8 * d * np.finfo(float).eps * scale
            near = ~(sign * dist > least[:, None])
            part = np.cumsum(near.sum(axis=1)) // MEASURED
            out = []
            for some in np.split(np.arange(nq), np.flatnonzero(np.diff(part)) + 1):
                r, at = np.nonzero(near[some])
                r = some[r]
                own = joined(ordered(s[at] * p[r]), r, at) if kind.startswith("Sign") else true(x[at], z[r])
                o = np.lexsort((ids[at], sign * own, r))
                o = o[np.arange(len(o)) - np.searchsorted(r, r) < most]  # r is in order already
                r, at, own = r[o], at[o], own[o]
                fine = true(restored(row.sq8, n, c)[at], q[r]) if refine else own
                out.append(pd.DataFrame({"qid": qids[r], "vec_id": ids[at], "dist": own, "fine": fine}))
            return pd.concat(out)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for row in b.itertuples(index=False):
                    yield one(row)

        return run

    def _queries(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """Blocks of queries (cluster_id, nq, qid, qv), each query once for each list it probes."""
        centroids, ivf = self.models.centroids, self.kind.endswith("IVF")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not ivf or not len(b):
                    yield pd.DataFrame({"cluster_id": np.zeros(len(b), np.int32), "qid": b["qid"], "qv": b["qv"]})
                    continue
                q, m = _matrix(b["qv"]), min(nprobe, len(centroids))
                for a in range(0, len(q), step := max(1, 4_000_000 // max(1, centroids.size))):
                    dist = ((q[a : a + step, None, :] - centroids[None]) ** 2).sum(axis=2)
                    near = np.argsort(dist, axis=1, kind="stable")[:, :m]
                    yield pd.DataFrame({"cluster_id": near.ravel().astype(np.int32), "qid": np.repeat(b["qid"].to_numpy()[a : a + step], m), "qv": [q[a + i] for i in np.repeat(np.arange(len(near)), m)]})

        each = queries.select("qid", "qv").mapInPandas(run, "cluster_id int, qid long, qv array<double>")
        return _blocks(each, "cluster_id", QUERIES, {"qid": "int64", "qv": "vector"}, sort=ivf).withColumnRenamed("n", "nq")

    def live(self) -> DataFrame:
        return self.rows if self.tombstones is None else store.without(self.rows, self.tombstones)

    def _scored(self, queries: DataFrame, nprobe: int, k: int, refine: int, radius: float | None, where: Column | None) -> DataFrame:
        if not self.models.centroids.size and self.kind.endswith("IVF"):
            raise ValueError("the index has no lists")
        rows = self.live() if where is None else self.live().where(where)
        names = {"vec_id": "int64", "code": "bytes", "n2": "float64", "l1": "float64", "o2": "float64", "sq8": "bytes"}
        ivf = self.kind.endswith("IVF")
        own = self._queries(transformed(queries, self.models.before, "qid", "qv"), nprobe)
        if ivf:  # at most as many lists as the model has: prunes the partitions of a saved index
            rows = rows.where(F.col("cluster_id").isin([r[0] for r in own.select("cluster_id").distinct().collect()]))
        blocks = _blocks(rows, "cluster_id", ROWS, names, sort=ivf)
        if queries.count() * (min(nprobe, len(self.models.centroids)) if ivf else 1) * 8 * (1 + self.d) <= BROADCAST_BYTES:
            own = F.broadcast(own)
        # a stated set of queries against all rows, in blocks: few rows on either side, each a matrix
        pairs = blocks.join(own, "cluster_id") if ivf else blocks.crossJoin(own.drop("cluster_id"))
        return pairs.mapInPandas(self._scorer(k, refine, radius), "qid long, vec_id long, dist double, fine double")

    def search(self, queries: DataFrame, k: int = 10, nprobe: int = 8, refine: int = 10, where: Column | None = None) -> DataFrame:
        """(qid, rank, vec_id, dist): the k best rows of each query (qid, qv), ties to the lower vec_id.

        refine: k * refine candidates are ranked again by their 8-bit codes (0: not; without 8-bit codes: not). nprobe: lists of
        an inverted index that are searched. where: a condition on the rows' columns. Queries of a wrong length fail.
        """
        refine = refine if self.models.lo is not None and not self.kind.startswith(("Raw", "SQ8")) else 0
        if k < 1 or nprobe < 1 or refine < 0:
            raise ValueError("k and nprobe are at least 1, refine at least 0")
        order = (lambda c: F.col(c).desc()) if self.metric == "ip" else F.col
        found = self._scored(queries, nprobe, k, refine, None, where)
        if refine:
            found = found.withColumn("_n", F.row_number().over(W.partitionBy("qid").orderBy(order("dist"), "vec_id"))).where(F.col("_n") <= k * refine).drop("_n")
        ranked = found.select("qid", "vec_id", F.col("fine").alias("dist")).withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(order("dist"), "vec_id")))
        return ranked.where(F.col("rank") <= k).select("qid", "rank", "vec_id", "dist")

    def within(self, queries: DataFrame, radius: float, nprobe: int = 8) -> DataFrame:
        """(qid, vec_id, dist) of all rows nearer than the radius (inner product: greater than it)."""
        return self._scored(queries, nprobe, 1, 0, radius, None).select("qid", "vec_id", "dist")

    def insert(self, vectors: DataFrame) -> Index:
        """The index with new vectors (vec_id, x): assigned, encoded and appended; a vector whose id is there replaces it."""
        new = encoded(transformed(vectors, self.models.before, "vec_id", "x"), self.kind, self.bits, self.models)
        old = self.live().join(vectors.select("vec_id").distinct(), "vec_id", "left_anti")
        return replace(self, rows=old.unionByName(new), tombstones=None)

    def delete(self, ids: DataFrame) -> Index:
        """The index without the vectors of ids (vec_id)."""
        gone = ids.select("vec_id") if self.tombstones is None else self.tombstones.union(ids.select("vec_id"))
        return replace(self, tombstones=gone)

    def code(self, ids: DataFrame) -> DataFrame:
        """(vec_id, code, sq8) of ids that the index holds."""
        return self.live().join(ids.select("vec_id").distinct(), "vec_id").select("vec_id", "code", "sq8")

    def reconstructed(self) -> DataFrame:
        """(vec_id, x): vectors as their 8-bit codes, or else as their sign codes, tell."""
        m, d = self.models, self.d

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                c = b["cluster_id"].to_numpy()
                if m.lo is not None:
                    x = m.lo[c] + np.stack([np.frombuffer(v, np.uint8) for v in b["sq8"]]) * ((m.hi[c] - m.lo[c]) / 255)
                else:
                    s = np.stack([np.unpackbits(np.frombuffer(v, np.uint8))[:d] for v in b["code"]]) - 0.5
                    n2, l1 = b["n2"].to_numpy(), b["l1"].to_numpy()
                    x = m.centroids[c] + s * (2 * n2 / np.maximum(l1, 1e-30))[:, None]
                yield pd.DataFrame({"vec_id": b["vec_id"], "x": list(x)})

        return self.live().mapInPandas(run, "vec_id long, x array<double>")

    def stats(self) -> DataFrame:
        """index_type, d, rows, rows with 8-bit codes, and the bytes that codes, factors and 8-bit codes take."""
        factors = 16 if self.kind.startswith("Sign") else 0
        size = lambda c: F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).cast("long")
        return self.live().agg(
            F.lit(self.kind).alias("index_type"), F.lit(self.d).alias("d"), F.count("*").alias("ntotal"), F.count("sq8").alias("sq8_count"),
            size("code").alias("code_bytes"), (F.count("*") * factors).alias("factor_bytes"), size("sq8").alias("sq8_bytes"),
        )

    def save(self, path: str) -> None:
        """Rows partitioned by list, models, and last the metadata."""
        spark = self.rows.sparkSession
        rows = self.live()
        meta = store.IndexMeta(self.kind, self.d, rows.count(), 1 if self.kind.startswith("Sign") else self.bits, self.models.lo is not None, self.metric, len(self.models.centroids) if self.kind.endswith("IVF") else 0)
        arrays = {n: getattr(self.models, n) for n in ("centroids", "lo", "hi", "rotation", "cents", "bounds", "before", "books")}
        data = [(n, [float(v) for v in a.ravel()], list(a.shape)) for n, a in arrays.items() if a is not None]
        store.save_index(spark, path, rows, meta, {"models": spark.createDataFrame(data, "name string, v array<double>, shape array<int>").coalesce(1)})


def load(spark: SparkSession, path: str, kind: str | None = None) -> Index:
    """The saved index; another kind than asked for, or a count that its metadata doesn't tell, is refused."""
    rows, meta = store.load_index(spark, path, kind)
    models = Models(**{r["name"]: np.array(r["v"]).reshape(r["shape"]) for r in store.load_model(spark, path, "models").collect()})
    return Index(meta.index_type, meta.d, rows.select(*[c.split()[0] for c in _ROW.split(", ")]), models, meta.nbits if meta.index_type.startswith("Book") else 4, meta.metric)


def build(vectors: DataFrame, kind: str, d: int, bits: int = 4, sq8: bool = True, nlist: int = 16, rounds: int = 20, metric: str = "l2", seed: int = 42, centroids: np.ndarray | None = None, before: np.ndarray | None = None, parts: int = 8) -> Index:
    """Trains what the kind needs on vectors (vec_id, x) and encodes them. centroids: lists that are trained already (of transformed
    vectors); before: a d x d matrix that vectors and queries are multiplied by first, as a learned
    rotation; parts: of a product quantiser, each with 2 ** bits centroids (at most 256)."""
    if kind == "PQIVF" and (d % parts or not 1 <= bits <= 8):
        raise ValueError("parts divide d, and their codes have at most 8 bits")
    if kind not in KINDS or metric not in METRICS:
        raise ValueError(f"kind is one of {KINDS}, metric of {METRICS}")
    vectors = transformed(vectors, before, "vec_id", "x")
    if centroids is None:
        if kind.endswith("IVF"):
            centroids = np.array(M.kmeans(vectors, nlist, rounds, seed).first()["ms"]).reshape(-1, d)
        elif kind == "SignFlat":
            centroids = np.array(M.mean(vectors).first()["c"] or [0.0] * d).reshape(1, d)
        else:
            centroids = np.zeros((1, d))
    models = Models(centroids, before=before)
    if kind == "SQ8Flat" or sq8 and not kind.startswith("Raw"):
        lo, hi = _ranges(vectors, centroids if kind.endswith("IVF") else None, len(centroids), d)
        models = replace(models, lo=lo, hi=hi)
    if kind.startswith("Book"):
        rotation = M.rotation(d)
        cents, bounds = M.codebook(bits, len(rotation))
        models = replace(models, rotation=rotation, cents=cents, bounds=bounds)
    if kind == "PQIVF":
        models = replace(models, books=_product(vectors, models.centroids, d, parts, 1 << bits, rounds, seed))
    return Index(kind, d, encoded(vectors, kind, bits, models), models, bits, metric)


def _product(vectors: DataFrame, centroids: np.ndarray, d: int, parts: int, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of each part of the vectors' differences from their lists' centroids; with fewer rows than k the last is repeated."""
    w, books = d // parts, []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _matrix(b["x"])
                yield pd.DataFrame({"vec_id": b["vec_id"], "x": list(x - centroids[nearest(x, centroids)])})

    own = vectors.select("vec_id", "x").mapInPandas(run, "vec_id long, x array<double>")
    for p in range(parts):
        ms = np.array(M.kmeans(own.select("vec_id", F.slice("x", 1 + p * w, w).alias("x")), k, rounds, seed).first()["ms"]).reshape(-1, w)
        books.append(np.concatenate([ms, np.repeat(ms[-1:], k - len(ms), axis=0)]) if len(ms) else np.zeros((k, w)))
    return np.stack(books)


def build_opq(vectors: DataFrame, d: int, parts: int = 8, k: int = 16, turns: int = 3, **options) -> Index:
    """Inverted lists of sign codes behind a learned rotation (product quantiser's) and the randomised Hadamard rotation; d is a power of two."""
    from . import transforms

    learned, _ = transforms.opq(vectors, d, parts, k, turns)
    return build(vectors, "SignIVF", d, before=M.rotation(d) @ learned, **options)


def search(index: Index, queries: DataFrame, k: int = 10, nprobe: int = 8, refine: int = 10, where: Column | None = None) -> DataFrame:
    """One entry for all kinds of index: see Index.search."""
    return index.search(queries, k, nprobe, refine, where)


def report(vectors: DataFrame, queries: DataFrame, truth: DataFrame, d: int, k: int, methods: list[tuple[str, dict]]) -> list[dict]:
    """Costs and benefits of methods (name, build parameters): bytes as stored, recall, seconds, compression and score = recall * compression * (1000 / ms) * recall * 100."""
    import time

    n, raw = queries.count(), 4 * d * vectors.count()
    near = truth.select("qid", "vec_id").distinct()
    out = []
    for name, p in methods:
        p = dict(p)
        nprobe, refine = p.pop("nprobe", 8), p.pop("refine", 10)
        t = time.time()
        index = build(vectors, d=d, **p)
        rows = index.rows.cache()
        rows.count()
        index = replace(index, rows=rows)
        built = time.time() - t
        t = time.time()
        got = index.search(queries, k, nprobe, refine).cache()
        got.count()
        s = time.time() - t
        share = got.join(near, ["qid", "vec_id"], "left_semi").count() / max(1, n * k)
        st = index.stats().first()
        size = st["code_bytes"] + st["factor_bytes"] + st["sq8_bytes"]
        ratio = raw / max(1, size)
        out.append({"name": name, "bytes": round(size / max(1, st["ntotal"]), 1), "recall": round(share, 4), "build_s": round(built, 2), "search_s": round(s, 2), "qps": round(n / s, 1), "compression": round(ratio, 2), "score": round(share * ratio * (1000 / (1000 * s)) * share * 100, 3)})
        got.unpersist()
        rows.unpersist()
    return out


def sweep(vectors: DataFrame, queries: DataFrame, truth: DataFrame, d: int, k: int, kinds: list[str], nlists: list[int], nprobes: list[int]) -> list[dict]:
    """report() over kinds x nlist x nprobe."""
    methods = [(f"{kind} nlist={n} nprobe={p}", {"kind": kind, "nlist": n, "rounds": 4, "nprobe": p}) for kind in kinds for n in nlists for p in nprobes if p <= n]
    return report(vectors, queries, truth, d, k, methods)
