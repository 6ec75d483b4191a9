"""Learned linear transforms: aggregates of outer products in Spark, small factorisations on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecforge.functions import vector as V

from . import models as M


def gram(df: DataFrame, d: int, x: str = "x", y: str = "x") -> np.ndarray:
    """sum of x_i y_j over all rows (the first d dimensions): one matrix a partition, then their sum."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for b in batches:
            if len(b):
                total += M.matrix(b[x])[:, :d].T @ M.matrix(b[y])[:, :d]
        yield pd.DataFrame({"s": [total.ravel()]})

    part = df.select(*{x, y}).mapInPandas(run, "s array<double>").select(F.posexplode("s").alias("i", "e"))
    out = np.zeros(d * d)
    for i, e in part.groupBy("i").agg(F.sum("e").alias("e")).collect():
        out[i] = e
    return out.reshape(d, d)


def covariance(df: DataFrame, d: int) -> DataFrame:
    n, mean = df.count(), np.array(M.mean(df).first()["c"] or [0.0] * d)[:d]
    cov = gram(df, d) / max(1, n) - np.outer(mean, mean)
    rows = [(i, j, round(float(cov[i, j]), 9)) for i in range(d) for j in range(d)] if n else []
    return df.sparkSession.createDataFrame(rows, "i int, j int, cov double")


def pca(df: DataFrame, d: int, out: int, eigen_power: float = 0.0, rotate: int | None = None, bins: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(matrix out x d, mean): the leading axes, scaled by eigenvalue ** eigen_power (-0.5 whitens).

    rotate: seed of a random rotation after it. bins: axes are dealt to so many equal groups of neighbours, each axis to the
    group whose product of eigenvalues is least so far, so that parts of a product quantiser hold even variance.
    """
    n = df.count()
    mean = np.array(M.mean(df).first()[0])
    values, axes = np.linalg.eigh(gram(df, d) / n - np.outer(mean, mean))
    order = np.argsort(-values)[:out]
    if bins:
        groups: list[list[int]] = [[] for _ in range(bins)]
        weight = np.zeros(bins)
        for i in order:
            free = [g for g in range(bins) if len(groups[g]) < out // bins] or list(range(bins))
            g = min(free, key=lambda g: (weight[g], g))
            groups[g].append(int(i))
            weight[g] += np.log(max(values[i], 1e-12))
        order = np.array([i for g in groups for i in g])
    a = (axes[:, order] * np.maximum(values[order], 1e-12) ** eigen_power).T
    return (a if rotate is None else random_rotation(out, out, rotate) @ a), mean


def random_rotation(d_in: int, d_out: int, seed: int) -> np.ndarray:
    """Orthonormal rows (d_out <= d_in), or a tight frame (d_out > d_in): orthonormal columns scaled by sqrt(d_out / d_in)."""
    g = np.random.default_rng(seed).normal(size=(max(d_in, d_out),) * 2)
    q, r = np.linalg.qr(g)
    return (q * np.sign(np.diag(r)))[:d_out, :d_in] * max(1.0, d_out / d_in) ** 0.5


def is_orthonormal(a: np.ndarray, eps: float = 4e-5) -> bool:
    return bool(np.abs(a @ a.T - np.eye(len(a))).max() < eps)


def apply(df: DataFrame, a: np.ndarray, b: np.ndarray | None = None, x: str = "x", out: str = "y") -> DataFrame:
    """out = A x + b."""
    model = M.row(df.sparkSession, lin=a.tolist(), off=(np.zeros(len(a)) if b is None else b).tolist())
    return df.crossJoin(model).withColumn(out, F.zip_with(V.matvec(F.col("lin"), F.col(x)), "off", lambda p, q: p + q)).drop("lin", "off")


def itq(df: DataFrame, d: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Rotation that brings centred vectors near sign vectors: alternate signs and the Procrustes solution of their Gram."""
    r = random_rotation(d, d, seed)
    for _ in range(rounds):
        y = apply(df, r).withColumn("s", F.transform("y", lambda e: F.when(e > 0, 1.0).otherwise(-1.0)))
        u, _, vt = np.linalg.svd(gram(y, d, "s", "x"))
        r = u @ vt
    return r


def opq(df: DataFrame, d: int, parts: int, k: int, rounds: int = 5, seed: int = 1) -> tuple[np.ndarray, list[list[list[float]]]]:
    """Rotation and sub-space centroids of a product quantiser: alternate one Lloyd round in each sub-space and the Procrustes solution."""
    r, w = np.eye(d), d // parts
    books: list[list[list[float]]] = []
    for turn in range(rounds):
        y = apply(df, r)
        subs = [y.select("vec_id", F.slice("y", 1 + p * w, w).alias("x")) for p in range(parts)]
        books = [M.seeds(s, k, seed) for s in subs] if not books else books
        books = [M.update(s, b) for s, b in zip(subs, books, strict=True)]
        if turn < rounds - 1:
            u, _, vt = np.linalg.svd(gram(pq_decode(pq_encode(y.withColumn("x0", F.col("x")), books, "y"), books).withColumn("x", F.col("x0")), d, "decoded", "x"))
            r = u @ vt
    return r, books


def pq_encode(df: DataFrame, books: list[list[list[float]]], x: str = "x") -> DataFrame:
    """df with pq, the nearest centroid of each part."""
    w = len(books[0][0])
    codes = []
    for p, b in enumerate(books):
        df = df.crossJoin(M.row(df.sparkSession, **{f"b{p}": b}))
        codes.append(_nearest(F.col(f"b{p}"), F.slice(x, 1 + p * w, w)))
    return df.withColumn("pq", F.array(*codes)).drop(*[f"b{p}" for p in range(len(books))])


def _nearest(book, part):
    return F.array_min(F.transform(book, lambda m, i: F.struct(V.l2sq(m, part).alias("d"), i.alias("i"))))["i"]


def pq_decode(df: DataFrame, books: list[list[list[float]]]) -> DataFrame:
    for p, b in enumerate(books):
        df = df.crossJoin(M.row(df.sparkSession, **{f"b{p}": b}))
    return df.withColumn("decoded", F.flatten(F.array(*[F.get(F.col(f"b{p}"), F.get("pq", F.lit(p))) for p in range(len(books))]))).drop(*[f"b{p}" for p in range(len(books))])


def remap(x: str, where: list[int]):
    """Dimensions picked by index; -1 gives 0."""
    return F.transform(F.array(*[F.lit(i) for i in where]), lambda i: F.when(i < 0, 0.0).otherwise(F.get(F.col(x), i)))


def center(df: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(M.mean(df))).withColumn("x", V.minus(F.col("x"), F.col("c"))).drop("c")
