"""Quantiser models: small, fixed in size by their parameters, fitted from the data with partial sums, kept as one-row DataFrames."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecforge.functions import vector as V


def signs(seed: int, round_: int, d: int) -> list[int]:
    """+1 or -1 by the parity of the first hex digit of md5('seed:round:i')."""
    return [1 if int(hashlib.md5(f"{seed}:{round_}:{i}".encode()).hexdigest()[0], 16) % 2 == 0 else -1 for i in range(d)]


def fwht(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows of x, whose length p is a power of two, in log2 p passes; not scaled."""
    p, width = x.shape[-1], 1
    while width < p:
        pair = x.reshape(*x.shape[:-1], p // (2 * width), 2, width)
        top, low = pair[..., 0, :], pair[..., 1, :]
        x = np.stack([top + low, top - low], axis=-2).reshape(x.shape)
        width *= 2
    return x


def _padded(x: np.ndarray) -> np.ndarray:
    p = V.next_power_of_2(x.shape[-1])
    return np.concatenate([x, np.zeros((*x.shape[:-1], p - x.shape[-1]), x.dtype)], axis=-1)


def rotate(x: np.ndarray, seed: int = 12345) -> np.ndarray:
    """The randomised Hadamard rotation of rows: three rounds of signs and transform; rows are padded to a power of two."""
    y = _padded(x)
    p = y.shape[-1]
    for r in (1, 2, 3):
        y = fwht(np.array(signs(seed, r, p)) * y)
    return y / (p * p**0.5)


def unrotate(y: np.ndarray, d: int, seed: int = 12345) -> np.ndarray:
    """The inverse of rotate: the rounds backwards, then the first d components."""
    p = y.shape[-1]
    for r in (3, 2, 1):
        y = np.array(signs(seed, r, p)) * fwht(y)
    return y[..., :d] / (p * p**0.5)


def rotation(d: int, seed: int = 12345) -> np.ndarray:
    """The rotation as a matrix, from exact integers: d columns, as many rows as the padded length."""
    p = V.next_power_of_2(d)
    y = np.eye(p, dtype=np.int64)
    for r in (1, 2, 3):
        y = fwht(np.array(signs(seed, r, p)) * y)
    return (y.T / (p * p**0.5))[:, :d]


def _each(df: DataFrame, x: str, out: str, f) -> DataFrame:
    """(vec_id, out): f of the matrix of each batch's vectors x."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"vec_id": b["vec_id"], out: list(f(matrix(b[x])))})

    return df.select("vec_id", x).mapInPandas(run, f"vec_id long, {out} array<double>")


def hadamard(df: DataFrame, x: str = "x", out: str = "y") -> DataFrame:
    """(vec_id, out): one unsigned transform of x, scaled by 1 / sqrt(padded length) and cut back to the length of x."""
    return _each(df, x, out, lambda m: fwht(_padded(m))[:, : m.shape[1]] / V.next_power_of_2(m.shape[1]) ** 0.5)


def unrotated(df: DataFrame, d: int, y: str = "z", out: str = "x", seed: int = 12345) -> DataFrame:
    """(vec_id, out): the vectors of which y are the rotations."""
    return _each(df, y, out, lambda m: unrotate(m, d, seed))


def codebook(bits: int, d: int, grid: int = 32768, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd-Max centroids and boundaries for a coordinate of a random unit vector in d dimensions, density (1 - x^2)^((d-3)/2)."""
    k = 1 << bits
    if d == 1:
        c = np.array([-1.0] * (k // 2) + [1.0] * (k - k // 2))
        return c, (c[1:] + c[:-1]) / 2
    x = -1 + 2 * (np.arange(grid) + 0.5) / grid
    with np.errstate(all="ignore"):
        w = np.ones(grid) if d == 3 else (1 - x * x) ** ((d - 3) / 2)
    w[~np.isfinite(w)] = 0
    cw, cx = np.concatenate([[0], np.cumsum(w)]), np.concatenate([[0], np.cumsum(w * x)])

    def means(cuts: np.ndarray, fallback: np.ndarray) -> np.ndarray:
        mass = cw[cuts[1:]] - cw[cuts[:-1]]
        return np.where(mass > 0, (cx[cuts[1:]] - cx[cuts[:-1]]) / np.where(mass > 0, mass, 1), fallback)

    cells = -1 + (2 * np.arange(k) + 1) / k
    c = means(np.concatenate([[0], np.searchsorted(cw, cw[-1] * np.arange(1, k) / k), [grid]]), cells)
    for _ in range(rounds):
        b = (c[1:] + c[:-1]) / 2
        edge = np.concatenate([[-1], b, [1]])
        new = np.clip(means(np.concatenate([[0], np.searchsorted(x, b), [grid]]), (edge[1:] + edge[:-1]) / 2), edge[:-1], edge[1:])
        moved = np.abs(new - c).max()
        c = new
        if moved < 1e-8:
            break
    c = np.sort(c).astype(np.float32)
    return c.astype(float), ((c[1:] + c[:-1]) / np.float32(2)).astype(float)


def row(spark: SparkSession, **arrays: list) -> DataFrame:
    """A one-row DataFrame of (nested) arrays of doubles, marked for broadcast: its size is fixed by the model's parameters."""
    kind = lambda v: "array<array<double>>" if v and isinstance(v[0], list) else "array<double>"
    return F.broadcast(spark.createDataFrame([tuple(arrays.values())], ", ".join(f"{k} {kind(v)}" for k, v in arrays.items())))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def _listed(c: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("i", c.alias("e")))), lambda p: p["e"])


def mean(df: DataFrame, x: str = "x") -> DataFrame:
    """One row c: the mean of each dimension, from one row of sums a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for b in batches:
            if len(b):
                s = matrix(b[x]).sum(axis=0)
                total, n = s if total is None else total + s, n + len(b)
        if n:
            yield pd.DataFrame({"n": [n], "s": [total]})

    sums = df.select(x).mapInPandas(run, "n long, s array<double>").select("n", F.posexplode("s").alias("i", "e"))
    return sums.groupBy("i").agg((F.sum("e") / F.sum("n")).alias("e")).agg(_listed(F.col("e")).alias("c"))


def ranges(df: DataFrame, *keys: str, x: str = "x") -> DataFrame:
    """lo and hi of each dimension, for each key; a range under 1e-6 is widened to 1e-6. One row a partition and key goes into the exchange."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[np.ndarray]] = {}
        for b in batches:
            for k, part in b.groupby(list(keys), sort=False) if keys else [((), b)]:
                if len(part):
                    m = matrix(part[x])
                    lo, hi = m.min(axis=0), m.max(axis=0)
                    old = held.get(k)
                    held[k] = [lo, hi] if old is None else [np.minimum(old[0], lo), np.maximum(old[1], hi)]
        if held:
            yield pd.DataFrame({**{c: [k[i] for k in held] for i, c in enumerate(keys)}, "l": [v[0] for v in held.values()], "h": [v[1] for v in held.values()]})

    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "l array<double>", "h array<double>"])
    part = df.select(*keys, x).mapInPandas(run, schema).select(*keys, F.posexplode(F.arrays_zip("l", "h")).alias("i", "p"))
    g = part.groupBy(*keys, "i").agg(F.min("p.l").alias("lo"), F.max("p.h").alias("hi"))
    g = g.withColumn("hi", F.when(F.col("hi") - F.col("lo") < 1e-6, F.col("lo") + 1e-6).otherwise(F.col("hi")))
    return g.groupBy(*keys).agg(_listed(F.col("lo")).alias("lo"), _listed(F.col("hi")).alias("hi"))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row (ties to the lowest), by direct differences."""
    out = np.empty(len(x), np.int32)
    step = max(1, 4_000_000 // max(1, centroids.size))
    for a in range(0, len(x), step):
        out[a : a + step] = ((x[a : a + step, None, :] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)
    return out


def assign(df: DataFrame, centroids: DataFrame, x: str = "x") -> DataFrame:
    """df with cluster_id, the nearest centroid (ties to the lowest id). centroids: one row, ms ARRAY<ARRAY<DOUBLE>>, whose size is fixed by parameters; no shuffle."""
    ms = np.array(centroids.first()["ms"])

    @F.pandas_udf("int")
    def near(v: pd.Series) -> pd.Series:
        return pd.Series(nearest(matrix(v), ms) if len(v) else np.empty(0, np.int32))

    return df.withColumn("cluster_id", near(x))


def update(df: DataFrame, old: list[list[float]], x: str = "x") -> list[list[float]]:
    """One Lloyd round: means of the rows nearest to each centroid, from k rows of sums a partition; an empty cluster keeps its centroid."""
    ms = np.array(old)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(ms.shape), np.zeros(len(ms), np.int64)
        for b in batches:
            if len(b):
                m = matrix(b[x])
                c = nearest(m, ms)
                np.add.at(total, c, m)
                n += np.bincount(c, minlength=len(ms))
        at = np.flatnonzero(n)
        if len(at):
            yield pd.DataFrame({"c": at.astype("int32"), "n": n[at], "s": list(total[at])})

    sums = df.select(x).mapInPandas(run, "c int, n long, s array<double>").select("c", "n", F.posexplode("s").alias("i", "e"))
    new = [list(c) for c in old]
    for c, i, e in sums.groupBy("c", "i").agg((F.sum("e") / F.sum("n")).alias("e")).collect():
        new[c][i] = e
    return new


def seeds(df: DataFrame, k: int, seed: int = 42) -> list[list[float]]:
    """The k rows with the least md5('seed:vec_id'): a deterministic random draw; fewer if there are fewer rows."""
    return [r[0] for r in df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string"))), "vec_id").limit(k).select("x").collect()]


def kmeans(df: DataFrame, k: int, rounds: int, seed: int = 42) -> DataFrame:
    """Exactly `rounds` Lloyd rounds from seeded rows. One row: ms, the centroids; k * d numbers go to the driver each round."""
    spark, ms = df.sparkSession, seeds(df, k, seed)
    for _ in range(rounds):
        ms = update(df, ms)
    return row(spark, ms=ms)
