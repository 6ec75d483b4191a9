"""Polar quantisation: a rotated vector as a radius and d - 1 angles, each coded on a few levels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import transforms

R_MIN, R_MAX = 1e-3, 10.0


def beta_codebook(bits: int, d: int, grid: int = 20000, rounds: int = 100) -> np.ndarray:
    """Lloyd-Max centroids on [0, 1] for the density of Beta(d/2, d/2)."""
    k = 1 << bits
    x = (np.arange(grid) + 0.5) / grid
    lw = (d / 2 - 1) * (np.log(x) + np.log1p(-x))
    w = np.exp(lw - lw.max())
    c = (np.arange(k) + 0.5) / k
    for _ in range(rounds):
        cell = np.searchsorted((c[1:] + c[:-1]) / 2, x)
        mass = np.bincount(cell, w, k)
        new = np.where(mass > 1e-300, np.bincount(cell, w * x, k) / np.maximum(mass, 1e-300), c)
        if np.abs(new - c).max() < 1e-10:
            break
        c = np.sort(new)
    return c


def to_polar(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Radii (n) and angles (n, d - 1); an angle whose tail is shorter than 1e-10 is 0; the last is in [0, 2 pi)."""
    tail = np.sqrt(np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1])
    t = np.where(tail[:, :-1] < 1e-10, 0.0, np.arccos(np.clip(y[:, :-1] / np.maximum(tail[:, :-1], 1e-300), -1, 1)))
    t[:, -1] = np.where(y[:, -1] < 0, 2 * math.pi - t[:, -1], t[:, -1])
    return tail[:, 0], t


def from_polar(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    s = np.cumprod(np.hstack([np.ones((len(t), 1)), np.sin(t)]), axis=1)
    return r[:, None] * np.hstack([np.cos(t), np.ones((len(t), 1))]) * s


class Polar:
    def __init__(self, d: int, radius_bits: int = 8, angle_bits: int = 4, seed: int = 42):
        self.d, self.rb, self.ab = d, radius_bits, angle_bits
        self.rotation = transforms.random_rotation(d, d, seed)
        self.book = beta_codebook(angle_bits, d)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, t = to_polar(np.atleast_2d(x) @ self.rotation.T)
        level = np.clip((np.log(np.maximum(r, 1e-300)) - math.log(R_MIN)) / (math.log(R_MAX) - math.log(R_MIN)), 0, 1)
        ri = np.where(r < 1e-10, 0, level * ((1 << self.rb) - 1)).astype(int)
        ti = np.searchsorted((self.book[1:] + self.book[:-1]) / 2, np.clip(t / math.pi, 0, 1))
        levels = 1 << self.ab  # the last angle is even over the whole circle
        ti[:, -1] = np.minimum(levels - 1, t[:, -1] / (2 * math.pi) * levels)
        return ri, ti, r

    def decode(self, ri: np.ndarray, ti: np.ndarray) -> np.ndarray:
        r = np.exp(math.log(R_MIN) + ri / ((1 << self.rb) - 1) * (math.log(R_MAX) - math.log(R_MIN)))
        t = self.book[ti] * math.pi
        t[:, -1] = (ti[:, -1] + 0.5) / (1 << self.ab) * 2 * math.pi
        return from_polar(r, t) @ self.rotation

    def ratio(self) -> float:
        return 32 * self.d / (self.rb + (self.d - 1) * self.ab)


def compress(vectors: DataFrame, codec: Polar) -> DataFrame:
    """(vec_id, radius_idx, angle_indices, original_norm)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                ri, ti, r = codec.encode(np.stack(b["x"].to_numpy()))
                yield pd.DataFrame({"vec_id": b["vec_id"], "radius_idx": ri, "angle_indices": list(ti.astype(np.int32)), "original_norm": r})

    return vectors.select("vec_id", "x").mapInPandas(run, "vec_id long, radius_idx int, angle_indices array<int>, original_norm double")


def decompress(codes: DataFrame, codec: Polar) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"vec_id": b["vec_id"], "x": list(codec.decode(b["radius_idx"].to_numpy(), np.stack(b["angle_indices"].to_numpy())))})

    return codes.mapInPandas(run, "vec_id long, x array<double>")


def save(spark: SparkSession, path: str, codec: Polar) -> None:
    """The codec as a one-row table: its parameters, rotation and codebook."""
    row = (codec.d, codec.rb, codec.ab, [float(v) for v in codec.rotation.ravel()], [float(v) for v in codec.book])
    spark.createDataFrame([row], "d int, radius_bits int, angle_bits int, rotation array<double>, book array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Polar:
    r = spark.read.parquet(path).first()
    codec = Polar.__new__(Polar)
    codec.d, codec.rb, codec.ab = r["d"], r["radius_bits"], r["angle_bits"]
    codec.rotation, codec.book = np.array(r["rotation"]).reshape(codec.d, codec.d), np.array(r["book"])
    return codec


def weight_blocks(matrix: DataFrame, codec: Polar) -> DataFrame:
    """A weight matrix (row, w ARRAY<DOUBLE>) as coded blocks of the codec's length: (row, block, width, radius_idx, angle_indices, original_norm); the last block of a row is padded with zeros."""
    d = codec.d
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / d)), lambda i: F.slice("w", (i * d + 1).cast("int"), F.lit(d)))
    blocks = matrix.where("size(w) > 0").select("row", F.size("w").alias("width"), F.posexplode(parts).alias("block", "x"))
    blocks = blocks.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), F.lit(d) - F.size("x"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                ri, ti, r = codec.encode(np.stack(b["x"].to_numpy()))
                yield pd.DataFrame({"row": b["row"], "block": b["block"], "width": b["width"], "radius_idx": ri, "angle_indices": list(ti.astype(np.int32)), "original_norm": r})

    return blocks.select("row", "block", "width", "x").mapInPandas(run, "row long, block int, width int, radius_idx int, angle_indices array<int>, original_norm double")


def weight_restore(codes: DataFrame, codec: Polar) -> DataFrame:
    """(row, w): the matrix that coded blocks tell. A row's blocks meet in one task: a row is as long as the layer is wide."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"row": b["row"], "block": b["block"], "width": b["width"], "x": list(codec.decode(b["radius_idx"].to_numpy(), np.stack(b["angle_indices"].to_numpy())))})

    x = codes.select("row", "block", "width", "radius_idx", "angle_indices").mapInPandas(run, "row long, block int, width int, x array<double>")
    whole = x.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("block", "x"))).alias("b"), F.first("width").alias("width"))
    return whole.select("row", F.slice(F.flatten(F.transform("b", lambda p: p["x"])), F.lit(1), F.col("width")).alias("w"))
