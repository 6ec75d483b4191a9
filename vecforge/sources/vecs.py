"""Sources and sinks of fixed-record vector files: little-endian int32 dimension, then that many float32 or int32 values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DIM = 65536


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, dimension, records) of each file, in the order of their paths; only the first four bytes of each are read here."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x for s in (fs.globStatus(top) or []) for x in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    out = []
    for f in sorted((str(x.getPath()), x.getLen()) for x in found if x.isFile()):
        if not f[1]:
            continue
        with_d = fs.open(jvm.org.apache.hadoop.fs.Path(f[0]))
        try:
            d = int.from_bytes(with_d.readInt().to_bytes(4, "big", signed=True), "little", signed=True) if f[1] >= 4 else 0
        finally:
            with_d.close()
        if not 1 <= d <= MAX_DIM or f[1] % (4 + 4 * d):
            raise ValueError(f"not a vector file: dimension {d}, {f[1]} bytes")
        out.append((f[0], d, f[1] // (4 + 4 * d)))
    return out


def _read(spark: SparkSession, path: str, kind: str, element: str) -> DataFrame:
    """(id, v): files in the order of their paths, ids count from 0. Files are split into tasks at record borders, so their size doesn't matter."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                raw = np.stack([np.frombuffer(x, "<i4") for x in b["b"]])
                if (raw[:, 0] != raw.shape[1] - 1).any():
                    raise ValueError("records differ in dimension")
                yield pd.DataFrame({"id": b["id"], "v": list(np.ascontiguousarray(raw[:, 1:]).view(kind))})

    out, at = None, 0
    for name, d, n in _files(spark, path):
        conf = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(4 + 4 * d)}
        rdd = spark.sparkContext.newAPIHadoopFile(name, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)
        one = spark.createDataFrame(rdd, "id long, b binary").select((F.col("id") + at).alias("id"), "b").mapInPandas(rows, f"id long, v array<{element}>")
        out, at = one if out is None else out.unionAll(one), at + n
    return spark.createDataFrame([], f"id long, v array<{element}>") if out is None else out


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "<f4", "float")


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "<i4", "int")


def encode(rows: np.ndarray) -> bytes:
    """Bytes of a vector file (float32 or int32 by the array's kind)."""
    rows = np.ascontiguousarray(rows, "<i4" if rows.dtype.kind in "iu" else "<f4")
    return np.hstack([np.full((len(rows), 1), rows.shape[1], "<i4"), rows.view("<i4")]).tobytes()


def dataset(spark: SparkSession, folder: str, name: str) -> dict[str, DataFrame]:
    """The base, query and ground-truth triple of a published set."""
    return {"base": read_fvecs(spark, f"{folder}/{name}_base.fvecs"), "query": read_fvecs(spark, f"{folder}/{name}_query.fvecs"), "groundtruth": read_ivecs(spark, f"{folder}/{name}_groundtruth.ivecs")}


def clustered(spark: SparkSession, n: int, d: int, clusters: int, std: float, seed: int) -> DataFrame:
    """(vec_id, embedding): unit vectors about random unit centres, row i about centre i mod clusters; each row is drawn from (seed, id) alone."""
    centres = np.random.default_rng(seed).normal(size=(clusters, d))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack([centres[i % clusters] + std * np.random.default_rng([seed, i]).normal(size=d) for i in b["id"]])
            yield pd.DataFrame({"vec_id": b["id"], "embedding": list((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))})

    return spark.range(n).mapInPandas(rows, "vec_id long, embedding array<float>")


def noisy_queries(vectors: DataFrame, nq: int, noise: float, seed: int) -> DataFrame:
    """(qid, qv): nq rows chosen by a hash, with Gaussian noise, renormalised."""
    chosen = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(nq)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack([np.asarray(e, float) + noise * np.random.default_rng([seed, i]).normal(size=len(e)) for i, e in zip(b["vec_id"], b["embedding"], strict=True)])
            yield pd.DataFrame({"qid": b["vec_id"], "qv": list(x / np.linalg.norm(x, axis=1, keepdims=True))})

    return chosen.select("vec_id", "embedding").mapInPandas(rows, "qid long, qv array<double>")


def checked(vectors: DataFrame, d: int) -> DataFrame:
    """Rows that may enter an index: d finite components."""
    x = F.col("embedding")
    return vectors.where(x.isNotNull() & (F.size(x) == d) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
