"""Neighbour graphs: smoothed distances and membership strengths, and attention over stored rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecforge.functions import vector as V


def smooth_knn(edges: DataFrame, k: float, rounds: int = 64) -> DataFrame:
    """(src, rho, sigma) from edges (src, dst, dist): rho is the least positive distance; sigma, found by bisection, makes
    the strengths exp(-(dist - rho) / sigma) sum to log2 k. A node's edges are its k neighbours, so an array holds them."""
    nodes = edges.where("src <> dst").groupBy("src").agg(F.array_sort(F.collect_list("dist")).alias("d"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rho, sigma = [], []
            for d in b["d"]:
                d = np.asarray(d)
                r = d[d > 0].min() if (d > 0).any() else 0.0
                lo, hi, s = 0.0, np.inf, 1.0
                for _ in range(rounds):
                    total = np.exp(-np.maximum(d - r, 0) / s).sum()
                    if abs(total - np.log2(k)) < 1e-5:
                        break
                    if total > np.log2(k):
                        hi, s = s, (lo + s) / 2
                    else:
                        lo, s = s, s * 2 if hi == np.inf else (s + hi) / 2
                rho.append(float(r))
                sigma.append(max(float(s), 1e-3 * float(d.mean())))
            yield pd.DataFrame({"src": b["src"], "rho": rho, "sigma": sigma})

    return nodes.mapInPandas(run, "src long, rho double, sigma double")


def membership(edges: DataFrame, smooth: DataFrame, symmetric: bool = True) -> DataFrame:
    """(src, dst, weight); symmetric: a + b - a b of both directions."""
    e = edges.where("src <> dst").join(smooth, "src").select("src", "dst", F.when((F.col("dist") <= F.col("rho")) | (F.col("sigma") == 0), 1.0).otherwise(F.exp(-(F.col("dist") - F.col("rho")) / F.col("sigma"))).alias("w"))
    if not symmetric:
        return e.withColumnRenamed("w", "weight")
    both = e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg((F.sum("w") - F.when(F.count("*") > 1, F.min("w") * F.max("w")).otherwise(0.0)).alias("weight"))


def attention(cache: DataFrame, queries: DataFrame, d: int) -> DataFrame:
    """(qid, value): softmax of scaled dot products with keys (pos, key, value), times values. Queries are a stated, small set."""
    w = W.partitionBy("qid")
    s = cache.crossJoin(F.broadcast(queries)).withColumn("s", V.dot(F.col("key"), F.col("qv")) / d**0.5)
    p = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    parts = p.select("qid", "e", F.posexplode("value").alias("i", "v")).groupBy("qid", "i").agg((F.sum(F.col("e") * F.col("v")) / F.sum("e")).alias("v"))
    return parts.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("value"))


def select_tokens(scores: DataFrame, capacity: int, window: int, kernel: int = 5) -> DataFrame:
    """(key, pos) that stay: the newest `window` of each key, and of the others the capacity - window best by centred average pooling (zero padding)."""
    by = W.partitionBy("key")
    last = F.max("pos").over(by)
    s = scores.withColumn("recent", F.col("pos") > last - window)
    old = s.where("not recent").withColumn("pooled", F.sum("score").over(by.orderBy("pos").rowsBetween(-(kernel // 2), kernel // 2)) / kernel)
    best = old.withColumn("r", F.row_number().over(by.orderBy(F.desc("pooled"), "pos"))).where(F.col("r") <= capacity - window)
    return best.select("key", "pos").unionAll(s.where("recent").select("key", "pos"))


#: Nodes that a layout holds on the driver at most; a larger graph is refused.
MOST_NODES = 200_000


def layout(edges: DataFrame, dims: int = 2, rounds: int = 100, rate: float = 1.0, negatives: int = 5, seed: int = 42) -> DataFrame:
    """(id, pos): positions from weighted edges (src, dst, weight) by gradient steps: linked nodes attract, random ones repel.

    The graph has a node for each vector that was asked for, and is laid out on the driver; more than MOST_NODES fail.
    """
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    if (n := ids.count()) > MOST_NODES:
        raise ValueError(f"{n} nodes; a layout holds {MOST_NODES}")
    names = np.sort(ids.toArrow()["id"].to_numpy()) if n else np.empty(0, np.int64)
    e = edges.select("src", "dst", "weight").toArrow()
    a, b, w = np.searchsorted(names, e["src"].to_numpy()), np.searchsorted(names, e["dst"].to_numpy()), e["weight"].to_numpy()
    r = np.random.default_rng(seed)
    pos = r.uniform(-10, 10, (n, dims))
    for turn in range(rounds):
        lr = rate * (1 - turn / rounds)
        use = r.random(len(w)) < w / max(w.max(initial=0), 1e-12)
        i, j = a[use], b[use]
        apart = pos[i] - pos[j]
        d2 = (apart * apart).sum(axis=1, keepdims=True)
        pull = np.clip(-2 * apart / (1 + d2), -4, 4)
        push_to = r.integers(0, max(n, 1), (len(i), negatives))
        away = pos[i][:, None] - pos[push_to]
        far = (away * away).sum(axis=2, keepdims=True)
        push = np.clip(2 * away / ((0.001 + far) * (1 + far)), -4, 4).sum(axis=1)
        np.add.at(pos, i, lr * (pull + push))
        np.add.at(pos, j, -lr * pull)
    return edges.sparkSession.createDataFrame([(int(k), [float(v) for v in p]) for k, p in zip(names, pos, strict=True)], "id long, pos array<double>")


def compressed_attention(codes: DataFrame, values: DataFrame, queries: DataFrame, codec) -> DataFrame:
    """attention() over keys that are kept as polar codes: codes (vec_id, radius_idx, angle_indices, original_norm), values (vec_id, value)."""
    from . import polar

    keys = polar.decompress(codes, codec).select("vec_id", F.col("x").alias("key"))
    return attention(keys.join(values, "vec_id").select(F.col("vec_id").alias("pos"), "key", "value"), queries, codec.d)


def cache_bytes(codes: DataFrame, codec) -> DataFrame:
    """One row: entries, bytes of the codes, bytes of the same keys in single precision."""
    bits = codec.rb + (codec.d - 1) * codec.ab
    return codes.agg(F.count("*").alias("entries"), (F.count("*") * ((bits + 7) // 8)).alias("code_bytes"), (F.count("*") * 4 * codec.d).alias("raw_bytes"))
