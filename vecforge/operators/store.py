"""Indexes as Parquet: rows partitioned by cluster, one row of metadata, versioned upserts and tombstones."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("RawFlat", "SQ8Flat", "BookFlat", "SignFlat", "RawIVF", "SignIVF", "BookIVF", "PQIVF")


@dataclass
class IndexMeta:
    index_type: str
    d: int
    ntotal: int
    nbits: int = 4
    use_sq8: bool = True
    metric: str = "l2"
    nlist: int = 0
    hadamard_seed: int = 12345
    kmeans_niter: int = 20
    storage_version: int = 3

    def __post_init__(self) -> None:
        if self.index_type not in KINDS:
            raise ValueError(f"index_type must be one of {KINDS}")


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir; unset, in local mode only, a local one), deleted at exit."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    _SCRATCH.append((spark, path := f"{base.rstrip('/')}/vecforge-{tag}-{uuid.uuid4().hex[:12]}"))
    return path


@atexit.register
def _clear() -> None:
    for spark, path in _SCRATCH:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001, S110  the JVM may be gone
            pass


def save_index(spark: SparkSession, path: str, rows: DataFrame, meta: IndexMeta, models: dict[str, DataFrame] | None = None) -> None:
    """Data first, metadata last: an index without metadata is not an index."""
    writer = rows.write.mode("overwrite")
    if "cluster_id" in rows.columns:
        writer = rows.repartition("cluster_id").write.mode("overwrite").partitionBy("cluster_id")
    writer.parquet(f"{path}/rows")
    for name, df in (models or {}).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(asdict(meta)),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_meta(spark: SparkSession, path: str) -> IndexMeta:
    return IndexMeta(**json.loads(spark.read.parquet(f"{path}/meta").first()[0]))


def load_index(spark: SparkSession, path: str, index_type: str | None = None) -> tuple[DataFrame, IndexMeta]:
    meta = load_meta(spark, path)
    if index_type and meta.index_type != index_type:
        raise ValueError(f"{path} holds a {meta.index_type} index, not {index_type}")
    rows = spark.read.parquet(f"{path}/rows")
    if (n := rows.count()) != meta.ntotal:
        raise ValueError(f"{path} holds {n} rows, its metadata says {meta.ntotal}")
    return rows, meta


def load_model(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def latest(versions: DataFrame, key: str = "vec_id", seq: str = "seq") -> DataFrame:
    """The last written row of each key: upserts as appends."""
    return versions.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.col(seq).desc()))).where("_n = 1").drop("_n")


def without(rows: DataFrame, tombstones: DataFrame, key: str = "vec_id") -> DataFrame:
    return rows.join(tombstones.select(key).distinct(), key, "left_anti")


def lookup(rows: DataFrame, ids: list[int], key: str = "vec_id") -> DataFrame:
    return rows.where(F.col(key).isin(ids))


def first_code(ids: DataFrame, *families: DataFrame, key: str = "vec_id") -> DataFrame:
    """The code of each id from the first family that holds it."""
    out, names = ids, []
    for i, f in enumerate(families):
        names.append(f"_c{i}")
        out = out.join(f.select(key, F.col("code").alias(names[-1])), key, "left")
    return out.select(key, F.coalesce(*names).alias("code"))


def stats(rows: DataFrame, meta: IndexMeta) -> DataFrame:
    sq8 = F.count("code") if "code" in rows.columns else F.lit(0).cast("long")
    return rows.agg(F.lit(meta.index_type).alias("index_type"), F.lit(meta.d).alias("d"), F.lit(meta.ntotal).cast("long").alias("ntotal"), F.count("*").alias("code_count"), sq8.alias("sq8_count"))


def merged_counts(deltas: DataFrame) -> DataFrame:
    """Sums (count, start) deltas for each cluster: partial sums, then their sum."""
    return deltas.groupBy("cluster_id").agg(F.sum("count").alias("count"), F.sum("start").alias("start"))


def cluster_offsets(assigned: DataFrame) -> DataFrame:
    """(cluster_id, size, offset): sizes and running sums of the clusters before."""
    w = W.orderBy("cluster_id").rowsBetween(W.unboundedPreceding, -1)
    sizes = assigned.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return sizes.withColumn("offset", F.coalesce(F.sum("size").over(w), F.lit(0).cast("long")))


def code_bytes(method: str, d: int, bits: int = 4, sq8: bool = True) -> int:
    base = {"sign": d // 8 + 8, "book": (d * bits + 7) // 8, "sq8": 0, "raw": 4 * d}[method]
    return base + (d if sq8 and method != "raw" else 0)


def notify(spark: SparkSession, folder: str, event: str, **detail: object) -> None:
    """Appends an event (IndexBuilt, IndexPersisted, WriteProgress, Error) to the folder's table, which a stream can follow."""
    spark.createDataFrame([(event, json.dumps(detail))], "event string, detail string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(folder)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """(event, detail, at) as a stream."""
    return spark.readStream.schema("event string, detail string, at timestamp").parquet(folder)
