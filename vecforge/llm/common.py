"""Shared pieces: tables in the shared folder, size-checked joins, connected components."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: A side is broadcast only if its counted rows times its row width stay under this.
BROADCAST_BYTES = 16 << 20
_roots: dict[str, SparkSession] = {}
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset (tests) a local one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir() + "/vecforge-checkpoints"
    app = spark.sparkContext.applicationId
    root = f"{base.rstrip('/')}/vecforge-{app}"
    _roots[root] = spark
    return root


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _forget() -> None:
    for root, spark in _roots.items():
        try:
            _delete(spark, root)
        except Exception:  # noqa: BLE001, S110  the JVM may be gone
            pass


def save(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, statistics are known, a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes saved tables that no later step reads, and lets Spark drop the shuffle files of finished steps."""
    for df in frames:
        if path := getattr(df, "_saved_at", None):
            _delete(df.sparkSession, path)
    if frames:
        tidy(frames[0].sparkSession)


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files and broadcasts of finished jobs, and the driver's heap shrink to what it still holds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fits_broadcast(df: DataFrame, row_bytes: int) -> bool:
    """Counts a saved table: broadcast it only if it is small."""
    return df.count() * row_bytes <= BROADCAST_BYTES


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """df marked for broadcast if its counted size allows that, else as it is (a shuffle join follows)."""
    return F.broadcast(df) if fits_broadcast(df, row_bytes) else df


def extended(df: DataFrame, **more: str) -> StructType:
    """df's schema and further nullable columns, as a schema object: any column name is allowed."""
    return StructType([*df.schema.fields, *(f for name, kind in more.items() for f in DataType.fromDDL(f"{name} {kind}").fields)])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of df."""
    known, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in known:
            name = f"_{name}"
        out.append(name)
    return out


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, unless they find it by PYTHONPATH as the driver does."""
    top = Path(__file__).resolve().parents[1]
    known = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if top.parent in known or spark.sparkContext.applicationId in _shipped:
        return
    with zipfile.ZipFile(path := Path(tempfile.mkdtemp()) / f"{top.name}.zip", "w") as z:
        for f in top.rglob("*.py"):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(spark.sparkContext.applicationId)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Long texts: few rows in an Arrow batch bound a Python worker's memory."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: (a BIGINT, b BIGINT). Returns (id, component) for each id in an edge; component is the smallest id
    reachable. Each round is two aggregations with partial sums and two joins; nothing goes to the driver but two sums.
    """
    e = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        nxt = save(small.where("u <> v").distinct(), "edges")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(e)
        e = nxt
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").union(e.select("v", "v").distinct().toDF("id", "component"))
