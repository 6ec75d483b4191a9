"""Ingest and upkeep by Structured Streaming: versioned rows in, current rows and running top-k out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecforge.functions import vector as V
from vecforge.operators import search as S
from vecforge.operators import store
from vecforge.sources.vecs import checked

SCHEMA = "vec_id long, embedding array<float>, label int, op string, n long"


def read_commands(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of (vec_id, embedding, label, op, n): op 'insert' (null: the same) or 'delete'; n, which may be missing, numbers the commands."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _last(commands: DataFrame) -> DataFrame:
    """The command of each id with the greatest number n (null: 0); of equal numbers a delete, then the greatest vector."""
    w = Window.partitionBy("vec_id").orderBy(F.coalesce("n", F.lit(0)).desc(), F.col("op"), F.col("embedding").desc(), F.col("label").desc())
    return commands.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def ingest(commands: DataFrame, path: str, checkpoint: str, d: int) -> StreamingQuery:
    """Appends each batch to path with its number as seq, deletes as tombstones. A batch that runs again overwrites its own
    folder, so each command counts once. Within a batch an id's last command counts. Commands without an id, and inserts of
    a wrong length or with non-finite components, are dropped into path/rejected."""

    def batch(df: DataFrame, n: int) -> None:
        rows = df.withColumn("op", F.coalesce("op", F.lit("insert"))).withColumn("seq", F.lit(n).cast("long"))
        named = rows.where("vec_id is not null")
        deletes = named.where("op = 'delete'")
        good = checked(named.where("op = 'insert'"), d)
        _last(good.unionByName(deletes)).drop("n").write.mode("overwrite").parquet(f"{path}/log/batch={n}")
        bad = rows.where("vec_id is null or op not in ('insert', 'delete')").unionByName(named.where("op = 'insert'").exceptAll(good))
        bad.write.mode("overwrite").parquet(f"{path}/rejected/batch={n}")

    return commands.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """Last command of each vector; deleted ones are gone."""
    return store.latest(spark.read.parquet(f"{path}/log")).where("op = 'insert'").select("vec_id", "embedding", "label")


def compact(spark: SparkSession, path: str, to: str) -> None:
    current(spark, path).write.mode("overwrite").parquet(to)


def running_top_k(commands: DataFrame, queries: DataFrame, path: str, checkpoint: str, k: int) -> StreamingQuery:
    """Keeps each query's best k of all vectors seen: every batch merges the old best with its own candidates, in path/top/batch=n.
    An id's later vector replaces its earlier one, and a deleted id leaves the lists, which may be shorter until others come."""
    spark = commands.sparkSession

    def batch(df: DataFrame, n: int) -> None:
        last = _last(df.where("vec_id is not null").withColumn("op", F.coalesce("op", F.lit("insert"))))
        v = last.where("op = 'insert'").select("vec_id", V.doubles("embedding").alias("x"))
        new = S.pairs(v, queries).select("qid", "vec_id", V.l2sq(F.col("x"), F.col("qv")).alias("dist"))
        if n:
            old = spark.read.parquet(f"{path}/top/batch={n - 1}").select("qid", "vec_id", "dist")
            new = new.unionByName(old.join(last.select("vec_id"), "vec_id", "left_anti").select("qid", "vec_id", "dist"))
        S.best(new.groupBy("qid", "vec_id").agg(F.min("dist").alias("dist")), k).write.mode("overwrite").parquet(f"{path}/top/batch={n}")

    return commands.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(tokens: DataFrame, size: int = 128) -> DataFrame:
    """Count-based tumbling windows: rows (key, pos) of full groups of `size` get a group number, newer rows stay in the residual (null)."""
    w = Window.partitionBy("key")
    n = F.count("*").over(w)
    i = F.row_number().over(w.orderBy("pos")) - 1
    return tokens.withColumn("grp", F.when(i < n - n % size, F.floor(i / size)))
