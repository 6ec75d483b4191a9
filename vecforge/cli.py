"""Command line: python -m vecforge.cli build|search|insert|delete|stats|config ... over Parquet tables."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from vecforge.functions import vector as V
from vecforge.operators import engine, store
from vecforge.operators.config import Config


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vecforge")
    p.add_argument("--config", help="settings in INI or TOML")
    p.add_argument("--events", help="folder of the table of events")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("build", "insert"):
        c = sub.add_parser(name)
        c.add_argument("index")
        c.add_argument("vectors", help="table of vec_id and embedding")
        c.add_argument("--to", help="path of the new index (insert)")
        c.add_argument("--kind", default="SignIVF", choices=engine.KINDS)
        c.add_argument("--metric", default="l2", choices=engine.METRICS)
    c = sub.add_parser("search")
    c.add_argument("index")
    c.add_argument("queries", help="table of qid and qv")
    c.add_argument("out")
    c.add_argument("--nprobe", type=int, default=8)
    c.add_argument("--refine", type=int, default=10)
    c = sub.add_parser("delete")
    c.add_argument("index")
    c.add_argument("ids", help="table of vec_id")
    c.add_argument("--to", required=True)
    sub.add_parser("stats").add_argument("index")
    c = sub.add_parser("config")
    c.add_argument("--format", default="toml", choices=("toml", "ini"))
    return p


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("vec_id", V.doubles("embedding").alias("x"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    c = Config.load(a.config) if a.config else Config()
    if a.command == "config":
        print(c.dump(a.format))
        return 0
    spark = spark or SparkSession.builder.appName("vecforge").getOrCreate()
    said = (lambda event, **x: store.notify(spark, a.events, event, **x)) if a.events else (lambda *_, **__: None)
    if a.command == "build":
        index = engine.build(_vectors(spark, a.vectors), a.kind, c.index.d, c.index.nbits, c.index.use_sq8, c.index.nlist, metric=a.metric)
        said("IndexBuilt", kind=a.kind)
        index.save(a.index)
        said("IndexPersisted", path=a.index)
    elif a.command == "insert":
        engine.load(spark, a.index).insert(_vectors(spark, a.vectors)).save(a.to)
        said("IndexPersisted", path=a.to)
    elif a.command == "delete":
        engine.load(spark, a.index).delete(spark.read.parquet(a.ids)).save(a.to)
        said("IndexPersisted", path=a.to)
    elif a.command == "search":
        engine.load(spark, a.index).search(spark.read.parquet(a.queries), c.query.k, a.nprobe, a.refine).write.mode("overwrite").parquet(a.out)
    else:
        engine.load(spark, a.index).stats().show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
