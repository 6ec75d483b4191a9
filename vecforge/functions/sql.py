"""Vector functions for SQL: temporary functions that the analyser inlines, so Catalyst sees plain expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

V = "ARRAY<DOUBLE>"
FUNCTIONS = {
    "l2sq": (f"a {V}, b {V}", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, t) -> s + t)"),
    "dot": (f"a {V}, b {V}", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, t) -> s + t)"),
    "norm": (f"a {V}", "DOUBLE", "sqrt(aggregate(transform(a, x -> x * x), 0D, (s, t) -> s + t))"),
    "sq8_encode": (f"x {V}, lo {V}, hi {V}", "ARRAY<INT>", "transform(sequence(0, size(x) - 1), i -> cast(floor(greatest(0D, least(1D, (x[i] - lo[i]) / (hi[i] - lo[i]))) * 255) AS INT))"),
    "sq8_decode": (f"code ARRAY<INT>, lo {V}, hi {V}", V, "transform(sequence(0, size(code) - 1), i -> lo[i] + code[i] * ((hi[i] - lo[i]) / 255))"),
    "book_encode": (f"v {V}, bounds {V}", "ARRAY<INT>", "transform(v, x -> size(filter(bounds, b -> b < x)))"),
    "rotate": (f"m ARRAY<{V}>, v {V}", V, "transform(m, r -> aggregate(zip_with(r, v, (x, y) -> x * y), 0D, (s, t) -> s + t))"),
}


def register(spark: SparkSession, prefix: str = "vec_") -> list[str]:
    for name, (args, out, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS {out} RETURN {body}")
    return [prefix + n for n in FUNCTIONS]
