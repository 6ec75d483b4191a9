"""Vector functions as Column expressions over ARRAY<DOUBLE>; sums run in index order, so results are reproducible."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(ZERO), lambda s, t: s + t)


def doubles(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def l2sq(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm_sq(a: Column) -> Column:
    return total(F.transform(a, lambda x: x * x))


def norm(a: Column) -> Column:
    return F.sqrt(norm_sq(a))


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def normalize(a: Column) -> Column:
    """Unchanged if the norm is at most 1e-10."""
    return let(norm(a), lambda n: F.when(n > 1e-10, F.transform(a, lambda x: x / n)).otherwise(a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is at most 1e-10."""
    n = norm(a) * norm(b)
    return F.when(n > 1e-20, dot(a, b) / n).otherwise(F.lit(ZERO))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def matvec(matrix: Column, v: Column) -> Column:
    """Rows of the matrix (ARRAY<ARRAY<DOUBLE>>) times v."""
    return F.transform(matrix, lambda row: dot(row, v))


def pad(v: Column, to: int) -> Column:
    return F.concat(v, F.array_repeat(F.lit(ZERO), F.lit(to) - F.size(v)))


def next_power_of_2(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


# --- 8-bit scalar codes -------------------------------------------------------------------------------------------


def sq8_encode(x: Column, lo: Column, hi: Column) -> Column:
    unit = F.transform(F.arrays_zip(x.alias("x"), lo.alias("lo"), hi.alias("hi")), lambda p: (p["x"] - p["lo"]) / (p["hi"] - p["lo"]))
    return F.transform(unit, lambda u: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), u)) * 255).cast("int"))


def sq8_decode(code: Column, lo: Column, hi: Column) -> Column:
    step = F.zip_with(hi, lo, lambda h, m: (h - m) / 255)
    return F.zip_with(lo, F.zip_with(code, step, lambda c, s: c * s), lambda m, t: m + t)


# --- sign codes ---------------------------------------------------------------------------------------------------


def sign_encode(x: Column, c: Column) -> Column:
    """STRUCT<signs ARRAY<INT>, n2, o2, l1>: 1 where x exceeds c, with the sums the estimate needs."""
    r = minus(x, c)
    return F.struct(
        F.transform(r, lambda v: F.when(v > 0, 1).otherwise(0)).alias("signs"), norm_sq(r).alias("n2"), norm_sq(x).alias("o2"), total(F.transform(r, F.abs)).alias("l1")
    )


def sign_dp(code: Column, d: int) -> Column:
    """The stored multiplier sqrt(n2) / (l1 / (sqrt(n2) sqrt(d))), with guards for tiny norms."""
    n2, l1 = code["n2"], code["l1"]
    nd = l1 * F.when(n2 < 1e-10, F.lit(1.0)).otherwise(1 / F.sqrt(n2)) / (d**0.5)
    return F.when(F.abs(nd) < 1e-10, F.lit(1.0)).otherwise(1 / nd) * F.sqrt(n2)


def sign_distance(code: Column, q: Column, c: Column, d: int) -> Column:
    """Estimated squared distance of the coded vector to q; at least 0."""
    p = minus(q, c)
    fd = total(F.zip_with(code["signs"], p, lambda s, v: F.when(s == 1, v).otherwise(-v))) / (d**0.5)
    return F.greatest(F.lit(0.0), code["n2"] + norm_sq(p) - 2 * sign_dp(code, d) * fd)


def sign_error(code: Column, q: Column, c: Column, d: int) -> Column:
    """Half-width of the estimate's error bound (1.9 standard errors), times the query's distance to the centroid."""
    ratio = (code["n2"] * d / 4) / ((code["l1"] / 2) * (code["l1"] / 2))
    e = F.when(ratio > 1, F.sqrt(code["n2"]) * 1.9 * F.sqrt((ratio - 1) / (d - 1))).otherwise(F.lit(0.0))
    return 2 * e * F.sqrt(norm_sq(minus(q, c)))


# --- codebook codes -----------------------------------------------------------------------------------------------


def book_encode(v: Column, boundaries: Column) -> Column:
    """Number of boundaries strictly below each value: a value on a boundary takes the lower cell."""
    return F.transform(v, lambda x: F.size(F.filter(boundaries, lambda b: b < x)))


def book_decode(code: Column, centroids: Column) -> Column:
    return F.transform(code, lambda i: F.get(centroids, i))


def split_tables(q: Column, centroids: Column) -> Column:
    """For each dimension of q the squared distance to each centroid: computed once a query."""
    return F.transform(q, lambda x: F.transform(centroids, lambda c: (c - x) * (c - x)))


def table_distance(tables: Column, code: Column) -> Column:
    """The coded distance by table look-ups."""
    return total(F.zip_with(tables, code, lambda t, i: F.get(t, i)))


def sq8_query(q: Column, lo: Column, hi: Column) -> Column:
    """A query in units of the 8-bit codes."""
    return F.zip_with(F.zip_with(q, lo, lambda a, b: a - b), F.zip_with(hi, lo, lambda a, b: (a - b) / 255), lambda a, s: a / s)


def sq8_query_distance(code: Column, prepared: Column, lo: Column, hi: Column) -> Column:
    """The distance in code units times the mean squared step: an approximation, exact where all steps are equal."""
    steps = F.zip_with(hi, lo, lambda a, b: ((a - b) / 255) * ((a - b) / 255))
    return total(F.zip_with(code, prepared, lambda c, p: (c - p) * (c - p))) * total(steps) / F.size(steps)
