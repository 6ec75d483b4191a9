"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, save, sized, small_batches

# The kinds, in this order, with their patterns and least lengths.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: A candidate is cut at each '=' inside it; those at its end are padding of the last token.
TOKEN, TOKEN_LEAST = re.compile(r"[A-Za-z0-9+/_-]+(?:=+(?![A-Za-z0-9+/_=-]))?"), 16
ALPHABETS = {"digits": "0123456789", "hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}

#: Strings drawn from the natural law for each encoding and length.
DRAWS = 4000
#: Weight of the logarithms of the p-values of runs and serial correlation beside that of chi-squared, which tells words and random letters apart best.
SECONDARY = 0.25
_CODE = np.full((len(ALPHABETS), 256), -1, np.int16)
for _i, _a in enumerate(ALPHABETS.values()):
    for _j, _c in enumerate(_a):
        _CODE[_i, ord(_c)] = _j
_CODE[-1, ord("-")], _CODE[-1, ord("_")] = 62, 63
_SIZE = [len(a) for a in ALPHABETS.values()]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within a kind; matches that fail a length are dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def encoding(raw: np.ndarray) -> int:
    """The smallest alphabet that holds every letter."""
    return next(i for i in range(len(_SIZE)) if _CODE[i, raw].min() >= 0)


def battery(codes: np.ndarray, k: int) -> np.ndarray:
    """(N, 3): chi-squared of uniformity over the alphabet of k letters, the standard score of the number of runs above and below
    the alphabet's middle, and that of the serial correlation of neighbours, the last two without sign, of N strings (N, n) of codes."""
    rows, n = codes.shape
    counts = np.bincount((np.arange(rows)[:, None] * k + codes).ravel(), minlength=rows * k).reshape(rows, k).astype(float)
    chi = (counts * counts).sum(axis=1) * k / n - n
    above = codes >= k / 2
    up = above.sum(axis=1)
    mean = 1 + 2 * up * (n - up) / n
    sd = np.sqrt(np.maximum((mean - 1) * (mean - 2), 0) / (n - 1))
    runs = np.abs(1 + (above[:, 1:] != above[:, :-1]).sum(axis=1) - mean) / np.where(sd > 1e-3, sd, 1)
    runs = np.where(sd > 1e-3, runs, 9.0)
    x = codes - (k - 1) / 2
    serial = np.abs((x[:, 1:] * x[:, :-1]).sum(axis=1)) / ((k * k - 1) / 12 * math.sqrt(n - 1))
    return np.stack([chi, runs, serial], axis=1)


def length_bin(n: int) -> int:
    """Lengths to 64 are their own bins; beyond, there are two for each doubling. A longer token's statistics are brought to its bin's length."""
    return n if n <= 64 else int(64 * 2 ** (int(2 * math.log2(n / 64)) / 2))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        base, found = [], []
        pairs = np.zeros(4096, np.int64)
        for t in texts:
            t = t or ""
            spans = base_spans(t)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            code = _CODE[-1, np.frombuffer(t.encode("ascii", "replace"), np.uint8)].astype(np.int32)
            both = (code[1:] >= 0) & (code[:-1] >= 0)
            pairs += np.bincount((code[:-1] * 64 + code[1:])[both], minlength=4096)
            own = []
            for m in (m for c in CANDIDATE.finditer(t) for m in TOKEN.finditer(t, c.start(), c.end())):
                w = m[0].rstrip("=")
                if len(w) < TOKEN_LEAST or any(s < m.end() and m.start() < e for s, _, e in spans):
                    continue
                raw = np.frombuffer(w.encode(), np.uint8)
                e = encoding(raw)
                n, size = len(raw), length_bin(len(raw))
                chi, runs, serial = battery(_CODE[e, raw][None, :].astype(np.int64), _SIZE[e])[0].tolist()
                h = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "big", signed=True)
                own.append({"start": m.start(), "end": m.end(), "enc": e, "n": size, "h": h, "chi": chi * size / n, "runs": runs * (size / n) ** 0.5, "serial": serial * (size / n) ** 0.5})
            found.append(own)
        at = np.flatnonzero(pairs)
        first = [[{"pair": int(i), "n": int(pairs[i])} for i in at]] + [[]] * (len(texts) - 1) if texts else []
        yield pa.RecordBatch.from_arrays([ids, pa.array(base, _BASE), pa.array(found, _FOUND), pa.array(first, _PAIRS)], ["doc_id", "base", "found", "pairs"])


_I, _L, _D = pa.int32(), pa.int64(), pa.float64()
_BASE = pa.list_(pa.struct([("start", _I), ("kind", _I), ("end", _I)]))
_FOUND = pa.list_(pa.struct([("start", _I), ("end", _I), ("enc", _I), ("n", _I), ("h", _L), ("chi", _D), ("runs", _D), ("serial", _D)]))
_PAIRS = pa.list_(pa.struct([("pair", _I), ("n", _L)]))
_SCHEMA = "doc_id long, base array<struct<start:int,kind:int,end:int>>, found array<struct<start:int,end:int,enc:int,n:int,h:bigint,chi:double,runs:double,serial:double>>, pairs array<struct<pair:int,n:bigint>>"


def _upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > 1e-12 * total:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 300):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-10:
            break
    return scale * h


class Law:
    """What the battery gives for natural strings of one encoding and length: letters follow each other as in the corpus's words.

    A test's p-value is the share of natural strings that look at least as random; that of chi-squared follows a normal law
    of its logarithm, so that it can be smaller than one in DRAWS. The three are combined by the weighted sum of their logarithms, whose
    natural law is a gamma distribution with the mean and variance of the draws, which takes in that the tests depend on each other.
    """

    def __init__(self, pairs: np.ndarray, enc: int, n: int):
        k = _SIZE[enc]
        at = [ALPHABETS["base64"].index(c) for c in list(ALPHABETS.values())[enc]]
        m = pairs.reshape(64, 64).astype(float)
        if enc == 2:  # capitals follow each other as small letters do
            m = m.copy()
            m[:26, :26] += m[26:52, 26:52]
        m = m[np.ix_(at, at)] + 1e-3 * (1 + m.sum() / 4096)
        r = np.random.default_rng([enc, n])
        cut = np.cumsum(m, axis=1) / m.sum(axis=1, keepdims=True)
        codes = np.zeros((DRAWS, n), np.int64)
        codes[:, 0] = r.choice(k, DRAWS, p=m.sum(axis=1) / m.sum())
        for i in range(1, n):
            codes[:, i] = np.minimum(k - 1, (cut[codes[:, i - 1]] < r.random(DRAWS)[:, None]).sum(axis=1))
        s = battery(codes, k)
        log = np.log1p(np.maximum(s[:, 0], 0))
        self.mean, self.sd = float(log.mean()), float(max(log.std(), 1e-3))
        self.runs, self.serial = np.sort(s[:, 1]), np.sort(s[:, 2])
        t = np.array([self.fisher(*x) for x in s])
        self.scale, self.shape = float(t.var() / t.mean()), float(t.mean() ** 2 / t.var())

    def fisher(self, chi: float, runs: float, serial: float) -> float:
        z = (math.log1p(max(chi, 0)) - self.mean) / self.sd
        lower = math.log(max(0.5 * math.erfc(-z / math.sqrt(2)), 1e-300))
        share = lambda null, x: math.log((1 + int(np.searchsorted(null, x, side="right"))) / (1 + len(null)))
        return -2 * (lower + SECONDARY * (share(self.runs, runs) + share(self.serial, serial)))

    def p(self, chi: float, runs: float, serial: float) -> float:
        return _upper_gamma(self.shape, self.fisher(chi, runs, serial) / self.scale)


def scan(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """(doc_id, base, spans) for each row: base and all spans as arrays of (start, kind, end), sorted by start, then kind.

    Offsets count code points, ends are exclusive. Kind 3 ('random') holds tokens of 16 or more letters that overlap no
    fixed pattern and pass the battery. Every such token has a p-value: how likely a natural string of its encoding and
    length looks as random. Natural strings are drawn from the counts of letter pairs over all documents. Benjamini-Hochberg
    over all different tokens holds the share of natural ones among those reported to the rate; p-values are counted in
    fiftieths of a decade, as a histogram. Null and empty texts have no spans; very long texts and tokens are read
    whole; rows that repeat an id or a text have spans each, and copies of a token are one hypothesis; other columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    found = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, _SCHEMA).withColumn("rid", F.monotonically_increasing_id()), "secrets")
    pairs = np.zeros(4096, np.int64)
    for i, n in found.select(F.explode("pairs").alias("x")).groupBy("x.pair").agg(F.sum("x.n")).collect():
        pairs[i] = n
    tokens = found.select(F.explode("found").alias("x")).select("x.*").select("enc", "n", "h", "chi", "runs", "serial").dropDuplicates(["h"])
    tokens = save(tokens, "tokens")
    laws = {(r[0], r[1]): Law(pairs, r[0], r[1]) for r in tokens.select("enc", "n").distinct().collect()}

    @F.pandas_udf("int")
    def depth(enc: pd.Series, n: pd.Series, chi: pd.Series, runs: pd.Series, serial: pd.Series) -> pd.Series:
        return pd.Series([int(-50 * math.log10(max(laws[e, m].p(*x), 1e-300))) for e, m, *x in zip(enc, n, chi, runs, serial, strict=True)], dtype="int32")

    ranked = save(tokens.select("h", depth("enc", "n", "chi", "runs", "serial").alias("depth")), "ranked")
    limit = threshold({r[0]: r[1] for r in ranked.groupBy("depth").count().collect()}, rate)
    release(tokens)
    if limit is None:
        return found.select("doc_id", "base", F.col("base").alias("spans"))
    hits = save(ranked.where(F.col("depth") >= limit).select("h"), "hits")
    rows = found.select("rid", F.explode("found").alias("x")).join(sized(hits, 8), F.col("x.h") == F.col("h"), "left_semi")
    rows = save(rows.groupBy("rid").agg(F.collect_list(F.struct(F.col("x.start").alias("start"), F.lit(3).alias("kind"), F.col("x.end").alias("end"))).alias("more")), "random")
    out = found.join(sized(rows, 128), "rid", "left")
    none = F.from_json(F.lit("[]"), "array<struct<start:int,kind:int,end:int>>")
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def threshold(seen: dict[int, int], rate: float) -> int | None:
    """Benjamini-Hochberg: the least depth (fiftieths of a decade of p) that is rejected, with p taken at its bin's upper end."""
    tested, done, best = sum(seen.values()), 0, None
    for d in sorted(seen, reverse=True):
        done += seen[d]
        if 10 ** (-d / 50) * tested <= rate * done:
            best = d
    return best


def joined(spans: str, kinds: tuple[str, ...]) -> F.Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame, kinds: tuple[str, ...], base: int, *more: F.Column) -> DataFrame:
    """doc_id, n_<kind> for the base kinds, base_sha256, spans and more columns of a frame with (doc_id, base, spans)."""
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long").alias(f"n_{kinds[i]}")
    counts = [count(i) for i in range(base)]
    return found.select("doc_id", *counts, F.sha2(joined("base", kinds), 256).alias("base_sha256"), joined("spans", kinds).alias("spans"), *more)
