"""Mixing sources to target weights by soft domain membership."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, release, save, sized, small_batches, tidy

DOMAINS = ("good", "poor", "toxic")
#: Share of all kept tokens that each domain should have.
TARGETS = (0.75, 0.25, 0.0)
DIM = 1 << 14
#: Labelled rows the classifier is fitted on at most.
SAMPLE = 4000


def _features(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashed words with weights log(1 + count), scaled to length 1, and the number of words."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.int64), np.empty(0), 0
    count = Counter(words)
    at = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) & (DIM - 1) for w in count), np.int64, len(count))
    v = np.log1p(np.fromiter(count.values(), np.float64, len(count)))
    return at, v / np.sqrt((v * v).sum()), len(words)


class Classifier:
    """Multinomial logistic regression over hashed words; a text without words gets the labelled rows' shares."""

    def __init__(self, weights: np.ndarray, prior: np.ndarray):
        self.w, self.prior = weights, prior

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 0, rate: float = 8.0, decay: float = 2e-5, seed: int = 3) -> Classifier:
        """rows: features and domain of each. epochs 0: as many as make about 40 000 steps of one row, between 5 and 25."""
        k = len(DOMAINS)
        epochs = epochs or max(5, min(25, 40_000 // max(1, len(rows))))
        prior = np.bincount([r[2] for r in rows], minlength=k) + 1.0
        prior /= prior.sum()
        x = [r[:2] for r in rows]
        y = np.array([r[2] for r in rows], np.int64)
        w = np.zeros((DIM + 1, k))
        w[DIM] = np.log(prior)
        r = np.random.default_rng(seed)
        for e in range(epochs):
            order = r.permutation(len(rows))
            lr = rate / (1 + e)
            for a in range(0, len(order), 16):
                pick = order[a : a + 16]
                at = np.concatenate([x[i][0] for i in pick])
                v = np.concatenate([x[i][1] for i in pick])
                own = np.repeat(np.arange(len(pick)), [len(x[i][0]) for i in pick])
                z = np.zeros((len(pick), k)) + w[DIM]
                np.add.at(z, own, w[at] * v[:, None])
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(pick)), y[pick]] -= 1
                np.add.at(w, at, -lr * v[:, None] * p[own])
                w[DIM] -= 0.02 * lr * p.mean(axis=0)
            w[:DIM] *= (1 - decay) ** len(order)
        return cls(w.astype(np.float32), prior)

    def posterior(self, text: str | None) -> tuple[np.ndarray, int]:
        at, v, n = _features(text)
        if not n:
            return self.prior, 0
        z = self.w[DIM] + v @ self.w[at]
        p = np.exp(z - z.max())
        return p / p.sum(), n


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [_features(t)[:2] for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tolist() for a, _ in got], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in got], pa.list_(pa.float64()))], ["doc_id", "y", "at", "v"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fits on at most `sample` labelled documents, those with the least hash of the id. Rows with a null label or id teach
    nothing; an id labelled twice takes its largest labels; of rows that repeat an id one teaches. Without labelled rows all
    domains are even. The driver gets the hashed features of the sample, never texts."""
    lab = labels.select(F.col("doc_id").cast("long").alias("_lab"), F.col("quality").cast("int").alias("_q"), F.col("toxic").cast("int").alias("_t")).where("_lab is not null and _q is not null and _t is not null")
    lab = lab.groupBy("_lab").agg(F.max("_q").alias("_q"), F.max("_t").alias("_t"))
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    chosen = lab.join(there, F.col("_lab") == F.col("doc_id"), "left_semi").orderBy(F.xxhash64("_lab"), "_lab").limit(sample)
    chosen = save(chosen.select("_lab", F.when(F.col("_t") == 1, 2).when(F.col("_q") == 1, 0).otherwise(1).alias("y")), "labelled")
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sized(chosen, 16), F.col("doc_id") == F.col("_lab"))
    own = own.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = own.mapInArrow(_featured, "doc_id long, y int, at array<int>, v array<double>").toArrow()
    release(chosen)
    return Classifier.fit(_rows(got))


def _rows(got: pa.Table) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features and domain of each row of (doc_id, y, at, v), by doc_id: views into the table, of which no second copy is made."""
    rows = []
    for batch in got.to_batches():
        at, v = batch.column(2), batch.column(3)
        words, weights = at.values.to_numpy(), v.values.to_numpy()
        cuts = zip(at.offsets.to_pylist()[:-1], at.offsets.to_pylist()[1:], v.offsets.to_pylist()[:-1], v.offsets.to_pylist()[1:], strict=True)
        rows += [(i, (words[a:b], weights[c:d], k)) for i, k, (a, b, c, d) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), cuts, strict=True)]
    return [row for _, row in sorted(rows, key=lambda r: r[0])]


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with n_tokens (words of the whole text) and posterior (array of a probability for each domain)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("n_tokens", "posterior", "rate", "reached", "converged")
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.posterior(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([n for _, n in got], pa.int64()), pa.array([[float(x) for x in p] for p, _ in got], pa.list_(pa.float64()))], [*batch.schema.names, "n_tokens", "posterior"]
            )

    return docs.mapInArrow(run, extended(docs, n_tokens="long", posterior="array<double>"))


def rates(p: np.ndarray, moves: list[np.ndarray]) -> np.ndarray:
    """Rates of documents with posteriors p (n, K) after the given steps r <- max(0, r - p . move): a pure function of a document's posterior."""
    r = np.ones(len(p))
    for m in moves:
        r = np.maximum(0.0, r - p @ m)
    return r


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(len(DOMAINS))], axis=1)


def _sums(flat: DataFrame, moves: list[np.ndarray], tries: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each step in tries, taken after moves: the domains' token totals at the rates, and the token-weighted Gram matrix of
    the posteriors of documents whose rate is over 0. One row from each partition, then their sum."""
    k = len(DOMAINS)
    width = len(tries) * (k + k * k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(tries), k + k * k))
        for batch in batches:
            p, t = _matrix(batch, 1), batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            before = rates(p, moves)
            for i, m in enumerate(tries):
                r = np.maximum(0.0, before - p @ m)
                total[i, :k] += (t * r) @ p
                total[i, k:] += ((p * (t * (r > 0))[:, None]).T @ p).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["s"])

    got = flat.mapInArrow(run, "s array<double>").agg(*[F.sum(F.get("s", F.lit(i))) for i in range(width)]).first()
    got = np.array([x or 0.0 for x in got]).reshape(len(tries), -1)
    return [(g[:k], g[k:].reshape(k, k)) for g in got]


#: Lengths of step that a round tries at once.
STEPS = (1.0, 0.5, 0.2, 0.05, 0.02)
#: After so many rounds the driver lets go of what finished rounds have left.
TIDY = 4
#: Domain totals (shares of all tokens) this near to their targets end the fit.
TOLERANCE = 5e-3


def fit(flat: DataFrame, targets: tuple[float, ...] = TARGETS, rounds: int = 200, tolerance: float = TOLERANCE) -> tuple[list[np.ndarray], np.ndarray]:
    """Projected gradient for min over r >= 0 of sum over k w_k (sum over d r_d t_d p_dk / T - target_k)^2 / 2.

    T is the number of tokens, so rates of 1 keep everything; w_k = 1 / (target_k + 0.1), so that small targets count too. In the metric that weighs a document by its share of tokens
    the gradient of a document's rate is p_d . (w residual). Steps go along it in the metric of the token-weighted Gram matrix of
    the documents whose rate is over 0 (which takes out the posteriors' correlation), in several lengths, and along the plain
    gradient; the best is taken. The state is the list of steps, so a round is one aggregation of a few sums and nothing is
    kept for each document. It ends when all totals are within the tolerance of their targets, or no step comes nearer.
    Returns the steps and the totals that the rates reach.
    """
    k = len(DOMAINS)
    total = float(flat.agg(F.sum("n_tokens")).first()[0] or 0)
    if not total:
        return [], np.zeros(k)
    goal, moves = np.array(targets), []
    (at, gram), *_ = _sums(flat, [], [np.zeros(k)])
    whole, w = np.linalg.eigvalsh(gram / total)[-1], 1 / (goal + 0.1)
    for _ in range(rounds):
        off = at / total - goal
        if np.abs(off).max() < tolerance:
            break
        along = np.linalg.solve(gram / total + 1e-9 * max(whole, 1e-9) * np.eye(k), off)
        tries = [s * along for s in STEPS] + [w * off / (whole * w.max())]
        sums = _sums(flat, moves, tries)
        best = min(range(len(tries)), key=lambda i: float((w * (sums[i][0] / total - goal) ** 2).sum()))
        if (w * (sums[best][0] / total - goal) ** 2).sum() >= (w * off * off).sum() * (1 - 1e-9):
            break
        moves.append(tries[best])
        if len(moves) % TIDY == 0:
            tidy(flat.sparkSession)
        at, gram = sums[best]
    return moves, at / total


def mix(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """docs with n_tokens, posterior, rate (the nonnegative factor by which to draw each document), and, the same in every row,
    reached (the domains' expected shares at the rates) and converged (all within TOLERANCE of the targets).

    Every row stays, also at rate 0; rows that repeat an id are rows like any other, and equal texts get equal rates. Null and
    empty texts have 0 tokens, the labelled shares as posterior, and a rate like any other. Very long texts count whole. Columns
    of docs that clash with the new ones are replaced; an empty table gives an empty table.
    """
    scored = save(score(docs, train(docs, labels)), "scored")
    flat = save(scored.select("n_tokens", *[F.get("posterior", F.lit(i)).alias(f"p{i}") for i in range(len(DOMAINS))]), "posteriors")
    moves, reached = fit(flat, targets)
    release(flat)

    @F.pandas_udf("double")
    def rate(*p: pd.Series) -> pd.Series:
        return pd.Series(rates(np.stack([x.to_numpy() for x in p], axis=1), moves))

    near = bool(np.abs(reached - np.array(targets)).max() <= TOLERANCE)
    return scored.withColumn("rate", rate(*[F.get("posterior", F.lit(i)) for i in range(len(DOMAINS))])).withColumn("reached", F.array(*[F.lit(float(x)) for x in reached])).withColumn("converged", F.lit(near))
