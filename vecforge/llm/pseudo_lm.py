"""LM scoring by masked pseudo-likelihood: a bidirectional window network predicts every token from both sides."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, save, small_batches

#: Codes are pairs of SIDE x SIDE digits; the last OPEN codes are classes of all words without a code of their own.
SIDE, OPEN = 32, 32
WINDOW, DIM, HIDDEN = 2, 12, 32
#: Counters of the words without a code: a class's words have probabilities by their counters.
COUNTERS = 1 << 18
#: Each document trains in one of ROUNDS rounds; after each, the models of all shards are averaged. A shard holds about SHARD tokens of a round.
ROUNDS, SHARD = 8, 500_000
_SPACE = r"[ \t\n\x0B\f\r]+"
_PAD = SIDE * SIDE
_FIRST = SIDE * SIDE - OPEN


def vocabulary(docs: DataFrame) -> tuple[dict[bytes, int], np.ndarray, int]:
    """Code of each of the SIDE * SIDE - OPEN most frequent words, counted over all documents (ties by the word); for each
    counter the logarithm of the probability of one of its words in its class; the number of tokens."""
    words = docs.select(F.explode(F.split("text", _SPACE)).alias("w")).where("w <> ''")
    counts = save(words.groupBy("w").agg(F.count("*").alias("n")), "counts")
    top = [r[0] for r in counts.orderBy(F.desc("n"), "w").limit(_FIRST).select("w").collect()]
    codes = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(top)}
    c = F.pmod(F.crc32(F.encode("w", "utf-8")), F.lit(COUNTERS)).alias("c")
    got = counts.select(c, "n").groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("d")).toArrow()
    n, d = np.zeros(COUNTERS), np.zeros(COUNTERS)
    at = got["c"].to_numpy()
    n[at], d[at] = got["n"].to_numpy(), got["d"].to_numpy()
    total = int(n.sum())
    for r in counts.orderBy(F.desc("n"), "w").limit(_FIRST).select("w", "n").collect():
        i = zlib.crc32(r[0].encode("utf-8", "surrogatepass")) % COUNTERS
        n[i] -= r[1]
        d[i] -= 1
    whole = np.bincount(np.arange(COUNTERS) % OPEN, weights=n, minlength=OPEN)
    share = np.maximum(n, 1) / np.maximum(d, 1) / np.maximum(whole, 1)[np.arange(COUNTERS) % OPEN]
    release(counts)
    return codes, np.log(share).astype(np.float32), total


def tokens(text: str | None, codes: dict[bytes, int]) -> list[int]:
    """A word's code, or _PAD + 1 + its counter."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    return [c if (c := codes.get(w)) is not None else _PAD + 1 + zlib.crc32(w) % COUNTERS for w in words]


def code_of(t: np.ndarray) -> np.ndarray:
    return np.where(t > _PAD, _FIRST + (t - _PAD - 1) % OPEN, t)


class Network:
    """p(code | 2 words to each side) = p(high digit | h) p(low digit | h, high digit), with h = tanh of the sum of a table's rows, one table a side and distance.

    The hidden layer's product with the embeddings is folded into the tables T (2 WINDOW, codes + 1, HIDDEN), so a token costs
    four row look-ups and two small products.
    """

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        s = HIDDEN**-0.5
        self.p = {
            "E": r.normal(0, 0.5, (_PAD + 1, DIM)), "W": r.normal(0, (2 * WINDOW * DIM) ** -0.5, (2 * WINDOW, DIM, HIDDEN)), "b": np.zeros(HIDDEN),
            "A": r.normal(0, s, (HIDDEN, SIDE)), "a": np.zeros(SIDE), "B": r.normal(0, s, (HIDDEN, SIDE)), "D": np.zeros((SIDE, SIDE)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def step(self, ctx: np.ndarray, gold: np.ndarray, rate: float) -> float:
        """One step of gradient descent, with an accumulated squared gradient for each parameter."""
        p, n = self.p, len(gold)
        e = p["E"][ctx].reshape(n, -1)
        w = p["W"].reshape(-1, HIDDEN)
        h = np.tanh(e @ w + p["b"])
        hi, lo, rows = gold // SIDE, gold % SIDE, np.arange(n)
        pa_, pb = _softmax(h @ p["A"] + p["a"]), _softmax(h @ p["B"] + p["D"][hi])
        loss = -float(np.log(pa_[rows, hi] * pb[rows, lo] + 1e-12).mean())
        pa_[rows, hi] -= 1
        pb[rows, lo] -= 1
        dh = (pa_ @ p["A"].T + pb @ p["B"].T) * (1 - h * h)
        de = (dh @ w.T).reshape(-1, DIM)
        at = ctx.ravel()
        g = {"A": h.T @ pa_, "a": pa_.sum(axis=0), "B": h.T @ pb, "b": dh.sum(axis=0), "W": (e.T @ dh).reshape(p["W"].shape)}
        first = np.zeros((n, SIDE), np.float32)
        first[rows, hi] = 1
        g["D"] = first.T @ pb
        g["E"] = np.stack([np.bincount(at, weights=de[:, j], minlength=_PAD + 1) for j in range(DIM)], axis=1).astype(np.float32)
        for k, v in g.items():
            v /= n
            self.m[k] += v * v
            p[k] -= rate * v / (np.sqrt(self.m[k]) + 1e-6)
        return loss

    def tables(self) -> np.ndarray:
        return np.einsum("vd,jdh->jvh", self.p["E"], self.p["W"], optimize=True)

    def positions(self, flat: np.ndarray, log_share: np.ndarray, tables: np.ndarray, block: int = 16384) -> np.ndarray:
        """log p(token | both sides) at every place of flat (documents with WINDOW pads before each and after the last); 0 at pads."""
        p, out = self.p, np.zeros(len(flat))
        code = code_of(flat)
        places = np.flatnonzero(flat != _PAD)
        for at in range(0, len(places), block):
            i = places[at : at + block]
            h = tables[0][code[i - 2]]
            for j, shift in enumerate((-1, 1, 2), 1):
                h += tables[j][code[i + shift]]
            h += p["b"]
            np.tanh(h, out=h)
            g, rows = code[i], np.arange(len(i))
            hi = g // SIDE
            total = np.zeros(len(i))
            for z, pick in ((h @ p["A"] + p["a"], hi), (h @ p["B"] + p["D"][hi], g % SIDE)):
                z -= z.max(axis=1)[:, None]
                total += z[rows, pick]
                np.exp(z, out=z)
                total -= np.log(z.sum(axis=1))
            open_ = flat[i] > _PAD
            total[open_] += log_share[flat[i][open_] - _PAD - 1]
            out[i] = total
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _joined(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All documents' tokens in one array with WINDOW pads before each and after the last, and each document's first place."""
    values, at = column.flatten().to_numpy(), column.value_lengths().to_numpy(zero_copy_only=False)
    at = np.where(np.isnan(at), 0, at).astype(np.int64) if at.dtype.kind == "f" else at.astype(np.int64)
    starts = np.cumsum(at) - at + WINDOW * np.arange(1, len(at) + 1)
    flat = np.full(len(values) + WINDOW * (len(at) + 1), _PAD, np.int32)
    flat[np.arange(len(values)) + np.repeat(WINDOW * np.arange(1, len(at) + 1), at)] = values
    return flat, starts


def _trained(start: np.ndarray | None, rate: float, batch: int = 1024):
    """One model for each shard, trained from start on every position of its documents in a hashed order; emitted as (index, tokens * value) to be averaged."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending")])
        flat = _joined(table.column("tokens").combine_chunks())[0]
        code = code_of(flat).astype(np.int64)
        places = np.flatnonzero(flat != _PAD)
        net = Network()
        if start is not None:
            net.load(start)
        order = np.random.default_rng(len(places)).permutation(places)
        for at in range(0, len(order), batch):
            i = order[at : at + batch]
            net.step(np.stack([code[i - 2], code[i - 1], code[i + 1], code[i + 2]], axis=1), code[i], rate)
        v = np.concatenate([[1.0], net.flat()]) * len(places)
        return pa.table({"i": pa.array(np.arange(len(v)), pa.int32()), "v": v})

    return run


def train(coded: DataFrame, total: int) -> Network:
    """Local stochastic gradient on shards of about SHARD tokens, ROUNDS rounds, each over another part of the documents, so that
    every position of the corpus trains once. After a round the models are averaged, weighted by their tokens (by Spark: the
    driver gets one model), and the next starts from there. Shards are dealt by a hash of id and text, so the model
    doesn't depend on how the table is laid out in files."""
    net = Network()
    shards = max(1, round(total / ROUNDS / SHARD))
    for r in range(ROUNDS):
        own = coded.where(F.pmod("h", F.lit(ROUNDS)) == r).select(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"), "h", "tokens")
        part = own.groupBy("shard").applyInArrow(_trained(net.flat() if r else None, 0.1 * (1 - r / ROUNDS) + 0.01), "i int, v double")
        got = part.groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        v = np.zeros(len(net.flat()) + 1)
        v[got["i"].to_numpy()] = got["v"].to_numpy()
        if v[0]:
            net.load(v[1:] / v[0])
    return net


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, log_prob, per_token) for each row: the summed conditional log-probabilities (natural) of the whole
    text's words, and their mean. Null and empty texts have 0 tokens, log_prob 0 and a null mean; very long texts are scored
    whole; equal texts have equal scores, rows that repeat an id a score each; other columns are ignored; an empty table gives an empty table."""
    small_batches(docs.sparkSession)
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    codes, share, total = vocabulary(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([tokens(t, codes) for t in batch.column(2).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "h", "tokens"])

    kind = text.schema["doc_id"].dataType.simpleString()
    coded = text.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(encode, f"doc_id {kind}, h long, tokens array<int>")
    coded = save(coded, "coded")
    net = train(coded.where("size(tokens) > 0"), total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in batches:
            flat, starts = _joined(batch.column(1))
            sums = np.add.reduceat(net.positions(flat, share, tables), np.minimum(starts, len(flat) - 1)) if len(starts) else np.zeros(0)
            n = np.diff(np.append(starts, len(flat))) - WINDOW
            mean = pa.array(np.where(n > 0, sums / np.maximum(n, 1), 0), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(np.where(n > 0, sums, 0.0)), mean], ["doc_id", "n_tokens", "log_prob", "per_token"])

    return coded.select("doc_id", "tokens").mapInArrow(run, f"doc_id {kind}, n_tokens long, log_prob double, per_token double")
