"""Language ID: a bidirectional gated recurrent network over bytes, trained by backpropagation through time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import extended, save, sized, small_batches

UNKNOWN = "und"
HIDDEN, WINDOW = 8, 64


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGRU:
    """Parameters for two directions d: byte table E[d] (3H x 256), U[d] (3H x H), bias of the candidate c[d], output O[d] (L x H), o (L).

    The text is read in windows of WINDOW bytes, each from a zero state in both directions; features come first and
    windows last in every array, so that a step is one matrix product over all windows.
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        s = hidden**-0.5
        self.p = {
            "E": r.normal(0, 0.3, (2, 3 * hidden, 256)), "U": r.normal(0, s, (2, 3 * hidden, hidden)), "c": np.zeros((2, hidden, 1)),
            "O": r.normal(0, s, (2, len(labels), hidden)), "o": np.zeros((len(labels), 1)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _states(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """x: bytes (T, B). Returns states (2, T, H, B) and, to train, what each step made."""
        (t_all, b), n = x.shape, self.h
        hs, tape = np.empty((2, t_all, n, b), np.float32), []
        for d in range(2):
            e, u, c = self.p["E"][d], self.p["U"][d], self.p["c"][d]
            h, made = np.zeros((n, b), np.float32), []
            for t in range(t_all) if d == 0 else range(t_all - 1, -1, -1):
                g = e[:, x[t]]
                v = u @ h
                zr = g[: 2 * n]
                zr += v[: 2 * n]
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                z, r = zr[:n], zr[n:]
                q = v[2 * n :] + c
                cand = np.tanh(g[2 * n :] + r * q)
                new = cand + z * (h - cand)
                if keep:
                    made.append((t, h, z, r, q, cand))
                h = new
                hs[d, t] = h
            tape.append(made)
        return hs, tape

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities (L, T, B) of every position."""
        hs, _ = self._states(x, keep=False)
        t, n, b = hs.shape[1:]
        y = np.empty((len(self.labels), t, b), np.float32)
        for i in range(t):
            y[:, i] = self.p["O"][0] @ hs[0, i] + self.p["O"][1] @ hs[1, i] + self.p["o"]
        y -= y.max(axis=0)
        np.exp(y, out=y)
        y /= y.sum(axis=0)
        return y

    def step(self, x: np.ndarray, mask: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over positions and its gradients; x, mask (T, B); gold (B)."""
        hs, tape = self._states(x, keep=True)
        (_, t_all, n, b), p = hs.shape, self.p
        y = np.einsum("dlh,dthb->ltb", p["O"], hs) + p["o"][:, :, None]
        y -= y.max(axis=0)
        y = np.exp(y)
        y /= y.sum(axis=0)
        total = mask.sum()
        loss = -float((np.log(y[gold, :, np.arange(b)].T + 1e-9) * mask).sum() / total)
        y[gold, :, np.arange(b)] -= 1
        y *= mask / total
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["o"] = y.sum(axis=(1, 2))[:, None]
        grad["O"] = np.einsum("ltb,dthb->dlh", y, hs)
        back = np.einsum("dlh,ltb->dthb", p["O"], y)
        for d in range(2):
            u, dh = p["U"][d], np.zeros((n, b), np.float32)
            for t, h, z, r, q, cand in reversed(tape[d]):
                dh = dh + back[d, t]
                dz = dh * (h - cand) * z * (1 - z)
                dc = dh * (1 - z) * (1 - cand * cand)
                dr = dc * q * r * (1 - r)
                dq = dc * r
                dv = np.concatenate([dz, dr, dq])
                dg = np.concatenate([dz, dr, dc])
                grad["U"][d] += dv @ h.T
                grad["c"][d] += dq.sum(axis=1, keepdims=True)
                np.add.at(grad["E"][d].T, x[t], dg.T)
                dh = dh * z + u.T @ dv
        return loss, grad

    def fit(self, windows: list[bytes], gold: np.ndarray, steps: int, batch: int = 192, rate: float = 0.02, seed: int = 11) -> BiGRU:
        r, m, v = np.random.default_rng(seed), {}, {}
        x, mask = pack([[w] for w in windows])[:2]
        for i in range(1, steps + 1):
            pick = r.integers(0, len(windows), batch)
            _, grad = self.step(x[:, pick], mask[:, pick], gold[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            lr = rate * (1 - 0.9 * i / steps)
            for k, g in grad.items():
                g = g * min(1, 1 / (norm + 1e-9))
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                self.p[k] -= (lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return self


def pack(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (T, B), their mask, and the document of each window; docs hold pieces of at most WINDOW bytes."""
    pieces = [w for d in docs for w in d]
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    flat = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in pieces), np.uint8).reshape(len(pieces), WINDOW)
    lens = np.array([len(w) for w in pieces])
    return np.ascontiguousarray(flat.T), (np.arange(WINDOW)[:, None] < lens).astype(np.float32), owner


def classify(model: BiGRU, texts: list[str | None], block: int = 2048) -> tuple[list[str], list[float]]:
    """Label and pooled probability of each whole text: the mean over the letters' positions (bytes of letters, all bytes above 127)."""
    out_l, out_s = [UNKNOWN] * len(texts), [0.0] * len(texts)
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    if not any(raw):
        return out_l, out_s
    counts = np.array([-(-len(b) // WINDOW) for b in raw])
    flat = np.frombuffer(b"".join(b.ljust(c * WINDOW, b"\0") for b, c in zip(raw, counts.tolist(), strict=True)), np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(raw)), counts)
    total = np.zeros((len(raw), len(model.labels)))
    seen = np.zeros(len(raw))
    for at in range(0, len(flat), block):
        x = np.ascontiguousarray(flat[at : at + block].T)
        y = model.positions(x)
        w = _LETTER[x]
        own = owner[at : at + block]
        sums = np.einsum("ltb,tb->bl", y, w)
        edge = np.flatnonzero(np.diff(own, prepend=-1))
        total[own[edge]] += np.add.reduceat(sums, edge)
        seen[own[edge]] += np.add.reduceat(w.sum(axis=0), edge)
    for i, t in enumerate(texts):
        if seen[i] and any(map(str.isalpha, t)):
            k = int(total[i].argmax())
            out_l[i], out_s[i] = model.labels[k], float(min(1.0, total[i, k] / seen[i]))
    return out_l, out_s


_LETTER = np.zeros(256, np.float32)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def train(docs: DataFrame, per_label: int = 400, pieces: int = 4, steps: int = 260) -> BiGRU | None:
    """Fits the network on a bounded sample of docs (text, lang): per_label different texts of each language (those of the
    least hash), and `pieces` windows spread over each. Every language of a row with letters is learned. None if no row has a text with letters and a lang."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null and text rlike '[^\\\\x00-\\\\x40]'")
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(5)))
    sizes = save(rows.select("lang", "h").distinct().groupBy("lang").count(), "langs")
    # about twice as many as wanted pass this, whatever the number of copies; then the least hashes are taken
    share = (2.0 * per_label + 40) / F.col("count")
    cut = [F.substring("text", F.greatest(F.lit(1), (F.length("text") * F.lit(j / pieces)).cast("int")), F.lit(WINDOW)).alias(f"p{j}") for j in range(pieces)]
    chosen = rows.join(sized(sizes, 64), "lang").where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / float(1 << 30) < share).select("lang", "h", *cut).distinct()
    w = Window.partitionBy("lang").orderBy("h", *[f"p{j}" for j in range(pieces)])
    got = chosen.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_label).drop("_n", "h").collect()
    labels = sorted({r["lang"] for r in got})
    at = {k: i for i, k in enumerate(labels)}
    pairs = sorted({(p.encode("utf-8", "surrogatepass")[:WINDOW], at[r["lang"]]) for r in got for p in r[1:] if p and any(map(str.isalpha, p))})
    return BiGRU(labels).fit([w for w, _ in pairs], np.array([k for _, k in pairs]), steps) if pairs else None


def predict(docs: DataFrame, model: BiGRU | None) -> DataFrame:
    """docs with lang_pred and score from the whole text, very long ones too; of tied languages the first by name. Null, empty or letterless
    texts, and all texts where no language was learned: 'und' with score 0. Columns of these names, in any case, are replaced."""
    small_batches(docs.sparkSession)
    rest = [f for f in docs.schema.fields if f.name.lower() not in ("lang_pred", "score")]
    at = next(i for i, f in enumerate(rest) if f.name.lower() == "text")
    own = docs.select(*[F.col(f"`{f.name.replace('`', '``')}`") for f in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            lang, score = classify(model, texts) if model else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return own.mapInArrow(run, extended(own, lang_pred="string", score="double"))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row. Rows whose crc32(doc_id as text) mod 4 is 2 are held out: they teach nothing.
    A null doc_id is not held out and teaches nothing; rows that repeat an id are rows each; other columns than text and lang are ignored; an empty table gives an empty table."""
    held = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4 == 2, F.lit(False))
    model = train(docs.where(~held & F.col("doc_id").isNotNull()))
    text = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(text, model).drop("text")


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The pipeline's filter: rows of a known language; out go texts without letters and those whose best pooled probability is
    under `least`. Where no row tells a language, none can be learned, and all texts with letters stay."""
    model = train(docs)
    if model is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    return predict(docs, model).where(f"lang_pred <> '{UNKNOWN}' and score >= {least}").select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])
