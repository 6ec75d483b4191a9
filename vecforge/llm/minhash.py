"""Near duplicates by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fresh, release, save, sized, small_batches
from .words import _G, mix, shingles, times_g

#: Turns of comparing a band's classes with one of them, at most, before the rest is compared in blocks.
STARS = 3
#: Shingles in a block of one side.
BLOCK = 1_000_000
BANDS, ROWS = 24, 4  # a pair at 0.8 shares no band with probability (1 - 0.8^4)^24 = 3e-6


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches (t coordinates) of non-empty sets of 64-bit hashes.

    Rounds 0 .. t-1 place each element in a hashed bin, rounds t .. 2t-1 place all elements in bin (round - t); a bin keeps
    the least value of the first round that fills it. So every coordinate is filled, after t*ln(t)/|set| rounds or so,
    and two sets agree in a coordinate with probability equal to their Jaccard similarity, with concentration as for
    independent coordinates. A set leaves the loop when it is full.
    """
    n = len(sets)
    out = np.zeros((n, t), np.uint64)
    empty = np.ones((n, t), bool)
    active = np.arange(n)
    flat = np.concatenate(sets) if n else np.empty(0, np.uint64)
    lens = np.array([len(s) for s in sets], np.int64)
    none = np.uint64(2**64 - 1)
    for i in range(2 * t):
        if not len(active):
            break
        h = mix(flat ^ (times_g(i + 1)))
        value = h & np.uint64(0xFFFFFFFF)
        row = np.repeat(np.arange(len(active)), lens)
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(h), i - t)
        low = np.full(len(active) * t, none)
        np.minimum.at(low, row * t + bins, value)
        low = low.reshape(len(active), t)
        fill = empty[active] & (low != none)
        r, c = np.nonzero(fill)
        out[active[r], c] = mix(low[r, c] + np.uint64((i + 1) << 32))
        empty[active[r], c] = False
        still = empty[active].any(axis=1)
        if not still.all():
            flat, lens, active = flat[np.repeat(still, lens)], lens[still], active[still]
    return out


def band_keys(sk: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sk.reshape(len(sk), bands, rows)
    key = np.zeros(parts.shape[:2], np.uint64)
    for j in range(rows):
        key = mix(key * np.uint64(31) + parts[:, :, j])
    return mix(key ^ (np.arange(bands, dtype=np.uint64) * _G)).view(np.int64)


def _sketcher(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), 128):
                sets = [shingles(t, k) for t in texts[at : at + 128]]
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(sketch(full, bands * rows), bands, rows).tolist()) if full else iter(())
                n = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(sets)),
                        pa.array(n, pa.int64()),
                        pa.array([int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                        pa.array([int(mix(s ^ _G).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                        pa.array([next(keys) if x else [] for x in n], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "c1", "c2", "bands"],
                )

    return run


def _verifier(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for x, y, sx, sy in zip(a, b, ta, tb, strict=True):
                if last[0] != x:
                    last = (x, shingles(sx, k))
                p, q = last[1], shingles(sy, k)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    keep.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in keep], pa.int64()), pa.array([y for _, y in keep], pa.int64())], ["a", "b"])

    return run


def verify(texts: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full shingle sets meet the threshold. texts: one row (doc_id, text) for each id."""
    ids = save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    own = save(texts.join(sized(ids, 16), "doc_id", "left_semi"), "texts")
    b = own.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    a = own.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    out = save(pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(_verifier(k, percent), "a long, b long").distinct(), "links")
    release(ids, own)
    return out


def _block(percent: int, k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between the rows of side x and all others of another component, one merge of counts for each x."""
        sets = [shingles(t, k) for t in pdf["text"]]
        lens = np.array([len(s) for s in sets])
        y = np.flatnonzero(~pdf["x"].to_numpy())
        out = []
        if len(y):
            all_, ids = np.unique(np.concatenate(sets), return_inverse=True)
            at = np.concatenate([[0], np.cumsum(lens)])
            flat = np.concatenate([ids[at[i] : at[i + 1]] for i in y])
            starts = np.concatenate([[0], np.cumsum(lens[y])[:-1]])
            rep, comp = pdf["rep"].to_numpy(), pdf["comp"].to_numpy()
            mask = np.zeros(len(all_), np.int64)
            for i in np.flatnonzero(pdf["x"].to_numpy()):
                own = ids[at[i] : at[i + 1]]
                mask[own] = 1
                both = np.add.reduceat(mask[flat], starts)
                mask[own] = 0
                hit = y[(100 * both >= percent * (lens[i] + lens[y] - both)) & (comp[y] != comp[i])]
                # one link into each other component is enough
                for j in hit[np.unique(comp[hit], return_index=True)[1]].tolist():
                    out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _across(text: DataFrame, rest: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components of one band: those outside the band's largest component against all of another component,
    in blocks of at most about BLOCK shingles a side, so that neither a task nor the number of rows grows with the pairs."""
    per = rest.groupBy("key", "comp").agg(F.sum("n").alias("s"))
    main = per.groupBy("key").agg(F.max_by("comp", F.struct("s", "comp")).alias("main"), F.ceil(F.sum("s") / BLOCK).cast("int").alias("ny"), F.ceil((F.sum("s") - F.max("s") + 1) / BLOCK).cast("int").alias("nx"))
    r = rest.join(main, "key")
    xb, yb = F.pmod(F.xxhash64("rep"), F.col("nx")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("ny")).cast("int")
    xs = r.where("comp <> main").select("key", "rep", "comp", xb.alias("xb"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("yb"), F.lit(True).alias("x"))
    ys = r.select("key", "rep", "comp", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("xb"), yb.alias("yb"), F.lit(False).alias("x"))
    ids = save(rest.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    own = save(text.join(sized(ids, 16), "doc_id", "left_semi").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "rep"), "texts")
    out = save(xs.union(ys).join(own, "rep").groupBy("key", "xb", "yb").applyInPandas(_block(percent, k), "a long, b long").distinct(), "links")
    release(ids, own)
    return out


def _linked(text: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, component) of the classes (rep, n_shingles, bands) that are linked, saved."""
    banded = classes.select("rep", F.explode("bands").alias("key"))
    # only bands that several classes share: all later steps see their rows alone
    shared = save(banded.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("c")).where("c > 1").drop("c"), "shared")
    size = classes.select("rep", F.col("n_shingles").alias("n"))
    rest = save(banded.join(sized(shared, 24), "key").join(size, "rep"), "banded")
    release(shared)
    fits = f"100 * least(n, lead_n) >= {percent} * greatest(n, lead_n)"
    star = rest.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b"), "n").distinct()
    star = save(star.join(size.toDF("a", "lead_n"), "a").where(fits).select("a", "b"), "pairs")
    links = verify(text, star, k, percent)
    tried, comp = star, save(components(links), "comp")
    rest = rest.drop("lead")
    for turn in range(1, STARS + 1):
        label = comp.select(F.col("id").alias("rep"), "component")
        marked = save(rest.join(sized(label, 24), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp")), "marked")
        mixed = marked.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo <> hi")
        rest = save(marked.join(sized(save(mixed.select("key", "c"), "mixed"), 24), "key"), "rest")
        release(marked)
        rows, squares = rest.agg(F.count("*"), F.sum("c")).first()
        if not rows:
            break
        final = turn == STARS or squares <= 8 * rows
        if final:
            more = _across(text, rest, k, percent)
        else:
            lead = rest.groupBy("key").agg(F.max_by(F.struct("comp", "rep", "n"), F.xxhash64("rep", F.lit(turn))).alias("lead"))
            near = fits.replace("lead_n", "lead.n")
            pairs = rest.join(lead, "key").where(f"comp <> lead.comp and {near}").select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b")).distinct()
            pairs = save(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
            more = verify(text, pairs, k, percent)
            tried = save(tried.union(pairs), "tried")
        if not more.isEmpty():
            links = save(links.union(more), "links")
            comp = save(components(links), "comp")
        if final:
            break
        rest = rest.select("key", "rep", "n")
    return comp


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text, ...; other columns are ignored).

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of k-word shingles. Documents with equal
    sets become one class first; then classes that share a band are compared with the band's first class, then, in bands
    that still hold several components, with a class chosen by a hash, another each turn; last, in blocks, across components only:
    within a component nothing is left to find, so no group is expanded into all its pairs and no link between
    components is lost. Turns end as soon as comparing across components costs about as much as a turn. A null or empty text has no shingles and
    links with nothing; a null doc_id has a null component and
    is kept; rows that repeat a doc_id are placed each by its own text. Very long texts are sets like any other; of tied
    groups the smallest doc_id leads; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = save(text.mapInArrow(_sketcher(k, bands, rows), "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>"), "sets")
    # equal sets have equal bands, so any class member's bands serve, and its smallest doc_id is found without them
    firsts = sets.where("n_shingles > 0 and doc_id is not null").groupBy("c1", "c2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = save(firsts.join(sets.select("c1", "c2", "n_shingles", F.col("doc_id").alias("rep"), "bands"), ["c1", "c2", "n_shingles", "rep"]).dropDuplicates(["c1", "c2", "n_shingles"]), "classes")
    comp = _linked(text, classes, k, percent).withColumnRenamed("id", "rep")
    placed = classes.select("c1", "c2", "n_shingles", "rep").join(comp, "rep", "left").select("c1", "c2", "n_shingles", F.coalesce("component", "rep").alias("root"))
    out = sets.select("doc_id", "n_shingles", "c1", "c2").join(placed, ["c1", "c2", "n_shingles"], "left")
    root = F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    out = save(out.select("doc_id", "n_shingles", root.alias("component_id")).withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near")
    release(sets, classes)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay when each group of near duplicates keeps its smallest doc_id (rows that repeat it: one of them, the first by its text)."""
    (i,) = fresh(docs, "_id")
    same = F.col("doc_id").cast("long") == F.col(i)
    gone = save(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(i)).distinct(), "gone")
    out = docs.join(sized(gone, 16), same, "left_anti")
    twice = save(docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias(i)).count().where("count > 1").select(i), "twice")
    if twice.isEmpty():
        return out
    again, once = out.join(sized(twice, 16), same, "left_semi"), out.join(sized(twice, 16), same, "left_anti")
    return once.union(again.dropDuplicates(["doc_id"]))
