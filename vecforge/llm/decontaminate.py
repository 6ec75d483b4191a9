"""Benchmark decontamination: q-gram counts in overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, release, save, sized, small_batches
from .words import mix

Q, EDITS, SEGMENT, STRIDE = 8, 0.1, 100, 50
#: Characters of benchmark text in one pass; a larger benchmark is matched in as many passes, so a worker's index stays bounded.
BLOCK_CHARS = 2_000_000
@cache
def _word_characters() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def normal(text: str | None) -> np.ndarray:
    """Code points of the small letters and digits, with one space for anything between: case, marks and spacing don't count as edits."""
    if not text:
        return np.empty(0, np.uint32)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = _word_characters()[c]
    gap = np.zeros(len(c), bool)
    np.greater(keep[:-1], keep[1:], out=gap[1:])
    out = np.where(keep, c, np.uint32(32))[keep | gap]
    return out[:-1] if len(out) and out[-1] == 32 else out


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash for each q-gram (q a power of two), by doubling."""
    h, mult, width = codes.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while width < q:
        h = h[:-width] * np.uint64(mult) + h[width:] if len(h) > width else h[:0]
        mult = mult * mult & 0xFFFFFFFFFFFFFFFF
        width *= 2
    return mix(h)


def segments(items: list[tuple[int, str | None]]) -> list[tuple[int, np.ndarray]]:
    """Overlapping windows of SEGMENT normalised characters of each item, so that a passage cut from an item is found too; an
    item that is shorter is its own only window. Windows of fewer than Q characters are whole words: they begin and end with a space."""
    out = []
    for item, text in items:
        c = normal(text)
        if not len(c):
            continue
        if len(c) < Q:
            c = np.concatenate([[32], c, [32]]).astype(np.uint32)
        starts = [*range(0, len(c) - SEGMENT, STRIDE), len(c) - SEGMENT] if len(c) > SEGMENT else [0]
        out += [(item, c[s : s + SEGMENT]) for s in starts]
    return out


def _budget(m: int) -> int:
    """Edits allowed: a share of the length, as long as the q-gram lemma still asks for 2 common q-grams."""
    k = int(EDITS * m)
    while k and m + 1 - Q * (k + 1) < 2:
        k -= 1
    return k


class Index:
    def __init__(self, items: list[tuple[int, str | None]]):
        every = segments(items)
        self.segments = [x for x in every if len(x[1]) >= Q]
        self.short = [(item, c.astype("<u4").tobytes()) for item, c in every if len(c) < Q]
        grams = [_grams(c, Q) for _, c in self.segments]
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        seg = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        pos = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.seg, self.pos = seg[order].astype(np.int64), pos[order].astype(np.int64)
        self.keys, self.at = np.unique(flat[order], return_index=True)
        self.size = np.diff(np.append(self.at, len(flat)))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.m = np.array([len(c) for _, c in self.segments], np.int64)
        self.k = np.array([_budget(int(m)) for m in self.m], np.int64)
        self.need = np.maximum(1, self.m + 1 - Q * (self.k + 1))
        # the same bound for q-grams half as long, counted wherever they are in a band's region, spares most alignments
        self.need_half = self.m + 1 - Q // 2 * (self.k + 1)
        self.half = [(_grams(c, Q // 2) & np.uint64(4095)).astype(np.int64) for _, c in self.segments]

    def search(self, texts: list[str | None]) -> list[list[int]]:
        """For each text the sorted benchmark items of which a segment occurs in it within its budget of edits.

        A segment of m characters that occurs with at most k edits shares at least m + 1 - q (k + 1) q-grams with the
        text, on 2k + 1 neighbouring diagonals; so they lie in one of the bands of 2 (2k + 1) diagonals that start every
        2k + 1 diagonals and overlap by half. Bands with enough are aligned, all of a batch's at once.
        """
        found: list[set[int]] = [set() for _ in texts]
        first: list[tuple[int, int, np.ndarray]] = []
        later: list[tuple[int, int, np.ndarray]] = []
        for i, text in enumerate(texts):
            items: set[int] = set()
            codes = normal(text)
            if self.short and len(codes):
                raw = np.concatenate([[32], codes, [32]]).astype("<u4").tobytes()
                found[i].update(item for item, c in self.short if _holds(raw, c))
            # the fullest band of an item first: the others only matter if that one fails
            for _, sg, region in sorted(self._candidates(codes), key=lambda x: -x[0]):
                (later if self.segments[sg][0] in items else first).append((i, sg, region))
                items.add(self.segments[sg][0])
            if len(later) >= 4096 or i == len(texts) - 1:
                self._settle(first, found)
                self._settle([x for x in later if self.segments[x[1]][0] not in found[x[0]]], found)
                first, later = [], []
        return [sorted(x) for x in found]

    def _settle(self, waiting: list[tuple[int, int, np.ndarray]], found: list[set[int]]) -> None:
        for at in range(0, len(waiting), 128):
            part = waiting[at : at + 128]
            cost = align([self.segments[sg][1] for _, sg, _ in part], [r for _, _, r in part])
            for (doc, sg, _), c in zip(part, cost.tolist(), strict=True):
                if c <= self.k[sg]:
                    found[doc].add(self.segments[sg][0])

    def _candidates(self, codes: np.ndarray) -> Iterator[tuple[float, int, np.ndarray]]:
        h = _grams(codes, Q)
        hit = np.flatnonzero(self.bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)]) if len(self.keys) and len(h) else np.empty(0, np.int64)
        if not len(hit):
            return
        k = np.searchsorted(self.keys, h[hit])
        k[k == len(self.keys)] = 0
        good = self.keys[k] == h[hit]
        hit, k = hit[good], k[good]
        work = np.cumsum(self.size[k])
        cuts = np.unique(np.append(np.searchsorted(work, np.arange(0, work[-1] if len(work) else 0, 1_000_000)), len(hit)))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            # a match that begins in this part may end in the next
            yield from self._bands(codes, hit, k, a, max(b, int(np.searchsorted(hit, int(hit[b - 1]) + 2 * SEGMENT + 64))))

    def _bands(self, codes: np.ndarray, hit: np.ndarray, k: np.ndarray, a: int, b: int) -> Iterator[tuple[float, int, np.ndarray]]:
        n = self.size[k[a:b]]
        row = np.repeat(np.arange(a, b), n)
        entry = np.repeat(self.at[k[a:b]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        seg = self.seg[entry]
        live = (np.bincount(seg, minlength=len(self.m)) >= self.need)[seg]
        seg, row, off = seg[live], row[live], self.pos[entry[live]]
        if not len(seg):
            return
        width = 2 * self.k[seg] + 1
        band = (hit[row] - off + 4 * SEGMENT) // width
        key = np.concatenate([(seg << 40) + band, (seg << 40) + np.maximum(0, band - 1)])
        # a place of the segment counts once in a band, however often the text repeats its q-gram there
        place = np.concatenate([off, off])
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
        bands, counts = np.unique(key[first], return_counts=True)
        s = bands >> 40
        enough, half = counts >= self.need[s], None
        for x, sg, c in zip(bands[enough].tolist(), s[enough].tolist(), counts[enough].tolist(), strict=True):
            m, e = int(self.m[sg]), int(self.k[sg])
            low = (x & ((1 << 40) - 1)) * (2 * e + 1) - 4 * SEGMENT
            start, end = max(0, low - e), max(0, low + 2 * (2 * e + 1) + m + e)
            if half is None:
                half = (_grams(codes, Q // 2) & np.uint64(4095)).astype(np.int64)
            there = np.zeros(4096, bool)
            there[half[start : end + 1 - Q // 2]] = True
            if there[self.half[sg]].sum() >= self.need_half[sg]:
                yield c / m, sg, codes[start:end]


def _holds(raw: bytes, part: bytes) -> bool:
    """Whether part occurs in raw at a whole code point."""
    at = raw.find(part)
    while at >= 0 and at % 4:
        at = raw.find(part, at + 1)
    return at >= 0


def align(patterns: list[np.ndarray], regions: list[np.ndarray]) -> np.ndarray:
    """For each pattern the least edits between it and any substring of its region, which is as long as the pattern and its
    band: rows of all tables are filled together."""
    if not patterns:
        return np.empty(0, np.int32)
    count, n = len(patterns), max(map(len, regions))
    m = np.array([len(p) for p in patterns])
    p = np.zeros((count, m.max()), np.uint32)
    r = np.full((count, n), 0xFFFFFFFF, np.uint32)
    for i, (x, y) in enumerate(zip(patterns, regions, strict=True)):
        p[i, : len(x)], r[i, : len(y)] = x, y
    idx = np.arange(n + 1, dtype=np.int32)
    row, best = np.zeros((count, n + 1), np.int32), np.zeros(count, np.int32)
    for i in range(p.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, :-1] + (r != p[:, i : i + 1]), row[:, 1:] + 1, out=new[:, 1:])
        new -= idx
        np.minimum.accumulate(new, axis=1, out=new)
        new += idx
        row = new
        if (done := m == i + 1).any():
            best[done] = row[done].min(axis=1)
    return best


def match(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with item_ids, the sorted benchmark items of which each row's text holds a window within the edit budget (empty: clean).

    docs holds text and any other columns (one named item_ids is replaced); benchmark holds item_id and text. Null or empty texts and items match nothing;
    very long texts are searched whole; equal texts, also in rows that repeat an id, have equal items, and items that repeat an id are one; an empty table gives
    an empty table. The benchmark is taken in blocks of about BLOCK_CHARS characters one after the other, so neither the driver nor a
    worker holds more of it; the documents are scanned once for each block, and only hashes of the texts with hits are kept.
    """
    small_batches(docs.sparkSession)
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    blocks = 1 + (bench.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS
    docs = docs.drop("item_ids")
    text = F.col("text").cast("string")
    hashes = [F.xxhash64(text).alias("_h1"), F.xxhash64(text, F.lit(1)).alias("_h2")]
    own = docs.select(*hashes, text.alias("text")).where("text is not null")
    hits = []
    for i in range(blocks):
        items = [(r[0], r[1]) for r in bench.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()]
        hits.append(save(own.mapInArrow(_searcher(items), "_h1 long, _h2 long, item long").distinct(), "hits"))
    h1, h2 = fresh(docs, "_h1", "_h2")
    found = save(reduce(DataFrame.union, hits).groupBy(F.col("_h1").alias(h1), F.col("_h2").alias(h2)).agg(F.array_sort(F.collect_set("item")).alias("item_ids")), "found")
    release(*hits)
    none = F.from_json(F.lit("[]"), "array<bigint>")
    out = docs.join(sized(found, 128), (F.xxhash64(text) == F.col(h1)) & (F.xxhash64(text, F.lit(1)) == F.col(h2)), "left")
    return out.withColumn("item_ids", F.coalesce(F.col("item_ids"), none)).drop(h1, h2)


def _searcher(items: list[tuple[int, str | None]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items)
        for batch in batches:
            found = index.search(batch.column(2).to_pylist())
            n = [len(x) for x in found]
            at = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([i for x in found for i in x], pa.int64())], ["_h1", "_h2", "item"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs that hold no benchmark passage, with their columns."""
    return match(docs, benchmark).where("size(item_ids) = 0").select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c.lower() != "item_ids"])
