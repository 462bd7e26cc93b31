"""Passages of held-out items inside a corpus (problem 8)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from chainloom.llm.words import Encoded, spread, words
from chainloom.plans.shared import Shared

#: The smallest leak in words, the words of a shingle, the least weighted similarity of windows.
WINDOW, SHINGLE, LEAST = 12, 5, 0.8
#: Standard deviations by which the radius exceeds the expected distance of windows of the least similarity.
MARGIN = 1.8
#: Characters of items held by the workers at once; more items are searched for in several passes over the corpus.
CHARS_A_PASS = 600_000
#: Word positions hashed and pairs compared at once in a worker, and characters of text taken together.
POSITIONS, PAIRS, CHARS = 1 << 15, 1 << 22, 1 << 23
FOUND = "doc_id bigint, item_id bigint, size int, windows bigint, similarity double, run_words bigint"


def shingles(e: Encoded) -> np.ndarray:
    """A 64-bit hash of each word and the SHINGLE - 1 words after it (meaningless at the end of a text)."""
    h, x = e.hashes[e.codes], np.zeros(len(e.codes), np.uint64)
    for k in range(SHINGLE):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.roll(h, -k)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def simhash(f: np.ndarray, n: int) -> np.ndarray:
    """SimHash of every n consecutive shingles: bit b is set if more than half of them have it set.

    A shingle that occurs twice counts twice, which is the weight. Sums of 2, 4, 8, ... neighbours are built by doubling.
    """
    out = np.empty(max(0, len(f) - n + 1), np.uint64)
    kind = np.uint8 if n < 256 else np.uint32
    for at in range(0, len(out), POSITIONS):
        end = min(at + POSITIONS, len(out))
        power, length = np.unpackbits(f[at : end + n - 1].view(np.uint8).reshape(-1, 8), axis=1).astype(kind, copy=False), 1
        total, covered, left = None, 0, n
        while left:
            if left & 1:
                part = power[covered : covered + end - at]
                total, covered = part.copy() if total is None else total + part, covered + length
            left >>= 1
            if left:
                power, length = power[:-length] + power[length:], length * 2
        out[at:end] = np.packbits(total > n // 2, axis=1).view(np.uint64).ravel()
    return out


def radius(n: int, least: float) -> int:
    """Bits within which fingerprints of n shingles are searched for.

    Windows of similarity `least` differ in at most k of their n shingles (0 if only equal ones are that similar). Their
    bits differ with probability arccos(1 - k / n) / pi; MARGIN standard deviations are added.
    """
    k = n - math.ceil(2 * n * least / (1 + least) - 1e-9)
    p = math.acos(1 - k / n) / math.pi
    return min(64, math.ceil(64 * p + MARGIN * math.sqrt(64 * p * (1 - p))))


class Blocks:
    """Multi-index over fingerprints: all pairs within `radius` bits are found.

    The 64 bits are cut into blocks so many that one of them differs in at most two bits, by the pigeonhole principle (in
    none with radius 0). Each fingerprint is filed, for each block, under all keys so near to its own.
    """

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius, self.tables = prints, radius, []
        cuts = np.linspace(0, 64, radius // 3 + 2).astype(int)
        for lo, hi in zip(cuts, cuts[1:]):
            width, errors = int(hi - lo), radius // (len(cuts) - 1)
            flips = np.array([sum(1 << b for b in c) for e in range(errors + 1) for c in combinations(range(width), e)], np.uint64)
            keys = (self.keys(prints, int(lo), width)[:, None] ^ flips).ravel()
            order = np.argsort(keys, kind="stable")
            self.tables.append((int(lo), width, keys[order], (order // len(flips)).astype(np.int32)))

    @staticmethod
    def keys(prints: np.ndarray, lo: int, width: int) -> np.ndarray:
        return (prints >> np.uint64(lo)) & np.uint64((1 << width) - 1)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (position in prints, filed fingerprint) that differ in at most radius bits."""
        found = [np.empty(0, np.int64)]
        for lo, width, keys, filed in self.tables:
            mine = self.keys(prints, lo, width)
            first, last = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            ends = np.cumsum(last - first)
            at = 0
            while at < len(mine):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
                n = last[at:end] - first[at:end]
                pos = np.repeat(np.arange(at, end), n)
                other = filed[np.arange(len(pos)) + np.repeat(first[at:end] - (np.cumsum(n) - n), n)]
                close = np.bitwise_count(prints[pos] ^ self.prints[other]) <= self.radius
                found.append(pos[close] * len(self.prints) + other[close])
                at = end
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


@dataclass
class Windows:
    """Windows of one size of the items: where they lie, their shingles, the index of their fingerprints."""

    size: int
    item: np.ndarray
    at: np.ndarray
    shingle: np.ndarray
    blocks: Blocks


class Index:
    """The windows of the items. Those of the smallest size lie at every word; the sizes then double, up to the size of the
    longest item, and those windows lie half their size apart and at an item's end. bits marks the shingles of all items."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int, least: float):
        e = self.words = Encoded([w for _, w in items])
        ids, f = np.array([i for i, _ in items], np.int64), shingles(e) if len(e.codes) else np.empty(0, np.uint64)
        longest = max((len(w) for _, w in items), default=0)
        self.sizes, size = [], window
        while size <= longest:
            step, n = 1 if size == window else size // 2, size - SHINGLE + 1
            spans = [(i, a, b) for i, (a, b) in enumerate(zip(e.offsets, e.offsets[1:])) if b - a >= size]
            start = [np.unique(np.append(np.arange(a, b - size + 1, step), b - size)) for _, a, b in spans]
            owner = np.repeat([i for i, _, _ in spans], [len(s) for s in start])
            start = np.concatenate(start)
            self.sizes.append(Windows(size, ids[owner], start, f[start[:, None] + np.arange(n)], Blocks(simhash(f, n)[start], radius(n, least))))
            size *= 2
        used = np.unique(np.concatenate([w.shingle.ravel() for w in self.sizes])) if self.sizes else f[:0]
        self.bits = np.zeros(1 << min(26, max(16, len(used).bit_length() + 9)), bool)
        self.bits[(used & np.uint64(len(self.bits) - 1)).astype(np.int64)] = True


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of rows of shingles, the weight of a shingle being how often it occurs."""
    a, b = np.sort(a, axis=1), np.sort(b, axis=1)
    n = a.shape[1]
    i, j, same, row = np.zeros(len(a), int), np.zeros(len(a), int), np.zeros(len(a), int), np.arange(len(a))
    for _ in range(2 * n):
        on = (i < n) & (j < n)
        u, v = a[row, np.minimum(i, n - 1)], b[row, np.minimum(j, n - 1)]
        same += on & (u == v)
        i, j = i + (on & (u <= v)), j + (on & (v <= u))
    return same / (2 * n - same)


def alike(e: Encoded, f: np.ndarray, hits: np.ndarray, w: Windows, x: Index, least: float) -> tuple[np.ndarray, ...]:
    """(text, position, item window, similarity) of the windows of some texts that are like a window of an item.

    A window of whose shingles no item has half can't be like any (for that it needs 2 * least / (1 + least) of them, if least
    is a third or more) and gets no fingerprint.
    """
    n = w.size - SHINGLE + 1
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.float64))
    if len(f) < w.size:
        return none
    least_hits = max(1, n // 2 if least >= 1 / 3 else 1)
    pos = np.flatnonzero(hits[n:] - hits[:-n] >= least_hits)
    doc = np.searchsorted(e.offsets, pos, side="right") - 1
    inside = pos + w.size <= e.offsets[doc + 1]
    pos, doc = pos[inside], doc[inside]
    if not len(pos):
        return none
    # Only the shingles of these windows are hashed; each window is a contiguous piece of what is left.
    cover = np.zeros(len(f) + 1, np.int32)
    np.add.at(cover, pos, 1)
    np.add.at(cover, pos + n, -1)
    cover = np.cumsum(cover[:-1]) > 0
    prints = simhash(f[cover], n)[(np.cumsum(cover) - 1)[pos]]
    k, win = w.blocks.near(prints)
    like = np.empty(len(k))
    for at in range(0, len(k), POSITIONS):
        p, q = pos[k[at : at + POSITIONS]], win[at : at + POSITIONS]
        like[at : at + POSITIONS] = similarity(f[p[:, None] + np.arange(n)], w.shingle[q])
    ok = like >= least
    return doc[k[ok]], pos[k[ok]], win[ok], like[ok]


def _search(ids: np.ndarray, texts: list[list[str]], x: Index, least: float) -> Iterator[tuple]:
    e = Encoded(texts)
    if len(e.codes) < SHINGLE or not x.sizes:
        return
    f = shingles(e)
    hits = np.concatenate([[0], np.cumsum(x.bits[(f & np.uint64(len(x.bits) - 1)).astype(np.int64)])])
    code = pc.fill_null(pc.index_in(e.vocabulary, x.words.vocabulary), -1).to_numpy(zero_copy_only=False)[e.codes]
    for w in x.sizes:
        doc, pos, win, like = alike(e, f, hits, w, x, least)
        if not len(doc):
            continue
        cells = np.arange(w.size)
        equal = (code[pos[:, None] + cells] == x.words.codes[w.at[win][:, None] + cells]).all(axis=1)
        # Equal windows that follow each other in the document and in the item are one run.
        item, place = w.item[win], w.at[win]
        order = np.lexsort((pos, place - pos, item, doc))
        pos, like, equal, item, place, doc = (v[order] for v in (pos, like, equal, item, place, doc))
        new = np.ones(len(pos), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | ((place - pos)[1:] != (place - pos)[:-1]) | (pos[1:] != pos[:-1] + 1) | ~equal[1:] | ~equal[:-1]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))
        run = np.where(equal, np.arange(len(pos)) - begin + w.size, 0)
        pair = np.ones(len(pos), bool)
        pair[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        at = np.flatnonzero(pair)
        n = np.diff(np.append(at, len(pos)))
        yield ids[doc[at]], item[at], np.full(len(at), w.size), n, np.maximum.reduceat(like, at), np.maximum.reduceat(run, at)


def _searcher(held, window: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = Index(held.value, window, least)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64())
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            at = 0
            while at < len(ids):
                chars, part = 0, []
                first = at
                while at < len(ids) and (chars < CHARS or not part):
                    t = texts[at].as_py()
                    part.append(words(t))
                    chars, at = chars + len(t), at + 1
                for cols in _search(ids[first:at], part, x, least):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "size", "windows", "similarity", "run_words"])

    return run


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, size, windows, similarity, run_words): documents that hold windows of an item (passage, then
    question), one row for each size of windows.

    The windows of the items have `window` words and two, four, ... times as many, up to the size of the item. Every window
    of every document that has half its shingles of five words in common with the items gets a SimHash. Multi-index blocks
    give all pairs of fingerprints within the radius that the size calls for, and those of a weighted shingle similarity of
    at least `least` are kept. Equal windows have equal fingerprints, so every shared run of `window` words is found;
    windows that are only alike are found as far as their fingerprints are within the radius, which more than 0.9 are.
    windows counts the pairs of windows, similarity is their best, run_words the longest run of words equal in both (0
    without an equal window). Null and short texts match nothing; extra columns are ignored.

    Texts never leave their partition. The items are broadcast: those of a pass hold about CHARS_A_PASS characters. A
    single pass is lazy; of several, each is written before the next one's items are sent.
    """
    spark = documents.sparkSession
    wanted = items.select(F.col("item_id").cast("bigint"), "passage", "question").where("item_id is not null")
    size = F.coalesce(F.length("passage"), F.lit(0)) + F.coalesce(F.length("question"), F.lit(0))
    passes = max(1, -(-(wanted.agg(F.sum(size)).first()[0] or 0) // CHARS_A_PASS))
    docs = spread(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("text is not null"))
    shared, out = Shared(spark, "leaks"), None
    for k in range(passes):
        part = wanted.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(passes)) == k) if passes > 1 else wanted
        held = spark.sparkContext.broadcast([(r.item_id, words(r.passage) + words(r.question)) for r in part.collect()])
        found = docs.mapInArrow(_searcher(held, window, least), FOUND)
        if passes > 1:
            found = shared.table(found)
            held.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def leaked_passages(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id) of documents with at least `window` consecutive words of an item, each pair once."""
    return leaks(documents, items, window).where(F.col("run_words") >= window).select("doc_id", "item_id").distinct()
