"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Words are runs of letters and digits in lower case; shingles have WIDTH words (a shorter item is one shingle). Each item has a SimHash of
128 bits from its shingles with their counts, and so has every window of a document with as many words; a document shorter than an item is one
window for it. Two fingerprints that differ in at most RADIUS = 31 bits differ in at most 7 bits in one of four blocks of 32 bits, and there in
at most 3 bits in one of its halves: tables of the halves' values find the items of every such pair, which 0.4 % of random pairs pass. Of the pairs
in the radius, the weighted Jaccard similarity of their shingles, sum of min / sum of max of the counts, decides; from SIMILARITY on, a pair is
a leak. At a similarity of just 0.8 fingerprints differ in 19 bits on average and in over 31 once in about 700 pairs.
A window without a single shingle of any item has similarity 0 to all, so fingerprints are taken only where windows hold one.

A benchmark of up to ITEMS_BYTES is broadcast. A larger one is dealt into parts of that size; still in one pass over the documents, a Bloom filter of
all items' shingles (FILTER_BITS bits at most) picks the documents that share one, a join on the shingles tells which parts they must meet,
and each part meets its documents in salted tasks.

Null and empty texts and items match nothing; of equal items each is reported; a document's best window counts for each item (ties: the first);
repeated rows are reported each; a null doc_id is reported as null; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, WordIds, read, ship

WIDTH, SIMILARITY, RADIUS, ITEMS_BYTES, FILTER_BITS, STRETCH, FEW, DOCS_A_TASK = 5, 0.8, 31, 16 << 20, 1 << 27, 4096, 64, 50_000
#: Bits in which a block and one of its halves may differ: (RADIUS + 1) / 4 - 1 and (RADIUS + 1) / 8 - 1.
IN_BLOCK, IN_HALF = 7, 3
LEAK = "doc_id long, item_id long, similarity double, first_word int, n_words int"


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the shingles of a text, from its words' hashes; a text of fewer words is one shingle."""
    if not len(h):
        return h
    width = min(width, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[i : len(h) - width + 1 + i]
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def words_hashes(ids: WordIds, text: str) -> np.ndarray:
    words = WORD.findall(text.lower())
    h = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    return (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def bits_of(shingles: np.ndarray) -> np.ndarray:
    """(n, 128) bits: each shingle's hash and another one made from it."""
    two = np.stack([shingles, (shingles ^ (shingles >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)], 1)
    two[:, 1] ^= two[:, 1] >> np.uint64(29)
    return np.unpackbits(two.astype(">u8").view(np.uint8), axis=1)


def prints_of(ones: np.ndarray, n: int) -> np.ndarray:
    """(rows, 4) blocks of 32 bits: 1 where over half of n are."""
    return np.packbits(ones * 2 > n, axis=1).view(">u4").astype(np.uint32)


class HalfTables:
    """Of fingerprints: those that a value of a half has within IN_HALF bits; lists are made when first asked for and kept up to LIMIT entries."""

    LIMIT = 4_000_000

    def __init__(self, prints: np.ndarray):
        self.halves = np.stack([prints >> np.uint32(16), prints & np.uint32(0xFFFF)], 2).reshape(len(prints), 8).T.astype(np.uint16).copy()
        self.lists: dict[int, np.ndarray] = {}
        self.held = 0

    def near(self, half: int, value: int) -> np.ndarray:
        found = self.lists.get(half << 16 | value)
        if found is None:
            found = np.flatnonzero(np.bitwise_count(self.halves[half] ^ np.uint16(value)) <= IN_HALF)
            if self.held > self.LIMIT:
                self.lists.clear()
                self.held = 0
            self.lists[half << 16 | value] = found
            self.held += len(found) + 16
        return found


class Items:
    """Items by size, their fingerprints in Hamming blocks, their shingles with counts."""

    def __init__(self, items: list[tuple[int, str]], few: int = FEW):
        ids = WordIds()
        got = [(i, words_hashes(ids, t)) for i, t in items]
        got = [(i, h) for i, h in got if len(h)]
        self.ids, self.few = [i for i, _ in got], few
        self.words = np.array([len(h) for _, h in got], np.int64)
        shingles = [shingle_hashes(h, WIDTH) for _, h in got]
        self.counts = [np.unique(s, return_counts=True) for s in shingles]
        self.prints = np.stack([prints_of(bits_of(s).sum(0, dtype=np.int64)[None], len(s))[0] for s in shingles]) if got else np.zeros((0, 4), np.uint32)
        self.by_size = {n: np.flatnonzero(self.words == n) for n in np.unique(self.words).tolist()}
        self.tables = {n: HalfTables(self.prints[at]) for n, at in self.by_size.items() if len(at) > few}
        self.known = {w: np.unique(np.concatenate([u for (u, _), m in zip(self.counts, self.words, strict=True) if min(m, WIDTH) == w])) for w in {min(n, WIDTH) for n in self.by_size}}

    def pairs(self, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of own, item) of the items of n words within RADIUS, by the blocks."""
        items = self.by_size[n]
        if n in self.tables:
            table, w, i = self.tables[n], [], []
            halves = np.stack([own >> np.uint32(16), own & np.uint32(0xFFFF)], 2).reshape(len(own), 8)
            for half in range(8):
                values, turn = np.unique(halves[:, half], return_inverse=True)
                lists = [table.near(half, v) for v in values.tolist()]
                size = np.array([len(x) for x in lists])
                w.append(np.repeat(np.arange(len(own)), size[turn]))
                i += [lists[t] for t in turn.tolist()]
            w, i = np.concatenate(w), np.concatenate(i)
            w, i = np.divmod(np.unique(w * len(items) + i), len(items))
        else:
            w, i = (x.ravel() for x in np.indices((len(own), len(items))))
        apart = np.bitwise_count(own[w] ^ self.prints[items[i]])
        ok = (apart <= IN_BLOCK).any(1) & (apart.sum(1, dtype=np.int64) <= RADIUS)
        return w[ok], items[i[ok]]

    def leaks(self, h: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item's place, similarity, first word, words) of a text's best window for each item."""
        best: dict[int, tuple[float, int]] = {}
        for width, known in self.known.items():
            if len(h) < width:
                continue
            s = shingle_hashes(h, width)
            hits = np.flatnonzero(_among(s, known))
            if not len(hits):
                continue
            sizes = [n for n in self.by_size if min(n, WIDTH) == width]
            reach = max(min(n, len(h)) for n in sizes) - width + 1
            shorter = [n for n in sizes if n > len(h) and (len(h) - width + 1) >= SIMILARITY * (n - width + 1)]
            if shorter:
                own = prints_of(bits_of(s).sum(0, dtype=np.int64)[None], len(s))
                for n in shorter:
                    self._verify(s, np.zeros(1, np.int64), len(s), *self.pairs(own, n), best)
            inside = [n for n in sizes if n <= len(h)]
            # stretches within reach of a hit, in parts that share the longest window
            lo, hi = np.maximum(0, hits - reach + 1), np.minimum(len(s), hits + reach)
            new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
            for a, b in zip(lo[new].tolist(), hi[np.append(new[1:], len(lo)) - 1].tolist(), strict=True):
                for at in range(a, b, STRETCH):
                    end = min(b, at + STRETCH + reach - 1)
                    total = np.concatenate([np.zeros((1, 128), np.int32), np.cumsum(bits_of(s[at:end]), axis=0, dtype=np.int32)])
                    near = np.concatenate([[0], np.cumsum(np.isin(np.arange(at, end), hits, assume_unique=True))])
                    for n in inside:
                        span = n - width + 1
                        start = np.arange(max(0, min(STRETCH, end - at - span + 1)))
                        start = start[near[start + span] > near[start]]
                        if len(start):
                            own = prints_of(total[start + span] - total[start], span)
                            self._verify(s, at + start, span, *self.pairs(own, n), best)
        return [(y, sim, x, min(len(h), int(self.words[y]))) for y, (sim, x) in sorted(best.items())]

    def _verify(self, s: np.ndarray, starts: np.ndarray, span: int, w: np.ndarray, items: np.ndarray, best: dict) -> None:
        for x, y in zip(starts[w].tolist(), items.tolist(), strict=True):
            sim = self._similarity(s[x : x + span], *self.counts[y])
            if sim >= SIMILARITY and (y not in best or (-sim, x) < (-best[y][0], best[y][1])):
                best[y] = (sim, x)

    @staticmethod
    def _similarity(window: np.ndarray, shingles: np.ndarray, counts: np.ndarray) -> float:
        mine, n = np.unique(window, return_counts=True)
        at = np.searchsorted(shingles, mine)
        at[at == len(shingles)] = 0
        low = int(np.where(shingles[at] == mine, np.minimum(counts[at], n), 0).sum())
        return low / (int(counts.sum()) + len(window) - low)


def _among(s: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, s)
    at[at == len(known)] = 0
    return known[at] == s


#: The items that a Python worker made last.
_MADE: dict[str, Items] = {}


def _leak_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in LEAK.split(", ")])


def _leaks_of_few(spark: SparkSession, texts: DataFrame, items: DataFrame) -> DataFrame:
    sent, name = spark.sparkContext.broadcast([(r.item_id, r.text) for r in items.orderBy("item_id", "text").collect()]), uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            if name not in _MADE:
                _MADE.clear()
                _MADE[name] = Items(sent.value)
            known = _MADE[name]
            yield _leak_batch([(doc, known.ids[y], sim, x, n) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for y, sim, x, n in known.leaks(words_hashes(ids, text.as_py()))])

    return texts.mapInArrow(task, LEAK)


def _leaks_of_many(spark: SparkSession, texts: DataFrame, items: DataFrame, parts: int, bits: int) -> DataFrame:
    scratch = Scratch(spark, "leaks")
    dealt = scratch.save(items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int")), "items")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            hashes = [shingle_hashes(words_hashes(ids, t), WIDTH) for t in batch.column(0).to_pylist()]
            part = np.repeat(batch.column(1).to_numpy(), [len(h) for h in hashes])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*hashes, np.zeros(0, np.uint64)]).view(np.int64)), pa.array(part)], ["s", "part"])

    told = scratch.save(dealt.select("text", "part").mapInArrow(shingles, "s long, part int").distinct(), "shingles")
    chunk = min(bits, 1 << 20)

    def bitmap(df: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(chunk, np.uint8)
        out[df["bit"].to_numpy()] = 1
        return pd.DataFrame({"c": df["c"].iloc[:1], "map": [np.packbits(out).tobytes()]})

    place = told.select(F.pmod("s", F.lit(bits)).alias("p")).select((F.col("p") / chunk).cast("int").alias("c"), (F.col("p") % chunk).cast("int").alias("bit")).distinct()
    whole = np.zeros(bits // 8, np.uint8)
    for r in place.groupBy("c").applyInPandas(bitmap, "c int, map binary").collect():  # bits / 8 bytes in all
        whole[r.c * chunk // 8 : (r.c + 1) * chunk // 8] = np.frombuffer(r.map, np.uint8)
    sent = spark.sparkContext.broadcast(whole)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, row, seen = WordIds(), TaskContext.get().partitionId() << 33, sent.value
        for batch in batches:
            keep, hits = [], []
            for i, text in enumerate(batch.column(1)):
                h = words_hashes(ids, text.as_py())
                s = np.unique(np.concatenate([shingle_hashes(h, w) for w in range(1, WIDTH + 1) if len(h) >= w] or [np.zeros(0, np.uint64)]))
                p = np.mod(s.view(np.int64), bits)
                s = s[(seen[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1]
                if len(s):
                    keep.append(i)
                    hits.append(s.view(np.int64))
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(keep))), *part.columns, pa.array(hits, pa.list_(pa.int64()))], ["row", "doc_id", "text", "hits"])
            row += len(keep)

    picked = scratch.save(texts.mapInArrow(pick, "row long, doc_id long, text string, hits array<long>"), "picked")
    meet = scratch.save(picked.select("row", F.explode("hits").alias("s")).join(told, "s").select("row", "part").distinct(), "meet")
    salts = meet.groupBy("part").agg(F.ceil(F.count("*") / DOCS_A_TASK).cast("int").alias("salts"))
    docs = picked.select("row", "doc_id", "text").join(meet, "row").join(F.broadcast(salts), "part").select("part", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("doc_id").alias("id"), "text")
    sides = dealt.join(F.broadcast(salts), "part").select("part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("item_id").alias("id"), "text")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by (part, salt, kind, id): a part's items, then the documents that it meets."""
        ids, now, waiting, known = WordIds(), None, [], None
        for batch in batches:
            out = []
            for part, salt, kind, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, salt) != now:
                    now, waiting, known = (part, salt), [], None
                if kind == 0:
                    waiting.append((i, text))
                    continue
                known = known or Items(waiting)
                out += [(i, known.ids[y], sim, x, n) for y, sim, x, n in known.leaks(words_hashes(ids, text))]
            yield _leak_batch(out)

    return docs.union(sides).repartition("part", "salt").sortWithinPartitions("part", "salt", "kind", "id", "text").mapInArrow(search, LEAK)


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, items_bytes: int = ITEMS_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """LEAK rows: every document and item with a window of similarity SIMILARITY or more."""
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") > 0)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= items_bytes:
        return _leaks_of_few(spark, texts, items)
    return _leaks_of_many(spark, texts, items, -(-size // items_bytes), filter_bits)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
