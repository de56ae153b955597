"""Near copies by SimHash and the generalised pigeonhole principle, with the exact Jaccard similarity of the sets of five-word shingles.

A set's fingerprint has BITS bits, each 1 if set in over half of the shingles' hashes. As in simhash.py the bits are grouped into PARTS partitions of
correlated bits and a dynamic programme gives each its threshold, so that the thresholds sum to TAU - PARTS + 1 at the least estimated cost; fingerprints
that differ in at most TAU bits agree within the threshold in some partition. Sets of similarity 0.8 differ in 15 % of the bits, more than TAU;
but as bits differ at random, 16 of them agree in 7 of 100 partitions, so that some of PARTS do with probability 0.997, and more above 0.8. Groups and
thresholds are chosen by the SAMPLE nodes of least hash; whatever they are, TAU is covered.

Nodes that agree in a partition and differ in at most NEAR of the first 128 bits are candidates (of similarity 0.8: all but 1 in 20,000; of unrelated
ones 4 in 10 million). Their connected components are the buckets, and sets in a bucket are linked only if the exact similarity is SIMILARITY or more.
EARLY partitions are met first; in the others only links between the components known from these are told, so a group of many near copies doesn't
come back from each partition.

Equal sets are one node. A bucket is cut into cells of about BLOCK nodes, each with the
bucket's least node too; where nodes of a cut bucket are still apart after that, those outside its largest component meet all others.
Cells return spanning forests, not pairs. Null and empty texts are the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, WordIds, ship
from .components import connected_components, merge
from .decontaminate import shingle_hashes
from .simhash import PROBE, allocate, correlated_groups, words_of

WIDTH, SIMILARITY, BLOCK, DOCS_A_TIME = 5, 0.8, 1024, 500
#: So many links are joined in one task; the rounds for more take dozens of broadcasts, which fill the executors' memory.
FEW = 100_000
#: Words of 64 bits in a fingerprint, each cut into PARTS / WORDS partitions. MOST: the largest threshold of a partition.
WORDS, PARTS, MOST, NEAR, SAMPLE, LARGE, EARLY = 20, 80, 2, 36, 8192, 256, 8
BITS, TAU = 64 * WORDS, PARTS - 1
_RNG = np.random.default_rng(42)
FLIP, TIMES = _RNG.integers(0, 1 << 64, WORDS, np.uint64), _RNG.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)


class WordHashes(WordIds):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingle_set(ids: WordHashes, text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = words_of(text)
    return np.unique(shingle_hashes(np.fromiter(map(ids.__getitem__, words), np.uint64, len(words)), WIDTH))


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """BITS bits, packed into bytes: those set in over half of the shingles' hashes; zero without shingles."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 240):  # sums of a byte each
        h = (shingles[at : at + 240, None] ^ FLIP) * TIMES
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(shingles))


def partition_values(prints: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """(nodes, partitions) values of packed fingerprints; the first bit of a group is the lowest of the value."""
    bits, out = np.unpackbits(prints, axis=1), np.zeros((len(prints), len(groups)), np.int32)
    for i, group in enumerate(groups):
        for k, b in enumerate(group):
            out[:, i] |= bits[:, b].astype(np.int32) << k
    return out


def plain_groups() -> list[list[int]]:
    return np.arange(BITS).reshape(PARTS, -1).tolist()


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys under which a set is met, with bits grouped in their order and all thresholds zero."""
    return partition_values(fingerprint(shingles)[None], plain_groups())[0] | np.arange(PARTS, dtype=np.int32) << 16


def partitions(sample: np.ndarray, n: int) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and their thresholds for n nodes, by the packed fingerprints of a sample of these."""
    if len(sample) < 2:
        return plain_groups(), [0] * PARTS
    bits, groups = np.unpackbits(sample, axis=1).astype(np.float32), []
    share = bits.mean(0, dtype=np.float64)
    differ = 2 * share * (1 - share)
    for w in range(0, BITS, 64):
        x = bits[:, w : w + 64]
        groups += [[w + b for b in g] for g in correlated_groups((x.T @ x).astype(np.float64) / len(x), PARTS // WORDS)]
    values, scale, costs = partition_values(sample, groups), n / len(sample), []
    for i, group in enumerate(groups):
        ways = [1.0] + [0.0] * MOST  # as in simhash.links_within
        for b in group:
            q = min(differ[b], 0.499)
            for k in range(MOST, 0, -1):
                ways[k] += ways[k - 1] * q / (1 - q)
        met = (np.bincount(values[:, i]).astype(np.float64) ** 2).sum() * scale**2
        costs.append([met * sum(ways[: t + 1]) + PROBE * n * sum(comb(len(group), k) for k in range(t + 1)) for t in range(MOST + 1)])
    return groups, allocate(costs, TAU - PARTS + 1)


def prints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(row, doc_id, key, node, print, shingles): key is the text's hash, node that of its set."""
    ship(spark)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, row = WordHashes(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_A_TIME):
                part = batch.slice(at, DOCS_A_TIME)
                sets = [shingle_set(ids, x.as_py()) for x in part.column(2)]
                node = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
                found = pa.array([fingerprint(s).tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(sets))), part.column(0), part.column(1), pa.array(node), found, pa.array([s.tobytes() for s in sets], pa.binary())], ["row", "doc_id", "key", "node", "print", "shingles"])
                row += len(sets)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text").mapInArrow(task, "row long, doc_id long, key long, node long, print binary, shingles binary")


def near_forest(role: np.ndarray, c: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Places of one bucket's rows, a forest that joins the components comp (places) by pairs that differ in at most NEAR bits, one of them at home."""
    comp, links, todo = comp.copy(), [], np.ones(len(c), bool)
    while True:  # a pair both of whose rows are still to do is in one component at the end
        left = np.bincount(comp[todo], minlength=1)
        if (left > 0).sum() < 2:
            return links
        x = int(np.flatnonzero(todo & (comp != left.argmax()))[0])
        near = (comp != comp[x]) & (np.bitwise_count(c ^ c[x]).sum(1, dtype=np.int64) <= NEAR)
        if role[x]:
            near &= role == 0
        for y in np.unique(comp[near], return_index=True)[1]:
            links.append((x, int(np.flatnonzero(near)[y])))
        comp[np.isin(comp, comp[near])] = comp[x]
        todo[x] = False


def near_pairs(k: np.ndarray, role: np.ndarray, c: np.ndarray, node: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows sorted by k: for each k, a forest of the components of rows that differ in at most NEAR bits; rows of one node are together."""
    node = np.arange(len(k)) if node is None else node
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.append(first, len(k)))
    last = np.repeat(first + size, size)
    order = np.lexsort((node, k))  # stable
    new = np.concatenate([[True], (k[order][1:] != k[order][:-1]) | (node[order][1:] != node[order][:-1])])
    start = np.empty(len(k), np.int64)
    start[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    mixed = np.add.reduceat(start == np.arange(len(k)), first, dtype=np.int64) > 1
    comp, at, d = start.copy(), np.flatnonzero(np.repeat(mixed & (size <= LARGE), size)), 1
    while len(at := at[at + d < last[at]]):
        ok = at[(comp[at] != comp[at + d]) & ((role[at] == 0) | (role[at + d] == 0))]
        ok = ok[np.bitwise_count(c[ok] ^ c[ok + d]).sum(1, dtype=np.int64) <= NEAR]
        merge(comp, ok, ok + d)
        d += 1
    x = [np.flatnonzero((start == np.arange(len(k))) & (comp != start))]
    y = [comp[x[0]]]
    large = np.flatnonzero(mixed & (size > LARGE))
    for a, n in zip(first[large].tolist(), size[large].tolist(), strict=True):
        found = a + np.array(near_forest(role[a : a + n], c[a : a + n], start[a : a + n] - a), np.int64).reshape(-1, 2)
        x.append(found[:, 0])
        y.append(found[:, 1])
    return np.concatenate(x), np.concatenate(y)


def _near_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, role, node, c0, c1) sorted by k -> links (a, b) of nodes, fewer than rows; rows of one node are together already."""

    def linked(rows: pa.Table) -> pa.RecordBatch:
        k, role, node, c0, c1 = (rows.column(i).to_numpy() for i in range(5))
        x, y = near_pairs(k, role, np.stack([c0, c1], 1).view(np.uint64), node)
        pairs = np.unique(np.sort(np.stack([node[x], node[y]], 1), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(0).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))  # the last bucket may go on
        if cut or held and held[0].column(0)[0].as_py() != int(k[0]):
            yield linked(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield linked(pa.Table.from_batches(held))


def candidates(spark: SparkSession, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links with the components of all nodes that agree within a partition's threshold and differ in at most NEAR bits; at most one a node from
    the early partitions, and in each other one fewer than the bucket has components of these."""
    sample = [r.print for r in nodes.select("node", "print").orderBy("node").limit(SAMPLE).collect()]
    groups, thresholds = partitions(np.frombuffer(b"".join(sample), np.uint8).reshape(-1, BITS // 8), nodes.count())
    flips = [(i, [sum(1 << b for b in flip) for k in range(t + 1) for flip in combinations(range(len(groups[i])), k)]) for i, t in enumerate(thresholds) if t >= 0]

    def met(nodes: DataFrame, flips: list[tuple[int, list[int]]], name: str) -> DataFrame:
        """Links between the values of column node, by some of the partitions."""

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, DOCS_A_TIME):
                    part = batch.slice(at, DOCS_A_TIME)
                    prints = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, BITS // 8)
                    values = partition_values(prints, groups)
                    k = np.concatenate([values[:, i] ^ flip | i << 16 for i, masks in flips for flip in masks])
                    role = np.repeat(np.array([int(flip > 0) for _, masks in flips for flip in masks], np.int8), len(prints))
                    turn = np.tile(np.arange(len(prints)), len(k) // len(prints))
                    c = prints[:, :16].copy().view(np.int64)[turn]
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(role), pa.array(part.column(0).to_numpy()[turn]), pa.array(c[:, 0]), pa.array(c[:, 1])], ["k", "role", "node", "c0", "c1"])

        rows = nodes.select("node", "print").mapInArrow(probe, "k int, role byte, node long, c0 long, c1 long")
        return scratch.save(rows.repartition("k").sortWithinPartitions("k").mapInArrow(_near_task, "a long, b long"), name)

    flips.sort(key=lambda x: len(x[1]))
    known = connected_components(spark, met(nodes, flips[:EARLY], "near-early"), scratch, "early-cc", few=FEW)
    rooted = nodes.select("node", "print").join(known, "node", "left").select(F.coalesce("root", "node").alias("node"), "print")
    return known.select(F.col("node").alias("a"), F.col("root").alias("b")).union(met(rooted, flips[EARLY:], "near"))


def similar_links(sets: list[np.ndarray], known: np.ndarray) -> list[tuple[int, int]]:
    """Places of sets, a spanning forest of what similarity SIMILARITY links beyond the components that are known."""
    n, size = len(sets), np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if known[0] != known[1] and both / max(1, size.sum() - both) >= SIMILARITY else []
    comp, links, todo = np.unique(known, return_inverse=True)[1], [], np.ones(n, bool)
    inverse = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order, base = np.argsort(inverse, kind="stable"), np.concatenate([[0], np.cumsum(size)])
    owner, first = np.repeat(np.arange(n), size)[order], np.searchsorted(inverse[order], np.arange(inverse.max(initial=-1) + 2))
    while True:  # a pair both of whose sets are still to do is in one component at the end
        left = np.bincount(comp[todo], minlength=1)
        if (left > 0).sum() < 2:
            return links
        x = int(np.flatnonzero(todo & (comp != left.argmax()))[0]) if todo.sum() < n else 0
        mine = inverse[base[x] : base[x + 1]]
        a, m = first[mine], first[mine + 1] - first[mine]
        at = np.repeat(a - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum()) if len(m) else np.zeros(0, np.int64)
        both = np.bincount(owner[at], minlength=n)
        for y in np.flatnonzero(both / np.maximum(1, size + size[x] - both) >= SIMILARITY).tolist():
            if comp[y] != comp[x]:
                links.append((x, y))
                comp[comp == comp[y]] = comp[x]
        todo[x] = False


def _cell_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, cell, node, known, shingles) sorted by (k, cell) -> links (a, b)."""
    now, nodes, known, sets, out = None, [], [], [], []

    def done() -> None:
        if len(nodes) > 1:
            out.extend((nodes[i], nodes[j]) for i, j in similar_links(sets, np.array(known)))
        for x in (nodes, known, sets):
            x.clear()

    for batch in batches:
        for k, cell, node, root, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
            if (k, cell) != now:
                done()
                now = k, cell
            nodes.append(node)
            known.append(root)
            sets.append(np.frombuffer(raw.as_py(), np.uint64))
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
            out.clear()
    done()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])


def links_of(spark: SparkSession, rows: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links with the components of all candidate pairs of similarity SIMILARITY; rows are prints, nodes (node, row, print) one of each set."""
    keyed = connected_components(spark, candidates(spark, nodes, scratch), scratch, "near-cc", few=FEW).withColumnRenamed("root", "k")
    buckets = scratch.save(keyed.groupBy("k").agg(F.count("*").alias("n")).withColumn("hub", F.col("k")), "buckets")
    members = scratch.save(keyed.join(buckets, "k").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks"))), "members")
    wanted = scratch.save(nodes.select("node", "row").join(members.select("node"), "node", "left_semi").select("row"), "wanted")
    sets = scratch.save(rows.select("row", "node", "shingles").join(wanted, "row", "left_semi").drop("row"), "sets")

    def linked(cells: DataFrame, name: str) -> DataFrame:
        full = cells.join(sets, "node").select("k", "cell", "node", "known", "shingles")
        return scratch.save(full.repartition("k", "cell").sortWithinPartitions("k", "cell").mapInArrow(_cell_task, "a long, b long"), name)

    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    cells = members.withColumn("cell", F.explode(F.when(F.col("node") == F.col("hub"), every).otherwise(F.array("block"))))
    links = linked(cells.withColumn("known", F.col("node")), "links")
    if buckets.filter(F.col("n") > BLOCK).isEmpty():
        return links
    roots = connected_components(spark, links, scratch, "first", few=FEW)
    cut = scratch.save(members.filter("blocks > 1").join(roots, "node", "left").withColumn("known", F.coalesce("root", "node")).drop("root"), "cut")
    most = cut.groupBy("k", "known").count().groupBy("k").agg(F.max_by("known", F.struct("count", "known")).alias("main"), (F.sum("count") - F.max("count")).alias("out"))
    cut = cut.join(scratch.save(most.filter("out > 0"), "most"), "k").withColumn("parts", F.ceil(F.col("out") / BLOCK).cast("long"))
    others = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    all_rows = cut.withColumn("part", F.explode(others))
    out_rows = cut.filter(F.col("known") != F.col("main")).withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts"))).withColumn("block", F.explode(every))
    cells = all_rows.unionByName(out_rows).select("k", (F.col("block") * F.col("parts") + F.col("part")).alias("cell"), "node", "known").distinct()
    return links.union(linked(cells, "links-cut"))


def kept_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, key) of each component's smallest row that has an id; key is xxhash64 of the text."""
    scratch = Scratch(spark, "near")
    rows = scratch.save(prints(spark, docs), "prints")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key")))
    nodes = scratch.save(rows.groupBy("node").agg(F.min("row").alias("row"), F.first("print").alias("print"), least.alias("least")), "nodes")
    roots = connected_components(spark, links_of(spark, rows, nodes, scratch), scratch, few=FEW)
    named = nodes.select("node", "least").join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("least").alias("least"))
    kept = scratch.save(named.filter("least is not null").select("least.doc_id", "least.key"), "kept")
    for name in ("prints", "sets"):
        scratch.drop(name)
    return kept
