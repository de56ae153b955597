"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint bit is 1 if set in over half of the hashes of a text's word shingles. The 64 bits are grouped into partitions of
correlated bits; a dynamic programme gives each partition its own threshold (-1 leaves it out), so that the thresholds sum to
tau - m + 1 and the estimated number of candidates, and of the probes that find them, is least. If two fingerprints differ in at most tau bits, some partition differs in
at most its threshold; so every fingerprint probes its partitions' values within the thresholds, and candidates are verified.

Null and empty texts have fingerprint zero and are linked like any other. Equal fingerprints are one node, however many rows share
them. Buckets of over BUCKET nodes are not compared in one task: for tau <= 2 their members meet at common one-bit neighbours (two
words differ in at most two bits just if they share one; a neighbour has 65 members at most), else they are cut into blocks, compared
block by block. Bucket tasks return spanning forests, not pairs. Null ids count as no id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read, ship
from .components import connected_components

BITS, BUCKET, BLOCK, CHUNK, MANY_HOT = 64, 4096, 2048, 8192, 20_000
#: What a probe costs, in candidate pairs.
PROBE = 4


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case; bytes.split() cuts at the blank and at 0x09-0x0D, no others."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def majority(items: list[bytes], seed: int = 42) -> int:
    """Bits set in over half of the items' XXH64; zero without items."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(items), CHUNK):
        digests = b"".join([xxhash.xxh64_digest(x, seed) for x in items[at : at + CHUNK]])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(items)).tobytes(), "big") if items else 0


def shingles(words: list[bytes], width: int) -> list[bytes]:
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(width)), strict=False)]


def fingerprints(spark: SparkSession, docs: DataFrame, width: int = 3, checked_width: int = 0) -> DataFrame:
    """(doc_id, a, b0, b1): a from shingles of `width` words, repeats included.

    With checked_width, a is from the distinct words (which few edits move little), and b0, b1 are 128 bits from the shingles of checked_width words.
    """
    ship(spark)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.uint64)
            for i, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                if checked_width:
                    long = shingles(words, checked_width)
                    out[:, i] = majority(list(dict.fromkeys(words))), majority(long), majority(long, 43)
                else:
                    out[0, i] = majority(shingles(words, width))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.view(np.int64)) for x in out)], ["doc_id", "a", "b0", "b1"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, a long, b0 long, b1 long")


def correlated_groups(both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of BITS bits, correlated ones together; both: the share of fingerprints in which two bits are set."""
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    close = np.abs((both - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(close, 0)
    left, groups = set(range(BITS)), []
    for g in range(m):
        size = (BITS - sum(map(len, groups))) // (m - g)
        order = sorted(left)
        group = [max(order, key=lambda b: (close[b, order].max(), -b))]
        left.discard(group[0])
        while len(group) < size:
            group.append(max(sorted(left), key=lambda b: (close[b, group].mean(), -b)))
            left.discard(group[-1])
        groups.append(sorted(group))
    return groups


def correlated_partitions(nodes: DataFrame, m: int) -> tuple[list[list[int]], np.ndarray]:
    """m groups of bits, correlated ones together, and how often two fingerprints differ in each bit; from counts over all nodes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = np.unpackbits(np.ascontiguousarray(batch.column(0).to_numpy().view(np.uint64).astype(">u8")).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            for at in range(0, len(x), CHUNK):
                both += x[at : at + CHUNK].T @ x[at : at + CHUNK]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1, dtype=np.int32)), pa.array(np.append(both.ravel(), n))], ["k", "n"])

    got = {r.k: r.n for r in nodes.select("a").mapInArrow(task, "k int, n double").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    n = max(1.0, got.get(BITS * BITS, 1.0))
    both = np.array([got.get(k, 0.0) for k in range(BITS * BITS)]).reshape(BITS, BITS) / n
    p = np.diag(both)
    return correlated_groups(both, m), 2 * p * (1 - p)


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds -1.. for each partition that sum to `total` at the least cost; costs[i][t] is of threshold t, -1 costs nothing."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, chosen) in best.items():
            for t in range(-1, len(cost)):
                option = (c + (cost[t] if t >= 0 else 0.0), [*chosen, t])
                if spent + t not in nxt or option < nxt[spent + t]:
                    nxt[spent + t] = option
        best = nxt
    return best[total][1]


def _mask(bits: list[int]) -> int:
    """Bit 0 is the highest, as unpackbits has it; as a signed 64-bit number."""
    x = sum(1 << (BITS - 1 - b) for b in bits)
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _probe(groups: list[list[int]], thresholds: list[int]) -> Column:
    """Of each used partition: (part, val, role), role 0 at home and 1 at every other value within the threshold."""
    out = []
    for i, (bits, t) in enumerate(zip(groups, thresholds, strict=True)):
        for k in range(t + 1):
            for flip in combinations(bits, k):
                val = F.col("a").bitwiseAND(F.lit(_mask(bits)).cast("long")).bitwiseXOR(F.lit(_mask(list(flip))).cast("long"))
                out.append(F.struct(F.lit(i).alias("part"), val.alias("val"), F.lit(int(k > 0)).alias("role")))
    return F.explode(F.array(*out))


def bucket_links(tau: int, tau_checked: int | None):
    """For mapInArrow over rows sorted by (k0, k1): links of each bucket's nodes that verify, as a spanning forest."""

    def linked(rows: pa.Table) -> pa.RecordBatch:
        k0, k1, role, node, a, b0, b1 = (rows[c].to_numpy() for c in ("k0", "k1", "role", "node", "a", "b0", "b1"))
        n = len(k0)
        same = (k0[1:] == k0[:-1]) & (k1[1:] == k1[:-1])
        group = np.concatenate([[0], np.cumsum(~same)])
        a, b0, b1 = a.view(np.uint64), b0.view(np.uint64), b1.view(np.uint64)
        last = np.searchsorted(group, group, side="right")
        root, links, d, at = np.arange(n), [], 1, np.arange(n)
        while True:
            at = at[at + d < last[at]]
            if not len(at):
                break
            to = at + d
            ok = (np.bitwise_count(a[at] ^ a[to]) <= tau) & ((role[at] == 0) | (role[to] == 0)) & (node[at] != node[to])
            if tau_checked is not None:
                ok &= np.bitwise_count(b0[at] ^ b0[to]).astype(np.int16) + np.bitwise_count(b1[at] ^ b1[to]) <= tau_checked
            x, y = at[ok], to[ok]
            apart = root[x] != root[y]
            if apart.any():
                for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
                    while root[i] != i:
                        i = root[i]
                    while root[j] != j:
                        j = root[j]
                    if i != j:
                        root[max(i, j)] = min(i, j)
                        links.append((i, j))
                while (root[root] != root).any():
                    root = root[root]
            d += 1
        x, y = (np.array(links, np.int64).reshape(-1, 2)).T
        return pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], ["a", "b"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k0, k1 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = int(np.flatnonzero((k0 != k0[-1]) | (k1 != k1[-1]))[-1]) + 1 if (k0[0], k1[0]) != (k0[-1], k1[-1]) else 0
            if cut or held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (int(k0[0]), int(k1[0])):
                yield linked(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield linked(pa.Table.from_batches(held))

    return task


def links_within(spark: SparkSession, nodes: DataFrame, scratch: Scratch, tau: int, m: int, tau_checked: int | None = None) -> DataFrame:
    """(a, b): links among `nodes` (node, a, b0, b1: written, distinct) that have the same components as all pairs within tau."""
    groups, differ = correlated_partitions(nodes, m)
    home = nodes.select(_probe(groups, [0] * m).alias("p")).groupBy("p.part", "p.val").count()
    squares = {r.part: (float(r.s), r.n) for r in home.groupBy("part").agg(F.sum(F.col("count").cast("double") ** 2).alias("s"), F.sum("count").alias("n")).collect()}
    costs = []
    for i, bits in enumerate(groups):
        ways = [1.0] + [0.0] * tau  # elementary symmetric sums of the odds that a bit differs
        for b in bits:
            q = min(differ[b], 0.499)
            for k in range(tau, 0, -1):
                ways[k] += ways[k - 1] * q / (1 - q)
        pairs, n = squares.get(i, (0.0, 0))
        costs.append([pairs * sum(ways[: t + 1]) + PROBE * max(1, n) * sum(comb(len(bits), k) for k in range(t + 1)) for t in range(tau + 1)])
    thresholds = allocate(costs, tau - m + 1)
    rows = nodes.withColumn("p", _probe(groups, thresholds)).select(F.col("p.part").cast("long").alias("k0"), F.col("p.val").alias("k1"), F.col("p.role").alias("role"), "node", "a", "b0", "b1")
    hot = scratch.save(rows.groupBy("k0", "k1").count().filter(F.col("count") > BUCKET), "hot")
    n_hot = hot.count()
    cool, parts = rows, []
    if n_hot:
        side = F.broadcast(hot) if n_hot <= MANY_HOT else hot
        cool = rows.join(side.select("k0", "k1"), ["k0", "k1"], "left_anti")
        if tau <= 2 and tau_checked is None:
            near = rows.join(side.select("k0", "k1"), ["k0", "k1"], "left_semi").select("a").distinct()
            flips = F.array(F.lit(0).cast("long"), *[F.lit(_mask([b])).cast("long") for b in range(BITS)])
            meet = near.select("a", F.explode(flips).alias("f")).groupBy(F.col("a").bitwiseXOR(F.col("f")).alias("z")).agg(F.collect_list("a").alias("all")).filter(F.size("all") > 1)
            parts.append(meet.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).filter("a <> b").distinct())
        else:
            blocks = F.ceil(F.col("count") / BLOCK).cast("int")
            cell = rows.join(side, ["k0", "k1"]).withColumn("n", blocks).withColumn("mine", F.pmod(F.xxhash64("node", F.lit(5)), F.col("n")).cast("int"))
            cell = cell.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            cell = cell.withColumn("k1", F.xxhash64("k0", "k1", F.least("mine", "other"), F.greatest("mine", "other"))).withColumn("k0", F.lit(-1).cast("long"))
            cool = cool.select("k0", "k1", "role", "node", "a", "b0", "b1").union(cell.select("k0", "k1", "role", "node", "a", "b0", "b1"))
    cool = cool.select("k0", "k1", "role", "node", "a", "b0", "b1").repartition("k0", "k1").sortWithinPartitions("k0", "k1")
    parts.append(cool.mapInArrow(bucket_links(tau, tau_checked), "a long, b long"))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 3, tau: int = 2, m: int = 3, checked_width: int = 0, tau_checked: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable through links, its own included."""
    ship(spark)
    scratch = Scratch(spark, "simhash")
    prints = scratch.save(fingerprints(spark, docs, width, checked_width), "prints")
    node = F.xxhash64("a", "b0", "b1") if checked_width else F.col("a")
    prints = prints.withColumn("node", node)
    nodes = scratch.save(prints.groupBy("node").agg(F.first("a").alias("a"), F.first("b0").alias("b0"), F.first("b1").alias("b1"), F.min("doc_id").alias("least")), "nodes")
    links = links_within(spark, nodes, scratch, tau, m, tau_checked)
    roots = connected_components(spark, links, scratch)
    named = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = scratch.save(named.select("node", "root").join(smallest, "root").select("node", "component_id"), "classes")
    return prints.join(classes, "node").select("doc_id", F.lpad(F.lower(F.hex("a")), 16, "0").alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read(spark, sf_dir, "documents"))
