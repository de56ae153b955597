"""Packing by lexical retrieval: sequences filled with a seed document's BM25 neighbours.

Documents are encoded once and dealt into shards of about SHARD_TOKENS tokens by content: by the least-hashed of a document's KEY_TERMS
heaviest terms, so that texts meet as often as they share these, whatever the number of shards. Keys of more than a shard's tokens are split by a hash. Each shard holds an inverted index over
its pieces, with document frequencies and mean length of the whole corpus (one number for each vocabulary entry, so broadcast whatever the
corpus). Full-length stretches of long documents are sequences of their own. Of the rest, the longest unused piece is the seed; its
heaviest terms are the query (QUERY_TERMS of them, or all), and its unused neighbours fill the sequence, best first, as long as they fit; what room
is left goes to the front part of the best neighbour that doesn't fit (or, if no neighbour is left, of the next unused piece), whose rest stays
unused. So only a shard's last sequence is padded, and gaps of under MIN_CUT. A shard takes its documents in order of id and tokens, so a
task that runs again packs them alike.

Every id lies in exactly one piece. Null and empty texts are the end id alone. Repeated rows are packed each; null doc_ids stay null;
an empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read, ship
from .tokens import default_path, encoder

WINDOW, END_ID, SHARD_TOKENS, QUERY_TERMS, MIN_CUT, K1, B = 2048, 1, 3_000_000, 24, 8, 1.2, 0.75
KEY_TERMS, KEYS, AT_FIRST = 8, 1 << 16, 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def weights(ids: np.ndarray, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """(terms, BM25 weights) of a document or piece."""
    ids = np.sort(ids, kind="stable")  # numbers of 16 bits by radix
    new = np.ones(len(ids) + 1, bool)
    np.not_equal(ids[1:], ids[:-1], out=new[1:-1])
    at = np.flatnonzero(new)
    terms, tf = ids[at[:-1]], at[1:] - at[:-1]
    return terms, (idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))).astype(np.float32)


@lru_cache(maxsize=2)
def term_hashes(size: int) -> np.ndarray:
    h = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def content_key(ids: np.ndarray, idf: np.ndarray, mean: float) -> int:
    """The least-hashed of the KEY_TERMS heaviest terms (ties: the smaller), as a number under KEYS."""
    terms, w = weights(ids, idf, mean)
    if len(w) > KEY_TERMS:
        terms = terms[w >= np.partition(w, len(w) - KEY_TERMS)[len(w) - KEY_TERMS]][:KEY_TERMS]
    return int(term_hashes(len(idf))[terms].min()) * 0xD6E8FEB86659FD93 % (1 << 64) >> 48


def encoded(spark: SparkSession, docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, n, ids, term): the text's ids and the end id, as little-endian numbers of the vocabulary's width, term null.

    Besides, of every task's terms, (null, documents with it, null, term): what a second pass would count.
    """
    ship(spark)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end, df = np.array([end_id], enc.kind).tobytes(), np.zeros(enc.size, np.int64)
        names = ["doc_id", "n", "ids", "term"]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [enc.encode(x.as_py() or "") + end for x in part.column(1)]
                for x in ids:
                    df[np.frombuffer(x, enc.kind)] += 1  # once for each term, however often it comes
                n = [len(x) // enc.kind.itemsize for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.nulls(len(n), pa.int32())], names)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(df[at]), pa.nulls(len(at), pa.binary()), pa.array(at, pa.int32())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, n long, ids binary, term int")


def frequencies(tokens: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Of encoded(): documents, their ids, and the documents with each term."""
    n, total, df = 0, 0, np.zeros(size, np.int64)
    for r in tokens.groupBy("term").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect():  # at most `size` rows and one
        if r.term is None:
            n, total = r.rows, r.n
        else:
            df[r.term] = r.n
    return n, total, df


def dealt_keys(sizes: dict[int, int], shard_tokens: int) -> tuple[list[tuple[int, int, int]], int]:
    """(key, first shard, shards) of every key with its tokens, and the number of shards: neighbours fill one up, larger keys have their own."""
    out, shard, room = [], -1, 0
    for key, n in sorted(sizes.items()):
        if n > shard_tokens:
            continue
        if shard < 0 or n > room:
            shard, room = shard + 1, shard_tokens
        out.append((key, shard, 1))
        room -= n
    for key, n in sorted(sizes.items()):
        if n > shard_tokens:
            out.append((key, shard + 1, -(-n // shard_tokens)))
            shard += out[-1][2]
    return out, shard + 1


class Shard:
    """Greedy filling of windows from one shard's documents: arrays of ids, in their order."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int, query_terms: int | None = QUERY_TERMS):
        self.docs, self.window, self.query_terms = docs, window, query_terms
        self.full = [(d, at, window) for d, ids in enumerate(docs) for at in range(0, len(ids) - len(ids) % window, window)]
        rest = [(d, len(ids) - len(ids) % window) for d, ids in enumerate(docs) if len(ids) % window]
        self.doc = np.array([d for d, _ in rest], np.int64)
        self.start = np.array([s for _, s in rest], np.int64)
        self.left = np.array([len(docs[d]) - s for d, s in rest], np.int64)
        terms, owners, heavy = [], [], []
        for i, (d, s) in enumerate(rest):
            t, w = weights(docs[d][s:], idf, mean)
            terms.append(t)
            heavy.append(w)
            owners.append(np.full(len(t), i, np.int32))
        if not rest:
            return
        terms, owner, weight = np.concatenate(terms), np.concatenate(owners), np.concatenate(heavy)
        self.first = np.searchsorted(owner, np.arange(len(rest) + 1))
        self.terms, self.weight = terms, weight
        order = np.argsort(terms, kind="stable")
        self.posting_owner, self.posting_weight = owner[order], weight[order]
        self.at = np.searchsorted(terms[order], np.arange(len(idf) + 1))
        self.held = len(rest)

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[np.ndarray]:
        """Unused pieces that share a query term with the seed, best first (ties: the earlier), in a short array and one of the rest."""
        if (left := int(unused.sum())) < 0.5 * self.held:  # postings of used pieces go from time to time
            keep = unused[self.posting_owner]
            self.at = np.concatenate([[0], np.cumsum(keep)])[self.at]
            self.posting_owner, self.posting_weight, self.held = self.posting_owner[keep], self.posting_weight[keep], left
        a, b = self.first[seed], self.first[seed + 1]
        best = np.argsort(-self.weight[a:b], kind="stable")[: self.query_terms]
        score = np.zeros(len(self.left), np.float32)
        for t in self.terms[a:b][best]:
            x, y = self.at[t], self.at[t + 1]
            score[self.posting_owner[x:y]] += self.posting_weight[x:y]
        found = np.flatnonzero((score > 0) & unused)
        s = score[found]
        best = s >= np.partition(s, len(s) - AT_FIRST)[len(s) - AT_FIRST] if len(s) > AT_FIRST else np.ones(len(s), bool)
        yield found[best][np.argsort(-s[best], kind="stable")]
        yield found[~best][np.argsort(-s[~best], kind="stable")]

    def sequences(self) -> Iterator[list[tuple[int, int, int]]]:
        """Lists of (document, start, length)."""
        for piece in self.full:
            yield [piece]
        unused = np.ones(len(self.left), bool)
        by_length = np.argsort(-self.left, kind="stable")
        at = 0
        while True:
            while at < len(by_length) and not unused[by_length[at]]:
                at += 1
            if at == len(by_length):
                return
            seed = int(by_length[at])
            unused[seed] = False
            out, room = [self._take(seed, int(self.left[seed]))], self.window
            room -= out[0][2]
            if room >= MIN_CUT:
                over = -1
                for near in self.neighbours(seed, unused):
                    at_near = 0
                    while room >= MIN_CUT and at_near < len(near):
                        fit = self.left[near[at_near:]] <= room
                        step = int(fit.argmax()) if fit.any() else len(fit)
                        if step and over < 0:  # the best that doesn't fit
                            over = int(near[at_near])
                        at_near += step
                        if at_near < len(near):
                            i = int(near[at_near])
                            out.append(self._take(i, int(self.left[i])))
                            unused[i] = False
                            room -= out[-1][2]
                            at_near += 1
                    if room < MIN_CUT:
                        break
                while room >= MIN_CUT:
                    if over < 0:
                        while at < len(by_length) and not unused[by_length[at]]:
                            at += 1
                        if at == len(by_length):
                            break
                        over = int(by_length[at])
                    n = min(room, int(self.left[over]))
                    out.append(self._take(over, n))
                    unused[over] = self.left[over] > 0
                    room -= n
                    over = -1
            yield out

    def _take(self, i: int, n: int) -> tuple[int, int, int]:
        piece = (int(self.doc[i]), int(self.start[i]), n)
        self.start[i] += n
        self.left[i] -= n
        return piece


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, query_terms: int | None = QUERY_TERMS) -> DataFrame:
    """Pieces of documents in sequences, with their ids (little-endian, unsigned, 32 bits): see PIECES. query_terms None: all terms of a seed."""
    path = path or default_path()
    scratch = Scratch(spark, "packing")
    tokens = scratch.save(encoded(spark, docs, path, end_id), "tokens")
    kind, size = encoder(path).kind, encoder(path).size
    n, total, df = frequencies(tokens, size)
    model = spark.sparkContext.broadcast((np.log1p((n - df + 0.5) / (df + 0.5)), max(1.0, total / max(1, n))))

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [content_key(np.frombuffer(x.as_buffer(), kind), *model.value) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], ["doc_id", "n", "ids", "key"])

    keyed = scratch.save(tokens.filter("term is null").drop("term").mapInArrow(with_key, "doc_id long, n long, ids binary, key int"), "keyed")
    scratch.drop("tokens")
    sizes = keyed.groupBy("key").agg(F.sum("n").alias("n")).collect()  # at most KEYS rows
    dealt, shards = dealt_keys({r.key: r.n for r in sizes}, shard_tokens)
    keys = spark.createDataFrame(dealt, "key int, first int, parts int")
    names = [x.split()[0] for x in PIECES.split(", ")]

    def packed(shard: int, owners: list[int | None], ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = []

        def out():
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.binary())], names)

        for k, pieces in enumerate(Shard(ids, *model.value, window, query_terms).sequences()):
            offset = 0
            for d, start, length in pieces:
                raw = ids[d][start : start + length].astype("<u4").tobytes()
                rows.append((owners[d], start, length, zlib.crc32(raw), len(ids[d]), (shard << 32) + k, offset, raw))
                offset += length
            if len(rows) >= 2000:
                yield out()
                rows = []
        if rows:
            yield out()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, doc_id, ids) in this order."""
        now, owners, ids = None, [], []
        for batch in batches:
            for shard, owner, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if shard != now:
                    if ids:
                        yield from packed(now, owners, ids)
                    now, owners, ids = shard, [], []
                owners.append(owner)
                ids.append(np.frombuffer(raw.as_py(), kind))
        if ids:
            yield from packed(now, owners, ids)

    shard = F.col("first") + F.pmod(F.xxhash64("doc_id", "ids"), F.col("parts")).cast("int")
    placed = keyed.join(F.broadcast(keys), "key").select(shard.alias("shard"), "doc_id", "ids")
    return placed.repartition(max(1, shards), "shard").sortWithinPartitions("shard", "doc_id", "ids").mapInArrow(task, PIECES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, read(spark, sf_dir, "documents")).drop("ids")
