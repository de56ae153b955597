"""Removal of every byte covered by an L-byte string that also starts elsewhere, by column-wise construction over many documents.

A full collection transform needs as many rounds as the longest document has symbols, each passing over all that was inserted before;
for texts of 100,000 bytes and more that is out of reach. So the construction runs on anchored windows, with the same exact result:

1. Every L-byte window has one anchor, the least-hashed K-byte string inside it (the leftmost of equals). Equal windows have equal
   anchors at equal places, so windows that share no anchor string need never meet. All windows of an anchor form its context.
2. Contexts seen twice are settled whole: all their windows repeat. Each map batch combines its own contexts first and sends one row
   for each, so a context that a third of all documents share is a few rows.
3. What is left (edges of repeats) is sorted column by column: the contexts of an anchor string are aligned at it, and each round
   prepends one symbol of every context, from the last column to the first: a stable sort of the last round's order by the new symbols
   (the column's Burrows-Wheeler segment) and an update of the common prefixes of neighbours (one more than the least in between, or
   zero). A window repeats just if its common prefix with a neighbour is L or more. Rows come in order from sorted shuffle files and
   go through in bounded collections, a round at a time.
4. Anchor strings with over HOT different contexts are split by whole windows instead: counts of 128-bit window hashes, combined before the
   shuffle. Those that come over HEAVY_ROWS times are known from a count ahead (of strings that some batch has HEAVY times), and their contexts are
   dealt by their own hashes in step 2, so that no task sees all of them.

Contexts meet by the hash of their anchor string and their own, 128 bits in all.

Null texts are empty; matches never cross documents; equal rows count as repeats of one another; texts under L bytes stay whole; an
empty table gives an empty result; extra columns are left out. Strings are compared on the input, never on what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read, ship

LENGTH, K, HOT, ROWS, PIECE, HEAVY, HEAVY_ROWS, MOST_HEAVY = 200, 32, 20_000, 16_384, 1 << 20, 32, 1 << 20, 50_000
ANCHOR = "ek long, kind int, k long, ctx long, cnt int, did long, rk long, p int, jlo int, jhi int"
FOUND = "kind int, k long, settled boolean, did long, rk long, p int, jlo int, jhi int"


def anchors(buf: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, p, first, last) of each anchor: its place and its windows' starts. Texts lie in buf one after another up to `ends`."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    if len(buf) < length:
        return none
    h, power = buf.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019), 0xD6E8FEB86659FD93
    for s in (1, 2, 4, 8, 16):  # K = 32
        h = h[:-s] * np.uint64(power) + h[s:]
        power = power * power % (1 << 64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    w, s = length - K + 1, 1
    while s * 2 <= w:
        low = np.minimum(low[:-s], low[s:])
        s *= 2
    low = np.minimum(low[: len(low) - (w - s)], low[w - s :]) if w > s else low
    ok = np.ones(len(low), bool)  # a window must end in its own text
    for e in ends[:-1]:
        ok[max(0, e - length + 1) : e] = False
    starts = np.flatnonzero(ok)
    if not len(starts):
        return none
    p = (low[starts] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return h[p[new]], p[new], starts[new], starts[np.append(new[1:], len(starts)) - 1]


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, offset, bytes) of about PIECE bytes; long texts come in pieces that share length - 1 bytes."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[at : at + PIECE + length - 1]
            if len(part) < length:
                continue
            if size + len(part) > PIECE and group:
                yield group
                group, size = [], 0
            group.append((i, at, part))
            size += len(part)
    if group:
        yield group


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of a document as one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    shift = doc.astype(np.int64) * (1 << 33)
    reach = np.maximum.accumulate(end + shift)
    new = np.flatnonzero(np.concatenate([[True], (start + shift)[1:] > reach[:-1]]))
    return doc[new], start[new], (reach - shift)[np.append(new[1:], len(doc)) - 1]


def _heavy_task(length: int, heavy: int):
    """Texts -> (k, n) of the anchor strings that a batch has `heavy` times, and (null, n) of all its anchors."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for group in _pieces([x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()], length):
                found.append(anchors(np.frombuffer(b"".join(x[2] for x in group), np.uint8), np.cumsum([len(x[2]) for x in group]), length)[0])
            every = np.concatenate(found)
            k, n = np.unique(every, return_counts=True)
            k, n = k[n >= heavy], n[n >= heavy]
            yield pa.RecordBatch.from_arrays([pa.array([*k.view(np.int64).tolist(), None], pa.int64()), pa.array([*n.tolist(), len(every)], pa.int64())], ["k", "n"])

    return task


def _anchor_task(length: int, heavy):
    """heavy: a broadcast of sorted anchor hashes; their rows are of kind 2 and dealt by their contexts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
            did, rk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            got = []
            for group in _pieces(texts, length):
                whole = b"".join(x[2] for x in group)
                ends = np.cumsum([len(x[2]) for x in group])
                k, p, lo, hi = anchors(np.frombuffer(whole, np.uint8), ends, length)
                if not len(k):
                    continue
                view = memoryview(whole)
                ctx = np.fromiter((xxhash.xxh64_intdigest(view[a : b + length], c - a) for a, b, c in zip(lo.tolist(), hi.tolist(), p.tolist(), strict=True)), np.uint64, len(k))
                of = np.searchsorted(ends, lo, side="right")
                shift = np.array([x[1] for x in group]) - np.concatenate([[0], ends[:-1]])
                got.append((k, ctx, np.array([x[0] for x in group])[of], p + shift[of], lo + shift[of], hi + shift[of]))
            if not got:
                continue
            k, ctx, doc, p, lo, hi = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((ctx, k))
            new = np.concatenate([[True], (k[order][1:] != k[order][:-1]) | (ctx[order][1:] != ctx[order][:-1])])
            first, times = np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(order)))
            twice = np.repeat(times > 1, times)
            s_doc, s_lo, s_hi = _merged(doc[order][twice], lo[order][twice], hi[order][twice] + length)
            one = order[first]
            n, m = len(one), len(s_doc)
            known, at = heavy.value, np.searchsorted(heavy.value, k[one])
            many = known[np.minimum(at, len(known) - 1)] == k[one] if len(known) else np.zeros(n, bool)
            deal = np.where(many, k[one] ^ (ctx[one] * np.uint64(0x9E3779B97F4A7C15)), k[one])
            ints = lambda x, y, kind: pa.array(np.concatenate([x, y]).astype(kind))
            zero = np.zeros(m, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ints(deal.view(np.int64), did[s_doc] ^ rk[s_doc], np.int64), ints(1 + many, zero, np.int32), ints(k[one].view(np.int64), zero, np.int64), ints(ctx[one].view(np.int64), zero, np.int64),
                    ints(np.minimum(times, 2), zero, np.int32), ints(did[doc[one]], did[s_doc], np.int64), ints(rk[doc[one]], rk[s_doc], np.int64), ints(p[one], zero, np.int32), ints(lo[one], s_lo, np.int32), ints(hi[one], s_hi, np.int32),
                ],
                [x.split()[0] for x in ANCHOR.split(", ")],
            )

    return task


def _settle_task(length: int):
    """Rows sorted by (kind, k, ctx): spans pass; of each anchor string, contexts seen twice become spans; where it has several, or is heavy, each is a candidate."""
    names = [x.split()[0] for x in FOUND.split(", ")]

    def out(kind, k, settled, did, rk, p, lo, hi):
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(kind, len(did)).astype(np.int32)), pa.array(k), pa.array(settled), pa.array(did), pa.array(rk), pa.array(p), pa.array(lo), pa.array(hi)], names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None

        def settle(cols, last: bool):
            nonlocal held, before
            kind, k, ctx, cnt, did, rk, p, lo, hi = cols
            if not len(k):
                return
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (ctx[1:] != ctx[:-1])])
            first = np.flatnonzero(new)
            if not last:  # the last context may go on
                held = [x[first[-1] :] for x in cols]
                k_next, first = k[first[-1]], first[:-1]
                stop = len(k) - len(held[0])
            else:
                held, k_next, stop = None, None, len(k)
            if not len(first):
                return
            total = np.add.reduceat(cnt[:stop].astype(np.int64), first)
            run = k[first]
            after = np.append(run[1:] == run[:-1], k_next is not None and run[-1] == k_next)
            prior = np.append(before is not None and run[0] == before, run[1:] == run[:-1])
            many, before = after | prior | (kind[first] == 2), run[-1]
            size = np.diff(np.append(first, stop))
            span = np.flatnonzero(np.repeat(total > 1, size) & (cnt[:stop] == 1))
            if len(span):
                yield out(0, np.zeros(len(span), np.int64), np.ones(len(span), bool), did[span], rk[span], p[span], lo[span], (hi[span] + length).astype(np.int32))
            cand = first[many]
            if len(cand):
                yield out(kind[cand], k[cand], total[many] > 1, did[cand], rk[cand], p[cand], lo[cand], hi[cand])

        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy()  # noqa: B023, E731
            kind = col("kind")
            cols = [kind, *(col(c) for c in ("k", "ctx", "cnt", "did", "rk", "p", "jlo", "jhi"))]
            if (at := kind == 0).any():
                _, k, _, _, did, rk, p, lo, hi = (x[at] for x in cols)
                yield out(0, k, np.ones(len(k), bool), did, rk, p, lo, hi)
                cols = [x[~at] for x in cols]
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
            yield from settle(cols, False)
        if held is not None:
            yield from settle(held, True)

    return task


def column_rounds(group: np.ndarray, symbols: np.ndarray, length: int) -> np.ndarray:
    """repeats[i, c]: context i shares the `length` symbols from column c on with another context of its group.

    symbols: (n, columns) int16, one context a row, -1 where it has no symbol. group: ascending numbers.
    One round a column, from the last to the first; `order` sorts the suffixes that start there, `common` is each one's common prefix
    with the one before it.
    """
    n, width = symbols.shape
    order, common = np.arange(n), np.zeros(n, np.int32)
    repeats = np.zeros((n, max(0, width - length + 1)), bool)
    for c in range(width - 1, -1, -1):
        symbol = symbols[order, c]
        turn = np.argsort(group[order].astype(np.int64) * 512 + symbol, kind="stable")
        moved = order[turn]
        same = np.zeros(n, bool)
        if n > 1:
            s, g = symbol[turn], group[moved]
            same[1:] = (s[1:] == s[:-1]) & (g[1:] == g[:-1]) & (s[1:] >= 0)
        grown = np.zeros(n, np.int32)
        at = np.flatnonzero(same)
        if len(at):
            lo, hi = turn[at - 1] + 1, turn[at] + 1
            if (hi - lo == 1).all():
                grown[at] = common[lo] + 1
            else:
                edges = np.empty(2 * len(at), np.int64)
                edges[0::2], edges[1::2] = lo, hi
                grown[at] = np.minimum.reduceat(np.append(common, 0), edges)[0::2] + 1
        order, common = moved, grown
        if c < repeats.shape[1]:
            long = common >= length
            long[:-1] |= long[1:].copy()
            repeats[order[long], c] = True
    return repeats


def _column_task(length: int):
    before, width = length - K, 2 * length - K

    def spans(rows: pa.Table) -> pa.RecordBatch:
        k, did, rk, p, lo, settled = (rows[c].to_numpy() for c in ("k", "did", "rk", "p", "jlo", "settled"))
        ctx = rows["bytes"].to_pylist()
        symbols = np.full((len(k), width), -1, np.int16)
        for i, (text, a) in enumerate(zip(ctx, (before - (p - lo)).tolist(), strict=True)):
            symbols[i, a : a + len(text)] = np.frombuffer(text, np.uint8)
        found = column_rounds(np.cumsum(np.concatenate([[0], k[1:] != k[:-1]])), symbols, length)
        found[settled] = False
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        i, first = np.nonzero(edge == 1)
        _, last = np.nonzero(edge == -1)
        at = p[i] - before
        return pa.RecordBatch.from_arrays([pa.array(did[i]), pa.array(rk[i]), pa.array((at + first).astype(np.int32)), pa.array((at + last - 1 + length).astype(np.int32))], ["did", "rk", "jlo", "jhi"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                held.append(batch.slice(at, ROWS))
                n += held[-1].num_rows
                if n >= ROWS:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    k = rows["k"].to_numpy()
                    cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
                    if cut:
                        yield spans(rows.slice(0, cut))
                        held, n = rows.slice(cut).to_batches(), rows.num_rows - cut
        if n:
            yield spans(pa.Table.from_batches(held))

    return task


def _context_task(length: int, hot: bool):
    """Documents with their candidates: each one's context; of hot ones, the hash of each window."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                text = memoryview(unpack.decompress(row.column(2)[0].as_py()))
                c = row.column(3)[0].values
                k, p, lo, hi = (c.field(x).to_numpy() for x in ("k", "p", "jlo", "jhi"))
                settled = c.field("settled").to_numpy(zero_copy_only=False)
                did, rk = row.column(0)[0].as_py(), row.column(1)[0].as_py()
                if hot:
                    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)])
                    h = [xxhash.xxh3_128_digest(text[j : j + length]) for j in starts.tolist()]
                    twice = np.repeat(settled, hi - lo + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(np.where(twice, 2, 1)), pa.array(np.full(len(h), did)), pa.array(np.full(len(h), rk)), pa.array(starts.astype(np.int32))], ["h", "n", "did", "rk", "jlo"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k), pa.array(settled), pa.array(np.full(len(k), did)), pa.array(np.full(len(k), rk)), pa.array(p), pa.array(lo), pa.array([bytes(text[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())],
                        ["k", "settled", "did", "rk", "p", "jlo", "bytes"],
                    )

    return task


def _pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack.compress(x or b"") for x in batch.column(2).cast(pa.binary()).to_pylist()], pa.binary()), batch.column(3)], ["did", "rk", "z", "doc_id"])


def _kept_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        n, spans, kept = [], [], []
        for z, found in zip(batch.column(1), batch.column(2), strict=True):
            text = unpack.decompress(z.as_py())
            found = found.as_py() or []
            _, lo, hi = _merged(np.zeros(len(found), np.int64), np.array([x["jlo"] for x in found], np.int64), np.array([x["jhi"] for x in found], np.int64))
            cuts = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(text)]
            n.append(len(text))
            spans.append([{"start": a, "end": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
            kept.append(b"".join(text[a:b] for a, b in zip(cuts[0::2], cuts[1::2], strict=True)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int = LENGTH, hot: int = HOT, heavy: int = HEAVY, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>>, kept binary): maximal runs of repeated bytes and what remains without them."""
    ship(spark)
    scratch = Scratch(spark, "repeats")
    least = F.lit(-(2**63)).cast("long")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("did"), F.xxhash64("doc_id", "text").alias("rk"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    counts = scratch.save(keyed.select("text").mapInArrow(_heavy_task(length, heavy), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")), "counts")
    every = counts.filter("k is null").first()
    bar = max(heavy_rows, (every.n if every else 0) // MOST_HEAVY)  # so at most MOST_HEAVY strings reach it
    known = np.array(sorted(r.k % (1 << 64) for r in counts.filter(F.col("k").isNotNull() & (F.col("n") > bar)).select("k").collect()), np.uint64)
    rows = keyed.select("did", "rk", "text").mapInArrow(_anchor_task(length, spark.sparkContext.broadcast(known)), ANCHOR)
    rows = rows.repartition("ek").sortWithinPartitions("kind", "k", "ctx")
    found = scratch.save(rows.mapInArrow(_settle_task(length), FOUND), "found")
    cand = found.filter("kind = 1").select("k", "settled", "did", "rk", "p", "jlo", "jhi")
    many = scratch.save(cand.groupBy("k").count().filter(F.col("count") > hot).select("k"), "hot")
    n_hot, wide = many.count(), found.filter("kind = 2").select("k", "settled", "did", "rk", "p", "jlo", "jhi")
    packed = keyed.mapInArrow(_pack_task, "did long, rk long, z binary, doc_id long")

    def with_texts(c: DataFrame) -> DataFrame:
        lists = c.groupBy("did", "rk").agg(F.collect_list(F.struct("k", "settled", "p", "jlo", "jhi")).alias("c"))
        return packed.select("did", "rk", "z").join(lists, ["did", "rk"]).select("did", "rk", "z", "c")

    spans = found.filter("kind = 0").select("did", "rk", "jlo", "jhi")
    cool = cand
    if n_hot or len(known):
        side = F.broadcast(many) if n_hot <= 20_000 else many
        cool = cand.join(side, "k", "left_anti")
        windows = scratch.save(with_texts(cand.join(side, "k", "left_semi").union(wide)).mapInArrow(_context_task(length, True), "h binary, n long, did long, rk long, jlo int"), "windows")
        twice = windows.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
        spans = spans.union(windows.filter("n = 1").join(twice, "h").select("did", "rk", "jlo", (F.col("jlo") + length).alias("jhi")))
    contexts = with_texts(cool).mapInArrow(_context_task(length, False), "k long, settled boolean, did long, rk long, p int, jlo int, bytes binary")
    columns = contexts.repartition("k").sortWithinPartitions("k").mapInArrow(_column_task(length), "did long, rk long, jlo int, jhi int")
    lists = spans.union(columns).groupBy("did", "rk").agg(F.collect_set(F.struct("jlo", "jhi")).alias("spans"))
    return packed.join(lists, ["did", "rk"], "left").select("doc_id", "z", "spans").mapInArrow(_kept_task, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(spark, read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
