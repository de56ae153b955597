"""Line dedup by winnowing over line hashes: later repeats of runs of lines go.

A line ends at a line end or at a sentence end (sign and blank), so a passage that stands inside a paragraph has lines of its own. The
windows of a text are the shortest runs with MIN_WORDS words from each line on, and up to each line. A window's fingerprint is the least
line hash in it; equal windows have equal fingerprints at equal places, so any run that is repeated shows there. Positions meet by
fingerprint, and a match extends from it both ways: every window around it is known by 96 bits of its lines in order and by their number (and meets only those of its fingerprint), and
a window that occurred earlier (smaller doc_id, then place) is a repeat. All windows of a repeated run of MIN_WORDS words or more cover it from
end to end, so exactly the lines of such runs go, and the first occurrence stays whole.

Only fingerprints are shuffled, with the hashes of the windows they stand for; every map batch sends each such list once, its later
owners being repeats already. Fingerprints whose lists weigh over HOT_BYTES (lines that very many texts have among different neighbours) are
not met in one task: their windows are dealt by their own hashes, the first owner of each is found by a pre-aggregated minimum, and its join
back may be split. Blank lines start and end no window and go with a run that covers them. Null texts are empty; rows with equal
doc_id and text count as one document; a null doc_id comes first in order; texts under MIN_WORDS words stay; an empty table gives an
empty result; other columns are kept, of any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, read, ship

MIN_WORDS, DOCS_A_TIME, HOT_BYTES, MANY_HOT = 30, 512, 64 << 10, 100_000
#: Multipliers of the two hashes of a run.
TIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
CUT = re.compile(r"(?<=[.!?] )|(?<=\n)")
ROWS = "kind int, k long, did long, rk long, at int, to int, windows binary"
RUNS = "did long, rk long, at int, to int"
#: A window in a list: its two hashes, number of lines less one, offset from the list's first line.
WINDOW = np.dtype([("h0", "<u8"), ("h1", "<u4"), ("size", "<u4"), ("offset", "<u4")])


def lines_of(text: str) -> list[str]:
    """The text in lines, each with the blank or line end after it."""
    if "\x01" in text:
        return CUT.split(text)
    return text.replace(". ", ". \x01").replace("! ", "! \x01").replace("? ", "? \x01").replace("\n", "\n\x01").split("\x01")


def _least(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of h[first..last], by tables of the least of 1, 2, 4, ... neighbours."""
    out, level, n = np.empty(len(first), np.uint64), 0, last - first + 1
    of = np.frexp(n.astype(np.float64))[1] - 1
    while len(first):
        at = np.flatnonzero(of == level)
        out[at] = np.minimum(h[first[at]], h[last[at] - (1 << level) + 1])
        if level >= of.max():
            break
        h = np.minimum(h[: -(1 << level)], h[1 << level :])
        level += 1
    return out


def windows(texts: list[list[str]], min_words: int) -> tuple[np.ndarray, ...]:
    """(doc, first, last, fingerprint, hash, hash) of every window, lines counted within their document, by first and last line."""
    flat = [x.strip() for lines in texts for x in lines]
    h = np.fromiter((xxhash.xxh64_intdigest(x) for x in flat), np.uint64, len(flat))
    words = np.fromiter((x.count(" ") + 1 if x else 0 for x in flat), np.int64, len(flat))
    size = np.array([len(x) for x in texts], np.int64)
    doc, base = np.repeat(np.arange(len(texts)), size), np.concatenate([[0], np.cumsum(size)])
    total = np.concatenate([[0], np.cumsum(words)])
    there = np.flatnonzero(words > 0)
    ahead = np.searchsorted(total, total[there] + min_words) - 1
    behind = np.searchsorted(total, total[there + 1] - min_words, side="right") - 1
    until = np.full(len(flat), -1)
    until[there] = np.where(ahead < base[doc[there] + 1], ahead, -1)
    more = behind >= base[doc[there]]
    more[more] = until[behind[more]] != there[more]  # most windows are the shortest from both ends
    first, last = np.concatenate([np.flatnonzero(until >= 0), behind[more]]), np.concatenate([until[until >= 0], there[more]])
    if more.any():
        turn = np.lexsort((last, first))
        first, last = first[turn], last[turn]
    hashes = []
    for times, turned in zip(TIMES, (h, (h << np.uint64(23)) | (h >> np.uint64(41))), strict=True):
        with np.errstate(over="ignore"):
            one = np.ones(1, np.uint64)  # of the arrays' own type, lest they turn into floats
            power = np.concatenate([one, np.cumprod(np.full(len(h), times, np.uint64), dtype=np.uint64)])
            inverse = np.concatenate([one, np.cumprod(np.full(len(h), pow(times, -1, 1 << 64), np.uint64), dtype=np.uint64)])
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(turned * power[:-1])])
            whole = (run[last + 1] - run[first]) * inverse[first]
        hashes.append(whole ^ (whole >> np.uint64(31)))
    hashes[1] >>= np.uint64(32)
    shift = base[doc[first]]
    return doc[first], first - shift, last - shift, _least(h, first, last), *hashes


def _firsts(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first, later): of rows with equal keys, that of the least order and those that differ from it in order; keys[0] is a hash."""
    turn = np.argsort(keys[0], kind="stable")
    many = np.zeros(len(turn), bool)
    many[1:] = keys[0][turn][1:] == keys[0][turn][:-1]
    many[:-1] |= many[1:]
    alone, turn = turn[~many], turn[many]
    turn = turn[np.lexsort([x[turn] for x in [*order[::-1], *keys[::-1]]])]
    same, equal = np.zeros(len(turn), bool), np.zeros(len(turn), bool)
    if len(turn):
        same[1:], equal[1:] = True, True
        for x in keys:
            same[1:] &= x[turn][1:] == x[turn][:-1]
        lead = turn[np.flatnonzero(~same)][np.cumsum(~same) - 1]
        equal = np.all([x[turn] == x[lead] for x in order], axis=0)
    return np.concatenate([alone, turn[~same]]), turn[same & ~equal]


def _runs(did: np.ndarray, rk: np.ndarray, at: np.ndarray, to: np.ndarray) -> list[np.ndarray]:
    """Overlapping or touching runs of a document as one."""
    if not len(did):
        return [did, rk, at, to]
    turn = np.lexsort((at, rk, did))
    did, rk, at, to = did[turn], rk[turn], at[turn], to[turn]
    doc = np.cumsum(np.concatenate([[0], (did[1:] != did[:-1]) | (rk[1:] != rk[:-1])])) << 32
    reach = np.maximum.accumulate(to + doc)
    new = np.flatnonzero(np.concatenate([[True], (at + doc)[1:] > reach[:-1]]))
    return [did[new], rk[new], at[new], (reach - doc)[np.append(new[1:], len(at)) - 1]]


def _run_columns(did: np.ndarray, rk: np.ndarray, at: np.ndarray, to: np.ndarray) -> list[pa.Array]:
    return [pa.array(did, pa.int64()), pa.array(rk, pa.int64()), pa.array(at.astype(np.int32)), pa.array(to.astype(np.int32))]


def _fingerprint_task(min_words: int):
    """Documents (did, rk, text) -> ROWS: kind 1, lists of windows of one fingerprint, the first of equal ones; kind 0, runs known to be later."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, packed, known = [], [], []
            for start in range(0, batch.num_rows, DOCS_A_TIME):
                part = batch.slice(start, DOCS_A_TIME)
                did, rk = part.column(0).to_numpy(), part.column(1).to_numpy()
                doc, first, last, k, h0, h1 = windows([lines_of(x or "") for x in part.column(2).to_pylist()], min_words)
                if not len(doc):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (doc[1:] != doc[:-1])]))
                size = np.diff(np.append(new, len(doc)))
                group, at = np.repeat(np.arange(len(new)), size), np.repeat(first[new], size)
                # windows that repeat within one list: all but the first are later
                _, again = _firsts([h0 ^ (group.astype(np.uint64) * np.uint64(TIMES[0])), h0, h1, last - first, group], [first])
                known.append((did[doc[again]], rk[doc[again]], first[again], last[again] + 1))
                rows = np.empty(len(doc), WINDOW)
                rows["h0"], rows["h1"], rows["size"], rows["offset"] = h0, h1, last - first, first - at
                mixed = ((h0 ^ rows["offset"]) + rows["size"]) * np.uint64(TIMES[1])
                sums = [np.add.reduceat(x, new) for x in (mixed, (mixed ^ (mixed >> np.uint64(32))) * h1)]
                lists.append((sums[0], sums[1], k[new], did[doc[new]], rk[doc[new]], first[new], np.maximum.reduceat(last, new) + 1, size))
                packed.append(rows)
            if not lists:
                continue
            sum0, sum1, k, did, rk, at, to, size = (np.concatenate(x) for x in zip(*lists, strict=True))
            ends = np.concatenate([[0], np.cumsum(size)]) * WINDOW.itemsize
            every = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.concatenate(packed))])
            one, later = _firsts([sum0, sum1, k], [did, rk, at])
            gone = _runs(*(np.concatenate([*x, y[later]]) for x, y in zip(zip(*known, strict=True), (did, rk, at, to), strict=True)))
            n, m = len(one), len(gone[0])
            both = [np.concatenate([x[one], y]) for x, y in zip((did, rk, at, to), gone, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([1, 0], [n, m]).astype(np.int32)), pa.array(np.concatenate([k[one].view(np.int64), np.zeros(m, np.int64)])), *_run_columns(*both), pa.concat_arrays([every.take(pa.array(one)), pa.nulls(m, pa.binary())])],
                [x.split()[0] for x in ROWS.split(", ")],
            )

    return task


def _unpacked(lists: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Windows of all lists (..., did, rk, at, windows), and their (did, rk, first line)."""
    packed = lists["windows"].combine_chunks()
    packed = packed if isinstance(packed, pa.Array) else packed.chunk(0)
    ends = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, packed.offset * 4)
    rows = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(WINDOW)
    size = np.diff(ends) // WINDOW.itemsize
    did, rk, at = (np.repeat(lists[c].to_numpy(), size) for c in ("did", "rk", "at"))
    return rows, [did, rk, at + rows["offset"].astype(np.int64)]


def _met(lists: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    rows, places = _unpacked(lists)
    return rows, places, *_firsts([rows[c] for c in ("h0", "h1", "size")], places)


def _later_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists (k, did, rk, at, windows) sorted by k: of each fingerprint, windows that an earlier row had."""

    def later(lists: pa.Table) -> Iterator[pa.RecordBatch]:
        k = lists["k"].to_numpy()
        many = np.zeros(len(k), bool)
        many[1:] = k[1:] == k[:-1]
        many[:-1] |= many[1:]
        if many.any():  # most fingerprints have one list
            rows, (did, rk, first), _, gone = _met(lists.filter(pa.array(many)))
            if len(gone):
                merged = _runs(did[gone], rk[gone], first[gone], first[gone] + rows["size"][gone].astype(np.int64) + 1)
                yield pa.RecordBatch.from_arrays(_run_columns(*merged), [x.split()[0] for x in RUNS.split(", ")])

    held = None
    for batch in batches:
        lists = pa.Table.from_batches([batch])
        lists = lists if held is None else pa.concat_tables([held, lists])
        k = lists["k"].to_numpy()
        cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
        yield from later(lists.slice(0, cut))
        held = lists.slice(cut)
    if held is not None:
        yield from later(held)


def _windows_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists (k, did, rk, at, windows) -> (w, did, rk, at, to): the first of a batch's equal windows, with w null runs known to be later."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows, places, one, gone = _met(pa.Table.from_batches([batch]))
        to = places[2] + rows["size"].astype(np.int64) + 1
        merged = _runs(*(x[gone] for x in (*places, to)))
        names = np.zeros((len(one), 16), np.uint8)
        names[:] = rows[one].view(np.uint8).reshape(-1, WINDOW.itemsize)[:, :16]
        w = pa.Array.from_buffers(pa.binary(16), len(one), [None, pa.py_buffer(names.tobytes())]).cast(pa.binary())
        both = [np.concatenate([x[one], y]) for x, y in zip((*places, to), merged, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([w, pa.nulls(len(merged[0]), pa.binary())]), *_run_columns(*both)], ["w", *(x.split()[0] for x in RUNS.split(", "))])


def _cut_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., text, runs) -> (..., text, n_lines, removed array<struct<at, to>>)."""
    for batch in batches:
        texts, n, removed = [], [], []
        for text, runs in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            lines, gone, end = lines_of(text or ""), [], 0
            for r in sorted(runs or [], key=lambda r: (r["at"], r["to"])):
                if gone and r["at"] <= gone[-1]["to"]:
                    gone[-1]["to"] = max(gone[-1]["to"], r["to"])
                else:
                    gone.append(dict(r))
            kept = []
            for r in gone:
                kept += lines[end : r["at"]]
                end = r["to"]
            texts.append("".join(kept + lines[end:]) if gone else text)
            n.append(len(lines))
            removed.append(gone)
        kind = pa.list_(pa.struct([("at", pa.int32()), ("to", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(removed, kind)], [*batch.schema.names[:-2], "text", "line_dedup_n", "line_dedup_removed"])


def later_runs(spark: SparkSession, docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(did, rk, at, to) of windows that occurred earlier; docs: (did, rk, text). A window's rows may repeat."""
    prints = scratch.save(docs.select("did", "rk", "text").mapInArrow(_fingerprint_task(min_words), ROWS), "prints")
    known, lists = prints.filter("kind = 0").select("did", "rk", "at", "to"), prints.filter("kind = 1").select("k", "did", "rk", "at", "windows")
    hot = scratch.save(lists.groupBy("k").agg(F.sum(F.octet_length("windows")).alias("n"), F.count("*").alias("rows")).filter((F.col("n") > hot_bytes) & (F.col("rows") > 1)).select("k"), "hot")
    n_hot = hot.count()
    cool = lists
    if n_hot:
        side = F.broadcast(hot) if n_hot <= MANY_HOT else hot
        cool = lists.join(side, "k", "left_anti")
        every = scratch.save(lists.join(side, "k", "left_semi").mapInArrow(_windows_task, "w binary, " + RUNS), "windows")
        split = every.filter("w is not null")
        first = split.groupBy("w").agg(F.min(F.struct("did", "rk", "at")).alias("first"), F.max(F.struct("did", "rk", "at")).alias("final")).filter("first < final")
        known = known.union(every.filter("w is null").drop("w")).union(split.join(first.select("w", "first"), "w").filter(F.struct("did", "rk", "at") > F.col("first")).select("did", "rk", "at", "to"))
    return known.union(cool.repartition("k").sortWithinPartitions("k").mapInArrow(_later_task, RUNS))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """docs with `text` less its later repeats, line_dedup_n (lines before) and line_dedup_removed (runs of removed lines, end exclusive).

    Columns of the last two names are replaced.
    """
    ship(spark)
    docs = docs.drop("line_dedup_n", "line_dedup_removed")
    did, rk, runs, own_did, own_rk = fresh(docs, "did", "rk", "runs", "own_did", "own_rk")
    least = F.lit(-(2**63)).cast("long")
    keyed = docs.withColumns({own_did: F.coalesce(F.col("doc_id").cast("long"), least), own_rk: F.xxhash64("doc_id", "text")})
    later = later_runs(spark, keyed.select(F.col(own_did).alias("did"), F.col(own_rk).alias("rk"), "text"), Scratch(spark, "lines"), min_words, hot_bytes)
    each = later.groupBy("did", "rk").agg(F.collect_set(F.struct("at", "to")).alias("runs")).select(F.col("did").alias(did), F.col("rk").alias(rk), F.col("runs").alias(runs))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    joined = keyed.join(each, (F.col(own_did) == F.col(did)) & (F.col(own_rk) == F.col(rk)), "left").select(*others, "text", runs)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"), "text string, line_dedup_n int, line_dedup_removed array<struct<at:int,to:int>>"])
    return joined.mapInArrow(_cut_task, schema)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(spark, read(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("line_dedup_removed", F.lit(0), lambda s, r: s + r.to - r.at)
    return out.select("doc_id", F.col("line_dedup_n").alias("n_lines"), gone.alias("n_removed"), F.size("line_dedup_removed").alias("n_runs"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
