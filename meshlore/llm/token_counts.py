"""Token counts by offset-mapped attribution.

The fields of a row are joined with line ends and encoded once, so merges across field and section ends happen as they do in training
data. A section is a line of a field, with the line end after it. Every token's span of bytes is joined to the sections' intervals
(both are sorted, so by binary search) and the token goes to one section by RULE:

    first     the section with the token's first byte (default)
    last      the section with its last byte
    majority  the section with most of its bytes; ties: the earlier

Sections start at characters, so bytes and characters give the same answer; offsets are returned in code points. The sections' counts
sum to the tokens of the whole row. Null fields are empty: an empty field has one empty section. Repeated rows are counted each; an
empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship
from .tokens import byte_letters, default_path, encoder

RULES = ("first", "last", "majority")
OUT = "doc_id long, field string, section int, start long, end long, n_tokens long, n_crossing long"


def token_bytes(path: str) -> np.ndarray:
    """Bytes of each vocabulary entry."""
    out = np.zeros(encoder(path).size, np.int64)
    for w, i in encoder(path).tokenizer.get_vocab().items():
        out[i] = len(w.encode()) if w in encoder(path).added else len(w)
    return out


def attribute(ends: np.ndarray, starts: np.ndarray, total: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section; ends: of the tokens, starts: of the sections, ascending (an empty section owns nothing)."""
    first = np.searchsorted(starts, np.concatenate([[0], ends[:-1]]), side="right") - 1
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    crossing = first != last
    home = last if rule == "last" else first.copy()
    if rule == "majority":
        until = np.append(starts[1:], total)
        for t in np.flatnonzero(crossing).tolist():
            a, b = (ends[t - 1] if t else 0), ends[t]
            at = np.arange(first[t], last[t] + 1)
            home[t] = at[np.argmax(np.minimum(b, until[at]) - np.maximum(a, starts[at]))]
    return np.bincount(home, minlength=len(starts)), np.bincount(home[crossing], minlength=len(starts))


def section_tokens(spark: SparkSession, docs: DataFrame, fields: list[str], rule: str = "first", path: str | None = None) -> DataFrame:
    """OUT rows: of each row, field and section its place in the joined text and its tokens; n_crossing of these reach over its ends."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(spark)
    path = path or default_path()
    assert byte_letters()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = encoder(path), token_bytes(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cols = {c: [] for c in ("doc_id", "field", "section", "start", "end", "n", "x")}
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    values = [x or "" for x in row[1:]]
                    text = "\n".join(values)
                    ids = np.frombuffer(enc.encode(text), enc.kind)
                    ends = np.cumsum(size[ids])
                    lines = [(f, i, line) for f, v in zip(fields, values, strict=True) for i, line in enumerate(v.split("\n"))]
                    chars = np.cumsum([0] + [len(x[2]) + 1 for x in lines])
                    plain = text.isascii()
                    starts = chars[:-1] if plain else np.cumsum([0] + [len(x[2].encode()) + 1 for x in lines[:-1]])
                    n, x = attribute(ends, starts, int(ends[-1]) if len(ends) else 0, rule)
                    cols["doc_id"] += [row[0]] * len(lines)
                    cols["field"] += [f for f, _, _ in lines]
                    cols["section"] += [i for _, i, _ in lines]
                    cols["start"] += chars[:-1].tolist()
                    cols["end"] += [*chars[1:-1].tolist(), len(text)]
                    cols["n"] += n.tolist()
                    cols["x"] += x.tolist()
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols.values(), kinds, strict=True)], [x.split()[0] for x in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)]).mapInArrow(task, OUT)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(spark, read(spark, sf_dir, "documents"), ["source", "text"])
