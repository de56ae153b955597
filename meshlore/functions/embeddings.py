"""Embeddings of texts: a hashing embedder inside the JVM, and batched calls of a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

DIM = 16
#: What stands before a text that asks, and before one that is asked for.
PREFIXES = {"query": "query: ", "passage": "passage: "}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}_#]+"), lambda w: w != "")


def hashed(text: Column) -> Column:
    """DIM numbers of length 1: the sum over the words of the bytes of their md5, each scaled to -1..1; zeros without words."""
    at = lambda w, i: F.conv(F.substr(F.md5(w), 2 * i + 1, F.lit(2)), 16, 10).cast("double")
    raw = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.aggregate(words(text), F.lit(0.0), lambda s, w: s + (at(w, i) - 127.5) / 127.5))
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.array(raw), lambda v: F.when(size(v) > 0, F.transform(v, lambda x: x / size(v))).otherwise(v))[0]


def encode(rows: DataFrame, text: str, kind: str, model: Callable[[list[str]], list[list[float]]], into: str = "embedding", batch: int = 8) -> DataFrame:
    """rows with `into`: the model's vectors of the prefixed texts, scaled to length 1, in batches; a null text has a null vector."""
    prefix = PREFIXES[kind]

    def work(frames: Iterator) -> Iterator:
        for f in frames:
            out: list = [None] * len(f)
            there = [i for i, t in enumerate(f[text].tolist()) if t is not None]
            for at in range(0, len(there), batch):
                part = there[at : at + batch]
                for i, v in zip(part, model([prefix + f[text].iloc[i] for i in part]), strict=True):
                    size = sum(x * x for x in v) ** 0.5 or 1.0
                    out[i] = [float(x) / size for x in v]
            yield f.assign(**{into: out})

    return rows.drop(into).mapInPandas(work, StructType([*rows.drop(into).schema.fields, StructField(into, ArrayType(DoubleType()))]))
