"""Text classifiers that are linear in hashed word n-grams: fitting on a bounded labelled sample, scoring all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordIds, ship, sigmoid

#: Most labelled rows that a model is fitted on; with more, a uniform sample by a hash of the id is taken.
MAX_TRAINING_ROWS = 10_000
TEXTS_A_SLICE = 256


def training_rows(docs: DataFrame, labels: DataFrame, target: str, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(doc_id, text, y): one row per labelled document; null labels and ids drop out, of several labels the largest counts.

    The sample is drawn on the labels alone, so that at most about max_rows ids are broadcast, whatever the input's size.
    """
    one = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    there = one.count()
    if there > max_rows:
        one = one.filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_003)) < int(1_000_003 * max_rows / there))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.col("doc_id").isNotNull())
    return texts.join(F.broadcast(one), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def fit(spark: SparkSession, rows: DataFrame, train: Callable[[list[str], np.ndarray], np.ndarray]) -> np.ndarray:
    """Weights (float32) from one task over the bounded sample; rows are put in order of id, so a repeat gives the same model."""
    ship(spark)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        order = np.argsort(table["doc_id"].to_numpy())
        table = table.take(pa.array(order))
        w = train(table["text"].to_pylist(), table["y"].to_numpy())
        yield pa.RecordBatch.from_pydict({"w": pa.array([w.astype("<f4").tobytes()], pa.binary())})

    got = rows.coalesce(1).mapInArrow(task, "w binary").collect()
    return np.frombuffer(bytes(got[0].w), "<f4") if got else np.zeros(0, np.float32)


def score(spark: SparkSession, docs: DataFrame, weights: np.ndarray, slots: Callable[[WordIds, str], tuple[np.ndarray, np.ndarray | None]], name: str) -> DataFrame:
    """docs with a column `name` in 0..1; a null or empty text gets the score of the intercept alone, and with no model 0."""
    ship(spark)
    model = spark.sparkContext.broadcast(weights)
    schema = docs.drop(name).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, ids = model.value.astype(np.float64), WordIds()
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_A_SLICE):
                part = batch.slice(start, TEXTS_A_SLICE)
                out = np.zeros(part.num_rows)
                if len(w):
                    for i, text in enumerate(part.column(part.schema.get_field_index("text")).to_pylist()):
                        at, x = slots(ids, text or "")
                        out[i] = (w[at].sum() if x is None else w[at] @ x) + w[-1]
                    out = sigmoid(out)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.float64())], [*part.schema.names, name])

    return docs.drop(name).mapInArrow(task, _with(schema, name))


def _with(schema, name):
    from pyspark.sql.types import DoubleType, StructType

    return StructType([*schema.fields]).add(name, DoubleType())
