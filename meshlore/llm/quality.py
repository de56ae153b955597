"""Quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader updates.

Each word or run of signs is a token; its unigrams and bigrams fall into 2**18 slots with value count / sqrt(sum of count**2).
Training runs row by row over a bounded labelled sample (linear.MAX_TRAINING_ROWS); scoring is a sparse dot product.
Null and empty texts get the intercept's score; repeated rows are scored alike, equal texts (ties) too; a null id is never held out nor labelled;
no labels at all give score 0; an empty table gives an empty result; texts are read whole; extra columns stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Ftrl, WORD_OR_SIGN, WordIds, ngram_slots, read, sigmoid
from .linear import MAX_TRAINING_ROWS, fit, score, training_rows

BITS = 18
#: The slot that all bigrams of a word with itself share, beside their own.
REPEAT = 1


def slots(ids: WordIds, text: str) -> tuple[np.ndarray, np.ndarray]:
    words = WORD_OR_SIGN.findall(text)
    h = np.fromiter(map(ids.__getitem__, words), np.uint32, len(words))
    again = np.full(int((h[1:] == h[:-1]).sum()), REPEAT)
    at, n = np.unique(np.concatenate([ngram_slots(h, BITS), again]), return_counts=True)
    x = n.astype(np.float64)
    return at, x / max(1.0, np.sqrt(x @ x))


def train(texts: list[str], y: np.ndarray, epochs: int = 3, l1: float = 0.05, seed: int = 7) -> np.ndarray:
    model, ids, rng = Ftrl(1 << BITS, alpha=0.5, l1=l1, l2=0.01), WordIds(), np.random.default_rng(seed)
    rows = [(at.astype(np.int32), x.astype(np.float32)) for at, x in (slots(ids, t) for t in texts)]
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = np.append(rows[i][0], model.size), np.append(rows[i][1], 1.0)
            w = model.weights(at)
            model.update(at, (sigmoid(w @ x) - y[i]) * x, w)
    return model.weights()


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """docs with `score` (0..1, higher: label 1 likelier), learned from the given labels only."""
    return score(spark, docs, fit(spark, training_rows(docs, labels, "quality", max_rows), train), slots, "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").filter(~held_out)
    return quality_scores(spark, docs, labels).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
