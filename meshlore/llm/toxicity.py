"""Toxicity: a logistic classifier on hashed words, regularised by counterfactual pairs.

Words (lower case, of letters and digits), their bigrams and their stems (first 4 and 5 letters, for inflected insults) count once
per text. In every labelled text that names a group, the
identity terms are swapped for another group's; the squared change of the score enters the loss with weight PAIR_WEIGHT, so that
naming a group does not move the score. A sample of the other labelled texts gets a neutral mention put in, with the same penalty.
Null and empty texts get the intercept's score; repeated rows are scored alike, equal texts (ties) too; a null id is never held out nor labelled;
no labels at all give score 0; an empty table gives an empty result; texts are read whole; extra columns stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Ftrl, WORD, WordIds, ngram_slots, read, sigmoid
from .linear import MAX_TRAINING_ROWS, fit, score, training_rows

BITS, PAIR_WEIGHT, MENTION_SHARE, THRESHOLD = 18, 0.5, 0.1, 0.3
#: Groups of terms that may stand for one another.
IDENTITY = [
    "women men girls boys", "woman man girl boy", "female male", "muslims christians jews hindus buddhists atheists", "muslim christian jewish hindu buddhist atheist",
    "gay straight lesbian bisexual transgender", "black white asian latino african european", "immigrants refugees foreigners locals", "femmes hommes", "musulmans chrétiens juifs",
    "frauen männer", "muslime christen juden", "mujeres hombres", "musulmanes cristianos judíos",
]
SWAP = {w: [x for x in g.split() if x != w] for g in IDENTITY for w in g.split()}


def distinct_slots(ids: WordIds, words: list[str]) -> np.ndarray:
    known = set(words)
    stems = {"<" + w[:n] for w in known for n in (4, 5) if len(w) >= n}
    return np.unique(
        np.concatenate([ngram_slots(np.fromiter(map(ids.__getitem__, words), np.uint32, len(words)), BITS), ngram_slots(np.fromiter(map(ids.__getitem__, stems), np.uint32, len(stems)), BITS, 1)])
    )


def slots(ids: WordIds, text: str) -> tuple[np.ndarray, None]:
    return distinct_slots(ids, WORD.findall(text.lower())), None


def counterfactual(words: list[str], rng: np.random.Generator) -> list[str] | None:
    """The words with each identity term swapped; in a share of texts that have none, with a mention put in; else None."""
    hits = [i for i, w in enumerate(words) if w in SWAP]
    if hits:
        out = list(words)
        for i in hits:
            out[i] = SWAP[words[i]][rng.integers(len(SWAP[words[i]]))]
        return out
    if words and rng.random() < MENTION_SHARE:
        at, terms = int(rng.integers(len(words) + 1)), sorted(SWAP)
        return [*words[:at], terms[rng.integers(len(terms))], *words[at:]]
    return None


def train(texts: list[str], y: np.ndarray, epochs: int = 3, l1: float = 3.0, seed: int = 11) -> np.ndarray:
    model, ids, rng = Ftrl(1 << BITS, alpha=0.3, l1=l1, l2=0.1), WordIds(), np.random.default_rng(seed)
    rows = []
    for text in texts:
        words = WORD.findall(text.lower())
        other = counterfactual(words, rng)
        mine = distinct_slots(ids, words)
        other = None if other is None else distinct_slots(ids, other)
        # one vector of each pair's difference: +1 only here, -1 only in the counterfactual
        rows.append((mine.astype(np.int32), None if other is None else (np.setdiff1d(mine, other), np.setdiff1d(other, mine))))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            mine, pair = rows[i]
            at = np.append(mine, model.size)
            if pair is not None:
                at = np.concatenate([at, pair[1]])
            w = model.weights(at)
            n = len(mine)
            grad = np.zeros(len(at))
            grad[: n + 1] = sigmoid(w[: n + 1].sum()) - y[i]
            if pair is not None and (len(pair[0]) or len(pair[1])):
                only = np.isin(mine, pair[0], assume_unique=True)
                change = w[:n][only].sum() - w[n + 1 :].sum()
                grad[:n][only] += 2 * PAIR_WEIGHT * change
                grad[n + 1 :] -= 2 * PAIR_WEIGHT * change
            model.update(at, grad, w)
    return model.weights()


def toxicity_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, into: str = "score") -> DataFrame:
    """docs with `into` (0..1, higher: label 1 likelier), learned from the given labels only."""
    return score(spark, docs, fit(spark, training_rows(docs, labels, "toxic", max_rows), train), slots, into)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").filter(~held_out)
    return toxicity_scores(spark, docs, labels).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
