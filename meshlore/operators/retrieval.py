"""Dense and lexical top-k, re-ranking and fusion over batches of queries.

Scored lists are (query_id, id, score); ties go to the smaller id everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from meshlore.sources.parquet import Workspace

K1, B = 1.5, 0.75
#: Queries that one task holds, and vectors that meet them there.
FEW_QUERIES, VECTOR_BLOCK = 2048, 1 << 18


def ranked(scored: DataFrame, k: int, by: list[Column] | None = None) -> DataFrame:
    order = by or [F.round("score", 9).desc(), F.col("id")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _best(vectors: np.ndarray, asked: np.ndarray, allowed: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, score) of each query's k largest products, to 9 digits; rows come in order of id, so the earlier wins a tie."""
    exact = vectors @ asked.T
    scores = np.round(exact, 9) if allowed is None else np.where(allowed, np.round(exact, 9), -np.inf)
    least = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k] if len(scores) > k else np.full(len(asked), -np.inf)
    q, row = np.nonzero((scores >= least).T & (scores > -np.inf).T)
    order = np.lexsort((row, -scores[row, q], q))
    q, row = q[order], row[order]
    first = np.searchsorted(q, np.arange(len(asked)))
    keep = np.arange(len(q)) - first[q] < k
    return row[keep], q[keep], exact[row[keep], q[keep]]


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, subset: DataFrame | None = None, same: str | None = None) -> DataFrame:
    """vectors (id, embedding), queries (query_id, q): inner-product top k as (query_id, id, score, rank).

    With subset (query_id, id) only of those ids; with `same`, a column of both sides, only where it is equal. Vectors of another length than
    the query's, and null ones, take no part. Up to FEW_QUERIES queries are broadcast as a matrix; more are dealt into blocks of as many, and each
    block of queries meets each block of vectors in a task. Every batch of vectors gives its k best of each query, so no pairs are shuffled.
    """
    if subset is not None:
        both = queries.join(subset, "query_id").join(vectors, "id").filter(F.size("q") == F.size("embedding"))
        return ranked(both.select("query_id", "id", dot("embedding", "q").alias("score")), k)
    spark = vectors.sparkSession
    group = F.lit(0) if same is None else F.col(same)
    v = vectors.filter("embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("embedding"), group.alias("same"))
    q = queries.filter("q is not null").select("query_id", F.col("q").cast("array<double>").alias("q"), group.alias("same"))
    schema = StructType([StructField("query_id", q.schema["query_id"].dataType), StructField("id", v.schema["id"].dataType), StructField("score", DoubleType())])
    kinds = to_arrow_schema(schema)
    if k < 1:
        return ranked(spark.createDataFrame([], schema), 1)

    def scored(rows: pa.RecordBatch, names: pa.Array, asked: list, groups: list) -> Iterator[pa.RecordBatch]:
        rows = rows.take(pc.sort_indices(rows.column(0)))
        sizes = np.diff(rows.column(1).offsets.to_numpy())
        flat, mine = rows.column(1).flatten().to_numpy(zero_copy_only=False), np.array(rows.column(2).to_pylist(), object)
        for size in {len(x) for x in asked} & set(sizes.tolist()):
            at, who = np.flatnonzero(sizes == size), [i for i, x in enumerate(asked) if len(x) == size]
            matrix = flat.reshape(-1, size) if (sizes == size).all() else flat[np.repeat(sizes == size, sizes)].reshape(-1, size)
            for part in range(0, len(who), 256):
                some = who[part : part + 256]
                allowed = None if same is None else mine[at][:, None] == np.array([groups[i] for i in some], object)[None]
                row, who_asks, score = _best(matrix, np.array([asked[i] for i in some]), allowed, k)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.array(some)[who_asks])), rows.column(0).take(pa.array(at[row])), pa.array(score)], schema=kinds)

    many = q.count()
    if many <= FEW_QUERIES:
        rows = q.collect()
        sent = spark.sparkContext.broadcast(([r.query_id for r in rows], [r.q for r in rows], [r.same for r in rows]))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked, groups = sent.value
            for batch in batches:
                if batch.num_rows and asked:
                    yield from scored(batch, pa.array(ids, kinds.field(0).type), asked, groups)

        return ranked(v.mapInArrow(task, schema), k)
    blocks, parts = -(-many // FEW_QUERIES), F.ceil(F.count("*") / VECTOR_BLOCK).cast("int")
    n_parts = max(1, v.agg(parts).first()[0])
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    none = lambda f: F.lit(None).cast(f.dataType)
    left = q.select(F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), deal("query_id", blocks).alias("block"), F.lit(0).alias("kind"), none(schema["id"]).alias("id"), F.col("q").alias("embedding"), "same", "query_id")
    right = v.select(deal("id", n_parts).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "embedding", "same", none(schema["query_id"]).alias("query_id"))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, asked, groups = None, [], [], []
        for batch in batches:
            part, of, kind = (batch.column(i).to_numpy() for i in range(3))
            cuts = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (of[1:] != of[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(part)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if (part[a], of[a]) != now:
                    now, names, asked, groups = (part[a], of[a]), [], [], []
                rows = batch.slice(a, b - a)
                if kind[a] == 0:
                    names += rows.column(6).to_pylist()
                    asked += rows.column(4).to_pylist()
                    groups += rows.column(5).to_pylist()
                elif asked:
                    yield from scored(pa.RecordBatch.from_arrays(rows.columns[3:6], ["id", "embedding", "same"]), pa.array(names, kinds.field(0).type), asked, groups)

    dealt = left.union(right).repartition("part", "block").sortWithinPartitions("part", "block", "kind")
    return ranked(dealt.mapInArrow(block, schema), k)


def multi_collection(lists: list[DataFrame], k: int) -> DataFrame:
    return ranked(reduce(DataFrame.union, [x.select("query_id", "id", "score") for x in lists]), k)


def words(text: str) -> Column:
    """Lower-case words; null texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) of queries (query_id, text)."""
    return queries.select("query_id", F.explode(F.array_distinct(words("text"))).alias("term"))


def postings(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(term, id, tf, len) of docs (id, text): a word's number in a text and the text's number of words; with `only` (term), of these terms."""
    rows = docs.select("id", words("text").alias("w")).select("id", F.size("w").alias("len"), F.explode("w").alias("term"))
    if only is not None:
        rows = rows.join(only, "term", "left_semi")
    return rows.groupBy("id", "len", "term").agg(F.count("*").alias("tf")).select("term", "id", "tf", "len")


def bm25_scores(index: DataFrame, total: DataFrame, asked: DataFrame, k: int, subset: DataFrame | None = None, scale: bool = False, k1: float = K1, b: float = B) -> DataFrame:
    """index: postings; total: one row (n, all_len); asked (query_id, term). With subset (query_id, id) only those ids; scale squashes scores to 0..1.

    Document frequencies come from all of the index.
    """
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / (F.col("all_len") / F.col("n"))))
    weighed = index.join(df, "term").join(F.broadcast(total)).select("term", "id", weight.alias("w"))
    scored = weighed.join(asked, "term").groupBy("query_id", "id").agg(F.sum("w").alias("score"))
    if subset is not None:
        scored = scored.join(subset, ["query_id", "id"], "left_semi")
    if scale:
        scored = scored.withColumn("score", 1 / (1 + F.exp(-F.col("score") / 8)))
    return ranked(scored, k, [F.round("score", 9).desc(), F.col("id")])


def bm25(docs: DataFrame, queries: DataFrame, k: int, subset: DataFrame | None = None, scale: bool = False) -> DataFrame:
    """docs (id, text), queries (query_id, text): sum over shared terms of ln(1 + (n - df + 0.5) / (df + 0.5)) tf (k1 + 1) / (tf + k1 (1 - b + b len / mean)).

    Words of no query are dropped before they are grouped; lengths are read off the texts.
    """
    asked = asked_terms(queries)
    total = docs.agg(F.count("*").alias("n"), F.sum(F.size(words("text"))).alias("all_len"))
    index = Workspace(docs.sparkSession, "bm25").save(postings(docs, asked.select("term").distinct()), "postings")  # read twice
    return bm25_scores(index, total, asked, k, subset, scale)


def backfill(hits: DataFrame, subset: DataFrame, k: int, score: float = 0.5) -> DataFrame:
    """Lists of under k hits get unseen ids of their subset (query_id, id), in order, with a fixed score."""
    rest = subset.join(hits, ["query_id", "id"], "left_anti").select("query_id", "id", F.lit(score).alias("score"), F.lit(1).alias("late"))
    every = hits.select("query_id", "id", "score", F.lit(0).alias("late")).union(rest)
    return ranked(every, k, [F.col("late"), F.when(F.col("late") == 0, -F.col("score")).otherwise(0.0), F.col("id")]).drop("late")


def single_step(hits: DataFrame, threshold: float | None, k: int) -> DataFrame:
    return ranked(hits if threshold is None else hits.filter(F.col("score") >= threshold), k).select("query_id", "id", "score", "rank")


def fused(lists: list[DataFrame], weights: list[float], k: int, c: int = 60) -> DataFrame:
    """Weighted reciprocal ranks: sum of w / (rank + c); ties by the first list, then the rank there."""
    if abs(sum(weights) - 1) > 1e-5:
        raise ValueError("weights must sum to 1")
    every = reduce(DataFrame.union, [x.select("query_id", "id", "rank", F.lit(i).alias("list"), F.lit(float(w)).alias("w")) for i, (x, w) in enumerate(zip(lists, weights, strict=True))])
    score = every.groupBy("query_id", "id").agg(F.sum(F.col("w") / (F.col("rank") + c)).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return ranked(score, k, [F.round("score", 12).desc(), F.col("first"), F.col("id")]).drop("first")


def ir_metrics(run: DataFrame, total: DataFrame, cuts: list[int]) -> DataFrame:
    """(metric, k, value): mean precision, recall, F1 and average precision at each cut over the queries of total (query_id, all: relevant items); run (query_id, rank, hit)."""
    hits = run.filter("hit").select("query_id", "rank").withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    at = hits.groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in cuts], *[F.sum(F.when(F.col("rank") <= k, F.col("nth") / F.col("rank"))).alias(f"ap{k}") for k in cuts])
    q, out = total.join(at, "query_id", "left").fillna(0), []
    for k in cuts:
        h, p, r = F.col(f"h{k}"), F.col(f"h{k}") / F.lit(k), F.col(f"h{k}") / F.col("all")
        f1 = F.when(h > 0, 2 * p * r / (p + r)).otherwise(0.0)
        out += [F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.round(F.avg(x), 5).alias("value")) for m, x in (("precision", p), ("recall", r), ("f1", f1), ("map", F.col(f"ap{k}") / F.col("all")))]
    return q.agg(F.array(*out).alias("a")).select(F.explode("a").alias("s")).select("s.*")
