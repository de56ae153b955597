"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Each of TABLES random projections keeps the vectors of an index cell in sorted order. A query stands in the middle of its own window in
every array; virtual rehashing widens all windows together by a factor, and a vector's count is the number of windows it lies in. Vectors
whose count reaches NEED of the tables are verified by their exact inner product. Inner products become distances by one more component,
sqrt(M**2 - |x|**2) with M the largest norm in the cell, which queries have as 0. A vector at distance d lies in a window of half width w with
probability 2 Phi(w / d) - 1, so widening ends when w reaches REACH times the distance of the k-th best verified vector: those that are nearer
have then passed NEED with the probability that RECALL_Z stands for, whatever the data. How much is verified is up to the data.

The index is cut into cells around pivots (k-means on at most SAMPLE vectors; every vector is indexed). A query first searches the cell with the
largest product of its pivot; then only cells whose bound q c + |q| r reaches the k-th best product found there. Cells of over CELL_VALUES numbers
are split, and so are the queries that meet at one, so no task holds more than a cell and a batch of queries.

Vectors that are null, zero, or hold null or non-finite components take no part; only vectors of equal length meet. Equal vectors are one
class with its smallest members (one more than k, so none is lost), and equal queries are searched once: a vector that a third of the rows
hold costs no more than any other. A repeated row (same id and vector) counts once. Ties go to the smaller id; an empty table gives an empty
result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read, ship

TABLES, REACH, RECALL_Z, HALF, WIDEN = 96, 1.04, 1.6, 0.5, 1.3
#: Share of windows that a vector just as far as the window is scaled for lies in (2 Phi(REACH) - 1), and the share that is asked for.
AT_REACH = 0.7017
NEED = AT_REACH - RECALL_Z * (AT_REACH * (1 - AT_REACH) / TABLES) ** 0.5
CELL_VALUES, QUERY_PART, QUERIES_A_TIME, SAMPLE, MOST_PIVOTS = 1 << 20, 2048, 128, 20_000, 256
FOUND = "class long, bound double, found array<struct<vec_id:long,score:double>>"


class Cell:
    """Sorted projections of the rows of x."""

    def __init__(self, x: np.ndarray, seed: int = 5):
        norm2 = (x * x).sum(1)
        self.x, self.largest = x, float(np.sqrt(norm2.max()))
        lifted = np.concatenate([x, np.sqrt(np.maximum(0.0, self.largest**2 - norm2))[:, None]], 1) / self.largest
        self.lines = np.random.default_rng(seed).standard_normal((lifted.shape[1], TABLES))
        at = lifted @ self.lines
        order = np.argsort(at, axis=0, kind="stable")
        self.order, self.values = order.T.copy(), np.take_along_axis(at, order, 0).T.copy()

    def search(self, asked: np.ndarray, k: int, bounds: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query: the best k verified rows and their inner products in double precision, best first, ties by row; those under its bound may lack."""
        n, size, many = len(self.x), np.sqrt((asked * asked).sum(1)), len(asked)
        mine, scale = (asked / size[:, None]) @ self.lines[:-1], self.largest * size
        need, count, verified = int(np.ceil(NEED * TABLES)), np.zeros((many, n), np.int16), np.zeros((many, n), bool)
        bounds = np.full(many, -np.inf) if bounds is None else bounds
        rows, scores = [np.zeros(0, np.int64)] * many, [np.zeros(0)] * many
        far = lambda i, at: REACH * float(np.sqrt(max(0.0, 2 - 2 * at / scale[i])))
        half = np.array([far(i, x) if x > -np.inf else HALF for i, x in enumerate(bounds.tolist())])
        lo = np.stack([np.searchsorted(v, m) for v, m in zip(self.values, mine.T, strict=True)], 1)
        hi, active, out = lo.copy(), np.arange(many), [None] * many
        while len(active):
            a, b = (np.stack([np.searchsorted(v, m + w) for v, m in zip(self.values, mine[active].T, strict=True)], 1) for w in (-half[active], half[active]))
            a, b = np.minimum(a, lo[active]), np.maximum(b, hi[active])
            done = (b - a == n).all(1)
            for j, i in enumerate(active.tolist()):
                seen = [o[x:y] for o, x, y in zip(self.order, a[j].tolist(), lo[i].tolist(), strict=True)] + [o[x:y] for o, x, y in zip(self.order, hi[i].tolist(), b[j].tolist(), strict=True)]
                count[i] += np.bincount(np.concatenate(seen), minlength=n).astype(np.int16)
                new = np.flatnonzero((count[i] >= need) & ~verified[i])
                verified[i, new] = True
                rows[i], scores[i] = np.concatenate([rows[i], new]), np.concatenate([scores[i], (self.x[new] * asked[i]).sum(1)])
                at = max(bounds[i], float(-np.partition(-scores[i], k - 1)[k - 1]) if len(scores[i]) >= k else -np.inf)
                enough = far(i, at) if at > -np.inf else np.inf
                if done[j] or half[i] >= enough * (1 - 1e-9):
                    done[j], best = True, np.lexsort((rows[i], -scores[i]))[:k]
                    out[i] = rows[i][best], scores[i][best]
                half[i] = min(half[i] * WIDEN, enough)
            lo[active], hi[active] = a, b
            active = active[~done]
        return out


def _pivots(sample: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """n centres at most, by a few rounds of k-means from evenly spaced rows."""
    centres = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)].copy()
    for _ in range(rounds if n > 1 else 1):
        home = np.argmin((centres * centres).sum(1) - 2 * sample @ centres.T, axis=1)
        for c in range(len(centres)):
            if (home == c).any():
                centres[c] = sample[home == c].mean(0)
    return centres


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _search_task(k: int):
    """Rows by (cell, part, kind, class): a cell's vectors with their members, then queries with their bounds."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vectors, members, cell = None, [], [], None
        for batch in batches:
            out = []
            key = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            starts = [i for i in range(len(key)) if i == 0 or key[i] != key[i - 1]] + [len(key)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                part, v = batch.slice(a, b - a), _vectors(batch.column(4).slice(a, b - a))
                if key[a][:2] != now:
                    now, vectors, members, cell = key[a][:2], [], [], None
                if key[a][2] == 0:
                    vectors.append(v)
                    members += part.column(5).to_pylist()
                    continue
                if not vectors and cell is None:
                    continue
                if cell is None:
                    cell, vectors = Cell(np.concatenate(vectors)), []
                names, bounds = part.column(3).to_pylist(), np.array([-np.inf if x is None else x for x in part.column(6).to_pylist()])
                for at in range(0, len(names), QUERIES_A_TIME):
                    until = at + QUERIES_A_TIME
                    for name, (rows, scores) in zip(names[at:until], cell.search(v[at:until], k, bounds[at:until]), strict=True):
                        found = sorted((-s, m) for i, s in zip(rows.tolist(), scores.tolist(), strict=True) for m in members[i])[:k]
                        out.append((name, -found[-1][0] if len(found) == k else None, [{"vec_id": m, "score": -s} for s, m in found]))
            if out:
                cols = list(zip(*out, strict=True))
                kind = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], kind)], ["class", "bound", "found"])

    return task


def nearest(spark: SparkSession, vectors: DataFrame, queries, k: int = 20, cell_values: int = CELL_VALUES) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of `vectors` (vec_id, embedding) where the column `queries` holds."""
    ship(spark)
    scratch, most = Scratch(spark, "ann"), k + 1
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    good = good.filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).filter(~F.exists("v", bad) & F.exists("v", lambda c: c != 0)).withColumn("v", F.transform("v", lambda c: c + F.lit(0.0)))
    same = ["dim", "h", "g"]  # a vector's length and 96 bits of hash
    rows = scratch.save(good.groupBy("vec_id", "v").agg(F.max("asks").alias("asks")).withColumns({"dim": F.size("v"), "h": F.xxhash64("v"), "g": F.hash("v")}), "rows")
    rank = F.row_number().over(Window.partitionBy(*same).orderBy("vec_id"))
    members = rows.select(*same, "vec_id").withColumn("r", rank).filter(F.col("r") <= most).groupBy(*same).agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    classes = rows.groupBy(*same).agg(F.first("v").alias("v"), F.max("asks").alias("asks")).join(members, same).withColumn("class", F.monotonically_increasing_id())
    classes = scratch.save(classes, "classes")
    # pivots of each length, from a bounded sample; lengths that it lacks have one cell around zero
    sizes = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(MOST_PIVOTS).collect()}
    total, sample = sum(sizes.values()), {}
    some = classes if total <= SAMPLE else classes.filter(F.pmod(F.xxhash64("h", F.lit(3)), F.lit(1_000_003)) < int(1_000_003 * SAMPLE / total))
    for r in some.select("dim", "v").limit(SAMPLE + SAMPLE // 10).collect():
        sample.setdefault(r.dim, []).append(r.v)
    pivots = {d: _pivots(np.array(sorted(sample[d])), min(MOST_PIVOTS, -(-n * d // cell_values))) for d, n in sizes.items() if d in sample}
    around = spark.sparkContext.broadcast(pivots)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, far, dims = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows), batch.column(1).to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                v = _vectors(batch.column(2).take(pa.array(at)))
                c = around.value.get(d, np.zeros((1, d)))
                near[at] = np.argmin((c * c).sum(1) - 2 * v @ c.T, axis=1)
                far[at] = np.sqrt(((v - c[near[at]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near), pa.array(far)], ["class", "pivot", "far"])

    homes = scratch.save(classes.select("class", "dim", "v").mapInArrow(home, "class long, pivot int, far double"), "homes")
    index = scratch.save(classes.select("class", "dim", "v", "asks", "members").join(homes, "class"), "index")
    stats = index.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # a row a cell: at most MOST_PIVOTS for each length
    cells = {}
    for r in sorted(stats):
        cells.setdefault(r.dim, []).append((r.pivot, r.radius, max(1, -(-r.n * r.dim // cell_values))))
    known = spark.sparkContext.broadcast(cells)

    def route(first: bool):
        """Queries (class, dim, v, bound, went) -> (class, v, bound, dim, pivot, sub) of the cells to search."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                took, pivot, sub = [], [], []
                for i, (d, v, bound) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                    q, mine = np.array(v), known.value[d]
                    c = around.value.get(d, np.zeros((1, d)))[[p for p, _, _ in mine]]
                    products = c @ q
                    best = int(np.argmax(products))
                    limit = products + np.sqrt(q @ q) * np.array([r for _, r, _ in mine]) * (1 + 1e-9) + 1e-9
                    go = [best] if first else [j for j in range(len(mine)) if j != best and (bound is None or limit[j] >= bound)]
                    for j in go:
                        for s in range(mine[j][2]):
                            took.append(i)
                            pivot.append(mine[j][0])
                            sub.append(s)
                part = batch.take(pa.array(took, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), part.column(1), pa.array(pivot, pa.int32()), pa.array(sub, pa.int32())], ["class", "v", "bound", "dim", "pivot", "sub"])

        return task

    split = spark.createDataFrame([(d, p, s) for d, mine in cells.items() for p, _, s in mine], "dim int, pivot int, subs int")
    parted = index.join(F.broadcast(split), ["dim", "pivot"]).withColumn("sub", F.pmod(F.xxhash64("class", F.lit(1)), F.col("subs")).cast("int"))

    def searched(asks: DataFrame, first: bool, name: str) -> DataFrame:
        routed = scratch.save(asks.select("class", "dim", "v", "bound").mapInArrow(route(first), "class long, v array<double>, bound double, dim int, pivot int, sub int"), f"routed-{name}")
        at = ["dim", "pivot", "sub"]
        parts = scratch.save(routed.groupBy(*at).agg(F.ceil(F.count("*") / QUERY_PART).cast("int").alias("parts")), f"parts-{name}")
        cell = F.concat_ws("/", *at).alias("cell")
        sides = parted.join(F.broadcast(parts), at).select(cell, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "class", "v", "members", F.lit(None).cast("double").alias("bound"))
        asked = routed.join(F.broadcast(parts), at).select(cell, F.pmod(F.xxhash64("class", F.lit(2)), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "class", "v", F.lit(None).cast("array<long>").alias("members"), "bound")
        both = sides.union(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind", "class")
        return scratch.save(both.mapInArrow(_search_task(most), FOUND), f"found-{name}")

    asks = index.filter("asks").select("class", "dim", "v", F.lit(None).cast("double").alias("bound"))
    one = searched(asks, True, "home")
    # a home of several parts gives several bounds: the largest is one that the whole has
    two = searched(asks.drop("bound").join(one.groupBy("class").agg(F.max("bound").alias("bound")), "class"), False, "others")
    flat = one.union(two).select("class", F.explode("found").alias("f")).select("class", "f.*")
    first = F.row_number().over(Window.partitionBy("class").orderBy(F.col("score").desc(), "vec_id"))
    best = flat.withColumn("r", first).filter(F.col("r") <= most).groupBy("class").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    mine = rows.filter("asks").select(F.col("vec_id").alias("query_id"), *same).join(classes.select("class", *same), same).join(best, "class")
    mine = mine.select("query_id", F.slice(F.filter("best", lambda b: b.vec_id != F.col("query_id")), 1, k).alias("best")).select("query_id", F.posexplode("best").alias("at", "b"))
    return mine.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
