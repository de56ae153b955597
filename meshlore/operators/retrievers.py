"""Retrieval of triplets for batches of questions: indexes, rankings, traversals, mixture, filter.

questions: (query_id, text, q), q the text's vector. found lists: (query_id, t_id, r_type, r_id), one of each relation. Indexes are tables: vectors (type, id, text, embedding, t_id)
with type 'triplet' for relations (id is the relation's, t_id a triplet of it), and the texts of the same rows for BM25.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlore.operators import astar, graph, retrieval
from meshlore.operators.retrieval import dot

#: Rankers of the naive retriever and their weights, what each fetches, texts that a filter keeps and their types.
ENSEMBLE, FETCH, MOST, KINDS = {"dense": 0.7, "bm25": 0.3}, 50, 25, ("hyper", "simple")
#: Ranking strategies by name.
STRATEGIES = ("single_step", "multi_step", "ensemble_fusion")


def checked(strategy: str, config: dict) -> dict:
    """The configuration of a strategy, or ValueError: steps and weights name known indexes, counts are positive, thresholds numbers or None, weights sum to 1."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    steps = config.get("steps") or []
    if not steps or (strategy == "single_step" and len(steps) != 1):
        raise ValueError("one step is needed" if strategy == "single_step" else "steps are needed")
    for step in steps:
        if step.get("index") not in ENSEMBLE:
            raise ValueError(f"index must be one of {tuple(ENSEMBLE)}")
        if not isinstance(step.get("fetch", 10), int) or step.get("fetch", 10) < 1:
            raise ValueError("fetch must be a positive number")
        if not isinstance(step.get("threshold"), (int, float, type(None))):
            raise ValueError("threshold must be a number or None")
    if strategy == "ensemble_fusion" and abs(sum(s.get("weight", 1 / len(steps)) for s in steps) - 1) > 1e-5:
        raise ValueError("weights must sum to 1")
    return config


def index_hits(items: DataFrame, questions: DataFrame, index: str, k: int, subset: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank) of items (id, text, embedding) by one index."""
    if index == "dense":
        return retrieval.dense_topk(items.select("id", "embedding"), questions.select("query_id", "q"), k, subset)
    return retrieval.bm25(items.select("id", "text"), questions.select("query_id", "text"), k, subset, scale=True)


def ranked_by(items: DataFrame, questions: DataFrame, strategy: str, config: dict, k: int, subset: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the first k by a strategy over steps of {index, fetch, threshold, weight}."""
    steps = checked(strategy, config)["steps"]
    hits = lambda step, within: retrieval.single_step(index_hits(items, questions, step["index"], step.get("fetch", 10), within), step.get("threshold"), step.get("fetch", 10))
    if strategy == "ensemble_fusion":
        return retrieval.fused([hits(s, subset) for s in steps], [s.get("weight", 1 / len(steps)) for s in steps], k)
    out = hits(steps[0], subset)
    for step in steps[1:]:
        out = hits(step, out.select("query_id", "id"))
    return retrieval.ranked(out.drop("rank"), k)


def ensemble(fetch: int = FETCH, threshold: float | None = None) -> dict:
    return {"steps": [{"index": i, "fetch": fetch, "threshold": threshold, "weight": w} for i, w in ENSEMBLE.items()]}


def _triplet_items(vectors: DataFrame) -> DataFrame:
    return vectors.filter("type = 'triplet'").select("id", "text", "embedding")


def of_relations(t: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (query_id, id: relations) with a triplet of each: the smallest t_id."""
    one = t.groupBy("r_type", "r_id").agg(F.min("t_id").alias("t_id"))
    return hits.select("query_id", F.col("id").alias("r_id")).distinct().join(one, "r_id").select("query_id", "t_id", "r_type", "r_id")


def once(found: DataFrame, first: str | None = None) -> DataFrame:
    """One triplet of each relation of a query: of the largest `first` where given (a later retriever wins), then the smallest t_id."""
    order = [F.desc(first)] if first else []
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "r_type", "r_id").orderBy(*order, "t_id"))).filter("_r = 1").select("query_id", "t_id", "r_type", "r_id")


def naive(t: DataFrame, vectors: DataFrame, questions: DataFrame, k: int = MOST, strategy: str = "ensemble_fusion", config: dict | None = None) -> DataFrame:
    """The triplets of the first k relations by a ranking of the triplet index."""
    return of_relations(t, ranked_by(_triplet_items(vectors), questions, strategy, config or ensemble(), k))


def _walked(t: DataFrame, seeds: DataFrame, walk: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """seeds (query_id, seed), walk over distinct seeds -> (seed, t_id)."""
    got = walk(seeds.select("seed").distinct())
    return once(seeds.select("query_id", "seed").distinct().join(got, "seed").select("query_id", "t_id").distinct().join(t.select("t_id", "r_type", "r_id"), "t_id"))


def breadth_first(t: DataFrame, seeds: DataFrame, save, depth: int = 3, width: int = 10, passed: int = 50) -> DataFrame:
    return _walked(t, seeds, lambda s: graph.bfs(t, s, depth, width, save, passed))


def paths_between(t: DataFrame, vectors: DataFrame, seeds: DataFrame, save, metric: str = "ip", depth: int = 5, passed: int = 25, cap: int = 25) -> DataFrame:
    """Triplets on the A* paths between each pair of a query's seeds; a query of one seed has none."""
    pairs = save(astar.seed_pairs(seeds), "pairs")
    edges = graph.undirected(t).select("a", "b").distinct()
    nodes = vectors.filter("type <> 'triplet'").select(F.concat_ws(":", "type", "id").alias("id"), "embedding")
    hops = graph.hops(t, pairs.select(F.col("goal").alias("seed")).distinct(), depth, save) if "short_path" in metric else None
    paths = astar.astar(edges, pairs.select("start", "goal"), save, nodes, metric, hops, depth, passed, cap)
    steps = save(astar.path_edges(paths), "steps")
    found = pairs.join(steps, ["start", "goal"]).select("query_id", "a", "b").distinct().join(graph.undirected(t).select("a", "b", "t_id", "r_type", "r_id"), ["a", "b"])
    return once(found.select("query_id", "t_id", "r_type", "r_id").distinct())


def similarity(vectors: DataFrame, questions: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Adds s, the product of a relation's vector and its question's, to rows (seed 'query_id|node', r_id, ...); 1 at most."""
    v = vectors.filter("type = 'triplet'").select(F.col("id").alias("r_id"), "embedding")
    asked = questions.select(F.col("query_id").cast("string").alias("_q"), "q")
    return lambda ext: ext.withColumn("_q", F.split("seed", "\\|")[0]).join(asked, "_q").join(v, "r_id").withColumn("s", F.least(dot("embedding", "q"), F.lit(1.0))).drop("_q", "q", "embedding")


def beams(t: DataFrame, vectors: DataFrame, questions: DataFrame, seeds: DataFrame, save, depth: int = 3, paths: int = 10, alpha: float = 0.75, threshold: float = 0.5, mode: str = "mixed") -> DataFrame:
    """Triplets on the beam search paths of each question from its seeds; paths of a seed don't share nodes or edges."""
    starts = seeds.select(F.concat_ws("|", F.col("query_id").cast("string"), "seed").alias("seed"), F.col("seed").alias("start")).distinct()
    got = graph.beam(t, starts, similarity(vectors, questions), depth, paths, alpha, save, threshold, False, False, mode)
    kind = questions.schema["query_id"].dataType
    found = got.select(F.split("seed", "\\|")[0].cast(kind).alias("query_id"), F.explode("t_ids").alias("t_id")).distinct()
    return once(found.join(t.select("t_id", "r_type", "r_id"), "t_id"))


def mixture(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both lists; a relation that both have is the second's."""
    return once(first.withColumn("from", F.lit(1)).unionByName(second.withColumn("from", F.lit(2))), "from")


def filtered(found: DataFrame, vectors: DataFrame, questions: DataFrame, k: int = MOST, kinds: tuple[str, ...] = KINDS, strategy: str = "ensemble_fusion", config: dict | None = None) -> DataFrame:
    """Of each query the relations of these kinds; where these are over k, the first k by the ranking of just them."""
    kept = once(found).filter(F.col("r_type").isin(*kinds)).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    few, many = kept.filter(F.col("n") <= k).drop("n"), kept.filter(F.col("n") > k).drop("n")
    subset = many.select("query_id", F.col("r_id").alias("id"))
    asked = questions.join(subset.select("query_id").distinct(), "query_id", "left_semi")
    best = ranked_by(_triplet_items(vectors), asked, strategy, config or ensemble(), k, subset)
    return few.unionByName(many.join(best.select("query_id", F.col("id").alias("r_id")), ["query_id", "r_id"], "left_semi").select(*few.columns))


def retrieve(questions: DataFrame, traversed: DataFrame, apply_filter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, status, n, t_ids): a traversal's triplets, filtered where a filter is given; zero_retrieved_triplets where the traversal found none."""
    got = (apply_filter(traversed) if apply_filter else traversed).groupBy("query_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("t_id")).alias("t_ids"))
    any_ = traversed.select("query_id", F.lit(True).alias("any")).distinct()
    out = questions.select("query_id").join(any_, "query_id", "left").join(got, "query_id", "left")
    return out.select("query_id", F.when(F.col("any"), "success").otherwise("zero_retrieved_triplets").alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("t_ids", F.array().cast("array<string>")).alias("t_ids"))


def validity(found: DataFrame, t: DataFrame, vectors: DataFrame) -> DataFrame:
    """(t_id, in_graph, in_vectors) of found (t_id, r_id): whether the graph and the vector index still have it."""
    have = found.select("t_id", "r_id").distinct().join(t.select("t_id", F.lit(True).alias("g")).distinct(), "t_id", "left")
    have = have.join(vectors.filter("type = 'triplet'").select(F.col("id").alias("r_id"), F.lit(True).alias("v")).distinct(), "r_id", "left")
    return have.select("t_id", F.coalesce("g", F.lit(False)).alias("in_graph"), F.coalesce("v", F.lit(False)).alias("in_vectors"))


def explore(t: DataFrame, vectors: DataFrame, questions: DataFrame, seeds: DataFrame, save, depth: int = 2, per_node: int = 5, nodes: int = 3, total: int = 25) -> DataFrame:
    """(query_id, id, score, rank): relations around each question's seeds (query_id, seed), the best `total` by similarity to it.

    From every node the relations to all neighbours but the one it was reached from: the `per_node` best are kept, and the neighbours behind the `nodes` best are next, down to
    depth; under 0, all. Nodes reached alike are looked at once.
    """
    v = vectors.filter("type = 'triplet'").select(F.col("id").alias("r_id"), "embedding")
    edges = save(graph.undirected(t).select("a", "b", "r_id").distinct().join(v, "r_id"), "edges")
    asked = questions.select("query_id", "q")
    front, kept = save(seeds.select("query_id", F.col("seed").alias("a"), F.lit(None).cast("string").alias("prev")).distinct(), "front0"), []
    for k in range(1, depth + 1):
        step = front.join(edges, "a").filter(~F.col("b").eqNullSafe(F.col("prev"))).join(asked, "query_id").withColumn("score", dot("embedding", "q"))
        rel = step.groupBy("query_id", "a", "prev", "r_id").agg(F.max("score").alias("score"), F.max("b").alias("b"))
        rel = save(rel.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "a", "prev").orderBy(F.desc(F.round("score", 9)), "r_id"))), f"ranked{k}")
        kept.append(rel.filter(F.col("r") <= per_node) if per_node >= 0 else rel)
        front = save((rel.filter(F.col("r") <= nodes) if nodes >= 0 else rel).select("query_id", F.col("b").alias("a"), F.col("a").alias("prev")).distinct(), f"front{k}")
    every = kept[0]
    for x in kept[1:]:
        every = every.union(x)
    best = every.select("query_id", F.col("r_id").alias("id"), "score").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return retrieval.ranked(best, total, [F.desc(F.round("score", 9)), F.col("id")])
