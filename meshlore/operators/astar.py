"""A* paths between node pairs: one best-first step of all pairs a round, each round one join with the edges.

A pair's state is one row: its open nodes in order, and what is known of the nodes it has met (cost, parent, similarity along the path).
At most `passed` nodes are popped and `cap` neighbours taken of each, so a row holds passed * cap nodes at most, whatever the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlore.operators.graph import UNREACHABLE
from meshlore.operators.retrieval import dot

#: The names of the heuristics.
METRICS = ("zero", "ip", "weight_with_short_path", "avg_weighted_with_short_path")


def apart(a: str, b: str, va: str, vb: str) -> Column:
    """One less the product of two nodes' vectors; 0 for a node and itself."""
    return F.when(F.col(a) == F.col(b), 0.0).otherwise(1 - dot(va, vb))


def heuristic(metric: str, near: Column, chain: Column, hop: Column) -> Column:
    """near: distance to the goal by vectors; chain: sum of such distances along the path to the node; hop: edges to the goal."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    far = F.coalesce(hop, F.lit(UNREACHABLE))
    return {"zero": F.lit(0.0), "ip": near, "weight_with_short_path": near * far, "avg_weighted_with_short_path": (chain + near) * far}[metric]


def closest(candidates: DataFrame, group: list[str], score: str, cap: int) -> DataFrame:
    """Of each group the `cap` candidates (b) of the largest score, ties by b; a cap under 0 keeps all."""
    if cap < 0:
        return candidates
    return candidates.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), "b"))).filter(F.col("_r") <= cap).drop("_r")


def astar(edges: DataFrame, pairs: DataFrame, save, vectors: DataFrame | None = None, metric: str = "ip", hops: DataFrame | None = None, depth: int = 5, passed: int = 25, cap: int = 25, towards: str = "goal") -> DataFrame:
    """(start, goal, path): the path from goal, or else from the last node that was looked at, back to start.

    edges (a, b): both ways, without repeats. pairs (start, goal): repeats count once. vectors (id, embedding): of length 1, for the metric and for the choice of `cap`
    neighbours by similarity to `towards`; a node without one counts as zeros. hops (seed, b, hop): distances from each goal, for metrics that weigh by
    them. A node is looked at when it has the least cost + heuristic among the open ones, ties by id; `passed` of them at most, and no node that
    is `depth` edges away is expanded.
    """
    if vectors is None and (metric != "zero" or cap >= 0):
        raise ValueError("the metric and the cap need vectors")
    if vectors is None:
        vectors = pairs.select(F.col("start").alias("id"), F.array().cast("array<double>").alias("embedding")).limit(0)
    v = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    none = F.array().cast("array<double>")
    vector = lambda df, of, into: df.join(v.select(F.col("id").alias(of), F.col("embedding").alias(into)), of, "left").withColumn(into, F.coalesce(into, none))
    known = vector(vector(edges.select("a", "b").distinct(), "a", "va"), "b", "vb").withColumn("step", apart("a", "b", "va", "vb")).drop("va")
    known = save(known, "edges")
    state = pairs.select("start", "goal").distinct()
    state = vector(vector(state, "start", "vs"), "goal", "vg")
    state = state.select(
        "start", "goal", "vs", "vg", F.array(F.struct(F.lit(0.0).alias("f"), F.col("start").alias("node"))).alias("open"), F.create_map("start", F.struct(F.lit(0).alias("g"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("chain"))).alias("met"),
        F.lit(0).alias("popped"), F.col("start").alias("last"), F.lit(None).cast("string").alias("node"), F.lit(False).alias("done"),
    )
    for k in range(passed):
        top = F.get("open", 0)["node"]
        over = F.col("done") | (F.size("open") == 0) | (F.col("popped") + 1 >= passed)
        shallow = F.element_at("met", top)["g"] < depth
        looked = ~over & shallow
        popped = state.withColumns({
            "node": F.when(looked & (top != F.col("goal")), top), "last": F.when(looked, top).otherwise(F.col("last")), "popped": F.col("popped") + 1,
            "done": over | (looked & (top == F.col("goal"))), "open": F.when(F.size("open") > 0, F.slice("open", F.lit(2), F.greatest(F.size("open") - 1, F.lit(0)))).otherwise(F.col("open")),
        })
        popped = save(popped, f"popped{k}")
        live = popped.filter("node is not null").select("start", "goal", "vs", "vg", "node", "met")
        if popped.filter(~F.col("done")).isEmpty():
            state = popped
            break
        near = live.join(known, live.node == known.a).withColumn("score", dot("vb", "vs" if towards == "start" else "vg"))
        near = closest(near, ["start", "goal"], "score", cap)
        here, old = F.element_at("met", F.col("node")), F.element_at("met", F.col("b"))
        near = near.withColumns({"g": here["g"] + 1, "chain": here["chain"] + F.col("step"), "to_goal": apart("b", "goal", "vb", "vg"), "hop": F.lit(None).cast("int")})
        near = near.filter(~F.col("b").eqNullSafe(here["parent"]) & (old.isNull() | (F.col("g") < old["g"])))
        if hops is not None and "short_path" in metric:
            near = near.drop("hop").join(hops.select(F.col("seed").alias("goal"), "b", "hop"), ["goal", "b"], "left")
        near = near.withColumn("f", F.col("g") + heuristic(metric, F.col("to_goal"), F.col("chain"), F.col("hop")))
        got = near.groupBy("start", "goal").agg(F.collect_list(F.struct("f", F.col("b").alias("node"), "g", F.col("node").alias("parent"), "chain")).alias("new"))
        new = F.map_from_entries(F.transform("new", lambda x: F.struct(x.node, F.struct(x.g, x.parent, x.chain))))
        state = popped.join(got, ["start", "goal"], "left").withColumn("new", F.coalesce("new", F.array().cast(got.schema["new"].dataType)))
        state = state.withColumns({
            "met": F.map_concat(F.map_filter("met", lambda n, _: ~F.exists("new", lambda x: x.node == n)), new), "open": F.array_sort(F.concat("open", F.transform("new", lambda x: F.struct(x.f, x.node)))),
        }).drop("new")
    end = F.when(F.map_contains_key("met", F.col("goal")), F.col("goal")).otherwise(F.col("last"))
    back = lambda path, _: F.when(F.element_at("met", F.element_at(path, -1))["parent"].isNotNull(), F.array_append(path, F.element_at("met", F.element_at(path, -1))["parent"])).otherwise(path)
    return state.select("start", "goal", F.aggregate(F.sequence(F.lit(0), F.lit(depth + 1)), F.array(end), back).alias("path"))


def path_edges(paths: DataFrame) -> DataFrame:
    """(start, goal, a, b) of neighbours on each path."""
    steps = F.zip_with(F.slice("path", F.lit(1), F.size("path") - 1), F.slice("path", F.lit(2), F.size("path") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return paths.filter(F.size("path") > 1).select("start", "goal", F.explode(steps).alias("e")).select("start", "goal", "e.a", "e.b").distinct()


def seed_pairs(seeds: DataFrame) -> DataFrame:
    """seeds (query_id, seed): (query_id, start, goal) of each unordered pair of a query's seeds, the smaller first; with one seed none. A query has few seeds."""
    each = seeds.groupBy("query_id").agg(F.array_sort(F.collect_set("seed")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("start"), b.alias("goal")))))
    return each.select("query_id", F.explode(pairs).alias("p")).select("query_id", "p.start", "p.goal")
