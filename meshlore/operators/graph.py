"""Typed graph: triplets and their endpoints as DataFrames.

triplets: t_id, s_type, s_id, s_name, r_type, r_id, r_name, e_type, e_id, e_name, stringified. All functions are plans without actions;
a frontier or id list is a DataFrame too, so look-ups of any number of ids are one join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlore.functions import ids

#: Relation type -> start and end types that it may join.
LEGAL = {"simple": [("object", "object")], "hyper": [("object", "hyper")], "episodic": [("object", "episodic"), ("hyper", "episodic")], "time": [("time", "episodic"), ("time", "hyper")]}


PROPS = "array<struct<k:string,v:string>>"


def triplets(rows: DataFrame) -> DataFrame:
    """From (s_type, s_name, r_type, r_name, e_type, e_name) and, where there are such, s_props, r_props, e_props (array<struct<k, v>>, in order); illegal endpoint types raise.

    A node's id is that of its text with time and properties, so one name with other properties is another node.
    """
    legal = reduce(lambda a, b: a | b, [(F.col("r_type") == r) & (F.col("s_type") == s) & (F.col("e_type") == e) for r, pairs in LEGAL.items() for s, e in pairs])
    rows = rows.withColumn("r_name", F.when(F.col("r_type") == "simple", F.col("r_name")).otherwise(F.col("r_type")))
    props = {x: F.coalesce(F.col(f"{x}_props"), F.array().cast(PROPS)) for x in "sre" if f"{x}_props" in rows.columns}
    shown = {x: F.concat(F.col(f"{x}_name"), ids.suffix(props[x])) if x in props else F.col(f"{x}_name") for x in "sre"}
    text = ids.triplet_text(F.col("r_type"), F.when(F.col("r_type") == "time", F.col("s_name")).otherwise(shown["s"]), shown["r"], shown["e"])
    for kinds, x in ((("simple",), "r"), (("hyper", "episodic"), "e")):
        if x in props:
            text = F.concat(F.when(F.col("r_type").isin(*kinds), ids.time_prefix(props[x])).otherwise(""), text)
    rows = rows.withColumns({"stringified": text, **{f"{x}_id": ids.create_id(ids.node_text(F.col(f"{x}_name"), props.get(x))) for x in "se"}}).withColumn("r_id", ids.create_id(F.col("stringified")))
    wrong = F.raise_error(F.lit("a relation of this type can't join these nodes"))  # in the id, since a filter could run before rows are dropped
    return rows.withColumn("t_id", F.when(legal, ids.triplet_id(*(F.col(c) for c in ("s_type", "s_id", "r_type", "r_id", "e_type", "e_id")))).otherwise(wrong.cast("string")))


def nodes(t: DataFrame) -> DataFrame:
    ends = t.select(F.col("s_type").alias("type"), F.col("s_id").alias("id"), F.col("s_name").alias("name")).union(t.select("e_type", "e_id", "e_name"))
    return ends.groupBy("type", "id").agg(F.min("name").alias("name"))


def undirected(t: DataFrame) -> DataFrame:
    """(a, b, ...) from each end; a loop once. Typed ids are 'type:id'."""
    s, e = F.concat_ws(":", "s_type", "s_id"), F.concat_ws(":", "e_type", "e_id")
    out = t.select(s.alias("a"), e.alias("b"), F.col("e_type").alias("b_type"), F.col("e_name").alias("b_name"), "r_type", "r_id", "t_id")
    back = t.select(e.alias("a"), s.alias("b"), F.col("s_type").alias("b_type"), F.col("s_name").alias("b_name"), "r_type", "r_id", "t_id").filter("a <> b")
    return out.union(back)


def create(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with new triplets: one of each t_id, those it has skipped."""
    return store.unionByName(new.dropDuplicates(["t_id"]).join(store.select("t_id"), "t_id", "left_anti").select(*store.columns))


def read_by_ids(t: DataFrame, wanted: DataFrame) -> DataFrame:
    return t.join(wanted.select("t_id").distinct(), "t_id", "left_semi")


def delete(t: DataFrame, gone: DataFrame) -> DataFrame:
    return t.join(gone.select("t_id").distinct(), "t_id", "left_anti")


def deletion_flags(t: DataFrame, gone: DataFrame) -> DataFrame:
    """(t_id, s_node, e_node, triplet): what a batch's removal leaves orphaned, by the state after it; relations count by r_id."""
    left, out = delete(t, gone), read_by_ids(t, gone)
    live = nodes(left).select("type", "id", F.lit(True).alias("live"))
    out = out.join(live.select(F.col("type").alias("s_type"), F.col("id").alias("s_id"), F.col("live").alias("s_live")), ["s_type", "s_id"], "left")
    out = out.join(live.select(F.col("type").alias("e_type"), F.col("id").alias("e_id"), F.col("live").alias("e_live")), ["e_type", "e_id"], "left")
    out = out.join(left.select("r_id").distinct().withColumn("r_live", F.lit(True)), "r_id", "left")
    return out.select("t_id", F.col("s_live").isNull().alias("s_node"), F.col("e_live").isNull().alias("e_node"), F.col("r_live").isNull().alias("triplet"))


def read_by_name(t: DataFrame, kind: str, name: str) -> DataFrame:
    """Nodes of a type and name, exactly; the ends are filtered before they are made one."""
    if not name:
        raise ValueError("a name is needed")
    ends = [t.filter((F.col(f"{e}_type") == kind) & (F.col(f"{e}_name") == name)).select(F.col(f"{e}_type").alias("type"), F.col(f"{e}_id").alias("id"), F.col(f"{e}_name").alias("name")) for e in "se"]
    return ends[0].union(ends[1]).distinct()


def relations_by_name(t: DataFrame, kind: str, name: str) -> DataFrame:
    """Triplets whose relation has this type and name, exactly."""
    if not name:
        raise ValueError("a name is needed")
    return t.filter((F.col("r_type") == kind) & (F.col("r_name") == name))


def copies(t: DataFrame, what: str, wanted: DataFrame) -> DataFrame:
    """(id, n) of wanted (id): how often a node, relation or triplet of this id is stored, 0 if never."""
    if what not in ("node", "relation", "triplet"):
        raise ValueError("what must be node, relation or triplet")
    have = nodes(t).select("id") if what == "node" else t.select(F.col("r_id" if what == "relation" else "t_id").alias("id"))
    n = have.join(wanted.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count("*").alias("n"))
    return wanted.select("id").distinct().join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def delete_with_info(nodes_: DataFrame, t: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, triplets) without those of gone (t_id, s_node, e_node); an end goes too where its flag says so or is null."""
    out = read_by_ids(t, gone).join(gone.select("t_id", "s_node", "e_node"), "t_id")
    ends = [out.filter(F.coalesce(f"{e}_node", F.lit(True))).select(F.col(f"{e}_type").alias("type"), F.col(f"{e}_id").alias("id")) for e in "se"]
    return nodes_.join(ends[0].union(ends[1]), ["type", "id"], "left_anti"), delete(t, gone)


def neighbour_counts(t: DataFrame, patterns: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(source, relation, target, n_targets, min, max, mean, median, std): how many sources of a type each target of a type has, by relation type; 'any' stands for all.

    Targets without a neighbour are absent; the deviation is that of the population.
    """
    ends = undirected(t).select(F.split("a", ":")[0].alias("source"), "a", F.col("r_type").alias("relation"), F.col("b_type").alias("target"), "b").distinct()
    every = ends.union(ends.select(F.lit("any"), "a", F.lit("any"), F.lit("any"), "b")).distinct()
    n = every.groupBy("source", "relation", "target", "b").agg(F.count_distinct("a").alias("n"))
    if patterns is not None:
        wanted = t.sparkSession.createDataFrame(patterns, "source string, relation string, target string")
        n = n.join(F.broadcast(wanted), ["source", "relation", "target"], "left_semi")
    return n.groupBy("source", "relation", "target").agg(F.count("*").alias("n_targets"), F.min("n").alias("min"), F.max("n").alias("max"), F.round(F.avg("n"), 3).alias("mean"), F.round(F.median("n"), 3).alias("median"), F.round(F.stddev_pop("n"), 3).alias("std"))


def node_ratios(t: DataFrame) -> DataFrame:
    """(ratio, value): edges a node, episodic nodes a hyper node, object nodes an episodic and a hyper node; null where there is none of the latter."""
    kind = lambda x: F.count_if(F.col("type") == x).cast("double")
    n = nodes(t).agg(F.count("*").cast("double").alias("all"), *[kind(x).alias(x) for x in ("object", "hyper", "episodic")]).join(t.agg(F.count("*").cast("double").alias("edges")))
    share = lambda name, a, b: F.struct(F.lit(name).alias("ratio"), F.round(F.try_divide(F.col(a), F.col(b)), 3).alias("value"))
    made = [share("edges_per_node", "edges", "all"), share("episodic_per_hyper", "episodic", "hyper"), share("objects_per_episodic", "object", "episodic"), share("objects_per_hyper", "object", "hyper")]
    return n.select(F.explode(F.array(*made)).alias("s")).select("s.*")


def components(t: DataFrame, save, salts: int = 8) -> DataFrame:
    """(node, root): root is the smallest typed id of the node's connected component.

    Labels fall by the least of the neighbourhood and then by the label's own label, so long chains take rounds in the logarithm of their length. A round pre-aggregates minima; the join
    that looks labels up is salted by the node that asks.
    """
    edges = undirected(t).select("a", "b").distinct()
    label = save(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).select(F.col("a").alias("node"), "root"), "label0")
    edges = save(edges, "edges")
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(salts)).cast("int")
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    k = 0
    while True:
        k += 1
        far = edges.withColumn("salt", salt("a")).join(spread(label).select(F.col("node").alias("b"), F.col("root").alias("r"), "salt"), ["b", "salt"])
        low = far.groupBy(F.col("a").alias("node")).agg(F.min("r").alias("low"))
        hooked = label.join(low, "node").select(F.col("root").alias("node"), F.least("root", "low").alias("low")).groupBy("node").agg(F.min("low").alias("low"))
        both = label.join(low, "node").select("node", F.least("root", "low").alias("root"))
        new = both.withColumn("salt", salt("node")).join(spread(hooked).select(F.col("node").alias("root"), F.col("low").alias("next"), "salt"), ["root", "salt"], "left")
        new = save(new.select("node", F.coalesce("next", "root").alias("root")), f"label{k}")
        moved = new.join(label.withColumnRenamed("root", "old"), "node").filter("root <> old").isEmpty()
        label = new
        if moved:
            return label


def component_sizes(t: DataFrame, save) -> DataFrame:
    """(size, n): numbers of connected components by their number of nodes."""
    return components(t, save).groupBy("root").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def text_lengths(t: DataFrame) -> DataFrame:
    """(what, type, n, min, max, mean, median, std) of the lengths of nodes' names and of relations' texts, by type."""
    texts = nodes(t).select(F.lit("node").alias("what"), "type", F.length("name").alias("x")).union(t.select("r_type", "r_id", "stringified").distinct().select(F.lit("relation"), "r_type", F.length("stringified")))
    return texts.groupBy("what", "type").agg(F.count("*").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.round(F.avg("x"), 3).alias("mean"), F.round(F.median("x"), 3).alias("median"), F.round(F.stddev_pop("x"), 3).alias("std"))


def coverage(t: DataFrame, vectors: DataFrame) -> DataFrame:
    """(type, n_graph, n_vectors, matched, only_graph, only_vectors): ids of the graph and of the stored vectors (type, id), type 'triplet' for relations."""
    have = nodes(t).select("type", "id").union(t.select(F.lit("triplet"), "r_id").distinct()).withColumn("g", F.lit(1))
    both = have.join(vectors.select("type", "id").distinct().withColumn("v", F.lit(1)), ["type", "id"], "full_outer")
    n = lambda c: F.count_if(c)
    g, v = F.col("g").isNotNull(), F.col("v").isNotNull()
    return both.groupBy("type").agg(n(g).alias("n_graph"), n(v).alias("n_vectors"), n(g & v).alias("matched"), n(g & ~v).alias("only_graph"), n(~g & v).alias("only_vectors"))


def consistent(t: DataFrame, vectors: DataFrame) -> DataFrame:
    """(type, n_graph, n_vectors, consistent): as many node vectors as nodes of each type; at most as many triplet vectors as triplets."""
    c = coverage(t, vectors).select("type", "n_graph", "n_vectors")
    n = t.agg(F.count("*").alias("all"))
    return c.join(F.broadcast(n)).select("type", F.when(F.col("type") == "triplet", F.col("all")).otherwise(F.col("n_graph")).alias("n_graph"), "n_vectors").withColumn("consistent", F.when(F.col("type") == "triplet", F.col("n_vectors") <= F.col("n_graph")).otherwise(F.col("n_vectors") == F.col("n_graph")))




def adjacent(t: DataFrame, frontier: DataFrame, types: list[str], distinct: bool = True) -> DataFrame:
    """(a, b, b_type, b_name) for a in frontier (a)."""
    out = undirected(t).join(frontier.select("a").distinct(), "a", "left_semi").filter(F.col("b_type").isin(types)).select("a", "b", "b_type", "b_name")
    return out.distinct() if distinct else out


def incident(t: DataFrame, frontier: DataFrame, types: list[str], relations: list[str] | None = None) -> DataFrame:
    out = undirected(t).join(frontier.select("a").distinct(), "a", "left_semi").filter(F.col("b_type").isin(types))
    return out.filter(F.col("r_type").isin(relations)) if relations else out


def shared(t: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, t_id, r_id) of all edges between the nodes of each pair, in any direction."""
    return undirected(t).join(pairs.select("a", "b").distinct(), ["a", "b"]).select("a", "b", "t_id", "r_id").distinct()


def by_names(t: DataFrame, names: DataFrame) -> DataFrame:
    """Triplets with an end of one of these names (name), in any case and direction."""
    low = names.select(F.lower("name").alias("n")).distinct()
    s = t.join(low, F.lower("s_name") == low.n, "left_semi")
    return s.union(t.join(low, F.lower("e_name") == low.n, "left_semi")).dropDuplicates(["t_id"])


def counts(t: DataFrame) -> DataFrame:
    """(what, type, n), with zeros for types without rows."""
    spark = t.sparkSession
    every = spark.createDataFrame([("node", x) for x in ids.NODE_TYPES] + [("triplet", x) for x in ids.RELATION_TYPES], "what string, type string")
    have = nodes(t).groupBy("type").count().select(F.lit("node").alias("what"), "type", "count").union(t.groupBy("r_type").count().select(F.lit("triplet"), "r_type", "count"))
    return every.join(have, ["what", "type"], "left").select("what", "type", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def health(t: DataFrame) -> DataFrame:
    return t.groupBy("s_type", "r_type", "e_type").agg(F.count("*").alias("n"))


def hops(t: DataFrame, seeds: DataFrame, depth: int, save) -> DataFrame:
    """(seed, b, hop): the least number of edges to every node within depth; one join a level, each level saved (save(df, name)).

    seeds: (seed), typed ids. A level's frontier is anti-joined with what was reached before, so no node is expanded twice.
    """
    edges = undirected(t).select("a", "b").distinct()
    reached = save(seeds.select("seed", F.col("seed").alias("b"), F.lit(0).alias("hop")), "hop0")
    front, parts = reached, [reached]
    for k in range(1, depth + 1):
        step = front.select("seed", F.col("b").alias("a")).join(edges, "a").select("seed", "b").distinct()
        step = step.join(reduce(DataFrame.union, parts), ["seed", "b"], "left_anti").select("seed", "b", F.lit(k).alias("hop"))
        front = save(step, f"hop{k}")
        parts.append(front)
    return reduce(DataFrame.union, parts)


#: Fixed value: the distance of nodes without a path.
UNREACHABLE = 1_000_001


def distances(t: DataFrame, pairs: DataFrame, depth: int, save) -> DataFrame:
    """(a, b, hop) of pairs (a, b): the least number of edges, UNREACHABLE if there is no path within depth."""
    near = hops(t, pairs.select(F.col("a").alias("seed")).distinct(), depth, save).withColumnRenamed("seed", "a")
    return pairs.select("a", "b").distinct().join(near, ["a", "b"], "left").select("a", "b", F.coalesce("hop", F.lit(UNREACHABLE)).alias("hop"))


def bfs(t: DataFrame, seeds: DataFrame, depth: int, width: int, save, passed: int = 50) -> DataFrame:
    """(seed, t_id): triplets between each node and those first seen from it, on a walk breadth first from every seed (seed).

    A node looks at its first `width` neighbours in order of typed id; a level's nodes do so in the order in which they were seen; a walk ends with the
    `passed` first nodes that it sees. Under 0, width and passed don't bind.
    """
    edges = undirected(t).select("a", "b", "t_id")
    near = edges.select("a", "b").distinct()
    if width >= 0:
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("b"))).filter(F.col("r") <= width).drop("r")
    near = save(near.filter("a <> b"), "near")
    front = save(seeds.select("seed", F.col("seed").alias("b"), F.lit(0).cast("long").alias("no")).distinct(), "bfs0")
    seen, found = [front], []
    for k in range(1, depth + 1):
        step = front.select("seed", F.col("b").alias("a"), "no").join(near, "a").join(reduce(DataFrame.union, seen).select("seed", "b"), ["seed", "b"], "left_anti")
        first = step.groupBy("seed", "b").agg(F.min(F.struct("no", "a")).alias("from")).join(front.groupBy("seed").agg(F.max("no").alias("before")), "seed")
        level = first.select("seed", "b", F.col("from.a").alias("a"), (F.col("before") + F.row_number().over(Window.partitionBy("seed").orderBy("from.no", "b"))).alias("no"))
        level = save(level.filter(F.col("no") <= passed) if passed >= 0 else level, f"bfs{k}")
        found.append(level.join(edges, ["a", "b"]).select("seed", "t_id"))
        front = level.select("seed", "b", "no")
        seen.append(front)
    return reduce(DataFrame.union, found).distinct()


def beam(t: DataFrame, seeds: DataFrame, score: Callable[[DataFrame], DataFrame], depth: int, paths: int, alpha: float, save, threshold: float = 0.0, other_nodes: bool = True, other_edges: bool = True, mode: str = "mixed") -> DataFrame:
    """(seed, nodes, t_ids, cost, ended): beam search by ascending cost from every seed (seed, and start, its node, where that is another).

    score adds s, the similarity in (0, 1] of an extension (seed, r_id, t_id, a, b, ...); an edge of s over the threshold costs -ln(s). Paths don't return to their own nodes and edges,
    nor, unless other_nodes or other_edges, go where another live path of the seed has been. Of each path the `paths` cheapest extensions live, of each seed
    the `paths` cheapest in all. A path without extension has ended; cost is the sum / edges**alpha. At the end `paths` of each seed stay: ended ones first
    ('ended_first'), those that reached the depth ('continuous_first'), or the cheapest ('mixed').
    """
    if mode not in ("ended_first", "continuous_first", "mixed"):
        raise ValueError("mode must be ended_first, continuous_first or mixed")
    edges = undirected(t).select("a", "b", "t_id", "r_id")
    start = F.col("start") if "start" in seeds.columns else F.col("seed")
    live = save(seeds.select("seed", F.array(start).alias("nodes"), F.array().cast("array<string>").alias("t_ids"), F.lit(0.0).alias("acc")), "beam0")
    done = []
    for k in range(1, depth + 1):
        tail = live.withColumn("a", F.element_at("nodes", -1))
        if not (other_nodes and other_edges):  # a seed has `paths` live paths at most
            tail = tail.join(live.groupBy("seed").agg(F.collect_list(F.struct("nodes", "t_ids")).alias("every")), "seed")
        ext = tail.join(edges, "a").filter(~F.array_contains("nodes", F.col("b")) & ~F.array_contains("t_ids", F.col("t_id")))
        if not other_nodes:
            ext = ext.filter(~F.exists("every", lambda p: (p.t_ids != F.col("t_ids")) & F.array_contains(p.nodes, F.col("b"))))
        if not other_edges:
            ext = ext.filter(~F.exists("every", lambda p: (p.t_ids != F.col("t_ids")) & F.array_contains(p.t_ids, F.col("t_id"))))
        ext = score(ext).filter(F.col("s") > threshold)
        ext = ext.select("seed", F.col("nodes").alias("from"), F.col("t_ids").alias("from_ids"), F.array_append("nodes", F.col("b")).alias("nodes"), F.array_append("t_ids", F.col("t_id")).alias("t_ids"), (F.col("acc") - F.log("s")).alias("acc"))
        order = ["acc", "t_ids"]
        ext = save(ext.withColumn("r", F.row_number().over(Window.partitionBy("seed", "from", "from_ids").orderBy(*order))).filter(F.col("r") <= paths).drop("r"), f"step{k}")
        if k > 1:
            done.append(live.join(ext.select("seed", F.col("from_ids").alias("t_ids")).distinct(), ["seed", "t_ids"], "left_anti").select("seed", "nodes", "t_ids", "acc", F.lit(True).alias("ended")))
        ext = ext.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy(*order))).filter(F.col("r") <= paths).drop("r")
        live = save(ext.select("seed", "nodes", "t_ids", "acc"), f"beam{k}")
    every = reduce(DataFrame.unionByName, [*done, live.withColumn("ended", F.lit(False))])
    cost = every.select("seed", "nodes", "t_ids", (F.col("acc") / F.pow(F.size("t_ids").cast("double"), F.lit(alpha))).alias("cost"), "ended")
    first = [] if mode == "mixed" else [F.desc("ended") if mode == "ended_first" else F.col("ended")]
    return cost.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy(*first, "cost", "t_ids"))).filter(F.col("r") <= paths).drop("r")


def expand_by_names(t: DataFrame, seeds: DataFrame) -> DataFrame:
    """seeds (seed): (seed, direction, t_id, other), object triplets with the seed as start (forward) or end (backward), in any case and with '_' for blanks or not."""
    forms = F.array("seed", F.translate("seed", "_", " "), F.translate("seed", " ", "_"))
    forms = seeds.select("seed", F.explode(F.transform(forms, F.lower)).alias("form")).distinct()
    simple = t.filter("s_type = 'object' and e_type = 'object'")
    side = lambda mine, other, direction: simple.join(forms, F.lower(mine) == F.col("form")).select("seed", F.lit(direction).alias("direction"), "t_id", F.col(other).alias("other"))
    return side("s_name", "e_name", "forward").union(side("e_name", "s_name", "backward")).distinct()
