"""Summary trees: nodes (id, str_id, type, text, depth) and edges (parent, child) as stores; insertion, lookup, deletion.

Types are root, summarized and leaf; the root has depth 0. Leaves stand for outside things by str_id; summarized nodes cover their leaves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlore.operators import memory, retrieval
from meshlore.operators.retrieval import dot
from meshlore.sources.parquet import Store

ROOT = "root"
NODE = "id string, str_id string, type string, text string, depth int"


def invalid(nodes: DataFrame) -> DataFrame:
    """(id, fault) of nodes without a depth, leaves without a str_id, and of types that there are not."""
    fault = F.when(~F.coalesce(F.col("type"), F.lit("")).isin("root", "summarized", "leaf"), "type").when(F.col("depth").isNull(), "depth").when((F.col("type") == "leaf") & F.col("str_id").isNull(), "str_id")
    return nodes.select("id", fault.alias("fault")).filter("fault is not null")


def consistency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: roots, leaves without str_id, summarized nodes without a child, leaves with more than one, whether summarized nodes are no more than leaves, and whether all is well."""
    n = edges.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    x = nodes.join(n, "id", "left").fillna(0, ["children"])
    kind = lambda k: F.col("type") == k
    out = x.agg(F.count_if(kind("root")).alias("n_roots"), F.count_if(kind("leaf") & F.col("str_id").isNull()).alias("leaves_unnamed"), F.count_if(kind("summarized") & (F.col("children") < 1)).alias("summarized_childless"),
                F.count_if(kind("leaf") & (F.col("children") > 1)).alias("leaves_with_children"), F.count_if(kind("summarized")).alias("n_summarized"), F.count_if(kind("leaf")).alias("n_leaves"))
    return out.withColumn("sound", (F.col("n_roots") == 1) & (F.col("leaves_unnamed") + F.col("summarized_childless") + F.col("leaves_with_children") == 0) & (F.col("n_summarized") <= F.col("n_leaves")))


def descend(nodes: DataFrame, edges: DataFrame, new: DataFrame, max_depth: int, save) -> DataFrame:
    """(new_id, node, depth): the path of each of new (new_id, embedding) from the root down, the last one being where it is attached.

    nodes (id, embedding): at each level the most similar child (ties: the smaller id) is next if its similarity reaches the level's threshold. One join a level.
    """
    child = save(edges.join(nodes.select(F.col("id").alias("child"), F.col("embedding").alias("v")), "child"), "children")
    front = save(new.select("new_id", "embedding", F.lit(ROOT).alias("node"), F.lit(0).alias("depth")), "path0")
    parts = [front.select("new_id", "node", "depth")]
    for k in range(max_depth + 1):
        step = front.join(child, front.node == child.parent).withColumn("score", dot("v", "embedding"))
        step = step.filter(F.col("score") >= memory.adaptive_threshold(F.lit(k), F.lit(max_depth)))
        best = step.withColumn("r", F.row_number().over(Window.partitionBy("new_id").orderBy(F.desc(F.round("score", 9)), "child"))).filter("r = 1")
        front = save(best.select("new_id", "embedding", F.col("child").alias("node"), F.lit(k + 1).alias("depth")), f"path{k + 1}")
        parts.append(front.select("new_id", "node", "depth"))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def lookup(nodes: DataFrame, edges: DataFrame, asked: DataFrame, max_depth: int, most: int = 1, strategy: str = "collapsed") -> DataFrame:
    """(query_id, id, text) of the leaves that match asked (query_id, q): the best leaf, or, if the best summarized node scores less than it, that node's best `most` leaves.

    nodes (id, type, text, embedding). A most under 1 takes all its leaves. The direction of the comparison is fixed.
    """
    if strategy != "collapsed":
        raise NotImplementedError(strategy) if strategy == "traversal" else ValueError(strategy)
    best = lambda kind: retrieval.dense_topk(nodes.filter(F.col("type") == kind).select("id", "embedding"), asked, 1).select("query_id", F.col("id").alias(kind), F.col("score").alias(f"{kind}_score"))
    both = best("leaf").join(best("summarized"), "query_id", "left")
    below = F.coalesce(F.col("summarized_score") < F.col("leaf_score"), F.lit(False))
    one = both.filter(~below).select("query_id", F.col("leaf").alias("id"))
    roots = both.filter(below).select("query_id", F.col("summarized").alias("root"))
    under = memory.leaf_descendants(edges, roots.select("root").distinct(), max_depth)
    subset = roots.join(under, "root").select("query_id", F.col("leaf").alias("id"))
    if most > 0:
        subset = retrieval.dense_topk(nodes.select("id", "embedding"), asked, most, subset).select("query_id", "id")
    return one.union(subset).join(nodes.select("id", "text"), "id").select("query_id", "id", "text")


class Tree:
    """A tree in two stores. Changes check their input first and raise ValueError."""

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[Column], Column], save):
        self.spark, self.embed, self.saved, self._save = spark, embed, 0, save
        self.nodes, self.edges = Store(spark, root, "nodes", "id"), Store(spark, root, "edges", "child")
        if self.nodes.version() is None:
            self.nodes.create(spark.createDataFrame([(ROOT, None, "root", None, 0)], NODE))
            self.edges.create(spark.createDataFrame([], "parent string, child string"))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.saved += 1
        return self._save(df, f"{name}-{self.saved}")

    def create(self, new: DataFrame) -> None:
        """new (parent, id, str_id, type, text, depth): parents must be there, ids must not."""
        if not invalid(new).isEmpty():
            raise ValueError("a node is not valid")
        if not new.join(self.nodes.read(), "id", "left_semi").isEmpty():
            raise ValueError("a node is there already")
        if not new.join(self.nodes.read().select(F.col("id").alias("parent")), "parent", "left_anti").isEmpty():
            raise ValueError("a parent is missing")
        self.nodes.upsert(new.select("id", "str_id", "type", "text", "depth"))
        self.edges.upsert(new.select("parent", F.col("id").alias("child")))

    def read(self, wanted: DataFrame, by: str = "id") -> DataFrame:
        """Nodes of wanted (id) or (str_id)."""
        return self.nodes.read().join(wanted.select(by).distinct(), by, "left_semi")

    def exist(self, wanted: DataFrame, by: str = "id") -> DataFrame:
        have = self.nodes.read().select(by, F.lit(True).alias("found")).dropDuplicates([by])
        return wanted.select(by).distinct().join(have, by, "left").select(by, F.coalesce("found", F.lit(False)).alias("found"))

    def update(self, rows: DataFrame) -> None:
        """Known nodes get new texts, types and so on; their edges stay."""
        if not invalid(rows).isEmpty():
            raise ValueError("a node is not valid")
        self.nodes.update(rows.select("id", "str_id", "type", "text", "depth"))

    def delete(self, gone: DataFrame) -> None:
        """Nodes (id) without children."""
        if not self.edges.read().join(gone.select(F.col("id").alias("parent")), "parent", "left_semi").isEmpty():
            raise ValueError("a node has children")
        self.nodes.delete(gone)
        self.edges.delete(gone.select(F.col("id").alias("child")))

    def children(self, wanted: DataFrame) -> DataFrame:
        """(parent, child, type, text)."""
        return self.edges.read().join(wanted.select(F.col("id").alias("parent")), "parent", "left_semi").join(self.nodes.read().select(F.col("id").alias("child"), "type", "text"), "child")

    def max_depth(self) -> int:
        return self.nodes.read().agg(F.max("depth")).first()[0]

    def counts(self) -> DataFrame:
        return self.nodes.read().groupBy("type").agg(F.count("*").alias("n"))

    def leaves_under(self, roots: DataFrame) -> DataFrame:
        """(root, leaf)."""
        return memory.leaf_descendants(self.edges.read(), roots, self.max_depth())

    def check(self) -> DataFrame:
        return consistency(self.nodes.read(), self.edges.read())

    def insert(self, str_id: str, text: str, summarize: Callable[[str, str, int], str | None], mechanism: str = "sequencial") -> str:
        """Put one text in: down the tree while a child is similar enough, every node on the way summarised anew from the bottom up, a leaf at the end turned into a summarized node with its old text below it.

        summarize(text of the node, new text, number of leaves below) -> text, or None: 'text, new'. 'sequencial' passes each summary on to the next node up, 'parallel' the new text to all.
        Returns the status. Insertions depend on one another, so this is one at a time; each is a few joins.
        """
        if mechanism not in ("sequencial", "parallel"):
            raise ValueError(mechanism)
        nodes, edges = self.nodes.read(), self.edges.read()
        if not nodes.filter(F.col("str_id") == str_id).isEmpty():
            return "already_exist"
        v = nodes.select("id", self.embed(F.col("text")).alias("embedding")).filter("embedding is not null")
        new = self.spark.createDataFrame([(str_id, text)], "new_id string, text string").select("new_id", self.embed(F.col("text")).alias("embedding"))
        path = [r.node for r in descend(v, edges, new, self.max_depth(), self.save).orderBy("depth").collect()][1:]  # as long as the tree is deep
        rows = {r.id: r for r in nodes.filter(F.col("id").isin(path)).collect()}
        n = {r.root: r.n for r in self.leaves_under(self.spark.createDataFrame([(p,) for p in path] or [(ROOT,)], "root string")).groupBy("root").agg(F.count("*").alias("n")).collect()}
        changed, told = [], text
        for p in reversed(path):
            made = summarize(rows[p].text, told if mechanism == "sequencial" else text, n.get(p, 0))
            made = f"{rows[p].text}, {text}" if made is None else made
            changed.append((p, rows[p].str_id if rows[p].type != "leaf" else None, "summarized", made, rows[p].depth))
            told = made
        parent = path[-1] if path else ROOT
        if path and rows[parent].type == "leaf":
            self.create(self.spark.createDataFrame([(parent, f"{parent}/0", rows[parent].str_id, "leaf", rows[parent].text, rows[parent].depth + 1)], "parent string, " + NODE))
        if changed:
            self.update(self.spark.createDataFrame(changed, NODE))
        self.create(self.spark.createDataFrame([(parent, f"{parent}/{str_id}", str_id, "leaf", text, len(path) + 1)], "parent string, " + NODE))
        return "success"

    def expand(self, texts: list[tuple[str, str]], summarize: Callable[[str, str, int], str | None]) -> dict[str, str]:
        """Insert (str_id, text) in order, an id once: {str_id: status}."""
        return {i: self.insert(i, t, summarize) for i, t in dict(texts).items()}

    def reduce(self, gone: DataFrame) -> None:
        """Leaves (str_id) go, and summarized nodes that have none left below them."""
        ids = self.read(gone, "str_id").filter("type = 'leaf'").select("id")
        while not ids.isEmpty():
            self.delete(self.save(ids, "gone"))
            parents = self.edges.read().select(F.col("parent").alias("id")).distinct()
            ids = self.nodes.read().filter("type = 'summarized'").select("id").join(parents, "id", "left_anti")
