"""Triplets around several entities of a question: those that join two of them, those that meet beyond, and the choice among them.

edges: (query, entity int, seed, direction, t_id, other) as `graph.expand_by_names` gives them for a question's seeds (query, entity, seed); a question has few entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Triplets of chains and their share by number of entities, other triplets and their shares, when evidence is thin.
CHAINS, SHARES, OTHERS, OTHER_SHARES, FEW_TEXTS, FEW_ALL = 25, [1.0, 0.5, 0.3], 6, {"strict": 0.5, "alone": 1.0, "all": 1.5}, 2, 20


def joined(edges: DataFrame, seeds: DataFrame, t: DataFrame) -> DataFrame:
    """(query, entity, kind, t_id, hits): kind 1, edges that touch another entity's seed, with how many of their two ends do; kind 2, edges of different entities that meet at a node.

    An edge of kind 1 is none of kind 2. Of edges between the same two nodes, in any direction, an entity has one of each kind: of most hits, then the smallest t_id.
    """
    name = lambda c: F.lower(F.translate(c, "_", " "))
    ends = t.select("t_id", name(F.col("s_name")).alias("s"), name(F.col("e_name")).alias("e"), F.least("s_id", "e_id").alias("low"), F.greatest("s_id", "e_id").alias("high"))
    rows = edges.select("query", "entity", "t_id", name(F.col("other")).alias("far")).distinct().join(ends, "t_id")
    others = seeds.select("query", F.col("entity").alias("o"), name(F.col("seed")).alias("n")).distinct().groupBy("query").agg(F.collect_list(F.struct("o", "n")).alias("seeds"))
    rows = rows.join(others, "query")
    seen = lambda c: F.exists("seeds", lambda x: (x.o != F.col("entity")) & (x.n == F.col(c))).cast("int")
    rows = rows.withColumn("hits", seen("s") + seen("e")).drop("seeds")
    first = rows.filter("hits > 0").select("query", "entity", F.lit(1).alias("kind"), "t_id", "hits", "low", "high")
    rest = rows.filter("hits = 0").select("query", "entity", "t_id", "far", "low", "high")
    shared = rest.groupBy("query", "far").agg(F.count_distinct("entity").alias("n")).filter("n > 1")
    second = rest.join(shared, ["query", "far"]).select("query", "entity", F.lit(2).alias("kind"), "t_id", F.lit(0).alias("hits"), "low", "high")
    order = Window.partitionBy("query", "entity", "kind", "low", "high").orderBy(F.desc("hits"), "t_id")
    return first.union(second).withColumn("r", F.row_number().over(order)).filter("r = 1").select("query", "entity", "kind", "t_id", "hits")


def assembled(chains: DataFrame, edges: DataFrame, seeds: DataFrame, texts: DataFrame, strict: bool = True) -> DataFrame:
    """(query, source, t_id): texts (query, t_id), triplets of chains, and others where evidence is thin; source is text, chain or other, a triplet counts for the first.

    Each entity gives CHAINS of its chains, less with more entities: strict, those of several hits alone if it has any. Without a chain and with under FEW_TEXTS texts (not
    strict: with under FEW_ALL of both) each entity gives some of its other edges.
    """
    n = seeds.groupBy("query").agg(F.count_distinct("entity").alias("n"))
    share = F.when(F.col("n") == 1, SHARES[0]).when(F.col("n") == 2, SHARES[1]).otherwise(SHARES[2])
    rows = chains.join(n, "query").withColumn("many", F.max((F.col("hits") > 1).cast("int")).over(Window.partitionBy("query", "entity")))
    if strict:
        rows = rows.filter((F.col("many") == 0) | (F.col("hits") > 1))
    rank = F.row_number().over(Window.partitionBy("query", "entity").orderBy(F.desc("hits"), "kind", "t_id"))
    kept = rows.withColumn("r", rank).filter(F.col("r") <= F.floor(CHAINS * share + 1e-9)).select("query", "t_id").distinct()
    text = texts.select("query", "t_id").distinct()
    count = seeds.select("query").distinct().join(kept.groupBy("query").agg(F.count("*").alias("c")), "query", "left").join(text.groupBy("query").agg(F.count("*").alias("h")), "query", "left").fillna(0, ["c", "h"])
    thin = count.filter((F.col("c") == 0) & (F.col("h") < FEW_TEXTS) if strict else F.col("c") + F.col("h") < FEW_ALL)
    most = int(OTHERS * OTHER_SHARES["alone" if strict else "all"])
    other = edges.select("query", "entity", "t_id").distinct().join(thin.select("query"), "query", "left_semi")
    other = other.withColumn("r", F.row_number().over(Window.partitionBy("query", "entity").orderBy("t_id"))).filter(F.col("r") <= most).select("query", "t_id").distinct()
    every = text.withColumn("source", F.lit("text")).unionByName(kept.withColumn("source", F.lit("chain"))).unionByName(other.withColumn("source", F.lit("other")))
    order = F.when(F.col("source") == "text", 0).when(F.col("source") == "chain", 1).otherwise(2)
    return every.withColumn("r", F.row_number().over(Window.partitionBy("query", "t_id").orderBy(order))).filter("r = 1").select("query", "source", "t_id")
