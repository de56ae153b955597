"""Provenance, key-value and table stores, statistics, derivations of new knowledge, summary trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return store.join(new.select(key), key, "left_anti").unionByName(new)


def add_missing(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing keys stay as they are; of a batch's repeats one is taken."""
    return store.unionByName(new.dropDuplicates([key]).join(store.select(key), key, "left_anti").select(*store.columns))


def read_positional(store: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (pos, id): a row for each position, null where the store has no value."""
    return asked.join(store.select("id", "value"), "id", "left").select("pos", "id", "value")


def evict(store: DataFrame, n: int) -> DataFrame:
    """Without the n rows of the least score (ties: the smaller id)."""
    gone = store.orderBy("score", "id").limit(n).select("id")
    return store.join(gone, "id", "left_anti")


def two_tier(fast: DataFrame, slow: DataFrame, asked: DataFrame) -> DataFrame:
    one = asked.join(fast.select("id", F.col("value").alias("v1")), "id", "left").join(slow.select("id", F.col("value").alias("v2")), "id", "left")
    return one.select("pos", "id", F.coalesce("v1", "v2").alias("value"), F.col("v1").isNotNull().alias("hit"))


def statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, n_not_null, min, max, sum, mean, std, median): nulls ignored, population deviation, exact median, rounded to 3."""
    made = []
    for c in columns:
        x = F.col(c).cast("double")
        made.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count(x).alias("n_not_null"), *[F.round(f(x), 3).alias(n) for n, f in (("min", F.min), ("max", F.max), ("sum", F.sum), ("mean", F.avg), ("std", F.stddev_pop), ("median", F.median))]))
    return df.agg(F.array(*made).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def deletable(links: DataFrame, texts: DataFrame, references: int = 1) -> DataFrame:
    """links (text_id, t_id): triplets of the given texts (text_id) that just `references` texts refer to."""
    mine = links.join(texts.select("text_id").distinct(), "text_id", "left_semi")
    n = links.join(mine.select("t_id").distinct(), "t_id", "left_semi").groupBy("t_id").agg(F.count_distinct("text_id").alias("n"))
    return mine.select("text_id", "t_id").distinct().join(n.filter(F.col("n") == references), "t_id", "left_semi")


def clear_texts(links: DataFrame, texts: DataFrame) -> DataFrame:
    """(t_id, state): deleted with its last text, updated if others still refer to it."""
    gone = texts.select("text_id").distinct()
    mine = links.join(gone, "text_id", "left_semi").select("t_id").distinct()
    rest = links.join(gone, "text_id", "left_anti").select("t_id").distinct()
    return mine.join(rest.withColumn("live", F.lit(True)), "t_id", "left").select("t_id", F.when(F.col("live"), "updated").otherwise("deleted").alias("state"))


def derive(extracted: DataFrame) -> DataFrame:
    """Triplet rows of (episode, entity, thesis, time): thesis links, episode links of entities and theses, time links. Null parts give no row."""
    row = lambda st, s, rt, et, e: extracted.filter(s.isNotNull() & e.isNotNull()).select(F.lit(st).alias("s_type"), s.alias("s_name"), F.lit(rt).alias("r_type"), F.lit(rt).alias("r_name"), F.lit(et).alias("e_type"), e.alias("e_name"))
    ep, en, th, ti = (F.col(c) for c in ("episode", "entity", "thesis", "time"))
    return reduce(DataFrame.union, [row("object", en, "hyper", "hyper", th), row("object", en, "episodic", "episodic", ep), row("hyper", th, "episodic", "episodic", ep), row("time", ti, "time", "episodic", ep), row("time", ti, "time", "hyper", th)]).distinct()


def obsolete_episodic(t: DataFrame) -> DataFrame:
    """t_ids of object-episode links whose ends share no thesis, and of thesis-episode links whose thesis has no object."""
    hyper = t.filter("r_type = 'hyper'").select(F.col("s_id").alias("o"), F.col("e_id").alias("h"))
    told = t.filter("r_type = 'episodic' and s_type = 'hyper'")
    common = hyper.join(told.select(F.col("s_id").alias("h"), F.col("e_id").alias("ep")), "h").select("o", "ep").distinct()
    o = t.filter("r_type = 'episodic' and s_type = 'object'").join(common, (F.col("s_id") == F.col("o")) & (F.col("e_id") == F.col("ep")), "left_anti").select("t_id", F.lit("object").alias("kind"))
    h = told.join(hyper.select(F.col("h").alias("s_id")), "s_id", "left_anti").select("t_id", F.lit("hyper").alias("kind"))
    return o.union(h)


def leaf_descendants(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """edges (parent, child): (root, leaf) for roots (root); a root without children is its own leaf. One join a level up to depth."""
    inner = edges.select(F.col("parent").alias("node")).distinct()
    front, out = roots.select("root", F.col("root").alias("node")), []
    for _ in range(depth + 1):
        out.append(front.join(inner, "node", "left_anti").select("root", F.col("node").alias("leaf")))
        front = front.join(edges, front.node == edges.parent).select("root", F.col("child").alias("node"))
    return reduce(DataFrame.union, out)


def adaptive_threshold(depth: Column, max_depth: Column) -> Column:
    """0.3 exp(0.4 depth / max_depth); 0.3 for a tree without levels; over 1 becomes 0.98."""
    x = F.when(max_depth < 1, 0.3).otherwise(0.3 * F.exp(0.4 * depth / max_depth))
    return F.when(x > 1, 0.98).otherwise(x)


def linked_nodes(entities: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """candidates (query_id, id, name, rank) of entities (query_id, entity): if some match exactly (in any case) only these, else the first k."""
    x = candidates.join(entities, "query_id").withColumn("exact", F.lower("name") == F.lower("entity"))
    x = x.withColumn("any", F.max("exact").over(Window.partitionBy("query_id"))).filter((F.col("rank") <= k) & (F.col("exact") | ~F.col("any")))
    return x.select("query_id", "entity", "id", "name", "rank", "exact")


def clue_queries(matches: DataFrame, most: int) -> DataFrame:
    """matches (query_id, entity, name): combinations of one name an entity, entities and names in order, the first `most` of each query.

    Combinations are read off their number in mixed radix, so none beyond `most` is made.
    """
    lists = matches.groupBy("query_id", "entity").agg(F.sort_array(F.collect_set("name")).alias("names")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("entity", "names"))).alias("e"))
    total = F.aggregate("e", F.lit(1).cast("long"), lambda s, x: F.least(s * F.size(x.names), F.lit(1 << 40)))
    rows = lists.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.least(total, F.lit(most)) - 1)))
    right = F.transform("e", lambda x, i: F.aggregate(F.slice("e", i + 2, F.size("e")), F.lit(1).cast("long"), lambda s, y: s * F.size(y.names)))
    pick = F.transform(F.arrays_zip("e", "w"), lambda z: F.element_at(z.e.names, (F.pmod(F.floor(F.col("n") / z.w), F.size(z.e.names)) + 1).cast("int")))
    return rows.withColumn("w", right).select("query_id", F.col("n").alias("combination"), pick.alias("names"))


def tree_health(edges: DataFrame) -> DataFrame:
    """edges (parent, child): one row of counts; a sound tree has one root, no node with two parents and no more inner nodes than leaves."""
    inner = edges.select(F.col("parent").alias("node")).distinct().withColumn("p", F.lit(1))
    below = edges.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("c"))
    n = inner.join(below, "node", "full_outer").agg(F.count_if(F.col("c").isNull()).alias("n_roots"), F.count("p").alias("n_inner"), F.count_if(F.col("p").isNull()).alias("n_leaves"), F.count_if(F.col("c") > 1).alias("n_two_parents"))
    return n.withColumn("sound", (F.col("n_roots") == 1) & (F.col("n_two_parents") == 0) & (F.col("n_inner") <= F.col("n_leaves")))
