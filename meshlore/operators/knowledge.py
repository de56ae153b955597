"""The graph and its vectors together: writing both, removing what nothing refers to, and what texts add to them.

Stored tables: triplets by t_id, vectors by key ('type:id'; 'triplet:r_id' for relations), provenance (text_id, t_id). Vectors are derived from the triplets,
so every index over them is derived from one table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlore.functions import parsers
from meshlore.operators import graph, memory
from meshlore.sources.parquet import Store

ROWS = ["s_type", "s_name", "r_type", "r_name", "e_type", "e_name"]


def vector_rows(t: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(key, type, id, text, embedding, t_id): a row for each node, and for each relation id, however many triplets share it (t_id is the smallest)."""
    n = graph.nodes(t).select("type", "id", F.col("name").alias("text"), F.lit(None).cast("string").alias("t_id"))
    r = t.groupBy("r_id").agg(F.min("stringified").alias("text"), F.min("t_id").alias("t_id")).select(F.lit("triplet").alias("type"), F.col("r_id").alias("id"), "text", "t_id")
    both = n.unionByName(r)
    return both.select(F.concat_ws(":", "type", "id").alias("key"), "type", "id", "text", embed(F.col("text")).alias("embedding"), "t_id")


def obsolete_vectors(t: DataFrame, gone: DataFrame) -> DataFrame:
    """(key): vectors that no triplet needs once gone (t_id) are removed."""
    flags = graph.deletion_flags(t, gone).join(t.select("t_id", "s_type", "s_id", "r_id", "e_type", "e_id"), "t_id")
    key = lambda flag, *parts: flags.filter(flag).select(F.concat_ws(":", *parts).alias("key"))
    return key("s_node", "s_type", "s_id").union(key("e_node", "e_type", "e_id")).union(key("triplet", F.lit("triplet"), "r_id")).distinct()


class Knowledge:
    """Stores of triplets, their vectors and their provenance under one root."""

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[Column], Column]):
        self.spark, self.embed = spark, embed
        self.triplets, self.vectors = Store(spark, root, "triplets", "t_id"), Store(spark, root, "vectors", "key")
        self.provenance = Store(spark, root, "provenance", "link")

    def add(self, new: DataFrame) -> DataFrame:
        """Unknown triplets and vectors are added, known ones stay. Returns the t_ids that are new."""
        new = new.dropDuplicates(["t_id"])
        fresh = new.select("t_id") if self.triplets.version() is None else new.select("t_id").join(self.triplets.read().select("t_id"), "t_id", "left_anti")
        self.triplets.create(new)
        self.vectors.create(vector_rows(new, self.embed))
        return fresh

    def remove(self, gone: DataFrame) -> None:
        """Triplets (t_id) go, and with them the nodes and relations that only they had."""
        t = self.triplets.read()
        keys = obsolete_vectors(t, gone)
        self.vectors.delete(keys)
        self.triplets.delete(gone)

    def counts(self) -> DataFrame:
        return graph.counts(self.triplets.read())

    def check(self) -> DataFrame:
        return graph.consistent(self.triplets.read(), self.vectors.read())

    def clear(self) -> None:
        for s in (self.triplets, self.vectors, self.provenance):
            s.clear()

    def save_origin(self, links: DataFrame) -> None:
        """links (text_id, t_id): a text that is known already raises."""
        if self.provenance.version() is not None and not links.join(self.provenance.read(), "text_id", "left_semi").isEmpty():
            raise ValueError("a text is known already")
        self.provenance.create(links.select("text_id", "t_id").distinct().withColumn("link", F.concat_ws("|", "text_id", "t_id")))

    def of_texts(self, texts: DataFrame) -> DataFrame:
        """(text_id, t_ids)."""
        return self.provenance.read().join(texts.select("text_id").distinct(), "text_id", "left_semi").groupBy("text_id").agg(F.array_sort(F.collect_set("t_id")).alias("t_ids"))

    def of_triplets(self, wanted: DataFrame) -> DataFrame:
        """(t_id, text_ids)."""
        return self.provenance.read().join(wanted.select("t_id").distinct(), "t_id", "left_semi").groupBy("t_id").agg(F.array_sort(F.collect_set("text_id")).alias("text_ids"))

    def forget(self, texts: DataFrame) -> None:
        """Texts (text_id) go, and the triplets that no other text refers to."""
        links = self.provenance.read().select("text_id", "t_id")
        gone = memory.clear_texts(links, texts).filter("state = 'deleted'").select("t_id")
        if self.triplets.version() is not None:
            self.remove(gone)
        self.provenance.delete(self.provenance.read().join(texts.select("text_id").distinct(), "text_id", "left_semi").select("link"))


def extract(texts: DataFrame, raw_triplets: Column, raw_theses: Column) -> DataFrame:
    """texts (text_id, text, time, and props where there are such) with generated answers -> (text_id, s_type, ..., e_name, s_props, r_props, e_props, status): rows of triplets, or one with status zero_triplets.

    Simple triplets and theses with their entities as parsed; every entity and thesis is linked to the text, and the time, where there is one, to text and theses. A text's
    properties and its time are its relations' in simple triplets, and those of theses, their entities and the text's node; entities of one text that read alike count once.
    """
    given = F.coalesce(F.col("props"), F.array().cast(graph.PROPS)) if "props" in texts.columns else F.array().cast(graph.PROPS)
    timed = F.when(F.col("time").isNotNull(), F.array(F.struct(F.lit("time").alias("k"), F.col("time").alias("v")))).otherwise(F.array().cast(graph.PROPS))
    texts = texts.withColumn("p", F.concat(given, timed))
    none = F.array().cast(graph.PROPS)

    def row(df: DataFrame, s: str, r: Column, e: str, types: tuple[str, str, str], props: tuple[Column, Column, Column]) -> DataFrame:
        kinds = [F.lit(k).alias(c) for k, c in zip(types, ("s_type", "r_type", "e_type"), strict=True)]
        return df.select("text_id", kinds[0], F.col(s).alias("s_name"), kinds[1], r.alias("r_name"), kinds[2], F.col(e).alias("e_name"), *[p.alias(c) for p, c in zip(props, ("s_props", "r_props", "e_props"), strict=True)])

    spo = texts.select("text_id", "p", F.explode(parsers.triplet_lines(raw_triplets)).alias("x")).select("text_id", "p", "x.*")
    simple = row(spo, "s", F.col("r"), "o", ("object", "simple", "object"), (none, F.col("p"), none))
    th = texts.select("text_id", "p", F.explode(parsers.theses(raw_theses)).alias("x")).select("text_id", "p", "x.thesis", F.explode("x.entities").alias("entity"))
    hyper = row(th, "entity", F.lit("hyper"), "thesis", ("object", "hyper", "hyper"), (F.col("p"), none, F.col("p")))
    entity = lambda df, kind, name, props: df.select("text_id", F.lit(kind).alias("kind"), F.col(name).alias("name"), props.alias("own"))
    entities = reduce(DataFrame.union, [entity(spo, "object", "s", none), entity(spo, "object", "o", none), entity(th, "object", "entity", F.col("p")), entity(th, "hyper", "thesis", F.col("p"))]).distinct()
    told = entities.join(texts.select("text_id", "text", "time", "p"), "text_id")
    episodic = told.select("text_id", F.col("kind").alias("s_type"), F.col("name").alias("s_name"), *[F.lit("episodic").alias(c) for c in ("r_type", "r_name", "e_type")], F.col("text").alias("e_name"), F.col("own").alias("s_props"), none.alias("r_props"), F.col("p").alias("e_props"))
    dated = told.filter("time is not null")
    time = row(dated, "time", F.lit("time"), "text", ("time", "time", "episodic"), (none, none, F.col("p"))).union(row(dated.filter("kind = 'hyper'"), "time", F.lit("time"), "name", ("time", "time", "hyper"), (none, none, F.col("own"))))
    every = reduce(DataFrame.unionByName, [simple, hyper, episodic, time]).distinct().withColumn("status", F.lit("success"))
    left = texts.select("text_id").join(every.select("text_id").distinct(), "text_id", "left_anti")
    return every.unionByName(left.select("text_id", *[F.lit(None).cast("string").alias(c) for c in ROWS], *[F.lit(None).cast(graph.PROPS).alias(c) for c in ("s_props", "r_props", "e_props")], F.lit("zero_triplets").alias("status")))


def simple_candidates(t: DataFrame, new: DataFrame) -> DataFrame:
    """(new_id, t_id): for each new simple triplet the stored object-object triplets at nodes of its ends' names."""
    ends = new.filter("r_type = 'simple'").select(F.col("t_id").alias("new_id"), F.explode(F.array("s_name", "e_name")).alias("name")).distinct()
    simple = t.filter("r_type = 'simple'")
    found = simple.select("t_id", F.col("s_name").alias("name")).union(simple.select("t_id", "e_name"))
    return ends.join(found, "name").filter("new_id <> t_id").select("new_id", "t_id").distinct()


def hyper_candidates(t: DataFrame, new: DataFrame) -> DataFrame:
    """(new_id, t_id): for each new hyper triplet the stored ones of the same-named object."""
    return new.filter("r_type = 'hyper'").select(F.col("t_id").alias("new_id"), F.col("s_name").alias("name")).join(t.filter("r_type = 'hyper'").select("t_id", F.col("s_name").alias("name")), "name").filter("new_id <> t_id").select("new_id", "t_id").distinct()


def replaced(pairs: DataFrame, candidates: DataFrame, t: DataFrame, new: DataFrame) -> DataFrame:
    """(t_id): candidates that a generated answer names as replaced; pairs (old, new: md5 of the rendered triplets), as `parsers.replacements` gives them.

    A simple triplet reads 's, r, o', a hyper one as its thesis.
    """
    text = lambda df: df.withColumn("m", F.md5(F.when(F.col("r_type") == "simple", F.concat_ws(", ", "s_name", "r_name", "e_name")).otherwise(F.col("e_name"))))
    both = candidates.join(text(t).select("t_id", F.col("m").alias("old")), "t_id").join(text(new).select(F.col("t_id").alias("new_id"), F.col("m").alias("new")), "new_id")
    return both.join(pairs.select("old", "new").distinct(), ["old", "new"], "left_semi").select("t_id").distinct()


def update(store: Knowledge, new: DataFrame, choose: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Add new triplets; with choose (candidates (new_id, t_id) -> (t_id)) what they make obsolete goes first, and time triplets raise."""
    if choose is not None and store.triplets.version() is not None:
        if not new.filter("r_type = 'time'").isEmpty():
            raise ValueError("time triplets replace nothing")
        t = store.triplets.read()
        gone = choose(simple_candidates(t, new).union(hyper_candidates(t, new)))
        after = graph.delete(t, gone).unionByName(new.select(*t.columns))
        late = memory.obsolete_episodic(after).join(t.select("t_id"), "t_id", "left_semi").select("t_id")
        store.remove(gone.union(late).distinct())
    store.add(new)


def remember(store: Knowledge, texts: DataFrame, raw_triplets: Column, raw_theses: Column, save, choose: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Extract from texts (text_id, text, time, generated answers), update the store and save what came from which text. Returns (text_id, status, n)."""
    rows = save(extract(texts, raw_triplets, raw_theses), "extracted")
    good = rows.filter("status = 'success'")
    t = save(graph.triplets(good.drop("status")).drop("s_props", "r_props", "e_props"), "triplets")
    store.save_origin(t.select("text_id", "t_id"))
    new = t.drop("text_id").dropDuplicates(["t_id"])
    update(store, new.filter("r_type <> 'time'"), choose)
    update(store, new.filter("r_type = 'time'"))
    return rows.groupBy("text_id").agg(F.first("status").alias("status"), F.count("s_name").alias("n"))


