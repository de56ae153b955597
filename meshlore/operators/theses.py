"""Theses of a question's entities: scores by what else they mention, and the choice of texts by falling thresholds.

seeds: (query, entity int, seed), the node names that each entity of a question is linked to; a question has few. theses: (query, entity, seed,
kind, text, t_id, values array<string>), the hyper and episodic texts of those nodes with the values of their properties. All plans but one bounded
figure, the largest number of entities; null texts and seeds take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlore.operators.corpus import first_of

#: Thresholds of the shared and of the single entity's ladder, texts of each kind, and their share by number of entities.
LEVELS = [2.0, 1.9, 1.4, 1.1, 0.9, 0.8, 0.6, 0.0]
OWN_LEVELS = [1.1, 0.9, 0.8, 0.6, 0.0]
MOST = {"hyper": 25, "episodic": 15}
SHARES = [1.0, 0.67, 0.5]

#: A name that is proper by itself, as another's mention, and as another's mention by its stems.
PROPER, MENTIONED, STEMMED = r"^.?\p{Lu}|\p{Nd}", r"^.?[\p{Lu}\p{Nd}]", r"^[\p{Lu}\p{Nd}]"


def stems(name: Column) -> Column:
    """Lower-case words; Russian ones lose their last two letters, of four letters the last, shorter ones none."""
    cut = lambda w: F.when(w.rlike("^[а-яё]") & (F.length(w) >= 4), F.substring(w, F.lit(1), F.when(F.length(w) > 4, F.length(w) - 2).otherwise(3))).otherwise(w)
    return F.transform(F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != ""), cut)


def mention_scores(theses: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row per (query, entity, kind, text) with score and flag.

    Every other entity adds 1.0 if a proper name of it is in the text (whole or by stems), else 0.5 if a common one is; the own seed adds
    0.7 if it is proper, in the text, and there are other entities. flag: a property has another entity's name as its value.
    """
    each = seeds.filter(F.col("seed").isNotNull()).select("query", "entity", F.struct(
        F.lower("seed").alias("low"), stems(F.col("seed")).alias("stems"), F.when(F.col("seed").rlike(MENTIONED), 1.0).otherwise(0.5).alias("whole"), F.when(F.col("seed").rlike(STEMMED), 1.0).otherwise(0.5).alias("part")).alias("s"))
    asked = each.groupBy("query", "entity").agg(F.collect_set("s").alias("names")).groupBy("query").agg(F.collect_list(F.struct("entity", "names")).alias("every"))
    rows = first_of(theses.filter("text is not null and seed is not null").withColumn("_t", F.trim("text")), ["query", "entity", "kind", "_t"], [F.col("seed"), F.col("t_id")]).drop("_t")
    rows = rows.join(asked, "query").withColumn("others", F.filter("every", lambda e: e.entity != F.col("entity"))).drop("every")
    text, own = F.lower("text"), F.lower("seed")
    worth = lambda s: F.when(F.contains(text, s.low), s.whole).when(F.forall(s.stems, lambda w: F.contains(text, w)), s.part).otherwise(0.0)
    found = F.aggregate("others", F.lit(0.0), lambda total, e: total + F.array_max(F.transform(e.names, worth)))
    bonus = F.when((F.size("others") > 0) & F.col("seed").rlike(PROPER) & F.contains(text, own), 0.7).otherwise(0.0)
    named = F.exists("others", lambda e: F.exists(e.names, lambda s: F.array_contains(F.coalesce("values", F.array().cast("array<string>")), s.low)))
    return rows.withColumns({"score": F.round(found + bonus, 6), "flag": F.coalesce(named, F.lit(False))}).drop("others", "values")


def climb(rows: DataFrame, levels: list[float]) -> DataFrame:
    """Each query's texts over the threshold at which its ladder ends, with `step`, the first threshold they pass.

    Thresholds fall until more than one text passes; one is enough where the next would be 0.6.
    """
    texts = rows.groupBy("query", "text").agg(F.max("score").alias("m"))
    passed = lambda v: F.sum(F.when(F.col("m") > v, 1).otherwise(0))
    ends = [F.when(passed(v) > (0 if after == 0.6 else 1), v) for v, after in zip(levels, [*levels[1:], None])]
    end = texts.groupBy("query").agg(F.coalesce(*ends, F.lit(levels[-1])).alias("end"))
    kept = rows.join(end, "query").filter(F.col("score") > F.col("end")).drop("end")
    kept = kept.withColumn("step", F.coalesce(*[F.when(F.col("score") > v, i) for i, v in enumerate(levels)]))
    return first_of(kept, ["query", "text"], [F.col("step"), F.col("entity"), F.desc("score"), F.col("kind"), F.col("t_id")])


def choose(scored: DataFrame, seeds: DataFrame, save, strict: bool = True, same_types: bool = False) -> DataFrame:
    """(query, kind, rank, text, seed, t_id, score): the texts that answer a question, at most MOST of a kind.

    Flagged texts of all entities climb one ladder. Questions without any take each proper entity's own ladder in turn, a text once; those still
    without take the last entity's texts. Entities of one type (same_types) give their best texts each.
    """
    number = seeds.groupBy("query").agg(F.count_distinct("entity").alias("n"), F.max("entity").alias("last"))
    share = F.when(F.col("n") == 1, SHARES[0]).when(F.col("n") == 2, SHARES[1]).otherwise(SHARES[2]) if strict else F.lit(SHARES[1])
    most = F.when(F.col("kind") == "hyper", MOST["hyper"]).otherwise(MOST["episodic"])
    rows = scored.join(number.withColumn("share", share).drop("n"), "query").withColumn("most", most)
    best = ["entity", F.desc("score"), "text", "t_id"]

    def capped(df: DataFrame, group: list[str], order: list) -> DataFrame:
        limit = F.floor(F.col("share") * F.col("most") + 1e-9)
        return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_r") <= limit).drop("_r")

    def ranked(df: DataFrame, order: list) -> DataFrame:
        out = df.withColumn("rank", F.row_number().over(Window.partitionBy("query", "kind").orderBy(*order))).filter(F.col("rank") <= F.col("most"))
        return out.select("query", "kind", "rank", "text", "seed", "t_id", "score")

    if same_types:
        return ranked(capped(rows, ["query", "entity", "kind"], best), best)
    shared = save(climb(rows.filter("flag"), LEVELS), "shared")
    rest = save(rows.join(shared.select("query").distinct(), "query", "left_anti"), "rest")
    first = first_of(seeds, ["query", "entity"], [F.col("seed")]).filter(F.col("seed").rlike(PROPER)).select("query", "entity")
    top = seeds.agg(F.max("entity")).first()[0]
    taken: list[DataFrame] = []
    for e in range((-1 if top is None else top) + 1):
        mine = rest.filter(F.col("entity") == e).join(first, ["query", "entity"], "left_semi")
        if taken:
            mine = mine.join(reduce(DataFrame.unionByName, taken).select("query", "text"), ["query", "text"], "left_anti")
        taken.append(save(climb(mine.select(*rest.columns), OWN_LEVELS), f"own{e}"))
    order = ["step", "entity", F.desc("score"), "text", "t_id"]
    out = ranked(capped(shared, ["query", "kind"], order), order)
    if not taken:
        return out
    own = reduce(DataFrame.unionByName, taken)
    out = out.unionByName(ranked(capped(own, ["query", "entity", "kind"], order), ["entity", "step", F.desc("score"), "text", "t_id"]))
    left = rest.join(own.select("query").distinct(), "query", "left_anti").filter("entity = last")
    return out.unionByName(ranked(capped(left, ["query", "kind"], best), best))
