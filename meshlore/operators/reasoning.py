"""Answering batches of questions: preprocessing, entity linking, search plans, answers, and their traces.

Every step is a plan over all questions at once; a prompted task is asked once for each distinct request (`tasks.solve`). Rows carry a status: those that are not
'success' pass through the rest untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlore.functions import parsers, prompts
from meshlore.operators import memory, retrievers, tasks

#: Entities of a text, steps of a plan, clue queries of a step, nodes of an entity, the answer without enough information.
MOST_ENTITIES, MOST_STEPS, MOST_CLUES, MOST_NODES, NO_ANSWER = 20, 8, 4, 3, "<|NotEnoughtInfo|>"
LINKING = {"steps": [{"index": "dense", "fetch": 50, "threshold": None, "weight": 0.3}, {"index": "bm25", "fetch": 50, "threshold": None, "weight": 0.7}]}

Retrieve = Callable[[DataFrame], DataFrame]


class Asker:
    """A provider with prompts, a place for tables, and the trace of what was asked."""

    def __init__(self, spark, provider, save, lang: str = "en", overrides: dict | None = None):
        self.spark, self.provider, self.save, self.lang, self.overrides, self.trace, self.k = spark, provider, save, lang, overrides or {}, [], 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.k += 1
        return self.save(df, f"{name}{self.k}")

    def ask(self, rows: DataFrame, task: str, values: dict[str, Column], parse: Callable[[Column], Column], into: str, when: Column | None = None) -> DataFrame:
        """rows (status, ...) with `into`: of rows of status success (and `when`, if given) the task's result, null and the task's status where it fails; else null."""
        start = time.time()
        live = (F.col("status") == "success") & (F.lit(True) if when is None else F.coalesce(when, F.lit(False)))
        rows = rows.drop(into)
        asked = rows.filter(live).withColumnRenamed("status", "before")
        out = tasks.solve(asked, values, prompts.suite(self.spark, task, self.overrides.get(task)), self.provider, parse, lambda df, name: self.table(df, f"{task}-{name}"), self.lang)[0]
        out = self.table(out.withColumnRenamed("result", into).drop("before", "key"), task)
        for r in out.groupBy("status").agg(F.count("*").alias("n"), F.count_if("cache_hit").alias("hits")).collect():  # a row a status
            self.trace.append((task, r.status, r.n, r.hits, round(time.time() - start, 3)))
        out = out.drop("cache_hit")
        return out.unionByName(rows.filter(~live).withColumn(into, F.lit(None).cast(out.schema[into].dataType)))

    def traces(self) -> DataFrame:
        """(task, status, n, cache_hits, elapsed) in order of asking."""
        return self.spark.createDataFrame(self.trace, "task string, status string, n long, cache_hits long, elapsed double")


def answer_of(raw: Column) -> Column:
    return parsers.after_marker(raw, "answer")


def preprocess(ask: Asker, questions: DataFrame, denoise: bool = True, enhance: bool = False, decompose: bool = True) -> DataFrame:
    """questions (question_id, query) -> (question_id, query, better, processed array, status): cleared of noise, completed, split into sub-questions.

    A step that fails ends a question with its status; one that needs no splitting is its own only part, and one whose splitting fails has status empty_answer.
    """
    rows = questions.select("question_id", "query", F.col("query").alias("better"), F.lit("success").alias("status"))
    for on, task in ((denoise, "denoise"), (enhance, "enhance")):
        if on:
            rows = ask.ask(rows, task, {"query": F.col("better")}, answer_of, "made")
            rows = rows.withColumn("better", F.coalesce("made", "better")).drop("made")
    rows = rows.withColumn("processed", F.array("better"))
    if decompose:
        rows = rows.withColumn("ready", F.col("status") == "success")
        rows = ask.ask(rows, "decompose_classify", {"query": F.col("better")}, parsers.truth, "many")
        rows = ask.ask(rows, "decompose", {"query": F.col("better")}, lambda raw: F.when(F.size(parsers.dashed(raw)) > 0, parsers.dashed(raw)), "parts", F.col("many"))
        rows = rows.withColumn("processed", F.coalesce("parts", "processed")).withColumn("status", F.when(F.col("ready") & (F.col("many").isNull() | (F.col("many") & F.col("parts").isNull())), "empty_answer").otherwise(F.col("status"))).drop("many", "parts", "ready")
    return rows.select("question_id", "query", "better", "processed", "status")


def linked(nodes: DataFrame, entities: DataFrame, embed: Callable[[Column], Column], most: int = MOST_NODES) -> DataFrame:
    """entities (key, entity) -> (key, entity, id, name, rank, exact): nodes (id, text, embedding) of each entity by vectors and words; only those of just its name, if there are such."""
    names = entities.select("entity").distinct().withColumn("query_id", F.md5("entity"))
    hits = retrievers.ranked_by(nodes, names.select("query_id", F.col("entity").alias("text"), embed(F.col("entity")).alias("q")), "ensemble_fusion", LINKING, most)
    found = memory.linked_nodes(names, hits.join(nodes.select("id", F.col("text").alias("name")), "id").select("query_id", "id", "name", "rank"), most)
    return entities.select("key", "entity").distinct().join(found.drop("query_id"), "entity").select("key", "entity", "id", "name", "rank", "exact")


def entity_names(found: DataFrame, compare: int = 5) -> DataFrame:
    """(key, entity, names): the entity alone if a node of just its name is among the first `compare`, else it and the nodes' names."""
    exact = F.max((F.col("exact") & (F.col("rank") <= compare)).cast("int")) == 1
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"])
    return found.groupBy("key", "entity").agg(F.when(exact, F.array("entity")).otherwise(F.concat(F.array("entity"), names)).alias("names"))


def context_of(found: DataFrame, t: DataFrame, kinds: tuple[str, ...] = retrievers.KINDS) -> DataFrame:
    """(query_id, context): the texts of a query's hyper and simple triplets (query_id, t_id), in order."""
    texts = found.select("query_id", "t_id").join(t.select("t_id", "r_type", "stringified"), "t_id").filter(F.col("r_type").isin(*kinds))
    return texts.groupBy("query_id").agg(parsers.context(F.array_sort(F.collect_set("stringified"))).alias("context"))


def _entities(ask: Asker, rows: DataFrame, text: str) -> DataFrame:
    names = lambda raw: F.when(F.size(parsers.name_list(raw)) > 0, F.slice(parsers.name_list(raw), 1, MOST_ENTITIES))
    return ask.ask(rows, "entities", {"query": F.col(text)}, names, "entities")


def weak(ask: Asker, questions: DataFrame, nodes: DataFrame, t: DataFrame, embed: Callable[[Column], Column], retrieve: Retrieve) -> DataFrame:
    """questions (question_id, query) -> (question_id, answer, status): entities, their nodes, triplets around them (retrieve: (query_id, text, q, seeds) -> (query_id, t_id)), an answer.

    A question without nodes has status empty_answer, one without triplets zero_retrieved_triplets.
    """
    rows = _entities(ask, questions.select("question_id", "query", F.lit("success").alias("status")), "query")
    each = rows.filter("status = 'success'").select(F.col("question_id").alias("key"), F.explode("entities").alias("entity"))
    seeds = ask.table(linked(nodes, each, embed).select(F.col("key").alias("query_id"), F.concat(F.lit("object:"), "id").alias("seed")).distinct(), "seeds")
    rows = _without(rows, "question_id", seeds, "empty_answer")
    asked = rows.filter("status = 'success'").select(F.col("question_id").alias("query_id"), F.col("query").alias("text"), embed(F.col("query")).alias("q"))
    found = ask.table(retrieve(asked, seeds).select("query_id", "t_id"), "found")
    rows = _without(rows, "question_id", found, "zero_retrieved_triplets")
    rows = rows.join(context_of(found, t).withColumnRenamed("query_id", "question_id"), "question_id", "left").withColumn("context", F.coalesce("context", F.lit("|Empty|")))
    rows = ask.ask(rows, "answer", {"context": F.col("context"), "query": F.col("query")}, answer_of, "answer")
    return rows.select("question_id", "answer", "status")


def _without(rows: DataFrame, key: str, found: DataFrame, status: str) -> DataFrame:
    """Rows of status success whose key is not in found (query_id) get a status."""
    have = found.select(F.col("query_id").alias(key), F.lit(True).alias("have")).distinct()
    return rows.join(have, key, "left").withColumn("status", F.when((F.col("status") == "success") & F.col("have").isNull(), status).otherwise(F.col("status"))).drop("have")


def medium(ask: Asker, questions: DataFrame, nodes: DataFrame, t: DataFrame, embed: Callable[[Column], Column], retrieve: Retrieve, steps: int = MOST_STEPS, behaviour: str = "stub", change_plan: bool = True) -> DataFrame:
    """questions (question_id, query) -> (question_id, answer, status): a plan of steps, each one searched through clue queries; after each, what was found may answer.

    All open questions take their k-th step together. A plan may change after each step; it ends with the answer, its last step, or `steps`. What is then open is
    answered from what was found ('answer') or with NO_ANSWER ('stub').
    """
    if behaviour not in ("answer", "stub"):
        raise ValueError("behaviour must be answer or stub")
    none = F.array().cast("array<string>")
    rows = questions.select("question_id", "query", F.lit("success").alias("status"), none.alias("steps"), none.alias("answers"), F.lit(None).cast("string").alias("answer"))
    told = {"query": F.col("query"), "steps": F.concat_ws("; ", "steps"), "answers": F.concat_ws("; ", "answers")}
    plan = lambda raw: F.when(F.size(parsers.numbered(raw)) > 0, parsers.numbered(raw))
    for k in range(steps):
        open_ = F.col("answer").isNull()
        if k == 0:
            rows = ask.ask(rows, "plan", {"query": F.col("query")}, plan, "made").withColumn("steps", F.coalesce("made", "steps")).drop("made")
        elif change_plan:
            rows = ask.ask(rows, "plan_classify", told, parsers.truth, "change", open_ & (F.size("steps") > k))
            rows = ask.ask(rows, "plan_enhance", told, plan, "made", open_ & F.col("change"))
            rows = rows.withColumn("steps", F.when(F.col("made").isNotNull(), F.concat(F.slice("steps", 1, k), F.col("made"))).otherwise(F.col("steps"))).drop("made", "change")
        rows = ask.table(rows, "plan")
        now = rows.filter(open_ & (F.col("status") == "success") & (F.size("steps") > k)).withColumn("step", F.get("steps", k))
        if now.isEmpty():
            break
        rest = rows.join(now.select("question_id"), "question_id", "left_anti")
        now = _entities(ask, now, "step")
        each = now.filter("status = 'success'").select(F.col("question_id").alias("key"), F.explode("entities").alias("entity"))
        found = ask.table(linked(nodes, each, embed), "linked")
        now = _without(now, "question_id", found.withColumnRenamed("key", "query_id"), "empty_answer")
        clues = memory.clue_queries(found.select(F.col("key").alias("query_id"), "entity", F.concat_ws("|", "id", "name").alias("name")), MOST_CLUES)
        clues = clues.join(now.filter("status = 'success'").select(F.col("question_id").alias("query_id"), "step"), "query_id").withColumn("status", F.lit("success"))
        names = F.transform("names", lambda x: F.split(x, "\\|", 2)[1])
        clues = ask.ask(clues.withColumn("clue_id", F.concat_ws("|", "query_id", "combination")), "clue_query", {"query": F.col("step"), "names": F.concat_ws(", ", names)}, answer_of, "clue")
        good = clues.filter("status = 'success'")
        asked = good.select(F.col("clue_id").alias("query_id"), F.col("clue").alias("text"), embed(F.col("clue")).alias("q"))
        seeds = good.select(F.col("clue_id").alias("query_id"), F.explode("names").alias("n")).select("query_id", F.concat(F.lit("object:"), F.split("n", "\\|", 2)[0]).alias("seed")).distinct()
        got = ask.table(retrieve(asked, seeds).select("query_id", "t_id"), "found")
        clues = clues.join(context_of(got, t).withColumnRenamed("query_id", "clue_id"), "clue_id", "left").withColumn("context", F.coalesce("context", F.lit("|Empty|")))
        clues = ask.ask(clues, "clue_answer", {"context": F.col("context"), "query": F.col("step")}, answer_of, "clue_answer")
        bad = clues.filter("status <> 'success'").groupBy(F.col("query_id").alias("question_id")).agg(F.min("status").alias("fault"))
        texts = clues.filter("status = 'success'").groupBy(F.col("query_id").alias("question_id")).agg(F.array_sort(F.collect_list(F.struct("combination", "clue_answer"))).alias("c"))
        now = now.join(bad, "question_id", "left").join(texts, "question_id", "left").withColumn("status", F.when(F.col("status") == "success", F.coalesce("fault", "status")).otherwise(F.col("status")))
        now = now.withColumn("clue_answers", F.array_join(F.transform("c", lambda x: x["clue_answer"]), "\n")).drop("fault", "c")
        now = ask.ask(now, "clue_summary", {"query": F.col("step"), "answers": F.coalesce("clue_answers", F.lit("|Empty|"))}, answer_of, "made")
        now = now.withColumn("answers", F.when(F.col("made").isNotNull(), F.array_append("answers", F.col("made"))).otherwise(F.col("answers"))).drop("made")
        now = ask.ask(now, "answer_classify", told, parsers.truth, "enough")
        now = ask.ask(now, "final_answer", told, answer_of, "made", F.col("enough")).withColumn("answer", F.col("made"))
        rows = ask.table(rest.unionByName(now.select(*rest.columns)), "step")
    left = F.col("answer").isNull()
    if behaviour == "answer":
        rows = ask.ask(rows, "final_answer", told, answer_of, "made", left).withColumn("answer", F.coalesce("answer", "made"))
    else:
        rows = rows.withColumn("answer", F.when(left & (F.col("status") == "success"), NO_ANSWER).otherwise(F.col("answer")))
    return rows.select("question_id", "answer", "status")


def aggregate(ask: Asker, parts: DataFrame) -> DataFrame:
    """parts (question_id, query, no, answer, status) -> (question_id, answer, status): one answer of a question's parts, the only one as it is; a part that failed fails the question."""
    fault = F.min(F.when(F.col("status") != "success", F.col("status")))
    rows = parts.groupBy("question_id").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("no", "answer"))).alias("a"), F.coalesce(fault, F.lit("success")).alias("status"))
    rows = rows.withColumn("texts", F.transform("a", lambda x: x["answer"])).drop("a")
    rows = ask.ask(rows, "aggregate", {"query": F.col("query"), "answers": F.concat_ws("\n", "texts")}, answer_of, "made", F.size("texts") > 1)
    return rows.select("question_id", F.when(F.col("status") == "success", F.coalesce("made", F.get("texts", 0))).alias("answer"), "status")


def answer(ask: Asker, questions: DataFrame, reason: Callable[[DataFrame], DataFrame], **steps: bool) -> DataFrame:
    """The whole way from questions (question_id, query) to (question_id, answer, status): preprocess, reason about every part, put the answers together."""
    ready = ask.table(preprocess(ask, questions, **steps), "ready")
    parts = ready.filter("status = 'success'").select("question_id", F.col("better").alias("whole"), F.posexplode("processed").alias("no", "part"))
    parts = parts.withColumn("id", F.concat_ws("|", "question_id", "no"))
    got = reason(parts.select(F.col("id").alias("question_id"), F.col("part").alias("query")))
    told = parts.join(got.withColumnRenamed("question_id", "id"), "id").select("question_id", F.col("whole").alias("query"), "no", "answer", "status")
    done = aggregate(ask, ask.table(told, "parts"))
    return done.unionByName(ready.filter("status <> 'success'").select("question_id", F.lit(None).cast("string").alias("answer"), "status"))


def judged(ask: Asker, answers: DataFrame) -> DataFrame:
    """answers (query, gold, answer, ...) with `right`, as the judge says."""
    rows = answers.withColumn("status", F.lit("success"))
    return ask.ask(rows, "judge", {c: F.coalesce(c, F.lit("|Empty|")) for c in ("query", "gold", "answer")}, parsers.truth, "right")
