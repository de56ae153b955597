"""Corpus preparation and answer metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_documents(docs: DataFrame, least: int, most: int) -> DataFrame:
    """(doc_id, hash): texts of least..most characters, the smallest id of each text."""
    kept = docs.filter(F.length("text").between(least, most)).withColumn("hash", F.md5("text"))
    return kept.groupBy("hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "hash")


def answerable(qa: DataFrame, kept: DataFrame, most: int | None = None) -> DataFrame:
    """qa (qa_id, question, refs array): of each question the smallest qa_id, if its references are all kept (doc_id), none empty; new_id counts those from 0 in order, the first `most` stay.

    The order is one of ids alone: ids are numbered block by block, so no window spans them all.
    """
    one = first_of(qa.filter(F.size("refs") > 0), ["question"], [F.col("qa_id")])
    each = one.select("qa_id", F.explode(F.array_distinct("refs")).alias("doc_id"))
    full = each.join(kept.select("doc_id", F.lit(1).alias("k")), "doc_id", "left").groupBy("qa_id").agg(F.count("*").alias("n_refs"), F.count("k").alias("m")).filter("n_refs = m").drop("m")
    out = numbered(full, "qa_id", "new_id")
    return out if most is None else out.filter(F.col("new_id") < most)


def numbered(df: DataFrame, by: str, into: str, block: int = 100_000) -> DataFrame:
    """df with dense numbers from 0 by a whole-number column without repeats: ranks within blocks of its values, and the sizes of the blocks before."""
    b = df.withColumn("_b", F.floor(F.col(by) / block))
    sizes = b.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(by)) - 1
    return b.withColumn("_r", rank).join(F.broadcast(sizes), "_b").withColumn(into, F.col("_r") + F.coalesce("_before", F.lit(0))).drop("_b", "_n", "_before", "_r")


def noise(docs: DataFrame, used: DataFrame, n: int) -> DataFrame:
    """The first n documents (by hash) that no pair refers to."""
    return docs.join(used.select("doc_id").distinct(), "doc_id", "left_anti").orderBy("hash").limit(n)


def chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, chunk, hash, text): paragraphs (cut at blank lines) joined to chunks of up to `size` characters.

    A chunk starts with the last paragraphs of the one before that have up to `overlap` characters together; a longer paragraph is cut into stretches of `size` that share
    `overlap`. A text's equal chunks count once, the first.
    """
    step = size - overlap
    cut = lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - overlap - 1) / step).cast("int")), lambda i: F.substring(p, i * step + 1, F.lit(size))))
    parts = F.flatten(F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n"), lambda p: F.trim(p) != ""), cut))
    tail = lambda now: F.aggregate(F.reverse(now), F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, p: F.when(
        s.go & (s.n + F.length(p) + F.when(F.size(s.kept) > 0, 2).otherwise(0) <= overlap), F.struct(F.concat(F.array(p), s.kept).alias("kept"), (s.n + F.length(p) + F.when(F.size(s.kept) > 0, 2).otherwise(0)).alias("n"), F.lit(True).alias("go"))
    ).otherwise(F.struct(s.kept.alias("kept"), s.n.alias("n"), F.lit(False).alias("go"))), lambda s: s.kept)
    joined = lambda x: F.array_join(x, "\n\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"))

    def add(s: Column, p: Column) -> Column:
        fits = (F.size(s.now) == 0) | (F.length(joined(s.now)) + 2 + F.length(p) <= size)
        carried = tail(s.now)
        begin = F.when((F.size(carried) > 0) & (F.length(joined(carried)) + 2 + F.length(p) <= size), F.concat(carried, F.array(p))).otherwise(F.array(p))
        return F.when(fits, F.struct(s.done.alias("done"), F.array_append(s.now, p).alias("now"))).otherwise(F.struct(F.array_append(s.done, joined(s.now)).alias("done"), begin.alias("now")))

    made = F.aggregate(parts, start, add, lambda s: F.when(F.size(s.now) > 0, F.array_append(s.done, joined(s.now))).otherwise(s.done))
    rows = docs.select("doc_id", F.posexplode(F.array_distinct(made)).alias("chunk", "text"))
    return rows.select("doc_id", "chunk", F.sha1("text").alias("hash"), "text")


def chunk_questions(pieces: DataFrame, asked: DataFrame) -> DataFrame:
    """(hash, qa_ids): each distinct chunk with the questions (qa_id, doc_id) that its documents belong to."""
    return pieces.join(asked, "doc_id").groupBy("hash").agg(F.array_sort(F.collect_set("qa_id")).alias("qa_ids"))


def tagged(qa: DataFrame, kept: DataFrame, bad: str = "no-answer") -> DataFrame:
    """qa (qa_id, tags array, refs array) with contexts, without the tag `bad`, all of whose contexts (doc_id) are kept."""
    fine = qa.filter((F.size("refs") > 0) & ~F.coalesce(F.array_contains("tags", bad), F.lit(False)))
    gone = fine.select("qa_id", F.explode("refs").alias("doc_id")).join(kept, "doc_id", "left_anti").select("qa_id").distinct()
    return fine.join(gone, "qa_id", "left_anti")


def multi_hop(qa: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, qa_ids), (qa_id, refs)): contexts with their questions and questions with their contexts, without questions that lost one."""
    each = qa.select("qa_id", F.explode(F.array_distinct("refs")).alias("doc_id"))
    lost = each.join(kept.select("doc_id"), "doc_id", "left_anti").select("qa_id").distinct()
    each = each.join(lost, "qa_id", "left_anti")
    return each.groupBy("doc_id").agg(F.array_sort(F.collect_set("qa_id")).alias("qa_ids")), each.groupBy("qa_id").agg(F.array_sort(F.collect_set("doc_id")).alias("refs"))


def dataset_faults(qa: DataFrame, docs: DataFrame) -> DataFrame:
    """(fault, n): questions and ids that come twice, empty references, references to no document, documents of no question; all 0 in a sound set."""
    refs, ids = qa.select(F.explode("refs").alias("doc_id")).distinct(), docs.select("doc_id").distinct()
    one = qa.agg((F.count("*") - F.count_distinct("question")).alias("repeated_questions"), (F.count("*") - F.count_distinct("qa_id")).alias("repeated_ids"), F.count_if(F.coalesce(F.size("refs"), F.lit(0)) < 1).alias("without_references"))
    one = one.join(docs.agg((F.count("*") - F.count_distinct("doc_id")).alias("repeated_documents"))).join(refs.join(ids, "doc_id", "left_anti").agg(F.count("*").alias("unknown_references"))).join(ids.join(refs, "doc_id", "left_anti").agg(F.count("*").alias("unused_documents")))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("fault"), F.col(c).cast("long").alias("n")) for c in one.columns])).alias("x")).select("x.*")


def answer_scores(answers: DataFrame, metrics: list[str], nothing: str) -> DataFrame:
    """(pack, metric means, null_share, nothing_share, time): answers (pack, answer, time, metrics...): means over answers that are there, the share of null answers and of those equal to `nothing`."""
    there = F.col("answer").isNotNull()
    return answers.groupBy("pack").agg(*[F.round(F.avg(F.when(there, F.col(m))), 5).alias(m) for m in metrics], F.round(F.count_if(~there) / F.count("*"), 5).alias("null_share"), F.round(F.count_if(F.col("answer") == nothing) / F.count("*"), 5).alias("nothing_share"), F.round(F.sum("time"), 3).alias("time"))


def pack_means(packs: DataFrame) -> DataFrame:
    """One row: the mean of the packs' columns, and the sum of their times."""
    return packs.agg(*[F.round(F.avg(c), 5).alias(c) for c in packs.columns if c not in ("pack", "time")], F.round(F.sum("time"), 3).alias("time"))


def ground_truth(qa: DataFrame, links: DataFrame, t: DataFrame) -> DataFrame:
    """(qa_id, t_ids, node_ids): triplets that a question's documents gave (links text_id, t_id) and their ends."""
    each = qa.select("qa_id", F.explode("refs").alias("text_id")).join(links.select("text_id", "t_id"), "text_id").join(t.select("t_id", F.concat_ws(":", "s_type", "s_id").alias("s"), F.concat_ws(":", "e_type", "e_id").alias("e")), "t_id")
    return each.groupBy("qa_id").agg(F.array_sort(F.collect_set("t_id")).alias("t_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("s", "e"))))).alias("node_ids"))


def score_summary(scores: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, max, mean, median, min, std, sum) of columns of scores."""
    x = lambda c: F.col(c).cast("double")
    made = [F.struct(F.lit(c).alias("column"), F.count(x(c)).alias("n"), *[F.round(f(x(c)), 5).alias(n) for n, f in (("max", F.max), ("mean", F.avg), ("median", F.median), ("min", F.min), ("std", F.stddev_pop), ("sum", F.sum))]) for c in columns]
    return scores.agg(F.array(*made).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def token_f1(a: Column, b: Column) -> Column:
    """Overlap of the sets of words over the lengths of the lists."""
    x, y = F.split(F.lower(a), " +"), F.split(F.lower(b), " +")
    same = F.size(F.array_intersect(x, y)).cast("double")
    p, r = same / F.size(x), same / F.size(y)
    return F.when(same > 0, 2 * p * r / (p + r)).otherwise(0.0)


def exact_match(a: Column, b: Column) -> Column:
    clean = lambda x: F.trim(F.regexp_replace(F.lower(x), "[\\p{Punct}]", ""))
    return clean(a) == clean(b)


def set_scores(found: DataFrame, gold: DataFrame, key: str, item: str) -> DataFrame:
    """(key, precision, recall) of sets of items."""
    f = found.select(key, item).distinct().withColumn("f", F.lit(1))
    g = gold.select(key, item).distinct().withColumn("g", F.lit(1))
    both = f.join(g, [key, item], "full_outer").groupBy(key).agg(F.sum(F.col("f") * F.col("g")).alias("h"), F.sum("f").alias("nf"), F.sum("g").alias("ng"))
    h = F.coalesce("h", F.lit(0))
    return both.select(key, F.coalesce(F.round(h / F.col("nf"), 5), F.lit(0.0)).alias("precision"), F.coalesce(F.round(h / F.col("ng"), 5), F.lit(0.0)).alias("recall"))


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def words(x: Column) -> Column:
    return F.split(F.lower(x), " +")


def _clipped(x: Column, y: Column) -> Column:
    """Number of items of x that y has, each at most as often as there."""
    times = lambda a, w: F.size(F.filter(a, lambda v: v == w))
    return F.aggregate(F.array_distinct(x), F.lit(0), lambda s, w: s + F.least(times(x, w), times(y, w)))


def _brevity(x: Column, y: Column) -> Column:
    return F.when(F.size(x) < F.size(y), F.exp(1 - F.size(y) / F.size(x))).otherwise(1.0)


def bleu1(found: Column, gold: Column) -> Column:
    """Share of found words that gold has, each at most as often as there, times exp(1 - gold / found) where found is the shorter."""
    x, y = words(found), words(gold)
    return _clipped(x, y) / F.size(x) * _brevity(x, y)


def bleu2(found: Column, gold: Column) -> Column:
    """As bleu1, of the geometric mean of the shares of words and of pairs of neighbours; 0 without a common pair."""
    x, y = words(found), words(gold)
    pairs = lambda a: F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), lambda v, w: F.concat_ws(" ", v, w))
    return F.sqrt(_clipped(x, y) / F.size(x) * _clipped(pairs(x), pairs(y)) / F.greatest(F.size(x) - 1, F.lit(1))) * _brevity(x, y)


def rouge_l(found: Column, gold: Column) -> Column:
    """F1 of the longest common subsequence of words; its table is folded row by row."""
    x, y = words(found), words(gold)
    cell = lambda row, done, w, j: F.when(F.get(y, j) == w, F.get(row, j) + 1).otherwise(F.greatest(F.get(row, j + 1), F.get(done, j)))
    line = lambda row, w: F.aggregate(F.sequence(F.lit(0), F.size(y) - 1), F.array(F.lit(0)), lambda done, j: F.array_append(done, cell(row, done, w, j)))
    common = F.element_at(F.aggregate(x, F.array_repeat(F.lit(0), F.size(y) + 1), line), -1)
    return 2.0 * common / (F.size(x) + F.size(y))
