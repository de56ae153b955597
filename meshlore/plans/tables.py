"""The driver tables as a typed graph, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlore.functions.embeddings import hashed
from meshlore.operators import graph, knowledge
from meshlore.sources.parquet import Workspace

#: What this session has stored: (application, folder, table) -> DataFrame over the written files.
_STORED: dict[tuple[str, str, str], DataFrame] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores has few row groups, and is dealt out; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def triplet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read(spark, sf_dir, n)
    region, nation, customer, supplier, part = (t(x) for x in ("region", "nation", "customer", "supplier", "part"))
    row = lambda df, s, r, e, st="object", rt="simple", et="object": df.select(F.lit(st).alias("s_type"), F.col(s).alias("s_name"), F.lit(rt).alias("r_type"), F.lit(r).alias("r_name"), F.lit(et).alias("e_type"), F.col(e).alias("e_name"))
    out = row(nation.join(region, nation.n_regionkey == region.r_regionkey), "n_name", "in region", "r_name")
    out = out.union(row(customer.join(nation, customer.c_nationkey == nation.n_nationkey), "c_name", "lives in", "n_name"))
    out = out.union(row(supplier.join(nation, supplier.s_nationkey == nation.n_nationkey), "s_name", "based in", "n_name"))
    sold = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    out = out.union(row(sold.join(part, sold.l_partkey == part.p_partkey).join(supplier, sold.l_suppkey == supplier.s_suppkey), "p_name", "supplied by", "s_name"))
    docs = t("documents").select((F.col("doc_id") % 25).cast("int").alias("k"), F.md5("text").alias("episode"), F.concat(F.lit("2024-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0")).alias("month"))
    bench = t("benchmark").select((F.col("item_id") % 25).cast("int").alias("k"), F.col("text").alias("thesis"), F.col("item_id"))
    out = out.union(row(docs.join(nation, docs.k == nation.n_nationkey), "n_name", "episodic", "episode", rt="episodic", et="episodic"))
    out = out.union(row(bench.join(nation, bench.k == nation.n_nationkey), "n_name", "hyper", "thesis", rt="hyper", et="hyper"))
    out = out.union(row(docs, "month", "time", "episode", st="time", rt="time", et="episodic"))
    return out.distinct()


def stored(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """make() written once a session and folder, then read: graph, vectors and postings are stores that are filled once and asked often."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _STORED:
        _STORED[key] = Workspace(spark, "stored").save(make(), name)
    return _STORED[key]


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph."""
    return stored(spark, sf_dir, "triplets", lambda: graph.triplets(triplet_rows(spark, sf_dir)).dropDuplicates(["t_id"]))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, type, id, text, embedding, t_id) of the graph's nodes and relations, by the hashing embedder."""
    return stored(spark, sf_dir, "vectors", lambda: knowledge.vector_rows(triplets(spark, sf_dir), hashed))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text, q): one of each nation."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat("n_name", F.lit(" in region")).alias("text"))
    return n.withColumn("q", hashed(F.col("text")))


def saver(spark: SparkSession, label: str):
    return Workspace(spark, label).save


_ROWS = """
rows0 AS (
  SELECT 'object' s_type, n_name s_name, 'simple' r_type, 'in region' r_name, 'object' e_type, r_name e_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT 'object', c_name, 'simple', 'lives in', 'object', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT 'object', s_name, 'simple', 'based in', 'object', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT 'object', p_name, 'simple', 'supplied by', 'object', s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  UNION SELECT 'object', n_name, 'episodic', 'episodic', 'episodic', md5(text) FROM documents JOIN nation ON doc_id % 25 = n_nationkey
  UNION SELECT 'object', n_name, 'hyper', 'hyper', 'hyper', text FROM benchmark JOIN nation ON item_id % 25 = n_nationkey
  UNION SELECT 'time', '2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0'), 'time', 'time', 'episodic', md5(text) FROM documents
),
rows1 AS (SELECT *, CASE WHEN r_type = 'simple' THEN s_name || ' ' || r_name || ' ' || e_name WHEN r_type = 'time' THEN s_name || ': ' || e_name ELSE e_name END stringified, md5(s_name) s_id, md5(e_name) e_id FROM rows0),
rows2 AS (SELECT *, md5(stringified) r_id FROM rows1),
t AS (SELECT DISTINCT ON (t_id) * FROM (SELECT *, md5(s_type || s_id || r_type || r_id || e_type || e_id) t_id FROM rows2)),
nodes AS (SELECT type, id, min(name) AS name FROM (SELECT s_type type, s_id id, s_name AS name FROM t UNION ALL SELECT e_type, e_id, e_name FROM t) GROUP BY type, id),
u AS (SELECT s_type || ':' || s_id a, e_type || ':' || e_id b, e_type b_type, e_name b_name, r_type, r_id, t_id FROM t
  UNION ALL SELECT e_type || ':' || e_id, s_type || ':' || s_id, s_type, s_name, r_type, r_id, t_id FROM t WHERE s_type || ':' || s_id <> e_type || ':' || e_id)
"""
_EMBED = """
{name}0 AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_#]+'), lambda w: w <> '') ew FROM ({rows})),
{name}1 AS (SELECT *, list_transform(range(0, 16), lambda i: coalesce(list_sum(list_transform(ew, lambda x: (('0x' || substr(md5(x), (2 * i + 1)::INT, 2))::INT - 127.5)::DOUBLE / 127.5)), 0.0::DOUBLE)) raw FROM {name}0),
{name} AS (SELECT * EXCLUDE (ew, raw), CASE WHEN list_inner_product(raw, raw) > 0 THEN list_transform(raw, lambda x: x / sqrt(list_inner_product(raw, raw))) ELSE raw END emb FROM {name}1)"""
_QUESTIONS = "SELECT n_nationkey query_id, n_name || ' in region' AS text FROM nation"
_RELATIONS = "SELECT r_id id, min(stringified) AS text, min(t_id) t_id, min(r_type) r_type FROM t GROUP BY r_id"


def embed_sql(name: str, rows: str) -> str:
    """A named query: rows (text, ...) with emb, as `embeddings.hashed` gives it."""
    return _EMBED.format(name=name, rows=rows)


def bm25_sql(docs: str, queries: str) -> str:
    """Named queries up to bm(query_id, id, score, rank), docs (id, text), queries (query_id, text)."""
    terms = "SELECT {key}, term, count(*) tf FROM (SELECT {key}, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) term FROM ({rows})) WHERE term <> '' GROUP BY ALL"
    return f"""
bm_tf AS ({terms.format(key="id", rows=docs)}), bm_asked AS ({terms.format(key="query_id", rows=queries)}), bm_len AS (SELECT id, sum(tf) len FROM bm_tf GROUP BY id),
bm_df AS (SELECT term, count(*) df FROM bm_tf GROUP BY term), bm_n AS (SELECT (SELECT count(*) FROM ({docs})) n, (SELECT sum(len) FROM bm_len) all_len),
bm_w AS (SELECT bm_tf.term, bm_tf.id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (all_len / n))) w FROM bm_tf JOIN (SELECT DISTINCT term FROM bm_asked) USING (term) JOIN bm_df USING (term) JOIN bm_len USING (id), bm_n),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT query_id, id, sum(w) score FROM bm_w JOIN bm_asked USING (term) GROUP BY ALL))"""


def graph_sql(select: str, more: str = "") -> str:
    """`select` over t, nodes and u (edges both ways), with further named queries before it."""
    return "WITH RECURSIVE " + _ROWS + more + select


def retrieval_sql(select: str, more: str = "") -> str:
    """`select` over rel and asked (with emb), dense(query_id, id, score, rank) and bm of the questions over the graph's relations."""
    named = "," + embed_sql("rel", _RELATIONS) + "," + embed_sql("asked", _QUESTIONS) + "," + bm25_sql("SELECT id, text FROM rel", _QUESTIONS)
    dense = ", dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT query_id, id, list_inner_product(rel.emb, asked.emb) score FROM rel, asked))"
    return graph_sql(select, named + dense + more)
