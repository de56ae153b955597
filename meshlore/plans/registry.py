"""Queries of the engine's own operators over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlore.functions import embeddings, ids, parsers
from meshlore.functions.embeddings import hashed
from meshlore.operators import astar, chains, corpus, graph, knowledge, memory, reasoning, retrieval, retrievers, tasks, theses, trees
from meshlore.operators.retrieval import dot
from meshlore.plans.tables import bm25_sql, embed_sql, graph_sql, questions, read, retrieval_sql, saver, spread, triplets
from meshlore.plans.tables import vectors as graph_vectors
from meshlore.sources.index import Composer, LexicalIndex, VectorIndex
from meshlore.sources.parquet import Store, Workspace

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
OBJECTS = ["object"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def new_root(spark: SparkSession, label: str) -> str:
    return Workspace(spark, label).root


def frontier(t: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nations."""
    return read(spark, sf_dir, "nation").select(F.concat(F.lit("object:"), F.md5("n_name")).alias("a"))


IN_NATION = "a IN (SELECT 'object:' || md5(n_name) FROM nation)"


# graph
@query(graph_sql("SELECT r_type, count(*)::BIGINT n, count(DISTINCT r_id)::BIGINT n_relations, min(t_id) first_id FROM t GROUP BY r_type"))
def g1_create(spark, sf_dir):
    t = triplets(spark, sf_dir)
    return t.groupBy("r_type").agg(F.count("*").alias("n"), F.count_distinct("r_id").alias("n_relations"), F.min("t_id").alias("first_id"))


@query(graph_sql("SELECT r_type, count(*)::BIGINT n FROM t GROUP BY r_type"))
def g2_idempotent_create(spark, sf_dir):
    t = triplets(spark, sf_dir)
    return graph.create(t.filter("r_type = 'simple'"), t).groupBy("r_type").agg(F.count("*").alias("n"))


@query(graph_sql("SELECT t_id, stringified, r_id FROM t WHERE t_id IN (SELECT t_id FROM t WHERE r_name IN ('in region', 'based in'))"))
def g3_read_by_ids(spark, sf_dir):
    t = triplets(spark, sf_dir)
    return graph.read_by_ids(t, t.filter(F.col("r_name").isin("in region", "based in"))).select("t_id", "stringified", "r_id")


@query(graph_sql("SELECT r_name, count(*)::BIGINT n FROM t WHERE r_name <> 'lives in' GROUP BY r_name"))
def g5_delete(spark, sf_dir):
    t = triplets(spark, sf_dir)
    return graph.delete(t, t.filter("r_name = 'lives in'")).groupBy("r_name").agg(F.count("*").alias("n"))


@query(graph_sql("""SELECT t_id, NOT EXISTS (SELECT 1 FROM ln WHERE ln.id = s_id AND ln.type = s_type) s_node, NOT EXISTS (SELECT 1 FROM ln WHERE ln.id = e_id AND ln.type = e_type) e_node,
 r_id NOT IN (SELECT r_id FROM l) triplet FROM t WHERE r_name = 'lives in'""", ", l AS (SELECT * FROM t WHERE r_name <> 'lives in'), ln AS (SELECT s_type type, s_id id FROM l UNION SELECT e_type, e_id FROM l)\n"))  # fmt: skip
def g6_orphan_delete(spark, sf_dir):
    t = triplets(spark, sf_dir)
    return graph.deletion_flags(t, t.filter("r_name = 'lives in'"))


@query(graph_sql("SELECT type, id, name FROM nodes WHERE type = 'object' AND name = 'NATION_2'"))
def g7_read_by_name(spark, sf_dir):
    return graph.read_by_name(triplets(spark, sf_dir), "object", "NATION_2")


@query(graph_sql(f"SELECT DISTINCT a, b, b_type, b_name FROM u WHERE {IN_NATION} AND b_type = 'object'"))
def g8_adjacent_nodes(spark, sf_dir):
    t = triplets(spark, sf_dir)
    return graph.adjacent(t, frontier(t, spark, sf_dir), OBJECTS)


@query(graph_sql(f"SELECT a, b, r_type, t_id FROM u WHERE {IN_NATION} AND b_type IN ('hyper', 'episodic')"))
def g9_incident_triplets(spark, sf_dir):
    t = triplets(spark, sf_dir)
    return graph.incident(t, frontier(t, spark, sf_dir), ["hyper", "episodic"]).select("a", "b", "r_type", "t_id")


PAIRS = "SELECT DISTINCT 'object:' || md5(s_name) a, 'object:' || md5(n_name) b FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def supplier_pairs(spark, sf_dir):
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.concat(F.lit("object:"), F.md5("s_name")).alias("a"), F.concat(F.lit("object:"), F.md5("n_name")).alias("b"))


@query(graph_sql(f"SELECT DISTINCT u.a, u.b, t_id, r_id FROM u JOIN ({PAIRS}) p ON u.a = p.a AND u.b = p.b"))
def g10_shared_ids(spark, sf_dir):
    return graph.shared(triplets(spark, sf_dir), supplier_pairs(spark, sf_dir))


@query(graph_sql(f"SELECT DISTINCT t.t_id, t.stringified FROM u JOIN ({PAIRS}) p ON u.a = p.a AND u.b = p.b JOIN t ON t.t_id = u.t_id"))
def g11_pair_triplets(spark, sf_dir):
    t = triplets(spark, sf_dir)
    return graph.read_by_ids(t, graph.shared(t, supplier_pairs(spark, sf_dir))).select("t_id", "stringified")


@query(graph_sql("SELECT t_id, s_name, r_type, e_type FROM t WHERE lower(s_name) IN (SELECT lower(n_name) FROM nation) OR lower(e_name) IN (SELECT lower(n_name) FROM nation)"))
def g12_by_names(spark, sf_dir):
    return graph.by_names(triplets(spark, sf_dir), read(spark, sf_dir, "nation").select(F.lower("n_name").alias("name"))).select("t_id", "s_name", "r_type", "e_type")


@query(graph_sql("""SELECT what, x.type, coalesce(n, 0)::BIGINT n FROM (VALUES ('node','object'),('node','hyper'),('node','episodic'),('node','time'),('triplet','simple'),('triplet','hyper'),('triplet','episodic'),('triplet','time')) x(what, type)
 LEFT JOIN (SELECT 'node' w, type, count(*) n FROM nodes GROUP BY type UNION ALL SELECT 'triplet', r_type, count(*) FROM t GROUP BY r_type) y ON x.what = y.w AND x.type = y.type"""))  # fmt: skip
def g13_counts(spark, sf_dir):
    return graph.counts(triplets(spark, sf_dir))


@query(graph_sql("SELECT r_name name, EXISTS (SELECT 1 FROM nodes WHERE nodes.name = region.r_name AND type = 'object') found FROM region"))
def g14_exists(spark, sf_dir):
    n = graph.nodes(triplets(spark, sf_dir)).filter("type = 'object'").select("name", F.lit(True).alias("found"))
    return read(spark, sf_dir, "region").select(F.col("r_name").alias("name")).join(n, "name", "left").select("name", F.coalesce("found", F.lit(False)).alias("found"))


_HOPS = """, h(seed, b, hop, d) AS (SELECT 'object:' || md5(r_name), 'object:' || md5(r_name), 0, 0 FROM region
  UNION SELECT h.seed, e.b, h.hop + 1, h.d + 1 FROM h JOIN (SELECT DISTINCT a, b FROM u) e ON h.b = e.a WHERE h.hop < {n})
"""


@query(graph_sql("SELECT seed, b, min(hop)::INT hop FROM h GROUP BY seed, b", _HOPS.format(n=3)))
def t6_hop_distance(spark, sf_dir):
    seeds = read(spark, sf_dir, "region").select(F.concat(F.lit("object:"), F.md5("r_name")).alias("seed"))
    return graph.hops(triplets(spark, sf_dir), seeds, 3, saver(spark, "hops"))


@query(graph_sql("SELECT x.a, x.b, coalesce(h.hop, 1000001)::INT hop FROM (SELECT 'object:' || md5(r_name) a, 'object:' || md5(s_name) b FROM region, supplier) x LEFT JOIN (SELECT seed, b, min(hop) hop FROM h GROUP BY ALL) h ON h.seed = x.a AND h.b = x.b", _HOPS.format(n=2)))
def t6_pair_distance(spark, sf_dir):
    """Regions to suppliers, up to two edges; what is farther counts as unreachable."""
    r, s = read(spark, sf_dir, "region"), read(spark, sf_dir, "supplier")
    pairs = F.broadcast(r.select(F.concat(F.lit("object:"), F.md5("r_name")).alias("a"))).join(s.select(F.concat(F.lit("object:"), F.md5("s_name")).alias("b")))
    return graph.distances(triplets(spark, sf_dir), pairs, 2, saver(spark, "distances"))


@query(graph_sql("SELECT hop, count(*)::BIGINT n FROM (SELECT seed, b, min(hop)::INT hop FROM h GROUP BY seed, b) GROUP BY hop", _HOPS.format(n=4)))
def g16_path_lengths(spark, sf_dir):
    seeds = read(spark, sf_dir, "region").select(F.concat(F.lit("object:"), F.md5("r_name")).alias("seed"))
    return graph.hops(triplets(spark, sf_dir), seeds, 4, saver(spark, "paths")).groupBy("hop").agg(F.count("*").alias("n"))


@query(graph_sql("SELECT s_type, r_type, e_type, count(*)::BIGINT n FROM t GROUP BY ALL"))
def g17_health(spark, sf_dir):
    return graph.health(triplets(spark, sf_dir))


#: A second store that lacks vectors: of nodes whose id starts with 0, of relations whose id starts with 1.
_HELD = """, held AS (SELECT type, id FROM nodes WHERE id NOT LIKE '0%' UNION ALL SELECT DISTINCT 'triplet', r_id FROM t WHERE r_id NOT LIKE '1%'),
 have AS (SELECT type, id FROM nodes UNION ALL SELECT DISTINCT 'triplet', r_id FROM t), cov AS (SELECT coalesce(a.type, b.type) type, a.id g, b.id v FROM have a FULL JOIN held b ON a.type = b.type AND a.id = b.id)
"""


def held_vectors(spark, sf_dir):
    first = F.when(F.col("type") == "triplet", "1").otherwise("0")
    return graph_vectors(spark, sf_dir).select("type", "id").filter(F.substring("id", 1, 1) != first)


@query(graph_sql("SELECT c.type, CASE WHEN c.type = 'triplet' THEN (SELECT count(*) FROM t) ELSE n_graph END n_graph, n_vectors, CASE WHEN c.type = 'triplet' THEN n_vectors <= (SELECT count(*) FROM t) ELSE n_vectors = n_graph END consistent FROM (SELECT type, count(g) n_graph, count(v) n_vectors FROM cov GROUP BY type) c", _HELD))
def g18_consistency(spark, sf_dir):
    return graph.consistent(triplets(spark, sf_dir), held_vectors(spark, sf_dir))


@query(graph_sql("SELECT type, count(g) n_graph, count(v) n_vectors, count(*) FILTER (g IS NOT NULL AND v IS NOT NULL) matched, count(*) FILTER (v IS NULL) only_graph, count(*) FILTER (g IS NULL) only_vectors FROM cov GROUP BY type", _HELD))
def g23_coverage(spark, sf_dir):
    return graph.coverage(triplets(spark, sf_dir), held_vectors(spark, sf_dir))


@query(graph_sql("""SELECT source, relation, target, count(*) n_targets, min(n) "min", max(n) "max", round(avg(n), 3) mean, round(median(n)::DOUBLE, 3) median, round(stddev_pop(n), 3) std FROM (SELECT source, relation, target, b, count(DISTINCT a) n FROM pairs GROUP BY ALL) GROUP BY source, relation, target""",
                 ", p0 AS (SELECT DISTINCT split_part(a, ':', 1) source, a, r_type relation, b_type target, b FROM u), pairs AS (SELECT * FROM p0 UNION SELECT 'any', a, 'any', 'any', b FROM p0)\n"))
def g20_neighbour_counts(spark, sf_dir):
    return graph.neighbour_counts(triplets(spark, sf_dir))


@query(graph_sql("""SELECT unnest(['edges_per_node', 'episodic_per_hyper', 'objects_per_episodic', 'objects_per_hyper']) ratio, unnest([round(e / n, 3), round(ep / hy, 3), round(ob / ep, 3), round(ob / hy, 3)]) AS "value"
 FROM (SELECT (SELECT count(*) FROM t)::DOUBLE e, count(*)::DOUBLE n, (count(*) FILTER (type = 'episodic'))::DOUBLE ep, (count(*) FILTER (type = 'hyper'))::DOUBLE hy, (count(*) FILTER (type = 'object'))::DOUBLE ob FROM nodes)"""))  # fmt: skip
def g20_ratios(spark, sf_dir):
    return graph.node_ratios(triplets(spark, sf_dir))


@query()
def g21_components(spark, sf_dir):
    return graph.component_sizes(triplets(spark, sf_dir), saver(spark, "components"))


@query(graph_sql("""SELECT what, type, count(*) n, min(x) "min", max(x) "max", round(avg(x), 3) mean, round(median(x)::DOUBLE, 3) median, round(stddev_pop(x), 3) std FROM (SELECT 'node' what, type, length(name)::INT x FROM nodes UNION ALL SELECT 'relation', r_type, length(stringified)::INT FROM (SELECT DISTINCT r_type, r_id, stringified FROM t)) GROUP BY what, type"""))
def g22_text_lengths(spark, sf_dir):
    return graph.text_lengths(triplets(spark, sf_dir))


@query(graph_sql("SELECT r_id id, count(*) n FROM t WHERE r_id IN (SELECT md5(text) FROM benchmark) GROUP BY r_id"))
def g13_copies(spark, sf_dir):
    return graph.copies(triplets(spark, sf_dir), "relation", read(spark, sf_dir, "benchmark").select(F.md5("text").alias("id")))


@query(graph_sql("SELECT t_id, s_name, e_name FROM t WHERE r_type = 'simple' AND r_name = 'based in'"))
def g7_relations_by_name(spark, sf_dir):
    return graph.relations_by_name(triplets(spark, sf_dir), "simple", "based in").select("t_id", "s_name", "e_name")


@query(graph_sql("SELECT type, count(*) n FROM nodes WHERE type || ':' || id NOT IN (SELECT s_type || ':' || s_id FROM t WHERE r_name = 'lives in') GROUP BY type UNION ALL SELECT 'triplet', count(*) FROM t WHERE r_name <> 'lives in'"))
def g5_delete_with_info(spark, sf_dir):
    """Customers go with their triplets; nations are flagged to stay."""
    t = triplets(spark, sf_dir)
    gone = t.filter("r_name = 'lives in'").select("t_id", F.lit(True).alias("s_node"), F.lit(False).alias("e_node"))
    n, left = graph.delete_with_info(graph.nodes(t), t, gone)
    return n.groupBy("type").agg(F.count("*").alias("n")).union(left.agg(F.lit("triplet"), F.count("*")))


@query(graph_sql("SELECT 'node' what, type, count(*) n FROM ln2 GROUP BY type UNION ALL SELECT 'vector', type, count(*) FROM ln2 GROUP BY type UNION ALL SELECT 'vector', 'triplet', count(DISTINCT r_id) FROM l",
                 ", l AS (SELECT * FROM t WHERE r_name <> 'supplied by'), ln2 AS (SELECT s_type type, s_id id FROM l UNION SELECT e_type, e_id FROM l)\n"))
def g19_add_and_remove(spark, sf_dir):
    """All triplets are added twice, with their vectors, and those of supplied parts removed again."""
    t = triplets(spark, sf_dir)
    store = knowledge.Knowledge(spark, new_root(spark, "knowledge"), hashed)
    store.add(t)
    store.add(t.filter("r_type = 'simple'"))
    store.remove(t.filter("r_name = 'supplied by'").select("t_id"))
    n = graph.nodes(store.triplets.read()).groupBy(F.lit("node").alias("what"), "type").agg(F.count("*").alias("n"))
    return n.union(store.vectors.read().groupBy(F.lit("vector").alias("what"), "type").agg(F.count("*").alias("n")))


# traversal
def nation_seeds(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(F.concat(F.lit("object:"), F.md5("n_name")).alias("seed"))


def question_nodes(spark, sf_dir):
    """(query_id, seed): a question's nation, and that seven numbers on."""
    n = read(spark, sf_dir, "nation")
    both = n.select(F.col("n_nationkey").alias("query_id"), "n_name").union(n.select(F.pmod(F.col("n_nationkey") - 7, F.lit(25)), "n_name"))
    return both.select("query_id", F.concat(F.lit("object:"), F.md5("n_name")).alias("seed"))


@query()
def t2_bfs(spark, sf_dir):
    return graph.bfs(triplets(spark, sf_dir), nation_seeds(spark, sf_dir), 3, 10, saver(spark, "bfs"))


@query()
def t3_beam(spark, sf_dir):
    t, q = triplets(spark, sf_dir), questions(spark, sf_dir)
    seeds = question_nodes(spark, sf_dir).select(F.concat_ws("|", F.col("query_id").cast("string"), "seed").alias("seed"), F.col("seed").alias("start"))
    found = graph.beam(t, seeds, retrievers.similarity(graph_vectors(spark, sf_dir), q), 3, 10, 0.75, saver(spark, "beam"), 0.1, False, False)
    return found.select("seed", F.concat_ws(",", "t_ids").alias("t_ids"), F.round("cost", 6).alias("cost"), "ended")


@query()
def t4_astar(spark, sf_dir):
    """Paths between each question's nations over the whole graph, by the similarity heuristic, 25 neighbours of a node at most."""
    t = triplets(spark, sf_dir)
    v = graph_vectors(spark, sf_dir).filter("type <> 'triplet'").select(F.col("key").alias("id"), "embedding")
    pairs = astar.seed_pairs(question_nodes(spark, sf_dir))
    paths = astar.astar(graph.undirected(t).select("a", "b").distinct(), pairs, saver(spark, "astar"), v, "ip")
    return paths.select("start", "goal", F.concat_ws(",", "path").alias("path"))


_TWO = "SELECT n_nationkey query_id, 'object:' || md5(n_name) seed FROM nation UNION ALL SELECT (n_nationkey + 18) % 25, 'object:' || md5(n_name) FROM nation"


@query(graph_sql("""SELECT a.query_id, x.a AS node, round(CASE WHEN x.a = 'object:' || md5(m.n_name) THEN 0 ELSE 1 - list_inner_product(e.emb, g.emb) END, 6) h FROM two a JOIN u x ON x.b = a.seed JOIN nation m ON m.n_nationkey = (a.query_id + 7) % 25 JOIN e ON e.key = x.a JOIN e g ON g.key = 'object:' || md5(m.n_name) WHERE x.r_type = 'simple' GROUP BY ALL""",
                 f", two AS ({_TWO}), {embed_sql('e', 'SELECT type || chr(58) || id AS key, name AS text FROM nodes')}\n"))
def t5_heuristic(spark, sf_dir):
    """Distance by vectors of the neighbours of a question's nodes to its second nation."""
    n = read(spark, sf_dir, "nation").select(F.pmod(F.col("n_nationkey") - 7, F.lit(25)).alias("query_id"), F.concat(F.lit("object:"), F.md5("n_name")).alias("goal"))
    near = graph.undirected(triplets(spark, sf_dir)).filter("r_type = 'simple'").select(F.col("a").alias("node"), F.col("b").alias("seed"))
    rows = question_nodes(spark, sf_dir).join(near, "seed").select("query_id", "node").distinct().join(n, "query_id")
    v = graph_vectors(spark, sf_dir).select("key", "embedding")
    rows = rows.join(v.select(F.col("key").alias("node"), F.col("embedding").alias("va")), "node").join(v.select(F.col("key").alias("goal"), F.col("embedding").alias("vb")), "goal")
    return rows.select("query_id", "node", F.round(astar.heuristic("ip", astar.apart("node", "goal", "va", "vb"), F.lit(0.0), F.lit(0)), 6).alias("h"))


@query(graph_sql("""SELECT query_id, node FROM (SELECT query_id, b node, row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(e.emb, g.emb), 9) DESC, b) r FROM (SELECT DISTINCT n_nationkey query_id, b, 'object:' || md5(n_name) goal FROM u JOIN nation ON u.a = 'object:' || md5(n_name)) x JOIN e ON e.key = x.b JOIN e g ON g.key = x.goal) WHERE r <= 25""",
                 f", {embed_sql('e', 'SELECT type || chr(58) || id AS key, name AS text FROM nodes')}\n"))
def t8_capped_adjacency(spark, sf_dir):
    """The 25 neighbours of each nation that are most similar to it."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("object:"), F.md5("n_name")).alias("a"))
    v = graph_vectors(spark, sf_dir).select("key", "embedding")
    near = graph.undirected(triplets(spark, sf_dir)).select("a", "b").distinct().join(n, "a").join(v.select(F.col("key").alias("b"), F.col("embedding").alias("vb")), "b").join(v.select(F.col("key").alias("a"), F.col("embedding").alias("va")), "a")
    return astar.closest(near.withColumn("score", F.round(dot("vb", "va"), 9)), ["query_id"], "score", 25).select("query_id", F.col("b").alias("node"))


# retrievers over the whole graph
_FUSE = """, fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, f, id) AS rank FROM (SELECT query_id, id, sum(w / (rank + 60)) score, min(list * 1000000 + rank) f FROM
 (SELECT query_id, id, rank, 0 list, 0.7::DOUBLE w FROM dense WHERE rank <= 50 UNION ALL SELECT query_id, id, rank, 1, 0.3::DOUBLE FROM bm WHERE rank <= 50) GROUP BY ALL))
"""


@query(retrieval_sql("SELECT query_id, t_id, r_type, id r_id FROM fused JOIN rel USING (id) WHERE rank <= 25", _FUSE))
def t1_naive(spark, sf_dir):
    return retrievers.naive(triplets(spark, sf_dir), graph_vectors(spark, sf_dir), questions(spark, sf_dir))


@query(retrieval_sql("""SELECT query_id, max(t_id) t_id, r_type, r_id FROM (SELECT query_id, t_id, r_type, id r_id FROM fused JOIN rel USING (id) WHERE rank <= 25 UNION
 SELECT n_nationkey, min(t_id), r_type, r_id FROM u JOIN nation ON a = 'object:' || md5(n_name) WHERE r_type IN ('simple', 'hyper') GROUP BY n_nationkey, r_type, r_id) GROUP BY query_id, r_type, r_id""", _FUSE))  # fmt: skip
def t14_mixture(spark, sf_dir):
    """The naive retriever and the simple and hyper triplets of the question's nation."""
    return retrievers.mixture(retrievers.naive(triplets(spark, sf_dir), graph_vectors(spark, sf_dir), questions(spark, sf_dir)), around(spark, sf_dir))


def around(spark, sf_dir, kinds=("simple", "hyper")):
    """(query_id, t_id, r_type, r_id): triplets at the question's nation."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("object:"), F.md5("n_name")).alias("a"))
    u = graph.undirected(triplets(spark, sf_dir)).filter(F.col("r_type").isin(*kinds))
    return retrievers.once(n.join(u, "a").select("query_id", "t_id", "r_type", "r_id"))


#: At each nation all its triplets; kept are simple and hyper ones, or the best 25 of them.
_AROUND = """, near AS (SELECT n_nationkey query_id, r_type, r_id id, min(t_id) t_id FROM u JOIN nation ON a = 'object:' || md5(n_name) WHERE r_type IN ('simple', 'hyper') GROUP BY ALL),
 n_near AS (SELECT query_id, count(*) n FROM near GROUP BY query_id),
 d2 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM dense JOIN near USING (query_id, id)), b2 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm JOIN near USING (query_id, id)),
 f2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, f, id) AS rank FROM (SELECT query_id, id, sum(w / (rank + 60)) score, min(list * 1000000 + rank) f FROM (SELECT query_id, id, rank, 0 list, 0.7::DOUBLE w FROM d2 WHERE rank <= 50 UNION ALL SELECT query_id, id, rank, 1, 0.3::DOUBLE FROM b2 WHERE rank <= 50) GROUP BY ALL)),
 kept AS (SELECT near.* FROM near JOIN n_near USING (query_id) LEFT JOIN (SELECT * FROM f2 WHERE rank <= 25) f USING (query_id, id) WHERE n <= 25 OR f.id IS NOT NULL)
"""


@query(retrieval_sql("SELECT query_id, t_id, r_type, id r_id FROM kept", _AROUND))
def t15_filter(spark, sf_dir):
    found = around(spark, sf_dir, ("simple", "hyper", "episodic"))
    return retrievers.filtered(found, graph_vectors(spark, sf_dir), questions(spark, sf_dir))


@query(retrieval_sql("SELECT n_nationkey query_id, CASE WHEN n IS NULL THEN 'zero_retrieved_triplets' ELSE 'success' END status, coalesce(n, 0) n, coalesce(t_ids, '') t_ids FROM nation LEFT JOIN (SELECT query_id, count(*) n, string_agg(t_id, ',' ORDER BY t_id) t_ids FROM kept WHERE query_id % 5 > 0 GROUP BY query_id) ON query_id = n_nationkey", _AROUND))
def t16_knowledge_retriever(spark, sf_dir):
    """The filtered triplets around each question's nation; every fifth question has a traversal that finds nothing."""
    q, v = questions(spark, sf_dir), graph_vectors(spark, sf_dir)
    found = around(spark, sf_dir, ("simple", "hyper", "episodic")).filter("query_id % 5 > 0")
    return retrievers.retrieve(q, found, lambda x: retrievers.filtered(x, v, q)).withColumn("t_ids", F.concat_ws(",", "t_ids"))


@query(graph_sql("SELECT t_id, r_type <> 'hyper' in_graph, r_id NOT LIKE '1%' in_vectors FROM t WHERE r_type IN ('simple', 'hyper')"))
def t17_validity(spark, sf_dir):
    t = triplets(spark, sf_dir)
    return retrievers.validity(t.filter("r_type in ('simple', 'hyper')"), t.filter("r_type <> 'hyper'"), held_vectors(spark, sf_dir))


_SCORED = "sc AS (SELECT query_id, id r_id, score FROM dense)"


@query(retrieval_sql("""SELECT query_id, id, round(score, 6) score, rank FROM (SELECT query_id, r_id id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, r_id) AS rank FROM
 (SELECT query_id, r_id, max(score) score FROM (SELECT * FROM e1 WHERE r <= 5 UNION ALL SELECT * FROM e2 WHERE r <= 5) GROUP BY query_id, r_id)) WHERE rank <= 25""",
    f""", {_SCORED}, two AS ({_TWO}), l1 AS (SELECT query_id, x.a, CAST(NULL AS VARCHAR) prev, r_id, max(x.b) b, max(score) score FROM two JOIN u x ON x.a = seed JOIN sc USING (query_id, r_id) GROUP BY query_id, x.a, r_id),
 e1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, a ORDER BY round(score, 9) DESC, r_id) r FROM l1), f1 AS (SELECT DISTINCT query_id, b a, a prev FROM e1 WHERE r <= 3),
 l2 AS (SELECT f1.query_id, f1.a, f1.prev, x.r_id, max(x.b) b, max(score) score FROM f1 JOIN u x ON x.a = f1.a AND x.b <> f1.prev JOIN sc ON sc.query_id = f1.query_id AND sc.r_id = x.r_id GROUP BY f1.query_id, f1.a, f1.prev, x.r_id),
 e2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, a, prev ORDER BY round(score, 9) DESC, r_id) r FROM l2)
"""))  # fmt: skip
def t18_explore(spark, sf_dir):
    found = retrievers.explore(triplets(spark, sf_dir), graph_vectors(spark, sf_dir), questions(spark, sf_dir), question_nodes(spark, sf_dir), saver(spark, "explore"))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(graph_sql("SELECT DISTINCT seed, 'forward' direction, t_id, e_name other FROM t JOIN f ON lower(s_name) = n WHERE s_type = 'object' AND e_type = 'object' UNION SELECT seed, 'backward', t_id, s_name FROM t JOIN f ON lower(e_name) = n WHERE s_type = 'object' AND e_type = 'object'", ", f AS (SELECT replace(n_name, '_', ' ') seed, lower(unnest([replace(n_name, '_', ' '), replace(n_name, ' ', '_')])) n FROM nation)\n"))
def t9_name_expansion(spark, sf_dir):
    seeds = read(spark, sf_dir, "nation").select(F.translate("n_name", "_", " ").alias("seed"))
    return graph.expand_by_names(triplets(spark, sf_dir), seeds)


# dense retrieval
_DOT = "list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_V5 = f"SELECT query_id, id, score, rank FROM (SELECT q.vec_id query_id, v.vec_id id, round({_DOT}, 6) score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 10"


def vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def asked_vectors(spark, sf_dir):
    """The stated query set: every vector whose id is divisible by 100, against all."""
    return vectors(spark, sf_dir).filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))


@query(_V5)
def v5_topk(spark, sf_dir):
    return retrieval.dense_topk(vectors(spark, sf_dir), asked_vectors(spark, sf_dir), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(_V5.replace("WHERE q.vec_id % 100 = 0", "WHERE q.vec_id % 100 = 0 AND v.vec_id % 3 = q.vec_id % 3"))
def v5_topk_subset(spark, sf_dir):
    third = lambda c: (F.col(c) % 3).alias("third")
    v, q = vectors(spark, sf_dir).select("id", "embedding", third("id")), asked_vectors(spark, sf_dir).select("query_id", "q", third("query_id"))
    return retrieval.dense_topk(v, q, 10, same="third").select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("SELECT label, count(*)::BIGINT n FROM embeddings GROUP BY label")
def v7_count(spark, sf_dir):
    return vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query(_V5)
def v9_multi_collection(spark, sf_dir):
    v, q = vectors(spark, sf_dir), asked_vectors(spark, sf_dir)
    parts = [retrieval.dense_topk(v.filter(F.col("label") % 2 == i), q, 10) for i in (0, 1)]
    return retrieval.multi_collection(parts, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("SELECT vec_id id, label + 100 label FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id % 2 = 1")
def v3_upsert(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", "label")
    return memory.upsert(v, v.filter("id % 2 = 0").withColumn("label", F.col("label") + 100), "id")


@query("SELECT vec_id id, label FROM embeddings WHERE vec_id % 2 = 1")
def v4_delete(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", "label")
    return v.join(v.filter("id % 2 = 0").select("id"), "id", "left_anti")


@query("SELECT vec_id id, label FROM embeddings")
def v1_create(spark, sf_dir):
    """Half of the rows, then all, the known ones with other labels: these are skipped."""
    store = Store(spark, new_root(spark, "vectors"), "v", "id")
    v = vectors(spark, sf_dir)
    store.create(v.filter("id % 2 = 0"))
    store.create(v.withColumn("label", F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("label")).cast("int")))
    return store.read().select("id", "label")


@query("SELECT vec_id id, label FROM embeddings WHERE vec_id % 100 = 0")
def v2_read_by_ids(spark, sf_dir):
    """The ids of the stated query set."""
    v = vectors(spark, sf_dir)
    return VectorIndex.project(v.join(asked_vectors(spark, sf_dir).select(F.col("query_id").alias("id")), "id", "left_semi"), ["label"])


@query("SELECT label, n, n AS n_second, n AS n_third FROM (SELECT label, count(*)::BIGINT n FROM embeddings WHERE vec_id % 4 <> 1 GROUP BY label)")
def v8_composer(spark, sf_dir):
    """Three indexes over one set of items: rows are added to all, changed in all, deleted from all."""
    root, v = new_root(spark, "composer"), vectors(spark, sf_dir)
    every = Composer({n: Store(spark, root, n, "id") for n in ("first", "second", "third")})
    every.create(v)
    every.upsert(v.filter("id % 4 = 2"))
    every.delete(v.filter("id % 4 = 1").select("id"))
    n = lambda name, into: every.read(name).groupBy("label").agg(F.count("*").alias(into))
    return n("first", "n").join(n("second", "n_second"), "label").join(n("third", "n_third"), "label")


@query("SELECT vec_id id, vec_id % 2 = 0 found FROM embeddings")
def v7_exist(spark, sf_dir):
    store = Store(spark, new_root(spark, "exist"), "v", "id")
    v = vectors(spark, sf_dir).select("id", "label")
    store.create(v.filter("id % 2 = 0"))
    return store.exist(v)


@query(graph_sql("SELECT type, count(*) n, round(sum(list_sum(emb)), 4) total FROM e GROUP BY type", f", {embed_sql('e', 'SELECT type, name AS text FROM nodes UNION ALL SELECT DISTINCT chr(116) || chr(114) || chr(105) || chr(112) || chr(108) || chr(101) || chr(116), stringified FROM t')}\n"))
def v11_embeddings(spark, sf_dir):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return graph_vectors(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.round(F.sum(total), 4).alias("total"))


@query(graph_sql("SELECT type, count(*) n FROM (SELECT type, id FROM nodes WHERE type || ':' || id NOT IN (SELECT s_type || ':' || s_id FROM t WHERE r_name = 'lives in') UNION ALL SELECT DISTINCT 'triplet', r_id FROM t WHERE r_name <> 'lives in') GROUP BY type"))
def v12_delete_embeddings(spark, sf_dir):
    """Vectors that are left when customers' triplets go."""
    t = triplets(spark, sf_dir)
    gone = knowledge.obsolete_vectors(t, t.filter("r_name = 'lives in'").select("t_id"))
    return graph_vectors(spark, sf_dir).join(gone, "key", "left_anti").groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey query_id, n_name || ' in region' AS text, 1.0::DOUBLE AS length FROM nation")
def v10_embed(spark, sf_dir):
    """A model called in batches on prefixed texts; its vectors come out with length 1."""
    q = questions(spark, sf_dir).select("query_id", "text")
    made = embeddings.encode(q, "text", "query", lambda texts: [[float(len(t)), float(t.startswith("query: "))] for t in texts])
    return made.select("query_id", "text", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 9).alias("length"))


# lexical retrieval
_DOCS, _ITEMS = "SELECT doc_id id, text FROM documents", "SELECT item_id query_id, text FROM benchmark"
_BM25 = "WITH " + bm25_sql(_DOCS, _ITEMS) + " "


def documents(spark, sf_dir):
    return spread(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def items(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(_BM25 + "SELECT query_id, id, round(score, 5) score, rank FROM bm WHERE rank <= 10")
def b3_bm25_topk(spark, sf_dir):
    return retrieval.bm25(documents(spark, sf_dir), items(spark, sf_dir), 10).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


@query(_BM25 + "SELECT query_id, id, round(1 / (1 + exp(-score / 8)), 5) score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (1 + exp(-score / 8)), 9) DESC, id) r FROM bm WHERE id % 10 = query_id % 10) WHERE r <= 5")
def b3_subset_and_scale(spark, sf_dir):
    docs, asked = documents(spark, sf_dir), items(spark, sf_dir)
    subset = asked.select("query_id", (F.col("query_id") % 10).alias("m")).join(docs.select("id", (F.col("id") % 10).alias("m")), "m").select("query_id", "id")
    return retrieval.bm25(docs, asked, 5, subset, True).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


def lexical_store(spark, sf_dir):
    """Documents of odd ids, then all (known ones are skipped), then without every seventh; one in five changed."""
    def fill(root):
        index, docs = LexicalIndex(spark, root), documents(spark, sf_dir)
        index.create(docs.filter("id % 2 = 1"))
        index.create(docs)
        index.upsert(docs.filter("id % 5 = 0").withColumn("text", F.concat("text", F.lit(" changed anew"))))
        index.delete(docs.filter("id % 7 = 0").select("id"))
        return index

    key = spark.sparkContext.applicationId, sf_dir
    if key not in _INDEXES:
        _INDEXES[key] = fill(new_root(spark, "lexical"))
    return _INDEXES[key]


_INDEXES: dict = {}
_LIVE = "SELECT doc_id id, CASE WHEN doc_id % 5 = 0 THEN text || ' changed anew' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0"


@query("WITH " + bm25_sql(_LIVE, _ITEMS) + " SELECT query_id, id, round(score, 5) score, rank FROM bm WHERE rank <= 10")
def b1_stored_postings(spark, sf_dir):
    return lexical_store(spark, sf_dir).retrieve(items(spark, sf_dir), 10).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


@query(f"SELECT id, md5(text) hash FROM ({_LIVE})")
def b2_read_by_ids(spark, sf_dir):
    return lexical_store(spark, sf_dir).read(documents(spark, sf_dir).select("id")).select("id", F.md5("text").alias("hash"))


@query(f"SELECT doc_id id, doc_id % 7 <> 0 found, (SELECT count(*) FROM ({_LIVE})) n FROM documents")
def b5_count_and_exist(spark, sf_dir):
    index = lexical_store(spark, sf_dir)
    return index.exist(documents(spark, sf_dir)).withColumn("n", F.lit(index.count()).cast("long"))


@query(_BM25 + """, hits AS (SELECT query_id, id, score FROM bm WHERE rank <= 5 AND score >= 12), sub AS (SELECT item_id query_id, doc_id id FROM benchmark JOIN documents ON doc_id % 50 = item_id % 50),
 h2 AS (SELECT hits.* FROM hits SEMI JOIN sub USING (query_id, id)), e AS (SELECT *, 0 late FROM h2 UNION ALL SELECT query_id, id, 0.5, 1 FROM sub ANTI JOIN h2 USING (query_id, id))
 SELECT query_id, id, round(score::DOUBLE, 5) score, row_number() OVER (PARTITION BY query_id ORDER BY late, CASE WHEN late = 0 THEN -round(score::DOUBLE, 5) ELSE 0 END, id) AS rank FROM e QUALIFY rank <= 8""")  # fmt: skip
def b4_backfill(spark, sf_dir):
    """Hits among a fiftieth of the documents, filled up with others of these."""
    docs, asked = documents(spark, sf_dir), items(spark, sf_dir)
    subset = asked.select("query_id", (F.col("query_id") % 50).alias("m")).join(docs.select("id", (F.col("id") % 50).alias("m")), "m").select("query_id", "id")
    hits = retrieval.bm25(docs, asked, 5).filter("score >= 12").join(subset, ["query_id", "id"], "left_semi").select("query_id", "id", F.round("score", 5).alias("score"))
    return retrieval.backfill(hits, subset, 8).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


# re-ranking over the graph's relations, by their vectors and their words
def relations(spark, sf_dir):
    return graph_vectors(spark, sf_dir).filter("type = 'triplet'").select("id", "text", "embedding")


_RANK = "SELECT query_id, id, round(score, {n}) score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) r FROM {rows}) WHERE r <= {k}"


@query(retrieval_sql(_RANK.format(n=6, rows="(SELECT * FROM dense WHERE rank <= 50 AND score >= 0.6)", k=10)))
def r1_single_step(spark, sf_dir):
    found = retrievers.ranked_by(relations(spark, sf_dir), questions(spark, sf_dir), "single_step", {"steps": [{"index": "dense", "fetch": 50, "threshold": 0.6}]}, 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(retrieval_sql(_RANK.format(n=6, rows="(SELECT dense.* FROM dense SEMI JOIN (SELECT query_id, id FROM bm WHERE rank <= 40) USING (query_id, id))", k=5)))
def r2_multi_step(spark, sf_dir):
    """The 40 best by words, of these the 5 best by vectors."""
    steps = {"steps": [{"index": "bm25", "fetch": 40, "threshold": None}, {"index": "dense", "fetch": 5, "threshold": None}]}
    return retrievers.ranked_by(relations(spark, sf_dir), questions(spark, sf_dir), "multi_step", steps, 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(retrieval_sql("SELECT query_id, id, round(score, 9) score, rank FROM fused WHERE rank <= 10", _FUSE))
def r3_weighted_rrf(spark, sf_dir):
    found = retrievers.ranked_by(relations(spark, sf_dir), questions(spark, sf_dir), "ensemble_fusion", retrievers.ensemble(), 10)
    return found.select("query_id", "id", F.round("score", 9).alias("score"), "rank")


_CUTS = " UNION ALL ".join(
    f"""SELECT unnest(['precision', 'recall', 'f1', 'map']) metric, {k} k, round(unnest([avg(h / {k}), avg(h / all_n), avg(CASE WHEN h > 0 THEN 2 * (h / {k}) * (h / all_n) / (h / {k} + h / all_n) ELSE 0 END), avg(ap / all_n)]), 5) AS value
 FROM (SELECT total.query_id, all_n::DOUBLE all_n, coalesce(h, 0)::DOUBLE h, coalesce(ap, 0) ap FROM total LEFT JOIN (SELECT query_id, count(*) h, sum(nth / rank) ap FROM hits WHERE rank <= {k} GROUP BY query_id) x USING (query_id))"""
    for k in (3, 5, 8, 10)
)


@query(f"""WITH rel AS (SELECT q.vec_id query_id, v.vec_id id FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0), total AS (SELECT query_id, count(*) all_n FROM rel GROUP BY query_id),
 hits AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank)::DOUBLE nth FROM ({_V5}) JOIN rel USING (query_id, id)) {_CUTS}""")  # fmt: skip
def e1_ir_metrics(spark, sf_dir):
    """Relevant are the other vectors of a query's label: they are counted by label, and only hits are looked up."""
    v = vectors(spark, sf_dir)
    labels = v.select("id", "label")
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("all"))
    total = labels.filter("id % 100 = 0").join(sizes, "label").filter(F.col("all") > 0).select(F.col("id").alias("query_id"), "all")
    run = retrieval.dense_topk(v, asked_vectors(spark, sf_dir), 10)
    run = run.join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return retrieval.ir_metrics(run.select("query_id", "id", "rank", ((F.col("label") == F.col("own")) & (F.col("id") != F.col("query_id"))).alias("hit")), total, [3, 5, 8, 10])


# provenance and memory
_LINKS = "SELECT doc_id text_id, md5(n_name || md5(text)) t_id FROM documents JOIN nation ON doc_id % 25 = n_nationkey UNION SELECT doc_id, md5(lang || source) FROM documents"


def links(spark, sf_dir):
    d, n = read(spark, sf_dir, "documents"), read(spark, sf_dir, "nation")
    one = d.join(n, F.col("doc_id") % 25 == F.col("n_nationkey")).select(F.col("doc_id").alias("text_id"), F.md5(F.concat("n_name", F.md5("text"))).alias("t_id"))
    return one.union(d.select("doc_id", F.md5(F.concat("lang", "source")))).distinct()


@query(f"WITH l AS ({_LINKS}) SELECT text_id, count(*)::BIGINT n, min(t_id) first_id FROM l GROUP BY text_id")
def m13_provenance(spark, sf_dir):
    return links(spark, sf_dir).groupBy("text_id").agg(F.count("*").alias("n"), F.min("t_id").alias("first_id"))


@query(f"WITH l AS ({_LINKS}) SELECT text_id, t_id FROM l WHERE text_id % 5 = 0 AND t_id IN (SELECT t_id FROM l GROUP BY t_id HAVING count(DISTINCT text_id) = 1)")
def m15_refcount_delete(spark, sf_dir):
    x = links(spark, sf_dir)
    return memory.deletable(x, x.filter("text_id % 5 = 0")).select("text_id", "t_id")


@query(f"WITH l AS ({_LINKS}) SELECT t_id, CASE WHEN max((text_id % 5 <> 0)::INT) = 1 THEN 'updated' ELSE 'deleted' END state FROM l GROUP BY t_id HAVING max((text_id % 5 = 0)::INT) = 1")
def m16_clear_text(spark, sf_dir):
    x = links(spark, sf_dir)
    return memory.clear_texts(x, x.filter("text_id % 5 = 0"))


_FACTS = "SELECT md5(text) episode, source entity, lang || ' is written in ' || source thesis, lang AS \"time\" FROM documents"


@query(f"""WITH f AS ({_FACTS}) SELECT s_type, r_type, e_type, count(*)::BIGINT n FROM (SELECT 'object' s_type, entity s, 'hyper' r_type, 'hyper' e_type, thesis e FROM f UNION SELECT 'object', entity, 'episodic', 'episodic', episode FROM f
 UNION SELECT 'hyper', thesis, 'episodic', 'episodic', episode FROM f UNION SELECT 'time', "time", 'time', 'episodic', episode FROM f UNION SELECT 'time', "time", 'time', 'hyper', thesis FROM f) GROUP BY ALL""")  # fmt: skip
def m5_derive(spark, sf_dir):
    return graph.health(graph.triplets(memory.derive(facts(spark, sf_dir))))


def facts(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(F.md5("text").alias("episode"), F.col("source").alias("entity"), F.concat("lang", F.lit(" is written in "), "source").alias("thesis"), F.col("lang").alias("time"))


@query("""WITH e AS (SELECT DISTINCT source s, md5(text) ep, lang || ' of ' || source th, doc_id % 2 told FROM documents) SELECT kind, count(*)::BIGINT n FROM (
 SELECT DISTINCT 'object' kind, s, ep FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.told = 0 AND y.s = x.s AND y.ep = x.ep) UNION ALL
 SELECT DISTINCT 'hyper', th, ep FROM e x WHERE told = 1 AND NOT EXISTS (SELECT 1 FROM e y WHERE y.told = 0 AND y.th = x.th)) GROUP BY kind""")  # fmt: skip
def m9_obsolete_episodic(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", F.md5("text").alias("ep"), F.concat("lang", F.lit(" of "), "source").alias("th"), (F.col("doc_id") % 2).alias("told"))
    row = lambda df, st, s, rt, e: df.select(F.lit(st).alias("s_type"), F.col(s).alias("s_name"), F.lit(rt).alias("r_type"), F.lit(rt).alias("r_name"), F.lit(rt).alias("e_type"), F.col(e).alias("e_name"))
    rows = row(d, "object", "source", "episodic", "ep").union(row(d.filter("told = 0"), "object", "source", "hyper", "th")).union(row(d, "hyper", "th", "episodic", "ep"))
    return memory.obsolete_episodic(graph.triplets(rows.distinct())).groupBy("kind").agg(F.count("*").alias("n"))


# key-value and tables
_KV = "SELECT event_id id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, user_id score FROM events"


def kv(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.col("user_id").alias("score"))


@query(f"WITH kv AS ({_KV}) SELECT e.event_id + 5 pos, 2 * e.event_id id, kv.value FROM events e LEFT JOIN kv ON kv.id = 2 * e.event_id")
def k2_read_positional(spark, sf_dir):
    asked = read(spark, sf_dir, "events").select((F.col("event_id") + 5).alias("pos"), (2 * F.col("event_id")).alias("id"))
    return memory.read_positional(kv(spark, sf_dir), asked)


@query(f"WITH kv AS ({_KV}) SELECT id, score FROM (SELECT *, row_number() OVER (ORDER BY score, id) r FROM kv) WHERE r > 100")
def k4_evict(spark, sf_dir):
    return memory.evict(kv(spark, sf_dir), 100).select("id", "score")


@query(f"WITH kv AS ({_KV}) SELECT e.event_id pos, e.event_id id, kv.value, e.event_id % 3 = 0 AND kv.value IS NOT NULL hit FROM events e JOIN kv ON kv.id = e.event_id")
def k5_two_tier(spark, sf_dir):
    x = kv(spark, sf_dir)
    return memory.two_tier(x.filter("id % 3 = 0"), x, x.select(F.col("id").alias("pos"), "id"))


@query("SELECT event_id id, sha1(sha1(event_type) || sha1(props)) AS key FROM events")
def k6_cache_key(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), ids.cache_key(F.array("event_type", "props")).alias("key"))


_STAT = "SELECT '{c}' AS column, count(*)::BIGINT n, count({x})::BIGINT n_not_null, round(min({x})::DOUBLE, 3) AS min, round(max({x})::DOUBLE, 3) AS max, round(sum({x})::DOUBLE, 3) AS sum, round(avg({x}), 3) AS mean, round(stddev_pop({x}), 3) AS std, round(median({x})::DOUBLE, 3) AS median FROM {t}"


@query(f"WITH kv AS ({_KV}) " + _STAT.format(c="value", x="value", t="kv") + " UNION ALL " + _STAT.format(c="score", x="score", t="kv"))
def tb6_statistics(spark, sf_dir):
    return memory.statistics(kv(spark, sf_dir), ["value", "score"])


@query(_STAT.format(c="n_chars", x="length(text)", t="documents"))
def d4_corpus_statistics(spark, sf_dir):
    return memory.statistics(read(spark, sf_dir, "documents").select(F.length("text").alias("n_chars")), ["n_chars"])


# trees: region > nation > supplier
_TREE = "tree AS (SELECT 'r' || n_regionkey parent, 'n' || n_nationkey child FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"


def tree(spark, sf_dir):
    n, s = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    x = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return n.select(x("r", "n_regionkey").alias("parent"), x("n", "n_nationkey").alias("child")).union(s.select(x("n", "s_nationkey"), x("s", "s_suppkey")))


@query(f"WITH RECURSIVE {_TREE}, d(root, node) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region UNION ALL SELECT root, child FROM d JOIN tree ON node = parent) SELECT root, node leaf FROM d WHERE node NOT IN (SELECT parent FROM tree)")
def tr5_leaf_descendants(spark, sf_dir):
    roots = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))
    return memory.leaf_descendants(tree(spark, sf_dir), roots, 3)


@query(f"WITH {_TREE} SELECT parent, count(*)::BIGINT n FROM tree GROUP BY parent")
def tr6_children(spark, sf_dir):
    return tree(spark, sf_dir).groupBy("parent").agg(F.count("*").alias("n"))


@query(f"""WITH {_TREE}, n AS (SELECT count(DISTINCT parent) n_inner, count(DISTINCT parent) FILTER (parent NOT IN (SELECT child FROM tree)) n_roots, count(DISTINCT child) FILTER (child NOT IN (SELECT parent FROM tree)) n_leaves,
 (SELECT count(*) FROM (SELECT child FROM tree GROUP BY child HAVING count(*) > 1)) n_two_parents FROM tree) SELECT n_roots, n_inner, n_leaves, n_two_parents, n_roots = 1 AND n_two_parents = 0 AND n_inner <= n_leaves sound FROM n""")  # fmt: skip
def tr7_consistency(spark, sf_dir):
    return memory.tree_health(tree(spark, sf_dir))


@query("SELECT DISTINCT s_suppkey % 5 AS depth, round(CASE WHEN 0.3 * exp(0.4 * (s_suppkey % 5) / 2) > 1 THEN 0.98 ELSE 0.3 * exp(0.4 * (s_suppkey % 5) / 2) END, 9) threshold FROM supplier")
def tr8_threshold(spark, sf_dir):
    d = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 5).alias("depth")).distinct()
    return d.select("depth", F.round(memory.adaptive_threshold(F.col("depth"), F.lit(2)), 9).alias("threshold"))


# linking
@query("""WITH c AS (SELECT n_nationkey query_id, n_name entity, c_custkey id, CASE WHEN c_custkey % 10 = 0 THEN lower(n_name) ELSE c_name END AS name, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey),
 x AS (SELECT *, lower(name) = lower(entity) exact, bool_or(lower(name) = lower(entity)) OVER (PARTITION BY query_id) has FROM c) SELECT query_id, entity, id, name, rank, exact FROM x WHERE rank <= 3 AND (exact OR NOT has)""")  # fmt: skip
def l1_entity_linking(spark, sf_dir):
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    x = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_nationkey").alias("query_id"), F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 == 0, F.lower("n_name")).otherwise(F.col("c_name")).alias("name"), F.lit(0.0).alias("score"))
    return memory.linked_nodes(n.select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("entity")), retrieval.ranked(x, 1 << 30), 3)


@query("""WITH m AS (SELECT r_regionkey q, n_nationkey % 3 e, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey), l AS (SELECT DISTINCT q, e FROM m),
 c AS (SELECT a.q, a.name n0, b.name n1, d.name n2 FROM m a JOIN m b ON a.q = b.q JOIN m d ON a.q = d.q WHERE a.e = 0 AND b.e = 1 AND d.e = 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n0, n1, n2) - 1 k FROM c)
 SELECT q query_id, k::BIGINT combination, n0 || '|' || n1 || '|' || n2 AS names FROM r WHERE k < 4 AND q IN (SELECT q FROM l GROUP BY q HAVING count(*) = 3)""")  # fmt: skip
def l3_clue_queries(spark, sf_dir):
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    m = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_regionkey").alias("query_id"), (F.col("n_nationkey") % 3).alias("entity"), F.col("n_name").alias("name"))
    return memory.clue_queries(m, 4).filter(F.size("names") == 3).select("query_id", "combination", F.concat_ws("|", "names").alias("names"))


@query("SELECT r_regionkey query_id, string_agg('- ' || n_name, chr(10) ORDER BY n_name) context FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def l6_context(spark, sf_dir):
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    x = n.join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_regionkey").alias("query_id")).agg(F.sort_array(F.collect_list("n_name")).alias("texts"))
    return x.select("query_id", parsers.context(F.col("texts")).alias("context"))


# parsers over generated text
@query("SELECT turn, role, CASE WHEN ru + en = 0 THEN NULL WHEN ru > en THEN 'ru' ELSE 'en' END lang, count(*)::BIGINT n FROM (SELECT *, length(regexp_replace(text, '[^А-Яа-яЁё]', '', 'g')) ru, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) en FROM conversations) GROUP BY ALL")
def u5_language(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("turn", "role", parsers.detect_language(F.col("text")).alias("lang")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey id, lower(n_name) s, 'in region' r, lower(r_name) o FROM nation JOIN region ON n_regionkey = r_regionkey")
def u6_parse_triplets(spark, sf_dir):
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    x = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(" | In Region. | "), "r_name", F.lit(";\nno bars here")).alias("raw"))
    return x.select("id", F.explode(parsers.triplet_lines(F.col("raw"))).alias("t")).select("id", "t.*")


@query("SELECT n_nationkey id, n_name AS name FROM nation UNION ALL SELECT n_nationkey, 'Second' FROM nation")
def u8_name_list(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.explode(parsers.name_list(F.concat("n_name", F.lit(" | | Second .")))).alias("name"))


@query("SELECT n_nationkey id, n_name answer, true yes, 2 n_items FROM nation")
def u10_answers(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    marked = F.concat(F.lit("think\n[Answer]  "), "n_name", F.lit("\n"))
    return n.select(F.col("n_nationkey").alias("id"), F.trim(F.translate(parsers.after_marker(marked, "answer"), "\n", "")).alias("answer"), parsers.truth(F.lit("It is True, not False")).alias("yes"), F.size(parsers.numbered(F.lit("1. a\nx\n2. b"))).alias("n_items"))


# metrics and corpus preparation
@query("""SELECT a.item_id, round(CASE WHEN s > 0 THEN 2 * (s / x) * (s / y) / (s / x + s / y) ELSE 0 END, 6) f1, a.text = b.text em FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1,
 LATERAL (SELECT len(list_intersect(list_distinct(string_split(regexp_replace(lower(a.text), ' +', ' ', 'g'), ' ')), string_split(regexp_replace(lower(b.text), ' +', ' ', 'g'), ' ')))::DOUBLE s, len(string_split(regexp_replace(lower(a.text), ' +', ' ', 'g'), ' ')) x, len(string_split(regexp_replace(lower(b.text), ' +', ' ', 'g'), ' ')) y)""")  # fmt: skip
def e2_token_f1(spark, sf_dir):
    a = read(spark, sf_dir, "benchmark")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return a.join(b, "item_id").select("item_id", F.round(corpus.token_f1(F.col("text"), F.col("other")), 6).alias("f1"), corpus.exact_match(F.col("text"), F.col("other")).alias("em"))


_W = "string_split(regexp_replace(lower({x}.text), ' +', ' ', 'g'), ' ')"
_CLEAN = "regexp_replace(lower({x}.text), '[^a-z0-9 ]', '', 'g')"


@query(f"""SELECT item_id, levenshtein(ca, cb)::INT edits, round(h / len(x)::DOUBLE * CASE WHEN len(x) < len(y) THEN exp(1 - len(y) / len(x)::DOUBLE) ELSE 1 END, 6) bleu1 FROM (SELECT *, list_sum(list_transform(list_distinct(x), lambda g: least(len(list_filter(x, lambda w: w = g)), len(list_filter(y, lambda w: w = g))))) h
 FROM (SELECT a.item_id, {_CLEAN.format(x="a")} ca, {_CLEAN.format(x="b")} cb, {_W.format(x="a")} x, {_W.format(x="b")} y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1))""")  # fmt: skip
def e4_overlap(spark, sf_dir):
    a = read(spark, sf_dir, "benchmark")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    clean = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9 ]", "")
    return a.join(b, "item_id").select("item_id", F.levenshtein(clean("text"), clean("other")).alias("edits"), F.round(corpus.bleu1(F.col("text"), F.col("other")), 6).alias("bleu1"))


@query()
def e4_rouge_l(spark, sf_dir):
    a = read(spark, sf_dir, "benchmark")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return a.join(b, "item_id").select("item_id", F.round(corpus.rouge_l(F.col("text"), F.col("other")), 6).alias("rouge_l"))


@query("""WITH f AS (SELECT DISTINCT o_custkey AS key, o_orderpriority item FROM orders WHERE o_orderkey % 2 = 0), g AS (SELECT DISTINCT o_custkey AS key, o_orderpriority item FROM orders WHERE o_orderkey % 3 = 0),
 j AS (SELECT coalesce(f.key, g.key) k, f.item fi, g.item gi FROM f FULL JOIN g ON f.key = g.key AND f.item = g.item) SELECT k AS key, CASE WHEN count(fi) = 0 THEN 0.0::DOUBLE ELSE round(count(fi) FILTER (gi IS NOT NULL) / count(fi)::DOUBLE, 5) END "precision", CASE WHEN count(gi) = 0 THEN 0.0::DOUBLE ELSE round(count(fi) FILTER (gi IS NOT NULL) / count(gi)::DOUBLE, 5) END recall FROM j GROUP BY k""")  # fmt: skip
def e6_set_scores(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("item"), "o_orderkey")
    return corpus.set_scores(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0"), "key", "item")


@query("""WITH f AS (SELECT DISTINCT o_custkey AS key, o_orderpriority item FROM orders WHERE o_orderkey % 2 = 0), g AS (SELECT DISTINCT o_custkey AS key, o_orderpriority item FROM orders WHERE o_orderkey % 3 = 0),
 j AS (SELECT coalesce(f.key, g.key) k, f.item fi, g.item gi FROM f FULL JOIN g ON f.key = g.key AND f.item = g.item), s AS (SELECT CASE WHEN count(fi) = 0 THEN 0.0::DOUBLE ELSE round(count(fi) FILTER (gi IS NOT NULL) / count(fi)::DOUBLE, 5) END p, CASE WHEN count(gi) = 0 THEN 0.0::DOUBLE ELSE round(count(fi) FILTER (gi IS NOT NULL) / count(gi)::DOUBLE, 5) END r FROM j GROUP BY k)
 SELECT 'precision' AS "column", count(p) n, round(max(p), 5) AS "max", round(avg(p), 5) mean, round(median(p), 5) median, round(min(p), 5) AS "min", round(stddev_pop(p), 5) std, round(sum(p), 5) AS "sum" FROM s UNION ALL SELECT 'recall', count(r), round(max(r), 5), round(avg(r), 5), round(median(r), 5), round(min(r), 5), round(stddev_pop(r), 5), round(sum(r), 5) FROM s""")  # fmt: skip
def e6_summary(spark, sf_dir):
    return corpus.score_summary(e6_set_scores(spark, sf_dir), ["precision", "recall"])


_KEPT = "SELECT md5(text) hash, min(doc_id) doc_id FROM documents WHERE length(text) BETWEEN 64 AND 4096 GROUP BY text"


@query(f"SELECT doc_id, hash FROM ({_KEPT})")
def d1_unique_documents(spark, sf_dir):
    return corpus.unique_documents(read(spark, sf_dir, "documents"), 64, 4096)


_QA = "SELECT conv_id qa_id, string_agg(text, ' ' ORDER BY turn) question, [min(turn) + conv_id, max(turn) + conv_id] refs FROM conversations GROUP BY conv_id"


def qa(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("qa_id")).agg(F.min("turn").alias("a"), F.max("turn").alias("b"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("question"))
    return c.select("qa_id", "question", F.array(F.col("a") + F.col("qa_id"), F.col("b") + F.col("qa_id")).alias("refs"))


@query(f"""WITH kept AS ({_KEPT}), one AS (SELECT * FROM ({_QA}) QUALIFY row_number() OVER (PARTITION BY question ORDER BY qa_id) = 1), e AS (SELECT qa_id, unnest(list_distinct(refs)) doc_id FROM one),
 f AS (SELECT qa_id, count(*)::BIGINT n_refs FROM e LEFT JOIN kept USING (doc_id) GROUP BY qa_id HAVING count(*) = count(hash)) SELECT qa_id, n_refs, row_number() OVER (ORDER BY qa_id) - 1 new_id FROM f QUALIFY new_id < 40""")  # fmt: skip
def d2_answerable(spark, sf_dir):
    return corpus.answerable(qa(spark, sf_dir), corpus.unique_documents(read(spark, sf_dir, "documents"), 64, 4096), 40)


@query(f"WITH kept AS ({_KEPT}), e AS (SELECT DISTINCT unnest(refs) doc_id FROM ({_QA})) SELECT doc_id, hash FROM kept ANTI JOIN e USING (doc_id) ORDER BY hash LIMIT 50")
def d3_noise_documents(spark, sf_dir):
    used = qa(spark, sf_dir).select(F.explode("refs").alias("doc_id"))
    return corpus.noise(corpus.unique_documents(read(spark, sf_dir, "documents"), 64, 4096), used, 50)


@query()
def d7_chunks(spark, sf_dir):
    return corpus.chunks(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), 1024, 64).select("doc_id", "chunk", "hash")


@query(f"WITH kept AS (SELECT doc_id FROM ({_KEPT})), f AS (SELECT * FROM ({_QA}) WHERE qa_id % 4 <> 0 AND list_has_all((SELECT list(doc_id) FROM kept), refs)) SELECT qa_id, list_extract(refs, 1) first_ref FROM f")
def d8_tag_filter(spark, sf_dir):
    """Every fourth question has the tag no-answer."""
    rows = qa(spark, sf_dir).withColumn("tags", F.when(F.col("qa_id") % 4 == 0, F.array(F.lit("no-answer"))).when(F.col("qa_id") % 4 == 1, F.array(F.lit("count"))))
    return corpus.tagged(rows, corpus.unique_documents(read(spark, sf_dir, "documents"), 64, 4096)).select("qa_id", F.get("refs", 0).alias("first_ref"))


@query(f"WITH kept AS (SELECT doc_id FROM ({_KEPT})), e AS (SELECT qa_id, unnest(list_distinct(refs)) doc_id FROM ({_QA})), f AS (SELECT * FROM e WHERE qa_id NOT IN (SELECT qa_id FROM e ANTI JOIN kept USING (doc_id))) SELECT doc_id, string_agg(qa_id::VARCHAR, ',' ORDER BY qa_id) qa_ids FROM f GROUP BY doc_id")
def d6_multi_hop(spark, sf_dir):
    contexts, _ = corpus.multi_hop(qa(spark, sf_dir), corpus.unique_documents(read(spark, sf_dir, "documents"), 64, 4096))
    return contexts.select("doc_id", F.array_join(F.transform("qa_ids", lambda x: x.cast("string")), ",").alias("qa_ids"))


@query(f"""WITH q AS ({_QA}), r AS (SELECT DISTINCT unnest(refs) doc_id FROM q) SELECT unnest(['repeated_questions', 'repeated_ids', 'without_references', 'repeated_documents', 'unknown_references', 'unused_documents']) fault,
 unnest([(SELECT count(*) - count(DISTINCT question) FROM q), (SELECT count(*) - count(DISTINCT qa_id) FROM q), (SELECT count(*) FROM q WHERE len(refs) < 1), (SELECT count(*) - count(DISTINCT doc_id) FROM documents), (SELECT count(*) FROM r ANTI JOIN documents USING (doc_id)), (SELECT count(*) FROM documents ANTI JOIN r USING (doc_id))]) n""")  # fmt: skip
def d5_dataset_faults(spark, sf_dir):
    return corpus.dataset_faults(qa(spark, sf_dir), read(spark, sf_dir, "documents"))


@query("""WITH a AS (SELECT event_type pack, CASE WHEN event_id % 9 <> 0 THEN CASE WHEN event_id % 5 = 0 THEN '<none>' ELSE props END END answer, event_id % 3 AS em, value AS f1, event_id % 7 AS "time" FROM events)
 SELECT pack, round(avg(em) FILTER (answer IS NOT NULL), 5) em, round(avg(f1) FILTER (answer IS NOT NULL), 5) f1, round(count(*) FILTER (answer IS NULL) / count(*)::DOUBLE, 5) null_share, round(count(*) FILTER (answer = '<none>') / count(*)::DOUBLE, 5) nothing_share, round(sum("time")::DOUBLE, 3) AS "time" FROM a GROUP BY pack""")  # fmt: skip
def e10_answer_scores(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    answer = F.when(F.col("event_id") % 9 != 0, F.when(F.col("event_id") % 5 == 0, "<none>").otherwise(F.col("props")))
    rows = e.select(F.col("event_type").alias("pack"), answer.alias("answer"), (F.col("event_id") % 3).alias("em"), F.col("value").alias("f1"), (F.col("event_id") % 7).cast("double").alias("time"))
    return corpus.answer_scores(rows, ["em", "f1"], "<none>")


@query(graph_sql("""SELECT qa_id, string_agg(DISTINCT t_id, ',' ORDER BY t_id) t_ids, len(list_distinct(flatten(list([s, e])))) n_nodes FROM (SELECT conv_id qa_id, unnest([min(turn) + conv_id, max(turn) + conv_id]) doc_id FROM conversations GROUP BY conv_id)
 JOIN documents USING (doc_id) JOIN (SELECT t_id, e_name, s_type || ':' || s_id s, e_type || ':' || e_id e FROM t WHERE e_type = 'episodic') x ON e_name = md5(text) GROUP BY qa_id"""))  # fmt: skip
def e7_ground_truth(spark, sf_dir):
    t = triplets(spark, sf_dir)
    links = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), F.md5("text").alias("e_name")).join(t.filter("e_type = 'episodic'").select("t_id", "e_name"), "e_name")
    return corpus.ground_truth(qa(spark, sf_dir), links, t).select("qa_id", F.concat_ws(",", "t_ids").alias("t_ids"), F.size("node_ids").cast("long").alias("n_nodes"))


_G = "list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1])"
_CLIP = "coalesce(list_sum(list_transform(list_distinct({x}), lambda g: least(len(list_filter({x}, lambda w: w = g)), len(list_filter({y}, lambda w: w = g))))), 0)"


@query(f"""SELECT item_id, round(sqrt({_CLIP.format(x="x", y="y")} / len(x)::DOUBLE * {_CLIP.format(x="gx", y="gy")} / greatest(len(gx), 1)) * CASE WHEN len(x) < len(y) THEN exp(1 - len(y) / len(x)::DOUBLE) ELSE 1 END, 6) bleu2
 FROM (SELECT *, {_G.format(x="x")} gx, {_G.format(x="y")} gy FROM (SELECT a.item_id, {_W.format(x="a")} x, {_W.format(x="b")} y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1))""")  # fmt: skip
def e4_bleu2(spark, sf_dir):
    a = read(spark, sf_dir, "benchmark")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return a.join(b, "item_id").select("item_id", F.round(corpus.bleu2(F.col("text"), F.col("other")), 6).alias("bleu2"))


# events as the lines of twenty logs
@query("""WITH l AS (SELECT user_id % 20 log, *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 20 ORDER BY event_id) question FROM events),
 c AS (SELECT log, question::BIGINT question, count(*) FILTER (event_type = 'view')::BIGINT s, coalesce(sum(event_id % 4) FILTER (event_type = 'purchase'), 0)::BIGINT c FROM l WHERE question > 0 GROUP BY ALL)
 SELECT log, question, s entities_extractor, s clueanswers_summarizer, s answer_classify, s - 1 searchplan_enhance_classify, s - 1 plan_enhancing, c cluequeries_generator, c clueanswer_generator, 1::BIGINT plan_initialing, (s = 3)::BIGINT strict_answer_gen, (s <> 3)::BIGINT casual_answer_gen FROM c""")  # fmt: skip
def e9_call_counts(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumns({"log": F.col("user_id") % 20, "line_no": F.col("event_id")})
    kind = F.col("event_type")
    return tasks.call_counts(e, kind == "signup", kind == "view", F.when(kind == "purchase", F.col("event_id") % 4), 3)


@query("""SELECT item_id, 'yes' result, 'success' status, text IN (SELECT text FROM benchmark WHERE item_id % 2 = 0) cache_hit, sha1(sha1('Be brief.') || sha1('Text: ' || text || ' Answer?') || sha1('__<|None|>__') || sha1('t=0')) AS "key" FROM benchmark""")
def u3_tasks(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark")
    prompts = spark.createDataFrame([("en", "Be brief.", "Text: {text} Answer?", None)], "lang string, system string, user string, assistant string")
    run = lambda df, cache, label: tasks.solve(df, {"text": F.col("text")}, prompts, tasks.stub(["So: [Answer] yes"]), lambda raw: parsers.after_marker(raw, "answer"), saver(spark, label), "en", cache, "t=0")
    made = run(rows.filter("item_id % 2 = 0"), None, "tasks_half")[1]
    return run(rows, made, "tasks_all")[0].drop("text")


# questions over the theses of a nation: a benchmark item asks for its nation and for words of its text
def question_seeds(spark, sf_dir):
    w = F.split("text", "\\s+")
    named = [(0, F.concat(F.lit("NATION_"), F.col("item_id") % 25)), (1, F.get(w, 0)), (1, F.get(w, 1)), (2, F.get(w, 3))]
    each = F.explode(F.array(*[F.struct(F.lit(e).alias("entity"), s.alias("seed")) for e, s in named])).alias("x")
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), each).select("query", "x.entity", "x.seed").filter("seed is not null").distinct()


def question_theses(spark, sf_dir):
    b, c = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "conversations")
    rows = b.select((F.col("item_id") % 25).alias("k"), F.lit("hyper").alias("kind"), "text", F.lower(F.get(F.split("text", "\\s+"), 0)).alias("value"))
    rows = rows.union(c.select(F.col("conv_id") % 25, F.lit("episodic"), "text", "role")).withColumn("t_id", F.md5(F.concat_ws("|", "kind", "value", "text")))
    asked = b.select(F.col("item_id").alias("query"), (F.col("item_id") % 25).alias("k"))
    return rows.join(asked, "k").select("query", F.lit(0).alias("entity"), F.concat(F.lit("NATION_"), F.col("k")).alias("seed"), "kind", "text", "t_id", F.array("value").alias("values"))


_MENTIONS = r"""WITH q AS (SELECT item_id query, item_id % 25 k, string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ') w FROM benchmark),
 s0 AS (SELECT query, 1 entity, w[1] seed FROM q UNION SELECT query, 1, w[2] FROM q UNION SELECT query, 2, w[4] FROM q),
 s AS (SELECT *, lower(seed) low, CASE WHEN regexp_matches(lower(seed), '^[а-яё]') AND length(seed) >= 4 THEN left(lower(seed), CASE WHEN length(seed) > 4 THEN length(seed) - 2 ELSE 3 END) ELSE lower(seed) END stem FROM s0 WHERE seed IS NOT NULL),
 th AS (SELECT item_id % 25 k, 'hyper' kind, text, lower(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ')[1]) AS value FROM benchmark UNION ALL SELECT conv_id % 25, 'episodic', text, role FROM conversations),
 r AS (SELECT query, kind, text, value, md5(concat_ws('|', kind, value, text)) t_id FROM th JOIN q USING (k) QUALIFY row_number() OVER (PARTITION BY query, kind, trim(text) ORDER BY md5(concat_ws('|', kind, value, text))) = 1),
 m AS (SELECT r.query, kind, t_id, entity, max(CASE WHEN contains(lower(text), low) THEN CASE WHEN regexp_matches(seed, '^.?[\p{Lu}\p{Nd}]') THEN 1.0 ELSE 0.5 END WHEN contains(lower(text), stem) THEN CASE WHEN regexp_matches(seed, '^[\p{Lu}\p{Nd}]') THEN 1.0 ELSE 0.5 END ELSE 0.0 END)::DOUBLE v, bool_or(value = low) f
  FROM r JOIN s ON r.query = s.query GROUP BY ALL)
 SELECT query, kind, t_id, round(sum(v), 6) score, bool_or(f) flag FROM m GROUP BY ALL""".replace("\\\\", "\\")


@query(_MENTIONS)
def t11_mention_scores(spark, sf_dir):
    return theses.mention_scores(question_theses(spark, sf_dir), question_seeds(spark, sf_dir)).select("query", "kind", "t_id", "score", "flag")


@query()
def t12_choose_theses(spark, sf_dir):
    seeds = question_seeds(spark, sf_dir)
    save = saver(spark, "theses")
    scored = save(theses.mention_scores(question_theses(spark, sf_dir), seeds), "scored")
    return theses.choose(scored, seeds, save).select("query", "kind", "rank", "t_id", "score")


@query(graph_sql("""SELECT a.query, a.entity, CASE WHEN a.hits > 0 THEN 1 ELSE 2 END kind, min(a.t_id) t_id, a.hits FROM rows3 a LEFT JOIN (SELECT query, far FROM rows3 WHERE hits = 0 GROUP BY query, far HAVING count(DISTINCT entity) > 1) m ON a.query = m.query AND a.far = m.far WHERE a.hits > 0 OR m.far IS NOT NULL GROUP BY a.query, a.entity, a.low, a.high, a.hits""",
    """, seeds AS (SELECT n_nationkey query, 0 entity, n_name seed FROM nation UNION ALL SELECT n_nationkey, 1, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey, 2, 'NATION_' || ((n_nationkey + 5) % 25) FROM nation),
 ends AS (SELECT t_id, lower(replace(s_name, '_', ' ')) s, lower(replace(e_name, '_', ' ')) e, least(s_id, e_id) low, greatest(s_id, e_id) high FROM t WHERE r_type = 'simple'),
 rows1b AS (SELECT DISTINCT query, entity, t_id, s, e, low, high, CASE WHEN s = lower(replace(seed, '_', ' ')) THEN e ELSE s END far FROM seeds JOIN ends ON s = lower(replace(seed, '_', ' ')) OR e = lower(replace(seed, '_', ' '))),
 rows3 AS (SELECT *, (EXISTS (SELECT 1 FROM seeds z WHERE z.query = x.query AND z.entity <> x.entity AND lower(replace(z.seed, '_', ' ')) = x.s))::INT + (EXISTS (SELECT 1 FROM seeds z WHERE z.query = x.query AND z.entity <> x.entity AND lower(replace(z.seed, '_', ' ')) = x.e))::INT hits FROM rows1b x)
"""))  # fmt: skip
def t10_joined_chains(spark, sf_dir):
    """Entities of a question are a nation, its region and the nation five numbers on."""
    seeds, edges = nation_entities(spark, sf_dir)
    return chains.joined(edges, seeds, triplets(spark, sf_dir))


def nation_entities(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    row = lambda df, k, c: df.select(F.col("n_nationkey").alias("query"), F.lit(k).alias("entity"), c.alias("seed"))
    seeds = row(n, 0, F.col("n_name")).union(row(n.join(r, n.n_regionkey == r.r_regionkey), 1, F.col("r_name"))).union(row(n, 2, F.concat(F.lit("NATION_"), ((F.col("n_nationkey") + 5) % 25).cast("string"))))
    near = graph.expand_by_names(triplets(spark, sf_dir), seeds.select("seed").distinct())
    return seeds, seeds.join(near, "seed")


@query()
def t13_assembled(spark, sf_dir):
    seeds, edges = nation_entities(spark, sf_dir)
    t = triplets(spark, sf_dir)
    texts = read(spark, sf_dir, "benchmark").select((F.col("item_id") % 25).alias("query"), F.md5("text").alias("e_id")).join(t.filter("r_type = 'hyper'").select("t_id", "e_id"), "e_id")
    return chains.assembled(chains.joined(edges, seeds, t), edges, seeds, texts.filter("query % 2 = 0").select("query", "t_id"))


# memory: what generated answers add, and what they replace
def answered_texts(spark, sf_dir):
    """Nations as texts whose generated answers name two triplets and one thesis; every tenth answer has nothing."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    x = n.join(r, n.n_regionkey == r.r_regionkey)
    none = F.col("n_nationkey") % 10 == 0
    spo = F.concat(F.lower("n_name"), F.lit(" | lies in | "), F.lower("r_name"), F.lit(".\n'"), F.lower("n_name"), F.lit("' | has number | "), F.col("n_nationkey").cast("string"), F.lit(";"))
    thesis = F.concat(F.lower("n_name"), F.lit(" belongs to a region | ['"), F.lower("n_name"), F.lit("', \""), F.lower("r_name"), F.lit("\"]."))
    return x.select(F.col("n_nationkey").alias("text_id"), F.concat(F.lit("About "), "n_name").alias("text"), F.when(F.col("n_nationkey") % 2 == 0, "May 2024").alias("time"), F.when(none, "nothing").otherwise(spo).alias("raw_triplets"), F.when(none, "nothing").otherwise(thesis).alias("raw_theses"))


#: Entities of dated texts read otherwise in theses than in simple triplets, and are linked twice.
_TOLD = """WITH x AS (SELECT n_nationkey id, lower(n_name) n, lower(r_name) r, 'About ' || n_name AS text, n_nationkey % 2 = 0 dated FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 10 <> 0),
 ent AS (SELECT id, 'object' k, unnest([n, r, id::VARCHAR]) nm, text, false p FROM x UNION SELECT id, 'object', unnest([n, r]), text, dated FROM x UNION SELECT id, 'hyper', n || ' belongs to a region', text, dated FROM x),
 m1 AS (SELECT id text_id, 'object' s_type, n s_name, 'simple' r_type, 'lies in' r_name, 'object' e_type, r e_name, false p FROM x UNION ALL SELECT id, 'object', n, 'simple', 'has number', 'object', id::VARCHAR, false FROM x
 UNION ALL SELECT id, 'object', unnest([n, r]), 'hyper', 'hyper', 'hyper', n || ' belongs to a region', dated FROM x UNION ALL SELECT id, k, nm, 'episodic', 'episodic', 'episodic', text, p FROM ent
 UNION ALL SELECT id, 'time', 'May 2024', 'time', 'time', 'episodic', text, false FROM x WHERE dated UNION ALL SELECT id, 'time', 'May 2024', 'time', 'time', 'hyper', n || ' belongs to a region', false FROM x WHERE dated)
"""


@query(_TOLD + "SELECT *, 'success' status FROM m1 UNION ALL SELECT n_nationkey, NULL, NULL, NULL, NULL, NULL, NULL, false, 'zero_triplets' FROM nation WHERE n_nationkey % 10 = 0")
def m1_extract(spark, sf_dir):
    """p: whether the start has properties."""
    out = knowledge.extract(answered_texts(spark, sf_dir), F.col("raw_triplets"), F.col("raw_theses"))
    return out.select("text_id", *knowledge.ROWS, F.coalesce(F.size("s_props") > 0, F.lit(False)).alias("p"), "status")


@query(_TOLD + "SELECT r_type, count(*) n, (SELECT count(*) FROM m1) n_links FROM (SELECT DISTINCT s_type, s_name, r_type, r_name, e_type, e_name, p FROM m1) GROUP BY r_type")
def m12_remember(spark, sf_dir):
    store = knowledge.Knowledge(spark, new_root(spark, "memory"), hashed)
    knowledge.remember(store, answered_texts(spark, sf_dir), F.col("raw_triplets"), F.col("raw_theses"), saver(spark, "remember"))
    return store.triplets.read().groupBy("r_type").agg(F.count("*").alias("n")).withColumn("n_links", F.lit(store.provenance.count()).cast("long"))


@query(_TOLD + "SELECT text_id, count(DISTINCT s_type || s_name || r_type || r_name || e_type || e_name || p::VARCHAR) n FROM m1 GROUP BY text_id")
def m14_load_provenance(spark, sf_dir):
    store = knowledge.Knowledge(spark, new_root(spark, "origin"), hashed)
    knowledge.remember(store, answered_texts(spark, sf_dir), F.col("raw_triplets"), F.col("raw_theses"), saver(spark, "origin"))
    return store.of_texts(answered_texts(spark, sf_dir)).select("text_id", F.size("t_ids").cast("long").alias("n"))


#: New facts: every third nation has moved to the next region; its old place is named as replaced.
_MOVED = "SELECT n_name n, r.r_name was, x.r_name now FROM nation JOIN region r ON n_regionkey = r.r_regionkey JOIN region x ON x.r_regionkey = (n_regionkey + 1) % 5 WHERE n_nationkey % 3 = 0"


def moved(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    was = n.filter("n_nationkey % 3 = 0").join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("n"), F.col("r_name").alias("was"), ((F.col("n_regionkey") + 1) % 5).alias("k"))
    return was.join(r.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("now")), "k")


def new_places(spark, sf_dir):
    lit = lambda x, c: F.lit(x).alias(c)
    return graph.triplets(moved(spark, sf_dir).select(lit("object", "s_type"), F.col("n").alias("s_name"), lit("simple", "r_type"), lit("in region", "r_name"), lit("object", "e_type"), F.col("now").alias("e_name")))


@query(graph_sql(f"SELECT md5('object' || md5(n) || 'simple' || md5(n || ' in region ' || now) || 'object' || md5(now)) new_id, count(*) n FROM (SELECT DISTINCT n, now, t_id FROM ({_MOVED}) JOIN t ON r_type = 'simple' AND (s_name IN (n, now) OR e_name IN (n, now)) WHERE stringified <> n || ' in region ' || now) GROUP BY n, now"))
def m7_simple_candidates(spark, sf_dir):
    return knowledge.simple_candidates(triplets(spark, sf_dir), new_places(spark, sf_dir)).groupBy("new_id").agg(F.count("*").alias("n"))


@query(graph_sql("SELECT md5('object' || md5(n_name) || 'hyper' || md5('Big news') || 'hyper' || md5('Big news')) new_id, count(*) n FROM nation JOIN t ON r_type = 'hyper' AND s_name = n_name GROUP BY n_name"))
def m8_hyper_candidates(spark, sf_dir):
    lit = lambda x, c: F.lit(x).alias(c)
    new = graph.triplets(read(spark, sf_dir, "nation").select(lit("object", "s_type"), F.col("n_name").alias("s_name"), lit("hyper", "r_type"), lit("hyper", "r_name"), lit("hyper", "e_type"), lit("Big news", "e_name")))
    return knowledge.hyper_candidates(triplets(spark, sf_dir), new).groupBy("new_id").agg(F.count("*").alias("n"))


@query(f"SELECT n_name AS name, r_name region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0 UNION ALL SELECT n, now FROM ({_MOVED})")
def m11_update(spark, sf_dir):
    """Generated answers name old places as replaced by new ones; the store drops the first and adds the second."""
    t = triplets(spark, sf_dir)
    store, new = knowledge.Knowledge(spark, new_root(spark, "update"), hashed), new_places(spark, sf_dir)
    store.add(t.filter("r_type = 'simple' and r_name in ('in region', 'based in')"))
    raw = moved(spark, sf_dir).select(F.concat(F.lit("[["), "n", F.lit(", in region, "), "was", F.lit(" -> "), "n", F.lit(", in region, "), "now", F.lit("]]")).alias("raw"))
    pairs = raw.select(F.explode(parsers.replacements(F.col("raw"))).alias("p")).select("p.*")
    low = lambda df: df.withColumns({c: F.lower(c) for c in ("s_name", "r_name", "e_name")})
    knowledge.update(store, new, lambda c: knowledge.replaced(pairs, c, low(store.triplets.read()), low(new)))
    return store.triplets.read().filter("r_name = 'in region'").select(F.col("s_name").alias("name"), F.col("e_name").alias("region"))


# parsers over made answers
@query("SELECT n_nationkey id, lower(n_name) s, 'in region' r, lower(r_name) o FROM nation JOIN region ON n_regionkey = r_regionkey")
def u6_triplet_list(spark, sf_dir):
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    x = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("id"), F.concat(F.lit("Here they are: 1. "), "n_name", F.lit(", In Region, "), "r_name", F.lit("; two, parts")).alias("raw"))
    return x.select("id", F.explode(parsers.triplet_list(F.col("raw"))).alias("t")).select("id", "t.*")


@query("SELECT n_nationkey id, lower(n_name) || ' is told of' thesis, lower(n_name) || ',' || lower(r_name) entities FROM nation JOIN region ON n_regionkey = r_regionkey")
def u7_theses(spark, sf_dir):
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    raw = F.concat("n_name", F.lit(" is told of | ['"), "n_name", F.lit("', \""), "r_name", F.lit("\"];\nno bar here\nbad | [list"))
    x = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("id"), F.explode(parsers.theses(raw)).alias("t"))
    return x.select("id", "t.thesis", F.concat_ws(",", "t.entities").alias("entities"))


@query("SELECT n_nationkey id, md5(lower(n_name) || ', was, a') old, md5(lower(n_name) || ', is, b') AS new FROM nation UNION ALL SELECT n_nationkey, md5('old of ' || lower(n_name)), md5('new of ' || lower(n_name)) FROM nation")
def u9_replacements(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    one = parsers.replacements(F.concat(F.lit("So: [["), "n_name", F.lit(", was, a -> "), "n_name", F.lit(", is, b], [two, parts -> x, y, z]]")))
    two = parsers.thesis_replacements(F.concat(F.lit('So: ["New of '), "n_name", F.lit(" <- Old of "), "n_name", F.lit('", "nothing"]')))
    return n.select(F.col("n_nationkey").alias("id"), F.explode(F.concat(one, two)).alias("p")).select("id", "p.*")


@query("SELECT n_nationkey id, CASE WHEN n_nationkey % 2 = 0 THEN 2 END n_second, n_name || ' in short' summary, 'what of ' || n_name || '?' first_part FROM nation")
def u13_summaries_and_lists(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    names = parsers.name_list(F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, " | b").otherwise(" | ")), 2)
    made = parsers.summary(F.concat(F.lit("thought\n[Output Summary]\n"), "n_name", F.lit(" in short.")))
    parts = parsers.dashed(F.concat(F.lit("- what of "), "n_name", F.lit("?\n\n- and then?")))
    return n.select(F.col("n_nationkey").alias("id"), F.when(names.isNotNull(), F.size(names)).alias("n_second"), made.alias("summary"), F.get(parts, 0).alias("first_part"))


@query("""WITH l AS (SELECT user_id % 20 log, *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 20 ORDER BY event_id) question FROM events),
 c AS (SELECT count(*) n, sum(s) s FROM (SELECT log, question, count(*) FILTER (event_type = 'view') s FROM l WHERE question > 0 GROUP BY ALL)) SELECT 'plan_initialing' task, n calls, round(n * 120.5, 3)::DOUBLE prompt_tokens, round(n * 30.25, 3)::DOUBLE generated_tokens FROM c UNION ALL SELECT 'answer_classify', s::BIGINT, round(s * 80.0, 3)::DOUBLE, round(s * 1.5, 3)::DOUBLE FROM c""")  # fmt: skip
def e9_token_sums(spark, sf_dir):
    means = spark.createDataFrame([("plan_initialing", 120.5, 30.25), ("answer_classify", 80.0, 1.5)], "task string, prompt_tokens double, generated_tokens double")
    return tasks.token_sums(e9_call_counts(spark, sf_dir), means)


# answering questions with a provider that knows the forms of answers only
def echo(requests: DataFrame) -> DataFrame:
    """Says False to yes-or-no questions, else gives the last line of the request back in the form that is asked for."""
    user = F.col("user")
    about = F.regexp_extract(user, r"(?:Question|Text): (.*)", 1)
    said = F.when(user.contains("True or False"), F.when(user.contains("Found: "), "True").otherwise("False")).when(F.col("system").contains("numbered"), F.concat(F.lit("1. "), about)).when(F.col("system").contains("with bars"), F.regexp_extract(about, r"(\w+_\d+)", 1))
    return requests.select("key", F.coalesce(said, F.concat(F.lit("[Answer] "), about)).alias("raw"), F.lit(1).cast("long").alias("prompt_tokens"), F.lit(1).cast("long").alias("generated_tokens"), F.lit(0.0).alias("elapsed"))


def asker(spark, label):
    return reasoning.Asker(spark, echo, saver(spark, label))


def nation_questions(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("question_id"), F.concat(F.lit("Where does one find "), "n_name", F.lit("?")).alias("query"))


def object_nodes(spark, sf_dir):
    return graph_vectors(spark, sf_dir).filter("type = 'object'").select("id", "text", "embedding")


@query("SELECT n_nationkey::VARCHAR question_id, 'Where does one find ' || n_name || '?' better, 1 n_parts, 'success' status FROM nation")
def u14_preprocess(spark, sf_dir):
    out = reasoning.preprocess(asker(spark, "preprocess"), nation_questions(spark, sf_dir), enhance=True)
    return out.select("question_id", "better", F.size("processed").alias("n_parts"), "status")


_FOUND = "SELECT n_nationkey::VARCHAR question_id, 'Where does one find ' || n_name || '?' answer, 'success' status FROM nation"


def near_seeds(spark, sf_dir):
    """Retrieval for the reasoners: the simple triplets at the seeds."""
    u = graph.undirected(triplets(spark, sf_dir)).filter("r_type = 'simple'").select(F.col("a").alias("seed"), "t_id")
    return lambda asked, seeds: seeds.join(u, "seed").select("query_id", "t_id").distinct()


@query(_FOUND)
def u16_weak_reasoner(spark, sf_dir):
    return reasoning.weak(asker(spark, "weak"), nation_questions(spark, sf_dir), object_nodes(spark, sf_dir), triplets(spark, sf_dir), hashed, near_seeds(spark, sf_dir))


@query(_FOUND)
def u16_medium_reasoner(spark, sf_dir):
    return reasoning.medium(asker(spark, "medium"), nation_questions(spark, sf_dir), object_nodes(spark, sf_dir), triplets(spark, sf_dir), hashed, near_seeds(spark, sf_dir), steps=2)


@query(_FOUND)
def u16_answer(spark, sf_dir):
    """The whole way, with the weak reasoner."""
    ask = asker(spark, "answer")
    nodes, t, near = object_nodes(spark, sf_dir), triplets(spark, sf_dir), near_seeds(spark, sf_dir)
    return reasoning.answer(ask, nation_questions(spark, sf_dir), lambda q: reasoning.weak(ask, q, nodes, t, hashed, near))


@query("SELECT unnest(['denoise', 'decompose_classify']) task, 'success' status, count(*) n FROM nation")
def u17_traces(spark, sf_dir):
    ask = asker(spark, "traces")
    reasoning.preprocess(ask, nation_questions(spark, sf_dir))
    return ask.traces().select("task", "status", "n")


@query("SELECT item_id, true AS \"right\", 'success' status FROM benchmark")
def e5_judge(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select("item_id", F.lit("Which text?").alias("query"), F.col("text").alias("gold"), F.col("text").alias("answer"))
    yes = reasoning.Asker(spark, tasks.stub(["I say True."]), saver(spark, "judge"))
    return reasoning.judged(yes, b).select("item_id", "right", "status")


@query("""WITH e AS (SELECT n_nationkey k, n_name AS entity FROM nation) SELECT k::VARCHAR AS key, entity, md5(entity) id, entity AS name, true AS exact FROM e""")
def l2_linked_nodes(spark, sf_dir):
    """Names of nations to the nodes of just their names."""
    e = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("entity"))
    return reasoning.linked(object_nodes(spark, sf_dir), e, hashed).select("key", "entity", "id", "name", "exact")


@query(graph_sql("SELECT n_nationkey query_id, string_agg(x.txt, chr(10) ORDER BY x.stringified) context FROM nation JOIN (SELECT DISTINCT a, stringified, '- ' || trim(stringified) txt FROM u JOIN t USING (t_id) WHERE t.r_type IN ('hyper', 'simple')) x ON x.a = 'object:' || md5(n_name) GROUP BY n_nationkey"))
def l5_context(spark, sf_dir):
    """Episodic triplets are left out."""
    return reasoning.context_of(around(spark, sf_dir, ("simple", "hyper", "episodic")), triplets(spark, sf_dir))


# trees as stores
def summary_tree(spark, sf_dir):
    """The root, regions as summarized nodes, nations as leaves."""
    made = trees.Tree(spark, new_root(spark, "tree"), hashed, saver(spark, "tree"))
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    text = lambda c: F.col(c).cast("string")
    made.create(r.select(F.lit(trees.ROOT).alias("parent"), F.concat(F.lit("r"), text("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("str_id"), F.lit("summarized").alias("type"), F.col("r_name").alias("text"), F.lit(1).alias("depth")))
    made.create(n.select(F.concat(F.lit("r"), text("n_regionkey")).alias("parent"), F.concat(F.lit("n"), text("n_nationkey")).alias("id"), F.md5("n_name").alias("str_id"), F.lit("leaf").alias("type"), F.col("n_name").alias("text"), F.lit(2).alias("depth")))
    return made


@query("SELECT 'r' || n_regionkey parent, 'n' || n_nationkey child, 'leaf' AS type, n_name AS text FROM nation")
def tr1_create(spark, sf_dir):
    return summary_tree(spark, sf_dir).children(read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))).select("parent", "child", "type", "text")


@query("SELECT 'n' || n_nationkey id, n_name AS text FROM nation")
def tr2_read_by_string_id(spark, sf_dir):
    wanted = read(spark, sf_dir, "nation").select(F.md5("n_name").alias("str_id"))
    return summary_tree(spark, sf_dir).read(wanted, "str_id").select("id", "text")


@query("SELECT 'n' || n_nationkey id, CASE WHEN n_nationkey < 5 THEN 'summarized' ELSE 'leaf' END AS type, CASE WHEN n_nationkey < 5 THEN 'new ' || n_name ELSE n_name END AS text, 'r' || n_regionkey parent FROM nation")
def tr3_update(spark, sf_dir):
    made = summary_tree(spark, sf_dir)
    n = read(spark, sf_dir, "nation").filter("n_nationkey < 5")
    made.update(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("str_id"), F.lit("summarized").alias("type"), F.concat(F.lit("new "), "n_name").alias("text"), F.lit(2).alias("depth")))
    return made.nodes.read().join(made.edges.read().withColumnRenamed("child", "id"), "id").filter("depth = 2").select("id", "type", "text", "parent")


@query("SELECT type, count(*) n FROM (SELECT 'root' AS type UNION ALL SELECT 'summarized' FROM region UNION ALL SELECT 'leaf' FROM nation WHERE n_nationkey % 5 <> 1) GROUP BY type")
def tr4_delete(spark, sf_dir):
    made = summary_tree(spark, sf_dir)
    made.delete(read(spark, sf_dir, "nation").filter("n_nationkey % 5 = 1").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id")))
    return made.counts()


@query("SELECT (SELECT count(*) FROM nation) n_leaves, (SELECT count(*) FROM region) n_summarized, 1 n_roots, 2 depth, true sound")
def tr6_depth_and_check(spark, sf_dir):
    made = summary_tree(spark, sf_dir)
    return made.check().select("n_leaves", "n_summarized", "n_roots", F.lit(made.max_depth()).alias("depth"), "sound")


@query("SELECT n_nationkey query_id, 'n' || n_nationkey id, n_name AS text FROM nation")
def tr9_lookup(spark, sf_dir):
    """Each nation's name finds its leaf: no summary scores below a leaf's 1 except through the fixed comparison, which then gives the summary's best leaf."""
    made = summary_tree(spark, sf_dir)
    nodes = made.nodes.read().filter("text is not null").select("id", "type", "text", hashed(F.col("text")).alias("embedding"))
    asked = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), hashed(F.col("n_name")).alias("q"))
    best = trees.lookup(nodes.filter("type = 'leaf'"), made.edges.read(), asked, 2)
    return best


@query()
def tr10_expand(spark, sf_dir):
    """Regions put in one after another, then one taken out."""
    made = trees.Tree(spark, new_root(spark, "expand"), hashed, saver(spark, "expand"))
    made.expand([(f"s{r.r_regionkey}", r.r_name) for r in read(spark, sf_dir, "region").orderBy("r_regionkey").collect()], lambda old, new, n: None)
    made.reduce(spark.createDataFrame([("s1",)], "str_id string"))
    return made.nodes.read().select("type", "text", "depth")
