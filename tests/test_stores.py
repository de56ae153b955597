"""Stores, indexes, trees, readers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from meshlore.functions.embeddings import encode, hashed
from meshlore.operators import graph, knowledge, retrieval, trees
from meshlore.sources import parquet
from meshlore.sources.index import Composer, LexicalIndex, VectorIndex, check_retrieval
from meshlore.sources.parquet import Store, Workspace
from meshlore.streaming.ingest import ingest


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}"


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_store(spark, root):
    kv = lambda rows: spark.createDataFrame(rows, "id string, value int")
    with Store(spark, root, "kv", "id") as s:
        assert s.is_open() and s.count() == 0 and values(s.exist(kv([("a", 1)])), "id", "found") == [("a", False)]
        s.create(kv([("a", 1), ("b", 2)]))
        s.create(kv([("a", 9), ("c", 3)]))
        s.upsert(kv([("b", 7)]))
        s.update(kv([("c", 4), ("z", 0)]))
        s.delete(kv([("c", 0), ("q", 0)]))
        assert values(s.read(), "id", "value") == [("a", 1), ("b", 7)] and s.count() == 2
        assert values(s.read_ids(kv([("b", 0), ("b", 0)]), ["value"]), "id", "value") == [("b", 7)]
        for bad in ([(None, 1)], [("x", 1), ("x", 2)]):
            with pytest.raises(ValueError, match="key"):
                s.upsert(kv(bad))
        with pytest.raises(ValueError, match="null"):
            s.create(kv([(None, 1)]))
    with pytest.raises(ValueError, match="closed"):
        s.read()
    s.open().clear()
    assert s.count() == 0
    with pytest.raises(ValueError, match="empty"):
        s.read()


def test_the_second_of_two_writers_fails(spark, root):
    row = spark.createDataFrame([("a", 1)], "id string, value int")
    s = Store(spark, root, "kv", "id")
    s.create(row)
    after, old = s._old()
    s.upsert(row)
    with pytest.raises(RuntimeError, match="another"):
        s._commit(old, after)
    assert s.count() == 1


def test_sizes_of_all_stores(spark, root):
    for name, rows in (("qa/answers", 2), ("qa/plan/steps", 1), ("mem", 3)):
        at, last = name.rpartition("/")[0], name.rpartition("/")[2]
        Store(spark, f"{root}/{at}".rstrip("/"), last, "id").create(spark.range(rows))
    assert parquet.store_sizes(spark, root) == {"qa/answers": 2, "qa/plan/steps": 1, "mem": 3}
    parquet.clear_stores(spark, f"{root}/qa")
    assert parquet.store_sizes(spark, root) == {"mem": 3} and parquet.store_sizes(spark, f"{root}/none") == {}


def test_retries():
    calls, again = [], []

    @parquet.retried(3, 0, again=again.append)
    def shaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise ConnectionError
        return x

    assert shaky(5) == 5 and calls == [5] * 3 and again == [5] * 2
    with pytest.raises(ConnectionError):
        parquet.retried(2, 0)(lambda: (_ for _ in ()).throw(ConnectionError()))()


def test_dumps_readers_and_environments(spark, root, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    first = parquet.dump(df, root, "t")
    assert parquet.dump(df, root, "t") == first != parquet.dump(df, root, "t", rewrite=False)
    assert values(parquet.load(spark, first), "id", "text") == [(1, "x")]
    (tmp_path / "c.csv").write_text('title,context,cntx_idx,hash\n"A ""b""","one, two\nthree",0,h\n')
    assert values(parquet.contexts_csv(spark, f"{root}/c.csv"), "text") == [('Title: A "b"\none, two\nthree',)]
    (tmp_path / "q.csv").write_text('question,cntx_ids\nwhy,"[1, 2]"\n')
    assert [r.cntx_ids for r in parquet.qa_csv(spark, f"{root}/q.csv").collect()] == [[1, 2]]
    (tmp_path / "d.json").write_text(json.dumps({"data": [{"text_dialog": "hi", "time": "now"}]}))
    assert values(parquet.dialogs_json(spark, f"{root}/d.json"), "text", "time") == [("hi", "now")]
    base = parquet.create_environment(spark, root, "env", {"lang": "en"})
    assert parquet.find_environments(spark, root) == ["env"] and parquet.load_environment(spark, base) == {"lang": "en"}
    with pytest.raises(ValueError, match="exists"):
        parquet.create_environment(spark, root, "env", {})
    (tmp_path / "env" / "kv").rmdir()
    with pytest.raises(ValueError, match="kv"):
        parquet.load_environment(spark, base)
    with pytest.raises(ValueError, match="back end"):
        parquet.source(spark, "unknown", {})


def test_vector_index(spark, root):
    rows = spark.createDataFrame([("a", "cat dog", {"k": "v"}), ("b", "dog", {"k": "w"}), ("c", "tree", {})], "id string, document string, metadata map<string,string>")
    index = VectorIndex(spark, root, "v", hashed)
    index.create(rows)
    index.create(rows.filter("id = 'a'").withColumn("document", F.lit("other")))
    assert values(index.read(rows.select("id"), ["documents"]), "id", "document") == [("a", "cat dog"), ("b", "dog"), ("c", "tree")]
    asked = spark.createDataFrame([(1, "dog")], "query_id int, text string").withColumn("q", hashed(F.col("text")))
    assert [r.id for r in index.retrieve(asked, 2).orderBy("rank").collect()] == ["b", "a"]
    assert index.retrieve(asked, 0).count() == 0 and index.retrieve(asked, 5, asked.select("query_id", F.lit("c").alias("id"))).count() == 1
    index.delete(rows.filter("id = 'b'").select("id"))
    assert values(index.exist(rows), "id", "found") == [("a", True), ("b", False), ("c", True)] and index.count() == 2
    for bad, why in ((rows.withColumn("embedding", F.array(F.lit(1.0))), "made here"), (rows.withColumn("id", F.lit(1)), "strings"), (rows.union(rows), "twice"), (rows.withColumn("metadata", F.create_map(F.lit("k"), F.lit(None).cast("string"))), "missing")):
        with pytest.raises(ValueError, match=why):
            index.create(bad)
    with pytest.raises(ValueError, match="needed"):
        VectorIndex(spark, root, "w").create(rows)
    for k, includes in (("3", None), (True, None), (3, ["texts"])):
        with pytest.raises(ValueError):
            check_retrieval(k, includes)
    both = Composer({"one": index, "two": VectorIndex(spark, root, "two", hashed)})
    assert values(both.exist(rows), "id", "found") == [("a", False), ("b", False), ("c", False)]
    both.upsert(rows)
    assert both.counts() == {"one": 3, "two": 3}
    both.clear()
    assert both.counts() == {"one": 0, "two": 0}


@pytest.mark.parametrize("few", [2048, 2])
def test_dense_topk_in_blocks(spark, monkeypatch, few):
    """Against all products, with ties, lengths that differ, nulls and groups."""
    import random

    monkeypatch.setattr(retrieval, "FEW_QUERIES", few)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 20)
    rng = random.Random(1)
    rows = [(f"v{i:03d}", [float(rng.randint(-2, 2)) for _ in range(3 if i % 7 else 2)], i % 2) for i in range(80)] + [("none", None, 0)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>, g int").repartition(3)
    queries = [(q, [float(rng.randint(-2, 2)) for _ in range(3)], q % 2) for q in range(7)]
    asked = spark.createDataFrame(queries, "query_id int, q array<double>, g int")
    for same in (None, "g"):
        want = set()
        for q, x, g in queries:
            scored = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v, h in rows if v and len(v) == 3 and (same is None or g == h))
            want |= {(q, i, -s, r + 1) for r, (s, i) in enumerate(scored[:5])}
        assert {tuple(r) for r in retrieval.dense_topk(df, asked, 5, same=same).collect()} == want


def test_lexical_index(spark, root):
    index = LexicalIndex(spark, root)
    docs = spark.createDataFrame([("a", "the cat sat"), ("b", "a dog, a cat"), ("c", None)], "id string, text string")
    index.create(docs)
    index.create(spark.createDataFrame([("a", "changed")], "id string, text string"))
    index.upsert(spark.createDataFrame([("b", "only birds here")], "id string, text string"))
    asked = spark.createDataFrame([(1, "cat"), (2, "birds dog")], "query_id int, text string")
    now = spark.createDataFrame([("a", "the cat sat"), ("b", "only birds here"), ("c", None)], "id string, text string")
    assert values(index.retrieve(asked, 5), "query_id", "id", "score", "rank") == values(retrieval.bm25(now, asked, 5), "query_id", "id", "score", "rank") != []
    assert all(0 < r.score < 1 for r in index.retrieve(asked, 5, scale=True).collect())
    assert index.retrieve(asked, 5, asked.select("query_id", F.lit("c").alias("id"))).count() == 0
    index.delete(docs.filter("id = 'a'"))
    assert values(index.retrieve(asked, 5), "query_id", "id") == [(2, "b")] and index.count() == 2 and values(index.read(docs), "id") == [("b",), ("c",)]
    with pytest.raises(ValueError, match="no embeddings"):
        index.create(docs.withColumn("embedding", F.lit(1)))


def test_embeddings(spark):
    rows = spark.createDataFrame([(1, "b a"), (2, "a b"), (3, ""), (4, None)], "id int, text string")
    v = {r.id: r.v for r in rows.withColumn("v", hashed(F.col("text"))).collect()}
    assert v[1] == pytest.approx(v[2]) and sum(x * x for x in v[1]) == pytest.approx(1) and v[3] == [0.0] * 16
    got = {r.id: r.e for r in encode(rows, "text", "passage", lambda texts: [[3.0, 4.0 * t.startswith("passage: ")] for t in texts], "e", 2).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.6, 0.8], 3: [0.6, 0.8], 4: None}


def test_knowledge(spark, root):
    rows = [("object", "a", "simple", "r", "object", "b"), ("object", "b", "simple", "r", "object", "c"), ("object", "a", "hyper", "hyper", "hyper", "t"), ("object", "c", "hyper", "hyper", "hyper", "t")]
    t = graph.triplets(spark.createDataFrame(rows, "s_type string, s_name string, r_type string, r_name string, e_type string, e_name string"))
    store = knowledge.Knowledge(spark, root, hashed)
    assert store.add(t).count() == 4 and store.add(t).count() == 0 and store.vectors.count() == 4 + 3  # a thesis has one relation
    assert [r.consistent for r in store.check().collect()] == [True] * 3
    store.save_origin(t.select(F.lit(1).alias("text_id"), "t_id").union(t.filter("s_name = 'a'").select(F.lit(2), "t_id")))
    with pytest.raises(ValueError, match="known"):
        store.save_origin(t.select(F.lit(2).alias("text_id"), "t_id"))
    assert values(store.of_triplets(t.filter("s_name = 'b'")), "text_ids") == [([1],)]
    store.forget(spark.createDataFrame([(1,)], "text_id int"))
    assert values(store.triplets.read(), "s_name", "e_name") == [("a", "b"), ("a", "t")]
    assert values(store.vectors.read(), "text") == [("a",), ("a r b",), ("b",), ("t",), ("t",)]
    assert values(store.of_texts(spark.createDataFrame([(1,), (2,)], "text_id int")), "text_id") == [(2,)]
    new = graph.triplets(spark.createDataFrame([("time", "now", "time", "time", "hyper", "t")], "s_type string, s_name string, r_type string, r_name string, e_type string, e_name string"))
    with pytest.raises(ValueError, match="time"):
        knowledge.update(store, new, lambda c: c.select("t_id"))


def test_tree(spark, root):
    node = "parent string, id string, str_id string, type string, text string, depth int"
    tree = trees.Tree(spark, root, hashed, Workspace(spark, "tree").save)
    make = lambda *rows: spark.createDataFrame(list(rows), node)
    tree.create(make(("root", "s", None, "summarized", "pets", 1)))
    tree.create(make(("s", "l1", "x1", "leaf", "cat", 2), ("s", "l2", "x2", "leaf", "dog", 2)))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    for bad, why in ((make(("no", "n", "y", "leaf", "t", 2)), "parent"), (make(("s", "l1", "y", "leaf", "t", 2)), "there already"), (make(("s", "n", None, "leaf", "t", 2)), "valid"), (make(("s", "n", "y", "leaf", "t", None)), "valid"), (make(("s", "n", "y", "twig", "t", 2)), "valid")):
        with pytest.raises(ValueError, match=why):
            tree.create(bad)
    with pytest.raises(ValueError, match="children"):
        tree.delete(ids("s"))
    assert tree.max_depth() == 2 and values(tree.children(ids("s")), "child") == [("l1",), ("l2",)] and values(tree.exist(ids("s", "q")), "id", "found") == [("q", False), ("s", True)]
    assert values(tree.read(spark.createDataFrame([("x2",)], "str_id string"), "str_id"), "id") == [("l2",)] and tree.check().first().sound
    assert tree.insert("x3", "cat", lambda old, new, n: f"{old}+{new}/{n}") == "success" and tree.insert("x3", "cat", None) == "already_exist"
    rows = {r.str_id or r.id: (r.type, r.text, r.depth) for r in tree.nodes.read().collect()}
    # no child of the root is similar enough to a cat: the leaf hangs there
    assert rows["x3"] == ("leaf", "cat", 1)
    assert tree.insert("x4", "pets", lambda old, new, n: f"{old}+{new}/{n}") == "success"
    rows = {r.str_id or r.id: (r.type, r.text, r.depth) for r in tree.nodes.read().collect()}
    assert rows["s"] == ("summarized", "pets+pets/2", 1) and rows["x4"] == ("leaf", "pets", 2)
    assert tree.insert("x5", "cat", lambda old, new, n: None) == "success"  # onto the leaf x3, which becomes a summary of both
    rows = {r.str_id or r.id: (r.type, r.text, r.depth) for r in tree.nodes.read().collect()}
    assert rows["root/x3"] == ("summarized", "cat, cat", 1) and rows["x3"] == ("leaf", "cat", 2) and rows["x5"] == ("leaf", "cat", 2)
    tree.reduce(spark.createDataFrame([("x3",), ("x5",)], "str_id string"))
    assert values(tree.counts(), "type", "n") == [("leaf", 3), ("root", 1), ("summarized", 1)]


def test_tree_lookup(spark):
    nodes = spark.createDataFrame([("a", "leaf", "x", [1.0, 0.0]), ("b", "leaf", "y", [0.8, 0.6]), ("s", "summarized", "z", [0.9, 0.4])], "id string, type string, text string, embedding array<double>")
    edges = spark.createDataFrame([("root", "s"), ("s", "a"), ("s", "b")], "parent string, child string")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, q array<double>")
    assert values(trees.lookup(nodes, edges, asked, 2, 0), "query_id", "id") == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    assert values(trees.lookup(nodes, edges, asked, 2), "query_id", "id") == [(1, "a"), (2, "b")]
    assert values(trees.lookup(nodes.filter("type = 'leaf'"), edges, asked, 2), "query_id", "id") == [(1, "a"), (2, "b")]
    with pytest.raises(NotImplementedError):
        trees.lookup(nodes, edges, asked, 2, strategy="traversal")


def test_streaming_adds_each_text_once(spark, root, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"t": "one"}) + "\n" + json.dumps({"t": "one"}))
    store = Store(spark, root, "triplets", "t_id")
    take = lambda df: df.select(F.col("t").alias("episode"), F.lit("who").alias("entity"), F.concat(F.lit("said "), "t").alias("thesis"), F.lit(None).cast("string").alias("time"))
    for name in ("1", "2"):
        ingest(spark, f"{root}/in", "t string", take, store, f"{root}/checkpoint{name}").awaitTermination()
    assert values(store.read(), "r_type") == [("episodic",), ("episodic",), ("hyper",)]
