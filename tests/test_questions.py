"""Retrievers, reasoners, chains, graph reports and corpus preparation on small made inputs."""

import hashlib
import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from meshlore.functions import parsers, prompts
from meshlore.functions.embeddings import hashed
from meshlore.operators import chains, corpus, graph, knowledge, reasoning, retrievers, tasks
from meshlore.sources.parquet import Workspace
from tests.test_engine import made_graph, neighbours, one

ROWS = "s_type string, s_name string, r_type string, r_name string, e_type string, e_name string"


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def saver(spark, label="questions"):
    return Workspace(spark, label).save


@pytest.fixture(scope="module")
def small(spark):
    simple = [("Ann", "knows", "Bob"), ("Bob", "knows", "Cid"), ("Ann", "lives in", "Rome"), ("Dan", "lives in", "Rome"), ("Eve", "likes", "tea")]
    rows = [("object", s, "simple", r, "object", o) for s, r, o in simple] + [("object", "Ann", "hyper", "hyper", "hyper", "Ann is kind"), ("object", "Ann", "episodic", "episodic", "episodic", "a long talk")]
    t = graph.triplets(spark.createDataFrame(rows, ROWS)).cache()
    return t, knowledge.vector_rows(t, hashed).cache()


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string").withColumn("q", hashed(F.col("text")))


def test_rankings_are_checked():
    step = {"index": "dense", "fetch": 5, "threshold": 0.5}
    assert retrievers.checked("multi_step", {"steps": [step, step]})
    for strategy, config in (("none", {"steps": [step]}), ("single_step", {"steps": [step, step]}), ("multi_step", {}), ("single_step", {"steps": [{**step, "index": "x"}]}), ("single_step", {"steps": [{**step, "fetch": 0}]}),
                             ("single_step", {"steps": [{**step, "threshold": "x"}]}), ("ensemble_fusion", {"steps": [{**step, "weight": 0.5}]})):
        with pytest.raises(ValueError):
            retrievers.checked(strategy, config)


def test_retrievers(spark, small):
    t, v = small
    q = asked(spark, "Ann knows Bob", "tea")
    names = dict(values(t, "t_id", "stringified"))
    found = retrievers.naive(t, v, q, 2)
    assert ("Ann knows Bob" in {names[r.t_id] for r in found.collect() if r.query_id == 0}) and {r.query_id for r in found.collect()} == {0, 1}
    seeds = spark.createDataFrame([(0, f"object:{i}") for i in ("x",)], "query_id int, seed string")
    seeds = t.filter("s_name in ('Ann', 'Dan')").select(F.lit(0).alias("query_id"), F.concat(F.lit("object:"), "s_id").alias("seed")).distinct()
    between = retrievers.paths_between(t, v, seeds, saver(spark), "zero", cap=-1)
    assert {names[r.t_id] for r in between.collect()} == {"Ann lives in Rome", "Dan lives in Rome"}
    walked = retrievers.breadth_first(t, seeds, saver(spark), 1)
    assert {names[r.t_id] for r in walked.collect()} == {"Ann knows Bob", "Ann lives in Rome", "Ann is kind", "a long talk", "Dan lives in Rome"}
    kept = retrievers.filtered(walked, v, q)
    assert {names[r.t_id] for r in kept.collect()} == {"Ann knows Bob", "Ann lives in Rome", "Ann is kind", "Dan lives in Rome"}
    assert retrievers.filtered(walked, v, q, 2).count() == 2
    out = {r.query_id: (r.status, r.n) for r in retrievers.retrieve(q, walked, lambda x: retrievers.filtered(x, v, q)).collect()}
    assert out == {0: ("success", 4), 1: ("zero_retrieved_triplets", 0)}
    first, second = walked.withColumn("t_id", F.lit("1")), walked.limit(1).withColumn("t_id", F.lit("2"))
    assert sorted(r.t_id for r in retrievers.mixture(first, second).collect()) == ["1"] * 4 + ["2"]
    beams = retrievers.beams(t, v, q, seeds, saver(spark), threshold=0.0, depth=2)
    assert {r.query_id for r in beams.collect()} == {0} and "Ann knows Bob" in {names[r.t_id] for r in beams.collect()}


def test_components_and_neighbour_counts(spark):
    t = made_graph(spark, 40, 30)
    near = neighbours(t)
    label = {}
    for a in sorted(near):
        todo = [a]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = a
                todo += near[x]
    assert {r.node: r.root for r in graph.components(t, saver(spark)).collect()} == label
    path = graph.triplets(spark.createDataFrame([("object", f"p{i}", "simple", "to", "object", f"p{i + 1}") for i in range(40)], ROWS))
    assert values(graph.component_sizes(path, saver(spark)), "size", "n") == [(41, 1)]
    want = sorted(len(x) for x in near.values())
    got = graph.neighbour_counts(t, [("object", "simple", "object")]).first()
    assert (got.n_targets, got["min"], got["max"]) == (len(want), want[0], want[-1]) and got["mean"] == round(sum(want) / len(want), 3)
    ratios = {r.ratio: r.value for r in graph.node_ratios(t).collect()}
    assert ratios["edges_per_node"] == round(t.count() / len(near), 3) and ratios["episodic_per_hyper"] is None


def test_chains(spark, small):
    t, _ = small
    seeds = spark.createDataFrame([(1, 0, "Ann"), (1, 1, "Bob"), (1, 2, "Dan"), (2, 0, "Eve")], "query int, entity int, seed string")
    edges = seeds.join(graph.expand_by_names(t, seeds.select("seed").distinct()), "seed")
    names = dict(values(t, "t_id", "stringified"))
    got = chains.joined(edges, seeds, t)
    assert sorted((r.query, r.entity, r.kind, names[r.t_id], r.hits) for r in got.collect()) == [(1, 0, 1, "Ann knows Bob", 1), (1, 0, 2, "Ann lives in Rome", 0), (1, 1, 1, "Ann knows Bob", 1), (1, 2, 2, "Dan lives in Rome", 0)]
    texts = spark.createDataFrame([], "query int, t_id string")
    out = chains.assembled(got, edges, seeds, texts)
    assert sorted((r.query, r.source, names[r.t_id]) for r in out.collect()) == [(1, "chain", "Ann knows Bob"), (1, "chain", "Ann lives in Rome"), (1, "chain", "Dan lives in Rome"), (2, "other", "Eve likes tea")]
    enough = spark.createDataFrame([(2, "a"), (2, "b")], "query int, t_id string")
    assert {r.source for r in chains.assembled(got, edges, seeds, enough).filter("query = 2").collect()} == {"text"}


def provider(answers):
    """Answers by the first word of the system prompt."""
    def give(requests):
        said = F.coalesce(*[F.when(F.col("system").startswith(k), F.lit(v)) for k, v in answers.items()], F.lit("nothing"))
        return requests.select("key", said.alias("raw"), *[F.lit(0).cast("long").alias(c) for c in ("prompt_tokens", "generated_tokens")], F.lit(0.0).alias("elapsed"))

    return give


@pytest.mark.parametrize("style", ["openai", "ollama"])
def test_chat_servers(spark, style):
    seen = []

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization")))
            said = "[Answer] " + body["messages"][-1]["content"].upper()
            out = {"choices": [{"message": {"content": said}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}} if style == "openai" else {"message": {"content": said}, "prompt_eval_count": 3, "eval_count": 4}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = tasks.batched(tasks.chat(f"http://127.0.0.1:{server.server_port}", "m", style, {"temperature": 0}, "secret"))
    rows = spark.createDataFrame([("k", "be brief", "hello", None)], "key string, system string, user string, assistant string")
    assert [(r.raw, r.prompt_tokens, r.generated_tokens) for r in ask(rows).collect()] == [("[Answer] HELLO", 3, 4)]
    server.shutdown()
    assert set(seen) == {("/chat/completions" if style == "openai" else "/api/chat", "Bearer secret")}
    with pytest.raises(Exception, match="refused"):
        tasks.chat(f"http://127.0.0.1:{server.server_port}", "m", style, trials=2, wait=0, timeout=1)("a", "b", None) if not server.server_close() else None
    with pytest.raises(ValueError, match="style"):
        tasks.chat("", "m", "other")


def test_preprocessing_statuses(spark):
    q = spark.createDataFrame([("a", "first and second?")], "question_id string, query string")
    go = lambda answers, **steps: reasoning.preprocess(reasoning.Asker(spark, provider(answers), saver(spark)), q, **steps).first()
    good = {"Remove": "[Answer] clean", "Make": "[Answer] full", "Tell": "True", "Split": "- one\n- two"}
    r = go(good, enhance=True)
    assert (r.better, r.processed, r.status) == ("full", ["one", "two"], "success")
    assert go({**good, "Tell": "False"}).processed == ["clean"]
    assert go({**good, "Tell": "hm"}).status == "empty_answer" and go({**good, "Remove": "hm"}).status == "bad_parser"


def test_reasoners_statuses(spark, small):
    t, v = small
    nodes = v.filter("type = 'object'").select("id", "text", "embedding")
    q = spark.createDataFrame([("a", "Where is Ann?")], "question_id string, query string")
    u = graph.undirected(t).filter("r_type = 'simple'").select(F.col("a").alias("seed"), "t_id")
    near = lambda _, seeds: seeds.join(u, "seed").select("query_id", "t_id").distinct()
    none = lambda _, seeds: seeds.select("query_id", F.lit("x").alias("t_id")).limit(0)
    say = {"Name": "Ann", "Answer from the": "[Answer] in Rome", "Write numbered": "1. find Ann\n2. find Rome", "Ask": "[Answer] where is Ann", "Say": "[Answer] Rome", "Put": "[Answer] it is Rome", "Answer from what": "[Answer] Rome at last"}

    def run(reasoner, answers, retrieve=near, **more):
        return tuple(reasoner(reasoning.Asker(spark, provider(answers), saver(spark)), q, nodes, t, hashed, retrieve, **more).first())

    assert run(reasoning.weak, say) == ("a", "in Rome", "success")
    assert run(reasoning.weak, say, none) == ("a", None, "zero_retrieved_triplets")
    assert run(reasoning.weak, {**say, "Name": " | "}) == ("a", None, "bad_parser")
    assert run(reasoning.medium, {**say, "Tell whether what": "True"}, steps=1) == ("a", "Rome at last", "success")
    stays = {**say, "Tell whether what": "False", "Tell whether the rest": "False"}
    assert run(reasoning.medium, stays, steps=2) == ("a", reasoning.NO_ANSWER, "success")
    assert run(reasoning.medium, stays, steps=1, behaviour="answer") == ("a", "Rome at last", "success")
    assert run(reasoning.medium, {**say, "Write numbered": "no plan"}, steps=2) == ("a", None, "bad_parser")
    with pytest.raises(ValueError, match="behaviour"):
        run(reasoning.medium, say, behaviour="other")


def test_parts_are_put_together(spark):
    rows = spark.createDataFrame([(1, "q", 0, "one", "success"), (2, "q", 0, "x", "success"), (2, "q", 1, "y", "success"), (3, "q", 0, "x", "success"), (3, "q", 1, None, "bad_parser")], "question_id int, query string, no int, answer string, status string")
    got = reasoning.aggregate(reasoning.Asker(spark, provider({"Make one": "[Answer] x and y"}), saver(spark)), rows)
    assert values(got.fillna("-"), "question_id", "answer", "status") == [(1, "one", "success"), (2, "x and y", "success"), (3, "-", "bad_parser")]
    with pytest.raises(ValueError, match="no task"):
        prompts.suite(spark, "none")
    assert {r.lang for r in prompts.suite(spark, "judge", {"de": ("a", "b")}).collect()} == {"en", "ru", "de"}


def test_extraction_and_statuses(spark):
    texts = spark.createDataFrame([(1, "T", "now", "a | b | c", "th | ['a', 'd']"), (2, "U", None, "no", "no")], "text_id int, text string, time string, r string, th string")
    got = knowledge.extract(texts, F.col("r"), F.col("th"))
    assert values(got.filter("text_id = 1"), "s_name", "r_type", "e_name") == [("a", "episodic", "T"), ("a", "episodic", "T"), ("a", "hyper", "th"), ("a", "simple", "c"), ("c", "episodic", "T"), ("d", "episodic", "T"), ("d", "hyper", "th"), ("now", "time", "T"), ("now", "time", "th"), ("th", "episodic", "T")]
    assert values(got.filter("text_id = 2"), "status") == [("zero_triplets",)]


def test_properties_are_part_of_ids(spark):
    texts = spark.createDataFrame([(1, "T", "May", [("lang", "en"), ("type", "x")], "a | b | c", "th | ['a']")], "text_id int, text string, time string, props array<struct<k:string,v:string>>, r string, th string")
    rows = knowledge.extract(texts, F.col("r"), F.col("th"))
    t = graph.triplets(rows.filter("status = 'success'").drop("status"))
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    got = {(r.s_name, r.r_type, r.e_name, r.s_id): (r.stringified, r.e_id) for r in t.collect()}
    seen = "May: a (lang: en)"
    assert got["a", "simple", "c", md5("a")] == ("May: a b (lang: en) c", md5("c"))
    assert got["a", "hyper", "th", md5(seen)] == ("May: th (lang: en)", md5("May: th (lang: en)"))
    assert {k[3] for k in got if k[:2] == ("a", "episodic")} == {md5("a"), md5(seen)}
    assert got["May", "time", "T", md5("May")] == ("May: T (lang: en)", md5("May: T (lang: en)"))


def test_parsers_of_bad_answers(spark):
    assert one(spark, parsers.triplet_lines(F.lit("a | . | c"))) is None and one(spark, parsers.triplet_list(F.lit("a, , c"))) is None
    for bad in (parsers.triplet_lines(F.lit("a | . | c"), True), parsers.triplet_list(F.lit(""), True)):
        with pytest.raises(Exception, match="no triplets"):
            one(spark, bad)
    assert [tuple(x) for x in one(spark, parsers.triplet_list(F.lit("Sure: 1. A, b, 'C'; x, y; 2. d, e, f.")))] == [("a", "b", "c"), ("d", "e", "f")]
    assert one(spark, parsers.name_list(F.lit("a | | b"), 2)) is None and one(spark, parsers.name_list(F.lit("a | | b"))) == ["a", "b"]
    assert one(spark, parsers.summary(F.lit("x [Output Summary]\nshort"))) == "short" and one(spark, parsers.summary(F.lit(" whole. "))) == "whole" and one(spark, parsers.summary(F.lit(" . "))) is None
    assert one(spark, parsers.replacements(F.lit("none here"))) == [] and one(spark, parsers.theses(F.lit("a | b | [c]\nd | nothing"))) == []


def test_chunks(spark):
    """Every paragraph is in a chunk, chunks keep to their size, overlaps to theirs, long paragraphs are covered."""
    rng = random.Random(4)
    docs = []
    for i in range(30):
        paragraphs = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([3, 20, 60, 90, 250]))).strip() + str(k) for k in range(rng.randint(0, 8))]
        docs.append((i, rng.choice(["\n\n", "\n \n", "\n\n\n"]).join(paragraphs), paragraphs))
    rows = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(99, None)], "doc_id int, text string")
    got: dict = {}
    for r in corpus.chunks(rows, 100, 30).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert 99 not in got
    for i, _, paragraphs in docs:
        mine = got.get(i, [])
        assert all(len(c) <= 100 for c in mine) and len(mine) == len(set(mine))
        for p in paragraphs:
            if len(p) <= 100:
                assert any(p in c.split("\n\n") for c in mine)
            else:
                assert all(any(p[k : k + 20] in c for c in mine) for k in range(len(p) - 20))
        for a, b in zip(mine, mine[1:]):
            shared = [p for p in b.split("\n\n") if p in a.split("\n\n")]
            assert len("\n\n".join(shared)) <= 30


def test_answerable_and_faults(spark):
    kept = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    qa = spark.createDataFrame([(300_000, "a", [1]), (7, "b", [1, 2]), (9, "b", [1]), (8, "c", [9]), (1, "d", []), (200_000, "e", [3, 3])], "qa_id int, question string, refs array<int>")
    assert values(corpus.answerable(qa, kept), "new_id", "qa_id", "n_refs") == [(0, 7, 2), (1, 200_000, 1), (2, 300_000, 1)]
    assert values(corpus.answerable(qa, kept, 1), "qa_id") == [(7,)]
    assert dict(values(corpus.dataset_faults(qa, kept), "fault", "n")) == {"repeated_questions": 1, "repeated_ids": 0, "without_references": 1, "repeated_documents": 0, "unknown_references": 1, "unused_documents": 0}
    left = corpus.tagged(qa.withColumn("tags", F.when(F.col("qa_id") == 7, F.array(F.lit("no-answer")))), kept)
    assert values(left, "qa_id") == [(9,), (200_000,), (300_000,)]
    contexts, questions = corpus.multi_hop(qa, kept)
    assert values(contexts, "doc_id", "qa_ids") == [(1, [7, 9, 300_000]), (2, [7]), (3, [200_000])] and questions.count() == 4


def test_scores_of_packs(spark):
    rows = [("p", "x", 1.0, 2.0), ("p", None, 9.0, 1.0), ("p", "none", 0.0, 1.0), ("r", "y", 1.0, 1.0)]
    packs = corpus.answer_scores(spark.createDataFrame(rows, "pack string, answer string, em double, time double"), ["em"], "none")
    assert values(packs, "pack", "em", "null_share", "nothing_share", "time") == [("p", 0.5, 0.33333, 0.33333, 4.0), ("r", 1.0, 0.0, 0.0, 1.0)]
    assert tuple(corpus.pack_means(packs).first()) == (0.75, 0.16667, 0.16667, 5.0)
    calls = spark.createDataFrame([("l", 1, 2, 1), ("l", 2, 3, 1)], "log string, question int, a long, b long")
    means = spark.createDataFrame([("a", 10.0, 0.5), ("b", 1.0, 1.0)], "task string, prompt_tokens double, generated_tokens double")
    assert values(tasks.token_sums(calls, means), "task", "calls", "prompt_tokens", "generated_tokens") == [("a", 5, 50.0, 2.5), ("b", 2, 2.0, 2.0)]
