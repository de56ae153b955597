"""Goldens of ids and renderings, and graph and fusion operators against plain models."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from meshlore.functions import ids, parsers
from meshlore.operators import astar, corpus, graph, memory, retrieval, tasks, theses
from meshlore.sources.parquet import Store, Workspace


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def props(*pairs):
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in pairs])


def test_ids(spark):
    assert one(spark, ids.create_id(F.lit("abc"))) == "900150983cd24fb0d6963f7d28e17f72"
    assert one(spark, ids.create_id(ids.node_text(F.lit("abc"), props(("k1", "v1"))))) == "79ab7fd2f1bd8070bd3b4d8b75139e61"
    assert one(spark, ids.node_text(F.lit("abc"), props(("time", "12.12.2012")))) == "12.12.2012: abc"
    assert one(spark, ids.cache_key(F.array(F.lit("a"), F.lit("b")))) == "5463504435e4dbf2b93a3a8a00ca78e36ea40e24"
    assert one(spark, ids.cache_key(F.array(F.lit("b"), F.lit("a")))) == "b7d99985b3cf2b2e59215451e8b633a6671bd533"


def test_triplet_ids(spark):
    t = graph.triplets(spark.createDataFrame([("object", "abc", "simple", "def", "object", "abc")], "s_type string, s_name string, r_type string, r_name string, e_type string, e_name string")).first()
    assert (t.r_id, t.t_id, t.stringified) == ("5f4ba4d09985c36535de3534c4645a54", "c6c46a9e92e6f18d8c6c8f7a2c75d2c1", "abc def abc")
    with pytest.raises(Exception, match="can't join"):
        graph.triplets(spark.createDataFrame([("time", "a", "simple", "b", "object", "c")], "s_type string, s_name string, r_type string, r_name string, e_type string, e_name string")).collect()


def made_graph(spark, n=30, m=60):
    rng = random.Random(1)
    rows = {("object", f"n{rng.randrange(n)}", "simple", "to", "object", f"n{rng.randrange(n)}") for _ in range(m)}
    return graph.triplets(spark.createDataFrame(sorted(rows), "s_type string, s_name string, r_type string, r_name string, e_type string, e_name string"))


def neighbours(t):
    near: dict = {}
    for a, b in graph.undirected(t).select("a", "b").distinct().collect():
        near.setdefault(a, set()).add(b)
    return near


def distances(near, start):
    level, out, k = {start}, {start: 0}, 0
    while level:
        k += 1
        level = {y for x in level for y in near[x]} - set(out)
        out |= dict.fromkeys(level, k)
    return out


def test_hops(spark):
    t = made_graph(spark)
    near = neighbours(t)
    start = sorted(near)[0]
    got = graph.hops(t, spark.createDataFrame([(start,)], "seed string"), 4, Workspace(spark, "t").save)
    assert {r.b: r.hop for r in got.collect()} == {k: v for k, v in distances(near, start).items() if v <= 4}


def test_astar_without_heuristic_finds_shortest_paths(spark):
    t = made_graph(spark, 12, 15)
    near = neighbours(t)
    edges = graph.undirected(t).select("a", "b").distinct()
    pairs = [(a, b) for a in sorted(near) for b in sorted(near) if a < b]
    got = astar.astar(edges, spark.createDataFrame(pairs, "start string, goal string"), Workspace(spark, "astar").save, None, "zero", None, 50, 60, -1)
    paths = {(r.start, r.goal): r.path for r in got.collect()}
    assert set(paths) == set(pairs)
    for (start, goal), path in paths.items():
        assert path[-1] == start and all(b in near[a] for a, b in zip(path, path[1:]))
        d = distances(near, start).get(goal)
        assert (path[0] == goal and len(path) == d + 1) if d is not None else path[0] != goal


def test_astar_bounds(spark):
    """A line with branches: vectors lead along it; caps, depth and number of nodes cut it off."""
    edges = [(f"n{i}", f"n{i + 1}") for i in range(4)] + [(f"n{i}", f"x{i}{k}") for i in range(4) for k in range(2)]
    both = spark.createDataFrame([e for a, b in edges for e in ((a, b), (b, a))], "a string, b string")
    angle = lambda i: [math.cos(i / 10), math.sin(i / 10)]
    v = spark.createDataFrame([(f"n{i}", angle(i)) for i in range(5)] + [(f"x{i}{k}", angle(-9 - k)) for i in range(4) for k in range(2)], "id string, embedding array<double>")
    pair = spark.createDataFrame([("n0", "n3"), ("n0", "n0")], "start string, goal string")

    def go(**more):
        out = astar.astar(both, pair, Workspace(spark, "bounds").save, v, **{"metric": "ip", "cap": 25, **more})
        return {(r.start, r.goal): r.path for r in out.collect()}

    line = [f"n{i}" for i in range(3, -1, -1)]
    assert go(depth=4) == {("n0", "n3"): line, ("n0", "n0"): ["n0"]}
    assert go(depth=4, cap=1)["n0", "n3"] == line  # the nearest to the goal is the next one
    near = go(depth=2)["n0", "n3"]
    assert near[-1] == "n0" and len(near) <= 3
    assert go(depth=4, passed=3)["n0", "n3"] == ["n1", "n0"]  # the third one is not looked at
    hops = spark.createDataFrame([("n3", f"n{i}", abs(3 - i)) for i in range(5)], "seed string, b string, hop int")
    assert go(depth=4, metric="avg_weighted_with_short_path", hops=hops)["n0", "n3"] == line
    assert one(spark, astar.heuristic("avg_weighted_with_short_path", F.lit(0.5), F.lit(1.0), F.lit(3))) == 4.5
    assert one(spark, astar.heuristic("weight_with_short_path", F.lit(0.5), F.lit(1.0), F.lit(None).cast("int"))) == 0.5 * 1_000_001
    with pytest.raises(ValueError, match="metric"):
        astar.heuristic("none", F.lit(0), F.lit(0), F.lit(0))
    assert [tuple(r) for r in astar.path_edges(hops.select(F.lit("a").alias("start"), F.lit("c").alias("goal"), F.array(F.lit("c"), F.lit("b"), F.lit("a")).alias("path")).limit(1)).orderBy("a").collect()] == [("a", "c", "b", "a"), ("a", "c", "c", "b")]
    seeds = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c"), (2, "z")], "query_id int, seed string")
    assert sorted(tuple(r) for r in astar.seed_pairs(seeds).collect()) == [(1, "a", "b"), (1, "a", "c"), (1, "b", "c")]


@pytest.mark.parametrize(("width", "passed"), [(2, 50), (100, 50), (4, 7), (-1, -1)])
def test_bfs(spark, width, passed):
    """What holds of a walk: every node has one triplet's other end seen before it, levels come in order, first ones first, up to `passed` nodes."""
    t = made_graph(spark)
    near, between = neighbours(t), {}
    for r in graph.undirected(t).select("a", "b", "t_id").collect():
        between.setdefault((r.a, r.b), set()).add(r.t_id)
    looked = {a: [b for b in sorted(bs)[: width if width >= 0 else None] if b != a] for a, bs in near.items()}
    got, want = graph.bfs(t, spark.createDataFrame([(x,) for x in near], "seed string"), 3, width, Workspace(spark, "t").save, passed), set()
    for seed in near:
        order, level = [seed], [seed]
        for _ in range(3):
            fresh = {}
            for a in level:
                fresh |= {b: a for b in looked[a] if b not in order and b not in fresh}
            level = list(fresh)[: None if passed < 0 else max(0, passed - len(order) + 1)]
            order += level
            want |= {(seed, i) for b in level for i in between[fresh[b], b]}
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("paths", [1, 100_000])
def test_beam(spark, paths):
    """All paths of up to 3 edges that can't go on, or the cheapest step each time."""
    t, rng = made_graph(spark, 12, 14), random.Random(2)
    edges = graph.undirected(t).select("a", "b", "t_id", "r_id").collect()
    seeds, cost = sorted({e.a for e in edges})[:3], {r: rng.uniform(0.1, 1) for r in sorted({e.r_id for e in edges})}
    scores = spark.createDataFrame([(s, r, x) for s in seeds for r, x in cost.items()], "seed string, r_id string, s double")
    got = graph.beam(t, spark.createDataFrame([(s,) for s in seeds], "seed string"), lambda ext: ext.join(scores, ["seed", "r_id"]), 3, paths, 0.75, Workspace(spark, "t").save)
    want = {}
    for seed in seeds:
        live = [((seed,), (), 0.0)]
        for _ in range(3):
            out = []
            for nodes, ids_, acc in live:
                more = [((*nodes, e.b), (*ids_, e.t_id), acc - math.log(cost[e.r_id])) for e in edges if e.a == nodes[-1] and e.b not in nodes]
                more.sort(key=lambda x: (x[2], x[1]))
                if not more and ids_:
                    want[seed, ids_] = acc / len(ids_) ** 0.75
                out += more[:paths]
            live = out
        want |= {(seed, i): acc / len(i) ** 0.75 for _, i, acc in live}
    if paths == 1:  # one of each seed stays
        want = {k: v for k, v in want.items() if (v, k[1]) == min((x, i[1]) for i, x in want.items() if i[0] == k[0])}
    assert {(r.seed, tuple(r.t_ids)): r.cost for r in got.collect()} == pytest.approx(want)


def test_overlap(spark):
    pairs = [("a b c d", "a c d e f"), ("a", "b"), ("a a a", "a b"), ("X y", "x Y z"), ("b a", "a b")]

    def common(x, y):
        return 0 if not x or not y else 1 + common(x[1:], y[1:]) if x[0] == y[0] else max(common(x[1:], y), common(x, y[1:]))

    for r in spark.createDataFrame(pairs, "x string, y string").select("x", "y", corpus.bleu1(F.col("x"), F.col("y")).alias("bleu"), corpus.rouge_l(F.col("x"), F.col("y")).alias("rouge")).collect():
        x, y = r.x.lower().split(), r.y.lower().split()
        assert r.rouge == pytest.approx(2 * common(x, y) / (len(x) + len(y)))
        hits = sum(min(x.count(w), y.count(w)) for w in set(x))
        assert r.bleu == pytest.approx(hits / len(x) * min(1, math.exp(1 - len(y) / len(x))))


def test_tree_health(spark):
    sound = lambda rows: memory.tree_health(spark.createDataFrame(rows, "parent string, child string")).first().sound
    assert sound([("r", "a"), ("r", "b")]) and not sound([("r", "a"), ("s", "b")]) and not sound([("r", "a"), ("r", "b"), ("b", "a")])


def test_fusion(spark):
    row = lambda *x: spark.createDataFrame([(0, i, r + 1) for r, i in enumerate(x)], "query_id int, id string, rank int")
    got = {r.id: r.score for r in retrieval.fused([row("x", "y", "z"), row("z", "x")], [0.7, 0.3], 10).collect()}
    assert got == pytest.approx({"x": 0.0163141195, "z": 0.0160291439, "y": 0.0112903226}, abs=1e-9)
    with pytest.raises(ValueError, match="sum"):
        retrieval.fused([row("x")], [0.5], 1)


def test_statistics(spark):
    rows = [(1, 7, 3.5), (None, 8, 4.0), (3, 9, 4.5), (4, None, 5.0), (5, 11, None), (6, 12, 7.0)]
    got = {r.column: r for r in memory.statistics(spark.createDataFrame(rows, "a int, b int, c double"), ["a", "b", "c"]).collect()}
    assert (got["a"].n, got["a"].n_not_null, got["a"].median, got["a"].mean, got["a"].std) == (6, 5, 4.0, 3.8, 1.72)
    assert memory.statistics(spark.createDataFrame([], "a int"), ["a"]).first()["mean"] is None


def test_parsers(spark):
    assert [tuple(x) for x in one(spark, parsers.triplet_lines(F.lit("a | b | c;\nd | e | f.\nno")))] == [("a", "b", "c"), ("d", "e", "f")]
    assert one(spark, parsers.after_marker(F.lit("x [ANSWER] yes "), "answer")) == "yes"
    assert one(spark, parsers.detect_language(F.lit("привет"))) == "ru"


def test_threshold(spark):
    assert one(spark, memory.adaptive_threshold(F.lit(1), F.lit(2))) == pytest.approx(0.3664208274)


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}", "kv", "id")
    s.create(spark.createDataFrame([("a", 1), ("b", 2)], "id string, value int"))
    s.create(spark.createDataFrame([("a", 9), ("c", 3)], "id string, value int"))
    s.upsert(spark.createDataFrame([("b", 7)], "id string, value int"))
    s.delete(spark.createDataFrame([("c",)], "id string"))
    assert {r.id: r.value for r in s.read().collect()} == {"a": 1, "b": 7} and s.count() == 2
    s.clear()
    assert s.count() == 0


def test_contract():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def ladder_end(scores, levels):
    """The first threshold that more than one text passes, or a single one if the next is 0.6; else the last."""
    passing = {v: sum(x > v for x in scores) for v in levels}
    enough = [v for v, after in zip(levels, [*levels[1:], None]) if passing[v] > (after != 0.6)]
    return enough[0] if enough else levels[-1]


def test_choice_of_theses(spark):
    """Of every question: which texts may be chosen, how many of each kind, and which come when no ladder lets any through."""
    rng = random.Random(3)
    seeds, rows = [], []
    for q in range(40):
        names = {e: rng.choice(["Ann", "oak", "Bob", "elm"]) + "xyz"[e] for e in range(rng.randint(1, 3))}
        seeds += [(q, e, n) for e, n in names.items()]
        for e in names:
            for i in range(rng.choice([0, 1, 3, 40])):
                rows.append((q, e, names[e], rng.choice(["hyper", "hyper", "episodic"]), f"t{q}.{e}.{i:03d}", rng.choice([0.0, 0.5, 0.7, 1.0, 1.2, 1.5, 2.0]), q % 3 == 0 and rng.random() < 0.3))
    s = spark.createDataFrame(seeds, "query int, entity int, seed string")
    r = spark.createDataFrame(rows, "query int, entity int, seed string, kind string, text string, score double, flag boolean").withColumn("t_id", F.col("text"))
    out: dict = {}
    for x in theses.choose(r, s, Workspace(spark, "test_theses").save).collect():
        out.setdefault((x.query, x.kind), []).append((x["rank"], x.text))
    for q in range(40):
        mine, own = [x for x in rows if x[0] == q], {e: n for k, e, n in seeds if k == q}
        cap = {k: int([1.0, 0.67, 0.5][len(own) - 1] * n) for k, n in theses.MOST.items()}
        flagged = [x for x in mine if x[6]]
        passed = [x for x in flagged if x[5] > ladder_end([y[5] for y in flagged], theses.LEVELS)]
        groups = [passed] if passed else []
        if not passed:
            for e, n in own.items():
                its = [x for x in mine if x[1] == e] if n[0].isupper() else []
                groups.append([x for x in its if x[5] > ladder_end([y[5] for y in its], theses.OWN_LEVELS)])
            if not any(groups):
                groups = [[x for x in mine if x[1] == max(own)]]
        for kind, most in theses.MOST.items():
            got = [t for _, t in sorted(out.get((q, kind), []))]
            allowed = [[x for x in g if x[3] == kind] for g in groups]
            assert len(got) == len(set(got)) == min(most, sum(min(cap[kind], len(g)) for g in allowed))
            assert set(got) <= {x[4] for g in allowed for x in g}
            if not passed and groups == [[x for x in mine if x[1] == max(own)]]:  # the best ones, no threshold
                assert got == [x[4] for x in sorted(allowed[0], key=lambda x: (-x[5], x[4]))][: cap[kind]]
    same = theses.choose(r, s, Workspace(spark, "test_same").save, same_types=True)
    assert same.groupBy("query", "kind").agg(F.max("rank").alias("m")).filter("m > if(kind = 'hyper', 25, 15)").count() == 0
    assert theses.choose(r.limit(0), s.limit(0), Workspace(spark, "test_no_theses").save).count() == 0


def test_mentions(spark):
    seeds = spark.createDataFrame([(1, 0, "Anna"), (1, 1, "кошка"), (1, 2, "red Fox"), (1, 2, None), (2, 0, "Solo")], "query int, entity int, seed string")
    made = [(1, 0, "Anna", "hyper", "Anna saw a FOX, red", "a", ["кошка"]), (1, 0, "Anna", "hyper", "кошку", "b", None), (1, 0, "Anna", "hyper", None, "c", None), (2, 0, "Solo", "hyper", "Solo", "d", [])]
    t = spark.createDataFrame(made, "query int, entity int, seed string, kind string, text string, t_id string, values array<string>")
    got = {r.t_id: (r.score, r.flag) for r in theses.mention_scores(t, seeds).collect()}
    assert got == {"a": (1.2, True), "b": (0.5, False), "d": (0.0, False)}


def test_tasks(spark):
    rows = spark.createDataFrame([(1, "hi {x}"), (2, ""), (3, "123"), (4, "hi {x}"), (5, "привет")], "id int, t string")
    prompts = spark.createDataFrame([("en", "s", "Say {text}!", None), ("ru", "s", "{text} {gone}", None)], "lang string, system string, user string, assistant string")
    space = Workspace(spark, "test_tasks")
    calls = tasks.batched(lambda system, user, assistant: (f"[Answer] {user}", 1, 2, 0.0))
    go = lambda cache: tasks.solve(rows, {"text": F.col("t")}, prompts, calls, lambda raw: parsers.after_marker(raw, "answer"), Workspace(spark, "test_solve").save, cache=cache)
    got, new = go(None)
    want = {1: ("Say hi {x}!", "success"), 2: (None, "empty_input_text"), 3: (None, "not_supported_lang"), 4: ("Say hi {x}!", "success"), 5: (None, "bad_user_prompt")}
    assert {r.id: (r.result, r.status) for r in got.collect()} == want
    assert new.count() == 1
    kept = space.save(new, "kept")
    again, newer = go(kept)
    assert {r.id for r in again.filter("cache_hit").collect()} == {1, 4} and newer.count() == 0


def test_bleu2(spark):
    score = lambda a, b: one(spark, corpus.bleu2(F.lit(a), F.lit(b)))
    assert score("a b c", "a b c") == pytest.approx(1.0)
    assert score("a b d", "a b c d") == pytest.approx(math.sqrt(1.0 * 0.5) * math.exp(1 - 4 / 3))
    assert score("b a", "a b") == 0.0 and score("a", "a") == 0.0
