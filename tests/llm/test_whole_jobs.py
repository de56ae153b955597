"""Cases that earlier versions of the operators did not cover."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from meshlore.llm import decontaminate, line_dedup, near_copies

NAMED = "doc_id long, text string"


def prose(rng, n):
    return [f"{rng.choice('bdfgklmnprst')}{rng.randrange(9000)}" for _ in range(n)]


def jaccard(a, b):
    a, b = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("block", [1024, 3])
def test_near_copies_by_blocks(spark, monkeypatch, block):
    """Blocks added, dropped and replaced, scattered words, chains; against all pairs."""
    import corpus_pipeline

    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng, texts = random.Random(6), []
    for share in (0.04, 0.08, 0.12, 0.16, 0.19, 0.24, 0.3, 0.4) * 3:
        base = prose(rng, 250)
        n = int(share * 250)
        edits = [base + prose(rng, n), base[n:], base[: 125 - n // 2] + prose(rng, n // 2) + base[125:]]
        texts += [" ".join(t) for t in [base, *edits]]
    base = prose(rng, 60)
    texts += [" ".join(base[:i] + ["other"] + base[i + 1 :]) for i in range(0, 60, 4)]
    texts += ["", None, "one two", "one two"]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if comp[i] != comp[j] and jaccard(texts[i] or "", texts[j] or "") >= 0.8:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    rows = [*enumerate(texts), (0, "quite another text of the same id"), (0, texts[0]), (None, texts[0])]
    docs = spark.createDataFrame(rows, NAMED).repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    want = [(i, texts[i]) for i in sorted(set(comp))] + [(0, rows[-3][1]), (None, texts[0])]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_pairs_around_the_bound():
    """Pairs of similarity 0.6 to 0.95 by block edits: all from 0.8 on are linked, none below."""
    rng, ids, seen = random.Random(1), near_copies.WordHashes(), set()
    for _ in range(300):
        base = prose(rng, rng.randint(200, 400))
        n = max(1, int(rng.uniform(0.03, 0.45) * len(base)))
        a, b = " ".join(base), " ".join(rng.choice([base + prose(rng, n), base[n:]]))
        sets = [near_copies.shingle_set(ids, t) for t in (a, b)]
        met = len(set(near_copies.band_keys(sets[0]).tolist()) & set(near_copies.band_keys(sets[1]).tolist())) > 0
        linked = met and near_copies.similar_links(sets, [0, 1]) == [(0, 1)]
        assert linked == (jaccard(a, b) >= 0.8)
        seen.add(linked)
    assert seen == {True, False}


def test_near_copies_meet_by_pigeonholes():
    """Whatever the sample, fingerprints within TAU bits agree in a partition within its threshold."""
    rng = np.random.default_rng(4)
    one = rng.integers(0, 256, (1, near_copies.BITS // 8), np.uint8)
    for sample in (one[:0], one, np.repeat(one, 50, 0), rng.integers(0, 256, (400, near_copies.BITS // 8), np.uint8) & rng.integers(0, 256, near_copies.BITS // 8, np.uint8)):
        groups, thresholds = near_copies.partitions(sample, 1000)
        assert sorted(b for g in groups for b in g) == list(range(near_copies.BITS))
        assert sum(thresholds) == near_copies.TAU - near_copies.PARTS + 1 and min(thresholds) >= -1
        for _ in range(50):
            flip = np.zeros(near_copies.BITS, np.uint8)
            flip[rng.permutation(near_copies.BITS)[: near_copies.TAU]] = 1
            a, b = near_copies.partition_values(np.concatenate([one, one ^ np.packbits(flip)]), groups)
            assert (np.bitwise_count(a ^ b) <= np.array(thresholds)).any()


@pytest.mark.parametrize("large", [256, 3])
def test_candidate_links_equal_all_pairs(monkeypatch, large):
    """Components of the links of small and large buckets, against all pairs."""
    monkeypatch.setattr(near_copies, "LARGE", large)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 64, (6, 2), np.uint64)
    c = base[rng.integers(0, 6, 120)]
    for i in range(120):
        for b in rng.integers(0, 128, 18).tolist():
            c[i, b >> 6] ^= np.uint64(1 << (b & 63))
    k, role = np.sort(rng.integers(0, 9, 120)).astype(np.int32), rng.integers(0, 2, 120).astype(np.int8)

    def classes(pairs):
        comp = np.arange(120)
        for i, j in pairs:
            comp[comp == comp[j]] = comp[i]
        return {frozenset(np.flatnonzero(comp == x).tolist()) for x in comp}

    want = [(i, j) for i in range(120) for j in range(i) if k[i] == k[j] and not (role[i] and role[j]) and np.bitwise_count(c[i] ^ c[j]).sum() <= near_copies.NEAR]
    assert 5 < len(want) and classes(zip(*(x.tolist() for x in near_copies.near_pairs(k, role, c)))) == classes(want)


@pytest.mark.parametrize("large", [256, 3])
def test_links_of_a_bucket_are_fewer_than_its_rows(monkeypatch, large):
    """A group of 200 equal prints, and rows of which some are known to be together: a forest, with the components of all pairs."""
    monkeypatch.setattr(near_copies, "LARGE", large)
    rng = np.random.default_rng(9)
    x, y = near_copies.near_pairs(np.zeros(200, np.int32), np.zeros(200, np.int8), np.ones((200, 2), np.uint64))
    assert len(x) == len(y) == 199
    c = rng.integers(0, 1 << 64, (5, 2), np.uint64)[rng.integers(0, 5, 150)]
    for i in range(150):
        for b in rng.integers(0, 128, 18).tolist():
            c[i, b >> 6] ^= np.uint64(1 << (b & 63))
    k, role, node = np.sort(rng.integers(0, 6, 150)).astype(np.int32), rng.integers(0, 2, 150).astype(np.int8), rng.integers(0, 60, 150)
    x, y = near_copies.near_pairs(k, role, c, node)
    for one in range(6):
        rows = np.flatnonzero(k == one)
        got, want = ({n: n for n in node[rows].tolist()} for _ in range(2))
        near = [(i, j) for i in rows for j in rows if not (role[i] and role[j]) and np.bitwise_count(c[i] ^ c[j]).sum() <= near_copies.NEAR]
        for comp, pairs in ((want, near), (got, [(i, j) for i, j in zip(x, y) if k[i] == one])):
            for i, j in pairs:
                old, new = comp[node[i]], comp[node[j]]
                comp.update({n: new for n, r in comp.items() if r == old})
        assert len({(got[n], want[n]) for n in got}) == len(set(got.values())) == len(set(want.values()))
        assert (k[x] == one).sum() == len(got) - len(set(got.values()))


def test_a_group_of_near_copies_makes_few_links(spark):
    """400 texts that differ in a word or two, 40 others: one component, told about once and not again by each partition."""
    from meshlore.llm.common import Scratch

    rng = random.Random(12)
    base = prose(rng, 120)
    texts = [" ".join([*base[: (at := rng.randrange(120))], f"own{i}", *base[at + 1 :]]) for i in range(400)] + [" ".join(prose(rng, 120)) for _ in range(40)]
    scratch = Scratch(spark, "test")
    nodes = scratch.save(near_copies.prints(spark, spark.createDataFrame(list(enumerate(texts)), NAMED).repartition(3)), "prints")
    links = [(r.a, r.b) for r in near_copies.candidates(spark, nodes, scratch).collect()]
    comp = {r.node: r.node for r in nodes.select("node").collect()}
    for a, b in links:
        old, new = comp[a], comp[b]
        comp.update({n: new for n, r in comp.items() if r == old})
    made = spark.read.parquet(f"{scratch.root}/near-early").count(), spark.read.parquet(f"{scratch.root}/near").count()
    scratch.drop()
    assert Counter(Counter(comp.values()).values()) == {400: 1, 1: 40}
    assert made[0] <= near_copies.EARLY * 399 and made[1] < 400 and len(links) < 3 * 400


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 3), (3, 5), (3, 9), (None, 3), (12, 11), (4, 4), (-7, 12)] + [(i, i + 1) for i in range(100, 140)]])
def test_components_in_one_task_and_in_rounds(spark, edges):
    from meshlore.llm.common import Scratch
    from meshlore.llm.components import connected_components

    scratch, table = Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long")
    one = connected_components(spark, table, scratch, "one", few=1000)
    assert one.inputFiles() and all("one-few" in x for x in one.inputFiles())
    got, want = (sorted(map(tuple, x.collect())) for x in (one, connected_components(spark, table, scratch, "all", few=len(set(edges)) // 2)))
    scratch.drop()
    assert got == want and (len(edges) < 2 or got[0] == (-7, -7) and (140, 100) in got)


def later_runs(rows):
    """Runs that the two tasks of line dedup find in one batch of (doc_id, key, text)."""
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], ["did", "rk", "text"])
    (found,) = line_dedup._fingerprint_task(30)(iter([batch]))
    order = found.filter(pa.compute.equal(found["kind"], 1)).select(["k", "did", "rk", "at", "windows"]).sort_by("k")
    known = [(r["did"], r["rk"], r["at"], r["to"]) for r in found.to_pylist() if not r["kind"]]
    halves = [order.slice(i, 1) for i in range(order.num_rows)]
    once = [tuple(r.values()) for out in line_dedup._later_task(iter([order])) for r in out.to_pylist()]
    assert once == [tuple(r.values()) for out in line_dedup._later_task(iter(halves)) for r in out.to_pylist()]
    return known + once


def test_windows_alike_in_one_hash_differ(monkeypatch):
    doc, first, k, none = np.array([0, 1, 2]), np.array([0, 0, 0]), np.full(3, 5, np.uint64), np.zeros(3, np.uint64)
    monkeypatch.setattr(line_dedup, "windows", lambda texts, n: (doc, first, first + 2, k, none, np.array([7, 8, 8], np.uint64)))
    assert later_runs([(1, 1, "x"), (2, 2, "y"), (3, 3, "z")]) == [(3, 3, 0, 3)]


def test_offsets_over_16_bits(monkeypatch):
    doc, first, k = np.array([0, 1, 1]), np.array([0, 0, 70_000]), np.full(3, 5, np.uint64)
    monkeypatch.setattr(line_dedup, "windows", lambda texts, n: (doc, first, first + 2, k, np.array([9, 8, 9], np.uint64), np.zeros(3, np.uint64)))
    assert later_runs([(1, 1, "x"), (2, 2, "y")]) == [(2, 2, 70_000, 70_003)]


def test_passage_late_in_a_text_of_one_fingerprint(spark):
    """Every second line of a text of 80,000 lines is the same; a passage that an earlier text holds starts at line 71,000."""
    rng = random.Random(2)
    common = next(x for x in (f"common {i} line" for i in range(10**6)) if line_dedup.xxhash.xxh64_intdigest(x) < 1 << 46)
    passage = [x for _ in range(20) for x in (" ".join(prose(rng, 4)), common)]
    lines = [x for _ in range(40_000) for x in (" ".join(prose(rng, 4)), common)]
    lines[71_000:71_040] = passage
    docs = spark.createDataFrame([(1, "\n".join(passage)), (2, "\n".join(lines))], NAMED)
    for hot in (line_dedup.HOT_BYTES, 1 << 30):
        got = {r.doc_id: [tuple(x) for x in r.line_dedup_removed] for r in line_dedup.drop_repeated_lines(spark, docs, hot_bytes=hot).collect()}
        assert got[1] == [] and len(got[2]) == 1 and got[2][0][0] in (70_999, 71_000) and got[2][0][1] in (71_039, 71_040, 71_041)


@pytest.mark.parametrize("parts", [1, 4])
def test_repeated_rows_stay_whole(spark, parts):
    rng = random.Random(8)
    long, other = (". ".join(" ".join(prose(rng, 12)) for _ in range(8)) + "." for _ in range(2))
    rows = [(3, long), (3, long), (None, other), (None, other), (4, long), (4, long), (5, "Start here. " + other)]
    docs = spark.createDataFrame(rows, NAMED).repartition(parts)
    got = sorted(((r.doc_id, r.text) for r in line_dedup.drop_repeated_lines(spark, docs).collect()), key=repr)
    assert got == sorted([(3, long), (3, long), (None, other), (None, other), (4, ""), (4, ""), (5, "Start here. ")], key=repr)


def test_documents_shorter_than_an_item():
    rng = random.Random(5)
    items = [prose(rng, n) for n in (50, 200, 6, 4)]
    known = decontaminate.Items([(i, " ".join(x)) for i, x in enumerate(items)])

    ids = decontaminate.WordIds()

    def found(words):
        return known.leaks(decontaminate.words_hashes(ids, " ".join(words)))

    for item, low in ((0, 41), (1, 161)):  # 37 of 46 and 157 of 196 shingles are the fewest
        n = len(items[item])
        for m in range(low - 3, n):
            want = [(item, pytest.approx((m - 4) / (n - 4)), 0, m)] if m >= low else []
            assert found(items[item][:m]) == want == found(items[item][n - m :])
    assert found(items[2][:5]) == found(items[3][:3]) == []
    assert found(["new", *items[0][:45], "words"]) == [(0, pytest.approx(41 / 48), 0, 47)]


def brute_leaks(items, words):
    """{item: (similarity, first word)} of a text, over all its windows of an item's size; a shorter text is one window."""
    out = {}
    for i, item in enumerate(items):
        w = min(5, len(item))
        want = Counter(tuple(item[k : k + w]) for k in range(len(item) - w + 1))
        n = min(len(item), len(words))
        for x in range(len(words) - n + 1 if n >= w else 0):
            have = Counter(tuple(words[k : k + w]) for k in range(x, x + n - w + 1))
            low = (want & have).total()
            sim = low / (want.total() + have.total() - low)
            if sim >= 0.8 and sim > out.get(i, (0, 0))[0]:
                out[i] = (sim, x)
    return out


@pytest.mark.parametrize("few", [64, 0])
def test_windows_against_brute_force(monkeypatch, few):
    """Items copied whole, edited, cut, repeated and run together; stretches shorter than a text."""
    monkeypatch.setattr(decontaminate, "STRETCH", 64)
    rng, ids = random.Random(4), decontaminate.WordIds()
    items = [prose(rng, n) for n in [1, 2, 3, 4, 5, 6, 9, 15, 15, 15, 18, 24, 30, 30, 41, 59, 59, 120]] + [["a", "b"] * 20]
    items += [items[12][:20] + prose(rng, 3), items[12]]
    known = decontaminate.Items([(i, " ".join(x)) for i, x in enumerate(items)], few)
    found = wanted = right = 0
    for _ in range(250):
        words = prose(rng, rng.choice([0, 3, 40]))
        for _ in range(rng.randint(1, 4)):
            item = list(rng.choice(items))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(item) + 1)
                item[at : at + rng.choice([0, 1])] = rng.choice([[], ["x1"], ["x2", "x3"]])
            words += item[rng.choice([0, 0, 1, 3]) :] + prose(rng, rng.choice([0, 0, 5, 90]))
        want = brute_leaks(items, words)
        got = {y: (sim, x) for y, sim, x, _ in known.leaks(decontaminate.words_hashes(ids, " ".join(words)))}
        found, wanted = found + len(got), wanted + len(want)
        right += sum(want.get(y) == (pytest.approx(sim), x) for y, (sim, x) in got.items())
    assert right == found and found >= 0.995 * wanted and wanted > 250


def test_blocks_find_all_within_the_radius_and_little_else():
    rng = np.random.default_rng(3)
    items = rng.integers(0, 1 << 32, (3000, 4), np.uint64).astype(np.uint32)
    known = decontaminate.Items([(i, f"w{i} a b c d e") for i in range(3000)], 0)
    (n,) = known.by_size
    known.prints, known.tables = items, {n: decontaminate.HalfTables(items)}
    own = items[:200].copy()
    for row in own:
        for bit in rng.choice(128, rng.integers(0, 34), replace=False).tolist():
            row[bit // 32] ^= np.uint32(1 << bit % 32)
    apart = np.bitwise_count(own[:, None] ^ items[None]).sum(2, dtype=np.int64)
    w, i = known.pairs(own, n)
    assert sorted(zip(w.tolist(), i.tolist())) == sorted(map(tuple, np.argwhere(apart <= decontaminate.RADIUS).tolist()))
    passed = (np.bitwise_count(own[:, None] ^ items[None]) <= decontaminate.IN_BLOCK).any(2).mean()
    assert passed < 0.01


def test_workers_give_memory_back(spark):
    from meshlore.llm.common import LEAN, ship

    ship(spark)
    assert LEAN and all(spark.sparkContext.environment.get(name) for name in LEAN)


def test_weights_at_places_make_no_table():
    """Same weights as the whole table's, without an array of the table's size."""
    import tracemalloc

    from meshlore.llm.common import Ftrl

    model, rng = Ftrl(1 << 18), np.random.default_rng(2)
    model.z[:], model.n[:] = rng.normal(0, 3, model.size + 1), rng.random(model.size + 1)
    at = np.array([3, 70, model.size])
    want = model.weights()[at]
    tracemalloc.start()
    got = model.weights(at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and peak < 100_000
