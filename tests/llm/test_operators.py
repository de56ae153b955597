"""The training-data operators against brute force, round trips and held-out accuracy, with nulls, empties, ties, repeats and extra columns."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from meshlore.llm import ann, decontaminate, line_dedup, packing, pii, simhash, suffix_dedup, token_counts, toxicity
from meshlore.llm.components import connected_components
from meshlore.llm.common import Scratch
from meshlore.llm.tokens import default_path, encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n=8):
    return " ".join("".join(rng.choice(["an", "er", "th", "io", "la", "qu", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [" ".join(sentence(rng) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    passage = " ".join(sentence(rng) for _ in range(9))
    out = base + base[:6] + [b + "\n" + passage + "\nEnd." for b in base[10:14]] + [passage, passage[:150], "a" * 900, "", None, "x", base[3].replace(" an", " er", 1)]
    out.append("Same line here. " * 60)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "src0", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumnRenamed("lang", "score")  # a name that results use too


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def repeats(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[j : j + length] for b in raw for j in range(len(b) - length + 1))
    out = []
    for b in raw:
        cover = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if n[b[j : j + length]] > 1:
                cover[j : j + length] = True
        out.append(bytes(x for x, c in zip(b, cover) if not c))
    return out


@pytest.mark.parametrize(("hot", "heavy", "rows"), [(20_000, 32, 1 << 20), (1, 32, 1 << 20), (1, 1, 1), (20_000, 2, 3)])
def test_repeated_spans(docs, texts, hot, heavy, rows):
    got = {r.doc_id: r for r in suffix_dedup.repeated_spans(docs.sparkSession, docs, hot=hot, heavy=heavy, heavy_rows=rows).collect()}
    for i, kept in enumerate(repeats(texts)):
        assert bytes(got[i].kept) == kept, i
        assert got[i].n_bytes - sum(s.end - s.start for s in got[i].spans) == len(kept)


def test_repeated_spans_of_equal_rows(spark, empty):
    text = " ".join(sentence(random.Random(9)) for _ in range(20))
    rows = spark.createDataFrame([(1, text), (1, text), (None, "short")], "doc_id long, text string")
    assert sorted(len(r.kept) for r in suffix_dedup.repeated_spans(spark, rows).collect()) == [0, 0, 5]
    assert suffix_dedup.repeated_spans(spark, empty).count() == 0


def test_column_rounds():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 2, (60, 14)).astype(np.int16)
    symbols[rng.random((60, 14)) < 0.05] = -1
    group = np.sort(rng.integers(0, 3, 60))
    got = suffix_dedup.column_rounds(group, symbols, 4)
    for i in range(60):
        for c in range(11):
            w = symbols[i, c : c + 4]
            want = (w >= 0).all() and any(j != i and group[j] == group[i] and (symbols[j, c : c + 4] == w).all() for j in range(60))
            assert got[i, c] == want


def test_simhash_components(spark, docs, texts):
    prints = [simhash.majority(simhash.shingles(simhash.words_of(t), 3)) for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r.doc_id: r for r in simhash.near_duplicates(spark, docs).collect()}
    assert [got[i].component_id for i in range(len(texts))] == comp
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == prints


@pytest.mark.parametrize(("tau", "m", "checked"), [(2, 3, None), (5, 3, None), (6, 4, 20)])
def test_links_in_hot_and_cool_buckets(spark, monkeypatch, tau, m, checked):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rng = random.Random(tau)
    base = [rng.getrandbits(64) for _ in range(6)]
    a = sorted({x ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1 for x in base for _ in range(25)})
    b = [rng.choice([0, 0, (1 << 30) - 1]) for _ in a]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    scratch = Scratch(spark, "test")
    nodes = scratch.save(spark.createDataFrame([(i, signed(x), y, 0) for i, (x, y) in enumerate(zip(a, b))], "node long, a long, b0 long, b1 long"), "nodes")
    if checked is None:
        nodes = scratch.save(nodes.selectExpr("a as node", "a", "b0", "b1"), "as_words")
    links = simhash.links_within(spark, nodes, scratch, tau, m, checked)
    roots = {r.node: r.root for r in connected_components(spark, links, scratch).collect()}
    name = (lambda i: i) if checked is not None else (lambda i: signed(a[i]))
    comp = {name(i): name(i) for i in range(len(a))}
    for _ in range(12):
        for i in range(len(a)):
            for j in range(i):
                if (a[i] ^ a[j]).bit_count() <= tau and (checked is None or (b[i] ^ b[j]).bit_count() <= checked):
                    comp[name(i)] = comp[name(j)] = min(comp[name(i)], comp[name(j)])
    assert {k: roots.get(k, k) for k in comp} == comp


def test_thresholds_sum_and_cost():
    assert simhash.allocate([[1, 5, 9], [100, 200, 300], [2, 3, 50]], 0) in ([1, -1, 0], [0, -1, 1])


@pytest.mark.parametrize("made", ["gaussian 256", "uneven norms", "clusters", "small norms beside large"])
def test_recall_on_vectors_of_all_sorts(made):
    rng, n = np.random.default_rng(6), 6000
    x = rng.standard_normal((n, 256 if "256" in made else 64))
    if made == "uneven norms":
        x *= np.exp(rng.standard_normal((n, 1)))
    elif made == "clusters":
        x += 3 * rng.standard_normal((60, 64))[rng.integers(0, 60, n)]
    elif made == "small norms beside large":
        x[: n // 2] *= 1e-3
    asked = rng.choice(n, 60, replace=False)
    hit = 0
    for i, (rows, _) in zip(asked, ann.Cell(x).search(x[asked], 21)):
        hit += len(set(rows.tolist()) & set(np.argsort(-(x @ x[i]), kind="stable")[:21].tolist()))
    assert hit / (21 * 60) >= 0.9


@pytest.mark.parametrize("cell_values", [ann.CELL_VALUES, 1000])
def test_nearest_neighbours(spark, cell_values):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[100:130] = x[7]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(4000 + i, [float(i), 1.0, -1.0]) for i in range(4)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] + [1.0] * 15), (5, [float(c) for c in x[5]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    got = ann.nearest(spark, df, F.col("vec_id") % 20 == 0, cell_values=cell_values).collect()
    by: dict = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == set(range(0, 900, 20)) | {4000} and [v for v, _ in by.pop(4000)] == [4001, 4002, 4003]
    hit, d = 0, x.astype(np.float64)
    for q, found in by.items():
        s = (d * d[q]).sum(1)
        s[q] = -np.inf
        top = np.lexsort((np.arange(900), -s))[:20]
        hit += len({v for v, _ in found} & set(top.tolist()))
        assert all(abs(s[v] - score) < 1e-12 for v, score in found) and len(found) == 20
    assert hit / (20 * len(by)) >= 0.9
    assert [v for v, _ in by[100]][:20] == [7, *range(101, 120)]
    assert ann.nearest(spark, df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_encoder_needs_no_look_ahead():
    """The pattern has none; texts are cut before the last space of a run that something follows, others stay whole."""
    from meshlore.llm import tokens

    enc = encoder(default_path())
    assert "(?" not in tokens.FLAT and enc.ranked.__self__._pat_str == tokens.FLAT
    assert enc._parts("a  b \n c  ") == ["a ", " b \n", " c  "] and enc._parts("é\u3000\xa0x\x1c y") == ["é\u3000", "\xa0x\x1c y"] and enc._parts("a b\nc") == ["a b\nc"]
    for t in ("a  b \n c  ", "é\u3000\xa0x\x1c y", "\n\n x"):
        assert np.frombuffer(enc.encode(t), enc.kind).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_equals_tokenizer(texts):
    enc = encoder(default_path())
    odd = [" a", "a ", "a  b", "x\n\ny z", "x \ny", "it's 's", "a\xa0b c", "<|endoftext|> z", "é ²³ x½ ", "ab_cd !!! 12ab", "\n", " ", "a\n\n\n b", "\n a", "x, y. z,\nB", "\x1c a", "日本 語"]
    for t in [*odd, *filter(None, texts)]:
        assert np.frombuffer(enc.encode(t), enc.kind).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
    rng = random.Random(1)
    spaces = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", *(chr(x) for x in [0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])]
    bits = ["a", "the", "Don't", "'s", "'ll", "x", "123", "½", "²", "é", "日本", "ß", "!!", "...", "—", "🙂", "_", "a_b", "<|endoftext", "<|endoftext|>", "İ", "ſ", "ﬁ", "\x00", "\u0301"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) if rng.random() < 0.6 else rng.choice(spaces) for _ in range(rng.randint(1, 14)))
        t += "".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x1F000)])) for _ in range(rng.randint(0, 3)))
        assert np.frombuffer(enc.encode(t), enc.kind).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_is_whole(spark, docs, texts, empty):
    rows = [r.asDict() for r in packing.pack(spark, docs, window=128, shard_tokens=4000).collect()]
    enc = encoder(default_path())
    want = {i: np.array(enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and bytes(r["ids"]) == ids[r["start"] : r["start"] + r["length"]].tobytes() and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts, whole in [(p, len(want[d])) for d, p in by_doc.items()] + [(p, None) for p in by_sequence.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at == whole if whole else at <= 128
    assert set(by_doc) == set(want)
    assert sum(map(len, want.values())) / (128 * len(by_sequence)) > 0.9
    assert packing.pack(spark, empty).count() == 0
    again = packing.pack(spark, docs.repartition(7, "text"), window=128, shard_tokens=4000)  # whatever the order of arrival
    assert sorted(map(repr, rows)) == sorted(repr(r.asDict()) for r in again.collect())


def test_terms_are_counted_while_encoding(spark, docs, texts, empty):
    """One pass gives the ids and the documents of each term; spaces are found in bytes; no lists of ids are made."""
    enc = encoder(default_path())
    assert enc.ranked.__name__ == "encode_to_numpy"
    found = packing.encoded(spark, docs.repartition(3), default_path(), 1).cache()
    whole = [enc.encode(t or "") + np.array([1], enc.kind).tobytes() for t in texts]
    assert sorted(bytes(r.ids) for r in found.filter("term is null").collect()) == sorted(whole)
    want = np.bincount(np.concatenate([np.unique(np.frombuffer(x, enc.kind)) for x in whole]), minlength=enc.size)
    n, total, df = packing.frequencies(found, enc.size)
    assert (n, total) == (len(texts), sum(map(len, whole)) // enc.kind.itemsize) and (df == want).all()
    n, total, df = packing.frequencies(packing.encoded(spark, empty, default_path(), 1), enc.size)
    assert (n, total, df.sum()) == (0, 0, 0)
    for kind in (np.uint16, np.uint32):
        for size in (0, 1, 500):
            ids = np.random.default_rng(size).integers(0, 200, size).astype(kind)
            terms, tf = np.unique(ids, return_counts=True)
            got, w = packing.weights(ids, np.ones(200), 100.0)
            assert got.tolist() == terms.tolist() and w.tolist() == (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / 100))).astype(np.float32).tolist()


def test_neighbours_and_keys(spark):
    """The index against a plain BM25 over all pieces, also after used ones left it; near copies share their key, hot keys are split."""
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 300, rng.integers(5, 60)).astype(np.uint16) for _ in range(80)]
    idf, mean = rng.random(300) + 0.1, 30.0
    for terms in (None, 6):
        shard, unused = packing.Shard(docs, idf, mean, 64, terms), np.ones(80, bool)

        def weights(d):
            t, n = np.unique(docs[d], return_counts=True)
            return dict(zip(t.tolist(), idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))))

        for seed in range(60):
            unused[seed] = False
            query = sorted(weights(seed).items(), key=lambda x: (-np.float32(x[1]), x[0]))[:terms]
            score = {d: sum(w.get(t, 0.0) for t, _ in query) for d in range(80) if unused[d] for w in [weights(d)]}
            want = sorted((d for d, x in score.items() if x), key=lambda d: (-score[d], d))
            got = np.concatenate(list(shard.neighbours(seed, unused))).tolist()
            assert set(got) == set(want) and [score[d] for d in got] == pytest.approx([score[d] for d in want], rel=1e-5)
    rare = rng.random(50_000) + 1
    key = lambda d: packing.content_key(d, rare, 400.0)
    assert np.mean([key(np.concatenate([d[:-2], d[-1:] // 2])) == key(d) for d in [rng.integers(0, 50_000, 400) for _ in range(200)]]) > 0.8
    assert packing.dealt_keys({1: 5, 2: 6, 3: 25, 4: 4, 9: 1}, 10) == ([(1, 0, 1), (2, 1, 1), (4, 1, 1), (9, 2, 1), (3, 3, 3)], 6)
    assert packing.dealt_keys({}, 10) == ([], 0)


@pytest.mark.parametrize("items_bytes", [decontaminate.ITEMS_BYTES, 300])
def test_leaks(spark, empty, items_bytes):
    rng = random.Random(3)
    items = [(i, sentence(rng, 12 + i)) for i in range(12)] + [(50, None), (51, ""), (52, "two words")]
    body = lambda: " ".join(sentence(rng) for _ in range(12))
    rows = [(i, body() + " " + t.upper() + " " + body()) for i, t in items if t and i < 12] + [(100, body()), (101, None), (102, ""), (103, "has two words in it")]
    long = sentence(rng, 60)
    words = long.split()
    near, far = " ".join([*words[:-1], "changed."]), " ".join(w if k % 5 else "other" for k, w in enumerate(words))
    bench = spark.createDataFrame([*items, (60, long)], "item_id long, text string")
    rows += [(200, body() + " " + near), (201, far), (None, near)]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(spark, spark.createDataFrame(rows, "doc_id long, text string"), bench, items_bytes, 1 << 16).collect()}
    assert set(got) == {(i, i) for i in range(12)} | {(103, 52), (200, 60), (None, 60)}
    assert got[200, 60] == pytest.approx(55 / 57) and all(got[i, i] == 1 for i in range(12))
    assert decontaminate.leaks(spark, empty, bench).count() == 0 and decontaminate.leaks(spark, bench.withColumnRenamed("item_id", "doc_id"), bench.limit(0)).count() == 0


def brute_lines(texts, min_words):
    """Without every line of a run of min_words words or more that an earlier place had, runs of any length."""
    seen, out = set(), []
    for t in texts:
        lines = line_dedup.lines_of(t or "")
        flat, gone = [x.strip() for x in lines], set()
        words = [x.count(" ") + 1 if x else 0 for x in flat]
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines) if words[a] else a):
                n += words[b]
                if n >= min_words and words[b]:
                    key = hash(tuple(flat[a : b + 1]))
                    if key in seen:
                        gone |= set(range(a, b + 1))
                    seen.add(key)
        out.append("".join(x for i, x in enumerate(lines) if i not in gone))
    return out


@pytest.mark.parametrize("hot", [line_dedup.HOT_BYTES, 1])
def test_repeated_lines(spark, docs, texts, empty, hot):
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(spark, docs, hot_bytes=hot).collect()}
    assert [got[i].text or "" for i in range(len(texts))] == brute_lines(texts, line_dedup.MIN_WORDS)
    assert set(docs.columns) < set(got[0].asDict()) and got[0].score == "en"
    assert line_dedup.drop_repeated_lines(spark, empty, hot_bytes=hot).count() == 0


@pytest.mark.parametrize("hot", [line_dedup.HOT_BYTES, 500])
def test_lines_under_one_fingerprint(spark, hot):
    """Lines of many sizes around one common line, blank lines, repeats inside a text, names that the operator uses itself."""
    rng = random.Random(12)
    common, made = sentence(rng, 3)[:-1] + ".", []
    parts = [sentence(rng, rng.choice([1, 2, 3, 12, 40])) for _ in range(30)]
    for _ in range(120):
        mid = [rng.choice(parts) if rng.random() < 0.5 else sentence(rng, rng.randint(1, 9)) for _ in range(rng.randint(1, 8))]
        mid += rng.choice([[], ["\n", common], [common, common], ["\n\n"]])
        made.append(" ".join([*rng.sample(parts, 2), common, *mid, common, *rng.sample(parts, 2)]))
    rows = [(i, t, "a", "b", "c") for i, t in enumerate(made)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, own_did string, runs string, line_dedup_n string").repartition(4)
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(spark, odd, hot_bytes=hot).collect()}
    assert [got[i].text for i in range(len(made))] == brute_lines(made, line_dedup.MIN_WORDS)
    assert got[0].own_did == "a" and got[0].runs == "b" and got[0].line_dedup_n == len(line_dedup.lines_of(made[0]))


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens(spark, docs, texts, rule):
    enc = encoder(default_path())
    got: dict = {}
    for r in token_counts.section_tokens(spark, docs, ["source", "text"], rule).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        whole = "src0\n" + (t or "")
        raw = whole.encode()
        sizes = token_counts.token_bytes(default_path())[enc.tokenizer.encode(whole, add_special_tokens=False).ids]
        ends = np.cumsum(sizes)
        starts = [0] + [k + 1 for k, b in enumerate(raw) if b == 10]
        want = [0] * len(starts)
        for e, n in zip(ends, sizes):
            own = [max(j for j, s in enumerate(starts) if s <= b) for b in range(e - n, e)]
            want[own[0] if rule == "first" else own[-1] if rule == "last" else max(sorted(set(own)), key=own.count)] += 1
        rows = sorted(got[i], key=lambda r: r.start)
        assert [r.n_tokens for r in rows] == want and rows[-1].end == len(whole)


def test_base_pii_equals_patterns():
    import re

    rng = random.Random(2)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(3000):
        t = "".join(rng.choice("ab1299..@@-+ ()%é\n") for _ in range(rng.randint(0, 60)))
        got = pii.base_spans(t)
        assert [x[1:] for x in got if x[0] == "email"] == [m.span() for m in email.finditer(t)], t
        assert [x[1:] for x in got if x[0] == "ip"] == [m.span() for m in ip.finditer(t) if all(int(p) < 256 for p in m[0].split("."))], t
    assert [k for k, *_ in pii.base_spans("a@b.co 4111 1111 1111 1111 x 10.0.0.1 +1 (988) 555-2485")] == ["email", "ip", "card", "phone"]
    assert pii.base_spans("") == [] and pii.base_spans("9" * 5000) == []


def test_field_finds_held_out_entities():
    model, rng, right, wrong, missed = pii.trained(), random.Random(77), 0, 0, 0
    for _ in range(200):
        text, gold = pii.made_sentence(rng)
        found = {(a, b): k for a, b, k in model.decode(text)}
        right += sum(gold.get(k) == v for k, v in found.items())
        wrong += sum(gold.get(k) != v for k, v in found.items())
        missed += sum(found.get(k) != v for k, v in gold.items())
    assert right > 9 * (wrong + missed)


WRITTEN = [  # by hand, not by the generator that the field learns from
    ("Please reach our office at 415-555-0132 before noon.", ["415-555-0132"]), ("order 123-456-7890 was shipped", []), ("My SSN is 078-05-1120, do not share it", ["078-05-1120"]),
    ("The wifi password is Sunflower42 and the router sits upstairs", ["Sunflower42"]), ("export AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY", ["wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY"]),
    ('key = "' + "a1" * 60 + '"', ["a1" * 60]), ("password: " + "qZkWpLmNxRtYvBsDfGhJ" * 3 + "abc7", ["qZkWpLmNxRtYvBsDfGhJ" * 3 + "abc7"]), ("password = correcthorsebatterystaple", ["correcthorsebatterystaple"]),
    ("the key: turn it twice to the left", []), ("token: none", []), ("Transfer to DE89370400440532013000 by Friday", ["DE89370400440532013000"]), ("IBAN GB29 1234 6016 1331 9268 19 is ours", ["GB29 1234 6016 1331 9268 19"]),
    ("In 2019 there were 1,234 cases and 56 deaths.", []), ("Version 10.15.7 was released on 2020-09-24.", []), ("Call (212) 555-7788 or fax 212-555-7789", ["(212) 555-7788", "212-555-7789"]), ("ISBN 978-3-16-148410-0 costs 12.50", []),
    ("git commit 9fceb02d0ae598e95dc970b74767f19372d61af8 fixed it", []), ("GITHUB_TOKEN=ghp_16C7e42F292c6912E7710c838347Ae178B4a", ["ghp_16C7e42F292c6912E7710c838347Ae178B4a"]), ("He scored 21 points in 35 minutes on 9-14 shooting", []),
    ("from 1914-1918 the war", []), ("db_password='hunter2hunter2'", ["hunter2hunter2"]), ("social security number 219-09-9999", ["219-09-9999"]), ("Ref 4455-2211, please quote it", []), ("pwd: Tr0ub4dor&3", ["Tr0ub4dor&3"]),
    ("Phone: 030.555.1234 extension 12", ["030.555.1234"]), ("see https://example.org/2014/05/item-334.html for more", []), ("invoice 202-555-0175 total 99.00", []), ('client_secret: "xYzZyPlUgHqWeRtY"', ["xYzZyPlUgHqWeRtY"]),
    ("A key insight: these 3 steps", []), ("SSN: 123-45-6789 DOB 1980-01-01", ["123-45-6789"]),
]


def test_field_on_written_sentences():
    model, found, wanted = pii.trained(), [], []
    for i, (text, want) in enumerate(WRITTEN):
        found += [(i, text[a:b]) for _, a, b in pii.added_spans(model, text, pii.base_spans(text))]
        wanted += [(i, x) for x in want]
    both = len(set(found) & set(wanted))
    assert both >= 0.9 * len(wanted) and both >= 0.9 * len(found)


def test_zones_end_between_runs():
    long = "Pass" + "word" * 30 + "9"
    assert [long in z for _, z in pii.zones("so it says " + long + " and more")] == [True]
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("ab1 \n=key:") for _ in range(rng.randint(0, 400)))
        got = list(pii.zones(t))
        assert all(t[a : a + len(z)] == z for a, z in got) and all(a + len(z) <= b for (a, z), (b, _) in zip(got, got[1:]))
        assert sum(c.isdigit() for _, z in got for c in z) == sum(c.isdigit() for c in t)


def test_pii_spans(spark, docs):
    df = spark.createDataFrame([(1, "é call (626) 555-5759 or a@b.example.com"), (2, None), (3, 'token = "841d82b07cb9b9f1fcb7cce52fad63a992695314" x')], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_pii(spark, df).collect()}
    assert got == {1: [("email", 25, 40), ("tel", 7, 21)], 2: [], 3: [("secret", 9, 49)]}


def test_counterfactual_training_lowers_the_gap():
    rng = random.Random(5)
    words = [sentence(rng, 12).lower() for _ in range(300)]
    made, y = [], []
    for i, w in enumerate(words):  # toxic texts name one group more often than others do
        toxic = i % 3 == 0
        made.append(w + (" idiot scum" if toxic else "") + (" women" if rng.random() < (0.8 if toxic else 0.1) else ""))
        y.append(int(toxic))
    from meshlore.llm.common import WordIds

    def gap(weight, monkey):
        monkey.setattr(toxicity, "PAIR_WEIGHT", weight)
        w, ids = toxicity.train(made, np.array(y), l1=0.2), WordIds()
        raw = lambda t: w[toxicity.slots(ids, t)[0]].sum()
        return float(np.mean([abs(raw(t + " women") - raw(t + " men")) for t in words[:60]])), raw("an idiot scum er") - raw("an er")

    with pytest.MonkeyPatch.context() as m:
        without, _ = gap(0.0, m)
        fair, toxic = gap(2.0, m)
    assert fair < 0.5 * without and toxic > 0


def test_classifiers_on_held_out_rows(spark):
    from meshlore.llm import quality

    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = sentence(rng, 40)
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text, f"s{i % 3}"))
        labels.append((i, 0 if bad else 1, int(bad)))
    rows += [(900, None, "x"), (901, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    held = spark.createDataFrame([r for r in labels if r[0] % 5] + [(3, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.quality_scores(spark, docs, held).collect()}
    assert len(got) == 402 and all(0 <= x <= 1 for x in got.values()) and got[900] == got[901]
    assert np.mean([(got[i] >= 0.5) == q for i, q, _ in labels if i % 5 == 0]) > 0.95
    assert {r.score for r in quality.quality_scores(spark, docs, held.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity_scores(spark, docs.limit(0), held).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    named = docs.withColumnRenamed("score", "lang").select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "w1 w2 w3 w4 w5 w6 w7 w8")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = spark.createDataFrame([(500, "before w1 w2 w3 w4 w5 w6 w7 w8 after", "en", "s", 1)], SCHEMA)
    named.union(leak).write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert now.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        if k == 2:
            assert len({r.text for r in now.select("text").collect()}) == now.count()
    assert 500 not in {r.doc_id for r in now.select("doc_id").collect()}
    assert 0 in {r.doc_id for r in now.select("doc_id").collect()}
    assert now.count() > 0
