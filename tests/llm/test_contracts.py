"""The eleven queries as they are called: names, types and rows on a folder of messy tables, and on empty ones."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from meshlore.llm import decontaminate, line_dedup, packing, pii, token_counts, toxicity
from meshlore.llm.queries import QUERIES
from meshlore.llm.tokens import default_path, encoder

#: Names that operators use themselves stand for extra columns.
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score string, did string, _d string, key string, line_dedup_n string, _kept string, leak string, toxicity string"
COLUMNS = {
    "op1_nearest": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2_repeats": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op3_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op4_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op5_decontaminate": {"doc_id": "bigint", "item_id": "bigint", "similarity": "double"},
    "op6_token_counts": {"doc_id": "bigint", "n_tokens": "bigint"},
    "op7_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op8_lines": {"doc_id": "bigint", "n_removed": "int"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


def prose(rng, n):
    out, left = [], 0
    for _ in range(n):
        left -= 1
        w = rng.choice("bdfgklmnprst") + rng.choice(["ar", "el", "io", "un"]) + str(rng.randrange(900)) * (rng.random() < 0.2) + rng.choice(["na", "ti", "so", "ré"])
        out.append(w + ("." if left <= 0 and out else ""))
        left = rng.randint(5, 14) if left <= 0 else left
    return " ".join(out)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(21)
    base = [prose(rng, rng.randint(1, 220)) for _ in range(40)]
    items = [(i, prose(rng, 12 + 3 * i)) for i in range(8)] + [(8, None), (9, ""), (10, base[3]), (None, "w1 w2 w3 w4 w5 w6 w7")]
    passage = prose(rng, 70)
    texts = [*base, *base[:5], *(b + "\n" + passage for b in base[5:9]), *(prose(rng, 9) + " " + t + " " + prose(rng, 9) for _, t in items[:8])]
    texts += [None, "", " \n ", "x", "mail a.b@c.example.org now +1 202 555 0143 or 10.0.0.7", "4111 1111 1111 1111", 'token = "0f3a9c81d2e4b5a60f3a9c81d2e4b5a6"', "w1 w2 w3 w4 w5 w6 w7"]
    texts += [prose(rng, 30_000), ("Again and again. " * 4000).strip(), "a" * 50_000]
    texts += ["you idiot scum " + b for b in base[10:14]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, base[2]), (2, base[2]), (None, base[4]), (None, None), (None, base[30]), (7, "another text of the same id")]
    labels = [(i, int(i % 3 > 0), int("idiot" in (t or ""))) for i, t in rows if i is not None and i % 2 == 0] + [(1, None, None), (None, 1, 1), (0, 0, 0)]
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    vectors += [(300 + i, vectors[20][1]) for i in range(40)] + [(400, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7), (460, [None] + [1.0] * 7), (20, vectors[20][1]), (None, [1.0] * 8), (480, [1.0, 2.0]), (481, [2.0, 1.0])]
    return rows, items, labels, vectors


@pytest.fixture(scope="module")
def folders(spark, tables, tmp_path_factory):
    rows, items, labels, vectors = tables
    out = []
    for name, full in (("messy", True), ("empty", False)):
        root = str(tmp_path_factory.mktemp(name))
        made = {
            "documents": ([(i, t, "en", f"s{k % 2}", len(t or ""), *(f"{c}{k}" for c in "abcdefgh")) for k, (i, t) in enumerate(rows)], DOCUMENTS),
            "benchmark": ([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string"),
            "labels": ([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, text string"),
            "embeddings": ([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, score int"),
        }
        for table, (data, schema) in made.items():
            spark.createDataFrame(data if full else [], schema).repartition(3).write.parquet(f"{root}/{table}.parquet")
        out.append(root)
    return out


@pytest.fixture(scope="module")
def results(spark, folders):
    kept = {}

    def get(name):
        if name not in kept:
            kept[name] = QUERIES[name](spark, folders[0]).cache()
        return kept[name]

    return get


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_empty_tables(spark, folders, results, name):
    have = dict(results(name).dtypes)
    assert all(have.get(c) == t for c, t in COLUMNS[name].items()), have
    assert QUERIES[name](spark, folders[1]).count() == 0


def test_nearest(results, tables):
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in tables[3] if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    by: dict = {}
    for r in results("op1_nearest").collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == {i for i in vectors if i % 20 == 0}
    hit = want_n = 0
    for q, got in by.items():
        scores = {i: float((v * vectors[q]).sum()) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])}
        want = sorted(scores, key=lambda i: (-scores[i], i))[:20]
        got.sort()
        assert [r for r, _, _ in got] == list(range(1, len(want) + 1))
        assert [s for _, _, s in got] == pytest.approx([scores[i] for _, i, _ in got], abs=1e-12)
        assert [(-round(s, 9), i) for _, i, s in got] == sorted((-round(s, 9), i) for _, i, s in got)
        hit, want_n = hit + len({i for _, i, _ in got} & set(want)), want_n + len(want)
    assert hit >= 0.9 * want_n


def test_repeats(results, tables):
    raw = [(i, (t or "").encode()) for i, t in tables[0]]
    n = Counter(b[j : j + 200] for _, b in raw for j in range(len(b) - 199))
    want = []
    for i, b in raw:
        cover = np.zeros(len(b) + 2, bool)
        for j in range(len(b) - 199):
            if n[b[j : j + 200]] > 1:
                cover[j + 1 : j + 201] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~cover[1:-1]])
        want.append((i, len(b), len(b) - len(kept), int((np.diff(cover.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r[c] for c in COLUMNS["op2_repeats"]) for r in results("op2_repeats").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_packing(results, tables):
    enc, pieces, sequences = encoder(default_path()), {}, {}
    whole = Counter()
    for i, t in tables[0]:
        ids = np.array(enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        whole[i, len(ids)] += len(ids)
        pieces.setdefault((i, len(ids)), ids)
    for r in results("op3_packing").collect():
        ids = pieces.get((r.doc_id, r.doc_tokens))
        whole[r.doc_id, r.doc_tokens] -= r.length
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert not any(whole.values())
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= packing.WINDOW
    total = sum(n for parts in sequences.values() for _, n in parts)
    assert total > 0.9 * packing.WINDOW * len(sequences)


def test_fingerprints(results, tables):
    def one(t):
        words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))) if w]
        h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    rows = [(i, one(t)) for i, t in tables[0]]
    prints = sorted({f for _, f in rows})
    comp = {f: f for f in prints}
    for _ in prints:
        changed = False
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= 2 and comp[a] > comp[b]:
                    comp[a], changed = comp[b], True
        if not changed:
            break
    least = {}
    for i, f in rows:
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    want = sorted(((i, f"{f:016x}", least.get(comp[f])) for i, f in rows), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in results("op4_simhash").collect()), key=repr) == want


def test_leaks(results, tables):
    from tests.llm.test_whole_jobs import brute_leaks

    words = lambda t: re.findall(r"\w+", (t or "").lower())
    items = [(i, words(t)) for i, t in tables[1] if words(t)]
    want = [(d, items[k][0]) for d, t in tables[0] if len(t or "") < 20_000 for k in brute_leaks([w for _, w in items], words(t))]
    got = [(r.doc_id, r.item_id) for r in results("op5_decontaminate").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and all(r.similarity >= decontaminate.SIMILARITY for r in results("op5_decontaminate").collect())


def test_token_counts(results, tables):
    enc = encoder(default_path())
    got = Counter()
    for r in results("op6_token_counts").collect():
        got[r.doc_id] += r.n_tokens
    want = Counter()
    for k, (i, t) in enumerate(tables[0]):
        want[i] += len(enc.tokenizer.encode(f"s{k % 2}\n" + (t or ""), add_special_tokens=False).ids)
    assert got == want and token_counts.RULES[0] == "first"


def test_pii(results, tables):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def holds(kind, m):
        digits = re.sub("[^0-9]", "", m)
        twice = [int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))]
        return {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m.split(".")), "card": 16 <= len(digits) <= 19 and sum(twice) % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]

    want = []
    for i, t in tables[0]:
        t = "" if t and len(t) == 50_000 else t or ""  # the plain pattern is quadratic there
        spans = [(k, *m.span()) for k, p in kinds.items() for m in re.finditer(p, t) if holds(k, m[0])]
        want.append((i, *(sum(k == s[0] for s in spans) for k in kinds), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    rows = results("op7_pii").collect()
    assert sorted((tuple(r[c] for c in list(COLUMNS["op7_pii"])[:-1]) for r in rows), key=repr) == sorted(want, key=repr)
    assert any(r.spans.startswith("secret:") for r in rows) and all(x.split(":")[0] in pii.TYPES for r in rows for x in r.spans.split(",") if x)


def test_lines(results, tables):
    from tests.llm.test_operators import brute_lines

    short = [(i, t) for i, t in tables[0] if i is not None and len(t or "") < 20_000]
    order = sorted(dict.fromkeys(short), key=lambda x: x[0])
    rows = {r.doc_id: r for r in results("op8_lines").collect()}
    # the two rows without an id and with lines come first
    free = [t for i, t in tables[0] if i is None and t]
    kept = brute_lines(free + [t for _, t in order], line_dedup.MIN_WORDS)[len(free) :]
    for (i, _), want in zip(order, kept, strict=True):
        assert i == 7 or rows[i].kept_sha256 == hashlib.sha256(want.encode()).hexdigest(), i  # two texts have id 7


@pytest.mark.parametrize(("name", "of", "rest"), [("op9_toxicity", 4, 2), ("op10_quality", 5, 0)])
def test_scores(results, tables, name, of, rest):
    rows = results(name).collect()
    assert sorted((r.doc_id, r.held_out) for r in rows if r.doc_id is not None) == sorted((i, zlib.crc32(str(i).encode()) % of == rest) for i, _ in tables[0] if i is not None)
    assert [r.held_out for r in rows if r.doc_id is None] == [False] * 3
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (40 + 17, 40 + 18)}) == 1  # null and empty


def test_neutral_mentions_raise_no_alarm():
    """Trained on texts whose toxic part names one group more often; neutral sentences that name it, held out, score low."""
    rng = random.Random(3)
    texts, y = [], []
    for i in range(400):
        toxic = i % 3 == 0
        texts.append(prose(rng, 12) + (" idiot scum" if toxic else "") + (" women" if rng.random() < (0.7 if toxic else 0.1) else ""))
        y.append(int(toxic))
    ids, neutral = toxicity.WordIds(), [prose(rng, 12) + " women " + prose(rng, 5) for _ in range(100)]
    alarms = {}
    for weight in (0.0, 2.0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(toxicity, "PAIR_WEIGHT", weight)
            w = toxicity.train(texts, np.array(y), l1=0.2)
            alarms[weight] = np.mean([toxicity.sigmoid(w[toxicity.slots(ids, t)[0]].sum() + w[-1]) >= toxicity.THRESHOLD for t in neutral])
    assert alarms[2.0] <= 0.05 and alarms[2.0] <= alarms[0.0]


def test_pipeline(spark, folders, tables):
    out = corpus_pipeline.run(spark, folders[0])
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert set(packing.PIECES.replace(",", "").split()[::2]) == set(out.columns)
    leaked = {d for d, t in tables[0] if t and any(w and w in t for _, w in tables[1][:8])}
    assert not leaked & ids and {0, 1} <= ids
    assert corpus_pipeline.run(spark, folders[1]).count() == 0


def test_pipeline_stages_keep_columns_and_rows_without_id(spark, folders):
    now = spark.read.parquet(f"{folders[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folders[0])
        assert out.columns == now.columns
    left = corpus_pipeline.decontaminate(spark, spark.createDataFrame([(None, "w1 w2 w3 w4 w5 w6 w7"), (None, "quite clean"), (5, None)], "doc_id long, text string"), folders[0])
    assert sorted(r.text or "" for r in left.collect()) == ["", "quite clean"]
