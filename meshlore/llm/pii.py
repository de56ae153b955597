"""Personal data: base patterns, and further spans from a semi-Markov conditional random field.

Base kinds are found by their patterns, leftmost and without overlap for each kind; matches that fail their test are dropped.
The field scores whole candidate segments of a zone (a stretch of a line around digits, or after a name such as `password` and a sign of
assignment; zones end between runs, never inside one): features of the whole span - shape, groups of digits, checksums, length, letters, words
before it - have a weight for each type, and dynamic programming over segments picks boundaries and types jointly, the rest of the zone being
free. A segment has at most MAX_GROUPS groups of digits and MAX_LENGTH characters, or is one run without spaces of any length. The field is
trained here, by gradient steps on the conditional likelihood (forward and backward over segments), on sentences made from a fixed seed. It knows
the base kinds too, which compete for segments, but adds only kinds that no base pattern has: secret, tel, iban, ssn; a span that
touches a base span is not added.

Null and empty texts have no spans; repeated rows are scanned each; an empty table gives an empty result; offsets are code points, ends
exclusive; texts are scanned whole; extra columns are left out.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship

BASE, ADDED = ("email", "ip", "card", "phone"), ("secret", "tel", "iban", "ssn")
TYPES = BASE + ADDED
MAX_GROUPS, MAX_LENGTH, REACH = 7, 80, 48

LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_SIGN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
DIGIT = re.compile(r"[0-9]")
SPACE = re.compile(r"\s")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as in BASE, then by start. The email pattern is found from its @, so that long words cost no more than their length."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        m, start = DOMAIN.match(text, at), at
        if m:
            while start > end and text[start - 1] in LOCAL_SIGN:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                end = m.end()
        at = text.find("@", max(at + 1, end))
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


GROUP = re.compile(r"[0-9]+")
JOINT = re.compile(r"[\x20().-]{1,3}\Z")
RUN = re.compile(r"[^\s\"'=<>,;]+")
WORDS_BEFORE = re.compile(r"[^\W\d_]+")
#: A name of a secret with a sign of assignment; what follows may be one without a digit.
ASSIGNED = re.compile(r"(?i)(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|key|bearer|credentials?)[\"']?(?:\s*[:=]\s*|\s+is\s+|\s+)(?:bearer\s+)?[\"']?\Z")
NAMED = re.compile(r"(?i)(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|key|bearer|credentials?)[\"']?\s*[:=]")


def candidates(zone: str) -> list[tuple[int, int]]:
    """Segments that may be entities: runs without spaces that hold a digit or are assigned to a name of secrets, and up to MAX_GROUPS neighbouring groups of digits."""
    found = set()
    for m in RUN.finditer(zone):
        s = m[0].rstrip(".:!?)")
        start = m.start()
        if DIGIT.search(s) or (len(s) >= 6 and ASSIGNED.search(zone, max(0, start - 32), start)):
            found.add((start, start + len(s)))
        if (at := s.find(":")) > 0 and at + 1 < len(s) and ASSIGNED.search(s[: at + 1]):  # name:value
            found.add((start + at + 1, start + len(s)))
    groups = [m.span() for m in GROUP.finditer(zone)]
    for i, (a, _) in enumerate(groups):
        country = a > 1 and zone[a - 2 : a].isalpha() and zone[a - 2 : a].isupper() and not (a > 2 and zone[a - 3].isalnum())
        for lead in {a, a - 1 if a and zone[a - 1] in "+(" else a, a - 2 if a > 1 and zone[a - 2 : a] == "+(" or country else a}:
            for j in range(i, min(len(groups), i + MAX_GROUPS)):
                if j > i and not JOINT.match(zone[groups[j - 1][1] : groups[j][0]]):
                    break
                if groups[j][1] - lead <= MAX_LENGTH:
                    found.add((lead, groups[j][1]))
    return sorted(found)


def features(zone: str, a: int, b: int) -> list[str]:
    """Of the whole span and what stands before and after it."""
    s = zone[a:b]
    digits = NOT_DIGIT.sub("", s)
    shape = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "_" if c == " " else c for c in s))
    before = [w.lower() for w in WORDS_BEFORE.findall(zone[max(0, a - 24) : a])][-2:]
    sizes = "-".join(str(min(9, len(x))) for x in GROUP.findall(s)[:6])
    out = ["bias", "shape " + shape[:12], "sizes " + sizes + (" +" if s[0] == "+" else ""), "n " + str(min(20, len(digits))), "len " + str(min(64, len(s)) // 4)]
    out += ["word " + w for w in before] + ["left " + zone[a - 1 : a], "right " + zone[b : b + 1]]
    if zone[b : b + 1].isalnum() or (a and zone[a - 1].isalnum()):
        out.append("inside a word")
    if ASSIGNED.search(zone, max(0, a - 32), a):
        out.append("assigned" + (" sign" if any(c in ":=" for c in zone[max(0, a - 3) : a]) else ""))
        out.append(f"assigned n {min(20, len(digits)) // 3} len {min(24, len(s)) // 4}")
    if not digits:
        letters = [c for c in s if c.isalpha()]
        vowels = sum(c in "aeiouyAEIOUY" for c in letters)
        turns = sum(x.islower() and y.isupper() for x, y in zip(s, s[1:], strict=False))
        out.append(f"letters: vowels {10 * vowels // max(1, 2 * len(letters))}, turns {min(3, turns)}, signs {min(2, len(s) - len(letters))}, len {min(24, len(s)) // 4}")
    if "@" in s:
        out.append("at")
    if 13 <= len(digits) <= 19 and luhn(digits):
        out.append("luhn")
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", s) and all(int(x) < 256 for x in s.split(".")):
        out.append("octets")
    if len(s) >= 12 and re.fullmatch(r"[0-9a-fA-F]+", s):
        out.append("hex" if re.search("[a-fA-F]", s) else "long number")
    elif len(s) >= 12 and re.fullmatch(r"[A-Za-z0-9_/+-]+", s) and re.search("[A-Za-z]", s):
        out.append("key")
    return out


class SemiCrf:
    """Log-linear in (feature, type); a segmentation is a set of disjoint candidates with types, the free rest scores zero."""

    def __init__(self):
        self.w: dict[str, list[float]] = {}
        self.square: dict[str, list[float]] = {}

    def scores(self, zone: str, spans: list[tuple[int, int]]) -> tuple[list[list[str]], list[list[float]]]:
        fs = [features(zone, a, b) for a, b in spans]
        none = [0.0] * len(TYPES)
        return fs, [[sum(x) for x in zip(*(self.w.get(f, none) for f in row), strict=True)] for row in fs]

    def decode(self, zone: str) -> list[tuple[int, int, str]]:
        spans = candidates(zone)
        if not spans:
            return []
        _, scores = self.scores(zone, spans)
        best = [0.0] * (len(zone) + 1)
        back: list = [None] * (len(zone) + 1)
        by_end: dict[int, list[tuple[int, int]]] = {}
        for k, (a, b) in enumerate(spans):
            by_end.setdefault(b, []).append((a, k))
        for end in range(1, len(zone) + 1):
            best[end] = best[end - 1]
            for a, k in by_end.get(end, ()):
                top = max(scores[k])
                if best[a] + top > best[end]:
                    best[end], back[end] = best[a] + top, (a, TYPES[scores[k].index(top)])
        out, end = [], len(zone)
        while end > 0:
            if back[end]:
                out.append((back[end][0], end, back[end][1]))
                end = back[end][0]
            else:
                end -= 1
        return out[::-1]

    def learn(self, zone: str, gold: dict[tuple[int, int], str], rate: float = 0.5, l2: float = 1e-3) -> None:
        """One gradient step on the log-likelihood of the gold segments (those outside the candidates don't count)."""
        spans = candidates(zone)
        if not spans:
            return
        fs, scores = self.scores(zone, spans)
        add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
        each = [m + math.log(sum(math.exp(x - m) for x in s)) for s in scores for m in [max(s)]]
        n = len(zone)
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        ends: dict[int, list] = {}
        starts: dict[int, list] = {}
        for (a, b), e in zip(spans, each, strict=True):
            ends.setdefault(b, []).append((a, e))
            starts.setdefault(a, []).append((b, e))
        for i in range(1, n + 1):
            ahead[i] = ahead[i - 1]
            for a, e in ends.get(i, ()):
                ahead[i] = add(ahead[i], ahead[a] + e)
        for i in range(n - 1, -1, -1):
            behind[i] = behind[i + 1]
            for b, e in starts.get(i, ()):
                behind[i] = add(behind[i], behind[b] + e)
        for (a, b), row, s in zip(spans, fs, scores, strict=True):
            for t, x in enumerate(s):
                g = (gold.get((a, b)) == TYPES[t]) - math.exp(min(0.0, ahead[a] + x + behind[b] - ahead[n]))
                if abs(g) < 1e-4:
                    continue
                for f in row:
                    w, q = self.w.setdefault(f, [0.0] * len(TYPES)), self.square.setdefault(f, [1e-2] * len(TYPES))
                    d = g - l2 * w[t]
                    q[t] += d * d
                    w[t] += rate * d / math.sqrt(q[t])


def made_sentence(rng: random.Random) -> tuple[str, dict[tuple[int, int], str]]:
    """A sentence of invented words with entities and with numbers that are none."""
    word = lambda: "".join(rng.choice("th er on an re en at ti es or ion de la el ch ung".split()) for _ in range(rng.randint(1, 4)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))

    def card():
        d = rng.choice("456") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return d if rng.random() < 0.6 else rng.choice(" -").join(d[i : i + 4] for i in range(0, 16, 4))

    area = lambda: f"{num(3)}"
    signed = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ_-!@#$%") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    low = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    named = ["password", "Password", "passwd", "pwd", "token", "api_key", "secret", "key", "access_key", "auth_token", "client_secret", "passphrase"]

    def secret():
        body = rng.choice([lambda: hexa(rng.choice([16, 18, 32, 40, 64, 128])), lambda: mixed(rng.choice([10, 16, 20, 24, 40, 88, 200])), lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)),
                           lambda: "sk_live_" + hexa(24), lambda: "ghp_" + mixed(36), lambda: f"{low(rng.randint(4, 9))}{num(rng.randint(1, 4))}", lambda: f"{low(5).capitalize()}{num(2)}!", lambda: signed(rng.randint(8, 40)),
                           lambda: low(rng.choice([16, 24, 32, 64])), lambda: f"eyJ{mixed(20)}.eyJ{mixed(30)}.{mixed(40)}"])()
        lead = rng.choice(named) + rng.choice(["=", " = ", ": ", ":", ' = "', '="', ': "'])
        if any(c.isdigit() for c in body) and rng.random() < 0.3:
            lead = rng.choice(["password is ", "the password is ", "passphrase is ", "password ", "Authorization: Bearer ", "token "])
        return lead, body

    kinds = {
        "email": lambda: ("", f"{word()}.{num(2)}@{word()}{num(1)}.example.com"),
        "ip": lambda: ("", ".".join(str(rng.randint(0, 255)) for _ in range(4))),
        "card": lambda: ("", card()),
        "phone": lambda: ("", rng.choice([f"+1 ({area()}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(4)}", f"+{num(11)}"])),
        "tel": lambda: (rng.choice(["", "", "call ", "phone ", "phone: ", "tel ", "tel. ", "fax ", "mobile ", "cell: ", "ring me at "]), rng.choice([f"({area()}) {num(3)}-{num(4)}", f"{area()}-{num(3)}-{num(4)}", f"{area()}.{num(3)}.{num(4)}", f"{area()} {num(3)} {num(4)}"])),
        "secret": secret,
        "iban": lambda: (rng.choice(["", "iban ", "IBAN: ", "account "]), rng.choice([lambda c: c + num(20), lambda c: c + num(2) + "".join(" " + num(4) for _ in range(4)) + " " + num(2)])(rng.choice(["DE", "FR", "ES", "GB", "NL", "IT"]))),
        "ssn": lambda: (rng.choice(["", "ssn ", "SSN: ", "social security ", "social security number "]), f"{num(3)}-{num(2)}-{num(4)}"),
    }
    label = lambda: rng.choice(["order", "order no ", "ref", "reference", "invoice", "ticket", "case", "item", "serial", "part number", "id", "isbn", "tracking", "flight", "version", "model"]).strip()
    like = lambda: rng.choice([f"{area()}-{num(3)}-{num(4)}", f"{num(3)}-{num(2)}-{num(4)}", f"{area()} {num(3)} {num(4)}", f"{num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{num(4)}-{num(4)}", f"{num(10)}", f"{mixed(12)}"])
    none = [lambda: num(rng.randint(1, 6)), lambda: f"{num(2)}.{num(2)}", lambda: f"20{num(2)}-{num(2)}-{num(2)}", lambda: f"{num(1)}.{num(1)}.{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: f"{num(2)}-{num(2)}", lambda: f"{num(2)}%", lambda: word() + num(2), lambda: f"{num(12)}", lambda: f"20{num(2)}", lambda: f"{num(1)},{num(3)}",
            lambda: f"{label()} {like()}", lambda: f"{label()}: {like()}", lambda: f"{rng.choice(['commit', 'sha', 'md5', 'checksum', 'hash', 'digest'])} {hexa(rng.choice([8, 32, 40, 64]))}", lambda: f"{rng.choice(named)}{rng.choice([' = ', ': ', '='])}{rng.choice([num(1), num(2), 'none', 'true', 'null', 'required', word(), word() + ' ' + word(), 'unknown', 'missing'])}",
            lambda: f"1{num(3)}-1{num(3)}", lambda: f"{num(3)} {num(3)} {num(3)}", lambda: f"http://{word()}.org/{word()}/{num(5)}/{word()}-{num(3)}.html", lambda: f"{num(2)}.{num(2)}.20{num(2)}", lambda: f"{num(4)} {num(4)} {num(4)}"]
    text, gold = "", {}
    for _ in range(rng.randint(4, 9)):
        r = rng.random()
        if r < 0.25:
            kind = rng.choice(TYPES)
            lead, s = kinds[kind]()
            text += lead
            gold[len(text), len(text) + len(s)] = kind
            text += s + ('"' if lead.endswith('"') else "")  # a run ends at a quote
        elif r < 0.45:
            text += rng.choice(none)()
        else:
            text += word()
        text += rng.choice([" ", " ", " ", ", ", ". "])
    return text, gold


@lru_cache(maxsize=1)
def trained(sentences: int = 1500, epochs: int = 3, seed: int = 3) -> SemiCrf:
    rng, model = random.Random(seed), SemiCrf()
    made = [made_sentence(rng) for _ in range(sentences)]
    for _ in range(epochs):
        rng.shuffle(made)
        for text, gold in made:
            model.learn(text, gold)
    model.square = {}
    return model


def zones(text: str) -> Iterator[tuple[int, str]]:
    """(offset, stretch) around digits and after names of secrets: REACH characters each way within the line, and on to the end of a run; stretches don't overlap."""
    start = end = -1
    marks = sorted([m.span() for m in GROUP.finditer(text)] + [m.span() for m in NAMED.finditer(text)])
    for first, last in marks:
        if last <= end:
            continue
        a, b = max(0, first - REACH), min(len(text), last + REACH)
        a, b = max(0, a, end if a < end <= first else 0), b
        if (x := text.rfind("\n", a, first)) >= 0:
            a = x + 1
        else:
            while a > max(0, end) and not text[a - 1].isspace():
                a -= 1
        if (x := text.find("\n", last, b)) >= 0:
            b = x
        elif m := SPACE.search(text, b):
            b = m.start()
        else:
            b = len(text)
        if a <= end and start >= 0:
            end = max(end, b)
        else:
            if start >= 0:
                yield start, text[start:end]
            start, end = a, b
    if start >= 0:
        yield start, text[start:end]


def added_spans(model: SemiCrf, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    out = []
    for at, zone in zones(text):
        for a, b, kind in model.decode(zone):
            a, b = a + at, b + at
            if kind in ADDED and not any(x < b and a < y for _, x, y in base):
                out.append((kind, a, b))
    return sorted(out, key=lambda x: (TYPES.index(x[0]), x[1]))


def find_pii(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>): base spans first, by kind as in TYPES, then by start."""
    ship(spark)
    model = spark.sparkContext.broadcast(trained())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        for batch in batches:
            out = []
            for x in batch.column(1):
                text = x.as_py() or ""
                base = base_spans(text)
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in base + added_spans(field, text, base)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark, read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), *[count(k) for k in ADDED], F.size("spans").cast("long").alias("n_spans"))
